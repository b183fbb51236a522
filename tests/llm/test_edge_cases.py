"""Very long rows and tables without rows, where an operator's own tests have none."""

import public_tokenizers
from pyspark.sql import functions as F

from llm_fixtures import no_docs  # noqa: F401
from revmine.llm import chat_examples as CE, token_files as TF, url_digests as UD

RULES = [("net/", "block"), ("example.net/en/", "allow")]


def test_a_very_long_conversation_text(spark):
    text = "</turn> \\### Assistant: " * 60_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    row = CE.digests(CE.format_chats(df)).first()
    assert row["n_turns"] == 3 and row["loss_chars"] == len(text)


def test_examples_beyond_the_limit_keep_their_row(spark):
    df = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(8)] + [(2, 0, "assistant", "alone")],
                               "conv_id long, turn long, role string, text string")
    out = CE.format_chats(df)
    whole = {(r["conv_id"], r["example"]): r["context"] for r in CE.expanded(out).collect()}
    some = {(r["conv_id"], r["example"]): r["context"] for r in CE.expanded(out, max_context_chars=60).collect()}
    assert whole.keys() == some.keys() and None not in whole.values() and None in some.values()
    assert all(v is None or v == whole[k] for k, v in some.items()) and all(v is not None for k, v in some.items() if len(whole[k]) <= 60)


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 20_000 + "net/x", "http://example.net/en/" + "y" * 500_000, "://", "http://x.org/" + "?" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    one = {r["id"]: (r["rule"], r["verdict"]) for r in UD.judge(df, RULES, []).collect()}
    assert one[0] == ("net/", "block") and one[1] == ("example.net/en/", "allow") and one[2] == (None, "block")


def test_tables_without_rows(spark, no_docs, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string")
    blocked = spark.createDataFrame([("spam.example",)], "entry string")
    rules = spark.createDataFrame(RULES, "entry string, verdict string")
    assert UD.judge(none, RULES, ["spam.example"]).collect() == []
    assert UD.judge_by_join(none, rules, blocked).collect() == []
    some = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert UD.judge_by_join(some, rules.where("entry = 'no'"), blocked.where("entry = 'no'")).count() == 2
    files = TF.write_token_files(no_docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    assert TF.export_files(files, str(tmp_path)).where(F.lit(True)).collect() == []
