import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import no_docs, odd  # noqa: F401
from revmine.llm import chat_examples as CE, rule_ledger as RL, url_digests as UD


# --- rules --------------------------------------------------------------------

def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


COLS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def test_measures_equal_brute_force(spark, odd):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b#", "cé", "d|d", "漢字\n", "\n\n", "x\ty"]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (df, odd):
        got = sorted(((r["id"], *(r[c] for c in COLS)) for r in RL.ledger(frame).collect()), key=str)
        assert got == sorted(((r["doc_id"], *measures(r["text"])) for r in frame.collect()), key=str)


def test_policies_and_ablation(spark, odd, no_docs):
    rows = RL.ledger(odd)
    got = RL.verdicts(rows, RL.PRODUCTION).collect()
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = RL.accept(odd)
    assert kept.schema == odd.schema and kept.count() == sum(r["kept"] for r in got)
    # an ablation is what the policy without the rule keeps
    table = {r["rule"]: r for r in RL.ablation(rows, RL.PRODUCTION).collect()}
    assert set(table) == set(RL.RULES)
    for rule, r in table.items():
        less = RL.Policy("less", tuple(x for x in RL.RULES if x != rule))
        assert r["n_kept_without"] == rows.where(less.accepts(F.col("fail_bits"))).count()
        assert r["n_failed"] == rows.where(F.col("fail_bits").bitwiseAND(1 << RL.RULES[rule][0]) != 0).count()
    assert RL.ledger(no_docs).collect() == [] and RL.accept(no_docs).collect() == []


def test_accept_with_clashing_names(spark):
    df = spark.createDataFrame([("some words that are long enough to pass every one of the rules", 1, 2)], "text string, _rules int, `__rules.w` int")
    assert RL.accept(df).collect() == df.collect()


# --- chat -----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, position string, segment long"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(mine), sha(said), len(loss), sha(loss))
    return out


ROWS = [(1, 0, "system", "be & <good>"), (1, 1, "user", "&lt;|end|&gt; <|end|>"), (1, 2, "assistant", "\\### Assistant: </turn> ok"),
        (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, None, "no reply"), (3, 5, "assistant", "late"), (3, 5, "assistant", "late"),
        (3, None, "user", "first"), (None, 0, "assistant", "no id 😀"), (4, 0, "a|>b\n", "role with marks"), (5, 300, "assistant", "far"), (5, 2, "user", "near")]


def test_round_trip(spark):
    out = CE.format_chats(chats(spark, ROWS))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in CE.digests(out).collect()}
    assert got == expected(ROWS)
    stream = {}
    for r in sorted(out.segments.collect(), key=lambda r: (str(r["conv_id"]), r["position"])):
        s = stream.get(r["conv_id"], "")
        assert r["begin"] == len(s) and r["end"] == len(s) + len(r["segment"])
        stream[r["conv_id"]] = s + r["segment"]
    for e in CE.expanded(out).collect():
        mine = [x for x in out.examples.where(F.col("conv_id").eqNullSafe(e["conv_id"]) & (F.col("example") == e["example"])).collect()][0]
        assert e["context"] == stream[e["conv_id"]][:mine["context_end"]]
        assert "<" not in e["target"][e["loss_begin"]:e["loss_end"]]
    assert CE.expanded(out, max_context_chars=0).count() == 1  # the conversation without an id begins with a reply
    empty = CE.format_chats(spark.createDataFrame([], TURNS))
    assert CE.digests(empty).collect() == [] and empty.examples.collect() == []


def test_examples_hold_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(CE, "SHARE", 4)
    rows = ROWS + [(9, i, "assistant" if i % 3 else "user", f"t<{i}> é😀" * (i % 5)) for i in range(41)]
    out = CE.format_chats(chats(spark, rows))
    segments = sorted(out.segments.collect(), key=lambda r: r["position"])
    found = out.examples.collect()
    for e in found:
        before = [s["segment"] for s in segments if s["conv_id"] == e["conv_id"] and s["position"] < e["example"]]
        assert e["context"] == "".join(before) and e["context_turns"] == len(before)
    assert len(found) == sum(r[2] == "assistant" for r in rows)


def test_long_conversation_in_blocks(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3 * CE.BLOCK + 7)]
    out = CE.format_chats(chats(spark, rows))
    assert [r["position"] for r in out.segments.orderBy("begin").collect()] == list(range(len(rows)))
    r = CE.digests(out).first()
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(rows)[9]
    total, upto = 0, 0
    for s in out.segments.orderBy("begin").collect():
        upto += len(s["segment"])
        total += upto if s["segment"].startswith("<|assistant") else 0
    assert r["example_chars"] == total and r["formatted_chars"] == upto


def test_expanded_has_the_lengths_that_digests_report(spark):
    rows = ROWS + [(9, i, "assistant" if i % 2 else "user", f"t<{i}>" * (i % 5)) for i in range(41)]
    out = CE.format_chats(chats(spark, rows))
    examples = {(str(r["conv_id"]), r["example"]): (r["context_end"], len(r["target"])) for r in out.examples.collect()}
    written, total = {}, {}
    for e in CE.expanded(out).collect():
        written[str(e["conv_id"]), e["example"]] = len(e["context"]), len(e["target"])
        total[e["conv_id"]] = total.get(e["conv_id"], 0) + len(e["context"]) + len(e["target"])
    assert written == examples and len(written) > 20
    got = {r["conv_id"]: r["example_chars"] for r in CE.digests(out).collect()}
    assert got == {c: total.get(c, 0) for c in got}


# --- urls -------------------------------------------------------------------------

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("h.example.org/fr/x", "block"), ("bare.io", "block")]
URLS = ["http://a.example.net/en/1", "HTTPS://A.Example.NET/en", "http://net/", "http://net", "x://evilnet/", "http://www.example.com/de/?q", "http://example.com/DE/",
        "http://s.org/fr/1#x", "http://h.example.org/fr/xyz", "http://h.example.org/fr/", "a://b://example.net/", "no scheme", "", None, "http://", "http:///net/",
        "http://u@bare.io:80/", "http://sub.bare.io", "http://bare.io?x", "http://..net/", "http://bad.host/x", "http://é.NET/ü", "http://a.example.net/en/1"]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest).group()
        path = re.match(r"(?s)[^?#]*", rest[len(host):]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = []
    for rule, verdict in RULES:
        h, p = (rule[:rule.index("/")], rule[rule.index("/"):]) if "/" in rule else (rule, "")
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((len(rule), rule, verdict))
    if fit:
        return (host, path, *max(fit)[1:])
    return (host, path, None, "block" if not host or host == "bad.host" else "allow")


def pages(spark):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")


def test_judge_equals_brute_force(spark):
    got = {r["id"]: tuple(r)[1:] for r in UD.judge(pages(spark), RULES, ["bad.host"]).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}


def test_join_gives_the_same_rules(spark):
    a = {r["id"]: (r["rule"], r["verdict"]) for r in UD.judge(pages(spark), RULES).collect()}
    rules = spark.createDataFrame(RULES, "entry string, verdict string")
    b = {r["id"]: (r["rule"], r["verdict"]) for r in UD.judge_by_join(pages(spark), rules).collect()}
    assert a == b and len(a) == len(URLS)


def test_join_gives_the_same_rules_and_block_list(spark):
    """A listed entry longer than an allow rule, one that is also a rule, one with a path, a parent domain, repeats and a null."""
    rules = [*RULES, ("ok.example.net/", "allow"), ("both.io", "allow")]
    listed = ["bad.host", "bad.host", "a.example.net/en/1", "both.io", "www.ok.example.net/long/path", "x.y/deep/", "evil.com"]
    urls = [*URLS, "http://www.ok.example.net/long/path/z", "http://both.io/", "http://x.y/deep/1", "http://x.y/dee", "http://sub.evil.com", "http://notevil.com/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    a = {r["id"]: tuple(r)[1:] for r in UD.judge(frame, rules, listed).collect()}
    rules_df = spark.createDataFrame(rules, "entry string, verdict string")
    blocked = spark.createDataFrame([(e, 1) for e in [*listed, None]], "entry string, verdict int")
    b = {r["id"]: tuple(r)[1:] for r in UD.judge_by_join(frame, rules_df, blocked).collect()}
    assert a == b and len(a) == len(urls)
    said = {urls[i]: v[-2:] for i, v in b.items()}
    assert said["http://www.ok.example.net/long/path/z"] == ("ok.example.net/", "allow") and said["http://both.io/"] == ("both.io", "allow")
    assert said["http://bad.host/x"] == said["http://x.y/deep/1"] == said["http://sub.evil.com"] == (None, "block")
    assert said["http://x.y/dee"] == said["http://notevil.com/"] == (None, "allow")
    only = UD.judge_by_join(frame, rules_df.limit(0), blocked)
    assert {r["id"]: tuple(r)[1:] for r in only.collect()} == {r["id"]: tuple(r)[1:] for r in UD.judge(frame, [], listed).collect()}


def test_collisions_are_confirmed(spark, monkeypatch):
    """With a digest of two values every probe collides; the stored strings still decide."""
    monkeypatch.setattr(UD.xxhash, "xxh3_64_intdigest", lambda d: len(d) % 2)
    index = UD.build_index(spark, ["a", "bb", "ccc", "dddd"])
    opened = index.open()
    assert UD.probe(opened, ["a", "b", "bb", "ccc", "xxx", "dddd", "", "bb"]).tolist() == [True, False, True, True, False, True, False, True]


def test_lists_and_bounds(spark):
    with pytest.raises(ValueError, match="judge_by_join"):
        UD.build_index(spark, ["abc.example/"], max_index_bytes=10)
    got = UD.judge(pages(spark), []).collect()
    assert {r["verdict"] for r in got if r["host"]} == {"allow"} and all(r["rule"] is None for r in got)
    both = UD.judge(pages(spark), [("net/", "allow"), ("net/", "block")]).where("rule is not null").collect()
    assert {r["verdict"] for r in both} == {"block"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert UD.judge(empty, RULES).collect() == []
