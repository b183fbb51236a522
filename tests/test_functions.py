"""Column functions on hand-made values (FIXTURES.md part B)."""

import unicodedata

from pyspark.sql import functions as F

from revmine.functions import arrays as AR
from revmine.functions import lexicon as L
from revmine.functions import text as X


def one(spark, value, col, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_mojibake_and_ipa(spark):
    assert one(spark, "it" + L.MOJIBAKE_APOSTROPHE + "s", X.fix_mojibake_apostrophe("t")) == "it’s"
    assert one(spark, "it" + L.MOJIBAKE_APOSTROPHE + "s", X.fix_mojibake_apostrophe("t", "'")) == "it's"
    got = one(spark, "IPAs and neipa, municipal; participate Ipa", X.collapse_ipa("t"))
    assert got == "ipa and ipa, ipa; ipa ipa"  # "particIPAte" too, like the original


def test_accent_strip_matches_nfkd(spark):
    text = "Crème straße Ñandú ﬁne … ½ Ⅻ ＡＢＣ naïve"
    want = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    assert one(spark, text, X.strip_accents_ascii("t")) == want
    assert one(spark, text, X.strip_accents_ascii("t", method="jvm")) == want


def test_accent_strip_in_pieces(spark):
    texts = [None if i % 7 == 0 else f"é{i}ﬁ" if i % 3 else f"plain {i}" for i in range(3 * X.STRIP_ROWS + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = {r["i"]: r["t"] for r in df.select("i", X.strip_accents_exact("t").alias("t")).collect()}
    assert got == {i: None if t is None else t.replace("é", "e").replace("ﬁ", "fi") for i, t in enumerate(texts)}


def test_tokens_after_cleaning(spark):
    toks = one(spark, "crème straße ab abc IPAs", X.tokenise(X.clean_for_tokens("t")))
    assert toks == ["creme", "strae", "abc", "ipa"]
    assert one(spark, "", X.tokenise(X.clean_for_tokens("t"))) == []


def test_sentences_keep_empties(spark):
    assert one(spark, "a.b;c!", X.split_sentences("t")) == ["a", "b", "c", ""]
    assert one(spark, "Good. Bad - really!", X.split_sentences_regexp("t")) == ["Good.", " Bad - really!."]


def test_word_count_and_guard(spark):
    assert one(spark, "  two   words ", X.word_count("t")) == 2
    assert one(spark, "x" * 499, X.char_length_guard("t")) is True
    assert one(spark, "x" * 500, X.char_length_guard("t")) is False


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,), (None,)], "x double")
    got = [r[0] for r in df.select(X.round_half_even("x").cast("int")).collect()]
    assert got == [0, 2, 2, 4, None]


def test_ngrams_short_arrays(spark):
    arr = F.split(F.col("t"), " ")
    assert one(spark, "a b c", X.ngrams(arr, 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "a", X.ngrams(arr, 2, 2)) == []


def test_label_argmax_ties_and_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.2, 0.5, 0.5), (0.1, 0.0, 0.3)], "a double, b double, c double")
    got = [r[0] for r in df.select(X.label_argmax(["a", "b", "c"])).collect()]
    assert got == ["a", "b", "c"]


def test_capitalise(spark):
    assert one(spark, "aROMA", X.capitalise("t")) == "Aroma"


def test_circular_pair_smooth_equals_in_place_loop(spark):
    d = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    ref = list(d)
    for i in range(len(ref)):
        ref[i] = (ref[i] + ref[(i + 1) % len(ref)]) / 2
    tot = sum(ref)
    want = [x / tot for x in ref]
    got = one(spark, d, AR.circular_pair_smooth("t"), "t array<double>")
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_circular_triple_smooth(spark):
    d = [1.0, 0.0, 0.0, 0.0]
    got = one(spark, d, AR.circular_triple_smooth("t"), "t array<double>")
    assert got == [1.0, 1.0, 0.0, 1.0]


def test_dominant_topic_first_on_tie(spark):
    v = [(2, 0.4), (0, 0.4), (1, 0.2)]
    got = one(spark, v, AR.dominant_topic("t"), "t array<struct<topic:int,prob:double>>")
    assert got == 2


def test_porter2_examples():
    from revmine.functions.stem import stem_word

    cases = {"consign": "consign", "consigned": "consign", "consistency": "consist", "consolatory": "consolatori",
             "conspiracy": "conspiraci", "generously": "generous", "running": "run", "happily": "happili",
             "dying": "die", "skies": "sky", "cries": "cri", "ties": "tie", "gas": "gas", "gaps": "gap",
             "hoped": "hope", "agreed": "agre", "relational": "relat", "hopefulness": "hope",
             "communism": "communism", "bowdlerize": "bowdler", "controll": "control"}
    assert {k: stem_word(k) for k in cases} == cases


def test_stem_operator(spark):
    from revmine.operators import text as T

    counts = spark.createDataFrame([("d", "running", 2), ("d", "run", 1), ("d", "hoped", 1)],
                                   "doc string, term string, tf bigint")
    got = sorted((r["term"], r["tf"]) for r in T.stem(counts, ["doc"]).collect())
    assert got == [("hope", 1), ("run", 3)]


def test_accent_strip_hands_on_pieces(spark, monkeypatch):
    monkeypatch.setattr(X, "STRIP_BYTES", 300)
    texts = [None if i % 7 == 0 else f"é{i}ﬁ" if i % 3 else "" for i in range(5 * X.STRIP_ROWS + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = {r["i"]: r["t"] for r in df.select("i", X.strip_accents_exact("t").alias("t")).collect()}
    assert got == {i: None if t is None else t.replace("é", "e").replace("ﬁ", "fi") for i, t in enumerate(texts)}
