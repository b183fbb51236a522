"""Hidden Markov tagger against brute force over all tag sequences; lemmas in context; language identifier."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from revmine.functions import text as X
from revmine.operators import clean as CL
from revmine.operators import language as LG
from revmine.operators import tagger as TG
from revmine.operators import text as T


def small_model(seed):
    rng = np.random.default_rng(seed)
    m = TG.HmmTagger.initial(["a", "dog", "saw", "runs"])
    k = len(TG.TAGS)
    m.start, table = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k + 1), size=k)
    m.move, m.stop = table[:, :-1], table[:, -1]
    m.emit = rng.dirichlet(np.ones(m.emit.shape[1]), size=k)
    return m


def paths(model, obs):
    for path in itertools.product(range(len(TG.TAGS)), repeat=len(obs)):
        p = model.start[path[0]] * model.emit[path[0], obs[0]]
        for a, b, o in zip(path, path[1:], obs[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, o]
        yield path, p * model.stop[path[-1]]


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_and_expected_counts_equal_brute_force(seed):
    m = small_model(seed)
    rng = np.random.default_rng(seed)
    sentences = [rng.integers(0, m.emit.shape[1], n) for n in (1, 2, 3, 4, 3, 0)]
    k = len(TG.TAGS)
    start, move, stop, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros(m.emit.shape), 0.0
    for s, got in zip(sentences, m.viterbi(sentences), strict=True):
        if not len(s):
            assert len(got) == 0
            continue
        every = list(paths(m, s))
        assert tuple(got) == max(every, key=lambda x: x[1])[0]
        total = sum(p for _, p in every)
        log += math.log(total)
        for path, p in every:
            start[path[0]] += p / total
            stop[path[-1]] += p / total
            for i, c in enumerate(path):
                emit[c, s[i]] += p / total
                if i:
                    move[path[i - 1], c] += p / total
    a, b, z, c, d = m.expected(sentences)
    assert np.allclose(a, start) and np.allclose(b, move) and np.allclose(z, stop) and np.allclose(c, emit) and math.isclose(d, log)


TEXTS = ["She saw the dog. He saw a cat. They saw it.", "The saw cuts wood. A saw is sharp! The big saw broke.", "The leaves fell on the road. He leaves the house; she leaves it.",
         "You must taste it. The taste is good. We taste the beer.", "I left the room. The dogs run. The better beer won.", None, "", "...", "She tasted the hoppy beers quickly."] * 3


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").repartition(3)
    return df, TG.fit_tagger(df, "t")


def test_rounds_end_by_the_tolerance(fitted):
    log = fitted[1].log_likelihood
    assert 2 <= len(log) <= 12 and log[-1] > log[0]


def test_one_word_two_lemmas(fitted):
    df, tagger = fitted
    got = {r["id"]: r["l"] for r in df.select("id", tagger.lemmas("t").alias("l")).collect()}
    assert got[0] == ["she", "see", "the", "dog", "see", "cat", "they", "see"]
    assert got[1][:2] == ["the", "saw"] and got[1].count("saw") == 3 and "see" not in got[1]
    assert got[2] == ["the", "leaf", "fall", "the", "road", "leave", "the", "house", "she", "leave"]
    assert got[5] is None and got[6] == [] and got[7] == []
    kept = df.select("id", tagger.lemmas("t", keep=["NN"]).alias("n"), tagger.lemmas("t", keep=["VB"], pattern=r"\p{L}+").alias("v")).where("id in (0, 3)").orderBy("id").collect()
    assert kept[0]["n"] == ["dog", "cat"] and kept[1]["n"].count("taste") == 1 and kept[1]["n"][-1] == "beer"
    assert kept[0]["v"] == ["see"] * 3 and kept[1]["v"][0] == kept[1]["v"][-1] == "taste"


def test_word_counts_and_clean_tokens_in_context(spark, fitted):
    df, tagger = fitted
    counts = {r["term"]: r["tf"] for r in T.word_counts(df.where("id < 3"), ["id"], "t", None, tokenizer=tagger.lemmas, clean=False).groupBy("term").agg(F.sum("tf").alias("tf")).collect()}
    assert counts["see"] == 3 and counts["saw"] == 3 and counts["leaf"] == 1 and counts["leave"] == 2
    rows = {r["id"]: r["tokens"] for r in T.clean_tokens(df, "t", tagger=tagger).collect()}
    assert rows[0] == ["see", "dog", "see", "cat", "see"] and rows[3] == ["taste", "taste", "good", "taste", "beer"]
    assert rows[5] is None and rows[6] == []


@pytest.mark.parametrize("run", [1, 5, 1 << 19])
@pytest.mark.parametrize("few", [0, 1000])
def test_runs_of_sentences_of_any_length(monkeypatch, run, few):
    monkeypatch.setattr(TG, "RUN_WORDS", run)
    monkeypatch.setattr(TG, "FEW", few)
    rng = np.random.default_rng(3)
    m = TG.HmmTagger.initial(["a", "dog", "saw", "runs"])
    sentences = [m.encode(rng.choice(["a", "dog", "saw", "runs", "x", "7", "quickly"], n).tolist()) for n in [3, 0, 1, 9, 1, 0, 4, 9, 2]]
    one = [m.expected([s]) for s in sentences]
    for got, want in zip(m.expected(sentences), zip(*one, strict=True), strict=True):
        assert np.allclose(got, sum(want))
    assert math.isclose(m.expected(sentences)[3].sum(), sum(map(len, sentences)))
    assert [x.tolist() for x in m.viterbi(sentences)] == [x.tolist() for s in sentences for x in m.viterbi([s])]
    assert m.viterbi([]) == [] and m.expected([])[4] == 0


def test_tags_keep_the_shape(spark):
    m = TG.HmmTagger.initial(["a", "dog"])
    rows = [(0, [["a", "dog"], [], ["7"]]), (1, None), (2, []), (3, [None, ["a"]])]
    got = {r["i"]: r["g"] for r in spark.createDataFrame(rows, "i int, s array<array<string>>").coalesce(1).select("i", m.tags("s").alias("g")).collect()}
    assert got == {0: [["DT", "NN"], [], ["CD"]], 1: None, 2: [], 3: [[], ["DT"]]}


def test_tags_after_accents_were_stripped(spark, fitted):
    df, tagger = fitted
    accents = spark.createDataFrame([("Crème",), ("plain",), (None,)], "a string")
    assert accents.select(X.strip_accents_ascii("a").alias("a")).collect() == [("Creme",), ("plain",), (None,)]
    assert df.select(tagger.tags(TG.words_of_sentences("t")).alias("g")).where("g is not null").count() == 24
    assert len(TG.fit_tagger(df, "t", max_rounds=1).log_likelihood) == 1


# --- language ---------------------------------------------------------------------------

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/documents.parquet").select(F.col("doc_id") + 10_000, "text", "lang").toDF("doc_id", "text", "lang"))
    model = LG.fit_language_model(docs.where("doc_id % 5 <> 0"))
    rows = LG.detect_language(docs.where("doc_id % 5 = 0"), "text", model).where(LG.letters("text") != "").collect()
    for lang in model.languages:
        mine = [r["lang_guess"] == lang for r in rows if r["lang"] == lang]
        assert len(mine) >= 10 and sum(mine) / len(mine) > 0.97, (lang, sum(mine), len(mine))


def brute_model(docs, max_grams):
    from collections import Counter

    counts, n = {}, Counter()
    for text, lang in docs:
        n[lang] += 1
        c = counts.setdefault(lang, Counter())
        for k in range(1, 5):
            c.update(text[i:i + k] for i in range(len(text) - k + 1))
    total = sum(counts.values(), Counter())
    known = sorted(total, key=lambda g: (-total[g], g))[:max_grams]
    sums = {x: sum(c[g] for g in known) for x, c in counts.items()}

    def score(text):
        out = {}
        for x, c in counts.items():
            s = math.log(n[x] / sum(n.values()))
            for k in range(1, 5):
                s += sum(math.log(c[g] + 1) - math.log(sums[x] + len(known)) for i in range(len(text) - k + 1) if (g := text[i:i + k]) in known)
            out[x] = s
        return out
    return score


@pytest.mark.parametrize("max_grams", [30, 50_000])
def test_language_scores_equal_brute_force(spark, max_grams):
    docs = [("Der Hund läuft!", "de"), ("Le chien court, été", "fr"), ("The dog runs 42", "en"), ("the 漢字 dog", "en"), ("Ein Hund", "de")]
    df = spark.createDataFrame(docs, "t string, l string")
    model = LG.fit_language_model(df, "t", "l", max_grams=max_grams)
    clean = [r["c"] for r in df.select(LG.letters("t").alias("c")).collect()]
    score = brute_model(list(zip(clean, [x for _, x in docs], strict=True)), max_grams)
    for text in [*clean, " x ", " le hund ", " 漢 "]:
        want = score(text)
        assert np.allclose(model.scores([text])[0], [want[x] for x in model.languages])


def test_language_of_odd_texts(spark):
    df = spark.createDataFrame([("der hund", "de"), ("the dog", "en"), ("the cat", "en")], "t string, l string")
    model = LG.fit_language_model(df, "t", "l")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "42 !?"), (4, "漢字"), (5, "hund " * 300_000), (6, "the")], "id long, t string")
    got = {r["id"]: r["lang_guess"] for r in LG.detect_language(odd, "t", model).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "en", 5: "de", 6: "en"}
    assert [r["id"] for r in CL.filter_language(odd, "de", lang_col=None, text="t", model=model).collect()] == [5]
    with pytest.raises(ValueError):
        CL.filter_language(odd, "de", lang_col=None, text="t")
    with pytest.raises(ValueError):
        LG.fit_language_model(df.where("l = 'xx'"), "t", "l")


def test_language_texts_beyond_the_bound_are_not_learnt(spark):
    df = spark.createDataFrame([(f"word{chr(97 + i)} text", "en") for i in range(20)], "t string, l string")
    assert math.isclose(math.exp(LG.fit_language_model(df, "t", "l", max_docs=3).prior[0]), 1.0)
    assert len(LG.fit_language_model(df, "t", "l", max_docs=3).keys) < len(LG.fit_language_model(df, "t", "l").keys)
