
import math

import pytest
from pyspark.sql import functions as F

from revmine.operators import aggregate as A
from revmine.operators import clean as CL
from revmine.operators import joins as J
from revmine.operators import scoring as SC
from revmine.operators import stats as M
from revmine.operators import text as T
from revmine.operators import window as W


def rows(df, *cols):
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(got, key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))


def test_drop_all_duplicates_keeps_only_singles(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,)], "id int")
    assert rows(CL.drop_all_duplicates(df, "id"), "id") == [(1,)]
    dc = CL.duplicate_count(df, "id").first()
    assert (dc["duplicate_rows"], dc["duplicated_keys"]) == (5, 2)


def test_classify_location_and_state(spark):
    df = spark.createDataFrame([("United States, Oregon",), ("United States",), ("Belgium",), (None,),
                                ("United States, Atlantis",)], "location string")
    cats = [r[0] for r in df.select(CL.classify_location("location")).collect()]
    assert cats == ["United States", "United States", "Other Countries", None, "United States"]
    st = CL.state_from_location(df, "location").collect()
    assert [(r["state"], r["state_code"]) for r in st] == [("Oregon", "OR"), (None, None), (None, None),
                                                         (None, None), ("Atlantis", None)]
    norm = CL.normalise_country(df, "location")
    assert rows(norm, "location") == [("Belgium",), ("United States of America",), ("United States of America",),
                                      ("United States of America",)]
    us = CL.us_vs_other_users(df, "location").first()
    assert (us["home"], us["other"]) == (3, 2)


def test_quantile_split_threshold_value_goes_negative(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0), ("b", 5.0),
                                ("a", None)], "e string, r double")
    lab = W.quantile_split(df, "e", "r", 10)
    got = rows(lab, "e", "r", "polarity")
    # a: p10 of 1..4 = 1.3 -> only 1.0 negative; b: all equal -> all negative (empty positive side)
    assert ("a", 1.0, "negative") in got and ("a", 2.0, "positive") in got
    assert ("b", 5.0, "negative") in got
    assert ("a", None, None) in got


def test_expert_weight_equals_replication(spark):
    df = spark.createDataFrame([("x", "good beer good", True), ("x", "bad beer", False), ("y", "beer", True)],
                               "e string, text string, expert boolean")
    weighted = T.word_counts(T.build_corpus(df, "e", "text", expert="expert", expert_weight=3), ["e"])
    copies = T.word_counts(T.replicate_experts(df, "expert", 3), ["e"], weight=None)
    assert rows(weighted, "e", "term", "tf") == rows(copies, "e", "term", "tf")
    assert ("x", "good", 6) in rows(weighted, "e", "term", "tf")


def test_tfidf_is_l2_normalised_and_smoothed(spark):
    counts = spark.createDataFrame([("d1", "a", 2), ("d1", "b", 1), ("d2", "a", 1)], "doc string, term string, tf bigint")
    sc = T.tfidf_scores(counts, ["doc"])
    norms = {r["doc"]: r["n"] for r in sc.groupBy("doc").agg(F.sqrt(F.sum(F.col("tfidf") ** 2)).alias("n")).collect()}
    assert all(abs(v - 1.0) < 1e-12 for v in norms.values())
    # idf(a) = ln(3/3) + 1 = 1, idf(b) = ln(3/2) + 1
    w_a, w_b = 2 * 1.0, 1 * (math.log(3 / 2) + 1)
    got = {(r["doc"], r["term"]): r["tfidf"] for r in sc.collect()}
    assert abs(got[("d1", "a")] - w_a / math.hypot(w_a, w_b)) < 1e-12


def test_top_terms_ties_break_by_term(spark):
    sc = spark.createDataFrame([("d", "b", 0.5), ("d", "a", 0.5), ("d", "c", 0.9)], "doc string, term string, s double")
    top = T.top_terms_per_entity(sc, ["doc"], "s", 2)
    assert rows(top, "rank", "term") == [(1, "c"), (2, "a")]


def test_top_attributes_by_handles_nulls_and_short_groups(spark):
    df = spark.createDataFrame([("g1", "x", "y", None), ("g1", "x", None, None), ("g2", "z", None, None)],
                               "loc string, attr_1 string, attr_2 string, attr_3 string")
    out = T.top_attributes_by(df, "loc", top_count=2, column_count=3)
    got = {r["loc"]: (r["top_attr_1"], r["top_attr_2"]) for r in out.collect()}
    assert got == {"g1": ("x", "y"), "g2": ("z", None)}


def test_criticisms_align_missing_side_as_zero(spark):
    counts = spark.createDataFrame([("e", "negative", "sour", 3), ("e", "positive", "sweet", 2),
                                    ("f", "negative", "sour", 1), ("f", "positive", "sour", 1)],
                                   "e string, polarity string, term string, tf bigint")
    crit = T.criticisms_per_entity(counts, "e", k=5)
    got = {(r["e"], r["term"]): (r["negative"], r["positive"]) for r in crit.collect()}
    assert got[("e", "sweet")][0] == 0.0 and got[("e", "sour")][1] == 0.0


def test_histogram_last_bin_closed_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "x double")
    h = A.histogram(df, "x", 5)
    counts = [r["count"] for r in h.orderBy("bin").collect()]
    assert counts == [2, 1, 0, 0, 1] and sum(counts) == 4
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    hc = A.histogram(const, "x", 10).orderBy("bin").collect()
    assert [r["count"] for r in hc] == [0, 0, 0, 0, 0, 2, 0, 0, 0, 0]


def test_percentile_and_count_above(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert abs(A.percentile_value(df, "x", 10).first()[0] - 1.9) < 1e-12
    assert A.count_above_percentile(df, "x", 50).first()[0] == 5


def test_spearman_golden_shape(spark):
    # six classes, squared rank differences sum to 64 -> 1 - 6*64/210 = -0.828571
    ys = [3, 6, 2, 5, 1, 4]
    df = spark.createDataFrame([(i, float(y), float(i), float(-i)) for i, y in enumerate(ys)],
                               "score int, a double, up double, down double")
    sp = {r["label"]: r["spearman"] for r in M.spearman(df, "score", ["a", "up", "down"]).collect()}
    d2 = sum((i + 1 - y) ** 2 for i, y in enumerate(ys))
    assert abs(sp["a"] - (1 - 6 * d2 / 210)) < 1e-12
    assert abs(sp["up"] - 1.0) < 1e-12 and abs(sp["down"] + 1.0) < 1e-12
    p = M.spearman_p_value(M.spearman(df, "score", ["up"])).first()["p_value"]
    assert p == 0.0


def test_t_distribution_series():
    # two-sided p for t = 2.0 with 4 and 5 degrees of freedom (tables: 0.1161, 0.1019)
    assert abs(M._t_two_sided_p(2.0, 4) - 0.11611652) < 1e-6
    assert abs(M._t_two_sided_p(2.0, 5) - 0.10194017) < 1e-6


def test_spearman_ranks_counted_values(spark):
    """Windows see one row for each distinct value, not the raw rows."""
    df = spark.range(6000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") * F.col("id") % 11).cast("double").alias("a"), (-(F.col("id") % 7)).alias("b"))
    out = M.spearman(df, "x", ["a", "b"])
    pd_df = df.toPandas()
    got = {r["label"]: (round(r["spearman"], 9), r["n"]) for r in out.collect()}
    assert got == {y: (round(pd_df["x"].rank().corr(pd_df[y].rank()), 9), 6000) for y in ("a", "b")}
    assert "rank(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 30.0)], "id int, v double")
    got = rows(W.average_rank(df, "v"), "id", "v_rank")
    assert got == [(1, 1.0), (2, 2.5), (3, 2.5), (4, 4.0)]


def test_emotion_scores_guard_and_argmax(spark):
    df = spark.createDataFrame([("great great awful",), ("nothing here",), ("great " * 100,)], "t string")
    s = SC.score_emotions(df, "t", max_chars=500).collect()
    assert SC.score_emotions(df, "t").collect()[2]["joy"] == 1.0  # no limit unless one is given
    assert s[0]["max_feel"] == "joy" and abs(s[0]["joy"] - 2 / 3) < 1e-12
    assert s[1]["max_feel"] == "anger" and s[1]["anger"] == 0.0
    assert s[2]["joy"] == 0.0  # 500+ characters score zero


def test_polarity_only_low_scores(spark):
    df = spark.createDataFrame([("awful gross", 1), ("awful", 4), ("great", 0)], "t string, score int")
    got = rows(SC.score_polarity(df, "t", "score"), "t", "polarity")
    assert got == [("awful gross", 1.0), ("great", 0.0)]


def test_split_argument_checks():
    with pytest.raises(ValueError):
        T.check_split_arguments(10, True, None)
    with pytest.raises(ValueError):
        T.check_split_arguments(False, True, ["u"])


def test_column_collision(spark):
    df = spark.createDataFrame([(1,)], "anger int")
    with pytest.raises(ValueError):
        CL.assert_no_column_collision(df, ["anger", "joy"])


def test_category_share_guard(spark):
    df = spark.createDataFrame([("g", [], [], [], []), ("h", ["a"], ["b", "c"], [], ["d"])],
                               "g string, appearance array<string>, aroma array<string>, palate array<string>, "
                               "taste array<string>")
    got = {r["g"]: (r["Appearance"], r["Aroma"]) for r in A.category_share(df).collect()}
    assert got["g"] == (None, None) and got["h"] == (25.0, 50.0)


def test_enrich_drops_entities_without_reviews(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "beer_id int, name string")
    rv = spark.createDataFrame([(1, 4.0), (1, 2.0), (None, 1.0)], "beer_id int, overall double")
    got = rows(J.enrich_with_review_stats(dim, rv, "beer_id"), "beer_id", "review_count", "avg_overall")
    assert got == [(1, 2, 3.0)]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_positions_of_a_hot_key_with_a_kept_column(spark, reuse):
    """3 M rows, one key with two thirds of them, a kept column: every position against numpy's."""
    import numpy as np

    from revmine.operators.reshape import collect_by_entity

    n = 3_000_000
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id") % 2).otherwise(9).alias("k"),
                                   (F.col("id") * 7919 % n).alias("h"), F.xxhash64("id").alias("payload"))
        got = collect_by_entity(df, "k", "h", keep=["payload"]).toArrow()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    k, h, pos = (got.column(c).to_numpy() for c in ("k", "h", "position"))
    assert len(k) == n
    for key in (0, 1, 9):
        mine = np.argsort(h[k == key])
        assert (pos[k == key][mine] == np.arange(1, len(mine) + 1)).all()


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, o int")
    got = {(r["k"], r["o"]): r["pos"] for r in W.running_sum(df, ["k"], ["o"], F.lit(1), "pos").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 5): 1}


def test_abv_bins_lose_no_row(spark):
    df = spark.createDataFrame([(8.0,), (9.0,), (9.25,), (11.0,), (None,), (float("nan"),)], "abv double")
    got = {r["bin"]: r["count"] for r in A.abv_bins(df, "abv", [9.0, 9.25, 9.5, 9.75, 10.0]).collect()}
    assert got == {0: 2, 1: 1, 3: 1, None: 2}


def test_doc_term_long(spark):
    wide = spark.createDataFrame([("x", 2, 0), ("y", 0, 1)], "e string, hops long, malt long")
    assert rows(T.doc_term_long(wide, "e"), "e", "term", "tf") == [("x", "hops", 2), ("y", "malt", 1)]


def test_clean_tokens_pos_filter(spark):
    df = spark.createDataFrame([(1, "The hoppy beer, not bad!"), (2, "Really.")], "id int, t string")
    pos = spark.createDataFrame([("hoppy", "JJ"), ("beer", "NN"), ("bad", "JJ"), ("not", "RB")], "term string, pos string")
    got = {r["id"]: r["tokens"] for r in T.clean_tokens(df, "t", pos_table=pos, id_col="id").collect()}
    assert got == {1: ["hoppy", "beer", "not", "bad"], 2: []}


def test_lemma_applies_to_stop_words_and_vocabulary(spark):
    df = spark.createDataFrame([("x", "boxes pours pour ales ale hops")], "e string, text string")
    corpus = T.build_corpus(df, "e", "text")
    got = rows(T.word_counts(corpus, ["e"], stop=["pours"], lemma=T.lemma_rules), "term", "tf")
    # "pours" lemmatises to "pour", so both forms are stop words
    assert got == [("ale", 2), ("box", 1), ("hop", 1)]
    vocab = rows(T.word_counts(corpus, ["e"], vocabulary=["ale", "hops"]), "term", "tf")
    assert vocab == [("ale", 1), ("hops", 1)]


def test_model_scorer_hook(spark):
    def _toy_model(batches):
        # stand-in for a real classifier loaded once per worker: scores by text length
        for pdf in batches:
            n = pdf["t"].str.len().clip(upper=10) / 10.0
            yield pdf.assign(joy=n, sadness=1.0 - n)

    df = spark.createDataFrame([("short",), ("a much longer text",)], "t string")
    out = SC.score_with_model(df, _toy_model, "t string, joy double, sadness double")
    got = {r["t"]: (r["joy"], r["sadness"]) for r in out.collect()}
    assert got["short"] == (0.5, 0.5) and got["a much longer text"] == (1.0, 0.0)


def test_detect_language_by_stop_words(spark):
    df = spark.createDataFrame([(1, "The beer and the head of it"), (2, "Le goût et la mousse de la bière"),
                                (3, "Das Bier und der Schaum ist gut"), (4, "La cerveza y el sabor con la espuma"),
                                (5, "xyz qwv")], "id int, t string")
    got = {r["id"]: r["lang_guess"] for r in CL.detect_language_by_stop_words(df, "t").collect()}
    assert got == {1: "en", 2: "fr", 3: "de", 4: "es", 5: None}


def test_order_by_total(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 5, 0), ("c", 2, 2)], "loc string, x int, y int")
    assert [r["loc"] for r in W.order_by_total(df, ["x", "y"]).collect()] == ["b", "c", "a"]


def test_classify_vectors_blocks_agree(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "id int, v array<double>")
    cents = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "category string, centroid array<double>")
    one, many = ({r["id"]: (r["category"], r["score"] and round(r["score"], 9), r["kept"]) for r in SC.classify_vectors(vecs, cents, "id", "v", block=n).collect()}
                 for n in (1024, 1))
    assert one == many
    assert one[1][0] == "a" and one[2][0] == "b" and one[1][2] and one[2][2]
    assert one[3][0] is None and one[4][0] == "a" and not one[4][2]  # a tie: first name, half the mass


def test_classify_attributes_by_score(spark):
    df = spark.createDataFrame([("x", 1, "hops"), ("x", 2, "fizz"), ("x", 3, "odd")], "e string, rank int, term string")
    scores = spark.createDataFrame([("hops", "aroma", 0.7), ("hops", "taste", 0.3), ("fizz", "taste", 0.5), ("fizz", "palate", 0.5), ("odd", "taste", 0.51)],
                                   "term string, category string, score double")
    got = SC.classify_attributes(df, "e", "term", categories=["aroma", "palate", "taste"], scores=scores).first()
    assert (got["aroma"], got["palate"], got["taste"]) == (["hops"], [], ["odd"])


def test_irregular_and_verb_and_adjective_lemmas(spark):
    df = spark.createDataFrame([("children", "NN"), ("boxes", "NN"), ("went", "VB"), ("tried", "VB"), ("pouring", "VB"), ("stopped", "VB"), ("lasts", "VB"),
                                ("better", "JJ"), ("darker", "JJ"), ("hoppiest", "JJ"), ("beer", "JJ")], "term string, pos string")
    got = {r["term"]: r["l"] for r in df.select("term", T.lemma_by_class(F.col("term"), F.col("pos")).alias("l")).collect()}
    assert got == {"children": "child", "boxes": "box", "went": "go", "tried": "try", "pouring": "pour", "stopped": "stop", "lasts": "last",
                   "better": "good", "darker": "dark", "hoppiest": "hoppy", "beer": "beer"}


def test_corpus_entry_point(spark):
    reviews = spark.createDataFrame([("b", 1, "good", 1.0), ("b", 2, "bad", 5.0), ("b", 1, "ok", 3.0)],
                                    "beer_name string, user_id int, text string, rating double")
    experts = spark.createDataFrame([(1,)], "user_id int")
    c = T.corpus(reviews, experts=experts, expert_weight=5, quantile_split=50)
    got = rows(c, "text", "polarity", "weight")
    assert got == [("bad", "positive", 1), ("good", "negative", 5), ("ok", "negative", 5)]
    with pytest.raises(ValueError):
        T.corpus(reviews, quantile_split=10, emotion_split=True)


def test_zero_sums_give_null_not_errors(spark):
    from revmine.functions import arrays as AR
    from revmine.operators import topics as TP

    z = spark.createDataFrame([([0.0, 0.0, 0.0],)], "a array<double>")
    assert z.select(AR.circular_pair_smooth("a")).first()[0] == [None, None, None]
    assert z.select(AR.circular_triple_smooth("a")).first()[0] == [None, None, None]
    t = spark.createDataFrame([(1.0, [(0, 0.0)])], "score double, topics array<struct<topic:int,prob:double>>")
    assert TP.avg_score_by_topic(t).first()["avg_score"] is None
    w = spark.createDataFrame([(2.0, 0.0)], "x double, w double")
    assert w.agg(M.weighted_mean("x", "w")).first()[0] is None
    pct = A.row_normalise_pct(spark.createDataFrame([("k", 0, 0)], "k string, a int, b int"), ["a", "b"]).first()
    assert pct["a"] is None


def test_stop_words_lemmatised_list(spark):
    counts = spark.createDataFrame([("d1", "beer", 1), ("d2", "beer", 1), ("d2", "hops", 1)],
                                   "doc string, term string, tf bigint")
    plain = {r["term"] for r in T.stop_words(counts, ["doc"], 0.9).collect()}
    assert "beer" in plain and "hops" not in plain and "united states" in plain
    lem = {r["term"] for r in T.stop_words(counts, ["doc"], 0.9, lemma=T.lemma_rules).collect()}
    assert {"united", "state", "pour"} <= lem


def test_bigrams_skip_stop_words_like_the_vectorizer(spark):
    df = spark.createDataFrame([("x", "hoppy and bitter beer")], "e string, text string")
    got = rows(T.word_counts(T.build_corpus(df, "e", "text"), ["e"], stop=["and"], ngram_range=(1, 2)), "term")
    assert got == [("beer",), ("bitter",), ("bitter beer",), ("hoppy",), ("hoppy bitter",)]


def test_percentile_methods_agree(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 7.0)], "e string, x double")
    rank = {r["e"]: r["percentile"] for r in J.attach_entity_percentile(df, "e", "x", 10).collect()}
    agg = {r["e"]: r["p"] for r in df.groupBy("e").agg(F.percentile("x", 0.1).alias("p")).collect()}
    approx = {r["e"]: r["percentile"] for r in J.attach_entity_percentile(df, "e", "x", 10, approx=True).collect()}
    assert rank == agg and abs(rank["a"] - 10.9) < 1e-12 and rank["b"] == 7.0
    assert abs(approx["a"] - rank["a"]) <= 1.0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_languages_by_one_split_into_words(spark):
    texts = ["The cat AND the dog", "le chat et la maison", "der Hund und die Katze", "", None, "x1the 9und-et", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = CL.detect_language_by_stop_words(df, "t")
    lists = {c: set(CL.language_stop_words(c)) for c in ("en", "fr", "de", "es")}

    def guess(t):
        words = "".join(ch if ch.isalpha() else " " for ch in (t or "").lower()).split()
        n = {c: sum(w in s for w in words) for c, s in lists.items()}
        return max(n, key=n.get) if max(n.values()) else None

    assert rows(out, "i", "lang_guess") == [(i, guess(t)) for i, t in enumerate(texts)]
    assert plan_of(out).count("regexp_extract_all") == 1 and out.columns == ["i", "t", "lang_guess"]


def test_scores_by_spaced_words_and_a_filter_that_reads_the_label(spark):
    texts = ["apple, Bob! zoo", "9x-ray é eagle's", "", None, "  ", "Ñu2apple xylo"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    lex = SC.initial_letter_rule()
    fast = SC.score_emotions(df, "t", lex)
    labels = SC.L.EMOTIONS
    for r in fast.collect():
        words = "".join(ch if ch.isalpha() else " " for ch in (r["t"] or "").lower()).split()
        hits = [labels[(ord(w[0]) - 97) * 7 // 26] for w in words if "a" <= w[0] <= "z"]
        want = [hits.count(x) / len(hits) if hits else 0.0 for x in labels]
        assert [r[x] for x in labels] == want and r["max_feel"] == labels[want.index(max(want))]
    odd = SC.score_emotions(df, "t", SC.RegexLexicon({"joy": "x-ray|zoo"}))  # not of letters alone
    assert [r["joy"] for r in odd.orderBy("i").collect()] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    conditions = [line for line in plan_of(fast.where("max_feel = 'joy'")).splitlines() if "Filter" in line]
    assert conditions and not any("CASE WHEN" in line for line in conditions)


def test_word_counts_list_their_documents(spark):
    df = spark.createDataFrame([("a", "one two two", 1), ("b", "the", 2), ("c", "", 1), ("d", None, 1)], "k string, text string, weight int")
    for grams in ((1, 1), (1, 2)):
        both = T.word_counts(df, ["k"], stop=["the"], ngram_range=grams, documents=True)
        assert rows(both.where("term is null"), "k") == [("a",), ("b",), ("c",), ("d",)]
        plain = T.word_counts(df, ["k"], stop=["the"], ngram_range=grams)
        assert rows(both.where("term is not null"), "k", "term", "tf") == rows(plain, "k", "term", "tf")
    some = T.word_counts(df, ["k"], vocabulary=["two"], documents=True)
    assert rows(some.where("term is not null"), "k", "term", "tf") == [("a", "two", 2)] and some.where("term is null").count() == 4


def test_norms_of_texts_without_a_second_pass(spark):
    data = [("s", 1, "a", 2), ("s", 1, "b", 1), ("s", 2, "a", 5), ("t", 2, "a", 1), ("s", None, "a", 3), (None, 3, "b", 1), ("t", 4, "c", 0)]
    counts = spark.createDataFrame(data, "s string, d int, term string, tf long")
    a, b = (T.tfidf_scores(counts, ["s", "d"], texts=x) for x in (False, True))
    cols = ["s", "d", "term"]
    one, two = ({tuple(r[c] for c in cols): r["tfidf"] for r in x.collect()} for x in (a, b))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], abs_tol=1e-12) for k in one)
    assert "Window" in plan_of(b) and "Window" not in plan_of(a)
