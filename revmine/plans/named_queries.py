"""One query under its own name for each operator that other queries only use on the way.

X1, X2, X4, X14, M4, M5, M7, K4, P2, P5, T2 (plain and quantile mode through
``corpus``), T9 with a vocabulary and a least document count, U2 over given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.functions.arrays import circular_pair_smooth, circular_triple_smooth
from revmine.operators import aggregate as A
from revmine.operators import scoring as SC
from revmine.operators import text as T
from revmine.operators import window as W
from revmine.plans import catalog as C
from revmine.plans import sqlfrag as S
from revmine.plans.registry import register
from revmine.plans.text_queries import MAX_DF, en_corpus

DAYS = ["1", "2", "3", "4", "5", "6", "7"]


@register("fix_mojibake_apostrophe", f"""
SELECT doc_id, replace(text, {S.q(L.MOJIBAKE_APOSTROPHE)}, {S.q(L.RIGHT_QUOTE)}) AS text FROM documents""")
def q_fix_mojibake_apostrophe(spark: SparkSession, sf: str) -> DataFrame:
    """The broken UTF-8 apostrophe repaired in every document."""
    return C.table(spark, sf, "documents").select("doc_id", X.fix_mojibake_apostrophe("text").alias("text"))


@register("collapse_ipa", f"SELECT doc_id, regexp_replace(text, {S.q(L.IPA_PATTERN)}, 'ipa', 'g') AS text FROM documents")
def q_collapse_ipa(spark: SparkSession, sf: str) -> DataFrame:
    """Words that contain "ipa" rewritten in every document."""
    return C.table(spark, sf, "documents").select("doc_id", X.collapse_ipa("text").alias("text"))


@register("lowercase", "SELECT doc_id, lower(text) AS text FROM documents")
def q_lowercase(spark: SparkSession, sf: str) -> DataFrame:
    """Lowercased documents."""
    return C.table(spark, sf, "documents").select("doc_id", X.lowercase("text").alias("text"))


@register("take_first_k", "SELECT doc_id, string_split(text, ' ')[1:5] AS words FROM documents")
def q_take_first_k(spark: SparkSession, sf: str) -> DataFrame:
    """The first five words of each document (the operator's feature)."""
    d = C.table(spark, sf, "documents")
    return d.select("doc_id", X.take_first_k(F.split("text", " "), 5).alias("words"))


_WEEK_SQL = """
w AS (SELECT event_type, isodow(ts) AS day, sum(value) AS v FROM events GROUP BY ALL),
p AS (SELECT event_type, """ + ", ".join(f"COALESCE(sum(v) FILTER (day = {d}), 0.0) AS d{d}" for d in DAYS) + """
      FROM w GROUP BY event_type),
a AS (SELECT *, [d1, d2, d3, d4, d5, d6, d7] AS d FROM p)"""


def _week(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of event values per type and weekday, one column for each day (Monday first)."""
    e = C.table(spark, sf, "events").withColumn("day", (F.weekday("ts") + 1).cast("string"))
    wide = e.groupBy("event_type").pivot("day", DAYS).agg(F.sum("value")).na.fill(0.0)
    return wide.select("event_type", *[F.col(d).alias(f"d{d}") for d in DAYS])


def _rounded(arr) -> F.Column:
    return F.transform(arr, lambda x: F.round(x, 6))


@register("circular_pair_smooth", "WITH " + _WEEK_SQL + """,
s AS (SELECT event_type, list_transform(range(7), lambda i: CASE WHEN i < 6 THEN (d[i + 1] + d[i + 2]) / 2.0
                                                            ELSE (d[7] + (d[1] + d[2]) / 2.0) / 2.0 END) AS sm FROM a)
SELECT event_type, list_transform(sm, lambda x: round(x / list_sum(sm), 6)) AS smooth FROM s""")
def q_circular_pair_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """M4: weekday profile smoothed in pairs, divided by its sum."""
    w = _week(spark, sf)
    return w.select("event_type", _rounded(circular_pair_smooth(F.array(*[f"d{d}" for d in DAYS]))).alias("smooth"))


@register("circular_triple_smooth", "WITH " + _WEEK_SQL + """,
s AS (SELECT event_type, list_transform(range(7), lambda i: (d[((i + 6) % 7) + 1] + d[i + 1] + d[((i + 1) % 7) + 1]) / 3.0) AS sm FROM a)
SELECT event_type, list_transform(sm, lambda x: round(x / list_max(sm), 6)) AS smooth FROM s""")
def q_circular_triple_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """M5: weekday profile smoothed in threes, divided by its maximum."""
    w = _week(spark, sf)
    return w.select("event_type", _rounded(circular_triple_smooth(F.array(*[f"d{d}" for d in DAYS]))).alias("smooth"))


@register("row_normalise_pct", "WITH " + _WEEK_SQL + """
SELECT event_type, """ + ", ".join(f"round(d{d} * 100.0 / (d1 + d2 + d3 + d4 + d5 + d6 + d7), 6) AS d{d}" for d in DAYS) + " FROM a")
def q_row_normalise_pct(spark: SparkSession, sf: str) -> DataFrame:
    """M7: weekday shares of each event type in percent."""
    cols = [f"d{d}" for d in DAYS]
    return A.row_normalise_pct(_week(spark, sf), cols).select("event_type", *[F.round(c, 6).alias(c) for c in cols])


@register("order_by_total", """
SELECT l_suppkey, a, n, r, a + n + r AS total FROM
  (SELECT l_suppkey, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS a, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n,
          count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS r FROM lineitem GROUP BY l_suppkey) x ORDER BY total DESC""")
def q_order_by_total(spark: SparkSession, sf: str) -> DataFrame:
    """K4: ratings per reviewer and flag, reviewers with most first."""
    li = C.table(spark, sf, "lineitem")
    wide = li.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return W.order_by_total(wide.select("l_suppkey", *[F.col(c).alias(c.lower()) for c in "ANR"]), ["a", "n", "r"])


@register("pivot_top_attributes", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM c)
SELECT p_brand, """ + ", ".join(f"max(p_type) FILTER (rank = {i}) AS top_type_{i}" for i in (1, 2, 3)) + " FROM r GROUP BY p_brand")
def q_pivot_top_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's three most frequent types as columns."""
    counts = T.attribute_counts(C.table(spark, sf, "part").select("p_brand", "p_type"), "p_brand", "p_type")
    ranked = T.top_k_per_group(counts, "p_brand", "count", 3, "p_type")
    return T.pivot_top_attributes(ranked, "p_brand", 3, "top_type_", "p_type")


@register("doc_term_long", """
SELECT s AS l_suppkey, term, tf FROM (
  UNPIVOT (SELECT l_suppkey AS s, count(CASE WHEN l_shipmode = 'AIR' THEN 1 END) AS air, count(CASE WHEN l_shipmode = 'RAIL' THEN 1 END) AS rail
           FROM lineitem GROUP BY l_suppkey) ON air, rail INTO NAME term VALUE tf) u WHERE tf <> 0"""
          .replace("l_shipmode", "l_returnflag").replace("'AIR'", "'A'").replace("'RAIL'", "'R'"))
def q_doc_term_long(spark: SparkSession, sf: str) -> DataFrame:
    """P5: a wide count matrix (reviewer x flag) as long rows without zeros."""
    li = C.table(spark, sf, "lineitem")
    wide = li.groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).count().na.fill(0)
    return T.doc_term_long(wide.select("l_suppkey", F.col("A").alias("air"), F.col("R").alias("rail")), "l_suppkey")


# --- corpus() in its two registered-nowhere modes --------------------------------

_EXPERTS_SQL = "(SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"


def _corpus(spark: SparkSession, sf: str, **mode) -> DataFrame:
    docs = C.table(spark, sf, "documents").select(
        F.col("source").alias("beer_name"), "text", F.col("doc_id").alias("user_id"), F.col("n_chars").cast("double").alias("rating"))
    experts = C.expert_docs(spark, sf)
    return T.corpus(docs, experts=experts, expert_weight=C.EXPERT_WEIGHT, **mode)


@register("corpus_plain", f"""
SELECT source AS beer_name, sum(CASE WHEN e.doc_id IS NULL THEN 1 ELSE {C.EXPERT_WEIGHT} END)::BIGINT AS weight, count(*) AS reviews,
       sum(length(text))::BIGINT AS chars
FROM documents d LEFT JOIN {_EXPERTS_SQL} e ON d.doc_id = e.doc_id WHERE source IS NOT NULL GROUP BY source""")
def q_corpus_plain(spark: SparkSession, sf: str) -> DataFrame:
    """T2 (plain mode) through ``corpus``: weights, reviews and characters of each source's document."""
    return _corpus(spark, sf).groupBy("beer_name").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("reviews"), F.sum(F.length("text")).alias("chars"))


@register("corpus_quantile", f"""
WITH p AS (SELECT source, quantile_cont(CAST(n_chars AS DOUBLE), 0.1) AS pct FROM documents GROUP BY source)
SELECT d.source AS beer_name, CASE WHEN round(CAST(n_chars AS DOUBLE), 9) <= round(pct, 9) THEN 'negative' ELSE 'positive' END AS polarity,
       sum(CASE WHEN e.doc_id IS NULL THEN 1 ELSE {C.EXPERT_WEIGHT} END)::BIGINT AS weight, count(*) AS reviews
FROM documents d JOIN p ON d.source = p.source LEFT JOIN {_EXPERTS_SQL} e ON d.doc_id = e.doc_id
WHERE n_chars IS NOT NULL GROUP BY ALL""")
def q_corpus_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """T2 (quantile mode) through ``corpus``: weights and reviews of each source and side."""
    return _corpus(spark, sf, quantile_split=10).groupBy("beer_name", "polarity").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("reviews"))


# --- attributes classified by scores, lemmas by word class -------------------------

_SPANS = {"appearance": "a-g", "aroma": "h-m", "palate": "n-r", "taste": "s-z"}


@register("classify_attributes_scored", """
WITH c AS (SELECT p_brand, p_type AS term, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT p_brand, term, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, term) AS rank FROM c),
s AS (SELECT DISTINCT term, unnest([""" + ", ".join(f"'{c}'" for c in _SPANS) + """]) AS category,
             unnest([""" + ", ".join(f"length(regexp_replace(lower(term), '[^{r}]', '', 'g')) / length(term)" for r in _SPANS.values()) + """]) AS score FROM r),
b AS (SELECT term, arg_min(category, (-score, category)) AS category FROM s GROUP BY term HAVING max(score) > 0.4),
l AS (SELECT p_brand, rank, term, category FROM r LEFT JOIN b USING (term) WHERE rank <= 10)
SELECT p_brand, """ + ", ".join(f"COALESCE(list(term ORDER BY rank) FILTER (category = '{c}'), []) AS {c}" for c in _SPANS) + " FROM l GROUP BY p_brand")
def q_classify_attributes_scored(spark: SparkSession, sf: str) -> DataFrame:
    """T21 with scores: each brand's ten most frequent types by the category that scores above 0.4."""
    counts = T.attribute_counts(C.table(spark, sf, "part").select("p_brand", F.col("p_type").alias("term")), "p_brand", "term")
    ranked = T.top_k_per_group(counts, "p_brand", "count", 10, "term")
    share = F.inline(F.array(*[F.struct(F.lit(c).alias("category"), (F.length(F.regexp_replace(F.lower("term"), f"[^{r}]", "")) / F.length("term")).alias("score"))
                               for c, r in _SPANS.items()]))
    scores = counts.select("term").distinct().select("term", share)
    return SC.classify_attributes(ranked, "p_brand", "term", categories=list(_SPANS), scores=scores, min_score=0.4)


# --- word counts with a vocabulary, tf-idf with a least document count ------------

@register("word_counts_vocabulary", f"""
WITH r AS ({C.REVIEWS_SQL}),
docs AS (SELECT source, CASE WHEN expert THEN {C.EXPERT_WEIGHT} ELSE 1 END AS weight, {S.clean('text')} AS clean FROM r WHERE source IS NOT NULL),
vocab AS (SELECT DISTINCT unnest({S.tokens(S.clean('text'))}) AS term FROM benchmark),
toks AS (SELECT source, weight, unnest({S.tokens('clean')}) AS term FROM docs)
SELECT source, term, CAST(sum(weight) AS BIGINT) AS tf FROM toks WHERE term IN (SELECT term FROM vocab) GROUP BY source, term""")
def q_word_counts_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """T9 with ``vocabulary``: counts of the benchmark's words per source."""
    vocab = T.with_tokens(C.table(spark, sf, "benchmark"), "text", "_t").select(F.explode("_t").alias("term"))
    return T.word_counts(en_corpus(spark, sf), ["source"], vocabulary=vocab)


@register("tfidf_min_df", f"""
WITH r AS ({C.REVIEWS_SQL}),
docs AS (SELECT source, CASE WHEN expert THEN {C.EXPERT_WEIGHT} ELSE 1 END AS weight, {S.clean('text')} AS clean FROM r WHERE source IS NOT NULL),
toks AS (SELECT source, weight, unnest({S.tokens('clean')}) AS term FROM docs),
c AS (SELECT source, term, CAST(sum(weight) AS BIGINT) AS tf FROM toks WHERE term NOT IN {S.in_list(T.fixed_stop_words())} GROUP BY source, term),
nd AS (SELECT count(DISTINCT source) AS n_docs FROM docs),
dfq AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT c.source, c.term, tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w FROM c JOIN dfq USING (term) CROSS JOIN nd
      WHERE df >= 3 AND df / n_docs < {MAX_DF})
SELECT source, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY source)), 6) AS tfidf FROM w""")
def q_tfidf_min_df(spark: SparkSession, sf: str) -> DataFrame:
    """M1 with ``min_df``: terms of at least three sources."""
    from revmine.session import cut_lineage

    corpus = en_corpus(spark, sf)
    counts = cut_lineage(T.word_counts(corpus, ["source"], stop=T.fixed_stop_words()))
    out = T.tfidf_scores(counts, ["source"], docs=corpus, max_df=MAX_DF, min_df=3)
    return out.select("source", "term", F.round("tfidf", 6).alias("tfidf"))
