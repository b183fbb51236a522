"""Topic queries.

LDA (T25) is iterative and seeded: no SQL twin, rows-only check.  The topic
tables A19-A21 are checked on a deterministic mixture derived from
``embeddings`` (squared shares of all components).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions.arrays import dominant_topic
from revmine.operators import reshape as R
from revmine.operators import stats as M
from revmine.operators import topics as TP
from revmine.plans import catalog as C
from revmine.plans.registry import register
from revmine.sources import tables as ST

EMO = L.EMOTIONS
N_TOPICS = 5


def vector_topics(spark: SparkSession, sf: str) -> DataFrame:
    emb = C.table(spark, sf, "embeddings")
    feel = F.try_element_at(F.array(*[F.lit(e) for e in EMO]), F.least(F.col("label"), F.lit(6)) + 1)
    return TP.topics_from_vectors(emb, "embedding").select(
        "vec_id", F.col("label").alias("score"), feel.alias("max_feel"), "topics")


VT_SQL = f"""
tv AS (SELECT vec_id, label AS score, {"[" + ", ".join(f"'{e}'" for e in EMO) + "]"}[least(label, 6) + 1] AS max_feel,
              list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS head
       FROM embeddings),
tp AS (SELECT vec_id, score, max_feel, CAST(unnest(range(len(head))) AS INTEGER) AS topic,
              unnest(head) / list_sum(head) AS prob FROM tv)"""


def _w(body: str) -> str:
    return "WITH " + VT_SQL.strip() + "\n" + body


@register("explode_topics", _w("SELECT vec_id, topic, round(prob, 6) AS prob FROM tp"))
def q_explode_topics(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (vector, topic)."""
    ex = R.explode_topics(vector_topics(spark, sf), "topics", ["vec_id"])
    return ex.select("vec_id", "topic", F.round("prob", 6).alias("prob"))


@register("dominant_topic", _w("""
SELECT vec_id, CAST(list_position(head, list_max(head)) - 1 AS INTEGER) AS dominant_topic FROM tv"""))
def q_dominant_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Topic with the highest probability (first on ties)."""
    vt = vector_topics(spark, sf)
    return vt.select("vec_id", dominant_topic(F.col("topics")).alias("dominant_topic"))


@register("avg_score_by_topic", _w("""
SELECT topic, round(sum(score * prob) / sum(prob), 6) AS avg_score FROM tp GROUP BY topic"""))
def q_avg_score_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Probability-weighted mean score per topic."""
    out = TP.avg_score_by_topic(vector_topics(spark, sf), "topics", "score")
    return out.select("topic", F.round("avg_score", 6).alias("avg_score"))


@register("topic_distribution", _w("""
SELECT topic, round(sum(prob) / (SELECT sum(prob) FROM tp) * 100.0, 6) AS percentage,
       round(sum(prob) / count(*), 6) AS avg_prob FROM tp GROUP BY topic"""))
def q_topic_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the total probability mass and mean probability per topic."""
    out = TP.topic_distribution(vector_topics(spark, sf), "topics")
    return out.select("topic", F.round("percentage", 6).alias("percentage"), F.round("avg_prob", 6).alias("avg_prob"))


@register("topic_emotion_distribution", _w(f""",
d0 AS (SELECT topic, [{", ".join(f"COALESCE(sum(prob) FILTER (WHERE max_feel = '{e}'), 0.0)" for e in EMO)}] AS d
       FROM tp GROUP BY topic),
d1 AS (SELECT topic, list_transform(range(7), lambda i: CASE WHEN i < 6 THEN (d[i + 1] + d[i + 2]) / 2.0
                                                        ELSE (d[7] + (d[1] + d[2]) / 2.0) / 2.0 END) AS sm FROM d0)
SELECT topic, {", ".join(f"round(sm[{i + 1}] / list_sum(sm), 6) AS {e}" for i, e in enumerate(EMO))} FROM d1"""
.replace("\n,\nd0", ",\nd0")))
def q_topic_emotion_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Probability mass per (topic, label), circular pair smoothing, / sum."""
    out = TP.topic_emotion_distribution(vector_topics(spark, sf), "topics", "max_feel", EMO)
    return out.select("topic", *[F.round(e, 6).alias(e) for e in EMO])


@register("weighted_mean", """
SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS weighted_price
FROM lineitem GROUP BY l_returnflag""")
def q_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    """M8: quantity-weighted mean price per return flag."""
    li = C.table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(M.weighted_mean("l_extendedprice", "l_quantity"), 6)
                                          .alias("weighted_price"))


# --- centroid classifier (T21) -------------------------------------------------

CENTROID_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ce AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) q
       GROUP BY label, pos),
c AS (SELECT CAST(label AS VARCHAR) AS category, list(m ORDER BY pos) AS centroid FROM ce GROUP BY label)"""


@register("category_centroids", "WITH " + CENTROID_SQL.strip() + """
SELECT category, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM c""")
def q_category_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per label (element-wise)."""
    from revmine.operators.scoring import category_centroids

    c = category_centroids(C.table(spark, sf, "embeddings"), "embedding", "label")
    return c.select(F.col("category").cast("string").alias("category"),
                    F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@register("classify_vectors", "WITH " + CENTROID_SQL.strip() + """,
s AS (SELECT e.vec_id, c.category,
             list_dot_product(e.v, c.centroid) / (sqrt(list_dot_product(e.v, e.v))
                                                  * sqrt(list_dot_product(c.centroid, c.centroid))) / 0.05 AS z
      FROM e CROSS JOIN c),
r AS (SELECT vec_id, category, z, max(z) OVER (PARTITION BY vec_id) AS zmax,
             row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, category) AS rk FROM s),
d AS (SELECT vec_id, sum(exp(z - zmax)) AS den FROM r GROUP BY vec_id)
SELECT r.vec_id, r.category, round(1.0 / d.den, 6) AS score, 1.0 / d.den > 0.5 AS kept
FROM r JOIN d USING (vec_id) WHERE rk = 1""")
def q_classify_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """T21 (re-aimed zero-shot): each vector to its nearest label centroid
    (softmax of cosine / 0.05), kept when the probability exceeds 0.5."""
    from revmine.operators.scoring import category_centroids, classify_vectors

    emb = C.table(spark, sf, "embeddings")
    out = classify_vectors(emb, category_centroids(emb, "embedding", "label"), "vec_id", "embedding", 0.5, 0.05, block=4)
    return out.select("vec_id", "category", F.round("score", 6).alias("score"), "kept")


# --- LDA (rows-only) -------------------------------------------------------------

def _lda(spark: SparkSession, sf: str):
    docs = C.reviews(spark, sf, "en").select("source", "text")
    return TP.lda_topics(docs, "source", "text", k=N_TOPICS, max_iter=10, seed=23)


@register("lda_topics")
def q_lda_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic mixture per source (seeded online LDA)."""
    return _lda(spark, sf)[0]


@register("lda_topic_terms")
def q_lda_topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Five most weighted words per topic."""
    return _lda(spark, sf)[1]


@register("write_topics")
def q_write_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic table written as parquet under the checkpoint folder, read back."""
    from revmine.plans.io_paths import scratch_path

    topics = _lda(spark, sf)[0]
    path = scratch_path(spark, sf, "topics")
    ST.write_topics(topics, path)
    return spark.read.parquet(f"{path}/topics")


@register("topics_of_unseen")
def q_topics_of_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on four fifths of the sources, saved, read back and asked for the topics of every source."""
    from revmine.plans.io_paths import scratch_path

    docs = C.reviews(spark, sf, "en").select("source", "text")
    model = TP.fit_topics(docs.where(F.crc32("source") % 5 != 0), "source", "text", k=N_TOPICS)
    path = scratch_path(spark, sf, "topic_model")
    model.save(spark, path)
    return TP.TopicModel.load(spark, path).topics(docs, "source", "text")


@register("complaints_by_topic")
def q_complaints_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Sadness sentences of the sources with the commonest dominant LDA topic, summarised."""
    from revmine.operators.scoring import summarise_complaints
    from revmine.plans.scoring_queries import scored_sentences
    from revmine.session import cut_lineage

    topics = cut_lineage(_lda(spark, sf)[0])
    common = (topics.groupBy(dominant_topic(F.col("topics")).alias("t")).count()
              .orderBy(F.col("count").desc(), "t").first()["t"])
    scored = (scored_sentences(spark, sf).withColumnRenamed("location", "source")
              .withColumnRenamed("sentence_idx", "sid"))

    def summary(df, by, text, n, ids):  # the sentences that are left are read three times
        return summarise_complaints(cut_lineage(df.select(*by, *ids, text)), by, text, n, ids, materialise=cut_lineage)

    return TP.complaints_by_topic(topics, scored, common, "source", "review", n=3, id_col=["doc_id", "sid"], summary=summary)
