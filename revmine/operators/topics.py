"""Topic operators.

A topic mixture is ``array<struct<topic:int, prob:double>>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions.arrays import circular_pair_smooth, dominant_topic
from revmine.operators.ranks import position_in_group
from revmine.operators.scoring import summarise_complaints
from revmine.operators.text import english_stop_words
from revmine.session import cut_lineage

TOPIC_TYPE = "array<struct<topic:int,prob:double>>"


def lda_tokens(text_col, stop: Sequence[str] | None = None):
    """Lowercase, split on single spaces, alphabetic words longer than 2, no stop word."""
    stop = list(stop if stop is not None else english_stop_words())
    words = F.split(F.lower(text_col), " ")
    return F.filter(words, lambda w: w.rlike(r"^\p{L}{3,}$") & ~w.isin(sorted(set(stop))))


@dataclass(frozen=True)
class TopicModel:
    """``terms`` by number, ``weights`` (topic, term): probabilities of a topic's terms, ``prior`` weight of each topic."""

    terms: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def top_terms(self, n: int = 5) -> list[list[str]]:
        return [[self.terms[i] for i in np.argsort(-w, kind="stable")[:n]] for w in self.weights]

    def mixture(self, numbers: np.ndarray, counts: np.ndarray, tolerance: float = 1e-6, max_rounds: int = 200) -> np.ndarray:
        """Topic shares of a bag under these topics: each round deals every term's count to the topics by their
        present shares and adds the prior; from equal shares, so the result depends on the bag alone."""
        share = np.full(len(self.prior), 1 / len(self.prior))
        w = self.weights[:, numbers]
        for _ in range(max_rounds):
            part = share[:, None] * w
            total = part.sum(axis=0)
            new = self.prior + (part * np.divide(counts, total, out=np.zeros(len(total)), where=total > 0)).sum(axis=1)
            new /= new.sum()
            done = np.abs(new - share).max() < tolerance
            share = new
            if done:
                break
        return share

    def topics(self, df: DataFrame, entity: str, text: str, min_prob: float = 0.0) -> DataFrame:
        """``(entity, topics)`` of any texts, seen in the fit or not; entities without a known term get the prior's shares.

        Terms are counted per entity before a bag, at most the vocabulary, is put together.
        """
        spark = df.sparkSession
        numbers = spark.createDataFrame(pa.table({"idx": pa.array(range(len(self.terms)), pa.int32()), "term": pa.array(self.terms, pa.string())}))
        rows = df.where(F.col(entity).isNotNull())
        toks = rows.select(entity, F.explode(lda_tokens(F.col(text))).alias("term"))
        counts = toks.groupBy(entity, "term").agg(F.count("*").cast("double").alias("n"))
        bags = counts.join(numbers, "term").groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "n"))).alias("_p"))
        every = rows.select(entity).distinct().join(bags, entity, "left")
        sent = spark.sparkContext.broadcast(self)  # topics * terms doubles

        @F.pandas_udf("array<double>")
        def shares(i: pd.Series, n: pd.Series) -> pd.Series:
            model, none = sent.value, np.zeros(0)
            return pd.Series([model.mixture(np.asarray(none if a is None else a, np.int64), np.asarray(none if b is None else b, np.float64)).tolist() for a, b in zip(i, n, strict=True)])

        dist = every.select(entity, shares(F.col("_p.i"), F.col("_p.n")).alias("_d"))
        return dist.select(entity, F.filter(F.transform("_d", lambda p, i: F.struct(i.cast("int").alias("topic"), p.alias("prob"))),
                                            lambda s: s["prob"] >= min_prob).alias("topics"))

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as two parquet tables below ``path``, written over what was there."""
        rows = pa.table({"idx": pa.array(range(len(self.terms)), pa.int32()), "term": pa.array(self.terms, pa.string()),
                         "weights": pa.array(self.weights.T.tolist(), pa.list_(pa.float64()))})
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/terms")
        prior = pa.table({"topic": pa.array(range(len(self.prior)), pa.int32()), "prior": pa.array(self.prior)})
        spark.createDataFrame(prior).write.mode("overwrite").parquet(f"{path.rstrip('/')}/prior")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        """A saved model; its vocabulary reaches the driver."""
        prior = spark.read.parquet(f"{path.rstrip('/')}/prior").orderBy("topic").toArrow().column("prior").to_numpy()
        rows = spark.read.parquet(f"{path.rstrip('/')}/terms").orderBy("idx").toArrow()
        weights = np.array(rows.column("weights").to_pylist(), np.float64).reshape(-1, len(prior)).T
        return cls(rows.column("term").to_pylist(), weights, prior)


def _bags(df: DataFrame, entity: str, text: str, min_df: int, max_df: float, vocab_size: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(bags of one sparse vector per entity, vocabulary (idx, term), its size)."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    toks = df.where(F.col(entity).isNotNull()).select(entity, F.explode(lda_tokens(F.col(text))).alias("term"))
    counts = cut_lineage(toks.groupBy(entity, "term").agg(F.count("*").cast("double").alias("n")))
    n_docs = df.where(F.col(entity).isNotNull()).select(entity).distinct().agg(F.count("*")).scalar()
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
    vocab = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    vocab = position_in_group(vocab, [], [F.desc("cf"), F.asc("term")], "idx").withColumn("idx", F.col("idx") - 1)
    if vocab_size is not None:
        vocab = vocab.where(F.col("idx") < vocab_size)
    vocab = cut_lineage(vocab)
    size = vocab.count()

    @F.udf(VectorUDT(), useArrow=True)
    def to_vec(indices, values):
        return SparseVector(size, indices, values)

    bags = (counts.join(vocab.select("term", "idx"), "term", "inner")
            .groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), "n"))).alias("_p"))
            .select(entity, to_vec(F.col("_p.i"), F.col("_p.n")).alias("features")))
    return cut_lineage(bags), vocab, size


def fit_topics(df: DataFrame, entity: str, text: str, k: int = 5, *, max_iter: int = 10, seed: int = 23,
               min_df: int = 5, max_df: float = 0.4, vocab_size: int | None = None) -> TopicModel | None:
    """A topic model to keep (:meth:`TopicModel.save`) and to ask for other entities; None without a vocabulary."""
    from pyspark.ml.clustering import LDA

    bags, vocab, size = _bags(df, entity, text, min_df, max_df, vocab_size)
    if size == 0:
        return None
    model = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online").fit(bags)
    terms = [r["term"] for r in vocab.orderBy("idx").select("term").collect()]  # the model holds k numbers for each of them
    weights = model.topicsMatrix().toArray().T
    return TopicModel(terms, weights / weights.sum(axis=1, keepdims=True), np.array(model.estimatedDocConcentration().toArray()))


# T25
def lda_topics(df: DataFrame, entity: str, text: str, k: int = 5, *, max_iter: int = 10, seed: int = 23,
               min_df: int = 5, max_df: float = 0.4, vocab_size: int | None = None, min_prob: float = 0.0,
               top_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """LDA over one bag of words per entity -> ``(entity, topics)`` and the
    ``(topic, terms)`` table (``top_words`` per topic).

    The bag is built by aggregation -- ``(entity, term, count)`` with map-side
    partial sums -- and packed into one sparse vector per entity, whose size is
    bounded by the vocabulary, never by the number of reviews.  Vocabulary
    filter like the study's dictionary: in at least ``min_df`` documents, in at
    most ``max_df`` of them (``vocab_size``: only the most frequent of these;
    ``min_prob``: only topics of at least this share).  The counts and the bags
    are materialised: each of the fit's iterations reads the bags.
    ``pyspark.ml.clustering.LDA`` (online) fits it.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    bags, vocab, size = _bags(df, entity, text, min_df, max_df, vocab_size)
    if size == 0:
        empty = spark.createDataFrame([], f"{entity} {df.schema[entity].dataType.simpleString()}, topics {TOPIC_TYPE}")
        return empty, spark.createDataFrame([], "topic int, terms array<string>")
    model = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online").fit(bags)
    dist = model.transform(bags).select(entity, vector_to_array("topicDistribution").alias("_d"))
    topics = dist.select(entity, F.filter(F.transform("_d", lambda p, i: F.struct(i.cast("int").alias("topic"),
                                                                                   p.alias("prob"))),
                                          lambda s: s["prob"] >= min_prob).alias("topics"))
    terms_by_idx = vocab.select(F.col("idx").cast("int").alias("termIndex"), "term")
    desc = (model.describeTopics(top_words).select("topic", F.posexplode("termIndices").alias("pos", "termIndex"))
            .join(terms_by_idx, "termIndex")
            .groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("_s"))
            .select(F.col("topic").cast("int"), F.transform("_s", lambda s: s["term"]).alias("terms")))
    return topics, desc


# A19
def avg_score_by_topic(df: DataFrame, topics: str = "topics", score: str = "score") -> DataFrame:
    """Sum(score * prob) / sum(prob) per topic."""
    ex = df.select(F.col(score).cast("double").alias("_s"), F.inline(topics))
    return ex.groupBy("topic").agg(F.try_divide(F.sum(F.col("_s") * F.col("prob")), F.sum("prob")).alias("avg_score"))


# A20
def topic_distribution(df: DataFrame, topics: str = "topics") -> DataFrame:
    """Per topic: % of the total probability mass and the mean probability."""
    ex = df.select(F.inline(topics))
    per = ex.groupBy("topic").agg(F.sum("prob").alias("_p"), F.count("*").alias("_n"))
    total = ex.agg(F.sum("prob")).scalar()
    return per.select("topic", (F.try_divide(F.col("_p"), total) * 100.0).alias("percentage"),
                      (F.col("_p") / F.col("_n")).alias("avg_prob"))


# A21 (+ M4)
def topic_emotion_distribution(df: DataFrame, topics: str = "topics", feel: str = "max_feel",
                               labels: Sequence[str] = L.EMOTIONS) -> DataFrame:
    """Probability mass per (topic, label) in the fixed label order, smoothed
    with the circular pair rule and divided by its sum."""
    labels = list(labels)
    ex = df.select(F.col(feel), F.inline(topics))
    piv = ex.groupBy("topic").pivot(feel, labels).agg(F.sum("prob")).na.fill(0.0, subset=labels)
    sm = circular_pair_smooth(F.array(*[F.col(c) for c in labels]))
    return piv.select("topic", *[F.element_at(sm, i + 1).alias(c) for i, c in enumerate(labels)])


# T23
def complaints_by_topic(topics: DataFrame, scored: DataFrame, topic_id: int, entity: str, text: str = "review",
                        feel: str = "max_feel", n_rows: int | None = None, n: int = 3,
                        order: Sequence[str] = ("review_id",),
                        id_col: str | Sequence[str] = "review_id", summary: Callable[..., DataFrame] = summarise_complaints) -> DataFrame:
    """Sadness rows of entities whose dominant topic is ``topic_id``, summarised by ``summary``
    (``n_rows``: only the first so many in the explicit order)."""
    ents = topics.where(dominant_topic(F.col("topics")) == topic_id).select(entity)
    sub = scored.where(F.col(feel) == "sadness").join(ents, entity, "left_semi")
    if n_rows is not None:
        sub = sub.orderBy(*order).limit(n_rows)
    sub = sub.withColumn("_topic", F.lit(topic_id))
    return summary(sub, ["_topic"], text, n, id_col).withColumnRenamed("_topic", "topic")


def topics_from_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Deterministic topic mixture from a vector (tests and oracles): the
    squared shares of its components."""
    head = F.transform(F.col(vec), lambda x: x.cast("double") * x.cast("double"))
    tot = F.aggregate(head, F.lit(0.0), lambda a, x: a + x)
    with_tot = df.withColumn("_tot", tot)
    return with_tot.withColumn("topics", F.transform(head, lambda x, i: F.struct(
        i.cast("int").alias("topic"), F.try_divide(x, F.col("_tot")).alias("prob")))).drop("_tot")

