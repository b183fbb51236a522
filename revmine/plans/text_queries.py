"""Text queries over ``documents``: corpus -> counts -> tf-idf -> top terms.

Entity = ``documents.source``; English documents only (F8 by the ``lang``
column); expert documents (``labels.quality = 1``) weigh 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.operators import text as T
from revmine.plans import catalog as C
from revmine.plans import sqlfrag as S
from revmine.plans.registry import register
from revmine.session import cut_lineage

K = 10
MAX_DF = 0.9


def _stop() -> list[str]:
    return T.fixed_stop_words()


def en_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.reviews(spark, sf_dir, lang="en")
    return T.build_corpus(docs, "source", "text", expert="expert", expert_weight=C.EXPERT_WEIGHT)


def en_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = en_corpus(spark, sf_dir)
    # the counts feed three branches (document frequency, scores, norms):
    # materialise them once in the shared checkpoint folder
    return corpus, cut_lineage(T.word_counts(corpus, ["source"], stop=_stop()))


def en_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, counts = en_counts(spark, sf_dir)
    return T.tfidf_scores(counts, ["source"], docs=corpus, max_df=MAX_DF)


# --- SQL twins ---------------------------------------------------------------

def _sql_corpus_ctes() -> str:
    return f"""
r AS ({C.REVIEWS_SQL}),
docs AS (
  SELECT source, CASE WHEN expert THEN {C.EXPERT_WEIGHT} ELSE 1 END AS weight, {S.clean('text')} AS clean
  FROM r WHERE source IS NOT NULL),
toks AS (SELECT source, weight, unnest({S.tokens('clean')}) AS term FROM docs),
counts AS (
  SELECT source, term, CAST(sum(weight) AS BIGINT) AS tf FROM toks
  WHERE term NOT IN {S.in_list(_stop())} GROUP BY source, term),
ndocs AS (SELECT count(DISTINCT source) AS n_docs FROM docs),
dfreq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scored AS (
  SELECT c.source, c.term, c.tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w
  FROM counts c JOIN dfreq USING (term) CROSS JOIN ndocs
  WHERE df / n_docs < {MAX_DF}),
tfidf AS (SELECT source, term, w / sqrt(sum(w * w) OVER (PARTITION BY source)) AS tfidf FROM scored),
ranked AS (
  SELECT source, term, tfidf,
         row_number() OVER (PARTITION BY source ORDER BY round(tfidf, 9) DESC, term ASC) AS rank
  FROM tfidf)"""


def _with(body: str) -> str:
    return "WITH " + _sql_corpus_ctes().strip() + "\n" + body


# --- queries -------------------------------------------------------------------

@register("top_terms_per_entity", _with(f"""
SELECT source, CAST(rank AS INTEGER) AS rank, term, round(tfidf, 6) AS tfidf
FROM ranked WHERE rank <= {K}"""), bench=True)
def q_top_terms_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 (flagship): 10 highest tf-idf terms per source."""
    top = T.top_terms_per_entity(en_tfidf(spark, sf_dir), ["source"], "tfidf", K)
    return top.select("source", "rank", "term", F.round("tfidf", 6).alias("tfidf"))


@register("top_attributes", _with(f"""
SELECT source, {", ".join(f"max(CASE WHEN rank = {i} THEN term END) AS attr_{i}" for i in range(1, K + 1))}
FROM ranked WHERE rank <= {K} GROUP BY source"""))
def q_top_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide attr_1..attr_10 per source."""
    return T.top_attributes(en_tfidf(spark, sf_dir), ["source"], K, "attr_")


@register("word_counts", _with("SELECT source, term, tf FROM counts"))
def q_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted document-term counts, stop words removed."""
    return en_counts(spark, sf_dir)[1]


@register("tfidf_scores", _with("SELECT source, term, round(tfidf, 6) AS tfidf FROM tfidf"), bench=True)
def q_tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full tf-idf table."""
    return en_tfidf(spark, sf_dir).select("source", "term", F.round("tfidf", 6).alias("tfidf"))


@register("document_frequency", _with("""
SELECT term, df, n_docs, round(df / n_docs, 6) AS doc_freq
FROM dfreq CROSS JOIN ndocs"""))
def q_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: share of sources containing each term."""
    corpus, counts = en_counts(spark, sf_dir)
    d = T.document_frequency(counts, ["source"], docs=corpus)
    return d.select("term", "df", "n_docs", F.round("doc_freq", 6).alias("doc_freq"))


@register("stop_words", f"""
WITH r AS ({C.REVIEWS_SQL}),
docs AS (SELECT source, {S.clean('text')} AS clean FROM r WHERE source IS NOT NULL),
toks AS (SELECT DISTINCT source, unnest({S.tokens('clean')}) AS term FROM docs),
ndocs AS (SELECT count(DISTINCT source) AS n_docs FROM docs),
freq AS (SELECT term FROM toks CROSS JOIN ndocs GROUP BY term, n_docs HAVING count(*) / n_docs >= {MAX_DF})
SELECT term FROM freq UNION SELECT term FROM {S.values(T.fixed_stop_words())}""")
def q_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English list + pour forms + place words + terms in >= 90 % of sources."""
    corpus = en_corpus(spark, sf_dir)
    raw = T.word_counts(corpus, ["source"], weight=None)
    return T.stop_words(raw, ["source"], MAX_DF, docs=corpus)
