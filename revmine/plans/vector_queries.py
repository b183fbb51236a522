"""Term vectors (T21) and scorers learnt from seed terms (T18-T20) over the English documents.

The test prose is invented, so no real cue word occurs: the 14 most frequent
terms stand in for a user's seed list, dealt to the seven emotions in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.operators import scoring as SC
from revmine.operators import text as T
from revmine.operators import vectors as V
from revmine.plans import catalog as C
from revmine.plans import sqlfrag as S
from revmine.plans.registry import register
from revmine.plans.scoring_queries import sentences
from revmine.plans.text_queries import _stop, en_tfidf
from revmine.session import cut_lineage

EMO = L.EMOTIONS
MAX_TERMS, WINDOW, NEAR, ROUNDS, SHARE = 20_000, 4, 10, 6, 0.6


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = C.table(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id", "text")
    return cut_lineage(T.with_tokens(d, "text", "tokens").select("doc_id", "tokens"))


def _vocabulary(tok: DataFrame) -> list[str]:
    return V.vocabulary(tok, "tokens", MAX_TERMS, _stop())


PMI_SQL = f"""
tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS p
        FROM (SELECT doc_id, {S.tokens(S.clean("text"))} AS t FROM documents WHERE lang = 'en') x),
voc AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS i
        FROM (SELECT term, count(*) AS n FROM tok WHERE term NOT IN {S.in_list(_stop())} GROUP BY term ORDER BY n DESC, term LIMIT {MAX_TERMS}) v),
pt AS (SELECT doc_id, p, i FROM tok LEFT JOIN voc USING (term)),
ld AS (SELECT i, {", ".join(f"lead(i, {d}) OVER w AS a{d}" for d in range(1, WINDOW + 1))} FROM pt WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
pr AS ({" UNION ALL ".join(f"SELECT i, a{d} AS j FROM ld WHERE i IS NOT NULL AND a{d} IS NOT NULL" for d in range(1, WINDOW + 1))}),
cnt AS (SELECT i, j, count(*) AS n FROM (SELECT i, j FROM pr UNION ALL SELECT j, i FROM pr) y GROUP BY i, j),
ni AS (SELECT i, sum(n)::DOUBLE AS s FROM cnt GROUP BY i),
pmi AS (SELECT * FROM (SELECT c.i, c.j, c.n, ln(c.n::DOUBLE * (SELECT sum(n)::DOUBLE FROM cnt) / (a.s * b.s)) AS v
                       FROM cnt c JOIN ni a ON a.i = c.i JOIN ni b ON b.i = c.j) z WHERE v > 0)"""


@register("cooccurrence_ppmi", "WITH " + PMI_SQL.strip() + """
SELECT a.term, b.term AS context, n, round(v, 6) AS ppmi FROM pmi JOIN voc a ON a.i = pmi.i JOIN voc b ON b.i = pmi.j""")
def q_cooccurrence_ppmi(spark: SparkSession, sf: str) -> DataFrame:
    """Positive PMI of terms at most four words apart."""
    tok = _tokens(spark, sf)
    terms = _vocabulary(tok)
    names = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
    pmi = V.positive_pmi(cut_lineage(V.cooccurrences(tok, terms, "tokens", WINDOW)))
    return (pmi.join(names, "i").join(names.select(F.col("i").alias("j"), F.col("term").alias("context")), "j")
            .select("term", "context", "n", F.round("v", 6).alias("ppmi")))


@register("classify_terms")
def q_classify_terms(spark: SparkSession, sf: str) -> DataFrame:
    """T21 by meaning: each term to the source whose ten best tf-idf terms (W4) its vector is nearest to."""
    vectors = cut_lineage(V.term_vectors(_tokens(spark, sf), max_terms=MAX_TERMS, stop=_stop(), dim=32))
    seeds = T.top_terms_per_entity(en_tfidf(spark, sf), ["source"], "tfidf", 10).select("term", F.col("source").alias("category"))
    out = SC.classify_vectors(vectors, V.seed_centroids(vectors, seeds), "term", "vector", temperature=0.1)
    return out.select("term", "category", F.round("score", 6).alias("score"), "kept")


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    tok = _tokens(spark, sf)
    terms = _vocabulary(tok)
    seeds = spark.createDataFrame([(t, EMO[k % len(EMO)]) for k, t in enumerate(terms[:2 * len(EMO)])], "term string, label string")
    return cut_lineage(V.induce_lexicon(tok, seeds, EMO, window=WINDOW, m=NEAR, terms=terms, share=SHARE, tolerance=0.0, max_rounds=ROUNDS))


def _lexicon_sql() -> str:
    own = ", ".join(f"CASE WHEN i % {len(EMO)} = {k} THEN {1 - SHARE} ELSE 0.0 END::DOUBLE AS {e}" for k, e in enumerate(EMO))
    rounds = ""
    for k in range(1, ROUNDS + 1):
        near = ", ".join(f"sum(w * f.{e}) * {SHARE} AS {e}" for e in EMO)
        rounds += f""",
r{k} AS (SELECT i, {", ".join(f"sum({e}) AS {e}" for e in EMO)} FROM (
  SELECT g.i, {near} FROM edges g JOIN r{k - 1} f ON f.i = g.j GROUP BY g.i UNION ALL SELECT i, {", ".join(EMO)} FROM r0) x GROUP BY i)"""
    return PMI_SQL + f""",
nb AS (SELECT i, j, v, row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, j) AS r FROM pmi WHERE i <> j),
edges AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS w FROM nb WHERE r <= {NEAR}),
r0 AS (SELECT i, {own} FROM voc WHERE i < {2 * len(EMO)}){rounds},
lex AS (SELECT term, {", ".join(EMO)} FROM r{ROUNDS} JOIN voc USING (i))"""


@register("learned_lexicon", "WITH " + _lexicon_sql().strip() + f"\nSELECT term, {', '.join(f'round({e}, 6) AS {e}' for e in EMO)} FROM lex")
def q_learned_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Label weights of terms after six rounds from the seed terms over the ten strongest neighbours."""
    return _lexicon(spark, sf).select("term", *[F.round(e, 6).alias(e) for e in EMO])


def _sentence_tokens(spark: SparkSession, sf: str) -> DataFrame:
    s = sentences(spark, sf).withColumn("sentence_idx", F.col("sentence_idx").cast("int"))
    return T.with_tokens(s, "review", "tokens")


def _scored_sql(lexicon: str, labels: list[str], where: str = "") -> str:
    total = " + ".join(f"s_{e}" for e in labels)
    shares = ", ".join(f"CASE WHEN {total} > 0 THEN s_{e} / ({total}) ELSE 0.0 END AS {e}" for e in labels)
    arr, sc = "[" + ", ".join(f"'{e}'" for e in labels) + "]", "[" + ", ".join(f"round({e}, 9)" for e in labels) + "]"
    return f""",
sent AS (SELECT doc_id, score, CAST(unnest(range(len(parts))) AS INTEGER) AS sentence_idx, unnest(parts) AS review
         FROM (SELECT doc_id, CAST(least(floor(n_chars / 1000), 5) AS INTEGER) AS score, string_split_regex(text, '[;.?!]') AS parts
               FROM documents WHERE lang = 'en') d),
sw AS (SELECT doc_id, sentence_idx, unnest({S.tokens(S.clean("review"))}) AS term FROM sent {where}),
su AS (SELECT doc_id, sentence_idx, {", ".join(f"coalesce(sum({e}), 0.0) AS s_{e}" for e in labels)}
       FROM (SELECT doc_id, sentence_idx FROM sent {where}) k LEFT JOIN sw USING (doc_id, sentence_idx) LEFT JOIN ({lexicon}) l USING (term) GROUP BY doc_id, sentence_idx),
sh AS (SELECT doc_id, sentence_idx, {shares} FROM su),
scored AS (SELECT *, {arr}[list_position({sc}, list_max({sc}))] AS max_feel FROM sh)"""


@register("score_emotions_learned", "WITH " + _lexicon_sql().strip() + _scored_sql("SELECT * FROM lex", EMO) + f"""
SELECT doc_id, sentence_idx, {", ".join(f"round({e}, 6) AS {e}" for e in EMO)}, max_feel FROM scored""")
def q_score_emotions_learned(spark: SparkSession, sf: str) -> DataFrame:
    """T18 with learnt weights: seven label shares per sentence and the largest."""
    out = V.score_with_lexicon(_sentence_tokens(spark, sf), ["doc_id", "sentence_idx"], _lexicon(spark, sf), EMO)
    return out.select("doc_id", "sentence_idx", *[F.round(e, 6).alias(e) for e in EMO], "max_feel")


_SIDES_SQL = "SELECT term, " + ", ".join(f"{' + '.join(cols)} AS {side}" for side, cols in V.SIDES.items()) + " FROM lex"


@register("score_polarity_learned", "WITH " + _lexicon_sql().strip() + _scored_sql(_SIDES_SQL, SC.POLARITY_LABELS, "WHERE score IN (0, 1, 2)") + """
SELECT doc_id, sentence_idx, round(CASE WHEN max_feel = 'negative' THEN negative ELSE 0.0 END, 6) AS polarity FROM scored""")
def q_score_polarity_learned(spark: SparkSession, sf: str) -> DataFrame:
    """T19 with learnt weights: negative share of the sentences of low-score documents, 0 where another side is larger."""
    low = _sentence_tokens(spark, sf).where(F.col("score").isin(L.NEGATIVE_SCORES))
    out = V.score_with_lexicon(low, ["doc_id", "sentence_idx"], V.polarity_lexicon(_lexicon(spark, sf)), SC.POLARITY_LABELS, feel="side")
    return out.select("doc_id", "sentence_idx", F.round(F.when(F.col("side") == "negative", F.col("negative")).otherwise(0.0), 6).alias("polarity"))


@register("score_sentences_learned", "WITH " + _lexicon_sql().strip() + _scored_sql("SELECT * FROM lex", EMO, "WHERE score IN (4, 5)") + """
SELECT doc_id, sentence_idx, max_feel FROM scored""")
def q_score_sentences_learned(spark: SparkSession, sf: str) -> DataFrame:
    """T20 with learnt weights: the feeling of each sentence of documents with score 4 or 5."""
    high = _sentence_tokens(spark, sf).where(F.col("score").isin(L.POSITIVE_SCORES))
    return V.score_with_lexicon(high, ["doc_id", "sentence_idx"], _lexicon(spark, sf), EMO).select("doc_id", "sentence_idx", "max_feel")




GRAPH_ROUNDS, DAMPING = 8, 0.85


def _summary_sql(where: str, group: str = "d.source", more: str = "") -> str:
    rounds = ""
    for k in range(1, GRAPH_ROUNDS + 1):
        rounds += f""",
p{k} AS (SELECT p.source, p.doc_id, p.k, {1 - DAMPING!r}::DOUBLE + {DAMPING} * coalesce(c.s, 0.0) AS score FROM p{k - 1} p LEFT JOIN (
  SELECT e.source, e.da, e.ka, sum(e.p * q.score) AS s FROM sedges e JOIN p{k - 1} q ON q.source = e.source AND q.doc_id = e.db AND q.k = e.kb GROUP BY ALL) c
  ON c.source = p.source AND c.da = p.doc_id AND c.ka = p.k)"""
    greedy, over = "", "0.0::DOUBLE"
    for k in range(1, 4):
        if k > 1:
            over = f"greatest(over, len(list_intersect(terms, b{k - 1}.bt)) / least(len(terms), len(b{k - 1}.bt)))"
        source = f"n{k - 1} n JOIN b{k - 1} USING (source)" if k > 1 else f"st JOIN p{GRAPH_ROUNDS} USING (source, doc_id, k)"
        greedy += f""",
n{k} AS (SELECT source, doc_id, k, sentence, terms, score, {over} AS over FROM {source}),
b{k} AS (SELECT source, sentence AS bs, terms AS bt, score AS bw FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score * (1.0 - over), 9) DESC, sentence, doc_id, k) AS rn FROM n{k} WHERE over <= 0.5) x WHERE rn = 1)"""
    return "WITH " + _lexicon_sql().strip() + _scored_sql("SELECT * FROM lex", EMO) + more + f""",
st0 AS (SELECT {group} AS source, doc_id, sentence_idx AS k, review AS sentence, list_distinct({S.tokens(S.clean("review"))}) AS terms
        FROM scored JOIN sent USING (doc_id, sentence_idx) JOIN (SELECT doc_id, source FROM documents) d USING (doc_id) WHERE max_feel = 'sadness' {where}),
st AS (SELECT * FROM st0 WHERE len(terms) > 0),
po AS (SELECT source, doc_id, k, ln(1.0 + len(terms)) AS l, unnest(terms) AS t FROM st),
gn AS (SELECT source, count(*) AS n FROM st GROUP BY source),
ra AS (SELECT source, t, ln(any_value(n) / count(*)) AS idf FROM po JOIN gn USING (source) GROUP BY source, t HAVING count(*) >= 2),
pr2 AS (SELECT * FROM po JOIN ra USING (source, t)),
ew AS (SELECT a.source, a.doc_id AS da, a.k AS ka, b.doc_id AS db, b.k AS kb, sum(a.idf) / any_value(a.l + b.l) AS w
       FROM pr2 a JOIN pr2 b ON a.source = b.source AND a.t = b.t AND (a.doc_id <> b.doc_id OR a.k <> b.k) GROUP BY ALL),
sedges AS (SELECT source, da, ka, db, kb, w / sum(w) OVER (PARTITION BY source, db, kb) AS p FROM ew),
p0 AS (SELECT source, doc_id, k, 1.0::DOUBLE AS score FROM st){rounds}{greedy}
SELECT * FROM (""" + " UNION ALL ".join(f"SELECT source, {k} AS rank, trim(bs) AS sentence, round(bw, 6) AS score FROM b{k}" for k in range(1, 4)) + ") z"


def _sad(spark: SparkSession, sf: str) -> DataFrame:
    s = _sentence_tokens(spark, sf).withColumnRenamed("location", "source")
    scored = V.score_with_lexicon(s, ["doc_id", "sentence_idx"], _lexicon(spark, sf), EMO)
    sad = s.select("source", "doc_id", F.col("sentence_idx").alias("sid"), "review").join(
        scored.select("doc_id", F.col("sentence_idx").alias("sid"), "max_feel"), ["doc_id", "sid"])
    return cut_lineage(sad.where(F.col("max_feel") == "sadness"))


@register("summarise_by_graph", _summary_sql(""))
def q_summarise_by_graph(spark: SparkSession, sf: str) -> DataFrame:
    """T22 without repeats: per source the 3 most central sadness sentences (learnt weights) that hardly overlap."""
    return SC.summarise_by_graph(_sad(spark, sf), ["source"], "review", 3, ["doc_id", "sid"], damping=DAMPING, tolerance=0.0,
                                 max_rounds=GRAPH_ROUNDS)


@register("complaints_by_entity_graph", _summary_sql("AND d.source = 'src1'"))
def q_complaints_by_entity_graph(spark: SparkSession, sf: str) -> DataFrame:
    """T24 without repeats: the summary of one source's sadness sentences."""
    def summary(df, by, text, n, ids):
        return SC.summarise_by_graph(df, by, text, n, ids, damping=DAMPING, tolerance=0.0, max_rounds=GRAPH_ROUNDS)

    return SC.complaints_by_entity(_sad(spark, sf), "source", "src1", "review", id_col=["doc_id", "sid"], summary=summary)


# the sources' topic mixtures are stood in for by the vectors with their numbers
_COMMON_TOPIC_SQL = """,
dt AS (SELECT 'src' || vec_id AS source, CAST(list_position(sq, list_max(sq)) - 1 AS INTEGER) AS topic
       FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS sq FROM embeddings) x),
ct AS (SELECT topic FROM dt WHERE source IN (SELECT DISTINCT source FROM documents) GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1)"""


@register("complaints_by_topic_graph", "SELECT source AS topic, rank, sentence, score FROM (" + _summary_sql(
    "AND d.source IN (SELECT source FROM dt JOIN ct USING (topic))", "(SELECT topic FROM ct)", _COMMON_TOPIC_SQL) + ") o")
def q_complaints_by_topic_graph(spark: SparkSession, sf: str) -> DataFrame:
    """T23 without repeats: sadness sentences (learnt weights) of the sources with the commonest dominant topic, summarised."""
    from revmine.functions.arrays import dominant_topic
    from revmine.operators import topics as TP

    names = C.table(spark, sf, "documents").select("source").distinct()
    mix = TP.topics_from_vectors(C.table(spark, sf, "embeddings").withColumn("source", F.concat(F.lit("src"), "vec_id")), "embedding").select("source", "topics")
    mix = mix.join(names, "source", "left_semi")
    common = mix.groupBy(dominant_topic("topics").alias("t")).count().orderBy(F.desc("count"), "t").first()["t"]

    def summary(df, by, text, n, ids):
        return SC.summarise_by_graph(df, by, text, n, ids, damping=DAMPING, tolerance=0.0, max_rounds=GRAPH_ROUNDS)

    return TP.complaints_by_topic(mix, _sad(spark, sf), common, "source", "review", id_col=["doc_id", "sid"], summary=summary)


@register("write_topic_table", """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS sq FROM embeddings)
SELECT vec_id, CAST(unnest(range(len(sq))) AS INTEGER) AS topic, round(unnest(sq) / list_sum(sq), 6) AS prob FROM q""")
def q_write_topic_table(spark: SparkSession, sf: str) -> DataFrame:
    """Topic mixtures (shares of squared vector components) written as a topic table and read back."""
    from revmine.operators import topics as TP
    from revmine.plans.io_paths import scratch_path
    from revmine.sources import tables as ST

    path = scratch_path(spark, sf, "topic_table")
    ST.write_topics(TP.topics_from_vectors(C.table(spark, sf, "embeddings"), "embedding").select("vec_id", "topics"), path)
    return spark.read.parquet(f"{path}/topics").select("vec_id", F.inline("topics")).select("vec_id", "topic", F.round("prob", 6).alias("prob"))
