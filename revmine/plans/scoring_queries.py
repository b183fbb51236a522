"""Scoring queries over sentences of the English documents.

Sentences are the scored texts (reviews of the study were short).  A sentence's ``score``
is its document's length class 0-5 and its ``location`` the document source.
The label rule is the deterministic first-letter lexicon (the test prose is
invented words, so no real cue word occurs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.operators import aggregate as A
from revmine.operators import clean as CL
from revmine.operators import joins as J
from revmine.operators import reshape as R
from revmine.operators import scoring as SC
from revmine.operators import stats as M
from revmine.operators import text as T
from revmine.operators import window as W
from revmine.plans import catalog as C
from revmine.plans import sqlfrag as S
from revmine.plans.registry import register
from revmine.plans.split_queries import counted
from revmine.session import cut_lineage

EMO = L.EMOTIONS
K = 10
MAX_DF = 0.9


def doc_score(n_chars) -> F.Column:
    return F.least(F.floor(n_chars / 1000), F.lit(5)).cast("int")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").where(F.col("lang") == "en").select(
        "doc_id", F.col("source").alias("location"), "text", doc_score(F.col("n_chars")).alias("score"))
    return R.explode_sentences(docs, "text", ["doc_id", "location", "score"], out="review")


def scored_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return SC.score_emotions(sentences(spark, sf), "review", SC.initial_letter_rule(EMO))


def _rule_sql(var: str, labels) -> str:
    n = len(labels)
    arr = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    return (f"CASE WHEN ascii({var}) - 97 BETWEEN 0 AND 25 THEN "
            f"{arr}[CAST(floor((ascii({var}) - 97) * {n} / 26) AS INTEGER) + 1] END")


def _score_cols_sql(text: str, labels) -> tuple[str, str]:
    hits = f"list_filter(list_transform(regexp_extract_all(lower({text}), '\\p{{L}}+'), lambda w: {_rule_sql('w', labels)}), lambda x: x IS NOT NULL)"
    cols = ", ".join(f"CASE WHEN len(h) > 0 THEN len(list_filter(h, lambda x: x = '{lab}')) / len(h) ELSE 0.0 END AS {lab}"
                     for lab in labels)
    return hits, cols


def _scored_sql() -> str:
    hits, cols = _score_cols_sql("review", EMO)
    arr = "[" + ", ".join(f"'{x}'" for x in EMO) + "]"
    sc = "[" + ", ".join(EMO) + "]"
    return f"""
sent AS (SELECT doc_id, location, score, unnest(parts) AS review, unnest(range(len(parts))) AS sentence_idx
         FROM (SELECT doc_id, source AS location, CAST(least(floor(n_chars / 1000), 5) AS INTEGER) AS score,
                      string_split_regex(text, '[;.?!]') AS parts FROM documents WHERE lang = 'en') d),
hitsq AS (SELECT *, {hits} AS h FROM sent),
sc0 AS (SELECT doc_id, location, score, review, CAST(sentence_idx AS INTEGER) AS sentence_idx, {cols} FROM hitsq),
scored AS (SELECT *, {arr}[list_position({sc}, list_max({sc}))] AS max_feel FROM sc0)"""


def _w(body: str) -> str:
    return "WITH " + _scored_sql().strip() + "\n" + body


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register("score_emotions", _w(f"""
SELECT doc_id, sentence_idx, {", ".join(f"round({e}, 6) AS {e}" for e in EMO)}, max_feel FROM scored"""), bench=True)
def q_score_emotions(spark: SparkSession, sf: str) -> DataFrame:
    """Seven label shares per sentence + arg-max label."""
    s = scored_sentences(spark, sf)
    return s.select("doc_id", "sentence_idx", *_r6(EMO), "max_feel")


@register("label_argmax", _w("SELECT doc_id, sentence_idx, max_feel FROM scored"))
def q_label_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Leftmost arg-max over the seven score columns (all zero -> anger)."""
    s = scored_sentences(spark, sf)
    return s.select("doc_id", "sentence_idx", X.label_argmax(EMO).alias("max_feel"))


@register("explode_sentences", _w("SELECT doc_id, CAST(sentence_idx AS INTEGER) AS sentence_idx, review FROM sent"))
def q_explode_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """One row per ; . ? ! piece (empty pieces kept)."""
    return sentences(spark, sf).select("doc_id", F.col("sentence_idx").cast("int").alias("sentence_idx"), "review")


def _polarity_sql() -> str:
    hits, cols = _score_cols_sql("review", SC.POLARITY_LABELS)
    return _w(f""",
ph AS (SELECT doc_id, sentence_idx, score, {hits} AS h, review FROM sent WHERE score IN (0, 1, 2)),
pc AS (SELECT doc_id, CAST(sentence_idx AS INTEGER) AS sentence_idx, {cols} FROM ph),
pol AS (SELECT doc_id, sentence_idx,
               CASE WHEN ['negative', 'neutral', 'positive'][list_position([negative, neutral, positive],
                         list_max([negative, neutral, positive]))] = 'negative' THEN negative ELSE 0.0 END AS polarity
        FROM pc)""".replace("\nph AS", "ph AS", 1)).replace("scored AS", "scored AS", 1)


def polarity(spark: SparkSession, sf: str) -> DataFrame:
    s = sentences(spark, sf)
    out = SC.score_polarity(s, "review", "score", SC.initial_letter_rule(SC.POLARITY_LABELS))
    return out.select("doc_id", F.col("sentence_idx").cast("int").alias("sentence_idx"), "polarity")


@register("score_polarity", _polarity_sql() + "\nSELECT doc_id, sentence_idx, round(polarity, 6) AS polarity FROM pol")
def q_score_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """Negative polarity of sentences of low-score documents (else 0)."""
    p = polarity(spark, sf)
    return p.select("doc_id", "sentence_idx", F.round("polarity", 6).alias("polarity"))


@register("exclude_zero_polarity", _polarity_sql() + """
SELECT doc_id, sentence_idx, round(polarity, 6) AS polarity FROM pol WHERE polarity <> 0""")
def q_exclude_zero_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """only sentences with a non-zero polarity."""
    p = CL.exclude_zero_polarity(polarity(spark, sf))
    return p.select("doc_id", "sentence_idx", F.round("polarity", 6).alias("polarity"))


@register("most_negative_sentences", _polarity_sql() + """
SELECT doc_id, sentence_idx, round(polarity, 6) AS polarity FROM pol WHERE polarity <> 0
ORDER BY polarity DESC, doc_id, sentence_idx LIMIT 5""")
def q_most_negative_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the five sentences with the strongest negative polarity (ties by id)."""
    p = CL.exclude_zero_polarity(polarity(spark, sf)).withColumn("polarity", F.round("polarity", 6))
    return p.orderBy(F.col("polarity").desc(), "doc_id", "sentence_idx").limit(5)


@register("least_negative_sentences", _polarity_sql() + """
SELECT doc_id, sentence_idx, round(polarity, 6) AS polarity FROM pol WHERE polarity <> 0
ORDER BY polarity ASC, doc_id, sentence_idx LIMIT 5""")
def q_least_negative_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """K1 (reverse): the five weakest non-zero negative polarities."""
    p = CL.exclude_zero_polarity(polarity(spark, sf)).withColumn("polarity", F.round("polarity", 6))
    return p.orderBy(F.col("polarity").asc(), "doc_id", "sentence_idx").limit(5)


@register("score_sentences", _w(f"""
SELECT doc_id, sentence_idx, max_feel FROM scored WHERE score IN (4, 5)"""))
def q_score_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of score 4-5 documents, scored (F9 -> P4 -> T18)."""
    docs = C.table(spark, sf, "documents").where(F.col("lang") == "en").select(
        "doc_id", "text", doc_score(F.col("n_chars")).alias("score"))
    s = SC.score_sentences(docs, "text", ["doc_id"], "score", L.POSITIVE_SCORES, SC.initial_letter_rule(EMO))
    return s.select("doc_id", F.col("sentence_idx").cast("int").alias("sentence_idx"), "max_feel")


@register("emotion_filter", _w("""
SELECT doc_id, sentence_idx FROM scored WHERE max_feel = 'sadness' AND location = 'src1'"""))
def q_emotion_filter(spark: SparkSession, sf: str) -> DataFrame:
    """sadness sentences of one source."""
    s = CL.emotion_filter(scored_sentences(spark, sf), "sadness", entity="location", entity_value="src1")
    return s.select("doc_id", "sentence_idx")


@register("emotion_filter_first_n", _w("""
SELECT doc_id, sentence_idx FROM scored WHERE max_feel = 'sadness' ORDER BY doc_id, sentence_idx LIMIT 50"""))
def q_emotion_filter_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 sadness sentences in (document, position) order."""
    s = CL.emotion_filter(scored_sentences(spark, sf), "sadness", n=50, order=["doc_id", "sentence_idx"])
    return s.select("doc_id", "sentence_idx")


@register("emotion_split", _w("""
SELECT doc_id, sentence_idx, CASE WHEN max_feel IN ('disgust', 'sadness') THEN 'negative'
                                  WHEN max_feel IN ('neutral', 'joy') THEN 'positive' END AS polarity
FROM scored"""))
def q_emotion_split(spark: SparkSession, sf: str) -> DataFrame:
    """T5: disgust/sadness -> negative, neutral/joy -> positive, others -> neither."""
    return W.emotion_split(scored_sentences(spark, sf)).select("doc_id", "sentence_idx", "polarity")


def _emotion_crit_sql() -> str:
    return _w(f""",
lab AS (SELECT location AS source, doc_id, sentence_idx,
               CASE WHEN max_feel IN ('disgust', 'sadness') THEN 'negative'
                    WHEN max_feel IN ('neutral', 'joy') THEN 'positive' END AS polarity,
               {S.clean('review')} AS clean FROM scored),
docs AS (SELECT * FROM lab WHERE polarity IS NOT NULL AND source IS NOT NULL),
toks AS (SELECT source, polarity, unnest({S.tokens('clean')}) AS term FROM docs),
counts AS (SELECT source, polarity, term, CAST(count(*) AS BIGINT) AS tf FROM toks
           WHERE term NOT IN {S.in_list(T.fixed_stop_words())} GROUP BY ALL),
ndocs AS (SELECT polarity, count(*) AS n_docs FROM (SELECT DISTINCT source, polarity FROM docs) d GROUP BY polarity),
dfreq AS (SELECT polarity, term, count(*) AS df FROM counts GROUP BY polarity, term),
sc AS (SELECT c.*, c.tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w
       FROM counts c JOIN dfreq USING (polarity, term) JOIN ndocs USING (polarity) WHERE df / n_docs < {MAX_DF}),
tfidf AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY source, polarity)) AS tfidf FROM sc),
aligned AS (SELECT source, term, COALESCE(sum(CASE WHEN polarity = 'negative' THEN tfidf END), 0.0) AS negative,
                   COALESCE(sum(CASE WHEN polarity = 'positive' THEN tfidf END), 0.0) AS positive
            FROM tfidf GROUP BY source, term),
ranked AS (SELECT *, negative - positive AS score_diff,
                  row_number() OVER (PARTITION BY source ORDER BY round(negative - positive, 9) DESC, term) AS rank
           FROM aligned)
SELECT source, CAST(rank AS INTEGER) AS rank, term, round(score_diff, 6) AS score_diff FROM ranked WHERE rank <= {K}""")


@register("build_corpus_emotion_split", _emotion_crit_sql())
def q_build_corpus_emotion_split(spark: SparkSession, sf: str) -> DataFrame:
    """T2 (emotion mode) -> T15: criticisms from emotion-labelled sentences."""
    T.check_split_arguments(False, True, None)
    lab = W.emotion_split(scored_sentences(spark, sf))
    corpus = T.build_corpus(lab, "location", "review", label="polarity").withColumnRenamed("location", "source")
    counts, docs = counted(corpus, ["source", "polarity"])
    crit = T.criticisms_per_entity(counts, "source", k=K, docs=docs, max_df=MAX_DF)
    return crit.select("source", "rank", "term", F.round("score_diff", 6).alias("score_diff"))


def _share_sql() -> str:
    counts = ", ".join(f"count(CASE WHEN max_feel = '{e}' THEN 1 END) AS {e}" for e in EMO)
    tot = " + ".join(EMO)
    return _w(f""",
cnt AS (SELECT score, {counts} FROM scored GROUP BY score),
pct AS (SELECT score, {", ".join(f"{e} * 100.0 / ({tot}) AS {e}" for e in EMO)} FROM cnt)""")


@register("emotion_share_by_score", _share_sql() + f"""
SELECT score, {", ".join(f"round({e}, 6) AS {e}" for e in EMO)} FROM pct""")
def q_emotion_share_by_score(spark: SparkSession, sf: str) -> DataFrame:
    """% of each arg-max label per score class."""
    sh = A.emotion_share_by_score(scored_sentences(spark, sf), "score", "max_feel", EMO)
    return sh.select("score", *_r6(EMO))


def _rank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({p.strip() + ', ' if p else 'PARTITION BY '}{col}) - 1) / 2.0)"


@register("spearman", _share_sql() + f""",
lng AS (SELECT score, label, value FROM pct UNPIVOT (value FOR label IN ({", ".join(EMO)}))),
rk AS (SELECT label, {_rank_sql('score', 'label')} AS rx, {_rank_sql('value', 'label')} AS ry FROM lng)
SELECT label, round(CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0
                        THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 6) AS spearman,
       count(*) AS n FROM rk GROUP BY label""")
def q_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman correlation of each label's share with the score."""
    # a row per score class, read by each branch of the ranks
    sh = cut_lineage(A.emotion_share_by_score(scored_sentences(spark, sf), "score", "max_feel", EMO))
    sp = M.spearman(sh, "score", EMO)
    return sp.select("label", F.round("spearman", 6).alias("spearman"), "n")


def _p_value_sql() -> str:
    def series(odd: bool) -> str:
        num, den, top = ("2 * j", "2 * j + 1", "(nu - 3) // 2") if odd else ("2 * j - 1", "2 * j", "(nu - 2) // 2")
        return (f"COALESCE(list_sum(list_transform(range(1, {top} + 1), lambda k: "
                f"exp(list_sum(list_transform(range(1, k + 1), lambda j: ln(({num}) / ({den}))))) "
                f"* pow(cos(theta), 2 * k))), 0.0)")
    return _share_sql() + f""",
lng AS (SELECT score, label, value FROM pct UNPIVOT (value FOR label IN ({", ".join(EMO)}))),
rk AS (SELECT label, {_rank_sql('score', 'label')} AS rx, {_rank_sql('value', 'label')} AS ry FROM lng),
sp AS (SELECT label, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0
                          THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS r, count(*) AS n
       FROM rk GROUP BY label),
th AS (SELECT *, n - 2 AS nu,
              CASE WHEN r IS NOT NULL AND abs(r) < 1 AND n >= 3
                   THEN atan(abs(r * sqrt((n - 2) / (1 - r * r))) / sqrt(n - 2)) END AS theta FROM sp),
pa AS (SELECT *, CASE WHEN theta IS NULL THEN NULL
                      WHEN nu % 2 = 1 AND nu = 1 THEN 2 / pi() * theta
                      WHEN nu % 2 = 1 THEN 2 / pi() * (theta + sin(theta) * cos(theta) * (1 + {series(True)}))
                      ELSE sin(theta) * (1 + {series(False)}) END AS a FROM th)
SELECT label, round(r, 6) AS spearman, n,
       round(CASE WHEN r IS NULL OR n < 3 THEN NULL WHEN abs(r) >= 1 THEN 0.0
                  ELSE greatest(0.0, least(1.0, 1 - a)) END, 6) AS p_value
FROM pa"""


@register("spearman_p_value", _p_value_sql())
def q_spearman_p_value(spark: SparkSession, sf: str) -> DataFrame:
    """M3: two-sided p-values of the Spearman coefficients (t test, n - 2 dof)."""
    sh = cut_lineage(A.emotion_share_by_score(scored_sentences(spark, sf), "score", "max_feel", EMO))
    p = M.spearman_p_value(M.spearman(sh, "score", EMO))
    return p.select("label", F.round("spearman", 6).alias("spearman"), "n", F.round("p_value", 6).alias("p_value"))


@register("emotion_by_location", _w(f"""
, top AS (SELECT location FROM scored WHERE location IS NOT NULL GROUP BY location
          ORDER BY count(*) DESC, location LIMIT 10)
SELECT location, {", ".join(f"count(CASE WHEN max_feel = '{e}' THEN 1 END) AS {e}" for e in EMO)}, count(*) AS total
FROM scored WHERE location IN (SELECT location FROM top) GROUP BY location""".replace("\n, top", ",\ntop", 1)))
def q_emotion_by_location(spark: SparkSession, sf: str) -> DataFrame:
    """Label counts for the 10 locations with most sentences (+ total)."""
    return A.emotion_by_location(scored_sentences(spark, sf), "location", "max_feel", 10, EMO)


@register("top_locations_by_emotion", _w("""
SELECT location, round(p, 6) AS percentage FROM
  (SELECT location, count(CASE WHEN max_feel = 'sadness' THEN 1 END) / count(*) * 100.0 AS p FROM scored
   WHERE location IS NOT NULL GROUP BY location HAVING count(*) > 100 AND count(CASE WHEN max_feel = 'sadness' THEN 1 END) > 0) x
ORDER BY p DESC, location LIMIT 5"""))
def q_top_locations_by_emotion(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 locations (over 100 sentences) with the highest sadness share."""
    out = A.top_locations_by_emotion(scored_sentences(spark, sf), 100, "sadness", 5)
    return out.select("location", F.round("percentage", 6).alias("percentage"))


@register("align_by_location", _w("""
SELECT c.location, c.count, t.total, round(c.count / t.total * 100.0, 6) AS percentage
FROM (SELECT location, count(*) AS count FROM scored WHERE max_feel = 'joy' GROUP BY location) c
JOIN (SELECT location, count(*) AS total FROM scored GROUP BY location) t ON c.location = t.location"""))
def q_align_by_location(spark: SparkSession, sf: str) -> DataFrame:
    """Joy counts / totals x 100 on matching locations."""
    s = scored_sentences(spark, sf)
    counts = s.where(F.col("max_feel") == "joy").groupBy("location").agg(F.count("*").alias("count"))
    totals = s.groupBy("location").agg(F.count("*").alias("total"))
    out = J.align_by_location(counts, totals)
    return out.select("location", "count", "total", F.round("percentage", 6).alias("percentage"))


@register("emotion_profile_by_score", _w(f""",
m AS (SELECT score, [{", ".join(f"avg({e})" for e in EMO)}] AS d FROM scored GROUP BY score),
s AS (SELECT score, list_transform(range(7), lambda i: (d[((i + 6) % 7) + 1] + d[i + 1] + d[((i + 1) % 7) + 1]) / 3.0) AS sm FROM m)
SELECT score, {", ".join(f"round(sm[{i + 1}] / list_max(sm), 6) AS {e}" for i, e in enumerate(EMO))} FROM s"""))
def q_emotion_profile_by_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean label scores per score class, 3-point circular smoothing, / max."""
    out = A.emotion_profile_by_score(scored_sentences(spark, sf), "score", EMO)
    return out.select("score", *_r6(EMO))


def _summary_sql(where: str) -> str:
    return _w(f""",
sad AS (SELECT location, doc_id, sentence_idx, review AS sentence FROM scored
        WHERE max_feel = 'sadness' {where} AND trim(review) <> ''),
tk AS (SELECT location, doc_id, sentence_idx, unnest({S.tokens(S.clean('sentence'))}) AS term FROM sad),
cnt AS (SELECT location, term, count(*) AS tf FROM tk GROUP BY location, term),
nd AS (SELECT count(DISTINCT location) AS n_docs FROM scored WHERE max_feel = 'sadness' {where}),
dfq AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
w0 AS (SELECT c.location, c.term, c.tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w
       FROM cnt c JOIN dfq USING (term) CROSS JOIN nd),
tf AS (SELECT location, term, w / sqrt(sum(w * w) OVER (PARTITION BY location)) AS tfidf FROM w0),
per AS (SELECT tk.location, doc_id, sentence_idx, avg(tfidf) AS score FROM tk JOIN tf USING (location, term)
        GROUP BY tk.location, doc_id, sentence_idx),
rk AS (SELECT s.location, trim(s.sentence) AS sentence, p.score,
              row_number() OVER (PARTITION BY s.location ORDER BY round(p.score, 9) DESC, s.sentence, s.doc_id,
                                 s.sentence_idx) AS rank
       FROM sad s JOIN per p ON s.location = p.location AND s.doc_id = p.doc_id AND s.sentence_idx = p.sentence_idx)
SELECT location, CAST(rank AS INTEGER) AS rank, sentence, round(score, 6) AS score FROM rk WHERE rank <= 3""")


@register("summarise_complaints", _summary_sql(""))
def q_summarise_complaints(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, the 3 sadness sentences with the highest mean tf-idf."""
    sad = scored_sentences(spark, sf).where(F.col("max_feel") == "sadness")
    # the scored subset feeds three branches of the summary: score it once
    sad = cut_lineage(sad.select("location", "doc_id", F.col("sentence_idx").alias("sid"), "review"))
    # sentences are the texts: splitting them again keeps each one whole
    return SC.summarise_complaints(sad, ["location"], "review", 3, ["doc_id", "sid"], cut_lineage).select(
        "location", "rank", "sentence", "score")


@register("complaints_by_entity", _summary_sql("AND location = 'src1'"))
def q_complaints_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    """The summary for one source."""
    s = scored_sentences(spark, sf).select("location", "doc_id", F.col("sentence_idx").alias("sid"), "review", "max_feel")
    s = cut_lineage(s.where((F.col("max_feel") == "sadness") & (F.col("location") == "src1")))
    return SC.complaints_by_entity(s, "location", "src1", "review", n=3, id_col=["doc_id", "sid"]).select(
        "location", "rank", "sentence", "score")


@register("chunk_words", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT doc_id, words, unnest(range(0, len(words), 750)) AS s FROM w)
SELECT doc_id, CAST(s / 750 AS INTEGER) AS chunk_idx, array_to_string(words[s + 1:s + 750], ' ') AS chunk
FROM c""")
def q_chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    """750-word chunks of every document."""
    out = R.chunk_words(C.table(spark, sf, "documents"), "text", 750, keep=["doc_id"])
    return out.select("doc_id", "chunk_idx", "chunk")
