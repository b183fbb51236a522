"""Positive/negative splits and criticisms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.operators import aggregate as A
from revmine.operators import joins as J
from revmine.operators import scoring as SC
from revmine.operators import text as T
from revmine.operators import window as W
from revmine.plans import catalog as C
from revmine.plans import sqlfrag as S
from revmine.plans.registry import register
from revmine.session import cut_lineage

Q = 10.0
K = 10
MAX_DF = 0.9
IR = f"({C.ITEM_RATINGS_SQL})"
MAKERS = f"({C.MAKERS_SQL})"


def _stop():
    return T.fixed_stop_words()


def split_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """English documents labelled by their source's 10th percentile of length."""
    docs = C.reviews(spark, sf, "en")
    lab = W.quantile_split(docs, "source", "rating", Q)
    return T.build_corpus(lab, "source", "text", expert="expert", expert_weight=C.EXPERT_WEIGHT,
                          label="polarity", keep=["doc_id"])


def _split_ctes(doc_level: bool = False) -> str:
    """SQL twin of split_corpus -> counts -> per-side tf-idf."""
    doc_col = ", doc_id" if doc_level else ""
    doc_keys = "source, polarity, doc_id" if doc_level else "source, polarity"
    idf_keys = "source, polarity" if doc_level else "polarity"
    return f"""
r AS ({C.REVIEWS_SQL}),
thr AS (SELECT source, quantile_cont(rating, {Q / 100}) AS pct FROM r WHERE source IS NOT NULL GROUP BY source),
lab AS (SELECT r.*, thr.pct, CASE WHEN round(rating, 9) <= round(pct, 9) THEN 'negative'
                         WHEN round(rating, 9) > round(pct, 9) THEN 'positive' END AS polarity
        FROM r JOIN thr USING (source)),
docs AS (SELECT source, polarity, doc_id, CASE WHEN expert THEN {C.EXPERT_WEIGHT} ELSE 1 END AS weight,
                {S.clean('text')} AS clean FROM lab WHERE polarity IS NOT NULL),
toks AS (SELECT source, polarity{doc_col}, weight, unnest({S.tokens('clean')}) AS term FROM docs),
counts AS (SELECT {doc_keys}, term, CAST(sum(weight) AS BIGINT) AS tf FROM toks
           WHERE term NOT IN {S.in_list(_stop())} GROUP BY {doc_keys}, term),
ndocs AS (SELECT {idf_keys}, count(*) AS n_docs FROM (SELECT DISTINCT {doc_keys} FROM docs) d GROUP BY {idf_keys}),
dfreq AS (SELECT {idf_keys}, term, count(*) AS df FROM counts GROUP BY {idf_keys}, term),
scored AS (SELECT c.*, c.tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w
           FROM counts c JOIN dfreq USING ({idf_keys}, term) JOIN ndocs USING ({idf_keys})
           WHERE df / n_docs < {MAX_DF}),
tfidf AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY {doc_keys})) AS tfidf FROM scored),
aligned AS (SELECT source, term,
                   COALESCE(sum(CASE WHEN polarity = 'negative' THEN tfidf END), 0.0) AS negative,
                   COALESCE(sum(CASE WHEN polarity = 'positive' THEN tfidf END), 0.0) AS positive
            FROM tfidf GROUP BY source, term),
ranked AS (SELECT source, term, negative, positive, negative - positive AS score_diff,
                  row_number() OVER (PARTITION BY source ORDER BY round(negative - positive, 9) DESC, term) AS rank
           FROM aligned)"""


def counted(corpus: DataFrame, keys: list[str], **kw) -> tuple[DataFrame, DataFrame]:
    """(word counts, documents with and without tokens) of a corpus, which is read once."""
    both = cut_lineage(T.word_counts(corpus, keys, stop=_stop(), documents=True, **kw))
    return both.where(F.col("term").isNotNull()), cut_lineage(both.where(F.col("term").isNull()).select(*keys))


def _crit_out(df: DataFrame) -> DataFrame:
    return df.select("source", "rank", "term", F.round("score_diff", 6).alias("score_diff"),
                     F.round("negative", 6).alias("negative"), F.round("positive", 6).alias("positive"))


CRIT_SELECT = f"""
SELECT source, CAST(rank AS INTEGER) AS rank, term, round(score_diff, 6) AS score_diff,
       round(negative, 6) AS negative, round(positive, 6) AS positive FROM ranked WHERE rank <= {K}"""


@register("quantile_split", f"""
WITH {_split_ctes().strip().split('docs AS')[0].rstrip().rstrip(',')}
SELECT doc_id, source, rating, round(pct, 6) AS percentile, polarity FROM lab""")
def q_quantile_split(spark: SparkSession, sf: str) -> DataFrame:
    """Each English document labelled against its source's 10th percentile."""
    docs = C.reviews(spark, sf, "en").select("doc_id", "source", "rating")
    lab = W.quantile_split(docs, "source", "rating", Q)
    return lab.select("doc_id", "source", "rating", F.round("percentile", 6).alias("percentile"), "polarity")


@register("criticisms_per_entity", "WITH " + _split_ctes().strip() + CRIT_SELECT, bench=True)
def q_criticisms_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, the 10 terms most specific to its negative side."""
    corpus = split_corpus(spark, sf)
    counts, docs = counted(corpus, ["source", "polarity"])
    crit = T.criticisms_per_entity(counts, "source", k=K, docs=docs, max_df=MAX_DF)
    return _crit_out(crit)


@register("top_negative_words", "WITH " + _split_ctes(doc_level=True).strip() + CRIT_SELECT)
def q_top_negative_words(spark: SparkSession, sf: str) -> DataFrame:
    """T14 (notebook mode): documents = reviews of one source, each side fitted
    separately per source; summed tf-idf negative minus positive, top 10."""
    corpus = split_corpus(spark, sf)
    counts, docs = counted(corpus, ["source", "polarity", "doc_id"])
    crit = T.top_negative_words(counts, ["source", "polarity", "doc_id"], k=K, rank_keys=["source"],
                                idf_keys=["source", "polarity"], docs=docs, max_df=MAX_DF, texts=True)
    return _crit_out(crit)


@register("entities_missing_a_side", f"""
WITH {_split_ctes().strip().split('docs AS')[0].rstrip().rstrip(',')}
SELECT source, max(CASE WHEN polarity = 'negative' THEN 1 ELSE 0 END) AS has_negative,
       max(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END) AS has_positive
FROM lab WHERE polarity IS NOT NULL GROUP BY source
HAVING max(CASE WHEN polarity = 'negative' THEN 1 ELSE 0 END) = 0
    OR max(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END) = 0""")
def q_entities_missing_a_side(spark: SparkSession, sf: str) -> DataFrame:
    """J9 report: sources whose reviews fall on one side only (the original asserted)."""
    return T.entities_missing_a_side(split_corpus(spark, sf), "source")


def _freq_sql() -> str:
    ctes = _split_ctes().strip()
    head = ctes[: ctes.index("ndocs AS")].rstrip().rstrip(",")
    return "WITH " + head + f""",
rel AS (SELECT source, polarity, term, tf / sum(tf) OVER (PARTITION BY source, polarity) AS f FROM counts),
aligned AS (SELECT source, term, COALESCE(sum(CASE WHEN polarity = 'negative' THEN f END), 0.0) AS negative,
                   COALESCE(sum(CASE WHEN polarity = 'positive' THEN f END), 0.0) AS positive
            FROM rel GROUP BY source, term),
ranked AS (SELECT source, term, negative, positive, negative - positive AS score_diff,
                  row_number() OVER (PARTITION BY source ORDER BY round(negative - positive, 9) DESC, term) AS rank
           FROM aligned)""" + CRIT_SELECT


@register("top_negative_words_frequency", _freq_sql())
def q_top_negative_words_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """T14 with ``use_tfidf=False``: relative term frequency per side instead of tf-idf."""
    corpus = split_corpus(spark, sf)
    counts = cut_lineage(T.word_counts(corpus, ["source", "polarity"], stop=_stop()))
    crit = T.top_negative_words(counts, ["source", "polarity"], use_tfidf=False, k=K, rank_keys=["source"])
    return _crit_out(crit)


def _bigram_sql() -> str:
    ctes = _split_ctes().strip()
    # tokens -> stop words out -> uni+bigrams, then the same per-side tf-idf
    ctes = ctes.replace(
        "toks AS (SELECT source, polarity, weight, unnest(" + S.tokens("clean") + ") AS term FROM docs),",
        "tk AS (SELECT source, polarity, weight, list_filter(" + S.tokens("clean") + ", lambda x: x NOT IN "
        + S.in_list(_stop()) + ") AS t FROM docs),\n"
        "toks AS (SELECT source, polarity, weight, unnest(list_concat(t, list_transform(range(1, len(t)), "
        "lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk),")
    ctes = ctes.replace("WHERE term NOT IN " + S.in_list(_stop()) + " GROUP BY", "GROUP BY")
    return "WITH " + ctes + CRIT_SELECT


@register("top_negative_words_bigrams", _bigram_sql())
def q_top_negative_words_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """T14 with ``ngrams=(1, 2)``: stop words leave the token list, then uni- and
    bigrams are scored per side (one document per source and side)."""
    corpus = split_corpus(spark, sf)
    counts, docs = counted(corpus, ["source", "polarity"], ngram_range=(1, 2))
    crit = T.criticisms_per_entity(counts, "source", k=K, docs=docs, max_df=MAX_DF)
    return _crit_out(crit)


def _lemma_crit_sql() -> str:
    from revmine.plans.function_queries import _lemma_sql

    ctes = _split_ctes().strip()
    ctes = ctes.replace(
        "toks AS (SELECT source, polarity, weight, unnest(" + S.tokens("clean") + ") AS term FROM docs),",
        "toks0 AS (SELECT source, polarity, weight, unnest(" + S.tokens("clean") + ") AS w FROM docs),\n"
        "toks AS (SELECT source, polarity, weight, " + _lemma_sql("w") + " AS term FROM toks0),\n"
        "stopl AS (SELECT DISTINCT " + _lemma_sql("term") + " AS term FROM " + S.values(_stop()) + " sv),")
    ctes = ctes.replace("WHERE term NOT IN " + S.in_list(_stop()) + " GROUP BY",
                        "WHERE term NOT IN (SELECT term FROM stopl) GROUP BY")
    return "WITH " + ctes + CRIT_SELECT


@register("top_negative_words_lemmatised", _lemma_crit_sql())
def q_top_negative_words_lemmatised(spark: SparkSession, sf: str) -> DataFrame:
    """T14 with ``lemmatize=True``: tokens and the stop list mapped to lemmas
    (suffix rules), then the per-side tf-idf difference."""
    corpus = split_corpus(spark, sf)
    counts, docs = counted(corpus, ["source", "polarity"], lemma=T.lemma_rules)
    crit = T.criticisms_per_entity(counts, "source", k=K, docs=docs, max_df=MAX_DF)
    return _crit_out(crit)


@register("align_pos_neg", "WITH " + _split_ctes().strip() + """
SELECT source, term, round(negative, 6) AS negative, round(positive, 6) AS positive FROM aligned""")
def q_align_pos_neg(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides' tf-idf per (source, term), 0 where a side lacks the term."""
    corpus = split_corpus(spark, sf)
    counts, docs = counted(corpus, ["source", "polarity"])
    scored = T.tfidf_scores(counts, ["source", "polarity"], group_keys=["polarity"], docs=docs, max_df=MAX_DF)
    al = T.align_pos_neg(scored, ["source"])
    return al.select("source", "term", F.round("negative", 6).alias("negative"), F.round("positive", 6).alias("positive"))


# --- global threshold split over item ratings (T4, A24, J4) ------------------------

def _global_split_sql(body: str) -> str:
    return f"""
WITH r AS {IR},
t AS (SELECT quantile_cont(rating, {Q / 100}) AS thr FROM r),
lab AS (SELECT r.*, CASE WHEN round(rating, 9) <= round(thr, 9) THEN 'negative'
                         WHEN round(rating, 9) > round(thr, 9) THEN 'positive' END AS polarity FROM r CROSS JOIN t),
cnt AS (SELECT user_id, count(*) AS total, count(CASE WHEN polarity = 'negative' THEN 1 END) AS bad FROM lab
        WHERE user_id IS NOT NULL GROUP BY user_id)
{body}"""


@register("global_threshold_split", _global_split_sql("""
SELECT review_id, line, user_id, rating, polarity FROM lab
WHERE user_id IN (SELECT user_id FROM lab GROUP BY user_id
                  HAVING count(CASE WHEN polarity = 'negative' THEN 1 END) > 10 AND count(CASE WHEN polarity = 'positive' THEN 1 END) > 10)"""))
def q_global_threshold_split(spark: SparkSession, sf: str) -> DataFrame:
    """T4: one global 10th percentile; users with more than 10 ratings on each side."""
    ir = C.item_ratings(spark, sf).select("review_id", "line", "user_id", "rating")
    return W.global_threshold_split(ir, "user_id", "rating", Q, 10)


@register("neg_pos_review_counts", _global_split_sql("""
SELECT user_id, total, bad FROM cnt WHERE bad > 10 AND total - bad > 10"""))
def q_neg_pos_review_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per user total and negative ratings, both sides above 10."""
    ir = C.item_ratings(spark, sf)
    thr = A.percentile_scalar(ir, "rating", Q)
    lab = W.pos_neg_partition(ir.withColumn("_t", thr), "rating", "_t")
    return A.neg_pos_review_counts(lab, "user_id", min_each=10)


@register("join_neg_counts", _global_split_sql(f"""
SELECT m.id, m.location, c.total, c.bad FROM {MAKERS} m JOIN cnt c ON m.id = c.user_id
WHERE c.bad > 10 AND c.total - c.bad > 10"""))
def q_join_neg_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Maker dimension joined with its (total, bad) counts (inner)."""
    ir = C.item_ratings(spark, sf)
    thr = A.percentile_scalar(ir, "rating", Q)
    lab = W.pos_neg_partition(ir.withColumn("_t", thr), "rating", "_t")
    counts = A.neg_pos_review_counts(lab, "user_id", min_each=10).withColumnRenamed("user_id", "id")
    return J.join_neg_counts(C.makers(spark, sf).select("id", "location"), counts, "id")


# --- top attributes by group (T12, P1, A26, W2, P2) ---------------------------------

def _lang_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.reviews(spark, sf, lang=None)
    corpus = T.build_corpus(docs.withColumn("doc", F.concat_ws("/", "lang", "source")), "doc", "text",
                            expert="expert", expert_weight=C.EXPERT_WEIGHT, keep=["lang"])
    counts, both = counted(corpus, ["doc", "lang"])
    return T.tfidf_scores(counts, ["doc", "lang"], docs=both, max_df=MAX_DF)


def lang_top_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """attr_1..attr_10 per (lang, source) over all four languages."""
    return T.top_attributes(_lang_scores(spark, sf), ["doc", "lang"], K)


def _lang_attr_ctes() -> str:
    all_reviews = C.REVIEWS_SQL.replace("WHERE d.lang = 'en'", "")
    return f"""
r AS ({all_reviews}),
docs AS (SELECT lang || '/' || source AS doc, lang, CASE WHEN expert THEN {C.EXPERT_WEIGHT} ELSE 1 END AS weight,
                {S.clean('text')} AS clean FROM r WHERE lang || '/' || source IS NOT NULL),
toks AS (SELECT doc, lang, weight, unnest({S.tokens('clean')}) AS term FROM docs),
counts AS (SELECT doc, lang, term, CAST(sum(weight) AS BIGINT) AS tf FROM toks
           WHERE term NOT IN {S.in_list(_stop())} GROUP BY doc, lang, term),
ndocs AS (SELECT count(*) AS n_docs FROM (SELECT DISTINCT doc, lang FROM docs) d),
dfreq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scored AS (SELECT c.doc, c.lang, c.term, c.tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w
           FROM counts c JOIN dfreq USING (term) CROSS JOIN ndocs WHERE df / n_docs < {MAX_DF}),
tfidf AS (SELECT doc, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc, lang)) AS tfidf FROM scored),
rk AS (SELECT doc, lang, term, row_number() OVER (PARTITION BY doc, lang ORDER BY round(tfidf, 9) DESC, term) AS rank
       FROM tfidf),
attrs AS (SELECT doc, lang, rank AS arank, term AS attribute FROM rk WHERE rank <= {K}),
acount AS (SELECT lang, attribute, count(*) AS count FROM attrs WHERE lang IS NOT NULL GROUP BY lang, attribute),
top AS (SELECT lang, attribute, count,
               row_number() OVER (PARTITION BY lang ORDER BY count DESC, attribute) AS rank FROM acount)"""


TOP_BY = 5


@register("top_attributes_by", "WITH " + _lang_attr_ctes().strip() + f"""
SELECT lang, {", ".join(f"max(CASE WHEN rank = {i} THEN attribute END) AS top_attr_{i}" for i in range(1, TOP_BY + 1))}
FROM top WHERE rank <= {TOP_BY} GROUP BY lang""")
def q_top_attributes_by(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 attributes most often among the sources' top 10, per language."""
    top = T.top_terms_per_entity(_lang_scores(spark, sf), ["doc", "lang"], "tfidf", K)  # long already: no pivot and back
    return T.top_attributes_by(top, "lang", TOP_BY, K, "attr_", long="term")


@register("melt_attributes", "WITH " + _lang_attr_ctes().strip() + """
SELECT doc, lang, 'attr_' || CAST(arank AS VARCHAR) AS attribute_type, attribute FROM attrs""")
def q_melt_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Wide attr_i columns back to long rows (NULLs dropped)."""
    return T.melt_attributes(lang_top_attributes(spark, sf), ["doc", "lang"], "attr_", K)


@register("attribute_counts", "WITH " + _lang_attr_ctes().strip() + """
SELECT lang, attribute, count FROM acount""")
def q_attribute_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each attribute is among the top 10, per language."""
    return T.attribute_counts(T.melt_attributes(lang_top_attributes(spark, sf), ["doc", "lang"], "attr_", K), "lang")


@register("top_k_per_group", "WITH " + _lang_attr_ctes().strip() + f"""
SELECT lang, attribute, count, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= {TOP_BY}""")
def q_top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked attribute counts, first 5 per language."""
    counts = T.attribute_counts(T.melt_attributes(lang_top_attributes(spark, sf), ["doc", "lang"], "attr_", K), "lang")
    return T.top_k_per_group(counts, "lang", "count", TOP_BY, "attribute")


# --- categories of criticisms (T21 lexicon variant, A25) -----------------------------

CAT_RULE_SQL = ("CASE WHEN ascii(term) - 97 BETWEEN 0 AND 25 THEN "
                "['appearance', 'aroma', 'palate', 'taste'][CAST(floor((ascii(term) - 97) * 4 / 26) AS INTEGER) + 1] END")


def _crit_categories(spark: SparkSession, sf: str) -> DataFrame:
    corpus = split_corpus(spark, sf)
    counts, docs = counted(corpus, ["source", "polarity"])
    crit = T.criticisms_per_entity(counts, "source", k=K, docs=docs, max_df=MAX_DF)
    return SC.classify_attributes(crit, "source", "term", rule=SC.initial_letter_rule(L.CATEGORIES),
                                  categories=L.CATEGORIES)


def _cat_lists_sql() -> str:
    lists = ", ".join(
        f"COALESCE(list(term ORDER BY rank) FILTER (WHERE cat = '{c}'), []) AS {c}" for c in L.CATEGORIES)
    return "WITH " + _split_ctes().strip() + f""",
crit AS (SELECT source, rank, term, {CAT_RULE_SQL} AS cat FROM ranked WHERE rank <= {K}),
lists AS (SELECT source, {lists} FROM crit GROUP BY source)"""


@register("classify_attributes", _cat_lists_sql() + "\nSELECT source, appearance, aroma, palate, taste FROM lists")
def q_classify_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """T21 (lexicon/rule variant): each source's criticisms in four category lists."""
    return _crit_categories(spark, sf).select("source", *L.CATEGORIES)


@register("category_share", _cat_lists_sql() + """
SELECT source, """ + ", ".join(
    f"CASE WHEN tot > 0 THEN round(len({c}) * 100.0 / tot, 6) END AS {c.capitalize()}" for c in L.CATEGORIES) + f"""
FROM (SELECT *, {" + ".join(f"len({c})" for c in L.CATEGORIES)} AS tot FROM lists) x""")
def q_category_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each category among a source's criticisms (empty -> NULL)."""
    sh = A.category_share(_crit_categories(spark, sf), L.CATEGORIES)
    return sh.select("source", *[F.round(c.capitalize(), 6).alias(c.capitalize()) for c in L.CATEGORIES])
