"""Column functions and text helpers on whole documents."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.operators import reshape as R
from revmine.operators import text as T
from revmine.operators import topics as TP
from revmine.plans import catalog as C
from revmine.plans import sqlfrag as S
from revmine.plans.registry import register

DOCS = "documents"
PUNCT = "".join(ch for ch in string.punctuation if ch != "'")


@register("normalise_text", f"SELECT doc_id, {S.normalise('text')} AS text FROM documents")
def q_normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    """Apostrophe repair + every word containing "ipa" -> "ipa"."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.normalise_text("text").alias("text"))


@register("strip_accents_ascii", f"SELECT doc_id, {S.clean('text')} AS text FROM documents")
def q_strip_accents_ascii(spark: SparkSession, sf: str) -> DataFrame:
    """Lowercase + NFKD accent strip to ASCII (Arrow UDF)."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.clean_for_tokens("text").alias("text"))


@register("strip_accents_jvm", f"SELECT doc_id, {S.clean('text')} AS text FROM documents")
def q_strip_accents_jvm(spark: SparkSession, sf: str) -> DataFrame:
    """X3 (JVM variant): same result without a Python worker."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.strip_accents_ascii(F.lower(X.normalise_text("text")), method="jvm").alias("text"))


@register("tokenise", f"SELECT doc_id, {S.tokens(S.clean('text'))} AS tokens FROM documents")
def q_tokenise(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of three or more letters after cleaning."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", T.review_tokens(d, "text").alias("tokens"))


@register("split_sentences", "SELECT doc_id, string_split_regex(text, '[;.?!]') AS sentences FROM documents")
def q_split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Split on ; . ? ! keeping empty pieces."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.split_sentences("text").alias("sentences"))


@register("split_sentences_regexp", f"""
SELECT doc_id, regexp_extract_all(text || '.', {S.q(L.SENTENCE_WITH_DELIMS)}) AS sentences FROM documents""")
def q_split_sentences_regexp(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with their delimiter runs (a final '.' appended first)."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.split_sentences_regexp("text").alias("sentences"))


@register("word_count", """
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words
FROM documents""")
def q_word_count(spark: SparkSession, sf: str) -> DataFrame:
    """Whitespace-separated words per document."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.word_count("text").alias("words"))


@register("char_length_guard", "SELECT doc_id, length(text) < 500 AS short FROM documents")
def q_char_length_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Texts short enough for the scorer."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.char_length_guard("text", 500).alias("short"))


@register("remove_punctuation", f"""
SELECT doc_id, translate(text, {S.q(PUNCT)}, {S.q(" " * len(PUNCT))}) AS text FROM documents""")
def q_remove_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    """Every ASCII punctuation mark but the apostrophe becomes a space."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", X.remove_punctuation("text").alias("text"))


def _lda_stop_sql() -> str:
    return S.in_list(T.english_stop_words())


@register("isalpha_min_len", f"""
SELECT doc_id, list_filter(string_split(lower(text), ' '),
                           lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}') AND w NOT IN {_lda_stop_sql()}) AS words
FROM documents""")
def q_isalpha_min_len(spark: SparkSession, sf: str) -> DataFrame:
    """X11: topic-model words: split on spaces, alphabetic, 3+ letters, no stop word."""
    d = C.table(spark, sf, DOCS)
    return d.select("doc_id", TP.lda_tokens(F.col("text")).alias("words"))


@register("ngrams", f"""
WITH t AS (SELECT doc_id, {S.tokens(S.clean('text'))} AS tk FROM documents)
SELECT doc_id, list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS grams
FROM t""")
def q_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Unigrams then bigrams of each document."""
    d = C.table(spark, sf, DOCS)
    return T.with_tokens(d, "text", "grams", ngram_range=(1, 2)).select("doc_id", "grams")


@register("capitalise", "SELECT DISTINCT upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS label FROM events")
def q_capitalise(spark: SparkSession, sf: str) -> DataFrame:
    """Labels capitalised."""
    e = C.table(spark, sf, "events")
    return e.select(X.capitalise("event_type").alias("label")).distinct()


@register("join_terms", """
WITH r AS (SELECT source, term, rank FROM ({top}) z)
SELECT source, string_agg(term, ', ' ORDER BY rank) AS attributes FROM r GROUP BY source""")
def q_join_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A source's top-10 attributes as one comma-separated text."""
    from revmine.plans.text_queries import q_top_terms_per_entity

    top = q_top_terms_per_entity(spark, sf)
    arr = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
    return top.groupBy("source").agg(X.join_terms(arr, ", ").alias("attributes"))


def _location_label_sql() -> str:
    from revmine.plans.relational_queries import ULOC, _state_map_sql

    home = L.HOME_COUNTRY
    return f"""
WITH u AS (SELECT location, avg_overall,
                  CASE WHEN starts_with(location, '{home}') THEN trim(string_split(location, ',')[2]) END AS state
           FROM {ULOC} x WHERE location IS NOT NULL),
s AS (SELECT location, state, {_state_map_sql()}[state] AS state_code, avg(avg_overall) AS a
      FROM u GROUP BY location, state)
SELECT location, concat_ws(chr(10), location, CASE WHEN a IS NOT NULL THEN printf('%.2f', a) END, state, state_code) AS label
FROM s"""


@register("location_label", _location_label_sql())
def q_location_label(spark: SparkSession, sf: str) -> DataFrame:
    """Place, mean rating with two decimals and its non-null details as text."""
    from revmine.operators import clean as CL

    u = CL.state_from_location(C.user_locations(spark, sf), "location")
    per = u.where(F.col("location").isNotNull()).groupBy("location", "state", "state_code").agg(
        F.avg("avg_overall").alias("avg_overall"))
    return per.select("location", X.location_label("location", "avg_overall", ["state", "state_code"], "\n").alias("label"))


# --- word cloud side -----------------------------------------------------------------

def _clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.clean_tokens(C.table(spark, sf, DOCS).select("doc_id", "text"), "text", "tokens")


def _clean_tokens_sql(where: str = "") -> str:
    stop = [w for w in T.english_stop_words() if w not in L.KEPT_NEGATIONS]
    return f"""
WITH s AS (SELECT doc_id, regexp_extract_all(text || '.', {S.q(L.SENTENCE_WITH_DELIMS)}) AS sents
           FROM documents {where}),
w AS (SELECT doc_id, flatten(list_transform(sents, lambda x: string_split_regex(
          trim(translate(x, {S.q(PUNCT)}, {S.q(" " * len(PUNCT))})), '\\s+'))) AS ws FROM s),
t AS (SELECT doc_id, list_filter(list_filter(list_transform(ws, lambda x: lower(x)),
                                             lambda x: x <> '' AND x NOT IN {S.in_list(stop)}),
                                 lambda x: regexp_full_match(x, '\\p{{L}}+')) AS tokens FROM w)"""


@register("clean_tokens", _clean_tokens_sql() + "\nSELECT doc_id, tokens FROM t")
def q_clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Word-cloud tokens (sentences, punctuation off, stop words but not/no/never, alphabetic)."""
    return _clean_tokens(spark, sf).select("doc_id", "tokens")


@register("term_frequencies", _clean_tokens_sql() + """
SELECT term, count(*) AS count FROM (SELECT unnest(tokens) AS term FROM t) x GROUP BY term""")
def q_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram frequencies of the word-cloud tokens."""
    return T.term_frequencies(_clean_tokens(spark, sf), "tokens")


@register("tfidf_sum_over_docs", _clean_tokens_sql("WHERE lang = 'en' AND source = 'src1'") + """,
t13d AS (SELECT doc_id, list_filter(tokens, lambda x: length(x) >= 2) AS tk FROM t),
t13g AS (SELECT doc_id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])))
               AS term FROM t13d),
t13c AS (SELECT doc_id, term, count(*) AS tf FROM t13g GROUP BY doc_id, term),
t13n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM t13d),
t13f AS (SELECT term, count(*) AS df FROM t13c GROUP BY term),
t13w AS (SELECT c.doc_id, c.term, c.tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w
         FROM t13c c JOIN t13f USING (term) CROSS JOIN t13n),
t13s AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM t13w)
SELECT term, round(sum(tfidf), 6) AS TF FROM t13s GROUP BY term""")
def q_tfidf_sum_over_docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents = one source's reviews, tokens = the word-cloud tokens
    (T16; the vectorizer's two-character minimum applied); summed tf-idf per
    uni/bigram ("TF")."""
    d = C.table(spark, sf, DOCS).where((F.col("lang") == "en") & (F.col("source") == "src1")).select("doc_id", "text")
    tok = T.clean_tokens(d, "text", "tk").withColumn("tk", F.filter("tk", lambda x: F.length(x) >= 2))
    out = T.tfidf_sum_over_docs(tok, "doc_id", "text", (1, 2), tokens="tk")
    return out.select("term", F.round("TF", 6).alias("TF"))


# --- lemmas, replication, stop-list union, flat grouping -----------------------------------

def _lemma_sql(v: str) -> str:
    parts = []
    for suf, rep in T.NOUN_SUFFIX_RULES:
        cond = f"suffix({v}, '{suf}') AND length({v}) >= {max(4, len(suf) + 2)}"
        if suf == "s":
            cond += f" AND NOT suffix({v}, 'ss') AND NOT suffix({v}, 'us') AND NOT suffix({v}, 'is')"
        parts.append(f"WHEN {cond} THEN substr({v}, 1, length({v}) - {len(suf)}) || '{rep}'")
    return "CASE " + " ".join(parts) + f" ELSE {v} END"


@register("lemmatise", """
WITH {ctes}
SELECT source, {lemma} AS term, CAST(sum(tf) AS BIGINT) AS tf FROM counts GROUP BY source, {lemma}""")
def q_lemmatise(spark: SparkSession, sf: str) -> DataFrame:
    """Counts re-aggregated on the lemma of each distinct term (suffix rules)."""
    from revmine.plans.text_queries import en_counts

    counts = en_counts(spark, sf)[1]
    return T.lemmatise(counts, ["source"])


def _english_tagger(spark: SparkSession, sf: str):
    from revmine.operators.tagger import fit_tagger

    d = C.table(spark, sf, DOCS).where(F.col("lang") == "en").select("doc_id", "source", "text")
    return d, fit_tagger(d, "text")


@register("lemmatise_in_context")
def q_lemmatise_in_context(spark: SparkSession, sf: str) -> DataFrame:
    """T7 by word class in context: per source the counts of lemmas, classes from a tagger fitted on the English documents."""
    d, tagger = _english_tagger(spark, sf)
    return T.word_counts(d, ["source"], weight=None, tokenizer=tagger.lemmas, clean=False)


@register("clean_tokens_in_context")
def q_clean_tokens_in_context(spark: SparkSession, sf: str) -> DataFrame:
    """T16 by word class in context: nouns, adjectives, adverbs and verbs (as lemmas) of each English document."""
    d, tagger = _english_tagger(spark, sf)
    return T.clean_tokens(d, "text", "tokens", tagger=tagger).select("doc_id", "tokens")


@register("word_classes")
def q_word_classes(spark: SparkSession, sf: str) -> DataFrame:
    """How often the tagger gives each word of the English documents each class."""
    from revmine.operators.tagger import words_of_sentences

    d, tagger = _english_tagger(spark, sf)
    s = d.select(words_of_sentences("text").alias("s")).select("s", tagger.tags("s").alias("t"))
    pairs = s.select(F.explode(F.arrays_zip(F.flatten("s").alias("word"), F.flatten("t").alias("tag"))).alias("p"))
    return pairs.groupBy(F.col("p.word").alias("word"), F.col("p.tag").alias("tag")).agg(F.count("*").alias("n"))


@register("stem")
def q_stem(spark: SparkSession, sf: str) -> DataFrame:
    """Counts re-aggregated on the Porter2 stem of each distinct term."""
    from revmine.plans.text_queries import en_counts

    return T.stem(en_counts(spark, sf)[1], ["source"])


@register("replicate_experts", """
WITH {ctes}
SELECT source, term, tf FROM counts""")
def q_replicate_experts(spark: SparkSession, sf: str) -> DataFrame:
    """U1 (literal copies) gives the A23 weighted counts: expert reviews repeated 5 times."""
    from revmine.plans.text_queries import en_corpus

    corpus = en_corpus(spark, sf)
    rep = T.replicate_experts(corpus.withColumn("expert", F.col("weight") > 1), "expert", C.EXPERT_WEIGHT)
    return T.word_counts(rep, ["source"], weight=None, stop=T.fixed_stop_words())


@register("weighted_term_count", """
WITH {ctes}
SELECT source, term, tf FROM counts""")
def q_weighted_term_count(spark: SparkSession, sf: str) -> DataFrame:
    """Expert weight as a summed weight column (no copies)."""
    from revmine.plans.text_queries import en_counts

    return en_counts(spark, sf)[1]


@register("stop_word_union", """
SELECT term FROM {english} UNION SELECT lower(n_name) AS term FROM nation UNION SELECT lower(r_name) AS term FROM region""")
def q_stop_word_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the English list and the place names of the data."""
    nations = C.table(spark, sf, "nation").select(F.lower("n_name").alias("term"))
    regions = C.table(spark, sf, "region").select(F.lower("r_name").alias("term"))
    return T.stop_word_union(spark, T.english_stop_words(), nations, regions)


@register("collect_by_entity", """
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS position
FROM documents""")
def q_collect_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews grouped per entity, kept flat as positions (no per-entity list)."""
    return R.collect_by_entity(C.table(spark, sf, DOCS), "source", "doc_id")


def _fill_templates() -> None:
    """Some SQL twins reuse the text CTEs; fill them in after import."""
    from revmine.plans import registry
    from revmine.plans.text_queries import _sql_corpus_ctes, q_top_terms_per_entity  # noqa: F401

    ctes = _sql_corpus_ctes().strip()
    top = registry.ORACLES["top_terms_per_entity"]
    for name in ("lemmatise", "replicate_experts", "weighted_term_count"):
        registry.ORACLES[name] = registry.ORACLES[name].replace("{ctes}", ctes).replace(
            "{lemma}", _lemma_sql("term"))
    registry.ORACLES["join_terms"] = registry.ORACLES["join_terms"].replace("{top}", top)
    registry.ORACLES["stop_word_union"] = registry.ORACLES["stop_word_union"].replace(
        "{english}", S.values(T.english_stop_words()))


_fill_templates()
