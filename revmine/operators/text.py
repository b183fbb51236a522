"""Text-mining operators: corpus, word counts, stop words, tf-idf, top terms.

Data model: a corpus is *flat* -- one row per review with the document keys
(e.g. ``entity`` and optionally ``polarity``), a ``weight`` and the text.  The
original glued all reviews of an entity into one string; we never do: counts
are additive, so ``sum(weight)`` over per-review tokens gives the same
document-term counts without moving whole documents through one task.

Document-term data stays long and sparse: ``(doc keys..., term, tf)``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.operators.tagger import HmmTagger


def _list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------------------
# Stop words
# ---------------------------------------------------------------------------

@functools.lru_cache(maxsize=None)
def spark_stop_list(language: str = "english") -> tuple[str, ...]:
    """A stop word list of Spark (``StopWordsRemover`` resources), kept as package
    data so that neither a session nor Spark's jars are needed to read it."""
    lines = resources.files("revmine.data").joinpath(f"stopwords_{language}.txt").read_text("utf-8").splitlines()
    return tuple(line for line in lines if line and not line.startswith("#"))


def _spark_english_list() -> tuple[str, ...]:
    return spark_stop_list("english")


def english_stop_words() -> list[str]:
    """Spark's built-in English stop word list (``StopWordsRemover``'s default), the base list."""
    return list(_spark_english_list())


def fixed_stop_words(base: Sequence[str] | None = None, extra: Sequence[str] = ()) -> list[str]:
    """Base list (default: Spark's English list) + pour forms + place words + extra.

    Multi-word entries ("united states") are kept as they are: like in the
    original they never equal a single token, so they remove nothing.
    """
    base = english_stop_words() if base is None else list(base)
    out, seen = [], set()
    for w in [*base, *L.POUR_WORDS, *L.PLACE_WORDS, *extra]:
        if w not in seen:
            seen.add(w)
            out.append(w)
    return out


def stop_word_union(spark: SparkSession, *lists: Sequence[str] | DataFrame, term: str = "term") -> DataFrame:
    """Union of stop lists (Python lists or one-column DataFrames), distinct."""
    frames = []
    for item in lists:
        if isinstance(item, DataFrame):
            frames.append(item.select(F.col(item.columns[0]).alias(term)))
        else:
            frames.append(spark.createDataFrame([(w,) for w in item], f"{term} string"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _stop_frame(spark: SparkSession, words: Sequence[str], term: str) -> DataFrame:
    # Bounded by the size of a typed word list: safe to broadcast.
    return F.broadcast(spark.createDataFrame([(w,) for w in sorted(set(words))], f"{term} string"))


# ---------------------------------------------------------------------------
# Corpus construction
# ---------------------------------------------------------------------------

def check_split_arguments(quantile_split, emotion_split, experts) -> None:
    """the split modes are exclusive; experts only with the quantile split."""
    if quantile_split and emotion_split:
        raise ValueError("quantile_split and emotion_split exclude each other")
    if emotion_split and experts is not None:
        raise ValueError("a weight for experts has no meaning with emotion_split")


def expert_weight_column(expert_flag: Column, expert_weight: int = 2) -> Column:
    """Expert reviews count ``expert_weight`` times (sum of weights, no copies)."""
    return F.when(F.coalesce(expert_flag, F.lit(False)), F.lit(expert_weight)).otherwise(F.lit(1))


def build_corpus(reviews: DataFrame, entity: str, text: str, *, expert: str | None = None,
                 expert_weight: int = 2, label: str | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Flat weighted corpus ``(entity, [label], weight, text, keep...)``.

    ``expert`` names a boolean column (True = expert review, weighted
    ``expert_weight`` times).  ``label`` names a polarity column produced by
    :func:`quantile_split` / :func:`emotion_split`; rows with a NULL label
    belong to neither side.  Null entities are dropped (pandas groupby does).
    """
    w = expert_weight_column(F.col(expert), expert_weight) if expert else F.lit(1)
    cols = [F.col(entity)] + ([F.col(label)] if label else []) + [w.alias("weight"), F.col(text).alias("text")]
    cols += [F.col(k) for k in keep]
    out = reviews.where(F.col(entity).isNotNull())
    if label:
        out = out.where(F.col(label).isNotNull())
    return out.select(*cols)


def corpus(reviews: DataFrame, entity: str = "beer_name", text: str = "text", *,
           experts: DataFrame | None = None, user: str = "user_id", expert_weight: int = 2,
           quantile_split: float | None = None, emotion_split: bool = False, rating: str = "rating",
           feel: str = "max_feel") -> DataFrame:
    """T2 entry point with the original's options: plain, quantile split (the
    per-entity ``quantile_split``-th percentile of ``rating``) or emotion
    split (``feel`` of scored sentences); ``experts`` (a DataFrame of user
    ids) weigh ``expert_weight``.  Returns the flat corpus
    ``(entity, [polarity], weight, text)``.
    """
    from revmine.operators.window import emotion_split as _emotion_split
    from revmine.operators.window import quantile_split as _quantile_split

    check_split_arguments(quantile_split, emotion_split, experts)
    df = reviews
    expert_col = None
    if experts is not None:
        flags = experts.select(F.col(experts.columns[0]).alias(user)).distinct().withColumn("_expert", F.lit(True))
        df = df.join(flags, user, "left")
        expert_col = "_expert"
    label = None
    if quantile_split:
        df, label = _quantile_split(df, entity, rating, float(quantile_split)), "polarity"
    elif emotion_split:
        df, label = _emotion_split(df, feel), "polarity"
    return build_corpus(df, entity, text, expert=expert_col, expert_weight=expert_weight, label=label)


def replicate_experts(reviews: DataFrame, expert: str, weight: int = 2) -> DataFrame:
    """U1 literal form: each expert review appears ``weight`` times (for checks;
    prefer the ``weight`` column of :func:`build_corpus`)."""
    reps = F.when(F.col(expert), F.sequence(F.lit(1), F.lit(weight))).otherwise(F.array(F.lit(1)))
    return reviews.withColumn("_copy", F.explode(reps)).drop("_copy")


# ---------------------------------------------------------------------------
# Tokens and counts
# ---------------------------------------------------------------------------

def review_tokens(df: DataFrame, text: str = "text", *, pattern: str = L.THREE_LETTERS,
                  tokenizer: Callable[[Column], Column] | None = None, clean: bool = True,
                  accent_method: str = "arrow") -> Column:
    """Token array of one review: T1 -> lowercase -> X3 -> pattern."""
    c = F.col(text)
    if clean:
        c = X.strip_accents_ascii(F.lower(X.normalise_text(c)), method=accent_method)
    return tokenizer(c) if tokenizer is not None else X.tokenise(c, pattern)


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", *,
                ngram_range: tuple[int, int] = (1, 1), **kw) -> DataFrame:
    """Adds the token array (and its n-grams) as a column.  The tokens are
    materialised first so the n-gram lambdas only see a plain column (the
    Arrow accent strip cannot run inside a higher-order function)."""
    out_df = df.withColumn(out, review_tokens(df, text, **kw))
    lo, hi = ngram_range
    if (lo, hi) != (1, 1):
        out_df = out_df.withColumn(out, X.ngrams(F.col(out), lo, hi))
    return out_df


def word_counts(corpus: DataFrame, keys: Sequence[str], text: str = "text", weight: str | None = "weight", *,
                pattern: str = L.THREE_LETTERS, tokenizer: Callable[[Column], Column] | None = None,
                ngram_range: tuple[int, int] = (1, 1), stop: Sequence[str] | None = None,
                lemma: Callable[[Column], Column] | None = None, clean: bool = True,
                accent_method: str = "arrow", term: str = "term",
                vocabulary: Sequence[str] | DataFrame | None = None, documents: bool = False) -> DataFrame:
    """Long document-term counts ``(keys..., term, tf)``.

    ``vocabulary`` (a word list or a one-column DataFrame) keeps only those
    terms (a semi-join; the list form is broadcast, being bounded).
    ``documents`` adds a row with a null term for each document, also for one
    left without tokens, so that no second pass over the corpus lists them.

    Tokens are exploded per review and summed per (document, term) with a
    map-side partial aggregation, so only distinct terms per task reach the
    shuffle.  Stop words are removed *after* that aggregation, on the much
    smaller table, with a broadcast anti-join (the list is bounded).
    """
    keys = _list(keys)
    w = F.col(weight) if weight else F.lit(1)
    grams = tuple(ngram_range) != (1, 1)
    tok = with_tokens(corpus.select(*[F.col(k) for k in keys], w.alias("_w"), F.col(text).alias("_text")),
                      "_text", "_tok", pattern=pattern, tokenizer=tokenizer, clean=clean, accent_method=accent_method)
    if grams:
        # like the vectorizer: lemmas and stop-word removal act on the token
        # list, and n-grams are built from what remains
        if lemma is not None:
            tok = tok.withColumn("_tok", F.transform("_tok", lemma))
        if stop:
            # literals only, so the list becomes a hash set; lemmas of it are folded to literals
            listed = [lemma(F.lit(x)) if lemma is not None else F.lit(x) for x in sorted(set(stop))]
            tok = tok.withColumn("_tok", F.filter("_tok", lambda t: ~t.isin(*listed)))
        tok = tok.withColumn("_tok", X.ngrams(F.col("_tok"), *ngram_range))
    # explode_outer + a filter on the generated term: plain explode makes the
    # optimizer infer size(tokens) > 0 below the projection, which would run
    # the Arrow accent strip twice.
    if documents:
        none = F.array(F.lit(None).cast("string"))
        exploded = tok.select(*[F.col(k) for k in keys], "_w", F.explode_outer(F.coalesce(F.concat("_tok", none), none)).alias(term))
    else:
        exploded = (tok.select(*[F.col(k) for k in keys], "_w", F.explode_outer("_tok").alias(term))
                    .where(F.col(term).isNotNull()))
    if lemma is not None and not grams:
        exploded = exploded.withColumn(term, lemma(F.col(term)))
    counts = exploded.groupBy(*keys, term).agg(F.sum("_w").cast("bigint").alias("tf"))
    if stop and not grams:
        stop_df = _stop_frame(corpus.sparkSession, stop, term)
        if lemma is not None:  # stop words are compared as lemmas too (the list is lemmatised)
            stop_df = F.broadcast(stop_df.select(lemma(F.col(term)).alias(term)).distinct())
        counts = counts.join(stop_df, term, "left_anti")
    if vocabulary is not None:
        vocab = (vocabulary.select(F.col(vocabulary.columns[0]).alias(term)).distinct()
                 if isinstance(vocabulary, DataFrame) else _stop_frame(corpus.sparkSession, vocabulary, term))
        kept = counts.join(vocab, term, "left_semi")
        counts = kept.unionByName(counts.where(F.col(term).isNull())) if documents else kept
    return counts


def doc_term_long(matrix: DataFrame, keys: Sequence[str], term: str = "term", tf: str = "tf") -> DataFrame:
    """P5: a wide document-term matrix (one column per term) as ``(keys..., term, tf)``, zeros left out."""
    keys = _list(keys)
    wide = [c for c in matrix.columns if c not in keys]
    return matrix.unpivot(keys, wide, term, tf).where(F.col(tf) != 0)


# ---------------------------------------------------------------------------
# Document frequency, frequent-term stop words
# ---------------------------------------------------------------------------

def count_docs(docs: DataFrame, doc_keys: Sequence[str], group_keys: Sequence[str] = ()) -> DataFrame:
    """Number of documents per group ``(group_keys..., n_docs)``."""
    doc_keys, group_keys = _list(doc_keys), _list(group_keys)
    only = [k for k in doc_keys if k not in group_keys]
    return docs.select(*group_keys, *only).distinct().groupBy(*group_keys).agg(F.count("*").alias("n_docs"))


def _attach_n_docs(df: DataFrame, n_docs: DataFrame, group_keys: list[str]) -> DataFrame:
    if group_keys:
        return df.join(n_docs, group_keys, "inner")
    # one global number: a scalar subquery, no cross join and no driver round trip
    return df.withColumn("n_docs", n_docs.select("n_docs").scalar())


def document_frequency(counts: DataFrame, doc_keys: Sequence[str], term: str = "term",
                       group_keys: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame:
    """M6: ``(group..., term, df, n_docs, doc_freq = df / n_docs)``.

    ``docs`` lists every document (also those left without tokens); the
    original counts them in N.  Defaults to the documents present in counts.
    """
    doc_keys, group_keys = _list(doc_keys), _list(group_keys)
    dfreq = counts.where(F.col("tf") > 0).groupBy(*group_keys, term).agg(F.count("*").alias("df"))
    n = count_docs(docs if docs is not None else counts, doc_keys, group_keys)
    out = _attach_n_docs(dfreq, n, group_keys)
    return out.withColumn("doc_freq", F.col("df") / F.col("n_docs"))


def frequent_terms(counts: DataFrame, doc_keys: Sequence[str], max_df: float = 0.9, term: str = "term",
                   group_keys: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame:
    """Terms whose document frequency share is >= ``max_df`` (the data part of T6)."""
    d = document_frequency(counts, doc_keys, term, group_keys, docs)
    return d.where(F.col("doc_freq") >= F.lit(max_df)).select(*_list(group_keys), term)


def stop_words(counts: DataFrame, doc_keys: Sequence[str], max_df: float = 0.9, *, term: str = "term",
               base: Sequence[str] | None = None, extra: Sequence[str] = (),
               docs: DataFrame | None = None, lemma: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fixed list (English + pour forms + place words + extra) U frequent terms.

    ``counts`` must be computed *without* stop word removal.  With ``lemma``
    (the tokens are lemmatised) the fixed list is lemmatised too, as the
    original ran its tokenizer over the joined stop list.
    """
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(w,) for w in fixed_stop_words(base, extra)], f"{term} string")
    if lemma is not None:
        words = fixed.select(F.explode(F.split(F.col(term), " ")).alias(term))
        fixed = words.select(lemma(F.col(term)).alias(term))
    freq = frequent_terms(counts, doc_keys, max_df, term, docs=docs)
    return fixed.unionByName(freq).distinct()


# ---------------------------------------------------------------------------
# tf-idf (M1 / T10)
# ---------------------------------------------------------------------------

def tfidf_scores(counts: DataFrame, doc_keys: Sequence[str], term: str = "term", tf: str = "tf", *,
                 group_keys: Sequence[str] = (), docs: DataFrame | None = None,
                 max_df: float | None = None, min_df: float | None = None, norm: bool = True,
                 out: str = "tfidf", texts: bool = False) -> DataFrame:
    """M1: smoothed idf ``ln((1+N)/(1+df)) + 1``, ``tf * idf``, L2-normalised per document.

    ``group_keys`` fits one idf per group (e.g. per polarity: the negative and
    the positive corpora are scored separately).  ``max_df`` drops terms whose
    document share reaches it (the frequent-term stop words) in the same pass.
    The per-document norm is a partial aggregate joined back (small table,
    broadcast by AQE when it fits), so the big table is not shuffled by
    document here.  ``texts``: each document is one text, so there are about as
    many norms as texts; a document's rows are then shuffled together once and
    get their norm there, without a second pass over all rows.
    """
    doc_keys, group_keys = _list(doc_keys), _list(group_keys)
    d = document_frequency(counts, doc_keys, term, group_keys, docs)
    if max_df is not None:
        d = d.where(F.col("doc_freq") < F.lit(max_df))
    if min_df is not None:  # an int is a document count, a float a share (like the vectorizer)
        d = d.where((F.col("df") >= F.lit(min_df)) if isinstance(min_df, int) else (F.col("doc_freq") >= F.lit(min_df)))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    scored = counts.join(d.select(*group_keys, term, idf.alias("idf")), [*group_keys, term], "inner")
    scored = scored.withColumn(out, F.col(tf) * F.col("idf"))
    if not norm:
        return scored
    if texts:
        for k in doc_keys:  # null keys find no norm in the join below
            scored = scored.where(F.col(k).isNotNull())
        size = F.sqrt(F.sum(F.col(out) * F.col(out)).over(Window.partitionBy(*doc_keys)))  # the distinct terms of one text
        return scored.withColumn("_norm", size).withColumn(out, F.when(F.col("_norm") > 0, F.col(out) / F.col("_norm")).otherwise(F.lit(0.0))).drop("_norm")
    norms = scored.groupBy(*doc_keys).agg(F.sqrt(F.sum(F.col(out) * F.col(out))).alias("_norm"))
    return (scored.join(norms, doc_keys, "inner")
            .withColumn(out, F.when(F.col("_norm") > 0, F.col(out) / F.col("_norm")).otherwise(F.lit(0.0)))
            .drop("_norm"))


# ---------------------------------------------------------------------------
# Top terms
# ---------------------------------------------------------------------------

def rank_order(score: str, term: str = "term") -> list[Column]:
    """Deterministic ranking: score (rounded to 9 decimals) desc, then term asc."""
    return [F.round(F.col(score), 9).desc(), F.col(term).asc()]


def top_terms_per_entity(scores: DataFrame, keys: Sequence[str], score: str = "tfidf", k: int = 10,
                         term: str = "term", rank: str = "rank") -> DataFrame:
    """The ``k`` best terms per key.  ``row_number <= k`` lets the planner
    add a partial WindowGroupLimit before the shuffle, so at most k rows per
    key and task are moved."""
    w = Window.partitionBy(*_list(keys)).orderBy(*rank_order(score, term))
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def pivot_ranks(ranked: DataFrame, keys: Sequence[str], k: int, value: str = "term", rank: str = "rank",
                prefix: str = "attr_") -> DataFrame:
    """P2 core: rank -> columns ``prefix1..prefixk`` (always k columns)."""
    keys = _list(keys)
    return (ranked.groupBy(*keys).pivot(rank, list(range(1, k + 1)))
            .agg(F.first(value))
            .select(*keys, *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(1, k + 1)]))


def pivot_top_attributes(ranked: DataFrame, by: str | Sequence[str], k: int, prefix: str = "top_attr_",
                         value: str = "attribute", rank: str = "rank") -> DataFrame:
    """The ranked attributes of each group as ``k`` columns, NULL where a group has fewer."""
    return pivot_ranks(ranked.where(F.col(rank) <= k), _list(by), k, value, rank, prefix)


def top_attributes(scores: DataFrame, keys: Sequence[str], k: int = 10, prefix: str = "attr_",
                   score: str = "tfidf", term: str = "term") -> DataFrame:
    """Wide ``keys, attr_1..attr_k``; the whole vocabulary is ranked."""
    return pivot_ranks(top_terms_per_entity(scores, keys, score, k, term), keys, k, term, "rank", prefix)


def melt_attributes(df: DataFrame, by: str | Sequence[str], prefixes: str | Sequence[str] = "attr_",
                    k: int = 10, value: str = "attribute") -> DataFrame:
    """Wide ``prefix1..prefixk`` columns (several prefixes allowed) -> long, nulls dropped."""
    by = _list(by)
    cols = [f"{p}{i + 1}" for p in _list(prefixes) for i in range(k)]
    long = df.unpivot(by, cols, "attribute_type", value)
    return long.where(F.col(value).isNotNull())


def attribute_counts(long: DataFrame, by: str | Sequence[str], value: str = "attribute") -> DataFrame:
    """Size by (group, attribute); null groups dropped like pandas groupby."""
    by = _list(by)
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).isNotNull()
    return long.where(cond).groupBy(*by, value).agg(F.count("*").alias("count"))


def top_attributes_by(df: DataFrame, by: str, top_count: int = 5, column_count: int = 10,
                      prefix: str | Sequence[str] = "attr_", long: str | None = None) -> DataFrame:
    """Most frequent attributes per group -> ``by, top_<prefixes>1..top_count``.

    P1 -> A26 -> W2 -> P2.  ``long`` names the attribute column of a table that
    has a row for each attribute already (:func:`top_terms_per_entity`), which
    needs no P1.  Ties in counts break by attribute ascending.  A
    group with fewer than ``top_count`` attributes gets NULLs (the original
    raised).
    """
    rows = melt_attributes(df, by, prefix, column_count) if long is None else df.withColumnRenamed(long, "attribute").where("attribute is not null")
    counts = attribute_counts(rows, by)
    ranked = top_k_per_group(counts, by, "count", top_count, "attribute")
    return pivot_ranks(ranked, [by], top_count, "attribute", "rank", "top_" + "".join(_list(prefix)))


def top_k_per_group(df: DataFrame, by: str | Sequence[str], order: str, k: int, tie: str,
                    rank: str = "rank") -> DataFrame:
    """Sort by ``order`` desc (ties by ``tie`` asc), number 1.., keep k."""
    w = Window.partitionBy(*_list(by)).orderBy(F.col(order).desc(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# ---------------------------------------------------------------------------
# Criticisms: negative minus positive
# ---------------------------------------------------------------------------

def align_pos_neg(scores: DataFrame, keys: Sequence[str], label: str = "polarity", score: str = "tfidf",
                  term: str = "term", negative: str = "negative", positive: str = "positive") -> DataFrame:
    """``(keys..., term, negative, positive)`` with 0 for a side lacking the term.

    A conditional aggregation on (keys, term) is the full outer join of the two
    sides without a second shuffle.
    """
    keys = _list(keys)
    return (scores.groupBy(*keys, term)
            .agg(F.coalesce(F.sum(F.when(F.col(label) == negative, F.col(score))), F.lit(0.0)).alias(negative),
                 F.coalesce(F.sum(F.when(F.col(label) == positive, F.col(score))), F.lit(0.0)).alias(positive)))


def entities_missing_a_side(corpus: DataFrame, entity: str, label: str = "polarity",
                            negative: str = "negative", positive: str = "positive") -> DataFrame:
    """Report (instead of the original assert) of entities lacking one side."""
    sides = corpus.groupBy(entity).agg(
        F.max(F.when(F.col(label) == negative, 1).otherwise(0)).alias("has_negative"),
        F.max(F.when(F.col(label) == positive, 1).otherwise(0)).alias("has_positive"))
    return sides.where((F.col("has_negative") == 0) | (F.col("has_positive") == 0))


def relative_frequency(counts: DataFrame, doc_keys: Sequence[str], tf: str = "tf", out: str = "tfidf") -> DataFrame:
    """Relative term frequency per document (tf-idf switched off)."""
    doc_keys = _list(doc_keys)
    tot = counts.groupBy(*doc_keys).agg(F.sum(tf).alias("_tot"))
    return counts.join(tot, doc_keys).withColumn(out, F.col(tf) / F.col("_tot")).drop("_tot")


def top_negative_words(counts: DataFrame, doc_keys: Sequence[str], *, label: str = "polarity",
                       term: str = "term", use_tfidf: bool = True, k: int | None = 10,
                       rank_keys: Sequence[str] = (), idf_keys: Sequence[str] | None = None,
                       docs: DataFrame | None = None, max_df: float | None = None, texts: bool = False) -> DataFrame:
    """``score_diff = negative - positive`` per term, best first.

    ``counts`` holds both sides; ``doc_keys`` identify a document and include
    ``label``.  Each side is scored separately: one idf per ``idf_keys``
    (default ``[label]``).  A side's term score is the sum of its documents'
    scores within ``rank_keys`` (one document per entity: that document's
    score; documents = reviews of an entity: the summed tf-idf).  The sides
    are aligned (J9, 0 for a missing side) and ranked within ``rank_keys``
    (empty: one global ranking).  ``use_tfidf=False`` scores by relative
    frequency instead.  ``texts`` as in :func:`tfidf_scores`.
    """
    doc_keys, rank_keys = _list(doc_keys), _list(rank_keys)
    idf_keys = _list(idf_keys) if idf_keys is not None else [label]
    if use_tfidf:
        scored = tfidf_scores(counts, doc_keys, term, group_keys=idf_keys, docs=docs, max_df=max_df, texts=texts)
    else:
        scored = relative_frequency(counts, doc_keys)
    aligned = align_pos_neg(scored, rank_keys, label, "tfidf", term)
    out = aligned.withColumn("score_diff", F.col("negative") - F.col("positive"))
    if k is None:
        return out
    if rank_keys:
        return top_terms_per_entity(out, rank_keys, "score_diff", k, term)
    ranked = out.orderBy(*rank_order("score_diff", term)).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order("score_diff", term))))


def criticisms_per_entity(counts: DataFrame, entity: str, *, label: str = "polarity", k: int = 10,
                          term: str = "term", docs: DataFrame | None = None,
                          max_df: float | None = None) -> DataFrame:
    """T14 for every entity at once (one document per entity and side, one
    plan keyed by entity, no loop)."""
    return top_negative_words(counts, [entity, label], label=label, term=term, k=k,
                              rank_keys=[entity], docs=docs, max_df=max_df)


# ---------------------------------------------------------------------------
# Word-cloud side
# ---------------------------------------------------------------------------

def tfidf_sum_over_docs(df: DataFrame, doc: str, text: str, ngram_range: tuple[int, int] = (1, 2),
                        tokens: str | None = None) -> DataFrame:
    """documents = reviews; score = sum over documents of L2 tf-idf, per term ("TF").

    ``tokens`` may name a precomputed token array (e.g. from :func:`clean_tokens`);
    otherwise runs of two or more word characters (Unicode) of the lowercased text are used.
    """
    arr = F.col(tokens) if tokens else X.tokenise(F.lower(F.col(text)), L.TWO_LETTERS_NUMBERS_UNI)
    grams = X.ngrams(arr, *ngram_range)
    counts = (df.select(F.col(doc), F.explode(grams).alias("term"))
              .groupBy(doc, "term").agg(F.count("*").alias("tf")))
    scored = tfidf_scores(counts, [doc], "term", docs=df.select(doc))
    return scored.groupBy("term").agg(F.sum("tfidf").alias("TF"))


def clean_tokens(df: DataFrame, text: str, out: str = "tokens", *, stop: Sequence[str] | None = None,
                 pos_table: DataFrame | None = None, lemma: Callable[[Column], Column] | None = None,
                 id_col: str | None = None, tagger: HmmTagger | None = None) -> DataFrame:
    """Word-cloud tokens: sentences, punctuation off (but '), lowercase,
    stop words except not/no/never, verb lemma, alphabetic only.

    Nouns, adjectives, adverbs and verbs are kept by a ``tagger`` (of
    :func:`revmine.operators.tagger.fit_tagger`), which sees each sentence whole,
    stop words included; verbs become their lemma.  Instead, a
    ``pos_table (term, pos)`` can be given (NN/JJ/RB/VB kept).  It is applied
    as a semi-join of the exploded tokens on the distinct kept vocabulary and
    the arrays are rebuilt per text ``id_col`` (one review's tokens), so no
    text travels through a shuffle.  Without either every token is kept.
    """
    stop = [w for w in (stop if stop is not None else english_stop_words()) if w not in L.KEPT_NEGATIONS]
    sentences = X.split_sentences_regexp(F.col(text))
    if tagger is not None:
        spoken = F.transform(sentences, lambda s: F.filter(F.split(F.trim(X.remove_punctuation(F.lower(s))), r"\s+"), lambda w: w != ""))
        pairs = F.flatten(F.zip_with(spoken, tagger.tags(spoken), lambda w, t: F.zip_with(w, t, lambda a, b: F.struct(a.alias("w"), b.alias("t")))))
        kept = F.filter(pairs, lambda p: p["t"].isin("NN", "JJ", "RB", "VB") & ~p["w"].isin(sorted(set(stop))) & p["w"].rlike(r"^\p{L}+$"))
        return df.withColumn(out, F.transform(kept, lambda p: F.when(p["t"] == "VB", lemma_by_class(p["w"], p["t"])).otherwise(p["w"])))
    words = F.flatten(F.transform(sentences, lambda s: F.split(F.trim(X.remove_punctuation(s)), r"\s+")))
    words = F.transform(words, lambda w: F.lower(w))
    words = F.filter(words, lambda w: (w != "") & ~w.isin(sorted(set(stop))))
    if lemma is not None:
        words = F.transform(words, lemma)
    words = F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))
    out_df = df.withColumn(out, words)
    if pos_table is None:
        return out_df
    if id_col is None:
        raise ValueError("pos_table needs id_col (a unique text id) to rebuild the token arrays")
    keep = pos_table.where(F.col("pos").rlike("^(NN|JJ|RB|VB)")).select(F.col("term").alias("_t")).distinct()
    exploded = out_df.select(id_col, F.posexplode(out).alias("_i", "_t"))
    kept = (exploded.join(keep, "_t", "left_semi").groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_s"))
            .select(id_col, F.transform("_s", lambda s: s["_t"]).alias("_kept")))
    return (out_df.join(kept, id_col, "left")
            .withColumn(out, F.coalesce(F.col("_kept"), F.array().cast("array<string>"))).drop("_kept"))


def term_frequencies(df: DataFrame, tokens: str = "tokens", term: str = "term") -> DataFrame:
    """Unigram counts over all texts, most frequent first (ties by term)."""
    return (df.select(F.explode(tokens).alias(term)).groupBy(term).agg(F.count("*").alias("count")))


# ---------------------------------------------------------------------------
# Lemmas (T7)
# ---------------------------------------------------------------------------

# Regular English plural endings (noun rules), most specific first.
NOUN_SUFFIX_RULES = [("sses", "ss"), ("ies", "y"), ("ches", "ch"), ("shes", "sh"),
                     ("xes", "x"), ("zes", "z"), ("men", "man"), ("ses", "s"), ("s", "")]


def lemma_rules(col: Column, min_len: int = 4) -> Column:
    """Suffix-rule lemma for words missing from a lemma table (nouns only).

    Words ending in "ss"/"us"/"is" and words shorter than ``min_len`` stay.
    """
    out = None
    for suf, rep in NOUN_SUFFIX_RULES:
        cond = col.endswith(suf) & (F.length(col) >= F.lit(max(min_len, len(suf) + 2)))
        if suf == "s":
            cond = cond & ~col.endswith("ss") & ~col.endswith("us") & ~col.endswith("is")
        val = F.concat(F.substr(col, F.lit(1), F.length(col) - len(suf)), F.lit(rep))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(col)


# Verb and adjective endings; a doubled consonant before them is halved.
VERB_SUFFIX_RULES = [("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("s", "")]
ADJECTIVE_SUFFIX_RULES = [("iest", "y"), ("ier", "y"), ("est", ""), ("er", "")]


def lemma_by_class(col: Column, pos: Column, min_stem: int = 3) -> Column:
    """Lemma by word class (``NN``, ``VB``, ``JJ`` ... as in a tag's first two letters).

    Irregular forms come from a table; other nouns follow :func:`lemma_rules`,
    verbs and adjectives lose their endings if ``min_stem`` letters are left.
    Words that only look inflected ("beer") need the right class or a lemma table.
    """
    tag = F.substring(pos, 1, 2)

    def listed(cls: str) -> Column:
        table = F.create_map(*[F.lit(x) for kv in L.IRREGULAR_LEMMAS[cls].items() for x in kv])
        return F.element_at(table, col)

    def cut(rules: Sequence[tuple[str, str]], keep: str) -> Column:
        out = None
        for suf, rep in rules:
            stem_ = F.substr(col, F.lit(1), F.length(col) - len(suf))
            double = F.regexp_replace(stem_, r"([bdgmnprt])\1$", "$1") if suf in ("ing", "ed", "est", "er") else stem_
            cond = col.endswith(suf) & (F.length(col) >= min_stem + len(suf) - len(rep)) & ~col.rlike(keep)
            out = F.when(cond, F.concat(double, F.lit(rep))) if out is None else out.when(cond, F.concat(double, F.lit(rep)))
        return out.otherwise(col)

    return (F.when(tag == "VB", F.coalesce(listed("VB"), cut(VERB_SUFFIX_RULES, "(ss|us|is)$")))
            .when(tag == "JJ", F.coalesce(listed("JJ"), cut(ADJECTIVE_SUFFIX_RULES, "eer$")))
            .when(tag == "NN", F.coalesce(listed("NN"), lemma_rules(col))).otherwise(col))


def lemmatise(counts: DataFrame, keys: Sequence[str], term: str = "term", tf: str = "tf",
              lemma_table: DataFrame | None = None) -> DataFrame:
    """Map each *distinct* term to its lemma and re-aggregate.

    ``lemma_table (token, lemma)`` wins where it has the term (joined on the
    distinct vocabulary); the rest use :func:`lemma_rules`.
    """
    keys = _list(keys)
    vocab = counts.select(term).distinct()
    if lemma_table is not None:
        vocab = vocab.join(lemma_table.withColumnRenamed("token", term), term, "left")
        mapped = vocab.select(term, F.coalesce(F.col("lemma"), lemma_rules(F.col(term))).alias("_lemma"))
    else:
        mapped = vocab.select(term, lemma_rules(F.col(term)).alias("_lemma"))
    return (counts.join(mapped, term, "inner").groupBy(*keys, F.col("_lemma").alias(term))
            .agg(F.sum(tf).alias(tf)))


# ---------------------------------------------------------------------------
# Stems (T8)
# ---------------------------------------------------------------------------

def stem(counts: DataFrame, keys: Sequence[str], term: str = "term", tf: str = "tf") -> DataFrame:
    """Porter2 (Snowball English) stem of each *distinct* term, joined back
    and re-aggregated.  The stemmer runs once per vocabulary entry in an Arrow
    UDF; the join back is a plain equi-join that AQE broadcasts while the
    vocabulary is small."""
    from revmine.functions.stem import stem_udf

    keys = _list(keys)
    vocab = counts.select(term).distinct()
    mapped = vocab.select(term, stem_udf(F.col(term)).alias("_stem"))
    return (counts.join(mapped, term, "inner").groupBy(*keys, F.col("_stem").alias(term))
            .agg(F.sum(tf).cast("bigint").alias(tf)))

