"""Scoring operators (T18-T24): emotions, polarity, attribute classes, summaries.

The study scored texts with hosted transformer models.  Here the scorer is
pluggable and the default is a lexicon: a bounded ``term -> label`` map
applied inside one projection (no shuffle, no Python), or any
``Column -> Column`` rule.  A real model can be plugged in as a
``mapInPandas`` function through :func:`score_with_model`.  Scores are *not*
the study's numbers; only the operator contract is the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.operators import text as T
from revmine.operators.reshape import explode_sentences
from revmine.session import cut_lineage

LabelRule = Callable[[Column], Column]
WORD_PATTERN = r"\p{L}+"
WORD_START = r"(?<!\p{L})"
WORD_END = r"(?!\p{L})"
#: an alternative that matches one or more letters alone: letters, ranges of them and ``\p{L}``; or one that never matches
_OF_LETTERS = re.compile(r"\(\?!\)|(?:[^\W\d_]|\[[a-z]-[a-z]\])(?:[^\W\d_]|\[[a-z]-[a-z]\]|\\p\{L\}\*?)*")


class RegexLexicon(dict):
    """``label -> regex of one whole word`` (lowercase).  Scoring with it runs
    one JVM regex count per label and no lambda per word, so it stays in
    generated code; it gives the same counts as the equivalent word rule."""

    def __call__(self, t: Column) -> Column:
        return self.rule()(t)

    def rule(self) -> LabelRule:
        pats = list(self.items())

        def r(t: Column) -> Column:
            out = None
            for lab, p in pats:
                cond = t.rlike("^(?:" + p + ")$")
                out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
            return out

        return r


def lexicon_rule(lexicon: Mapping[str, Sequence[str]] = L.EMOTION_LEXICON) -> RegexLexicon:
    """``term -> label`` from a bounded word list (first label wins for a word
    listed twice), as one alternation per label."""
    seen: set[str] = set()
    out = RegexLexicon()
    for label, words in lexicon.items():
        mine = [w for w in words if w not in seen]
        seen.update(mine)
        if mine:
            out[label] = "|".join(re.escape(w) for w in sorted(mine, key=lambda w: (-len(w), w)))
    return out


def _letter_ranges(n: int) -> list[str]:
    groups: list[list[str]] = [[] for _ in range(n)]
    for code in range(26):
        groups[(code * n) // 26].append(chr(ord("a") + code))
    return [f"[{g[0]}-{g[-1]}]" if g else "(?!)" for g in groups]


def initial_letter_rule(labels: Sequence[str] = L.EMOTIONS) -> RegexLexicon:
    """Deterministic test lexicon over any vocabulary: label by the word's first
    letter (ASCII a-z), the alphabet cut into ``len(labels)`` equal ranges.
    Used on the invented prose of the test tables, where no real cue word occurs."""
    return RegexLexicon({lab: rng + r"\p{L}*" for lab, rng in zip(labels, _letter_ranges(len(labels)))})


def label_hits(text: Column, rule: LabelRule) -> Column:
    """Labels of the matched words of a text (unmatched words dropped)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)
    return F.filter(F.transform(words, rule), lambda x: x.isNotNull())


def spaced_words(text: Column) -> Column:
    """The lowercase words of a text between single spaces, one before the first and one behind the last."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))


def label_counts(words: Column, text: Column, lex: RegexLexicon) -> list[Column]:
    """Per label, the number of words matching it (one regex each).

    Patterns that only letters match are looked for behind the spaces of
    ``words`` (of :func:`spaced_words`), so that other characters are passed
    over without a look back; other patterns in ``text``.
    """
    low = F.lower(text)
    return [F.regexp_count(words, F.lit(" (?:" + p + ")(?= )")) if all(_OF_LETTERS.fullmatch(x) for x in p.split("|"))
            else F.regexp_count(low, F.lit(WORD_START + "(?:" + p + ")" + WORD_END)) for p in lex.values()]


def _held(df: DataFrame, *cols: Column) -> DataFrame:
    """``df`` and columns computed once a row by a one-row ``inline``: a later filter on them reads them and does not write them out again."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def _scored(df: DataFrame, text: str, rule: LabelRule, labels: Sequence[str], max_chars: int | None,
            prefix: str = "") -> DataFrame:
    """Adds one score column per label.

    The per-label word counts are produced by a one-row ``inline`` (a Generate
    node): the optimizer cannot push a later filter on the scores below it,
    so the counting runs once per text instead of being inlined into every
    predicate and projection that uses a score.  With a
    :class:`RegexLexicon` each count is one regex in generated code; any other
    rule splits the words once and labels them with a lambda.
    """
    labels = list(labels)
    source = df
    if isinstance(rule, RegexLexicon):
        lex = {lab: rule[lab] for lab in labels if lab in rule}
        source = _held(df, spaced_words(F.col(text)).alias("_words"))
        counts = dict(zip(lex, label_counts(F.col("_words"), F.col(text), RegexLexicon(lex))))
    else:
        hits = label_hits(F.col(text), rule)
        counts = {lab: F.size(F.filter(hits, lambda x, lab=lab: x == lab)) for lab in labels}
    fields = [counts.get(lab, F.lit(0)).alias(f"_n_{lab}") for lab in labels]
    fields.append(F.length(F.col(text)).alias("_len"))
    cnt = _held(source, *fields)
    n = sum((F.col(f"_n_{lab}") for lab in labels), F.lit(0))
    ok = (n > 0) if max_chars is None else ((n > 0) & (F.col("_len") < max_chars))
    cols = [F.when(ok, F.col(f"_n_{lab}") / n).otherwise(F.lit(0.0)).alias(prefix + lab) for lab in labels]
    return cnt.select(*df.columns, *cols)


# T18
def score_emotions(df: DataFrame, text: str, rule: LabelRule | None = None, max_chars: int | None = None,
                   labels: Sequence[str] = L.EMOTIONS, feel: str = "max_feel") -> DataFrame:
    """Seven label scores per text and ``max_feel`` = leftmost arg-max (all zero
    -> "anger").  ``max_chars`` gives texts of that length or more score 0, for
    scorers with an input limit (the study's model had 500; a lexicon has none)."""
    rule = rule or lexicon_rule()
    scored = _scored(df, text, rule, labels, max_chars)
    return _held(scored, X.label_argmax(list(labels)).alias(feel)).select(*[c for c in scored.columns if c != feel], feel)


# T19
POLARITY_LABELS = ["negative", "neutral", "positive"]


def polarity_rule_from_emotions(lexicon: Mapping[str, Sequence[str]] = L.EMOTION_LEXICON) -> LabelRule:
    side = {"anger": "negative", "disgust": "negative", "fear": "negative", "sadness": "negative",
            "joy": "positive", "surprise": "neutral", "neutral": "neutral"}
    return lexicon_rule({s: [w for e, ws in lexicon.items() if side[e] == s for w in ws] for s in POLARITY_LABELS})


def score_polarity(df: DataFrame, text: str, score: str = "score", rule: LabelRule | None = None,
                   max_chars: int | None = None, bands: Sequence[int] = L.NEGATIVE_SCORES,
                   out: str = "polarity") -> DataFrame:
    """Rows with score in {0,1,2} only; polarity = the negative score when
    "negative" is the arg-max label, else 0; ``max_chars`` as in T18."""
    rule = rule or polarity_rule_from_emotions()
    sub = df.where(F.col(score).isin(list(bands)))
    scored = _scored(sub, text, rule, POLARITY_LABELS, max_chars, prefix="_")
    top = X.label_argmax([f"_{lab}" for lab in POLARITY_LABELS], POLARITY_LABELS)
    return (scored.withColumn(out, F.when(top == "negative", F.col("_negative")).otherwise(F.lit(0.0)))
            .drop(*[f"_{lab}" for lab in POLARITY_LABELS]))


def score_with_model(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                     schema: str) -> DataFrame:
    """Plug a model in: ``fn`` gets Arrow batches of rows (load the model once
    per Python worker inside it) and yields the input columns + scores."""
    return df.mapInPandas(fn, schema)


# T20
def score_sentences(df: DataFrame, text: str, keep: Sequence[str], score: str = "score",
                    bands: Sequence[int] = L.POSITIVE_SCORES, rule: LabelRule | None = None) -> DataFrame:
    """F9 (scores 4-5) -> P4 sentences -> T18."""
    sub = df.where(F.col(score).isin(list(bands)))
    sents = explode_sentences(sub, text, keep, out="review")
    return score_emotions(sents, "review", rule)


# T21
def category_centroids(vectors: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Mean vector per category (element-wise, via position explode + average)."""
    long = vectors.select(label, F.posexplode(vec).alias("_pos", "_v"))
    per = long.groupBy(label, "_pos").agg(F.avg("_v").alias("_m"))
    return (per.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_s"))
            .select(F.col(label).alias("category"), F.transform("_s", lambda s: s["_m"]).alias("centroid")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def classify_vectors(df: DataFrame, centroids: DataFrame, key: str, vec: str = "embedding", min_score: float = 0.5,
                     temperature: float = 0.05, block: int = 1024) -> DataFrame:
    """T21 (re-aimed): softmax over cosine similarity to category centroids.

    ``(key, category, score, kept)``: ``category`` = arg-max (first category
    name on ties), ``score`` its probability, ``kept`` when score >
    ``min_score``.  Categories are taken in blocks of about ``block``, a few
    thousand numbers each: a row meets one after the other and keeps the best
    category and the softmax sum so far, without a shuffle.  Without categories,
    or for a vector of length 0, category and score are NULL.
    """
    n_blocks = max(1, -(-centroids.count() // block))
    cat = F.col("category").cast("string")
    dealt = centroids.select(cat.alias("category"), F.transform("centroid", lambda x: x.cast("double")).alias("centroid"),
                             F.pmod(F.xxhash64(cat), F.lit(n_blocks)).alias("_b"))
    out = df.select(key, F.transform(F.col(vec), lambda x: x.cast("double")).alias("_v")).select(
        "*", F.sqrt(_dot(F.col("_v"), F.col("_v"))).alias("_vn"), F.lit(None).cast("double").alias("_top"),
        F.lit(None).cast("string").alias("_best"), F.lit(0.0).alias("_den"))
    for b in range(n_blocks):
        one = dealt.where(F.col("_b") == b).agg(F.array_sort(F.collect_list(F.struct("category", "centroid"))))  # about ``block`` rows
        out = out.withColumn("_c", one.scalar())
        out = out.withColumn("_z", F.filter(F.transform("_c", lambda c: F.struct(
            (F.try_divide(_dot(F.col("_v"), c["centroid"]), F.col("_vn") * F.sqrt(F.aggregate(c["centroid"], F.lit(0.0), lambda a, t: a + t * t))) / temperature).alias("z"),
            c["category"].alias("category"))), lambda s: s["z"].isNotNull()))
        high = F.array_max(F.transform("_z", lambda s: s["z"]))
        here = out.withColumn("_high", high).withColumn("_new", F.greatest("_top", "_high"))
        first = F.array_min(F.transform(F.filter("_z", lambda s: s["z"] == F.col("_high")), lambda s: s["category"]))
        grown = F.col("_den") * F.coalesce(F.exp(F.col("_top") - F.col("_new")), F.lit(1.0)) + F.aggregate("_z", F.lit(0.0), lambda a, s: a + F.exp(s["z"] - F.col("_new")))
        best = (F.when(F.col("_high").isNull(), F.col("_best")).when(F.col("_top").isNull() | (F.col("_high") > F.col("_top")), first)
                .when(F.col("_high") == F.col("_top"), F.least(F.col("_best"), first)).otherwise(F.col("_best")))
        out = here.select(key, "_v", "_vn", F.col("_new").alias("_top"), best.alias("_best"), grown.alias("_den"))
        if b % 8 == 7:  # a plan of many blocks is cut
            out = cut_lineage(out)
    score = F.when(F.col("_top").isNotNull(), F.try_divide(F.lit(1.0), F.col("_den")))
    return out.select(key, F.col("_best").alias("category"), score.alias("score")).withColumn("kept", F.col("score") > min_score)


def classify_attributes(df: DataFrame, by: str, term: str = "attribute",
                        lexicon: Mapping[str, Sequence[str]] = L.CATEGORY_LEXICON,
                        rule: LabelRule | None = None, categories: Sequence[str] | None = None,
                        scores: DataFrame | None = None, min_score: float = 0.5) -> DataFrame:
    """Attribute -> category, one list per category and group, in attribute
    rank order (``rank`` column if present, else the attribute).

    With ``scores`` ``(term, category, score)``, from any scorer (such as
    :func:`classify_vectors` over term vectors), an attribute takes its best
    category (first name on ties) if that scores above ``min_score``.  Else it
    takes the category whose cue words (or ``rule``) it matches.  Other
    attributes are dropped; groups keep empty lists for categories without
    attributes.  A group's attributes are few: its best ranked ones.
    """
    rule = rule or lexicon_rule(lexicon)
    cats = list(categories or lexicon)
    order = "rank" if "rank" in df.columns else term
    if scores is not None:
        best = scores.groupBy(F.col(term).alias("_t")).agg(F.max("score").alias("_s"), F.min_by("category", F.struct(-F.col("score"), "category")).alias("category"))
        lab = df.join(best.where(F.col("_s") > min_score).select("_t", "category"), F.col(term) == F.col("_t"), "left")
    else:
        lab = df.withColumn("category", rule(F.col(term)))
    return lab.groupBy(by).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct(order, term)))),
                    lambda s: s[term]).alias(c) for c in cats])


# T22
def summarise_complaints(df: DataFrame, by: Sequence[str], text: str, n: int = 3,
                         id_col: str | Sequence[str] = "review_id", materialise=None) -> DataFrame:
    """Extractive summary (re-aimed from an abstractive model): sentences ranked
    by the mean tf-idf (document = group) of their words; best ``n`` per group.

    ``id_col`` (one or more columns) identifies a text; a sentence is
    ``(id..., sentence_idx)``.  ``materialise`` (e.g.
    :func:`revmine.session.cut_lineage`) is applied to the token table,
    which two branches of the plan read.  Output ``(by..., rank, sentence, score)``; ties
    by sentence text, then id.
    """
    by = list(by)
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    key = [*by, *ids, "sentence_idx"]
    sents = explode_sentences(df, text, [*by, *ids], out="sentence").where(F.trim("sentence") != "")
    toks = (T.with_tokens(sents, "sentence", "_tok").select(*key, F.explode_outer("_tok").alias("term"))
            .where(F.col("term").isNotNull()))
    # one row per sentence and term: a common word of a large group is one row for each sentence, not each use
    toks = toks.groupBy(*key, "term").agg(F.count("*").alias("_n"))
    if materialise is not None:  # tokens feed two branches: compute them once
        toks = materialise(toks)
    counts = toks.groupBy(*by, "term").agg(F.sum("_n").alias("tf"))
    scores = T.tfidf_scores(counts, by, docs=df.select(*by))
    per = (toks.join(scores.select(*by, "term", "tfidf"), [*by, "term"], "inner")
           .groupBy(*key).agg((F.sum(F.col("tfidf") * F.col("_n")) / F.sum("_n")).alias("score")))
    # scores alone are ranked; texts join the few sentences (and their ties) that are left
    first = per.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.round("score", 9).desc()))).where(F.col("_r") <= n).drop("_r")
    ranked = sents.join(first, key, "inner")
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), F.col("sentence").asc(),
                                        *[F.col(c).asc() for c in ids], F.col("sentence_idx").asc())
    return (ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(*by, "rank", F.trim("sentence").alias("sentence"), F.round("score", 6).alias("score")))


@dataclass(frozen=True)
class SentenceGraph:
    """The sentences of each group and the terms that link them.

    ``nodes``: (by..., s, _i, _rows), a sentence's key as a struct, its number
    and the rows with that key.  ``links``: (i, t, idf, size, n), a sentence's
    number, a term's, the term's weight, the terms of the sentence and the rows
    alike.  Two sentences have a link of the weight: sum of ``idf`` over the
    terms of both, by the logarithms of both sizes.
    """

    nodes: DataFrame
    links: DataFrame

    def spread(self, values: DataFrame) -> DataFrame:
        """``(i, total)``: per sentence the sum of weight times value over all sentences, itself among them.

        ``values``: (i, v).  A weight depends on the sentences' terms and sizes
        alone, so values are summed for each term and size; a term then has a
        sum for each size that meets it, and a sentence adds up those of its
        terms.  Exact, in as many rows as links, however many share a term.
        """
        sums = self.links.join(values, "i").groupBy("t", "idf", "size").agg(F.sum(F.col("n") * F.col("v")).alias("x"))
        sums = sums.groupBy("t", "idf").agg(F.collect_list(F.struct("size", F.log(1.0 + F.col("size")).alias("l"), "x")).alias("c"))  # a row for each size
        met = sums.select("t", F.inline(F.transform("c", lambda a: F.struct(a["size"].alias("size"), (F.col("idf") * F.aggregate(
            "c", F.lit(0.0), lambda acc, b: acc + b["x"] / (a["l"] + b["l"]))).alias("y")))))
        return self.links.join(met, ["t", "size"]).groupBy("i").agg(F.sum(F.col("n") * F.col("y")).alias("total"))

    def own(self) -> DataFrame:
        """``(i, own)``: a sentence's weight with itself, which :meth:`spread` counts and a link never has."""
        c = F.collect_list(F.struct("n", F.log(1.0 + F.col("size")).alias("l")))  # one, unless a key has rows of other sizes
        both = F.aggregate("c", F.lit(0.0), lambda acc, a: acc + F.aggregate("c", F.lit(0.0), lambda s, b: s + a["n"] * b["n"] / (a["l"] + b["l"])))
        return self.links.groupBy("i", "t", "idf").agg(c.alias("c")).groupBy("i").agg(F.sum(F.col("idf") * both).alias("own"))


def sentence_graph(sents: DataFrame, by: Sequence[str], key: Sequence[str], terms: str = "terms", max_shared: int | None = None) -> SentenceGraph:
    """The graph of the sentences of a group that share a term.

    ``terms``: a sentence's distinct terms.  A term links all sentences of a
    group that hold it and adds ln(sentences of the group / those with the
    term); one that all of them hold adds nothing.  Pairs are not written out,
    as they grow with the square of a term's sentences.  Only with
    ``max_shared`` do terms of more sentences than that link none.
    """
    by = list(by)
    keyed = sents.select(*by, F.struct(*key).alias("s"), F.col(terms).alias("_terms"))
    nodes = cut_lineage(keyed.groupBy(*by, "s").agg(F.count("*").alias("_rows")).withColumn("_i", F.monotonically_increasing_id()))
    rows = keyed.join(nodes.select(*by, "s", "_i"), [*by, "s"]).select(*by, "_i", F.size("_terms").alias("size"), F.explode("_terms").alias("_t"))
    sizes = sents.groupBy(*by).agg(F.count("*").alias("_n"))
    shared = rows.groupBy(*by, "_t").agg(F.count("*").alias("_df"), (F.min("_i") < F.max("_i")).alias("_two")).where("_two")
    if max_shared is not None:
        shared = shared.where(F.col("_df") <= max_shared)
    shared = shared.join(sizes, by).where(F.col("_df") < F.col("_n")).select(*by, "_t", F.log(F.col("_n") / F.col("_df")).alias("idf"))
    shared = cut_lineage(shared.withColumn("_no", F.monotonically_increasing_id()))
    return SentenceGraph(nodes, cut_lineage(rows.join(shared, [*by, "_t"]).groupBy(F.col("_i").alias("i"), F.col("_no").alias("t"), "idf", "size").agg(F.count("*").alias("n"))))


def central_sentences(sents: DataFrame, by: Sequence[str], key: Sequence[str], terms: str = "terms", *, max_shared: int | None = None,
                      damping: float = 0.85, tolerance: float = 1e-4, max_rounds: int = 30) -> DataFrame:
    """``(by..., s, score)``: how central each sentence is in its group's graph; 1 is the mean of a connected group.

    Damped power iteration over :func:`sentence_graph`, all groups at once; each
    round is stored, the last is the first in which no score moves by ``tolerance``.
    """
    by = list(by)
    graph = sentence_graph(sents, by, key, terms, max_shared)
    strength = graph.spread(graph.links.select("i").distinct().withColumn("v", F.lit(1.0))).join(graph.own(), "i")
    # p: what a sentence of score 1 gives for each unit of weight; null without links
    nodes = graph.nodes.select(F.col("_i").alias("i"), "_rows")
    now = cut_lineage(nodes.join(strength, "i", "left").select("i", F.lit(1.0).alias("score"), "own", (F.col("_rows") / (F.col("total") - F.col("own"))).alias("p")))
    for _ in range(max_rounds):
        come = graph.spread(now.where(F.col("p").isNotNull()).select("i", (F.col("score") * F.col("p")).alias("v")))
        come_in = F.col("total") - F.col("own") * F.col("score") * F.col("p")
        new = cut_lineage(now.join(come, "i", "left").select("i", F.col("score").alias("_old"), "own", "p",
                                                             (1.0 - damping + damping * F.coalesce(come_in, F.lit(0.0))).alias("score")))
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("_old")))).first()[0]
        now = new.drop("_old")
        if moved is None or moved < tolerance:
            break
    scored = graph.nodes.join(now.select(F.col("i").alias("_i"), "score"), "_i")
    return scored.select(*by, "s", "score", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))).alias("_copy")).drop("_copy")


def summarise_by_graph(df: DataFrame, by: Sequence[str], text: str, n: int = 3, id_col: str | Sequence[str] = "review_id", *,
                       most_shared: float = 0.5, **graph) -> DataFrame:
    """Extractive summary without repeats: ``(by..., rank, sentence, score)``, at most n sentences a group.

    Sentences are scored by :func:`central_sentences` and taken greedily: the
    next one has the largest score times one less its greatest overlap (shared
    terms by the smaller set) with those taken; one that overlaps a taken one by
    more than ``most_shared`` is never taken.  Ties by sentence text, then id.
    Every sentence stays a candidate; sentences without a term are left out.
    """
    by = list(by)
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    key = [*ids, "sentence_idx"]
    sents = explode_sentences(df, text, [*by, *ids], out="sentence")
    sents = T.with_tokens(sents, "sentence", "_tok").withColumn("terms", F.array_distinct("_tok")).where(F.size("terms") > 0)
    sents = cut_lineage(sents.select(*by, *key, "sentence", "terms"))
    scores = central_sentences(sents, by, key, **graph)
    rest = sents.withColumn("s", F.struct(*key)).join(scores, [*by, "s"]).select(*by, *key, "sentence", "terms", "score", F.lit(0.0).alias("_over"))
    rest = cut_lineage(rest)
    taken = []
    for k in range(1, n + 1):
        worth = F.round(F.col("score") * (1.0 - F.col("_over")), 9)
        order = F.struct(-worth, F.col("sentence"), *[F.col(c) for c in key])
        best = cut_lineage(rest.where(F.col("_over") <= most_shared).groupBy(*by).agg(F.min_by(F.struct("sentence", "terms", "score", *key), order).alias("_best")))  # a row a group
        taken.append(best.select(*by, F.lit(k).alias("rank"), F.trim("_best.sentence").alias("sentence"), F.round("_best.score", 6).alias("score")))
        if k < n:
            shared = F.size(F.array_intersect("terms", "_best.terms")) / F.least(F.size("terms"), F.size("_best.terms"))
            rest = cut_lineage(rest.join(best, by).withColumn("_over", F.greatest("_over", shared)).drop("_best"))
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


# T24
def complaints_by_entity(scored: DataFrame, entity: str, entity_value, text: str = "review",
                         feel: str = "max_feel", n: int = 3, id_col: str | Sequence[str] = "review_id",
                         summary: Callable[..., DataFrame] = summarise_complaints) -> DataFrame:
    """Sadness texts of one entity, summarised (F10 + T22); ``summary``: either summariser."""
    sub = scored.where((F.col(feel) == "sadness") & (F.col(entity) == entity_value))
    return summary(sub, [entity], text, n, id_col)
