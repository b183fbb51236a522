"""Term vectors and learned label weights from how terms occur together.

Terms are counted within a window of tokens, the counts become positive
pointwise mutual information, and a randomised decomposition turns them into
short vectors (T21), or a walk over the strongest neighbours spreads a few
labelled seed terms over the vocabulary (T18-T20).  The vocabulary is the
``max_terms`` most frequent terms, so matrices of ``max_terms`` rows and a few
dozen columns are bounded; texts are read once, in Arrow tasks that add up the
pairs of a bounded piece of a batch before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revmine.functions import text as X
from revmine.session import cut_lineage

#: rows of the term matrix that one task multiplies
BLOCK_ROWS = 64
#: places of a batch, in whole texts, that a task looks at together, and whose pairs it holds
SLICE_TOKENS = 1 << 18


def vocabulary(df: DataFrame, tokens: str = "tokens", max_terms: int = 20_000, stop: Sequence[str] = ()) -> list[str]:
    """The most frequent terms, ties by the term, stop words left out; ``max_terms`` words reach the driver."""
    t = df.select(F.explode_outer(tokens).alias("t")).where(F.col("t").isNotNull()).groupBy("t").agg(F.count("*").alias("n"))
    if stop:
        t = t.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in sorted(set(stop))], "t string")), "t", "left_anti")  # a typed list
    return [r["t"] for r in t.orderBy(F.desc("n"), "t").limit(max_terms).select("t").collect()]


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of the texts (lists of words) with ``SLICE_TOKENS`` words at most, or one text."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    done = 0
    while done < len(ends):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE_TOKENS, side="right")))
        yield column.slice(done, upto - done)
        done = upto


def cooccurrences(df: DataFrame, terms: Sequence[str], tokens: str = "tokens", window: int = 4) -> DataFrame:
    """``(i, j, n)``: ordered pairs of places at most ``window`` apart in one text, with terms i and j (numbers in ``terms``).

    Words outside ``terms`` keep their places.  The counts are symmetric; only
    pairs that occur have a row.
    """
    sent = df.sparkSession.sparkContext.broadcast(list(terms))
    size = max(1, len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(sent.value, pa.string())
        for column in (c for batch in batches for c in _pieces(batch.column("tokens"))):
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = column.flatten().dictionary_encode()
            if not len(words):
                continue
            known = pa.compute.index_in(words.dictionary, value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.where(words.indices.is_null().to_numpy(zero_copy_only=False), -1, known[words.indices.fill_null(0).to_numpy(zero_copy_only=False)])
            text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            for lo in range(0, len(code), SLICE_TOKENS):  # a long text: pairs whose first place is in this piece
                keys = []
                for d in range(1, window + 1):
                    hi = min(lo + SLICE_TOKENS, len(code) - d)
                    if hi <= lo:
                        break
                    a, b = code[lo:hi], code[lo + d:hi + d]
                    use = (a >= 0) & (b >= 0) & (text[lo:hi] == text[lo + d:hi + d])
                    keys += [a[use] * size + b[use], b[use] * size + a[use]]
                if not keys:
                    continue
                pair, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pair // size).astype(np.int32)), pa.array((pair % size).astype(np.int32)), pa.array(n)], names=["i", "j", "n"])

    return df.select(F.col(tokens).alias("tokens")).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def positive_pmi(counts: DataFrame) -> DataFrame:
    """``(i, j, n, v)`` with v = ln(n * total / (n_i * n_j)), pairs with v > 0 only."""
    rows = counts.groupBy("i").agg(F.sum("n").alias("_ni"))  # a row for each term
    total = counts.agg(F.sum("n")).scalar()
    out = counts.join(rows, "i").join(rows.select(F.col("i").alias("j"), F.col("_ni").alias("_nj")), "j")
    v = F.log(F.col("n").cast("double") * total / (F.col("_ni").cast("double") * F.col("_nj")))
    return out.select("i", "j", "n", v.alias("v")).where("v > 0")


def _multiplied(matrix: DataFrame, right: np.ndarray) -> np.ndarray:
    """The symmetric sparse matrix (i, j, v) times a dense one with few columns, which every task holds."""
    sent = matrix.sparkSession.sparkContext.broadcast(right)
    width = right.shape[1]

    def block(table: pa.Table) -> pa.Table:
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        at = i % BLOCK_ROWS
        out, seen = np.zeros((BLOCK_ROWS, width)), np.zeros(BLOCK_ROWS, bool)
        for lo in range(0, len(at), 1 << 16):  # a bounded piece of the products at a time
            some = slice(lo, lo + (1 << 16))
            np.add.at(out, at[some], v[some, None] * sent.value[j[some]])
            seen[at[some]] = True
        rows = i[0] // BLOCK_ROWS * BLOCK_ROWS + np.flatnonzero(seen)
        return pa.table({"i": pa.array(rows, pa.int32()), "y": pa.array(list(out[seen]), pa.list_(pa.float64()))})

    got = matrix.groupBy(F.floor(F.col("i") / BLOCK_ROWS)).applyInArrow(block, "i int, y array<double>").toArrow()
    out = np.zeros(right.shape)
    if got.num_rows:
        out[got.column("i").to_numpy()] = np.concatenate([c.flatten().to_numpy() for c in got.column("y").chunks]).reshape(-1, width)
    return out


def randomised_vectors(matrix: DataFrame, n: int, dim: int = 64, extra: int = 16, rounds: int = 4, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(singular values in falling order, left vectors times their roots) of a symmetric sparse matrix of n rows.

    Products with a random subspace run in Spark, ``rounds`` of them; the
    subspace, n * (dim + extra) doubles, is kept orthogonal on the driver.  The
    largest entry of each vector is made positive.
    """
    width = min(n, dim + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_multiplied(matrix, basis))[0]
    small = basis.T @ _multiplied(matrix, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dim]
    vectors = basis @ turn[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    size = np.abs(values[order])
    return size, vectors * np.sqrt(size)


def term_vectors(df: DataFrame, tokens: str = "tokens", *, dim: int = 64, window: int = 4, max_terms: int = 20_000,
                 stop: Sequence[str] = ()) -> DataFrame:
    """``(term, vector)`` of the most frequent terms of all texts; terms without a neighbour have the zero vector."""
    spark = df.sparkSession
    terms = vocabulary(df, tokens, max_terms, stop)
    if not terms:
        return spark.createDataFrame([], "term string, vector array<double>")
    matrix = cut_lineage(positive_pmi(cut_lineage(cooccurrences(df, terms, tokens, window))).select("i", "j", "v"))
    _, vectors = randomised_vectors(matrix, len(terms), dim)
    return spark.createDataFrame(pa.table({"term": terms, "vector": pa.array(list(vectors), pa.list_(pa.float64()))}))  # max_terms * dim doubles


def seed_centroids(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(category, centroid)``: mean vector of a category's seed terms ``(term, category)`` that have one."""
    long = vectors.join(seeds, "term").select("category", F.posexplode("vector").alias("_p", "_v"))
    per = long.groupBy("category", "_p").agg(F.avg("_v").alias("_m"))
    return (per.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_s"))  # one entry for each dimension
            .select("category", F.transform("_s", lambda s: s["_m"]).alias("centroid")))


def neighbours(pmi: DataFrame, m: int = 10) -> DataFrame:
    """``(i, j, w)``: each term's m strongest other terms (ties by number), weights that add up to 1."""
    w = Window.partitionBy("i").orderBy(F.round("v", 9).desc(), "j")  # a term has at most as many rows as there are terms
    top = pmi.where("i <> j").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m)
    return top.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("i"))).select("i", "j", "w")


def spread_labels(edges: DataFrame, seeds: DataFrame, labels: Sequence[str], share: float = 0.6, tolerance: float = 1e-4,
                  max_rounds: int = 40) -> DataFrame:
    """``(i, label...)``: weights of each label for every term that a seed reaches.

    A round gives each term ``share`` of its neighbours' weights and, if it is
    one of ``seeds`` ``(i, label)``, 1 - ``share`` of its own label.  Rounds end
    when no weight moves by ``tolerance``; each one is stored.
    """
    labels = list(labels)
    own = seeds.groupBy("i").agg(*[F.max(F.when(F.col("label") == c, 1.0 - share).otherwise(0.0)).alias(c) for c in labels])
    own = cut_lineage(own)
    now = own
    edges = cut_lineage(edges)
    for _ in range(max_rounds):
        from_near = (edges.join(now.withColumnRenamed("i", "j"), "j").groupBy("i")
                     .agg(*[(F.sum(F.col("w") * F.col(c)) * share).alias(c) for c in labels]))
        both = from_near.unionByName(own)
        new = cut_lineage(both.groupBy("i").agg(*[F.sum(c).alias(c) for c in labels]))
        old = now.select("i", *[F.col(c).alias(f"_{c}") for c in labels])
        moved = new.join(old, "i", "left").agg(F.max(F.greatest(*[F.abs(F.col(c) - F.coalesce(f"_{c}", F.lit(0.0))) for c in labels], F.lit(0.0)))).first()[0]
        now = new
        if moved is None or moved < tolerance:
            break
    return now


def induce_lexicon(df: DataFrame, seeds: DataFrame, labels: Sequence[str], tokens: str = "tokens", *, window: int = 4, max_terms: int = 20_000,
                   m: int = 10, stop: Sequence[str] = (), terms: Sequence[str] | None = None, **spread) -> DataFrame:
    """``(term, label...)``: weights learnt from seed terms ``(term, label)`` and how all texts use their words."""
    terms = list(terms) if terms is not None else vocabulary(df, tokens, max_terms, stop)
    spark = df.sparkSession
    numbers = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, term string")
    pmi = positive_pmi(cut_lineage(cooccurrences(df, terms, tokens, window)))
    weights = spread_labels(neighbours(pmi, m), seeds.join(numbers, "term").select("i", "label"), labels, **spread)
    return weights.join(numbers, "i").select("term", *labels)


def score_with_lexicon(df: DataFrame, ids: Sequence[str], lexicon: DataFrame, labels: Sequence[str], tokens: str = "tokens",
                       feel: str = "max_feel") -> DataFrame:
    """``(ids..., label..., feel)``: shares of the label weights of each text's words; all 0 without a known word.

    ``ids`` identify a text; ``feel`` is the leftmost largest label, shares
    being compared in 9 decimals.  A text's
    words are added up in the task that reads it before its sums are shuffled.
    """
    labels, ids = list(labels), list(ids)
    words = df.select(*ids, F.explode_outer(tokens).alias("term"))
    sums = words.join(lexicon, "term", "left").groupBy(*ids).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in labels])
    total = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    shares = sums.select(*ids, *[F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0)).alias(c) for c in labels])
    near = shares.select("*", *[F.round(c, 9).alias(f"_{c}") for c in labels])
    return near.withColumn(feel, X.label_argmax([f"_{c}" for c in labels], labels)).drop(*[f"_{c}" for c in labels])


#: side of each emotion for a polarity
SIDES = {"negative": ("anger", "disgust", "fear", "sadness"), "neutral": ("neutral", "surprise"), "positive": ("joy",)}


def polarity_lexicon(lexicon: DataFrame) -> DataFrame:
    """``(term, negative, neutral, positive)`` of a lexicon of emotions."""
    return lexicon.select("term", *[sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias(side) for side, cols in SIDES.items()])


def word_tokens(text: str | Column) -> Column:
    """Lowercase words of three letters and more, the tokens of these operators by default."""
    return X.tokenise(F.lower(F.col(text) if isinstance(text, str) else text))
