"""Toxicity: character n-gram linear classifier over naive Bayes log-count ratios.

Features are the presence of character n-grams (3 to 6 characters of a
lower-cased word with one boundary mark on either side, hashed to ``2**BITS``
buckets).  Each present feature counts as its naive Bayes log-count ratio
``r = log(P(gram | toxic) / P(gram | clean))`` (counts of texts, smoothed by
one); a logistic regression is fitted on these scaled features.  Grams whose
ratio is less than ``min_z`` standard errors from 0 have weight 0.

The fit reads a bounded sample of labelled rows (``max_rows``, by a hash of the
id), counted on the executors; scoring reads every row over its whole text.

Defined results: a null or empty text has no features and gets the score of
the intercept.  Null labels and labels without a text are not used; labels of a
repeated id are averaged and rounded.  Without labels of both classes every
score is the share of label 1 (0 without any label).  Repeated rows score
alike.  Columns beside the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from revmine.llm.common import labelled_sample, stored
from revmine.llm.words import SPACED, chunks, released, words

BITS = 20
ORDERS = (3, 4, 5, 6)


def word_grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) pairs of a list of words, hashed; a word without grams has none."""
    if not vocabulary:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "\n" + b"\n".join(vocabulary).decode("utf-8", "replace").lower() + "\n"
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = points == 10
    word = np.cumsum(mark) - 1  # of the word that starts at or before each character
    found_w, found_g = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inner = np.zeros(m, bool)
        h = np.full(m, n, np.uint64)
        for i in range(n):
            if 0 < i < n - 1:
                inner |= mark[i:i + m]
            h = (h ^ points[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        at = np.flatnonzero(~inner)
        found_w.append(word[at])
        found_g.append((h[at] >> np.uint64(64 - BITS - 4) & np.uint64((1 << BITS) - 1)).astype(np.int64))
    w, g = (np.concatenate(found_w), np.concatenate(found_g)) if found_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(w, kind="stable")
    return w[order], g[order]


def text_grams(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, gram) pairs of a null-free slice; with ``wanted`` only grams it flags."""
    w = words(texts, SPACED)
    of, gram = word_grams(w.vocabulary)
    if wanted is not None:
        use = wanted[gram]
        of, gram = of[use], gram[use]
    count = np.bincount(of, minlength=len(w.vocabulary))
    begin = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    keep = count[w.codes] > 0
    pairs = np.unique((owner[keep] << 32) | w.codes[keep])  # distinct words of each text
    text, code = pairs >> 32, pairs & 0xFFFFFFFF
    n = count[code]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[code], n)
    got = np.unique((np.repeat(text, n) << 32) | gram[at])
    return got >> 32, got & 0xFFFFFFFF


@dataclass(frozen=True)
class GramModel:
    grams: np.ndarray    # hashed grams with a weight, ascending
    weights: np.ndarray  # ratio times coefficient
    bias: float

    def probability(self, texts: pa.Array) -> np.ndarray:
        wanted = np.zeros(1 << BITS, bool)
        wanted[self.grams] = True
        text, gram = text_grams(texts, wanted)
        s = np.bincount(text, weights=self.weights[np.searchsorted(self.grams, gram)], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _logistic(text: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, n_features: int,
              l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Nesterov's gradient method on sparse rows given as (text, feature) pairs."""
    n = len(y)
    norm = np.bincount(text, weights=value[feature] ** 2, minlength=n).mean() + 1
    rate, w, b = 4.0 / norm, np.zeros(n_features), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    vw, vb = w.copy(), b
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, weights=(vw * value)[feature], minlength=n) + vb, -40, 40)))
        err = (p - y) / n
        gw = np.bincount(feature, weights=err[text], minlength=n_features) * value + l2 * vw / n
        nw, nb = vw - rate * gw, vb - rate * err.sum()
        k = t / (t + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        train: Column | None = None, max_rows: int = 12_000, min_z: float = 3.0, l2: float = 1.0,
        steps: int = 300) -> GramModel:
    """Fit on at most ``max_rows`` labelled rows (``train``: which labels may be learnt from)."""
    sample = stored(labelled_sample(docs, labels, label, id_col, text_col, train, max_rows), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column("label").to_numpy()
            for lo, part in chunks(batch.column("text")):
                text, gram = text_grams(part)
                own = y[lo:lo + len(part)]
                rows += np.bincount(own, minlength=2)
                for c in (0, 1):
                    seen[c] += np.bincount(gram[own[text] == c], minlength=1 << BITS)
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0][at], rows[0])), pa.array(np.append(seen[1][at], rows[1]))], names=["gram", "clean", "toxic"])

    counted = (sample.mapInArrow(released(count), "gram long, clean long, toxic long").groupBy("gram")
               .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).orderBy("gram").toArrow())  # 2**BITS rows at most
    none = GramModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    if not counted.num_rows:
        return GramModel(none.grams, none.weights, -40.0)
    gram, clean, toxic = (counted.column(c).to_numpy() for c in ("gram", "clean", "toxic"))
    n0, n1 = int(clean[0]), int(toxic[0])  # gram -1 counts the texts
    if not n0 or not n1:
        return GramModel(none.grams, none.weights, 40.0 if n1 else -40.0)
    gram, p, q = gram[1:], toxic[1:] + 1.0, clean[1:] + 1.0
    ratio = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2))
    pick = np.abs(ratio) / np.sqrt(1 / p + 1 / q) >= min_z
    gram, ratio = gram[pick], ratio[pick]
    wanted = np.zeros(1 << BITS, bool)
    wanted[gram] = True

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                text, g = text_grams(part, wanted)
                ends = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, len(part)), pa.ListArray.from_arrays(ends, pa.array(g.astype(np.int32)))], names=["label", "grams"])

    got = sample.mapInArrow(released(present), "label int, grams array<int>").toArrow()  # max_rows rows of chosen grams
    lists = got.column("grams").combine_chunks()
    n, flat, label = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), got.column("label").to_numpy()
    begin = np.cumsum(n) - n
    digest = np.array([xxhash.xxh3_64_intdigest(flat[a:a + k]) for a, k in zip(begin.tolist(), n.tolist(), strict=True)], np.uint64)
    order = np.lexsort((label, digest))  # task order must not matter
    n, y = n[order].astype(np.int64), label[order].astype(float)
    text = np.repeat(np.arange(len(n)), n)
    feature = np.searchsorted(gram, flat[np.arange(n.sum()) + np.repeat(begin[order] - (np.cumsum(n) - n), n)])
    w, b = _logistic(text, feature, ratio, y, len(gram), l2, steps)
    return GramModel(gram, w * ratio, b)


def score(docs: DataFrame, model: GramModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, by the whole text."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(part)), pa.array(model.probability(part))], names=["id", "score"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(run), f"id {kind.simpleString()}, score double"))
