"""Quality classifier: Bradley-Terry pairwise ranking.

Each preference pair (a better text, a worse one) says
``P(better beats worse) = sigmoid(s(better) - s(worse))``; the document score
``s`` is linear in features of the text, so fitting is a logistic regression
without intercept on *feature differences*.  A score quantile, taken where the
share of poor training texts ends, is the threshold.

The features are shares and logarithms of counts over the whole text (letters,
digits, symbols, line and word repetition ...), each cut into quantile bins of
the training texts, so that the linear score is a sum of step functions.

The fit uses every labelled row and every pair of a row labelled 1 with one
labelled 0.  The pairs are never written out: their loss depends on the scores
alone, so a step counts the scores of either label on a grid (linear weights
between two nodes, ``GRID`` or wider apart), the driver adds up the pairs of
nodes, and a second pass gives each row its share of the gradient.  Passes run
in Arrow tasks over the stored bin numbers and add up integers (multiples of
2**-30), so the model does not depend on how rows are dealt to tasks.

Defined results: a null or empty text has the features of a text of no
characters and gets a score like any other.  Labels that are null, or of an id
that no text has, are not used; labels of a repeated id are averaged and
rounded.  With no label, or labels of one class only, every score is the share
of label 1 among the labels (0.5 without any).  Repeated rows score alike.
Columns of the input beside the named ones are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revmine.llm.common import labelled_sample, stored
from revmine.llm.words import SPACED, chunks, raw, released, word_class, words
from revmine.operators.ranks import percentile_by_rank

#: the score that the quantile threshold is mapped to
THRESHOLD_SCORE = 0.3

LINES = word_class([(0x0A, 0x0A)], lower=False)

FEATURES = [
    "log_chars", "log_words", "log_lines", "upper", "digit", "space", "symbol", "bang", "stop", "comma",
    "other_punct", "non_ascii", "word_len", "distinct_words", "distinct_triples", "distinct_lines",
    "line_words", "caps_words", "marked_words", "top_word",
]


def _byte_set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_MARKS = frozenset(b"#*$%&|<>!")
_SETS = {
    "upper": _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _byte_set("0123456789"),
    "space": _byte_set(" \t\r\x0b\x0c"),
    "symbol": _byte_set("#*$%&|<>"),
    "bang": _byte_set("!?"),
    "stop": _byte_set("."),
    "comma": _byte_set(",;:"),
    "other_punct": _byte_set("\"'()+-/=@[\\]^_`{}~"),
    "lead": np.arange(256) >= 0xC0,
    "cont": (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0),
}


def _histograms(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of the 256 byte values in each text."""
    out = np.zeros((len(offs) - 1, 256), np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        out[i] = np.bincount(data[a:b], minlength=256)
    return out


def _distinct(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes (below 2**40) of each owner."""
    return np.bincount(np.unique((owner << 40) | codes) >> 40, minlength=n)


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """40 hash bits of three codes; a collision moves a feature by one part in n words."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (((h ^ (h >> np.uint64(29))) + c.astype(np.uint64)) * np.uint64(0x94D049BB133111EB) >> np.uint64(24)).astype(np.int64)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a null-free slice."""
    n = len(texts)
    data, offs = raw(texts)
    by_byte = _histograms(data, offs)
    counts = {k: by_byte[:, t].sum(axis=1) for k, t in _SETS.items()}
    chars = np.diff(offs) - counts["cont"]
    w, ln = words(texts, SPACED), words(texts, LINES)
    n_words, n_lines = np.diff(w.first), np.diff(ln.first)
    owner = np.repeat(np.arange(n), n_words)
    codes = w.codes.astype(np.int64)
    one, words1, lines1 = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    # word shapes, looked up by code
    caps = np.array([len(v) > 1 and v.isupper() for v in w.vocabulary] or [False], bool)
    marked = np.array([not _MARKS.isdisjoint(v) for v in w.vocabulary] or [False], bool)
    caps_n, marked_n = (np.bincount(owner, weights=x[codes], minlength=n) for x in (caps, marked))
    # triples of words inside a text
    at = np.flatnonzero(owner[:-2] == owner[2:])
    triples = _mixed(codes[at], codes[at + 1], codes[at + 2])
    key, times = np.unique((owner << 40) | codes, return_counts=True)
    top = np.zeros(n)
    if len(key):
        begin = np.flatnonzero(np.diff(key >> 40, prepend=-1))
        top[key[begin] >> 40] = np.maximum.reduceat(times, begin)
    return np.column_stack([
        np.log1p(chars), np.log1p(n_words), np.log1p(n_lines), counts["upper"] / one, counts["digit"] / one,
        counts["space"] / one, counts["symbol"] / one, counts["bang"] / one, counts["stop"] / one,
        counts["comma"] / one, counts["other_punct"] / one, counts["lead"] / one, chars / words1,
        np.bincount(key >> 40, minlength=n) / words1, _distinct(triples, owner[at], n) / np.maximum(n_words - 2, 1),
        _distinct(ln.codes.astype(np.int64), np.repeat(np.arange(n), n_lines), n) / lines1,
        np.log1p(n_words / lines1), caps_n / words1, marked_n / words1, top / words1,
    ]).astype(np.float64)


@dataclass(frozen=True)
class RankModel:
    """Step-function weights of a Bradley-Terry score and its calibration."""

    edges: list[np.ndarray] = field(default_factory=list)   # inner bin edges of each feature
    weights: list[np.ndarray] = field(default_factory=list)  # one weight for each bin
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.0          # raw score at the quantile; its probability is THRESHOLD_SCORE
    constant: float | None = None   # the score when there is nothing to rank

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x))
        for j, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            s += w[np.searchsorted(e, x[:, j], side="right")]
        return s

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw_score(x) + self.offset, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, count: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method for the logistic loss (x is dense and narrow, ``count`` says how many rows a row stands for)."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (count * (p - y)) + l2 * w
        hess = (x * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


#: distance of the nodes that scores are counted on, and how many there are at most
GRID, MAX_NODES = 1 / 64, 2048
#: nodes of the coarser grid that the Hessian is taken on
HESSIAN_NODES = 128
#: rows that a pass holds as a dense matrix
PASS_ROWS = 8192
_ONE = float(1 << 30)  # a sum's unit is 1 / _ONE

#: a pass: (bin numbers, labels) of some rows to a vector of integers, summed over all rows
_Pass = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]

QUANTILES = [*np.linspace(0, 1, 13)[1:-1].tolist(), 0.01, 0.03, 0.97, 0.99]  # the tails, where poor texts are, get edges of their own


def _short(x: np.ndarray) -> np.ndarray:
    """Values cut to 14 bits behind the first, so that there are few different ones, however many rows."""
    return (np.ascontiguousarray(x, np.float64).view(np.int64) >> 38 << 38).view(np.float64)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin number of each row and feature, counted through over all features."""
    first = np.cumsum([0] + [len(e) + 1 for e in edges])
    return np.column_stack([first[j] + np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]).astype(np.int64)


def _grid(w: np.ndarray, cuts: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` nodes at multiples of one step, around every score that the weights can give."""
    step = GRID
    lo, hi = (sum(f(w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)) for f in (np.min, np.max))
    while hi - lo > (most - 4) * step:
        step *= 2
    return step * np.arange(math.floor(lo / step) - 1, math.ceil(hi / step) + 2)


def _hats(s: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node below, weight of the node above) of each score, the weight a multiple of 1 / _ONE."""
    at = (s - nodes[0]) / (nodes[1] - nodes[0])
    below = np.clip(np.floor(at).astype(np.int64), 0, len(nodes) - 2)
    return below, np.rint((at - below) * _ONE) / _ONE


def _raw(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = np.zeros(len(codes))
    for j in range(codes.shape[1]):
        s += w[codes[:, j]]
    return s


def _counts(codes: np.ndarray, label: np.ndarray, w: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Rows with label 1, then rows with label 0 at each node."""
    below, up = _hats(_raw(codes, w), nodes)
    out = []
    for value in (1, 0):
        mine = label == value
        some, part = below[mine], np.rint(up[mine] * _ONE)
        out.append(np.bincount(some, _ONE - part, len(nodes)) + np.bincount(some + 1, part, len(nodes)))
    return np.concatenate(out).astype(np.int64)


def _slopes(codes: np.ndarray, label: np.ndarray, w: np.ndarray, nodes: np.ndarray, pull: np.ndarray, wide: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Gradient (d), the rows' own part of the Hessian (d * d), and the features at the coarse nodes by label (2 * nodes * d)."""
    d, n = len(w), len(wide)
    s = _raw(codes, w)
    good, known = label == 1, (label == 1) | (label == 0)
    force = np.rint(np.where(good, -np.interp(s, nodes, pull[0]), np.interp(s, nodes, pull[1])) * known * _ONE)
    grad = np.bincount(codes.ravel(), np.repeat(force, codes.shape[1]), d)
    below, up = _hats(s, wide)
    bend = np.where(good, (1 - up) * curve[0][below] + up * curve[0][below + 1], (1 - up) * curve[1][below] + up * curve[1][below + 1])
    hot = np.zeros((len(codes), d))
    np.put_along_axis(hot, codes, 1.0, axis=1)
    hess = hot.T @ (hot * np.rint(bend * known * _ONE)[:, None])
    place, row = np.zeros((len(codes), 2 * n)), np.arange(len(codes))
    part, at = np.rint(up * _ONE) * known, below + np.where(good, 0, n)
    place[row, at], place[row, at + 1] = _ONE * known - part, part
    return np.concatenate([grad, hess.ravel(), (place.T @ hot).ravel()]).astype(np.int64)


def _beaten(nodes: np.ndarray) -> np.ndarray:
    """Probability that a row at the node of a line loses against one at the node of a column."""
    return 1 / (1 + np.exp(-np.clip(nodes[None, :] - nodes[:, None], -40, 40)))


def _all_pairs(passes: _Pass, cuts: np.ndarray, n_good: int, n_bad: int, weight: float, l2: float, steps: int = 60) -> np.ndarray:
    """Bin weights with the least ``weight`` times the mean loss of all pairs plus l2 / 2 times their squares, by Newton's method."""
    d, fewer = int(cuts[-1]), min(n_good, n_bad)
    share = np.array([[fewer / n_good], [fewer / n_bad]])  # a row's part of the pairs, 1 for the rarer label
    w = np.zeros(d)
    for _ in range(steps):
        nodes, wide = _grid(w, cuts, MAX_NODES), _grid(w, cuts, HESSIAN_NODES)
        found = passes(lambda c, y, w=w, a=nodes, b=wide: np.concatenate([_counts(c, y, w, a), _counts(c, y, w, b)])) / _ONE
        good, bad, good_wide, bad_wide = np.split(found, np.cumsum([len(nodes), len(nodes), len(wide)]))
        lose, turn = _beaten(nodes), _beaten(wide)
        turn = turn * (1 - turn)
        pull = np.stack([lose @ bad / n_bad, good @ lose / n_good]) * share
        curve = np.stack([turn @ bad_wide / n_bad, good_wide @ turn / n_good]) * share
        got = passes(lambda c, y, w=w, a=nodes, p=pull, b=wide, q=curve: _slopes(c, y, w, a, p, b, q)) / _ONE
        grad, own, (up, down) = got[:d], got[d:d + d * d].reshape(d, d), got[d + d * d:].reshape(2, len(wide), d)
        cross = up.T @ turn @ down / max(n_good, n_bad)
        hess = (own - cross - cross.T) * (weight / fewer) + (l2 + 1e-9) * np.eye(d)
        step = np.linalg.solve(hess, grad * (weight / fewer) + l2 * w)
        most = np.abs(step).max()
        w = w - step / max(1.0, most / 2)
        if most < 1e-4:
            break
    return w


def _ranked(passes: _Pass, edges: list[np.ndarray], n_good: int, n_bad: int, weight: float, l2: float) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(weights of each feature's bins, the same in one, slope of the score's log odds)."""
    cuts = np.cumsum([0] + [len(e) + 1 for e in edges])
    w = _all_pairs(passes, cuts, n_good, n_bad, weight, l2)
    nodes = _grid(w, cuts, MAX_NODES)
    found = passes(lambda c, y: _counts(c, y, w, nodes)) / _ONE
    slope, _ = _logistic(np.column_stack([np.tile(nodes, 2), np.ones(2 * len(nodes))]), np.repeat([1.0, 0.0], len(nodes)), 1e-3, found)
    return [w[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], w, max(float(slope), 1e-3)


def _model(edges: list[np.ndarray], weights: list[np.ndarray], slope: float, threshold: float) -> RankModel:
    return RankModel(edges, weights, slope, math.log(THRESHOLD_SCORE / (1 - THRESHOLD_SCORE)) - slope * threshold, threshold)


def _summed(batches: Iterator[tuple[np.ndarray, np.ndarray]], f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    total = None
    for codes, label in batches:
        for lo in range(0, len(label), PASS_ROWS):
            part = f(codes[lo:lo + PASS_ROWS], label[lo:lo + PASS_ROWS])
            total = part if total is None else total + part
    return total


def fit_pairs(x: np.ndarray, label: np.ndarray, n_pairs: int = 20_000, l2: float = 3.0) -> RankModel:
    """Learn the score from all pairs (label 1 preferred to label 0) of rows at hand; ``n_pairs``: weight of their mean loss against ``l2``."""
    n_good, n_bad = int((label == 1).sum()), int((label == 0).sum())
    if not n_good or not n_bad:
        return RankModel(constant=float(label.mean()) if len(label) else 0.5)
    edges = [np.unique(np.quantile(_short(x[:, j]), QUANTILES)) for j in range(x.shape[1])]
    codes = _binned(x, edges)
    weights, w, slope = _ranked(lambda f: _summed(iter([(codes, label)]), f), edges, n_good, n_bad, n_pairs, l2)
    return _model(edges, weights, slope, float(np.quantile(_raw(codes, w), n_bad / len(label), method="midpoint")))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        train: Column | None = None, n_pairs: int = 20_000, l2: float = 3.0) -> RankModel:
    """:func:`fit_pairs` on all labelled rows (``train``: which labels may be learnt from), in Spark."""
    rows = labelled_sample(docs, labels, label, id_col, text_col, train)
    width = len(FEATURES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                x = text_features(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(lo, len(part)), pa.FixedSizeListArray.from_arrays(x.reshape(-1), x.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["label", "x"])

    rows = stored(rows.mapInArrow(released(features), "label int, x array<double>"), "quality-features")
    n, n_good, n_bad, mean = rows.agg(F.count("*"), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), F.avg("label")).first()
    if not n_good or not n_bad:
        return RankModel(constant=float(mean) if n else 0.5)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _short(batch.column("x").flatten().to_numpy().reshape(-1, width))
            for j in range(width):
                value, times = np.unique(x[:, j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), j, np.int32)), pa.array(value), pa.array(times)], names=["j", "v", "n"])

    counted = rows.select("x").mapInArrow(values, "j int, v double, n long").groupBy("j", "v").agg(F.sum("n").alias("n"))
    cut = counted.groupBy("j").agg(F.percentile("v", F.array(*map(F.lit, QUANTILES)), F.col("n")).alias("q")).orderBy("j").collect()  # a row for each feature
    edges = [np.unique(r["q"]) for r in cut]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _binned(batch.column("x").flatten().to_numpy().reshape(-1, width), edges).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.FixedSizeListArray.from_arrays(codes.reshape(-1), width).cast(pa.list_(pa.int32()))],
                                             names=["label", "codes"])

    binned = stored(rows.mapInArrow(bins, "label int, codes array<int>"), "quality-bins").coalesce(docs.sparkSession.sparkContext.defaultParallelism)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            yield batch.column("codes").flatten().to_numpy().reshape(-1, width).astype(np.int64), batch.column("label").to_numpy()

    def passes(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _summed(of(batches), f)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["total"])

        got = binned.mapInArrow(released(run), "total array<long>").toArrow()  # a vector for each task
        return sum(c.flatten().to_numpy().reshape(len(c), -1).sum(axis=0) for c in got.column("total").chunks if len(c))

    weights, w, slope = _ranked(passes, edges, n_good, n_bad, n_pairs, l2)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, _ in of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_raw(codes, w))], names=["s"])

    at = n_bad / n * (n - 1)
    s = binned.mapInArrow(scores, "s double")
    low, high = (percentile_by_rank(s, "s", k / (n - 1)).first()[0] for k in (math.floor(at), math.ceil(at)))
    return _model(edges, weights, slope, (low + high) / 2)


def score(docs: DataFrame, model: RankModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, raw_score) of every row, by the whole text."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                x = text_features(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, len(part)), pa.array(model.probability(x)), pa.array(model.raw_score(x) if model.weights else np.zeros(len(x)))],
                    names=["id", "score", "raw_score"])

    schema = f"id {kind.simpleString()}, score double, raw_score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), schema)


def accept(docs: DataFrame, model: RankModel, *, text_col: str = "text", min_score: float = THRESHOLD_SCORE) -> DataFrame:
    """Rows of ``docs`` with a score of ``min_score`` at least, all columns unchanged.

    One narrow pass: rows are judged where they are, only texts go to Python and
    only scores come back.
    """
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.probability(text_features(part)) for _, part in chunks(texts, 1 << 20)]
            yield pa.array(np.concatenate([*found, np.zeros(0)]))

    return docs.where(scored(F.col(f"`{text_col}`").cast("string")) >= min_score)
