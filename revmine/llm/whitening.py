"""Whitening of embeddings by an incremental eigendecomposition.

Vectors become integers (``floor(scale * c) + shift``), and each distinct one
counts once.  A task holds the mean and the spectrum of the vectors it has seen
so far and adds each vector as one centred rank-one update: with n vectors of
sum S before, their scatter grows by v v' for v = (n x - S) / sqrt(n (n + 1)).
In the basis of the present eigenvectors that is a diagonal plus a rank one, its
eigenvalues the roots of the secular equation 1 + sum z_j^2 / (d_j - l) = 0.
Places where z is (nearly) 0 and equal d are deflated first; the others are
found by rational interpolation between neighbouring poles, all at a time, kept
as distances from the nearer pole; eigenvectors come from the z that has
exactly these roots, which keeps them orthogonal however close two roots lie.

Two spectra are combined by adding one's eigenvectors, scaled by the roots of
its eigenvalues, to the other as rank-one updates, and one more for the distance
of the means.  Tasks' spectra meet in groups of ``FAN_IN``, level by level, each
level stored; no task or driver sees more than ``FAN_IN`` of them.  Rounding of
many updates is removed last: the exact mean is known, each task multiplies its
centred vectors into the basis and sums their products, and the small matrix
that remains is diagonalised (Rayleigh-Ritz).

Size bounds: the driver and a task hold a few matrices of d * d doubles, d the
length of a vector.

Defined results: rows whose vector is null, empty, or holds a null or a
non-finite entry are left out, and so are rows whose vector has another length
than most have (the greater length if two are equally frequent) or an entry
beyond 2**40 / scale, which sums of integers do not hold; rows that repeat an id are rows of their own; ties between eigenvalues
leave the choice of directions inside their space open, the same for all rows; a component whose eigenvalue is 0 to rounding has no direction and no
rows; without two distinct vectors the result is empty.  ``deviation`` is null
where it does not fit a long.  Columns beside the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from revmine.llm.common import stored
from revmine.llm.words import released

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: spectra that one task combines
FAN_IN = 16
#: vectors that one task adds to a spectrum, about
ROWS_PER_TASK = 8_000
_EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pole, offset): root i of 1 + sum z_j^2 / (d_j - l) is d[pole[i]] + offset[i].

    ``d`` ascending and distinct, ``z`` without zeros.  Root i lies between d_i
    and d_(i + 1), the last one up to |z|^2 above the last pole.
    """
    n = len(d)
    zz = z * z
    gap = np.append(np.diff(d), zz.sum())
    # which half of the interval holds the root tells the nearer pole
    middle = d[:, None] - d[None, :] - (gap / 2)[None, :]  # d_j - (d_i + gap_i / 2)
    at_middle = 1 + (zz[:, None] / middle).sum(axis=0)
    right = (at_middle < 0) & (np.arange(n) < n - 1)
    pole = np.arange(n) + right
    delta = d[:, None] - d[pole][None, :]  # exact differences to the pole of each root
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(n) < n - 1, gap / 2, gap))
    low = np.where((np.arange(n) == n - 1) & (at_middle < 0), gap / 2, low)
    high = np.where((np.arange(n) == n - 1) & (at_middle >= 0), gap / 2, high)
    x = (low + high) / 2
    below = np.triu(np.ones((n, n)))  # poles left of root i
    a, b = delta[np.arange(n), np.arange(n)], np.append(delta[np.arange(1, n), np.arange(n - 1)], np.inf)
    inner = slice(0, n - 1)
    with np.errstate(all="ignore"):
        for _ in range(80):
            away = delta - x
            part = zz[:, None] / away
            slope = part / away
            whole, near = part.sum(axis=0), np.einsum("ji,ji->i", part, below)
            left = np.einsum("ji,ji->i", slope, below)
            rest = slope.sum(axis=0) - left
            f = 1 + whole
            done = np.abs(f) <= 4 * _EPS * (1 + whole - 2 * near)  # terms left of a root are negative, right of it positive
            if done.all():
                break
            negative = f < 0
            low, high = np.where(negative, x, low), np.where(negative, high, x)
            # f is replaced by c + s / (a - l) + t / (b - l) with its own value and slopes from either side,
            # whose root is a step y with c y^2 - p y + q = 0
            da, db = (a - x)[inner], (b - x)[inner]
            c = f[inner] - da * left[inner] - db * rest[inner]
            p = (da + db) * f[inner] - da * db * (left[inner] + rest[inner])
            q = da * db * f[inner]
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            y = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            end = a[-1] - x[-1]  # right of the last pole there is none
            new = x + np.append(y, end + left[-1] * end * end / (f[-1] - end * left[-1]))
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            done |= np.abs(new - x) <= 2 * _EPS * np.abs(new)
            x = np.where(done, x, new)
            if done.all():
                break
    return pole, x


def rank_one(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of diag(d) + z z', d ascending."""
    n = len(d)
    basis = None
    scale = max(abs(d[-1]), float(z @ z), np.finfo(np.float64).tiny)
    keep = np.abs(z) * np.sqrt(scale) > 8 * _EPS * scale
    z = np.where(keep, z, 0.0)
    close = np.flatnonzero(np.diff(d) <= 8 * _EPS * scale)
    if len(close):  # equal poles: a rotation moves all of z to the last of them
        basis, z = np.eye(n), z.copy()
        for i in close.tolist():
            r = np.hypot(z[i], z[i + 1])
            if r > 0 and z[i] != 0:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                first, second = basis[:, i].copy(), basis[:, i + 1].copy()
                basis[:, i], basis[:, i + 1] = c * first - s * second, s * first + c * second
    use = np.flatnonzero(z)
    values, vectors = d.astype(np.float64).copy(), np.eye(n)
    if len(use):
        dk, zk = d[use], z[use]
        pole, x = secular_roots(dk, zk)
        away = (dk[:, None] - dk[pole][None, :]) - x  # d_j - root_i
        # the z whose roots are exactly these (Loewner)
        ratio = -away
        np.fill_diagonal(ratio, 1.0)
        spread = dk[None, :] - dk[:, None]
        np.fill_diagonal(spread, 1.0)
        square = -np.diagonal(away) * np.prod(ratio / spread, axis=1)
        exact = np.copysign(np.sqrt(np.abs(square)), zk)
        part = exact[:, None] / away
        part /= np.linalg.norm(part, axis=0)
        values[use] = dk[pole] + x
        vectors[np.ix_(use, use)] = part
    order = np.argsort(values, kind="stable")
    vectors = vectors[:, order] if basis is None else basis @ vectors[:, order]
    return np.maximum(values[order], 0.0), vectors


@dataclass
class Spectrum:
    """n vectors with sums ``total`` (exact); scatter = basis diag(values) basis', values ascending."""

    dim: int
    n: int = 0
    total: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    basis: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.total is None:
            self.total = np.zeros(self.dim, object)
            self.values, self.basis = np.zeros(self.dim), np.eye(self.dim)

    def _update(self, v: np.ndarray) -> None:
        self.values, turn = rank_one(self.values, self.basis.T @ v)
        self.basis = self.basis @ turn

    def add(self, rows: np.ndarray) -> None:
        """Vectors of integers, one rank-one update for each."""
        total = self.total - rows[0].astype(object) * self.n  # about the first row, so that sums stay small
        small = np.array(total, np.float64)
        about = rows[0]
        for x in rows - about:
            if self.n:
                self._update((self.n * x - small) / np.sqrt(self.n * (self.n + 1.0)))
            small += x
            self.n += 1
        self.total = self.total + rows.sum(axis=0, dtype=np.int64).astype(object)

    def add_block(self, rows: np.ndarray) -> None:
        """The same for many vectors at once: the triangular factor of the centred vectors has their scatter, and each
        of its rows, as many as a vector has entries, is one rank-one update."""
        block = Spectrum(self.dim, len(rows), rows.sum(axis=0, dtype=np.int64).astype(object), np.zeros(self.dim), np.eye(self.dim))
        low = rows[0]
        centred = (rows - low).astype(np.float64)
        for v in np.linalg.qr(centred - centred.mean(axis=0), mode="r"):
            block._update(v)
        self.combine(block)

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        if self.n:
            for value, v in zip(other.values, other.basis.T, strict=True):
                if value > 0:
                    self._update(np.sqrt(value) * v)
            apart = np.array(self.total * other.n - other.total * self.n, np.float64) / (float(self.n) * other.n)
            self._update(apart * np.sqrt(self.n * (other.n / (self.n + other.n))))
        else:
            self.values, self.basis = other.values, other.basis
        self.n, self.total = self.n + other.n, self.total + other.total

    def row(self, group: int) -> pa.RecordBatch:
        columns = [pa.array([group]), pa.array([self.n]), pa.array([[int(v) for v in self.total]], pa.list_(pa.int64())),
                   pa.array([self.values.tolist()], pa.list_(pa.float64())), pa.array([self.basis.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "n", "total", "eigenvalues", "basis"])


_SPECTRUM = "grp long, n long, total array<long>, eigenvalues array<double>, basis array<double>"


def _spectra(batch: pa.RecordBatch | pa.Table, dim: int) -> Iterator[Spectrum]:
    for r in batch.to_pylist():
        yield Spectrum(dim, r["n"], np.array(r["total"], object), np.array(r["eigenvalues"]), np.array(r["basis"]).reshape(dim, dim))


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


@dataclass(frozen=True)
class Model:
    """n and sums of the distinct vectors; eigenvalues (divisor n) in falling order, a component a column."""

    n: int
    total: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.total]) if self.n else np.zeros(0)


def integers(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): the integer vector of each row that has a whole one, of the length that most have."""
    vector = F.col(vector_col).cast("array<double>")
    most = float(1 << 40) / scale
    whole = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(c.between(-most, most), F.lit(False)))
    x = F.transform(vector, lambda c: (F.floor(F.lit(float(scale)) * c) + shift).cast("long"))
    return rows.where(whole).select(F.col(id_col).alias("id"), x.alias("x"))


def fit(parts: DataFrame, dim: int, components: int = COMPONENTS, rows_per_task: int = ROWS_PER_TASK, block_rows: int = 1) -> Model:
    """Spectrum of the vectors ``x`` of a stored table, distinct and of length ``dim``.

    With ``block_rows`` > ``dim`` so many vectors are condensed to ``dim`` before
    the updates, which then are fewer by that factor; results differ by rounding.
    """
    spark = parts.sparkSession
    tasks = -(-parts.count() // rows_per_task)

    def updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum(dim)
        for batch in batches:
            rows = _matrix(batch.column("x"), dim, np.int64)
            for lo in range(0, len(rows), max(block_rows, 1) if block_rows > dim else max(len(rows), 1)):
                if block_rows > dim:
                    seen.add_block(rows[lo:lo + block_rows])
                else:
                    seen.add(rows)
        if seen.n:
            yield seen.row(TaskContext.get().partitionId())

    def combined(key: tuple, table: pa.Table) -> pa.Table:
        out = Spectrum(dim)
        for other in _spectra(table, dim):
            out.combine(other)
        return pa.Table.from_batches([out.row(key[0].as_py())])

    spectra = stored(parts.select("x").repartition(max(1, tasks)).mapInArrow(released(updates), _SPECTRUM), "spectra")
    while spectra.count() > 1:
        meet = spectra.withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        spectra = stored(meet.groupBy("grp").applyInArrow(combined, _SPECTRUM), "spectra")
    rows = spectra.toArrow()  # one row of about d * d doubles, or none
    if not rows.num_rows:
        return Model(0, (), np.zeros(0), np.zeros((dim, 0)), 0.0)
    found = next(_spectra(rows, dim))
    total, n, basis = [int(t) for t in found.total], found.n, found.basis
    sent = spark.sparkContext.broadcast((total, n, basis))  # d * d doubles

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, basis = sent.value
        low = [t // n for t in total]  # whole part of the mean, taken off exactly
        rest = np.array([t % n / n for t in total])
        gram = np.zeros((dim, dim))
        for batch in batches:
            centred = (_matrix(batch.column("x"), dim, np.int64) - np.array(low, np.int64)).astype(np.float64) - rest
            turned = centred @ basis
            gram += turned.T @ turned
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(gram.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    entries = parts.mapInArrow(released(products), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    summed = entries.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # d * d rows
    gram = np.zeros((dim, dim))
    gram[summed["i"].to_numpy(), summed["j"].to_numpy()] = summed["v"].to_numpy()
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    values, vectors = values[::-1] / n, basis @ turn[:, ::-1]
    use = values > max(dim, 10) * _EPS * max(values[0], 0.0)
    use[components:] = False
    return Model(n, tuple(total), values[use], vectors[:, use], float(np.trace(gram)) / n)


def _whitened(x: np.ndarray, model: Model) -> np.ndarray:
    low = np.array([t // model.n for t in model.total], np.int64)
    rest = np.array([t % model.n / model.n for t in model.total])
    return ((x - low).astype(np.float64) - rest) @ model.components / np.sqrt(model.values)


def _deviation(x: np.ndarray, model: Model) -> list[int | None]:
    """Exact sum of (n x - S)^2."""
    low = np.array([t // model.n for t in model.total], np.int64)
    rest = np.array([t % model.n for t in model.total], np.int64)
    far = x - low  # n x - S = n (x - low) - rest, rest below n
    if float(model.n) * (np.abs(far).max(initial=0) + 1.0) < (2.0 ** 62 / max(1, x.shape[1])) ** 0.5:
        part = model.n * far - rest
        return (part * part).sum(axis=1).tolist()
    exact = [sum((model.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in far.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(parts: DataFrame, model: Model) -> float:
    """Largest entry of the covariance of whitened distinct vectors less the identity, as the tasks computed them."""
    k = len(model.values)
    sent = parts.sparkSession.sparkContext.broadcast(model)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _whitened(_matrix(batch.column("x"), len(sent.value.total), np.int64), sent.value)
            gram, total = gram + w.T @ w, total + w.sum(axis=0)
        rows = np.vstack([gram, total[None, :]])
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    entries = parts.mapInArrow(released(products), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    got = entries.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros((k + 1, k))
    sums[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy() / model.n
    covariance = sums[:k] - np.outer(sums[k], sums[k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT, block_rows: int = 1) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each whole vector and component."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = stored(integers(rows, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift), "vectors")
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    vectors = vectors.where(F.size("x") == sizes["d"])
    parts = stored(vectors.select("x").distinct(), "distinct-vectors")
    model = fit(parts, sizes["d"], components, block_rows=block_rows)
    if not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(parts, model)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.values)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                x = _matrix(some.column("x"), len(model.total), np.int64)
                m = len(x)
                pick = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    some.column("id").take(pick), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(_deviation(x, model), pa.int64()).take(pick), pa.array(_whitened(x, model).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(released(run), schema)
