"""Whitening of embeddings, from their centred scatter by Cholesky and Jacobi.

Vectors are taken as integers, floor(SCALE * c). The fit list is each distinct vector once; its count n, sums
S and scatter come from Spark, everything of the size of a matrix from the driver:

1. Distinct vectors are found by one shuffle, which combines equal vectors before it, and stored.
2. Tasks sum their vectors, then the products of vectors centred at the rounded mean; each sends
   one matrix, whatever it read, and Spark adds the cells. Integers throughout: products are split
   so that matrix products in doubles stay exact, so the scatter is the exact one.
3. The covariance, correctly rounded, is factored by Cholesky with diagonal pivoting, which stops at its
   rank. One-sided Jacobi rotates the columns of the triangular factor until they are orthogonal: their
   squared norms are the eigenvalues, the columns over their norms the components. Small
   eigenvalues keep their digits, as the matrix isn't squared on the way.
4. Each row is centred, projected and scaled in its task; what is sent along are the components asked for.

The driver takes d * (d + 1) / 2 cells for vectors of d numbers: for d up to some thousands.

Rows: those whose vector is null or holds nulls, NaN, infinities or numbers whose integer passes a long
are dropped; null and repeated vec_ids and repeated rows each get rows. Vectors of different lengths
are different spaces, each whitened by itself. There are as many components as the covariance has
rank, so equal vectors, a single one or an empty one have none and give no rows. Of equal eigenvalues the order is
arbitrary but the same for all rows; a component's largest entry is positive. A deviation beyond a
long is null. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, COMPONENTS = 256, 4
#: Bits of a limb: products of limbs fill 44 bits, so sums of 512 are exact in doubles.
LIMB, CHUNK = 22, 512
#: Sums travel as places of 32 bits, which Spark can add up in longs.
PLACES = 5
CELLS = "dim int, i int, j int, " + ", ".join(f"p{k} long" for k in range(PLACES))
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def integers(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x, the usable vectors as longs."""
    c = F.col(column)
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.floor(v.cast("double") * scale).cast("double")) < 2.0**63))
    floored = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), floored.alias("x"))


def _matrix(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """A list column by length of its lists: length, places of the rows, their numbers as a matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out.append((d, at, flat[starts[at][:, None] + np.arange(d)]))
    return out


def exact_product(y: np.ndarray) -> np.ndarray:
    """y.T @ y of integers, exact, as Python integers."""
    total = np.zeros((y.shape[1],) * 2, object)
    most = int(np.abs(y).max(initial=0)) if y.dtype != object else max(map(abs, y.ravel().tolist()), default=0)
    if most < 1 << LIMB:
        for a in range(0, len(y), CHUNK):
            part = y[a : a + CHUNK].astype(np.float64)
            total += (part.T @ part).astype(np.int64)
        return total
    limbs, rest = [], y
    while np.any(rest):  # of equal sign as the number, so the last is zero
        sign = np.where(rest < 0, -1, 1)
        size = abs(rest)
        limbs.append((sign * (size % (1 << LIMB))).astype(np.float64))
        rest = sign * (size >> LIMB)
    for a in range(0, len(y), CHUNK):
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                total += (p[a : a + CHUNK].T @ q[a : a + CHUNK]).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums of integers, as Python integers."""
    if x.dtype == object:
        return x.sum(0)
    return ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)


def _cells(sums: dict) -> pa.RecordBatch:
    """(dim, i, j) -> integer, as rows with the integer's places."""
    names = [x.split()[0] for x in CELLS.split(", ")]
    keys, values = list(sums), list(sums.values())
    columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
    for k in range(PLACES):
        top = k == PLACES - 1
        columns.append(pa.array([v >> 32 * k if top else v >> 32 * k & 0xFFFFFFFF for v in values], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, names)


def _sums(batches):
    """A task's count and sums: i -1 has the count, i 0 to d - 1 the sums."""
    total: dict = {}
    for batch in batches:
        for d, at, x in _matrix(batch.column("x")):
            total[d, -1, 0] = total.get((d, -1, 0), 0) + len(at)
            for i, v in enumerate(exact_sum(x).tolist()):
                total[d, i, 0] = total.get((d, i, 0), 0) + v
    yield _cells(total)


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    if int(np.abs(x.astype(np.float64)).max(initial=0)) < 1 << 61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _scatter(centres: dict):
    """A task's products of centred vectors (i <= j), and their sums (i -1)."""

    def run(batches):
        products: dict = {}
        sums: dict = {}
        for batch in batches:
            for d, _, x in _matrix(batch.column("x")):
                y = _centred(x, centres[d])
                products[d] = products.get(d, 0) + exact_product(y)
                sums[d] = sums.get(d, 0) + exact_sum(y)
        out = {(d, i, j): m[i, j] for d, m in products.items() for i in range(d) for j in range(i, d)}
        yield _cells(out | {(d, -1, j): s[j] for d, s in sums.items() for j in range(d)})

    return run


def _collected(rows: DataFrame) -> dict:
    added = rows.groupBy("dim", "i", "j").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(PLACES)])
    return {(r["dim"], r["i"], r["j"]): sum(r[f"p{k}"] << 32 * k for k in range(PLACES)) for r in added.collect()}


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): v[order][:, order] = factor @ factor.T, the factor lower triangular with as many columns as
    v has rank: it ends where what is left of every diagonal entry is rounding."""
    v, d = v.copy(), len(v)
    order, own = np.arange(d), np.diag(v).copy()
    out = np.zeros((d, d))
    for k in range(d):
        left = np.diag(v)[k:]
        real = left > 4 * d * np.finfo(float).eps * own[k:]
        if not real.any():
            return out[:, :k], order
        p = k + int(np.argmax(np.where(real, left, -1)))
        for m in (v, v.T, out):
            m[[k, p]] = m[[p, k]]
        order[[k, p]], own[[k, p]] = order[[p, k]], own[[p, k]]
        out[k:, k] = v[k:, k] / np.sqrt(v[k, k])
        v[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k + 1 :, k])
    return out, order


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of a, rotated in pairs until all are orthogonal. A round rotates disjoint pairs together."""
    a = np.asfortranarray(a.copy())
    n = a.shape[1] + a.shape[1] % 2
    if a.shape[1] < 2:
        return a
    seats = list(range(n))
    for _ in range(sweeps):
        turned = False
        for _ in range(n - 1):
            pairs = [(p, q) for p, q in zip(seats[: n // 2], seats[: n // 2 - 1 : -1], strict=True) if max(p, q) < a.shape[1]]
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > len(a) * np.finfo(float).eps * np.sqrt(xx * yy)
            if turn.any():
                turned = True
                p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
                zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                a[:, p], a[:, q] = c * (x - t * y), c * (y + t * x)
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not turned:
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a positive semidefinite matrix, falling, and unit components as columns, as many as its rank."""
    factor, order = pivoted_cholesky(v)
    columns = one_sided_jacobi(factor)
    norms = np.sqrt((columns * columns).sum(0))
    by = np.argsort(-norms, kind="stable")
    out = np.empty((len(v), len(by)))
    out[order] = columns[:, by] / norms[by]
    sign = np.sign(out[np.abs(out).argmax(0), np.arange(len(by))])
    return norms[by] ** 2, out * sign


@dataclass
class Space:
    """What the fit list of one vector length says; values and components are those asked for."""

    n: int
    sums: list[int]
    centre: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    beyond: np.ndarray  # mean less centre

    def whiten(self, x: np.ndarray) -> np.ndarray:
        y = _centred(x, self.centre).astype(np.float64) - self.beyond
        return y @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = _centred(x, self.centre)
        rest = [self.n * c - s for c, s in zip(self.centre, self.sums, strict=True)]
        most = self.n * int(np.abs(y.astype(np.float64)).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * max(1, len(rest)) < 1 << 62:
            z = y.astype(np.int64) * self.n + np.array(rest, np.int64)
        else:
            z = y.astype(object) * self.n + np.array(rest, object)
        return [int(v) if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """distinct: x, each vector once. The space of each vector length that has a component."""
    sums = _collected(distinct.mapInArrow(_sums, CELLS))
    counts = {d: v for (d, i, _), v in sums.items() if i == -1}
    totals = {d: [sums[d, i, 0] for i in range(d)] for d in counts}
    centres = {d: [(2 * s + n) // (2 * n) for s in totals[d]] for d, n in counts.items()}
    scatter = _collected(distinct.mapInArrow(_scatter(centres), CELLS))
    out = {}
    for d, n in counts.items():
        if not d:
            continue
        rest = [scatter[d, -1, j] for j in range(d)]
        v = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = (n * scatter[d, i, j] - rest[i] * rest[j]) / (n * n)
        values, columns = eigen(v)
        if len(values):
            kept = min(components, len(values))
            out[d] = Space(n, totals[d], centres[d], values[:kept], columns[:, :kept], float(np.trace(v)), np.array([r / n for r in rest]))
    return out


def _whitened(spaces: dict[int, Space]):
    names = [x.split()[0] for x in WHITENED.split(", ")]

    def run(batches):
        for batch in batches:
            for d, at, x in _matrix(batch.column("x")):
                if d not in spaces:
                    continue
                s = spaces[d]
                k, w = len(s.values), s.whiten(x)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                every = lambda values, kind: pa.array(np.repeat(np.array(values, object), k).tolist(), kind)
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, s.n)), every(s.deviation(x), pa.int64()), pa.array(w.ravel()), pa.array(np.tile(s.values / s.trace, len(at)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _projections(spaces: dict[int, Space]):
    def run(batches):
        for batch in batches:
            for d, _, x in _matrix(batch.column("x")):
                if d in spaces:
                    w = spaces[d].whiten(x)
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(w), pa.int32()), pa.array(w.tolist(), pa.list_(pa.float64()))], ["dim", "w"])

    return run


def identity_errors(distinct: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """By vector length, the largest entry of the whitened fit list's covariance less the identity."""
    most = max((len(s.values) for s in spaces.values()), default=0)
    if not most:
        return {}
    w = distinct.mapInArrow(_projections(spaces), "dim int, w array<double>")
    at = lambda i: F.get("w", F.lit(i))
    cells = [F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i in range(most) for j in range(i, most)]
    return {r["dim"]: max(abs(r[f"c{i}_{j}"] - (i == j)) for i in range(len(spaces[r["dim"]].values)) for j in range(i, len(spaces[r["dim"]].values))) for r in w.groupBy("dim").agg(*cells).collect()}


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each usable vector and component."""
    x = integers(vectors, column)
    distinct = stored(x.select("x").distinct(), "whitening-fit")
    spaces = fit(distinct, components)
    errors = identity_errors(distinct, spaces)
    if not spaces:
        return x.limit(0).mapInArrow(_whitened({}), WHITENED).withColumn("identity_error", F.lit(None).cast("double"))
    # one error for all: of vectors of one length as a rule
    return x.mapInArrow(_whitened(spaces), WHITENED).withColumn("identity_error", F.lit(max(errors.values())))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
