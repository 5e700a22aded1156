"""Operator 12: whitening of embeddings by a block Jacobi-Davidson method without a covariance matrix.

A vector's entries c become integers x = floor(64 * c) + SHIFT; n, the sums S and the sums of squares are exact. The covariance V of x
is known only by its products: one pass over the vectors gives V u = sum of ((x - mean) . u) (x - mean) / n for a
block of vectors u, added up by the cluster, so the driver gets a block of the same size and never a row. The whole number
next to the mean is taken off as a long, so that a far mean costs no digits.

* The search space begins with K + EXTRA random directions. A step takes its Ritz pairs (the eigenpairs of V projected on it).
* A leading pair whose residual is down to double precision is locked: it leaves the search space, which stays orthogonal to it.
* For the other wanted pairs (theta, u), residual r, the correction equation (I - QQ')(V - theta)(I - QQ') t = -r with Q the locked
  vectors and the Ritz vectors wanted is solved by MINRES, for all pairs side by side, so that an inner step is one pass.
* The solutions widen the search space; a space that grows beyond MAX_SPACE columns is cut to its leading Ritz vectors.

It ends when all wanted pairs are locked. Numbers of passes don't depend on the number of rows.

Whitened is (x - mean) . u / sqrt(e) in double precision; identity_error is measured on those very values in a further pass.

Defined cases: a vector that is null, empty, holds a null or non-finite entry, an entry of 2**40 or more, or is of
another length than most (of equally many the longer) is left out, and gives no rows; repeated rows and null ids each give theirs; there are min(K, length)
components; a component whose variance is at most 1e-13 of the trace has null for whitened and no part in identity_error (null if none has one); deviation is null
where it does not fit a long; an empty table gives no rows; columns other than vec_id and embedding are not read, so names can't clash.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, materialize, one_thread, read_table

K = 32
SHIFT = 1_000_000
#: Random directions beyond those wanted.
EXTRA = 8
#: Columns of the search space, in multiples of the wanted pairs.
MAX_SPACE = 4
#: Largest residual of a locked pair, relative to the largest eigenvalue: what sums in double precision reach.
TOLERANCE = 1e-13
#: Inner steps of a correction equation, and the part of its residual that may be left.
MAX_INNER, INNER_LEFT = 6, 0.05
MAX_OUTER = 200
_LARGEST = float(1 << 40)


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the entries less SHIFT as longs, of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: F.coalesce((c > -_LARGEST) & (c < _LARGEST), F.lit(False))), F.lit(False))
    rows = embeddings.select("vec_id", e.alias("e")).where(fine)
    length = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").first()
    if length is None:
        return rows.select("vec_id", F.lit(None).cast("array<bigint>").alias("x")).where("false")
    return rows.where(F.size("e") == length["d"]).select("vec_id", F.transform("e", lambda c: F.floor(c * 64).cast("bigint")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def _total(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> np.ndarray | None:
    """The sum over the tasks of what `part` makes of a task's matrices; a task sends it in rows, and the cluster adds them up."""
    schema = "r int, v array<double>"

    def run(batches):
        one_thread()
        got = part(_matrix(b.column(0)) for b in batches if b.num_rows)
        if got is not None:
            got = np.atleast_2d(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got.tolist(), pa.list_(pa.float64()))], names=["r", "v"])

    entries = rows.select("x").mapInArrow(run, schema).select("r", F.posexplode("v").alias("c", "v"))
    sums = entries.groupBy("r", "c").agg(F.sum("v").alias("v")).collect()  # as many as the block has entries
    if not sums:
        return None
    out = np.zeros((max(s["r"] for s in sums) + 1, max(s["c"] for s in sums) + 1))
    for s in sums:
        out[s["r"], s["c"]] = s["v"]
    return out


class Moments:
    """n, sums (less SHIFT) and the trace of the covariance, exact; and products with the covariance."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

        def add(batches):
            n, sums, squares = 0, None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(0))
                if np.abs(x).max() >= 1 << 20:  # sums of squares of a batch may pass a long
                    x = x.astype(object)
                n += len(x)
                more = x.sum(0).astype(object), (x * x).sum(0).astype(object)
                sums, squares = more if sums is None else (sums + more[0], squares + more[1])
            if n:
                whole = [pa.array([decimal.Decimal(int(v)) for v in of], pa.decimal128(38, 0)) for of in (sums, squares)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(np.full(len(sums), n)), *whole], names=["c", "n", "s", "q"])

        parts = rows.select("x").mapInArrow(add, "c int, n long, s decimal(38,0), q decimal(38,0)")
        each = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("c").collect()  # a row a dimension
        self.n = each[0]["n"] if each else 0
        self.sums = [int(r["s"]) for r in each]
        self.trace = sum(self.n * int(r["q"]) - int(r["s"]) ** 2 for r in each) / self.n**2 if self.n else 0.0

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """(x - mean) of a matrix of x: whole numbers near the mean are taken off first, exactly."""
        near = np.array([round(Fraction(s, self.n)) for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s, self.n) - round(Fraction(s, self.n))) for s in self.sums])
        return lambda x: (x - near) - rest

    def product(self, u: np.ndarray) -> np.ndarray:
        """V u for the columns of u: one pass over the vectors."""
        centred, n = self.centred(), self.n

        def part(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for x in blocks:
                y = centred(x)
                more = (y @ u).T @ y
                total = more if total is None else total + more
            return total

        return _total(self.rows, part).T / n


def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of t add to the spaces given."""
    size = np.linalg.norm(t, axis=0)
    t = t[:, size > 0] / size[size > 0]
    for _ in range(2):
        for q in against:
            t = t - q @ (q.T @ t)
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    u = u[:, s > 1e-10]
    for _ in range(2):
        for q in against:
            u = u - q @ (q.T @ u)
        u = np.linalg.qr(u)[0]
    return u


def minres(product: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Approximate solutions t of (I - qq')(V - theta_j)(I - qq') t_j = -r_j, all columns side by side: a product a step."""

    def project(v):
        return v - q @ (q.T @ v)

    v_old, b = np.zeros_like(r), project(-r)
    beta = np.linalg.norm(b, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v = b / first
    t, d1, d2 = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    left, c, s, c_old, s_old, carried = beta.copy(), np.ones(len(theta)), np.zeros(len(theta)), np.ones(len(theta)), np.zeros(len(theta)), np.zeros(len(theta))
    for _ in range(MAX_INNER):
        w = project(product(v) - v * theta)
        alpha = np.sum(v * w, axis=0)
        w = w - v * alpha - v_old * carried
        w = project(w)
        grown = np.linalg.norm(w, axis=0)
        # the newest column of the tridiagonal matrix, turned by the last two rotations and then its own
        eps, bar = s_old * carried, c_old * carried
        delta, gamma_bar = c * bar + s * alpha, -s * bar + c * alpha
        gamma = np.hypot(gamma_bar, grown)
        fine = gamma > 1e-14 * np.abs(theta).max()
        safe = np.where(fine, gamma, 1.0)
        d = np.where(fine, (v - d1 * delta - d2 * eps) / safe, 0.0)
        c_new, s_new = np.where(fine, gamma_bar / safe, 1.0), np.where(fine, grown / safe, 0.0)
        t = t + d * (c_new * left)
        left = -s_new * left
        d2, d1 = d1, d
        c_old, s_old, c, s = c, s, c_new, s_new
        carried, v_old = grown, v
        v = np.where(grown > 1e-14 * first, w / np.where(grown > 0, grown, 1.0), 0.0)
        if (np.abs(left) <= INNER_LEFT * first).all():
            break
    return project(t)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix of d rows, known by its products, and their unit eigenvectors as columns."""
    k = min(k, d)
    start = np.random.default_rng(12).standard_normal((d, min(d, k + EXTRA)))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = np.linalg.qr(start)[0]
    image = product(space)
    for _ in range(MAX_OUTER):
        small = space.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = space @ s, image @ s
        want = min(k - len(values), len(theta))
        residual = au - u * theta - locked @ (locked.T @ au)
        size = np.linalg.norm(residual[:, :want], axis=0)
        good = size <= TOLERANCE * max(theta[0], values.max(initial=0.0), 0.0)
        full = locked.shape[1] + space.shape[1] >= d  # the space holds all there is: these are the pairs
        done = want if full or good.all() else int(np.argmin(good))
        locked, values = np.hstack([locked, u[:, :done]]), np.concatenate([values, theta[:done]])
        if len(values) == k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        u, au, theta, residual, want = u[:, done:], au[:, done:], theta[done:], residual[:, done:], want - done
        if u.shape[1] + want > max(MAX_SPACE * k, k + EXTRA + want):
            u, au = u[:, : want + EXTRA], au[:, : want + EXTRA]
        wide = ~good[done:]
        t = minres(product, theta[:want][wide], np.hstack([locked, u[:, :want]]), residual[:, :want][:, wide])
        t = _orthonormal(t if np.abs(t).max(initial=0.0) > 0 else residual[:, :want], locked, u)
        if not t.shape[1]:
            t = _orthonormal(np.random.default_rng(13).standard_normal((d, EXTRA)), locked, u)
        space, image = np.hstack([u, t]), np.hstack([au, product(t)])
    raise ArithmeticError(f"{k - len(values)} of {k} components did not reach double precision")


def whiten(embeddings: DataFrame, k: int = K) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every vector that takes part and component."""
    schema = T.StructType([embeddings.schema["vec_id"], T.StructField("component", T.IntegerType()), long_field("n"), long_field("deviation"), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    rows = materialize(integers(embeddings), "op12-vectors")
    moments = Moments(rows)
    if not moments.n:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, trace, sums, centred = moments.n, moments.trace, moments.sums, moments.centred()
    if trace > 0:
        values, vectors = jacobi_davidson(moments.product, len(sums), k)
    else:
        values, vectors = np.zeros(min(k, len(sums))), np.eye(len(sums))[:, : min(k, len(sums))]
    live = values > 1e-13 * trace
    scaled = vectors / np.sqrt(np.where(live, values, 1.0))
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def spread(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        """Sums and products of the whitened values."""
        total = None
        for x in blocks:
            w = centred(x) @ scaled[:, live]
            more = np.vstack([w.sum(0), w.T @ w])
            total = more if total is None else total + more
        return total

    error = None
    if live.any():
        total = _total(rows, spread) / n
        error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(int(live.sum()))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        one_thread()
        arrow, most = to_arrow_schema(schema), len(values)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = _matrix(batch.column(1))
                rough = np.square((n * x.astype(float) - np.array(sums, float))).sum(1)
                if n * (np.abs(x).max(initial=0) + 1.0) + max(map(abs, sums)) < 2.0**62 and rough.max(initial=0.0) < 2.0**62:
                    deviation = np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
                else:  # digits beyond a long: one by one
                    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
                    deviation = [v if v < 1 << 63 else None for v in exact]
                w = centred(x) @ scaled
                m = len(x)
                take = pa.array(np.repeat(np.arange(m), most))
                columns = [
                    batch.column(0).take(take), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), m)), pa.array(np.full(m * most, n)), pa.array(deviation, pa.int64()).take(take),
                    pa.array(w.ravel(), mask=~np.tile(live, m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * most), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
