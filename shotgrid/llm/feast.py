"""Operator 12: embedding whitening with components found by FEAST contour integration.

1. A vector's entries become whole numbers ``x = floor(256 * c)``; the fit list is the distinct x
   vectors, written once (packed at the smallest integer width that holds a vector, so equal
   vectors are equal bytes).
2. Two passes over the fit list: exact sums S, then the covariance V of the centred vectors
   (divisor n).  A task adds up its own rows; what moves is one d x d matrix per task, row by row.
3. The driver works on V alone (d x d).  Inertia counts (negative pivots of a symmetric block
   factorisation of V - sI, Sylvester's law) bisect for an interval that holds the wanted largest
   eigenvalues.  FEAST projects a random block onto the interval's eigenspace by Gauss-Legendre
   quadrature of the complex shifted solves ``(zI - V)^-1 Y`` on a half circle around it, and
   Rayleigh-Ritz on the projected block gives eigenpairs; this is repeated until the residuals
   are at rounding level.  The pairs inside the interval must be as many as the inertia counts
   say: otherwise the block grows and the search starts again.
4. A pass over the fit list measures the whitened covariance's distance from the identity; a
   map-only pass over the table returns the whitened coordinates.

Defined cases: rows with a null vector, or with a null, NaN or infinite entry, are dropped, and so
are entries beyond 2**54 in size (x would leave the long range); vectors of another length than
the most frequent one (ties: the longest) and empty vectors can't be compared and are dropped;
repeated rows count once in the fit and are returned each; a null vec_id is kept; directions
without variance are no components, so constant or single vectors and an empty table give no rows;
components with equal eigenvalues are any orthonormal choice; columns other than ``vec_id`` and
``embedding`` are ignored.  The sum of squares must fit a long, else the query raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm.common import freeing, over_batches, stored

SCALE, COMPONENTS = 256, 4
LARGEST = 2.0 ** 54
POINTS, ROUNDS = 8, 60
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


# ------------------------------------------------------------------------ symmetric eigenpairs
def inertia_below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` below ``shift``: negative pivots of a symmetric
    factorisation of ``v - shift I`` with 1 x 1 and 2 x 2 pivots (a 2 x 2 pivot has one)."""
    a, count = v - shift * np.eye(len(v)), 0
    while len(a):
        diag = np.abs(np.diag(a))
        p = int(np.argmax(diag))
        off = np.abs(np.tril(a, -1))
        r, s = np.unravel_index(int(np.argmax(off)), off.shape)
        if diag[p] == 0 and off[r, s] == 0:
            break
        one = diag[p] >= 0.64 * off[r, s]
        pivot = [p] if one else [int(s), int(r)]
        count += int(a[p, p] < 0) if one else 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return count


def top_interval(v: np.ndarray, k: int) -> tuple[float, float, int]:
    """(lo, hi, m): an interval with the k largest eigenvalues of ``v`` and m in all; m is k
    unless the k-th eigenvalue can't be told from the next.  lo lies inside the gap."""
    d, hi = len(v), float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    if k == d:
        return -hi, hi, d
    above, below = -hi, hi                      # more than k eigenvalues above; fewer than k or k
    while below - above > 1e-13 * hi:
        mid = (above + below) / 2
        m = d - inertia_below(v, mid)
        if m == k:
            low, high = (above, mid), (mid, below)
            for _ in range(20):                 # both ends of the gap
                x = sum(low) / 2
                low = (low[0], x) if d - inertia_below(v, x) == k else (x, low[1])
                x = sum(high) / 2
                high = (x, high[1]) if d - inertia_below(v, x) == k else (high[0], x)
            return (low[1] + high[0]) / 2, hi, k
        above, below = (mid, below) if m > k else (above, mid)
    return above, hi, d - inertia_below(v, above)


def feast(v: np.ndarray, lo: float, hi: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m eigenpairs of the symmetric ``v`` inside (lo, hi), values falling, vectors as
    columns; ``m`` is the interval's inertia count."""
    d, scale = len(v), max(float(np.abs(v).max()), np.finfo(float).tiny)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi * (nodes + 1) / 2)
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    size = min(d, m + max(2, m // 2))
    while True:
        block = np.random.default_rng(1).standard_normal((d, size))
        for _ in range(ROUNDS):
            projected = np.zeros((d, size))
            for w, t in zip(weights, turn, strict=True):
                z = centre + radius * t
                projected += w / 2 * (radius * t * np.linalg.solve(z * np.eye(d) - v, block.astype(complex))).real
            basis, _ = np.linalg.qr(projected)
            values, small = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ small
            inside = np.flatnonzero((values > lo) & (values < hi))
            residual = np.abs(v @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0.0)
            if len(inside) == m and residual <= 64 * np.finfo(float).eps * d * scale:
                order = inside[::-1]
                return values[order], block[:, order]
        if size == d:
            raise ArithmeticError(f"{len(inside)} of {m} eigenvalues found in ({lo}, {hi}), residual {residual}")
        size = min(d, 2 * size)


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance that are above rounding level, falling, and their unit
    vectors as columns (largest entry positive)."""
    floor = len(v) ** 2 * np.finfo(float).eps * float(np.trace(v))
    k = min(k, len(v) - inertia_below(v, floor)) if floor > 0 else 0
    if k == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    values, vectors = feast(v, *top_interval(v, k))
    values, vectors = values[:k], vectors[:, :k]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])


# ------------------------------------------------------------------------------- Spark passes
def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(rows with finite vectors of the most frequent length, that length or 0)."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") \
        .where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("embedding") == most["d"]), most["d"]) if most else (rows, 0)


def whole_numbers(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(flat * SCALE).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    low, high = x.min(), x.max()
    kind = next(t for t in _WIDTHS if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    out = np.empty((len(column), d), np.int64)
    for i, b in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(b, f"i{len(b) // d}")
    return out


def fit_list(rows: DataFrame, d: int) -> DataFrame:
    """Each distinct x vector once (``x``, packed)."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"x": list({_packed(x) for x in whole_numbers(batch.column(0), d)})}

    return stored(over_batches(rows.select("embedding"), run, "x binary").distinct(), "vectors")


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, exact sums per dimension) of the fit list."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        x = _unpacked(batch.column(0), d)
        half = np.int64(32)                     # high and low words apart: no overflow
        yield {"n": [len(x)], "high": [(x >> half).sum(axis=0)], "low": [(x & 0xFFFFFFFF).sum(axis=0)]}

    rows = over_batches(fit, run, "n long, high array<long>, low array<long>")
    n = rows.agg(F.sum("n")).first()[0] or 0
    parts = rows.select(F.posexplode(F.arrays_zip("high", "low"))).groupBy("pos").agg(
        F.sum(F.col("col.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("col.low").cast("decimal(38,0)")).alias("low"))
    by = {r["pos"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.collect()}
    return n, [by[i] for i in range(d)] if n else []


def moments(fit: DataFrame, d: int, width: int, f) -> np.ndarray:
    """Sum over the fit list of the outer products of the rows of ``f(x)``: one matrix per task,
    added up row by row."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            y = f(_unpacked(batch.column(0), d))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = fit.mapInArrow(freeing(run), "i int, row array<double>")
    added = rows.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s")).select("i", vector_to_array("s").alias("s"))
    return np.array([r["s"] for r in sorted(added.collect(), key=lambda r: r["i"])])


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = usable(vectors)
    fit = fit_list(rows, d) if d else None
    n, total = sums(fit, d) if d else (0, [])
    if n < 2:
        return spark.createDataFrame([], schema)
    mean = np.array([s / n for s in total])
    v = moments(fit, d, d, lambda x: x - mean) / n
    v = (v + v.T) / 2
    values, vectors_ = components(v, k)
    if not len(values):
        return spark.createDataFrame([], schema)
    project = vectors_ / np.sqrt(values)
    # the covariance of (1, whitened): its first row holds the whitened means
    both = moments(fit, d, len(values) + 1, lambda x: np.hstack([np.ones((len(x), 1)), (x - mean) @ project])) / n
    covariance = both[1:, 1:] - np.outer(both[0, 1:], both[0, 1:])
    error = float(np.abs(covariance - np.eye(len(values))).max())
    explained = values / np.trace(v)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        x = whole_numbers(batch.column("embedding"), d)
        largest = n * max(int(np.abs(x).max(initial=0)), 0) + max(abs(s) for s in total)
        z = (n * x - np.array(total, np.int64)) if largest < 2 ** 62 else n * x.astype(object) - np.array(total, object)
        squares = (z * z).sum(axis=1) if largest ** 2 * d < 2 ** 63 else [sum(int(e) ** 2 for e in r) for r in z]
        white = (x - mean) @ project
        m = len(values)
        yield {"vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), m))),
               "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), "n": np.full(len(x) * m, n),
               "deviation": np.repeat(np.array(squares, np.int64), m), "whitened": white.ravel(),
               "explained": np.tile(explained, len(x)), "identity_error": np.full(len(x) * m, error)}

    return over_batches(rows, run, schema)


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_feast_whitening": op12_feast_whitening}
