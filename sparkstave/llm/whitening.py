"""Whitening of embeddings on leading components found by spectrum slicing.

Entries become whole numbers, so the sums behind mean and covariance are exact and the same in any order: tasks
add up vectors and products of rows that were centred at whole numbers next to the mean, Spark adds up the tasks' sums, and only
those of the dimensions (d * (d + 1) / 2 numbers, whatever the number of rows) reach the driver.

There, LDL' factors of the shifted covariance tell how many eigenvalues lie above the shift (Sylvester's law of inertia).
Bisection by these counts isolates each leading eigenvalue, Rayleigh quotient iteration inside its interval converges cubically, and
counts on both sides of the result certify its number. Eigenvalues that counts can't tell apart at double precision are one interval; their vectors are
made orthogonal to each other.

Defined results: rows whose vector is null or holds a null or non-finite element go, and so do those that haven't the commonest
length (of equally common ones the longest counts), as they have no place in the space; a null or repeated id and repeated vectors are rows like any other; with fewer
dimensions than components all are returned; a component without variance has a null ``whitened`` (0 / 0) and stays out of
``identity_error``, which is 0 if there is no other; a ``deviation`` beyond a long is null; a table without such
vectors gives no rows. Only the two named columns are read, so others can't clash. Entries are below 2 ** 46 in size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Vectors taken at once in a task.
RUN = 1 << 12
EPS = float(np.finfo(float).eps)
EXACT = 1 << 53
LONG = 1 << 63
SUMS = "i int, j int, total decimal(38,0)"
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, x) of the vectors that can be used, as whole numbers and of one length."""
    bad = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias(vector_col)).filter(F.col(vector_col).isNotNull() & ~bad)
    whole = F.transform(vector_col, lambda v: F.floor(v.cast("double") * SCALE) + OFFSET)
    rows = rows.select("vec_id", whole.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"].alias("d"))
    length = lengths.first()["d"] or 0
    return rows.filter(F.size("x") == length)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with their vectors as one matrix."""
    for batch in batches:
        for at in range(0, len(batch), RUN):
            part = batch.slice(at, RUN)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _sums(i: np.ndarray, j: np.ndarray, totals: list[int]) -> pa.RecordBatch:
    return pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))})


def gathered(rows: DataFrame, partial: Callable, value_type: str) -> dict[tuple[int, int], object]:
    """The tasks' partial sums added up by (i, j)."""
    summed = rows.mapInArrow(partial, f"i int, j int, total {value_type}").groupBy("i", "j").agg(F.sum("total").alias("total"))
    return {(r["i"], r["j"]): r["total"] for r in summed.collect()}


class Moments:
    """Exact count, sums and covariance of whole vectors.

    ``centre`` are whole numbers next to the mean, ``rest`` the sums of what vectors lie beside them, so
    ``n * x - S`` is ``n * (x - centre) - rest``.
    """

    def __init__(self, rows: DataFrame):
        def sums(batches):
            n, total = 0, None
            for _, x in _runs(batches):
                part = [int(v) for v in x.sum(axis=0, dtype=np.int64)]
                n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            if n:
                at = np.arange(-1, len(total))
                yield _sums(at, at, [n, *total])

        found = gathered(rows, sums, "decimal(38,0)")
        self.n = int(found.pop((-1, -1), 0))
        self.d = len(found)
        self.sums = [int(found[k, k]) for k in range(self.d)]
        self.centre = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]

    def covariance(self, rows: DataFrame) -> np.ndarray:
        """Divisor n; every entry is the double next to its exact value."""
        centre, d, n = np.array(self.centre, np.int64), self.d, self.n
        i, j = np.triu_indices(d)

        def products(batches):
            total = None
            for _, x in _runs(batches):
                z = x - centre
                exact = float(np.abs(z).max(initial=0)) ** 2 * len(z) < EXACT  # else products of doubles might round
                part = (z.astype(float).T @ z.astype(float)).astype(np.int64) if exact else z.astype(object).T @ z.astype(object)
                part = [int(v) for v in part[i, j]]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            if total is not None:
                yield _sums(i, j, total)

        found = gathered(rows, products, "decimal(38,0)")
        out = np.zeros((d, d))
        for (a, b), g in found.items():
            out[a, b] = out[b, a] = (n * int(g) - self.rest[a] * self.rest[b]) / (n * n)
        return out


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` lie above ``shift``: the positive pivots of an LDL' factorisation (Bunch and Kaufman's pivots)."""
    a = v - shift * np.eye(len(v))
    n, k, above = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        wide = False
        beside = np.abs(a[k + 1 :, k])
        most = beside.max(initial=0.0)
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(beside.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most * most:
                wide = abs(a[r, r]) < alpha * row.max()
                swap(k + wide, r)
        if wide:
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            above += int((np.linalg.eigvalsh(block) > 0).sum())
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        elif a[k, k] != 0:
            above += int(a[k, k] > 0)
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k] / a[k, k])
        k += 1 + wide
    return above


def isolated(v: np.ndarray, most: int) -> list[tuple[int, int, float, float]]:
    """Intervals (first number, last number, low, high) of the leading eigenvalues, numbered from 1 by falling value.

    An interval holds one eigenvalue, or several that doubles can't tell apart.
    """
    scale = float(np.abs(v).sum(axis=0).max(initial=0.0))  # no eigenvalue is larger
    narrow = 4 * len(v) * EPS * scale
    low, high = -narrow, scale + narrow
    todo, out = [(low, count_above(v, low), high, count_above(v, high))], []
    while todo:
        low, upto, high, before = todo.pop()
        if upto == before or before >= most:
            continue
        middle = (low + high) / 2
        if upto == before + 1 or high - low <= narrow or not low < middle < high:
            out.append((before + 1, upto, low, high))
            continue
        inner = count_above(v, middle)
        todo += [(low, upto, middle, inner), (middle, inner, high, before)]
    return sorted(out)


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    d = len(v)
    scale = float(np.abs(v).sum(axis=0).max(initial=0.0))
    if scale == 0:  # any vectors will do
        return np.zeros(min(most, d)), np.eye(d)[:, :most]
    tiny = 4 * d * EPS * scale
    rng = np.random.default_rng(13)
    values: list[float] = []
    vectors: list[np.ndarray] = []

    def apart(x: np.ndarray, value: float) -> np.ndarray:
        """``x`` at length 1 and orthogonal to the vectors of eigenvalues close by."""
        near = [q for e, q in zip(values, vectors, strict=True) if abs(e - value) <= 1e-3 * scale]
        for _ in range(2):
            for q in near:
                x = x - (q @ x) * q
            x = x / np.linalg.norm(x)
        return x

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, 1.0, 3.0, 9.0):
            try:
                y = np.linalg.solve(v - (shift + nudge * EPS * scale) * np.eye(d), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                return y
        raise ArithmeticError("no shift near the eigenvalue gives a regular matrix")

    def iterated(low: float, high: float) -> tuple[float, np.ndarray] | None:
        """Inverse iteration at the middle, then with Rayleigh quotients; None if it leaves the interval."""
        shift = (low + high) / 2
        x = apart(rng.standard_normal(d), shift)
        for _ in range(2):
            x = apart(solved(shift, x), shift)
        best = (float("inf"), 0.0, x)
        for _ in range(12):
            value = float(x @ v @ x)
            if not low - tiny <= value <= high + tiny:
                return None
            off = float(np.linalg.norm(v @ x - value * x))
            if off >= best[0] / 2 and best[0] <= tiny:
                break
            best = min(best, (off, value, x), key=lambda b: b[0])
            x = apart(solved(value, x), value)
        return best[1:] if best[0] <= tiny else None

    for first, last, low, high in isolated(v, most):
        for number in range(first, min(last, most) + 1):
            while (pair := iterated(low, high)) is None:
                middle = (low + high) / 2
                if high - low <= tiny or not low < middle < high:
                    raise ArithmeticError(f"eigenvalue {number} was isolated but not reached")
                low, high = (middle, high) if count_above(v, middle) >= number else (low, middle)
            value, x = pair
            if (value - 2 * tiny > low and count_above(v, value - 2 * tiny) < number) or (value + 2 * tiny < high and count_above(v, value + 2 * tiny) >= number):
                raise ArithmeticError(f"the count certifies another number than {number}")
            values.append(value)
            vectors.append(x)
    e = np.array(values)
    e[e <= tiny] = 0.0
    return e, np.array(vectors).reshape(len(e), d).T


def whitened(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_vectors(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    moments = Moments(rows)
    if not moments.d:
        return spark.createDataFrame([], OUT).select(F.lit(None).cast(dict(vectors.dtypes)[id_col]).alias("vec_id"), *[c.split()[0] for c in OUT.split(", ")[1:]])
    covariance = moments.covariance(rows)
    e, axes = leading(covariance, most)
    k, n, trace = len(e), moments.n, float(np.trace(covariance))
    live = e > 0
    root = np.sqrt(np.where(live, e, 1.0))
    explained = e / trace if trace > 0 else np.zeros(k)
    centre, rest = np.array(moments.centre, np.int64), moments.rest
    beside = np.array([r / n for r in rest])

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - beside) @ axes / root

    def products(batches):
        """Sums of products; the values are centred already, as the mean was taken off before they were projected."""
        total, i, j = None, *np.triu_indices(k)
        for _, x in _runs(batches):
            w = projected(x)
            part = np.concatenate(((w.T @ w)[i, j], w.sum(axis=0)))
            total = part if total is None else total + part
        if total is not None:
            own = np.arange(k)
            yield pa.record_batch({"i": pa.array(np.concatenate((i, own)), pa.int32()), "j": pa.array(np.concatenate((j, own * 0 - 1)), pa.int32()), "total": pa.array(total)})

    found = gathered(rows, products, "double")
    mean = [found[a, -1] / n for a in range(k)]
    error = max((abs(found[a, b] / n - mean[a] * mean[b] - (a == b)) for a in range(k) for b in range(a, k) if live[a] and live[b]), default=0.0)

    def deviations(x: np.ndarray) -> list[int | None]:
        z = x - centre
        largest = int(np.abs(z).max(initial=0)) * n + max(abs(r) for r in rest)
        if largest * largest * z.shape[1] < LONG:
            return ((z * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        y = z.astype(object) * n - np.array(rest, object)
        return [int(v) if v < LONG else None for v in (y * y).sum(axis=1)]

    def written(batches):
        for part, x in _runs(batches):
            w = np.ascontiguousarray(projected(x))
            m = len(x)
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            off = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.record_batch(
                {
                    "vec_id": ids,
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": off,
                    "whitened": pa.array(w.ravel(), mask=np.tile(~live, m)),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
            )

    return rows.mapInArrow(written, OUT.replace("vec_id bigint", f"vec_id {dict(rows.dtypes)['vec_id']}"))
