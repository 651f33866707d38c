"""Scalar column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of lists whose tokens are numbered at a time.
FEW = 100


def safe_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(x).try_cast("int"), F.lit(default))


def local_name(tag: Column) -> Column:
    """A tag without its namespace."""
    return F.regexp_replace(tag, r"^[^}]*\}", "")


def round_time(x: Column) -> Column:
    return F.round(x, 6)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def token_distance(x: list, y: list) -> int:
    """Levenshtein distance of two lists: by diagonals while the distance is small, else by columns of bits."""
    number: dict = {}
    return number_distance(*(np.fromiter((number.setdefault(t, len(number)) for t in side), np.int64, len(side)) for side in (x, y)))


def number_distance(a: np.ndarray, b: np.ndarray) -> int:
    """The same of two arrays of numbers."""
    n = min(len(a), len(b))
    head = _run(a, b, 0, 0)
    tail = _run(a[head:][::-1], b[head:][::-1], 0, 0) if head < n else 0
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    near = diagonal_distance(a, b, max(16, int((len(a) * len(b)) ** 0.5) // 64))
    return bit_distance(a.tolist(), b.tolist()) if near is None else near


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many tokens from ``i`` and ``j`` on are equal."""
    done, step, n = 0, 16, min(len(a) - i, len(b) - j)
    while done < n:
        apart = a[i + done : i + min(done + step, n)] != b[j + done : j + min(done + step, n)]
        first = int(apart.argmax())
        if apart[first]:
            return done + first
        done, step = done + len(apart), step * 4
    return n


def diagonal_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The distance if it is at most ``most``, from how far each diagonal gets with 0, 1, 2, ... edits: the time goes with the length plus the square of the distance."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    far = {0: _run(a, b, 0, 0)}  # by j - i: the furthest i
    for edits in range(most + 1):
        if far.get(m - n, -1) >= n:
            return edits
        now = {}
        for k in range(max(-n, -edits - 1), min(m, edits + 1) + 1):
            i = min(max(far.get(k, -2) + 1, far.get(k - 1, -1), far.get(k + 1, -2) + 1), n, m - k)
            if i >= max(0, -k):
                now[k] = i + _run(a, b, i, i + k)
        far = now
    return None


def bit_distance(x: list, y: list) -> int:
    """One column of the table is a few integers with a bit per token of ``x``."""
    if not len(x):
        return len(y)
    places: dict = {}
    for i, token in enumerate(x):
        places[token] = places.get(token, 0) | 1 << i
    every, last, score = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = every, 0  # where the table rises and falls from row to row
    for token in y:
        same = places.get(token, 0)
        falls_across = (((same & up) + up) ^ up) | same
        rises = (down | ~(falls_across | up)) & every
        falls = up & falls_across
        score += bool(rises & last) - bool(falls & last)
        rises, falls = rises << 1 | 1, falls << 1
        up, down = (falls | ~(same | down | rises)) & every, rises & (same | down) & every
    return score


def edit_distance(x: Column, y: Column) -> Column:
    """Levenshtein distance of two token lists, with any number of distinct tokens; null where a list is null.

    Tokens are numbered in Arrow, FEW rows at a time: as Python strings those of a whole batch would take many times its bytes.
    """

    @F.arrow_udf("int")
    def distance(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for at in range(0, len(xs), FEW):
            few = [side.slice(at, FEW) for side in (xs, ys)]
            tokens = pa.chunked_array([side.flatten() for side in few]).combine_chunks()
            number = pc.fill_null(pc.dictionary_encode(tokens).indices, -1).to_numpy().astype(np.int64)
            sizes = np.concatenate([pc.fill_null(side.value_lengths(), 0).to_numpy() for side in few])
            lists = np.split(number, np.cumsum(sizes)[:-1])
            known = pc.and_(few[0].is_valid(), few[1].is_valid()).to_pylist()
            out += [number_distance(a, b) if both else None for a, b, both in zip(lists[: len(known)], lists[len(known) :], known, strict=True)]
        return pa.array(out, pa.int32())

    return distance(x, y)


def normalized_distance(distance: Column, truth: Column) -> Column:
    return distance / F.greatest(F.size(truth), F.lit(1))


def stable_uniform(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) from the first 8 bytes of SHA-256 of ``seed:key``."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def normalized_ratios(ratios: dict[str, float]) -> dict[str, float]:
    """Shares that add up to 1; an error for a negative ratio or none above 0."""
    total = sum(ratios.values())
    if total <= 0 or any(r < 0 for r in ratios.values()):
        raise ValueError("ratios must not be negative and must have a positive sum")
    return {k: r / total for k, r in ratios.items()}


def variant_of(u: Column, ratios: dict[str, float]) -> Column:
    """The variant in whose cumulative share ``u`` lies."""
    upto, out, names = 0.0, None, list(ratios)
    for name in names[:-1]:
        upto += ratios[name]
        out = F.when(u < upto, F.lit(name)) if out is None else out.when(u < upto, F.lit(name))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


def chosen(variant: Column, columns: dict[str, Column]) -> Column:
    """The column of the row's variant."""
    out = F
    for name, column in columns.items():
        out = out.when(variant == name, column)
    return out


def voice(x: Column) -> Column:
    """A voice label, null for empty and ``None``."""
    return F.when((x == "") | (x == "None"), F.lit(None)).otherwise(x)


def sanitized_id(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.translate(x, "/\\", "__")), F.lit("")), F.lit("sample"))


def joined_errors(errors: Column) -> Column:
    return F.nullif(F.array_join(errors, "|"), F.lit(""))


def typed_text(x: Column) -> Column:
    """A struct with the kind of a text value and its parts: null, bool, int, float or string."""
    low = F.lower(F.trim(x))
    as_int, as_float = x.try_cast("bigint"), x.try_cast("double")
    kind = (
        F.when(low.isin("null", "none") | low.isNull(), F.lit("null")).when(low.isin("true", "false"), F.lit("bool"))
        .when(as_int.isNotNull(), F.lit("int")).when(as_float.isNotNull(), F.lit("float")).otherwise(F.lit("string"))
    )
    return F.struct(
        kind.alias("kind"), F.when(kind == "bool", low == "true").alias("bool"), F.when(kind == "int", as_int).alias("int"),
        F.when(kind == "float", as_float).alias("float"),
    )


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def ticks_per_ms(tpq: Column, bpm: Column) -> Column:
    return tpq * bpm / 60000.0


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; two zero vectors are equal, one is unlike all others."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    nx, ny = F.sqrt(dot(x, x)), F.sqrt(dot(y, y))
    return F.when((nx == 0) & (ny == 0), F.lit(1.0)).when((nx == 0) | (ny == 0), F.lit(0.0)).otherwise(dot(x, y) / (nx * ny))
