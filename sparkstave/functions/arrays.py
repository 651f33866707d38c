"""Column functions on token lists: cutting, truncation, batches and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTS = "array<int>"


def words(text: Column) -> Column:
    """Words of a text split at white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def first_n(x: Column, n) -> Column:
    return F.slice(x, 1, n)


def cut_at_measure(x: Column, most: int, mark: str = "measure") -> Column:
    """Symbols up to, not with, the last ``mark`` at or before index ``most``; one symbol if there is none; only if longer than ``most``."""
    at = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: F.get(x, i) == mark))
    return F.when(F.size(x) > most, F.slice(x, 1, F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)))).otherwise(x)


def strip_marks(x: Column, bos: int, eos: int) -> Column:
    """Without one leading BOS and one trailing EOS."""
    head = F.coalesce((F.get(x, F.lit(0)) == bos).cast("int"), F.lit(0))
    tail = F.when(F.size(x) - head > 0, F.coalesce((F.element_at(x, -1) == eos).cast("int"), F.lit(0))).otherwise(F.lit(0))
    return F.when(F.size(x) == 0, x).otherwise(F.slice(x, head + 1, F.size(x) - head - tail))


def strip_mark_tuples(x: Column, bos: list[int], eos: list[int]) -> Column:
    """Lists of tuples without one leading BOS tuple and one trailing EOS tuple."""
    row = lambda values: F.array(*[F.lit(v) for v in values])
    head = F.coalesce((F.get(x, F.lit(0)) == row(bos)).cast("int"), F.lit(0))
    tail = F.when(F.size(x) - head > 0, F.coalesce((F.element_at(x, -1) == row(eos)).cast("int"), F.lit(0))).otherwise(F.lit(0))
    return F.when(F.size(x) == 0, x).otherwise(F.slice(x, head + 1, F.size(x) - head - tail))


def with_marks(x: Column, bos: int, eos: int, most: int) -> Column:
    """BOS, at most ``most`` - 2 ids, EOS."""
    return F.concat(F.array(F.lit(bos)).cast(INTS), F.slice(x, 1, most - 2), F.array(F.lit(eos)).cast(INTS))


def cut_generated(x: Column, bos: int, eos: int, pad: int) -> Column:
    """Ids after a leading BOS, up to the first EOS or PAD."""
    head = F.coalesce((F.get(x, F.lit(0)) == bos).cast("int"), F.lit(0))
    body = F.slice(x, head + 1, F.size(x))
    stop = F.array_min(F.filter(F.array(F.array_position(body, eos), F.array_position(body, pad)), lambda p: p > 0))
    return F.when(F.size(x) == 0, x).otherwise(F.slice(body, 1, F.coalesce(stop - 1, F.size(body)).cast("int")))


def measure_starts(x: Column, is_start) -> Column:
    """Index 0 and every index whose entry opens a measure."""
    found = F.when(F.size(x) > 0, F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: is_start(F.get(x, i))))
    return F.array_union(F.array(F.lit(0)), F.coalesce(found, F.array().cast(INTS)))


def prefix_end(starts: Column, k: Column, length: Column) -> Column:
    """End of the first k measures."""
    return F.when(k >= F.size(starts), length).otherwise(F.get(starts, k))


def aligned_cut(target: Column, t_starts: Column, source: Column, s_starts: Column, t_most: int, s_most: int, lookahead: int = 0) -> Column:
    """Truncation of a pair to the most shared measures that, with ``lookahead`` entries more, fit both limits; hard cut if not even one fits.

    A struct of measures, target_end, source_end, aligned (both sides have a boundary to align at), the entries looked ahead on both
    sides, and truncated.
    """
    bound = F.struct(t_starts.alias("t"), s_starts.alias("s"), F.size(target).alias("nt"), F.size(source).alias("ns"))
    last = lambda x: F.least(F.size(x["t"]), F.size(x["s"]))
    base = lambda x, side, k: prefix_end(x[side], k, x[f"n{side}"])
    upto = lambda x, side, k: F.least(x[f"n{side}"], base(x, side, k) + lookahead)
    # Ends never fall as k grows, so the greatest k that fits is the last before the first that doesn't.
    fits = lambda x: F.filter(F.sequence(F.lit(1), last(x)), lambda k: (upto(x, "t", k) <= t_most) & (upto(x, "s", k) <= s_most))

    def cut(x: Column, k: Column) -> Column:
        t_end = F.when(k > 0, upto(x, "t", k)).otherwise(F.least(x["nt"], F.lit(t_most)))
        s_end = F.when(k > 0, upto(x, "s", k)).otherwise(F.least(x["ns"], F.lit(s_most)))
        bounds = (F.array_max(x["t"]) > 0) & (F.array_max(x["s"]) > 0)
        ahead = lambda end, side: F.when(k > 0, end - base(x, side, k)).otherwise(F.lit(0))
        return F.struct(
            k.alias("measures"), t_end.alias("target_end"), s_end.alias("source_end"), ((k > 0) & bounds).alias("aligned"),
            ahead(t_end, "t").alias("target_ahead"), ahead(s_end, "s").alias("source_ahead"), ((t_end < x["nt"]) | (s_end < x["ns"])).alias("truncated"),
        )

    # Lambdas name what is computed once: the starts, and k.
    found = lambda x: F.transform(F.array(F.coalesce(F.array_max(fits(x)), F.lit(0))), lambda k: cut(x, k))[0]
    return F.transform(F.array(bound), found)[0]


def truncated_variants(rows: DataFrame, target: str, sources: dict[str, tuple[str, int]], t_start, s_start, t_most: int, s_most: int, width: int, shape=lambda x: x) -> DataFrame:
    """``rows`` with target and sources cut: each variant is truncated against the target, which is kept up to the longest cut of any.

    ``sources`` names each variant's column of tuples and its lookahead; ``shape`` makes tuples of what is kept, where the column has something else. Beside the cut lists a variant has the columns source_length,
    target_length, measure_count, boundary_aligned, lookahead_target, lookahead_source and truncated, with its name behind.
    """
    out = rows.withColumn("_starts", F.sort_array(measure_starts(F.col(target), t_start)))
    for name, (column, lookahead) in sources.items():
        s_starts = F.sort_array(measure_starts(F.col(column), s_start))
        out = out.withColumn(f"_cut_{name}", aligned_cut(F.col(target), F.col("_starts"), F.col(column), s_starts, t_most, s_most, lookahead))
    out = out.withColumn(target, F.slice(target, 1, F.array_max(F.array(*[F.col(f"_cut_{v}.target_end") for v in sources]))))
    for name, (column, _) in sources.items():
        cut = F.col(f"_cut_{name}")
        out = out.withColumn(column, or_zero_tuple(shape(F.slice(column, 1, cut["source_end"])), width))
        named = {
            "source_length": F.size(column), "target_length": cut["target_end"], "measure_count": cut["measures"], "boundary_aligned": cut["aligned"],
            "lookahead_target": cut["target_ahead"], "lookahead_source": cut["source_ahead"], "truncated": cut["truncated"],
        }
        out = out.withColumns({f"{k}_{name}": c for k, c in named.items()})
    return out.drop("_starts", *[f"_cut_{v}" for v in sources])


def or_zero_tuple(x: Column, width: int) -> Column:
    """An empty list of tuples becomes one tuple of zeros."""
    return F.when(F.size(x) == 0, F.array(F.array_repeat(F.lit(0), width))).otherwise(x)


def clamp(cut: Column, length: Column) -> Column:
    return F.greatest(F.lit(0), F.least(cut, length))


def padded(x: Column, to: Column, pad: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), to - F.size(x)).cast("int")))


def shifted_labels(x: Column, pad: int, ignored: int = -100) -> Column:
    """Labels of a decoder: entries from the second on, padding ignored."""
    return F.transform(F.slice(x, 2, F.size(x)), lambda t: F.when(t == pad, F.lit(ignored)).otherwise(t))


def window_starts(n: Column, length: int, stride: int) -> Column:
    """Starts of sliding windows; the last one ends flush right; a short row has one window."""
    last = F.greatest(F.lit(0), n - length)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def chunk_starts(n: Column, chunk: int, overlap: int) -> Column:
    """Starts of overlapping chunks."""
    return F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(chunk - overlap))
