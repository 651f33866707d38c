"""Batch planning: length buckets, padding, windows, chunks, curriculum draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstave.functions import arrays, scalars


def global_rank(rows: DataFrame, *order: Column, buckets: Column) -> DataFrame:
    """``rank`` from 0 over all rows, in two steps: rows of earlier buckets, then the rank inside one bucket.

    ``buckets`` must rise with the order.
    """
    keyed = rows.withColumn("_bucket", buckets)
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    ranked = keyed.withColumn("_inside", inside).join(offsets, "_bucket")
    return ranked.withColumn("rank", F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before")


def shelf_of(rows: DataFrame, number: str, shelves: int = 64) -> Column:
    """Which of ``shelves`` equal ranges between the least and the greatest value of a numeric column a row lies in; null first."""
    low, high = rows.agg(F.min(number).cast("double"), F.max(number).cast("double")).first()
    if low is None:
        return F.lit(0)
    width = max(high - low, 1.0) / shelves
    return F.coalesce(F.floor((F.col(number) - F.lit(low)) / F.lit(width)), F.lit(-1))


def hash_key(seed: int, *columns: str) -> Column:
    """A number of 52 bits from the MD5 of seed and columns: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), 1, 13), 16, 10).cast("bigint")


def inference_batches(rows: DataFrame, size: int) -> DataFrame:
    """(row_id, n, batch_id): longest rows first, cut into batches of ``size``.

    Ranks are counted in ranges of (length, id), so rows of one common length are spread over tasks too.
    """
    ranked = global_rank(rows, F.desc("n"), F.col("row_id"), buckets=F.struct((-F.col("n")).alias("n"), shelf_of(rows, "row_id").alias("shelf")))
    return ranked.select("row_id", "n", F.floor(F.col("rank") / F.lit(float(size))).alias("batch_id"))


def bucketed_batches(rows: DataFrame, batch: int, multiplier: int, seed: int, epoch: int, drop_last: bool = False) -> DataFrame:
    """(row_id, n, pool, piece, batch_id): rows in hash order cut into pools, each pool sorted by length and cut into batches, batches shuffled.

    ``batch_id`` is a batch's place in the shuffled order. With ``drop_last`` batches that aren't full go before they are numbered.
    """
    keyed = rows.withColumn("key", hash_key(seed + epoch, "row_id"))
    ranked = global_rank(keyed, F.col("key"), F.col("row_id"), buckets=F.shiftright(F.col("key"), 40))
    pool = F.floor(F.col("rank") / F.lit(float(batch * multiplier)))
    ranked = ranked.withColumn("pool", pool)
    inside = F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("n"), "row_id")) - 1
    planned = ranked.withColumn("piece", F.floor(inside / F.lit(float(batch))))
    batches = planned.groupBy("pool", "piece").count()
    batches = (batches.filter(F.col("count") == batch) if drop_last else batches).select("pool", "piece")
    batches = batches.withColumn("batch_key", hash_key(seed + epoch, "pool", "piece"))
    shuffled = global_rank(batches, F.col("batch_key"), F.col("pool"), F.col("piece"), buckets=F.shiftright(F.col("batch_key"), 40))
    return planned.drop("rank").join(shuffled, ["pool", "piece"]).select("row_id", "n", "pool", "piece", F.col("rank").alias("batch_id"))


def longest(rows: DataFrame) -> DataFrame:
    """Rows with ``most``, the greatest ``n`` of their batch."""
    return rows.withColumn("most", F.max("n").over(Window.partitionBy("batch_id")))


def padded_batches(rows: DataFrame, pad: int) -> DataFrame:
    """Ids padded to the longest of their batch, with a mask. Rows that have ``most`` already, from ``longest``, aren't sorted for it with their ids."""
    wide = rows if "most" in rows.columns else longest(rows)
    mask = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("most") - 1), lambda i: i < F.col("n"))
    return wide.select("row_id", "batch_id", arrays.padded(F.col("ids"), F.col("most"), pad).alias("ids"), mask.alias("mask"))


def sliding_windows(rows: DataFrame, length: int, stride: int) -> DataFrame:
    starts = rows.select("row_id", "ids", F.explode(arrays.window_starts(F.size("ids"), length, stride)).alias("at"))
    return starts.select("row_id", "at", F.slice("ids", F.col("at") + 1, F.lit(length)).alias("ids"))


def random_crop(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """A window at a repeatable random place; short rows whole."""
    room = F.greatest(F.lit(0), F.size("ids") - length)
    at = F.floor(scalars.stable_uniform(seed, F.col("row_id").cast("string")) * (room + 1)).cast("int")
    return rows.select("row_id", at.alias("at"), F.slice("ids", at + 1, F.lit(length)).alias("ids"))


def chunked(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks (row_id, chunk_no, ids)."""
    starts = rows.select("row_id", "ids", F.posexplode(arrays.chunk_starts(F.size("ids"), chunk, overlap)).alias("chunk_no", "at"))
    return starts.select("row_id", "chunk_no", F.slice("ids", F.col("at") + 1, F.lit(chunk)).alias("ids"))


def stitched(chunks: DataFrame, overlap: int) -> DataFrame:
    """Chunks joined again: later ones without their first ``overlap`` ids."""
    own = F.when(F.col("chunk_no") == 0, F.col("ids")).otherwise(F.slice("ids", overlap + 1, F.greatest(F.size("ids"), F.lit(1))))
    listed = F.array_sort(F.collect_list(F.struct("chunk_no", own.alias("ids"))))
    return chunks.groupBy("row_id").agg(F.flatten(F.transform(listed, lambda x: x["ids"])).alias("ids"))


def stage_of(epoch: Column, stages: dict[int, int]) -> Column:
    """The stage whose start is the last one at or before ``epoch``."""
    out = F.lit(None).cast("int")
    for start, stage in sorted(stages.items()):
        out = F.when(epoch >= start, F.lit(stage)).otherwise(out)
    return out


def expected_length(variants: dict[str, tuple[float, Column, Column]], source_cap: int, target_cap: int, mode: str = "target_only", source_weight: float = 1.0) -> Column:
    """Length of a row that buckets go by: over variants, probability times capped length plus two marks, of the target, the source, or both.

    ``variants`` has probability, source length and target length. ``mode`` is target_only, source_only or combined (target and weighted source).
    """
    total = lambda side, cap: sum((F.lit(v[0]) * (F.least(v[side], F.lit(cap)) + 2) for v in variants.values()), F.lit(0.0))
    if mode == "target_only":
        return total(2, target_cap)
    if mode == "source_only":
        return total(1, source_cap)
    if mode != "combined":
        raise ValueError(f"unknown mode {mode!r}")
    return total(2, target_cap) + F.lit(source_weight) * total(1, source_cap)


def stage_shares(weights: dict[str, float]) -> dict[str, float]:
    """Probabilities of a stage; all equal if they sum to 0."""
    total = sum(weights.values())
    return {k: (w / total if total else 1.0 / len(weights)) for k, w in weights.items()}


def curriculum_examples(rows: DataFrame, weights: dict[str, float], seed: int, epoch: int, most: int) -> DataFrame:
    """One training example per row: a drawn variant, marks stripped, trimmed and put back."""
    u = scalars.stable_uniform(seed + epoch, F.col("row_id").cast("string"))
    variant = scalars.variant_of(u, stage_shares(weights))
    drawn = rows.withColumn("variant", variant)
    source = scalars.chosen(F.col("variant"), {"clean": F.col("src_ids"), "light": F.slice("src_ids", 1, 20), "heavy": F.slice("src_ids", 1, 10)})
    return drawn.select("row_id", "variant", source.alias("source"), arrays.with_marks(arrays.strip_marks(F.col("lmx_ids"), 1, 2), 1, 2, most).alias("target"))
