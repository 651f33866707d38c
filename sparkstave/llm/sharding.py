"""Sharding by fixed virtual slots (DataFrame functions only).

Records hash into a fixed number of virtual slots. Bytes are summed per slot, and
a small versioned table maps slots to shards. Only that table changes when shards
are added or drift apart: records never hash anew, and only the records of edited
slots move.

A record's slot comes from an MD5 of its id, CRC, size and its number among records that are equal in all of
these, so that any number of equal records spreads over the slots.

Defined results: a null text counts no bytes beside the fixed 8 per row and has
the CRC of the empty text; rows with a null or repeated id are records like any
other; an empty table gives no rows and an empty map; columns other than the
two named ones are not read, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkstave.session import stored

N_SLOTS = 4096
ROW_BYTES = 8
SLACK = 0.01


def slotted(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """One narrow row per record: doc_id, size, text_crc32, ``again`` (its number among equal records) and its virtual slot."""
    rows = records.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        (F.octet_length("text").cast("bigint") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.spark_partition_id().alias("part"),
    )
    rows = numbered(stored(rows, "records"), ["doc_id", "text_crc32", "size"]).drop("part")
    label = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size", "again")
    return rows.withColumn("virtual_slot", (F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("bigint") % n_slots).cast("int"))


def numbered(rows: DataFrame, own: list[str]) -> DataFrame:
    """``again``: 0, 1, ... among rows that are equal in the columns ``own``, whichever is which; ``rows`` are written, with the ``part`` they stood in.

    Only repeated rows are ranked: in their part of the table, behind those of earlier parts, so a task never holds a group. Without repeated rows
    nothing is joined.
    """
    parts = rows.groupBy(*own, "part").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*own)
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    many = parts.withColumn("all", F.sum("n").over(group)).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    many = stored(many.filter("all > 1").select(*[F.col(c).alias(f"_{c}") for c in (*own, "part")], "before"), "repeats")
    first = F.lit(0).cast("bigint").alias("again")
    if many.isEmpty():
        return rows.select(*rows.columns, first)
    equal = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*own, "part")))
    single = rows.join(many, equal, "left_anti").select(*rows.columns, first)
    inside = F.row_number().over(Window.partitionBy(*own, "part").orderBy("before"))
    repeated = rows.join(many, equal).select(*rows.columns, (F.col("before") + inside - 1).alias("again"))
    return single.unionByName(repeated)


def slot_totals(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot; never more rows than there are slots."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))


def _element(array: Column, index0: Column) -> Column:
    return F.element_at(array, (index0 + 1).cast("int"))


def _with_element(array: Column, index0: Column, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == index0, value).otherwise(x))


def slot_map(totals: DataFrame, n_shards: int) -> DataFrame:
    """First map: slots by falling bytes, each to the shard with the least so far.

    The fold runs in SQL over one array of at most ``n_slots`` entries, whatever
    the number of records.
    """
    heavy_first = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "n_rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), n_shards).alias("loads"),
        F.array().cast("array<int>").alias("owners"),
    )

    def give(state: Column, slot: Column) -> Column:
        loads = state["loads"]
        to = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        return F.struct(
            _with_element(loads, to, _element(loads, to) - slot["minus"]).alias("loads"),
            F.concat(state["owners"], F.array(to)).alias("owners"),
        )

    one = totals.agg(heavy_first.alias("slots")).withColumn("owners", F.aggregate("slots", start, give)["owners"])
    pairs = one.select(F.explode(F.arrays_zip("slots", "owners")).alias("x"))
    return pairs.select(
        F.col("x.slots.virtual_slot").alias("virtual_slot"),
        F.col("x.slots.n_rows").alias("n_rows"),
        (-F.col("x.slots.minus")).alias("bytes"),
        F.col("x.owners").alias("shard"),
    )


def rebalanced(current: DataFrame, totals: DataFrame, n_shards: int) -> DataFrame:
    """Edit a map for new totals or more shards, moving as few slots as suffice.

    Heavy slots are looked at first. A slot leaves its shard only while that shard lies above the mean,
    stays no more than a hundredth below it without the slot, and the lightest shard stays a
    hundredth below it with the slot: small differences move nothing. Slots that the current map doesn't know start on the lightest shard.
    """
    now = totals.join(F.broadcast(current.select("virtual_slot", F.col("shard").alias("old"))), "virtual_slot", "left")
    slots = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "n_rows", "old")))
    one = now.agg(slots.alias("slots"), F.sum("bytes").alias("all"))
    shards = F.sequence(F.lit(0), F.lit(n_shards - 1))
    load_of = lambda k: F.aggregate(
        F.filter("slots", lambda s: s["old"] == k), F.lit(0).cast("bigint"), lambda a, s: a - s["minus"]
    )
    start = F.struct(F.transform(shards, load_of).alias("loads"), F.array().cast("array<int>").alias("owners"))
    mean = F.col("all") / F.lit(float(n_shards))

    def edit(state: Column, slot: Column) -> Column:
        loads, size = state["loads"], -slot["minus"]
        low = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        known = slot["old"].isNotNull()
        here = _element(loads, F.coalesce(slot["old"], F.lit(0)))
        low_mark = mean * (1 - SLACK)
        leave = ~known | ((here > mean) & (here - size >= low_mark) & (F.array_min(loads) + size <= low_mark))
        to = F.when(leave, low).otherwise(slot["old"])
        lighter = F.transform(loads, lambda x, i: x - F.when(known & (i == slot["old"]), size).otherwise(F.lit(0)))
        return F.struct(
            F.transform(lighter, lambda x, i: x + F.when(i == to, size).otherwise(F.lit(0))).alias("loads"),
            F.concat(state["owners"], F.array(to.cast("int"))).alias("owners"),
        )

    one = one.withColumn("owners", F.aggregate("slots", start, edit)["owners"])
    pairs = one.select(F.explode(F.arrays_zip("slots", "owners")).alias("x"))
    return pairs.select(
        F.col("x.slots.virtual_slot").alias("virtual_slot"),
        F.col("x.slots.n_rows").alias("n_rows"),
        (-F.col("x.slots.minus")).alias("bytes"),
        F.col("x.owners").alias("shard"),
    )


def write_map(mapping: DataFrame, root: str, version: int) -> None:
    """Store one version of a map; a version is never written twice."""
    mapping.coalesce(1).write.mode("errorifexists").parquet(f"{root}/version={version}")


def read_map(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A stored version of a map, the latest by default."""
    schema = "virtual_slot int, n_rows bigint, bytes bigint, shard int, version int"
    maps = spark.read.schema(schema).parquet(root)
    if version is not None:
        return maps.filter(F.col("version") == version)
    latest = maps.agg(F.max("version").alias("version"))
    return maps.join(F.broadcast(latest), "version", "left_semi")


def placed(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add each record's shard and its place in the shard, counted from 0 without gaps.

    A place is the number of rows in earlier slots of the shard plus the rank in the
    slot (by id, CRC, size; nulls last; equal rows by number), so no task holds more than one slot.
    The map has at most ``n_slots`` rows and is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mapping.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "again")
    ranked = rows.withColumn("rank", F.row_number().over(within).cast("bigint"))
    return ranked.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("offset") + F.col("rank") - 1)
