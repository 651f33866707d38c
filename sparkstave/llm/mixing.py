"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and offered up to three times
over. A copy's virtual finish time is its source's words so far divided by the
source's target, so at time 1 every source has served its target. Copies are put in
order of finish time over all sources and cut off at the total budget.

Both orders are made in steps, so that no task holds a source: sums of hash
(or time) ranges first, and of runs of ranges, then ranks within one range. Of the copies on offer, those in
time ranges before the cut are taken as they are; only the range that holds the cut is put in order.

Defined results: a null or empty text has no words, so taking it changes nothing; a null source
is a source of its own, last in order; documents with a null or repeated id are
separate documents (equal rows share one fate up to order); an empty table gives
an empty mix. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstave.llm.sharding import numbered
from sparkstave.llm.textkit import WORD
from sparkstave.session import stored

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
RANGE_ROWS = 1_000
#: Ranges in a run of ranges.
RUN = 1_000
UNIT = float(1 << 52)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")


def sized(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """``docs`` without text, with row number ``_row``, ``_size`` in words and ``_source``, written as the numbers hold only then; and these columns with shuffle key ``_u``.

    Rows of equal id, size and source are numbered, so that each has a key of its own and any number of them spreads over the ranges.
    """
    rows = docs.withColumn("_size", word_count(F.col("text"))).withColumn("_source", F.col("source")).withColumn("part", F.spark_partition_id())
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()).drop("text"), "mix")
    again = numbered(rows.select("_row", "doc_id", "_size", "_source", "part"), ["doc_id", "_size", "_source"])
    label = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_size").cast("string"), F.nullif(F.col("again"), F.lit(0)).cast("string"))
    key = F.conv(F.substring(F.md5(label), 1, 13), 16, 10).cast("bigint")
    return rows, again.select("_row", "doc_id", "_size", "_source", key.alias("_u"))


def targets(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its rows and words, weight, target, and all words.

    Sources in code point order, null last, take the weights in turn. Targets are
    ``least(most * words, level * weight)`` at the one level where they add up to all words: what
    capped sources can't take goes to the others by weight.
    """
    everything = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = rows.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_size").alias("source_size"))
    per = per.withColumn("s", F.row_number().over(everything))
    per = per.withColumn("w", F.element_at(cycle, ((F.col("s") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "s")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(whole))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("w").over(later))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))
    per = per.withColumn("level", F.min(fits).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    return per.select("_source", "s", "n", "source_size", "total", target.alias("target"))


def before(sums: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """``sums`` with the sum of ``value`` over all lesser keys (whole numbers) of the group: runs of keys first, then keys within a run."""
    run = F.floor(F.col(key) / RUN)
    rows = sums.withColumn("run", run)
    earlier = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*by, "run").agg(F.sum(value).alias("all")).withColumn("sofar", F.coalesce(F.sum("all").over(earlier), F.lit(0))).drop("all")
    inside = Window.partitionBy(*by, "run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(runs, [*by, "run"])
    return rows.withColumn("before", F.col("sofar") + F.col("inside")).drop("run", "sofar", "inside")


def served_rows(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Every row with ``served``, the words of its source up to it in shuffled order; written, as copies are made from it several times. ``rows`` have their shuffle key."""
    per = targets(rows, most=most)
    narrow = rows.select("_row", "doc_id", F.col("_source").alias("_of"), "_size", "_u")
    joined = narrow.join(per, F.col("_of").eqNullSafe(F.col("_source"))).drop("_of", "_source")
    ranges = F.ceil(F.col("n") / F.lit(float(RANGE_ROWS)))
    keyed = joined.withColumn("b", F.floor(F.col("_u") / F.lit(UNIT) * ranges))
    sums = before(keyed.groupBy("s", "b").agg(F.sum("_size").alias("words")), "b", "words", "s").drop("words")
    inside = Window.partitionBy("s", "b").orderBy("_u", F.col("doc_id").asc_nulls_last(), "_size").rowsBetween(Window.unboundedPreceding, 0)
    served = keyed.join(sums, ["s", "b"]).withColumn("served", F.col("before") + F.sum("_size").over(inside))
    return stored(served.select("_row", "s", "doc_id", "_size", "_u", "served", "source_size", "target", "total"), "served")


def offered_copies(served: DataFrame, most: int = MOST) -> DataFrame:
    """Every copy on offer with its virtual finish time; copies of targetless sources go."""
    offered = served.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    finish = (F.col("served") + F.col("e") * F.col("source_size")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))
    offered = offered.withColumn("finish", finish).filter(F.col("finish").isNotNull())
    return offered.select("_row", "s", "doc_id", "_size", "_u", "e", "finish", "total")


def taken_copies(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Cut the offered copies at the total budget: one row per copy taken (_row, e, finish). ``rows`` have their shuffle key."""
    served = served_rows(rows, most)
    offered = offered_copies(served, most)
    # Ranges of the finish time: about RANGE_ROWS copies each up to time 4, one range beyond, which is never reached.
    grain = float(max(1, -(-served.count() // RANGE_ROWS)))
    offered = offered.withColumn("r", F.floor(F.least(F.col("finish"), F.lit(4.0)) * grain))
    sums = before(offered.groupBy("r").agg(F.sum("_size").alias("words"), F.first("total").alias("budget")), "r", "words")
    over = sums.filter(F.col("before") + F.col("words") > F.col("budget"))
    cut = over.agg(F.min(F.struct("r", "before", "budget")).alias("x")).first()["x"]
    columns = ["_row", "e", "finish", "_size"]
    if cut is None:
        return offered.select(*columns)
    order = Window.partitionBy("r").orderBy("finish", "s", "_u", F.col("doc_id").asc_nulls_last(), "e")
    edge = offered.filter(F.col("r") == cut["r"]).withColumn("upto", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.filter(F.col("upto") + cut["before"] <= cut["budget"])
    return offered.filter(F.col("r") < cut["r"]).select(*columns).unionByName(edge.select(*columns))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, its source's target, and words taken."""
    rows, keyed = sized(docs.select("doc_id", "source", "text"))
    per = targets(rows).select("_source", "source_size", "target")
    taken = taken_copies(keyed).groupBy("_row").agg(F.sum("_size").alias("taken"))
    out = rows.select("_row", "doc_id", "_size", F.col("_source").alias("_of")).join(per, F.col("_of").eqNullSafe(F.col("_source"))).join(taken, "_row", "left")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in mixing order."""
    # The columns travel as one, so that none of theirs can clash.
    rows, keyed = sized(docs.select("doc_id", "source", "text", F.struct("*").alias("row")))
    chosen = taken_copies(keyed).select("_row", "finish")
    out = rows.select("_row", "row").join(chosen, "_row")
    return out.repartitionByRange(F.col("finish")).sortWithinPartitions("finish").select("row.*")
