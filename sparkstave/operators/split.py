"""Token totals, quartile strata and the token-balanced split.

Quantiles are exact and selected, not gathered: values are counted in RANGES ranges, only the range that holds a wanted rank is cut further, until it is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkstave.operators.batches import shelf_of
from sparkstave.session import stored

SPLITS = ("training", "validation", "test")
RATIO = (16, 4, 5)
STRATA = ("Short", "Medium", "Long", "Very Long")
PATTERN_BLOCK = 65_536
#: Ranges that a value is looked for in at once; rows ranked together.
RANGES, RUN = 1_024, 10_000
QUARTILES = (0.25, 0.5, 0.75)


def exact_quantiles(rows: DataFrame, column: str, shares: tuple[float, ...] = QUARTILES, by: str | None = None) -> dict:
    """Interpolated quantiles of a numeric column, and count, least and greatest value, by the values of ``by`` (few, as each has its own ranges): {group: (n, low, high, [quantile])}.

    Each round reads the (written) rows once and brings a count, least and greatest value of at most RANGES ranges for each rank to the driver;
    a range spans at most 1 / RANGES of the one before, so whole numbers take a few rounds. Nulls don't count.
    """
    group = F.lit(0) if by is None else F.col(by)
    rows = rows.select(group.alias("g"), F.col(column).alias("v")).filter("v is not null")
    spread = rows.groupBy("g").agg(F.count("*"), F.min("v"), F.max("v")).collect()
    ranks = {g: sorted({int(q * (n - 1)) for q in shares} | {min(int(q * (n - 1)) + 1, n - 1) for q in shares}) for g, n, _, _ in spread}
    # A wanted rank lies in [low, high], behind ``before`` rows of the group.
    wanted = {(g, r): (low, high, 0) for g, _, low, high in spread for r in ranks[g]}
    while open_ := {x: w for x, w in wanted.items() if w[0] < w[1]}:
        spans = sorted({(g, low, high) for (g, _), (low, high, _) in open_.items()}, key=str)
        number = {s: i for i, s in enumerate(spans)}
        given = rows.sparkSession.createDataFrame([(*s, i) for s, i in number.items()], f"g {rows.schema['g'].dataType.simpleString()}, low {rows.schema['v'].dataType.simpleString()}, high {rows.schema['v'].dataType.simpleString()}, i int")
        inside = rows.join(F.broadcast(given), "g").filter("v between low and high")
        place = F.least(F.floor((F.col("v").cast("double") - F.col("low").cast("double")) / (F.col("high").cast("double") - F.col("low").cast("double")) * RANGES), F.lit(RANGES - 1))
        found: dict[int, list] = {}
        for i, _, n, low, high in inside.groupBy("i", place.alias("place")).agg(F.count("*"), F.min("v"), F.max("v")).orderBy("i", "place").collect():
            found.setdefault(i, []).append((n, low, high))
        for (g, r), (low, high, before) in open_.items():
            for n, least, most in found[number[g, low, high]]:
                if r < before + n:
                    wanted[g, r] = (least, most, before)
                    break
                before += n
    out = {}
    for g, n, low, high in spread:
        at = lambda k, g=g: float(wanted[g, k][0])
        places = [(q * (n - 1), int(q * (n - 1))) for q in shares]
        out[g] = (n, low, high, [at(k) if x == k else (k + 1 - x) * at(k) + (x - k) * at(k + 1) for x, k in places])
    return out


def origin_totals(parts: DataFrame) -> DataFrame:
    """Tokens of each origin over all its parts."""
    return parts.groupBy("origin").agg(F.sum("n_tokens").cast("bigint").alias("total_tokens"))


def with_strata(totals: DataFrame) -> DataFrame:
    """Quartile stratum of each origin; equal edges put all in one stratum ``all``. Totals are written first, as they are read several times."""
    totals = stored(totals.select("origin", "total_tokens"), "totals")
    found = exact_quantiles(totals, "total_tokens")
    _, low, high, q = found.get(0, (0, 0, 0, [0.0] * 3))
    t = F.col("total_tokens")
    label = F.when(t <= q[0], F.lit(STRATA[0])).when(t <= q[1], F.lit(STRATA[1])).when(t <= q[2], F.lit(STRATA[2])).otherwise(F.lit(STRATA[3]))
    return totals.select("origin", "total_tokens", (label if len({float(low), *q, float(high)}) == 5 else F.lit("all")).alias("stratum"))


def stratum_means(strata: DataFrame) -> DataFrame:
    return strata.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("total_tokens").alias("mean_tokens"))


def dealt_run(filled: list[int], goals: list[float], open_splits: list[int], size: int, n: int) -> bytes:
    """The splits of ``n`` origins of one size; ``filled`` moves on. A split's turns come at rising fill ratios, so all turns are merged by ratio."""
    if n < 32 or not open_splits:
        given = bytearray(n)
        for i in range(n):
            given[i] = min(open_splits, key=lambda k: filled[k] / goals[k], default=0)
            filled[given[i]] += size
        return bytes(given)
    turns = np.arange(n, dtype=np.int64)
    ratios = np.concatenate([(filled[k] + turns * size) / goals[k] for k in open_splits])
    order = np.lexsort((np.repeat(np.arange(len(open_splits)), n), ratios))[:n]  # the lower split first on ties
    given = np.array(open_splits, np.uint8)[order // n]
    for k in open_splits:
        filled[k] += int((given == k).sum()) * size
    return given.tobytes()


def rank_in_run(strata: DataFrame) -> DataFrame:
    """``rank`` of each origin among those of its stratum and size, by origin: ranges of origins first where they are numbers, so a common size is spread over tasks."""
    run = ["stratum", "total_tokens"]
    numeric = strata.schema["origin"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")
    n_shelves = max(1, strata.count() // RUN)
    shelved = strata.withColumn("shelf", shelf_of(strata, "origin", n_shelves) if numeric and n_shelves > 1 else F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*run, "shelf").orderBy("origin")) - 1
    if n_shelves == 1:
        return shelved.withColumn("rank", inside).drop("shelf")
    earlier = Window.partitionBy(*run).orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    before = shelved.groupBy(*run, "shelf").agg(F.count("*").alias("n")).select(*run, "shelf", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = shelved.withColumn("inside", inside).join(before, [*run, "shelf"])
    return ranked.withColumn("rank", F.col("inside") + F.col("before")).drop("shelf", "inside", "before")


def balanced_split(strata: DataFrame, ratio: tuple = RATIO) -> DataFrame:
    """``partition`` for each origin: largest strata first, largest origins first, each to the least filled split.

    Which split comes next depends only on the sizes so far, so the sequential part runs over
    distinct sizes with their counts, not over origins: for each run of equal sizes it
    deals a block at a time, and origins pick theirs by their rank in the run. That part is one task by definition: its input is a row per distinct size and
    stratum and a byte per origin goes out. ``pattern_split`` is the form without one.
    """
    means = stratum_means(strata).select("stratum", "mean_tokens")
    total = strata.agg(F.sum("total_tokens")).first()[0] or 0
    goals = [total * (r / float(sum(ratio))) for r in ratio]
    runs = strata.groupBy("stratum", "total_tokens").agg(F.count("*").alias("n")).join(F.broadcast(means), "stratum")

    columns = ["stratum", "total_tokens", "block", "given"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = [0] * len(goals)
        open_splits = [k for k, g in enumerate(goals) if g > 0]
        for batch in batches:
            out = []
            for stratum, size, n in zip(batch["stratum"], batch["total_tokens"], batch["n"], strict=True):
                for begin in range(0, n, PATTERN_BLOCK):
                    out.append((stratum, size, begin // PATTERN_BLOCK, dealt_run(filled, goals, open_splits, int(size), min(PATTERN_BLOCK, n - begin))))
                    if len(out) >= 1_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    ordered = runs.repartition(1).sortWithinPartitions(F.desc("mean_tokens"), "stratum", F.desc("total_tokens")).select("stratum", "total_tokens", "n")
    patterns = ordered.mapInPandas(deal, "stratum string, total_tokens bigint, block bigint, given binary")
    ranked = rank_in_run(strata).withColumn("block", F.floor(F.col("rank") / PATTERN_BLOCK))
    dealt = ranked.join(patterns, ["stratum", "total_tokens", "block"])
    number = F.conv(F.hex(F.substring("given", (F.col("rank") % PATTERN_BLOCK + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    names = F.array(*[F.lit(s) for s in SPLITS])
    return dealt.select("origin", "total_tokens", "stratum", F.element_at(names, number + 1).alias("partition"))


def pattern_split(strata: DataFrame, ratio: tuple = RATIO) -> DataFrame:
    """The parallel form: hash order within a stratum, splits in proportion by rank. Near the targets, not equal to the greedy."""
    n = sum(ratio)
    slots = sorted(((i + 0.5) / r, k) for k, r in enumerate(ratio) for i in range(r))
    cycle = F.array(*[F.lit(SPLITS[k]) for _, k in slots])
    key = F.conv(F.substring(F.md5(F.concat(F.lit("shelf:"), F.col("origin").cast("string"))), 1, 13), 16, 10).cast("bigint")
    order = Window.partitionBy("stratum", "shelf").orderBy(F.desc("total_tokens"), "key", "origin")
    shelved = strata.withColumn("key", key).withColumn("shelf", F.col("key") % 64)
    return shelved.withColumn("partition", F.element_at(cycle, ((F.row_number().over(order) - 1) % n + 1).cast("int"))).drop("shelf", "key")


def split_report(assigned: DataFrame, ratio: tuple = RATIO) -> DataFrame:
    """Scores and tokens per split, and actual against target share."""
    per = assigned.groupBy("partition").agg(F.count("*").alias("n_scores"), F.sum("total_tokens").cast("bigint").alias("total_tokens"))
    goal = F.create_map(*[F.lit(x) for s, r in zip(SPLITS, ratio, strict=True) for x in (s, 100.0 * r / sum(ratio))])
    actual = F.round(F.lit(100.0) * F.col("total_tokens") / F.sum("total_tokens").over(Window.partitionBy()), 2)
    per = per.withColumn("actual_pct", actual).withColumn("target_pct", F.element_at(goal, F.col("partition")))
    return per.withColumn("error_pct", F.round(F.col("actual_pct") - F.col("target_pct"), 2))


def strata_crosstab(assigned: DataFrame) -> DataFrame:
    """Counts and row shares of each split in each stratum."""
    counts = assigned.groupBy("stratum").pivot("partition", list(SPLITS)).count().na.fill(0)
    row = sum((F.col(s) for s in SPLITS), F.lit(0))
    return counts.select("stratum", *SPLITS, *[F.round(F.lit(100.0) * F.col(s) / row, 2).alias(f"{s}_pct") for s in SPLITS])


def describe(assigned: DataFrame, column: str = "total_tokens") -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per split."""
    assigned = stored(assigned.select("partition", column), "assigned")
    found = exact_quantiles(assigned, column, QUARTILES, "partition")
    c = F.col(column)
    out = assigned.groupBy("partition").agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
    quantile = lambda k: F.element_at(F.create_map(*[F.lit(x) for g, (*_, q) in found.items() for x in (g, q[k])]), F.col("partition")) if found else F.lit(None).cast("double")
    return out.select("partition", "n", "mean", "std", "low", *[quantile(k).alias(f"q{25 * (k + 1)}") for k in range(3)], "high")


def label_parts(parts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each part with its origin's split."""
    return parts.join(assigned.select("origin", "partition"), "origin", "left")
