"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per dimension, set where the value is above 0. Codes are cut into segments of about
SHARE * log2(distinct codes) bits, so that a looked up value has a few codes, and an index lists each code under each of its segments' values. A search grows the radius of
one segment after the other: after the steps (radius, segment) so far, where segment t has radius r_t, all
codes at distance below the sum of r_t + 1 have been met (pigeonhole principle). A query is done once its kth verified
distance lies below that bound; only the other queries grow on. Steps of few probes are taken in one round.

Equal codes are one entry, with their k least ids (more can't be among k results), and equal
query codes are searched once: a vector that many rows share costs one entry. A candidate is taken in the
first step that meets it, so each pair of codes is verified once: in the join itself, where it
goes if it lies beyond the kth distance that its query has already.

Defined results: ties go to the lesser id; a query is itself among the rows searched; rows whose id or vector is null
are neither queries nor results; a null element is a bit of 0, as are the elements that a shorter vector lacks; vectors
may have any number of elements (64 a word of the code); rows that repeat both id and vector count
once; with fewer rows than k all are returned; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstave.session import stored

WORD = 64
LEAST_WIDTH, MOST_WIDTH = 8, 32
#: Steps are taken in one round up to this many probes a query; the first round is small, as it has no kth distance to hold pairs against.
FIRST_PROBES, ROUND_PROBES = 100, 600
SHARE = 0.8
#: A key is a segment's value, and the segment's number above these bits.
KEY_BITS = 32


def binary_words(vector: Column, n_words: int) -> list[Column]:
    """The code as words of 64 bits: bit i is set where element i is above 0."""

    def word(k: int) -> Column:
        bits = F.transform(F.slice(vector, k * WORD + 1, WORD), lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(F.reverse(bits), F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))

    return [word(k).alias(f"c{k}") for k in range(n_words)]


class Segments:
    """Equal parts of each word, about ``SHARE * log2(n_codes)`` bits wide."""

    def __init__(self, n_words: int, n_codes: int):
        width = min(MOST_WIDTH, max(LEAST_WIDTH, round(SHARE * math.log2(max(n_codes, 2)))))
        cuts = round(WORD / width)
        edges = [k * WORD // cuts for k in range(cuts + 1)]
        self.n_words = n_words
        self.parts = [(w, low, high - low) for w in range(n_words) for low, high in zip(edges[:-1], edges[1:], strict=True)]
        self.code, self.qcode = ([f"{side}{k}" for k in range(n_words)] for side in "cq")

    def __len__(self) -> int:
        return len(self.parts)

    def value(self, words: list[str], t: int) -> Column:
        w, low, width = self.parts[t]
        return F.shiftrightunsigned(F.col(words[w]), low).bitwiseAND(F.lit((1 << width) - 1))

    def key(self, words: list[str], t: int) -> Column:
        return self.value(words, t) + F.lit(t << KEY_BITS)

    def distance(self) -> Column:
        return reduce(add, (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(self.code, self.qcode, strict=True)))

    def first_step(self) -> Column:
        """The number of the step that meets a pair first: radius * segments + segment."""
        steps = [F.bit_count(self.value(self.code, t).bitwiseXOR(self.value(self.qcode, t))) * len(self) + t for t in range(len(self))]
        return F.least(*steps)

    def rounds(self) -> list[tuple[list[tuple[int, int]], int]]:
        """(steps (radius, segment), greatest distance covered after them) of each round."""
        out, radius, steps, probes = [], [-1] * len(self), [], 0
        every = [(r, t) for r in range(max(p[2] for p in self.parts) + 1) for t in range(len(self)) if r <= self.parts[t][2]]
        for r, t in every:
            n = math.comb(self.parts[t][2], r)
            if steps and probes + n > (ROUND_PROBES if out else FIRST_PROBES):
                out.append((steps, sum(x + 1 for x in radius) - 1))
                steps, probes = [], 0
            steps, probes = [*steps, (r, t)], probes + n
            radius[t] = r
            if r == self.parts[t][2]:
                break  # all values of one segment: whatever there is has been met
        return [*out, (steps, self.n_words * WORD)]


def coded(vectors: DataFrame, n_words: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct (id, words of the code: c0, c1, ...)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter("id is not null and vector is not null")
    return rows.select("id", *binary_words(F.col("vector"), n_words)).distinct()


def index(classes: DataFrame, segments: Segments) -> DataFrame:
    """(key, code, ids): each distinct code under each of its segments."""
    keys = F.array(*[segments.key(segments.code, t) for t in range(len(segments))])
    return classes.select(F.explode(keys).alias("key"), *segments.code, "ids")


def probes(queries: DataFrame, segments: Segments, steps: list[tuple[int, int]]) -> DataFrame:
    """``queries`` with (key, step): all values at exactly a step's radius from the query's own segment."""

    def one(radius: int, t: int) -> DataFrame:
        width = segments.parts[t][2]
        rows = queries.withColumn("key", segments.key(segments.qcode, t)).withColumn("at", F.lit(-1))
        for k in range(radius):  # flip one more bit, always above the last
            rows = rows.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.lit(width - radius + k))))
            rows = rows.withColumn("key", F.col("key").bitwiseXOR(F.expr("shiftleft(1L, at)")))
        return rows.drop("at").withColumn("step", F.lit(radius * len(segments) + t))

    return reduce(DataFrame.unionByName, (one(r, t) for r, t in steps))


def met(queries: DataFrame, entries: DataFrame, segments: Segments, steps: list[tuple[int, int]]) -> DataFrame:
    """(query code, id, distance) of the entries that the steps meet first, no farther than the query's ``bound``."""
    near = (segments.first_step() == F.col("step")) & (segments.distance() <= F.col("bound"))
    # Merged by order: the planner takes the probes, many times the queries, for a small side.
    pairs = probes(queries, segments, steps).hint("merge").join(entries.withColumnRenamed("key", "own"), (F.col("key") == F.col("own")) & near)
    return pairs.select(*segments.qcode, F.explode("ids").alias("id"), segments.distance().alias("distance"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, neighbor_id, rank, distance): the k rows of ``vectors`` of least Hamming distance to each of ``queries``."""
    spark = vectors.sparkSession
    sizes = [t.agg(F.max(F.size(vector_col))).first()[0] or 0 for t in (vectors, queries)]
    n_words = max(1, math.ceil(max(sizes) / WORD))
    codes = coded(vectors, n_words, id_col, vector_col)
    words = [f"c{i}" for i in range(n_words)]
    rank = F.row_number().over(Window.partitionBy(*words).orderBy("id"))
    least = codes.withColumn("rank", rank).filter(F.col("rank") <= k)  # the limit is taken in each task first
    classes = stored(least.groupBy(*words).agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    total = classes.agg(F.count("*").alias("codes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    segments = Segments(n_words, total["codes"])
    own = segments.qcode
    entries = stored(index(classes, segments), "index")
    asked = coded(queries, n_words, id_col, vector_col)
    asked = stored(asked.select("id", *[F.col(c).alias(q) for c, q in zip(words, own, strict=True)]), "queries")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = stored(asked.select(*own).distinct().withColumn("bound", F.lit(n_words * WORD)).repartition(tasks, *own), "left")
    enough = min(k, total["ids"])
    found, results = None, None
    order = Window.partitionBy(*own).orderBy("distance", "id")
    for steps, covered in segments.rounds():
        if left.isEmpty():
            break
        new = met(left, entries, segments, steps)
        best = new if found is None else found.join(left, own, "left_semi").unionByName(new)
        found = stored(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        state = found.groupBy(*own).agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        state = state.withColumn("full", F.col("n") >= enough).withColumn("done", F.col("full") & (F.col("last") <= covered))
        state = stored(state, "state")
        over = found.join(state.filter("done"), own, "left_semi")
        results = over if results is None else results.unionByName(over)
        found = found.drop("rank")
        kept = left.join(state, own, "left").filter("done is null or not done")
        kept = kept.withColumn("bound", F.when(F.col("full"), F.col("last")).otherwise(F.col("bound")))
        left = stored(kept.select(*own, "bound").repartition(tasks, *own), "left")
    if results is None:
        results = asked.select(*own, "id", F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    return asked.withColumnRenamed("id", "query_id").join(results.withColumnRenamed("id", "neighbor_id"), own).select(
        "query_id", "neighbor_id", F.col("rank").cast("int").alias("rank"), F.col("distance").cast("int").alias("distance")
    )
