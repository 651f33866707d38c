"""Noise variants of note tables: timing drift, jitter, stretch, overlap repair, all repeatable by hash."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstave.functions import scalars
from sparkstave.operators.notes import tempo_in_force

TPQ = 480
#: Per variant: drift in ticks, jitter in milliseconds, least and greatest stretch.
LEVELS = {"clean": (0.0, 0.0, 1.0, 1.0), "light": (TPQ // 8, 10.0, 0.9, 1.1), "heavy": (TPQ // 4, 25.0, 0.8, 1.2)}
#: Beats between two control points of the drift: drawn once for each file and variant.
STEP_BEATS = (4, 16)


def ticked(notes: DataFrame) -> DataFrame:
    """(file, note_id, pitch, time, duration) in ticks."""
    return notes.select("file", "note_id", "pitch", (F.col("onset_beat") * TPQ).cast("bigint").alias("time"), (F.col("duration_beat") * TPQ).cast("bigint").alias("duration"))


def merged_tracks(notes: DataFrame) -> DataFrame:
    """The notes of the tracks that noise is laid on: tracks of one program are one, and of a file the first such track (by ``track``) counts.

    A file without notes has no rows and stays so. ``notes`` has file, track and program beside its own columns.
    """
    first = notes.groupBy("file").agg(F.min_by("program", F.struct("track", "note_id")).alias("first"))
    return notes.join(first.withColumnRenamed("file", "_file"), (F.col("file") == F.col("_file")) & F.col("program").eqNullSafe(F.col("first"))).drop("_file", "first", "track")


def interpolated(x: Column, points: Column) -> Column:
    """Linear interpolation at ``x`` in [0, 1] between evenly spaced values: index arithmetic, no search."""
    last = F.size(points) - 1
    at = x * last
    low = F.floor(at).cast("int")
    t = at - low
    return (1 - t) * F.get(points, low) + t * F.get(points, F.least(low + 1, last))


def variants(notes: DataFrame, seed: int, tempi: DataFrame | None = None) -> DataFrame:
    """Each note in three variants: control points drift it, a normal at the tempo in force jitters it, a factor stretches it.

    ``clean`` stays as it is, overlaps included. ``tempi`` has file, tick and bpm; without any, 120 beats a minute. A file's drift has
    evenly spaced control points, one in 4 to 16 beats and two at least; only the two next to a note are drawn.
    """
    none = notes.sparkSession.createDataFrame([], "file string, tick bigint, bpm double")
    timed = tempo_in_force(notes.select("file", F.col("time").alias("tick"), "note_id"), none if tempi is None else tempi)
    length = notes.groupBy("file").agg(F.greatest(F.max(F.col("time") + F.col("duration")), F.lit(1)).alias("length"))
    rows = notes.join(timed.select("file", "note_id", "bpm"), ["file", "note_id"]).join(length, "file")
    noisy = rows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in LEVELS if v != "clean"])))
    level = {k: scalars.chosen(F.col("variant"), {v: F.lit(float(p[i])) for v, p in LEVELS.items()}) for i, k in enumerate(("drift", "jitter", "low", "high"))}
    uniform = lambda tag, *cols: scalars.stable_uniform(seed, F.concat_ws("/", F.lit(tag), "variant", *cols))
    low, high = STEP_BEATS
    step = F.floor((F.lit(float(low)) + uniform("step", "file") * float(high - low)) * TPQ)
    noisy = noisy.withColumn("last", F.greatest(F.lit(2), F.floor(F.col("length") / step)) - 1)
    at = F.col("time") / F.col("length") * F.col("last")
    noisy = noisy.withColumn("at_point", at).withColumn("point", F.least(F.floor(at), F.col("last") - 1))
    value = lambda k: (uniform("drift", "file", k.cast("string")) * 2 - 1) * level["drift"]
    share = F.col("at_point") - F.col("point")
    drift = (1 - share) * value(F.col("point")) + share * value(F.col("point") + 1)
    note = F.col("note_id").cast("string")
    normal = F.sqrt(-2 * F.log(F.greatest(uniform("r", note), F.lit(1e-12)))) * F.cos(2 * math.pi * uniform("a", note))
    jitter = normal * level["jitter"] * scalars.ticks_per_ms(F.lit(TPQ), F.col("bpm"))
    time = F.greatest(F.lit(0).cast("bigint"), (F.col("time") + drift + jitter).cast("bigint"))
    stretch = level["low"] + uniform("s", note) * (level["high"] - level["low"])
    duration = F.greatest(F.lit(1).cast("bigint"), (F.col("duration") * stretch).cast("bigint"))
    moved = noisy.select("variant", "file", "note_id", "pitch", F.col("time").alias("at"), time.alias("time"), duration.alias("duration"))
    fixed = repaired(moved.withColumn("file", F.concat_ws("/", "variant", "file")), order="at")
    fixed = fixed.withColumn("variant", F.substring_index("file", "/", 1)).withColumn("file", F.expr("substring(file, length(variant) + 2)"))
    return fixed.unionByName(notes.select("file", "note_id", "pitch", "time", "duration", F.lit("clean").alias("variant")))


def repaired(notes: DataFrame, order: str = "time") -> DataFrame:
    """Notes of one pitch don't overlap: the earlier one is cut, a start is pushed behind the one before.

    Sequential within one (file, pitch) only. Those are spread over tasks and come sorted, so a task
    holds one note at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for file, note, pitch, time, duration in batch[["file", "note_id", "pitch", "time", "duration"]].itertuples(index=False):
                if held and (held[0], held[2]) == (file, pitch) and time < held[3] + held[4]:
                    time = max(held[3] + 1, time)
                    held[4] = max(time - held[3] - 1, 1)
                if held:
                    out.append(held)
                held = [file, note, pitch, time, duration]
            yield pd.DataFrame(out, columns=["file", "note_id", "pitch", "time", "duration"])
        if held:
            yield pd.DataFrame([held], columns=["file", "note_id", "pitch", "time", "duration"])

    ordered = notes.repartition("file", "pitch").sortWithinPartitions("file", "pitch", order, "note_id")
    return ordered.mapInPandas(run, "file string, note_id bigint, pitch int, time bigint, duration bigint")


def on_grid(notes: DataFrame, tempi: DataFrame | None = None) -> DataFrame:
    """Compound tuples of a file's notes in order: bar, position in the bar, pitch, length, tempo, time signature, program.

    Positions are 8 a beat, lengths 8 a beat up to 8 beats and 4 a beat beyond. ``bar`` is 1 on the first note of a bar. ``notes`` has file, note_id,
    onset_beat, duration_beat, pitch, and may have beats, beat_type (4/4 where null or missing) and program (0). The ids are our own.
    """
    half_up = lambda x: F.floor(x + F.lit(0.5))
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in notes.columns else F.lit(default)
    beats, kind, program = own("beats", 4), own("beat_type", 4), own("program", 0)
    rows = notes.withColumn("_steps", half_up(F.col("onset_beat") * 8)).withColumn("_bar_steps", (beats * 32 / kind).cast("bigint"))
    d = F.col("duration_beat")
    length = F.when(d <= 8, F.greatest(F.lit(1), half_up(d * 8))).otherwise(F.greatest(F.lit(1), half_up((d - 8) * 4)) + 64)
    number = F.floor(F.col("_steps") / F.col("_bar_steps"))
    rows = rows.withColumn("_number", number)
    order = Window.partitionBy("file").orderBy("_steps", "pitch", "note_id")
    opens = ~number.eqNullSafe(F.lag(number).over(order))
    out = rows.select(
        "file", "note_id", opens.cast("int").alias("bar"), (F.col("_steps") - number * F.col("_bar_steps")).alias("position"), "pitch", length.alias("duration_step"),
        F.concat_ws("/", beats.cast("string"), kind.cast("string")).alias("time_signature"), program.alias("program"), (F.col("_steps") * 60).alias("_tick"),
    )
    if tempi is None:
        return out.withColumn("tempo", F.lit(120)).drop("_tick")
    bpm = tempo_in_force(out.select("file", F.col("_tick").alias("tick"), "note_id"), tempi).select("file", "note_id", half_up(F.col("bpm")).cast("int").alias("tempo"))
    return out.drop("_tick").join(bpm, ["file", "note_id"])
