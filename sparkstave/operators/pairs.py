"""Scores of prediction and truth file by file: from parsed markup to all metrics, composites and their summary."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstave.functions import scalars
from sparkstave.operators import match, notes as nt, report, similarity
from sparkstave.session import bucketed, drop_stored, stored

#: Elements of a bucket, about.
ROWS = 200_000

#: Metrics whose mean over files the summary gives.
MEANS = (
    *(f"{m}_f1" for m in match.MATCH_KEYS), "avg_measure_note_f1", "avg_measure_rhythm_f1", "avg_measure_pitch_class_f1", "avg_measure_soft_note_f1", "avg_measure_soft_pitch_class_f1",
    "key_event_f1", "time_event_f1", "clef_event_f1", "xml_normalized_structure_edit_distance", "pred_tie_merged_notes", "gt_tie_merged_notes", "pitch_class_histogram_jsd",
    "duration_histogram_jsd", "pitch_class_timeline_f1", "rhythm_timeline_f1", "pitch_class_timeline_dtw_similarity", "rhythm_timeline_dtw_similarity", "music_content_score",
    "notation_score", "onset_tolerance_beats", "duration_tolerance_beats",
)
#: Value of a metric for a file that has no row of it, where it isn't 0.
WITHOUT = {"pitch_class_timeline_dtw_similarity": 1.0, "rhythm_timeline_dtw_similarity": 1.0}


def structure_distance(tokens: DataFrame) -> DataFrame:
    """(file, distance, normalized): edit distance of the two sides' structure tokens, over the length of the truth."""
    side = lambda s: F.coalesce(F.first(F.when(F.col("side") == s, F.col("tokens")), ignorenulls=True), F.array().cast("array<string>"))
    pairs = tokens.groupBy("file").agg(side("pred").alias("pred"), side("gt").alias("gt"))
    pairs = pairs.withColumn("distance", scalars.edit_distance(F.col("pred"), F.col("gt")))
    return pairs.select("file", "distance", scalars.normalized_distance(F.col("distance"), F.col("gt")).alias("normalized"))


def per_side(rows: DataFrame, name: str) -> list[DataFrame]:
    counts = match.side_counts(rows, "file")
    return [named(counts, {f"pred_{name}": "np", f"gt_{name}": "ng"})]


def named(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(file, name, value) of some columns."""
    entries = [F.struct(F.lit(k).alias("name"), F.col(c).cast("double").alias("value")) for k, c in columns.items()]
    return rows.select("file", F.explode(F.array(*entries)).alias("x")).select("file", "x.name", "x.value")


COMPOSED = (
    "pitch_class_f1", "rhythm_f1", "pitch_class_onset_duration_f1", "pitch_class_timeline_dtw_similarity", "rhythm_timeline_dtw_similarity", "pitch_onset_duration_staff_f1",
    "measure_accuracy", "key_event_f1", "time_event_f1", "xml_normalized_structure_edit_distance",
)


def dealt(elements: DataFrame) -> tuple[DataFrame, int]:
    """Elements in parts of about ROWS by the hash of their file, and how many parts."""
    rows = stored(elements, "parsed")
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    out = bucketed(rows.repartition(n, "file"), "elements", "file", n)
    drop_stored(rows)
    return out, n


def pair_scores(elements: DataFrame, onset_tol: float = 0.0, duration_tol: float = 0.0, metrics: tuple[str, ...] | None = None, parts: int | None = None) -> DataFrame:
    """One row of all metrics for each file of ``elements`` (rows of ``score_elements`` with ``side``: pred or gt).

    Each family of metrics is a grouped query over all files. What it finds is listed as (file, name, value), and one pivot
    brings a file's metrics together. A file that one side lacks is scored against nothing. With ``metrics`` only families that hold one of these names are computed, and
    the others' columns are left out; composites need COMPOSED.

    Elements and notes lie in buckets by file, so families shuffle joins and what they have found, but no notes. ``parts``: the elements come dealt by the hash of their file into so many tasks.
    """
    elements = elements.filter("error is null")
    elements, parts = (bucketed(elements, "elements", "file", parts), parts) if parts else dealt(elements)
    raw = bucketed(nt.timed_notes(nt.with_ordinal(elements)), "notes", "file", parts)
    notes = bucketed(nt.merged_notes(raw), "notes", "file", parts)
    measures = elements.filter("tag = 'measure'").select("file", "side", nt.own_measure(elements).alias("measure_idx")).distinct()
    tolerances, exact = (onset_tol, duration_tol), not (onset_tol or duration_tol)
    found: list[DataFrame] = []
    made: set[str] = set()

    def family(names: list[str], make: Callable[[], list[DataFrame] | DataFrame]) -> None:
        if metrics is None or set(metrics) & set(names):
            made.update(names)
            rows = make()
            found.extend(rows if isinstance(rows, list) else [rows])

    for rows, name in ((notes, "notes"), (measures, "measures"), (raw, "notes_before_tie_merge"), (notes, "notes_after_tie_merge")):
        family([f"{s}_{name}" for s in ("pred", "gt")], lambda rows=rows, name=name: per_side(rows, name))
    numbers = ("precision", "recall", "f1", "tp", "fn")
    modes_of = {mode: [f"{mode}_{c}" for c in numbers] for mode in match.MATCH_KEYS}
    if exact:  # equality: all modes in one go

        def bags() -> DataFrame:
            voiced = notes.withColumn("voice", scalars.voice(F.col("voice")))
            wanted = [mode for mode, names in modes_of.items() if metrics is None or set(metrics) & set(names)]
            scores = match.bag_scores(voiced, {mode: match.mode_keys(mode) for mode in wanted}, "file")
            entries = F.array(*[F.struct(F.concat("name", F.lit(f"_{c}")).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers])
            return scores.select("file", F.explode(entries).alias("x")).select("file", "x.*")

        family([x for names in modes_of.values() for x in names], bags)
    else:
        for mode, names in modes_of.items():
            family(names, lambda mode=mode: named(match.tolerant_scores(notes, mode, *tolerances), {f"{mode}_{c}": c for c in numbers}))
    accuracy = {"measure_accuracy": "measure_accuracy", "ser": "ser", "correct_measures": "correct", "total_measures": "measures"}
    family(list(accuracy), lambda: named(match.measure_accuracy(notes, measures), accuracy))
    keys = {"note": ("pitch", "onset_beat", "duration_beat"), "rhythm": ("onset_beat", "duration_beat"), "pitch_class": ("pitch_class", "onset_beat", "duration_beat")}
    mean_of = lambda rows, head: rows.select("file", F.concat(F.lit(head), "name", F.lit("_f1")).alias("name"), F.col("avg").alias("value"))
    family([f"avg_measure_{k}_f1" for k in keys], lambda: mean_of(match.measure_f1s(notes, keys, measures), "avg_measure_"))
    modes = {"note": "pitch_onset_duration", "pitch_class": "pitch_class_onset_duration"}
    if exact:
        family([f"avg_measure_soft_{k}_f1" for k in modes], lambda: mean_of(match.strict_measure_f1s(notes, modes, measures), "avg_measure_soft_"))
    else:
        for name, mode in modes.items():
            soft = f"avg_measure_soft_{name}_f1"
            family([soft], lambda mode=mode, soft=soft: named(match.soft_measure_f1(notes, mode, *tolerances, measures=measures), {soft: "avg_soft_f1"}))
    family(
        [f"{k}_event_f1" for k in ("key", "time", "clef")],
        lambda: match.event_f1(nt.attribute_events(elements)).select("file", F.concat("kind", F.lit("_event_f1")).alias("name"), F.col("f1").alias("value")),
    )
    edits = {"xml_structure_edit_distance": "distance", "xml_normalized_structure_edit_distance": "normalized"}
    family(list(edits), lambda: named(structure_distance(nt.structure_tokens(elements)), edits))
    family(["pitch_class_histogram_jsd"], lambda: named(match.divergence(match.pitch_class_histogram(notes)), {"pitch_class_histogram_jsd": "jsd"}))
    family(["duration_histogram_jsd"], lambda: named(match.divergence(match.duration_histogram(notes, 6)), {"duration_histogram_jsd": "jsd"}))
    for kind in ("pitch_class", "rhythm"):
        family([f"{kind}_timeline_f1"], lambda kind=kind: named(match.framewise_f1(notes, kind, together=True), {f"{kind}_timeline_f1": "f1"}))
        warped = f"{kind}_timeline_dtw_similarity"
        family([warped], lambda kind=kind, warped=warped: named(similarity.timeline_dtw(match.timeline(notes, kind)), {warped: "similarity"}))
    names = [
        *(f"{s}_{c}" for c in ("notes", "measures", "notes_before_tie_merge", "notes_after_tie_merge") for s in ("pred", "gt")), *(f"{m}_{c}" for m in match.MATCH_KEYS for c in ("precision", "recall", "f1", "tp", "fn")),
        *accuracy, *(f"avg_measure_{n}_f1" for n in keys), "avg_measure_soft_note_f1", "avg_measure_soft_pitch_class_f1", *(f"{k}_event_f1" for k in ("key", "time", "clef")),
        "xml_structure_edit_distance", "xml_normalized_structure_edit_distance", "pitch_class_histogram_jsd", "duration_histogram_jsd",
        *(f"{k}_timeline_{c}" for k in ("pitch_class", "rhythm") for c in ("f1", "dtw_similarity")),
    ]
    names = [x for x in names if x in made]
    wide = reduce(DataFrame.unionByName, found).groupBy("file").pivot("name", names).agg(F.first("value"))
    every = elements.select("file").distinct().join(wide, "file", "left")
    every = every.select("file", *[F.coalesce(F.col(c), F.lit(WITHOUT.get(c, 0.0))).alias(c) for c in names])
    if "total_measures" in made:
        every = every.withColumn("wrong_measures", F.col("total_measures") - F.col("correct_measures"))
    for side in ("pred", "gt"):
        if {f"{side}_notes_before_tie_merge", f"{side}_notes_after_tie_merge"} <= made:
            every = every.withColumn(f"{side}_tie_merged_notes", F.greatest(F.lit(0.0), F.col(f"{side}_notes_before_tie_merge") - F.col(f"{side}_notes_after_tie_merge")))
    every = every.withColumn("onset_tolerance_beats", F.lit(float(onset_tol))).withColumn("duration_tolerance_beats", F.lit(float(duration_tol)))
    return report.composites(every) if set(COMPOSED) <= made else every


def summary(scores: DataFrame, group: str = "group") -> DataFrame:
    """A row of 32 columns for each group and one for all: files, means of MEANS, and micro measure accuracy and error."""
    wide = scores.withColumnRenamed("total_measures", "measures").withColumnRenamed("correct_measures", "correct")
    return report.summary(wide, list(MEANS), group).withColumnRenamed("micro_ser", "ser")


def validity(files: DataFrame, elements: DataFrame) -> DataFrame:
    """Counts of truth files with and without a prediction, of pairs where a side doesn't parse, and rates. ``files`` has file and side."""
    bad = elements.filter("error is not null").select("file").distinct().withColumn("bad", F.lit(True))
    side = files.groupBy("file").agg(F.bool_or(F.col("side") == "gt").alias("expected"), F.bool_or(F.col("side") == "pred").alias("available"))
    rows = side.filter("expected").join(bad, "file", "left")
    return report.validity(rows.select("available", F.col("bad").isNull().alias("parsed")))
