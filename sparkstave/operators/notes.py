"""From score elements to timed notes: measure clock, chords, tempo and measure lookup, tie merging."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkstave.functions import scalars
from sparkstave.schemas import ELEMENTS
from sparkstave.sources.scores import PIECE, broken_file, check, element_rows

DEFAULT_BPM = 120.0
#: Rows of a range of ticks, about; cells beyond this count as this one.
RANGE_ROWS, FAR = 10_000, 1 << 60
#: Rows of elements that a task holds at once.
OUT_ROWS = 5_000
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def with_clock(elements: DataFrame, *by: str, order: str = "child_pos") -> DataFrame:
    """``onset`` of each element: durations of notes (not chord notes) and forwards add up, backups take away.

    A chord note starts with the last note that is no chord note.
    """
    chord = F.coalesce(F.col("is_chord"), F.lit(False))
    step = F.when((F.col("tag") == "note") & ~chord, F.col("duration")).when(F.col("tag") == "forward", F.col("duration")).when(F.col("tag") == "backup", -F.col("duration"))
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    clocked = elements.withColumn("clock", F.coalesce(F.sum(F.coalesce(step, F.lit(0))).over(earlier), F.lit(0)))
    lead = F.last(F.when((F.col("tag") == "note") & ~chord, F.col("clock")), ignorenulls=True).over(earlier)
    return clocked.withColumn("onset", F.when(chord, F.coalesce(lead, F.col("clock"))).otherwise(F.col("clock")))


def measure_number(number: Column, ordinal: Column) -> Column:
    """A measure's own number, or its ordinal where that is no integer."""
    return F.coalesce(number.try_cast("int"), ordinal)


def spelled_pitch(step: Column, alter: Column, octave: Column) -> Column:
    """12 * (octave + 1) + step + alter; null for an unknown step."""
    steps = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    return (octave + 1) * 12 + F.try_element_at(steps, step) + F.coalesce(alter, F.lit(0))


def tempo_in_force(notes: DataFrame, tempi: DataFrame) -> DataFrame:
    """As-of join: the last tempo at or before each note; before the first one, the first; without any, 120.

    ``notes`` has file, tick and note_id, ``tempi`` file, tick and bpm. Ticks are cut into ranges of about RANGE_ROWS rows: the last tempo of each range is carried on to later ones,
    and rows are put in order inside a range only, so a long file lies in many tasks.
    """
    marks = tempi.select("file", "tick", "bpm", F.lit(None).cast("bigint").alias("note_id"), F.lit(0).alias("kind"))
    both = marks.unionByName(notes.select("file", "tick", F.lit(None).cast("double").alias("bpm"), F.col("note_id").cast("bigint").alias("note_id"), F.lit(1).alias("kind")))
    low, high, n = notes.agg(F.min("tick"), F.max("tick"), F.count("*")).first()
    width = ((high or 0) - (low or 0)) / max(1, -(-n // RANGE_ROWS)) + 1
    both = both.withColumn("range", F.coalesce(F.floor((F.col("tick") - F.lit(low or 0)) / F.lit(float(width))), F.lit(-1)))
    at = F.when(F.col("bpm").isNotNull(), F.struct("tick", "bpm"))
    ends = both.groupBy("file", "range").agg(F.max(at).alias("late"), F.min(at).alias("early"))
    of_file, earlier = Window.partitionBy("file"), Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "range", F.max("late").over(earlier)["bpm"].alias("carried"), F.min("early").over(of_file)["bpm"].alias("opening"))
    upto = Window.partitionBy("file", "range").orderBy("tick", "kind", "bpm").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("own", F.last("bpm", ignorenulls=True).over(upto)).filter("kind = 1").join(carried, ["file", "range"])
    return found.select("file", "tick", "note_id", F.coalesce("own", "carried", "opening", F.lit(DEFAULT_BPM)).alias("bpm"))


def dyadic_blocks(start: Column, end: Column) -> Column:
    """The (level, block) of the cells from ``start`` to ``end``: at most two a level, each of 2 ** level cells."""
    n = F.lit(2).cast("bigint")
    state = F.struct(start.alias("l"), (end + 1).alias("r"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(x: Column, level: Column) -> Column:
        left, right = x["l"] < x["r"], F.pmod(x["l"], n) == 1
        low = x["l"] + F.when(left & right, 1).otherwise(0)
        take = (low < x["r"]) & (F.pmod(x["r"], n) == 1)
        high = x["r"] - F.when(take, 1).otherwise(0)
        block = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        out = F.concat(x["out"], F.when(left & right, block(x["l"])).otherwise(none), F.when(take, block(high)).otherwise(none))
        return F.struct(F.shiftright(low, 1).alias("l"), F.shiftright(high, 1).alias("r"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2((end - start + 2).cast("double"))).cast("int")), state, step, lambda x: x["out"])


def measure_of(notes: DataFrame, spans: DataFrame, cell_beats: float = 4.0) -> DataFrame:
    """Interval join: the measure whose [m_start, m_end) holds the onset; of overlapping spans the first by start, end and measure.

    The very end of the last span belongs to it; a note in a gap gets 0. Spans are listed under blocks of 1, 2, 4, ... cells, two a level at most however long they are,
    and a note looks up one block for each level that its file has. ``notes`` has file, note_id and onset_beat.
    """
    cell = lambda c: F.least(F.greatest(F.floor(F.col(c) / F.lit(float(cell_beats))), F.lit(-FAR)), F.lit(FAR))
    listed = spans.filter("m_start < m_end").select(F.col("file").alias("_file"), "m_start", "m_end", "measure_idx", F.explode(dyadic_blocks(cell("m_start"), cell("m_end"))).alias("_at"))
    levels = listed.groupBy("_file").agg(F.collect_set("_at.level").alias("levels")).withColumnRenamed("_file", "file")
    last = spans.groupBy("file").agg(F.max(F.struct("m_start", "m_end", "measure_idx")).alias("last"))
    known = last.join(levels, "file", "left")
    points = notes.select("file", "note_id", "onset_beat").join(known, "file", "left")
    points = points.select("file", "note_id", "onset_beat", "last", F.explode_outer("levels").alias("level"))
    points = points.withColumn("block", F.call_function("shiftright", cell("onset_beat"), F.col("level")))
    inside = (F.col("file") == F.col("_file")) & (F.col("level") == F.col("_at.level")) & (F.col("block") == F.col("_at.block")) & (F.col("onset_beat") >= F.col("m_start")) & (F.col("onset_beat") < F.col("m_end"))
    span = F.when(F.col("measure_idx").isNotNull(), F.struct("m_start", "m_end", "measure_idx"))
    found = points.join(listed, inside, "left").groupBy("file", "note_id", "onset_beat").agg(F.min(span)["measure_idx"].alias("own"), F.any_value("last").alias("last"))
    ends = F.abs(F.col("onset_beat") - F.col("last.m_end")) <= 1e-9 * F.greatest(F.abs("onset_beat"), F.abs("last.m_end"))
    measure = F.coalesce("own", F.when(ends, F.col("last.measure_idx")), F.lit(0))
    return found.select("file", "note_id", "onset_beat", measure.alias("measure_idx"))


def merge_ties(notes: DataFrame) -> DataFrame:
    """One note per (file, part, tie key): least start, greatest end, attributes of the earliest."""
    first = F.struct("start_beat", "end_beat", "pitch")
    return notes.groupBy("file", "part_idx", "tie_key").agg(
        F.min("start_beat").alias("start_beat"), F.max("end_beat").alias("end_beat"), F.min(first)["pitch"].alias("pitch"), F.count("*").alias("n_merged")
    )


def own_measure(elements: DataFrame) -> Column:
    return measure_number(F.col("measure_number"), F.col("measure_order"))


def with_ordinal(elements: DataFrame) -> DataFrame:
    """``ordinal``: position of the element's measure on its side of a file, parts taken together; null for numbers below 0. Every measure has an element of its own."""
    number = own_measure(elements)
    rank = F.dense_rank().over(Window.partitionBy("file", "side", number >= 0).orderBy(number))
    return elements.withColumn("ordinal", F.when(number >= 0, rank))


def clocked(elements: DataFrame) -> DataFrame:
    """Parsed elements with ``measure_idx``, whole ``ticks``, and their ``onset`` in the measure."""
    rows = elements.withColumn("measure_idx", own_measure(elements)).withColumn("ticks", scalars.safe_int(F.col("duration")))
    return with_clock(rows.drop("duration").withColumnRenamed("ticks", "duration"), "file", "side", "part_idx", "measure_order").withColumnRenamed("duration", "ticks")


def pitch_of(elements: DataFrame) -> Column:
    """MIDI number of a note element; null without step or octave, and for a step that isn't one."""
    return F.when(F.nullif(F.col("octave"), F.lit("")).isNotNull(), spelled_pitch(F.col("step"), scalars.safe_int(F.col("alter")), scalars.safe_int(F.col("octave"))))


def _clef_entries() -> Column:
    filled = F.filter("clefs", lambda c: (F.coalesce(c["sign"], F.lit("")) != "") & (F.coalesce(c["line"], F.lit("")) != ""))
    return F.transform(filled, lambda c: F.struct(scalars.safe_int(c["number"], 1).alias("number"), c["sign"].alias("sign"), c["line"].alias("line")))


def attribute_events(elements: DataFrame) -> DataFrame:
    """(file, side, kind, key): an event for each time, key and clef, with its part and measure in the key."""
    rows = elements.filter("tag = 'attributes'").withColumn("measure_idx", own_measure(elements))
    place = [F.col("part_idx").cast("string"), F.col("measure_idx").cast("string")]
    text = lambda *c: F.concat_ws(":", *place, *[x.cast("string") for x in c])
    time = F.when(F.col("beats").isNotNull() | F.col("beat_type").isNotNull(), F.array(F.struct(F.lit("time").alias("kind"), text(scalars.safe_int(F.col("beats")), scalars.safe_int(F.col("beat_type"))).alias("key"))))
    key = F.when(F.nullif(F.col("fifths"), F.lit("")).isNotNull(), F.array(F.struct(F.lit("key").alias("kind"), text(scalars.safe_int(F.col("fifths"))).alias("key"))))
    clef = F.transform(_clef_entries(), lambda c: F.struct(F.lit("clef").alias("kind"), text(c["number"], c["sign"], c["line"]).alias("key")))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    every = F.concat(F.coalesce(time, none), F.coalesce(key, none), F.coalesce(clef, none))
    return rows.select("file", "side", F.explode(every).alias("e")).select("file", "side", "e.*")


def structure_tokens(elements: DataFrame) -> DataFrame:
    """(file, side, tokens): text tokens of all measures in order; in a measure attributes first, then notes, rests, backups and forwards.

    Fixed formats: PART, MEASURE, DIV, TIME, KEY, CLEF, REST, NOTE, BACKUP and FORWARD, between a measure's start and end marks.
    """
    number = lambda c, default=0: scalars.safe_int(F.col(c), default).cast("string")
    say = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    pitch, voice = pitch_of(elements), F.coalesce(F.trim("voice"), F.lit(""))
    tail = [F.lit("_D"), number("duration"), F.lit("_S"), number("staff"), F.lit("_V"), voice]
    part, measure = F.col("part_idx").cast("string"), own_measure(elements).cast("string")
    attributes = F.concat(
        F.array(F.when(F.nullif(F.col("divisions"), F.lit("")).isNotNull(), say("DIV_", number("divisions"))), F.when(F.col("beats").isNotNull() | F.col("beat_type").isNotNull(), say("TIME_", number("beats"), "_", number("beat_type"))),
                F.when(F.nullif(F.col("fifths"), F.lit("")).isNotNull(), say("KEY_", number("fifths")))),
        F.transform(_clef_entries(), lambda c: F.concat(F.lit("CLEF_"), c["number"].cast("string"), F.lit("_"), c["sign"], F.lit("_"), c["line"])),
    )
    note = F.when(F.coalesce("is_rest", F.lit(False)), say("REST", *tail)).when(pitch.isNotNull(), say("NOTE_P", pitch.cast("string"), *tail))
    tokens = (
        F.when(F.col("tag") == "measure", F.array(say("<PART_", part, "_MEASURE_START>"), say("PART_", part), say("MEASURE_", measure)))
        .when(F.col("tag") == "attributes", attributes).when(F.col("tag") == "note", F.array(note))
        .when(F.col("tag") == "backup", F.array(say("BACKUP_", number("duration")))).when(F.col("tag") == "forward", F.array(say("FORWARD_", number("duration"))))
    )
    phase = F.when(F.col("tag") == "measure", 0).when(F.col("tag") == "attributes", 1).otherwise(2)
    kept = F.filter(tokens, lambda t: t.isNotNull())
    at = lambda phase, tokens: F.struct("part_idx", "measure_order", phase.alias("phase"), "child_pos", tokens.alias("tokens"))
    own, end = at(phase, kept), at(F.lit(3), F.array(say("<PART_", part, "_MEASURE_END>")))
    rows = elements.select("file", "side", F.explode(F.when(F.col("tag") == "measure", F.array(own, end)).otherwise(F.array(own))).alias("x"))
    listed = F.array_sort(F.collect_list(F.when(F.col("x.tokens").isNotNull(), F.col("x"))))
    return rows.groupBy("file", "side").agg(F.flatten(F.transform(listed, lambda x: x["tokens"])).alias("tokens"))


def timed_notes(elements: DataFrame) -> DataFrame:
    """(file, side, note_id, part_idx, measure_idx, pitch, pitch_class, start_beat, end_beat, staff, voice, tie_key) of parsed notes, rests left out;
    with ``ordinal`` if the elements have it.

    A beat is a quarter: clock over the divisions in force in the part. A measure starts where the one before ends, and
    lasts up to the latest end of a note, rest or forward in it. A note whose tie stops continues the one before it of the same part, pitch, voice and staff.
    """
    part = ["file", "side", "part_idx"]
    rows = clocked(elements)
    upto = Window.partitionBy(*part).orderBy("measure_order", "child_pos").rowsBetween(Window.unboundedPreceding, 0)
    given = F.when(F.col("tag") == "attributes", F.nullif(scalars.safe_int(F.col("divisions")), F.lit(0)))
    rows = rows.withColumn("divisions_in_force", F.coalesce(F.last(given, ignorenulls=True).over(upto), F.lit(1)))
    rows = rows.withColumn("from_beat", F.col("onset") / F.col("divisions_in_force")).withColumn("to_beat", (F.col("onset") + F.col("ticks")) / F.col("divisions_in_force"))
    measure = [*part, "measure_order"]
    whole = Window.partitionBy(*measure)
    length = F.coalesce(F.greatest(F.lit(0.0), F.max(F.when(F.col("tag").isin("note", "forward"), F.col("to_beat"))).over(whole)), F.lit(0.0))
    opening = F.row_number().over(whole.orderBy("child_pos")) == 1  # a measure's length counts once
    earlier = Window.partitionBy(*part).orderBy("measure_order").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("length", F.when(opening, length)).withColumn("opens", F.coalesce(F.sum("length").over(earlier), F.lit(0.0)))
    notes = rows.filter("tag = 'note' and not is_rest").withColumn("pitch", pitch_of(elements)).filter("pitch is not null")
    start, end = scalars.round_time(F.col("opens") + F.col("from_beat")), scalars.round_time(F.col("opens") + F.col("to_beat"))
    staff, voice = F.col("staff").try_cast("int"), F.nullif(F.trim("voice"), F.lit(""))
    out = notes.select(
        *part, "measure_order", "child_pos", "measure_idx", F.col("pitch").cast("int").alias("pitch"), start.alias("start_beat"), end.alias("end_beat"),
        staff.alias("staff"), voice.alias("voice"), F.coalesce(F.col("ties").contains("stop"), F.lit(False)).alias("goes_on"),
        *(c for c in elements.columns if c == "ordinal"),
    )
    chain = Window.partitionBy(*part, "pitch", "voice", "staff").orderBy("measure_order", "start_beat", "child_pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(chain)
    key = F.concat_ws("/", "pitch", F.coalesce("voice", F.lit("-")), F.coalesce(F.col("staff").cast("string"), F.lit("-")), number.cast("string"))
    note_id = F.col("measure_order").cast("bigint") * 1_000_000 + F.col("child_pos")
    return out.withColumn("tie_key", key).withColumn("note_id", note_id).drop("goes_on", "measure_order", "child_pos")


def merged_notes(notes: DataFrame) -> DataFrame:
    """``timed_notes`` with tied ones merged: attributes and measure of the first, duration up to the last end."""
    ordinal = [c for c in notes.columns if c == "ordinal"]  # that of the measure, so it changes no order
    first = F.struct("start_beat", "end_beat", "note_id", "pitch", "measure_idx", "staff", "voice", *ordinal)
    merged = notes.groupBy("file", "side", "part_idx", "tie_key").agg(F.min(first).alias("x"), F.max("end_beat").alias("end"), F.count("*").alias("n_merged"))
    duration = scalars.round_time(F.greatest(F.lit(0.0), F.col("end") - F.col("x.start_beat")))
    return merged.select(
        "file", "side", "part_idx", "x.note_id", "x.measure_idx", "x.pitch", F.pmod("x.pitch", F.lit(12)).alias("pitch_class"), F.col("x.start_beat").alias("onset_beat"),
        duration.alias("duration_beat"), "x.staff", "x.voice", "n_merged", *(f"x.{c}" for c in ordinal),
    )


def score_elements(files: DataFrame) -> DataFrame:
    """Element rows of score markup (file, content), parsed file by file; the columns are those of the source ``scores``, which needs no file in one cell.

    Each measure has a row of its own (tag ``measure``, child_pos -1) before those of its children. A file that doesn't parse, or has no
    part, has one row with an ``error`` and nothing else.
    """

    schema = to_arrow_schema(ELEMENTS)

    def parsed(file: str, content: str) -> Iterator[tuple]:
        pieces = [content[i : i + PIECE] for i in range(0, len(content), PIECE)]
        try:
            check(pieces)
        except (expat.ExpatError, ValueError) as e:
            yield broken_file(file, e)
        else:
            yield from element_rows(file, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = (row for file, content in zip(batch.column("file"), batch.column("content"), strict=True) for row in parsed(file.as_py(), content.as_py() or ""))
            while rows := list(islice(every, OUT_ROWS)):  # a batch of files has far more rows than files
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("file", "content").mapInArrow(run, ELEMENTS)
