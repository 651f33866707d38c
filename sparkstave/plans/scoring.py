"""Queries on scoring: bags, measures, events, histograms, timelines, matching, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkstave.functions import scalars
from sparkstave.operators import match, notes as nt, pairs, report, similarity
from sparkstave.plans import fixtures as fx
from sparkstave.session import table

QUERIES, SQL = {}, {}
N = f"WITH {fx.NOTES_SQL}"
SCORES = """CASE WHEN tp + fp = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scored(counts: str, by: str) -> str:
    """SQL of the ratios over a CTE body with tp, fp, fn."""
    return f"""s AS (SELECT {by}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {SCORES} FROM ({counts}))
SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END AS f1 FROM s"""


def bags(keys: str, by: str = "file", source: str = "notes") -> str:
    return f"""k AS (SELECT {keys}, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gt') AS ng FROM {source} GROUP BY ALL),
""" + scored(f"SELECT {by}, sum(least(np, ng)) AS tp, sum(np - least(np, ng)) AS fp, sum(ng - least(np, ng)) AS fn FROM k GROUP BY {by}", by)


for _mode, _keys in match.BAG_KEYS.items():
    query(f"a08_bag_f1_{_mode}", f"{N}, {bags('file, ' + ', '.join(_keys))}")(lambda spark, d, m=_mode: match.bag_f1(fx.notes(spark, d), m))

ORDINAL = "o AS (SELECT *, dense_rank() OVER (PARTITION BY file, side ORDER BY measure_idx) AS ordinal FROM notes)"
RANGE = "r AS (SELECT file, unnest(range(1, max(ordinal) + 1)) AS ordinal FROM o GROUP BY file)"
BOTH = "count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gt') AS ng"


@query("a10_measure_accuracy", f"""{N}, {ORDINAL}, {RANGE},
k AS (SELECT file, ordinal, part_idx, pitch, onset_beat, duration_beat, staff, {BOTH} FROM o GROUP BY ALL),
w AS (SELECT file, ordinal, max(CASE WHEN np <> ng THEN 1 ELSE 0 END) AS wrong FROM k GROUP BY ALL),
p AS (SELECT file, count(*) AS measures, CAST(sum(coalesce(wrong, 0)) AS BIGINT) AS wrong FROM r LEFT JOIN w USING (file, ordinal) GROUP BY file)
SELECT file, measures, measures - wrong AS correct, (measures - wrong) / CAST(measures AS DOUBLE) AS measure_accuracy, wrong / CAST(measures AS DOUBLE) AS ser FROM p""")
def a10(spark, d):
    return match.measure_accuracy(fx.notes(spark, d))


def measure_f1_sql(keys: str) -> str:
    """CTEs k, m and f: F1 of each measure position by part and keys."""
    return f"""k AS (SELECT file, ordinal, part_idx, {keys}, {BOTH} FROM o GROUP BY ALL),
m AS (SELECT file, ordinal, sum(least(np, ng)) AS tp, sum(np) AS np, sum(ng) AS ng FROM k GROUP BY ALL),
f AS (SELECT file, ordinal, CASE WHEN tp = 0 THEN 0e0 ELSE 2e0 * (CAST(tp AS DOUBLE) / np) * (CAST(tp AS DOUBLE) / ng) / (CAST(tp AS DOUBLE) / np + CAST(tp AS DOUBLE) / ng) END AS f1 FROM m)"""


@query("a11_measure_f1", f"""{N}, {ORDINAL}, {RANGE}, {measure_f1_sql('pitch, onset_beat')}
SELECT file, avg(coalesce(f1, 0e0)) AS avg_measure_f1 FROM r LEFT JOIN f USING (file, ordinal) GROUP BY file""")
def a11(spark, d):
    return match.measure_f1(fx.notes(spark, d), "pitch", "onset_beat")


EVENTS = """ev AS (SELECT file, side, 'key' AS kind, CAST(measure_idx AS VARCHAR) || ':' || pitch_class AS key FROM notes WHERE note_id % 3 = 0
UNION ALL SELECT file, side, 'time', CAST(measure_idx AS VARCHAR) || ':' || CAST(duration_beat * 4 AS INTEGER) FROM notes WHERE note_id % 3 = 1
UNION ALL SELECT file, side, 'clef', CAST(measure_idx AS VARCHAR) || ':' || pitch FROM notes WHERE note_id % 3 = 2)"""


@query("a13_attribute_event_f1", f"{N}, {EVENTS}, {bags('file, kind, key', 'file, kind', 'ev')}")
def a13(spark, d):
    n = fx.notes(spark, d)
    key = lambda c: F.concat(F.col("measure_idx").cast("string"), F.lit(":"), c.cast("string"))
    k = F.col("note_id") % 3
    kind = F.when(k == 0, "key").when(k == 1, "time").otherwise("clef")
    value = F.when(k == 0, key(F.col("pitch_class"))).when(k == 1, key((F.col("duration_beat") * 4).cast("int"))).otherwise(key(F.col("pitch")))
    return match.event_f1(n.select("file", "side", kind.alias("kind"), value.alias("key")))


def jsd_ctes(name: str, column: str) -> str:
    return f"""{name}_h AS (SELECT file, {column} AS bin, {BOTH} FROM notes GROUP BY ALL),
{name}_p AS (SELECT file, coalesce(np / nullif(CAST(sum(np) OVER (PARTITION BY file) AS DOUBLE), 0), 0) AS p, coalesce(ng / nullif(CAST(sum(ng) OVER (PARTITION BY file) AS DOUBLE), 0), 0) AS q FROM {name}_h),
{name} AS (SELECT file, sum(0.5e0 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0e0 END + 0.5e0 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0e0 END) AS jsd FROM {name}_p GROUP BY file)"""


@query("a14_pitch_class_divergence", f"{N}, {jsd_ctes('j', 'pitch_class')} SELECT file, round(jsd, 9) AS jsd FROM j")
def a14(spark, d):
    return match.divergence(match.pitch_class_histogram(fx.notes(spark, d))).withColumn("jsd", F.round("jsd", 9))


@query("a15_duration_divergence", f"{N}, {jsd_ctes('j', 'round(duration_beat, 6)')} SELECT file, round(jsd, 9) AS jsd FROM j")
def a15(spark, d):
    return match.divergence(match.duration_histogram(fx.notes(spark, d))).withColumn("jsd", F.round("jsd", 9))


FRAMED = """fr AS (SELECT file, side, pitch_class, CAST(greatest(0, floor(onset_beat / 0.25e0)) AS BIGINT) AS b,
CAST(greatest(greatest(0, floor(onset_beat / 0.25e0)) + 1, ceil((onset_beat + greatest(duration_beat, 0.25e0)) / 0.25e0)) AS BIGINT) AS e FROM notes),
fx AS (SELECT file, side, pitch_class, b, unnest(range(b, e)) AS frame FROM fr)"""


@query("a16_pitch_class_timeline_f1", f"{N}, {FRAMED}, t AS (SELECT DISTINCT file, side, frame, pitch_class AS slot FROM fx), {bags('file, frame, slot', 'file', 't')}")
def a16(spark, d):
    return match.framewise_f1(fx.notes(spark, d), "pitch_class")


@query("a16_rhythm_timeline_f1", f"{N}, {FRAMED}, t AS (SELECT DISTINCT file, side, frame, 0 AS slot FROM fx WHERE frame = b UNION ALL SELECT DISTINCT file, side, frame, 1 FROM fx), {bags('file, frame, slot', 'file', 't')}")
def a16b(spark, d):
    return match.framewise_f1(fx.notes(spark, d), "rhythm")


@query("a20_validity", """WITH v AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS available, coalesce(l.quality = 1, false) AS parsed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT count(*) AS expected, count(*) FILTER (available) AS available, count(*) FILTER (available AND parsed) AS parsed FROM v)
SELECT *, expected - available AS missing, available - parsed AS failed, parsed / CAST(expected AS DOUBLE) AS parse_rate FROM c""")
def a20(spark, d):
    l = table(spark, d, "labels").select(F.col("doc_id").alias("other"), "quality")  # noqa: E741
    pairs = table(spark, d, "documents").join(l, F.col("doc_id") == F.col("other"), "left")
    return report.validity(pairs.select(F.col("other").isNotNull().alias("available"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("parsed")))


FLAVOURS = {"basic": ("pitch", "onset", "duration"), "staff": ("pitch", "onset", "duration", "staff"), "rhythm": ("onset", "duration"), "pitch_class": ("pitch_class", "onset", "duration")}
IN_KEY = {"onset": "CAST(onset_beat * 4 AS INTEGER)", "duration": "CAST(duration_beat * 4 AS INTEGER)", "staff": "coalesce(CAST(staff AS VARCHAR), 'None')", "pitch": "pitch", "pitch_class": "pitch_class"}


@query("a30_measure_key_lists", f"{N} SELECT file, side, measure_idx, " + ", ".join(
    f"list_sort(list(CAST(part_idx AS VARCHAR) || {''.join(chr(39) + ':' + chr(39) + ' || ' + IN_KEY[c] + ' || ' for c in columns)[:-4]})) AS {name}" for name, columns in FLAVOURS.items()) + " FROM notes GROUP BY ALL")
def a30(spark, d):
    grid = lambda c: (F.col(c) * 4).cast("int")
    column = {"onset": grid("onset_beat"), "duration": grid("duration_beat"), "staff": F.coalesce(F.col("staff").cast("string"), F.lit("None")), "pitch": F.col("pitch"), "pitch_class": F.col("pitch_class")}
    return match.measure_key_lists(fx.notes(spark, d), {name: [column[c] for c in columns] for name, columns in FLAVOURS.items()})


@query("a25_tie_merge", f"""{N} SELECT file, part_idx, CAST(note_id % 9 AS BIGINT) AS tie_key, min(onset_beat) AS start_beat, max(onset_beat + duration_beat) AS end_beat,
arg_min(pitch, (onset_beat, onset_beat + duration_beat, pitch)) AS pitch, count(*) AS n_merged FROM notes WHERE side = 'gt' GROUP BY ALL""")
def a25(spark, d):
    n = fx.notes(spark, d).filter("side = 'gt'")
    return nt.merge_ties(n.select("file", "part_idx", (F.col("note_id") % 9).alias("tie_key"), F.col("onset_beat").alias("start_beat"), (F.col("onset_beat") + F.col("duration_beat")).alias("end_beat"), "pitch"))


ELEMENTS = """el AS (SELECT event_id, user_id AS file, CAST(floor(event_id / 500e0) AS BIGINT) AS measure, event_id AS child_pos, CASE event_type WHEN 'purchase' THEN 'backup' WHEN 'error' THEN 'forward' ELSE 'note' END AS tag,
event_type = 'view' AS is_chord, event_type = 'signup' AS is_rest, 1 + event_id % 4 AS duration FROM events)"""


def elements(spark, d):
    e = table(spark, d, "events")
    tag = F.when(F.col("event_type") == "purchase", "backup").when(F.col("event_type") == "error", "forward").otherwise("note")
    return e.select(
        "event_id", F.col("user_id").alias("file"), F.floor(F.col("event_id") / F.lit(500.0)).alias("measure"), F.col("event_id").alias("child_pos"), tag.alias("tag"),
        (F.col("event_type") == "view").alias("is_chord"), (F.col("event_type") == "signup").alias("is_rest"), (F.col("event_id") % 4 + 1).alias("duration"),
    )


CLOCK = f"""WITH {ELEMENTS}, c AS (SELECT *, CAST(coalesce(sum(CASE WHEN tag = 'note' AND NOT is_chord THEN duration WHEN tag = 'forward' THEN duration WHEN tag = 'backup' THEN -duration ELSE 0 END)
OVER (PARTITION BY file, measure ORDER BY child_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clock FROM el)"""


@query("w01_measure_clock", f"{CLOCK} SELECT event_id, file, clock FROM c")
def w01(spark, d):
    return nt.with_clock(elements(spark, d), "file", "measure").select("event_id", "file", "clock")


@query("w02_chord_onset", f"""{CLOCK} SELECT event_id, CASE WHEN is_chord THEN coalesce(last_value(CASE WHEN tag = 'note' AND NOT is_chord THEN clock END IGNORE NULLS)
OVER (PARTITION BY file, measure ORDER BY child_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), clock) ELSE clock END AS onset FROM c""")
def w02(spark, d):
    return nt.with_clock(elements(spark, d), "file", "measure").select("event_id", "onset")


@query("w03_measure_number", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'X1' ELSE CAST(event_id % 90 AS VARCHAR) END AS INTEGER), row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS measure_number FROM events""")
def w03(spark, d):
    from pyspark.sql import Window

    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    number = F.when(F.col("event_id") % 4 == 0, F.lit("X1")).otherwise((F.col("event_id") % 90).cast("string"))
    return table(spark, d, "events").select("event_id", nt.measure_number(number, ordinal).cast("bigint").alias("measure_number"))


@query("w05_note_index", f"""{N} SELECT note_id, side, row_number() OVER (PARTITION BY file, side ORDER BY measure_idx, part_idx, onset_beat, pitch, duration_beat, coalesce(CAST(staff AS VARCHAR), 'None'), coalesce(voice, 'None'), note_id) - 1 AS idx FROM notes""")
def w05(spark, d):
    return match.dense_note_index(fx.notes(spark, d)).select("note_id", "side", F.col("idx").cast("bigint").alias("idx"))


@query("j08_tempo_as_of", """WITH n AS (SELECT user_id, event_id, epoch_us(ts) AS tick FROM events), t AS (SELECT user_id, epoch_us(ts) AS tick, CAST(60 + event_id % 120 AS DOUBLE) AS bpm FROM events WHERE event_type = 'signup'),
t1 AS (SELECT user_id, tick, max(bpm) AS bpm FROM t GROUP BY ALL), f AS (SELECT user_id, arg_min(bpm, (tick, bpm)) AS bpm FROM t GROUP BY user_id)
SELECT CAST(n.user_id AS VARCHAR) AS file, n.tick, n.event_id AS note_id, coalesce(a.bpm, f.bpm, 120e0) AS bpm FROM n ASOF LEFT JOIN t1 a ON n.user_id = a.user_id AND n.tick >= a.tick LEFT JOIN f ON n.user_id = f.user_id""")
def j08(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"), F.col("event_id").alias("note_id"), "event_type")
    tempi = e.filter("event_type = 'signup'").select("file", "tick", (F.col("note_id") % 120 + 60).cast("double").alias("bpm"))
    return nt.tempo_in_force(e.select("file", "tick", "note_id"), tempi)


@query("j09_interval_measure", """WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id FROM events),
s AS (SELECT user_id, CAST(k AS INTEGER) AS measure_idx, k * 2e0 AS a, k * 2e0 + CASE WHEN k % 5 = 0 THEN 1e0 WHEN k % 7 = 0 THEN 5e0 ELSE 2e0 END AS b FROM m),
n AS (SELECT user_id, event_id AS note_id, (event_id % 300) * 0.5e0 AS x FROM events), z AS (SELECT user_id, arg_max(b, (a, b, measure_idx)) AS b, arg_max(measure_idx, (a, b, measure_idx)) AS k FROM s GROUP BY user_id)
SELECT CAST(n.user_id AS VARCHAR) AS file, n.note_id, any_value(n.x) AS onset_beat, coalesce(arg_min(s.measure_idx, (s.a, s.b, s.measure_idx)), any_value(CASE WHEN n.x = z.b THEN z.k END), 0) AS measure_idx
FROM n LEFT JOIN s ON n.user_id = s.user_id AND n.x >= s.a AND n.x < s.b LEFT JOIN z ON n.user_id = z.user_id GROUP BY n.user_id, n.note_id""")
def j09(spark, d):
    """Spans from all events of a user, some shorter than their place and some over the next ones."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("k"))
    file, k = F.col("user_id").cast("string").alias("file"), F.col("k")
    start = k * F.lit(2.0)
    spans = e.select(file, start.alias("m_start"), (start + F.when(k % 5 == 0, 1.0).when(k % 7 == 0, 5.0).otherwise(2.0)).alias("m_end"), k.cast("int").alias("measure_idx"))
    points = e.select(file, ((F.col("event_id") % 300) * F.lit(0.5)).alias("onset_beat"), F.col("event_id").alias("note_id"))
    return nt.measure_of(points, spans)


#: Per timed mode: what else must be equal, whether durations are compared, and what the cost adds to the differences.
TIMED = {
    "pitch_onset": ("p.pitch = g.pitch", False, "abs(p.pitch - g.pitch) / 128e0 * 0.05e0"), "pitch_onset_duration": ("p.pitch = g.pitch", True, "abs(p.pitch - g.pitch) / 128e0 * 0.05e0"),
    "pitch_onset_duration_staff": ("p.pitch = g.pitch AND p.staff IS NOT DISTINCT FROM g.staff", True, "abs(p.pitch - g.pitch) / 128e0 * 0.05e0"),
    "pitch_onset_duration_voice": ("p.pitch = g.pitch AND p.voice IS NOT DISTINCT FROM g.voice", True, "abs(p.pitch - g.pitch) / 128e0 * 0.05e0"),
    "rhythm": ("true", True, "0e0"), "pitch_class_onset_duration": ("p.pitch_class = g.pitch_class", True, "CASE WHEN p.pitch_class = g.pitch_class THEN 0e0 ELSE 1e0 END * 0.05e0"),
}
INDEXED = """i AS (SELECT *, row_number() OVER (PARTITION BY grp, side ORDER BY measure_idx, part_idx, onset_beat, pitch, duration_beat, coalesce(CAST(staff AS VARCHAR), 'None'), coalesce(voice, 'None'), note_id) - 1 AS idx FROM keyed)"""


def greedy_sql(mode: str, group: str) -> str:
    """CTEs that end in ``s``: tp, fp, fn and ratios of each group, pairs taken one after the other by (cost, i, j)."""
    same, durations, more = TIMED[mode]
    cost = "abs(p.onset_beat - g.onset_beat)" + (" + abs(p.duration_beat - g.duration_beat)" if durations else "") + f" + {more}"
    near = "abs(p.onset_beat - g.onset_beat) <= 0.25e0" + (" AND abs(p.duration_beat - g.duration_beat) <= 0.25e0" if durations else "")
    return f"""keyed AS (SELECT *, {group} AS grp FROM notes), {INDEXED},
c AS (SELECT p.grp, p.idx AS i, g.idx AS j, {cost} AS cost FROM i p JOIN i g ON p.grp = g.grp AND p.part_idx = g.part_idx AND p.side = 'pred' AND g.side = 'gt' AND {same} AND {near}),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cost, i, j) AS r FROM c),
walk AS (
  SELECT grp, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ui, CAST([] AS BIGINT[]) AS uj FROM (SELECT DISTINCT grp FROM ranked)
  UNION ALL
  SELECT w.grp, n.r, CASE WHEN list_contains(ui, n.i) OR list_contains(uj, n.j) THEN ui ELSE list_append(ui, n.i) END, CASE WHEN list_contains(ui, n.i) OR list_contains(uj, n.j) THEN uj ELSE list_append(uj, n.j) END
  FROM walk w JOIN ranked n ON n.grp = w.grp AND n.r = w.r + 1),
t AS (SELECT grp, max(len(ui)) AS tp FROM walk GROUP BY grp),
z AS (SELECT grp, {BOTH} FROM keyed GROUP BY grp),
""" + scored("SELECT z.grp, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, ng - coalesce(tp, 0) AS fn FROM z LEFT JOIN t ON z.grp = t.grp", "grp")


for _mode in match.MATCH_KEYS:
    _sql = f"WITH RECURSIVE {fx.NOTES_SQL}, " + greedy_sql(_mode, "file").replace("SELECT *, CASE WHEN precision", "SELECT grp AS file, * EXCLUDE (grp), CASE WHEN precision") if _mode in TIMED else f"{N}, {bags(f'file, part_idx, {_mode}')}"
    query(f"j10_j11_match_{_mode}", _sql)(lambda spark, d, m=_mode: match.tolerant_scores(fx.notes(spark, d), m, 0.25, 0.25))

query("j10_zero_tolerance", f"{N}, {bags('file, part_idx, pitch, onset_beat, duration_beat')}")(lambda spark, d: match.tolerant_scores(fx.notes(spark, d), "pitch_onset_duration", 0.0, 0.0))


@query("j10_tolerance_pairs", f"""{N}, i AS (SELECT *, row_number() OVER (PARTITION BY file, side ORDER BY measure_idx, part_idx, onset_beat, pitch, duration_beat, coalesce(CAST(staff AS VARCHAR), 'None'), coalesce(voice, 'None'), note_id) - 1 AS idx FROM notes)
SELECT p.file, p.idx AS i, g.idx AS j, abs(p.onset_beat - g.onset_beat) + abs(p.duration_beat - g.duration_beat) + abs(p.pitch - g.pitch) / 128e0 * 0.05e0 AS cost
FROM i p JOIN i g ON p.file = g.file AND p.part_idx = g.part_idx AND p.pitch = g.pitch AND p.side = 'pred' AND g.side = 'gt' AND abs(p.onset_beat - g.onset_beat) <= 0.25e0 AND abs(p.duration_beat - g.duration_beat) <= 0.25e0""")
def j10(spark, d):
    pairs = match.candidate_pairs(match.dense_note_index(fx.notes(spark, d)), "pitch_onset_duration", 0.25, 0.25)
    return pairs.select("file", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "cost")


@query("a12_soft_measure_f1", f"WITH RECURSIVE {fx.NOTES_SQL}, " + greedy_sql("pitch_onset_duration", "file || '/' || measure_idx").replace("SELECT *, CASE WHEN precision", ", f AS (SELECT *, CASE WHEN precision") + ") SELECT split_part(grp, '/', 1) AS file, avg(f1) AS avg_soft_f1 FROM f GROUP BY 1")
def a12(spark, d):
    return match.soft_measure_f1(fx.notes(spark, d), "pitch_onset_duration", 0.25, 0.25)


def dtw_ctes(name: str, cells: str) -> str:
    """CTE ``name`` (file, similarity): warping of the two sides' timelines, row by row of the table; ``cells`` has (file, side, frame, slot)."""
    inf = "{'c': CAST('inf' AS DOUBLE), 's': CAST(0 AS BIGINT)}"
    near = "CASE WHEN x[i + 1] = 0 AND y[j] = 0 THEN 1e0 WHEN x[i + 1] = 0 OR y[j] = 0 THEN 0e0 ELSE bit_count(x[i + 1] & y[j]) / (sqrt(CAST(bit_count(x[i + 1]) AS DOUBLE)) * sqrt(CAST(bit_count(y[j]) AS DOUBLE))) END"
    cost = f"least(st[j + 1].c, acc[-1].c, st[j].c) + (1e0 - {near})"
    steps = "CASE WHEN st[j].c < least(st[j + 1].c, acc[-1].c) THEN st[j].s WHEN acc[-1].c < st[j + 1].c THEN acc[-1].s ELSE st[j + 1].s END + 1"
    return f"""{name}_m AS (SELECT file, side, frame, CAST(sum(1 << slot) AS BIGINT) AS mask FROM (SELECT DISTINCT file, side, frame, slot FROM {cells}) GROUP BY ALL),
{name}_g AS (SELECT file, side, unnest(range(0, max(frame) + 1)) AS frame FROM {name}_m GROUP BY file, side),
{name}_d AS (SELECT g.file, g.side, list(coalesce(m.mask, 0) ORDER BY g.frame) AS v FROM {name}_g g LEFT JOIN {name}_m m ON g.file = m.file AND g.side = m.side AND g.frame = m.frame GROUP BY g.file, g.side),
{name}_b AS MATERIALIZED (SELECT p.file, p.v AS x, g.v AS y, greatest(abs(len(p.v) - len(g.v)), CAST(ceil(greatest(len(p.v), len(g.v)) * 0.1e0) AS BIGINT)) AS band FROM {name}_d p JOIN {name}_d g ON p.file = g.file AND p.side = 'pred' AND g.side = 'gt'),
{name}_w AS (
  SELECT file, x, y, band, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN {{'c': 0e0, 's': CAST(0 AS BIGINT)}} ELSE {inf} END) AS st FROM {name}_b
  UNION ALL
  SELECT file, x, y, band, i + 1, list_reduce(range(1, len(y) + 1), lambda acc, j: list_append(acc, CASE WHEN abs(i + 1 - j) > band THEN {inf} ELSE {{'c': {cost}, 's': {steps}}} END), [{inf}])
  FROM {name}_w WHERE i < len(x)),
{name} AS (SELECT d.file, coalesce(any_value(greatest(0e0, 1 - w.st[-1].c / w.st[-1].s)), 0e0) AS similarity FROM {name}_d d LEFT JOIN {name}_w w ON d.file = w.file AND w.i = len(w.x) GROUP BY d.file)"""


@query("f33_timeline_dtw", f"WITH RECURSIVE {fx.NOTES_SQL}, {FRAMED}, t AS (SELECT DISTINCT file, side, frame, pitch_class AS slot FROM fx), {dtw_ctes('w', 't')} SELECT file, round(similarity, 9) AS similarity FROM w")
def f33(spark, d):
    return similarity.timeline_dtw(match.timeline(fx.notes(spark, d), "pitch_class")).withColumn("similarity", F.round("similarity", 9))


def _scores(spark, d, metrics=None):
    n = fx.score_parts(spark, d)
    return pairs.pair_scores(fx.parsed_scores(spark, d, n), metrics=metrics, parts=n)


PAIRS = f"WITH {fx.SCORES_SQL}"
PRF = "CASE WHEN np = 0 THEN 0e0 ELSE tp / CAST(np AS DOUBLE) END AS p, CASE WHEN ng = 0 THEN 0e0 ELSE tp / CAST(ng AS DOUBLE) END AS r"


def bag_ctes(name: str, keys: str, source: str = "notes", by: str = "file") -> str:
    """CTE ``name``: tp, fn, p, r and f1 by bag overlap of the keys."""
    return f"""{name}_k AS (SELECT {by}, {keys}, {BOTH} FROM {source} GROUP BY ALL),
{name}_s AS (SELECT {by}, tp, ng - tp AS fn, {PRF} FROM (SELECT {by}, sum(least(np, ng)) AS tp, sum(np) AS np, sum(ng) AS ng FROM {name}_k GROUP BY {by})),
{name} AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2e0 * p * r / (p + r) END AS f1 FROM {name}_s)"""


MODE_KEYS = {
    "pitch": "part_idx, pitch", "pitch_class": "part_idx, pitch_class", "pitch_onset": "part_idx, pitch, onset_beat", "pitch_onset_duration": "part_idx, pitch, onset_beat, duration_beat",
    "pitch_onset_duration_staff": "part_idx, pitch, onset_beat, duration_beat, staff", "pitch_onset_duration_voice": "part_idx, pitch, onset_beat, duration_beat, voice",
    "rhythm": "part_idx, onset_beat, duration_beat", "pitch_class_onset_duration": "part_idx, pitch_class, onset_beat, duration_beat",
}
MEASURE_KEYS = {"note": "pitch, onset_beat, duration_beat", "rhythm": "onset_beat, duration_beat", "pitch_class": "pitch_class, onset_beat, duration_beat"}
KINDS = {"key": "fifths", "time": "beats || ':4'", "clef": "'1:' || sign || ':2'"}


def relational_sql() -> tuple[str, dict[str, str]]:
    """CTEs that end in ``rel`` (a row a file), and its columns."""
    ctes, columns, joins = [FRAMED.replace("FROM notes", "FROM notes")], {}, []
    for mode, keys in MODE_KEYS.items():
        ctes.append(bag_ctes(f"m_{mode}", keys))
        columns |= {f"{mode}_precision": f"m_{mode}.p", f"{mode}_recall": f"m_{mode}.r", f"{mode}_f1": f"m_{mode}.f1", f"{mode}_tp": f"m_{mode}.tp", f"{mode}_fn": f"m_{mode}.fn"}
        joins.append(f"m_{mode}")
    ctes.append("ms AS (SELECT DISTINCT file, side, measure_idx FROM attrs)")
    ctes.append("pos AS (SELECT *, row_number() OVER (PARTITION BY file, side ORDER BY measure_idx) AS ordinal FROM ms)")
    ctes.append("rg AS (SELECT file, unnest(range(1, max(ordinal) + 1)) AS ordinal FROM pos GROUP BY file)")
    ctes.append("pl AS (SELECT n.*, ordinal FROM notes n JOIN pos USING (file, side, measure_idx))")
    ctes.append(f"ac_k AS (SELECT file, ordinal, part_idx, pitch, onset_beat, duration_beat, staff, {BOTH} FROM pl GROUP BY ALL)")
    ctes.append("ac_w AS (SELECT file, ordinal, max(CASE WHEN np <> ng THEN 1 ELSE 0 END) AS wrong FROM ac_k GROUP BY ALL)")
    ctes.append("ac AS (SELECT file, count(*) AS total, count(*) - sum(coalesce(wrong, 0)) AS correct FROM rg LEFT JOIN ac_w USING (file, ordinal) GROUP BY file)")
    columns |= {"measure_accuracy": "ac.correct / CAST(ac.total AS DOUBLE)", "ser": "(ac.total - ac.correct) / CAST(ac.total AS DOUBLE)", "correct_measures": "ac.correct", "wrong_measures": "ac.total - ac.correct", "total_measures": "ac.total"}
    joins.append("ac")
    for name, keys in MEASURE_KEYS.items():
        ctes.append(bag_ctes(f"o_{name}", f"part_idx, {keys}", "pl", "file, ordinal"))
        ctes.append(f"om_{name} AS (SELECT file, avg(coalesce(f1, 0e0)) AS v FROM rg LEFT JOIN o_{name} USING (file, ordinal) GROUP BY file)")
        columns[f"avg_measure_{name}_f1"] = f"om_{name}.v"
        joins.append(f"om_{name}")
    ctes.append("every AS (SELECT DISTINCT file, measure_idx FROM ms)")
    for name, mode in (("note", "pitch_onset_duration"), ("pitch_class", "pitch_class_onset_duration")):
        ctes.append(bag_ctes(f"s_{name}", MODE_KEYS[mode], "notes", "file, measure_idx"))
        ctes.append(f"sm_{name} AS (SELECT file, avg(coalesce(f1, 0e0)) AS v FROM every LEFT JOIN s_{name} USING (file, measure_idx) GROUP BY file)")
        columns[f"avg_measure_soft_{name}_f1"] = f"sm_{name}.v"
        joins.append(f"sm_{name}")
    for kind, value in KINDS.items():
        ctes.append(bag_ctes(f"e_{kind}", "event", f"(SELECT file, side, part_idx || ':' || measure_idx || ':' || {value} AS event FROM attrs)"))
        columns[f"{kind}_event_f1"] = f"e_{kind}.f1"
        joins.append(f"e_{kind}")
    for name, column in (("pitch_class", "pitch_class"), ("duration", "round(duration_beat, 6)")):
        ctes.append(jsd_ctes(f"j_{name}", column))
        columns[f"{name}_histogram_jsd"] = f"j_{name}.jsd"
        joins.append(f"j_{name}")
    ctes.append("t_pc AS (SELECT DISTINCT file, side, frame, pitch_class AS slot FROM fx)")
    ctes.append("t_rh AS (SELECT DISTINCT file, side, frame, 0 AS slot FROM fx WHERE frame = b UNION ALL SELECT DISTINCT file, side, frame, 1 FROM fx)")
    for name, source in (("pitch_class", "t_pc"), ("rhythm", "t_rh")):
        ctes.append(bag_ctes(f"f_{name}", "frame, slot", source))
        columns[f"{name}_timeline_f1"] = f"f_{name}.f1"
        joins.append(f"f_{name}")
    for name, source in (("notes", "notes"), ("measures", "ms"), ("notes_before_tie_merge", "notes"), ("notes_after_tie_merge", "notes")):
        ctes.append(f"c_{name} AS (SELECT file, {BOTH} FROM {source} GROUP BY file)")
        columns |= {f"pred_{name}": f"c_{name}.np", f"gt_{name}": f"c_{name}.ng"}
        joins.append(f"c_{name}")
    columns |= {f"{side}_tie_merged_notes": "0" for side in ("pred", "gt")}
    body = ",\n".join(ctes)
    picked = ", ".join(f"CAST(coalesce({x}, 0) AS DOUBLE) AS {k}" for k, x in columns.items())
    joined = " ".join(f"LEFT JOIN {j} ON f.file = {j}.file" for j in joins)
    return f"{PAIRS}, {body},\nrel AS (SELECT f.file, {picked} FROM (SELECT DISTINCT file FROM attrs) f {joined})", columns


REL, REL_COLUMNS = relational_sql()


SAID = """said AS (SELECT file, side, part_idx, measure_idx, 0 AS phase, 0 AS i, 0 AS sub, ['<PART_' || part_idx || '_MEASURE_START>', 'PART_' || part_idx, 'MEASURE_' || measure_idx] AS toks FROM attrs
UNION ALL SELECT file, side, part_idx, measure_idx, 1, 0, 0, list_concat(CASE WHEN measure_order = 1 THEN ['DIV_2'] ELSE [] END, ['TIME_' || beats || '_4', 'KEY_' || fifths, 'CLEF_1_' || sign || '_2']) FROM attrs
UNION ALL SELECT file, side, part_idx, measure_idx, 2, i, sub, [CASE WHEN tag = 'note' THEN CASE WHEN rest THEN 'REST' ELSE 'NOTE_P' || pitch END || '_D' || dur || '_S' || coalesce(staff, 0) || '_V' || coalesce(voice, '') ELSE upper(tag) || '_' || dur END] FROM el
UNION ALL SELECT file, side, part_idx, measure_idx, 3, 0, 0, ['<PART_' || part_idx || '_MEASURE_END>'] FROM attrs)"""
TOKENS = "SELECT file, side, flatten(list(toks ORDER BY part_idx, measure_idx, phase, i, sub)) AS tokens FROM said GROUP BY file, side"
DISTANCE = """ed_p AS MATERIALIZED (SELECT f.file, coalesce(p.tokens, []) AS x, coalesce(g.tokens, []) AS y FROM (SELECT DISTINCT file FROM tk) f LEFT JOIN tk p ON p.file = f.file AND p.side = 'pred' LEFT JOIN tk g ON g.file = f.file AND g.side = 'gt'),
ed_w AS (
  SELECT file, x, y, 0 AS i, range(0, len(y) + 1) AS st FROM ed_p
  UNION ALL
  SELECT file, x, y, i + 1, list_reduce(range(1, len(y) + 1), lambda acc, j: list_append(acc, least(acc[-1] + 1, st[j + 1] + 1, st[j] + CASE WHEN x[i + 1] = y[j] THEN 0 ELSE 1 END)), [CAST(i + 1 AS BIGINT)])
  FROM ed_w WHERE i < len(x)),
ed AS (SELECT file, CAST(st[-1] AS DOUBLE) AS distance, st[-1] / CAST(greatest(len(y), 1) AS DOUBLE) AS normalized FROM ed_w WHERE i = len(x))"""
#: Ends in ``every``: a row a file with all metrics.
EVERY = f"""{REL.replace("WITH ", "WITH RECURSIVE ", 1)}, {SAID}, tk AS ({TOKENS}), {DISTANCE}, {dtw_ctes("dw_pitch_class", "t_pc")}, {dtw_ctes("dw_rhythm", "t_rh")},
raw AS (SELECT rel.*, ed.distance AS xml_structure_edit_distance, ed.normalized AS xml_normalized_structure_edit_distance, coalesce(a.similarity, 1e0) AS pitch_class_timeline_dtw_similarity,
  coalesce(b.similarity, 1e0) AS rhythm_timeline_dtw_similarity, 0e0 AS onset_tolerance_beats, 0e0 AS duration_tolerance_beats
  FROM rel JOIN ed ON rel.file = ed.file LEFT JOIN dw_pitch_class a ON rel.file = a.file LEFT JOIN dw_rhythm b ON rel.file = b.file),
every_file AS (SELECT *, 0.30e0 * pitch_class_f1 + 0.25e0 * rhythm_f1 + 0.20e0 * pitch_class_onset_duration_f1 + 0.15e0 * pitch_class_timeline_dtw_similarity + 0.10e0 * rhythm_timeline_dtw_similarity AS music_content_score,
  0.35e0 * pitch_onset_duration_staff_f1 + 0.25e0 * measure_accuracy + 0.15e0 * key_event_f1 + 0.15e0 * time_event_f1 + 0.10e0 * greatest(0e0, 1e0 - xml_normalized_structure_edit_distance / 10.0e0) AS notation_score FROM raw)"""
EVERY_COLUMNS = [
    *REL_COLUMNS, "xml_structure_edit_distance", "xml_normalized_structure_edit_distance", "pitch_class_timeline_dtw_similarity", "rhythm_timeline_dtw_similarity",
    "onset_tolerance_beats", "duration_tolerance_beats", "music_content_score", "notation_score",
]


@query("f09_structure_tokens", f"{PAIRS}, {SAID} {TOKENS}")
def f09(spark, d):
    return nt.structure_tokens(fx.parsed_scores(spark, d))


@query("e2_pair_scores", f"{EVERY} SELECT file, " + ", ".join(f"round({c}, 9) AS {c}" for c in EVERY_COLUMNS) + " FROM every_file")
def e2(spark, d):
    """All metrics of a pair, from markup to composites."""
    return _scores(spark, d).select("file", *[F.round(c, 9).alias(c) for c in EVERY_COLUMNS])


@query("f34_composites", f"{EVERY} SELECT file, round(music_content_score, 9) AS music_content_score, round(notation_score, 9) AS notation_score FROM every_file")
def f34(spark, d):
    return _scores(spark, d, pairs.COMPOSED).select("file", *[F.round(c, 9).alias(c) for c in ("music_content_score", "notation_score")])


@query("a17_19_summary", f"""{EVERY}, q AS (SELECT *, CASE CAST(file AS INTEGER) % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'light' ELSE 'heavy' END AS "group" FROM every_file)
SELECT CASE WHEN grouping("group") = 1 THEN 'overall' ELSE "group" END AS "group", CAST(grouping("group") AS TINYINT) AS is_overall, count(*) AS num_files, sum(correct_measures) / sum(total_measures) AS strict_measure_accuracy,
sum(wrong_measures) / sum(total_measures) AS ser, """ + ", ".join(f"round(avg({m}), 9) AS avg_{m}" for m in pairs.MEANS) + """ FROM q GROUP BY ROLLUP ("group")""")
def a19(spark, d):
    """All 32 columns by variant and over all."""
    variant = F.element_at(F.array(F.lit("clean"), F.lit("light"), F.lit("heavy")), (F.col("file").cast("int") % 3 + 1).cast("int"))
    out = pairs.summary(_scores(spark, d).withColumn("group", variant))
    return out.select("group", "is_overall", "num_files", "strict_measure_accuracy", "ser", *[F.round(f"avg_{m}", 9).alias(f"avg_{m}") for m in pairs.MEANS])


@query("f32_cosine", """SELECT a.vec_id, CASE WHEN na = 0 AND nb = 0 THEN 1e0 WHEN na = 0 OR nb = 0 THEN 0e0 ELSE round(dot / (na * nb), 6) END AS cosine FROM (
SELECT x.vec_id, list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) AS dot, sqrt(list_sum(list_transform(x.v, lambda p: p * p))) AS na, sqrt(list_sum(list_transform(y.v, lambda p: p * p))) AS nb
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) x JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) y ON x.vec_id = y.vec_id) a""")
def f32(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(after, "vec_id").select("vec_id", F.round(scalars.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("a29_mean_vectors", """WITH c AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 9) AS mean FROM c GROUP BY label, pos""")
def a29(spark, d):
    return similarity.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 9))


@query("a27_token_accuracy", """WITH l AS (SELECT event_id % 50 AS batch_id, CASE WHEN event_id % 17 = 0 THEN -100 ELSE event_id % 10 END AS label, list_transform(range(0, 5), lambda k: (event_id + k * (event_id % 3)) % 12) AS top5 FROM events),
b AS (SELECT batch_id, count(*) AS n, sum(CASE WHEN top5[1] = label THEN 1e0 ELSE 0e0 END) AS h, sum(CASE WHEN list_contains(top5, label) THEN 1e0 ELSE 0e0 END) AS h5 FROM l WHERE label <> -100 GROUP BY batch_id)
SELECT sum(h) / sum(n) AS accuracy, sum(h5) / sum(n) AS top5_accuracy, avg(h / n) AS batch_accuracy, avg(h5 / n) AS batch_top5_accuracy FROM b""")
def a27(spark, d):
    i = F.col("event_id")
    top5 = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (i + k * (i % 3)) % 12)
    return similarity.token_accuracy(table(spark, d, "events").select((i % 50).alias("batch_id"), F.when(i % 17 == 0, F.lit(-100)).otherwise(i % 10).alias("label"), top5.alias("top5")))


@query("a32_failures", """SELECT lang AS "group", CASE WHEN n_chars < 100 THEN 'short' ELSE 'long' END AS error, count(*) AS n FROM documents WHERE n_chars < 100 OR n_chars > 5000 GROUP BY ALL""")
def a32(spark, d):
    n = F.col("n_chars")
    return report.failures(table(spark, d, "documents").select(F.col("lang").alias("group"), F.when(n < 100, "short").when(n > 5000, "long").alias("error")))
