"""One value far from all others, one hot key or one long file decides neither memory nor results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkstave.operators import match, notes, similarity, split

NOTE = "file string, side string, note_id bigint, part_idx int, measure_idx int, onset_beat double, duration_beat double, pitch int, pitch_class int, staff int, voice string"


def test_spans_of_any_length(spark):
    r = random.Random(1)
    spans = [(f"f{r.randrange(3)}", a := r.randrange(-400, 400) / 4, a + r.choice((0.0, 0.25, 1, 4, 17, 100)), k) for k in range(150)] + [("f1", -1e8, 1e8, 900), ("f2", 1e17, 4e18, 901)]
    points = [(f"f{r.randrange(4)}", k, r.randrange(-800, 800) / 8) for k in range(300)] + [("f1", 1000, 1e8), ("f1", 1001, -5e7), ("f2", 1002, 2e18), ("f0", 1003, None)]
    want = {}
    for f, k, x in points:
        mine = sorted((a, b, m) for g, a, b, m in spans if g == f)
        own = [m for a, b, m in mine if x is not None and a <= x < b]
        at_end = bool(mine) and x is not None and abs(x - mine[-1][1]) <= 1e-9 * max(abs(x), abs(mine[-1][1]))
        want[k] = own[0] if own else mine[-1][2] if at_end else 0
    got = notes.measure_of(spark.createDataFrame(points, "file string, note_id bigint, onset_beat double"), spark.createDataFrame(spans, "file string, m_start double, m_end double, measure_idx int"))
    assert {r["note_id"]: r["measure_idx"] for r in got.collect()} == want


@pytest.mark.parametrize("kind", ["pitch_class", "rhythm"])
def test_sweep_equals_frames(spark, kind, monkeypatch):
    monkeypatch.setattr(match, "SWEEP", 8)
    r = random.Random(2)
    rows = [(f"f{r.randrange(3)}", r.choice(("gt", "pred")), k, 0, 0, r.randrange(-8, 200) / 8, r.choice((0.0, 0.1, 0.25, 1.0, 9.3)), p := r.randrange(60, 66), p % 12, 1, None) for k in range(200)]
    df = spark.createDataFrame([*rows, ("f9", "gt", 1, 0, 0, 1.0, 1.0, 60, 0, 1, None)], NOTE)
    frames = match.with_scores(match.overlap(match.side_counts(match.timeline(df, kind), "file", "frame", "slot"), "file"))
    columns = ["file", "tp", "fp", "fn", "precision", "recall", "f1"]
    assert sorted(map(tuple, match.framewise_f1(df, kind).select(*columns).collect())) == sorted(map(tuple, frames.select(*columns).collect()))


def test_a_long_note_is_two_rows(spark):
    df = spark.createDataFrame([("f", side, 0, 0, 0, 0.0, beats, 60, 0, 1, None) for side, beats in (("gt", 1e7), ("pred", 5e6))], NOTE)
    got = match.framewise_f1(df, "pitch_class").first()
    assert (got["tp"], got["fp"], got["fn"]) == (20_000_000, 0, 20_000_000)


def test_tempo_of_a_long_file_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(notes, "RANGE_ROWS", 20)
    r = random.Random(3)
    tempi = [("f", r.randrange(5000), float(r.randrange(60, 180))) for _ in range(30)] + [("g", 4000, 90.0), ("g", 4000, 91.0)]
    rows = [(f, r.randrange(6000), k) for k, f in enumerate(["f"] * 300 + ["g"] * 30 + ["h"] * 5)]
    want = {}
    for f, tick, k in rows:
        mine = sorted((t, b) for g, t, b in tempi if g == f)
        want[k] = ([b for t, b in mine if t <= tick] or [b for _, b in mine[:1]] or [120.0])[-1]
    got = notes.tempo_in_force(spark.createDataFrame(rows, "file string, tick bigint, note_id bigint"), spark.createDataFrame(tempi, "file string, tick bigint, bpm double"))
    assert {r["note_id"]: r["bpm"] for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_selected_quantiles(spark, seed, monkeypatch):
    monkeypatch.setattr(split, "RANGES", 4)  # several rounds
    r = np.random.default_rng(seed)
    values = [r.integers(-9, 9, 50), r.integers(-(2**62), 2**62, 40), np.full(30, 7), r.integers(0, 3, 1)][seed]
    rows = [(f"g{i % 2}", int(v)) for i, v in enumerate(values)] + [("g0", None)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    for g, (n, low, high, q) in split.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0), "g").items():
        own = np.array([v for k, v in rows if k == g and v is not None])
        assert (n, low, high) == (len(own), own.min(), own.max()) and np.allclose(q, np.quantile(own.astype(float), (0.0, 0.25, 0.5, 0.9, 1.0)))
    assert split.exact_quantiles(df.filter("false"), "v") == {}


def test_ranks_of_a_common_size(spark, monkeypatch):
    monkeypatch.setattr(split, "RUN", 7)
    df = spark.createDataFrame([(k * 7 % 101, k % 3, "s") for k in range(100)], "origin int, total_tokens bigint, stratum string")
    got = split.rank_in_run(df)
    for size in range(3):
        mine = got.filter(F.col("total_tokens") == size).orderBy("origin").collect()
        assert [r["rank"] for r in mine] == list(range(len(mine)))


def test_timelines_of_many_lengths_warp_together():
    r = np.random.default_rng(4)
    lines = [[r.integers(0, 8, r.integers(0, 25)) for _ in range(2)] for _ in range(60)]
    n, m = (np.array([len(pair[k]) for pair in lines]) for k in range(2))
    x, y = (np.zeros((60, 25), np.int64) for _ in range(2))
    for i, (a, b) in enumerate(lines):
        x[i, : len(a)], y[i, : len(b)] = a, b
    alone = [similarity.dtw_similarities(a[None].reshape(1, -1), b[None].reshape(1, -1))[0] for a, b in lines]
    assert np.allclose(similarity.dtw_similarities(x, y, n=n, m=m), alone)


def test_wanted_metrics_only(spark, small_dir):
    from sparkstave.operators import pairs
    from sparkstave.plans import fixtures

    elements = fixtures.parsed_scores(spark, small_dir)
    some = pairs.pair_scores(elements, metrics=("rhythm_f1", "ser"))
    assert {"rhythm_f1", "ser", "measure_accuracy"} < set(some.columns) and not {c for c in some.columns if "timeline" in c or "edit" in c}
    every = {x["file"]: (x["rhythm_f1"], x["ser"]) for x in pairs.pair_scores(elements).collect()}
    assert {x["file"]: (x["rhythm_f1"], x["ser"]) for x in some.collect()} == every


def test_notes_are_shuffled_once_not_by_each_family(spark, small_dir):
    """Files lie in buckets, so families without a join shuffle only what they have found; rows of a file that come from several tasks are brought together first."""
    from sparkstave.operators import pairs
    from sparkstave.plans import fixtures

    names = ("rhythm_f1", "key_event_f1", "xml_structure_edit_distance", "duration_histogram_jsd", "pitch_class_timeline_dtw_similarity", "rhythm_timeline_dtw_similarity", "rhythm_timeline_f1")
    elements = fixtures.parsed_scores(spark, small_dir, 3)
    some = pairs.pair_scores(elements, metrics=names, parts=3)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 2
    scattered = pairs.pair_scores(elements.repartition(5), metrics=names)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, scattered.collect()))
    assert not [t.name for t in spark.catalog.listTables("default") if t.name.startswith(("elements_", "notes_"))]


@pytest.mark.parametrize("kind", ["pitch_class", "rhythm"])
def test_frames_of_a_file_in_one_task(spark, kind, monkeypatch):
    monkeypatch.setattr(match, "SWEEP", 8)
    r = random.Random(3)
    rows = [(f"f{r.randrange(3)}", r.choice(("gt", "pred")), k, 0, 0, r.randrange(-8, 200) / 8, r.choice((0.0, 0.25, 1.0, 9.3)), p := r.randrange(60, 66), p % 12, 1, None) for k in range(200)]
    df = spark.createDataFrame([*rows, ("f9", "pred", 1, 0, 0, 1.0, 1.0, 60, 0, 1, None)], NOTE)
    apart, together = (sorted(map(tuple, match.framewise_f1(df, kind, together=x).collect())) for x in (False, True))
    assert apart == together and len(apart) == 4


def test_positions_of_measures_without_a_join(spark):
    """Numbers may repeat, be missing, negative or differ between parts; what is looked up and what the elements bring is the same."""
    from sparkstave.operators import pairs

    numbers = [("gt", 0, ["5", "5", "x", "-3", "9"]), ("gt", 1, ["7", "2"]), ("pred", 0, ["9", "-1", "5"]), ("pred", 2, ["0", "100"])]
    note = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration></note>"
    text = lambda mine: "<score>" + "".join("<part>" + "".join(f"<measure number='{n}'>{note if k % 3 != 2 else ''}</measure>" for k, n in enumerate(of)) + "</part>" for _, _, of in mine) + "</score>"
    files = spark.createDataFrame([(s, text([x for x in numbers if x[0] == s])) for s in ("gt", "pred")], "file string, content string")
    elements = notes.score_elements(files).withColumn("side", F.col("file")).withColumn("file", F.lit("f"))
    measures = elements.filter("tag = 'measure'").select("file", "side", notes.own_measure(elements).alias("measure_idx")).distinct()
    plain, brought = (notes.merged_notes(notes.timed_notes(e)) for e in (elements, notes.with_ordinal(elements)))
    by = lambda df: sorted(map(tuple, df.collect()))
    want = by(match._placed(plain, measures)[0].select("side", "part_idx", "note_id", "measure_idx", "ordinal"))
    assert by(match._placed(brought, measures)[0].select("side", "part_idx", "note_id", "measure_idx", "ordinal")) == want and len(want) > 5
    assert by(match.measure_accuracy(plain, measures)) == by(match.measure_accuracy(brought, measures))
    assert pairs.pair_scores(elements, metrics=("ser",)).first()["total_measures"] == match.measure_accuracy(plain, measures).first()["measures"]
