"""Operators against plain statements of what they mean, on hand-made and random input."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkstave.functions import arrays, scalars
from sparkstave.operators import batches, bpe, match, noise, notes, similarity, split
from sparkstave.schemas import require_columns

NOTE = "file string, side string, note_id bigint, part_idx int, measure_idx int, pitch int, pitch_class int, onset_beat double, duration_beat double, staff int, voice string"


def note(side, note_id, pitch, onset, duration=1.0, measure=0, staff=None, voice=None, file="f"):
    return (file, side, note_id, 0, measure, pitch, pitch % 12, onset, duration, staff, voice)


def greedy_split(sizes, ratio=(16, 4, 5)):
    goals = [sum(sizes) * (r / 25.0) for r in ratio]
    filled = [0, 0, 0]
    for s in sizes:
        k = min((i for i in range(3) if goals[i] > 0), key=lambda i: filled[i] / goals[i], default=0)
        filled[k] += s
    return filled


@pytest.mark.parametrize("sizes", [[5], [7] * 40, list(range(1, 200)), [0, 0, 3]])
def test_balanced_split_is_greedy(spark, sizes):
    strata = spark.createDataFrame([(i, s, "all") for i, s in enumerate(sizes)], "origin bigint, total_tokens bigint, stratum string")
    got = {r[0]: r[1] for r in split.balanced_split(strata).groupBy("partition").agg(F.sum("total_tokens")).collect()}
    assert [got.get(s, 0) for s in split.SPLITS] == greedy_split(sorted(sizes, reverse=True))


def test_zero_ratio_gets_nothing(spark):
    strata = spark.createDataFrame([(i, 3, "all") for i in range(30)], "origin bigint, total_tokens bigint, stratum string")
    assert {r["partition"] for r in split.balanced_split(strata, (3, 0, 1)).collect()} == {"training", "test"}


def test_equal_edges_make_one_stratum(spark):
    totals = spark.createDataFrame([(i, 4 if i < 9 else i) for i in range(12)], "origin bigint, total_tokens bigint")
    assert {r["stratum"] for r in split.with_strata(totals).collect()} == {"all"}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="b, c"):
        require_columns(spark.range(1), "id", "b", "c")


def sequential(pairs):
    used_i, used_j, out = set(), set(), []
    for cost, i, j in sorted(pairs):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_match_equals_sequential(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for f in range(25):
        pairs = {(rng.choice([0.0, 0.25, 0.5]), i, j) for i, j in itertools.product(range(6), range(6)) if rng.random() < 0.4}
        rows += [(f"f{f}", i, j, c) for c, i, j in pairs]
        want[f"f{f}"] = sequential(pairs)
    got = match.greedy_match(spark.createDataFrame(rows, "file string, i bigint, j bigint, cost double")).collect()
    for f, pairs in want.items():
        assert sorted((r["i"], r["j"]) for r in got if r["file"] == f) == pairs


def test_tolerance_is_inclusive_and_null_staff_equals_null(spark):
    rows = [note("gt", 1, 60, 1.0), note("pred", 1, 60, 1.25), note("gt", 2, 61, 3.0), note("pred", 2, 61, 3.5)]
    got = match.tolerant_scores(spark.createDataFrame(rows, NOTE), "pitch_onset_duration_staff", 0.25, 0.25).first()
    assert (got["tp"], got["fp"], got["fn"]) == (1, 1, 1)


def test_measures_by_position(spark):
    rows = [note("gt", 1, 60, 0.0, measure=1), note("pred", 1, 60, 0.0, measure=7), note("gt", 2, 62, 4.0, measure=2)]
    df = spark.createDataFrame(rows, NOTE)
    got = match.measure_accuracy(df).first()
    assert (got["measures"], got["correct"]) == (2, 1)
    assert match.measure_f1(df, "pitch").first()["avg_measure_f1"] == 0.5


def test_perfect_prediction_scores_one(spark):
    rows = [note(s, k, 60 + k, k * 0.5) for s in ("gt", "pred") for k in range(5)]
    df = spark.createDataFrame(rows, NOTE)
    for mode in match.BAG_KEYS:
        assert match.bag_f1(df, mode).first()["f1"] == 1.0
    assert match.framewise_f1(df, "pitch_class").first()["f1"] == 1.0
    assert similarity.timeline_dtw(match.timeline(df, "pitch_class")).first()["similarity"] == pytest.approx(1.0)
    assert match.divergence(match.pitch_class_histogram(df)).first()["jsd"] == 0.0


def test_disjoint_histograms_diverge_by_one(spark):
    rows = [("f", 1, 2, 0), ("f", 2, 0, 3), ("g", 1, 0, 2)]
    got = {r["file"]: r["jsd"] for r in match.divergence(spark.createDataFrame(rows, "file string, bin int, np bigint, ng bigint")).collect()}
    assert got == {"f": pytest.approx(1.0), "g": pytest.approx(0.5)}


def dtw_table(x, y, band_share=0.1):
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    band = max(abs(n - m), math.ceil(max(n, m) * band_share))
    best = {(0, 0): (0.0, 0)}
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        if abs(i - j) > band:
            continue
        a, b = x[i - 1], y[j - 1]
        norm = math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())
        near = float((a * b).sum()) / norm if norm else float(not a.any() and not b.any())
        cost, steps = min((best.get(k, (math.inf, 0)) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1))), key=lambda c: c[0])
        best[i, j] = (cost + (1 - near), steps + 1)
    cost, steps = best[n, m]
    return max(0.0, 1 - cost / steps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=3, max_size=3), max_size=12), st.lists(st.lists(st.integers(0, 1), min_size=3, max_size=3), max_size=12))
def test_dtw_equals_table(x, y):
    x, y = (np.array(v, float).reshape(-1, 3) for v in (x, y))
    assert similarity.dtw_similarity(x, y) == pytest.approx(dtw_table(x, y))


def test_tempo_in_force(spark):
    n = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 15, 3), ("b", 5, 4)], "file string, tick bigint, note_id bigint")
    t = spark.createDataFrame([("a", 10, 90.0), ("a", 12, 60.0)], "file string, tick bigint, bpm double")
    assert {r["note_id"]: r["bpm"] for r in notes.tempo_in_force(n, t).collect()} == {1: 90.0, 2: 90.0, 3: 60.0, 4: 120.0}


def test_measure_of_note(spark):
    s = spark.createDataFrame([("a", 0.0, 2.0, 1), ("a", 3.0, 4.0, 2)], "file string, m_start double, m_end double, measure_idx int")
    n = spark.createDataFrame([("a", 0.0, 1), ("a", 2.5, 2), ("a", 4.0, 3), ("a", 9.0, 4)], "file string, onset_beat double, note_id bigint")
    assert {r["note_id"]: r["measure_idx"] for r in notes.measure_of(n, s).collect()} == {1: 1, 2: 0, 3: 2, 4: 0}


def test_clock_after_backup_and_leading_chord(spark):
    rows = [(0, "note", True, 2), (1, "note", False, 4), (2, "backup", False, 3), (3, "note", True, 1), (4, "note", False, 1)]
    e = spark.createDataFrame([("f", *r) for r in rows], "file string, child_pos int, tag string, is_chord boolean, duration int")
    got = [r["onset"] for r in notes.with_clock(e, "file").orderBy("child_pos").collect()]
    assert got == [0, 0, 4, 0, 1]


def test_score_markup(spark):
    xml = "<s xmlns='urn:x'><part id='P1'><measure number='1'><attributes><clef number='1'><sign>G</sign><line>2</line></clef></attributes><note><chord/><pitch><step>C</step><octave>4</octave></pitch><duration>3</duration></note><backup><duration>1</duration></backup></measure></part></s>"
    files = spark.createDataFrame([("a", xml), ("broken", "<s>"), ("empty", None)], "file string, content string")
    rows = notes.score_elements(files).orderBy("child_pos").collect()
    assert sorted(r["file"] for r in rows if r["error"]) == ["broken", "empty"]
    got = [(r["tag"], r["duration"], r["is_chord"], r["step"], r["measure_number"]) for r in rows if not r["error"]]
    assert got == [("measure", None, None, None, "1"), ("attributes", None, False, None, "1"), ("note", "3", True, "C", "1"), ("backup", "1", False, None, "1")]


def one(spark, df_schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, df_schema).select(column).collect()]


def test_cut_at_measure(spark):
    rows = [(["a", "b", "measure", "c", "measure", "d"],), (["a"] * 6,), (["a", "measure"],)]
    got = one(spark, "x array<string>", rows, arrays.cut_at_measure(F.col("x"), 4))
    assert got == [["a", "b", "measure", "c"], ["a"], ["a", "measure"]]


def test_marks_and_generated(spark):
    rows = [([1, 5, 2],), ([5, 6],), ([1],), ([],), ([1, 2],)]
    assert one(spark, "x array<int>", rows, arrays.strip_marks(F.col("x"), 1, 2)) == [[5], [5, 6], [], [], []]
    rows = [([1, 5, 2, 7],), ([5, 0, 2],), ([],), ([5, 6],)]
    assert one(spark, "x array<int>", rows, arrays.cut_generated(F.col("x"), 1, 2, 0)) == [[5], [5], [], [5, 6]]


def test_edit_distance(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (["q"], ["q"])]
    assert one(spark, "x array<string>, y array<string>", rows, scalars.edit_distance(F.col("x"), F.col("y"))) == [2, 1, 0]


def test_ratios():
    with pytest.raises(ValueError):
        scalars.normalized_ratios({"a": 0.0})
    assert batches.stage_shares({"a": 0.0, "b": 0.0}) == {"a": 0.5, "b": 0.5}


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer, models, trainers

    texts = ["!abab!abc", "!abc!abab", "!bcbc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    vocabulary = bpe.learned_merges(df, 6)
    got = [(r["id"], r["token"]) for r in vocabulary.orderBy("id").collect()]
    own = Tokenizer(models.BPE())
    pieces = [p for t in texts for p in ("!" + x for x in t.split("!") if x)]
    own.train_from_iterator(pieces, trainers.BpeTrainer(vocab_size=len(got), special_tokens=list(bpe.SPECIALS), show_progress=False))
    assert {t for _, t in got} == set(own.get_vocab())
    back = bpe.decoded(bpe.encoded(df, vocabulary), vocabulary)
    assert sorted((r["doc_id"], r["decoded"]) for r in back.collect()) == list(enumerate(texts))


def test_repaired_notes_do_not_overlap(spark):
    rows = [("f", k, 60, t, 10) for k, t in enumerate([0, 4, 4, 30, 33])]
    got = sorted((r["time"], r["duration"]) for r in noise.repaired(spark.createDataFrame(rows, "file string, note_id bigint, pitch int, time bigint, duration bigint")).collect())
    assert all(a + d <= b for (a, d), (b, _) in itertools.pairwise(got)) and all(d >= 1 for _, d in got) and len(got) == 5


def test_noise_is_repeatable_and_clean_is_unchanged(spark):
    df = spark.createDataFrame([("f", k, 50 + k, 480 * k, 240) for k in range(20)], "file string, note_id bigint, pitch int, time bigint, duration bigint")
    rows = lambda: sorted(tuple(r) for r in noise.variants(df, seed=3).collect())
    first = rows()
    assert first == rows()
    assert sorted((r[1], r[3], r[4]) for r in first if r[5] == "clean") == [(k, 480 * k, 240) for k in range(20)]


def test_same_result_on_one_and_many_partitions(spark, small_dir):
    from sparkstave.plans import fixtures

    df = fixtures.notes(spark, small_dir)
    rows = lambda n: sorted(map(str, match.tolerant_scores(df.repartition(n), "pitch_onset").collect()))
    assert rows(1) == rows(7)


def test_only_kept_ids_become_tuples(spark):
    tuples = lambda x: F.transform(x, lambda t: F.array(t, (t < 5).cast("int")))
    rows = spark.createDataFrame([(k, [(i * k) % 9 for i in range(20 * k)], [(i + k) % 7 for i in range(15 * k)]) for k in range(6)], "row_id int, t array<int>, s array<int>")
    late = arrays.truncated_variants(rows, "t", {"s": ("s", 1)}, lambda t: t < 5, lambda t: t < 5, 30, 30, 2, tuples)
    early = arrays.truncated_variants(rows.withColumn("s", tuples(F.col("s"))), "t", {"s": ("s", 1)}, lambda t: t < 5, lambda t: F.get(t, F.lit(1)) == 1, 30, 30, 2)
    assert late.columns == early.columns and sorted(late.collect()) == sorted(early.collect())
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 0
