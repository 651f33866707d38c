"""Pair scoring from markup to the summary, against plain Python over the same files; and operators that it rests on."""

import math
import random
import xml.etree.ElementTree as ET
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import dtw_table

from sparkstave.functions import arrays, scalars
from sparkstave.operators import match, noise, notes as nt, pairs, report, split
from sparkstave.session import shared_dir
from sparkstave.sources import tables

STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def markup(seed):
    """A small score with chords, rests, backups, ties, clefs, missing parts of notes and an empty measure."""
    rng = random.Random(seed)
    out = []
    for part in range(rng.choice((1, 2))):
        measures = []
        for m in range(rng.randint(1, 4)):
            number = rng.choice((str(m + 1), str(m + 1), "X"))
            body = []
            if m == 0 or rng.random() < 0.3:
                body.append(f"<attributes>{'<divisions>4</divisions>' if m == 0 else ''}<key><fifths>{rng.randint(-1, 1)}</fifths></key><time><beats>{rng.choice((3, 4))}</beats><beat-type>4</beat-type></time>"
                            f"<clef number='2'><sign>{rng.choice('GF')}</sign><line>2</line></clef><clef><sign>C</sign><line>3</line></clef></attributes>")
            for _ in range(rng.randint(0, 6)):
                kind = rng.random()
                if kind < 0.1:
                    body.append("<backup><duration>2</duration></backup>")
                elif kind < 0.2:
                    body.append("<forward><duration>1</duration></forward>")
                else:
                    what = "<rest/>" if kind < 0.3 else f"{'<chord/>' if kind < 0.5 else ''}<pitch><step>{rng.choice('CE')}</step><octave>4</octave></pitch>"
                    tie = rng.choice(("", "", "<tie type='stop'/>", "<tie type='start'/>"))
                    body.append(f"<note>{what}<duration>{rng.choice((2, 4))}</duration>{tie}{rng.choice(('', '<voice>1</voice>'))}{rng.choice(('', '<staff>1</staff>'))}</note>")
            measures.append(f"<measure number='{number}'>{''.join(body)}</measure>")
        out.append(f"<part id='P{part}'>{''.join(measures)}</part>")
    return f"<score>{''.join(out)}</score>"


def said(child, name, default=None):
    found = next(child.iter(name), None)
    return default if found is None or found.text is None else found.text.strip()


def parsed(content):
    """Notes, events, tokens and measures of one file, walked in order."""
    raw, events, tokens, ids = [], [], [], set()
    for p, part in enumerate(ET.fromstring(content).iter("part")):
        opens, divisions = 0.0, 1
        for order, measure in enumerate(part.findall("measure"), 1):
            idx = int(measure.get("number")) if measure.get("number").isdigit() else order
            ids.add(idx)
            tokens += [f"<PART_{p}_MEASURE_START>", f"PART_{p}", f"MEASURE_{idx}"]
            for a in measure.findall("attributes"):
                if said(a, "divisions"):
                    divisions = int(said(a, "divisions"))
                    tokens.append(f"DIV_{divisions}")
                tokens += [f"TIME_{said(a, 'beats')}_{said(a, 'beat-type')}", f"KEY_{said(a, 'fifths')}"]
                events += [("time", p, idx, said(a, "beats"), said(a, "beat-type")), ("key", p, idx, said(a, "fifths"))]
                for c in a.findall("clef"):
                    events.append(("clef", p, idx, c.get("number", "1"), said(c, "sign"), said(c, "line")))
                    tokens.append(f"CLEF_{c.get('number', '1')}_{said(c, 'sign')}_{said(c, 'line')}")
            clock, lead, latest = 0, None, 0
            for child in measure:
                d = int(said(child, "duration", "0"))
                if child.tag == "backup":
                    clock -= d
                elif child.tag == "forward":
                    clock += d
                    latest = max(latest, clock)
                if child.tag in ("backup", "forward"):
                    tokens.append(f"{child.tag.upper()}_{d}")
                if child.tag != "note":
                    continue
                chord, rest = child.find("chord") is not None, child.find("rest") is not None
                at = lead if chord and lead is not None else clock
                if not chord:
                    lead, clock = at, clock + d
                latest = max(latest, at + d)
                staff, voice = said(child, "staff"), said(child, "voice")
                pitch = None if rest else 12 * (int(said(child, "octave")) + 1) + STEPS[said(child, "step")]
                tokens.append(("REST" if rest else f"NOTE_P{pitch}") + f"_D{d}_S{staff or 0}_V{voice or ''}")
                if not rest:
                    stops = any(t.get("type") == "stop" for t in child.findall("tie"))
                    raw.append([p, idx, pitch, opens + at / divisions, opens + (at + d) / divisions, staff and int(staff), voice, stops, order])
            opens += latest / divisions
            tokens.append(f"<PART_{p}_MEASURE_END>")
    chains, merged = {}, []
    for note in sorted(raw, key=lambda n: (n[0], n[8], n[3])):
        key = (note[0], note[2], note[5], note[6])
        if note[7] and key in chains:
            chains[key][4] = max(chains[key][4], note[4])
            if note[3] < chains[key][3]:
                chains[key][3] = note[3]
        else:
            chains[key] = note[:7]
            merged.append(chains[key])
    return [(p, m, x, a, max(0.0, b - a), s, v) for p, m, x, a, b, s, v in merged], events, tokens, ids, len(raw)


def f1(pred, gt):
    tp = sum((Counter(pred) & Counter(gt)).values())
    p, r = tp / len(pred) if pred else 0.0, tp / len(gt) if gt else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def jsd(pred, gt):
    p, q = Counter(pred), Counter(gt)
    share = lambda c, k: c[k] / sum(c.values()) if c else 0.0
    out = 0.0
    for k in {*p, *q}:
        a, b = share(p, k), share(q, k)
        out += sum(0.5 * x * math.log2(x / ((a + b) / 2)) for x in (a, b) if x)
    return out


def timeline(rows, slots):
    """Frames of 12 pitch classes, or of onset and sustain."""
    import numpy as np

    spans = [(b := max(0, math.floor(a / 0.25)), max(b + 1, math.ceil((a + max(d, 0.25)) / 0.25)), x % 12) for _, _, x, a, d, _, _ in rows]
    out = np.zeros((max((e for _, e, _ in spans), default=0), slots))
    for begin, end, pc in spans:
        out[begin:end, pc if slots == 12 else 1] = 1
        if slots == 2:
            out[begin, 0] = 1
    return out


def expected(pred, gt):
    (pn, pe, pt, pi, praw), (gn, ge, gt_tokens, gi, graw) = parsed(pred), parsed(gt)
    key = {
        "pitch": lambda n: (n[0], n[2]), "pitch_class": lambda n: (n[0], n[2] % 12), "pitch_onset": lambda n: (n[0], n[2], n[3]), "pitch_onset_duration": lambda n: (n[0], n[2], n[3], n[4]),
        "pitch_onset_duration_staff": lambda n: (n[0], n[2], n[3], n[4], n[5]), "pitch_onset_duration_voice": lambda n: (n[0], n[2], n[3], n[4], n[6]),
        "rhythm": lambda n: (n[0], n[3], n[4]), "pitch_class_onset_duration": lambda n: (n[0], n[2] % 12, n[3], n[4]),
    }
    out = {f"{m}_f1": f1([k(n) for n in pn], [k(n) for n in gn]) for m, k in key.items()}
    by = lambda rows, k: {m: [k(n) for n in rows if n[1] == m] for m in {n[1] for n in rows}}
    total = max(len(pi), len(gi))
    at = lambda ids, found, i: found.get(sorted(ids)[i], []) if i < len(ids) else []
    both = lambda k: [(at(pi, by(pn, k), i), at(gi, by(gn, k), i)) for i in range(total)]
    out["correct_measures"] = sum(Counter(a) == Counter(b) for a, b in both(key["pitch_onset_duration_staff"]))
    out["total_measures"], out["measure_accuracy"] = total, out["correct_measures"] / total
    for name, mode in (("note", "pitch_onset_duration"), ("rhythm", "rhythm"), ("pitch_class", "pitch_class_onset_duration")):
        out[f"avg_measure_{name}_f1"] = sum(f1(a, b) for a, b in both(key[mode])) / total
    for name, mode in (("note", "pitch_onset_duration"), ("pitch_class", "pitch_class_onset_duration")):
        every = pi | gi
        out[f"avg_measure_soft_{name}_f1"] = sum(f1(by(pn, key[mode]).get(m, []), by(gn, key[mode]).get(m, [])) for m in every) / len(every)
    for kind in ("key", "time", "clef"):
        out[f"{kind}_event_f1"] = f1([e for e in pe if e[0] == kind], [e for e in ge if e[0] == kind])
    out["xml_structure_edit_distance"] = levenshtein(pt, gt_tokens)
    out["xml_normalized_structure_edit_distance"] = out["xml_structure_edit_distance"] / max(1, len(gt_tokens))
    out["pitch_class_histogram_jsd"] = jsd([n[2] % 12 for n in pn], [n[2] % 12 for n in gn])
    out["duration_histogram_jsd"] = jsd([n[4] for n in pn], [n[4] for n in gn])
    for kind, slots in (("pitch_class", 12), ("rhythm", 2)):
        x, y = timeline(pn, slots), timeline(gn, slots)
        cells = lambda t: [(int(i), int(j)) for i, j in zip(*t.nonzero(), strict=True)]
        out[f"{kind}_timeline_f1"] = f1(cells(x), cells(y))
        out[f"{kind}_timeline_dtw_similarity"] = dtw_table(x, y)
    out |= {"pred_notes": len(pn), "gt_notes": len(gn), "pred_tie_merged_notes": praw - len(pn), "gt_tie_merged_notes": graw - len(gn), "pred_measures": len(pi), "gt_measures": len(gi)}
    out["music_content_score"] = 0.3 * out["pitch_class_f1"] + 0.25 * out["rhythm_f1"] + 0.2 * out["pitch_class_onset_duration_f1"] + 0.15 * out["pitch_class_timeline_dtw_similarity"] + 0.1 * out["rhythm_timeline_dtw_similarity"]
    out["notation_score"] = (0.35 * out["pitch_onset_duration_staff_f1"] + 0.25 * out["measure_accuracy"] + 0.15 * out["key_event_f1"] + 0.15 * out["time_event_f1"]
                             + 0.1 * max(0.0, 1 - out["xml_normalized_structure_edit_distance"] / 10))
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def elements_of(spark, files):
    rows = [(f"{side}/{name}", content) for name, side, content in files]
    found = nt.score_elements(spark.createDataFrame(rows, "file string, content string"))
    return found.withColumn("side", F.substring_index("file", "/", 1)).withColumn("file", F.substring_index("file", "/", -1))


def test_pair_scores_equal_plain_python(spark):
    files = [(f"f{k}", side, markup(2 * k + (side == "gt" and k % 4 > 0))) for k in range(12) for side in ("pred", "gt")]
    scores = {r["file"]: r.asDict() for r in pairs.pair_scores(elements_of(spark, files)).collect()}
    content = {(f, s): c for f, s, c in files}
    assert len(scores) == 12
    for name, got in scores.items():
        for metric, value in expected(content[name, "pred"], content[name, "gt"]).items():
            assert got[metric] == pytest.approx(value, abs=1e-9), (name, metric)
    same = scores["f0"]
    assert same["measure_accuracy"] == 1.0 and same["xml_structure_edit_distance"] == 0.0


def test_tolerances_and_summary(spark):
    files = [(f"f{k}", side, markup(k + (side == "gt"))) for k in range(4) for side in ("pred", "gt")] + [("bad", "gt", "<score>"), ("bad", "pred", markup(1)), ("late", "gt", markup(2))]
    elements = elements_of(spark, files)
    strict, loose = (pairs.pair_scores(elements, t, t) for t in (0.0, 0.5))
    strict, loose = ({r["file"]: r for r in s.collect()} for s in (strict, loose))
    assert all(loose[f]["pitch_onset_f1"] >= strict[f]["pitch_onset_f1"] - 1e-12 and loose[f]["onset_tolerance_beats"] == 0.5 for f in strict)
    rows = spark.createDataFrame([strict[f] for f in sorted(strict) if f.startswith("f")]).withColumn("group", F.when(F.col("file") == "f0", "overall").otherwise("x"))
    summary = pairs.summary(rows)
    assert len(summary.columns) == 32 + 2  # and the group and whether it is all
    total = next(r for r in summary.collect() if r["is_overall"] == 1)
    assert total["num_files"] == 4 and total["avg_rhythm_f1"] == pytest.approx(sum(r["rhythm_f1"] for r in rows.collect()) / 4)
    listed = spark.createDataFrame([(f, s) for f, s, _ in files], "file string, side string")
    assert pairs.validity(listed, elements).first().asDict() == {"expected": 6, "available": 5, "parsed": 4, "missing": 1, "failed": 1, "parse_rate": pytest.approx(4 / 6)}


def test_overlapping_spans_go_to_the_first(spark):
    spans = spark.createDataFrame([("a", 0.0, 9.0, 1), ("a", 2.0, 4.0, 2), ("a", 8.0, 12.0, 3)], "file string, m_start double, m_end double, measure_idx int")
    notes = spark.createDataFrame([("a", 3.0, 1), ("a", 9.0, 2), ("a", 12.0, 3), ("a", 13.0, 4), ("b", 1.0, 5)], "file string, onset_beat double, note_id bigint")
    assert {r["note_id"]: r["measure_idx"] for r in nt.measure_of(notes, spans).collect()} == {1: 1, 2: 3, 3: 3, 4: 0, 5: 0}


def test_noise_leaves_clean_notes_alone(spark):
    rows = [("f", 1, 60, 0, 480), ("f", 2, 60, 240, 480)]
    notes = spark.createDataFrame(rows, "file string, note_id bigint, pitch int, time bigint, duration bigint")
    out = noise.variants(notes, 1).collect()
    assert sorted((r["time"], r["duration"]) for r in out if r["variant"] == "clean") == [(0, 480), (240, 480)]
    assert Counter(r["variant"] for r in out) == {"clean": 2, "light": 2, "heavy": 2}


def test_drift_points_grow_with_the_file(spark):
    """In a long file the drift changes from one stretch to the next: notes far apart don't move alike."""
    rows = [("f", k, 60 + k % 2, k * 4800, 100) for k in range(400)]
    notes = spark.createDataFrame(rows, "file string, note_id bigint, pitch int, time bigint, duration bigint")
    heavy = {r["note_id"]: r["time"] for r in noise.variants(notes, 3).filter("variant = 'heavy'").collect()}
    moves = [heavy[k] - k * 4800 for k in range(400)]
    turns = sum((b - a) * (c - b) < 0 for a, b, c in zip(moves, moves[1:], moves[2:], strict=False))
    assert turns > 100 and max(map(abs, moves)) < 300


def test_tracks_of_the_first_program(spark):
    rows = [("f", 1, 7, 1), ("f", 2, 3, 2), ("f", 3, 7, 3), ("g", 1, None, 4), ("g", 2, None, 5), ("g", 3, 1, 6)]
    notes = spark.createDataFrame(rows, "file string, track int, program int, note_id bigint")
    assert sorted(r["note_id"] for r in noise.merged_tracks(notes).collect()) == [1, 3, 4, 5]


def test_edit_distance_of_many_tokens(spark):
    x = [f"t{i}" for i in range(70_000)]
    y = [*x[:30_000], "new", *x[30_000:60_000], *x[60_010:]]
    rows = spark.createDataFrame([(x, y), ([], ["a"]), (None, ["a"]), (["a"], ["a"])], "x array<string>, y array<string>")
    assert sorted(str(r[0]) for r in rows.select(scalars.edit_distance(F.col("x"), F.col("y"))).collect()) == ["0", "1", "11", "None"]


def test_deal_of_equal_sizes_is_the_loop():
    rng = random.Random(3)
    for _ in range(50):
        goals = [rng.randint(100, 10_000) * 16 / 25, rng.randint(100, 10_000) * 4 / 25, 1000.0]
        filled = [rng.randint(0, 5000) for _ in range(3)]
        size, n = rng.randint(0, 50), rng.randint(32, 300)
        loop, want = list(filled), []
        for _ in range(n):
            to = min(range(3), key=lambda k: loop[k] / goals[k])
            loop[to] += size
            want.append(to)
        if size:
            assert list(split.dealt_run(filled, goals, [0, 1, 2], size, n)) == want and filled == loop


def test_variant_map_last_line_wins(spark):
    rows = [(1, "a", "x/a.xml", None, "clean", None, None), (2, "b", "y/a.xml", "z/c.lmx", "", "light", None), (3, "", None, None, "heavy", None, None)]
    manifest = spark.createDataFrame(rows, "line int, id string, truncated_musicxml_path string, truncated_lmx_path string, selected_variant string, variant string, noise string")
    assert {r["key"]: r["variant"] for r in report.variant_map(manifest).collect()} == {"a": "light", "b": "light", "c": "light"}


def test_quarantine_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id int, reason string")
    tables.write_quarantine(rows, "reason", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 3]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [(2, "bad")]


def test_marks_of_tuples(spark):
    rows = [([[1, 1], [5, 0], [2, 2]],), ([[1, 1]],), ([],), ([[5, 0]],), ([[2, 2]],)]
    got = spark.createDataFrame(rows, "x array<array<int>>").select(arrays.strip_mark_tuples(F.col("x"), [1, 1], [2, 2])).collect()
    assert [r[0] for r in got] == [[[5, 0]], [], [], [[5, 0]], []]


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_measures_without_notes_count(spark):
    notes = spark.createDataFrame([("f", "gt", 1, 1, 60, 0.0, 1.0, None), ("f", "pred", 1, 1, 60, 0.0, 1.0, None)], "file string, side string, part_idx int, measure_idx int, pitch int, onset_beat double, duration_beat double, staff int")
    measures = spark.createDataFrame([("f", s, m) for s in ("gt", "pred") for m in (1, 2)], "file string, side string, measure_idx int")
    got = match.measure_accuracy(notes, measures).first()
    assert (got["measures"], got["correct"]) == (2, 2)
    assert match.measure_f1(notes, "pitch", measures=measures).first()["avg_measure_f1"] == 0.5


def test_edit_distance_numbers_tokens_a_few_rows_at_a_time(spark):
    assert scalars.number_distance(np.array([1, 2, 3]), np.array([1, 3])) == 1
    texts = [["a"] * (i % 3) + [None, str(i)] for i in range(2 * scalars.FEW + 1)]
    rows = spark.createDataFrame([(i, x, None if i % 50 == 7 else [*x[:-1], "b"]) for i, x in enumerate(texts)], "i int, x array<string>, y array<string>").coalesce(1)
    got = dict(rows.select("i", scalars.edit_distance(F.col("x"), F.col("y"))).collect())
    assert got == {i: None if i % 50 == 7 else 1 for i in range(len(texts))}
