"""Queries and operators do the whole job: every text to its end, every symbol, every note."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkstave.operators import bpe, greedy, match
from sparkstave.plans import fixtures, registry, tokens
from sparkstave.session import table


def merges_one_by_one(texts, n):
    counted = Counter(s for t in texts for s in bpe.cut(t))
    letters = sorted({c for s in counted for c in s})
    number = {c: i for i, c in enumerate(letters, len(bpe.SPECIALS))}
    state, out = [([number[c] for c in s], k) for s, k in counted.items()], []
    for new in range(len(number) + len(bpe.SPECIALS), len(number) + len(bpe.SPECIALS) + n):
        pairs = Counter()
        for ids, k in state:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] += k
        if not pairs:
            break
        left, right = min(pairs, key=lambda p: (-pairs[p], p))
        out.append((left, right))
        state = [(bpe.merge(ids, left, right, new), k) for ids, k in state]
    return out


def test_merges_are_those_of_one_after_the_other(spark, small_dir, monkeypatch):
    monkeypatch.setattr(bpe, "COMMON", 50)  # most guesses are wrong then
    monkeypatch.setattr(bpe, "CHUNK", 300)
    texts = [f"!aaaa!aaa!aaaaa!{t[:1500]}" for t in (r["text"] for r in table(spark, small_dir, "documents").filter("text is not null").orderBy("doc_id").limit(8).collect())]
    texts = [t.replace(" ", "!") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = bpe.learned_merges(df, 120).filter("left is not null").orderBy("id").collect()
    assert [(r["left"], r["right"]) for r in got] == merges_one_by_one(texts, 120)


def test_bpe_queries_read_whole_texts(spark, small_dir):
    given = {r["doc_id"] for r in table(spark, small_dir, "documents").filter("text is not null").collect()}
    queries = {name: registry.queries()[name] for name in registry.queries()}
    vocabulary = queries["b01_bpe_learning"](spark, small_dir).collect()
    assert len(vocabulary) <= 5000 and sum(r["left"] is not None for r in vocabulary) > 1000
    letters = {c for r in vocabulary for c in r["token"] if r["left"] is None and r["id"] > 2}
    texts = {r["doc_id"]: r["text"] for r in tokens._bpe_text(spark, small_dir).collect()}
    same = queries["b03_bpe_round_trip"](spark, small_dir).collect()
    assert {r["doc_id"] for r in same} == given and all(r["same"] == (set(texts[r["doc_id"]]) <= letters) for r in same) and sum(r["same"] for r in same) > 0.9 * len(same)
    plain = {r["doc_id"]: r["ids"] for r in queries["b02_bpe_encoding"](spark, small_dir).collect()}
    dropped = {r["doc_id"]: r["ids"] for r in queries["b04_bpe_dropout"](spark, small_dir).collect()}
    assert set(plain) == set(dropped) == given and sum(map(len, dropped.values())) > sum(map(len, plain.values()))
    for r in queries["b06_tokenized_splits"](spark, small_dir).collect():
        whole = plain if r["split"] == "test" else dropped
        assert (r["split"] == "test") == (r["doc_id"] % 5 == 0) and r["ids"] == whole[r["doc_id"]][:8192] and r["length"] == len(whole[r["doc_id"]])
    openers = {r["id"]: r["token"] for r in queries["b05_measure_tokens"](spark, small_dir).collect()}
    assert openers == {r["id"]: r["token"] for r in vocabulary if r["token"].startswith("!")}
    group = {r["doc_id"]: (r["lang"], len(r["text"].split())) for r in table(spark, small_dir, "documents").filter("text is not null").collect()}
    for r in queries["a26_token_inflation"](spark, small_dir).collect():
        own = [d for d in given if group[d][0] == r["group"]]
        assert (r["files"], r["symbols"], r["tokens"]) == (len(own), sum(group[d][1] for d in own), sum(len(plain[d]) - 2 for d in own))
        assert r["inflation"] == r["tokens"] / r["symbols"]


def test_dropout_keeps_the_text(spark):
    df = spark.createDataFrame([(1, "!abab!abc!abab"), (2, "")], "doc_id bigint, text string")
    vocabulary = bpe.learned_merges(df, 4)
    plain, dropped = (bpe.encoded(df, vocabulary, dropout=p, seed=1) for p in (0.0, 0.9))
    assert sorted(r["decoded"] for r in bpe.decoded(dropped, vocabulary).collect()) == ["", "!abab!abc!abab"]
    assert plain.agg(F.sum(F.size("ids"))).first()[0] < dropped.agg(F.sum(F.size("ids"))).first()[0]


NOTE = "file string, side string, note_id bigint, part_idx int, measure_idx int, onset_beat double, duration_beat double, pitch int, pitch_class int, staff int, voice string"


def test_many_equal_notes_match(spark):
    rows = [("f", side, k, 0, 0, 1.0, 1.0, 60, 0, 1, None) for side, n in (("gt", 260), ("pred", 240)) for k in range(n)]
    df = spark.createDataFrame(rows, NOTE)
    for mode in match.MATCH_KEYS:
        got = match.tolerant_scores(df, mode).first()
        assert (got["tp"], got["fp"], got["fn"]) == (240, 0, 20)


def test_scores_are_those_of_one_pair_after_the_other(spark):
    r = random.Random(5)
    rows = [(f"f{k % 2}", r.choice(("gt", "pred")), k, r.randrange(2), 0, r.randrange(6) / 8, r.choice((0.5, 0.625, 1.0)), p := r.choice((60, 62, 72)), p % 12, r.choice((None, 1)), r.choice((None, "a"))) for k in range(60)]
    df = spark.createDataFrame(rows, NOTE)
    for mode in ("pitch", "pitch_class", "pitch_onset", "pitch_onset_duration_staff", "rhythm"):
        used, tp = set(), Counter()
        for c, f, i, j in sorted((x["cost"], x["file"], x["i"], x["j"]) for x in match.candidate_pairs(match.dense_note_index(df), mode, 0.25, 0.25).collect()):
            if not {(f, "p", i), (f, "g", j)} & used:
                used |= {(f, "p", i), (f, "g", j)}
                tp[f] += 1
        assert {x["file"]: x["tp"] for x in match.tolerant_scores(df, mode).collect()} == tp


def test_matching_over_many_ranges(spark, monkeypatch):
    """Ranges of a few notes: what lies next to a border is left to later rounds, and the pairs taken stay those of the sequential order."""
    monkeypatch.setattr(greedy, "RUN", 40)
    monkeypatch.setattr(greedy, "SMALL", 30)
    r = random.Random(6)
    rows = [(f"f{k % 3}", r.choice(("gt", "pred")), k, 0, k % 5, r.randrange(60) / 8, r.choice((0.5, 0.625, 1.0)), p := r.choice((60, 62)), p % 12, r.choice((None, 1)), None) for k in range(400)]
    rows += [("f1", "pred", 1000 + k, 0, 0, None, 1.0, 60, 0, 1, None) for k in range(3)]
    df = spark.createDataFrame(rows, NOTE)
    for mode in ("pitch_onset", "pitch_onset_duration", "rhythm", "pitch_class_onset_duration"):
        used, want = set(), set()
        indexed = match.dense_note_index(df)
        ids = {(x["file"], x["side"], x["idx"]): x["note_id"] for x in indexed.collect()}
        for _, f, i, j in sorted((x["cost"], x["file"], x["i"], x["j"]) for x in match.candidate_pairs(indexed, mode, 0.25, 0.25).collect()):
            if not {(f, "p", i), (f, "g", j)} & used:
                used |= {(f, "p", i), (f, "g", j)}
                want.add((f, ids[f, "pred", i], ids[f, "gt", j]))
        keys, durations = match.MATCH_KEYS[mode]
        same = ("onset_beat", *(("duration_beat",) if durations else ()))
        got = greedy.greedy_pairs(df, greedy.Match(greedy.numeric_cost(mode), same, 0.25, 0.25 if durations else None), keys)
        assert {(x["file"], x["note_id"], x["partner"]) for x in got.collect()} == want


def test_constant_shift_takes_few_jobs(spark):
    """10,000 notes predicted one tolerance late: one piece, each note's partner depends on the one before."""
    times = [("f", side, k, 0, k // 4, k / 4 + late, 1.0, 60, 0, 1, None) for side, late in (("gt", 0.0), ("pred", 0.25)) for k in range(10_000)]
    tracker, df = spark.sparkContext.statusTracker(), spark.createDataFrame(times, NOTE)
    spark.sparkContext.setJobGroup("shift", "")
    got = match.tolerant_scores(df, "pitch_onset", 0.25, 0.25).first()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (got["tp"], got["fn"]) == (9_999, 1) and len(tracker.getJobIdsForGroup("shift")) < 25


def test_dictionary_of_many_symbols_round_trips(spark):
    n = 70_000  # past the surrogates and the two-byte characters
    rows = spark.range(n).select((F.col("id") % 70).alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"))
    vocabulary = bpe.dictionary(rows)
    assert vocabulary.select("character").distinct().count() == n
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("symbol")).alias("s"))
    back = bpe.decode_symbols(bpe.encode_symbols(listed, vocabulary, "doc_id", "s"), vocabulary, "doc_id")
    assert back.join(listed, "doc_id").filter(F.col("symbols") == F.col("s")).count() == 70


def one_segment(ids, ranks, drop):
    """Merges of one segment one after the other, each drawn once."""
    out = set()
    while found := [(ranks[p], *p) for p in zip(ids, ids[1:], strict=False) if p in ranks and ranks[p] not in out]:
        new, left, right = min(found)
        if drop():
            out.add(new)
        else:
            ids = bpe.merge(ids, left, right, new)
    return ids


def test_segments_of_many_texts_are_merged_at_once(spark):
    """Ids and draws are those of one segment after the other, with numpy's own generator for each."""
    r = random.Random(7)
    texts = ["", "!", "!!é", *("".join(r.choice("aab!é" if k % 4 == 0 else "aab!") for _ in range(r.randrange(1, 60))) for k in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    vocabulary = bpe.learned_merges(df.filter("text not like '%é%'"), 30)  # é is unknown
    rows = vocabulary.collect()
    letters = {x["token"]: x["id"] for x in rows if x["left"] is None}
    ranks = {(x["left"], x["right"]): x["id"] for x in rows if x["left"] is not None}
    for dropout in (0.0, 0.4):
        got = {x["doc_id"]: x["ids"] for x in bpe.encoded(df, vocabulary, dropout, seed=3).collect()}
        for doc, text in enumerate(texts):
            want = [bpe.BOS]
            for pos, s in enumerate(bpe.cut(text)):
                rng = np.random.default_rng([3, *f"{doc}:{pos}:{s}".encode()])
                want += one_segment([letters[c] for c in s if c in letters], ranks, lambda rng=rng: rng.random() < dropout)
            assert got[doc] == [*want, bpe.EOS]
    pairs, sizes = bpe.Merges(ranks), np.array([len(texts[-1])])
    ids = np.array([letters.get(c, letters["a"]) for c in texts[-1]])
    plain = pairs.merged(ids, sizes)[0].tolist()
    pairs.table = None  # as for a large vocabulary
    assert pairs.merged(ids, sizes)[0].tolist() == plain == one_segment(ids.tolist(), ranks, lambda: False)


def test_dictionary_of_more_symbols_than_characters_round_trips(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHARACTERS", 100)
    rows = spark.range(2000).select((F.col("id") % 7).alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"))
    vocabulary = bpe.dictionary(rows)
    seen = {r["symbol"]: r["character"] for r in vocabulary.collect()}
    assert len(set(seen.values())) == 2000 and all(33 <= ord(c) < 33 + 100 for x in seen.values() for c in x) and {len(x) for x in seen.values()} == {1, 2}
    leads = {x[0] for x in seen.values() if len(x) == 2}
    assert not leads & {x[-1] for x in seen.values()}
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("symbol")).alias("s"))
    encoded = bpe.encode_symbols(listed, vocabulary, "doc_id", "s")
    assert encoded.agg(F.sum("n_known")).first()[0] == 2000
    assert bpe.decode_symbols(encoded, vocabulary, "doc_id").join(listed, "doc_id").filter(F.col("symbols") == F.col("s")).count() == 7


def test_many_merges_take_few_rounds_over_the_segments(spark, small_dir, monkeypatch):
    rounds, exact = [], bpe.pair_totals
    monkeypatch.setattr(bpe, "pair_totals", lambda state: rounds.append(1) or exact(state))
    df = tokens._bpe_text(spark, small_dir).select("doc_id", "text")
    got = bpe.learned_merges(df, 2000).filter("left is not null").count()
    assert got == 2000 and len(rounds) <= 4


def test_batches_are_planned_without_ids(spark, small_dir):
    planned = fixtures.id_counts(spark, small_dir)
    assert "md5" not in planned._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(planned.collect()) == sorted(fixtures.id_rows(spark, small_dir).select("row_id", F.size("lmx_ids").cast("bigint")).collect())
    text = registry.queries()["l04_padded_batches"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("md5(") == 1


def test_equal_segments_are_merged_once(spark, monkeypatch, tmp_path):
    texts = ["!abab" * 400, "abab!abab" * 200, "", "!", "é!abc!!ab", *["!abc!ab" * 50] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    vocabulary = bpe.learned_merges(df.filter("text not like '%é%'"), 4)
    table = {r["id"]: r for r in vocabulary.collect()}
    ranks = {(r["left"], r["right"]): i for i, r in table.items() if r["left"] is not None}
    letters = {r["token"]: i for i, r in table.items() if r["left"] is None}
    seen = str(tmp_path / "seen")

    class Counted(bpe.Merges):
        def merged(self, ids, sizes, dropped=None):
            with open(seen, "a") as out:
                out.write(f"{len(sizes)}\n")
            return super().merged(ids, sizes, dropped)

    monkeypatch.setattr(bpe, "Merges", Counted)
    monkeypatch.setattr(bpe, "FEW", 2)
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df, vocabulary).collect()}
    for doc, text in enumerate(texts):
        want = []
        for s in bpe.cut(text):
            ids = [letters[c] for c in s if c in letters]
            for (left, right), new in sorted(ranks.items(), key=lambda x: x[1]):
                ids = bpe.merge(ids, left, right, new)
            want += ids
        assert got[doc] == [bpe.BOS, *want, bpe.EOS]
    with open(seen) as lines:
        assert sum(map(int, lines)) <= 12  # of 3,600 and more


def test_round_trip_shuffles_no_text(spark, small_dir):
    plan = tokens.QUERIES["b03_bpe_round_trip"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sha2(") >= 2


def test_symbols_are_looked_up_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3000)
    kind = type(spark.range(0))
    asked, joined = [], kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a, **b: asked.append(self.count()) or joined(self, *a, **b))
    words = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.concat(F.lit("w"), (k % 20).cast("string")))
    rows = spark.range(0, 24, 1, 2).select(F.col("id").alias("doc_id"), words.alias("s"))
    odd = spark.createDataFrame([(90, ["w1", None, "x", "w2"]), (90, ["w3"]), (None, ["w4"]), (91, []), (92, None), (93, ["x"])], "doc_id bigint, s array<string>")
    vocabulary = bpe.dictionary(rows.select(F.explode("s").alias("symbol")))
    asked.clear()
    encoded = bpe.encode_symbols(rows.unionByName(odd), vocabulary, "doc_id", "s")
    got = {r["doc_id"]: r["symbols"] for r in bpe.decode_symbols(encoded, vocabulary, "doc_id").collect()}
    assert {r["doc_id"]: r["n_known"] for r in encoded.filter("doc_id is null or doc_id >= 90").collect()} == {None: 1, 90: 3, 91: 0, 92: 0, 93: 0}
    want = [f"w{k % 20}" for k in range(1, 501)]
    assert got == {k: want for k in range(24)} | {90: ["w1", "w3", "w2"], None: ["w4"]}
    assert asked and max(asked) < 400  # 12,000 words
