import collections
import random
import re

import numpy as np
import pytest

from sparkstave.llm import neardup


def word_sets(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in words]
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent):
    sets = [word_sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in where[g] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, n, length, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = rng.choices(vocabulary, k=length)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice(edits)):
            words[rng.randrange(length)] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(make, k, percent):
    texts = [t for s in range(25) for t in near_copies(s, 8, random.Random(s).randint(5, 90), [0, 1, 2, 4])]
    texts += near_copies(77, 150, 150, [1, 3, 5, 8]) + ["A b", "a B", "z", "z"]
    rows = list(enumerate(texts, 10)) + [(1, None), (2, ""), (3, " \n ")]
    random.Random(1).shuffle(rows)
    assert sorted(tuple(r) for r in neardup.near_duplicates(make(rows), k, percent).collect()) == brute(rows, k, percent)


def test_blocks_and_salts(make, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "HUB_MEMBERS", 8)
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", 0)
    rows = list(enumerate(near_copies(5, 120, 120, [1, 2, 4, 6, 9])))
    assert sorted(tuple(r) for r in neardup.near_duplicates(make(rows), 3, 85).collect()) == brute(rows, 3, 85)


def test_null_and_repeated_ids(make):
    text = "a b c d e f"
    got = sorted(map(str, neardup.near_duplicates(make([(None, text), (3, text), (3, text), (5, text), (3, "q")]), 3, 85).collect()))
    assert [("component_id=3" in g) for g in got] == [True] * 5
    assert sum("kept=True" in g for g in got) == 3


def test_very_long_texts(make):
    """Sets far above what a batch takes at a time, a near copy among them."""
    rng = random.Random(11)
    words = rng.choices([f"w{i}" for i in range(3000)], k=60_000)
    near = [w if rng.random() > 0.02 else "other" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, " ".join(words))]
    assert sorted(tuple(r) for r in neardup.near_duplicates(make(rows), 3, 85).collect()) == brute(rows, 3, 85)


def test_empty_table(make):
    assert neardup.near_duplicates(make([])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    slices = np.lib.stride_tricks.sliding_window_view(neardup.second_permutation(), neardup.N_HASHES)
    for share in (0.3, 0.6, 0.9):
        sets = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(1000 * share)).astype(np.uint64)
            own = [rng.integers(0, 2**63, (1000 - len(both)) // 2).astype(np.uint64) for _ in range(2)]
            sets += [np.unique(np.concatenate((both, o))) for o in own]
        sig = neardup.signatures(sets, slices)
        assert abs((sig[::2] == sig[1::2]).mean() - share) < 0.03


def test_a_hot_key_is_split(spark):
    """A join with an aggregate by the same key ends as a skewed join, so a key that most rows hold lies in several tasks."""
    from pyspark.sql import functions as F

    from sparkstave.llm import neardup
    from sparkstave.session import stored

    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "adaptive.skewJoin.skewedPartitionFactor": "2", "adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        rows = stored(spark.range(200_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("key"), "id").repartition(8), "rows")
        joined = neardup.with_sums(rows, rows.groupBy("key").agg(F.count("*").alias("m")), "key")
        assert joined.filter("key = 7").count() == 180_000 and set(joined.columns) == {"key", "id", "m"}
        plan = joined._jdf.queryExecution()
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in plan.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
