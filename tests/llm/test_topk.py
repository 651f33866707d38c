import itertools
import math
import random

import pytest

from sparkstave.llm import topk


def brute(rows, queries, k):
    code = {}
    for i, v in rows:
        if i is not None and v is not None:
            code.setdefault(i, set()).add(tuple(x is not None and x > 0 for x in v))
    out = []
    for q, mine in code.items():
        if q in queries:
            for c in mine:
                near = sorted((sum(a != b for a, b in itertools.zip_longest(c, o, fillvalue=False)), i) for i, others in code.items() for o in others)[:k]
                out += [(q, i, r, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n, dims=64):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.7) for x in rng.choice(centres)]) for i in range(n)]


def run(spark, rows, step, k):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "vec_id as id", "1 as code")
    return sorted(tuple(r) for r in topk.nearest(df, df.filter(f"vec_id % {step} = 0"), k).collect())


def test_equals_brute_force(spark):
    rows = vectors(1, 400)
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(500, None), (None, rows[3][1]), rows[5], (700, [None] * 64)]
    assert run(spark, rows, 50, 10) == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 10)


def test_fewer_rows_than_k(spark):
    rows = vectors(2, 4)
    assert run(spark, rows, 2, 10) == brute(rows, {0, 2}, 10)


def test_empty_table(spark):
    assert run(spark, [], 1, 10) == []


@pytest.mark.parametrize("dims", [3, 128, 150])
def test_any_number_of_dimensions(spark, dims):
    rows = vectors(3, 120, dims)
    rows += [(300, rows[0][1][:2]), (350, rows[1][1] + [1.0]), (350, rows[2][1])]
    ids = {i for i, _ in rows if i % 50 == 0}
    assert run(spark, rows, 50, 7) == brute(rows, ids, 7)


@pytest.mark.parametrize("n", [1, 300, 60_000, 1 << 40])
def test_rounds_cover_what_they_say(n):
    segments = topk.Segments(1, n)
    assert sum(p[2] for p in segments.parts) == 64
    seen, radius = 0, [-1] * len(segments)
    for steps, covered in segments.rounds():
        for r, t in steps:
            assert r == radius[t] + 1
            radius[t] = r
        # The least distance that avoids all the steps is a bit more than each radius in every segment.
        assert covered == 64 or covered == sum(r + 1 for r in radius) - 1
        assert covered >= seen
        seen = covered
        assert sum(math.comb(segments.parts[t][2], r) for r, t in steps) <= topk.ROUND_PROBES or len(steps) == 1
    assert seen == 64
