import collections
import hashlib
import random

import numpy as np
import pytest

from sparkstave.llm import substrings, textkit


def brute(rows, size):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    seen = collections.Counter(tuple(w[p : p + size]) for _, w in words for p in range(len(w) - size + 1))
    out = []
    for k, w in words:
        keep = [True] * len(w)
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                keep[p : p + size] = [False] * size
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((k, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 15))) for _ in range(15)]
    text = lambda: "\n".join(rng.choice([rng.choice(shared), " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))]) for _ in range(rng.randint(0, 6)))
    rows = [(rng.choice([None, rng.randint(0, 50)]), text()) for _ in range(200)]
    return rows + [(1, None), (2, ""), (3, "a b " * 40), (4, " \t\n"), (5, "same text " * 9), (5, "same text " * 9), (6, "é x y\x0bz " * 3)]


@pytest.mark.parametrize("size", [4, 7, 12])
def test_equals_brute_force(make, size):
    rows = random_rows(size)
    assert sorted((tuple(r) for r in substrings.removal_digests(make(rows), size).collect()), key=str) == brute(rows, size)


def test_small_chunks_and_sketch_lose_nothing(make, monkeypatch):
    rows = random_rows(99)
    monkeypatch.setattr(substrings, "CHUNK_WINDOWS", 50)
    monkeypatch.setattr(substrings, "CHUNK_ANCHORS", 20)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    assert sorted((tuple(r) for r in substrings.removal_digests(make(rows, 5), 6).collect()), key=str) == brute(rows, 6)


def test_a_crowded_sketch_loses_nothing(make, monkeypatch):
    """Where cells are few, next to all windows pass to the exact pass, and the result is the same."""
    rows = random_rows(98)
    monkeypatch.setattr(substrings, "LEAST_CELLS", 16)
    monkeypatch.setattr(substrings, "CELLS_PER_ANCHOR", 0)
    assert sorted((tuple(r) for r in substrings.removal_digests(make(rows, 5), 6).collect()), key=str) == brute(rows, 6)


@pytest.mark.parametrize("load,least,most", [(4, 0.0, 0.06), (1, 0.1, 0.75)])
def test_share_of_unrepeated_text_that_passes(make, monkeypatch, load, least, most):
    """Cells follow the text, so the share that passes is the same at any size."""
    monkeypatch.setattr(substrings, "LEAST_CELLS", 64)
    monkeypatch.setattr(substrings, "CELLS_PER_ANCHOR", load)
    rng = random.Random(5)
    for n in (60, 240):
        docs = make([(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1000))) for i in range(n)])
        hashed = docs.selectExpr("sha2(text, 256) AS h", "text")
        n_bytes = 1999 * n
        found = sum(len(r["ats"]) for r in substrings.estimated_repeated(hashed, n_bytes * 3, 35, 16).collect())
        words = [textkit.Words([r["text"]]) for r in docs.collect()]
        anchors = sum(len(substrings.anchors(w, w.hashes()[0], 35, 16)[2]) for w in words)
        assert least <= found / anchors <= most


def test_very_long_text(make):
    """Far more words than a batch takes at a time, with a passage that a short text has too."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=400_000))
    rows = [(1, f"{long} {passage} end"), (2, passage), (3, "x " * 20)]
    assert sorted((tuple(r) for r in substrings.removal_digests(make(rows)).collect()), key=str) == brute(rows, 35)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in substrings.removal_digests(docs).collect()), key=str) == brute(rows, 35)


def test_empty_table(make):
    assert substrings.removal_digests(make([])).count() == 0


def test_cut_text_keeps_the_rest(make):
    shared = " ".join(f"p{i}" for i in range(10))
    docs = make([(1, f"one  two\n{shared}\tend here"), (2, f"{shared} other"), (3, "alone  here"), (4, None)])
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs, 8).collect()}
    assert got == {1: "one  two\nend here", 2: "other", 3: "alone  here", 4: None}


def test_words_and_windows():
    words = textkit.Words(["a b  c", None, "", "xé " + "y" * 40])
    assert [words.data[s:e] for s, e in zip(words.start, words.end, strict=True)] == [b"a", b"b", b"c", "xé".encode(), b"y" * 40]
    assert words.first.tolist() == [0, 3, 3, 3, 5]
    x = np.arange(90, dtype=np.uint64) % 9
    for k in (1, 2, 3, 5, 8, 35):
        h = textkit.windows(x, k)
        assert len(h) == 90 - k + 1 and len(set(h.tolist())) == 9 and (h[:9] == h[9:18]).all()
        assert (textkit.sliding(x, k) == [x[i : i + k].min() for i in range(90 - k + 1)]).all()
