"""Mixing, sharding, BPE, WARC, quality, toxicity and language on small fixtures and odd input."""

import collections
import math
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import connect, same

from sparkstave.llm import bpe, langid, mixing, quality, queries, sharding, toxicity, warc
from sparkstave.session import stored

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "no id here"), (None, None), (5, "x" * 5000), (6, "long text " * 3000), (7, "###!!! 123"), (8, "é中文字 ok")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, small_dir, name):
    same(queries.QUERIES[name](spark, small_dir), connect(small_dir), queries.SQL[name])


# mixing


def test_mix_meets_targets(make):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    got = mixing.mixed_sizes(make(rows)).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        source = rows[r["doc_id"]][2]
        size[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 60
    again = mixing.mixed_sizes(make(rows, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_odd_rows(make):
    assert mixing.mixed_sizes(make([])).count() == 0
    got = mixing.mixed_sizes(make(ODD)).collect()
    assert len(got) == len(ODD) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    empty = mixing.mixed_sizes(make([(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_mixed_rows_have_the_columns_of_documents(make):
    docs = make([(i, "a b c " * (i % 5), "s" if i % 3 else "t") for i in range(60)])
    assert mixing.mixed(docs).columns == docs.columns


# sharding


def test_shards(spark, make, tmp_path):
    rng = random.Random(5)
    rows = [(i, "z" * rng.randint(0, 300)) for i in range(4000)] + ODD
    slotted = sharding.slotted(make(rows))
    first = sharding.slot_map(sharding.slot_totals(slotted), 24)
    sharding.write_map(first, str(tmp_path / "map"), 1)
    got = sharding.placed(slotted, sharding.read_map(spark, str(tmp_path / "map"))).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(load) == 24
    assert sorted(load.values())[-2] - min(load.values()) < 0.1 * np.mean(list(load.values()))


def test_equal_records_spread_over_shards(spark, make, tmp_path):
    rows = [(7, "same text")] * 5000 + [(None, "none")] * 2000 + [(i, "z" * (i % 50)) for i in range(2000)]
    slotted = stored(sharding.slotted(make(rows, 7)), "slotted")
    assert sorted(r["again"] for r in slotted.filter("doc_id = 7 and size = 17").collect()) == list(range(5000))
    sharding.write_map(sharding.slot_map(sharding.slot_totals(slotted), 24), str(tmp_path / "map"), 1)
    load = collections.Counter()
    for r in sharding.placed(slotted, sharding.read_map(spark, str(tmp_path / "map"))).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 24 and max(load.values()) < 1.02 * min(load.values())


def test_growth_moves_slots_to_the_new_shard(spark, make, tmp_path):
    rng = random.Random(6)
    slotted = sharding.slotted(make([(i, "z" * rng.randint(0, 300)) for i in range(4000)]))
    sharding.write_map(sharding.slot_map(sharding.slot_totals(slotted), 24), str(tmp_path / "map"), 1)
    grown = sharding.rebalanced(sharding.read_map(spark, str(tmp_path / "map")), sharding.slot_totals(slotted), 25)
    sharding.write_map(grown, str(tmp_path / "map"), 2)
    old = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, str(tmp_path / "map")).collect()}
    moved = {s for s in new if new[s] != old[s]}
    assert sum(new[s] == 24 for s in moved) > 0.9 * len(moved) and len(moved) < 0.08 * len(new)
    size = collections.Counter()
    for r in grown.collect():
        size[r["shard"]] += r["bytes"]
    assert len(size) == 25 and size[24] > 0.95 * np.mean(list(size.values()))


def test_shards_of_nothing(make):
    slotted = sharding.slotted(make([]))
    assert sharding.placed(slotted, sharding.slot_map(sharding.slot_totals(slotted), 24)).count() == 0


# BPE


def expected_ids(enc, text):
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_chunks_encode_like_the_library(spark, make):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoder(bpe.read_ranks(path), public_tokenizers.PATTERN)
    rng = random.Random(8)
    pieces = [" the", "ing", "  ", "\n", "'ll", "1234", "!?", "é", "中文", " ", "\x1c", " a", "Zebra", " "]
    rows = ODD + [(20 + i, "".join(rng.choices(pieces, k=rng.randint(0, 900)))) for i in range(60)] + [(99, "q" * 900 + " tail end"), (98, " " * 900)]
    tokenizer = bpe.Tokenizer(spark, path, public_tokenizers.PATTERN)
    got = sorted((tuple(r) for r in bpe.encoded_digests(make(rows), tokenizer, 200, 60).collect()), key=str)
    assert got == sorted(((d, *expected_ids(enc, t)) for d, t in rows), key=str)
    assert bpe.encoded_digests(make([]), tokenizer).count() == 0


def long_text(script, seed, size):
    rng = random.Random(seed)
    letters = {"russian": "абвгдежзиклмнопрстуфхцчшыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "chinese": "".join(map(chr, range(0x4E00, 0x4F00))), "arabic": "ابتثجحخدذرزسشصض"}
    out = []
    while sum(map(len, out)) < size:
        name = rng.choice(list(letters)) if script == "mixed" else script
        word = "".join(rng.choices(letters[name], k=rng.randint(1, 9)))
        out.append(word + rng.choice(["。", "，", "\n"] if name == "chinese" else [" ", " ", " ", ", ", ".\n", " 12 "]))
    return "".join(out)


@pytest.mark.parametrize("script", ["russian", "greek", "chinese", "arabic", "mixed"])
def test_every_script_is_stitched(spark, make, script):
    """Results alone don't show it: a text that is out of step is encoded whole."""
    texts = [long_text(script, seed, size) for seed, size in ((1, 3000), (2, 1999), (3, 2063), (4, 2064))]
    rows = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(texts)], "h string, text string")
    chunks = bpe._chunks(rows, 200, 64)
    found = bpe.stitches(chunks, public_tokenizers.PATTERN, 200, 64).collect()
    assert len(found) > 30 and not [r for r in found if r["begin"] is None or r["end"] is None]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoder(bpe.read_ranks(path), public_tokenizers.PATTERN)
    tokenizer = bpe.Tokenizer(spark, path, public_tokenizers.PATTERN)
    got = sorted(tuple(r) for r in bpe.encoded_digests(make(list(enumerate(texts))), tokenizer, 200, 64).collect())
    assert got == [(i, *expected_ids(enc, t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x7CA, 0x7EB))), "".join(map(chr, range(0x2D30, 0x2D66))), "".join(map(chr, range(0x2C30, 0x2C5F))), "😀🦜🫠🏽👍🧿"], ids=["nko", "tifinagh", "glagolitic", "emoji"])
def test_scripts_of_any_age_are_stitched(spark, make, letters):
    """Characters added after Unicode 3.2, in words parted by single spaces: the encoder is asked whether it cuts there too."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(n)) for n in (700, 500)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = bpe.Tokenizer(spark, path, public_tokenizers.PATTERN)
    rows = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(texts)], "h string, text string")
    found = bpe.stitches(bpe._chunks(rows, 200, 64), public_tokenizers.PATTERN, 200, 64, tokenizer).collect()
    assert len(found) > 15 and not [r for r in found if r["begin"] is None or r["end"] is None]
    enc = bpe.encoder(bpe.read_ranks(path), public_tokenizers.PATTERN)
    got = sorted(tuple(r) for r in bpe.encoded_digests(make(list(enumerate(texts))), tokenizer, 200, 64).collect())
    assert got == [(i, *expected_ids(enc, t)) for i, t in enumerate(texts)]


def test_learned_lexicon_equals_plain(spark):
    """Terms, exceptions and half-way point from the sample, in plain Python."""
    rng = random.Random(11)
    words = ["".join(rng.choices("bcdfglmnprst", k=2)) + rng.choice("aeiou") + "".join(rng.choices("bdgklmnt", k=3)) for _ in range(120)]
    docs = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(3, 30))]
        if i % 3 == 0:
            text.insert(rng.randrange(len(text)), "gruntor")
        if i in (1, 41, 121):
            text += ["never", "- " * 60, "gruntor"]  # an exception phrase across a long gap
        docs.append((" ".join(text), int(i % 3 == 0)))
    got = toxicity.fitted(spark.createDataFrame(docs, "text string, toxic int").repartition(3))
    word = re.compile(r"[^\W\d_]+")
    a, b, contexts = collections.Counter(), collections.Counter(), {}
    for text, toxic in docs:
        found = word.findall(toxicity.fold(text))
        before = dict(zip(found, ["", *found], strict=False))
        terms = {w: p for w, p in before.items() if len(w) >= toxicity.LEAST_TERM}
        terms |= {f"{w[:k]}*": p for w, p in list(terms.items()) for k in toxicity.STEMS if len(w) > k}
        for t, p in terms.items():
            (a if toxic else b)[t] += 1
            if toxic:
                contexts.setdefault(t, set()).add(p)
    n, m = sum(t for _, t in docs), sum(1 - t for _, t in docs)
    odds = {t: (a[t] + 0.5) / (n + 1) / ((b[t] + 0.5) / (m + 1)) for t in a if a[t] >= toxicity.MIN_DOCS and len(contexts[t]) >= max(toxicity.MIN_CONTEXTS, a[t] ** 0.7)}
    assert got.weights == {t: pytest.approx(math.log(o)) for t, o in odds.items() if o >= toxicity.MIN_ODDS} and got.weights
    phrases = [collections.Counter(), collections.Counter()]
    for text, toxic in docs:
        hits = got.hits(toxicity.fold(text))
        phrases[toxic].update({f"{p} {t}" for t, p, _ in hits if p} | {f"{t} {q}" for t, _, q in hits if q})
    assert got.exceptions == {p for p, k in phrases[0].items() if k >= 3 and k / m > phrases[1][p] / n} and any(p.startswith("never ") for p in got.exceptions)
    weights = [got.weight(t) for t, _ in docs]
    cuts = [0.0, *sorted(set(weights)), max(weights) * 2 + 1]
    right = lambda cut: sum((w > cut) == bool(t) for w, (_, t) in zip(weights, docs, strict=True))
    assert right(got.half - 1e-12) == max(right(c - 1e-12) for c in cuts)


def test_equal_rows_spread_over_the_ranges_of_a_mix(spark, make):
    """Rows without id, equal in size and source, have shuffle keys of their own."""
    _, keyed = mixing.sized(make([(None, "a b c", "s")] * 3000 + [(1, "a b", "t")] * 50).select("doc_id", "source", "text"))
    assert keyed.select("_u").distinct().count() == 3050 == keyed.select("_row").distinct().count()
    taken = mixing.mixed_sizes(make([(None, "a b c", "s")] * 3000 + [(1, "a b", "t")] * 50)).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) < 10 for r in taken)


def test_chunks_lose_nothing(spark):
    texts = ["x" * n for n in (1, 63, 64, 199, 200, 263, 264, 265, 5000)]
    rows = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(texts)], "h string, text string")
    for r in bpe._chunks(rows, 200, 64).collect():
        whole = texts[int(r["h"][1:])]
        assert r["text"] == (whole[r["i"] * 200 :] if r["i"] == r["n"] - 1 else whole[r["i"] * 200 : (r["i"] + 1) * 200 + 64])
        assert r["i"] < r["n"] - 1 or r["n"] == 1 or len(r["text"]) > 64


def test_round_trip(spark, make):
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in bpe.decode(bpe.encode(make(ODD), tokenizer), tokenizer).collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


# WARC


def test_archives_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\nx" * 400
    rows = [(1, "u", big), (2, None, big), (3, "a b\r\nc", "tail\r"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\n\r\r\n"), (7, "u", "tail\r"), (None, "u", big), (8, "u", "y\n" * 3000 + "\r")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_archives(pages, str(tmp_path / "w"), 700)
    got = {r["page_id"]: r for r in warc.read_pages(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == big and page != 1
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None)
        assert tuple(got[page][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    chunks = warc.read_chunks(spark, str(tmp_path / "w")).filter("page_id = 8").orderBy("chunk_no").collect()
    raw = ("y\n" * 3000 + "\r").encode()
    upto = 0
    for c in chunks:
        upto += c["chunk_bytes"]
        assert c["payload_digest"] == hashlib.sha256(raw[:upto]).hexdigest()
    assert len(chunks) > 5 and upto == len(raw)


def test_archives_are_seekable_records(spark, tmp_path):
    """Any gzip reader finds one record a member, and every record has an id of its own."""
    rows = [(1, "u", "same " * 50), (1, "u", "same " * 50), (2, "v", "same " * 50), (None, None, "a"), (None, None, "a"), (3, "é", "z" * 5000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), 1000)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert files and not list((tmp_path / "w").glob("*.txt"))
    records = []
    for file in files:
        rest, before = file.read_bytes(), len(records)
        whole = gzip.decompress(rest)
        while rest:
            one = zlib.decompressobj(31)
            data = one.decompress(rest)
            rest = one.unused_data
            records += [data] if data else []
        assert b"".join(records[before:]) == whole
    assert all(r.startswith(b"WARC/1.1\r\n") and r.count(b"WARC-Record-ID") == 1 for r in records)
    ids = [re.search(rb"WARC-Record-ID: (\S+)", r).group(1) for r in records]
    assert len(ids) == len(set(ids)) == 5 + 5
    refers = {m.group(1) for r in records for m in re.finditer(rb"WARC-Refers-To: (\S+)", r)}
    assert len(refers) == 1 and refers <= set(ids)
    got = sorted((tuple(r) for r in warc.read_pages(spark, str(tmp_path / "w")).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(1, "response", None)] * 2 + [(2, "revisit", 1), (None, "response", None), (None, "response", None), (3, "response", None)], key=str)


def test_a_payload_is_cut_in_one_pass():
    whole = bytes(range(256)) * 50
    parts = list(warc.cut(whole, 1000))
    assert b"".join(p[1] for p in parts) == whole and [p[0] for p in parts] == list(range(1, 14)) and [p[3] for p in parts] == [False] * 12 + [True]
    assert all(p[2] == hashlib.sha256(whole[: p[0] * 1000]).hexdigest() for p in parts)
    assert list(warc.cut(b"", 1000)) == [(1, b"", hashlib.sha256(b"").hexdigest(), True)]


def test_archive_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 0


# quality


def plain_quality(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    covered, longest = set(), 0
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered |= set(range(i, i + k))
    grams = collections.defaultdict(list)
    for i in range(n - 2):
        grams[tuple(words[i : i + 3])].append(i)
    again = {k for v in grams.values() if len(v) > 1 for i in v for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(covered), longest


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_repetition_equals_brute_force(least):
    rng = random.Random(least)
    texts = [None, "", " ", "x " * 50, "a b c\n" * 9, "é# ü$\n|", "p q r s t u v w " * 4] + [" ".join(rng.choice("ab\ncdefgh" if rng.random() < 0.6 else "ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = quality.measures(texts, least)
    for text, row in zip(texts, got.itertuples(), strict=True):
        want = plain_quality(text, least)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, round(row.covered * max(row.n_words, 1)), row.longest_repeat) == want


def test_quality_of_odd_rows(make):
    got = quality.judged(make(ODD)).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got)
    assert quality.judged(make([])).count() == 0


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judged(docs).join(labels, "doc_id").filter("quality = 1 and not base_failed").collect()
    assert np.mean([r["kept"] for r in judged]) > 0.99


# toxicity


def test_folding():
    assert toxicity.fold("You 1d10t! l0s3r th!s wоrthless 2024 12:30") == "you idiot! loser this worthless 2024 12:30"


def test_matches_are_whole_words_and_exceptions_hold():
    lexicon = toxicity.Lexicon({"ass": 2.0, "bad*": 3.0}, frozenset({"ass mule"}), 1.0)
    assert [h[0] for h in lexicon.hits("class ass, badly embadded ass mule")] == ["ass", "bad*", "ass"]
    assert lexicon.score("ass mule class") == 0.0 and lexicon.score("an ass") > 0.5 and lexicon.score(None) == 0.0


def test_half_way():
    assert toxicity.half_way(np.array([0.0, 0.0, 2.0, 4.0]), np.array([0, 0, 1, 1])) == 1.0
    assert toxicity.half_way(np.array([]), np.array([])) > 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = queries.op10_folded_lexicon(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in out if r["toxic"]]
    clean = [r["predicted"] for r in out if r["toxic"] == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01  # a share of the labels is noise
    del docs


def test_toxicity_without_labels(spark, make):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    lexicon = toxicity.learned(make(ODD), labels)
    assert [r["score"] for r in toxicity.scored(make(ODD), lexicon).collect()] == [0.0] * len(ODD)
    assert toxicity.without_toxic(make(ODD), lexicon).count() == len(ODD)
    assert toxicity.scored(make([]), lexicon).count() == 0


# language


def test_gradients():
    network = langid.Network(["a", "b"])
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, langid.SYMBOLS, (6, 40)), rng.integers(0, 2, 6)
    _, found = network.gradients(x, y)
    for p, g in zip(network.parameters(), found, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = p[at], 3e-3
        p[at] = was + step
        up = network.gradients(x, y)[0]
        p[at] = was - step
        down = network.gradients(x, y)[0]
        p[at] = was
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.2, abs=2e-3)


def test_tables_equal_the_network():
    network = langid.Network(["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, langid.SYMBOLS, (9, 64)).astype(np.uint8)
    embedded = network.embedding[x]
    pooled = []
    for w, f, b in zip(langid.WIDTHS, network.filters, network.bias, strict=True):
        span = 64 - w + 1
        pooled.append(np.maximum((np.concatenate([embedded[:, j : j + span] for j in range(w)], axis=2) @ f + b).max(axis=1), 0))
    logits = np.concatenate(pooled, axis=1) @ network.out + network.out_bias
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(network.probabilities(x, network.folded()), want, atol=1e-4)


def test_language_held_out(spark):
    out = queries.op2_byte_cnn(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.filter("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_of_odd_rows(make):
    network = langid.Network(["en", "de"])
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in langid.predicted(make(ODD), network).collect()}
    assert {(1, True), (2, True), (3, True), (7, True), (4, False), (6, False)} <= got
    assert {r["lang_pred"] for r in langid.predicted(make(ODD), None).collect()} == {"und"}
    assert langid.trained(make([(1, None)]).select("doc_id", "text", "lang")) is None
    assert langid.predicted(make([]), network).count() == 0


def test_prediction_equals_the_plain_network(make):
    """Whole texts of several windows: the mean of the windows' probabilities, weighted by letters, without any table."""
    network = langid.Network(["a", "b", "c"], seed=3)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcdeé ü中 1", k=n))) for i, n in enumerate((5, 100, 256, 257, 1500))]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predicted(make(rows), network).collect()}
    for d, text in rows:
        x, _ = langid.text_windows([text])
        pooled = []
        for w, f, b in zip(langid.WIDTHS, network.filters, network.bias, strict=True):
            embedded = network.embedding[x]
            patches = np.concatenate([embedded[:, j : j + x.shape[1] - w + 1] for j in range(w)], axis=2)
            pooled.append(np.maximum((patches @ f + b).max(axis=1), 0))
        logits = np.concatenate(pooled, axis=1) @ network.out + network.out_bias
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        mean = np.average(p, axis=0, weights=(x >= 4).sum(axis=1) + 1e-6)
        assert got[d][0] == network.labels[int(mean.argmax())] and got[d][1] == pytest.approx(float(mean.max()), abs=1e-4)


def test_training_rows_are_bounded_over_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROWS", 400)
    rows = [(i, f"text of language {i % 50} number {i}", f"l{i % 50:02d}") for i in range(5000)]
    few = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 100 <= len(few) <= 400 and len({r["lang"] for r in few}) > 40


def test_verdict_of_quality_equals_plain_rules(make):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.choice((20, 80, 300)))
        passage = rng.choices(vocabulary, k=rng.choice((4, 9, 30, 120)))
        rows.append((i, " ".join(words + passage * rng.choice((0, 1, 2, 5)))))
    for r in quality.judged(make(rows)).collect():
        n, _, _, _, again, covered, longest = plain_quality(rows[r["doc_id"]][1], quality.MIN_WORDS)
        failed = n < 50 or 100 * again > 50 * n
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and covered <= 0.5 * n and longest <= 100)


def test_hits_are_those_of_a_plain_scan():
    rng = random.Random(10)
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc*": 1.0, "bca": 1.0, "c*": 1.0, "aab": 1.0, "cab*": 1.0})
    for _ in range(300):
        text = "".join(rng.choices("abc  .1", k=rng.randint(0, 40)))
        want = []
        for m in re.finditer(r"[^\W\d_]+", text):
            word = m.group()
            want += [t for t in lexicon.weights if (word.startswith(t[:-1]) if t.endswith("*") else word == t)]
        assert sorted(h[0] for h in lexicon.hits(text)) == sorted(want)


def test_sample_counts_rows_not_ids(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, 5).collect()
    assert len(rows) <= 10 and {r["toxic"] for r in rows} == {0, 1}


def test_other_scripts_stay_what_they_are():
    assert toxicity.fold("Сосна стоит в поле") == "сосна стоит в поле"
    assert toxicity.fold("you аss hоle, my friend") == "you ass hole, my friend"
    assert toxicity.fold("plain text сор again") == "plain text cop again"


@pytest.mark.parametrize("weights,toxic,cut", [([1, 1, 1, 1], [0, 1, 0, 1], None), ([0, 1, 1, 2], [0, 0, 1, 1], None), ([0, 0, 3], [0, 0, 1], 1.5)])
def test_half_way_with_ties(weights, toxic, cut):
    """Equal weights are on one side of any cut; the cut found is as good as any."""
    w, t = np.array(weights, float), np.array(toxic)
    half = toxicity.half_way(w, t)
    right = lambda c: int(((w >= c) == t).sum())
    assert right(half) == max(right(c) for c in (-1.0, 0.5, 1.5, 2.5, 9.0))
    assert cut is None or half == cut
