"""The pipeline's stages in order, each against what the stage before has kept."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest

from sparkstave.llm import bpe, mixing, toxicity
from sparkstave.session import scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def columns_of(rows):
    return SCHEMA



def test_stages(spark, tmp_path):
    from test_neardup import brute as components
    from test_substrings import brute as removal

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = (docs.collect(), after.collect())
        if name != "tokens":
            assert after.columns == columns
        docs = after

    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learned(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if lexicon.score(r["text"]) < 0.5)
    assert len(after) > 0.8 * len(before)
    before, after = kept["near_duplicates"]
    want = {d for d, _, _, stays in components([(r["doc_id"], r["text"]) for r in before], 5, 80) if stays}
    assert {r["doc_id"] for r in after} == want
    before, after = kept["repeated_passages"]
    digests = {d: (n, k, sha) for d, n, k, sha in removal([(r["doc_id"], r["text"]) for r in before], 35)}
    assert {r["doc_id"] for r in after} == {d for d, (n, k, _) in digests.items() if not n or k < n}
    for r in after:
        assert hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() == digests[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"])
    before, after = kept["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before}
    copies = [r["doc_id"] for r in after]
    assert all(r["text"] == texts[r["doc_id"]] for r in after) and max(map(copies.count, copies)) <= 3
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(spark.createDataFrame(before, columns_of(before))).collect()}
    size = {d: len(t.encode().split()) for d, t in texts.items()}
    assert all(copies.count(d) * size[d] == taken[d] for d in texts)
    words = sum(size.values())
    assert 0 <= words - sum(len(r["text"].encode().split()) for r in after) < 20_000
    enc = bpe.encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    before, after = kept["tokens"]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in after) == sorted((r["doc_id"], len(enc.encode_ordinary(r["text"]))) for r in before)
    assert sorted(r["decoded_sha256"] for r in after) == sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in before)


def test_near_duplicates_keep_one_row_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    near = text.replace("ten", "ten eleven")
    rows = [(5, text), (5, text), (None, text), (3, near), (None, None), (None, None), (7, ""), (7, ""), (7, None), (None, "alone here"), (None, "alone here")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id bigint, text string, component_id string, number int")
    docs.repartition(3).write.parquet(p := scratch(spark, "docs"))
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(p), "").collect()]
    assert sorted(got, key=str) == sorted([(3, near), (None, None), (7, ""), (7, None), (None, "alone here")], key=str)


ROWS = [(None, None, None, None, None), (1, None, "en", None, None), (1, "", None, "a", 0), (2, "x" * 5000, "en", "a", 5000), (2, "x" * 5000, "en", "a", 5000), (3, " \n\t", "de", None, 3), (None, "word " * 20_000, None, "b", 100_000), (4, "é 中文", "fr", "b", 4)]


@pytest.mark.parametrize("rows", [[], ROWS])
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, tmp_path, name, rows):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns beside those of documents."""
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA + ", size string, h int, score double")
    docs.write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    got = out.collect()
    if name == "tokens":
        assert len(got) == len(rows)
        return
    assert out.columns == docs.columns
    texts = [r["text"] for r in got]
    if name == "toxicity":
        assert len(got) == len(rows)
    if rows and name == "near_duplicates":
        assert texts.count("x" * 5000) == 1 and len(got) == len(rows) - 1
    if rows and name == "repeated_passages":
        assert len(got) == len(rows) - 1 and "word " * 20_000 not in texts
