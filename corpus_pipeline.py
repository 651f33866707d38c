"""A corpus pipeline: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it again for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstave.session import scratch, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon rejects go (labels of held-out rows stay unused).

    Rows without text score 0 and stay; equal rows share one fate; without labels all stay.
    """
    from sparkstave.llm import toxicity as op

    lexicon = op.learned(docs, table(spark, sf_dir, "labels"))
    return op.without_toxic(docs, lexicon)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words a shingle, similarity 0.8 or more).

    Rows are told apart by a number of their own, so ids may be null or repeated: the row of least id stays (null last). Rows without
    words are near to nothing; of those that are equal in all columns one stays.
    """
    from sparkstave.llm import neardup as op

    # Numbers hold once they are written. The columns travel as one, so that none of theirs can clash.
    rows = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    found = op.near_duplicates(rows.select(F.col("number").alias("doc_id"), "row.text"), k=5, percent=80)
    found = stored(found.select(F.col("doc_id").alias("number"), "component_id", "n_shingles"), "groups")
    worded = found.filter("n_shingles > 0").join(rows.select("number", "row.doc_id"), "number")
    first = worded.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("number")))["number"].alias("number"))
    wordless = rows.join(found.filter("n_shingles = 0").select("number"), "number", "left_semi")
    kept = first.select("number").unionByName(wordless.groupBy("row").agg(F.min("number").alias("number")).select("number"))
    return rows.join(kept, "number", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that start anywhere else are cut; a document that is nothing else goes.

    Rows without words lose none and stay; of equal rows that fill a window none stays, as each repeats the other.
    """
    from sparkstave.llm import substrings as op

    cut = op.without_repeats(docs, keep_emptied=False)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, or up to three times.

    Rows without words weigh nothing; a null source is a source of its own; ids may be null or repeated.
    """
    from sparkstave.llm import mixing as op

    return op.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document row: doc_id, number of ids, digests of the ids and of the bytes they decode to; a null text has no ids."""
    import public_tokenizers

    from sparkstave.llm import bpe as op

    tokenizer = op.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return op.encoded_digests(docs, tokenizer)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Learned lexicons, verified MinHash components and BPE are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
