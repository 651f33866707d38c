"""Queries on sources, sinks, user functions and the stream: the driver's tables written and read back."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparkstave import schemas
from sparkstave.functions import one_to_many
from sparkstave.operators import notes as nt
from sparkstave.session import scratch, spread, table
from sparkstave.sources import scores, tables
from sparkstave.streaming import parts

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("s01_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def s01(spark, d):
    rows, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), scratch(spark, "csv")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query("s02_list_files", "SELECT n_regionkey AS k FROM nation GROUP BY 1")
def s02(spark, d):
    path = scratch(spark, "files")
    table(spark, d, "nation").repartitionByRange(3, "n_regionkey").write.partitionBy("n_regionkey").parquet(path)
    files = tables.list_files(spark, path, ".parquet").filter("length > 0")
    return files.select(F.regexp_extract("path", r"^n_regionkey=(\d+)/", 1).cast("int").alias("k")).distinct()


@query("s03_whole_texts", r"SELECT doc_id, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS content FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")
def s03(spark, d):
    docs, path = spread(table(spark, d, "documents")).dropna(subset=["doc_id", "text"]), scratch(spark, "texts")
    tables.write_files(docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("value")), path)
    return tables.read_whole_texts(spark, path, deep=True).select(F.regexp_extract("name", r"^-?\d+", 0).cast("bigint").alias("doc_id"), "content")


@query("s04_json_lines", "SELECT event_id, user_id, event_type, value FROM events")
def s04(spark, d):
    rows, path = table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), scratch(spark, "json")
    tables.write_json_lines(rows, path, rows.columns)
    return tables.read_json_lines(spark, path, rows.schema)


@query("s05_split_scan", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def s05(spark, d):
    path = scratch(spark, "splits")
    tables.write_splits(table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("split")), path)
    return tables.read_split(spark, path, "de")


@query("s06_required_columns", "SELECT doc_id, lang FROM documents")
def s06(spark, d):
    return schemas.require_columns(table(spark, d, "documents"), "doc_id", "text", "lang", "source").select("doc_id", "lang")


@query("s07_csv_replace", "SELECT s_suppkey, s_name FROM supplier")
def s07(spark, d):
    rows, path = table(spark, d, "supplier").select("s_suppkey", "s_name"), scratch(spark, "csv")
    tables.write_csv(rows.filter("s_suppkey < 10"), path)
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query("s08_s12_split_sink", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'training' END AS split FROM documents) GROUP BY split")
def s08(spark, d):
    rows, path = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("training").alias("split")), scratch(spark, "splits")
    tables.write_splits(rows, path)
    tables.write_splits(rows, path, guard=False)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("s09_manifest_sink", "SELECT 'eval_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS id, lang AS selected_variant, CAST(n_chars AS INTEGER) AS selected_source_length, n_chars > 10 AS xml_conversion_ok FROM documents WHERE doc_id IS NOT NULL")
def s09(spark, d):
    docs, path = table(spark, d, "documents").filter("doc_id is not null"), scratch(spark, "manifest")
    rows = docs.select(F.format_string("eval_%07d", "doc_id").alias("id"), F.col("lang").alias("selected_variant"), F.col("n_chars").cast("int").alias("selected_source_length"), (F.col("n_chars") > 10).alias("xml_conversion_ok"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.MANIFEST if f.name not in rows.columns]
    tables.write_json_lines(rows.select("*", *rest), path, schemas.MANIFEST.fieldNames())
    return tables.read_json_lines(spark, path, schemas.MANIFEST).select(*rows.columns)


@query("s10_statistics_sink", "SELECT source, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY source")
def s10(spark, d):
    stats, path = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")), scratch(spark, "stats")
    tables.write_statistics(stats, path)
    return spark.read.text(path).select(F.from_json("value", stats.schema).alias("x")).select("x.*")


@query("s11_artefacts", "SELECT CAST(page_id AS VARCHAR) AS id, 'html' AS kind, length(html) AS n, html LIKE '%</html>%' AS ok FROM pages WHERE html IS NOT NULL")
def s11(spark, d):
    pages, path = table(spark, d, "pages").filter("html is not null"), scratch(spark, "artefacts")
    ok = F.col("html").contains("</html>")
    tables.write_artefacts(pages.select(F.col("page_id").cast("string").alias("id"), F.lit("html").alias("kind"), F.col("html").alias("content"), ok.alias("ok"), F.when(~ok, "cut off").alias("error")), path)
    return spark.read.parquet(path).select("id", "kind", F.length("content").cast("bigint").alias("n"), "ok")


@query("s13_partition_csv", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s13(spark, d):
    rows, path = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), scratch(spark, "csv")
    tables.write_csv(rows, path, "o_orderstatus")
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("s14_score_elements", """SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn % 2 AS INTEGER) AS part, count(*) AS n_notes, CAST(sum(length(text) % 7 + 1) AS BIGINT) AS total
FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL""")
def s14(spark, d):
    files = score_markup(spark, d)
    return note_totals(nt.score_elements(files), files)


def note_totals(elements, files):
    parsed = elements.join(files.select("file", "low"), "file").filter("tag = 'note'")
    return parsed.groupBy("file", (F.col("part_idx") + F.col("low")).cast("int").alias("part")).agg(F.count("*").alias("n_notes"), F.sum(F.col("duration").cast("bigint")).alias("total"))


def score_markup(spark, d):
    """(file, content, low) from conversations: a turn is a note, its length the duration; ``low`` is the first part's number."""
    c = table(spark, d, "conversations").dropna(subset=["conv_id", "turn", "text"])
    note = F.concat(F.lit("<note><duration>"), (F.length("text") % 7 + 1).cast("string"), F.lit("</duration></note>"))
    part = c.groupBy("conv_id", (F.col("turn") % 2).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(note)), "").alias("notes"))
    body = F.concat(F.lit("<part id='P"), F.col("part").cast("string"), F.lit("'><measure number='1'>"), F.col("notes"), F.lit("</measure></part>"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", body.alias("body")))), lambda x: x["body"])
    files = part.groupBy("conv_id").agg(F.concat(F.lit("<score>"), F.array_join(listed, ""), F.lit("</score>")).alias("content"), F.min("part").alias("low"))
    return files.select(F.col("conv_id").cast("string").alias("file"), "content", "low")


@query("s14_score_source", SQL["s14_score_elements"])
def s14b(spark, d):
    """The same markup, written to a file for each score and read by the source ``scores``."""
    files, path = score_markup(spark, d), scratch(spark, "scores")
    tables.write_files(files.select(F.col("file").alias("name"), F.col("content").alias("value")), path)
    scores.register(spark)
    found = spark.read.format("scores").option("extensions", ".txt").load(path).withColumn("file", F.regexp_extract("file", r"([^/]*)-\d+\.txt$", 1))
    return note_totals(found, files)


@query("v01_batched_map", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 500")
def v01(spark, d):
    def keep(batches, least: int = 500):
        for batch in batches:
            n = pc.utf8_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n], ["doc_id", "n"]).filter(pc.greater(n, least))

    return table(spark, d, "documents").select("doc_id", "text").filter("text is not null").mapInArrow(keep, "doc_id bigint, n bigint")


@query("v02_one_to_many", r"SELECT doc_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE line <> ''")
def v02(spark, d):
    def lines(batches):
        for batch in batches:
            rows = [(k, i, x) for k, t in zip(batch["doc_id"], batch["text"], strict=True) for i, x in enumerate((t or "").split("\n")) if x]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "line"])

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(lines, "doc_id bigint, line_no int, line string")


@query("v02_lateral", SQL["v02_one_to_many"])
def v02b(spark, d):
    """One to many from SQL text."""
    one_to_many.register(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT d.doc_id, x.place AS line_no, x.item AS line FROM {docs} d, LATERAL one_to_many(d.text, '\n') x WHERE x.item <> ''", docs=docs)


@query("v03_missing_predictions", "SELECT doc_id, upper(source) AS prediction FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def v03(spark, d):
    def generate(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "prediction": batch["source"].str.upper()})

    missing = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return missing.mapInPandas(generate, "doc_id bigint, prediction string")


@query("x01_quarantine_stream", "SELECT CASE WHEN event_type = 'error' THEN 'quarantine' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY 1")
def x01(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    landing, good, bad = scratch(spark, "landing"), scratch(spark, "good"), scratch(spark, "bad")
    events.unionByName(events.filter("event_id % 9 = 0")).repartitionByRange(6, "ts").write.parquet(landing)
    stream = parts.part_stream(spark, landing, events.schema, files_per_batch=2)
    parts.run_quarantine(stream, ["event_id"], "ts", "400 days", F.when(F.col("event_type") == "error", F.lit("error")), good, bad, scratch(spark, "stream"))
    count = lambda path, kind: spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(good, "good").unionByName(count(bad, "quarantine"))


@query("x01_whole_origins", "SELECT user_id AS origin, count(*) AS n_parts, CAST(sum(event_id % 100) AS BIGINT) AS total_tokens FROM events GROUP BY 1")
def x01b(spark, d):
    """Events of users as parts of origins, in two runs of one stream: the second goes on where the first has stopped."""
    events = table(spark, d, "events").select(F.col("user_id").alias("origin"), F.col("event_id").alias("part_id"), (F.col("event_id") % 100).alias("n_tokens"))
    given = events.join(events.groupBy("origin").agg(F.count("*").alias("n_parts")), "origin")
    landing, out, state = scratch(spark, "landing"), scratch(spark, "origins"), scratch(spark, "stream")
    early = F.col("part_id") % 3 > 0
    for some in (given.filter(early), given.filter(~early).unionByName(given.filter("part_id % 5 = 1"))):
        some.coalesce(4).write.mode("append").parquet(landing)
        parts.run_whole_origins(parts.part_stream(spark, landing, given.schema), out, state)
    return spark.read.parquet(out)
