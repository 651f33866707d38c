"""Queries on corpus preparation: totals, strata, split, joins, audits, projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkstave.functions import scalars
from sparkstave.operators import batches, report, split
from sparkstave.plans import fixtures as fx
from sparkstave.session import scratch, table
from sparkstave.sources import tables

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("a01_origin_totals", f"WITH {fx.TOTALS_SQL} SELECT origin, total_tokens FROM totals")
def a01(spark, d):
    return split.origin_totals(fx.parts(spark, d))


@query("a02_quartile_strata", f"WITH {fx.STRATA_SQL} SELECT origin, total_tokens, stratum FROM strata")
def a02(spark, d):
    return split.with_strata(split.origin_totals(fx.parts(spark, d)))


@query("a03_stratum_means", f"WITH {fx.STRATA_SQL} SELECT stratum, count(*) AS n, avg(total_tokens) AS mean_tokens FROM strata GROUP BY stratum")
def a03(spark, d):
    return split.stratum_means(a02(spark, d))


@query("w04_token_balanced_split", f"WITH RECURSIVE {fx.SPLIT_SQL}" + """,
per AS (SELECT partition, count(*) AS n_scores, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM assigned GROUP BY partition),
pct AS (SELECT *, round(100.0e0 * total_tokens / sum(total_tokens) OVER (), 2) AS actual_pct,
        CASE partition WHEN 'training' THEN 64.0e0 WHEN 'validation' THEN 16.0e0 ELSE 20.0e0 END AS target_pct FROM per)
SELECT *, round(actual_pct - target_pct, 2) AS error_pct FROM pct""")
def w04(spark, d):
    return split.split_report(split.balanced_split(a02(spark, d)))


@query("w04b_pattern_split", f"WITH {fx.STRATA_SQL}" + """,
slot AS (SELECT list(k ORDER BY turn, p) AS cycle FROM (SELECT 'training' AS k, 0 AS p, (i + 0.5e0) / 16 AS turn FROM range(16) t(i) UNION ALL SELECT 'validation', 1, (i + 0.5e0) / 4 FROM range(4) t(i) UNION ALL SELECT 'test', 2, (i + 0.5e0) / 5 FROM range(5) t(i))),
shelved AS (SELECT *, CAST(CAST('0x' || substr(md5('shelf:' || origin), 1, 13) AS UBIGINT) AS BIGINT) AS key FROM strata),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum, key % 64 ORDER BY total_tokens DESC, key, origin) AS r FROM shelved),
assigned AS (SELECT total_tokens, cycle[CAST((r - 1) % 25 AS INTEGER) + 1] AS partition FROM r, slot),
per AS (SELECT partition, count(*) AS n_scores, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM assigned GROUP BY partition),
pct AS (SELECT *, round(100.0e0 * total_tokens / sum(total_tokens) OVER (), 2) AS actual_pct,
        CASE partition WHEN 'training' THEN 64.0e0 WHEN 'validation' THEN 16.0e0 ELSE 20.0e0 END AS target_pct FROM per)
SELECT *, round(actual_pct - target_pct, 2) AS error_pct FROM pct""")
def w04b(spark, d):
    return split.split_report(split.pattern_split(a02(spark, d)))


@query("a05_value_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def a05(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


def _hash_split(spark, d):
    """A cheap split of the strata by origin, for the reports."""
    names = F.array(*[F.lit(s) for s in split.SPLITS])
    return a02(spark, d).withColumn("partition", F.element_at(names, (F.pmod("origin", F.lit(3)) + 1).cast("int")))


HASH_SPLIT_SQL = fx.STRATA_SQL + ", dealt AS (SELECT *, CASE origin % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' ELSE 'test' END AS partition FROM strata)"


@query("a06_strata_crosstab", f"WITH {HASH_SPLIT_SQL}, c AS (SELECT stratum, count(*) FILTER (partition = 'training') AS training, " + """
count(*) FILTER (partition = 'validation') AS validation, count(*) FILTER (partition = 'test') AS test, count(*) AS n FROM dealt GROUP BY stratum)
SELECT stratum, training, validation, test, round(100.0e0 * training / n, 2) AS training_pct, round(100.0e0 * validation / n, 2) AS validation_pct,
round(100.0e0 * test / n, 2) AS test_pct FROM c""")
def a06(spark, d):
    return split.strata_crosstab(_hash_split(spark, d))


@query("a07_describe_split", f"WITH {HASH_SPLIT_SQL} SELECT partition, count(*) AS n, avg(total_tokens) AS mean, stddev_samp(total_tokens) AS std, " + """
min(total_tokens) AS low, quantile_cont(CAST(total_tokens AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(total_tokens AS DOUBLE), 0.5) AS q50,
quantile_cont(CAST(total_tokens AS DOUBLE), 0.75) AS q75, max(total_tokens) AS high FROM dealt GROUP BY partition""")
def a07(spark, d):
    return split.describe(_hash_split(spark, d))


@query("j05_label_parts", f"WITH {HASH_SPLIT_SQL} SELECT p.origin, p.part_key, p.part_line, p.n_tokens, s.partition FROM parts p LEFT JOIN dealt s ON p.origin = s.origin")
def j05(spark, d):
    return split.label_parts(fx.parts(spark, d), _hash_split(spark, d))


@query("w11_share_of_total", f"WITH {fx.TOTALS_SQL} SELECT origin, total_tokens, CAST(total_tokens AS DOUBLE) / sum(total_tokens) OVER () AS share FROM totals")
def w11(spark, d):
    totals = a01(spark, d)
    whole = totals.agg(F.sum("total_tokens").alias("whole"))
    return totals.crossJoin(F.broadcast(whole)).select("origin", "total_tokens", (F.col("total_tokens") / F.col("whole")).alias("share"))


@query("p01_subset_filter", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL")
def p01(spark, d):
    kept = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return kept.filter("o_orderpriority is not null")


@query("p02_dropna", "SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def p02(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").dropna(subset=["lang", "source"])


@query("p03_existing_files", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p03(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("p04_split_filter", f"WITH {HASH_SPLIT_SQL} SELECT origin, total_tokens FROM dealt WHERE partition = 'training'")
def p04(spark, d):
    return _hash_split(spark, d).filter("partition = 'training'").select("origin", "total_tokens")


@query("p05_derived_paths", r"""SELECT doc_id, regexp_replace(replace(source || '/mxl/' || doc_id || '.mxl', '/mxl/', '/lmx/'), '\.mxl$', '_P1.lmx') AS lmx_path,
regexp_replace(replace(source || '/mxl/' || doc_id || '.mxl', '/mxl/', '/midi/'), '\.mxl$', '_P1.mid') AS midi_path FROM documents""")
def p05(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/mxl/"), F.col("doc_id").cast("string"), F.lit(".mxl"))
    to = lambda folder, end: F.regexp_replace(F.replace(path, F.lit("/mxl/"), F.lit(f"/{folder}/")), r"\.mxl$", f"_P1.{end}")
    return docs.select("doc_id", to("lmx", "lmx").alias("lmx_path"), to("midi", "mid").alias("midi_path"))


@query("p06_row_ids", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS i FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, format('sample_{}_0', i) AS sample_id, 'eval_' || lpad(CAST(i AS VARCHAR), 7, '0') AS eval_id FROM r""")
def p06(spark, d):
    docs = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", "source")
    # Ranks inside ranges of (source, id) plus the rows of earlier ranges: no task sorts a source.
    rows = batches.global_rank(docs, F.col("source"), F.col("doc_id"), buckets=F.struct("source", batches.shelf_of(docs, "doc_id").alias("shelf")))
    return rows.select("doc_id", F.format_string("sample_%d_0", "rank").alias("sample_id"), F.format_string("eval_%07d", "rank").alias("eval_id"))


CONTRACT_SQL = """SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars <= 0 THEN 'length' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'variant' WHEN doc_id % 50 = 7 THEN 'path' END AS reason FROM documents"""


def _reason():
    return F.when(F.col("n_chars").isNull() | (F.col("n_chars") <= 0), "length").when(~F.col("lang").isin("en", "de", "fr"), "variant").when(F.col("doc_id") % 50 == 7, "path")


@query("p07_row_contract", CONTRACT_SQL)
def p07(spark, d):
    return table(spark, d, "documents").select("doc_id", _reason().alias("reason"))


@query("p08_quarantine", f"WITH c AS ({CONTRACT_SQL}) SELECT CASE WHEN reason IS NULL THEN 'good' ELSE 'quarantine' END AS kept_in, reason, d.doc_id, d.source, d.n_chars FROM documents d JOIN c ON d.doc_id = c.doc_id")
def p08(spark, d):
    """Two tables are written: good rows, and bad ones with the reason; the result reads both."""
    docs = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", "source", "n_chars", "lang")
    good, bad = scratch(spark, "good"), scratch(spark, "quarantine")
    tables.write_quarantine(docs.withColumn("reason", _reason()).drop("lang"), "reason", good, bad)
    schema = "doc_id bigint, source string, n_chars bigint"
    kept = spark.read.schema(schema).parquet(good).withColumn("reason", F.lit(None).cast("string")).withColumn("kept_in", F.lit("good"))
    return kept.unionByName(spark.read.schema(schema + ", reason string").parquet(bad).withColumn("kept_in", F.lit("quarantine")))


@query("p09_skip_list", "SELECT doc_id, source FROM documents WHERE doc_id >= 20 AND doc_id NOT IN (SELECT item_id FROM benchmark WHERE item_id IS NOT NULL)")
def p09(spark, d):
    skip = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source").filter("doc_id >= 20").join(skip, "doc_id", "left_anti")


@query("p10_column_drop", "SELECT doc_id, lang, source, n_chars FROM documents")
def p10(spark, d):
    return table(spark, d, "documents").drop("text")


@query("p11_ignored_labels", "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN -100 ELSE event_id % 10 END AS label FROM events WHERE event_id % 17 <> 0")
def p11(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.when(i % 17 == 0, F.lit(-100)).otherwise(i % 10).alias("label")).filter("label <> -100")


@query("j01_first_match", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT s.s_suppkey, s.s_name, f.c_custkey, f.c_name FROM supplier s JOIN f ON s.s_nationkey = f.c_nationkey AND f.r = 1""")
def j01(spark, d):
    first = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by(F.struct("c_custkey", "c_name"), "c_custkey").alias("c"))
    s = table(spark, d, "supplier").filter("s_nationkey is not null")
    return s.join(first, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "s_name", "c.c_custkey", "c.c_name")


@query("j02_pairing", "SELECT d.doc_id, d.source, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j02(spark, d):
    l = table(spark, d, "labels").select(F.col("doc_id").alias("other"), "quality")  # noqa: E741
    return table(spark, d, "documents").join(l, F.col("doc_id") == F.col("other"), "left").select("doc_id", "source", "quality", F.col("other").isNull().alias("missing"))


@query("j03_alignment_precheck", """SELECT coalesce(d.doc_id, b.item_id) AS id, CASE WHEN b.item_id IS NULL THEN 'truth only' ELSE 'prediction only' END AS side
FROM documents d FULL OUTER JOIN benchmark b ON d.doc_id = b.item_id WHERE d.doc_id IS NULL OR b.item_id IS NULL""")
def j03(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    p = table(spark, d, "benchmark").select("item_id")
    both = t.join(p, F.col("doc_id") == F.col("item_id"), "full_outer").filter("doc_id is null or item_id is null")
    return both.select(F.coalesce("doc_id", "item_id").alias("id"), F.when(F.col("item_id").isNull(), "truth only").otherwise("prediction only").alias("side"))


MANIFEST_SQL = """m AS (SELECT event_id AS line, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'c' || user_id END AS id, 'xml/m' || user_id || '.musicxml' AS xml, CASE WHEN event_id % 4 > 0 THEN 'lmx/l' || user_id || '.lmx' END AS lmx,
CASE WHEN event_id % 3 = 0 THEN 'clean' ELSE '' END AS selected_variant, CASE WHEN event_id % 3 = 1 THEN 'light' END AS variant, CASE WHEN event_id % 7 > 0 THEN 'heavy' END AS noise FROM events)"""


@query("j04_variant_lookup", f"""WITH {MANIFEST_SQL},
v AS (SELECT *, coalesce(nullif(selected_variant, ''), nullif(variant, ''), nullif(noise, '')) AS chosen FROM m),
k AS (SELECT line, chosen, unnest([id, regexp_extract(xml, '([^/]*)\\.[^.]*$', 1), regexp_extract(lmx, '([^/]*)\\.[^.]*$', 1)]) AS key FROM v WHERE chosen IS NOT NULL),
l AS (SELECT key, arg_max(chosen, line) AS variant FROM k WHERE key <> '' GROUP BY key),
f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'c' || c_custkey || '.xml' WHEN 1 THEN 'm' || c_custkey || '.xml' WHEN 2 THEN 'l' || c_custkey || '.musicxml' ELSE 'c' || c_custkey END AS file FROM customer)
SELECT c_custkey, file, coalesce(a.variant, b.variant, 'unknown') AS variant FROM f LEFT JOIN l a ON regexp_replace(f.file, '(.)\\.[^.]*$', '\\1') = a.key LEFT JOIN l b ON f.file = b.key""")
def j04(spark, d):
    i, user, c = F.col("event_id"), F.col("user_id").cast("string"), F.col("c_custkey")
    manifest = table(spark, d, "events").select(
        i.alias("line"), F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), user)).alias("id"), F.concat(F.lit("xml/m"), user, F.lit(".musicxml")).alias("truncated_musicxml_path"),
        F.when(i % 4 > 0, F.concat(F.lit("lmx/l"), user, F.lit(".lmx"))).alias("truncated_lmx_path"), F.when(i % 3 == 0, "clean").otherwise("").alias("selected_variant"),
        F.when(i % 3 == 1, "light").alias("variant"), F.when(i % 7 > 0, "heavy").alias("noise"),
    )
    number = c.cast("string")
    name = F.when(c % 4 == 0, F.concat(F.lit("c"), number, F.lit(".xml"))).when(c % 4 == 1, F.concat(F.lit("m"), number, F.lit(".xml")))
    files = table(spark, d, "customer").select("c_custkey", name.when(c % 4 == 2, F.concat(F.lit("l"), number, F.lit(".musicxml"))).otherwise(F.concat(F.lit("c"), number)).alias("file"))
    return report.with_variants(files, report.variant_map(manifest))


@query("j06_membership", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j06(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j07_storage_audit", """WITH c AS (SELECT doc_id, n_chars FROM documents), s AS (SELECT item_id AS doc_id, length(text) AS size FROM benchmark UNION ALL SELECT doc_id + 100000, 0 FROM labels WHERE doc_id % 10 = 0)
SELECT coalesce(c.doc_id, s.doc_id) AS id, CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN c.doc_id IS NULL AND s.size = 0 THEN 'empty orphan' WHEN c.doc_id IS NULL THEN 'orphan' WHEN s.size <> c.n_chars THEN 'count mismatch' ELSE 'ok' END AS finding
FROM c FULL OUTER JOIN s ON c.doc_id = s.doc_id""")
def j07(spark, d):
    c = table(spark, d, "documents").select("doc_id", "n_chars")
    s = table(spark, d, "benchmark").select(F.col("item_id").alias("at"), F.length("text").alias("size"))
    s = s.unionByName(table(spark, d, "labels").filter("doc_id % 10 = 0").select((F.col("doc_id") + 100000).alias("at"), F.lit(0).alias("size")))
    both = c.join(s, F.col("doc_id") == F.col("at"), "full_outer")
    finding = (
        F.when(F.col("at").isNull(), "missing").when(F.col("doc_id").isNull() & (F.col("size") == 0), "empty orphan").when(F.col("doc_id").isNull(), "orphan")
        .when(F.col("size") != F.col("n_chars"), "count mismatch").otherwise("ok")
    )
    return both.select(F.coalesce("doc_id", "at").alias("id"), finding.alias("finding"))


@query("j12_carry_flags", """SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, o.o_orderpriority FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def j12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("j13_selected_truth", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def j13(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").filter("lang = 'de'").select("doc_id"), "doc_id", "left_semi")


@query("j14_resume", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j14(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("u01_union_of_measures", f"WITH {fx.NOTES_SQL} SELECT DISTINCT file, measure_idx FROM notes")
def u01(spark, d):
    n = fx.notes(spark, d).select("file", "side", "measure_idx")
    return n.filter("side = 'gt'").drop("side").union(n.filter("side = 'pred'").drop("side")).distinct()


@query("u02_name_difference", "SELECT doc_id AS id FROM documents EXCEPT SELECT item_id FROM benchmark")
def u02(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).subtract(table(spark, d, "benchmark").select("item_id"))


@query("u03_bag_intersection", f"WITH {fx.NOTES_SQL} SELECT file, part_idx, pitch FROM notes WHERE side = 'gt' INTERSECT ALL SELECT file, part_idx, pitch FROM notes WHERE side = 'pred'")
def u03(spark, d):
    n = fx.notes(spark, d).select("side", "file", "part_idx", "pitch")
    return n.filter("side = 'gt'").drop("side").intersectAll(n.filter("side = 'pred'").drop("side"))


@query("u04_bag_equality", f"WITH {fx.NOTES_SQL}, k AS (SELECT file, measure_idx, pitch, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gt') AS ng FROM notes GROUP BY ALL) " + """
SELECT file, measure_idx, bool_and(np = ng) AS equal FROM k GROUP BY file, measure_idx""")
def u04(spark, d):
    from sparkstave.operators import match

    return match.side_counts(fx.notes(spark, d), "file", "measure_idx", "pitch").groupBy("file", "measure_idx").agg(F.bool_and(F.col("np") == F.col("ng")).alias("equal"))


@query("u05_append_splits", "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'training' ELSE 'test' END AS split FROM documents")
def u05(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    even = docs.filter("doc_id % 2 = 0").withColumn("split", F.lit("training"))
    return even.unionByName(docs.filter("not doc_id % 2 = 0").select("lang", "doc_id").withColumn("split", F.lit("test")))


@query("a26_corpus_statistics", r"SELECT lang, count(*) AS files, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''))) AS BIGINT) AS symbols, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def a26(spark, d):
    from sparkstave.functions import arrays

    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.size(arrays.words(F.col("text")))).alias("symbols"), F.sum(F.length("text")).alias("chars"))


@query("a31_note_counts", f"WITH {fx.NOTES_SQL} SELECT file, count(*) AS n_notes, count(DISTINCT measure_idx) AS n_measure FROM notes WHERE side = 'gt' GROUP BY file")
def a31(spark, d):
    return fx.notes(spark, d).filter("side = 'gt'").groupBy("file").agg(F.count("*").alias("n_notes"), F.count_distinct("measure_idx").alias("n_measure"))


@query("f25_27_variant_assignment", """WITH u AS (SELECT doc_id, 'sample_' || doc_id || '_0' AS id FROM documents WHERE doc_id IS NOT NULL),
v AS (SELECT id, CAST(CAST('0x' || substr(sha256('42:' || id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0e0 AS u FROM u)
SELECT id, u, CASE WHEN u < 1e0 / 3 THEN 'clean' WHEN u < 1e0 / 3 + 1e0 / 3 THEN 'light' ELSE 'heavy' END AS variant FROM v""")
def f27(spark, d):
    ids = table(spark, d, "documents").filter("doc_id is not null").select(F.format_string("sample_%d_0", "doc_id").alias("id"))
    shares = scalars.normalized_ratios({"clean": 1, "light": 1, "heavy": 1})
    return ids.withColumn("u", scalars.stable_uniform(42, F.col("id"))).withColumn("variant", scalars.variant_of(F.col("u"), shares))


@query("a22_variant_rates", f"WITH v AS ({SQL['f25_27_variant_assignment'].split('WITH u AS')[0]} SELECT * FROM (WITH u AS{SQL['f25_27_variant_assignment'].split('WITH u AS')[1]})) " + """
SELECT variant, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM v GROUP BY variant""")
def a22(spark, d):
    counts = f27(spark, d).groupBy("variant").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("a23_success_rates", "SELECT lang, count(*) FILTER (n_chars > 1000) AS n_ok, count(*) AS n, avg(CASE WHEN n_chars > 1000 THEN 1e0 ELSE 0e0 END) AS rate FROM documents GROUP BY lang")
def a23(spark, d):
    ok = F.col("n_chars") > 1000
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("rate"))


@query("a24_group_validity", """WITH a AS (SELECT coalesce(lang, 'overall') AS grp, count(*) AS available, count(l.doc_id) AS evaluated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang))
SELECT grp, available, evaluated FROM a""")
def a24(spark, d):
    l = table(spark, d, "labels").select(F.col("doc_id").alias("other"))  # noqa: E741
    joined = table(spark, d, "documents").join(l, F.col("doc_id") == F.col("other"), "left")
    return joined.rollup("lang").agg(F.count("*").alias("available"), F.count("other").alias("evaluated"), F.grouping("lang").alias("g")).select(
        F.when(F.col("g") == 1, "overall").otherwise(F.col("lang")).alias("grp"), "available", "evaluated"
    )


@query("o03_seeded_shuffle", """SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) - 1 AS place
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5('45:' || doc_id), 1, 13) AS UBIGINT) AS BIGINT) AS key FROM documents WHERE doc_id IS NOT NULL)""")
def o03(spark, d):
    docs = table(spark, d, "documents").filter("doc_id is not null").select("doc_id").withColumn("key", batches.hash_key(42 + 3, "doc_id"))
    return batches.global_rank(docs, F.col("key"), F.col("doc_id"), buckets=F.shiftright(F.col("key"), 40)).select("doc_id", F.col("rank").alias("place"))


@query("o05_first_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def o05(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(100)


@query("o02_sort_by_length", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def o02(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query("o04_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 1")
def o04(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))).limit(1)


@query("o06_weighted_draw", """WITH u AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256('5:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0e0 AS u FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN u < 0.5e0 THEN 'clean' WHEN u < 0.5e0 + 0.3e0 THEN 'light' ELSE 'heavy' END AS variant FROM u""")
def o06(spark, d):
    docs = table(spark, d, "documents").filter("doc_id is not null").select("doc_id")
    u = scalars.stable_uniform(5, F.col("doc_id").cast("string"))
    return docs.select("doc_id", scalars.variant_of(u, {"clean": 0.5, "light": 0.3, "heavy": 0.2}).alias("variant"))
