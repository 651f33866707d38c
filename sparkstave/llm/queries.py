"""The queries of the numbered operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstave.session import scratch, spread, table


def op1_wfq_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import mixing

    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS again FROM documents),
u AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, *, CAST(CAST('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), CASE WHEN again > 0 THEN CAST(again AS VARCHAR) END)), 1, 13) AS UBIGINT) AS BIGINT) AS u FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM u GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM per),
weighed AS (SELECT *, (s - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM ranked),
lev AS (
  SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM weighed),
lev2 AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY ratio, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM lev),
lam AS (SELECT level FROM lev2 WHERE level <= ratio ORDER BY ratio, s LIMIT 1),
t AS MATERIALIZED (
  SELECT v.source, v.s, v.source_size, v.total, least(CAST(v.cap AS DOUBLE), lam.level * CAST(v.w AS DOUBLE)) AS target FROM lev2 v, lam),
served AS (
  SELECT u.rid, u.doc_id, u.size, u.u, t.s, t.source_size, t.target, t.total,
         CAST(sum(u.size) OVER (PARTITION BY t.s ORDER BY u.u, u.doc_id NULLS LAST, u.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS served
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
offered AS (
  SELECT rid, doc_id, size, u, s, total, e, CAST(served + e * source_size AS DOUBLE) / nullif(target, 0) AS finish
  FROM served, (VALUES (0), (1), (2)) AS x(e)),
cut AS (
  SELECT rid, size, total, sum(size) OVER (ORDER BY finish, s, u, doc_id NULLS LAST, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM offered WHERE finish IS NOT NULL),
took AS (SELECT rid, CAST(sum(size) AS BIGINT) AS taken FROM cut WHERE upto <= total GROUP BY rid)
SELECT v.doc_id, v.size, v.source_size, v.target, coalesce(k.taken, 0) AS taken
FROM served v LEFT JOIN took k ON v.rid = k.rid
"""


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards under the law ``bytes``: version 1 of the map is stored, then edited for the totals at hand and stored as version 2.

    The edit leaves small differences alone, so over one table it moves nothing.
    """
    from sparkstave.llm import sharding

    rows = sharding.slotted(table(spark, sf_dir, "documents"))
    root = scratch(spark, "slot-map")
    totals = sharding.slot_totals(rows)
    sharding.write_map(sharding.slot_map(totals, 24), root, 1)
    sharding.write_map(sharding.rebalanced(sharding.read_map(spark, root), totals, 24), root, 2)
    out = sharding.placed(rows, sharding.read_map(spark, root))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def _crc_half(x: str) -> str:
    """SQL of four steps of the CRC's shift register."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(str(k))
    return f"xor({x} // 16, [{', '.join(table)}][{x} % 16 + 1])"


OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || array_slice(h, 2 * i + 1, 2 * i + 2) AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: {_crc_half(_crc_half("xor(c, x)"))}), 4294967295) AS crc FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, crc, size) - 1 AS again FROM c),
r AS MATERIALIZED (SELECT *, CAST(CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), crc, size, again)), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS v FROM n),
t AS (SELECT v, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY v),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY bytes DESC, v) AS k FROM t),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, list_transform(range(24), lambda i: CAST(0 AS BIGINT)) AS loads, CAST(NULL AS INTEGER) AS shard
  UNION ALL
  SELECT o.k, list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + o.bytes ELSE x END),
         CAST(list_position(w.loads, list_min(w.loads)) - 1 AS INTEGER)
  FROM walk w JOIN o ON o.k = w.k + 1),
m AS (SELECT o.v, w.shard, CAST(coalesce(sum(o.n_rows) OVER (PARTITION BY w.shard ORDER BY o.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM o JOIN walk w ON o.k = w.k)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, CAST(r.crc AS BIGINT) AS text_crc32, 'bytes' AS law, m.shard,
       m.before + row_number() OVER (PARTITION BY r.v ORDER BY r.doc_id NULLS LAST, r.crc, r.size, r.again) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, r.v AS virtual_slot
FROM r JOIN m ON r.v = m.v
"""


QUERIES = {"op1_wfq_mixing": op1_wfq_mixing, "op4_virtual_slots": op4_virtual_slots}
SQL = {"op1_wfq_mixing": OP1_SQL, "op4_virtual_slots": OP4_SQL}


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkstave.llm import bpe

    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encoded_digests(spread(table(spark, sf_dir, "documents")), tokenizer)


QUERIES["op5_chunked_bpe"] = op5_chunked_bpe


def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import quality

    return quality.judged(spread(table(spark, sf_dir, "documents")))


QUERIES["op9_suffix_repetition"] = op9_suffix_repetition


def op10_folded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import toxicity

    docs = spread(table(spark, sf_dir, "documents"))
    lexicon = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, lexicon)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % toxicity.HELD_OUT == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op10_folded_lexicon"] = op10_folded_lexicon


def op7_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import warc

    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


QUERIES["op7_chunked_warc"] = op7_chunked_warc
SQL["op7_chunked_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


def op3_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import substrings

    return substrings.removal_digests(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))


QUERIES["op3_countmin_substrings"] = op3_countmin_substrings
SQL["op3_countmin_substrings"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d),
g AS (SELECT r, i, word, CASE WHEN i + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM w),
f AS (SELECT r, i, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.r = s.r
"""


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import neardup

    return neardup.near_duplicates(spread(table(spark, sf_dir, "documents")), k=3, percent=85)


QUERIES["op8_circulant_minhash"] = op8_circulant_minhash
SQL["op8_circulant_minhash"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM n UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
least AS (SELECT reach.x AS r, min(n.doc_id) AS component FROM reach JOIN n ON n.r = reach.y GROUP BY reach.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.component, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(least.component, d.doc_id), false) AS kept
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN least ON d.r = least.r
"""


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import langid

    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    network = langid.trained(docs.filter(~held_out))
    return langid.predicted(docs.select("doc_id", "text"), network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES["op2_byte_cnn"] = op2_byte_cnn


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 50, among all vectors."""
    from sparkstave.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 10)


QUERIES["op6_multi_index_hashing"] = op6_multi_index_hashing
SQL["op6_multi_index_hashing"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
             CAST(list_sum(list_transform(list_zip(q.b, e.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM e q JOIN e ON q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p)
SELECT query_id, neighbor_id, rank, distance FROM r WHERE rank <= 10
"""


def op13_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import whitening

    return whitening.whitened(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


QUERIES["op13_spectrum_slicing"] = op13_spectrum_slicing


def op11_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import conversations

    return conversations.repaired_conversations(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _edit(x: str, cost: str, letter: str, row: str = "''") -> str:
    """SQL of a state ``x`` after one more edit."""
    return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {row}}}"


def _inserted(x: str, role: str) -> str:
    return _edit(x, "2", "I", f"chr(10) || '{role}:'")


_ROW = "chr(10) || {} || ':' || o.text"
_GIVEN = {role: _ROW.format(f"'{role}'") for role in ("user", "assistant")}
_KEPT = _ROW.format("o.role")
QUERIES["op11_hirschberg_repair"] = op11_hirschberg_repair
SQL["op11_hirschberg_repair"] = rf"""
WITH RECURSIVE g AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
b AS (SELECT *, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || array_slice(h, 2 * i + 1, 2 * i + 2) AS BIGINT)) AS bytes FROM g),
c AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: {_crc_half(_crc_half("xor(c, x)"))}), 4294967295) % 20 AS hurt FROM b),
r AS (
  SELECT k, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role,
         CASE hurt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN hurt = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE hurt <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i FROM r),
o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS seen, left(role, 1) AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS before FROM n),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 1000000000, 'a': '', 't': ''}} AS s1, {{'c': 1000000000, 'a': '', 't': ''}} AS s2, {{'c': 1000000000, 'a': '', 't': ''}} AS s3
  FROM (SELECT DISTINCT k FROM c)
  UNION ALL
  SELECT k, i,
    {_edit("s0", "3", "D")},
    list_min([{_edit("s1", "3", "D")}] || CASE WHEN go AND initial = 's' THEN [{_edit("s0", "p", "K", "kept")}] ELSE [] END),
    list_min([{_edit("u2", "3", "D")}] || CASE WHEN go THEN [{", ".join(_edit(x, "2 + p", "R", "as_user") for x in ("s0", "s1", "a2"))}] ELSE [] END
             || CASE WHEN go AND initial = 'u' THEN [{", ".join(_edit(x, "p", "K", "kept") for x in ("s0", "s1", "a2"))}] ELSE [] END),
    list_min([{_edit("a2", "3", "D")}] || CASE WHEN go THEN [{_edit("u2", "2 + p", "R", "as_assistant")}] ELSE [] END || CASE WHEN go AND initial = 'a' THEN [{_edit("u2", "p", "K", "kept")}] ELSE [] END)
  FROM (
    SELECT *, list_min([u1, {_inserted("a1", "user")}]) AS u2, list_min([a1, {_inserted("u1", "assistant")}]) AS a2 FROM (
      SELECT o.k, o.i, s0, s1, o.initial, NOT o.blank AND o.seen = 1 AS go, CASE WHEN o.cut THEN 1 ELSE 0 END AS p, {_KEPT} AS kept, {_GIVEN["user"]} AS as_user, {_GIVEN["assistant"]} AS as_assistant,
        list_min([s2, {", ".join(_inserted(x, "user") for x in ("s0", "s1", "s3"))}]) AS u1, list_min([s3, {_inserted("s2", "assistant")}]) AS a1
      FROM walk JOIN o ON o.k = walk.k AND o.i = walk.i + 1) AS one) AS two),
e AS (
  SELECT k, list_min([s0, s3, {_inserted("s2", "assistant")}, {{'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}}]) AS x
  FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
t AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen > 1) AS duplicate,
         count(*) FILTER (NOT blank AND seen = 1 AND cut) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY k)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(e.x.c AS BIGINT) AS cost, e.x.a AS audit, sha256(substr(e.x.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM c) v JOIN e ON v.k = e.k LEFT JOIN t ON t.k = v.k
"""


def op12_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkstave.llm import urls

    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES["op12_path_templates"] = op12_path_templates
