"""WARC archives by way of a table of record chunks.

Writing: each page gives one or more chunk rows (record id, chunk number, at most CHUNK bytes of payload, digest
of the payload up to and with the chunk), cut in one pass; one chunk row is one WARC record, and what goes beyond the
first chunk follows as ``continuation`` records (WARC/1.1 record segmentation). No task builds a whole oversized record.
A record is a gzip member of its own, so readers can seek to it. Spark's text writer stores the members, so any
file system that Spark writes to will do.

Reading: archives are split at CRLF by Spark's text reader and parsed as a stream by Content-Length; each
record gives a chunk row that carries the payload digest up to and with that chunk, so the last
one of a page has the whole digest, whatever the payload's size.

Pages with equal payloads of at least LEAST bytes are stored once: the least page_id is the
response, others revisit it.

Defined results: null html is an empty payload; a null page_id sorts after all others (a page without an id
revisits one with an id; among pages without ids each is a response); repeated rows
of the least id are responses all; every record has an id of its own, repeated rows too; null urls are written as
``urn:x-page:`` addresses; an empty table gives an archive without records. Only the named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstave.llm.textkit import pieces
from sparkstave.session import stored

CHUNK = 65_536
LEAST = 100
CRLF = "\r\n"
DATE = "2000-01-01T00:00:00Z"
#: Shared payloads up to this number (32 bytes of digest and two numbers each) are broadcast; more are joined by a shuffle.
BROADCAST_SHARED = 200_000
CHUNKS = (
    "page_id bigint, record_id string, chunk_no int, chunk_bytes bigint, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, last boolean, intact boolean"
)


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, number, and refers_to with its number (null for responses).

    ``number`` tells rows apart that share an id. It is made where a row is scanned, so both uses of the scan agree on it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("number"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Summed up before the shuffle, so a payload that many pages share is one row per task.
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number"))
    shared = rows.filter(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n"))
    shared = stored(shared.filter("n > 1 and first is not null").select("digest", "first"), "shared")
    few = shared.count() <= BROADCAST_SHARED
    # Payloads stay where they were read if the shared digests are few.
    joined = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    first = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    return joined.withColumn("refers_to", first["page_id"]).withColumn("refers_number", first["number"]).withColumn("digest", F.lower(F.hex("digest"))).drop("first")


def _urn(page_id, number, k: int = 1) -> str:
    return f"<urn:x-page:{'none' if pd.isna(page_id) else int(page_id)}:{int(number)}{f':{k}' if k > 1 else ''}>"


def cut(payload: bytes, chunk: int) -> Iterator[tuple[int, bytes, str, bool]]:
    """(number, bytes, digest so far, whether it is the last) of each chunk, in one pass."""
    sha, n, body = hashlib.sha256(), max(1, -(-len(payload) // chunk)), memoryview(payload)
    for k in range(1, n + 1):
        part = body[(k - 1) * chunk : k * chunk]
        sha.update(part)
        yield k, bytes(part), sha.hexdigest(), k == n


def record(page, k: int, part: bytes, said: str, last: bool) -> bytes:
    """One WARC record of a chunk, with its closing CRLFs."""
    own, revisit = _urn(page.page_id, page.number), not pd.isna(page.refers_to)
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {int(page.payload_bytes)}", "", ""]
    http = CRLF.join(http).encode()
    block = http + part if k == 1 else part
    # An address must not end its header line.
    address = _urn(page.page_id, page.number)[1:-1] if page.url is None else "".join("%20" if c <= " " or c == "\x7f" else c for c in page.url)
    lines = [
        "WARC/1.1", f"WARC-Type: {'continuation' if k > 1 else 'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page.page_id, page.number, k)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}",
    ]
    if k == 1:
        lines.append(f"WARC-Payload-Digest: sha256:{page.digest}")
    if k == 1 and revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(page.refers_to, page.refers_number)}"]
    if k > 1 or not last:
        lines.append(f"WARC-Segment-Number: {k}")
    if k > 1:
        lines.append(f"WARC-Segment-Origin-ID: {own}")
    if k > 1 and last:
        if said != page.digest:
            raise ValueError(f"the chunks of {own} don't add up to its payload")
        lines.append(f"WARC-Segment-Total-Length: {int(page.payload_bytes) + len(http)}")
    lines += [f"Content-Type: {'application/http; msgtype=response' if k == 1 else 'application/octet-stream'}", f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(lines).encode("utf-8", "surrogatepass") + block + (CRLF * 2).encode()


#: A gzip member without content: it stands between two records, where a text file has its line end.
NOTHING = gzip.compress(b"", mtime=0)


def members(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The gzip members of all records; a page's records stand together and in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "payload"):
            out, size = [], 0
            for page in batch.itertuples(index=False):
                payload = b"" if not pd.isna(page.refers_to) else page.payload.encode("utf-8", "surrogatepass")
                for piece in cut(payload, chunk):
                    out.append(gzip.compress(record(page, *piece), 6, mtime=0))
                    size += len(out[-1])
                    if size > 4 << 20:
                        yield pd.DataFrame({"value": out})
                        out, size = [], 0
            yield pd.DataFrame({"value": out}, dtype=object)

    return rows.mapInPandas(run, "value binary")


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write one ``.warc.gz`` file per task, a gzip member per record; files don't split, so a page's records are read in order."""
    lines = members(verdicts(pages), chunk).select(F.col("value").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", 0).text(path)
    # Spark names text files .txt; readers tell archives and their compression by the name.
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt")) or []:
        old = file.getPath()
        files.rename(old, spark._jvm.org.apache.hadoop.fs.Path(folder, old.getName().removesuffix(".txt") + ".warc.gz"))


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix("urn:x-page:").split(":")[0]
    return int(name) if name.lstrip("-").isdigit() else None


class RecordStream:
    """Parses archive bytes, given line by line without their CRLF, and digests payloads on the way."""

    def __init__(self):
        self.headers, self.lines, self.left, self.http = None, [], 0, False
        self.page, self.record, self.done, self.sha, self.said = None, None, 0, None, {}

    def feed(self, line: bytes) -> dict | None:
        """The chunk row of the record that this line ends, if it ends one."""
        if self.headers is None:
            if line:
                self.lines.append(line)
                return None
            if not self.lines:
                return None  # the blank lines between records
            if self.lines[0] != b"WARC/1.1":
                raise ValueError(f"not a WARC record: {self.lines[0][:40]!r}")
            pairs = (x.decode().partition(": ") for x in self.lines[1:])
            self.headers, self.lines = {name: value for name, _, value in pairs}, []
            self.left = int(self.headers["Content-Length"])
            self.begin()
            return self.end() if self.left == 0 else None
        data = line + b"\r\n"
        took = data[: self.left]
        self.left -= len(took)
        if self.http:
            if line:
                if line.startswith(b"Content-Length: "):
                    self.said["bytes"] = int(line[16:])
            else:
                self.http = False
        else:
            self.sha.update(took)
            self.done += len(took)
            self.chunk += len(took)
        return self.end() if self.left == 0 else None

    def begin(self) -> None:
        kind = self.headers["WARC-Type"]
        self.http, self.chunk = kind != "continuation", 0
        if kind == "continuation":
            if self.headers["WARC-Segment-Origin-ID"] != self.record:
                raise ValueError("a continuation stands apart from its record")
            return
        self.record, self.done, self.sha = self.headers["WARC-Record-ID"], 0, hashlib.sha256()
        self.said = {
            "kind": kind, "digest": self.headers["WARC-Payload-Digest"].removeprefix("sha256:"), "bytes": 0,
            "refers": _page_of(self.headers.get("WARC-Refers-To")), "page": _page_of(self.record),
        }

    def end(self) -> dict:
        said, number = self.said, int(self.headers.get("WARC-Segment-Number", "1"))
        last = "WARC-Segment-Total-Length" in self.headers or "WARC-Segment-Number" not in self.headers
        revisit = said["kind"] == "revisit"
        digest = said["digest"] if revisit else self.sha.hexdigest()
        self.headers = None
        return {
            "page_id": said["page"], "record_id": self.record, "chunk_no": number, "chunk_bytes": self.chunk,
            "payload_bytes": said["bytes"] if revisit else self.done, "payload_digest": digest, "record_type": said["kind"],
            "refers_to": said["refers"], "last": last, "intact": revisit or not last or (digest == said["digest"] and self.done == said["bytes"]),
        }


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below ``path``: one row per WARC record."""
    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("value").cast("binary").alias("line"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = RecordStream()
        for batch in batches:
            rows = [row for line in batch.line if (row := stream.feed(line)) is not None]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if stream.headers is not None or stream.lines:
            raise ValueError("an archive ends inside a record")

    return lines.mapInPandas(parse, CHUNKS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page in the archives, from its last chunk; damaged payloads raise an error."""
    last = read_chunks(spark, path).filter("last")
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload: "), F.col("record_id"))))
    return last.select("page_id", "payload_bytes", sound.cast("string").alias("payload_digest"), "record_type", "refers_to")
