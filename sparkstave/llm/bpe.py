"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text of at most CHUNK characters is encoded in one piece. A longer text is cut into
chunks that overlap, in one pass. All chunks are pre-tokenised in parallel; two neighbours are
stitched at the start of the first pre-token of their overlap that both have (from there on both cut
alike, since a pre-token depends only on the text from its start), whatever its script: next to characters that are too young for all engines to class them
alike, the encoder itself must cut there. The pieces between stitches are encoded
in parallel and folded in order into digests. A text with an overlap that never
resynchronises (one pre-token of over OVERLAP characters) is encoded whole.

Defined results: null or empty text gives no ids; rows with a null or repeated id are
rows like any other, and equal long texts are encoded once; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkstave.llm.textkit import pieces

CHUNK = 32_768
OVERLAP = 1_024
DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: A pre-token that ends this near to the end of a chunk may depend on what follows.
LOOK_AHEAD = 8
#: Pre-tokens on each side of a border that the encoder is asked about.
BESIDE = 3
#: Chunks that travel in one batch.
BATCH_CHUNKS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Ranks and pattern as they travel to executors; the encoder is made once per task."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))
        self.pattern = pattern


def digests(texts: pd.Series, enc, names: list[str]) -> pd.DataFrame:
    """Encode and decode each text, and digest ids and bytes."""
    rows = []
    for text in texts:
        ids = enc.encode_ordinary(text)
        said = " ".join([names[i] for i in ids]).encode()
        rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def _id_names(ranks: dict[bytes, int]) -> list[str]:
    return [str(i) for i in range(max(ranks.values(), default=0) + 1)]


def encode(texts: DataFrame, tokenizer: Tokenizer, text_col: str = "text") -> DataFrame:
    """``texts`` with an array column ``ids``: for tables whose texts are short enough for one cell."""
    ranks, pattern = tokenizer.ranks, tokenizer.pattern

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            yield pd.Series([enc.encode_ordinary(t) for t in batch])

    return texts.withColumn("ids", ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(tokens: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a binary column ``decoded``: the bytes of the ids, one after the other."""
    ranks = tokenizer.ranks

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            yield pd.Series([b"".join([token[i] for i in ids]) if ids is not None else b"" for ids in batch])

    return tokens.withColumn("decoded", joined(ids_col))


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(h, i, n, text): chunk i of n of each distinct long text, with the overlap behind it; each text is cut in one pass.

    The last chunk is longer than the overlap, so that it can be stitched.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, text in zip(batch.h, batch.text, strict=True):
                n = max(1, -(-(len(text) - overlap) // chunk))
                for begin in range(0, n, BATCH_CHUNKS):
                    at = range(begin, min(n, begin + BATCH_CHUNKS))
                    yield pd.DataFrame({"h": h, "i": list(at), "n": n, "text": [text[i * chunk : (i + 1) * chunk + overlap] for i in at]})

    return long.select("h", "text").mapInPandas(cut, "h string, i int, n int, text string")


def _settled(char: str) -> bool:
    """Whether a character has long had the class it has: engines of other Unicode versions read it alike."""
    return unicodedata.ucd_3_2_0.category(char)[0] == unicodedata.category(char)[0] != "C" or char.isspace()


def stitches(chunks: DataFrame, pattern: str, chunk: int, overlap: int, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(h, i, n, begin, end): each chunk's piece, counted from its own start; null where out of step.

    Borders next to characters that engines might class differently count only where the ``tokenizer`` itself cuts there too.
    """
    ranks = tokenizer.ranks if tokenizer else None

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        cut = regex.compile(pattern)
        enc = encoder(ranks.value, pattern) if ranks else None

        def cuts_too(text: str, spans: list[tuple[int, int]], k: int) -> bool:
            """Whether the encoder, too, has a border before pre-token ``k``: ids of its neighbours on both sides are the same with and without it."""
            low, at, high = spans[max(0, k - BESIDE)][0], spans[k][0], spans[min(len(spans), k + BESIDE) - 1][1]
            return enc is not None and enc.encode_ordinary(text[low:high]) == enc.encode_ordinary(text[low:at]) + enc.encode_ordinary(text[at:high])

        for batch in batches:
            rows = []
            for h, i, n, text in zip(batch.h, batch.i, batch.n, batch.text, strict=True):
                head, tail, last = [], [], len(text) - (LOOK_AHEAD if i < n - 1 else 0)
                spans = [m.span() for m in cut.finditer(text)]
                for k, (begin, end) in enumerate(spans):
                    if end > last or not begin or chunk > begin >= overlap:
                        continue
                    if not (_settled(text[begin - 1]) and _settled(text[begin]) or cuts_too(text, spans, k)):
                        continue
                    # Start and length in one number, by start.
                    if begin < overlap:
                        head.append(begin * (chunk + overlap) + end - begin)
                    if begin >= chunk:
                        tail.append((begin - chunk) * (chunk + overlap) + end - begin)
                rows.append((h, i, n, head, tail))
            yield pd.DataFrame(rows, columns=["h", "i", "n", "head", "tail"])

    found = chunks.mapInPandas(points, "h string, i int, n int, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("h").orderBy("i")
    agreed = F.floor(F.array_min(F.array_intersect("head", F.lag("tail").over(order))) / (chunk + overlap)).cast("int")
    found = found.withColumn("begin", F.when(F.col("i") == 0, F.lit(0)).otherwise(agreed))
    end = F.lead("begin").over(order) + F.lit(chunk)
    return found.select("h", "i", "n", "begin", F.when(F.col("i") == F.col("n") - 1, F.lit(chunk + overlap)).otherwise(end).alias("end"))


def long_digests(long: DataFrame, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(h, digests) of distinct long texts (h, text)."""
    ranks, pattern = tokenizer.ranks, tokenizer.pattern
    chunks = _chunks(long, chunk, overlap)
    spans = stitches(chunks, pattern, chunk, overlap, tokenizer)
    broken = spans.groupBy("h").agg(F.max((F.col("begin").isNull() | F.col("end").isNull()).cast("int")).alias("broken"))
    spans = chunks.select("h", "i", "text").join(spans, ["h", "i"]).join(broken, "h")
    # Out of step somewhere: the text goes on as its bare chunks and is encoded whole.
    bare = F.when(F.col("i") < F.col("n") - 1, F.substring("text", 1, chunk)).otherwise(F.col("text"))
    piece = F.when(F.col("broken") == 1, bare).otherwise(F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")))
    spans = spans.select("h", "i", "n", "broken", piece.alias("text"))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, names = encoder(ranks.value, pattern), _id_names(ranks.value)
        for batch in pieces(batches):
            rows = []
            for h, i, n, broken, text in zip(batch.h, batch.i, batch.n, batch.broken, batch.text, strict=True):
                if broken:
                    rows.append((h, i, n, -1, b"", text.encode()))
                else:
                    ids = enc.encode_ordinary(text)
                    rows.append((h, i, n, len(ids), " ".join([names[k] for k in ids]).encode(), enc.decode_bytes(ids)))
            yield pd.DataFrame(rows, columns=["h", "i", "n", "n_ids", "ids", "raw"])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of (h, i): one running state, whatever a text's length."""
        state = None
        for batch in batches:
            done = []
            for h, i, n, n_ids, ids, raw in zip(batch.h, batch.i, batch.n, batch.n_ids, batch.ids, batch.raw, strict=True):
                if i == 0:
                    state = [0, hashlib.sha256(), hashlib.sha256(), []]
                if n_ids < 0:
                    state[3].append(raw)
                else:
                    if ids:
                        state[1].update(b" " + ids if state[0] else ids)
                    state[0] += n_ids
                    state[2].update(raw)
                if i == n - 1:
                    if state[3]:
                        enc = encoder(ranks.value, pattern)
                        one = digests(pd.Series([b"".join(state[3]).decode()]), enc, _id_names(ranks.value)).iloc[0]
                        done.append((h, int(one.n_tokens), one.ids_sha256, one.decoded_sha256))
                    else:
                        done.append((h, state[0], state[1].hexdigest(), state[2].hexdigest()))
                    state = None
            yield pd.DataFrame(done, columns=["h", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = spans.mapInPandas(encoded, "h string, i int, n int, n_ids bigint, ids binary, raw binary")
    return done.repartition(F.col("h")).sortWithinPartitions("h", "i").mapInPandas(folded, f"h string, {DIGEST}")


def encoded_digests(docs: DataFrame, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, number of ids, SHA-256 of the ids as text and of the decoded bytes."""
    ranks, pattern = tokenizer.ranks, tokenizer.pattern
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Bytes bound characters from above and are cheap to count.
    short = rows.filter((F.octet_length("text") <= chunk) | (F.length("text") <= chunk))
    long = rows.filter((F.octet_length("text") > chunk) & (F.length("text") > chunk))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, names = encoder(ranks.value, pattern), _id_names(ranks.value)
        for batch in pieces(batches):
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), digests(batch.text, enc, names)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    direct = short.mapInPandas(whole, f"doc_id {kind}, {DIGEST}")
    long = long.withColumn("h", F.sha2("text", 256))
    distinct = long.groupBy("h").agg(F.first("text").alias("text"))
    parts = long_digests(distinct, tokenizer, chunk, overlap)
    return direct.unionByName(long.select("doc_id", "h").join(parts, "h").drop("h"))
