"""Substring dedup: words under a window that also starts elsewhere are removed.

First pass: a count-min sketch. A window is counted by its anchor, the least hash among its
GRAM-word grams: equal windows have equal anchors at different places, so an
anchor's count is never below its window's, and there are about a tenth as many
anchors as windows. Each task counts the cells of its anchors and sends each cell once; the sketch lies
in buckets, cell range by cell range, where the tasks' counts are summed and each task's
cells are answered. So the sketch has as many cells as the text asks for: nothing of it is broadcast or collected.
What comes back is, for each text that has any, the anchors that were counted twice or more in both rows.

Second pass: only windows with such an anchor are grouped exactly, by a
128-bit hash of their words. It runs over the distinct texts that have one, with
their number of copies. A task first groups its own windows: what repeats
inside it is settled there, and each distinct window is sent once, however many
copies a task holds. Buckets of the hash range settle the rest and answer each task's
chunk with the places that repeat.

Defined results: null and empty texts have no words and lose none; texts shorter than a window lose
nothing; equal rows repeat each other, so all their words go if they fill a window; ids
may be null or repeated, since texts are told apart by their own hash; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstave.llm.textkit import WORD, Words, mix, pieces, sliding, spans_union, windows
from sparkstave.session import drop_stored, stored

WINDOW = 35
GRAM = 16
CELLS_PER_ANCHOR = 4
LEAST_CELLS = 1 << 20
#: About so many bytes of text have one anchor.
ANCHOR_BYTES = 60
BUCKET_ANCHORS = 2_000_000
BUCKET_WORDS = 2_000_000
CHUNK_ANCHORS = 1_000_000
CHUNK_WINDOWS = 4_000_000
ROWS = 2
#: A side of a join of at most this many bytes is broadcast; a larger one is joined by order.
BROADCAST_BYTES = 8 << 20


def _pack(values: np.ndarray) -> bytes:
    """Sorted or small integers, compressed by planes of bytes."""
    import pyarrow as pa

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    import pyarrow as pa

    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _pack_places(doc: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """Places in order of (doc, at): steps are small, so they compress."""
    return _pack(np.diff(doc, prepend=0)), _pack(np.diff(at.astype(np.int64), prepend=0) & 0xFFFFFFFF)


def _unpack_places(docs: bytes, ats: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(docs).astype(np.int64)), (np.cumsum(_unpack(ats).astype(np.int64)) & 0xFFFFFFFF)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values (values are not negative)."""
    edges = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(edges, [*edges[1:], len(values)], strict=False))


def anchors(words: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each window's anchor hash, distinct anchor places, hashes of all grams)."""
    none = np.zeros(0, np.uint64)
    if len(h) < window:
        return np.zeros(0, np.int64), none, np.zeros(0, np.int64), none
    stop = words.first[1:][words.doc]
    grams = windows(h, gram)
    least = sliding(grams, window - gram + 1)
    at = np.arange(len(least))
    whole = at + window <= stop[at]
    held = np.where(whole, least, np.uint64(0))
    span = window - gram
    near = sliding(np.concatenate((np.zeros(span, np.uint64), held, np.zeros(span, np.uint64))), span + 1, np.maximum)
    return at[whole], least[whole], np.flatnonzero(near == grams), grams


def cells(anchor: np.ndarray, row: int, n_cells: int) -> np.ndarray:
    return mix(anchor + np.uint64(row + 1), row % 2) & np.uint64(n_cells - 1)


def sketch_size(n_bytes: int) -> int:
    """Cells per row: a power of two, CELLS_PER_ANCHOR for each anchor, whatever the size of the text."""
    need = max(LEAST_CELLS, n_bytes // ANCHOR_BYTES * CELLS_PER_ANCHOR)
    return 1 << (need - 1).bit_length()


ASKED = "bucket int, chunk bigint, keys binary, docs binary, ats binary, names array<string>"
ANSWERS = "chunk bigint, docs binary, ats binary, names array<string>"


class Chunk:
    """Keys of places in some texts of one task: cells of anchors, or hashes of candidate windows."""

    def __init__(self, number: int, n_buckets: int, first_bucket: int = 0):
        self.number, self.n_buckets, self.first_bucket = number, n_buckets, first_bucket
        self.keys, self.docs, self.ats, self.twice, self.names = [], [], [], [], []
        self.size = 0

    def add(self, keys: np.ndarray, doc: np.ndarray, at: np.ndarray, names: list[str], twice: np.ndarray | None = None) -> None:
        """``keys`` has a row per lane; ``twice`` marks places that other copies of their text have too."""
        used, place = np.unique(doc, return_inverse=True)
        self.keys.append(keys)
        self.docs.append(place.reshape(-1) + len(self.names))
        self.ats.append(at)
        self.twice.append(np.zeros(len(at), bool) if twice is None else twice)
        self.names += [names[i] for i in used]
        self.size += len(at)

    def rows(self, top_bits: int = 64) -> Iterator[pd.DataFrame]:
        """One row for each bucket that is asked, and one for what is settled here. Keys have ``top_bits`` bits."""
        if not self.size:
            return
        keys, doc, at, twice = np.concatenate(self.keys, axis=1), np.concatenate(self.docs), np.concatenate(self.ats), np.concatenate(self.twice)
        order, first, number = runs_of(keys)
        often = (np.diff(np.append(first, len(order))) > 1) | np.logical_or.reduceat(twice[order], first)
        sure = np.zeros(len(order), bool)
        sure[order[often[number]]] = True
        told = np.zeros(len(order), bool)
        told[order[first[often]]] = True
        shift = np.uint64(max(0, top_bits - 32))
        bucket = ((keys[0] >> shift) * np.uint64(self.n_buckets) >> np.uint64(min(32, top_bits))).astype(np.int64)
        send = order[(~sure | told)[order]]
        for begin, end in _runs(bucket[send]):
            some = send[begin:end]
            # Places that are settled here go last, without a place.
            some = np.concatenate((some[~told[some]], some[told[some]]))
            asks = int((~told[some]).sum())
            docs, ats = _pack_places(doc[some[:asks]], at[some[:asks]])
            yield self._row(self.first_bucket + int(bucket[some[0]]), _pack_keys(keys[:, some]), docs, ats, [])
        where = np.flatnonzero(sure)
        yield self._row(self.first_bucket + self.number % self.n_buckets, b"", *_pack_places(doc[where], at[where]), self.names)

    def _row(self, bucket, keys, docs, ats, names) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [bucket], "chunk": [self.number], "keys": [keys], "docs": [docs], "ats": [ats], "names": [names]})


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys of one lane are cells in rising order (twice over), whose steps are small; wider ones are hashes."""
    if len(keys) > 1:
        return keys.astype("<u8").tobytes()
    steps = np.diff(keys[0].view(np.int64), prepend=0)
    return _pack(np.concatenate((steps & 0xFFFFFFFF, steps >> 32)))


def _unpack_keys(raw: bytes, lanes: int) -> np.ndarray:
    if lanes > 1:
        return np.frombuffer(raw, "<u8").reshape(lanes, -1)
    low, high = _unpack(raw).reshape(2, -1)
    return np.cumsum(low.astype(np.int64) + (high.view(np.int32).astype(np.int64) << 32)).view(np.uint64).reshape(1, -1)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted order, first place of each distinct key in it, number of the key at each place)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def settle(group: pd.DataFrame, lanes: int) -> pd.DataFrame:
    """One bucket: answer each chunk with those of its places whose key is in the bucket twice or more."""
    asked = group[group["keys"].str.len() > 0]
    passed = group[group["keys"].str.len() == 0][["chunk", "docs", "ats", "names"]]
    if not len(asked):
        return passed
    keys = [_unpack_keys(k, lanes) for k in asked["keys"]]
    sizes = [k.shape[1] for k in keys]
    places = [_unpack_places(d, a) for d, a in zip(asked.docs, asked.ats, strict=True)]
    # Told keys repeat inside their chunk already: they count twice.
    weight = np.concatenate([np.where(np.arange(n) < len(p[0]), 1, 2) for n, p in zip(sizes, places, strict=True)])
    order, _, number = runs_of(np.concatenate(keys, axis=1))
    repeated = np.zeros(len(order), bool)
    repeated[order] = np.bincount(number, weight[order])[number] > 1
    out, begin = [], 0
    for chunk, n, (doc, at) in zip(asked.chunk, sizes, places, strict=True):
        yes = repeated[begin : begin + len(doc)]
        begin += n
        if yes.any():
            out.append((chunk, *_pack_places(doc[yes], at[yes]), []))
    return pd.concat([passed, pd.DataFrame(out, columns=["chunk", "docs", "ats", "names"])])


def _places(group: pd.DataFrame) -> np.ndarray:
    """All places of one chunk as doc * FAR + at, in order."""
    places = [_unpack_places(d, a) for d, a in zip(group.docs, group.ats, strict=True)]
    return np.sort(np.concatenate([d * FAR + a for d, a in places])) if places else np.zeros(0, np.int64)


FAR = np.int64(1 << 33)


def anchors_of_chunk(group: pd.DataFrame) -> pd.DataFrame:
    """The answers to one chunk of anchors: places of each text that both rows of the sketch count twice or more."""
    names = next(list(x) for x in group.names if len(x))
    row = group.chunk.to_numpy() % ROWS
    places = _places(group[row == 0])
    for k in range(1, ROWS):
        places = np.intersect1d(places, _places(group[row == k]), assume_unique=True)
    rows = [(names[places[i] // FAR], (places[i:j] % FAR).astype(np.int32)) for i, j in _runs(places // FAR)]
    return pd.DataFrame(rows, columns=["h", "ats"])


def spans_of_chunk(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """The answers to one chunk of windows: removed spans of each text, as word numbers [start, end, start, end, ...]."""
    names = next(list(x) for x in group.names if len(x))
    places = _places(group)
    begin, end = spans_union(places, places + window)
    of = begin // FAR
    rows = [(names[of[i]], np.column_stack((begin[i:j] % FAR, end[i:j] % FAR)).reshape(-1)) for i, j in _runs(of)]
    return pd.DataFrame(rows, columns=["h", "spans"])


def estimated_repeated(hashed: DataFrame, n_bytes: int, window: int, gram: int) -> DataFrame:
    """(h, ats): for each text with anchors that the sketch counts twice or more, their places."""
    n_cells = sketch_size(n_bytes)
    bits = n_cells.bit_length() - 1
    n_buckets = max(8, n_bytes // ANCHOR_BYTES // BUCKET_ANCHORS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        new = lambda: [Chunk(number * ROWS + row, n_buckets, row * n_buckets) for row in range(ROWS)]
        chunks = new()
        for batch in pieces(batches):
            words = Words(batch.text)
            _, _, at, grams = anchors(words, words.hashes()[0], window, gram)
            doc, names = words.doc[at], batch.h.tolist()
            for row, chunk in enumerate(chunks):
                chunk.add(cells(grams[at], row, n_cells).reshape(1, -1), doc, at - words.first[doc], names)
            if chunks[0].size >= CHUNK_ANCHORS:
                for chunk in chunks:
                    yield from chunk.rows(bits)
                number += 1
                chunks = new()
        for chunk in chunks:
            yield from chunk.rows(bits)

    answers = hashed.mapInPandas(count, ASKED).groupBy("bucket").applyInPandas(lambda g: settle(g, 1), ANSWERS)
    found = answers.groupBy(F.floor(F.col("chunk") / ROWS)).applyInPandas(anchors_of_chunk, "h string, ats array<int>")
    # Equal texts in several chunks have equal anchors.
    return stored(found.groupBy("h").agg(F.first("ats").alias("ats")), "anchors")


def small_side(side: DataFrame, size) -> DataFrame:
    """``side`` of a join, marked for broadcast if all its rows' ``size`` in bytes is small."""
    n_bytes = side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(side) if n_bytes <= BROADCAST_BYTES else side.hint("merge")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (h, text, ...) that may hold a repeated window, and (h, spans) of those that do: the words to remove.

    A text is named by its SHA-256.
    """
    gram = min(GRAM, (window + 1) // 2)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, n_bytes // 6 // BUCKET_WORDS)
    hashed = docs.select(F.sha2("text", 256).alias("h"), "text").filter("text is not null")
    flagged = estimated_repeated(hashed, n_bytes, window, gram)
    copies = F.count("*").alias("copies")
    # Copies are summed up in the tasks that read them, before a join by order could bring them all to one.
    if (flagged.agg(F.sum(F.size("ats") * 4 + 80)).first()[0] or 0) <= BROADCAST_BYTES:
        texts = hashed.join(F.broadcast(flagged), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("ats").alias("ats"), copies)
    else:
        texts = hashed.groupBy("h").agg(F.first("text").alias("text"), copies).join(flagged.hint("merge"), "h").select("h", "text", "ats", "copies")
    texts = stored(texts, "texts")
    drop_stored(flagged)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = Chunk(TaskContext.get().partitionId() << 24, n_buckets)
        for batch in pieces(batches):
            words = Words(batch.text)
            h = words.hashes(2)
            start, anchor, _, grams = anchors(words, h[0], window, gram)
            first = np.repeat(words.first[:-1], batch.ats.str.len())
            start = start[np.isin(anchor, grams[first + np.concatenate(batch.ats.to_list())])] if len(start) else start
            if len(start):
                keys = np.stack([windows(h[k], window, k)[start] for k in range(2)])
                doc = words.doc[start]
                chunk.add(keys, doc, start - words.first[doc], batch.h.tolist(), (batch.copies.to_numpy() > 1)[doc])
            if chunk.size >= CHUNK_WINDOWS:
                yield from chunk.rows()
                chunk = Chunk(chunk.number + 1, n_buckets)
        yield from chunk.rows()

    answers = texts.mapInPandas(candidates, ASKED).groupBy("bucket").applyInPandas(lambda g: settle(g, 2), ANSWERS)
    spans = answers.groupBy("chunk").applyInPandas(lambda g: spans_of_chunk(g, window), "h string, spans array<bigint>")
    # Written, so that a join with it can split a text that many rows hold.
    return texts, stored(spans, "spans")


def _kept(n: int, spans) -> np.ndarray:
    keep = np.ones(n, bool)
    for begin, end in np.asarray(spans, np.int64).reshape(-1, 2):
        keep[begin:end] = False
    return keep


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row doc_id, words, words removed, and SHA-256 of the words kept, joined by single spaces.

    Texts are digested where they are read, and those that lose words once more, each distinct one once; digests are joined.
    """
    texts, spans = repeated_spans(docs, window)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            out = []
            for text, own in zip(batch.text, batch.spans, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if own is not None:
                    words = [w for w, keep in zip(words, _kept(n, own).tolist(), strict=True) if keep]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            done = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
            yield pd.concat([batch[[c for c in batch if c not in ("text", "spans")]], done], axis=1)

    kind, counts = docs.schema["doc_id"].dataType.simpleString(), "n_words bigint, n_removed bigint, kept_sha256 string"
    rows = docs.select("doc_id", F.sha2("text", 256).alias("h"), "text", F.lit(None).cast("array<bigint>").alias("spans"))
    plain = rows.mapInPandas(digest, f"doc_id {kind}, h string, {counts}")
    changed = stored(texts.select("h", "text").join(spans, "h").mapInPandas(digest, f"h string, {counts}"), "changed")
    drop_stored(texts)
    changed = changed.select("h", F.col("n_removed").alias("gone"), F.col("kept_sha256").alias("left"))
    out = plain.join(small_side(changed, F.lit(160)), "h", "left")
    return out.select("doc_id", "n_words", F.coalesce("gone", "n_removed").alias("n_removed"), F.coalesce("left", "kept_sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; what stays between them is unchanged.

    Without ``keep_emptied``, rows that had words and lose them all go.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        word = re.compile(WORD)
        out = []
        for text, some in zip(texts, spans, strict=True):
            if some is not None:
                at = [m.start() for m in word.finditer(text)] + [len(text)]
                spans_at = np.asarray(some, np.int64).reshape(-1, 2)
                gone = int((spans_at[:, 1] - spans_at[:, 0]).sum()) == len(at) - 1
                kept, done = [], 0
                for begin, end in spans_at:
                    kept.append(text[done : at[begin]])
                    done = at[end]
                text = None if gone and not keep_emptied else "".join([*kept, text[done:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    # The columns travel as one, so that none of theirs can clash.
    keyed = docs.select(F.struct("*").alias("row"), F.sha2("text", 256).alias("h"))
    texts, spans = repeated_spans(docs.select("text"), window)
    drop_stored(texts)
    joined = keyed.join(small_side(spans, F.size("spans") * 8 + 80), "h", "left")
    out = joined.select("row", F.col("spans").isNotNull().alias("changed"), cut("row.text", "spans").alias("left"))
    out = out.filter(~F.col("changed") | F.col("left").isNotNull())
    return out.select(F.col("row").withField("text", F.col("left")).alias("row")).select("row.*")
