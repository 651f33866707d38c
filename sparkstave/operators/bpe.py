"""Symbol dictionary, byte-pair learning over segment counts, and segment-wise encoding of the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sparkstave.operators.batches import global_rank
from sparkstave.session import drop_stored, stored

SPECIALS = ("<pad>", "<s>", "</s>")
PAD, BOS, EOS = 0, 1, 2
#: Characters of a dictionary: from the first to the last one, without surrogates.
FIRST_CHARACTER, CHARACTERS = 33, 1_112_031
#: Tokens of the common pieces that the driver takes merges from (16 MB of ids), pairs that a round may look at unless more share the greatest count, tokens that a
#: task takes at a time, characters that a task encodes at a time with draws and without them, distinct segments that it merges at a time, and characters that it counts.
COMMON, MOST_LIVE, CHUNK, PIECE, LISTED, FEW, COUNTED = 4_000_000, 200_000, 1_000_000, 150_000, 8_000_000, 20_000, 4_000_000
#: Symbols of lists that are looked up together.
BLOCK = 1_000_000
#: Segments as tasks pass them on: ids of four bytes each, and how often the segment stands in the corpus.
PACKED = "ids binary, n bigint"


def dictionary(symbols: DataFrame) -> DataFrame:
    """(symbol, character): distinct symbols in order, from character 33 on without surrogates.

    A dictionary has as many rows as symbols, so ranks are made by ranges of the first two letters. Where there are more symbols than
    characters, the last characters only lead: the symbols that have no character of their own get two, a leading one and another.
    """
    listed = stored(symbols.select("symbol").distinct(), "symbols")
    n, leading = listed.count(), 0
    if n > CHARACTERS:
        leading = next((k for k in range(1, CHARACTERS // 2) if (1 + k) * (CHARACTERS - k) >= n), None)
        if leading is None:
            raise ValueError("more symbols than pairs of characters")
    single = CHARACTERS - leading
    ranked = global_rank(listed, F.col("symbol"), buckets=F.substring("symbol", 1, 2))

    def character(k: Column) -> Column:
        code = k + FIRST_CHARACTER
        code = F.when(code < 0xD800, code).otherwise(code + 0x800)
        return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")  # behind a byte order mark

    rank, beyond = F.col("rank"), F.col("rank") - single
    two = F.concat(character(F.floor(beyond / F.lit(single)) + single), character(beyond % single))
    return stored(ranked.select("symbol", F.when(rank < single, character(rank)).otherwise(two).alias("character")), "dictionary")


def blocks(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(block, keys, sizes, symbols, places): lists of about ``BLOCK`` symbols together, each distinct symbol once and the places as numbers of these, -1 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy()
            upto, at = np.cumsum(lengths), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
                few = batch.slice(at, end - at)
                coded = few.column(column).flatten().dictionary_encode()
                places = pc.fill_null(coded.indices, -1).to_numpy()
                places = places.astype(np.int16) if len(coded.dictionary) < 1 << 15 else places
                listed = [pa.ListArray.from_arrays([0, len(x)], x) for x in (few.column(key), pa.array(lengths[at:end], pa.int32()), coded.dictionary)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *listed, pa.array([places.tobytes()], pa.binary())], ["block", "keys", "sizes", "symbols", "places"])
                block, at = block + 1, end

    rows = rows.select(key, column)
    kinds = {"block": LongType(), "keys": ArrayType(rows.schema[key].dataType), "sizes": ArrayType(IntegerType()), "symbols": ArrayType(StringType()), "places": BinaryType()}
    return stored(rows.mapInArrow(run, StructType([StructField(k, kind) for k, kind in kinds.items()])), "blocks")


def looked_up(held: DataFrame, vocabulary: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """(key, x) from ``blocks``: each entry of a list by its row in the vocabulary, null where it has none; rows of equal keys become one, by places.

    Entries are joined with the vocabulary once for each block, so words aren't shuffled but numbers of them, and the vocabulary may grow.
    """
    found = held.select(F.col("block").alias("of"), F.posexplode("symbols").alias("pos", source)).join(vocabulary, source).select("of", "pos", target)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        (row,) = block.to_batches()
        keys, sizes = (row.column(c)[0].values for c in ("keys", "sizes"))
        n = row.column("n")[0].as_py()
        at = np.full(n + 1, -1, np.int32)
        at[found.column("pos").to_numpy()] = np.arange(found.num_rows)
        at = at[np.frombuffer(row.column("places")[0].as_buffer(), np.int16 if n < 1 << 15 else np.int32)]
        taken = pa.concat_arrays([pa.array([], pa.string()), *found.column(target).chunks]).take(pa.array(at, mask=at < 0))
        offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int32)
        return pa.Table.from_arrays([keys, pa.ListArray.from_arrays(offsets, taken)], [key, "x"])

    numbered = held.select("block", "keys", "sizes", F.size("symbols").alias("n"), "places")
    kinds = StructType([StructField(key, held.schema["keys"].dataType.elementType), StructField("x", ArrayType(StringType()))])
    out = numbered.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, kinds)
    if held.select(F.explode("keys").alias(key)).groupBy(key).count().filter("count > 1").isEmpty():
        return out
    placed = F.transform("x", lambda v, i: F.struct(i.alias("pos"), v.alias("v")))
    together = out.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("x"))
    return together.select(key, F.transform("x", lambda p: p["v"]).alias("x"))


def encode_symbols(rows: DataFrame, vocabulary: DataFrame, key: str, column: str) -> DataFrame:
    """Symbols as one string of characters, unknown ones dropped; keyed by a join, so the dictionary may grow."""
    return encode_blocks(blocks(rows, key, column), vocabulary, key)


def encode_blocks(held: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """``encode_symbols`` of rows that are in ``blocks`` already."""
    out = looked_up(held, vocabulary, key, "symbol", "character")
    return out.select(key, F.size(F.array_compact("x")).cast("bigint").alias("n_known"), F.array_join("x", "").alias("encoded"))


def decode_symbols(rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Characters back to symbols, unknown ones dropped; a character that leads in the dictionary goes with the one behind it. A row without any known one goes."""
    leading = vocabulary.filter(F.length("character") > 1).agg(F.min(F.substring("character", 1, 1))).first()[0]
    units = F.split("encoded", "") if leading is None else F.regexp_extract_all("encoded", F.lit(rf"(?s)[{leading}-\x{{10FFFF}}]?."), F.lit(0))
    cut = rows.select(key, F.filter(units, lambda c: c != "").alias("units"))
    out = looked_up(blocks(cut, key, "units"), vocabulary, key, "character", "symbol")
    return out.select(key, F.array_compact("x").alias("symbols")).filter("size(symbols) > 0")


def segments(text: DataFrame, mark: str = "!") -> DataFrame:
    """(doc_id, pos, segment): pieces of a text that start at the mark."""
    parts = F.split("text", f"(?={mark})")
    return text.select("doc_id", F.posexplode(parts).alias("pos", "segment")).filter("segment <> ''")


def segment_counts(text: DataFrame, mark: str = "!") -> DataFrame:
    """(segment, n): how often each of the ``segments`` stands in the texts. Tasks count about ``COUNTED`` characters at a time before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").drop_null()
            sizes = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(column):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + COUNTED, side="right")))
                parts = pc.split_pattern(column.slice(at, upto - at), mark)
                at = upto
                cuts, opening = parts.flatten(), np.zeros(len(parts.flatten()), bool)
                opening[np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())[:-1]])] = True
                first = cuts.filter(pa.array(opening))
                rest = pc.value_counts(cuts.filter(pa.array(~opening)))
                first = pc.value_counts(first.filter(pc.not_equal(first, "")))
                marked = pc.binary_join_element_wise(mark, rest.field("values"), "")
                for segment, n in ((first.field("values"), first.field("counts")), (marked, rest.field("counts"))):
                    yield pa.RecordBatch.from_arrays([segment, n], ["segment", "n"])

    return text.select("text").mapInArrow(run, "segment string, n bigint").groupBy("segment").agg(F.sum("n").alias("n"))


def learned_merges(text: DataFrame, n_merges: int | None = None, vocabulary: int | None = None) -> DataFrame:
    """The vocabulary (id, token, left, right): specials, characters by code point, then merges in order.

    Ends after ``n_merges``, at ``vocabulary`` rows, or where no pair is left. Segments are counted once, as distinct ones.
    A merge is the most frequent pair, then the one of least ids. A place where two tokens meet counts for one pair at a time, and merges
    around it only make that pair rarer; so as long as merges have a count of ``floor`` or more, no merge goes across a place whose pair has less.
    A round therefore cuts all segments at such places and counts equal pieces (``fragments``): these are few, as what is rare has gone, and the
    driver takes merges from them by exact counts down to the floor. The floor rises until the pieces have at most ``COMMON`` tokens. Tasks then apply the
    round's merges to all segments. The result doesn't depend on floors.
    """
    spark = text.sparkSession
    counted = stored(segment_counts(text), "segments")
    letters = counted.select("segment").mapInPandas(distinct_letters, "token string").distinct()
    alphabet = sorted(r["token"] for r in letters.collect())  # one row per character of the script
    rows = [(i, s, None, None) for i, s in enumerate(SPECIALS)] + [(i, c, None, None) for i, c in enumerate(alphabet, len(SPECIALS))]
    schema = "id int, token string, left int, right int"
    names = {i: c for i, c in enumerate(alphabet, len(SPECIALS))}
    points = np.array([ord(c) for c in alphabet], np.uint32)  # in order, as their ids are
    goal = min(float("inf") if n_merges is None else len(rows) + n_merges, float("inf") if vocabulary is None else vocabulary)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = batch.column("segment")
            at = np.frombuffer("".join(segment.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            ids = (np.searchsorted(points, at) + len(SPECIALS)).astype(np.int32)
            yield packed(ids, pc.utf8_length(segment).to_numpy(zero_copy_only=False), batch.column("n"))

    letters_of_all = counted.agg(F.sum(F.length("segment"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, letters_of_all // CHUNK)
    state = stored(counted.repartition(parts).mapInArrow(numbered, PACKED), "bpe")
    drop_stored(counted)
    wanted = None
    while len(rows) < goal:
        totals = pair_totals(state)
        top = totals.orderBy(F.desc("n"), "pair").limit(MOST_LIVE + 1).toArrow()
        if not top.num_rows:
            break
        codes, n = top.column("pair").to_numpy(), top.column("n").to_numpy()
        most = int(n[0])
        least = int(n[-1]) + 1 if len(n) > MOST_LIVE else 1
        if least > most:  # more pairs than that have the greatest count
            top = totals.filter(F.col("n") == most).toArrow()
            codes, n = top.column("pair").to_numpy(), top.column("n").to_numpy()
            least = most
        floor = min(most, max(least, most // 2048 if wanted is None else wanted))
        held, size = fragments(state, np.sort(codes[n >= floor]))
        while size > COMMON and floor < most:
            floor = min(most, int(floor * min(8.0, max(2.0, size / COMMON))) + 1)
            wide = held
            held, size = fragments(wide, np.sort(codes[n >= floor]))
            drop_stored(wide)
        if size > COMMON:
            left, right = divmod(int(codes[n == most].min()), 1 << 32)
            taken = [(left, right, len(rows))]
        else:
            taken = foremost(Chunk(*joined(held.toArrow().to_batches())), floor, len(rows), goal)
        drop_stored(held)
        wanted = floor // 8
        for left, right, new in taken:
            names[new] = names[left] + names[right]
            rows.append((new, names[new], left, right))
        if len(rows) < goal:
            old, state = state, stored(state.mapInArrow(lambda b, m=tuple(taken): folded(b, m), PACKED), "bpe")
            drop_stored(old)
    drop_stored(state)
    return spark.createDataFrame(rows, schema)


def foremost(chunk: Chunk, floor: int, first: int, goal: float) -> list[tuple[int, int, int]]:
    """Merges in order: always the most frequent pair, then the one of least ids, as long as it stands ``floor`` times or more and ids are below ``goal``."""
    counts = dict(zip(*(x.tolist() for x in chunk.counts()), strict=True))
    heap = [(-n, pair) for pair, n in counts.items() if n >= floor]
    heapify(heap)
    out: list[tuple[int, int, int]] = []
    while heap and first + len(out) < goal:
        n, pair = heappop(heap)
        if counts.get(pair) != -n:
            continue  # an older count of the pair
        out.append((pair >> 32, pair & 0xFFFFFFFF, first + len(out)))
        for changed, by in zip(*(x.tolist() for x in chunk.merge(*out[-1])), strict=True):
            counts[changed] = now = counts.get(changed, 0) + by
            if now >= floor:
                heappush(heap, (-now, changed))
            elif now == 0:
                del counts[changed]
    return out


def fragments(state: DataFrame, live: np.ndarray) -> tuple[DataFrame, int]:
    """Segments cut where a pair isn't one of ``live`` (sorted), equal pieces of two tokens or more once with their count; and the tokens of all pieces."""
    sent = state.sparkSession.sparkContext.broadcast(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = sent.value
        for t, w in flat_chunks(batches):
            codes = t[:-1].astype(np.int64) << 32 | t[1:]
            together = np.r_[False, live[np.minimum(np.searchsorted(live, codes), len(live) - 1)] == codes, False]
            before, behind = together[:-1], together[1:]
            starts, ends = np.flatnonzero(behind & ~before), np.flatnonzero(before & ~behind) + 1
            pieces = pa.Table.from_batches([packed(t[before | behind], ends - starts, pa.array(w[starts], pa.int64()))])
            sums = pieces.group_by("ids", use_threads=False).aggregate([("n", "sum")])
            yield from sums.select(["ids", "n_sum"]).rename_columns(["ids", "n"]).to_batches()

    out = stored(state.mapInArrow(run, PACKED).groupBy("ids").agg(F.sum("n").alias("n")), "pieces")
    return out, (out.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 4


def distinct_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"token": sorted(set().union(*batch["segment"]))}, dtype=object)


def packed(ids: np.ndarray, sizes: np.ndarray, n: pa.Array) -> pa.RecordBatch:
    """Rows of ``PACKED``: the ids of each segment as bytes, four for one, and its count."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, np.int32))]), n], ["ids", "n"])


def joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Segments one after the other, -1 before, between and behind them, and the count of its segment at each place."""
    sizes = np.concatenate([pc.binary_length(b.column("ids")).to_numpy() for b in held]).astype(np.int64) // 4
    n = np.concatenate([b.column("n").to_numpy() for b in held])
    values = np.concatenate([ids_of(b.column("ids")) for b in held])
    t = np.full(len(values) + len(sizes) + 1, -1, np.int32)
    t[1 + np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return t, np.concatenate([[0], np.repeat(n, sizes + 1)])


def ids_of(column: pa.Array) -> np.ndarray:
    """All ids of a column of packed ones."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.int32)[offsets[0] // 4 : offsets[-1] // 4] if offsets[-1] > offsets[0] else np.empty(0, np.int32)


def flat_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches put together until they hold CHUNK tokens."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("ids").nbytes // 4
        if size >= CHUNK:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def tallied(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once with its sum."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, int)
    return codes[starts], np.add.reduceat(n, starts) if len(codes) else n


class Chunk:
    """Segments of one task with postings: the places of every pair, so that a merge looks only at places that hold it.

    Tokens are linked, so nothing moves when two become one. A pair's places are known when the later of its two tokens comes up, as
    no merge of others makes it anew; places that a merge has changed since are passed over when they are looked up.
    """

    def __init__(self, t: np.ndarray, w: np.ndarray):
        self.t, self.w = t.copy(), w
        self.next, self.prev = np.arange(1, len(t) + 1), np.arange(-1, len(t) - 1)
        places = np.flatnonzero((t[:-1] >= 0) & (t[1:] >= 0))
        codes = self._codes(places)
        order = np.argsort(codes, kind="stable")
        self.codes, self.places = codes[order], places[order]
        self.made: dict[int, np.ndarray] = {}

    def _codes(self, at: np.ndarray) -> np.ndarray:
        return self.t[at].astype(np.int64) << 32 | self.t[self.next[at]]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and how often they stand in the corpus, before any merge."""
        return tallied(self.codes, self.w[self.places])

    def found(self, left: int, right: int) -> np.ndarray:
        """Places of a pair, of a run of equal tokens every other."""
        code = left << 32 | right
        at = self.made.get(code)
        if at is None:
            at = self.places[slice(*np.searchsorted(self.codes, (code, code + 1)))]
        at = at[self.t[at] == left]
        at = at[self.t[self.next[at]] == right]
        if left == right and len(at):
            i = np.arange(len(at))
            at = at[(i - np.maximum.accumulate(np.where(np.r_[True, self.next[at[:-1]] != at[1:]], i, 0))) % 2 == 0]
        return at

    def _pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.unique(at)
        at = at[self.t[at] >= 0]
        at = at[self.t[self.next[at]] >= 0]
        return at, self._codes(at)

    def merge(self, left: int, right: int, new: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Every pair from left to right becomes one token; how the counts of pairs change, None if nothing does."""
        at = self.found(left, right)
        if not len(at):
            return None
        second = self.next[at]
        old, old_codes = self._pairs(np.concatenate([self.prev[at], at, second]))
        behind = self.next[second]
        self.t[at], self.t[second] = new, -2
        self.next[at], self.prev[behind] = behind, at
        young, codes = self._pairs(np.concatenate([self.prev[at], at]))
        if len(codes):
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            self.made.update(zip(codes[order][starts].tolist(), np.split(young[order], starts[1:]), strict=True))
        codes, n = tallied(np.concatenate([old_codes, codes]), np.concatenate([-self.w[old], self.w[young]]))
        return codes[n != 0], n[n != 0]

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and counts without the places that merges have emptied."""
        left = self.t > -2
        return self.t[left], self.w[left]


def pair_totals(state: DataFrame) -> DataFrame:
    """(pair, n): how often each pair stands in the corpus; the left id in the upper half of the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, w in flat_chunks(batches):
            codes, n = Chunk(t, w).counts()
            yield pa.RecordBatch.from_pydict({"pair": codes, "n": n.astype(np.int64)})

    return state.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def folded(batches: Iterator[pa.RecordBatch], merges: tuple) -> Iterator[pa.RecordBatch]:
    """The state after the merges, without segments that have become one token."""
    for t, w in flat_chunks(batches):
        chunk = Chunk(t, w)
        for m in merges:
            chunk.merge(*m)
        t, w = chunk.compact()
        ends = np.flatnonzero(t < 0)
        sizes, n = np.diff(ends) - 1, w[ends[1:]]
        inside, long = t >= 0, sizes > 1
        yield packed(t[inside][np.repeat(long, sizes)], sizes[long], pa.array(n[long], pa.int64()))


def merge(ids: list[int], left: int, right: int, new: int) -> list[int]:
    """Every pair from left to right replaced."""
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and ids[i] == left and ids[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


class Draws:
    """The draws of ``np.random.default_rng(key).random()`` for many keys at once: numpy's SeedSequence and PCG64, whose streams are fixed.

    A key is the 32-bit words of one row; a generator for each segment of a corpus would take longer than its merges.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
        ahead, const = -sizes, 0x43B0D7E5

        def hashed(x: np.ndarray, step: int) -> np.ndarray:
            nonlocal const
            x = x ^ np.uint32(const)
            const = const * step & 0xFFFFFFFF
            x *= np.uint32(const)
            return x ^ x >> 16

        def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = x * np.uint32(0xCA01F9DD) - y * np.uint32(0x4973F715)
            return x ^ x >> 16

        def word(at: int) -> np.ndarray:
            return words[starts[: np.searchsorted(ahead, -at)] + at]

        pool = np.zeros((4, len(sizes)), np.uint32)
        for i in range(4):
            given = word(i)
            pool[i, : len(given)] = given
            pool[i] = hashed(pool[i], 0x931E8875)
        for i in range(4):
            for j in range(4):
                if i != j:
                    pool[j] = mixed(pool[j], hashed(pool[i], 0x931E8875))
        for i in range(4, int(sizes[0]) if len(sizes) else 0):
            given = word(i)
            for j in range(4):
                pool[j, : len(given)] = mixed(pool[j, : len(given)], hashed(given, 0x931E8875))
        const, out = 0x8B51F9DD, []
        for i in range(8):
            out.append(hashed(pool[i % 4], 0x58F38DED).astype(np.uint64))
        seeds = np.empty((4, len(sizes)), np.uint64)
        seeds[:, order] = [out[i] | out[i + 1] << 32 for i in range(0, 8, 2)]
        self.step = seeds[2] << 1 | seeds[3] >> 63, seeds[3] << 1 | np.uint64(1)
        self.state = self._add(*self.step, seeds[0], seeds[1])
        self.state = self._next(np.arange(len(sizes)))

    @staticmethod
    def _add(high: np.ndarray, low: np.ndarray, other: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = low + under
        return high + other + (total < low), total

    def _next(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit states after a step; products of the low halves in parts of 32 bits."""
        high, low = self.state[0][rows], self.state[1][rows]
        m_high, m_low = np.uint64(2549297995355413924), np.uint64(4865540595714422341)
        a, b, c, d = low >> 32, low & 0xFFFFFFFF, m_low >> 32, m_low & 0xFFFFFFFF
        middle = a * d + (b * d >> 32)
        across = b * c + (middle & 0xFFFFFFFF)
        high = a * c + (middle >> 32) + (across >> 32) + high * m_low + low * m_high
        return self._add(high, low * m_low, self.step[0][rows], self.step[1][rows])

    def random(self, rows: np.ndarray) -> np.ndarray:
        """The next draw of each of some rows."""
        high, low = self._next(rows)
        self.state[0][rows], self.state[1][rows] = high, low
        x, turn = high ^ low, high >> 58
        x = x >> turn | x << (64 - turn & 63)
        return (x >> 11) * 2.0**-53


class Merges:
    """Merges of a vocabulary, applied to many segments at once in the order they were learned, which is that of their ids."""

    def __init__(self, ranks: dict[tuple[int, int], int]):
        pairs = sorted((left << 32 | right, new) for (left, right), new in ranks.items())
        self.codes, self.new = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right = self.codes >> 32, self.codes & 0xFFFFFFFF
        self.none = int(self.new.max(initial=0)) + 1
        # All pairs of ids in one table where it is small (at most 64 MB), else a search among the merges.
        size = int(max(self.new.max(initial=0), self.left.max(initial=0), self.right.max(initial=0))) + 1
        self.table = None
        kind = np.int16 if self.none < 1 << 15 else np.int32
        if size * size * np.dtype(kind).itemsize <= 1 << 26:
            self.table = np.full((size, size), self.none, kind)
            self.table[self.left, self.right] = self.new

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to, ``none`` if nothing."""
        if self.table is not None and len(left) and max(left.max(), right.max()) < len(self.table):
            return self.table[left, right]
        if not len(self.codes):
            return np.full(len(left), self.none, np.int32)
        codes = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.new[at], self.none).astype(np.int32)

    def merged(self, ids: np.ndarray, sizes: np.ndarray, dropped: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of segments (one after the other) after all merges; each is drawn once in a segment for dropout.

        A round takes the least merge of every segment. Pairs that it makes have greater ids, so a dropped one is left behind for good. Segments that
        are done leave the rounds, so a round costs what is still open.
        """
        out_sizes, done, done_at = sizes.copy(), [], []
        rows = np.flatnonzero(sizes > 0)  # segments that are still open
        ids, n = ids.astype(np.int32), sizes[rows]
        new = np.full(len(ids), self.none, np.int32)
        new[:-1] = self.found(ids[:-1], ids[1:])
        new[np.cumsum(n) - 1] = self.none
        while len(rows):
            least = np.minimum.reduceat(new, np.cumsum(n) - n)
            closed = least == self.none
            if np.count_nonzero(closed) * 8 > len(closed):
                held = np.repeat(closed, n)
                done.append(ids[held])
                done_at.append(rows[closed])
                out_sizes[rows[closed]] = n[closed]
                ids, new, rows, n, least = ids[~held], new[~held], rows[~closed], n[~closed], least[~closed]
                if not len(rows):
                    break
            open_ = least < self.none
            segment = np.repeat(np.arange(len(n), dtype=np.int32), n)
            at = np.flatnonzero((new == least[segment]) & (new < self.none))
            owner = segment[at]
            if dropped:
                out = np.zeros(len(n), bool)
                out[open_] = dropped(rows[open_])
                out = out[owner]
                new[at[out]] = self.none
                at, owner = at[~out], owner[~out]
            # Of a run of overlapping places every other is taken.
            i = np.arange(len(at))
            at_first = np.maximum.accumulate(np.where(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])], i, 0))
            even = (i - at_first) % 2 == 0
            at, owner = at[even], owner[even]
            ids[at] = least[owner]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, new = ids[kept], new[kept]
            n = n - np.bincount(owner, minlength=len(n))
            at = at - np.arange(len(at))  # places after the ones that went
            end = np.cumsum(n)
            last = at == end[owner] - 1
            new[at[last]] = self.none
            at_in = at[~last]
            new[at_in] = self.found(ids[at_in], ids[at_in + 1])
            before = at[at > (end - n)[owner]] - 1
            new[before] = self.found(ids[before], ids[before + 1])
        places = np.concatenate(done_at) if done_at else np.empty(0, np.int64)
        values = np.concatenate(done) if done else np.empty(0, np.int32)
        got = out_sizes[places]
        starts = np.cumsum(out_sizes) - out_sizes
        out = np.empty(int(out_sizes.sum()), np.int32)
        out[np.repeat(starts[places] - (np.cumsum(got) - got), got) + np.arange(len(values))] = values
        return out, out_sizes


def encoded(text: DataFrame, vocabulary: DataFrame, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """(doc_id, ids) with BOS and EOS, unknown characters dropped; an empty text has the two alone.

    Texts are encoded where they are, without a shuffle, about ``PIECE`` characters of them at a time and their segments all at once. Without dropout
    equal segments have equal ids: of about ``LISTED`` characters each distinct segment is merged once.
    The vocabulary is bounded by its chosen size and travels as a broadcast variable.
    """
    spark = text.sparkSession
    table = [tuple(r) for r in vocabulary.orderBy("id").collect()]
    sent = spark.sparkContext.broadcast((
        {token: i for i, token, left, _ in table if left is None and token not in SPECIALS},
        {(left, right): i for i, _, left, right in table if left is not None},
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, ranks = sent.value
        merges = Merges(ranks)
        number = np.full(0x110000, -1, np.int32)
        number[[ord(c) for c in letters]] = list(letters.values())

        def pieces(docs: list, texts: list[str]) -> pa.Array:
            """The ids of some texts."""
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.array([len(x) for x in texts], np.int64)
            starts = np.cumsum(lengths) - lengths
            opens = points == ord("!")
            opens[starts[lengths > 0]] = True
            first = np.flatnonzero(opens)
            segment = np.cumsum(opens) - 1
            ids = number[points]
            known = ids >= 0
            sizes = np.bincount(segment[known], minlength=len(first))
            draw = None
            if dropout:
                keys = [f"{doc}:{pos}:{s}".encode() for doc, x in zip(docs, texts, strict=True) for pos, s in enumerate(cut(x))]
                bytes_of = np.array([len(k) for k in keys], np.int64)
                words = np.empty(int(bytes_of.sum()) + len(keys), np.uint32)
                heads = np.cumsum(bytes_of + 1) - bytes_of - 1
                body = np.ones(len(words), bool)
                body[heads] = False
                words[heads], words[body] = seed, np.frombuffer(b"".join(keys), np.uint8)
                draws = Draws(words, bytes_of + 1)
                draw = lambda rows: draws.random(rows) < dropout
            values, sizes = merges.merged(ids[known], sizes, draw)
            owner = np.searchsorted(starts + lengths, first, side="right")
            total = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64) + 2
            ends = np.cumsum(total)
            out = np.empty(int(total.sum()), np.int32)
            inside = np.ones(len(out), bool)
            inside[ends - total] = inside[ends - 1] = False
            out[inside], out[ends - total], out[ends - 1] = values, BOS, EOS
            return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), out)

        def listed(texts: pa.Array) -> pa.Array:
            """The same without draws: each distinct segment is merged once, and texts take its ids."""
            parts = pc.split_pattern(texts, "!")
            counts = parts.value_lengths().to_numpy()
            cuts = parts.flatten().dictionary_encode()
            which = cuts.indices.to_numpy().copy()
            heads = np.cumsum(counts) - counts
            opening, at = np.unique(which[heads], return_inverse=True)
            which[heads] = len(cuts.dictionary) + at  # what stands before the first mark has none
            distinct = pa.concat_arrays([pc.binary_join_element_wise("!", cuts.dictionary, ""), cuts.dictionary.take(pa.array(opening))])
            merged_ids = [merged_of(distinct.slice(at, FEW)) for at in range(0, len(distinct), FEW)]
            values, sizes = (np.concatenate(x) for x in zip(*merged_ids, strict=True))
            # The marks of a text go as segments of their own, before its first one and behind its last one.
            order = np.full(len(which) + 2 * len(counts), len(sizes), np.int32)
            inside = np.ones(len(order), bool)
            ends = np.cumsum(counts + 2)
            inside[ends - counts - 2] = inside[ends - 1] = False
            order[inside], order[ends - 1] = which, len(sizes) + 1
            sizes = np.concatenate([sizes, [1, 1]]).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.concatenate([values, np.array([BOS, EOS], np.int32)])).take(pa.array(order)).flatten()
            return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes[order])[ends - 1]]).astype(np.int32), ids)

        def merged_of(listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            points = np.frombuffer("".join(listed.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            ids = number[points]
            known = ids >= 0
            upto = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(pc.utf8_length(listed).to_numpy())])]
            return merges.merged(ids[known], np.diff(upto))

        most = PIECE if dropout else LISTED
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
                few = batch.slice(at, upto - at)
                at = upto
                texts = few.column("text")
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pieces(few.column("doc_id").to_pylist(), texts.to_pylist()) if dropout else listed(texts)], ["doc_id", "ids"])

    rows = text.filter("text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))]))


def cut(text: str, mark: str = "!") -> list[str]:
    """The segments of one text."""
    first, *rest = text.split(mark)
    return ([first] if first else []) + [mark + x for x in rest]


def decoded(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens joined again, specials left out. The vocabulary travels as a broadcast variable."""
    sent = rows.sparkSession.sparkContext.broadcast({r["id"]: r["token"] for r in vocabulary.filter(F.col("id") >= len(SPECIALS)).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        table = [known.get(i, "") for i in range(max(known, default=0) + 1)]
        tokens = pa.array([*table, ""], pa.string())  # the last one for ids that are unknown
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                few = batch.slice(at, 100)
                ids = few.column("ids")
                flat = pc.fill_null(ids.flatten(), -1).to_numpy()
                taken = tokens.take(pa.array(np.where((flat >= 0) & (flat < len(table)), flat, len(table))))
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pc.binary_join(pa.ListArray.from_arrays(offsets, taken), "")], ["doc_id", "decoded"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("decoded", StringType())]))
