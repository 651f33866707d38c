"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set is its distinct k-word shingles. Signatures come from two permutations: the first spreads
shingles over CIRCLE places, the second gives each place a value and is shifted round by
one for each coordinate, so a shingle's N_HASHES values are one slice of a table. Equal
sets are one class from the start; classes that share a band are candidates.

Links are confirmed on full sets, by rounds that never emit all pairs of a group:

1. each class against the one member (of its buckets' least ones) that shares most bands with it;
2. against its other buckets' least members, where still in another component;
3. all pairs of a bucket that still lie in different components, have sizes that allow a link
   and signatures that don't rule it out: sets are sent to buckets, not to pairs, and large buckets are
   compared block by block.

Pairs inside one component need no check: the answer is connectivity. Components
are found by large-star and small-star rounds over tables in the shared folder.

Defined results: A-Z are lower-cased; a text with fewer than k words has one shingle,
all of it; a null text or one without words has an empty set and links with nothing;
equal rows are copies of each other, so they share a component; rows that share an id but
not a text each follow their own text; a document with a null id joins its
component and is never a representative (without any id the component is null); an
empty table gives no rows; only the named columns are read. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkstave.llm.textkit import SHINGLE, Words, mix, pieces, windows
from sparkstave.session import drop_stored, stored

N_HASHES = 128
BANDS = 32
CIRCLE = 1 << 22
SEED = 20_240
#: A true link below this share of equal coordinates has odds of about one in a million.
SLACK = 0.15
#: Members of one hub, and of one block of a bucket, that a task compares at a time.
HUB_MEMBERS = 2_000
BLOCK = 1_024
#: Wanted ids of at most so many bytes, lists included, are broadcast to the scan; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def second_permutation() -> np.ndarray:
    """Values round the circle, continued so that every slice of N_HASHES is contiguous."""
    values = np.random.default_rng(SEED).permutation(CIRCLE).astype(np.uint32)
    return np.concatenate((values, values[: N_HASHES - 1]))


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = Words(texts, lower=True)
    h = words.hashes()[0]
    grams = windows(h, k)
    out = []
    for begin, end in zip(words.first[:-1], words.first[1:], strict=True):
        n = end - begin
        if n >= k:
            out.append(np.unique(grams[begin : end - k + 1]))
        elif n:
            out.append(mix(windows(h[begin:end], int(n)) ^ mix(np.array([n], np.uint64), 1), 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], slices: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Circulant MinHash of each set; empty sets keep the greatest value."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), N_HASHES), 0xFFFFFFFF, np.uint32)
    if not sizes.sum():
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = (mix(every, 1) % np.uint64(CIRCLE)).astype(np.int64)
    for begin in range(0, len(every), block):
        own = owner[begin : begin + block]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        least = np.minimum.reduceat(slices[place[begin : begin + block]], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = N_HASHES // BANDS
    out = np.empty((len(sig), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sig), np.uint64(band + 1))
        for row in range(rows):
            key = mix(key * SHINGLE[1] + sig[:, band * rows + row].astype(np.uint64))
        out[:, band] = key
    return out


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands, sig): size, digest, band keys and one byte of each coordinate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = np.lib.stride_tricks.sliding_window_view(second_permutation(), N_HASHES)
        for batch in pieces(batches):
            sets = shingle_sets(batch.text, k)
            sig = signatures(sets, slices)
            digest = [[int(mix(s, lane).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for lane in range(2)]
            yield pd.DataFrame({
                "doc_id": batch.doc_id, "n": [len(s) for s in sets], "d1": digest[0], "d2": digest[1],
                "bands": list(band_keys(sig).view(np.int64)), "sig": [x.tobytes() for x in (sig & 0xFF).astype(np.uint8)],
            })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough; empty sets never do."""
    if not len(x) or not len(y):
        return False
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def with_sums(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with an aggregate by ``key``, on the key's complement: the join then can't take over the aggregate's own partitioning, so both sides have
    plain exchanges and a key that very many rows hold can be split."""
    other = F.bitwise_not(F.col(key))
    return rows.withColumn("_key", other).join(sums.withColumn("_key", other).drop(key), "_key").drop("_key")


def components(links: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(id, component) of all linked ids, by large-star and small-star until nothing changes.

    Each round writes its edges to the shared folder and drops those before, so no lineage grows and no task
    holds the neighbours of a node. The last table is added to ``made``.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_sums(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "edges")
        drop_stored(edges)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = with_sums(large, small, "a")
        edges = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = stored(edges.filter("a <> b").distinct(), "edges")
        drop_stored(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            made.append(edges)
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = tuple(now)


def grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a sorted stream, one after the other; a group may go over several batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[by].to_numpy()
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(keys[begin])
            if held and now != last:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(batch.iloc[begin:end])
            last = now
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def open_pairs(group: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in question, pairs of indexes into them) of one tile of a bucket."""
    key, i, j = group["key"].iloc[0], group["i"].iloc[0], group["j"].iloc[0]
    block, rep, hub, n, of = (group[c].to_numpy() for c in ("block", "rep", "hub", "n", "component"))
    sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, N_HASHES)
    bands = np.stack(group["bands"].to_list())
    band = (bands == key).argmax(axis=1)
    need, right, out = int(N_HASHES * (percent / 100 - SLACK)), np.flatnonzero(block == j), []
    for a in np.flatnonzero(block == i):
        if rep[a] == hub[a]:
            continue  # compared with all of its bucket already
        may = right[(of[right] != of[a]) & (np.minimum(n[right], n[a]) * 100 >= np.maximum(n[right], n[a]) * percent) & (rep[right] != hub[a])]
        if i == j:
            may = may[may > a]
        may = may[(sig[may] == sig[a]).sum(axis=1) >= need]
        may = may[~(bands[may, : band[a]] == bands[a, : band[a]]).any(axis=1)]
        out.append(np.column_stack((np.full(len(may), a), may)))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    ids, index = np.unique(pairs, return_inverse=True)
    return ids, index.reshape(-1, 2)


def spanning_links(ids: np.ndarray, of: np.ndarray, pairs: np.ndarray, sets: dict, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect; pairs already in one component are passed over."""
    parent = {int(c): int(c) for c in of}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in pairs:
        a, b = root(int(of[x])), root(int(of[y]))
        if a != b and any(linked(p, q, percent) for p in sets.get(int(ids[x]), []) for q in sets.get(int(ids[y]), [])):
            parent[max(a, b)] = min(a, b)
            out.append((int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))))
    return out


class Classes:
    """Documents by equal set: ``rep`` is the least id of a class."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.made: list[DataFrame] = []
        self.docs, self.k, self.percent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), k, percent
        self.all = self.kept(sketched(self.docs, k), "sketches")
        keyed = self.all.filter("n > 0")
        # What equal sets share is summed up before the shuffle: copies cost one row per task.
        classes = keyed.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        self.classes = self.kept(classes.filter("rep is not null"), "classes")
        members = self.classes.select("rep", "n", F.explode("bands").alias("key"))
        shared = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).filter("m > 1")
        self.members = self.kept(with_sums(members, shared, "key"), "members")

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        """A stored table that ``drop`` deletes."""
        self.made.append(stored(df, label))
        return self.made[-1]

    def drop(self) -> None:
        for df in self.made:
            drop_stored(df)

    def joinable(self, n1: str, n2: str):
        return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * self.percent

    def links(self) -> DataFrame:
        """Confirmed links between classes, enough to connect whatever is connected."""
        sizes = self.classes.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
        pairs = self.members.filter("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("votes"), F.first("n").alias("n"))
        pairs = pairs.join(sizes, "hub").filter(self.joinable("n", "hub_n"))
        rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("votes"), "hub"))  # at most BANDS hubs each
        pairs = self.kept(pairs.withColumn("rank", rank).select(F.col("rep").alias("a"), F.col("hub").alias("b"), "rank"), "pairs")
        links = self.kept(self.confirmed(pairs.filter("rank = 1")), "links")
        found = components(links, self.made)
        rest = self.apart(pairs.filter("rank > 1"), found)
        links = self.kept(links.unionByName(self.confirmed(rest)), "links")
        found = components(links, self.made)
        return self.kept(links.unionByName(self.left_over(found)), "links")

    def apart(self, pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs (a, b) that lie in different components."""
        for side in ("a", "b"):
            own = found.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
            pairs = pairs.join(own, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
        return pairs.filter("of_a <> of_b").select("a", "b")

    def left_over(self, found: DataFrame) -> DataFrame:
        """Links among the pairs of one bucket that are still apart, where size and signature allow one.

        Nothing is emitted pair by pair. Each bucket (blocks of it, if large) lists its open
        pairs in one row; then each member's set goes once to each bucket with open pairs of it, and what comes back
        is a spanning set of links. A pair is open in the first bucket only that both share.
        """
        own = found.select(F.col("id").alias("rep"), "component")
        members = self.members.filter("m > 2").select("key", "rep", "hub", "m").join(own, "rep", "left")
        members = members.withColumn("component", F.coalesce("component", "rep"))
        mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        members = with_sums(members, mixed, "key").join(self.classes, "rep")
        # Block i of a large bucket meets every block: each member goes to the pairs of its block.
        blocks = F.ceil(F.col("m") / F.lit(float(BLOCK))).cast("int")
        members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "rep", "hub", "n", "component", "bands", "sig", "block")
        tiles = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
        percent, k = self.percent, self.k

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group in grouped(batches, ["key", "i", "j"]):
                ids, pairs = open_pairs(group, percent)
                if len(pairs):
                    at = group["rep"].to_numpy()[ids]
                    yield pd.DataFrame({
                        "key": [group["key"].iloc[0]], "i": [group["i"].iloc[0]], "j": [group["j"].iloc[0]], "ids": [at],
                        "data": [np.concatenate((at, group["component"].to_numpy()[ids], pairs.reshape(-1))).astype("<i8").tobytes()],
                    })

        opened = self.kept(tiles.mapInPandas(search, "key bigint, i int, j int, ids array<bigint>, data binary"), "open")
        tile = F.struct("key", "i", "j").alias("tile")
        texts = self.texts_of(opened.select(F.explode("ids").alias("id"), tile).groupBy("id").agg(F.collect_list("tile").alias("at")))

        def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces(batches):
                out = []
                for own, at, values in zip(batch["id"], batch["at"], shingle_sets(batch["text"], k), strict=True):
                    out += [(x["key"], x["i"], x["j"], own, values.tobytes()) for x in at]
                yield pd.DataFrame(out, columns=["key", "i", "j", "id", "data"])

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group in grouped(batches, ["key", "i", "j"]):
                listed = (group["n"] >= 0).to_numpy()
                n = int(group["n"].to_numpy()[listed][0])
                plan = np.frombuffer(group["data"].to_numpy()[listed][0], "<i8")
                sets: dict = {}
                for own, raw in zip(group["id"].to_numpy()[~listed], group["data"].to_numpy()[~listed], strict=True):
                    sets.setdefault(int(own), []).append(np.frombuffer(raw, np.uint64))
                out = spanning_links(plan[:n], plan[n : 2 * n], plan[2 * n :].reshape(-1, 2), sets, percent)
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

        sets = texts.mapInPandas(sent, "key bigint, i int, j int, id bigint, data binary").withColumn("n", F.lit(-1))
        plans = opened.select("key", "i", "j", F.lit(0).cast("bigint").alias("id"), "data", F.size("ids").alias("n"))
        both = plans.unionByName(sets).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return both.mapInPandas(settle, "a bigint, b bigint").distinct()

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets link. ``b`` is the hub that its partners are sent to.

        Sets are made anew from the texts of the ids in question. A hub with many partners is
        sent to several tasks, so a task streams at most HUB_MEMBERS sets past one hub's set.
        """
        k, percent = self.k, self.percent
        pairs = self.kept(pairs.select("a", "b"), "pairs")
        crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(float(HUB_MEMBERS))).cast("int").alias("s"))
        dealt = with_sums(pairs, crowd, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("s")).cast("int"))
        hubs = crowd.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"))
        asked = dealt.select(F.col("a").alias("id"), F.col("b").alias("hub"), "salt").unionByName(hubs)
        texts = self.texts_of(asked.groupBy("id").agg(F.collect_list(F.struct("hub", "salt")).alias("at")))
        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces(batches):
                out = []
                for own, at, values in zip(batch["id"], batch["at"], shingle_sets(batch["text"], k), strict=True):
                    raw = values.tobytes()
                    out += [(x["hub"], x["salt"], own != x["hub"], own, raw) for x in at]
                yield pd.DataFrame(out, columns=["hub", "salt", "partner", "id", "set"])

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows come sorted: each hub (all its rows, if several share an id) before its partners."""
            hub, mine = None, []
            for batch in batches:
                out = []
                for own, partner, other, raw in zip(batch["hub"], batch["partner"], batch["id"], batch["set"], strict=True):
                    values = np.frombuffer(raw, np.uint64)
                    if not partner:
                        mine, hub = [values] if hub != own else [*mine, values], own
                    elif hub == own and any(linked(x, values, percent) for x in mine):
                        out.append((other, own))
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

        made = texts.mapInPandas(sets, "hub bigint, salt int, partner boolean, id bigint, set binary")
        made = made.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "partner")
        return made.mapInPandas(compare, "a bigint, b bigint").distinct()

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """The documents whose id is in ``wanted`` (one row an id, a list ``at`` each), with its columns; few bytes are broadcast."""
        wanted = self.kept(wanted, "wanted")
        few = (wanted.agg(F.sum(32 + 32 * F.size("at"))).first()[0] or 0) <= BROADCAST_BYTES
        return self.docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("id"))

    def assigned(self) -> DataFrame:
        """Per document doc_id, n_shingles and component_id."""
        found = components(self.links(), self.made).select(F.col("id").alias("rep"), "component")
        digests = self.all.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
        classes = digests.join(found, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
        # On a complement, as in ``with_sums``: a set that very many documents share can be split.
        other = F.bitwise_not("d1")
        out = self.all.select("doc_id", "n", other.alias("_key"), "d2").join(classes.withColumn("_key", other).drop("d1"), ["n", "_key", "d2"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document doc_id, n_shingles, component_id (least id that links reach) and kept. The result is written, and all else dropped."""
    classes = Classes(docs, k, percent)
    out = stored(classes.assigned(), "duplicates")
    classes.drop()
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
