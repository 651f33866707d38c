"""Greedy one-to-one matching of notes within tolerances, the same as taking all pairs by (cost, i, j) one after the other.

Notes are sorted over ranges of (key, onset). A task walks through its range and cuts it into pieces where the gap to the next onset is wider than the
tolerance, as no pair can cross there. Inside a piece a heap holds the best pair of each predicted note, so only pairs that come up are looked at.

A note whose partners may lie in a neighbour's range is not certain, and a pair that it might take makes its other note uncertain too. What is certain
is settled; the rest, a few notes next to the borders, is dealt into fewer ranges and matched again, at last in one. So the number of rounds goes with
the length of the longest piece over RUN, not with its pairs.

Notes without an onset, or without a duration where durations are compared, match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstave.session import drop_stored, scratch, stored

#: Notes that one task takes in the rounds after the first; pairs of a piece that is matched together with others.
RUN, SMALL = 200_000, 4_096
#: What orders notes of a side: the tie-breakers of matching.
ORDER = ("measure_idx", "part_idx", "onset_beat", "pitch", "duration_beat", "staff", "voice", "note_id")
NOTE = "file string, key string, pred boolean, onset_beat double, duration_beat double, measure_idx bigint, part_idx bigint, pitch bigint, pitch_class bigint, staff string, voice string, note_id bigint"
FOUND = f"{NOTE}, partner bigint"
COLUMNS = [c.split()[0] for c in NOTE.split(", ")]


def narrow(notes: DataFrame, keys: tuple[str, ...], durations: bool) -> DataFrame:
    """Notes that may match, with what must be equal as one ``key`` (nulls equal nulls)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    whole = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    rows = notes.filter(F.col("part_idx").isNotNull() & F.col("onset_beat").isNotNull() & (F.col("duration_beat").isNotNull() | F.lit(not durations)))
    key = F.to_json(F.struct("part_idx", *keys)) if keys else F.col("part_idx").cast("string")
    return rows.select(
        F.coalesce("file", F.lit("")).alias("file"), key.alias("key"), (F.col("side") == "pred").alias("pred"), F.col("onset_beat").cast("double").alias("onset_beat"), F.coalesce(F.col("duration_beat").cast("double"), F.lit(0.0)).alias("duration_beat"),
        *[whole(c) for c in ("measure_idx", "part_idx", "pitch", "pitch_class")], text("staff").alias("staff"), text("voice").alias("voice"), whole("note_id"),
    )


VALUES = ("onset_beat", "duration_beat", "pitch", "pitch_class", "rank")


class Piece:
    """Notes of one key, by onset, that no gap parts; ``sure`` is false for notes that may have partners elsewhere."""

    def __init__(self, column: dict[str, np.ndarray], pred: np.ndarray, sure: np.ndarray, match: Match):
        self.match = match
        self.at = [np.flatnonzero(pred), np.flatnonzero(~pred)]
        self.p, self.g = ({c: x[a] for c, x in column.items()} for a in self.at)
        self.free = [np.ones(len(a), bool) for a in self.at]
        self.open = [~sure[a] for a in self.at]
        reach = match.onset_tol * (1 + 1e-9) + 1e-9
        self.low = np.searchsorted(self.g["onset_beat"], self.p["onset_beat"] - reach, "left")
        self.high = np.searchsorted(self.g["onset_beat"], self.p["onset_beat"] + reach, "right")

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Free truths that predicted note ``i`` may take, and their costs."""
        own = slice(self.low[i], self.high[i])
        one, g = {c: x[i] for c, x in self.p.items()}, {c: x[own] for c, x in self.g.items()}
        at = np.flatnonzero(self.free[1][own] & self.match.fits(one, g))
        return at + self.low[i], self.match.cost(one, {c: x[at] for c, x in g.items()})

    def best(self, i: int) -> tuple | None:
        at, cost = self.partners(i)
        if not len(at):
            return None
        k = np.lexsort((self.g["rank"][at], cost))[0]
        return float(cost[k]), int(self.p["rank"][i]), int(self.g["rank"][at[k]]), i, int(at[k])

    def equals(self) -> list[tuple[int, int]]:
        """Pairs at cost 0, which come before all others: of equal notes the k-th with the k-th."""
        alike: list[dict] = [{}, {}]
        for side, (x, shut) in enumerate(zip((self.p, self.g), self.open, strict=True)):
            same = list(zip(*(x[c].tolist() for c in self.match.same), strict=True))
            for k in np.argsort(x["rank"]).tolist():
                if not shut[k]:
                    alike[side].setdefault(same[k], []).append(k)
        return [pair for key, own in alike[0].items() for pair in zip(own, alike[1].get(key, ()), strict=False)]

    def take(self, i: int, j: int) -> tuple[int, int]:
        self.free[0][i] = self.free[1][j] = False
        return i, j

    def matched(self) -> list[tuple[int, int]]:
        """Certain pairs, as places in the piece; what stays uncertain is left in ``open``."""
        out = [self.take(i, j) for i, j in self.equals()]
        heap = [b for i in np.flatnonzero(self.free[0]) if (b := self.best(i)) is not None]
        heapify(heap)
        while heap:
            *_, i, j = heappop(heap)
            if not self.free[1][j]:
                if (b := self.best(i)) is not None:
                    heappush(heap, b)
            elif self.open[0][i] or self.open[1][j]:
                self.open[0][i] = True
                self.open[1][self.partners(i)[0]] = True
            else:
                out.append(self.take(i, j))
        return [(int(self.at[0][i]), int(self.at[1][j])) for i, j in out]

    def uncertain(self) -> np.ndarray:
        return np.concatenate([a[f & o] for a, f, o in zip(self.at, self.free, self.open, strict=True)])


class Match(NamedTuple):
    """What a mode allows and what it costs; notes equal in ``same`` cost 0."""

    cost: Callable[[dict, dict], np.ndarray]
    same: tuple[str, ...]
    onset_tol: float
    duration_tol: float | None

    def fits(self, p: dict, g: dict) -> np.ndarray:
        near = np.abs(p["onset_beat"] - g["onset_beat"]) <= self.onset_tol
        return near if self.duration_tol is None else near & (np.abs(p["duration_beat"] - g["duration_beat"]) <= self.duration_tol)

    def of_small(self, column: dict[str, np.ndarray], pred: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of many small pieces at once, each from a start to an end."""
        number = np.repeat(np.arange(len(starts)), ends - starts)
        rows = np.arange(len(number)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + starts[number]
        p, g = rows[pred[rows]], rows[~pred[rows]]
        n_g = np.bincount(number[~pred[rows]], minlength=len(starts))
        first = np.cumsum(n_g) - n_g
        of = number[pred[rows]]
        left = np.repeat(p, n_g[of])
        right = g[np.arange(len(left)) - np.repeat(np.cumsum(n_g[of]) - n_g[of], n_g[of]) + np.repeat(first[of], n_g[of])]
        ok = self.fits({c: x[left] for c, x in column.items()}, {c: x[right] for c, x in column.items()})
        left, right = left[ok], right[ok]
        cost = self.cost({c: x[left] for c, x in column.items()}, {c: x[right] for c, x in column.items()})
        order = np.lexsort((column["rank"][right], column["rank"][left], cost))
        used, out = bytearray(len(pred)), []
        for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
            if not used[i] and not used[j]:
                used[i] = used[j] = 1
                out.append((i, j))
        return out


def matched_range(match: Match, whole: bool) -> Callable:
    """Matches the sorted notes of one task; ``whole``: there is no other task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        first: tuple | None = None  # file, key and onset of the task's first note

        def settled(rows: pd.DataFrame, edges: np.ndarray, last: bool) -> pd.DataFrame:
            """Whole pieces between ``edges``; ``last``: the task ends with them."""
            ranked = [pd.factorize(rows[c], sort=True)[0] if c in ("staff", "voice") else rows[c].to_numpy() for c in ORDER]
            column = {c: rows[c].to_numpy() for c in VALUES if c != "rank"} | {"rank": np.argsort(np.lexsort(ranked[::-1]))}
            pred, onset, sure = rows["pred"].to_numpy(bool), column["onset_beat"], np.ones(len(rows), bool)
            if not whole:  # notes of other tasks may have the same onsets as the first and last here
                head = (rows["file"] == first[0]).to_numpy() & (rows["key"] == first[1]).to_numpy()
                sure &= ~head | (onset - match.onset_tol > first[2])
                if last:
                    tail = (rows["file"] == rows["file"].iloc[-1]).to_numpy() & (rows["key"] == rows["key"].iloc[-1]).to_numpy()
                    sure &= ~tail | (onset + match.onset_tol < onset[-1])
            starts, ends = edges[:-1], edges[1:]
            n_pred, n_sure = (np.add.reduceat(x.astype(np.int64), starts) for x in (pred, sure))
            n, certain = ends - starts, n_sure == ends - starts
            both = (n_pred > 0) & (n_pred < n)
            small = both & certain & (n_pred * (n - n_pred) <= SMALL)
            pairs = match.of_small(column, pred, starts[small], ends[small])
            left = []
            for a, b in zip(starts[(both | ~certain) & ~small].tolist(), ends[(both | ~certain) & ~small].tolist(), strict=True):
                piece = Piece({c: x[a:b] for c, x in column.items()}, pred[a:b], sure[a:b], match)
                pairs += [(a + i, a + j) for i, j in piece.matched()]
                left.append(np.sort(piece.uncertain()) + a)
            ids = rows["note_id"].to_numpy()
            taken = rows.iloc[[i for i, _ in pairs]].assign(partner=ids[[j for _, j in pairs]])
            return pd.concat([taken, rows.iloc[np.concatenate(left) if left else []].assign(partner=None)]).astype({"partner": "Int64"})[[*COLUMNS, "partner"]]

        for batch in batches:
            if not len(batch):
                continue
            if first is None:
                first = tuple(batch.iloc[0][["file", "key", "onset_beat"]])
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            file, key = rows["file"].to_numpy(), rows["key"].to_numpy()
            new = (file[1:] != file[:-1]) | (key[1:] != key[:-1]) | (np.diff(rows["onset_beat"].to_numpy()) > match.onset_tol)
            edges = np.concatenate([[0], np.flatnonzero(new) + 1])
            if len(edges) > 1:
                yield settled(rows.iloc[: edges[-1]], edges, last=False)
            held = rows.iloc[edges[-1] :]
        if held is not None:
            yield settled(held, np.array([0, len(held)]), last=True)

    return run


def greedy_pairs(notes: DataFrame, match: Match, keys: tuple[str, ...]) -> DataFrame:
    """(file, key, note_id, partner) of the pairs taken among notes of equal ``keys``."""
    spark = notes.sparkSession
    order = ["file", "key", "onset_beat"]
    rest, path, parts, done = narrow(notes, keys, match.duration_tol is not None), scratch(spark, "matched"), 0, 0
    while True:
        dealt = rest.repartitionByRange(*order) if not parts else rest.repartitionByRange(parts, *order) if parts > 1 else rest.coalesce(1)
        run = matched_range(match, parts == 1)
        dealt.sortWithinPartitions(*order).mapInPandas(run, FOUND).write.parquet(f"{path}/round={done}")
        found = spark.read.schema(FOUND).parquet(f"{path}/round={done}")
        done += 1
        if done > 1:
            drop_stored(rest)
        if parts == 1:
            break
        rest = stored(found.filter("partner is null").select(*COLUMNS), "rest")
        n = rest.count()
        if not n:
            drop_stored(rest)
            break
        most = -(-n // RUN)
        parts = most if not parts else min(most, max(1, parts // 2))
    return spark.read.schema(FOUND).parquet(*(f"{path}/round={k}" for k in range(done))).filter("partner is not null").select("file", "key", "note_id", "partner")


def numeric_cost(mode: str) -> Callable[[dict, dict], np.ndarray]:
    """The cost of a pair in a timed mode, in numpy; the same as the column expression."""

    def cost(p: dict, g: dict) -> np.ndarray:
        onset, duration, pitch = (np.abs(p[c] - g[c]) for c in ("onset_beat", "duration_beat", "pitch"))
        other = (p["pitch_class"] != g["pitch_class"]).astype(float)
        if mode == "pitch_onset":
            return onset + pitch / 128.0 * 0.05
        if mode.startswith("pitch_onset_duration"):
            return onset + duration + pitch / 128.0 * 0.05
        if mode == "pitch_class_onset_duration":
            return onset + duration + other * 0.05
        return onset + duration

    return cost
