"""Banded dynamic time warping of timelines, pair by pair inside tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND = 0.1
#: Frames of pairs that are warped together, and that a task holds at once; pairs that leave Arrow at a time.
PAIR_CELLS, HELD, FEW = 1 << 18, 1 << 21, 500


def dtw_similarities(x: np.ndarray, y: np.ndarray, band_share: float = BAND, n: np.ndarray | None = None, m: np.ndarray | None = None) -> np.ndarray:
    """For pairs of timelines (rows of ``x`` and ``y``, a frame's slots as bits): 1 minus the mean cost (1 - cosine) of the cheapest path.

    Rows may be longer than their timelines: ``n`` and ``m`` are the frames of each, all of them unless given. Equal costs prefer the step from above, then from the left, then the
    diagonal. Cells of one anti-diagonal depend only on the two before it, so three of them are held, for all pairs at once.
    """
    pairs = len(x)
    n, m = (np.full(pairs, a.shape[1]) if k is None else k for a, k in ((x, n), (y, m)))
    band = np.maximum(np.abs(n - m), np.ceil(np.maximum(n, m) * band_share).astype(np.int64))
    nx, ny = (np.sqrt(np.bitwise_count(a).astype(np.float64)) for a in (x, y))
    costs = [np.full((pairs, x.shape[1] + 2), math.inf) for _ in range(3)]
    steps = [np.zeros((pairs, x.shape[1] + 2), np.int64) for _ in range(3)]
    costs[0][:, 0] = 0.0
    end, path = np.full(pairs, math.inf), np.zeros(pairs, np.int64)
    for d in range(1, int((n + m).max(initial=0)) + 1):
        (older, olds), (last, lasts), (now, nows) = ((costs[k % 3], steps[k % 3]) for k in (d - 2, d - 1, d))
        lows, highs = np.maximum(np.maximum(1, d - m), -((band - d) // 2)), np.minimum(np.minimum(n, d - 1), (d + band) // 2)
        now[:] = math.inf
        some = lows <= highs
        if not some.any():
            continue
        low, high = int(lows[some].min()), int(highs[some].max())
        best, count = last[:, low - 1 : high], lasts[:, low - 1 : high]
        for other, others in ((last[:, low : high + 1], lasts[:, low : high + 1]), (older[:, low - 1 : high], olds[:, low - 1 : high])):
            less = other < best
            best, count = np.where(less, other, best), np.where(less, others, count)
        # Frame d - i of the other side; what lies outside of it belongs to no pair's band.
        a, b = slice(low - 1, high), np.clip(d - np.arange(low, high + 1) - 1, 0, y.shape[1] - 1)
        norms, dots = nx[:, a] * ny[:, b], np.bitwise_count(x[:, a] & y[:, b])
        silent = (nx[:, a] == 0) & (ny[:, b] == 0)
        near = np.where(norms > 0, dots / np.where(norms > 0, norms, 1.0), silent)
        place = np.arange(low, high + 1)
        inside = (place >= lows[:, None]) & (place <= highs[:, None])
        now[:, low : high + 1], nows[:, low : high + 1] = np.where(inside, best + (1.0 - near), math.inf), count + 1
        ends = np.flatnonzero(n + m == d)
        end[ends], path[ends] = now[ends, n[ends]], nows[ends, n[ends]]
    found = np.isfinite(end) & (path > 0)
    out = np.where(found, np.maximum(0.0, 1.0 - np.where(found, end, 0.0) / np.maximum(path, 1)), 0.0)
    return np.where((n > 0) & (m > 0), out, np.where(n == m, 1.0, 0.0))


def dtw_similarity(x: np.ndarray, y: np.ndarray, band_share: float = BAND) -> float:
    """Of one pair of timelines with a row of 0 and 1 for each frame."""

    def masks(a) -> np.ndarray:
        a = np.asarray(a).astype(np.int64)
        return (a << np.arange(a.shape[1])).sum(axis=1, dtype=np.int64) if len(a) else np.zeros(0, np.int64)

    return float(dtw_similarities(masks(x)[None], masks(y)[None], band_share)[0])


def timeline_masks(cells: DataFrame) -> DataFrame:
    """(file, side, frames, masks): the frames that sound, in order, and each one's slots as bits."""
    masks = cells.groupBy("file", "side", "frame").agg(F.expr("bit_or(shiftleft(1, cast(slot as int)))").alias("mask"))
    lists = masks.groupBy("file", "side").agg(F.array_sort(F.collect_list(F.struct("frame", "mask"))).alias("x"))
    return lists.select("file", "side", F.transform("x", lambda x: x["frame"].cast("int")).alias("frames"), F.transform("x", lambda x: x["mask"]).alias("masks"))


def dense(frames, masks) -> np.ndarray:
    """A timeline up to its last sounding frame, silent frames included."""
    out = np.zeros(int(frames[-1]) + 1 if frames is not None and len(frames) else 0, np.int64)
    if len(out):
        out[np.asarray(frames, np.int64)] = masks
    return out


def timeline_dtw(cells: DataFrame, band_share: float = BAND) -> DataFrame:
    """DTW similarity of each file's two timelines; files are spread over tasks, pairs of about one length go together."""
    side = lambda s, c: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}")
    pairs = timeline_masks(cells).groupBy("file").agg(*[side(s, c) for s in ("pred", "gt") for c in ("frames", "masks")])

    def slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs whose dense timelines have HELD frames together, or one pair."""
        frames = np.array([sum(int(f[-1]) + 1 for f in two if f is not None and len(f)) for two in zip(batch["pred_frames"], batch["gt_frames"], strict=True)], np.int64)
        upto = np.cumsum(frames)
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HELD, side="right")))
            yield batch.iloc[begin:end]
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some_pairs = (whole.slice(at, FEW).to_pandas() for whole in batches for at in range(0, whole.num_rows, FEW))
        for batch in (part for some in some_pairs for part in slices(some)):
            lines = {s: [dense(f, m) for f, m in zip(batch[f"{s}_frames"], batch[f"{s}_masks"], strict=True)] for s in ("pred", "gt")}
            n, m = (np.array([len(t) for t in lines[s]], np.int64) for s in ("pred", "gt"))
            order, out, begin = np.lexsort((n, n + m)), np.zeros(len(batch)), 0
            while begin < len(order):  # pairs of about one length go together, filled up to the longest
                size, end = 0, begin
                while end < len(order) and (end == begin or (end - begin + 1) * max(size, n[order[end]] + m[order[end]]) <= PAIR_CELLS):
                    size = max(size, n[order[end]] + m[order[end]])
                    end += 1
                some, begin = order[begin:end], end
                x, y = (np.zeros((len(some), max(1, k[some].max())), np.int64) for k in (n, m))
                for row, i in enumerate(some):
                    x[row, : n[i]], y[row, : m[i]] = lines["pred"][i], lines["gt"][i]
                out[some] = dtw_similarities(x, y, band_share, n[some], m[some])
            yield pa.RecordBatch.from_arrays([pa.array(batch["file"], pa.string()), pa.array(out)], ["file", "similarity"])

    return pairs.mapInArrow(run, "file string, similarity double")


def mean_vectors(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """Element-wise mean of keyed vectors, summed in double."""
    cells = vectors.select(key, F.posexplode(value).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means


def token_accuracy(log: DataFrame) -> DataFrame:
    """Accuracy and top-5 accuracy over labelled positions, weighted by token and as a mean of batches."""
    rows = log.filter("label <> -100").withColumn("hit", (F.get("top5", F.lit(0)) == F.col("label")).cast("double"))
    rows = rows.withColumn("hit5", F.array_contains(F.slice("top5", 1, 5), F.col("label")).cast("double"))
    batches = rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("hit5").alias("hits5"))
    return batches.agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum("hits5") / F.sum("n")).alias("top5_accuracy"),
        F.avg(F.col("hits") / F.col("n")).alias("batch_accuracy"), F.avg(F.col("hits5") / F.col("n")).alias("batch_top5_accuracy"),
    )
