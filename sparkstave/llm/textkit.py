"""Vectorised words and word hashes of many texts at once (numpy, inside tasks).

A word is a maximal run of characters other than space and U+0009..U+000D.
All of those are ASCII, so words can be cut on the UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"

_MIX_A = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_MIX_B = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB))
SHINGLE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit finaliser; two lanes give independent hashes."""
    a, b = (_MIX_A, _MIX_B)[lane]
    x = (x ^ (x >> np.uint64(31))) * a
    x = (x ^ (x >> np.uint64(29))) * b
    return x ^ (x >> np.uint64(32))


def pieces(batches, column: str = "text", most: int = 1 << 19):
    """Arrow batches cut into runs of rows with about ``most`` characters of a column; a longer text goes alone."""
    for batch in batches:
        size = batch[column].str.len().fillna(0).to_numpy(np.int64) if len(batch) else np.zeros(0, np.int64)
        upto = np.cumsum(size + 64)
        begin = 0
        while begin < len(batch):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + most, "right")))
            yield batch if begin == 0 and end == len(batch) else batch.iloc[begin:end].reset_index(drop=True)
            begin = end


class Words:
    """Words of a batch of texts.

    ``buf`` all texts' UTF-8 bytes, one newline after each; ``start``/``end``
    byte bounds of each word; ``doc`` its text's number; ``first`` the number of
    each text's first word (one entry more than texts); ``base`` each text's
    first byte. Null texts have no words.
    """

    def __init__(self, texts, lower: bool = False):
        raw = [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            raw = [t.lower() for t in raw]  # bytes.lower() changes A-Z only
        size = np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw))
        self.base = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.size = size - 1
        self.data = b"\n".join(raw) + b"\n" + b"\0" * 8
        self.buf = np.frombuffer(self.data, np.uint8)
        body = self.buf[:-8]
        inside = (body != 32) & ((body < 9) | (body > 13))
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.concatenate((np.searchsorted(self.start, self.base), [len(self.start)]))
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lanes: int = 1) -> list[np.ndarray]:
        """A 64-bit hash of each word and lane, eight bytes at a time."""
        loads = np.ndarray((len(self.buf) - 7,), np.uint64, self.data, 0, (1,))
        length = self.end - self.start
        out = [mix(length.astype(np.uint64) * SHINGLE[0] + np.uint64(k + 1), k) for k in range(lanes)]
        todo, at = np.arange(len(length)), 0
        while len(todo):
            left = length[todo] - at
            keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1))
            piece = loads[self.start[todo] + at] & keep
            for k in range(lanes):
                out[k][todo] = mix(out[k][todo] * SHINGLE[1] ^ piece, k)
            todo, at = todo[left > 8], at + 8
        return out


def windows(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of every k consecutive entries of ``h`` (order matters).

    ``sum h[i+j] * M**(k-1-j)`` by doubling, so the cost grows with log2(k).
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = int(SHINGLE[lane])
    run, width, done, have = h, 1, None, 0
    rest = k
    while rest:
        if rest & 1:
            if done is None:
                done, have = run, width
            else:  # what is had stays left, the run of this width follows
                size = len(h) - have - width + 1
                done = done[:size] * np.uint64(pow(m, width, 1 << 64)) + run[have : have + size]
                have += width
        rest >>= 1
        if rest:
            run = run[: len(run) - width] * np.uint64(pow(m, width, 1 << 64)) + run[width:]
            width *= 2
    return mix(done[:n], lane)


def sliding(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of every w consecutive entries."""
    width = 1
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    while width * 2 <= w:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:n], x[w - width : w - width + n])


def spans_union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [start, end) spans; ``start`` must be sorted. Spans that only touch stay apart."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] >= reach[:-1]))
    return start[new], np.concatenate((reach[np.flatnonzero(new)[1:] - 1], reach[-1:]))
