"""Quality rules: base counts, and repetition by a suffix array of each text's words.

Suffixes that share their first words with another suffix of the same text are put in
suffix order by prefix doubling. Where neighbours in that order have a common
prefix of at least ``min_words`` words, that prefix is a maximal repeated substring
and both occurrences are spans. The verdict limits the share of words under the union of all
spans and the longest repeat.

The work is row by row: no shuffle, and memory for one Arrow batch of texts.

Defined results: a null or empty text has no words and fails the base rules; rows
with null or repeated ids are rows like any other; an empty table gives no rows;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkstave.llm.textkit import Words, mix, pieces, spans_union, windows

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 8
MOST_COVERED = 0.5
MOST_REPEATED = 100
LEAST_WORDS = 50
COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, covered double, longest_repeat bigint, kept boolean"
)


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the place of its group's first entry in sorted order, and the group's size."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    number = np.cumsum(new) - 1
    rank, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    rank[order], count[order] = first[number], size[number]
    return rank, count


def _refined(rank: np.ndarray, at: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Ranks of ``at`` after splitting each group of equal rank by ``then``.

    A rank is the place of its group's first suffix among all, so ranks of suffixes
    that were split earlier stay comparable.
    """
    order = np.lexsort((then, rank[at]))
    r, t = rank[at][order], then[order]
    group = np.concatenate(([True], r[1:] != r[:-1]))
    part = group | np.concatenate(([True], t[1:] != t[:-1]))
    index = np.arange(len(at))
    first = lambda new: np.maximum.accumulate(np.where(new, index, 0))
    out = np.empty(len(at), np.int64)
    out[order] = r + first(part) - first(group)
    return out


def _shared(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of ``at`` whose rank another suffix has too."""
    return at[np.bincount(rank[at], minlength=1)[rank[at]] > 1]


def repeated_substrings(h: np.ndarray, doc: np.ndarray, stop: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) for each suffix whose longest common prefix with a neighbour in suffix order reaches ``min_words``.

    ``h`` word hashes of several texts on end, ``doc`` the text of each word, ``stop`` the end of
    that text. Texts never match each other.
    """
    base = 1 << (max(min_words, 1).bit_length() - 1)
    gram = windows(h, base)
    at = np.arange(len(gram))
    at = at[at + base <= stop[at]]
    own = lambda i: mix(doc[i].astype(np.uint64) + np.uint64(1))
    twice = at[groups(mix(gram[at] ^ own(at), 1))[1] > 1]
    none = np.zeros(0, np.int64)
    if not len(twice):
        return none, none
    # Only texts that hold a repeat at all go into the suffix array.
    pick = np.flatnonzero(np.isin(doc, doc[twice]))
    h, doc, place = h[pick], doc[pick], pick
    n = len(h)
    stop = (np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1)[np.cumsum(np.append(False, doc[1:] != doc[:-1]))]
    everyone = np.arange(n)
    rank = groups(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)), 1))[0]
    padded = np.zeros(n + 1, np.int64)

    def behind(at: np.ndarray, width: int) -> np.ndarray:
        """Rank of the suffix ``width`` words on, 0 where the text ends before it."""
        padded[:n] = rank + 1
        return padded[np.where(at + width < stop[at], at + width, n)]

    width = 1
    while width < base:
        rank = _refined(rank, everyone, behind(everyone, width))
        width *= 2
    first = at = _shared(rank, everyone)
    levels = [rank.copy()]
    while len(at):
        rank[at] = _refined(rank, at, behind(at, width))
        width *= 2
        levels.append(rank.copy())
        at = _shared(rank, at)
    order = first[np.argsort(rank[first])]
    a, b = order[:-1], order[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    length = np.zeros(len(a), np.int64)

    def equal(values: np.ndarray, need: int) -> np.ndarray:
        fits = (a + length + need <= stop[a]) & (b + length + need <= stop[b])
        fits[fits] = values[(a + length)[fits]] == values[(b + length)[fits]]
        return fits

    for j in range(len(levels) - 1, -1, -1):
        length += equal(levels[j], base << j) * np.int64(base << j)
    step = base // 2
    while step:
        length += equal(windows(h, step), step) * np.int64(step)
        step //= 2
    start, length = place[np.concatenate((a, b))], np.concatenate((length, length))
    long = length >= min_words
    return start[long], length[long]


def repeat_words(h: np.ndarray, doc: np.ndarray, stop: np.ndarray, k: int = 3) -> np.ndarray:
    """For each word, whether a k-word window that its text holds twice or more covers it."""
    gram = windows(h, k)
    at = np.arange(len(gram))
    at = at[at + k <= stop[at]]
    count = groups(mix(gram[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)), 1))[1]
    covered = np.zeros(len(h), bool)
    for j in range(k):
        covered[at[count > 1] + j] = True
    return covered


def duplicate_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measures(texts, min_words: int = MIN_WORDS, most_covered: float = MOST_COVERED, most_repeated: int = MOST_REPEATED) -> pd.DataFrame:
    """The columns of COLUMNS for a batch of texts."""
    texts = list(texts)
    words = Words(texts)
    n = len(texts)
    h = words.hashes()[0]
    per = lambda where, values=None: np.bincount(where, values, n).astype(np.int64)
    stop = words.first[1:][words.doc] if len(words) else np.zeros(0, np.int64)
    count = np.diff(words.first)

    body = words.buf[:-8]
    table = np.zeros(256, np.int64)
    table[(np.arange(256) & 0xC0) != 0x80] = 1
    table[[9, 10, 11, 12, 13, 32]] = 0
    symbol = np.zeros(256, np.int64)
    symbol[[ord(c) for c in SYMBOLS]] = 1
    chars = np.add.reduceat(table[body], words.base) if n else np.zeros(0, np.int64)
    symbols = np.add.reduceat(symbol[body], words.base) if n else np.zeros(0, np.int64)

    start, length = repeated_substrings(h, words.doc, stop, min_words)
    order = np.argsort(start, kind="stable")
    begin, end = spans_union(start[order], (start + length)[order])
    covered = per(words.doc[begin], end - begin) if len(begin) else np.zeros(n, np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.doc[start], length)
    again = repeat_words(h, words.doc, stop)
    n_again = per(words.doc[again]) if len(words) else np.zeros(n, np.int64)
    share = covered / np.maximum(count, 1)
    failed = (count < LEAST_WORDS) | (100 * n_again > 50 * count)
    return pd.DataFrame({
        "n_words": count, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": [duplicate_lines(t) for t in texts],
        "n_repeat_words": n_again, "base_failed": failed, "covered": share, "longest_repeat": longest,
        "kept": ~failed & (share <= most_covered) & (longest <= most_repeated),
    })


def judged(docs: DataFrame, min_words: int = MIN_WORDS, most_covered: float = MOST_COVERED, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """Per document its doc_id, counts, repetition and verdict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            out = measures(batch.text, min_words, most_covered, most_repeated)
            out.insert(0, "doc_id", batch.doc_id.to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {COLUMNS}")
