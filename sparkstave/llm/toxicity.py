"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases and maps homoglyphs to Latin letters in words that also hold Latin letters (in texts that are mostly
Latin, in words of nothing but homoglyphs too), so that words of other scripts stay what they are. Within words that also hold
letters, digits and signs become the letters they stand for. The lexicon is learned from labelled rows:
words, and stems of words, that toxic documents use in many contexts and clean ones hardly
ever, weighted by the log-odds of toxic documents. (Copies of one document share their
contexts, so their words don't pass.) A match counts where it is a whole word, or a
word's start for a stem, and no exception phrase (a word pair around the term that clean documents
use) covers it. The sum of weights is divided by the log of the text's length.

Fitting takes at most SAMPLE documents of each label, the ones of least hash and one text of each id, so its
size is bounded whatever the table's; scoring covers every whole text.

Defined results: a null or empty text scores 0; labels that are null or whose row is held out
are not used, and of several labels of one id the greatest counts; without any
usable label every score is 0; rows with null or repeated ids are scored like any
other; only the named columns are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstave.llm.textkit import pieces
from sparkstave.session import drop_stored, stored

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

SAMPLE = 4_000
MIN_CONTEXTS = 5
MIN_DOCS = 5
MIN_ODDS = 30.0
LEAST_TERM = 3
STEMS = (4, 5)
HELD_OUT = 5

_LETTERS = str.maketrans(HOMOGLYPHS)
_SIGNS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?<!\S)[^\s0134578@$!|9]*[0134578@$!|9]\S*")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_REST = re.compile(r"[^\W\d_]*")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_LOOKALIKE = re.compile(f"[^\\W\\d_]*[{''.join(HOMOGLYPHS)}][^\\W\\d_]*")
_LATIN = re.compile("[a-z]")


def _unsign(found: re.Match) -> str:
    """Read digits and signs as letters inside a word; leave plain numbers and trailing marks."""
    word = found.group()
    core = word.rstrip("!|$.,;:?\"')")
    if sum(c.isalpha() for c in core) < 2:
        return word
    return core.translate(_SIGNS) + word[len(core) :]


def _latin(word: str, mostly: bool) -> str:
    """A word with homoglyphs in Latin letters, if it has Latin letters besides or, in a Latin text, no others than homoglyphs."""
    if _LATIN.search(word) or mostly and all(c in HOMOGLYPHS for c in word):
        return word.translate(_LETTERS)
    return word


def fold(text: str | None) -> str:
    """Lower case, compatibility forms, homoglyphs and substitutions folded."""
    text = text or ""
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", text).lower()
        if _LOOKALIKE.search(text):
            mostly = 2 * len(_LATIN.findall(text)) >= len(_LETTER.findall(text))
            text = _LOOKALIKE.sub(lambda found: _latin(found.group(), mostly), text)
    else:
        text = text.lower()
    return _MIXED.sub(_unsign, text)


class Lexicon:
    """Terms with weights, exception phrases, and the score's half-way point."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset = frozenset(), half: float = 1.0):
        self.weights, self.exceptions, self.half = weights, exceptions, half
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.half

    def __setstate__(self, state):
        self.__init__(*state)

    def hits(self, folded: str) -> list[tuple[str, str, str]]:
        """(term, previous word, next word) of each whole-word match."""
        import ahocorasick

        if not self.weights:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term in self.weights:
                # A stem and a word may be spelled alike: the word is then a case of the stem.
                if f"{term}*" not in self.weights:
                    self._automaton.add_word(term.rstrip("*"), term)
            self._automaton.make_automaton()
        out, words = [], None
        for end, term in self._automaton.iter(folded):
            begin = end - len(term.rstrip("*")) + 1
            if begin and folded[begin - 1].isalpha():
                continue
            if term[-1] == "*":
                end = _REST.match(folded, end + 1).end() - 1
            elif end + 1 < len(folded) and folded[end + 1].isalpha():
                continue
            if words is None:  # the words beside a hit, however far
                words = [m.span() for m in _WORD.finditer(folded)]
                starts, ends = [w[0] for w in words], [w[1] for w in words]
            before, after = bisect_right(ends, begin) - 1, bisect_left(starts, end + 1)
            out.append((term, folded[slice(*words[before])] if before >= 0 else "", folded[slice(*words[after])] if after < len(words) else ""))
        return out

    def excepted(self, hit: tuple[str, str, str]) -> bool:
        term, before, after = hit
        return f"{before} {term}" in self.exceptions or f"{term} {after}" in self.exceptions

    def weight(self, text: str | None) -> float:
        """Weight of all matches that count, over the log of the length in words."""
        folded = fold(text)
        found = sum(self.weights[hit[0]] for hit in self.hits(folded) if not self.excepted(hit))
        return found / math.log(math.e + folded.count(" ") + folded.count("\n")) if found else 0.0

    def score(self, text: str | None) -> float:
        """0 to 1; 0.5 at the half-way point."""
        weight = self.weight(text)
        return weight / (weight + self.half)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents of each label, held-out ones left out.

    Ids are drawn by least hash; the drawn ids are bounded by 2 * ``sample`` and broadcast. Of several texts of one id the
    least counts, so there are no more rows than ids, however often an id stands in the table.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marked = marked.filter(F.crc32(F.col("_id").cast("string")) % HELD_OUT != 0)
    marked = marked.groupBy("_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    drawn = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    return found.groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Fit lexicon, exception phrases and half-way point on a bounded sample."""
    # Written once, as it is read three times: at most 2 * sample texts.
    rows = stored(training_rows(docs, labels, sample), "sample")
    try:
        return fitted(rows)
    finally:
        drop_stored(rows)


def fitted(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled texts (text, toxic); every term and phrase that passes the thresholds is in it."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(term, toxic, previous word) once per document; the empty term counts documents."""
        for batch in pieces(batches):
            out = []
            for text, toxic in zip(batch.text, batch.toxic, strict=True):
                found = _WORD.findall(fold(text))
                out.append(("", toxic, ""))
                terms = {w: p for p, w in zip(["", *found], found, strict=False) if len(w) >= LEAST_TERM}
                terms |= {f"{w[:k]}*": p for w, p in list(terms.items()) for k in STEMS if len(w) > k}
                out += [(w, toxic, p if toxic else "") for w, p in terms.items()]
            yield pd.DataFrame(out, columns=["term", "toxic", "context"])

    seen = rows.mapInPandas(words, "term string, toxic int, context string")
    toxic = F.col("toxic") == 1
    beside = seen.groupBy("term", "context").agg(F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"))
    per = beside.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("contexts"))
    total = per.filter("term = ''").first()
    if total is None or not total["a"]:
        return Lexicon({})
    n, m = total["a"], max(total["b"], 1)
    odds = (F.col("a") + 0.5) / F.lit(n + 1.0) / ((F.col("b") + 0.5) / F.lit(m + 1.0))
    often = (F.col("a") >= MIN_DOCS) & (F.col("contexts") >= F.greatest(F.lit(float(MIN_CONTEXTS)), F.pow("a", F.lit(0.7))))
    strong = per.filter((F.col("term") != "") & often).withColumn("odds", odds)
    lexicon = Lexicon({row["term"]: math.log(row["odds"]) for row in strong.filter(F.col("odds") >= MIN_ODDS).orderBy("term").collect()})

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            out = []
            for text, toxic in zip(batch.text, batch.toxic, strict=True):
                hits = lexicon.hits(fold(text))
                out += [(p, toxic) for p in {f"{a} {t}" for t, a, _ in hits if a} | {f"{t} {b}" for t, _, b in hits if b}]
            yield pd.DataFrame(out, columns=["phrase", "toxic"]).astype({"toxic": "int32"})

    counted = rows.mapInPandas(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"))
    clean = counted.filter((F.col("b") >= 3) & (F.col("b") / F.lit(float(m)) > F.col("a") / F.lit(float(n))))
    lexicon.exceptions = frozenset(row["phrase"] for row in clean.collect())

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame({"weight": [lexicon.weight(t) for t in batch.text], "toxic": batch.toxic.to_numpy()})

    points = rows.mapInPandas(weighed, "weight double, toxic int").collect()  # at most 2 * sample rows
    lexicon.half = half_way(np.array([p["weight"] for p in points]), np.array([p["toxic"] for p in points]))
    return lexicon


def half_way(weight: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with most right answers, in the middle of its gap; always above 0."""
    order = np.argsort(weight, kind="stable")
    w, t = weight[order], toxic[order]
    # Cut k: the first k are called clean.
    right = np.concatenate(([0], np.cumsum(1 - t))) + np.concatenate((np.cumsum(t[::-1])[::-1], [0]))
    can = np.concatenate(([True], w[1:] > w[:-1], [True]))
    k = int(np.argmax(np.where(can, right, -1)))
    low = w[k - 1] if k else 0.0
    high = w[k] if k < len(w) else low * 2 + 1.0
    return max(float(low + high) / 2, 1e-6)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document doc_id and score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": [lexicon.score(t) for t in batch.text]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score lies below ``limit``, with all their columns."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([lexicon.score(t) for t in batch])

    return docs.filter(score(F.col("text")) < limit)
