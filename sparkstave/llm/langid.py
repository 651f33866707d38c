"""Language identification by a byte convolutional network, trained here in numpy.

Bytes fold into a small alphabet (ASCII letters without case, digits, space, other ASCII, and every byte from 128 on by itself) and are embedded; filters of several widths slide over a
fixed-length window, the greatest response of each filter over the window is kept, and a softmax layer
names the language. A text is cut into such windows, all of it, and its score is
the mean of its windows' probabilities, weighted by their letters.

Training takes about PER_LANG texts (twice that at most) of each language, fewer where there are so many languages that these would be over MOST_ROWS,
drawn by hash, and PIECES pieces spread over each, so its cost doesn't grow with the table. At prediction time embedding and filters
fold into tables over byte pairs, so a window costs a few table reads per byte.

Defined results: a null text or one without any letter is ``und`` with score 0; with no usable label every
text is ``und``; rows with null or repeated ids are predicted like any other; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstave.llm.textkit import pieces

PER_LANG = 600
PIECES = 8
#: Bound on training texts over all languages (about 2 KB of pieces each), one text a language at least.
MOST_ROWS = 12_000
WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
STEPS = 500
BATCH = 64
RATE = 0.01
SEED = 7
UNKNOWN = "und"
SYMBOLS = 158


def _alphabet() -> np.ndarray:
    """Byte to symbol: letters without case, one symbol for digits and one for other ASCII, high bytes by themselves."""
    table = np.full(256, 1, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 2
    table[48:58] = 3
    for i in range(26):
        table[65 + i] = table[97 + i] = 4 + i
    high = np.arange(128, 256)
    table[high] = 30 + high - 128
    table[0] = 0
    return table


def text_windows(texts, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, owner): all windows of all texts, the last of each filled with zeros."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = -(-sizes // window)
    out = np.zeros(int(counts.sum()) * window, np.uint8)
    at = np.concatenate(([0], np.cumsum(counts) * window))[:-1] if len(raw) else []
    for begin, r in zip(at, raw, strict=True):
        out[begin : begin + len(r)] = np.frombuffer(r, np.uint8)
    return _alphabet()[out].reshape(-1, window), np.repeat(np.arange(len(raw)), counts)


class Network:
    """Embedding, filters by width, and the softmax layer."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embedding = rng.normal(0, 0.5, (SYMBOLS, EMBEDDING)).astype(np.float32)
        self.filters = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of one batch of windows."""
        rows = np.arange(len(x))
        embedded = self.embedding[x]
        kept, pooled = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            span = x.shape[1] - w + 1
            patches = np.concatenate([embedded[:, j : j + span] for j in range(w)], axis=2)
            response = patches @ f + b
            best = response.argmax(axis=1)
            value = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0]
            kept.append((patches, best, value))
            pooled.append(np.maximum(value, 0))
        z = np.concatenate(pooled, axis=1)
        logits = z @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[rows, y] + 1e-9).mean())
        d = p.copy()
        d[rows, y] -= 1
        d /= len(x)
        d_out, d_out_bias, dz = z.T @ d, d.sum(axis=0), d @ self.out.T
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_bias = [], []
        for i, (w, f, (patches, best, value)) in enumerate(zip(WIDTHS, self.filters, kept, strict=True)):
            g = dz[:, i * FILTERS : (i + 1) * FILTERS] * (value > 0)
            chosen = patches[rows[:, None], best]
            d_filters.append(np.einsum("nkd,nk->dk", chosen, g))
            d_bias.append(g.sum(axis=0))
            back = g[:, :, None] * f.T[None]
            for j in range(w):
                symbols = x[rows[:, None], best + j]
                np.add.at(d_embedding, symbols, back[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
        return loss, [d_embedding, *d_filters, *d_bias, d_out, d_out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam over random batches, the same ones every time; each label is drawn as often as any other."""
        order, first = np.argsort(y, kind="stable"), np.searchsorted(np.sort(y), np.unique(y))
        counts = np.diff(np.append(first, len(y)))
        rng = np.random.default_rng(seed)
        means = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        for step in range(1, steps + 1):
            label = rng.integers(0, len(first), BATCH)
            pick = order[first[label] + rng.integers(0, counts[label])]
            _, found = self.gradients(x[pick], y[pick])
            rate = RATE * (1 - step / (steps + 1))
            for p, g, (m, v) in zip(self.parameters(), found, means, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def folded(self) -> list[list[np.ndarray]]:
        """For each width, tables over symbol pairs (and one symbol if odd) whose sum is the response."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            single = [self.embedding @ f[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            single[0] = single[0] + b
            pairs = [(single[j][:, None] + single[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
            out.append([np.ascontiguousarray(t, np.float32) for t in pairs + ([single[-1]] if w % 2 else [])])
        return out

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]], block: int = 64) -> np.ndarray:
        """Softmax of each window."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for begin in range(0, len(x), block):
            part = x[begin : begin + block]
            pair = part[:, :-1].astype(np.int32) * SYMBOLS + part[:, 1:]
            pooled = []
            for w, own in zip(WIDTHS, tables, strict=True):
                span = part.shape[1] - w + 1
                response = own[0][pair[:, :span]]
                for k, t in enumerate(own[1:], 1):
                    response += t[pair[:, 2 * k : 2 * k + span]] if len(t) > SYMBOLS else t[part[:, 2 * k : 2 * k + span]]
                pooled.append(np.maximum(response.max(axis=1), 0))
            logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[begin : begin + block] = p / p.sum(axis=1, keepdims=True)
        return out


def training_rows(labelled: DataFrame, per_lang: int = PER_LANG) -> list:
    """(text, lang) of about ``per_lang`` rows of each language, drawn by least hash, in a fixed order.

    ``labelled`` has doc_id, text and lang and holds no held-out row. There are as many counts on the driver as languages.
    """
    rows = labelled.filter("lang is not null and text is not null")
    langs = rows.groupBy("lang").count().collect()
    if not langs:
        return []
    per_lang = max(1, min(per_lang, MOST_ROWS // (2 * len(langs))))
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    some = rows.withColumn("u", u).filter(F.col("u") < F.element_at(share, F.col("lang")))
    # The hash thins rows out where they are read; what is left is bounded by languages, not by the table.
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(PIECES - 1)),
        lambda i: F.substring("text", F.floor(i * F.length("text") / PIECES).cast("int") + 1, F.least(F.lit(WINDOW), F.ceil(F.length("text") / PIECES)).cast("int")),
    )
    few = some.select("u", "lang", F.array_join(pieces, " ").alias("text")).orderBy("u", "text").limit(2 * per_lang * len(langs))
    return few.collect()


def trained(labelled: DataFrame, per_lang: int = PER_LANG) -> Network | None:
    rows = training_rows(labelled, per_lang)
    if not rows:
        return None
    labels = sorted({r["lang"] for r in rows})
    x, owner = text_windows([r["text"] for r in rows])
    y = np.array([labels.index(r["lang"]) for r in rows])[owner]
    # Windows with next to no letters teach nothing.
    full = ((x >= 4).sum(axis=1) >= 8)
    network = Network(labels)
    if full.any():
        network.fit(x[full], y[full])
    return network


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """Per document doc_id, lang_pred and score. Only the text is looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if network is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        tables = model.folded()
        names = np.array([*model.labels, UNKNOWN], dtype=object)
        for batch in pieces(batches):
            x, owner = text_windows(batch.text.where(batch.lettered, None))
            p = model.probabilities(x, tables)
            weight = (x >= 4).sum(axis=1) + 1e-6
            mean = np.stack([np.bincount(owner, p[:, k] * weight, len(batch)) for k in range(len(model.labels))], axis=1)
            total = np.bincount(owner, weight, len(batch))
            lettered = batch.lettered.to_numpy(bool) & (total > 0)
            mean = mean / np.maximum(total, 1e-9)[:, None]
            best = np.where(lettered, mean.argmax(axis=1), len(model.labels))
            score = np.clip(np.where(lettered, mean.max(axis=1), 0.0), 0.0, 1.0)
            yield pd.DataFrame({"doc_id": batch.doc_id, "lang_pred": names[best], "score": score})

    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
