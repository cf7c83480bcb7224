"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates.

Features of a text are hashed n-grams of its words (1 and 2 words) and of its words' shapes (1 to 3): the classes of a
word's first two and last two bytes and whether it repeats the word before. Each is an index into 2**BITS weights; the
value of a feature is its share of the text's n-grams times SCALE. A score is the sparse dot product with the weights
through the logistic function, so texts of any length are scored whole.

Training reads at most ``max_rows`` labelled ids, those with the smallest hash of their doc_id, and of these as many as have ``MAX_BYTES``
of text together, whole texts only and repeated rows included; that bound is the only sample. Updates run in that order, so that the
model depends on the rows alone. Other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textnum
from gridloom.llm.common import slices, small_arrow_batches, text_bytes

BITS = 20
SCALE = 20.0
MAX_ROWS, MAX_BYTES = 4000, 64 << 20
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0x41, 0x61, 0x30, 0x80


def _grams(words: textnum.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature of each n-gram, index of its first word) for each kind of n-gram."""
    h, text = words.hashes(), words.text_of()
    c = _CLASS[words.buf]
    last = words.ends - 1
    repeated = np.zeros(len(h), dtype=np.uint64)
    repeated[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    second, before_last = np.minimum(words.starts + 1, last), np.maximum(last - 1, words.starts)
    shape = c[words.starts] | c[second] << np.uint64(8) | c[last] << np.uint64(16) | c[before_last] << np.uint64(24) | repeated << np.uint64(32)
    out = []
    for kind, (base, k) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3))):
        g = textnum.windows(base, k) + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)
        inside = np.flatnonzero(text[: len(g)] == text[k - 1 : k - 1 + len(g)])
        out.append(((textnum.mix(g)[inside] >> np.uint64(64 - BITS)).astype(np.int64), inside))
    return out


def _train_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        index, value = [], []
        for text in texts:
            grams = np.concatenate([g for g, _ in _grams(textnum.Words([text], textnum.SPACE))])
            i, n = np.unique(grams, return_counts=True)
            index.append(i.astype(np.uint32).tobytes())
            value.append((n * (SCALE / max(len(grams), 1))).astype(np.float32).tobytes())
        yield pa.record_batch([batch.column("at"), batch.column("label"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["at", "label", "i", "x"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05, epochs: int = 6) -> tuple[np.ndarray, float]:
    """Weights and intercept after FTRL-proximal updates over rows of (indices, values, label)."""
    size = (1 << BITS) + 1  # the last is the intercept
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, size - 1).astype(np.int64), np.append(value, 1.0).astype(np.float64)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i], n[i] = zi + g - step * wi, ni + g * g
    used = np.abs(z) > l1
    w[used] = (np.sign(z[used]) * l1 - z[used]) / ((beta + np.sqrt(n[used])) / alpha + l2)
    return w[:-1].astype(np.float32), float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Fit on labelled documents outside the held-out fold.

    A doc_id with several labels counts once, as 1 if half of them or more are 1; null labels and ids don't count. If
    no labelled row is left, all weights are 0 and every score is 0.5.
    """
    small_arrow_batches(documents.sparkSession)
    chosen = (
        labels.select("doc_id", F.col(label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .withColumn("at", F.xxhash64("doc_id"))
        .orderBy("at", "doc_id")
        .limit(max_rows)
    )
    chosen = documents.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # max_rows rows of three numbers
    sizes = documents.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("at", "doc_id").agg(F.sum("n").alias("n"))
    total, fits = 0, []
    for r in sorted(sizes.collect(), key=lambda r: (r["at"], r.doc_id)):
        total += r.n or 0
        if total > MAX_BYTES and fits:
            break
        fits.append(r["at"])
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen.filter(F.col("at") <= (fits[-1] if fits else 0))), "doc_id")
        .select("at", "label", "text")
        .mapInArrow(_train_features, "at long, label int, i binary, x binary")
        .collect()  # max_rows sparse vectors
    )
    rows.sort(key=lambda r: (r.at, r.i, r.x))
    return ftrl([(np.frombuffer(r.i, np.uint32), np.frombuffer(r.x, np.float32), r.label) for r in rows])


def score_texts(texts: list[bytes], weights: np.ndarray, intercept: float) -> np.ndarray:
    out = []
    for a, b in slices([len(t) for t in texts], 1 << 20):
        words = textnum.Words(texts[a:b], textnum.SPACE)
        total, n = np.zeros(b - a), np.zeros(b - a)
        for feature, first in _grams(words):
            of = np.searchsorted(words.first, first, side="right") - 1
            total += np.bincount(of, weights[feature], b - a)
            n += np.bincount(of, minlength=b - a)
        out.append(1 / (1 + np.exp(-np.clip(intercept + SCALE * total / np.maximum(n, 1), -35, 35))))
    return np.concatenate(out) if out else np.empty(0)


def with_score(documents: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """documents with a score from 0 to 1 for every row. Null and empty texts get the intercept's score.

    All columns stay; the score's column replaces one of the same name.
    """
    small_arrow_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c != column]
    weights, intercept = model
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(text_bytes(batch.column("text")), shared.value, intercept)
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, column])

    schema = documents.select(*kept).schema.add(column, "double")
    return documents.select(*kept).mapInArrow(run, schema)
