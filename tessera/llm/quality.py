"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

A text's features are its word and mark tokens and their pairs, hashed into
``2**bits`` slots and weighted by relative frequency, so long and short texts
share one scale.  Training reads a bounded sample of labelled rows in a single
task; scoring is one sparse dot product a text, summed with numpy over a whole
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._io import fresh

BITS = 18
#: Defaults of ``fit``'s bounds: most labelled texts, and most UTF-8 bytes of text, that its one task reads.
FIT_ROWS, FIT_BYTES = 6000, 24 << 20
THRESHOLD = 0.3
#: Updates that a fit aims at.
UPDATES = 24_000
#: A relative frequency times this is a feature's value.
SCALE = 64.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """Slots of all tokens and token pairs, their values, and bounds per text."""
    h, bounds = _text.tokens(data, offsets, fold=False, marks=True)
    shift = np.uint64(64 - bits)
    n = np.diff(bounds)
    pair = _text.mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15)) if len(h) > 1 else h[:0]
    slots = np.empty(2 * len(h), np.int64)
    slots[0::2] = (h >> shift).astype(np.int64)
    slots[1::2][: len(pair)] = (pair >> shift).astype(np.int64)
    real = np.ones(2 * len(h), bool)
    real[2 * bounds[1:][n > 0] - 1] = False  # no pair across texts
    value = np.repeat(SCALE / np.maximum(2 * n - 1, 1), 2 * n)
    value[~real] = 0.0
    if len(h):
        slots[~real] = 0
    return slots, value, 2 * bounds


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, *, bits: int = BITS, epochs: int | None = None, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> Model:
    """FTRL-proximal passes over the rows in the order given: 3, or more over few rows."""
    epochs = epochs or min(20, max(3, UPDATES // max(1, len(labels))))
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rows = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        slots, value, _ = features(data[a:b], np.array([0, b - a], np.int64), bits)
        i, back = np.unique(slots, return_inverse=True)
        rows.append((np.append(i, size).astype(np.int32), np.append(np.bincount(back, value, len(i)), 1.0).astype(np.float32)))
    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weight(i)
            g = (sigmoid(w @ x) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]), bits)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts' scores; each is summed by itself, so that equal texts score the same in any company."""
    slots, value, bounds = features(data, offsets, model.bits)
    total = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        total[some] = np.add.reduceat(model.weights[slots] * value, bounds[:-1][some])
    return sigmoid(total + model.bias)


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids that no fit reads; false for null ids, which none reads either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """Fit on at most ``rows`` labelled texts that aren't held out, of ``most_bytes`` UTF-8 bytes together.

    Rows are taken in the order of a hash of the id, so the choice and the
    order of learning depend on neither order nor partitions; a text that
    would go beyond ``most_bytes`` is passed over and the next one tried.  Null
    ids, labels and texts are left out, and an id labelled twice takes its
    greatest label; where nothing is labelled, the model says 0.5 for every
    text.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most ``rows`` pairs of numbers: bounded, so sent to all
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.col("_t").isNotNull())
    texts = read.join(F.broadcast(chosen), "_id").select("_id", "_t", "_y")

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[str, int]] = []
        used = 0
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(t.encode())
                if used + size <= most_bytes:
                    used += size
                    kept.append((t, y))
        if not kept or len({y > 0 for _, y in kept}) < 2:
            share = 0.5 if not kept else min(max(np.mean([y > 0 for _, y in kept]), 0.01), 0.99)
            model = Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
        else:
            model = train(*_text.buffers(pa.array([t for t, _ in kept], pa.large_string())), np.array([y > 0 for _, y in kept], float))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["w", "b"])

    row = texts.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "_t").select("_t", "_y").mapInArrow(run, "w binary, b double").first()
    if row is None:  # nothing labelled, so no task had rows
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(row.w, np.float32), row.b)


def score(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``, 0 to 1.  Null texts count as empty, which have the bias's score; a column of that name is replaced.

    The text itself stays in ``df``'s own columns; select what you need before.
    """
    df = df.drop(score_col)
    at = df.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)  # 4 * 2**bits bytes

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _text.slices(b, at)):
            got = scores(sent.value, *_text.buffers(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, score_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: every document's held-out mark, score and prediction.

    Null and empty texts have the bias's score; equal texts score the same;
    repeated rows give one row each; extra columns are left out.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(docs, labels)

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _text.slices(b, 1)):
            got = scores(sent.value, *_text.buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = texts.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches ``threshold``; rejected rows go."""
    model = fit(docs, labels)
    name = fresh("_score", docs.columns)
    return score(docs, model, score_col=name).where(F.col(name) >= threshold).drop(name)
