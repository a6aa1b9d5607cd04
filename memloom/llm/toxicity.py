"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presence of word unigrams, of words' first 4 to 7 bytes (their stems, as
insults are inflected and compounded), of bigrams and of one-word skip-grams, hashed into
2 ** BITS buckets; a bucket counts once LEAST training rows have it. Training runs on the driver over a bounded sample of labelled rows (at
most ``max_rows``, those of least hash of their doc_id, so the same at any partitioning);
per-coordinate rates and L1 leave a few thousand weights, which travel to the executors
with the scoring function. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import arrow_map, release_memory
from memloom.llm.words import U64, mix, split_words

BITS = 20
STEMS = (4, 5, 6, 7)
#: Training rows that must have a bucket before it gets a weight: n-grams seen once only fit noise.
LEAST = 3
_MULTIPLIERS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Weights(NamedTuple):
    """The non-zero weights by bucket, ascending, and the intercept. Without training data there are none and the score is 0."""

    buckets: np.ndarray
    values: np.ndarray
    intercept: float
    trained: bool


def _features(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For blocks of rows: the rows, and the document (in the block) and bucket of each occurrence of a feature."""
    down = U64(64 - BITS)
    for words in split_words(column, lower=True, alnum=True):
        h = words.hashes
        doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        docs, found = [doc], [h >> down]
        for n in STEMS:
            at, stem = words.prefixes(n)
            docs.append(doc[at])
            found.append((stem ^ U64(n)) >> down)
        with np.errstate(over="ignore"):
            for gap, (a, b) in ((1, _MULTIPLIERS[:2]), (2, _MULTIPLIERS[2:])):
                same = doc[gap:] == doc[:-gap]
                docs.append(doc[gap:][same])
                found.append(mix(h[:-gap][same] * a + h[gap:][same] * b) >> down)
        yield words.rows, np.concatenate(docs), np.concatenate(found).astype(np.uint32)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 7.0, l2: float = 1.0, epochs: int = 8) -> Weights:
    """FTRL-proximal (McMahan et al. 2013) over rows of distinct buckets, in the order given."""
    if not len(rows):
        return Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0, False)
    seen = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows = [np.append(x[seen[x] >= LEAST], np.uint32(1 << BITS)) for x in rows]  # the last coordinate is the intercept

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(z[i]) <= l1] = 0
        return w

    for _ in range(epochs):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    used = np.flatnonzero(w[:-1])
    return Weights(used.astype(np.uint32), w[used].astype(np.float32), float(w[-1]), True)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        for rows, doc, bucket in _features(batch.column("text")):
            both = np.unique(doc.astype(np.int64) << 32 | bucket)
            edges = np.searchsorted(both >> 32, np.arange(rows.stop - rows.start + 1))
            own = (both & 0xFFFFFFFF).astype("<u4")
            out += [own[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], ["doc_id", "toxic", "buckets"])


def training_rows(docs: DataFrame, labels: DataFrame, held_out: F.Column, max_rows: int) -> DataFrame:
    """(doc_id, toxic, text) of at most max_rows labelled documents that aren't held out.

    Labels of a doc_id that repeats count as toxic if one is; null labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")  # max_rows small rows


def train(docs: DataFrame, labels: DataFrame, *, held_out: F.Column, max_rows: int = 6000) -> Weights:
    rows = training_rows(docs, labels, held_out, max_rows).select("doc_id", "toxic", "text").transform(arrow_map, _buckets, "doc_id long, toxic int, buckets binary").toArrow()
    order = np.lexsort((rows["doc_id"].to_numpy(), mix(rows["doc_id"].to_numpy().astype(np.int64).view(U64)))) if len(rows) else []
    buckets = rows["buckets"].to_pylist()
    found = fit_ftrl([np.frombuffer(buckets[i], "<u4") for i in order], rows["toxic"].to_numpy()[order] if len(rows) else np.zeros(0))
    del rows, buckets
    release_memory()
    return found


def _scores(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    table = np.zeros(1 << BITS, np.float32)
    table[weights.buckets] = weights.values
    for batch in batches:
        total = np.full(batch.num_rows, weights.intercept)
        for rows, doc, bucket in _features(batch.column("text")):
            hit = np.flatnonzero(table[bucket])  # most buckets weigh nothing
            both = np.unique(doc[hit].astype(np.int64) << 32 | bucket[hit])  # presence, not counts
            total[rows] += np.bincount(both >> 32, table[both & 0xFFFFFFFF], rows.stop - rows.start)
        yield batch, 1 / (1 + np.exp(-np.clip(total, -35, 35))) if weights.trained else np.zeros(batch.num_rows)


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score double, predicted int) for each row; null and empty texts get the intercept's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scores(batches, weights):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.transform(arrow_map, run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, weights: Weights) -> DataFrame:
    """The rows of docs, all columns, whose score is under 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scores(batches, weights):
            yield batch.filter(pa.array(found < 0.5))

    return docs.transform(arrow_map, run, docs.schema)


def held_out_rows(fold: int, of: int) -> F.Column:
    """crc32 of the doc_id as text, modulo of, is fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))
