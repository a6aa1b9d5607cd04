"""Quality by co-training a text-content and a page-metadata classifier.

Both are logistic regressions over a few dozen numbers of a document: the content view sees
character classes, word shapes and repetition, the metadata view the language, the source,
the declared size and the page's shape (lines and their lengths). Starting from a bounded
labelled sample, each round scores every document with both views in one scan, takes the
documents on which one view is most sure (at most ``grow`` for each view, in the classes'
proportion, chosen over all documents) and hands them to the other view as pseudo-labels.
What has been handed over leaves the pool; documents on which the views are sure of
opposite labels are handed to neither. A view is sure of a label if its odds are LIFT times
those of the labelled sample, so a view of little power still hands over both labels. At last each view is
calibrated on labelled rows that trained neither, and a logistic combination of the two
calibrated views scores all documents.

The numbers of all documents are computed once and kept as a table in the shared folder;
only labelled samples and chosen rows, all bounded by parameters, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import arrow_map, drop, materialize
from memloom.llm.words import U64, mix, split_words

LANGS, SOURCES = 16, 32
_CLASSES = np.full(256, 11, np.uint8)  # other ASCII
for _k, _bytes in enumerate([range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t", b"\n\r", range(0x80, 0x100), b".", b",;:", b"|", b"!?", b"%#$*&@^~"]):
    _CLASSES[[*_bytes]] = _k
N_CLASSES = 12
CONTENT, META = 3 * N_CLASSES + 5, LANGS + SOURCES + 6
_VIEWS = "doc_id long, content binary, meta binary"


def _hashed(column: pa.Array, size: int) -> np.ndarray:
    """One-hot by hash, a row each; null is a value of its own."""
    out = np.zeros((len(column), size), np.float32)
    words = pa.array([f"={x}" if x is not None else "null" for x in column.to_pylist()])
    at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in words.to_pylist()])])
    data = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8).astype(U64)
    with np.errstate(over="ignore"):
        place = np.arange(len(data), dtype=U64) - np.repeat(at[:-1], np.diff(at)).astype(U64)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(data * U64(257) + place))])
        out[np.arange(len(column)), (mix(sums[at[1:]] - sums[at[:-1]]) % U64(size)).astype(int)] = 1
    return out


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two views of each document."""
    for batch in batches:
        content = np.zeros((batch.num_rows, CONTENT), np.float32)
        shape = np.zeros((batch.num_rows, 4), np.float32)
        for w in split_words(batch.column("text"), lower=False):
            n = w.rows.stop - w.rows.start
            size, words = np.diff(w.edges), np.diff(w.first)
            doc = np.repeat(np.arange(n), words)
            kinds = lambda docs, data: np.bincount(docs * N_CLASSES + _CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
            of_bytes = kinds(np.repeat(np.arange(n), size), w.data)
            first, last = kinds(doc, w.data[w.starts]), kinds(doc, w.data[w.ends - 1])
            again = np.bincount(doc[1:][(w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
            order = np.lexsort((w.hashes, doc))
            new = np.ones(len(order), bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (w.hashes[order][1:] != w.hashes[order][:-1])
            distinct = np.bincount(doc[order][new], minlength=n)
            per_word = 1 / np.maximum(words, 1)
            content[w.rows] = np.column_stack([of_bytes / np.maximum(size, 1)[:, None], first * per_word[:, None], last * per_word[:, None], size * per_word / 10, again * per_word, distinct * per_word, np.log1p(words) / 10, words == 0])
            lines = of_bytes[:, 4] + 1
            shape[w.rows] = np.column_stack([np.log1p(lines) / 5, np.log1p(size / lines) / 5, np.log1p(size) / 10, size == 0])
        declared = pa.array(batch.column("n_chars")).to_numpy(zero_copy_only=False).astype(np.float64)
        known = ~np.isnan(declared)
        meta = np.column_stack([_hashed(batch.column("lang"), LANGS), _hashed(batch.column("source"), SOURCES), shape, np.where(known, np.log1p(np.maximum(np.nan_to_num(declared), 0)) / 10, 0), known]).astype("<f4")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in content.astype("<f4")], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], ["doc_id", "content", "meta"])


class Linear(NamedTuple):
    weights: np.ndarray  # the last is the intercept

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> Linear:
    """Ridge logistic regression by Newton's method, on standardised columns."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()))


class Model(NamedTuple):
    """Both views, their calibrations (slope, intercept) and the weights of the calibrated views and a constant; untrained: all kept."""

    views: tuple[Linear, Linear]
    calibration: tuple[Linear, Linear]
    combination: Linear

    def probabilities(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [c.logits(v.logits(x)[:, None]) for v, c, x in zip(self.views, self.calibration, (content, meta), strict=True)]
        both = self.combination.logits(np.column_stack(own))
        return tuple(1 / (1 + np.exp(-x)) for x in (*own, both))


UNTRAINED = Model((Linear(np.zeros(CONTENT + 1)), Linear(np.zeros(META + 1))), (Linear(np.zeros(2)), Linear(np.zeros(2))), Linear(np.zeros(3)))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width).astype(np.float64)


def document_views(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars, ...) -> the numbers of both views, as a table in the shared folder."""
    own = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "double"))))
    return materialize(own.transform(arrow_map, _views, _VIEWS), "views")


class Round(NamedTuple):
    """The documents that each (view, label) hands to the other view, by doc_id."""

    handed: dict[tuple[int, int], list[int]]


def _top(rows: pa.Table, most: int) -> pa.Table:
    """The surest rows; of equally sure ones those of the smallest doc_id."""
    order = np.lexsort((rows["doc_id"].to_numpy(), -rows["sure"].to_numpy()))[:most]
    return rows.take(pa.array(order))


def _surest(pool: DataFrame, models: tuple[Linear, Linear], most: dict[tuple[int, int], int], least: dict[int, float], gone: np.ndarray) -> dict[tuple[int, int], pa.Table]:
    """For each view and label the documents of all on which the view is surest, in one scan; gone: ids that have left the pool."""
    keys = sorted(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], pa.Table] = {}  # each task's surest: most rows of each list
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column("doc_id").to_numpy(), gone)))
            for view, label in keys:
                logit = models[view].logits(_matrix(batch.column("meta" if view else "content"), META if view else CONTENT))
                sure = logit if label else -logit
                some = np.flatnonzero(sure > least[label])
                rows = pa.Table.from_batches([batch.take(pa.array(some))]).append_column("sure", pa.array(sure[some]))
                held[view, label] = _top(pa.concat_tables([held[view, label], rows]) if (view, label) in held else rows, most[view, label])
        for (view, label), rows in held.items():
            rows = rows.combine_chunks()
            for part in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([view] * len(part), pa.int32()), pa.array([label] * len(part), pa.int32()), *part.columns], ["view", "label", *part.schema.names])

    found = materialize(pool.transform(arrow_map, run, f"view int, label int, {_VIEWS}, sure double"), "surest")
    out = {}
    for view, label in keys:
        rows = found.where(f"view = {view} and label = {label}").orderBy(F.desc("sure"), "doc_id").limit(most[view, label])
        out[view, label] = rows.select("doc_id", "content", "meta").toArrow()
    drop(found)
    return out


#: How much a view's odds of a label must exceed the labelled sample's.
LIFT = 3.0


def co_train(views: DataFrame, labels: DataFrame, *, held_out: F.Column, max_rows: int = 8000, rounds: int = 3, grow: int = 500, history: list[Round] | None = None) -> Model:
    """labels (doc_id, quality, ...): at most max_rows of them, those of least hash of doc_id, and none that is held out.

    Labels that repeat a doc_id count as good only if all are; null labels are left out.
    Labels of one kind alone, or fewer than eight, give an untrained model. What the views
    hand over in each round is added to history, if given.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality is not null").where(~held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = views.join(F.broadcast(sample), "doc_id").orderBy("doc_id").toArrow()  # max_rows small rows
    y = rows["quality"].to_numpy().astype(float)
    if len(y) < 8 or y.min() == y.max():
        return UNTRAINED
    x = [_matrix(rows["content"], CONTENT), _matrix(rows["meta"], META)]
    ids = rows["doc_id"].to_numpy()
    apart = mix(ids.astype(np.int64).view(U64)) % U64(4) == 0  # for calibration
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    train = [[(m[~apart], y[~apart])] for m in x]
    fit = lambda: tuple(fit_logistic(*map(np.concatenate, zip(*t, strict=True))) for t in train)
    models = fit()
    if rounds > 0:
        pool = materialize(views.where("doc_id is not null").join(known.select("doc_id"), "doc_id", "left_anti"), "pool")
    rates = {1: y.mean(), 0: 1 - y.mean()}
    most = {(view, label): max(1, int(grow * rates[label])) for view in (0, 1) for label in (0, 1)}
    least = {label: float(np.log(LIFT * rates[label] / rates[1 - label])) for label in (0, 1)}
    gone = np.zeros(0, np.int64)  # at most 2 * grow + 2 for each round
    for _ in range(rounds):
        found = _surest(pool, models, most, least, gone)
        chosen = {key: rows["doc_id"].to_numpy() for key, rows in found.items()}
        torn = np.concatenate([np.intersect1d(chosen[0, 1 - label], chosen[1, label]) for label in (0, 1)])
        handed: dict[tuple[int, int], list[int]] = {}
        for (view, label), rows in found.items():
            keep = ~np.isin(chosen[view, label], torn)
            handed[view, label] = chosen[view, label][keep].tolist()
            if keep.any():
                rows = rows.filter(pa.array(keep))
                train[1 - view].append((_matrix(rows["content"] if view else rows["meta"], CONTENT if view else META), np.full(len(rows), float(label))))
        gone = np.union1d(gone, np.concatenate([np.array(x, np.int64) for x in handed.values()]))
        if history is not None:
            history.append(Round(handed))
        models = fit()
    if rounds > 0:
        drop(pool)
    at = apart if apart.any() else np.ones(len(y), bool)
    logits = [m.logits(v[at]) for m, v in zip(models, x, strict=True)]
    calibration = tuple(fit_logistic(z[:, None], y[at]) for z in logits)
    combination = fit_logistic(np.column_stack([c.logits(z[:, None]) for c, z in zip(calibration, logits, strict=True)]), y[at])
    return Model(models, calibration, combination)


def score_quality(views: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_score, meta_score, score, predicted) for each row; the scores are calibrated probabilities of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, both = model.probabilities(_matrix(batch.column("content"), CONTENT), _matrix(batch.column("meta"), META))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text), pa.array(meta), pa.array(both), pa.array((both >= 0.5).astype(np.int32))], ["doc_id", "text_score", "meta_score", "score", "predicted"])

    return views.transform(arrow_map, run, "doc_id long, text_score double, meta_score double, score double, predicted int")
