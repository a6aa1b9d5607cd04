"""Word pieces, text embeddings and re-embedding of stored drawers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION, MOST_TOKENS, LONGEST_WORD = 384, 256, 100
MODEL_TAG = "hashing-384"
#: Rows whose embeddings a worker holds at a time.
SLICE = 1024
#: Blocks of ideographs that are words of their own.
IDEOGRAPHS = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]


def load_vocabulary(path: str | Path) -> dict[str, int]:
    """A token on each line; its number is its id."""
    lines = Path(path).read_text(encoding="utf-8").split("\n")
    return {t.rstrip("\r"): i for i, t in enumerate(lines) if t.rstrip("\r")}


def _is_control(c: str) -> bool:
    return c not in "\t\n\r" and (ord(c) < 0x20 or 0x7F <= ord(c) <= 0x9F)


def _is_mark(c: str) -> bool:
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c)[0] in "PS"


def basic_words(text: str) -> list[str]:
    """Lower-cased words without accents; punctuation marks and ideographs are words of their own."""
    spaced = []
    for c in text:
        if ord(c) in (0, 0xFFFD) or _is_control(c):
            continue
        spaced.append(" " if c.isspace() else f" {c} " if any(a <= ord(c) <= b for a, b in IDEOGRAPHS) else c)
    out = []
    for word in "".join(spaced).lower().split():
        plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", word))
        start = True
        for c in plain:
            if _is_mark(c):
                out.append(c)
                start = True
            elif start:
                out.append(c)
                start = False
            else:
                out[-1] += c
    return out


def word_pieces(word: str, vocabulary: Mapping[str, int]) -> list[str]:
    """The longest pieces from the left, those after the first marked with ##; [UNK] if one is missing."""
    if len(word) > LONGEST_WORD:
        return ["[UNK]"]
    out, start = [], 0
    while start < len(word):
        end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocabulary), None)
        if end is None:
            return ["[UNK]"]
        out.append(("##" if start else "") + word[start:end])
        start = end
    return out


def encode(text: str, vocabulary: Mapping[str, int]) -> list[int]:
    """Ids between [CLS] and [SEP], cut to MOST_TOKENS in all."""
    pieces = [p for w in basic_words(text) for p in word_pieces(w, vocabulary)][: MOST_TOKENS - 2]
    return [vocabulary["[CLS]"], *(vocabulary.get(p, vocabulary["[UNK]"]) for p in pieces), vocabulary["[SEP]"]]


def encode_batch(texts: list[str], vocabulary: Mapping[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids padded to the longest text, and the mask of real tokens."""
    rows = [encode(t, vocabulary) for t in texts]
    width = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), width), vocabulary.get("[PAD]", 0), np.int64), np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)], mask[i, : len(r)] = r, 1
    return ids, mask


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the real tokens' vectors, as unit vectors."""
    m = mask[:, :, None].astype(np.float64)
    mean = (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


class Embedder(Protocol):
    tag: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic stand-in for a trained model: signed hashes of words and word pairs, as unit vectors."""

    tag = MODEL_TAG

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), DIMENSION), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = basic_words(text)
            for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = xxhash.xxh64_intdigest(feature)
                row[h % DIMENSION] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class OnnxEmbedder:
    """A transformer's mean-pooled states; model and vocabulary files are the caller's."""

    def __init__(self, model_path: str, vocabulary_path: str, tag: str) -> None:
        self.model_path, self.vocabulary_path, self.tag = model_path, vocabulary_path, tag
        self._session = None

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.model_path, providers=["CPUExecutionProvider"])
            self._vocabulary = load_vocabulary(self.vocabulary_path)
        ids, mask = encode_batch(texts, self._vocabulary)
        states = self._session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0]
        return mean_pool(states, mask).astype(np.float32)


def embed_column(df: DataFrame, text: str, embedder: Embedder, *, batch: int = 32) -> DataFrame:
    """df with a column embedding; null texts get none. The embedder loads once for each worker's batch stream.

    A worker holds one batch of texts and the vectors of SLICE rows, however many rows there are.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            texts = rows.column(text).to_pylist()
            some = [t for t in texts if t is not None]
            vectors = [embedder.embed(some[i : i + batch]) for i in range(0, len(some), batch)]
            flat = np.concatenate(vectors).astype(np.float32, copy=False) if some else np.empty((0, 0), np.float32)
            none = np.array([t is None for t in texts], bool)
            ends = np.cumsum(np.where(none, 0, flat.shape[1]), dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), pa.array(flat.ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([*rows.columns, column], [*rows.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def to_migrate(drawers: DataFrame, tag: str, *, resume: bool) -> DataFrame:
    """Drawers that need a new embedding: they have text and, when resuming, not the model's tag."""
    todo = drawers.where(F.coalesce(F.col("content") != "", F.lit(False)))
    return todo.where(~F.col("embedding_model").eqNullSafe(F.lit(tag))) if resume else todo


def migrate(drawers: DataFrame, embedder: Embedder, *, now: str, resume: bool = False) -> DataFrame:
    """All drawers, those to migrate with a new embedding and stamped with the model's tag and the time."""
    todo = to_migrate(drawers, embedder.tag, resume=resume).select("drawer_id", F.col("content").alias("_text"))
    fresh = embed_column(todo, "_text", embedder).select("drawer_id", F.col("embedding").alias("_new"))
    joined = drawers.join(fresh, "drawer_id", "left")
    new = F.col("_new").isNotNull()
    stamps = {"embedding": F.coalesce("_new", "embedding"), "embedding_model": F.when(new, embedder.tag).otherwise(F.col("embedding_model")), "embedded_at": F.when(new, now).otherwise(F.col("embedded_at"))}
    return joined.withColumns(stamps).drop("_new")


def migration_counts(drawers: DataFrame, tag: str, *, resume: bool) -> DataFrame:
    """One row: processed, updated, skipped and total. Drawers without text are processed, but neither of the others."""
    has = F.coalesce(F.col("content") != "", F.lit(False))
    done = F.col("embedding_model").eqNullSafe(F.lit(tag)) if resume else F.lit(False)
    return drawers.agg(F.count("*").alias("processed"), F.count_if(has & ~done).alias("updated"), F.count_if(has & done).alias("skipped"), F.count("*").alias("total"))
