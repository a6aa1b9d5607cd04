"""Token-ID files: an independent zstandard frame for each document, a seek table at the end.

Layout, in the public zstd seekable format, so that any zstd reader also sees the plain
concatenation of all ids:

* one zstd frame for each document, in ascending doc_id order: its ids, little-endian
  unsigned, 2 bytes each if the vocabulary has at most 65,536 ids, else 4;
* a skippable frame (0x184D2A50): one byte with the bytes of an id, one byte for each
  document (1: its doc_id is null), then the doc_ids as little-endian 64-bit integers;
* a skippable frame (0x184D2A5E): the seek table, for each frame its compressed size, its
  decompressed size and the low 32 bits of the xxh64 of its content, then the number of
  frames, a descriptor byte (0x80: with checksums) and the magic number 0x8F92EAB1. The
  frame that holds the doc_ids has an entry with decompressed size 0.

A reader fetches the table, then only the byte ranges of the documents it wants.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import arrow_map, materialize, new_folder
from memloom.llm.tokens import tokenizer

_INDEX, _TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Documents that are tokenised, or read back, at a time.
BATCH = 1000


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TokenFileWriter:
    def __init__(self, out: pa.NativeFile, vocab_size: int) -> None:
        self.out, self.dtype = out, "<u2" if vocab_size <= 1 << 16 else "<u4"
        self.squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True)
        self.ids: list[int | None] = []
        self.entries: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        frame = self.squeeze.compress(raw)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def finish(self) -> None:
        null = bytes(x is None for x in self.ids)
        index = bytes([int(self.dtype[-1])]) + null + np.array([x or 0 for x in self.ids], "<i8").tobytes()
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
        entries = [*self.entries, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = np.array(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _TABLE, len(table)) + table)


class TokenFile:
    """Random access to one file; every frame read is held against its checksum."""

    def __init__(self, uri: str) -> None:
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{uri}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.table = table[:-1]
        index = self.file.read_at(int(table[-1, 0]) - 8, int(self.starts[n - 1]) + 8)
        self.dtype = f"<u{index[0]}"
        self.null = np.frombuffer(index[1:n], bool)
        self.doc_ids = np.frombuffer(index[n:], "<i8")
        self.lengths = self.table[:, 1].astype(np.int64) // int(self.dtype[-1])
        self.expand = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of the documents at places first to last - 1: one ranged read."""
        data = self.file.read_at(int(self.starts[last] - self.starts[first]), int(self.starts[first])) if last > first else b""
        out = []
        for i in range(first, last):
            at = int(self.starts[i] - self.starts[first])
            raw = self.expand.decompress(data[at : at + int(self.table[i, 0])])
            if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
                raise ValueError(f"frame {i} is damaged")
            out.append(np.frombuffer(raw, self.dtype))
        return out

    def get(self, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """Ids of the documents asked for alone; a doc_id that repeats has several."""
        found: dict[int, list[np.ndarray]] = {}
        for x in doc_ids:
            places = np.flatnonzero((self.doc_ids == x) & ~self.null)
            found[x] = [self.read(int(i), int(i) + 1)[0] for i in places]
        return found

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, *, kind: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Tokenise every whole text of docs (doc_id, text, ...) and write files in ascending doc_id order.

    Each document's ids end with end_id; a null or empty text has that id alone. Null
    doc_ids come first. Documents that repeat a doc_id stay, in order of their texts.
    Returns a row for each file: (shard int, path string, n_docs long, n_tokens long,
    start long: ids in the files before it). An empty table gives no rows. Files are
    written under another name and then renamed, so a task that is lost or run twice
    leaves the same whole file.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    where, path = _filesystem(folder)
    where.create_dir(path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}.zst"
        fs, at = _filesystem(name)
        part, n_tokens, writer, out = f"{at}.{task.taskAttemptId()}", 0, None, None
        own = tokenizer(tokenizer_path, kind)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                rows = batch.slice(i, BATCH)
                if writer is None and rows.num_rows:
                    out = fs.open_output_stream(part)
                    writer = TokenFileWriter(out, max(own.vocab_size, end_id + 1))
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), own.encode(rows.column("text").to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    writer.add(doc_id, ids)
                    n_tokens += len(ids)
        if writer:
            writer.finish()
            out.close()
            fs.move(part, at)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [name], "n_docs": [len(writer.ids)], "n_tokens": [n_tokens]})

    files = materialize(ordered.transform(arrow_map, write, "shard int, path string, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """files from write_token_files() -> (doc_id, start long, n_tokens long, ids_crc32 long) for each document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = TokenFile(path)
                starts = start + np.concatenate([[0], np.cumsum(file.lengths)])[:-1]
                for i in range(0, len(file), BATCH):
                    j = min(i + BATCH, len(file))
                    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in file.read(i, j)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[i:j], mask=file.null[i:j]), pa.array(starts[i:j].astype(np.int64)), pa.array(file.lengths[i:j]), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    n = max(1, files.sparkSession.sparkContext.defaultParallelism, files.count())
    return files.select("path", "start").repartition(n).transform(arrow_map, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
