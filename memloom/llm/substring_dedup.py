"""Removal of repeated word passages with suffix automata of reference shards.

A passage is any window of ``window`` words that also starts earlier in the corpus. Sending
every automaton to every document would cost shards x corpus, so each shard is sent only to
the stretches of documents that can match it: every window is filed under its minimiser
(the least hash among its ``anchor``-word shingles), so equal windows have equal anchors.
Consecutive windows with one anchor form a stretch of at most 2 * window - anchor words.

1. ``_stretches``: a row for each stretch (anchor, place). Stretches of equal content hash
   within one batch meet in an automaton there, so a hot passage leaves one row for each batch.
2. ``_settle``: the shard of an anchor. An anchor of one stretch has no repeats; the words of
   all other stretches are needed. Anchors of more than ``hot`` stretches would be one task's
   work: their windows are dealt one by one, each to the shard of its own hash, where equal
   windows still meet.
3. ``_match``: a suffix automaton for each anchor's reference stretches, grown in corpus
   order while the later stretches stream through it: the matching statistic of each word
   tells whether the window that ends there started earlier.
4. ``_cut``: all covered spans meet their document once, and the words outside are kept.

Hashes only choose what meets; automata decide every window that is removed. Those of a
batch compare words by their 64-bit hashes, those of shards the words themselves.

Everything is one lazy plan: nothing is collected, and lost executors are recomputed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import arrow_map
from memloom.llm.words import U64, mix, shingles, split_words

_PLACE = U64((1 << 28) - 1)
_STRETCH = "part long, doc_id long, at long, settled boolean"  # at: start << 32 | number of windows; settled: a covered span already


class SuffixAutomaton:
    """Generalised suffix automaton, grown online over several sequences; first: where each state was first seen to end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [0]

    def _grow(self, sequence: list, place: int) -> list[int]:
        """Add a sequence whose words stand at place, place + 1, ...; for each, the state of the longest match ending there that also ends earlier, in it or in those before."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last, out = 0, []
        for at, c in enumerate(sequence, place):
            if (q := nxt[last].get(c)) is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                out.append(last)
                continue
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(at)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            out.append(link[cur])
            last = cur
        return out

    def _clone(self, p: int, c: object, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(self.length)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def grow(self, sequence: list, place: int = 0) -> list[int]:
        """Add a sequence; for each word, the matching statistic: the length of the longest match ending there that also ends earlier."""
        return [self.length[s] for s in self._grow(sequence, place)]

    def repeats(self, sequence: list, place: int, window: int) -> list[int]:
        """Add a sequence; the starts of its windows whose words were first seen at a smaller place."""
        link, length, out = self.link, self.length, []
        for j, state in enumerate(self._grow(sequence, place)):
            if length[state] >= window:
                while length[link[state]] >= window:
                    state = link[state]
                if self.first[state] < place + j:
                    out.append(j - window + 1)
        return out


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)


def _place(doc_id: int, start: int) -> int:
    """Places of words in corpus order."""
    return (doc_id << 40) + start


def _rows(part: np.ndarray, doc_id: np.ndarray, at: np.ndarray, *, settled: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(doc_id), pa.array(at), pa.array(np.full(len(part), settled))], ["part", "doc_id", "at", "settled"])


def _merged(doc_id: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that follow one another become one."""
    if not len(at):
        return doc_id, at
    order = np.lexsort((at, doc_id))
    doc_id, start, n = doc_id[order], at[order] >> 32, at[order] & 0xFFFFFFFF
    new = np.concatenate([[True], (doc_id[1:] != doc_id[:-1]) | (start[1:] > start[:-1] + n[:-1])])
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(start + n, first)
    return doc_id[first], (start[first] << 32) | (stop - start[first])


def _stretches(window: int, anchor: int):
    width = window - anchor + 1

    def find(words, doc_ids: np.ndarray) -> tuple[np.ndarray, ...] | None:
        h, n = words.hashes, len(words.hashes) - window + 1
        if n <= 0:
            return None
        grams = shingles(h, anchor)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: n], least[width - reach :][:n])
        place = (least & _PLACE).astype(np.int64)
        doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[:n]
        good = np.arange(n) + window <= words.first[doc + 1]
        at = np.flatnonzero(good)
        if not len(at):
            return None
        heads = at[_runs(place[at])]
        tails = np.append(at[_runs(place[at])[1:] - 1], at[-1])
        whole = shingles(h, window)
        count = tails - heads + 1
        with np.errstate(over="ignore"):
            content = mix(whole[heads] * U64(0x9E3779B97F4A7C15) + mix(whole[tails]) + count.astype(U64))
        return grams[place[heads]], content, doc_ids[words.rows][doc[heads]], ((heads - words.first[doc[heads]]) << 32) | count, heads

    def decide(content: np.ndarray, doc_id: np.ndarray, at: np.ndarray, head: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which stretches are repeats as a whole of others in the batch, and the spans (doc_id, at) that automata found in them."""
        order = np.lexsort((at, doc_id, content))
        edges = _runs(content[order])
        sizes = np.diff(np.append(edges, len(order)))
        whole, docs, ats = np.zeros(len(order), bool), [], []
        for first, size in zip(edges[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            shard = SuffixAutomaton()
            for i in order[first : first + size].tolist():
                own, start, n = int(doc_id[i]), int(at[i]) >> 32, int(at[i]) & 0xFFFFFFFF
                begin = int(head[i])
                found = shard.repeats(hashes[begin : begin + n + window - 1].tolist(), _place(own, start), window)
                whole[i] = len(found) == n
                docs.extend([own] * len(found))
                ats.extend([(start + j) << 32 | 1 for j in found])
        return whole, np.array(docs, np.int64), np.array(ats, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            found, hashes, size = [], [], 0
            for w in split_words(batch.column("text"), lower=False):
                if x := find(w, ids):
                    found.append((*x[:4], x[4] + size))
                    hashes.append(w.hashes)
                    size += len(w.hashes)
            if not found:
                continue
            part, content, doc_id, at, head = (np.concatenate(x) for x in zip(*found, strict=True))
            whole, docs, ats = decide(content, doc_id, at, head, np.concatenate(hashes))
            yield _rows(part[~whole], doc_id[~whole], at[~whole], settled=False)
            docs, ats = _merged(docs, ats)
            yield _rows(mix(docs.view(U64)), docs, ats, settled=True)

    return run


def _settle(hot: int):
    """Rows sorted by (part, doc_id, at) -> covered spans (part null), and the stretches whose words are needed (part: their anchor).

    Stretches of an anchor with more than hot of them are marked split: their windows are
    dealt one by one, and no more than hot rows of an anchor are held beyond a batch.
    """

    def out(part: np.ndarray, doc_id: np.ndarray, at: np.ndarray, *, covered: bool = False, split: np.ndarray | bool = False) -> pa.RecordBatch:
        columns = [pa.array(part, pa.int64(), mask=np.full(len(part), covered)), pa.array(doc_id), pa.array(at), pa.array(np.broadcast_to(split, len(part)))]
        return pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "at", "split"])

    def needed(rows: list[np.ndarray]) -> pa.RecordBatch:
        runs = np.diff(np.append(_runs(rows[0]), len(rows[0])))
        stretches = np.repeat(runs, runs)
        several = stretches > 1
        return out(*(x[several] for x in rows), split=stretches[several] > hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the stretches of the last anchor, which may go on
        busy: int | None = None  # an anchor that went on beyond hot stretches
        for batch in batches:
            done = batch.filter(batch.column("settled"))
            yield out(*(done.column(c).to_numpy() for c in ("part", "doc_id", "at")), covered=True)
            rows = [batch.filter(pc.invert(batch.column("settled"))).column(c).to_numpy() for c in ("part", "doc_id", "at")]
            if held:
                rows, held = [np.concatenate(x) for x in zip(held, rows, strict=True)], None
            if busy is not None:
                on = int(np.searchsorted(rows[0], busy, side="right"))
                yield out(*(x[:on] for x in rows), split=True)
                rows = [x[on:] for x in rows]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield needed([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > hot:
                busy = int(held[0][0])
                yield out(*held, split=True)
                held = None
        if held:
            yield needed(held)

    return run


def _window_hash(words: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def _words_needed(window: int):
    """(doc_id, row, needs) -> the words of each needed stretch; of a split one, those of each window, whose part is its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                part, docs, ats, texts = [], [], [], []
                for doc_id, needs, text in zip(rows.column("doc_id").to_pylist(), rows.column("needs").to_pylist(), rows.column("row").field("text").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    for need in needs:
                        start, n = need["at"] >> 32, need["at"] & 0xFFFFFFFF
                        size, n = (window, n) if need["split"] else (n + window - 1, 1)
                        for first in range(start, start + n):
                            found = b" ".join(words[first : first + size])
                            part.append(_window_hash(found) if need["split"] else need["part"])
                            docs.append(doc_id)
                            ats.append(first << 32 | size - window + 1)
                            texts.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), pa.array(texts, pa.binary())], ["part", "doc_id", "at", "words"])

    return run


def _match(window: int):
    """Stretches sorted by (part, doc_id, at) -> the spans of windows that started earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = None, SuffixAutomaton()
        for batch in batches:
            docs, ats = [], []
            for p, doc_id, at, words in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "at", "words")), strict=True):
                if p != part:
                    part, shard = p, SuffixAutomaton()
                start = at >> 32
                found = shard.repeats(words.split(b" "), _place(doc_id, start), window)
                docs.extend([doc_id] * len(found))
                ats.extend([(start + j) << 32 | 1 for j in found])
            doc_id, at = _merged(np.array(docs, np.int64), np.array(ats, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(at)], ["doc_id", "at"])

    return run


def _kept(spans: list[int] | None, text: str | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, of those that are covered, and the others joined."""
    words = (text or "").encode().split()
    total, removed = len(words), 0
    if spans:
        change = np.zeros(total + 1, np.int64)
        at = np.array(spans, np.int64)
        start = at >> 32
        fits = start < total  # rows that repeat a doc_id with another text may be shorter
        np.add.at(change, start[fits], 1)
        np.add.at(change, np.minimum(start + (at & 0xFFFFFFFF) + window - 1, total)[fits], -1)
        gone = np.cumsum(change[:-1]) > 0
        removed = int(gone.sum())
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return total, removed, b" ".join(words)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_kept(spans, text, window) for spans, text in zip(batch.column("spans").to_pylist(), batch.column("row").field("text").to_pylist(), strict=True)]
            total, removed, kept = zip(*made, strict=True) if made else ((), (), ())
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _replace(window: int, names: list[str]):
    """(row, spans) -> the rows; texts that lost words become the words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = row.field("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    texts[i] = _kept(spans, texts[i], window)[2].decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else row.field(n) for n in names], names)

    return run


def _with_spans(docs: DataFrame, columns: list[str], window: int, anchor: int, hot: int) -> DataFrame:
    """(doc_id, row, spans): row has the columns, spans the covered stretches of the row's document, as start << 32 | number of windows.

    Both joins that need texts read rows of one and the same exchange, so whole texts are
    shuffled once; that is why a plain doc_id goes without an alias, and rows stay whole.
    """
    plain = docs.schema["doc_id"].dataType == T.LongType()
    doc_id = F.col("doc_id") if plain else F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.select(doc_id, F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = docs.select(doc_id, F.struct(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(c) for c in columns)).alias("row"))
    known = rows.where("doc_id is not null")
    dealt = texts.transform(arrow_map, _stretches(window, anchor), _STRETCH).repartition("part").sortWithinPartitions("part", "doc_id", "at")
    settled = dealt.transform(arrow_map, _settle(hot), "part long, doc_id long, at long, split boolean")
    needs = settled.where("part is not null").groupBy("doc_id").agg(F.collect_list(F.struct("part", "at", "split")).alias("needs"))  # within one document
    stretches = known.hint("merge").join(needs, "doc_id").select("doc_id", "row", "needs").transform(arrow_map, _words_needed(window), "part long, doc_id long, at long, words binary")
    matched = stretches.repartition("part").sortWithinPartitions("part", "doc_id", "at").transform(arrow_map, _match(window), "doc_id long, at long")
    covered = settled.where("part is null").select("doc_id", "at").unionAll(matched)
    spans = covered.groupBy("doc_id").agg(F.collect_list("at").alias("spans"))
    nobody = rows.where("doc_id is null").withColumn("spans", F.array().cast("array<long>"))
    return known.hint("merge").join(spans, "doc_id", "left").select("doc_id", "row", "spans").unionByName(nobody)


def remove_repeats(docs: DataFrame, *, window: int = 20, anchor: int = 8, hot: int = 1000) -> DataFrame:
    """docs (doc_id long, text, ...) -> (doc_id, n_words, n_removed, kept string), a row for each row of docs.

    Each word is removed that is covered by a window of that many words whose sequence
    also starts earlier: at a smaller doc_id, or earlier in the same document. Windows are
    judged on the input. kept has the other words, joined by one space. A null or empty
    text has no words. Rows that repeat a doc_id are one document: a place that any of
    them repeats from elsewhere is removed in each. Rows with a null doc_id come back
    whole and count as no one's source. Other columns are ignored, whatever their names.
    Beyond hot stretches of one anchor its windows are spread over all shards; that moves work only.
    """
    out = _with_spans(docs, ["text"], window, anchor, hot)
    return out.transform(arrow_map, _cut(window), "doc_id long, n_words long, n_removed long, kept string")


def replace_repeats(docs: DataFrame, *, window: int = 20, anchor: int = 8, hot: int = 1000) -> DataFrame:
    """docs with texts cut as by remove_repeats(); texts that lose nothing, and all other columns, whatever their names, stay as they are."""
    out = _with_spans(docs, docs.columns, window, anchor, hot).select("row", "spans")
    return out.transform(arrow_map, _replace(window, docs.columns), docs.schema)
