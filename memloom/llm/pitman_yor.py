"""Hierarchical Pitman-Yor language model, trained and applied over whole corpora.

Every token is a customer in the restaurant of its context, whose tables are customers of
the one parent restaurant, whose base is uniform over the vocabulary and one unknown word:

    P(w | g) = (c_gw - d t_gw + (theta + d t_g) P(w)) / (theta + c_g)
    P(w)     = (t_w - d0 k_w + (theta0 + d0 k) / (V + 1)) / (theta0 + t)

A context g is the class of the previous token (its hash, 2 ** CLASS_BITS classes), so the
totals by context have a fixed size. The numbers of tables are sampled by Gibbs from their
full conditionals given the counts, with seats within a dish marginalised by generalised
Stirling numbers, and the predictive probabilities of several sweeps are averaged.

Counts are distributed: each (context, word) count lives in the word's shard. A pass over
the training tokens counts them into a table with a row for each shard. Each sweep reads
that table with its tables so far, resamples all of them given the totals of the sweep
before (tables by context, parent customers and tables: integers, of fixed size, summed on
the executors) and writes it anew. A last pass sends each document's tokens to their shards
and sums the log probabilities by document, in fixed point.

All randomness is keyed by word, context and sweep, all totals are exact and all sums are of
integers, so scores do not depend on the number of shards or partitions, nor on which words
are hot: words of more than HOT of the tokens are spread over all shards by context, which
moves work only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import arrow_map, drop, materialize
from memloom.llm.words import U64, mix, split_words

CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
SWEEPS, BURN_IN = 4, 4
#: Share of all tokens beyond which a word is spread.
HOT = 0.002
#: Tokens of a shard, which one worker holds in memory.
SHARD_TOKENS = 4_000_000
END, BEGIN = U64(0x0E4D0E4D0E4D0E4D), U64(0x0B0B0B0B0B0B0B0B)
#: Documents of a message, which it names with 15 bits; they bound a worker's memory.
ROWS = 3000
_ROW_BITS = (1 << 15) - 1
#: Up to so many customers tables are drawn from their distribution at once; more are seated in blocks of a quarter of those seated.
_SMALL = 256
#: Log probabilities are summed as multiples of this.
_UNIT = 2.0**-36
_BLOCKS = 512


class Prior(NamedTuple):
    d: float = 0.8
    theta: float = 2.0
    d0: float = 0.8
    theta0: float = 10.0


class Totals(NamedTuple):
    """Of all shards after a sweep: tables by context, parent customers and parent tables, and of the hot words the tables and parent tables."""

    tables: np.ndarray  # (CLASSES,)
    parent: tuple[int, int]
    hot: np.ndarray  # (hot,)
    hot_parent: np.ndarray  # (hot,)


class Corpus(NamedTuple):
    """Of all shards: customers by context, tokens, distinct tokens, and the count of each hot word."""

    customers: np.ndarray
    tokens: int
    vocabulary: int
    hot: np.ndarray


def log_stirling(d: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t <= most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, out[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 0)), -np.inf)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


_stirling: dict[float, np.ndarray] = {}


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), one for each key."""
    return (mix(key) >> U64(11)) * 2.0**-53


def sample_tables(c: np.ndarray, r: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with c customers, where r is (theta + d * tables) * the parent's probability.

    Drawn from S(c, t) r^t for c up to _SMALL; beyond it customers are seated one block
    after another. The draw depends on c, r, d and the 64-bit key alone.
    """
    if d not in _stirling:
        _stirling[d] = log_stirling(d, _SMALL)
    t = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(_SMALL + 2))
    u = _uniform(key)
    for v in range(2, _SMALL + 1):
        step = max(1, 1_000_000 // v)
        for i in range(edges[v], edges[v + 1], step):
            own = order[i : min(i + step, edges[v + 1])]
            x = _stirling[d][v, 1 : v + 1][None, :] + np.log(r[own])[:, None] * np.arange(1, v + 1)
            total = np.cumsum(np.exp(x - x.max(1, keepdims=True)), axis=1)
            t[own] = 1 + (total < (u[own] * total[:, -1])[:, None]).sum(1)
    for i in order[edges[_SMALL + 1] :].tolist():
        rng, left, rate = np.random.Generator(np.random.Philox(key=int(key[i]))), int(c[i]), float(r[i])
        seated = tables = 1
        while seated < left:
            block = min(max(seated // 4, 1), left - seated)
            tables += int(rng.binomial(block, rate / (rate + seated - d * tables)))
            seated += block
        t[i] = tables
    return t


class Shard:
    """The counts of one shard's words and their tables after each sweep that is kept; the last ones go into the next sweep."""

    def __init__(self, words: np.ndarray, keys: np.ndarray, counts: np.ndarray, hot: np.ndarray, samples: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """words: ascending hashes of the shard's words; keys: ascending (word << CLASS_BITS | context), word being a place in words, or len(words) + a hot word's number.

        samples: tables by (context, word), and parent tables by word (0 for hot words, whose are among the totals).
        """
        self.words, self.keys, self.counts, self.n, self.hot, self.samples = words, keys, counts, len(words), hot, samples
        self.word, self.context = keys >> CLASS_BITS, keys & (CLASSES - 1)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, self.n + len(self.hot)).astype(np.int64)

    def start(self) -> None:
        """One table for each dish."""
        t = np.ones(len(self.keys), np.int64)
        k = np.minimum(self.by_word(t), 1)
        k[self.n :] = 0
        self.samples = [(t, k)]

    def parent(self, sample: int, totals: Totals, vocabulary: int, prior: Prior) -> tuple[np.ndarray, float]:
        """The parent's probability of each word, and that of its base times its strength."""
        t, k = self.samples[sample]
        by_word, k = self.by_word(t), k.copy()
        by_word[self.n :], k[self.n :] = totals.hot, totals.hot_parent
        base = (prior.theta0 + prior.d0 * totals.parent[1]) / (vocabulary + 1)
        return (np.maximum(by_word - prior.d0 * k, 0) + base) / (prior.theta0 + totals.parent[0]), base

    def sweep(self, number: int, totals: Totals, vocabulary: int, prior: Prior, keep: bool) -> None:
        parent, _ = self.parent(-1, totals, vocabulary, prior)
        names = np.concatenate([self.words, self.hot])
        with np.errstate(over="ignore"):
            key = mix(names[self.word] + U64(2 * number + 1) * U64(0x9E3779B97F4A7C15)) ^ (self.context.astype(U64) << U64(7))
        t = sample_tables(self.counts, (prior.theta + prior.d * totals.tables[self.context]) * parent[self.word], prior.d, key)
        k = parent_tables(self.by_word(t)[: self.n], self.words, number, totals.parent[1], vocabulary, prior)
        self.samples = [*(self.samples if keep else []), (t, np.concatenate([k, np.zeros(len(self.hot), np.int64)]))]

    def sums(self) -> dict[int, np.ndarray]:
        """What totals are summed from, in _BLOCKS blocks of contexts; block -1 has the single numbers and the hot words."""
        t, k = self.samples[-1]
        by_word, count = self.by_word(t), self.by_word(self.counts)
        single = np.concatenate([[self.counts.sum(), (count[: self.n] > 0).sum(), t.sum(), k.sum()], count[self.n :], by_word[self.n :]])
        contexts = np.array([np.bincount(self.context, x, CLASSES) for x in (self.counts, t)]).astype(np.int64)
        return {-1: single.astype(np.int64), **{b: x for b, x in enumerate(np.split(contexts, _BLOCKS, axis=1)) if x.any()}}

    def pack(self) -> bytes:
        """Dishes and words of one customer have one table always and need no space."""
        dishes, words = self.counts > 1, self.by_word(self.counts)[: self.n] > 1
        samples = [x for t, k in self.samples for x in (t[dishes], k[: self.n][words])]
        return _pack(self.words, np.diff(self.word, prepend=0).astype(np.uint32), self.context.astype(np.uint16), *(x.astype(np.uint32) for x in (self.counts, *samples)))

    @staticmethod
    def unpack(data: bytes, samples: int, hot: np.ndarray) -> Shard:
        names, steps, contexts, counts, *rest = _unpacked(data, "<u8", "<u4", "<u2", *["<u4"] * (1 + 2 * samples))
        shard = Shard(names, np.cumsum(steps, dtype=np.int64) << CLASS_BITS | contexts, counts.astype(np.int64), hot, [])
        dishes, words = shard.counts > 1, shard.by_word(shard.counts)[: shard.n] > 1
        for some_t, some_k in zip(rest[::2], rest[1::2], strict=True):
            t, k = np.ones(len(shard.keys), np.int64), np.append(np.ones(shard.n, np.int64), np.zeros(len(hot), np.int64))
            t[dishes], k[: shard.n][words] = some_t, some_k
            shard.samples.append((t, k))
        return shard


def parent_tables(by_word: np.ndarray, words: np.ndarray, sweep: int, tables: int, vocabulary: int, prior: Prior) -> np.ndarray:
    """Tables of each word in the parent restaurant, of which it has by_word customers."""
    base = (prior.theta0 + prior.d0 * tables) / (vocabulary + 1)
    with np.errstate(over="ignore"):
        key = mix(words + U64(2 * sweep + 2) * U64(0x9E3779B97F4A7C15))
    return sample_tables(np.maximum(by_word, 1), np.full(len(by_word), base), prior.d0, key) * (by_word > 0)


def _prefix_class(previous: np.ndarray) -> np.ndarray:
    return mix(previous ^ U64(0x5151)) >> U64(64 - CLASS_BITS)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: the rows; document (in the block), hash and context of each token, the end among them."""
    for w in split_words(batch.column("text"), lower=True):
        n = len(w.first) - 1
        tokens = np.insert(w.hashes, w.first[1:], END)
        doc = np.repeat(np.arange(n), np.diff(w.first) + 1)
        previous = np.concatenate([[BEGIN], tokens[:-1]])
        previous[np.concatenate([[True], doc[1:] != doc[:-1]])] = BEGIN
        yield w.rows, doc, tokens, _prefix_class(previous)


_MESSAGE = "shard int, kind int, base long, data binary"


def _messages(shards: int, hot: np.ndarray, scoring: bool):
    """Each batch's tokens, sorted and packed, to their shards. kind 0: words, 1: hot words, 2: the documents themselves.

    A token is a 64-bit number: word's place << 32 | context << 16 | training << 15 | row.
    """
    place = np.argsort(hot) if len(hot) else np.zeros(0, int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 33
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                held = np.array(batch.column("held_out").to_pylist(), bool)
                rows = [(r.start + doc, tokens, context) for r, doc, tokens, context in _tokens(batch)]
                row, token, context = (np.concatenate(x) for x in zip(*rows, strict=True))
                out = []
                if scoring:
                    ids = batch.column("doc_id")
                    out.append((start % shards, 2, _pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8), held.astype(np.int8), np.bincount(row, minlength=batch.num_rows).astype(np.int32))))
                else:
                    row, token, context = row[~held[row]], token[~held[row]], context[~held[row]]
                tail = context << U64(16) | (np.where(held, 0, 1 << 15)[row] | (row if scoring else 0)).astype(U64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot[place], token), len(hot) - 1)
                    warm = hot[place][at] == token
                    spread = (mix(context[warm] + token[warm]) % U64(shards)).astype(np.int64)
                    packed = np.sort((spread.astype(U64) << U64(48)) | (place[at[warm]].astype(U64) << U64(32)) | tail[warm])
                    edges = np.searchsorted(packed >> U64(48), np.arange(shards + 1).astype(U64))
                    for s in np.flatnonzero(np.diff(edges)):
                        own = packed[edges[s] : edges[s + 1]] & U64((1 << 48) - 1)
                        out.append((int(s), 1, _pack(*_columns(own))))
                    token, tail = token[~warm], tail[~warm]
                words, word = np.unique(token, return_inverse=True)
                packed = np.sort(word.astype(U64) << U64(32) | tail)
                shard = ((words >> U64(32)) * U64(shards)) >> U64(32)
                word_edges = np.searchsorted(shard, np.arange(shards + 1).astype(U64))
                edges = np.searchsorted(packed >> U64(32), word_edges.astype(U64))
                for s in np.flatnonzero(np.diff(edges)):
                    own = packed[edges[s] : edges[s + 1]] - (U64(word_edges[s]) << U64(32))
                    out.append((int(s), 0, _pack(words[word_edges[s] : word_edges[s + 1]], *_columns(own))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([start] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["shard", "kind", "base", "data"])
                start += batch.num_rows

    return run


def _columns(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted tokens as steps of (word, context), which are mostly small, and rows."""
    key = packed >> U64(16)
    step = np.diff(key, prepend=U64(0))
    return (step >> U64(16)).astype(np.uint32), (step & U64(0xFFFF)).astype(np.uint16), (packed & U64(0xFFFF)).astype(np.uint16)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(x).to_bytes(4, "little") + x.tobytes() for x in arrays))


def _unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for t in types:
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(np.frombuffer(raw, t, n, at + 4))
        at += 4 + n * np.dtype(t).itemsize
    return out


_STATE = "shard int, data binary, block array<int>, sums array<binary>"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The messages (kind, base, data) of each shard; rows come sorted by shard, so one shard's are held at a time."""
    number, held = -1, []
    for batch in batches:
        for shard, *message in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "base", "data")), strict=True):
            if shard != number and held:
                yield number, held
                held = []
            number = shard
            held.append(tuple(message))
    if held:
        yield number, held


def _joined(messages: list[tuple], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's words and, of all its tokens, the keys (places in words), the document's base and its row."""
    parts = []
    for kind, base, data in messages:
        words = np.zeros(0, U64)
        if kind == 0:
            words, high, low, row = _unpacked(data, "<u8", "<u4", "<u2", "<u2")
        else:
            high, low, row = _unpacked(data, "<u4", "<u2", "<u2")
        key = np.cumsum((high.astype(U64) << U64(16)) | low.astype(U64), dtype=U64).astype(np.int64)
        parts.append((kind, words, key, row, base))
    words = np.unique(np.concatenate([p[1] for p in parts]))
    keys = []
    for kind, own, key, _, _ in parts:
        place = np.searchsorted(words, own) if kind == 0 else len(words) + np.arange(len(hot))
        keys.append(place[key >> 16] << CLASS_BITS | key & 0xFFFF)
    return words, np.concatenate(keys), np.repeat([p[4] for p in parts], [len(p[3]) for p in parts]), np.concatenate([p[3] for p in parts])


def _rows(shards: Iterator[tuple[int, Shard]]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for number, shard in shards:
        sums = shard.sums()
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([shard.pack()], pa.binary()), pa.array([[*sums]], pa.list_(pa.int32())), pa.array([[squeeze.compress(x.tobytes()) for x in sums.values()]], pa.list_(pa.binary()))],
            ["shard", "data", "block", "sums"],
        )


def _counted(hot: np.ndarray):
    """Training messages -> each shard's counts, with one table for each dish."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
        for number, messages in _groups(batches):
            words, keys, _, _ = _joined(messages, hot)
            shard = Shard(words, *np.unique(keys, return_counts=True), hot, [])
            shard.start()
            yield number, shard

    return lambda batches: _rows(shards(batches))


def _swept(sweep: int, samples: int, keep: bool, totals: Totals, vocabulary: int, hot: np.ndarray, prior: Prior):
    """Each shard after one more sweep."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
        for batch in batches:
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                shard = Shard.unpack(data.as_py(), samples, hot)
                shard.sweep(sweep, totals, vocabulary, prior, keep)
                yield number, shard

    return lambda batches: _rows(shards(batches))


def _sums_of(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for blocks, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            for block, x in zip(blocks, map(_sums_of, sums), strict=True):
                total[block] = total[block] + x if block in total else x
    squeeze = zstandard.ZstdCompressor(level=1)
    rows = [[block] for block in total], [[squeeze.compress(x.tobytes())] for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[1], pa.list_(pa.binary()))], ["block", "sums"])


def _totals(state: DataFrame, sweep: int, hot: np.ndarray, before: Totals | None, prior: Prior) -> tuple[Corpus, Totals]:
    """The sums of all shards: _BLOCKS + 1 rows of fixed size reach the driver."""
    some = "block array<int>, sums array<binary>"
    one = state.select("block", "sums").transform(arrow_map, _summed, some)
    rows = one.repartition("block").transform(arrow_map, _summed, some).collect()
    found = {r["block"][0]: _sums_of(bytes(r["sums"][0])) for r in rows}
    nothing = np.zeros(2 * CLASSES // _BLOCKS, np.int64)
    contexts = np.concatenate([found.get(b, nothing).reshape(2, -1) for b in range(_BLOCKS)], axis=1)
    single = found.get(-1, np.zeros(4 + 2 * len(hot), np.int64))
    count, tables = single[4 : 4 + len(hot)], single[4 + len(hot) :]
    corpus = Corpus(contexts[0], int(single[0]), int(single[1]) + int((count > 0).sum()), count)
    # The hot words' tables in the parent restaurant need their totals.
    hot_parent = np.minimum(tables, 1) if before is None else parent_tables(tables, hot, sweep, before.parent[1], corpus.vocabulary, prior)
    return corpus, Totals(contexts[1], (int(single[2]), int(single[3]) + int(hot_parent.sum())), tables, hot_parent)


_SUMS = "base long, kind int, data binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, log_count double, log_model double"


def _scores(corpus: Corpus, kept: list[Totals], hot: np.ndarray, prior: Prior):
    """A partition's shards and tokens -> for each message's documents, packed, the sums of those with tokens there; the documents themselves go on as they are."""

    def probabilities(shard: Shard, types: np.ndarray, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Averaged P(w | g) of distinct keys; types: their places in shard.keys, or -1; place: of their words in the shard, or -1."""
        context, seen, out = keys & (CLASSES - 1), types >= 0, np.zeros(len(keys))
        for s, totals in enumerate(kept):
            parent, base = shard.parent(s, totals, corpus.vocabulary, prior)
            above = np.where(place >= 0, parent[place], base / (prior.theta0 + totals.parent[0]))
            own = np.zeros(len(keys))
            own[seen] = shard.counts[types[seen]] - prior.d * shard.samples[s][0][types[seen]]
            out += (own + (prior.theta + prior.d * totals.tables[context]) * above) / (prior.theta + corpus.customers[context])
        return out / len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, documents = [], []

        def tokens() -> Iterator[pa.RecordBatch]:
            for batch in batches:  # the documents go on, the tokens are kept for their shard
                kind = batch.column("kind")
                documents.append(batch.filter(pc.equal(kind, 2)).select(["base", "kind", "data"]))
                yield batch.filter(pc.not_equal(kind, 2))

        for _, messages in _groups(tokens()):
            while documents:
                yield documents.pop()
            states = [data for kind, _, data in messages if kind == 3]
            messages = [m for m in messages if m[0] != 3]
            if not messages:
                continue
            shard = Shard.unpack(states[0], len(kept), hot) if states else Shard(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), hot, [(np.zeros(0, np.int64), np.zeros(len(hot), np.int64))] * len(kept))
            words, keys, base, row = _joined(messages, hot)
            # Words of the shard's counts, and those that only held-out documents have.
            at = np.minimum(np.searchsorted(shard.words, words), max(shard.n - 1, 0))
            known = shard.words[at] == words if shard.n else np.zeros(len(words), bool)
            place = np.concatenate([np.where(known, at, -1), shard.n + np.arange(len(hot))])
            distinct, inverse = np.unique(keys, return_inverse=True)
            of_word = place[distinct >> CLASS_BITS]
            own = np.where(of_word >= 0, of_word << CLASS_BITS | distinct & (CLASSES - 1), -1)
            at = np.minimum(np.searchsorted(shard.keys, own), max(len(shard.keys) - 1, 0))
            types = np.where(shard.keys[at] == own, at, -1) if len(shard.keys) else np.full(len(distinct), -1)
            count = shard.by_word(shard.counts)
            count[shard.n :] = corpus.hot
            count = np.where(of_word >= 0, count[of_word], 0)
            each = np.log10(np.maximum(probabilities(shard, types, distinct, of_word), 1e-300))
            fixed = lambda x: np.round(x / _UNIT).astype(np.int64)
            found.append(_by_document(base, (row & _ROW_BITS).astype(np.int64), [(count > 0)[inverse].astype(np.int64), fixed(np.log10(count + 1.0))[inverse], fixed(each)[inverse]]))
        yield from documents
        if found:
            base, row, sums = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
            base, row, sums = _by_document(base, row, sums)
            edges = np.flatnonzero(np.diff(base, prepend=base[0] - 1))
            data = [_pack(row[a:b].astype(np.uint16), *sums[:, a:b]) for a, b in zip(edges, [*edges[1:], len(base)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(base[edges]), pa.array([0] * len(edges), pa.int32()), pa.array(data, pa.binary())], ["base", "kind", "data"])

    return run


def _by_document(base: np.ndarray, row: np.ndarray, values: list[np.ndarray] | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the values by document, in order."""
    order = np.argsort(base + row, kind="stable")
    uid = (base + row)[order]
    first = np.flatnonzero(np.diff(uid, prepend=uid[0] - 1)) if len(uid) else np.zeros(0, int)
    sums = [np.add.reduceat(v[order], first) if len(uid) else np.zeros(0, np.int64) for v in values]
    return base[order][first], row[order][first], np.array(sums, np.int64)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that was found for a message's documents, added up."""
    documents: dict[int, bytes] = {}
    sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((3, ROWS), np.int64))
    for batch in batches:
        for base, kind, data in zip(*(batch.column(c).to_pylist() for c in ("base", "kind", "data")), strict=True):
            if kind == 2:
                documents[base] = data
            else:
                row, *values = _unpacked(data, "<u2", "<i8", "<i8", "<i8")
                sums[base][:, row] += np.array(values)
    for base, data in documents.items():
        ids, null, held, n = _unpacked(data, "<i8", "i1", "i1", "<i4")
        known, log_count, log_model = sums[base][:, : len(ids)]
        columns = [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known), pa.array(log_count * _UNIT), pa.array(log_model * _UNIT)]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORES.split(", ")])


def hot_words(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the words with more than HOT of some block of about a megabyte of text and, counted in such blocks alone, half that of all: at most 2 / HOT words. And the number of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = defaultdict(int)
        total = 0
        for batch in batches:
            for _, _, tokens, _ in _tokens(batch):
                words, n = np.unique(tokens, return_counts=True)
                total += len(tokens)
                for w, c in zip(words[n > HOT * len(tokens)].view(np.int64).tolist(), n[n > HOT * len(tokens)].tolist(), strict=True):
                    found[w] += c
        yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.int64()), pa.array([total, *found.values()], pa.int64())], ["word", "n"])

    found = materialize(texts.transform(arrow_map, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = found.where("word is null").agg(F.sum("n")).first()[0] or 0
    rows = found.where((F.col("n") > total * HOT / 2) & F.col("word").isNotNull()).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64)).view(U64), int(total)


def score_corpus(docs: DataFrame, *, held_out: Column, prior: Prior = Prior(), shards: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row.

    The model learns from every row that is not held out and scores every row. Tokens: words
    (A-Z lower-cased) and one end for each text; null and empty texts have the end alone.
    base_score is that of add-one unigrams, score the model's log10 probability. Rows that
    repeat a doc_id, and null doc_ids, are documents of their own. An empty table gives no
    rows; with nothing to learn from, every word is the unknown one. shards (two for each
    partition, or as many as hold SHARD_TOKENS each) divides the work and changes no score.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot, tokens = hot_words(texts.select("text"))
    shards = shards or max(2 * parts, -(-tokens // SHARD_TOKENS))

    def by_shard(messages: DataFrame) -> DataFrame:
        return messages.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", F.desc("kind"))

    training = texts.transform(arrow_map, _messages(shards, hot, False), _MESSAGE)
    state = materialize(by_shard(training).transform(arrow_map, _counted(hot), _STATE), "counts")
    corpus, totals = _totals(state, 0, hot, None, prior)
    kept: list[Totals] = []
    for sweep in range(1, BURN_IN + SWEEPS + 1):
        keep = len(kept) > 0  # the samples before stay as well
        after = materialize(state.select("shard", "data").transform(arrow_map, _swept(sweep, max(len(kept), 1), keep, totals, corpus.vocabulary, hot, prior), _STATE), "sweep")
        drop(state)
        state = after
        _, totals = _totals(state, sweep, hot, totals, prior)
        if sweep > BURN_IN:
            kept.append(totals)
    scoring = texts.transform(arrow_map, _messages(shards, hot, True), _MESSAGE)
    samples = state.select("shard", F.lit(3).alias("kind"), F.lit(0).cast("long").alias("base"), "data")
    parted = by_shard(scoring.unionByName(samples)).transform(arrow_map, _scores(corpus, kept, hot, prior), _SUMS)
    by_doc = parted.repartition(parts, "base").transform(arrow_map, _finish, _SCORES)
    return by_doc.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") - F.col("n_tokens") * float(np.log10(corpus.tokens + corpus.vocabulary + 1))).alias("base_score"),
        F.col("log_model").alias("score"),
        F.pow(F.lit(10.0), -F.col("log_model") / F.col("n_tokens")).alias("perplexity"),
    )
