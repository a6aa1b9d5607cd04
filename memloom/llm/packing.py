"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence. The covering LP (as few
configurations as can hold all pieces) is solved by multiplicative weights, at two levels.
Within a pass, a knapsack dynamic program prices configurations under the current weights;
near-optimal ones that share no length take up to STEP of what their lengths still need, and
the weights of the lengths that lag rise exponentially, until every piece is covered. From
pass to pass, a length's weight is multiplied by the exponential of what is wasted in the
configurations that hold it. The weights price every configuration, so they also bound the
optimum from below; passes end when the best solution is within GAP of the bound.

The fractional solution is rounded: each configuration is used as often as it says, rounded
down, whether full or not, and then full ones once more, those of the largest fractions
first. The LP is solved anew for the pieces left, until a solution places nothing more; the
few pieces that remain are placed best-fit decreasing.

Only the histogram (as many numbers as the capacity) reaches the driver; the work on it
depends on its number of lengths, never on the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import arrow_map, materialize
from memloom.llm.tokens import tokenizer

#: Passes at most for the whole histogram and for what rounding leaves, and the gap to the bound that ends them.
PASSES, LATER_PASSES, GAP = 6, 1, 0.0001
#: The share of a length's pieces that one round covers at most.
STEP = 0.5
#: How strongly needs within a pass, and waste from pass to pass, change weights; how near the best a configuration must be.
NEED, SHARP, WASTE, NEAR = 0.05, 3.0, 2.0, 0.005
#: Configurations in a row that share a length with others of their round, after which it ends.
MISSES = 30
#: The share of the pieces left that one rounding places by rounding up.
ROUNDED_UP = 0.4
BATCH = 1000

Configuration = tuple[tuple[int, int], ...]  # (length, copies), lengths descending


class Knapsack:
    """The most valuable multisets of lengths for every capacity up to the given one, by dynamic programming."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray, capacity: int) -> None:
        worth = np.full(capacity, -np.inf)
        worth[lengths - 1] = values
        back, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)  # back: the best values, from the capacity down
        for c in range(1, capacity + 1):
            rest = capacity - c + 1
            total = worth[:c] + back[rest:]
            j = int(total.argmax())
            if total[j] > back[rest]:
                back[rest - 1], choice[c] = total[j], j + 1
            else:
                back[rest - 1] = back[rest]
        self.best, self.choice = back[::-1], choice.tolist()

    def multiset(self, capacity: int) -> dict[int, int]:
        taken: dict[int, int] = {}
        while capacity > 0:
            if length := self.choice[capacity]:
                taken[length] = taken.get(length, 0) + 1
                capacity -= length
            else:
                capacity -= 1
        return taken


def fill(config: Configuration) -> int:
    return sum(length * copies for length, copies in config)


class Solution(NamedTuple):
    """A fractional cover: how often each configuration is used, so that each length is held as often as there is; no cover is smaller than bound."""

    used: dict[Configuration, float]
    bound: float
    weights: dict[int, float]

    @property
    def value(self) -> float:
        return sum(self.used.values())


def _pass(lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[dict[Configuration, float], float]:
    """One pass of multiplicative weights over all pieces: the configurations used, and the best bound that its prices give."""
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    left, used, bound = counts.copy(), defaultdict(float), 0.0
    while len(live := np.flatnonzero(left > 1e-9 * counts)):
        need = left[live] / counts[live]
        values = lengths[live] * weights[live] * (1 + NEED * (lengths[live] / capacity + np.exp(SHARP * (need - need.max()))))
        priced = Knapsack(lengths[live], values, capacity)
        best = priced.best[capacity]
        bound = max(bound, float(counts[live] @ values) / best)
        worth = values + priced.best[capacity - lengths[live]]  # of the best configuration that holds a length
        near = np.flatnonzero(worth >= best * (1 - NEAR))
        taken, misses = np.zeros(len(lengths), bool), 0
        for i in live[near][np.argsort(-worth[near], kind="stable")]:
            if taken[i]:
                continue
            length = int(lengths[i])
            config = priced.multiset(capacity - length)
            config[length] = config.get(length, 0) + 1
            at, copies = place[list(config)], np.array(list(config.values()), float)
            if taken[at].any():
                misses += 1
                if misses == MISSES:
                    break
                continue
            misses, taken[at] = 0, True
            much = float((np.minimum(left[at], STEP * counts[at]) / copies).min())
            left[at] -= much * copies
            used[tuple(sorted(config.items(), reverse=True))] += much
    return dict(used), bound


def solve_lp(histogram: dict[int, int], capacity: int, *, passes: int = PASSES, gap: float = GAP, weights: dict[int, float] | None = None) -> Solution:
    """The configuration LP by multiplicative weights, from the given weights of lengths (1 for each)."""
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(x)] for x in lengths], float)
    now = np.array([(weights or {}).get(int(x), 1.0) for x in lengths])
    bound, best, value, found = float(counts @ lengths / capacity), now, np.inf, {}
    for _ in range(passes):
        used, proved = _pass(lengths, counts, now, capacity)
        bound = max(bound, proved)
        if (total := sum(used.values())) < value:
            best, value, found = now, total, used
        if value <= bound * (1 + gap):
            break
        waste = np.zeros(capacity + 1)
        for config, times in used.items():
            for length, copies in config:
                waste[length] += times * copies * (1 - fill(config) / capacity)
        now = now * np.exp(WASTE * waste[lengths] / counts)
    return Solution(found, bound, dict(zip(lengths.tolist(), best.tolist(), strict=True)))


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Configuration, int]:
    """Best-fit decreasing over groups of equal sequences: exact, and as fast for a billion pieces as for a few."""
    open_groups: dict[int, dict[Configuration, int]] = defaultdict(dict)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in open_groups if r >= length):
            for config, n in sorted(open_groups[room].items()):
                if not left:
                    break
                del open_groups[room][config]
                fits = room // length
                full = min(n, left // fits)
                left -= full * fits
                rest = min(left, fits - 1) if full < n and left < fits else 0
                left -= rest
                for copies, times in ((fits, full), (rest, 1 if rest else 0), (0, n - full - (1 if rest else 0))):
                    if times:
                        grown = (*config, (length, copies)) if copies else config
                        group = open_groups[room - copies * length]
                        group[grown] = group.get(grown, 0) + times
        fits = capacity // length
        for copies, times in ((fits, left // fits), (left % fits, 1)):
            if copies and times:
                group = open_groups[capacity - copies * length]
                config = ((length, copies),)
                group[config] = group.get(config, 0) + times
    out: dict[Configuration, int] = defaultdict(int)
    for groups in open_groups.values():
        for config, n in groups.items():
            out[config] += n
    return dict(out)


class Plan(NamedTuple):
    """Whole configurations that hold each length exactly as often as there is; bound: no plan has fewer sequences; by_lp: pieces that the LP's configurations hold."""

    sequences: list[tuple[Configuration, int]]
    bound: float
    by_lp: int


def plan_sequences(histogram: dict[int, int], capacity: int) -> Plan:
    left = {x: n for x, n in histogram.items() if n}
    plan: dict[Configuration, int] = defaultdict(int)
    bound, by_lp, weights = 0.0, 0, None

    def take(config: Configuration, times: int) -> int:
        """Use a configuration so often, as far as there are pieces; how many it takes."""
        times = min(times, *(left[x] // n for x, n in config))
        if times:
            plan[config] += times
            for x, n in config:
                left[x] -= times * n
        return times * sum(n for _, n in config)

    while left:
        found = solve_lp(left, capacity, weights=weights, passes=PASSES if weights is None else LATER_PASSES)
        bound, weights, pieces = max(bound, found.bound), found.weights, sum(left.values())
        placed = sum(take(c, int(x + 1e-9)) for c, x in found.used.items())  # at most what there is, as the solution holds no more
        partly = [(-(x - int(x)), c) for c, x in found.used.items() if x - int(x) > 1e-9 and fill(c) == capacity]
        for _, config in sorted(partly):
            if placed > ROUNDED_UP * pieces:
                break
            placed += take(config, 1)
        left = {x: n for x, n in left.items() if n}
        by_lp += placed
        if not placed:
            break
    for config, times in best_fit(left, capacity).items():
        plan[config] += times
    return Plan(sorted(plan.items()), bound, by_lp)


def _slots(plan: list[tuple[Configuration, int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), by length and rank: which sequence the r-th piece of a length goes to."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for length, copies in config:
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(path: str, kind: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, task = tokenizer(path, kind), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist()), strict=True):
                    ids += int(end_id).to_bytes(4, "little")
                    total = len(ids) // 4
                    start, length = 0, (total - 1) % capacity + 1
                    for piece in range(-(-total // capacity)):
                        rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, int(seen[length])))
                        seen[length] += 1
                        start, length = start + length, capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, kind: str = "byte", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Every whole text is tokenised and ends with end_id (null: that id alone). Documents of
    more than capacity tokens are cut into pieces of capacity tokens, of which the first
    holds what is over; all pieces are packed into sequences of at most capacity tokens,
    gapless from offset 0. Rows that repeat a doc_id, and null doc_ids, are documents of
    their own. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = texts.transform(arrow_map, _pieces(tokenizer_path, kind, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long")
    made = materialize(made, "pieces")
    counts = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = _slots(plan_sequences(histogram, capacity).sequences)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keys = slots[:, 0] * (1 << 50) + slots[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rank = (x["base"] + x["nth"]).to_numpy()
            length = x["length"].to_numpy()
            at = slots[np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1] if len(x) else np.zeros((0, 5), np.int64)
            nth = rank - at[:, 1]
            yield x[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=at[:, 3] + nth // at[:, 2], offset=at[:, 4] + nth % at[:, 2] * length)

    joined = made.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "base", "nth")
    return joined.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
