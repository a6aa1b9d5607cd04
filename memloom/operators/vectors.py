"""Exact nearest neighbours and duplicate checks over unit vectors held as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import round_half_up

#: A tile is a block of queries that meets a part of the store in one task: at most about so many of each.
QUERY_TILE, STORE_TILE = 16_384, 32_768
#: Inside a tile products are formed for so many queries and stored vectors at a time: 8 MB.
_QUERIES, _VECTORS, _FIRST = 1024, 2048, 256


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, to three decimals."""
    return round_half_up(dot(a, b), 3)


def _matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows with whole, finite vectors of that length, and these."""
    lists = vectors.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    length = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    out = {}
    for n in np.unique(length[length >= 0]).tolist():
        at = np.flatnonzero(length == n)
        flat = lists.take(pa.array(at)).flatten()
        m = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)  # nulls become NaN
        fine = np.isfinite(m).all(axis=1)
        out[n] = (at[fine], m[fine])
    return out


def _products(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides as they are multiplied, in single precision unless vectors are long, and more than a product's rounding errors."""
    most = max(1.0, *(float(np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0))) for m in (q, x)))
    kind = np.float32 if most < 2 else np.float64
    return q.astype(kind), x.astype(kind), float(np.finfo(kind).eps) * (q.shape[1] + 8) * most * most


def _best(q: np.ndarray, x: np.ndarray, k: int, same: Callable[[slice, slice], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, thousandths) of each query's k best rows of x, the first rows among equals.

    Matrix products choose what is looked at. What is looked at is summed up in the vectors'
    order, as the column expression does, so both round alike.
    """
    out = []
    fast_q, fast_x, eps = _products(q, x)
    for a in range(0, len(q), _QUERIES):
        block, fast = q[a : a + _QUERIES], fast_q[a : a + _QUERIES]
        who, row, best = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        least = np.full(len(block), -np.inf)  # what a row must reach
        start = 0
        while start < len(x):
            end = min(len(x), start + (_VECTORS if start else max(_FIRST, k)))
            s = fast @ fast_x[start:end].T
            if same is not None:
                s[same(slice(a, a + len(block)), slice(start, end))] = -np.inf
            if not start and end > k:
                kth = np.partition(s, end - k, axis=1)[:, end - k].astype(np.float64)
                least = (np.floor((kth - eps) * 1000 + 0.5) - 0.5) / 1000 - eps
            near = s >= least.astype(s.dtype)[:, None]
            i, j = np.divmod(np.flatnonzero(near if same is None else near & (s > -np.inf)), end - start)
            if len(i):
                total = np.zeros(len(i))
                for d in range(x.shape[1]):
                    total += block[i, d] * x[start + j, d]
                who, row, best = np.concatenate([who, i]), np.concatenate([row, start + j]), np.concatenate([best, np.floor(total * 1000 + 0.5)])
                order = np.lexsort((row, -best, who))
                who, row, best = who[order], row[order], best[order]
                first = np.searchsorted(who, np.arange(len(block)))
                keep = np.arange(len(who)) - first[who] < k
                who, row, best = who[keep], row[keep], best[keep]
                n = np.bincount(who, minlength=len(block))
                full = np.flatnonzero(n == k)
                least[full] = (best[np.cumsum(n)[full] - 1] + 0.5) / 1000 - eps  # later rows lose ties
            start = end
        out.append((who + a, row, best))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _meet(k: int, exclude_self: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, store: pa.Table) -> pa.Table:
        names = ["query_id", "id", "similarity"]
        qid, store = queries["query_id"].combine_chunks(), store.sort_by("id")
        sid = store["id"].combine_chunks()
        code = pa.concat_arrays([qid, sid]).dictionary_encode().indices.to_numpy() if exclude_self else np.empty(0)
        qc, sc = code[: len(qid)], code[len(qid) :]
        parts, sides = [], _matrices(store["embedding"])
        left = np.full(len(qid), k)  # neighbours still to find
        for n, (at, q) in _matrices(queries["_q"]).items():
            if n in sides and len(q):
                rows, x = sides[n]
                who, row, best = _best(q, x, k, (lambda a, b, at=at, rows=rows: qc[at[a], None] == sc[None, rows[b]]) if exclude_self else None)
                left -= np.bincount(at[who], minlength=len(qid))
                parts.append((at[who], rows[row], best / 1000))
        for i in np.flatnonzero(left > 0):  # too few that can be compared: others follow, without a similarity
            had = np.concatenate([rows[who == i] for who, rows, _ in parts]) if parts else np.empty(0, np.int64)
            more = np.setdiff1d(np.flatnonzero(sc != qc[i]) if exclude_self else np.arange(len(sid)), had)[: left[i]]
            parts.append((np.full(len(more), i), more, np.full(len(more), np.nan)))
        who, rows, best = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([qid.take(pa.array(who)), sid.take(pa.array(rows)), pa.array(best, mask=np.isnan(best))], names)

    return run


def _any(q: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Whether some row of x is that similar, for each query, and the number of pairs met: a query that is settled meets no more."""
    fast_q, fast_x, eps = _products(q, x)
    eps += 1e-9
    found, pairs = np.zeros(len(q), bool), 0
    for a in range(0, len(q), _QUERIES):
        open_ = np.arange(a, min(len(q), a + _QUERIES))
        start = 0
        while start < len(x) and len(open_):
            end = min(len(x), start + (_VECTORS if start else _FIRST))
            s = fast_q[open_] @ fast_x[start:end].T
            pairs += s.size
            most = s.max(axis=1).astype(np.float64)
            found[open_[most >= threshold + 0.0005 + eps]] = True
            near = np.flatnonzero((most >= threshold - 0.0005 - eps) & ~found[open_])  # these are summed up in the vectors' order
            i, j = np.nonzero(s[near] >= np.asarray(threshold - 0.0005 - eps, s.dtype))
            total = np.zeros(len(i))
            for d in range(x.shape[1]):
                total += q[open_[near[i]], d] * x[start + j, d]
            found[open_[near[i[np.floor(total * 1000 + 0.5) / 1000 >= threshold]]]] = True
            open_, start = open_[~found[open_]], end
    return found, pairs


def _resembled(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(query_id, _q, found): whether the part has a vector that similar."""

    def run(queries: pa.Table, store: pa.Table) -> pa.Table:
        found, sides = np.zeros(len(queries), bool), _matrices(store["embedding"])
        for n, (at, q) in _matrices(queries["_q"]).items():
            if n in sides and len(q) and len(sides[n][1]):
                found[at] = _any(q, sides[n][1], threshold)[0]
        return pa.table([queries["query_id"], queries["_q"], pa.array(found)], ["query_id", "_q", "found"])

    return run


def _sides(store: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The store (id, embedding), the queries (query_id, _q), and how many parts and blocks these make."""
    v = store.select("id", "embedding")
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("_q"))
    n, cores = v.select("id").count(), v.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // STORE_TILE), min(2 * cores, n // _VECTORS))  # small stores are spread too
    return v, q, parts, max(1, -(-q.select("query_id").count() // QUERY_TILE))


def _tiles(q: DataFrame, v: DataFrame, parts: int, blocks: int, which: range, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(block, part) of each block of the queries with each part of the store whose number is named."""
    share = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    each = lambda r: F.explode(F.sequence(F.lit(r.start), F.lit(r.stop - 1)))
    tile = (F.col("_b") * F.lit(parts) + F.col("_p")).alias("_t")
    spread = lambda x: x.repartition(2 * len(which) * blocks, "_t").groupBy("_t")
    asked = q.withColumns({"_b": share("query_id", blocks), "_p": each(which)}).select(tile, "query_id", "_q")
    part = v.withColumn("_p", share("id", parts))
    part = part if len(which) == parts else part.where(F.col("_p").between(which.start, which.stop - 1))
    held = part.withColumn("_b", each(range(blocks))).select(tile, "id", "embedding")
    return spread(asked).cogroup(spread(held)).applyInArrow(run, schema)


def nearest(store: DataFrame, queries: DataFrame, k: int = 5, *, where: Column | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank) of the k most similar vectors for each query (id, embedding).

    Every query meets every vector: blocks of queries and parts of the store form tiles of
    bounded size, each a task's work by matrix products, and only the k best of a tile move.
    Ties go to the smaller id; pairs without a similarity (nulls, other lengths) come last.
    """
    store = store if where is None else store.where(where)
    v, q, parts, blocks = _sides(store, queries)
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *v.schema]}
    met = _tiles(q, v, parts, blocks, range(parts), _meet(k, exclude_self), f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))  # limited in each task before it moves
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def check_duplicate(store: DataFrame, queries: DataFrame, threshold: float = 0.9, n: int = 5) -> DataFrame:
    """Of each query's n nearest, those at least that similar."""
    return nearest(store, queries, n).where(F.col("similarity") >= threshold)


def without_duplicates(store: DataFrame, new: DataFrame, threshold: float = 0.9) -> DataFrame:
    """New rows that nothing in the store is that similar to: what filing lets in.

    A row is settled by the first vector that resembles it. All rows meet one part of the
    store; only those that it leaves open meet the others.
    """
    v, q, parts, blocks = _sides(store, new)
    kinds = {f.name: f.dataType.simpleString() for f in q.schema}
    many = max(blocks, v.sparkSession.sparkContext.defaultParallelism)  # one part is cheap to repeat
    run, schema = _resembled(threshold), f"query_id {kinds['query_id']}, _q {kinds['_q']}, found boolean"
    first = _tiles(q, v, parts, many, range(1), run, schema)
    taken, left = first.where("found"), first.where("not found").select("query_id", "_q")
    if parts > 1 and (blocks := -(-left.count() // QUERY_TILE)):
        taken = taken.unionAll(_tiles(left, v, parts, blocks, range(1, parts), run, schema).where("found"))
    return new.join(taken.select(F.col("query_id").alias("id")), "id", "left_anti")


def self_recall(store: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, found): whether each query, itself a row of the store, comes back as its own nearest."""
    first = nearest(store, queries, 1)
    return first.select(F.col("query_id").alias("id"), (F.col("id") == F.col("query_id")).alias("found"))
