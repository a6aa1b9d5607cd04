"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

Every signature coordinate comes from two permutations of the 32-bit universe: the first
scatters a shingle to a position, the second, circularly shifted by k, ranks the positions
for coordinate k. Bands of coordinates give candidate buckets. Within a bucket no pairs are
listed beyond a constant number for each row: every member is compared with the bucket's
smallest id, buckets of at most ``SMALL`` members are compared in full, and members of
larger buckets that turn out to belong elsewhere are dealt anew by pairs of bands. What
then lies in a larger bucket of several components is joined exactly, by prefix filter on
the shingles themselves. All candidates are confirmed on their full shingle sets, and those
of a document with many partners are spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.components import connected_components
from memloom.llm.shared import arrow_map, materialize
from memloom.llm.words import U64, mix, shingle_set, split_words

#: Buckets of so many members at most are compared in full.
SMALL = 12
#: Further bands with which each unresolved member of a large bucket is dealt anew.
REDEALT = 8
#: Pairs of one document that are confirmed in one group; a document with more is copied to further groups.
SPREAD = 200
#: Documents with many partners that are broadcast at most, 16 bytes each; more are joined by shuffle.
BROADCAST = 100_000
_BLOCK = 512


class CirculantMinHash:
    """Signatures of size coordinates from two permutations, the second shifted circularly."""

    def __init__(self, size: int) -> None:
        self.shifts = np.arange(size, dtype=np.uint32)[:, None]
        self.size = size
        self.work = np.empty((2, size * _BLOCK), np.uint32)

    def __call__(self, shingle_hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            place = (mix(shingle_hashes ^ U64(0xA5A5_5A5A_1234_8765)) >> U64(32)).astype(np.uint32)
            out = np.full(self.size, 0xFFFFFFFF, np.uint32)
            for i in range(0, len(place), _BLOCK):
                part = place[i : i + _BLOCK]
                shape = (self.size, len(part))
                x, y = (w[: self.size * len(part)].reshape(shape) for w in self.work)
                np.subtract(part[None, :], self.shifts, out=x)
                for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                    np.right_shift(x, np.uint32(shift), out=y)
                    np.bitwise_xor(x, y, out=x)
                    np.multiply(x, np.uint32(factor), out=x)
                np.right_shift(x, np.uint32(16), out=y)
                np.bitwise_xor(x, y, out=x)
                np.minimum(out, x.min(axis=1), out=out)
        return out


def _features(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = CirculantMinHash(bands * rows)
        places = mix(np.arange(1, bands * rows + 1, dtype=U64)).reshape(bands, rows) | U64(1)
        for batch in batches:
            n, h1, h2, keys = [], [], [], []
            for words in split_words(batch.column("text"), lower=True):
                for i in range(len(words.first) - 1):
                    own = shingle_set(words.hashes[words.first[i] : words.first[i + 1]], k)
                    n.append(len(own))
                    if len(own):
                        with np.errstate(over="ignore"):
                            h1.append(mix(own ^ U64(0x1234567)).sum(dtype=U64))
                            h2.append(mix(own ^ U64(0x89ABCDEF)).sum(dtype=U64))
                            s = signature(own).reshape(bands, rows).astype(U64) + U64(1)
                            keys.append(mix((s * places).sum(axis=1, dtype=U64) ^ places[:, 0]).view(np.int64))
                    else:
                        h1.append(U64(0))
                        h2.append(U64(0))
                        keys.append(np.zeros(0, np.int64))
            sizes = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(h1, U64).view(np.int64)), pa.array(np.array(h2, U64).view(np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))],
                ["doc_id", "n_shingles", "h1", "h2", "keys"],
            )

    return run


def _verified(k: int, part: int, whole: int):
    """Pairs (a, b) of which whole * intersection >= part * union."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [shingle_set(w.hashes[w.first[i] : w.first[i + 1]], k) for w in split_words(column, lower=True) for i in range(len(w.first) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy()
            runs = np.flatnonzero(np.diff(a, prepend=a[0] - 1)) if len(a) else np.zeros(0, int)  # rows come sorted by a
            left, run_of = sets(batch.column("text_a").take(pa.array(runs))), np.searchsorted(runs, np.arange(len(a)), "right") - 1
            good = np.zeros(len(a), bool)
            for i, right in enumerate(sets(batch.column("text_b"))):
                own = left[run_of[i]]
                if len(own) and len(right):
                    at = np.minimum(np.searchsorted(own, right), len(own) - 1)
                    both = int((own[at] == right).sum())
                    good[i] = whole * both >= part * (len(own) + len(right) - both)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _candidates(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (id, n, key, ...) -> pairs (a, na, b, nb) with a < b, and the members of large buckets with their leader."""
    buckets = members.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("first")).where("c > 1")
    dealt = members.join(buckets, "key").withColumn("leader", F.col("first.id"))
    star = dealt.where("id <> leader").select(F.col("leader").alias("a"), F.col("first.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))
    small = dealt.where((F.col("c") > 2) & (F.col("c") <= SMALL) & (F.col("id") != F.col("leader")))
    small = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))  # at most SMALL of them
    rest = small.select("ids", F.posexplode("ids").alias("at", "one"))
    rest = rest.select("one", F.explode(F.slice("ids", F.col("at") + 2, F.lit(SMALL))).alias("other"))
    return star.unionAll(rest.select(F.col("one.id").alias("a"), F.col("one.n").alias("na"), F.col("other.id").alias("b"), F.col("other.n").alias("nb"))), dealt.where(F.col("c") > SMALL).drop("first")


def _shingles(k: int):
    """Each document's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(w.hashes[w.first[i] : w.first[i + 1]], k) for w in split_words(batch.column("text"), lower=True) for i in range(len(w.first) - 1)]
            sizes = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, U64), *own]).view(np.int64)))], ["id", "shingles"])

    return run


def _left_apart(large: DataFrame, links: DataFrame) -> DataFrame:
    """Members of large buckets that hold several components -> (id, n, component), a row each."""
    label = connected_components(links)
    own = large.join(label, "id", "left").select("id", "n", "key", F.coalesce("component", "id").alias("component"))
    mixed = own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    return own.join(mixed, "key", "left_semi").select("id", "n", "component").distinct()


def _exact_candidates(apart: DataFrame, texts: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """(id, n, component) -> pairs (a, na, b, nb) of different components, among them each that holds.

    Shingles are ordered by rarity. Sets with whole * intersection >= part * union share one
    of the first n - ceil(part * n / whole) + 1 of the larger set and one of the first
    n - ceil(2 * part * n / (whole + part)) + 1 of the smaller one; at the first that they
    share, what follows must suffice for both. Shingles of one component alone are left out,
    and members of a shingle's largest component meet only the others that have it, so a
    group of near copies costs no more than its number.
    """
    own = apart.join(texts.where("doc_id is not null").withColumnRenamed("doc_id", "id"), "id").select("id", "text").dropDuplicates(["id"])
    rows = materialize(own.transform(arrow_map, _shingles(k), "id long, shingles array<long>").select("id", F.explode("shingles").alias("shingle")), "shingles")
    common = materialize(rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), "common")
    by_id = Window.partitionBy("id")
    placed = rows.join(common, "shingle").join(apart, "id")
    placed = placed.withColumn("at", F.col("n") - F.count("*").over(by_id) + F.row_number().over(by_id.orderBy("c", "shingle")))  # those of one document alone come before
    within = lambda over, under: F.col("at") <= F.col("n") - F.expr(f"(n * {over} + {under - 1}) div {under}") + 1
    placed = materialize(placed.where(within(part, whole)).select("shingle", "id", "n", "component", "at", F.ceil(F.col("c") / SPREAD).alias("groups")), "prefixes")
    owners = placed.groupBy("shingle", "component", "groups").agg(F.count("*").alias("c"))
    owners = owners.groupBy("shingle", "groups").agg(F.count("*").alias("owners"), F.max_by("component", F.struct("c", "component")).alias("largest")).where("owners > 1")
    group, all_groups = F.pmod(F.xxhash64("id"), F.col("groups")), F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)
    owners = owners.select("shingle", "largest", F.explode(all_groups).alias("group"))  # a frequent shingle is dealt over groups
    shared = materialize(placed.withColumn("group", group).join(owners, ["shingle", "group"]).withColumn("main", F.col("component") == F.col("largest")).drop("largest"), "shared")

    def ends(df: DataFrame, x: str, own: int, other: int) -> DataFrame:
        """Members of the largest component meet others in their own group, others meet those in every group, and one another in group -1."""
        at = lambda kind, g: F.struct(F.lit(kind).alias("kind"), g.alias("group"))
        meets = F.when(F.col("main"), F.array(at(own, F.col("group")))).otherwise(F.concat(F.transform(all_groups, lambda g: at(other, g)), F.array(at(2, F.lit(-1).cast("long")))))
        return df.select("shingle", F.explode(meets).alias("meets"), *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "component", "at")))

    smaller, larger = ends(shared.where(within(2 * part, whole + part)), "a", 0, 1), ends(shared, "b", 1, 0)
    follow = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    enough = follow * (whole + part) >= (F.col("n_a") + F.col("n_b")) * part
    in_order = F.struct("n_a", "id_a") < F.struct("n_b", "id_b")
    pairs = smaller.join(larger, ["shingle", "meets"]).where(in_order & (F.col("component_a") != F.col("component_b")) & enough)
    return pairs.select(F.col("id_a").alias("a"), F.col("n_a").alias("na"), F.col("id_b").alias("b"), F.col("n_b").alias("nb"))


def near_duplicates(docs: DataFrame, *, k: int = 5, part: int = 75, whole: int = 100, bands: int = 32, rows: int = 4) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Documents are linked whose sets of distinct k-word shingles (A-Z lower-cased) have
    whole * intersection >= part * union; component_id is the smallest doc_id reachable.
    A document of fewer than k words is one shingle, its whole sequence; null, empty and
    blank texts have the empty set and are linked with nothing. Rows that repeat a doc_id
    are the same document. A null doc_id gets a null component and is not kept, and links
    nothing. Other columns are ignored, whatever their names. A link of similarity s is
    missed with probability (1 - s ** rows) ** bands: 5e-6 at 0.75, far less above it.

    Exact copies are folded into one class before banding, so a group of copies costs one
    row for each map task; hot buckets are split by the join's adaptive skew handling.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(texts.transform(arrow_map, _features(k, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "features")
    filled = found.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    members = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("keys").alias("band", "key"))

    pairs, large = _candidates(members)
    links = materialize(_confirm(pairs, texts, k, part, whole), "links")
    large = materialize(large, "large")
    if not large.isEmpty():
        # Members of a large bucket that were not joined with its leader may still be linked with one another.
        label = connected_components(links)
        own = label.select(F.col("id"), F.col("component").alias("own"))
        lead = label.select(F.col("id").alias("leader"), F.col("component").alias("theirs"))
        rest = large.join(own, "id", "left").join(lead, "leader", "left")
        rest = rest.where(F.coalesce("own", "id") != F.coalesce("theirs", "leader")).select("id", "n", "key", "band")
        keys = reps.select(F.col("doc_id").alias("id"), "keys")
        next_keys = [F.element_at("keys", (F.col("band") + j) % bands + 1) for j in range(1, REDEALT + 1)]
        rest = rest.join(keys, "id").select("id", "n", F.col("key").alias("first"), F.explode(F.array(*next_keys)).alias("second"))
        rest = rest.select("id", "n", F.xxhash64("first", "second").alias("key"))
        rest = materialize(rest, "rest")
        if not rest.isEmpty():
            more, _ = _candidates(rest)
            links = materialize(links.unionAll(_confirm(more, texts, k, part, whole)), "links")
            apart = materialize(_left_apart(large, links), "apart")
            if not apart.isEmpty():
                more = _exact_candidates(apart, texts, k, part, whole)
                links = links.unionAll(materialize(_confirm(more, texts, k, part, whole), "links"))
    label = connected_components(links)
    of_class = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = found.drop("keys").join(of_class, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """Pairs (a, na, b, nb) that hold on full sets. A document with many partners goes to a group for each SPREAD of them."""
    pairs = pairs.where(F.least("na", "nb") * whole >= F.greatest("na", "nb") * part).select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > SPREAD).select("a", F.ceil(F.col("c") / SPREAD).alias("groups"))
    many = materialize(many, "many")
    pairs = pairs.join(F.broadcast(many) if many.count() <= BROADCAST else many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).alias("group"))
    texts = texts.where("doc_id is not null")
    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    first = pairs.select("a", "group").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = second.join(first.hint("merge"), ["a", "group"])
    return both.select("a", "text_a", "b", "text_b").transform(arrow_map, _verified(k, part, whole), "a long, b long").distinct()


def keep_one_of_each(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of docs, all columns, of the document with the smallest doc_id of each group of near copies.

    Of rows that repeat a doc_id the one with the least text stays (null first). Rows with
    a null doc_id stay, all of them.
    """
    found = near_duplicates(docs, **how)
    dropped = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    again = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    own = F.col("doc_id").cast("long")
    dropped = dropped.withColumnRenamed("doc_id", "dropped_doc_id")
    stay = docs.join(dropped, own == dropped["dropped_doc_id"], "left_anti")
    if again.isEmpty():
        return stay
    again = again.withColumnRenamed("doc_id", "repeated_doc_id")
    once = stay.join(again, own == again["repeated_doc_id"], "left_anti")
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), "text")).alias("row")
    rows = stay.join(again, own == again["repeated_doc_id"], "left_semi").groupBy(own).agg(first).select("row.*")
    return once.unionByName(rows)
