"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame operations alone.

Every benchmark item gives windows of ``window`` consecutive words (a shorter item is one
window). Words are ordered by how often the corpus has them. To contain a window whole, a
document must contain its rarest word, so that single prefix token is joined; its place in
the window fixes where the window would start (positional bound), which must leave room for
all of it (length bound); the words at that place are then compared one by one.

Documents are scanned once for the frequencies and once for the hits, however large the
benchmark. Up to ``BROADCAST`` windows, a number that is checked first, the prefix tokens are
broadcast, and words are exploded, met with them and verified against the row's own word
array in one generated stage, so that only verified hits move. Beyond it, prefix tokens
and the corpus' words meet by shuffle, without texts, and the places found are sent to
their documents to be verified there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows that are broadcast at most: about 500 bytes each, so 25 MB.
BROADCAST = 50_000
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of ASCII letters, digits and non-ASCII characters. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _SMALL), _BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """benchmark (item_id, text, ...) -> distinct windows (w array<string>, items array<string>: the ids that have it, as text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("item is not null and size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("w"))
    return each.groupBy("w").agg(F.collect_set("item").alias("items"))


def window_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, broadcast: int = BROADCAST) -> DataFrame:
    """Every occurrence of a benchmark window: (doc_id, start, n: its words, items). doc_id may have any type.

    With more than ``broadcast`` windows, rows that repeat a doc_id get each other's hits as
    far as these fit them; so do hits of rows with a null doc_id.
    """
    windows = benchmark_windows(benchmark, window)
    small = windows.count() <= broadcast
    light = F.broadcast if small else (lambda df: df)
    texts = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    places = windows.select("w", "items", F.posexplode("w").alias("place", "word"))
    # How often documents have each word of the benchmark: as many rows as the benchmark has words.
    vocabulary = light(places.select("word").distinct())
    counts = texts.select(F.explode("words").alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    ranked = places.join(light(counts), "word", "left")
    rarest = ranked.groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("r"), F.first("items").alias("items"))
    rarest = rarest.where("r.n > 0")  # a window with a word that no document has occurs nowhere
    prefix = light(rarest.select(F.col("r.word").alias("token"), F.col("r.place").alias("place"), F.size("w").alias("n"), "w", "items"))
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("n") <= F.col("size"))
    same = F.when(fits, (F.element_at("words", start + 1) == F.element_at("w", 1)) & (F.slice("words", start + 1, F.col("n")) == F.col("w"))).otherwise(F.lit(False))
    if small:
        words = texts.select("doc_id", "words", F.size("words").alias("size"), F.posexplode("words").alias("at", "token"))
        return words.join(prefix, "token").where(same).select("doc_id", start.alias("start"), "n", "items")
    words = texts.select("doc_id", F.size("words").alias("size"), F.posexplode("words").alias("at", "token"))
    found = words.join(prefix, "token").where(fits).select(F.col("doc_id").alias("id"), "at", "place", "n", "w", "items")
    there = found.join(texts.select("doc_id", "words", F.size("words").alias("size")), F.col("id").eqNullSafe(F.col("doc_id")))
    return there.where(same).select("doc_id", start.alias("start"), "n", "items")


def _measured(docs: DataFrame, benchmark: DataFrame, window: int, broadcast: int) -> DataFrame:
    """docs (doc_id of any type, text) -> (doc_id, n_words, n_hit, longest: words of the longest window, n_items, ids), a row for each row of docs."""
    hits = window_hits(docs, benchmark, window=window, broadcast=broadcast)
    by_doc = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.max("n").alias("longest"))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def add(done: Column, span: Column) -> Column:
        end = F.greatest(done["end"], span["start"] + span["n"])
        return F.struct(end.alias("end"), (done["hit"] + end - F.greatest(done["end"], F.least(span["start"], end))).alias("hit"))

    by_doc = by_doc.select(F.col("doc_id").alias("id"), F.aggregate("spans", nothing, add)["hit"].alias("n_hit"), "longest", F.size("items").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("ids"))
    counted = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("longest"), zero("n_items"), F.coalesce("ids", F.lit("")).alias("ids"))


def _heavy(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, broadcast: int = BROADCAST) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    A word inside any occurrence of a benchmark window is hit; a document is contaminated
    if at least one in share of its words is. items_sha256 is that of the ids of the items
    with occurring windows, sorted as text and joined by commas. Null and empty texts have
    no words and no hits; items without words or id are left out; an empty benchmark hits
    nothing. Rows that repeat a doc_id (null too) share their hits. Other columns are
    ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _measured(docs, benchmark, window, broadcast)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("ids", 256).alias("items_sha256"), _heavy(share).alias("contaminated"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of docs, all columns, whose text has no window of ``window`` benchmark words.

    Items of fewer words count as well if at least one in share of the text's words lies in
    them; a stray short item leaves a document in place. Rows are judged by their text
    alone, so a null or repeated doc_id is like any other; null texts stay.
    """
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    leaked = _measured(texts, benchmark, window, broadcast).where((F.col("longest") >= window) | _heavy(share)).select(F.col("doc_id").alias("leaked_text")).distinct()
    return docs.join(leaked, key == leaked["leaked_text"], "left_anti")
