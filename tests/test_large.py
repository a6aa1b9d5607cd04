"""Faults that showed on larger tables only, each in a small case."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions.text import SPACES
from memloom.operators import dialect as S
from memloom.operators import embedding as B
from memloom.operators import entities as E
from memloom.operators import registry as R
from memloom.operators import vectors as V
from memloom.plans import all_queries
from tests.oracle import connect, expected, rows
from tests.test_queries import SF

QUERIES, ORACLE = all_queries()


@pytest.fixture
def small_broadcasts(spark):
    """The planner may choose broadcasts, but one of more than 40 MB is an error (an empty one has 32)."""
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(40 << 20))
    yield
    spark.conf.set(key, before)


def with_documents(spark, folder, change):
    """The smallest tables with other documents."""
    for f in os.listdir(SF):
        if f != "documents.parquet":
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
    change(spark.read.parquet(f"{SF}/documents.parquet")).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_words_of_texts_are_not_broadcast(spark, tmp_path, small_broadcasts, monkeypatch):
    """The file is small and its estimate too; its words by number are not."""
    spark.range(40_000).selectExpr("id as query_id", "concat('Ann met Bob and they saw a lot of other things on the way ', id) as text").write.parquet(str(tmp_path / "q"))
    people = R.seed(spark.createDataFrame([("Ann", None, None, 0)], "name string, relationship string, context string, ord int"), spark.createDataFrame([], "alias string, canonical string, ord int"))
    for most in (50_000, 0):
        monkeypatch.setattr(R, "MOST_NAMES", most)
        assert R.people_in(spark.read.parquet(str(tmp_path / "q")), people).count() == 40_000


def test_resumed_migration_with_empty_documents(spark, tmp_path):
    d = with_documents(spark, tmp_path, lambda x: x.selectExpr("doc_id", "case when doc_id % 7 = 1 then '' when doc_id % 7 != 2 then text end as text", "lang", "source", "n_chars"))
    assert rows(QUERIES["migrate_resume_counts"](spark, d)) == expected(connect(d), ORACLE["migrate_resume_counts"])[1]


@pytest.mark.parametrize("alone", [True, False])
def test_inner_blocks_of_a_tile(monkeypatch, alone):
    """Ties within and across blocks go to the first rows; bounds taken from earlier blocks lose nothing."""
    for name, n in (("_QUERIES", 7), ("_VECTORS", 16), ("_FIRST", 8)):
        monkeypatch.setattr(V, name, n)
    x = np.random.default_rng(5).standard_normal((300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40:120] = x[2]
    q = x[::9]
    same = None if alone else lambda a, b: np.arange(0, 300, 9)[a, None] == np.arange(300)[None, b]
    who, row, best = V._best(q, x, 5, same)
    for i in range(len(q)):
        s = np.floor(sum(q[i, d] * x[:, d] for d in range(4)) * 1000 + 0.5)
        order = [j for j in np.lexsort((np.arange(300), -s)) if alone or j != 9 * i][:5]
        assert row[who == i].tolist() == order and best[who == i].tolist() == s[order].tolist()


@pytest.mark.parametrize("length", [1.0, 1e3])
def test_products_of_single_precision_only_choose(monkeypatch, length):
    """Sums that single precision can't tell apart, half of them just below a half thousandth, are ranked by double precision."""
    monkeypatch.setattr(V, "_FIRST", 8)
    q = np.array([[length, 0.0]])
    x = np.stack([(0.5005 + np.where(np.arange(200) % 3, -1e-12, 1e-12)) / length, np.linspace(0, 0.8, 200) * length], axis=1)
    who, row, best = V._best(q, x, 5, None)
    assert row.tolist() == [0, 3, 6, 9, 12] and best.tolist() == [501] * 5 and who.tolist() == [0] * 5
    assert {m.dtype for m in V._products(q, x)[:2]} == {np.dtype(np.float32 if length == 1 else np.float64)}


def plain_nearest(store, queries, k, exclude_self):
    """Pair by pair, by column expressions."""
    met = store.crossJoin(queries.selectExpr("id as query_id", "embedding as _q")).where((F.col("id") != F.col("query_id")) | F.lit(not exclude_self))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return met.select("query_id", "id", V.similarity(F.col("embedding"), F.col("_q")).alias("similarity")).withColumn("rank", rank).where(F.col("rank") <= k)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize(("k", "exclude_self"), [(1, False), (5, False), (5, True), (400, False)])
def test_tiles_find_what_all_pairs_hold(spark, monkeypatch, k, exclude_self, kind):
    """Copies, ties, odd lengths and nulls, over tiles and inner blocks far smaller than the tables."""
    for name, n in (("QUERY_TILE", 20), ("STORE_TILE", 90), ("_QUERIES", 7), ("_VECTORS", 16), ("_FIRST", 8)):
        monkeypatch.setattr(V, name, n)
    x = np.random.default_rng(3).standard_normal((300, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[10:90] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.5]), (302, [None] * 6), (303, [])]
    store = spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("id", F.col("id").cast(kind)).cache()
    queries = store.where("id % 6 = 0 or id >= 300")
    found, want = V.nearest(store, queries, k, exclude_self=exclude_self), plain_nearest(store, queries, k, exclude_self)
    assert rows_of(found) == rows_of(want) and found.columns == want.columns


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("threshold", [-2.0, 0.3, 0.6, 0.9, 1.0])
def test_new_rows_meet_the_rest_of_the_store_only_while_unsettled(spark, monkeypatch, threshold):
    """A twin, a near one, one with its only twin in the last part, odd lengths and nulls; as by all pairs."""
    for name, n in (("QUERY_TILE", 20), ("STORE_TILE", 90), ("_QUERIES", 7), ("_VECTORS", 16), ("_FIRST", 8)):
        monkeypatch.setattr(V, name, n)
    x = np.random.default_rng(4).standard_normal((300, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[::30] = x[1::30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.5]), (302, [None] * 6), (303, [])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").cache()
    store, new = v.where("id % 6 != 0 or id = 301"), v.where("id % 6 = 0 or id >= 300")
    best = plain_nearest(store, new, 1, False).where(F.col("similarity") >= threshold)
    assert rows_of(V.without_duplicates(store, new, threshold).select("id")) == rows_of(new.join(best.select(F.col("query_id").alias("id")), "id", "left_anti").select("id"))


def test_pairs_met_by_new_rows_grow_with_the_rows():
    """Before, each new row met each stored one."""
    x = np.random.default_rng(6).standard_normal((20_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, pairs = V._any(x[::20], x, 0.5)
    assert found.all() and pairs < 1000 * 1000


def test_search_has_one_plan_for_any_number_of_queries(spark, monkeypatch):
    """Before, each block of queries was a branch of the plan that scanned the store anew."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 10, raising=False)
    monkeypatch.setattr(V, "QUERY_TILE", 10)
    v = spark.range(100).selectExpr("id", "array(cast(id as float)) as embedding")
    plan = V.nearest(v, v, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("Range (") == 2


def test_costly_expressions_of_notes_run_in_many_tasks(spark):
    """The file of events has one row group, so one task reads it."""
    assert QUERIES["decode"](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_patterns_are_searched_once_by_tasks_dealt_by_texts(spark, tmp_path):
    spark.createDataFrame([(1, "Ann said. Ann laughed. Hey Ann! Hi Ann, thanks Ann.")], "k int, text string").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    found = E.score(E.candidates(texts, "k"), texts, "k")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("laughed") == 2  # once in contains, once in the pattern
    assert found.first().asDict() == {"k": 1, "name": "Ann", "frequency": 5, "person_score": 22, "project_score": 0, "person_signals": [f"'Ann ...' action ({n}x)" for n in (1, 1, 1)], "project_signals": []}
    assert E.needed_word(r"\bthe\s+{}\s+architecture\b") == "architecture"


def test_embedding_holds_few_rows(spark):
    class Frame:
        schema = spark.createDataFrame([], "k long, t string").schema
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    texts = [None if i % 5 == 0 else f"text {i}" for i in range(2500)]
    run = B.embed_column(Frame, "t", B.HashingEmbedder())
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(texts)], ["k", "t"])])))
    assert [b.num_rows for b in out] == [1024, 1024, 452]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["k"] for r in rows] == list(range(2500)) and [r["embedding"] is None for r in rows] == [t is None for t in texts]
    assert rows[7]["embedding"] == B.HashingEmbedder().embed(["text 7"])[0].tolist()


def test_tokens_are_counted_without_regular_expressions(spark):
    texts = [None, "", "  ", "a", f"{SPACES}a{SPACES}b é\u0085c\u200bd ", "one two\n\tthree"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", S.count_tokens("t").alias("n"))
    assert [r["n"] for r in found.orderBy("i").collect()] == [1, 1, 1, 1, 4, 4]
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
