from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import embedding as E
from memloom.operators import graph as G
from memloom.operators import kg as K
from memloom.operators import layers as L
from memloom.operators import registry as R
from memloom.sources import files as S
from memloom.streaming import checkpoints as C

FACTS = "id string, subject string, predicate string, object string, valid_from string, valid_to string"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("1", "Max", "works_at", "Acme", "2025-01-01", "2026-03-01"), ("2", "Max", "knows", "max", None, ""), ("3", "Ann", "likes", "MAX", "2025-05-05", None)], FACTS)


def test_as_of_is_closed_and_compares_text(facts):
    at = lambda day: {r["id"] for r in K.query_entity(facts, "max", day, "outgoing").collect()}
    assert at("2026-01-15") == at("2025-01-01") == at("2026-03-01") == {"1", "2"}
    assert at("2026-06-01") == at("2024-12-31") == {"2"}


def test_a_fact_about_itself(facts):
    assert sorted(r["id"] for r in K.query_entity(facts, "MAX").collect()) == ["1", "2", "2", "3"]
    assert [r["id"] for r in K.timeline(facts, "max").collect()] == ["2", "1", "3"]
    assert {r["id"]: r["current"] for r in K.timeline(facts).collect()} == {"1": False, "2": True, "3": True}
    assert all(r["current"] for r in K.query_entity(facts, "max").collect())  # without a day every fact is


def test_filing_again_revives(spark):
    log = [(1, "add_entity", "Max", None, None, "person", None), (2, "add", "Max", "at", "Acme", None, "2025-01-01"), (3, "invalidate", "max", "AT", "acme", None, "2025-06-01"), (4, "add", "MAX", "at", "Acme", None, "2026-01-01")]
    entities, triples = K.replay(spark.createDataFrame(log, "seq int, op string, subject string, predicate string, object string, type string, date string"))
    assert [(r["subject"], r["valid_from"], r["valid_to"]) for r in triples.collect()] == [("MAX", "2026-01-01", None)]
    assert {r["name"]: r["type"] for r in entities.collect()} == {"MAX": "unknown", "Acme": "unknown"}
    _, before = K.replay(spark.createDataFrame(log[:3], "seq int, op string, subject string, predicate string, object string, type string, date string"))
    assert before.first()["valid_to"] == "2025-06-01"


def test_empty_tables(spark):
    drawers = spark.createDataFrame([], "room string, wing string, content string, source_file string, ord long, extra map<string,string>, extra_type map<string,string>")
    assert G.traverse(drawers, "r", 3).count() == 0
    assert L.essential_story(drawers).first()[0] == "## L1 — No memories yet."
    assert K.stats(spark.createDataFrame([], FACTS)).first()["triples"] == 0


@pytest.mark.parametrize(("value", "kind", "want"), [("4.5", "number", 4.5), ("", "string", 0.0), ("true", "boolean", 1.0), ("many", "string", 3.0), (None, "number", 3.0)])
def test_importance(spark, value, kind, want):
    df = spark.createDataFrame([({"importance": value}, {"importance": kind})], "extra map<string,string>, extra_type map<string,string>")
    assert df.select(L.importance().alias("x")).first()[0] == want


def test_story_stops_at_its_budget(spark):
    rows = [(f"r{i % 3}", "w", "x" * 400, f"/a/{i}.txt", i, {"weight": str(i)}, {"weight": "number"}) for i in range(40)]
    df = spark.createDataFrame(rows, "room string, wing string, content string, source_file string, ord long, extra map<string,string>, extra_type map<string,string>")
    lines = [r["line"] for r in L.story_lines(df).orderBy("nth").collect()]
    assert lines[-1] == L.MORE and sum(map(len, lines[:-1])) <= L.MOST_CHARS
    assert "(39.txt)" in "".join(lines)


def test_word_pieces():
    vocabulary = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] don ' t cafe un ##aff ##able".split())}
    assert E.basic_words("don't Café\t日本") == ["don", "'", "t", "cafe", "日", "本"]
    assert E.word_pieces("unaffable", vocabulary) == ["un", "##aff", "##able"]
    assert E.word_pieces("x" * 101, vocabulary) == ["[UNK]"]
    ids, mask = E.encode_batch(["don't", ""], vocabulary)
    assert ids.tolist() == [[2, 4, 5, 6, 3], [2, 3, 0, 0, 0]] and mask.sum(1).tolist() == [5, 2]
    assert len(E.encode("a " * 500, vocabulary)) == E.MOST_TOKENS
    pooled = E.mean_pool(np.ones((1, 3, 4)), np.array([[1, 1, 0]]))
    assert np.allclose(np.linalg.norm(pooled), 1)


def test_migration(spark):
    rows = [("a", "text", E.MODEL_TAG, "t0", [1.0]), ("b", "more", None, None, None), ("c", None, None, None, None), ("d", "", None, None, None)]
    df = spark.createDataFrame(rows, "drawer_id string, content string, embedding_model string, embedded_at string, embedding array<float>")
    assert E.migration_counts(df, E.MODEL_TAG, resume=True).first().asDict() == {"processed": 4, "updated": 1, "skipped": 1, "total": 4}
    assert E.migration_counts(df, E.MODEL_TAG, resume=False).first()["updated"] == 2
    out = {r["drawer_id"]: r for r in E.migrate(df, E.HashingEmbedder(), now="t1", resume=True).collect()}
    assert (out["a"]["embedded_at"], out["b"]["embedded_at"], out["c"]["embedding"]) == ("t0", "t1", None)
    assert len(out["b"]["embedding"]) == E.DIMENSION


def test_hook():
    assert C.hook("s", 15, 0)[1] == 15 and C.hook("s", 29, 15) == ({}, 15)
    assert C.hook("s", 30, 0, active=True) == ({}, 0) and C.before_compaction()["decision"] == "block"


def test_stream_agrees_with_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(f"s{i % 3}", i) for i in range(140)]
    for k in range(4):
        spark.createDataFrame(rows[35 * k : 35 * k + 35], "session string, n int").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("session string, n int").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = C.stream_checkpoints(stream, "session").writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    streamed = {r["session"]: r["n"] for r in spark.sql("select session, sum(saves) n from saves group by session").collect()}
    batch = C.checkpoints(spark.createDataFrame(rows, "session string, n int"), "session", "n")
    assert streamed == {r["session"]: r["count"] for r in batch.groupBy("session").count().collect()}


def test_stream_mining_skips_what_is_filed(spark, tmp_path):
    chats = tmp_path / "chats"
    (chats / "node_modules").mkdir(parents=True)
    (chats / "a.txt").write_text("> why is the build broken again?\nBecause of a bug in the code.\n> and the test?\n> ok\n")
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name in ("b.txt", None):
        C.stream_mining(spark, str(chats), target, state, wing="w").awaitTermination()
        if name:
            (chats / name).write_text("One paragraph that is long enough to be filed.\n\nAnother one that is long enough, too.")
    out = spark.read.parquet(target)
    assert out.count() == 3 and out.select("drawer_id").distinct().count() == 3


def test_files(spark, tmp_path):
    for name in ("x.md", "y.JSONL", "z.meta.json", "w.py", "node_modules/n.txt", "q r.txt", "s.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    n, paths, more = S.list_chat_files(spark, str(tmp_path), 2)
    assert (n, len(paths), more) == (4, 2, True)
    assert {r["path"].rsplit("/", 1)[-1] for r in S.chat_files(spark, str(tmp_path)).collect()} == {"x.md", "y.JSONL", "q r.txt", "s.txt"}
    assert S.detection_files(spark, str(tmp_path)).count() == 3  # three prose files leave the code out


def test_registry_and_config_files(tmp_path):
    path = tmp_path / "deep" / "registry.json"
    assert S.load_registry(path) == S.EMPTY_REGISTRY
    S.save_registry(path, S.EMPTY_REGISTRY | {"mode": "work"})
    assert S.load_registry(path)["mode"] == "work"
    path.write_text("{broken")
    assert S.load_registry(path) == S.EMPTY_REGISTRY
    folder = tmp_path / "deep" / S.CONFIG_FOLDER
    folder.mkdir()
    (folder / "config.json").write_text(json.dumps({"metric": "dot"}))
    found = S.load_config(tmp_path / "deep" / "er", env={"MEMLOOM_COLLECTION": "mine"}, home=tmp_path)
    assert (found["metric"], found["collection"]) == ("dot", "mine")
    assert L.load_identity([tmp_path / "none", path]).endswith("{broken")


def test_research_and_confirmation(spark):
    wiki = spark.createDataFrame([("Old", "concept", 0.6, "t", "s", False)], "word string, inferred_type string, confidence double, title string, summary string, confirmed boolean")
    pages = spark.createDataFrame([("New", 404, None, None, None, None), ("Old", 404, None, None, None, None)], "word string, status int, page_type string, title string, description string, extract string")
    found = R.research(spark.createDataFrame([("New",), ("Old",)], "word string"), wiki, pages)
    assert {r["word"]: (r["inferred_type"], r["confirmed"]) for r in found.collect()} == {"Old": ("concept", False), "New": ("person", False)}
    people = R.seed(spark.createDataFrame([("Ann", None, None, 0)], "name string, relationship string, context string, ord int"), spark.createDataFrame([], "alias string, canonical string, ord int"))
    more, marked = R.confirm(people, found, spark.createDataFrame([("New", "person", None, None)], "word string, entity_type string, relationship string, context string"))
    assert {r["name"]: r["confidence"] for r in more.collect()} == {"Ann": 1.0, "New": 0.9}
    assert {r["word"] for r in marked.where(F.col("confirmed")).collect()} == {"New"}
