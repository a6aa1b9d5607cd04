from __future__ import annotations

import pytest

from memloom.memory import Memory


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, f"file://{tmp_path}/m")


def test_drawers(memory):
    assert memory.get_taxonomy().count() == 0 and memory.search("anything").count() == 0
    made = memory.add_drawer("home", "tea", "The kettle is blue and whistles.", metadata={"size": "big", "n": 3, "tags": ["a"], "filed_at": "never"})
    again = memory.add_drawer("home", "tea", "The kettle is blue and whistles.")
    other = memory.add_drawer("work", "tea", "Deploy the server on Monday.")
    assert made["success"] and other["success"] and again["matches"][0]["drawer_id"] == made["drawer_id"]
    assert memory.search("blue kettle").first()["drawer_id"] == made["drawer_id"]
    assert memory.search("blue kettle", wing="work").first()["drawer_id"] == other["drawer_id"]
    assert memory.query_by_metadata("size", "big").count() == 1 and memory.query_by_metadata("n", "3").count() == 0
    assert memory.query_by_date("2020-01-01T00:00:00Z").count() == 2
    assert {r["room"]: r["n_wings"] for r in memory.find_tunnels("home").collect()} == {"tea": 2}
    assert memory.graph_stats()["tunnel_rooms"] == 1 and memory.traverse("te").first()["near"]
    assert memory.update_drawer(made["drawer_id"], content="The kettle is red.", wing="attic", metadata={"n": "4"})["success"]
    got = memory.get_drawer(made["drawer_id"])
    assert (got["content"], got["wing"], got["extra"]["n"], got["extra"]["size"]) == ("The kettle is red.", "attic", "4", "big") and "filed_at" not in got["extra"]
    assert memory.query_by_metadata("n", "4").count() == 1
    assert memory.delete_drawer(other["drawer_id"])["success"] and "error" in memory.get_drawer(other["drawer_id"])
    assert [(r["wing"], r["drawers"]) for r in memory.list_wings().collect()] == [("attic", 1)]
    assert memory.layer_status()["total_drawers"] == 1 and "red" in memory.wake_up()["text"]
    assert memory.recall("attic").count() == 1 and memory.deep_search("red kettle").count() == 1
    assert memory.list_rooms("attic").count() == 1 and memory.status().count() == 3
    assert "error" in memory.update_drawer("none") and "error" in memory.delete_drawer("none")


def test_facts(memory):
    assert memory.kg_query("Max").count() == 0
    memory.kg_add("Max", "works_at", "Acme", "2025-01-01")
    assert memory.kg_invalidate("max", "works_at", "acme", "2026-03-01")["success"]
    assert memory.kg_query("MAX", "2026-01-15").count() == 1 and memory.kg_query("max", "2026-06-01").count() == 0
    memory.kg_add("Max", "works_at", "Acme", "2026-07-01")
    assert memory.kg_timeline("acme").first()["current"] and memory.kg_stats().first()["expired_facts"] == 0


def test_diary(memory):
    for i in range(3):
        memory.diary_write("Ann Lee", f"entry {i}", "work")
    found = memory.diary_read("Ann Lee", 2).orderBy("nth").collect()
    assert [r["entry"] for r in found] == ["entry 2", "entry 1"] and found[0]["total"] == 3


def test_summaries(memory):
    assert memory.compress("We chose tea.", wing="w").startswith("w|?|?|?\n0:")
    assert memory.compress_stats("one two three")["original_tokens_est"] == 4
    assert memory.decode("a|b|c|d\n1:X|t")["zettels"] == ["1:X|t"] and memory.get_spec()


def test_mining(memory, tmp_path):
    chats = tmp_path / "My Chats"
    chats.mkdir()
    (chats / "a.txt").write_text("> why is the build broken again?\nBecause of a bug in the code.\n> and the test?\n> ok\n")
    assert memory.scan_convos(str(chats))["count"] == 1
    assert memory.mine_convos(str(chats), dry_run=True).first()["drawers"] == 1
    assert memory.mine_convos(str(chats)).first()["drawers"] == 1
    assert memory.mine_convos(str(chats)).count() == 0
    assert [r["wing"] for r in memory.list_wings().collect()] == ["my_chats"]
    (chats / "b.md").write_text("hey Zora, thanks Zora. Zora said so, hi Zora")
    assert [r["name"] for r in memory.detect_entities(str(chats)).collect()] == ["Zora"]


def test_entities(memory, spark):
    memory.entity_seed([{"name": "Grace", "relationship": "sister"}], ["Atlas"], {"Gracie": "Grace"})
    assert memory.entity_lookup("gracie")["name"] == "Grace" and memory.entity_lookup("atlas")["type"] == "project"
    assert memory.entity_lookup("Grace", "the grace of it")["type"] == "concept"
    assert memory.entity_learn("Hey Zora, thanks Zora. Zora came. Zora left.") == ["Zora"]
    assert memory.entity_learn("Hey Zora, thanks Zora. Zora came. Zora left.") == []
    pages = spark.createDataFrame([("Quill", 200, "standard", "Quill", "", "Quill is a given name")], "word string, status int, page_type string, title string, description string, extract string")
    assert memory.entity_lookup("Quill")["type"] == "unknown"
    assert memory.entity_research("Quill", pages, confirm=True)["confidence"] == 0.9
    assert memory.entity_lookup("quill")["source"] == "wiki" and memory.entity_research("None", pages)["inferred_type"] == "unknown"
    assert "People: 3 (Grace, Gracie, Zora)" in memory.entity_summary()
