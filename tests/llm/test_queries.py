from __future__ import annotations

import pytest

import corpus_pipeline
from memloom.llm.queries import ORACLE, QUERIES
from tests.llm import brute
from tests.llm.test_tokens import check_packed
from tests.oracle import connect, expected, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    found = QUERIES[name](spark, SF)
    columns, want = expected(connect(SF), ORACLE[name])
    assert sorted(found.columns) == columns
    assert rows(found) == want


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_pipeline(spark):
    """Each stage against its plain version, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == before.columns
        out[name] = (texts(before), texts(docs) if name != "packing" else docs.collect())
    given, kept = out["toxicity"]
    toxic = {r["doc_id"] for r in QUERIES["op6_toxicity_ftrl"](spark, SF).where("predicted = 1").collect()}
    assert kept == {i: t for i, t in given.items() if i not in toxic}
    given, kept = out["near_dedup"]
    assert set(kept) == {i for i, (_, c) in brute.near_duplicates(given).items() if i == c}
    given, kept = out["substring_dedup"]
    assert kept == {i: " ".join(k) if n > len(k) else given[i] for i, (n, k) in brute.remove_repeats(given).items()}
    given, kept = out["decontamination"]
    assert set(kept) == {i for i, x in brute.contamination(given, items).items() if not x[1]}
    given, packed = out["packing"]
    check_packed(packed, given, 1024)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted((r["doc_id"], r["piece"], r["length"]) for r in packed)


def test_pipeline_stages_on_odd_rows(spark):
    """Null and repeated doc_ids, null, empty and long texts, ties, and columns of any name: each stage alone, on the same rows."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    long, same = " ".join(f"w{i}" for i in range(30_000)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, same), (5, same), (3, same), (3, same), (9, None), (10, ""), (11, " \n"), (12, long), (13, f"{same[:9]} {item} x"), (None, item), (14, "one"), (14, "two")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, needs string, key string, row string, leaked_text string, group string"
    docs = spark.createDataFrame([(i, t, None, "s", None, *["x"] * 6) for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        found = stages[name](spark, docs, SF)
        assert found.columns == docs.columns and stages[name](spark, docs.limit(0), SF).count() == 0
        got = found.collect()
        assert {tuple(r)[5:] for r in got} == {("x",) * 6}
        return sorted((r["doc_id"] or 0, r["text"] or "") for r in got)

    plain = sorted((i or 0, t or "") for i, t in rows)
    assert after("toxicity") == plain
    assert after("near_dedup") == sorted([(0, same), (3, same), (9, ""), (10, ""), (11, " \n"), (12, long), (13, rows[8][1]), (0, item), (14, "one")])
    cut = dict.fromkeys((3, 5), "")
    assert [x for x in after("substring_dedup") if x[0] == 5] == [(5, "")] and [x for x in after("substring_dedup") if x[0] not in cut] == [x for x in plain if x[0] not in cut]
    assert after("decontamination") == [x for x in plain if item not in x[1]]
    packed = stages["packing"](spark, docs, SF).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and sorted(r["doc_id"] or 0 for r in packed if not r["piece"]) == [i for i, _ in plain]
    assert stages["packing"](spark, docs.limit(0), SF).count() == 0
