from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import near_dedup as N
from memloom.llm import substring_dedup as S
from memloom.llm.components import connected_components
from memloom.llm.decontaminate import contamination, drop_leaked
from tests.llm import brute

ROW = "doc_id long, text string, key string, n string, part string, spans string, needs string, at string, row string, kept string, a string, component string"


def table(spark, rows):
    """With columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, *["x"] * 10) for i, t in rows], ROW)


def corpus(seed: int, n: int = 120) -> dict[int, str | None]:
    """Random texts with exact and near copies, chains of copies, shared passages and odd ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(45)]
    docs: dict[int, str | None] = {0: None, 1: "", 2: " \n\t", 3: "A b c", 4: "a B  c", 5: "one", 6: "é É É x y z", 7: "a b\x0bc"}
    texts: list[list[str]] = []
    for i in range(8, n):
        kind = r.random()
        if texts and kind < 0.4:
            t = list(r.choice(texts))
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                t[r.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(r.randint(1, 120))]
            if kind > 0.8:
                at = r.randint(0, len(t))
                t[at:at] = passage[r.randint(0, 10) : r.randint(20, 45)]
        texts.append(t)
        docs[i] = r.choice([" ", "\n", "  "]).join(t)
    docs[n] = " ".join(["a"] * 300)  # one word over and over
    docs[n + 1] = " ".join(texts[5] * 2)
    docs[n + 2] = " ".join(word() for _ in range(30_000))  # very long
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = corpus(seed)
    found = N.near_duplicates(table(spark, docs.items())).collect()
    want = brute.near_duplicates(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_large_buckets_keep_their_links(spark):
    """Near copies beyond SMALL in a bucket, and pairs of them that only hold with one another."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    docs = {}
    for i in range(60):
        t = list(base)
        t[r.randrange(100)] = f"x{i}"
        docs[i] = " ".join(t)
    for i in range(60, 90):  # share half with the base: alike in pairs alone
        docs[i] = " ".join(base[:50] + [f"y{i // 2}_{k}" for k in range(50)])
    found = N.near_duplicates(table(spark, docs.items())).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {i: c for i, (_, c) in brute.near_duplicates(docs).items()}


def test_links_beside_the_leader_are_found(spark):
    """Copies with edits of their own in large buckets: some hold only with members that the leader has already."""
    r = random.Random(1)
    docs = {}
    for i in range(300):
        t = [f"w{j}" for j in range(160)]
        for j in range(r.choice([2, 3, 4, 5, 6])):
            t[r.randrange(160)] = f"x{i}_{j}"
        docs[i] = " ".join(t)
    found = N.near_duplicates(table(spark, docs.items())).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {i: c for i, (_, c) in brute.near_duplicates(docs).items()}


def test_links_do_not_depend_on_the_second_deal(spark, monkeypatch):
    """Pairs on one template, whose buckets stay large when dealt anew by a single further band."""
    monkeypatch.setattr(N, "REDEALT", 1)
    r = random.Random(1)
    docs = {}
    for i in range(0, 240, 2):
        t = [f"w{j}" for j in range(160)]
        for j in range(3):
            t[r.randrange(160)] = f"p{i}_{j}"
        docs[i] = " ".join(t)
        for j in range(5):
            t[r.randrange(160)] = f"q{i}_{j}"
        docs[i + 1] = " ".join(t)
    found = N.near_duplicates(table(spark, docs.items())).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {i: c for i, (_, c) in brute.near_duplicates(docs).items()}


def test_pairs_in_a_family_of_templates(spark):
    """Documents on one template, 0.72 alike, of which pairs are 0.81 alike: each pair is found, and nothing else."""
    r = random.Random(11)
    docs = {}
    for i in range(0, 1600, 2):
        t = [f"w{j}" for j in range(160)]
        for j in (10, 25, 40, 55, 70):
            t[j] = f"p{i}_{j}"
        docs[i] = " ".join(t)
        for j in r.sample(range(80, 155, 8), 3):
            t[j] = f"q{i}"
        docs[i + 1] = " ".join(t)
    sets = {i: brute.shingle_set(docs[i]) for i in (0, 1, 2, 3)}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(0, 1) >= 0.75 > max(alike(0, 2), alike(0, 3), alike(1, 3))
    found = N.near_duplicates(table(spark, docs.items())).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {i: i - i % 2 for i in docs}


def test_a_document_with_many_partners_is_spread(spark, monkeypatch):
    monkeypatch.setattr(N, "SPREAD", 7)
    base = [f"w{i}" for i in range(100)]
    docs = {i: " ".join(base[:50] + [f"x{i}"] + base[51:]) for i in range(60)}
    found = N.near_duplicates(table(spark, docs.items())).collect()
    assert {x["component_id"] for x in found} == {0}


def test_one_row_of_each_document_stays(spark):
    same = "a b c d e f g"
    rows = [(5, same), (None, same), (3, same), (3, same), (3, None), (9, None), (8, "b c"), (8, "a c")]
    found = N.keep_one_of_each(table(spark, rows))
    assert found.columns == table(spark, rows).columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in found.collect()) == [(-1, same), (3, ""), (8, "a c"), (9, "")]
    assert N.keep_one_of_each(table(spark, [])).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    same = "a b c d e f g"
    found = N.near_duplicates(table(spark, [(5, same), (5, same), (None, same), (3, same), (9, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in found) == [(-1, -1, False), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert N.near_duplicates(table(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    all_of = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    sign = N.CirculantMinHash(512)
    a, b = sign(all_of[:1000]), sign(all_of[500:])
    assert abs((a == b).mean() - 1 / 3) < 0.1
    assert (sign(all_of[:10]) == sign(all_of[:10][::-1])).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {x["id"]: x["component"] for x in connected_components(df).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == brute.components(sorted({i for e in real for i in e}), real)
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    docs = corpus(seed)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(table(spark, docs.items())).collect()}
    want = {i: (n, n - len(k), " ".join(k)) for i, (n, k) in brute.remove_repeats(docs).items()}
    assert found == want
    assert any(x[1] for x in want.values())


def test_anchor_with_many_continuations(spark):
    """Windows of a hot anchor are dealt one by one; few rows a batch let an anchor go on over many."""
    common = [f"c{i}" for i in range(20)]
    docs = {i: " ".join([f"a{i % 350}x{j}" for j in range(13)] + common[: 19 + i % 2] + [f"b{i % 300}x{j}" for j in range(25)]) for i in range(600)}
    want = {i: (n, n - len(k), " ".join(k)) for i, (n, k) in brute.remove_repeats(docs).items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
        for hot in (2, 100, 1000):
            rows = S.remove_repeats(table(spark, docs.items()), hot=hot).collect()
            assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    found = S.remove_repeats(table(spark, [(None, text), (4, text), (4, text), (7, text), (9, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in found) == [(-1, 0), (4, 0), (4, 0), (7, 30), (9, 0)]
    assert S.remove_repeats(table(spark, [])).count() == 0
    out = S.replace_repeats(table(spark, [(4, text), (7, text + "  tail"), (8, "as  it is")])).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {4: text, 7: "tail", 8: "as  it is"} and set(out[0].asDict()) == {x.split()[0] for x in ROW.split(", ")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), min_size=1, max_size=4))
def test_matching_statistics(sequences):
    shard, done = S.SuffixAutomaton(), []
    for seq in sequences:
        for j, found in enumerate(shard.grow(seq)):
            best = 0
            for n in range(1, j + 2):
                piece = seq[j + 1 - n : j + 1]
                earlier = any(d[s : s + n] == piece for d in done for s in range(len(d) - n + 1)) or any(seq[s : s + n] == piece for s in range(j + 1 - n))
                best = n if earlier else best
            assert found == best
        done.append(seq)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    docs = corpus(seed)
    r = random.Random(seed)
    items: dict[int, str | None] = {100: None, 101: "?!", 102: "A-b C", 103: "zzz9"}
    for i in range(30):
        w = brute.bench_words(docs[r.randrange(8, 120)])
        at = r.randrange(max(1, len(w) - 10))
        items[i] = "; ".join(w[at : at + r.choice([3, 12, 13, 14, 30])]).upper() or None
    items[200] = items[3]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items.items()], "item_id long, text string, word string, n int")
    found = contamination(table(spark, docs.items()), bench).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["items_sha256"], x["contaminated"]) for x in found} == brute.contamination(docs, items)


def test_contamination_by_a_benchmark_too_large_to_broadcast(spark):
    docs = corpus(3) | {1000: "first words " + corpus(3)[20]}
    items = {i: "; ".join(brute.bench_words(docs[20 + i])[:15]) or None for i in range(40)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = contamination(table(spark, docs.items()), bench, broadcast=0).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["items_sha256"], x["contaminated"]) for x in found} == brute.contamination(docs, items)


def test_leaked_documents_go_however_long(spark):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (2, "two words")], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, f"{long} {item} {long}"), (2, long), (None, f"x {item}"), (None, "clean"), (3, None), (4, "two words"), (5, f"two words {long}"), (6, "")]
    docs = table(spark, rows)
    for limit in (0, 1000):
        found = drop_leaked(docs, bench, broadcast=limit)
        assert found.columns == docs.columns
        assert sorted((r["doc_id"] or -1, (r["text"] or "")[:9]) for r in found.collect()) == [(-1, "clean"), (2, long[:9]), (3, ""), (5, "two words"), (6, "")]
    assert drop_leaked(docs, bench.limit(0)).count() == len(rows) and drop_leaked(docs.limit(0), bench).count() == 0


def test_contamination_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (None, "lone")], "item_id long, text string")
    rows = [(None, item), (4, item), (4, item), (5, None), (6, "lone")]
    found = contamination(table(spark, rows), bench).collect()
    assert sorted((r["doc_id"] or -1, r["n_hit"], r["contaminated"]) for r in found) == [(-1, 15, True), (4, 15, True), (4, 15, True), (5, 0, False), (6, 0, False)]
    assert contamination(table(spark, []), bench).count() == 0
    assert [r["n_hit"] for r in contamination(table(spark, rows[:1]), bench.limit(0)).collect()] == [0]
