from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.llm import pitman_yor as H
from memloom.llm import quality as Q
from memloom.llm import toxicity as X
from memloom.llm.words import split_words
from tests.llm import brute

SF = "/root/testdata/sf0.01"
ODD = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "x " * 50_000), (905, "same text"), (905, "same text"), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, uid string, base int, score double")


def test_words_are_those_of_the_pattern():
    texts = [None, "", " a\tb\x0b\x0cc\r\n", "É é\x1fx", "word " * 3, "\x1c \x85 z"]
    column = pa.array(texts * 3)
    for lower in (False, True):
        got = []
        for w in split_words(column, lower=lower):
            spans = [(w.first[k], w.first[k + 1]) for k in range(len(w.first) - 1)]
            got += [[bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(a, b)] for a, b in spans]
        assert got == [brute.words(t, lower) for t in texts * 3]


def test_hashes_tell_words_and_documents_apart():
    w = next(split_words(pa.array(["ab", "a b", "b ab a"]), lower=False))
    a, b, ab = w.hashes[1], w.hashes[2], w.hashes[0]
    assert len({int(a), int(b), int(ab)}) == 3
    assert w.hashes.tolist() == [ab, a, b, b, ab, a]


def test_language_model(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(400)]
    docs = {i: " ".join(vocabulary[min(int(r.expovariate(0.02)), 399)] for _ in range(r.randint(0, 80))) for i in range(150)}
    for i in range(100, 150):
        docs[i] = docs[i - 100]  # copies, which a model of contexts knows
    docs[900], docs[901] = None, ""
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    found = {x["doc_id"]: x for x in H.score_corpus(frame(spark, docs.items()), held_out=X.held_out_rows(2, 7)).collect()}
    c, n, v = brute.unigrams(docs, held)
    for i, text in docs.items():
        tokens = [*brute.words(text, lower=True), None]
        x = found[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (i in held, len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert math.isclose(x["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert x["score"] < 0
    assert sum(found[i]["score"] for i in held) > sum(found[i]["base_score"] for i in held)


def test_language_model_of_odd_rows(spark):
    found = H.score_corpus(frame(spark, ODD), held_out=X.held_out_rows(2, 7)).collect()
    assert len(found) == len(ODD) and sum(x["doc_id"] == 905 for x in found) == 2 and sum(x["doc_id"] is None for x in found) == 1
    assert H.score_corpus(frame(spark, []), held_out=X.held_out_rows(2, 7)).count() == 0
    nothing = H.score_corpus(frame(spark, [(1, "a b")]), held_out=F.lit(True)).collect()
    assert (nothing[0]["train_tokens"], nothing[0]["n_known"]) == (0, 0) and math.isfinite(nothing[0]["score"])


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for parts, shards, hot in ((4, None, 0.002), (16, 5, 0.002), (3, 64, 0.05), (7, 1, 1.0)):
        old, H.HOT = (spark.conf.get("spark.sql.shuffle.partitions"), H.HOT), hot
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = H.score_corpus(docs.repartition(parts), held_out=X.held_out_rows(2, 7), shards=shards).orderBy("doc_id").collect()
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        H.HOT = old[1]
        found.append([tuple(r) for r in rows])
    assert found[0] == found[1] == found[2] == found[3]


def test_model_against_a_plain_version(spark):
    """The same sweeps over dictionaries, with draws by the same keys."""
    r = random.Random(8)
    docs = {i: " ".join(r.choice(["aa", "bb", "cc", "dd", f"w{r.randrange(40)}"]) for _ in range(r.randint(0, 60))) for i in range(60)}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    prior, counts, lines = H.Prior(), {}, {}
    for i, text in docs.items():
        for _, _, tokens, contexts in H._tokens(pa.RecordBatch.from_arrays([pa.array([text])], ["text"])):
            lines[i] = list(zip(tokens.tolist(), contexts.tolist(), strict=True))
        for w, g in lines[i] if i not in held else []:
            counts[w, g] = counts.get((w, g), 0) + 1
    words, contexts = sorted({w for w, _ in counts}), {g for _, g in counts}
    total = lambda d, at, x: sum(n for key, n in d.items() if key[at] == x)
    draw = lambda c, rate, d, key: int(H.sample_tables(np.array([c]), np.array([rate]), d, np.array([key], np.uint64))[0])
    step, whole = 0x9E3779B97F4A7C15, 1 << 64
    mixed = lambda x: int(H.mix(np.array([x % whole], np.uint64))[0])
    t, k, kept = dict.fromkeys(counts, 1), dict.fromkeys(words, 1), []

    def parent(w, t, k):
        base = (prior.theta0 + prior.d0 * sum(k.values())) / (len(words) + 1)
        return (max(total(t, 0, w) - prior.d0 * k.get(w, 0), 0) + base) / (prior.theta0 + sum(t.values()))

    for sweep in range(1, H.BURN_IN + H.SWEEPS + 1):
        above, tables = {w: parent(w, t, k) for w in words}, {g: total(t, 1, g) for g in contexts}
        base = (prior.theta0 + prior.d0 * sum(k.values())) / (len(words) + 1)
        t = {(w, g): draw(c, (prior.theta + prior.d * tables[g]) * above[w], prior.d, mixed(w + (2 * sweep + 1) * step) ^ (g << 7)) for (w, g), c in counts.items()}
        k = {w: draw(total(t, 0, w), base, prior.d0, mixed(w + (2 * sweep + 2) * step)) for w in words}
        if sweep > H.BURN_IN:
            kept.append((t, k, {w: parent(w, t, k) for w in words}, {g: total(t, 1, g) for g in contexts}))
    customers = {g: total(counts, 1, g) for g in contexts}

    def log_probability(w, g):
        p = 0.0
        for t, k, above, tables in kept:
            own = counts.get((w, g), 0) - prior.d * t.get((w, g), 0)
            p += (own + (prior.theta + prior.d * tables.get(g, 0)) * (above[w] if w in above else parent(w, t, k))) / (prior.theta + customers.get(g, 0))
        return math.log10(p / len(kept))

    found = {x["doc_id"]: x["score"] for x in H.score_corpus(frame(spark, docs.items()), held_out=X.held_out_rows(2, 7)).collect()}
    for i in docs:
        assert math.isclose(found[i], sum(log_probability(w, g) for w, g in lines[i]), rel_tol=1e-7)


def test_probabilities_sum_to_one():
    """Over the vocabulary and the unknown word, in one context, with one shard."""
    prior, rng = H.Prior(), np.random.default_rng(1)
    words = np.sort(rng.integers(1, 2**62, 30).astype(np.uint64))
    keys = np.unique(rng.integers(0, 30, 200) << H.CLASS_BITS | rng.integers(0, 5, 200))
    keys = np.unique(np.concatenate([keys, np.arange(30) << H.CLASS_BITS | 3]))
    hot = np.zeros(0, np.uint64)
    shard = H.Shard(words, keys, rng.integers(1, 9, len(keys)), hot, [])
    shard.start()
    for sweep in range(1, 4):
        t, k = shard.samples[-1]
        totals = H.Totals(np.bincount(shard.context, t, H.CLASSES).astype(np.int64), (int(t.sum()), int(k.sum())), hot.astype(np.int64), hot.astype(np.int64))
        assert ((t >= 1) & (t <= shard.counts)).all()
        parent, base = shard.parent(-1, totals, 30, prior)
        parent = np.append(parent, base / (prior.theta0 + t.sum()))
        assert math.isclose(parent.sum(), 1)
        for g in range(5):
            own, here = np.zeros(31), shard.context == g
            own[shard.word[here]] = shard.counts[here] - prior.d * t[here]
            p = (own + (prior.theta + prior.d * t[here].sum()) * parent) / (prior.theta + shard.counts[here].sum())
            assert math.isclose(p.sum(), 1)
        shard.sweep(sweep, totals, 30, prior, keep=False)


def test_tables_follow_their_distribution():
    d, c, r = 0.8, 6, 0.7
    keys = H.mix(np.arange(1, 40_001).astype(np.uint64))
    weights = np.exp([H.log_stirling(d, c)[c, t] + t * math.log(r) for t in range(1, c + 1)])
    drawn = H.sample_tables(np.full(40_000, c), np.full(40_000, r), d, keys)
    assert abs(drawn.mean() - (weights * np.arange(1, c + 1)).sum() / weights.sum()) < 0.03
    large = H.sample_tables(np.array([5000, 1, 2]), np.array([0.5, 0.5, 1e-12]), d, keys[:3])
    assert 1 <= large[0] < 5000 and large[1:].tolist() == [1, 1]
    assert large[0] == H.sample_tables(np.array([5000]), np.array([0.5]), d, keys[:1])[0]


def held_out_accuracy(found, label):
    rows = [(x[label], x["predicted"]) for x in found if x["held_out"]]
    return sum(a == b for a, b in rows) / len(rows)


def joined(spark, df, label):
    return df.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").collect()


def test_toxicity_learns(spark):
    from memloom.llm.queries import QUERIES

    found = joined(spark, QUERIES["op6_toxicity_ftrl"](spark, SF), "toxic")
    assert held_out_accuracy(found, "toxic") > 0.93
    caught = [x["predicted"] for x in found if x["toxic"] and not x["held_out"]]
    assert sum(caught) / len(caught) > 0.9


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    docs = frame(spark, [(i, "nice day for all" if i % 2 == 0 else "you vile toad") for i in range(40)] + ODD)
    weights = X.train(docs, labels, held_out=X.held_out_rows(0, 5))
    found = X.score(docs, weights).collect()
    assert len(found) == 40 + len(ODD) and all(0 <= x["score"] <= 1 for x in found)
    assert {x["predicted"] for x in found if x["doc_id"] is not None and x["doc_id"] < 40 and x["doc_id"] % 2} == {1}
    nothing = X.train(docs, labels.limit(0), held_out=X.held_out_rows(0, 5))
    assert {x["score"] for x in X.score(docs, nothing).collect()} == {0.0}
    assert X.score(docs.limit(0), weights).count() == 0
    assert X.drop_toxic(docs, weights).columns == docs.columns


def test_quality_learns(spark):
    from memloom.llm.queries import QUERIES

    found = joined(spark, QUERIES["op7_quality_cotraining"](spark, SF), "quality")
    assert held_out_accuracy(found, "quality") > 0.9
    good = [x for x in found if x["quality"]]
    assert sum(x["kept"] for x in good) / len(good) > 0.97


def test_quality_of_odd_rows(spark):
    rows = [(i, t, None if i else "en", None if i else "s", None) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    views = Q.document_views(docs)
    labels = spark.createDataFrame([(903, 1), (905, 0), (None, 1), (901, None)], "doc_id long, quality int")
    model = Q.co_train(views, labels, held_out=F.lit(False))
    assert model is Q.UNTRAINED
    found = Q.score_quality(views, model).collect()
    assert len(found) == len(ODD) and {x["predicted"] for x in found} == {1}
    assert Q.score_quality(Q.document_views(docs.limit(0)), model).count() == 0


def test_co_training_against_a_plain_version(spark):
    """What is handed over in each round, by sorting all documents, and the models that come of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = X.held_out_rows(0, 5)
    views, history = Q.document_views(docs), []
    model = Q.co_train(views, labels, held_out=held, rounds=3, grow=60, history=history)
    rows = views.orderBy("doc_id").toArrow()
    ids = rows["doc_id"].to_numpy()
    data = [Q._matrix(rows["content"], Q.CONTENT), Q._matrix(rows["meta"], Q.META)]
    quality = {r["doc_id"]: r["quality"] for r in labels.where(~held).collect()}
    y = np.array([quality.get(i, -1) for i in ids.tolist()])
    own = [i for i in range(len(ids)) if y[i] >= 0 and int(Q.mix(ids[i : i + 1].astype(np.int64).view(np.uint64))[0]) % 4]
    train = [[(i, float(y[i])) for i in own] for _ in (0, 1)]
    rate = np.mean(y[y >= 0])
    pool, models = {i for i in range(len(ids)) if y[i] < 0}, None
    for given in history:
        models = [Q.fit_logistic(data[v][[i for i, _ in train[v]]], np.array([z for _, z in train[v]])) for v in (0, 1)]
        chosen = {}
        for v in (0, 1):
            logit = models[v].logits(data[v])
            for label, share in ((0, 1 - rate), (1, rate)):
                sure = logit if label else -logit
                some = [i for i in pool if sure[i] > math.log(3 * share / (1 - share))]
                chosen[v, label] = sorted(some, key=lambda i: (-sure[i], ids[i]))[: int(60 * share)]
        torn = set(chosen[0, 0]) & set(chosen[1, 1]) | set(chosen[0, 1]) & set(chosen[1, 0])
        for (v, label), some in chosen.items():
            some = [i for i in some if i not in torn]
            assert given.handed[v, label] == [int(ids[i]) for i in some]
            train[1 - v] += [(i, float(label)) for i in some]
            pool -= set(some)
    all_handed = [i for r in history for v in (0, 1) for i in {*r.handed[v, 0], *r.handed[v, 1]}]
    assert all(r.handed[v, label] for r in history[:1] for v in (0, 1) for label in (0, 1))  # both views hand over both labels
    assert all(all_handed.count(i) <= 2 for i in all_handed)  # once by each view at most
    for v in (0, 1):
        last = Q.fit_logistic(data[v][[i for i, _ in train[v]]], np.array([z for _, z in train[v]]))
        assert np.allclose(last.weights, model.views[v].weights, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_newton_finds_the_optimum(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.0] + rng.normal(size=300) > 0.3).astype(float)
    fitted = Q.fit_logistic(x, y)
    assert (((fitted.logits(x) > 0) == y).mean() > 0.8) and fitted.weights[0] > 0 > fitted.weights[1]
