from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memloom.llm import packing as P
from memloom.llm import token_files as T
from memloom.llm.tokens import tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a", "a ", "a  b", "\n", "\n\n", "a\n\nb", "a \n b", "x 0 y", "10 20", "a\tb c", "I'm here's 're", "a b  c", "é è́ ́a", "<|endoftext|> x", "a<|endoftext|>b", "日本 語", "Straße! don't", "İx ǅx", "(a) \"b\" | c...", "%%% a***", "Ther " * 400]


def direct(path: str, text: str | None, end: int) -> np.ndarray:
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_chunks_give_the_whole_texts_ids(path, kind):
    plain, own = Tokenizer.from_file(path), tokenizer(path, kind)
    for text, ids in zip(ODD, own.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abÉé'’.,0 1\n\t  ́!ßＡ<|endoftext|>", max_size=20), max_size=3))
def test_random_texts_give_the_whole_texts_ids(texts):
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        plain = Tokenizer.from_file(path) if (path, kind) not in _plain else _plain[path, kind]
        _plain[path, kind] = plain
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer(path, kind).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


_plain: dict = {}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, length int, task string, start int")


def test_token_files(spark):
    rows = [(i * 7 % 50, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again")]
    files = T.write_token_files(docs(spark, rows), WORD, kind="word", end_id=2)
    found = T.read_token_files(files).collect()
    assert len(found) == len(rows)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start = 0
    for r, (i, t) in zip(sorted(found, key=lambda r: r["start"]), want, strict=True):
        ids = direct(WORD, t, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert T.read_token_files(T.write_token_files(docs(spark, []), WORD, kind="word", end_id=2)).count() == 0


def test_readers_fetch_single_documents_and_see_damage(spark, tmp_path):
    files = T.write_token_files(docs(spark, [(i, f"text number {i}") for i in range(20)]), WORD, kind="word", end_id=2, folder=f"file://{tmp_path}/t").collect()
    for f in files:
        file = T.TokenFile(f["path"])
        some = int(file.doc_ids[len(file) // 2])
        assert file.get([some])[some][0].tolist() == direct(WORD, f"text number {some}", 2).tolist()
        file.close()
    import zstandard

    path = files[0]["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(whole) == 2 * files[0]["n_tokens"]  # any zstd reader sees all ids
    data[9] ^= 1
    open(path, "wb").write(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        T.TokenFile(files[0]["path"]).read(0, 1)


def check_packed(rows, texts, capacity):
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = direct(BYTE, text, 2)
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(places)


def test_pack(spark):
    r = random.Random(1)
    texts = dict(enumerate(ODD)) | {100 + i: " ".join("word" + "s" * r.randint(0, 3) for _ in range(r.randint(1, 300))) for i in range(80)}
    n = check_packed(P.pack(docs(spark, texts.items()), BYTE, capacity=128).collect(), texts, 128)
    assert n <= -(-sum(len(direct(BYTE, t, 2)) for t in texts.values()) // 128) + 2
    twice = P.pack(docs(spark, [(1, "a"), (1, "a"), (None, None)]), BYTE).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    assert P.pack(docs(spark, []), BYTE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), min_size=1, max_size=12))
def test_plans_hold_every_piece(histogram):
    for plan in (P.plan_sequences(histogram, 40).sequences, sorted(P.best_fit(histogram, 40).items())):
        held = defaultdict(int)
        for config, times in plan:
            assert sum(x * n for x, n in config) <= 40
            for x, n in config:
                held[x] += n * times
        assert dict(held) == histogram


def test_knapsack_is_exact():
    r = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 12), 4)))
        values = np.array([r.random() for _ in lengths])
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - x] + v for x, v in zip(lengths, values, strict=True) if x <= c)])
        taken = P.Knapsack(lengths, values, 20).multiset(20)
        assert sum(x * n for x, n in taken.items()) <= 20
        assert abs(sum(values[list(lengths).index(x)] * n for x, n in taken.items()) - best[20]) < 1e-9


def histogram_of(sf: str) -> dict[int, int]:
    import duckdb

    own, found = tokenizer(BYTE, "byte"), defaultdict(int)
    for (text,) in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/documents.parquet'").fetchall():
        n = len(own.encode([text])[0]) // 4 + 1
        found[(n - 1) % 1024 + 1] += 1
        found[1024] += (n - 1) // 1024
    return {x: n for x, n in found.items() if n}


@pytest.mark.parametrize(("sf", "times"), [("sf0.01", 1), ("sf0.01", 500), ("sf0.1", 1), ("sf0.1", 500)])
def test_the_linear_program_places_the_pieces(sf, times):
    """Nearly all of them, in no more sequences than best fit alone, and close to what no plan can beat."""
    histogram = {x: n * times for x, n in histogram_of(sf).items()}
    plan = P.plan_sequences(histogram, 1024)
    n = sum(times for _, times in plan.sequences)
    assert plan.by_lp >= 0.95 * sum(histogram.values())
    assert n <= sum(P.best_fit(histogram, 1024).values())
    assert plan.bound <= n <= 1.002 * plan.bound + 1


def test_the_bound_holds_where_sizes_do_not_tell():
    """Pieces of which no two fit together need a sequence each."""
    found = P.solve_lp({60: 50, 55: 70}, 100)
    assert abs(found.value - 120) < 1e-6 and 119 <= found.bound <= 120 + 1e-6
