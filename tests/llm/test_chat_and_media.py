from __future__ import annotations

import hashlib
import io
import time
import zipfile
import zlib

import pytest

from memloom.llm import chat as C
from memloom.llm import media as M


def render(turns, me):
    out, spans, own = "", [], 0
    for who, text in turns:
        role = "assistant" if who == me else "system" if who == "system" else f"user name={who}"
        out += f"{C.OPEN}{role}\n"
        body = text + C.CLOSE
        if who == me:
            spans.append(f"{len(out)}-{len(out) + len(body)}")
            own += len(body)
        out += body + "\n"
    return out, ",".join(spans), own


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", ""), (1, 3, None, "who?"), (1, 4, "ann", None), (1, 4, "ann", None), (2, 0, "system", "alone"), (None, 1, "zoe", "x"), (3, None, "cy", "late"), (3, 300, "di", "far")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, block int, me string")
    found = {(r["conv_id"], r["perspective"], r["block"]): r for r in C.rotate_perspectives(df).collect()}
    turns = [("system", "be kind"), ("ann", "hi 😀"), ("bob", ""), ("unknown", "who?"), ("ann", ""), ("ann", "")]
    for me in ("ann", "bob", "unknown"):
        r = found.pop((1, me, 0))
        assert (r["text"], r["mask"], r["own_chars"]) == render(turns, me)
        assert (r["n_turns"], r["n_own"]) == (6, sum(w == me for w, _ in turns))
    assert set(found) == {(None, "zoe", 0), (3, "cy", -1), (3, "cy", 1), (3, "di", -1), (3, "di", 1)}
    assert found[3, "di", -1]["mask"] == "" and found[3, "di", -1]["n_own"] == 0
    assert C.rotate_perspectives(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn long, role string, text string")
    plan = C.rotate_perspectives(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def gif():
    return b"GIF89a" + bytes([2, 0, 2, 0, 0x80, 0, 0]) + bytes(6) + b"," + bytes(8) + b"\0" + b"\x02\x02\x4c\x01\0;"


def jpeg():
    frame = b"\xff\xc0\0\x0b" + bytes(9)
    return b"\xff\xd8\xff\xe0\0\x10JFIF" + bytes(10) + frame + b"\xff\xda\0\x08" + bytes(6) + b"ab\xff\0cd\xff\xd0e" + b"\xff\xd9"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


SAMPLES = {
    "image/png": M.to_png(bytes(range(256)) * 9),
    "audio/wav": M.to_wav(b"x" * 577),
    "image/bmp": M.to_bmp(b"y" * 1152),
    "image/gif": gif(),
    "image/jpeg": jpeg(),
    "application/gzip": zlib.compress(b"z" * 99, wbits=31),
    "application/pdf": b"%PDF-1.4\nobj\nstartxref\n9\n%%EOF",
    "application/zip": zipped(),
}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_formats_are_found_whole_and_carved(kind):
    b = SAMPLES[kind]
    assert M.sniff(b"BM noise " + b + b"RIFF tail") == [(kind, 9, len(b))]
    assert M.detect(b + b"rest", "image/x-wrong")[0] == kind
    assert M.sniff(b[:-1]) == []  # cut short: the structure doesn't hold


def test_many_in_one_blob_and_false_alarms():
    blob = b"--".join(SAMPLES.values())
    assert [m.kind for m in M.sniff(blob)] == list(SAMPLES)
    assert M.sniff(b"BM GIF89a RIFF \x89PNG\r\n\x1a\n %PDF-1 PK\x03\x04 \xff\xd8\xff \x1f\x8b\x08" * 50) == []
    broken = bytearray(SAMPLES["image/png"])
    broken[60] ^= 1
    assert M.sniff(bytes(broken)) == []
    assert M.detect(b"text", "image/png") == ("application/octet-stream", []) and M.detect(b"text", "text/plain")[0] == "text/plain"


@pytest.mark.parametrize(
    "unit",
    [b"%PDF-1 ", b"PK\x03\x04 ", b"GIF89a" + bytes(7) + b"!\0\x01x", SAMPLES["application/gzip"][:-9], SAMPLES["image/png"][:33] + b"\0\x04\0\0IDAT", b"\xff\xd8\xff\xda\0\x02", b"%PDF-1 startxref ", b"RIFF\x10\x27\0\0WAVE", b"PK\x03\x04PK\x05\x06" + bytes(18)],
)
def test_hostile_blobs_take_little_time(unit):
    blob = unit * (560_000 // len(unit))
    start = time.perf_counter()
    M.sniff(blob)
    assert time.perf_counter() - start < 3
    good = SAMPLES["image/bmp"]
    assert M.sniff(good + blob)[0] == ("image/bmp", 0, len(good))


def test_gzip_that_expands_a_thousandfold_is_measured_whole():
    b = zlib.compress(bytes(20_000_000), wbits=31)
    assert M.sniff(b"x" + b + b"y") == [("application/gzip", 1, len(b))]


def test_payloads_come_back(spark):
    texts = [None, "", "a" * 576, "a" * 577, "é" * 400, "BM RIFF \x00 GIF89a", "w " * 60_000, "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, record string, declared string")
    found = sorted(M.media_digests(M.store_texts(df)).collect(), key=lambda r: r["doc_id"] or 0)
    for r, t in zip(found, texts, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert found[-1].asDict() | {"doc_id": 0} == found[-2].asDict() | {"doc_id": 0}
    assert M.media_digests(M.store_texts(df.limit(0))).count() == 0


def test_sniffed_columns(spark):
    df = spark.createDataFrame([(1, SAMPLES["image/gif"], "image/png"), (2, b"x" + SAMPLES["image/png"], "text/html"), (3, None, None)], "k int, b binary, t string")
    found = {r["key"]: r for r in M.sniff_column(df, "k", "b", "t").collect()}
    assert found[1]["corrected"] == "image/gif" and not found[1]["embedded"]
    assert bytes(found[2]["embedded"][0]["content"]) == SAMPLES["image/png"] and found[3]["corrected"] is None
