import hashlib
import struct
import zlib

import pytest

from docstrata.llm.media import box, full, media_columns, payload_of, read_container, text_media_report, walk, write_container


@pytest.mark.parametrize("samples", [1, 15, 16, 17, 32, 100])
def test_round_trip(samples):
    payload = bytes(i * 7 % 256 for i in range(192 * samples))
    data = write_container(payload)
    t = read_container(data)
    assert payload_of(data, t) == payload and t.codec == "raw " and t.duration == len(payload) and len(t.sizes) == samples
    assert [a - t.offsets[0] for a, _ in t.key_ranges] == [i * 192 for i in range(0, samples, 16)]


def test_other_tables_of_the_family():
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 4, 2, 3)), full(b"stco", struct.pack(">III", 2, 8, 20)))
    mdia = box(b"mdia", box(b"mdhd", bytes([1, 0, 0, 0]), struct.pack(">QQIQI", 0, 0, 90, 25, 0)), box(b"minf", stbl))
    data = struct.pack(">I4s", 30, b"mdat") + bytes(range(22)) + box(b"moov", box(b"trak", mdia)) + struct.pack(">I4s", 0, b"free")
    t = read_container(data)
    assert (t.codec, t.timescale, t.duration, t.offsets, t.keys) == ("avc1", 90, 25, [8, 12, 20], [0, 1, 2])
    assert [p[-1] for p, _, _ in walk(data)][:3] == [b"mdat", b"moov", b"trak"]


def test_broken_files(spark):
    good = write_container(b"a" * 192)
    rows = [(1, bytearray(good)), (2, bytearray(good[:-1])), (3, bytearray(b"x")), (4, None), (5, bytearray(good[:200])), (6, bytearray(good.replace(b"stsz", b"junk")))]
    got = {r.k: r.track for r in media_columns(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert got[1].error is None and all(got[k].error and got[k].codec is None for k in (2, 3, 4, 5, 6))


def test_report(spark):
    texts = {1: "é" * 100, 2: None, 3: "", 4: "x" * 192, 5: "y" * 100_000, 6: "é" * 100}
    got = {r.doc_id: r for r in text_media_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'a' AS media", "1 AS track")).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        data = (t or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes > r.payload_bytes and r.feature.startswith("codec=raw;timescale=8000;duration=")
    assert got[1][1:] == got[6][1:]
    assert text_media_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
