import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm.transport_stream import BODY, PACKET, UNIT, crc32_mpeg, demux, mux, op2_transport_stream, read_media, store_media


@pytest.mark.parametrize("n", [0, 1, 64, 150, 162, 163, 161, 160, 345, 346, 347, 344, UNIT - 1, UNIT, UNIT + 1, 9 * UNIT + 5])
def test_round_trip(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    media = mux(payload)
    assert len(media) % PACKET == 0
    d = demux(media)
    assert d["payload"] == payload
    assert d["continuity_errors"] == d["sync_errors"] == 0
    units = max(1, -(-n // UNIT))
    assert d["pts"] == [3600 * k for k in range(units)]
    assert d["random_access"] == [k * UNIT for k in range(units)]


def test_errors_are_counted():
    media = bytearray(mux(bytes(5000)))
    lost = bytes(media[: 5 * PACKET] + media[6 * PACKET :])
    assert demux(lost)["continuity_errors"] == 1
    twice = bytes(media[: 6 * PACKET] + media[5 * PACKET :])
    assert demux(twice)["payload"] == bytes(5000) and demux(twice)["continuity_errors"] == 0
    media[7 * PACKET] = 0
    assert demux(bytes(media))["sync_errors"] == 1
    assert demux(b"")["payload"] == b"" and demux(b"x" * 500)["pid"] == -1
    broken = bytearray(mux(b"abc"))
    broken[20] ^= 1
    assert demux(bytes(broken))["pid"] == -1  # the program table's CRC no longer holds
    assert BODY == PACKET - 4


def section(table_id, number, body):
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def packets(pid, data, first=0, start=True):
    """data as packets of one pid; the last one is stuffed by its adaptation field."""
    out, at = b"", 0
    while at < len(data) or not out:
        part = data[at : at + BODY]
        head = bytes([0x47, (0x40 if start and not at else 0) | pid >> 8, pid & 255])
        short = BODY - len(part)
        field = b"" if not short else bytes([short - 1]) + (b"\0" + b"\xff" * (short - 2) if short > 1 else b"")
        out += head + bytes([(0x30 if short else 0x10) | first + at // BODY & 15]) + field + part
        at += BODY
    return out


def tables(pat, pmt):
    return packets(0, b"\0" + section(0, 1, pat)) + packets(0x100, b"\0" + section(2, 1, pmt))


PAT = bytes([0, 0, 0xE0, 0x10, 0, 1, 0xE1, 0])  # the network's entry comes first
PMT = bytes([0xE1, 1, 0xF0, 0, 6, 0xE1, 1, 0xF0, 0])
PES = b"\0\0\1\xe0\0\0\x80\0\0"


def test_foreign_streams():
    # program 0 is no program, and a packet of length 0 is open up to the next start
    d = demux(tables(PAT, PMT) + packets(0x101, PES + b"a" * 500) + packets(0x101, PES + b"b" * 300, 3))
    assert (d["program"], d["pid"], d["payload"], d["broken_units"], d["continuity_errors"]) == (1, 0x101, b"a" * 500 + b"b" * 300, 0, 0)
    # a program map with 240 bytes of descriptors lies in two packets; one that promises more than it has names no stream
    long = bytes([0xE1, 1, 0xF0, 240]) + b"d" * 240 + PMT[4:]
    assert demux(tables(PAT, long) + packets(0x101, PES + b"abc"))["payload"] == b"abc"
    assert demux(tables(PAT, bytes([0xE1, 1, 0xF3, 255]) + PMT[4:]) + packets(0x101, PES))["pid"] == -1
    # two sections in one packet
    both = packets(0, b"\0" + section(1, 1, b"other") + section(0, 1, PAT))
    assert demux(both + tables(PAT, PMT)[PACKET:] + packets(0x101, PES + b"xy"))["payload"] == b"xy"


def test_a_broken_unit_takes_no_byte_of_another():
    payload = bytes(range(250)) * 300
    media, unit = mux(payload), 32_768
    lost = media[: 9 * PACKET] + media[10 * PACKET :]
    d = demux(lost)
    assert (d["continuity_errors"], d["broken_units"]) == (1, 1)
    assert d["payload"] == payload[: len(d["payload"]) - len(payload) + unit] + payload[unit:] and len(d["payload"]) < len(payload) - unit // 2
    announced = bytearray(tables(PAT, PMT) + packets(0x101, PES + b"a" * 100) + packets(0x101, PES + b"b" * 100, 9))
    announced[3 * PACKET + 5] |= 0x80
    assert demux(bytes(announced))["continuity_errors"] == 0 and demux(bytes(announced))["payload"] == b"a" * 100 + b"b" * 100
    marked = bytearray(mux(b"abc"))
    marked[2 * PACKET + 1] |= 0x80
    assert demux(bytes(marked))["sync_errors"] == 1 and demux(bytes(marked))["payload"] == b""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5 * PACKET), st.integers(0, 255)), max_size=40), st.integers(0, 5 * PACKET))
def test_damage_never_raises(changes, end):
    media = bytearray(tables(PAT, PMT) + packets(0x101, PES + b"a" * 300))
    for at, value in changes:
        if at < len(media):
            media[at] = value
    d = demux(bytes(media[:end]))
    assert len(d["payload"]) <= len(media)


def test_registered_query(spark, tmp_path):
    rows = [(1, "é" * 40), (2, None), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_transport_stream(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.broken_units) for r in got.collect()} == {1: (80, 128, 0), 2: (0, 64, 0), None: (1, 64, 0)}


def test_frame(spark):
    texts = ["", None, "a", "é" * 100, "x" * 200_000, "a"]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int")
    rows = {r.id: r for r in read_media(store_media(df)).collect()}
    assert len(rows) == 6
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[2].media_sha256 == rows[5].media_sha256 and rows[0].feature == rows[1].feature
    assert read_media(store_media(df.limit(0))).count() == 0
