"""Media columns: texts or any payload as MPEG transport streams (ISO/IEC 13818-1), and the parser for them.

``mux`` writes program tables, packetised elementary stream packets with PTS and PCR, continuity counters and
random-access flags; ``demux`` parses the program association and map tables (over several packets where they need
them, checking their CRC), checks the continuity counters of the elementary stream, reassembles its packets (also those
of open length) and returns payload, timestamps and random-access points. ``store_media`` and ``read_media`` apply both to a DataFrame column, one batch at a time and
without a shuffle; a row's memory is a small multiple of its own text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import map_arrow, small_batches, utf8

PACKET, BODY = 188, 184
PMT_PID, ES_PID = 0x0100, 0x0101
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in packetised elementary stream packets
UNIT = 32_768  # bytes of payload in one access unit
TICKS = 3_600  # 90 kHz clock, 25 access units a second
TABLES_EVERY = 8  # access units between repetitions of the program tables


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A program table section in one transport packet's body."""
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return (b"\0" + head + crc32_mpeg(head).to_bytes(4, "big")).ljust(BODY, b"\xff")


_PAT = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
_PMT = _section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))


def _stamp(pts: int) -> bytes:
    """33 bits of PTS in the five bytes of a PES header."""
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, 1 | (pts >> 15 & 127) << 1, pts >> 7 & 255, 1 | (pts & 127) << 1])


def _table_packet(pid: int, body: bytes, counter: int) -> bytes:
    return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15]) + body


def _unit_packets(data: bytes, pts: int, counter: int) -> np.ndarray:
    """One access unit as transport packets: PCR and random access in the first, stuffing where it is short."""
    length = 8 + len(data)
    pes = np.frombuffer(b"\0\0\1" + bytes([STREAM_ID, length >> 8, length & 255, 0x84, 0x80, 5]) + _stamp(pts) + data, np.uint8)
    first = min(len(pes), BODY - 8)
    full, rest = divmod(len(pes) - first, BODY)
    out = np.full((1 + full + (rest > 0), PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
    out[:, 3] = 0x10 | (counter + np.arange(len(out))) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = BODY - 1 - first, 0x50
    out[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    out[0, PACKET - first :] = pes[:first]
    if full:
        out[1 : 1 + full, 4:] = pes[first : first + full * BODY].reshape(full, BODY)
    if rest:
        out[-1, 3] |= 0x20
        out[-1, 4] = BODY - 1 - rest
        if rest < BODY - 1:
            out[-1, 5] = 0
        out[-1, PACKET - rest :] = pes[-rest:]
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream of one program whose only elementary stream holds payload, in access units of UNIT bytes."""
    out, counter, tables = [], 0, 0
    for k in range(max(1, -(-len(payload) // UNIT))):
        if k % TABLES_EVERY == 0:
            out += [_table_packet(0, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        packets = _unit_packets(payload[k * UNIT : (k + 1) * UNIT], k * TICKS, counter)
        counter += len(packets)
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(packets: np.ndarray, start: np.ndarray) -> Iterator[bytes]:
    """The sections that the packets of one table's pid carry, also over several packets, as far as they are whole."""
    held = None
    for row, at in zip(packets, start.tolist(), strict=True):
        body = row[at:].tobytes()
        if row[1] & 0x40 and body:
            # the pointer tells how much of an earlier section comes first
            before, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            if held:
                yield held + before
            held = b""
        if held is not None:
            held += body
            while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
                yield held[:n]
                held = held[n:]


def _table(packets: np.ndarray, start: np.ndarray, table_id: int) -> bytes:
    """The body of the first sound section with this id that is in force (empty: none)."""
    for section in _sections(packets, start):
        if len(section) >= 12 and section[0] == table_id and section[5] & 1 and crc32_mpeg(section) == 0:
            return section[8:-4]
    return b""


def _first_program(pat: bytes) -> tuple[int, int]:
    """Number and map pid of the first program of an association table; entries of program 0 name the network."""
    for k in range(0, len(pat) - 3, 4):
        if number := pat[k] << 8 | pat[k + 1]:
            return number, (pat[k + 2] & 0x1F) << 8 | pat[k + 3]
    return 0, -1


def _first_stream(pmt: bytes) -> int:
    """The pid of the first elementary stream of a program map; -1 where the map ends before one."""
    at = 4 + ((pmt[2] & 15) << 8 | pmt[3]) if len(pmt) >= 4 else len(pmt)
    return (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2] if at + 5 <= len(pmt) else -1


_PLAIN = (0xBC, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)  # stream ids whose packets have no further header
_PADDING = 0xBE


def _unit(pes: bytes) -> tuple[bytes, int | None, bool] | None:
    """Payload, PTS and whether it is whole, of one packetised elementary stream packet; None for no such packet."""
    if len(pes) < 6 or pes[:3] != b"\0\0\1":
        return None
    length, stream = pes[4] << 8 | pes[5], pes[3]
    # a length of 0 means: up to the next packet's start
    whole, pes = (not length or len(pes) >= 6 + length), pes[: 6 + length] if length else pes
    if stream == _PADDING:
        return b"", None, whole
    if stream in _PLAIN:
        return pes[6:], None, whole
    if len(pes) < 9:
        return b"", None, False
    pts, t = None, pes[9:14]
    if pes[7] & 0x80 and len(t) == 5 and pes[8] >= 5:
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
    return pes[9 + pes[8] :], pts, whole and len(pes) >= 9 + pes[8]


def demux(media: bytes) -> dict:
    """Payload, presentation times, random-access points and errors of the first program's first stream; never raises.

    Packets without the sync byte or with the transport error mark are left out and counted. Packets that repeat the one
    before are left out. A gap in the continuity counters that is not announced is counted; what follows it up to the
    next unit's start has no sure place and is dropped, so a broken unit takes no byte of another. Units cut short in any
    way are counted as broken. Without sound program tables the payload is empty.
    """
    out = {"payload": b"", "packets": 0, "pts": [], "random_access": [], "continuity_errors": 0, "sync_errors": 0, "broken_units": 0, "program": 0, "pid": -1}
    raw = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    good = (raw[:, 0] == 0x47) & (raw[:, 1] & 0x80 == 0)
    out["sync_errors"] = int((~good).sum()) + (len(media) % PACKET > 0)
    raw = raw if good.all() else raw[good]
    out["packets"] = len(raw)
    adapted = raw[:, 3] & 0x20 > 0
    raw, adapted = (x[raw[:, 3] & 0x10 > 0] for x in (raw, adapted))
    start = np.minimum(np.where(adapted, 5 + raw[:, 4].astype(np.int32), 4), PACKET)
    flags = np.where(adapted & (raw[:, 4] > 0), raw[:, 5], 0)
    pid = (raw[:, 1] & 0x1F).astype(np.int32) << 8 | raw[:, 2]
    out["program"], map_pid = _first_program(_table(raw[pid == 0], start[pid == 0], 0))
    out["pid"] = _first_stream(_table(raw[pid == map_pid], start[pid == map_pid], 2))

    own, start, flags = (x[pid == out["pid"]] for x in (raw, start, flags))
    if not len(own):
        return out
    step = np.concatenate([[1], np.diff(own[:, 3] & 15) & 15])
    again = step == 0
    again[1:] &= (own[1:, 12:] == own[:-1, 12:]).all(1)  # a clock reference may differ
    own, start, flags, step = (x[~again] for x in (own, start, flags, step))
    gap = (step != 1) & (flags & 0x80 == 0)
    out["continuity_errors"] = int(gap.sum())
    stream = own[np.arange(PACKET) >= start[:, None]].tobytes()
    offset = np.concatenate([[0], np.cumsum(PACKET - start)])
    units = np.flatnonzero(own[:, 1] & 0x40)
    gaps = np.append(np.flatnonzero(gap), len(own))
    first_gap = gaps[np.searchsorted(gaps, units, "right")]
    parts, written = [], 0
    for i, end, cut in zip(units.tolist(), [*units[1:].tolist(), len(own)], first_gap.tolist(), strict=True):
        found = _unit(stream[int(offset[i]) : int(offset[min(end, cut)])])
        if found is None:
            out["broken_units"] += 1
            continue
        data, pts, whole = found
        out["broken_units"] += not whole or cut < end
        if pts is not None:
            out["pts"].append(pts)
        if flags[i] & 0x40:
            out["random_access"].append(written)
        parts.append(data)
        written += len(data)
    out["payload"] = b"".join(parts)
    return out


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: every whole text (null: empty), padded with zeros to a positive multiple of 64, as a stream."""
    small_batches(df.sparkSession)

    def store(batch):
        texts = list(utf8(batch.column(1)))
        return {
            "id": batch.column(0),
            "n_bytes": [len(t) for t in texts],
            "media": [mux(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts],
        }

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), store, "id long, n_bytes long, media binary")


def read_media(df: DataFrame, id_col: str = "id", size_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """Parse stored streams: sizes, digests of what was read back, timestamps, random-access byte offsets, errors.

    A null or broken stream gives an empty payload and its error counts, never an exception.
    """
    small_batches(df.sparkSession)

    def read(batch):
        rows = []
        for media in utf8(batch.column(2)):
            d = demux(media)
            p = d["payload"]
            gaps = np.diff(d["pts"])
            rows.append((
                len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                f"packets={d['packets']};units={len(d['pts'])};first_pts={min(d['pts'], default=-1)};last_pts={max(d['pts'], default=-1)};pts_step={int(gaps.min()) if len(gaps) else 0};random_access={len(d['random_access'])};mean={np.frombuffer(p, np.uint8).mean() if p else 0:.4f}",
                d["pts"], d["random_access"], d["continuity_errors"], d["sync_errors"], d["broken_units"],
            ))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "continuity_errors", "sync_errors", "broken_units")
        return {"id": batch.column(0), "n_bytes": batch.column(1)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>, continuity_errors long, sync_errors long, broken_units long"
    return map_arrow(df.select(id_col, size_col, media_col), read, schema)


def op2_transport_stream(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as a transport stream and read back; one row per document."""
    from driftlens.llm.common import table

    return read_media(store_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def stored_texts(spark, sf_dir: str) -> DataFrame:
    """Sizes and payload digests that op2_transport_stream reads back, which SQL can compute from the texts."""
    return op2_transport_stream(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "continuity_errors", "broken_units")


STORED_SQL = r"""
WITH own AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
sized AS (SELECT doc_id, raw, octet_length(raw) AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS m FROM own)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(raw || unhex(repeat('00', CAST(m - n AS INTEGER)))) AS payload_sha256,
       CAST(0 AS BIGINT) AS continuity_errors, CAST(0 AS BIGINT) AS broken_units
FROM sized
"""
