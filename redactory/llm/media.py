"""Media columns: payloads as MPEG transport streams.

A payload is cut into access units of `UNIT` bytes, each carried by one packetised elementary packet with a presentation
time, in four transport packets. Every `TABLES` units the program association and map tables come first, and that unit is a
random-access point. `mux` and `demux` work on whole arrays of packets; `demux` takes streams of others too: it finds the
stream's PID by the tables, checks continuity counters, reassembles the elementary packets and lists their times.
Null and empty texts have one unit of padding. Repeated rows are kept, extra columns ignored; rows without an id are dropped.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import lean, stored

# Fixed values of the format and of our streams.
SYNC, PACKET, STREAM_PRIVATE_DATA, PRIVATE_STREAM_1 = 0x47, 188, 0x06, 0xBD
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x0100, 0x0101, 1
UNIT, TABLES, FIRST_PTS, UNIT_TICKS = 576, 64, 126_000, 3_600


def crc32_mpeg(data: bytes) -> int:
    """CRC of program tables: polynomial 0x04C11DB7, not reflected, without final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, content: bytes) -> np.ndarray:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return np.frombuffer((head + content).ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def padded(data: bytes) -> bytes:
    """Bytes 255 behind, up to a positive multiple of UNIT."""
    return data + b"\xff" * ((-len(data)) % UNIT or (0 if data else UNIT))


def mux(payload: bytes) -> bytes:
    """The stream of a payload whose length is a positive multiple of UNIT."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(units)
    out = np.full((n, 4, PACKET), 0xFF, np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = DATA_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = DATA_PID & 0xFF
    out[:, :, 3] = (np.arange(4 * n) % 16).reshape(n, 4) | np.array([0x30, 0x10, 0x10, 0x30], np.uint8)
    out[:, 0, 4] = 1  # an adaptation field of flags only
    out[:, 0, 5] = np.where(np.arange(n) % TABLES == 0, 0x40, 0)
    pts = (FIRST_PTS + UNIT_TICKS * np.arange(n, dtype=np.int64)) & ((1 << 33) - 1)
    head = out[:, 0, 6:20]
    head[:, :9] = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (UNIT + 8).to_bytes(2, "big") + b"\x84\x80\x05", np.uint8)
    head[:, 9] = 0x21 | ((pts >> 29) & 0x0E)
    head[:, 10] = (pts >> 22) & 0xFF
    head[:, 11] = 0x01 | ((pts >> 14) & 0xFE)
    head[:, 12] = (pts >> 7) & 0xFF
    head[:, 13] = 0x01 | ((pts << 1) & 0xFE)
    out[:, 0, 20:] = units[:, :168]
    out[:, 1, 4:] = units[:, 168:352]
    out[:, 2, 4:] = units[:, 352:536]
    out[:, 3, 4], out[:, 3, 5] = 143, 0
    out[:, 3, 148:] = units[:, 536:]
    groups = -(-n // TABLES)
    stream = np.empty((4 * n + 2 * groups, PACKET), np.uint8)
    at = np.arange(4 * n)
    stream[at + 2 * (at // (4 * TABLES) + 1)] = out.reshape(-1, PACKET)
    first = np.arange(groups) * (4 * TABLES + 2)
    for k, packet in enumerate((_PAT, _PMT)):
        stream[first + k] = packet
        stream[first + k, 3] |= (np.arange(groups) % 16).astype(np.uint8)
    return stream.tobytes()


@dataclass
class Stream:
    payload: bytes
    pts: list[int]
    #: Packet numbers of random-access points.
    random_access: list[int]
    packets: int
    continuity_errors: int


def _begins(q: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins: behind the adaptation field; at the end if it has none."""
    begin = np.where((q[:, 3] & 0x20) != 0, 5 + q[:, 4].astype(np.int16), 4)
    begin[(q[:, 3] & 0x10) == 0] = PACKET
    return begin


def _section_of(q: np.ndarray) -> bytes:
    """The first section in the packets of one PID, of which the first starts one; it may go on in those that follow."""
    begin = _begins(q)
    first = q[0, begin[0] :].tobytes()
    data = first[1 + first[0] :]
    k = 1
    while len(data) < 3 or len(data) < 3 + (int.from_bytes(data[1:3], "big") & 0xFFF):
        if k == len(q):
            raise ValueError("a program table ends early")
        data += q[k, begin[k] :].tobytes()
        k += 1
    data = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
    if crc32_mpeg(data):
        raise ValueError("a program table's checksum is wrong")
    return data


def _sequence(q: np.ndarray) -> tuple[np.ndarray, int]:
    """Of the packets of one PID those that repeat the one before, as the format permits, and how many others are out of turn.

    Counters rise with payloads only; a packet that says that it is discontinuous may have any."""
    again = np.zeros(len(q), bool)
    filled = np.flatnonzero((q[:, 3] & 0x10) != 0)
    again[filled[1:]] = (q[filled[1:]] == q[filled[:-1]]).all(axis=1)
    kept = filled[~again[filled]]
    cc = (q[kept, 3] & 0x0F).astype(np.int16)
    told = ((q[kept, 3] & 0x20) != 0) & (q[kept, 4] > 0) & ((q[kept, 5] & 0x80) != 0)
    return again, int(((np.diff(cc) % 16 != 1) & ~told[1:]).sum())


def demux(data: bytes) -> Stream:
    """The elementary stream of the first program's first component."""
    if not data or len(data) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("a sync byte is missing")
    pid = ((p[:, 1] & 0x1F).astype(np.int32) << 8) | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0
    pat = np.flatnonzero((pid == PAT_PID) & starts)
    if not len(pat):
        raise ValueError("no program association table")
    table = _section_of(p[pat[0] :][pid[pat[0] :] == PAT_PID])
    programs = [(int.from_bytes(table[i : i + 2], "big"), int.from_bytes(table[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(table) - 4, 4)]
    own = next(x for n, x in programs if n)
    pmt = np.flatnonzero((pid == own) & starts)
    if not len(pmt):
        raise ValueError("no program map table")
    table = _section_of(p[pmt[0] :][pid[pmt[0] :] == own])
    at = 12 + (int.from_bytes(table[10:12], "big") & 0xFFF)
    own = int.from_bytes(table[at + 1 : at + 3], "big") & 0x1FFF
    errors, again = 0, np.zeros(len(p), bool)
    for one in np.unique(pid).tolist():
        if one != 0x1FFF:  # null packets have no order
            where = np.flatnonzero(pid == one)
            again[where], wrong = _sequence(p[where])
            errors += wrong
    own = np.flatnonzero((pid == own) & ~again)
    q, starts = p[own], starts[own]
    begin = _begins(q)
    size = PACKET - begin
    body = q[np.arange(PACKET) >= begin[:, None]]
    at = (np.cumsum(size) - size)[starts]
    if (body[at] | body[at + 1]).any() or (body[at + 2] != 1).any():
        raise ValueError("an elementary packet does not start with its code")
    head = 9 + body[at + 8].astype(np.int64)
    x = [body[at + 9 + k].astype(np.int64) for k in range(5)]
    pts = (((x[0] & 0x0E) << 29) | (x[1] << 22) | ((x[2] & 0xFE) << 14) | (x[3] << 7) | (x[4] >> 1))[(body[at + 7] & 0x80) != 0]
    edge = np.zeros(len(body) + 1, np.int32)
    edge[at] += 1
    np.subtract.at(edge, at + head, 1)
    payload = body[np.cumsum(edge[:-1]) == 0].tobytes()
    entry = ((q[:, 3] & 0x20) != 0) & (q[:, 4] > 0) & ((q[:, 5] & 0x40) != 0)
    return Stream(payload, pts.tolist(), own[entry].tolist(), len(p), errors)


def _parts(batch: pa.RecordBatch, most: int = 16 << 20):
    ids, n, media, size = [], [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        ids.append(key)
        n.append(len(data))
        media.append(mux(padded(data)))
        size += len(media[-1])
        if size > most:
            yield _stored_rows(ids, n, media)
            ids, n, media, size = [], [], [], 0
    if ids:
        yield _stored_rows(ids, n, media)


def _stored_rows(ids, n, media) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media), written to the cluster's shared folder."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return stored(docs.mapInArrow(lean(lambda batches: (x for b in batches for x in _parts(b))), "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"


def _read(batches):
    for batch in batches:
        rows = []
        for key, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = media.as_buffer().to_pybytes()
            s = demux(data)
            feature = f"packets={s.packets};units={len(s.pts)};first_pts={s.pts[0]};last_pts={s.pts[-1]};random_access={len(s.random_access)};continuity_errors={s.continuity_errors};mean={np.frombuffer(s.payload, np.uint8).mean():.6f}"
            rows.append((key, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.pts, s.random_access))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def read(media: DataFrame) -> DataFrame:
    """What the stored streams hold: digests, features, times and random-access points."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(_read), _READ)
