"""Packets of capture files, classic and next-generation, as a table.

A record lies where the one before it ends. So a first pass walks over the heads of a file's records, seeking from one to the next, and cuts the file into ranges
of bytes with what a reader has to know at their start: byte order, interfaces, and the number of the first packet. A second pass reads the ranges, each
in any task, by seeking; packets leave in batches of bounded size. The walk of one file is one task, which reads heads alone; a file's size has no other bound.

Files of a mounted folder are read in this way. Files that only Spark's own readers open come whole into one row each, which ends at 2 GB; they give
the same rows.

What is wrong gives a row with issue beside the packets (of those named in RECOVERABLE, others end the file), at the place and with the number of the record. A file of
another format gives that row alone; an empty file gives one in a mounted folder and none elsewhere, for Spark passes over it.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blake3
from . import files

#: First bytes and their byte order and parts of a second, link types, protocols, TCP flags from the lowest bit, and issues that reading goes on after.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ETHERNET, RAW = 1, (12, 101)
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
RECOVERABLE = ("OriginalLengthSmallerThanCaptured", "InvalidTimestampFraction")
#: Headers of IPv6 that stand before the protocol's own: hop-by-hop, routing, destination options.
EXTENSIONS = (0, 43, 60)
#: Bytes that a packet may have, that a block may have, and of a range; packets and bytes of a batch that leaves.
LARGEST, LARGEST_BLOCK, RANGE, BATCH, BATCH_BYTES = 16 << 20, 1 << 26, 64 << 20, 2000, 8 << 20
SCHEMA = (
    "file string, packet_index long, ts_us long, captured long, original long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, vlan int, "
    "tcp_flags string, tcp_sequence long, payload binary, issue string, offset long, packet_locator string, packet_hash string"
)
RANGES = "file string, start long, end long, first long, state string, issue string"


class Damaged(Exception):
    pass


@dataclass
class Interface:
    link: int
    ticks: int = 10**6
    offset: int = 0


@dataclass
class Section:
    order: str = "<"
    interfaces: list[Interface] = field(default_factory=list)


@dataclass
class Cut:
    """A range of bytes and what to know at its start, or what is wrong at it."""

    start: int
    end: int
    first: int
    state: str
    issue: str | None = None


class Ranges:
    """Collects records into ranges of about so many bytes."""

    def __init__(self, size: int) -> None:
        self.size, self.index, self.now = size, 0, None

    def record(self, at: int, end: int, state: str | None, packet: bool) -> Iterator[Cut]:
        """Takes a record in; gives the range before it if that is full, or if state, that of a new range, says that one begins here."""
        if self.now is not None and end - self.now.start > self.size and self.now.end > self.now.start:
            yield from self.close()
        if self.now is None:
            self.now = Cut(at, at, self.index, state or "")
        self.now.end = end
        self.index += packet

    def close(self) -> Iterator[Cut]:
        if self.now is not None:
            yield self.now
            self.now = None

    def issue(self, at: int, why: str) -> Iterator[Cut]:
        yield from self.close()
        yield Cut(at, at, self.index, "", why)


def _walk_classic(f: io.BufferedIOBase, length: int, size: int) -> Iterator[Cut]:
    head = f.read(24)
    order, ticks = CLASSIC[head[:4]]
    if len(head) < 24:
        raise Damaged("truncated header")
    snaplen, link = struct.unpack_from(order + "2I", head, 16)
    state, ranges, at = json.dumps([order, ticks, link & 0xFFFF]), Ranges(size), 24
    # a head that the file ends in isn't one
    while len(head := f.read(16)) == 16:
        _, part, captured, original = struct.unpack(order + "4I", head)
        end = at + 16 + captured
        why = "PacketLengthLimitExceeded" if captured > LARGEST else "TruncatedPacketRecord" if end > length else "CapturedLengthExceedsSnaplen" if captured > snaplen else None
        if why:
            yield from ranges.issue(at, why)
            return
        if original < captured:
            yield from ranges.issue(at, "OriginalLengthSmallerThanCaptured")
        else:
            yield from ranges.record(at, end, state, True)
            if part >= ticks:
                yield Cut(at, at, ranges.index - 1, "", "InvalidTimestampFraction")
        f.seek(captured, io.SEEK_CUR)
        at = end
    yield from ranges.close()


def _interface(body: bytes, order: str) -> Interface:
    if len(body) < 8:
        raise Damaged("short interface block")
    out, at = Interface(struct.unpack_from(order + "H", body)[0]), 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "2H", body, at)
        value = body[at + 4 : at + 4 + size]
        if code == 0:
            break
        if code == 9 and size == 1:
            out.ticks = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        if code == 14 and size == 8:
            out.offset = struct.unpack(order + "q", value)[0]
        at += 4 + (size + 3) // 4 * 4
    return out


def _state(now: Section) -> str:
    return json.dumps([now.order, [[i.link, i.ticks, i.offset] for i in now.interfaces]])


def _walk_blocks(f: io.BufferedIOBase, length: int, size: int) -> Iterator[Cut]:
    """A new section or interface ends a range, so that one state holds for all of it."""
    now, ranges, at = Section(), Ranges(size), 0
    state = _state(now)
    try:
        while at < length:
            head = f.read(12)
            if len(head) < 12:
                raise Damaged("truncated block")
            if head[:4] == b"\n\r\r\n":
                yield from ranges.close()
                now = Section({b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(head[8:12], ""))
                if not now.order:
                    raise Damaged("bad byte order")
                state = _state(now)
            kind, block = struct.unpack_from(now.order + "2I", head)
            if block < 12 or block % 4 or block > LARGEST_BLOCK:
                raise Damaged("bad block length")
            if at + block > length:
                raise Damaged("truncated block")
            body = b"" if kind not in (INTERFACE, ENHANCED) else (head[8:] + f.read(min(block - 16, 16 if kind == ENHANCED else block))) if block > 12 else b""
            f.seek(at + block - 4)
            if f.read(4) != struct.pack(now.order + "I", block):
                raise Damaged("block lengths differ")
            if kind == INTERFACE:
                yield from ranges.close()
                now.interfaces.append(_interface(body[: block - 12], now.order))
                state = _state(now)
            elif kind == ENHANCED:
                if len(body) < 20:
                    raise Damaged("short packet block")
                which, _, _, captured, _ = struct.unpack_from(now.order + "5I", body)
                if which >= len(now.interfaces):
                    raise Damaged("unknown interface")
                if 20 + captured > block - 12:
                    raise Damaged("truncated packet")
                yield from ranges.record(at, at + block, state, True)
            at += block
    except Damaged as e:
        yield from ranges.issue(at, str(e))
        return
    yield from ranges.close()


def walk(f: io.BufferedIOBase, length: int, size: int = RANGE) -> Iterator[Cut]:
    """The ranges of an open capture, and its issues, in order."""
    magic = f.read(4)
    f.seek(0)
    try:
        if magic not in CLASSIC and magic != b"\n\r\r\n":
            raise Damaged("unknown format")
        yield from (_walk_classic if magic in CLASSIC else _walk_blocks)(f, length, size)
    except Damaged as e:
        yield Cut(0, 0, 0, "", str(e))


def _classic(f: io.BufferedIOBase, cut: Cut) -> Iterator[tuple]:
    """Place, link type, microseconds, original length and bytes of each packet of a range."""
    order, ticks, link = json.loads(cut.state)
    at = cut.start
    while at < cut.end:
        sec, part, captured, original = struct.unpack(order + "4I", f.read(16))
        yield at, link, sec * 10**6 + part * 10**6 // ticks if part < ticks else None, original, f.read(captured)
        at += 16 + captured


def _blocks(f: io.BufferedIOBase, cut: Cut) -> Iterator[tuple]:
    order, interfaces = json.loads(cut.state)
    at = cut.start
    while at < cut.end:
        kind, block = struct.unpack(order + "2I", f.read(8))
        body = f.read(block - 8)
        if kind == ENHANCED:
            which, high, low, captured, original = struct.unpack_from(order + "5I", body)
            link, ticks, offset = interfaces[which]
            yield at, link, ((high << 32) + low) * 10**6 // ticks + offset * 10**6, original, body[20 : 20 + captured]
        at += block


def decode(link: int, raw: bytes) -> dict:
    """Addresses, ports and payload of a packet; what it lacks or what can't be read is left out."""
    out: dict = {}
    at, kind = 0, 0
    if link == ETHERNET:
        if len(raw) < 14:
            return out
        kind, at = int.from_bytes(raw[12:14]), 14
        while kind in (0x8100, 0x88A8) and len(raw) >= at + 4:
            out["vlan"] = int.from_bytes(raw[at : at + 2]) & 0xFFF
            kind, at = int.from_bytes(raw[at + 2 : at + 4]), at + 4
    elif link in RAW and raw:
        kind = {4: 0x0800, 6: 0x86DD}.get(raw[0] >> 4, 0)
    end = len(raw)
    if kind == 0x0800 and end >= at + 20:
        own, total, fragment = (raw[at] & 15) * 4, int.from_bytes(raw[at + 2 : at + 4]), int.from_bytes(raw[at + 6 : at + 8]) & 0x1FFF
        if raw[at] >> 4 != 4 or own < 20:
            return out
        out |= {"src_ip": str(ip_address(raw[at + 12 : at + 16])), "dst_ip": str(ip_address(raw[at + 16 : at + 20]))}
        proto, end = raw[at + 9], min(end, at + total) if total else end
        at += own
        if fragment:
            return out | {"protocol": PROTOCOLS.get(proto, str(proto))}
    elif kind == 0x86DD and end >= at + 40:
        out |= {"src_ip": str(ip_address(raw[at + 8 : at + 24])), "dst_ip": str(ip_address(raw[at + 24 : at + 40]))}
        proto, end = raw[at + 6], min(end, at + 40 + int.from_bytes(raw[at + 4 : at + 6])) if raw[at + 4 : at + 6] != b"\0\0" else end
        at += 40
        while proto in EXTENSIONS and end >= at + 8:
            proto, at = raw[at], at + 8 * (raw[at + 1] + 1)
    else:
        return out
    out["protocol"] = PROTOCOLS.get(proto, str(proto))
    if proto == 6 and end >= at + 20:
        size = (raw[at + 12] >> 4) * 4
        out |= {"tcp_flags": "|".join(name for k, name in enumerate(FLAGS) if raw[at + 13] >> k & 1), "tcp_sequence": int.from_bytes(raw[at + 4 : at + 8])}
        out["payload"] = raw[at + max(20, size) : end]
    elif proto == 17 and end >= at + 8:
        out["payload"] = raw[at + 8 : end]
    else:
        return out
    return out | {"src_port": int.from_bytes(raw[at : at + 2]), "dst_port": int.from_bytes(raw[at + 2 : at + 4])}


def rows_of(file: str, f: io.BufferedIOBase, cut: Cut) -> Iterator[dict]:
    if cut.issue:
        yield {"file": file, "packet_index": cut.first, "offset": cut.start, "issue": cut.issue}
        return
    f.seek(cut.start)
    reader = _blocks if cut.state.count("[") > 1 else _classic
    for k, (at, link, ts, original, raw) in enumerate(reader(f, cut), cut.first):
        locator = f"pcap{'ng' if reader is _blocks else ''}://offset/0x{at:08X}/packet/{k}"
        yield {"file": file, "packet_index": k, "ts_us": ts, "captured": len(raw), "original": original, "offset": at, "packet_locator": locator, "packet_hash": raw} | decode(link, raw)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _batches(rows: Iterator[dict], hashes: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def leave() -> pa.RecordBatch:
        raw = [r.get("packet_hash") for r in held]
        known = iter(blake3.digests([r for r in raw if r is not None]) if hashes else ())
        for row, r in zip(held, raw, strict=True):
            row["packet_hash"] = next(known, None) if r is not None else None
        return pa.RecordBatch.from_pylist(held, _schema(SCHEMA))

    for row in rows:
        held.append(row)
        size += row.get("captured") or 0
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield leave()
            held, size = [], 0
    if held:
        yield leave()


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """A row for each range of bytes of the captures at path, and for each issue; one task walks over a file."""
    found = list(files.listed(path))
    schema = _schema(RANGES)

    def work(batches):
        for batch in batches:
            for file, length in zip(batch.column("file").to_pylist(), batch.column("length").to_pylist(), strict=True):
                held = []
                with open(file, "rb", buffering=1 << 16) as f:
                    for cut in walk(f, length, size):
                        held.append({"file": file, **vars(cut)})
                        if len(held) == BATCH:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    names = spark.createDataFrame(found, "file string, length long")
    return names.repartition(min(len(found), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(work, RANGES)


def packets(spark: SparkSession, path: str, size: int = RANGE, hashes: bool = False) -> DataFrame:
    """A row for each packet of the captures at path, and one with issue for each thing that is wrong; with the BLAKE3 digest of each packet where hashes are asked for."""
    try:
        files.local(path)
    except ValueError:
        return packets_of(spark.read.format("binaryFile").load(path).select("path", "content"), hashes)

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = row.pop("file")
                with open(file, "rb", buffering=1 << 20) as f:
                    yield from _batches(rows_of(file, f, Cut(**row)), hashes)

    # a number of its own, so that ranges aren't brought together for being short rows
    return ranges(spark, path, size).repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("file", "start")).mapInArrow(work, SCHEMA)


def packets_of(contents: DataFrame, hashes: bool = False) -> DataFrame:
    """As packets, of captures that are rows of path and content."""

    def work(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                f = io.BytesIO(data)
                rows = (row for cut in walk(io.BytesIO(data), len(data)) for row in rows_of(file, f, cut))
                yield from _batches(rows, hashes)

    # files are large: few of them travel at once
    contents.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return contents.select("path", "content").mapInArrow(work, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """For each capture: packets, things that are wrong, and how good it is."""
    own = found.groupBy("file").agg(F.count_if(F.col("issue").isNull()).alias("packets"), F.count("issue").alias("issues"))
    return own.withColumn("quality", F.when(F.col("issues") == 0, "Complete").otherwise("Partial"))
