"""Binary Windows event logs as a table, read by ranges of their chunks.

A log is a header and chunks of 64 KiB, each of which holds records with the names and templates that they use; so a chunk can be read by itself, and
a task gets a range of chunks whatever the size of the log. A record is a tree whose template says where its values go. It becomes a
JSON text of the form that `records.event_head` and `records.observations` read.

Defined cases: a log that isn't a header and whole chunks gives one row with what is wrong in issue, as does one that doesn't begin as a log; a chunk
without its mark, or whose marks of bounds can't be, gives one row with issue and costs no other chunk; a chunk that was never used gives none; a record that
can't be read gives one row with its number and issue, and reading goes on at the next record. Where a checksum of a chunk differs, its records
are read and say so in `checksum`.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

#: Fixed values of the format: marks of logs, chunks and records, and sizes of headers and chunks.
LOG, CHUNK, RECORD = b"ElfFile\x00", b"ElfChnk\x00", b"**\x00\x00"
HEADER, SIZE, FIRST = 4096, 65536, 512
#: Chunks of a task, rows of a batch, and levels that a tree may have.
CHUNKS, BATCH, DEEPEST = 256, 1000, 64
SCHEMA = "file string, chunk long, offset long, record_id long, written timestamp, raw string, checksum boolean, issue string"
EPOCH = datetime(1601, 1, 1, tzinfo=UTC)


class Damaged(Exception):
    pass


@dataclass
class Value:
    """Where a template takes a value from; optional ones leave no trace where that is null."""

    index: int
    optional: bool


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, list]] = field(default_factory=list)
    parts: list = field(default_factory=list)


def moment(ticks: int) -> str:
    return (EPOCH + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def identifier(raw: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", raw)
    return f"{a:08X}-{b:04X}-{c:04X}-{raw[8:10].hex().upper()}-{raw[10:16].hex().upper()}"


def security_identifier(raw: bytes) -> str:
    return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8])), *map(str, struct.unpack_from(f"<{raw[1]}I", raw, 8))])


def system_time(raw: bytes) -> str:
    y, mo, _, d, h, mi, s, ms = struct.unpack_from("<8H", raw)
    return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"


#: Formats and sizes of numbers by kind.
NUMBERS = {3: ("b", 1), 4: ("B", 1), 5: ("h", 2), 6: ("H", 2), 7: ("i", 4), 8: ("I", 4), 9: ("q", 8), 10: ("Q", 8), 11: ("f", 4), 12: ("d", 8)}
TEXT, ANSI, BOOL, BINARY, GUID, POINTER, FILETIME, SYSTEMTIME, SID, HEX32, HEX64, TREE, ARRAY = 1, 2, 13, 14, 15, 16, 17, 18, 19, 20, 21, 33, 128
WIDTHS = {**{k: n for k, (_, n) in NUMBERS.items()}, BOOL: 4, GUID: 16, FILETIME: 8, SYSTEMTIME: 16, HEX32: 4, HEX64: 8}


class Chunk:
    """The records of one chunk; names and templates are read once, where they stand."""

    def __init__(self, data: bytes) -> None:
        self.data, self.names, self.templates = data, {}, {}

    def take(self, form: str, at: int) -> tuple:
        try:
            return struct.unpack_from("<" + form, self.data, at)
        except struct.error:
            raise Damaged("ends within a value") from None

    def bytes_at(self, at: int, size: int) -> bytes:
        if size < 0 or at < 0 or at + size > len(self.data):
            raise Damaged("ends within a value")
        return self.data[at : at + size]

    def text(self, at: int, units: int) -> str:
        return self.bytes_at(at, 2 * units).decode("utf-16-le", "replace")

    def name(self, at: int) -> tuple[str, int]:
        """A name by its place, which stands at `at`, and where reading goes on: behind the name if it stands right here."""
        (place,) = self.take("I", at)
        if place not in self.names:
            _, _, units = self.take("IHH", place)
            self.names[place] = self.text(place + 8, units), 10 + 2 * units
        name, size = self.names[place]
        return name, at + 4 + (size if place == at + 4 else 0)

    def tree(self, at: int, inside: bool, depth: int = 0) -> tuple[list, int]:
        """The elements from `at` on, and where they end. Inside a value, elements have no number of what they depend on."""
        out: list = []
        while True:
            (kind,) = self.take("B", at)
            if kind == 0x0F:
                at += 4
            elif kind == 0x00:
                return out, at + 1
            elif kind & 0x3F == 0x01:
                one, at = self.element(at, inside, depth)
                out.append(one)
            elif kind == 0x0C:
                elements, at = self.instance(at, depth)
                # nothing follows the values of a template but its end
                return out + elements, at
            else:
                raise Damaged(f"unknown token {kind}")

    def element(self, at: int, inside: bool, depth: int) -> tuple[Element, int]:
        if depth > DEEPEST:
            raise Damaged("too deep")
        (kind,) = self.take("B", at)
        name, at = self.name(at + (5 if inside else 7))
        out = Element(name)
        if kind & 0x40:
            at += 4
            while self.take("B", at)[0] & 0x3F == 0x06:
                label, at = self.name(at + 1)
                parts, at = self.content(at, inside, depth, attribute=True)
                out.attributes.append((label, parts))
        (kind,) = self.take("B", at)
        if kind == 0x03:
            return out, at + 1
        if kind != 0x02:
            raise Damaged(f"unknown token {kind}")
        out.parts, at = self.content(at + 1, inside, depth)
        if self.take("B", at)[0] != 0x04:
            raise Damaged("element without end")
        return out, at + 1

    def content(self, at: int, inside: bool, depth: int, attribute: bool = False) -> tuple[list, int]:
        """Texts, values to come and elements, up to a token of another kind."""
        out: list = []
        while True:
            (kind,) = self.take("B", at)
            plain = kind & 0x3F
            if plain == 0x05:
                if self.take("B", at + 1)[0] != TEXT:
                    raise Damaged("value that is no text")
                (units,) = self.take("H", at + 2)
                out.append(self.text(at + 4, units))
                at += 4 + 2 * units
            elif plain in (0x0D, 0x0E):
                index, _ = self.take("HB", at + 1)
                out.append(Value(index, plain == 0x0E))
                at += 4
            elif plain == 0x07:
                (units,) = self.take("H", at + 1)
                out.append(self.text(at + 3, units))
                at += 3 + 2 * units
            elif plain == 0x08:
                out.append(chr(self.take("H", at + 1)[0]))
                at += 3
            elif plain == 0x09:
                name, at = self.name(at + 1)
                out.append({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(name, f"&{name};"))
            elif plain == 0x01 and not attribute:
                one, at = self.element(at, inside, depth + 1)
                out.append(one)
            else:
                return out, at

    def instance(self, at: int, depth: int) -> tuple[list, int]:
        """The elements of a template with the values that follow it."""
        _, _, place = self.take("BII", at + 1)
        at += 10
        (size,) = self.take("I", place + 20)
        if place not in self.templates:
            self.templates[place] = self.tree(place + 24, False, depth + 1)[0]
        if place == at:
            at += 24 + size
        (number,) = self.take("I", at)
        heads, at = [self.take("HB", at + 4 + 4 * k) for k in range(min(number, SIZE // 4))], at + 4 + 4 * number
        values = []
        for length, kind in heads:
            values.append(self.value(kind, at, length, depth))
            at += length
        return [filled(e, values) for e in self.templates[place]], at

    def value(self, kind: int, at: int, length: int, depth: int):
        if kind == 0 or (length == 0 and kind not in (TEXT, ANSI)):
            return None
        if kind == TREE:
            if depth > DEEPEST:
                raise Damaged("too deep")
            return self.tree(at, True, depth + 1)[0]
        raw = self.bytes_at(at, length)
        if kind == TEXT | ARRAY:
            return raw.decode("utf-16-le", "replace").removesuffix("\0").split("\0")
        if kind & ARRAY:
            width = WIDTHS.get(kind & ~ARRAY)
            return raw.hex().upper() if not width else [scalar(kind & ~ARRAY, raw[k : k + width]) for k in range(0, length - width + 1, width)]
        return scalar(kind, raw)


def scalar(kind: int, raw: bytes):
    try:
        if kind in NUMBERS:
            return struct.unpack("<" + NUMBERS[kind][0], raw)[0]
        if kind == TEXT:
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        if kind == ANSI:
            return raw.decode("cp1252", "replace").rstrip("\0")
        if kind == BOOL:
            return any(raw)
        if kind in (POINTER, HEX32, HEX64):
            return hex(int.from_bytes(raw, "little"))
        if kind == FILETIME:
            return moment(int.from_bytes(raw, "little"))
        made = {GUID: identifier, SID: security_identifier, SYSTEMTIME: system_time}.get(kind)
        return raw.hex().upper() if made is None else made(raw)
    except (struct.error, IndexError, OverflowError):
        raise Damaged(f"bad value of kind {kind}") from None


def filled(e: Element, values: list) -> Element:
    """An element with values for the places of its template; places without one are left out."""

    def one(p):
        if isinstance(p, Element):
            return [filled(p, values)]
        if not isinstance(p, Value):
            return [p]
        v = values[p.index] if p.index < len(values) else None
        if v is None:
            return []
        return v if isinstance(v, list) and v and isinstance(v[0], Element) else [v]

    every = lambda parts: [x for p in parts for x in one(p)]
    named = [(n, every(parts)) for n, parts in e.attributes]
    return Element(e.name, [(n, parts) for n, parts in named if parts], every(e.parts))


def joined(parts: list):
    """The one value of an element or attribute, or several as a text."""
    return parts[0] if len(parts) == 1 else "".join(map(str, parts)) if parts else None


def plain(e: Element):
    """An element as JSON has it: attributes under #attributes, a text beside others under #text, and several elements of one name as a list."""
    out: dict = {}
    if e.attributes:
        out["#attributes"] = {n: joined(parts) for n, parts in e.attributes}
    for child in e.parts:
        if isinstance(child, Element):
            own = plain(child)
            if child.name not in out:
                out[child.name] = own
            elif isinstance(out[child.name], list):
                out[child.name].append(own)
            else:
                out[child.name] = [out[child.name], own]
    text = joined([p for p in e.parts if not isinstance(p, Element)])
    if out and text is not None and text != "":
        out["#text"] = text
    return out or text


def chunk_rows(data: bytes) -> Iterator[dict]:
    """The records of a chunk: offset in it, record_id, written, raw, or issue."""
    if not any(data[:8]):
        return
    if data[:8] != CHUNK:
        yield {"issue": "chunk without its mark"}
        return
    (end,) = struct.unpack_from("<I", data, 48)
    if not FIRST <= end <= SIZE:
        yield {"issue": "chunk with impossible bounds"}
        return
    own, all_of, head = Chunk(data), struct.unpack_from("<I", data, 52)[0], struct.unpack_from("<I", data, 124)[0]
    good = zlib.crc32(data[FIRST:end]) == all_of and zlib.crc32(data[:120] + data[128:FIRST]) == head
    at = FIRST
    while at + 28 <= end:
        row: dict = {"offset": at, "checksum": good}
        size, number, ticks = struct.unpack_from("<IQQ", data, at + 4)
        whole = data[at : at + 4] == RECORD and 28 <= size <= end - at and struct.unpack_from("<I", data, at + size - 4)[0] == size
        if not whole:
            found = data.find(RECORD, at + 4, end)
            yield row | {"record_id": number if data[at : at + 4] == RECORD and number < 1 << 63 else None, "issue": "record with impossible bounds"}
            if found < 0:
                return
            at = found
            continue
        row["record_id"] = number if number < 1 << 63 else None
        try:
            row["written"] = EPOCH + timedelta(microseconds=ticks // 10)
            elements = own.tree(at + 24, False)[0]
            row["raw"] = json.dumps({e.name: plain(e) for e in elements if isinstance(e, Element)}, ensure_ascii=False)
        except (Damaged, OverflowError, RecursionError) as e:
            row["issue"] = str(e) or "too deep"
        yield row
        at += size


@dataclass
class Range(InputPartition):
    path: str
    first: int
    chunks: int
    issue: str | None = None


class EventLogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunks = options["path"], int(options.get("chunks", CHUNKS))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files.listed(self.path):
            if size < HEADER or (size - HEADER) % SIZE:
                out.append(Range(path, 0, 0, f"{size} bytes are no header and whole chunks"))
                continue
            with open(path, "rb") as f:
                if f.read(len(LOG)) != LOG:
                    out.append(Range(path, 0, 0, "no event log"))
                    continue
            out += [Range(path, k, min(self.chunks, (size - HEADER) // SIZE - k)) for k in range(0, (size - HEADER) // SIZE, self.chunks)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC"), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
        if partition.issue:
            yield pa.RecordBatch.from_pylist([{"file": partition.path, "issue": partition.issue}], schema)
            return
        rows: list[dict] = []
        with open(partition.path, "rb") as f:
            f.seek(HEADER + partition.first * SIZE)
            for k in range(partition.first, partition.first + partition.chunks):
                start = HEADER + k * SIZE
                rows += [{"file": partition.path, "chunk": k, **row, "offset": start + row.get("offset", 0)} for row in chunk_rows(f.read(SIZE))]
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


class EventLogs(DataSource):
    """spark.read.format("evtx").option("chunks", 256).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "evtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EventLogReader:
        return EventLogReader(self.options)


def records(spark: SparkSession, path: str, chunks: int = CHUNKS) -> DataFrame:
    """A row for each record of the logs at path, a file, pattern or folder, and one with issue for each log, chunk or record that is damaged."""
    spark.dataSource.register(EventLogs)
    return spark.read.format("evtx").option("chunks", chunks).load(path)


def summary(found: DataFrame) -> DataFrame:
    """For each log: records read and damaged, chunks damaged and seen, and how good it is."""
    record, bad = F.col("raw").isNotNull(), F.col("issue").isNotNull()
    own = found.groupBy("file").agg(
        F.count_if(record).alias("records"), F.count_if(bad & F.col("checksum").isNotNull()).alias("damaged_records"), F.count_if(bad & F.col("checksum").isNull()).alias("damaged_chunks"),
        F.count_if(~F.coalesce("checksum", F.lit(True))).alias("unsure"),
    )
    return own.withColumn("quality", F.when(F.col("damaged_records") + F.col("damaged_chunks") == 0, "Complete").when(F.col("records") > 0, "Partial").otherwise("Failed"))
