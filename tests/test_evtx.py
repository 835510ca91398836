"""Binary event logs, written by a small encoder of the format."""

import json
import struct
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tracewright.sources import evtx, records

GUID = bytes(range(16))
TICKS = 133_500_000_000_000_000


class Writer:
    """Chunks with records of one template: an event with its system's values and two named texts."""

    def __init__(self):
        self.data, self.names, self.template = bytearray(512), {}, None

    def name(self, text):
        if text in self.names:
            self.data += struct.pack("<I", self.names[text])
            return
        self.names[text] = len(self.data) + 4
        self.data += struct.pack("<I", self.names[text]) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def open(self, name, attributes=()):
        self.data += struct.pack("<BHI", 0x41 if attributes else 0x01, 0xFFFF, 0)
        self.name(name)
        if attributes:
            self.data += struct.pack("<I", 0)
            for k, (label, value) in enumerate(attributes):
                self.data.append(0x46 if k + 1 < len(attributes) else 0x06)
                self.name(label)
                self.part(value)

    def part(self, value):
        if isinstance(value, tuple):
            self.data += struct.pack("<BHB", 0x0E if value[-1] == "optional" else 0x0D, value[0], value[1])
        else:
            self.data += struct.pack("<BBH", 0x05, 1, len(value)) + value.encode("utf-16-le")

    def leaf(self, name, value, attributes=()):
        self.open(name, attributes)
        self.data.append(0x02)
        self.part(value)
        self.data.append(0x04)

    def definition(self):
        self.data += struct.pack("<I", 0) + GUID
        at = len(self.data)
        self.data += struct.pack("<I", 0) + b"\x0f\x01\x01\x00"
        self.open("Event", [("xmlns", "http://schemas.microsoft.com/win/2004/08/events/event")])
        self.data.append(0x02)
        self.open("System")
        self.data.append(0x02)
        self.open("Provider", [("Name", (0, 1)), ("Guid", (1, 15, "optional"))])
        self.data.append(0x03)
        self.leaf("EventID", (2, 6), [("Qualifiers", (8, 6, "optional"))])
        self.open("TimeCreated", [("SystemTime", (3, 17))])
        self.data.append(0x03)
        self.leaf("EventRecordID", (4, 10))
        self.leaf("Channel", (5, 1))
        self.leaf("Computer", "WS-01")
        self.open("Security", [("UserID", (6, 19, "optional"))])
        self.data.append(0x03)
        self.data.append(0x04)
        self.open("EventData")
        self.data.append(0x02)
        self.leaf("Data", (7, 1), [("Name", "TargetUserName")])
        self.leaf("Data", (9, 20), [("Name", "LogonType")])
        self.part((10, 33, "optional"))
        self.data += b"\x04\x04\x00"
        struct.pack_into("<I", self.data, at, len(self.data) - at - 4)

    def record(self, number, user, event=4624, channel="Security", guid=True, tree=b""):
        at = len(self.data)
        self.data += evtx.RECORD + struct.pack("<IQQ", 0, number, TICKS + number * 10_000_000) + b"\x0f\x01\x01\x00"
        self.data += struct.pack("<BBI", 0x0C, 1, 7)
        if self.template is None:
            self.template = len(self.data) + 4
            self.data += struct.pack("<I", self.template)
            self.definition()
        else:
            self.data += struct.pack("<I", self.template)
        sid = bytes((1, 2)) + (5).to_bytes(6) + struct.pack("<2I", 32, 544)
        text = lambda t: t.encode("utf-16-le")
        values = [(1, text("Provider-Ä")), (15, GUID if guid else b""), (6, struct.pack("<H", event)), (17, struct.pack("<Q", TICKS)), (10, struct.pack("<Q", number)), (1, text(channel)), (19, sid), (1, text(user)), (0, b""), (20, struct.pack("<I", 10)), (33, tree)]
        self.data += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + b"".join(v for _, v in values)
        self.data += b"\x00" * (-(len(self.data) + 4 - at) % 8)
        struct.pack_into("<I", self.data, at + 4, len(self.data) + 4 - at)
        self.data += struct.pack("<I", len(self.data) + 4 - at)
        return at

    def chunk(self):
        end = len(self.data)
        self.data[:8] = evtx.CHUNK
        struct.pack_into("<I", self.data, 40, 128)
        struct.pack_into("<I", self.data, 48, end)
        struct.pack_into("<I", self.data, 52, zlib.crc32(bytes(self.data[512:end])))
        struct.pack_into("<I", self.data, 124, zlib.crc32(bytes(self.data[:120] + self.data[128:512])))
        return bytes(self.data) + bytes(evtx.SIZE - end)


def log(*chunks):
    return evtx.LOG + bytes(evtx.HEADER - 8) + b"".join(chunks)


def chunk_of(first, n, **more):
    w = Writer()
    for k in range(n):
        w.record(first + k, f"user{first + k}", **more)
    return w.chunk()


def read(spark, tmp_path, data, chunks=256, name="x.evtx"):
    (tmp_path / name).write_bytes(data)
    return evtx.records(spark, str(tmp_path / name), chunks)


def test_records_by_value(spark, tmp_path):
    rows = read(spark, tmp_path, log(chunk_of(1, 3), chunk_of(4, 2, guid=False))).orderBy("record_id").collect()
    assert [(r["chunk"], r["record_id"], r["checksum"], r["issue"]) for r in rows] == [(0, 1, True, None), (0, 2, True, None), (0, 3, True, None), (1, 4, True, None), (1, 5, True, None)]
    event = json.loads(rows[1]["raw"])["Event"]
    assert event["System"] == {
        "Provider": {"#attributes": {"Name": "Provider-Ä", "Guid": "03020100-0504-0706-0809-0A0B0C0D0E0F"}}, "EventID": 4624, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-17T21:20:00.000000Z"}}, "EventRecordID": 2,
        "Channel": "Security", "Computer": "WS-01", "Security": {"#attributes": {"UserID": "S-1-5-32-544"}},
    }
    assert event["EventData"] == {"Data": [{"#attributes": {"Name": "TargetUserName"}, "#text": "user2"}, {"#attributes": {"Name": "LogonType"}, "#text": "0xa"}]}
    assert "Guid" not in json.loads(rows[4]["raw"])["Event"]["System"]["Provider"]["#attributes"]
    assert rows[0]["offset"] == evtx.HEADER + 512 and rows[0]["written"].replace(tzinfo=UTC) == datetime(2024, 1, 17, 21, 20, 1, tzinfo=UTC)


def test_any_ranges_of_chunks_give_the_same(spark, tmp_path):
    data = log(*(chunk_of(10 * k, 5) for k in range(7)))
    want = sorted(map(tuple, read(spark, tmp_path, data).collect()))
    for chunks in (1, 2, 3):
        found = evtx.records(spark, str(tmp_path), chunks)
        assert sorted(map(tuple, found.collect())) == want and found.rdd.getNumPartitions() == -(-7 // chunks)


def test_damage_stays_where_it_is(spark, tmp_path):
    w = Writer()
    places = [w.record(k, f"u{k}") for k in range(1, 5)]
    struct.pack_into("<I", w.data, places[1] + 4, 7)
    whole = bytearray(w.chunk())
    # a token that doesn't exist, in the third record
    whole[places[2] + 24] = 0x3B
    bad = b"NotAChnk" + chunk_of(50, 2)[8:]
    unused = bytes(evtx.SIZE)
    bounds = bytearray(chunk_of(60, 2))
    struct.pack_into("<I", bounds, 48, 1 << 20)
    rows = read(spark, tmp_path, log(chunk_of(100, 2), bytes(whole), bad, unused, bytes(bounds), chunk_of(200, 1))).orderBy("chunk", "offset").collect()
    assert [(r["chunk"], r["record_id"], r["raw"] is not None, r["issue"]) for r in rows] == [
        (0, 100, True, None), (0, 101, True, None), (1, 1, True, None), (1, 2, False, "record with impossible bounds"), (1, 3, False, "unknown token 59"), (1, 4, True, None), (2, None, False, "chunk without its mark"),
        (4, None, False, "chunk with impossible bounds"), (5, 200, True, None),
    ]
    assert {r["chunk"]: r["checksum"] for r in rows if r["raw"]} == {0: True, 1: False, 5: True}
    total = evtx.summary(evtx.records(spark, str(tmp_path))).first()
    assert (total["records"], total["damaged_records"], total["damaged_chunks"], total["quality"]) == (5, 2, 2, "Partial")


@pytest.mark.parametrize(("data", "issue"), [(b"ElfFile\0", "8 bytes are no header and whole chunks"), (bytes(evtx.HEADER + evtx.SIZE), "no event log"), (log(chunk_of(1, 1))[:-5], "69627 bytes are no header and whole chunks")])
def test_files_that_are_no_logs(spark, tmp_path, data, issue):
    assert [(r["raw"], r["issue"]) for r in read(spark, tmp_path, data).collect()] == [(None, issue)]


def test_any_damaged_byte_costs_no_other_chunk(spark, tmp_path):
    one, two = chunk_of(1, 3), chunk_of(10, 2)
    for at in range(512, 2200, 7):
        broken = bytearray(one)
        broken[at] ^= 0xFF
        rows = [*evtx.chunk_rows(bytes(broken))]
        assert len(rows) <= 4 and all(("raw" in r) != ("issue" in r) or r.get("issue") for r in rows)
    assert [r["record_id"] for r in evtx.chunk_rows(two)] == [10, 11]


def test_trees_as_values_and_several_files(spark, tmp_path):
    # an element of its own as a value, without a number of what it depends on, whose name stands within the value
    w = Writer()
    w.record(1, "first")
    probe = Writer()
    probe.data = bytearray(w.data)
    probe.names, probe.template = dict(w.names), w.template
    probe.record(2, "second", tree=b"\xee" * 60)
    inner_at = bytes(probe.data).rfind(b"\xee" * 60)
    body = b"\x0f\x01\x01\x00" + b"\x01" + struct.pack("<I", 0) + struct.pack("<I", inner_at + 13) + struct.pack("<IHH", 0, 0, 4) + "More".encode("utf-16-le") + b"\0\0" + b"\x02" + struct.pack("<BBH", 5, 1, 2) + "hi".encode("utf-16-le") + b"\x04\x00"
    assert len(body) <= 60
    w.record(2, "second", tree=body + b"\0" * (60 - len(body)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y.evtx").write_bytes(log(w.chunk()))
    (tmp_path / "x.evtx").write_bytes(log(chunk_of(5, 1, channel="Microsoft-Windows-Sysmon/Operational", event=1)))
    rows = evtx.records(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [r["record_id"] for r in rows] == [1, 2, 5] and json.loads(rows[1]["raw"])["Event"]["EventData"].get("More") == "hi"


def test_records_as_observations(spark, tmp_path):
    found = records.observations(read(spark, tmp_path, log(chunk_of(1, 2))), "raw")
    got = found.select("head.number", "head.provider", "head.channel", "head.computer", "head.user_sid", "head.record_id", "kind", F.get_json_object("details", "$.target_user_name").alias("user")).orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [(4624, "Provider-Ä", "Security", "WS-01", "S-1-5-32-544", k, "logon_success", f"user{k}") for k in (1, 2)]
