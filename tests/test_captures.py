import struct
import tracemalloc

from tracewright.functions import blake3
from tracewright.operators import flows
from tracewright.sources import captures


def tcp(a, b, sport, dport, seq, flags, data=b"", vlan=None):
    body = struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 0x50, flags, 100, 0, 0) + data
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0, bytes(a), bytes(b)) + body
    return bytes(12) + (struct.pack(">HHH", 0x8100, vlan, 0x0800) if vlan else b"\x08\x00") + ip


def udp6():
    body = struct.pack(">HHHH", 53, 9, 11, 0) + b"dns"
    return bytes(12) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), 17, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + body


def classic(frames, order="<", magic=0xA1B2C3D4, cut=0):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for k, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + k, 5, len(f), len(f)) + f
    return out[: len(out) - cut]


def block(kind, body):
    body += bytes(-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


A, B = (10, 0, 0, 1), (10, 0, 0, 2)


def read(spark, tmp_path, data):
    (tmp_path / "x.cap").write_bytes(data)
    return captures.packets(spark, str(tmp_path / "x.cap"))


def test_classic_files(spark, tmp_path):
    for order in "<>":
        got = read(spark, tmp_path, classic([tcp(A, B, 1, 80, 7, 2, vlan=5), udp6(), b"short"], order)).orderBy("packet_index").collect()
        assert [(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, r.vlan, r.tcp_flags, r.tcp_sequence) for r in got] == [("10.0.0.1", "10.0.0.2", 1, 80, "TCP", 5, "SYN", 7), ("::1", "::2", 53, 9, "UDP", None, None, None), (None,) * 8]
        assert got[1].payload == b"dns" and got[0].ts_us == 100_000_005 and not any(r.issue for r in got)


def test_block_files(spark, tmp_path):
    section = block(captures.SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    interface = block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HHq", 14, 8, 2) + struct.pack("<HH", 0, 0))
    frame = tcp(A, B, 1, 80, 7, 2)
    packet = block(6, struct.pack("<IIIII", 0, 0, 5000, len(frame), len(frame)) + frame)
    got = read(spark, tmp_path, section + interface + packet + block(99, b"abc") + packet[:20]).orderBy("packet_index").collect()
    assert [(r.packet_index, r.ts_us, r.src_ip, r.issue) for r in got] == [(0, 2_000_005, "10.0.0.1", None), (1, None, None, "truncated block")]
    assert got[1].offset == len(section + interface + packet + block(99, b"abc"))


def records(*given, snaplen=65535, order="<"):
    """A classic file of records as given: seconds, part of one, captured and original length, bytes."""
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, 1)
    return out + b"".join(struct.pack(order + "IIII", *numbers) + data for *numbers, data in given)


def test_kinds_of_issues(spark, tmp_path):
    good = (1, 2, 60, 60, bytes(60))
    for bad, kind, more in (
        ((1, 2, 17 << 20, 60, b""), "PacketLengthLimitExceeded", 0), ((1, 2, 60, 60, bytes(59)), "TruncatedPacketRecord", 0), ((1, 2, 70000, 70000, bytes(70000)), "CapturedLengthExceedsSnaplen", 0),
        ((1, 2, 60, 59, bytes(60)), "OriginalLengthSmallerThanCaptured", 1), ((1, 10**6, 60, 60, bytes(60)), "InvalidTimestampFraction", 2),
    ):
        data = records(good, bad) if kind.startswith("Truncated") else records(good, bad, good)
        got = read(spark, tmp_path, data).collect()
        assert sorted((r.issue or "", r.packet_index, r.offset) for r in got if r.issue) == [(kind, 1, 24 + 76)]
        assert len([r for r in got if not r.issue]) == 1 + more and captures.summary(read(spark, tmp_path, data)).first()["quality"] == "Partial"
        if kind == "InvalidTimestampFraction":
            assert sorted((r.packet_index, r.ts_us) for r in got if not r.issue and r.ts_us) == [(0, 1_000_002), (2, 1_000_002)]


def sections():
    """Two sections of different byte order, interfaces between packets, and blocks of other kinds."""
    out, n = b"", 0
    for order in "<>":
        pack = lambda kind, body, order=order: struct.pack(order + "II", kind, len(body) + -len(body) % 4 + 12) + body + bytes(-len(body) % 4) + struct.pack(order + "I", len(body) + -len(body) % 4 + 12)
        out += pack(captures.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        for interface in range(3):
            out += pack(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 6 + interface)) + pack(99, b"x" * interface)
            for _ in range(7):
                frame = tcp(A, B, 1000 + n, 80, n, 24, b"data" * (n % 5))
                out += pack(6, struct.pack(order + "IIIII", n % (interface + 1), 0, 1000 + n, len(frame), len(frame)) + frame)
                n += 1
    return out


def test_any_ranges_give_the_rows_of_one_pass(spark, tmp_path):
    frames = [tcp(A, B, k, 80, k, 24, bytes([k]) * (k * 7 % 90)) for k in range(60)]
    for data in (classic(frames), classic(frames, ">"), sections(), records((1, 2, 60, 60, bytes(60)), (1, 2, 60, 59, bytes(60)), (1, 10**6, 60, 60, bytes(60)), (1, 2, 60, 60, bytes(60)))):
        (tmp_path / "x.cap").write_bytes(data)
        want = captures.packets_of(spark.createDataFrame([(str(tmp_path / "x.cap"), data)], "path string, content binary"), hashes=True)
        want = sorted(map(str, want.collect()))
        for size in (1, 200, 1000, 1 << 20):
            assert sorted(map(str, captures.packets(spark, str(tmp_path / "x.cap"), size, hashes=True).collect())) == want
            cuts = captures.ranges(spark, str(tmp_path / "x.cap"), size).where("issue IS NULL").collect()
            assert size > 1000 or len(cuts) >= len(data) // (size + 200) // 2
    digest = captures.packets(spark, str(tmp_path / "x.cap"), hashes=True).where("packet_index = 0 AND issue IS NULL").first()["packet_hash"]
    assert digest == blake3.digests([bytes(60)])[0]


def test_a_file_beyond_two_gigabytes_takes_bounded_memory(spark, tmp_path):
    # holes of a sparse file: 400 packets of 8 MB
    path, size, n = tmp_path / "large.cap", 8 << 20, 400
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 16 << 20, 1))
        for k in range(n):
            f.write(struct.pack("<IIII", k, 5, size, size))
            f.seek(size - 1, 1)
            f.write(b"\x01")
    assert path.stat().st_size > 3 << 30
    tracemalloc.start()
    with open(path, "rb") as f:
        cuts = list(captures.walk(f, path.stat().st_size, 64 << 20))
        assert sum((c.end - c.start) for c in cuts) == path.stat().st_size - 24 and len(cuts) > 40
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
        rows = [r for r in captures.rows_of("x", f, cuts[-1])]
    assert rows[-1]["packet_index"] == n - 1 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    found = captures.packets(spark, str(path)).agg({"packet_index": "max", "captured": "sum", "*": "count"}).first()
    assert tuple(found.asDict().values()) == (n - 1, n * size, n) or set(found.asDict().values()) == {n - 1, n * size, n}


def test_damaged_files(spark, tmp_path):
    frames = [tcp(A, B, 1, 80, 7, 2)] * 2
    for data, want in ((b"", ["unknown format"]), (b"hello", ["unknown format"]), (classic(frames, cut=3), [None, "TruncatedPacketRecord"]), (classic(frames) + b"tail", [None, None]), (classic(frames)[:10], ["truncated header"]), (classic([]), [])):
        assert [r.issue for r in read(spark, tmp_path, data).orderBy("packet_index").collect()] == want


def test_flows_and_instances(spark, tmp_path):
    frames = [tcp(A, B, 9, 80, 1, 2), tcp(B, A, 80, 9, 1, 18), tcp(A, B, 9, 80, 2, 17), tcp(A, B, 9, 80, 50, 2), tcp(A, B, 9, 81, 1, 2)]
    got = flows.flows(read(spark, tmp_path, classic(frames))).orderBy("right", "instance").collect()
    assert [(r.right, r.packets, r.forward_packets, r.backward_packets, r.fin, r.rst) for r in got] == [("10.0.0.2:80", 3, 2, 1, True, False), ("10.0.0.2:80", 1, 1, 0, False, False), ("10.0.0.2:81", 1, 1, 0, False, False)]
    assert got[0].bytes == 3 * 54 and got[0].last_us - got[0].first_us == 2_000_000


def test_streams(spark, tmp_path):
    top = 2**32 - 2
    frames = [tcp(A, B, 9, 80, top, 24, b"abcd"), tcp(A, B, 9, 80, top + 2, 24, b"cdef"), tcp(A, B, 9, 80, top, 24, b"ab"), tcp(A, B, 9, 80, top + 8, 24, b"ij")]
    packets = read(spark, tmp_path, classic(frames))
    parts = flows.streams(packets).orderBy("at", "packet_index").collect()
    assert b"".join(bytes(r.adds) for r in parts) == b"abcdefij" and sum(r.gap for r in parts) == 2
    one = flows.stream_totals(packets).first()
    assert (one.bytes, one.retransmissions, one.overlaps, one.missing, one.status) == (8, 1, 1, 2, "Gapped")
