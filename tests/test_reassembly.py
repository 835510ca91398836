"""Streams against a version that keeps each byte by itself."""

import random

import pytest

from tracewright.operators import reassembly

SCHEMA = "file string, packet_index long, ts_us long, captured long, original long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, tcp_flags string, tcp_sequence long, payload binary, issue string"


def packets(spark, rows, forward=True):
    """Packets of one stream: place in it, bytes, and whether the capture cut them."""
    ends = ("a", "b", 1, 2) if forward else ("b", "a", 2, 1)
    out = [("f", k, 1000 + k, len(d), len(d) + cut, *ends[:2], *ends[2:], "TCP", "ACK", s % 2**32, d, None) for k, (s, d, cut) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def plain(rows, limit=None):
    """The bytes of a stream by place, from the first packet that brought each, and its issues as (kind, start, end, packet)."""
    first = rows[0][0]
    known, began, issues, again, conflicts, cut_short = {}, {}, [], 0, 0, False
    for k, (s, data, cut) in enumerate(rows):
        at = (s - first + 2**31) % 2**32 - 2**31
        if cut:
            cut_short = True
            issues.append(("TruncatedCapture", at, at + len(data), k))
        if not data:
            continue
        copy = at in began and began[at] == data
        if at in began:
            again += 1
            issues.append(("Retransmission", at, at + len(data), k))
            if copy:
                issues.append(("Duplicate", at, at + len(data), k))
        # stretches of known bytes of one owner each
        i = 0
        while i < len(data):
            if at + i not in known:
                i += 1
                continue
            j = i
            while j < len(data) and at + j in known and known[at + j][1:] == known[at + i][1:]:
                j += 1
            same = all(known[at + x][0] == data[x] for x in range(i, j))
            conflicts += not same
            if not copy:
                issues.append(("OverlapIdentical" if same else "OverlapConflict", at + i, at + j, k))
            i = j
        run = None
        for x, b in enumerate(data):
            if at + x in known:
                run = None
            else:
                run = at + x if run is None else run
                known[at + x] = (b, k, run)
        began.setdefault(at, data)
    places = sorted(known)
    gaps = [("Gap", a + 1, b, None) for a, b in zip(places, places[1:]) if a + 1 < b]
    status = "Gapped" if gaps or conflicts else "Partial" if cut_short else "Complete"
    return bytes(known[p][0] for p in places), status, again, conflicts, issues + gaps


def read(spark, rows, **limits):
    found = reassembly.reassembled(packets(spark, rows), reassembly.Limits(**limits)).cache()
    stream = reassembly.streams_of(found).collect()
    return stream[0] if stream else None, reassembly.issues_of(found).collect()


@pytest.mark.parametrize("seed", range(6))
def test_streams_equal_those_by_bytes(spark, seed):
    rng = random.Random(seed)
    text = bytes(rng.randrange(256) for _ in range(120))
    start = rng.choice((5, 2**32 - 50))
    rows = []
    for _ in range(40):
        a = rng.randrange(0, 110)
        data = text[a : a + rng.randrange(0, 25)]
        if rng.random() < 0.15:
            data = bytes(b ^ 1 if rng.random() < 0.3 else b for b in data)
        rows.append((start + a, data, int(rng.random() < 0.1)))
    rows += [rows[0], rows[3]]
    stream, issues = read(spark, rows)
    want, status, again, conflicts, odd = plain(rows)
    assert bytes(stream["bytes"]) == want and (stream["status"], stream["retransmissions"], stream["overlap_conflicts"]) == (status, again, conflicts)
    number = lambda place: (rows[0][0] + place) % 2**32
    got = sorted((i["issue"], i["seq_start"], i["seq_end"], -1 if i["issue"] == "Gap" else i["second_packet"]) for i in issues)
    assert got == sorted((kind, number(a), number(b), -1 if k is None else k) for kind, a, b, k in odd)
    assert (stream["first_us"], stream["last_us"]) == (1000 + min(k for k, r in enumerate(rows) if r[1] or r[2]), 1000 + max(k for k, r in enumerate(rows) if r[1] or r[2]))


def test_each_kind_of_issue(spark):
    kinds = lambda rows, **limits: sorted({i["issue"] for i in read(spark, rows, **limits)[1]})
    assert kinds([(0, b"abcd", 0), (4, b"ef", 0)]) == []
    assert kinds([(0, b"abcd", 0), (6, b"ef", 0)]) == ["Gap"]
    assert kinds([(0, b"abcd", 0), (0, b"abcd", 0)]) == ["Duplicate", "Retransmission"]
    assert kinds([(0, b"abcd", 0), (2, b"cdef", 0)]) == ["OverlapIdentical"]
    assert kinds([(0, b"abcd", 0), (2, b"xyz", 0)]) == ["OverlapConflict"]
    assert kinds([(0, b"abcd", 3)]) == ["TruncatedCapture"]
    assert kinds([(0, b"abcd", 0), (4, b"efgh", 0)], stream_bytes=6) == ["ResourceLimit"]
    stream, issues = read(spark, [(0, b"abcd", 0), (4, b"efgh", 0), (20, b"x", 0)], stream_bytes=6)
    assert (bytes(stream["bytes"]), stream["status"]) == (b"abcdef", "Truncated") and [(i["seq_start"], i["seq_end"]) for i in issues] == [(6, 8), (20, 21)]
    stream, issues = read(spark, [(10 * k, b"ab", 0) for k in range(5)], segments=3)
    assert bytes(stream["bytes"]) == b"ababab" and [i["issue"] for i in issues].count("ResourceLimit") == 2


def test_directions_instances_and_empty_captures(spark):
    both = packets(spark, [(7, b"ask", 0)]).union(packets(spark, [(9, b"answer", 0), (50, b"", 0)], forward=False).withColumn("packet_index", reassembly.F.col("packet_index") + 10))
    found = reassembly.streams_of(reassembly.reassembled(both)).orderBy("forward").collect()
    assert [(r["forward"], bytes(r["bytes"])) for r in found] == [(False, b"answer"), (True, b"ask")]
    assert reassembly.reassembled(both.limit(0)).count() == 0
