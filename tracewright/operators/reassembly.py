"""TCP streams put together again, with what is odd in them, and the frames of protocols in them.

The packets of a flow come to one task in the order of capture, are told apart by instance and direction there, and leave it as they come: what a task holds is the bytes of both directions of one stream, of each
at most Limits.stream_bytes of them in at most Limits.segments pieces, however many packets the stream has, or all of them where these are None. What a limit leaves out is flagged, never dropped
silently. Of bytes that several segments bring, the first ones stay.

Issues, by kind: Retransmission, a segment that begins where one began before; Duplicate, of these one with the very same bytes; OverlapIdentical and OverlapConflict, a
segment that brings known bytes again, the same or other ones; Gap, bytes that no segment brought; ResourceLimit, bytes that a limit leaves out;
TruncatedCapture, a packet that was captured in part.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions import protocols
from .flows import KEY, ended

STREAM = [*KEY, "instance", "forward"]
SCHEMA = (
    "file string, left string, right string, protocol string, instance long, forward boolean, status string, bytes binary, retransmissions long, overlap_conflicts long, first_us long, last_us long, "
    "issue string, seq_start long, seq_end long, first_packet long, second_packet long, issue_packets map<string,long>"
)
#: Rows of a batch and bytes of streams that leave together.
BATCH, BATCH_BYTES = 1000, 8 << 20


@dataclass(frozen=True)
class Limits:
    """Pieces and bytes of a stream that are held; None for as many as there are."""

    segments: int | None = 4096
    stream_bytes: int | None = 4 << 20


#: For streams that are to be read whole, however long. The bytes of one stream still have to fit a row.
WHOLE = Limits(None, None)


@dataclass
class Stream:
    """The bytes of one direction so far, as pieces (start, bytes, packet) that don't touch one another's places."""

    limits: Limits
    first: int | None = None
    pieces: list[tuple[int, bytes, int]] = field(default_factory=list)
    began: dict[int, tuple[int, bytes]] = field(default_factory=dict)
    size: int = 0
    again: int = 0
    conflicts: int = 0
    limited: bool = False
    cut_short: bool = False

    def place(self, sequence: int) -> int:
        """A sequence number as a place: numbers wrap, and far below the first one means far above."""
        if self.first is None:
            self.first = sequence
        return (sequence - self.first + (1 << 31)) % (1 << 32) - (1 << 31)

    def after(self, place: int) -> int:
        """How many pieces begin at a place or before it; most segments come behind all that is known."""
        return len(self.pieces) if not self.pieces or self.pieces[-1][0] <= place else bisect_right(self.pieces, place, key=lambda p: p[0])

    def number(self, place: int) -> int:
        return (self.first + place) % (1 << 32)

    def issue(self, kind: str, start: int, end: int, first: int | None, second: int | None) -> dict:
        return {"issue": kind, "seq_start": self.number(start), "seq_end": self.number(end), "first_packet": first, "second_packet": second}

    def add(self, sequence: int, data: bytes, packet: int, truncated: bool) -> Iterator[dict]:
        start = self.place(sequence)
        end = start + len(data)
        if truncated:
            self.cut_short = True
            yield self.issue("TruncatedCapture", start, end, None, packet)
        if not data:
            return
        before = self.began.get(start)
        if before:
            self.again += 1
            yield self.issue("Retransmission", start, end, before[0], packet)
            if before[1] == data:
                yield self.issue("Duplicate", start, end, before[0], packet)
        at, new = start, []
        k = max(0, self.after(start) - 1)
        for known_at, known, owner in self.pieces[k:]:
            if known_at >= end:
                break
            lo, hi = max(known_at, start), min(known_at + len(known), end)
            if lo >= hi:
                continue
            if lo > at:
                new.append((at, data[at - start : lo - start], packet))
            same = known[lo - known_at : hi - known_at] == data[lo - start : hi - start]
            self.conflicts += not same
            if not (before and before[1] == data):
                yield self.issue("OverlapIdentical" if same else "OverlapConflict", lo, hi, owner, packet)
            at = hi
        if at < end:
            new.append((at, data[at - start :], packet))
        full = lambda held: self.limits.segments is not None and len(held) >= self.limits.segments
        for piece_at, piece, _ in new:
            room = 0 if full(self.pieces) else len(piece) if self.limits.stream_bytes is None else max(0, self.limits.stream_bytes - self.size)
            kept = piece[:room]
            if len(kept) < len(piece):
                self.limited = True
                yield self.issue("ResourceLimit", piece_at + len(kept), piece_at + len(piece), None, packet)
            if kept:
                self.pieces.insert(self.after(piece_at), (piece_at, kept, packet))
                self.size += len(kept)
        if before is None and not full(self.began):
            self.began[start] = packet, data

    def end(self) -> tuple[dict, list[dict]]:
        gaps = [self.issue("Gap", a + len(d), b, p, q) for (a, d, p), (b, _, q) in zip(self.pieces, self.pieces[1:], strict=False) if a + len(d) < b]
        status = "Truncated" if self.limited else "Gapped" if gaps or self.conflicts else "Partial" if self.cut_short else "Complete"
        return {"status": status, "bytes": b"".join(d for _, d, _ in self.pieces), "retransmissions": self.again, "overlap_conflicts": self.conflicts}, gaps


def reassembled(packets: DataFrame, limits: Limits = Limits(), issues: bool = True) -> DataFrame:
    """A row for each stream and direction that has bytes, with its status, its bytes and, by kind, at how many packets issues were met, and with issues one for each of them, which have no status.

    packets are as captures gives them. Flows are dealt over tasks; one flow is read by one of them, once, in the order of its packets.
    """
    own, opens, ends = ended(packets)
    own = own.where("protocol = 'TCP'").withColumns({"opens": opens, "ends": ends})
    cut = F.col("captured") < F.col("original") if "original" in packets.columns else F.lit(False)
    rows = own.select(*KEY, "forward", "packet_index", "tcp_sequence", F.coalesce("payload", F.lit(b"")).alias("payload"), F.coalesce(cut, F.lit(False)).alias("truncated"), "ts_us", "opens", "ends")
    rows = rows.withColumn("counts", F.expr("tcp_sequence IS NOT NULL AND (truncated OR length(payload) > 0)")).where("counts OR opens OR ends")
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,long>": pa.map_(pa.string(), pa.int64())}
    out = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
    fields = ("forward", "packet_index", "tcp_sequence", "payload", "truncated", "ts_us", "opens", "ends", "counts")

    def work(batches):
        held, size, now = [], 0, None
        # of the flow that is read: its instance, whether it has ended, and by direction its stream, its first and last time, and by kind the packets with issues and the last one
        instance, over, both = 0, False, {}

        def counted(at, i):
            last = at[2].setdefault(i["issue"], [0, None])
            if i["second_packet"] is not None and i["second_packet"] != last[1]:
                last[:] = last[0] + 1, i["second_packet"]

        def closed():
            for forward, at in both.items():
                total, gaps = at[0].end()
                for g in gaps:
                    counted(at, g)
                name = dict(zip(STREAM, (*now, instance, forward), strict=True))
                if at[0].size or at[0].limited:
                    yield name | total | {"first_us": at[1][0], "last_us": at[1][1], "issue_packets": [(k, n) for k, (n, _) in sorted(at[2].items())]}
                if issues:
                    yield from (name | g for g in gaps)
            both.clear()

        def every():
            nonlocal now, instance, over
            for batch in batches:
                new = np.zeros(batch.num_rows, bool)
                new[:1] = True
                for c in KEY:
                    codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    new[1:] |= codes[1:] != codes[:-1]
                begins = set(np.flatnonzero(new).tolist())
                for k, (forward, packet, sequence, payload, truncated, ts, opens, ends, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in fields), strict=True)):
                    if k in begins:
                        name = tuple(batch.column(c)[k].as_py() for c in KEY)
                        if name != now:
                            yield from closed()
                            now, instance, over = name, 0, False
                    if opens:
                        if over:
                            yield from closed()
                            instance += 1
                        over = False
                    over = over or ends
                    if not counts:
                        continue
                    at = both.get(forward)
                    if at is None:
                        at = both[forward] = Stream(limits), [ts, ts], {}
                    if ts is not None:
                        at[1][:] = (ts, ts) if at[1][0] is None else (min(at[1][0], ts), max(at[1][1], ts))
                    for i in at[0].add(sequence, payload, packet, truncated):
                        counted(at, i)
                        if issues:
                            yield dict(zip(STREAM, (*now, instance, forward), strict=True)) | i
            yield from closed()

        for row in every():
            held.append(row)
            size += len(row.get("bytes") or b"")
            if len(held) >= BATCH or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, out)

    return rows.repartition(*(F.col(c) for c in KEY)).sortWithinPartitions(*KEY, "packet_index").mapInArrow(work, SCHEMA)


def dns_messages_of(streams: DataFrame, keys: list[str]) -> DataFrame:
    """keys of each stream and the DNS messages (m) of its frames, in their order. Messages leave a task as they are read, so that a long stream takes no more of it than its bytes."""
    rows = streams.select(*keys, "bytes").where("bytes IS NOT NULL")
    schema = StructType([*(rows.schema[k] for k in keys), StructField("m", protocols.DNS_TYPE)])
    arrow = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name = [batch.column(c)[k].as_py() for c in keys]
                for some in protocols.dns_batches(batch.column("bytes")[k].as_py(), BATCH):
                    yield pa.RecordBatch.from_arrays([*(pa.array([n] * len(some), f.type) for n, f in zip(name, arrow, strict=False)), pa.array(some, arrow.field("m").type)], schema=arrow)

    return rows.mapInArrow(work, schema)


def streams_of(found: DataFrame) -> DataFrame:
    """The streams among the rows of reassembled."""
    return found.where("status IS NOT NULL").select(*STREAM, "status", "bytes", "retransmissions", "overlap_conflicts", "first_us", "last_us", "issue_packets")


def issues_of(found: DataFrame) -> DataFrame:
    """The issues among the rows of reassembled."""
    return found.where("issue IS NOT NULL").select(*STREAM, "issue", "seq_start", "seq_end", "first_packet", "second_packet")
