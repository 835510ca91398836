"""Flows of a stream against those of all packets at once, for any split into batches."""

import random

import pytest

from tracewright.operators import flows
from tracewright.streaming import flow_states

SCHEMA = "file string, packet_index long, ts_us long, captured long, original long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, tcp_flags string, tcp_sequence long, payload binary, issue string"
TOTALS = ["left", "right", "protocol", *flow_states.NAMES]


def rows_of(seed, n=120):
    rng, out = random.Random(seed), []
    for k in range(n):
        a, b = rng.sample(("10.0.0.1", "10.0.0.2", "10.0.0.3"), 2)
        protocol = rng.choice(("TCP", "TCP", "TCP", "UDP", None))
        flags = rng.choice(("SYN", "SYN|ACK", "ACK", "FIN|ACK", "RST", "PSH|ACK")) if protocol == "TCP" else None
        out.append(("f", k, 1_000_000 * (1000 + k), rng.randrange(60, 90), 90, a, b, 1, 2, protocol, flags, k, b"", None))
    return out


#: A packet of another flow that comes so late that all others are idle by then, twice, since a watermark follows what a batch brought.
LATER = [("f", 10_000 + k, 1_000_000 * (20_000 + 1000 * k), 60, 60, "z", "z", 9, 9, "UDP", None, None, b"", None) for k in range(2)]


def streamed(spark, tmp_path, batches):
    source = tmp_path / "packets"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"part={k:03d}"))
    stream = spark.readStream.schema(SCHEMA + ", part string").option("maxFilesPerTrigger", 1).parquet(str(source)).drop("part")
    name = f"flows_{abs(hash(str(tmp_path))) % 10**9}"
    query = flow_states.flows(stream, idle_seconds=3600).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("seed", range(3))
def test_any_batches_give_the_flows_of_all_packets(spark, tmp_path, seed):
    rows = rows_of(seed)
    want = sorted(map(str, flows.flows(spark.createDataFrame(rows, SCHEMA)).select(TOTALS).collect()))
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), seed * 2))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for batch in batches:
        rng.shuffle(batch)
    found = streamed(spark, tmp_path, [*batches, LATER[:1], LATER[1:]])
    assert sorted(map(str, found.where("left <> 'z:9'").select(TOTALS).collect())) == want
    assert found.where("closed = 'next'").count() > 0 and found.where("closed = 'idle'").count() > 0


def test_idle_flows_close_and_others_stay(spark, tmp_path):
    one = [("f", k, 1_000_000 * (1000 + k), 60, 60, "a", "b", 1, 2, "TCP", "ACK", k, b"", None) for k in range(3)]
    busy = [("f", 10 + k, 1_000_000 * (1000 + 3000 * k), 60, 60, "c", "d", 1, 2, "TCP", "ACK", k, b"", None) for k in range(5)]
    found = streamed(spark, tmp_path, [[*one, busy[0]], *([b] for b in busy[1:])])
    assert [(r["left"], r["packets"], r["closed"]) for r in found.collect()] == [("a:1", 3, "idle")]
