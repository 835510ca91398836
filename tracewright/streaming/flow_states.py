"""Flows of a stream of packets: state by flow key, in which a flow stays until a new one begins or nothing comes for a while.

What a flow has so far is one small row of state a key, whatever the number of its packets, and lies in the state store that a lost executor's tasks
read again. Packets of a key are taken in the order of their capture within a batch, batches in theirs; so it doesn't matter where one batch ends and the next begins: the flows are
those that `operators.flows.flows` finds in all packets at once, but for flows that were idle for longer than the limit, which it has no notion of.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.flows import KEY

TOTALS = "instance long, packets long, bytes long, forward_packets long, forward_bytes long, backward_packets long, backward_bytes long, first_us long, last_us long, fin boolean, rst boolean"
SCHEMA = "file string, left string, right string, protocol string, " + TOTALS + ", closed string"
NAMES = [x.split()[0] for x in TOTALS.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(old: tuple | None, rows: pd.DataFrame, instance: int) -> tuple:
    """The totals of a flow with further packets, which may be none at first."""
    forward = rows["forward"]
    size = rows["captured"]
    new = (
        instance, len(rows), int(size.sum()), int(forward.sum()), int(size[forward].sum()), int((~forward).sum()), int(size[~forward].sum()), int(rows["ts_us"].min()), int(rows["ts_us"].max()), bool(rows["fin"].any()), bool(rows["rst"].any()),
    )
    if old is None:
        return new
    return (instance, *(a + b for a, b in zip(old[1:7], new[1:7], strict=True)), min(old[7], new[7]), max(old[8], new[8]), old[9] or new[9], old[10] or new[10])


class FlowProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", TOTALS)

    def row(self, key: tuple, flow: tuple, closed: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, *flow, closed)], columns=[*KEY, *NAMES, "closed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        packets = pd.concat(list(rows)).sort_values("packet_index", ignore_index=True)
        flow = tuple(self.flow.get()) if self.flow.exists() else None
        start = 0
        for at in (*packets.index[packets["opens"]].tolist(), len(packets)):
            # a flow takes what comes before the next beginning
            if at > start:
                flow = joined(flow, packets.iloc[start:at], 0 if flow is None else flow[0])
            if at < len(packets) and flow is not None and (flow[9] or flow[10]):
                yield self.row(key, flow, "next")
                flow = (flow[0] + 1, 0, 0, 0, 0, 0, 0, 1 << 62, 0, False, False)
            start = at
        self.flow.update(flow)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(flow[8] // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flow = tuple(self.flow.get())
        self.flow.clear()
        yield self.row(key, flow, "idle")

    def close(self) -> None:
        pass


def flows(packets: DataFrame, idle_seconds: int = 300, delay: str = "60 seconds") -> DataFrame:
    """A row for each flow of a stream of packets, as captures gives them, when it closes: closed says whether by the next one or by being idle.

    A flow is idle when packets of other flows are so much later, and the delay. Packets that come later than the delay are dropped. Rows
    without a time or with an issue are none of a flow.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    end = lambda ip, port: F.concat_ws(":", F.coalesce(ip, F.lit("?")), F.coalesce(port, F.lit(0)).cast("string"))
    a, b = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    flag = lambda name: F.coalesce(F.col("tcp_flags").contains(name), F.lit(False))
    protocol = F.coalesce("protocol", F.lit("UNKNOWN"))
    own = packets.where("issue IS NULL AND ts_us IS NOT NULL").select(
        "file", F.least(a, b).alias("left"), F.greatest(a, b).alias("right"), protocol.alias("protocol"), "packet_index", "ts_us", "captured", (a <= b).alias("forward"), flag("FIN").alias("fin"), flag("RST").alias("rst"),
        ((protocol == "TCP") & flag("SYN") & ~flag("ACK")).alias("opens"), F.timestamp_micros("ts_us").alias("at"),
    )
    by_key = own.withWatermark("at", delay).groupBy(*KEY)
    return by_key.transformWithStateInPandas(FlowProcessor(1000 * idle_seconds), SCHEMA, "Append", "EventTime")
