"""Flows of packets: keys without direction, instances, totals, and the bytes of TCP streams in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import instances

KEY = ["file", "left", "right", "protocol"]


def _flag(name: str) -> Column:
    return F.coalesce(F.col("tcp_flags").contains(name), F.lit(False))


def ended(packets: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Packets with both ends of their flow in order and whether they go from left to right, and which of them open and end an instance of it."""
    end = lambda ip, port: F.concat_ws(":", F.coalesce(ip, F.lit("?")), F.coalesce(port, F.lit(0)).cast("string"))
    a, b = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    own = packets.where("issue IS NULL").withColumns({"left": F.least(a, b), "right": F.greatest(a, b), "forward": a <= b, "protocol": F.coalesce("protocol", F.lit("UNKNOWN"))})
    return own, (F.col("protocol") == "TCP") & _flag("SYN") & ~_flag("ACK"), _flag("FIN") | _flag("RST")


def keyed(packets: DataFrame) -> DataFrame:
    """Packets with both ends of their flow in order, whether they go from left to right, and the flow's instance.

    A new instance begins with a SYN without ACK once the one before has had a FIN or RST.
    """
    own, opens, ends = ended(packets)
    return instances(own, KEY, ["packet_index"], opens, ends)


def flows(packets: DataFrame) -> DataFrame:
    """One row for each instance of a flow: packets and bytes in all and in each direction, times, and whether it was ended."""
    size = F.col("captured")
    return keyed(packets).groupBy(*KEY, "instance").agg(
        F.count("*").alias("packets"), F.sum(size).alias("bytes"), F.count_if("forward").alias("forward_packets"), F.sum(F.when(F.col("forward"), size).otherwise(0)).alias("forward_bytes"),
        F.count_if(~F.col("forward")).alias("backward_packets"), F.sum(F.when(~F.col("forward"), size).otherwise(0)).alias("backward_bytes"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.bool_or(_flag("FIN")).alias("fin"), F.bool_or(_flag("RST")).alias("rst"),
    )


def streams(packets: DataFrame) -> DataFrame:
    """The parts of TCP streams in order: for each instance and direction, the bytes that each segment adds, at their place.

    Segments are ordered by their distance from the stream's smallest sequence number. One that lies within what came
    before adds nothing (retransmitted); one that begins there adds its rest (overlap); gap is how many bytes are missing
    before a segment. A stream is never gathered in one row; string_agg or a writer may join its parts.
    """
    own = keyed(packets).where("protocol = 'TCP' AND tcp_sequence IS NOT NULL AND length(payload) > 0")
    stream = [*KEY, "instance", "forward"]
    start = Window.partitionBy(*stream)
    # numbers wrap at 2 ** 32: far below the first packet's one means far above
    first = F.min_by("tcp_sequence", "packet_index").over(start)
    shift = F.pmod(F.col("tcp_sequence") - first + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    own = own.withColumn("at", shift).withColumn("at", F.col("at") - F.min("at").over(start)).withColumn("end", F.col("at") + F.length("payload"))
    before = F.coalesce(F.max("end").over(Window.partitionBy(*stream).orderBy("at", "packet_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    own = own.withColumn("before", before)
    known = F.least(F.greatest(F.col("before") - F.col("at"), F.lit(0)), F.length("payload")).cast("int")
    return own.select(
        *stream, "packet_index", "at", F.expr("substring(payload, cast(least(greatest(before - at, 0), length(payload)) as int) + 1)").alias("adds"), F.greatest(F.col("at") - F.col("before"), F.lit(0)).alias("gap"),
        F.when(known == 0, "new").when(known == F.length("payload"), "retransmitted").otherwise("overlap").alias("kind"),
    )


def stream_totals(packets: DataFrame) -> DataFrame:
    """For each TCP stream, its bytes without repetition, retransmissions, overlaps, missing bytes and status."""
    own = streams(packets).groupBy(*KEY, "instance", "forward").agg(F.sum(F.length("adds")).alias("bytes"), F.count_if(F.col("kind") == "retransmitted").alias("retransmissions"), F.count_if(F.col("kind") == "overlap").alias("overlaps"), F.sum("gap").alias("missing"))
    return own.withColumn("status", F.when(F.col("missing") > 0, "Gapped").otherwise("Complete"))
