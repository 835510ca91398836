"""Observations: what captures and snapshots of hosts show, as rows of one form for rules, timelines and correlations to read.

A row has source_tool, raw_event_type, at, and data, a JSON object with nulls for what isn't known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocols
from .flows import KEY, flows, keyed
from .reassembly import Limits, reassembled, streams_of

#: Ports by which a stream is read as DNS, HTTP or TLS.
DNS_PORTS, HTTP_PORTS, TLS_PORTS = (53,), (80, 8080, 8000), (443, 8443)


def json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def c(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _row(rows: DataFrame, kind: str | Column, data: Column, flow: Column, protocol: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(
        "file", F.lit("pcap_parser").alias("source_tool"), kind.alias("raw_event_type"), F.timestamp_micros("ts_us").alias("at"), data.alias("data"), F.lit("Complete").alias("capture_quality"), flow.alias("flow_quality"),
        protocol.alias("protocol_quality"), "packet_index", "packet_locator",
    )


def flow_quality(protocol: Column, fin: Column, rst: Column) -> Column:
    """A TCP flow is truncated by a reset, and partial without an end."""
    tcp = protocol == "TCP"
    return F.when(tcp & rst, "Truncated").when(tcp & ~fin, "Partial").otherwise("Complete")


def of_capture(packets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Observations of packets, as captures gives them: a socket for each packet with addresses, a DNS message for each UDP packet of its port, a flow, and what a TCP flow's first
    direction says by the port of its first packet: a DNS message, an HTTP head or a TLS handshake.

    Nothing is capped; windows.first_k gives the first so many of each kind. capture_quality is Complete for what a capture gave whole rows of.
    """
    none = F.lit(None).cast("string")
    own = packets.where("issue IS NULL")
    sockets = own.where("dst_ip IS NOT NULL")
    data = json(destination_ip=F.col("dst_ip"), destination_port=F.col("dst_port"), source_ip=F.col("src_ip"), source_port=F.col("src_port"), **c("protocol", "tcp_flags", "packet_index", "packet_locator"), captured_len=F.col("captured"), original_len=F.col("original"))
    out = _row(sockets, "network_socket", data, none, none)
    asked = sockets.where("protocol = 'UDP' AND (src_port = 53 OR dst_port = 53)").withColumn("m", protocols.dns(F.coalesce("payload", F.lit(b""))))
    ends = {"source_ip": F.col("src_ip"), "destination_ip": F.col("dst_ip"), "source_port": F.col("src_port"), "destination_port": F.col("dst_port"), "packet_index": F.col("packet_index")}
    good = json(**{n: F.col(f"m.{n}") for n in ("id", "response", "rcode", "qname", "qtype", "answers")}, **ends)
    bad = json(parse_error=F.col("m.issue"), offset=F.col("m.issue_at"), source_ip=F.col("src_ip"), destination_ip=F.col("dst_ip"), packet_index=F.col("packet_index"))
    odd = F.col("m.issue").isNotNull()
    out = out.union(_row(asked, "dns_message", F.when(odd, bad).otherwise(good), none, F.when(odd, "Degraded").otherwise("Complete")))
    # the first packet of each flow says where it was, which way it went and to which port
    first = F.struct("packet_index", "ts_us", "packet_locator", "forward", F.coalesce("dst_port", "src_port").alias("port"))
    starts = keyed(packets).groupBy(*KEY, "instance").agg(F.min(first).alias("f")).select(*KEY, "instance", "f.*")
    totals = flows(packets)
    named = totals.join(starts, [*KEY, "instance"]).withColumn("quality", flow_quality(F.col("protocol"), F.col("fin"), F.col("rst")))
    out = out.union(_row(named, "network_flow", json(flow=F.struct(*totals.columns)), F.col("quality"), none))
    port = F.col("port")
    read = named.where((F.col("protocol") == "TCP") & port.isin(*DNS_PORTS, *HTTP_PORTS, *TLS_PORTS)).select(*KEY, "instance", "forward", "ts_us", "packet_index", "packet_locator", "port", "quality")
    streams = streams_of(reassembled(packets, limits, issues=False)).select(*KEY, "instance", "forward", "status", "bytes").join(read, [*KEY, "instance", "forward"])
    dns = streams.where(port.isin(*DNS_PORTS)).withColumn("m", F.get(protocols.dns_frames("bytes"), F.lit(0))).where("m IS NOT NULL AND m.issue IS NULL")
    http = streams.where(port.isin(*HTTP_PORTS)).withColumn("m", protocols.http(F.col("bytes"))).where("m IS NOT NULL")
    tls = streams.where(port.isin(*TLS_PORTS)).withColumn("m", protocols.tls("bytes"))
    whole = F.when(F.col("status") == "Complete", "Complete").otherwise("Partial")
    quality = F.col("quality")
    out = out.union(_row(dns, "dns_message", F.to_json("m"), quality, whole)).union(_row(http, "http_message", F.to_json("m"), quality, whole))
    said = F.when(odd, json(parse_error=F.col("m.issue"), offset=F.col("m.issue_at"))).otherwise(F.to_json("m"))
    return out.union(_row(tls, "tls_handshake", said, quality, F.when(odd, "Degraded").otherwise("Complete")))


#: For each collection of a snapshot, the collector's and event's name, and the data's members by the columns they come from.
COLLECTIONS = {
    "processes": ("process", "process", {n: n for n in ("pid", "ppid", "parent_name", "executable_path", "command_line", "username", "uid", "exe_deleted", "sha256", "started_at")} | {"process_name": "name"}),
    "sockets": ("socket", "network_socket", {"protocol": "protocol", "local_address": "local_address", "local_port": "local_port", "destination_ip": "remote_address", "destination_port": "remote_port", "state": "state", "owning_pid": "pid", "process_name": "process_name"}),
    "services": ("service", "service", {"service_name": "service_name", "display_name": "display_name", "status": "state", "start_type": "start_type", "binary_path": "binary_path", "account": "account", "unquoted_risk": "unquoted_risk"}),
    "autoruns": ("autorun", "autorun", {"autorun_key": "key", "item_name": "value_name", "target_path": "resolved_executable", "value_data": "value_data", "mechanism": "mechanism", "owner": "owner"}),
    "tasks": ("task", "scheduled_task", {"task_name": "task_name", "task_path": "task_path", "state": "state", "action": "action", "arguments": "arguments", "mechanism": "mechanism", "schedule": "schedule", "user": "user"}),
}


def of_hosts(hosts: DataFrame, **collections: DataFrame) -> DataFrame:
    """host, source_tool, raw_event_type and data of what snapshots hold: collections by their names in COLLECTIONS, each with host; hosts has host, host_ip and platform.

    A process names its parent, an empty text if the snapshot has none; of processes with one number the smallest name counts. A task's action has its arguments. What a collection has no column for is null.
    """
    given = hosts.select("host", "host_ip", F.when(F.coalesce("platform", F.lit("")) == "", "host").otherwise(F.col("platform")).alias("platform"))
    out = None
    for name, rows in collections.items():
        collector, event, members = COLLECTIONS[name]
        if name == "processes":
            parents = rows.groupBy("host", F.col("pid").alias("ppid")).agg(F.min("name").alias("_parent"))
            rows = rows.join(parents, ["host", "ppid"], "left").withColumn("parent_name", F.coalesce("_parent", F.lit("")))
        if name == "tasks":
            rows = rows.withColumn("action", F.when(F.col("action").isNotNull() & (F.trim(F.coalesce("arguments", F.lit(""))) != ""), F.concat("action", F.lit(" "), "arguments")).otherwise(F.col("action")))
        fields = {n: F.col(f"r.{x}") if x in rows.columns else F.lit(None).cast("string") for n, x in members.items()}
        own = rows.select("host", F.struct(*rows.columns).alias("r")).join(given, "host")
        data = json(**fields, platform=F.col("platform"), host=F.col("host"), host_ip=F.col("host_ip"))
        own = own.select("host", F.concat("platform", F.lit(f"_{collector}_collector")).alias("source_tool"), F.lit(event).alias("raw_event_type"), data.alias("data"))
        out = own if out is None else out.union(own)
    return out
