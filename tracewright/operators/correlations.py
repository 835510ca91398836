"""Correlations of observations in time: a process with names that its host asked for and reached, a process with its connections on the wire.

Observations have id, host, kind, ts, quality and, where they know them, process, domain, source_ip and destination_ip. Rows without a time or a host
correlate with nothing. All joins are on keys with a time bucket among them, so that a busy host is spread over its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, joins

#: Kinds of observations of names, of connections and of packets; ranks of qualities, the worst last.
NAMES, CONNECTION, WIRE = ("dns_message", "tls_handshake", "http_message"), "network_connection", ("network_socket", "network_flow")
QUALITIES = ("Complete", "Partial", "Degraded", "Unknown")


def is_powershell(*names: Column) -> Column:
    """Whether any of the names of a process is PowerShell's."""
    out = F.lit(False)
    for n in names:
        low = F.lower(n)
        out = out | F.coalesce(low.contains("powershell") | low.contains("pwsh"), F.lit(False))
    return out


def is_network_domain(kind: Column, domain: Column) -> Column:
    return kind.isin(*NAMES) & domain.isNotNull()


def shares_endpoint(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two connections have an address in common; null addresses are none."""
    return F.coalesce(F.arrays_overlap(F.array_compact(F.array(*a)), F.array_compact(F.array(*b))), F.lit(False))


def rank_of_quality(quality: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, QUALITIES)), quality)


def worst_quality(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, QUALITIES)), rank.cast("int"))


def hosts_by_ip(observations: DataFrame) -> DataFrame:
    """ip and host: that of the last connection, in the order of ids, that has the address at either end."""
    own = observations.where((F.col("kind") == CONNECTION) & F.col("host").isNotNull())
    ends = own.select("id", "host", F.explode(F.array_compact(F.array("source_ip", "destination_ip"))).alias("ip"))
    return ends.groupBy("ip").agg(F.max_by("host", "id").alias("host"))


def attributed(observations: DataFrame) -> DataFrame:
    """observations with the host of their source, or else of their destination, where they have none themselves."""
    # both ends look it up: it is written once
    known = graph.kept(hosts_by_ip(observations))
    out = observations.join(joins.small(known.toDF("source_ip", "_s")), "source_ip", "left").join(joins.small(known.toDF("destination_ip", "_d")), "destination_ip", "left")
    return out.withColumn("host", F.coalesce("host", "_s", "_d")).select(*observations.columns)


def domains_of_processes(observations: DataFrame, window: int) -> DataFrame:
    """A row for each host and domain that PowerShell's host looked up and reached by TLS, both within window seconds of the process.

    Of the lookups and handshakes near a process the first by id counts, of several such processes the last.
    """
    own = observations.where("host IS NOT NULL AND ts IS NOT NULL")
    process = own.where((F.col("kind") == "process_create") & is_powershell(F.col("process"))).select("host", F.col("id").alias("process_id"), F.col("ts").alias("at"), F.col("quality").alias("q0"))
    names = own.where(is_network_domain(F.col("kind"), F.col("domain"))).select("host", "domain", "kind", "id", F.col("ts").alias("other"), "quality")
    met = joins.interval_join(process, names, ["host"], "at", "other", window)
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("id", "quality")))
    both = met.groupBy("host", "domain", "process_id", "q0").agg(first("dns_message").alias("d"), first("tls_handshake").alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    rank = F.greatest(*(rank_of_quality(F.col(c)) for c in ("q0", "d.quality", "t.quality")))
    last = both.groupBy("host", "domain").agg(F.max(F.struct("process_id", F.col("d.id").alias("dns_id"), F.col("t.id").alias("tls_id"), rank.alias("rank"))).alias("r"))
    return last.select("host", "domain", "r.process_id", "r.dns_id", "r.tls_id", worst_quality(F.col("r.rank")).alias("quality"))


def connections_on_the_wire(observations: DataFrame, window: int) -> DataFrame:
    """A row for each process of PowerShell and connection of its host by PowerShell within window seconds, with the first packet or flow by id, at most as far from
    the process, that has an address of the connection at either end."""
    own = observations.where("ts IS NOT NULL")
    process = own.where((F.col("kind") == "process_create") & is_powershell(F.col("process"))).select("host", F.col("id").alias("process_id"), F.col("ts").alias("at"))
    made = own.where((F.col("kind") == CONNECTION) & is_powershell(F.col("process"))).select("host", F.col("id").alias("connection_id"), F.col("ts").alias("other"), "source_ip", "destination_ip")
    pairs = joins.interval_join(process.where("host IS NOT NULL"), made, ["host"], "at", "other", window).select("process_id", "connection_id", "at", "source_ip", "destination_ip")
    ends = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.array_compact(F.array("source_ip", "destination_ip")))).alias("ip"))
    wire = ends(own.where(F.col("kind").isin(*WIRE)).withColumnRenamed("id", "packet_id").withColumnRenamed("ts", "seen"), "packet_id", "seen")
    met = joins.interval_join(ends(pairs, "process_id", "connection_id", "at"), wire, ["ip"], "at", "seen", window)
    return met.groupBy("process_id", "connection_id").agg(F.min("packet_id").alias("packet_id"))
