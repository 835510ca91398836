"""Timelines, views of graphs, candidates of a taxonomy, scores and reports of an investigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shapes and colours of nodes, techniques by the words of a command (with their tactic, and how sure they are with two pieces of evidence and with one),
#: systems and devices by open ports, layers of the pyramid of pain, states of ports.
SHAPES = {"Host": ("Circle", "#58a6ff"), "Process": ("Hexagon", "#2ea043"), "NetworkSocket": ("Diamond", "#bc8cff"), "Identity": ("Square", "#39c5bb")}
PLAIN_SHAPE = ("Octagon", "#f85149")
TECHNIQUES = (("T1059.001", "Execution", ("powershell",), 0.95, 0.70), ("T1033", "Discovery", ("whoami", "net user"), 0.90, 0.65))
MAPPING_RULES = "v1.0.0"
SYSTEMS = (
    ((135, 445, 3389), "Windows 11 Enterprise / Windows Server", "Workstation / Server"),
    ((22,), "Linux Kernel 6.x (x86_64)", "Linux Server"),
    ((80, 443), "Web Appliance / Embedded OS", "Network Device / Web Server"),
)
OTHER_SYSTEM = ("Generic Network Host", "Network Endpoint")
STATES = {"open": ("Open",), "closed": ("Closed",), "filtered": ("Filtered", "OpenFiltered"), "timeout": ("Timeout",), "error": ("Unreachable", "Unknown")}
UNNAMED_SERVICE = "TCP-Service"
HIGH = ("High", "Critical")
PYRAMID = ("HashValues", "IpAddresses", "DomainNames", "NetworkArtifacts", "HostArtifacts", "Tools", "TTPs")
STEP, LEVEL = 120, 100


def first_of(data: Column, names: tuple[str, ...]) -> Column:
    """The first of these members of a JSON object that is a text; numbers and others don't count."""
    whole = F.try_parse_json(data)
    found = [F.when(F.schema_of_variant(F.try_variant_get(whole, f"$.{n}", "variant")) == "STRING", F.try_variant_get(whole, f"$.{n}", "string")) for n in names]
    return F.coalesce(*found)


def text_members(data: Column, names: tuple[str, ...]) -> Column:
    """As first_of, an array of those that are texts."""
    whole = F.try_parse_json(data)
    return F.array_compact(F.array(*(F.when(F.schema_of_variant(F.try_variant_get(whole, f"$.{n}", "variant")) == "STRING", F.try_variant_get(whole, f"$.{n}", "string")) for n in names)))


def entries(facts: DataFrame) -> DataFrame:
    """Facts (id, fact_type, entity_key, lane, at) as entries of a timeline: a lane, General if they have none, and a label."""
    return facts.select("id", "at", F.coalesce("lane", F.lit("General")).alias("lane"), F.concat_ws(": ", "fact_type", "entity_key").alias("label"))


def timeline_order(at: str, artifact: str, id_: str) -> list[Column]:
    """Rows without a time last, of equal times those without an artifact first."""
    return [F.asc_nulls_last(at), F.asc_nulls_first(artifact), F.asc(id_)]


def graph_of_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of facts (id, entity_type, entity_key, host, at, label).

    A node is an entity with the label of its first fact, and when it was seen first and last. A host that facts name and that is no entity itself
    becomes a node labelled Host:<key>. Each entity that isn't a host has an edge from its host.
    """
    own = facts.groupBy("entity_type", "entity_key").agg(F.min_by("label", F.struct("at", "id")).alias("label"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    there = own.where("entity_type = 'Host'").select(F.col("entity_key").alias("host"))
    missing = facts.where("host IS NOT NULL").groupBy("host").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen")).join(there, "host", "left_anti")
    made = missing.select(F.lit("Host").alias("entity_type"), F.col("host").alias("entity_key"), F.concat(F.lit("Host:"), "host").alias("label"), "first_seen", "last_seen")
    edges = facts.where("host IS NOT NULL AND entity_type <> 'Host'").select(F.col("host").alias("src"), F.col("entity_type").alias("dst_type"), F.col("entity_key").alias("dst")).distinct()
    return own.unionByName(made), edges


def diagram(nodes: DataFrame, across: list[str]) -> DataFrame:
    """Nodes with a shape and colour by type, and a place: STEP apart in the order of across, all at one level. For the nodes of one view, which are few."""
    shape, colour = F.lit(PLAIN_SHAPE[0]), F.lit(PLAIN_SHAPE[1])
    for name, (s, c) in SHAPES.items():
        shape, colour = F.when(F.col("entity_type") == name, s).otherwise(shape), F.when(F.col("entity_type") == name, c).otherwise(colour)
    x = (F.row_number().over(Window.partitionBy("view").orderBy(*across)) - 1) * STEP
    return nodes.withColumn("shape", shape).withColumn("colour", colour).withColumn("x", x).withColumn("y", F.lit(LEVEL))


def taxonomy(facts: DataFrame) -> DataFrame:
    """facts (command_line, evidence, an array of ids) with a candidate for each technique whose words the command has, in the case it has.

    Two pieces of evidence corroborate one; the first is the one it rests on.
    """
    two = F.size(F.coalesce("evidence", F.array().cast("array<string>"))) >= 2
    found = []
    for technique, tactic, words, sure, less in TECHNIQUES:
        says = F.lit(False)
        for word in words:
            says = says | F.contains(F.col("command_line"), F.lit(word))
        found.append(F.when(says, F.struct(F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic"), F.when(two, sure).otherwise(less).alias("confidence"))))
    own = facts.withColumn("_t", F.explode(F.array_compact(F.array(*found))))
    return own.select(*facts.columns, "_t.*", F.when(two, "Corroborated").otherwise("Candidate").alias("state"), F.get("evidence", F.lit(0)).alias("evidence_id"), F.lit(MAPPING_RULES).alias("rules"))


def pyramid(facts: DataFrame, key: str) -> DataFrame:
    """How many facts of each key lie on each layer of the pyramid."""
    return facts.groupBy(key).agg(*(F.count_if(F.col("pain") == p).alias(p) for p in PYRAMID))


def system_behind(ports: Column) -> Column:
    """The operating system and device that a set of open ports tells of."""
    pair = lambda system, device: F.struct(F.lit(system).alias("system"), F.lit(device).alias("device"))
    out = pair(*OTHER_SYSTEM)
    for some, system, device in reversed(SYSTEMS):
        out = F.when(F.arrays_overlap(ports, F.array(*map(F.lit, some))), pair(system, device)).otherwise(out)
    return out


def coverage(ports: DataFrame, key: str, errors: DataFrame | None = None, nmap: bool = False) -> DataFrame:
    """For each key, ports (state, service) attempted and by state, services with and without a name, and how good the scan is.

    Partial with errors (rows of key) or ports that can't be reached, degraded where more than half of the ports timed out, else full.
    """
    is_open = F.col("state") == "Open"
    named = is_open & (F.coalesce("service", F.lit("")) != "") & (F.col("service") != UNNAMED_SERVICE)
    counts = [F.count_if(F.col("state").isin(*states)).alias(name) for name, states in STATES.items()]
    own = ports.groupBy(key).agg(F.count("*").alias("attempted"), *counts, F.count_if(named).alias("identified"), F.count_if(is_open & ~F.coalesce(named, F.lit(False))).alias("unidentified"))
    if errors is None:
        own = own.withColumn("errors", F.lit(0).cast("long"))
    else:
        own = own.join(errors.groupBy(key).agg(F.count("*").alias("errors")), key, "full")
        own = own.select(key, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in own.columns if c != key))
    bad, late = (F.col("errors") > 0) | (F.col("error") > 0), F.col("timeout") > F.floor(F.col("attempted") / 2)
    return own.withColumn("quality", F.when(bad, "Partial").when(late, "Degraded").otherwise("Full")).withColumn("confidence", F.lit(0.95 if nmap else 0.85))


def recommendations(facts: DataFrame) -> DataFrame:
    """A line for each fact of high or critical severity: whose asset to isolate, and why. One row a fact, in the order that the reader gives them."""
    why = F.concat(F.lit("Isolate asset '"), "entity_key", F.lit("' exhibiting high risk indicator '"), "fact_type", F.lit("'"))
    return facts.where(F.col("severity").isin(*HIGH)).withColumn("recommendation", why)


def incident(facts: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One row for each key of the facts: how many facts, nodes and edges there are, and how many recommendations."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    own = facts.groupBy(key).agg(F.count("*").alias("facts"), F.count_if(F.col("severity").isin(*HIGH)).alias("recommendations"))
    out = own.join(count(nodes, "nodes"), key, "left").join(count(edges, "edges"), key, "left")
    return out.select(key, "facts", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("nodes", "edges")), "recommendations")


def snapshot(nodes: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The nodes of a view: of each type the first so many, flagged ones before others and then by id. A cap is what the view shows, not what is stored."""
    by = Window.partitionBy("entity_type").orderBy(F.desc("flagged"), "id")
    most = F.lit(0)
    for name, n in caps.items():
        most = F.when(F.col("entity_type") == name, n).otherwise(most)
    return nodes.withColumn("place", F.row_number().over(by)).where(F.col("place") <= max(caps.values())).where(F.col("place") <= most)
