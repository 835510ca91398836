"""Queries of correlations, timelines, graphs and reports, over observations made from events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import correlations, reports, verification, windows
from .catalog import HOUR, query

KINDS = {"view": "process_create", "click": "dns_message", "purchase": "tls_handshake", "error": "network_connection", "signup": "network_socket"}
OBSERVED = f"""SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS host, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts, CASE event_id % 3 WHEN 0 THEN 'C:\\PowerShell.EXE' WHEN 1 THEN 'pwsh' ELSE 'cmd.exe' END AS process, CASE WHEN event_type IN ('click', 'purchase') THEN 'd' || event_id % 4 || '.test' END AS domain,
  '10.0.0.' || user_id % 200 AS source_ip, '10.0.1.' || event_id % 50 AS destination_ip, CASE event_id % 4 WHEN 0 THEN 'Partial' WHEN 1 THEN 'Degraded' ELSE 'Complete' END AS quality FROM events"""


def observed(t):
    at = F.col("event_id")
    kind = F.lit(None).cast("string")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return t("events").select(
        at.alias("id"), F.when(at % 11 != 0, F.col("user_id").cast("string")).alias("host"), kind.alias("kind"), F.when(at % 13 != 0, F.col("ts")).alias("ts"),
        F.when(at % 3 == 0, "C:\\PowerShell.EXE").when(at % 3 == 1, "pwsh").otherwise("cmd.exe").alias("process"), F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("d"), (at % 4).cast("string"), F.lit(".test"))).alias("domain"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string")).alias("source_ip"), F.concat(F.lit("10.0.1."), (at % 50).cast("string")).alias("destination_ip"),
        F.when(at % 4 == 0, "Partial").when(at % 4 == 1, "Degraded").otherwise("Complete").alias("quality"),
    )


SPAN = f"abs(epoch_us({{}}) - epoch_us({{}})) // 1000000 <= {HOUR}"
RANK = "CASE {}.quality WHEN 'Complete' THEN 1 WHEN 'Partial' THEN 2 ELSE 3 END"


@query(f"""
WITH o AS ({OBSERVED}), p AS (SELECT * FROM o WHERE kind = 'process_create' AND id % 3 <> 2),
m AS (SELECT p.host, x.domain, p.id AS process_id, {RANK.format('p')} AS r0, x.kind, x.id, {RANK.format('x')} AS r FROM p JOIN o x ON x.host = p.host AND x.domain IS NOT NULL AND {SPAN.format('p.ts', 'x.ts')}),
d AS (SELECT host, domain, process_id, max(r0) AS r0, min(id) AS dns_id, arg_min(r, id) AS r1 FROM m WHERE kind = 'dns_message' GROUP BY ALL), s AS (SELECT host, domain, process_id, min(id) AS tls_id, arg_min(r, id) AS r2 FROM m WHERE kind = 'tls_handshake' GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY host, domain ORDER BY process_id DESC) AS k FROM d JOIN s USING (host, domain, process_id))
SELECT host, domain, process_id, dns_id, tls_id, CASE greatest(r0, r1, r2) WHEN 1 THEN 'Complete' WHEN 2 THEN 'Partial' ELSE 'Degraded' END AS quality FROM b WHERE k = 1""")
def process_domains(t):
    return correlations.domains_of_processes(observed(t), HOUR)


@query(f"""
WITH o AS ({OBSERVED}), c AS (SELECT p.id AS process_id, x.id AS connection_id, p.ts, x.source_ip, x.destination_ip FROM o p JOIN o x ON x.host = p.host AND p.kind = 'process_create' AND x.kind = 'network_connection' AND p.id % 3 <> 2 AND x.id % 3 <> 2 AND {SPAN.format('p.ts', 'x.ts')})
SELECT process_id, connection_id, min(w.id) AS packet_id FROM c JOIN o w ON w.kind = 'network_socket' AND {SPAN.format('c.ts', 'w.ts')} AND (w.source_ip IN (c.source_ip, c.destination_ip) OR w.destination_ip IN (c.source_ip, c.destination_ip)) GROUP BY 1, 2""")
def process_packets(t):
    return correlations.connections_on_the_wire(observed(t), HOUR)


@query(f"""
WITH o AS ({OBSERVED}), e AS (SELECT id, host, unnest([source_ip, destination_ip]) AS ip FROM o WHERE kind = 'network_connection' AND host IS NOT NULL), h AS (SELECT ip, arg_max(host, id) AS host FROM e GROUP BY 1)
SELECT o.id, coalesce(o.host, s.host, d.host) AS host FROM o LEFT JOIN h s ON o.source_ip = s.ip LEFT JOIN h d ON o.destination_ip = d.ip""")
def attributed_hosts(t):
    return correlations.attributed(observed(t)).select("id", "host")


@query(f"WITH o AS ({OBSERVED}) SELECT id, id % 3 <> 2 AS powershell, kind IN ('dns_message', 'tls_handshake') AND domain IS NOT NULL AS named, source_ip IN ('10.0.0.1', '10.0.1.2') OR destination_ip IN ('10.0.0.1', '10.0.1.2') AS shares FROM o")
def observation_predicates(t):
    o = observed(t)
    shares = correlations.shares_endpoint((F.col("source_ip"), F.col("destination_ip")), (F.lit("10.0.0.1"), F.lit("10.0.1.2")))
    return o.select("id", correlations.is_powershell(F.lit(None).cast("string"), F.col("process")).alias("powershell"), correlations.is_network_domain(F.col("kind"), F.col("domain")).alias("named"), shares.alias("shares"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'n' || event_id WHEN 1 THEN 'x' END AS name, 'u' || user_id || CASE WHEN event_id % 2 = 0 THEN '|' || event_type ELSE '' END AS texts FROM events""")
def first_text_fields(t):
    at = F.col("event_id")
    # numbers and missing members don't count
    name = F.when(at % 3 == 0, F.to_json(F.struct(F.lit(5).alias("process_name"), F.concat(F.lit("n"), at.cast("string")).alias("image")))).when(at % 3 == 1, '{"process_name": "x", "image": "y"}').otherwise('{"image": true}')
    both = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("a"), F.when(at % 2 == 0, F.col("event_type")).alias("b"), F.lit(3).alias("c")))
    return t("events").select("event_id", reports.first_of(name, ("process_name", "image")).alias("name"), F.array_join(reports.text_members(both, ("a", "b", "c")), "|").alias("texts"))


FACTS = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'Process' WHEN 1 THEN 'Host' ELSE 'NetworkSocket' END AS entity_type, CASE event_id % 3 WHEN 1 THEN 'h' || user_id ELSE 'e' || event_id % 97 END AS entity_key, 'h' || (user_id + event_id % 2) AS host, ts AS seen, event_type AS label FROM events WHERE event_type <> 'view'"


def facts_(t):
    at = F.col("event_id")
    return t("events").where("event_type <> 'view'").select(
        at.alias("id"), F.when(at % 3 == 0, "Process").when(at % 3 == 1, "Host").otherwise("NetworkSocket").alias("entity_type"), F.when(at % 3 == 1, F.concat(F.lit("h"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("e"), (at % 97).cast("string"))).alias("entity_key"),
        F.concat(F.lit("h"), (F.col("user_id") + at % 2).cast("string")).alias("host"), F.col("ts").alias("at"), F.col("event_type").alias("label"),
    )


NODES = f"""WITH f AS ({FACTS}), n AS (SELECT entity_type, entity_key, arg_min(label, struct_pack(a := seen, b := id)) AS label, min(seen) AS first_seen, max(seen) AS last_seen FROM f GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT 'Host', host, 'Host:' || host, min(seen), max(seen) FROM f WHERE host NOT IN (SELECT entity_key FROM n WHERE entity_type = 'Host') GROUP BY host"""


@query(NODES)
def fact_graph_nodes(t):
    return reports.graph_of_facts(facts_(t))[0]


@query(f"SELECT DISTINCT host AS src, entity_type AS dst_type, entity_key AS dst FROM ({FACTS}) WHERE entity_type <> 'Host'")
def fact_graph_edges(t):
    return reports.graph_of_facts(facts_(t))[1]


@query(f"""SELECT entity_type, entity_key, CASE entity_type WHEN 'Host' THEN 'Circle' WHEN 'Process' THEN 'Hexagon' WHEN 'NetworkSocket' THEN 'Diamond' ELSE 'Octagon' END AS shape,
  CASE entity_type WHEN 'Host' THEN '#58a6ff' WHEN 'Process' THEN '#2ea043' WHEN 'NetworkSocket' THEN '#bc8cff' ELSE '#f85149' END AS colour, CAST((row_number() OVER (PARTITION BY label ORDER BY entity_type, entity_key) - 1) * 120 AS INT) AS x, CAST(100 AS INT) AS y
FROM (SELECT CASE WHEN entity_key LIKE 'e7%' THEN 'File' ELSE entity_type END AS entity_type, entity_key, label FROM ({NODES}))""")
def diagram_view(t):
    nodes = reports.graph_of_facts(facts_(t))[0].withColumn("view", F.col("label")).withColumn("entity_type", F.when(F.col("entity_key").startswith("e7"), "File").otherwise(F.col("entity_type")))
    return reports.diagram(nodes, ["entity_type", "entity_key"]).select("entity_type", "entity_key", "shape", "colour", "x", "y")


@query("SELECT event_id AS id, ts AS at, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'General' END AS lane, event_type || ': ' || user_id AS label FROM events")
def timeline_entries(t):
    at = F.col("event_id")
    return reports.entries(t("events").select(at.alias("id"), F.col("ts").alias("at"), F.when(at % 2 == 0, F.col("event_type")).alias("lane"), F.col("event_type").alias("fact_type"), F.col("user_id").cast("string").alias("entity_key")))


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seen IS NULL, seen, artifact IS NOT NULL, artifact, event_id) AS INT) AS place FROM
  (SELECT event_id, user_id, CASE WHEN event_id % 5 > 0 THEN date_trunc('day', ts) END AS seen, CASE WHEN event_id % 2 = 0 THEN event_type END AS artifact FROM events)""")
def timeline_order(t):
    own = t("events").select("event_id", "user_id", F.when(F.col("event_id") % 5 > 0, F.date_trunc("day", "ts")).alias("at"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("artifact"))
    return own.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*reports.timeline_order("at", "artifact", "event_id"))).alias("place"))


@query("""SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('error', 'purchase')) WHERE r <= 10""")
def newest_entries(t):
    own = t("events").where(F.col("event_type").isin("error", "purchase"))
    return windows.first_k(own, ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"))


COMMANDS = {"view": "powershell.exe -NoP -c ", "click": "cmd /c net user ", "error": "whoami & powershell ", "signup": "PowerShell "}


@query(f"""WITH f AS (SELECT user_id, event_type, list(CAST(event_id AS VARCHAR) ORDER BY event_id) AS e, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items())} END || user_id AS c FROM events WHERE value > 40 GROUP BY user_id, event_type),
c AS (SELECT *, 'T1059.001' AS technique, 'Execution' AS tactic, 0.95 AS two, 0.70 AS one FROM f WHERE contains(c, 'powershell') UNION ALL SELECT *, 'T1033', 'Discovery', 0.90, 0.65 FROM f WHERE contains(c, 'whoami') OR contains(c, 'net user'))
SELECT user_id, event_type, technique, tactic, CAST(CASE WHEN len(e) >= 2 THEN two ELSE one END AS DOUBLE) AS confidence, CASE WHEN len(e) >= 2 THEN 'Corroborated' ELSE 'Candidate' END AS state, e[1] AS evidence_id, 'v1.0.0' AS rules FROM c""")
def taxonomy_candidates(t):
    command = F.lit(None).cast("string")
    for k, v in COMMANDS.items():
        command = F.when(F.col("event_type") == k, F.concat(F.lit(v), F.col("user_id").cast("string"))).otherwise(command)
    own = t("events").where("value > 40").groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")).alias("evidence"))
    return reports.taxonomy(own.withColumn("command_line", command)).drop("evidence", "command_line")


PAIN = reports.PYRAMID


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_id % 7 = {k}) AS {p}" for k, p in enumerate(PAIN)) + " FROM events GROUP BY 1")
def pyramid_counts(t):
    return reports.pyramid(t("events").select("user_id", F.element_at(F.array(*map(F.lit, PAIN)), (F.col("event_id") % 7).cast("int") + 1).alias("pain")), "user_id")


@query("""SELECT o_custkey, CASE WHEN list_has_any(p, [135, 445, 3389]) THEN 'Windows 11 Enterprise / Windows Server' WHEN list_contains(p, 22) THEN 'Linux Kernel 6.x (x86_64)' WHEN list_has_any(p, [80, 443]) THEN 'Web Appliance / Embedded OS' ELSE 'Generic Network Host' END AS system,
  CASE WHEN list_has_any(p, [135, 445, 3389]) THEN 'Workstation / Server' WHEN list_contains(p, 22) THEN 'Linux Server' WHEN list_has_any(p, [80, 443]) THEN 'Network Device / Web Server' ELSE 'Network Endpoint' END AS device
FROM (SELECT o_custkey, list(DISTINCT [22, 80, 443, 8080, 9000, 445, 3389][1 + CAST(floor(o_totalprice / 1000) AS BIGINT) % 131 % 7]) AS p FROM orders WHERE o_totalprice > 300000 GROUP BY 1)""")
def system_by_ports(t):
    port = F.element_at(F.array(*map(F.lit, (22, 80, 443, 8080, 9000, 445, 3389))), (F.floor(F.col("o_totalprice") / 1000) % 131 % 7).cast("int") + 1)
    own = t("orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.collect_set(port).alias("ports"))
    return own.select("o_custkey", reports.system_behind(F.col("ports")).alias("s")).select("o_custkey", "s.system", "s.device")


STATES_SQL = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'Open' WHEN '2' THEN 'Closed' WHEN '3' THEN CASE o_orderstatus WHEN 'F' THEN 'Filtered' ELSE 'OpenFiltered' END WHEN '4' THEN 'Timeout' ELSE CASE WHEN o_totalprice < 60000 THEN 'Unreachable' ELSE 'Timeout' END END"


@query(f"""WITH p AS (SELECT o_custkey, {STATES_SQL} AS s, CASE o_orderstatus WHEN 'O' THEN 'http' WHEN 'F' THEN 'TCP-Service' END AS v FROM orders WHERE o_totalprice <= 490000), e AS (SELECT o_custkey, count(*) AS errors FROM orders WHERE o_totalprice > 490000 GROUP BY 1),
c AS (SELECT o_custkey, count(*) AS attempted, count(*) FILTER (s = 'Open') AS open, count(*) FILTER (s = 'Closed') AS closed, count(*) FILTER (s IN ('Filtered', 'OpenFiltered')) AS filtered, count(*) FILTER (s = 'Timeout') AS timeout, count(*) FILTER (s = 'Unreachable') AS error,
  count(*) FILTER (s = 'Open' AND v = 'http') AS identified, count(*) FILTER (s = 'Open' AND (v IS NULL OR v <> 'http')) AS unidentified FROM p GROUP BY 1),
b AS (SELECT coalesce(c.o_custkey, e.o_custkey) AS o_custkey, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('attempted', 'open', 'closed', 'filtered', 'timeout', 'error', 'identified', 'unidentified', 'errors'))} FROM c FULL JOIN e ON c.o_custkey = e.o_custkey)
SELECT *, CASE WHEN errors > 0 OR error > 0 THEN 'Partial' WHEN timeout > attempted // 2 THEN 'Degraded' ELSE 'Full' END AS quality, CAST(0.85 AS DOUBLE) AS confidence FROM b""")
def scan_coverage(t):
    kind, filtered = F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderstatus") == "F", "Filtered").otherwise("OpenFiltered")
    last = F.when(F.col("o_totalprice") < 60000, "Unreachable").otherwise("Timeout")
    state = F.when(kind == "1", "Open").when(kind == "2", "Closed").when(kind == "3", filtered).when(kind == "4", "Timeout").otherwise(last)
    service = F.when(F.col("o_orderstatus") == "O", "http").when(F.col("o_orderstatus") == "F", "TCP-Service")
    o = t("orders")
    return reports.coverage(o.where("o_totalprice <= 490000").select("o_custkey", state.alias("state"), service.alias("service")), "o_custkey", o.where("o_totalprice > 490000").select("o_custkey"))


SEVERE = "CASE WHEN value > 90 THEN 'Critical' WHEN value > 60 THEN 'High' ELSE 'Low' END"


def severe(t):
    severity = F.when(F.col("value") > 90, "Critical").when(F.col("value") > 60, "High").otherwise("Low")
    return t("events").select("event_id", "user_id", severity.alias("severity"), F.col("event_type").alias("fact_type"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("entity_key"))


@query(f"""SELECT f.user_id, facts, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, recommendations FROM (SELECT user_id, count(*) AS facts, count(*) FILTER ({SEVERE} <> 'Low') AS recommendations FROM events GROUP BY 1) f
  LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS nodes FROM events GROUP BY 1) n ON n.user_id = f.user_id LEFT JOIN (SELECT user_id, count(*) AS edges FROM events WHERE event_type = 'error' GROUP BY 1) e ON e.user_id = f.user_id""")
def incident_reports(t):
    return reports.incident(severe(t), t("events").select("user_id", "event_type").distinct(), t("events").where("event_type = 'error'"), "user_id")


@query(f"SELECT event_id, 'Isolate asset ''host-' || user_id || chr(39) || ' exhibiting high risk indicator ' || chr(39) || event_type || chr(39) AS recommendation FROM events WHERE {SEVERE} <> 'Low'")
def incident_recommendations(t):
    return reports.recommendations(severe(t)).select("event_id", "recommendation")


#: What each customer's investigation is expected to find, and for which customers.
EXPECTED = (
    ("Asset", "order-1", None, 1), ("Asset", "order-2", None, 1), ("Asset", "order-12", None, 2), ("Fact", "ProcessExecution", None, 1), ("Fact", "LSASS_Dump", None, 3), ("Fact", "discovered", None, 1), ("Fact", "discovered", None, 2),
    ("Technique", "T1003.001", None, 1), ("Technique", "T1059", None, 2), ("Technique", "T1033", None, 1), ("Technique", "schtasks", None, 4), ("Edge", "order-1", "order-2", 1), ("Edge", "order-3", "order-99", 2),
    ("Stage", "Execution", None, 1), ("Stage", "CredentialAccess", None, 2), ("Stage", "Persistence", None, 1), ("Stage", "Exfiltration", None, 3), ("Pyramid", "Tools", None, 1), ("Pyramid", "ttps", None, 2),
)
WORDS = {"1": "PowerShell -enc", "2": "whoami", "3": "procdump LSASS", "4": "schtasks /create", "5": "dir"}
KINDS_OF_FACTS = {"O": "ProcessExecution", "F": "CredentialDump", "P": "HostDiscovered"}
SCENARIO_FACTS = f"""SELECT o_custkey AS scenario, 'order-' || o_orderkey % 7 AS entity_key, CASE o_orderstatus {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS_OF_FACTS.items())} END AS fact_type,
  '{{"command_line":"' || CASE left(o_orderpriority, 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items())} END || '"}}' AS data, o_totalprice > 100000 AS backed, CASE WHEN o_totalprice > 400000 THEN 'Tools' WHEN o_totalprice < 50000 THEN 'TTPs' END AS pain_level FROM orders"""
TRUTH = f"""SELECT c_custkey AS scenario, criterion, thing, other FROM customer JOIN (VALUES {', '.join(f"('{k}', '{x}', {'NULL' if y is None else repr(y)}, {m})" for k, x, y, m in EXPECTED)}) e(criterion, thing, other, m) ON c_custkey % e.m = 0"""


def scenario_facts(t):
    pick = lambda c, names: F.coalesce(*(F.when(c == k, v) for k, v in names.items()))
    data = F.concat(F.lit('{"command_line":"'), pick(F.substring("o_orderpriority", 1, 1), WORDS), F.lit('"}'))
    price = F.col("o_totalprice")
    return t("orders").select(
        F.col("o_custkey").alias("scenario"), F.concat(F.lit("order-"), (F.col("o_orderkey") % 7).cast("string")).alias("entity_key"), pick(F.col("o_orderstatus"), KINDS_OF_FACTS).alias("fact_type"), data.alias("data"),
        F.when(price > 100000, 2).otherwise(0).alias("evidence"), F.lit(0.5).alias("evidence_strength"), F.when(price > 400000, "Tools").when(price < 50000, "TTPs").alias("pain_level"),
    )


def scenario_truth(t):
    things = F.array(*(F.struct(F.lit(k).alias("criterion"), F.lit(x).alias("thing"), F.lit(y).cast("string").alias("other"), F.lit(m).alias("m")) for k, x, y, m in EXPECTED))
    own = t("customer").select(F.col("c_custkey").alias("scenario"), F.explode(things).alias("e")).where("scenario % e.m = 0")
    return own.select("scenario", "e.criterion", "e.thing", "e.other")


SAYS = {
    "Fact": "contains(lower(fact_type), lower(thing)) OR (lower(thing) = 'processexecution' AND (contains(fact_type, 'Execution') OR contains(fact_type, 'Process') OR contains(fact_type, 'Dump'))) OR (lower(thing) = 'lsass_dump' AND (contains(fact_type, 'Credential') OR contains(lower(data), 'lsass')))",
    "Technique": "CASE thing WHEN 'T1003.001' THEN regexp_matches(lower(data), 'lsass|procdump|mimikatz') WHEN 'T1059' THEN regexp_matches(lower(data), 'powershell|-enc') WHEN 'T1033' THEN regexp_matches(lower(data), 'whoami|net user') ELSE contains(lower(data), lower(thing)) END",
    "Stage": """CASE thing WHEN 'Execution' THEN contains(lower(fact_type), 'execution') OR contains(lower(data), 'powershell') WHEN 'CredentialAccess' THEN contains(lower(fact_type), 'credential') OR regexp_matches(lower(data), 'lsass|mimikatz')
      WHEN 'Persistence' THEN contains(lower(fact_type), 'persist') OR contains(lower(data), 'schtasks') ELSE contains(lower(fact_type), lower(thing)) OR contains(lower(data), lower(thing)) END""",
    "Asset": "entity_key = thing", "Pyramid": "lower(pain_level) = lower(thing)",
}
SCORED = f"""WITH f AS ({SCENARIO_FACTS}), t AS (SELECT *, row_number() OVER (ORDER BY scenario, criterion, thing) AS n FROM ({TRUTH})),
h AS (SELECT t.n, CASE any_value(criterion) WHEN 'Edge' THEN bool_or(entity_key = thing) AND bool_or(entity_key = other) ELSE bool_or(CASE criterion {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SAYS.items())} END) END AS hit
  FROM t LEFT JOIN f ON t.scenario = f.scenario GROUP BY t.n),
c AS (SELECT scenario, criterion, count(*) FILTER (coalesce(hit, false)) AS hits, count(*) AS n FROM t JOIN h ON t.n = h.n GROUP BY ALL UNION ALL SELECT scenario, 'Evidence', count(*) FILTER (backed), count(*) FROM f WHERE scenario IN (SELECT scenario FROM t) GROUP BY ALL)
SELECT scenario, CAST(place AS INT) AS place, name, CAST(CASE criterion WHEN 'Evidence' THEN round(hits / n * 20) ELSE hits * points END AS BIGINT) AS points, CAST(CASE criterion WHEN 'Evidence' THEN 20 ELSE n * points END AS BIGINT) AS most, replace(replace(words, '#', CAST(hits AS VARCHAR)), '@', CAST(n AS VARCHAR)) AS explanation
FROM c JOIN (VALUES ('Asset', 1, 'Assets Discovered (Coverage)', 20, 'Discovered #/@ required assets'), ('Fact', 2, 'Fact Detection (Correctness)', 20, 'Identified #/@ expected security facts'), ('Evidence', 3, 'Evidence Quality (Provenance)', 20, '#/@ facts backed by cryptographic evidence provenance'),
  ('Technique', 4, 'ATT&CK Mapping (Accuracy)', 20, 'Mapped #/@ required ATT&CK techniques'), ('Edge', 5, 'Attack Graph (Edge Provenance)', 20, 'Reconstructed #/@ attack graph edges'), ('Stage', 6, 'Kill Chain Progression', 15, 'Traced #/@ Kill Chain attack stages'),
  ('Pyramid', 7, 'Pyramid of Pain (Depth)', 15, 'Attained #/@ required indicator depths')) v(criterion, place, name, points, words) USING (criterion)"""


@query(SCORED)
def scenario_criteria(t):
    return verification.criteria(scenario_truth(t), scenario_facts(t))


@query(f"""WITH s AS ({SCORED}), z AS (SELECT scenario, sum(points) AS p, sum(most) AS m, string_agg('- ' || name || ': +' || points || ' / ' || most || ' pts | ' || explanation || chr(10), '' ORDER BY place) AS lines FROM s GROUP BY 1)
SELECT scenario, 'Scenario: ' || scenario || ' | Total Score: ' || CAST(p AS BIGINT) || '/' || CAST(m AS BIGINT) || ' (' || printf('%.1f', p / m * 100.0) || '%)' || chr(10) || repeat('-', 40) || chr(10) || lines AS summary FROM z""")
def explained_scores(t):
    truth = scenario_truth(t)
    scored = verification.criteria(truth, scenario_facts(t))
    return verification.explained(scored, verification.totals(scored, truth))


@query("""SELECT id, entity_type FROM (SELECT p_partkey AS id, CASE WHEN p_size < 20 THEN 'Process' ELSE 'Host' END AS entity_type, row_number() OVER (PARTITION BY p_size < 20 ORDER BY p_partkey % 5 = 0 DESC, p_partkey) AS r FROM part) WHERE r <= CASE entity_type WHEN 'Process' THEN 30 ELSE 20 END""")
def snapshot_nodes(t):
    nodes = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 20, "Process").otherwise("Host").alias("entity_type"), (F.col("p_partkey") % 5 == 0).alias("flagged"))
    return reports.snapshot(nodes, {"Process": 30, "Host": 20}).select("id", "entity_type")
