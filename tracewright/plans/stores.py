"""Queries of a workspace's tables, over orders, lines, parts and customers as its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import joins, stores
from .catalog import query


def text_of(column):
    return column.cast("string")


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 5 AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def children_listed(t):
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return stores.listed(t("customer").where("c_nationkey < 20"), orders, "c_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], 5).select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 UNION ALL SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders WHERE o_custkey = 4 ORDER BY o_orderdate, o_orderkey LIMIT 1)")
def point_lookups(t):
    o = t("orders")
    return o.where("o_orderkey = 7").select("o_orderkey", "o_custkey").union(o.where("o_custkey = 4").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_custkey"))


@query("""SELECT DISTINCT o_orderkey AS artifact_id, l_linenumber * 100000000 + l_orderkey AS record_id FROM orders JOIN lineitem ON o_custkey = l_suppkey OR (l_orderkey = o_orderkey AND l_linenumber % 2 = 0)""")
def custody_records(t):
    artifacts = t("orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("session_id"))
    records = t("lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("artifact_id"), F.col("l_suppkey").alias("session_id"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_orderkey")).alias("record_id"))
    return stores.custody(artifacts, records, "artifact_id")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS a, min(CASE WHEN l_returnflag = 'R' THEN 'flag' || l_linenumber END) AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey AS challenge_id, coalesce(n, 0) AS artifacts, coalesce(a, 0) AS active_jobs, coalesce(n, 0) AS candidates, f AS flag FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def challenge_details(t):
    own = t("lineitem").withColumnRenamed("l_orderkey", "challenge_id")
    jobs = own.select("challenge_id", F.when(F.col("l_linestatus") == "O", "running").otherwise("failed").alias("state"))
    offered = own.select("challenge_id", F.when(F.col("l_returnflag") == "R", "accepted").otherwise("candidate").alias("state"), F.concat(F.lit("flag"), text_of(F.col("l_linenumber"))).alias("value"))
    return stores.challenge_detail(t("orders").select(F.col("o_orderkey").alias("challenge_id")), own.select("challenge_id"), jobs, offered)


@query("""WITH c AS (SELECT p_partkey, ['new', 'in_progress', 'blocked', 'solved', 'archived'][p_partkey % 5 + 1] AS state, CASE WHEN p_size % 3 > 0 THEN ['new', 'in_progress', 'blocked', 'solved', 'archived'][p_size % 5 + 1] END AS wanted FROM part),
f AS (SELECT *, state = wanted OR (state = 'new' AND wanted IN ('in_progress', 'archived')) OR (state = 'in_progress' AND wanted IN ('blocked', 'solved', 'archived')) OR (state = 'blocked' AND wanted IN ('in_progress', 'archived')) OR (state = 'solved' AND wanted IN ('archived', 'in_progress')) OR (state = 'archived' AND wanted = 'in_progress') AS ok FROM c)
SELECT p_partkey, CASE WHEN wanted IS NOT NULL AND ok THEN wanted ELSE state END AS state, CASE WHEN wanted IS NOT NULL THEN CAST(ok AS VARCHAR) END AS changed FROM f""")
def status_updates(t):
    names = F.array(*map(F.lit, policy.CHALLENGE))
    at = lambda c: F.element_at(names, (c % 5).cast("int") + 1)
    table = t("part").select("p_partkey", at(F.col("p_partkey")).alias("state"))
    return stores.with_states(table, t("part").where("p_size % 3 > 0").select("p_partkey", at(F.col("p_size")).alias("state")), "p_partkey", policy.CHALLENGE).withColumn("changed", text_of(F.col("changed")))


JOBS = ("queued", "preparing", "running", "succeeded", "failed", "cancelled")


@query("""SELECT p_partkey, a, b, a = b OR (a = 'queued' AND b IN ('preparing', 'cancelled')) OR (a = 'preparing' AND b IN ('running', 'failed', 'cancelled')) OR (a = 'running' AND b IN ('succeeded', 'failed', 'cancelled')) AS ok
FROM (SELECT p_partkey, ['queued', 'preparing', 'running', 'succeeded', 'failed', 'cancelled'][p_partkey % 6 + 1] AS a, ['queued', 'preparing', 'running', 'succeeded', 'failed', 'cancelled'][p_size % 6 + 1] AS b FROM part)""")
def job_transitions(t):
    names = F.array(*map(F.lit, JOBS))
    own = t("part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 6).cast("int") + 1).alias("a"), F.element_at(names, (F.col("p_size") % 6).cast("int") + 1).alias("b"))
    return own.withColumn("ok", policy.may_follow(policy.JOB, F.col("a"), F.col("b")))


@query("""SELECT l_orderkey AS challenge_id, 'v' || l_suppkey AS value, CAST(min(l_linenumber) AS BIGINT) AS seen, CASE WHEN l_suppkey = l_orderkey % 10 THEN 'accepted' ELSE 'candidate' END AS state FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def flag_candidates(t):
    offered = t("lineitem").select(F.col("l_orderkey").alias("challenge_id"), F.concat(F.lit("  v"), text_of(F.col("l_suppkey")), F.lit(" ")).alias("value"), F.col("l_linenumber").cast("long").alias("at"))
    expected = t("orders").select(F.col("o_orderkey").alias("challenge_id"), F.sha2(F.concat(F.lit("v"), text_of(F.col("o_orderkey") % 10)).cast("binary"), 256).alias("digest"))
    return stores.candidates(offered, expected).withColumnRenamed("at", "seen")


@query("""WITH s AS (SELECT l_orderkey, string_agg('- n' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem GROUP BY 1)
SELECT o_orderkey AS challenge_id, '# order ' || o_orderkey || chr(10) || chr(10) || '## Flags' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '- f' || o_custkey ELSE '- none' END || chr(10) || chr(10) || '## Steps' || chr(10) || coalesce(steps, '- none') || chr(10) AS markdown FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def writeups(t):
    o = t("orders")
    titles = o.select(F.col("o_orderkey").alias("challenge_id"), F.concat(F.lit("order "), text_of(F.col("o_orderkey"))).alias("title"))
    flags = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("challenge_id"), F.concat(F.lit("f"), text_of(F.col("o_custkey"))).alias("value"))
    steps = t("lineitem").select(F.col("l_orderkey").alias("challenge_id"), F.struct("l_linenumber", "l_partkey").alias("step"), F.concat(F.lit("n"), text_of(F.col("l_partkey"))).alias("note"))
    return stores.writeup(titles, flags, steps)


@query("SELECT n_nationkey AS team_id, count(c_custkey) AS members, count(*) FILTER (c_custkey % 3 = 0) AS online FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def team_counts(t):
    users = t("customer").select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("user_id"))
    return stores.teams(t("nation").select(F.col("n_nationkey").alias("team_id")), users, users.select("user_id", (F.col("user_id") % 3 == 0).alias("online")))


def _invitations(t):
    key = F.col("s_suppkey")
    return t("supplier").select(
        text_of(key).alias("code"), F.col("s_nationkey").alias("team_id"), F.when(key % 5 == 0, "revoked").otherwise("pending").alias("state"), F.lit("2024-01-02").cast("timestamp").alias("now"),
        F.when(key % 3 == 0, F.lit("2024-01-01").cast("timestamp")).when(key % 3 == 1, F.lit("2024-02-01").cast("timestamp")).alias("expires"), (key % 4).alias("uses"), F.when(key % 2 == 0, 6).alias("most"),
    )


INVITATIONS = "SELECT CAST(s_suppkey AS VARCHAR) AS code, s_nationkey AS team_id, s_suppkey % 4 AS uses, CASE WHEN s_suppkey % 2 = 0 THEN 6 END AS most, s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 AS ok FROM supplier"


@query(f"SELECT code, ok FROM ({INVITATIONS})")
def invitations_valid(t):
    return _invitations(t).select("code", stores.valid().alias("ok"))


ACCEPTED = f"""WITH i AS ({INVITATIONS}), a AS (SELECT DISTINCT code, team_id, c_custkey AS user_id, coalesce(most, 1000000000) - uses AS free FROM i JOIN customer ON CAST(c_custkey % 40 AS VARCHAR) = code WHERE ok AND NOT (c_nationkey = team_id)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY user_id DESC) AS r FROM a) WHERE r <= free)"""


def _accepted(t):
    users = t("customer").select(text_of(F.col("c_custkey") % 40).alias("code"), F.col("c_custkey").alias("user_id"), (-F.col("c_custkey")).alias("at"))
    return stores.accept(_invitations(t), users, t("customer").select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("user_id")))


@query(f"{ACCEPTED} SELECT i.code, CAST(uses + (SELECT count(*) FROM s WHERE s.code = i.code) AS BIGINT) AS uses FROM i")
def invitations_used(t):
    return _accepted(t)[0].select("code", "uses")


@query(f"{ACCEPTED} SELECT c_nationkey AS team_id, c_custkey AS user_id FROM customer UNION SELECT team_id, user_id FROM s")
def members_accepted(t):
    return _accepted(t)[1]


def _transferred(t):
    members = t("customer").select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("user_id"))
    owners = members.groupBy("team_id").agg(F.min("user_id").alias("_o"))
    roles = members.join(owners, "team_id").select("team_id", "user_id", F.when(F.col("user_id") == F.col("_o"), "owner").otherwise("viewer").alias("role"))
    # in odd teams one who isn't the owner tries
    wishes = members.groupBy("team_id").agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi")).where("lo < hi").select("team_id", F.when(F.col("team_id") % 2 == 0, F.col("lo")).otherwise(F.col("hi")).alias("from_id"), F.when(F.col("team_id") % 2 == 0, F.col("hi")).otherwise(F.col("lo")).alias("to_id"))
    return stores.transfer(roles, wishes)


EXTREMES = "SELECT c_nationkey AS team_id, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1"


@query(f"SELECT c_nationkey AS team_id, c_custkey AS user_id, CASE WHEN c_nationkey % 2 = 0 AND lo < hi THEN CASE c_custkey WHEN lo THEN 'admin' WHEN hi THEN 'owner' ELSE 'viewer' END WHEN c_custkey = lo THEN 'owner' ELSE 'viewer' END AS role FROM customer JOIN ({EXTREMES}) e ON team_id = c_nationkey")
def ownership_members(t):
    return _transferred(t)[0]


@query(f"SELECT team_id, 'ownership ' || lo || ' -> ' || hi AS action FROM ({EXTREMES}) WHERE team_id % 2 = 0 AND lo < hi")
def ownership_audit(t):
    return _transferred(t)[1]


@query("SELECT o_orderkey AS id, 'order' AS kind FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT l_orderkey, 'line' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(t):
    gone = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    a, b = stores.without(t("orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind")), gone, "id", t("lineitem").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind")))
    return a.union(b)


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS id, p_partkey AS ancestor, 0 AS distance FROM part UNION ALL SELECT id, ancestor // 2, distance + 1 FROM r WHERE distance < 4 AND ancestor // 2 > 0 AND ancestor // 2 < ancestor) SELECT id, ancestor, CAST(min(distance) AS INT) AS distance FROM r GROUP BY 1, 2""")
def lineage_chain(t):
    edges = t("part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))
    return stores.lineage(edges, t("part").select(F.col("p_partkey").alias("id")), 4)


@query("SELECT conv_id, turn FROM conversations WHERE turn % 4 = 1 OR contains(coalesce(text, ''), 'the')")
def entity_thread(t):
    messages = t("conversations").select("conv_id", "turn", "text", F.array(F.when(F.col("turn") % 4 == 1, "the").otherwise("x")).alias("refs"))
    return stores.thread(messages, F.lit("the")).select("conv_id", "turn")


@query("SELECT n_name AS feed, count(c_custkey) AS records, date_diff('day', DATE '1998-01-01', DATE '1998-01-01' + CAST(n_nationkey AS INT)) > CASE n_regionkey % 2 WHEN 0 THEN 7 ELSE 14 END AS stale FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey, n_regionkey")
def feed_status(t):
    counts = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("r"))
    own = t("nation").join(counts, "n_nationkey", "left").select(F.col("n_name").alias("feed"), F.coalesce("r", F.lit(0).cast("long")).alias("records"), F.when(F.col("n_regionkey") % 2 == 0, "high_freq").otherwise("standard").alias("kind"), F.lit("1998-01-01").cast("timestamp").alias("imported"), F.col("n_nationkey"))
    return stores.feeds(own.withColumn("imported", F.expr("timestampadd(DAY, -cast(n_nationkey as int), timestamp'1998-01-31')")), F.lit("1998-01-31").cast("timestamp"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN sha256(text) ELSE 'TooLarge' END AS digest, true AS intact FROM documents WHERE text IS NOT NULL")
def capped_digests(t):
    raw = F.col("text").cast("binary")
    return t("documents").where("text IS NOT NULL").select("doc_id", stores.digest_or_too_large(raw, 1000).alias("digest"), (F.sha2(raw, 256) == F.sha2("text", 256)).alias("intact"))


@query("SELECT p_partkey, len(a) AS n, a[1] AS first FROM (SELECT p_partkey, list_filter(string_split(p_type, ' '), lambda x: x <> '') AS a FROM part)")
def decoded_rows(t):
    words = F.filter(F.split("p_type", " "), lambda w: w != "")
    decoded = F.from_json(F.to_json(words), "array<string>")
    return t("part").select("p_partkey", F.size(decoded).cast("long").alias("n"), F.get(decoded, F.lit(0)).alias("first"))


@query("SELECT s_suppkey, s_acctbal + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS score FROM supplier")
def point_updates(t):
    changes = t("supplier").where("s_suppkey % 2 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("score"))
    return joins.merge_fields(t("supplier").select("s_suppkey", F.col("s_acctbal").alias("score")), changes, ["s_suppkey"])


@query("SELECT CASE WHEN p_size <= 10 THEN 'fact:' || p_partkey WHEN p_size <= 20 THEN 'artifact:' || p_brand END AS entity, p_partkey FROM part WHERE p_size <= 20")
def entities_by_type(t):
    p = t("part")
    fact = p.where("p_size <= 10").select(F.concat(F.lit("fact:"), text_of(F.col("p_partkey"))).alias("entity"), "p_partkey")
    return fact.union(p.where("p_size > 10 AND p_size <= 20").select(F.concat(F.lit("artifact:"), "p_brand"), "p_partkey"))


@query("SELECT c_nationkey, CAST(sum(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END) AS BIGINT) AS solved, CAST(sum(c_custkey) AS BIGINT) AS total FROM (SELECT c_nationkey, CAST(c_custkey AS BIGINT) AS c_custkey FROM customer) GROUP BY 1")
def progress_points(t):
    points = F.col("c_custkey").cast("long")
    return t("customer").groupBy("c_nationkey").agg(F.sum(F.when(F.col("c_custkey") % 2 == 0, points).otherwise(0)).alias("solved"), F.sum(points).alias("total"))


@query("""SELECT p_partkey AS id, p_brand AS competition_id, p_name AS name, p_size AS points, p_size % 4 > 0 AS has_target, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, floor(p_retailprice), p_partkey) AS INT) AS place FROM part WHERE p_type = 'PROMO'""")
def challenge_listing(t):
    own = t("part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("competition_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_size").alias("points"), F.lit("new").alias("status"),
        F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("target_host"), F.floor("p_retailprice").alias("created_at"),
    )
    return stores.challenge_listing(own, "PROMO").select("id", "competition_id", "name", "points", "has_target", "place")


@query(f"""WITH s AS (SELECT DISTINCT unnest(list_concat([{', '.join(map(str, policy.STANDARD_PORTS))}], range(1, 1025))) AS p), top AS (SELECT unnest([{', '.join(map(str, policy.STANDARD_PORTS))}]) AS p),
f AS (SELECT p FROM top UNION SELECT p FROM (SELECT p FROM s WHERE p NOT IN (SELECT p FROM top) ORDER BY p LIMIT {policy.STANDARD_SIZE - len(policy.STANDARD_PORTS)}))
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN n IN ({', '.join(map(str, policy.QUICK_PORTS))}) WHEN 'F' THEN n IN (SELECT p FROM f) ELSE n BETWEEN 1 AND 65535 END AS scanned FROM (SELECT *, CAST(floor(o_totalprice / 5) AS BIGINT) % 1100 AS n FROM orders)""")
def ports_of_profiles(t):
    profile = F.when(F.col("o_orderstatus") == "O", "Quick").when(F.col("o_orderstatus") == "F", "Standard").otherwise("Deep")
    # one list a profile, which orders look up
    profiles = t("orders").select("o_orderstatus").distinct().withColumn("port", F.explode(policy.profile_ports(profile)))
    orders = t("orders").withColumn("port", (F.floor(F.col("o_totalprice") / 5) % 1100).cast("int"))
    met = orders.join(profiles.withColumn("hit", F.lit(True)), ["o_orderstatus", "port"], "left")
    return met.select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("scanned"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS title, CASE s_suppkey % 3 WHEN 1 THEN 'unsigned' WHEN 2 THEN 'malformed' END AS issue FROM supplier""")
def scenario_manifests(t):
    way = F.col("s_suppkey") % 3
    members = {"scenario_id": F.col("s_suppkey").cast("string"), "title": F.col("s_name"), "description": F.lit(""), "difficulty": F.when(way < 2, "hard"), "signature": F.when(way != 1, F.sha2("s_name", 256)).otherwise("")}
    text = F.to_json(F.struct(*(c.alias(n) for n, c in members.items())))
    return t("supplier").select("s_suppkey", policy.manifest(text).alias("m")).select("s_suppkey", "m.title", "m.issue")
