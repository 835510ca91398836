"""Queries of lookups by prefix and by parts of texts, of bounded outputs, of components that follow changes, and of libraries in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buffers, graph, needles, scopes
from ..sources import scripts
from .catalog import query


def text(head, *parts):
    return F.concat(F.lit(head), *(p if isinstance(p, str) else p.cast("string") for p in parts))


HEAD, TAIL = 100, 250


@query(f"""WITH c AS (SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY turn))) AS h FROM conversations GROUP BY 1), n AS (SELECT conv_id, h, len(h) // 2 AS n FROM c)
SELECT conv_id, left(h, {2 * HEAD}) AS head, CASE WHEN n > {HEAD} THEN right(h, CAST(2 * least({TAIL}, n - {HEAD}) AS BIGINT)) ELSE '' END AS tail, greatest(0, n - {HEAD + TAIL}) AS dropped_bytes, n AS total_bytes FROM n""")
def output_buffers(t):
    own = buffers.bounded(t("conversations"), "conv_id", "turn", "text", HEAD, TAIL)
    return own.select("conv_id", F.hex("head").alias("head"), F.hex("tail").alias("tail"), "dropped_bytes", "total_bytes")


#: A scope for each supplier, of 16, 20 or 24 bits, and hosts of their own.
SCOPES = """SELECT s_suppkey AS scope, CASE s_suppkey % 4 WHEN 0 THEN '10.' || s_nationkey || '.' || s_suppkey % 256 || '.7/16' WHEN 1 THEN '10.' || s_nationkey || '.' || s_suppkey % 256 || '.7/20' WHEN 2 THEN '10.' || s_nationkey || '.' || s_suppkey % 256 || '.0/24' ELSE 'host-' || s_nationkey END AS pattern,
  s_nationkey AS a, CASE s_suppkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 20 WHEN 2 THEN 24 END AS size, s_suppkey % 256 AS b FROM supplier"""
TARGETS = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'host-' || c_nationkey ELSE '10.' || c_nationkey || '.' || CAST(floor(abs(c_acctbal)) AS BIGINT) % 256 || '.' || c_custkey % 256 END AS target, c_nationkey AS a, CAST(floor(abs(c_acctbal)) AS BIGINT) % 256 AS b, c_custkey % 5 = 0 AS named FROM customer"


@query(f"""WITH s AS ({SCOPES}), t AS ({TARGETS}), m AS (SELECT c_custkey, target, scope, coalesce(size, 0) AS size FROM t JOIN s ON s.a = t.a AND CASE WHEN t.named THEN s.size IS NULL WHEN s.size = 16 THEN true WHEN s.size = 20 THEN s.b // 16 = t.b // 16 WHEN s.size = 24 THEN s.b = t.b ELSE false END)
SELECT c_custkey, target, scope FROM m QUALIFY size = max(size) OVER (PARTITION BY c_custkey)""")
def scope_matches(t):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    head = text("10.", nation, F.lit("."), key % 256)
    pattern = F.when(key % 4 == 0, F.concat(head, F.lit(".7/16"))).when(key % 4 == 1, F.concat(head, F.lit(".7/20"))).when(key % 4 == 2, F.concat(head, F.lit(".0/24"))).otherwise(text("host-", nation))
    c = F.col("c_custkey")
    address = text("10.", F.col("c_nationkey"), F.lit("."), F.floor(F.abs("c_acctbal")) % 256, F.lit("."), c % 256)
    targets = t("customer").select("c_custkey", F.when(c % 5 == 0, text("host-", F.col("c_nationkey"))).otherwise(address).alias("target"))
    return scopes.matches(targets, "target", t("supplier").select(key.alias("scope"), pattern.alias("pattern")), "pattern").select("c_custkey", "target", "scope")


@query(f"""WITH s AS ({SCOPES} WHERE s_suppkey % 4 <> 3), t AS ({TARGETS})
SELECT c_custkey, NOT named AND EXISTS (SELECT 1 FROM s WHERE s.a = t.a AND (s.size = 16 OR (s.size = 20 AND s.b // 16 = t.b // 16) OR (s.size = 24 AND s.b = t.b))) AS in_scope FROM t""")
def addresses_in_scope(t):
    key, c = F.col("s_suppkey"), F.col("c_custkey")
    head = text("10.", F.col("s_nationkey"), F.lit("."), key % 256)
    pattern = F.when(key % 4 == 0, F.concat(head, F.lit(".7/16"))).when(key % 4 == 1, F.concat(head, F.lit(".7/20"))).otherwise(F.concat(head, F.lit(".0/24")))
    address = text("10.", F.col("c_nationkey"), F.lit("."), F.floor(F.abs("c_acctbal")) % 256, F.lit("."), c % 256)
    targets = t("customer").select("c_custkey", F.when(c % 5 == 0, text("host-", F.col("c_nationkey"))).otherwise(address).alias("target"))
    return scopes.in_scope(targets, "target", t("supplier").where("s_suppkey % 4 <> 3").select(pattern.alias("pattern")), "pattern").select("c_custkey", "in_scope")


@query("""WITH n AS (SELECT item_id, lower(substr(text, 11, 24)) AS needle FROM benchmark UNION ALL SELECT 100000 + p_partkey, lower(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey < 20)
SELECT item_id, doc_id FROM n JOIN documents ON needle <> '' AND contains(lower(text), needle)""")
def needles_in_documents(t):
    own = t("benchmark").select("item_id", F.substring("text", 11, 24).alias("needle"))
    own = own.union(t("part").where("p_partkey < 20").select(F.col("p_partkey") + 100000, F.split_part("p_name", F.lit(" "), F.lit(1))))
    return needles.found(own, "item_id", "needle", t("documents"), "doc_id", "text")


LINKS = "SELECT DISTINCT 'o' || o_custkey AS src, 'd' || CAST(floor(o_totalprice / 97) AS BIGINT) AS dst, o_orderstatus AS s FROM orders WHERE o_totalprice > 300000"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({LINKS}) WHERE s IN ('O', 'P') EXCEPT SELECT src, dst FROM ({LINKS}) WHERE s = 'F'), v AS (SELECT DISTINCT unnest([src, dst]) AS id FROM ({LINKS}) WHERE s IN ('O', 'P')),
b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r AS (SELECT id, id AS up FROM v UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.up)
SELECT id, min(up) AS component FROM r GROUP BY 1""")
def components_after_updates(t):
    """Components of some links, after others came and some went."""
    orders = t("orders").where("o_totalprice > 300000")
    links = lambda status: orders.where(F.col("o_orderstatus").isin(*status)).select(text("o", F.col("o_custkey")).alias("src"), text("d", F.floor(F.col("o_totalprice") / 97)).alias("dst")).distinct()
    first = graph.kept(graph.components(links("O")))
    more = graph.kept(graph.with_edges(first, links("P")))
    return graph.without_edges(more, links("OP"), links("F"))


@query("""WITH l AS (SELECT page_id, html, page_id % 4 AS way, CASE page_id % 4 WHEN 0 THEN 'lib' || page_id % 50 WHEN 1 THEN 'lodash' WHEN 2 THEN 'jquery' END AS name, '1.' || page_id % 30 || '.' || page_id % 7 AS v FROM pages)
SELECT page_id, name, v AS version, CAST(len(html) - len(replace(html, chr(10), '')) + 2 AS INT) AS line FROM l WHERE way < 3""")
def linked_libraries(t):
    page = F.col("page_id")
    version = F.concat(F.lit("1."), (page % 30).cast("string"), F.lit("."), (page % 7).cast("string"))
    link = (
        F.when(page % 4 == 0, F.concat(F.lit("https://unpkg.com/"), text("lib", page % 50), F.lit("@"), version, F.lit("/x.js"))).when(page % 4 == 1, F.concat(F.lit("//cdnjs.cloudflare.com/ajax/libs/lodash.js/"), version, F.lit("/lodash.js")))
        .when(page % 4 == 2, F.concat(F.lit("//code.jquery.com/jquery-"), version, F.lit(".min.js"))).otherwise("//unpkg.com/lib@5/x.js")
    )
    files = t("pages").select(page.cast("string").alias("path"), F.concat("html", F.lit("\n<script src='"), link, F.lit("'></script>")).alias("text"))
    return scripts.libraries(files).select(F.col("file").cast("long").alias("page_id"), "name", "version", "line")
