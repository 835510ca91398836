"""Queries of scans of packages, dependencies, products and builds, over parts as packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions import versions as V
from ..operators import scans, windows
from .catalog import QUERIES, ORACLE_SQL, RANGES_SQL, _packages, _ranges, query

HITS = f"""SELECT p_partkey AS host, p_brand AS name, version, id, fixed AS fix, CASE id WHEN 'A' THEN 9.8 WHEN 'B' THEN 5.0 END AS cvss, id = 'A' AS kev, CASE id WHEN 'B' THEN CAST(0.25 AS FLOAT) END AS epss
FROM (SELECT p_partkey, p_brand, p_size || '.' || (p_partkey % 12) AS version, p_size * 100 + p_partkey % 12 AS n FROM part) JOIN {RANGES_SQL} ON n >= lo AND n < hi AND n <= upto"""
FOUND = f"SELECT *, CASE WHEN cvss >= 9 THEN 'Critical' WHEN cvss >= 4 THEN 'Medium' ELSE 'Unknown' END AS severity FROM ({HITS})"


def found(t, ecosystem="Debian:12"):
    spark = t("part").sparkSession
    aliases = F.when(F.col("id") == "A", F.array(F.lit("CVE-1"))).otherwise(F.array().cast("array<string>"))
    ratings = spark.createDataFrame([("CVE-1", 9.8), ("B", 5.0), ("X", 1.0)], "id string, cvss double")
    kev, epss = spark.createDataFrame([("A",), ("A",)], "id string"), spark.createDataFrame([("DEBIAN-B", 0.25)], "id string, epss float")
    return scans.packages(_packages(t).withColumnRenamed("p_partkey", "host"), _ranges(t).withColumn("aliases", aliases), ratings, kev, epss, ecosystem)


@query(FOUND)
def package_scan(t):
    return found(t)


@query(f"""SELECT p_partkey AS host, count(id) AS findings, count(*) FILTER (severity = 'Critical') AS critical, CAST(0 AS BIGINT) AS high, count(*) FILTER (severity = 'Medium') AS medium, CAST(0 AS BIGINT) AS low, count(*) FILTER (kev) AS exploited, count(*) FILTER (id IS NOT NULL AND fix IS NULL) AS unfixed,
  max(cvss) AS top, CASE WHEN count(id) > 0 THEN 'VULNERABLE' ELSE 'NO_KNOWN_FINDINGS' END AS status FROM part LEFT JOIN ({FOUND}) f ON f.host = p_partkey GROUP BY 1""")
def host_scan_envelope(t):
    return scans.envelope(found(t), t("part").select(F.col("p_partkey").alias("host")), F.lit(True))


@query(f"""SELECT host, id, CAST(row_number() OVER (PARTITION BY host ORDER BY kev DESC, severity = 'Critical' DESC, severity = 'Medium' DESC, coalesce(cvss, -1) DESC, coalesce(epss, -1) DESC, name, id) AS INT) AS place FROM ({FOUND})""")
def scan_order(t):
    from ..operators.vulnerabilities import order

    return windows.first_k(found(t), ["host"], order(), 1 << 30).select("host", "id", F.col("rank").alias("place"))


@query(f"""SELECT host, CASE WHEN id = 'C' THEN 'MAL-C' ELSE id END AS id, CAST(row_number() OVER (PARTITION BY host ORDER BY id = 'C' DESC, kev DESC, coalesce(cvss, -1) DESC, id) AS INT) AS place FROM ({FOUND})""")
def dependency_scan_order(t):
    own = found(t, "PyPI").withColumn("id", F.when(F.col("id") == "C", "MAL-C").otherwise(F.col("id")))
    return windows.first_k(own, ["host"], scans.dependency_order(), 1 << 30).select("host", "id", F.col("rank").alias("place"))


DEPENDENCIES = "SELECT CASE l_linenumber % 2 WHEN 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem, 'p' || l_partkey AS name, CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS version, CASE WHEN l_returnflag = 'N' THEN 'lockfile' ELSE 'manifest' END AS kind, 'f' || l_linenumber AS file, l_orderkey AS line FROM lineitem"


def dependencies(t):
    return t("lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "npm").otherwise("PyPI").alias("ecosystem"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey").cast("string")).alias("version"),
        F.when(F.col("l_returnflag") == "N", "lockfile").otherwise("manifest").alias("kind"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("file"), F.col("l_orderkey").alias("line"),
    )


@query(f"""SELECT ecosystem, name, version, CAST(count(*) AS INT) AS n, string_agg(file || ':' || line, ',' ORDER BY r, file, line) AS places FROM (SELECT DISTINCT ecosystem, name, version, CASE WHEN kind = 'lockfile' THEN 1 ELSE 0 END AS r, file, line FROM ({DEPENDENCIES}) WHERE version IS NOT NULL) GROUP BY 1, 2, 3""")
def grouped_dependencies(t):
    return scans.grouped_dependencies(dependencies(t))


@query(f"WITH d AS ({DEPENDENCIES}) SELECT DISTINCT ecosystem, name FROM d WHERE version IS NULL AND NOT EXISTS (SELECT 1 FROM d p WHERE p.version IS NOT NULL AND p.ecosystem = d.ecosystem AND p.name = d.name)")
def unpinned_dependencies(t):
    return scans.unpinned(dependencies(t))


BUILDS = "SELECT c_custkey AS host, 'w' || c_custkey % 3 AS product, 19040 + c_custkey % 4 AS branch, c_custkey % 500 AS ubr, ['KB' || c_custkey % 10, 'KB' || c_nationkey] AS kbs FROM customer"
FIXES = "SELECT 'CVE-' || p_partkey % 40 AS cve, 'w' || p_partkey % 3 AS product, 19040 + p_partkey % 5 AS branch, p_size * 8 AS ubr, 'KB' || (p_partkey + 20) AS kb, ['KB' || p_partkey % 60] AS superseding FROM part WHERE p_partkey <= 60"


@query(f"""SELECT host, cve, CASE WHEN bool_or((f.branch = b.branch AND b.ubr >= f.ubr) OR list_contains(kbs, kb) OR list_has_any(kbs, superseding)) THEN 'Patched' WHEN bool_or(f.branch = b.branch) THEN 'Vulnerable' ELSE 'Unverified' END AS state,
  CAST(min(f.ubr) FILTER (f.branch = b.branch) AS VARCHAR) AS first_fix FROM ({BUILDS}) b JOIN ({FIXES}) f USING (product) GROUP BY 1, 2""")
def windows_build_states(t):
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    key, part = F.col("c_custkey"), F.col("p_partkey")
    hosts = t("customer").select(key.alias("host"), text("w", key % 3).alias("product"), (key % 4 + 19040).alias("branch"), (key % 500).alias("ubr"), F.array(text("KB", key % 10), text("KB", F.col("c_nationkey"))).alias("kbs"))
    fixes = t("part").where("p_partkey <= 60").select(text("CVE-", part % 40).alias("cve"), text("w", part % 3).alias("product"), (part % 5 + 19040).alias("branch"), (F.col("p_size") * 8).alias("ubr"), text("KB", part + 20).alias("kb"), F.array(text("KB", part % 60)).alias("superseding"))
    return scans.windows_builds(hosts, fixes).withColumn("first_fix", F.col("first_fix").cast("string"))


LADDER = """WITH x AS (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem),
y AS (SELECT p_partkey, s_suppkey, ['Windows', 'Debian', 'RedHat', 'npm'][p_size % 4 + 1] AS eco, p_name AS name, p_size AS minor, CASE WHEN p_size % 4 = 3 AND p_size % 5 = 0 THEN 'abc' ELSE '1.' || p_size || '.0' END AS version, CAST(floor(p_retailprice) AS BIGINT) AS ubr,
  'CVE-' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'GHSA-' || s_suppkey WHEN 1 THEN 'kb' || s_nationkey END AS alias, ['Debian', 'RedHat', 'npm', 'Windows'][s_suppkey % 4 + 1] AS range_eco, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 50 END AS f1, ['COLD WIDGET', 'Small Widget', 'large bolt'][s_suppkey % 3 + 1] AS package2, s_suppkey % 40 AS f2,
  s_suppkey % 2 = 0 AS has_cpe, CASE WHEN s_suppkey % 5 = 0 THEN 'KB' || s_nationkey END AS required, 'KB' || s_suppkey % 50 AS superseding, CASE WHEN s_suppkey % 5 = 1 THEN 900 + s_suppkey % 100 END AS fixed_ubr
  FROM x JOIN part USING (p_partkey) JOIN supplier USING (s_suppkey)),
z AS (SELECT *, CASE WHEN eco = 'Windows' AND required IS NOT NULL THEN 'kb' WHEN eco = 'Windows' AND fixed_ubr IS NOT NULL THEN 'ubr' WHEN eco = 'Windows' AND alias LIKE 'kb%' THEN 'alias' WHEN eco = range_eco AND contains(name, 'widget') THEN 'vendor' WHEN lower(package2) = name THEN 'named' WHEN has_cpe THEN 'cpe' ELSE 'alone' END AS how,
  required = 'KB' || minor OR superseding = 'KB' || minor AS by_kb, upper(alias) = 'KB' || minor AS by_alias FROM y),
v AS (SELECT *, CASE how WHEN 'vendor' THEN f1 WHEN 'named' THEN f2 END AS f FROM z)
SELECT p_partkey, s_suppkey,
  CASE how WHEN 'kb' THEN CASE WHEN by_kb THEN 'Fixed' ELSE 'Affected' END WHEN 'ubr' THEN CASE WHEN ubr >= fixed_ubr THEN 'Fixed' ELSE 'Affected' END WHEN 'alias' THEN CASE WHEN by_alias THEN 'Fixed' ELSE 'Affected' END
    WHEN 'cpe' THEN 'Candidate' WHEN 'alone' THEN 'Candidate' ELSE CASE WHEN f IS NULL THEN 'Affected' WHEN version = 'abc' THEN 'Unknown' WHEN minor >= f THEN 'Fixed' ELSE 'Affected' END END AS status,
  CASE how WHEN 'kb' THEN 'Required security update ' || required || CASE WHEN by_kb THEN ' (or superseding KB) is installed' ELSE ' is NOT installed' END WHEN 'ubr' THEN 'OS UBR ' || ubr || CASE WHEN ubr >= fixed_ubr THEN ' >= ' ELSE ' < ' END || 'required fixed UBR ' || fixed_ubr
    WHEN 'alias' THEN 'Required security update ' || alias || CASE WHEN by_alias THEN ' is installed' ELSE ' is NOT installed' END WHEN 'cpe' THEN 'NVD CPE match found for ''' || name || ''', exact backport status requires vendor advisory check'
    WHEN 'alone' THEN 'Matched candidate product name, version applicability unresolved'
    WHEN 'vendor' THEN CASE WHEN f IS NULL THEN 'Vendor advisory notes package is affected with no fix recorded' WHEN version = 'abc' THEN 'Failed to parse version: abc' WHEN minor >= f THEN 'Vendor security fix present: current ' || version || ' >= fixed 1.' || f || '.0' ELSE 'Vulnerable vendor package: current ' || version || ' < fixed 1.' || f || '.0' END
    ELSE CASE WHEN version = 'abc' THEN 'Cannot parse SemVer abc' WHEN minor >= f THEN 'Package fix present: current ' || version || ' >= fixed 1.' || f || '.0' ELSE 'Vulnerable package: current ' || version || ' < fixed 1.' || f || '.0' END END AS reason,
  CAST(CASE how WHEN 'kb' THEN 0.96 WHEN 'ubr' THEN 0.94 WHEN 'alias' THEN 0.92 WHEN 'cpe' THEN 0.6 WHEN 'alone' THEN 0.3 WHEN 'vendor' THEN CASE WHEN f IS NULL THEN 0.85 WHEN version = 'abc' THEN 0.4 WHEN minor >= f THEN 0.98 ELSE 0.95 END ELSE CASE WHEN version = 'abc' THEN 0.4 WHEN minor >= f THEN 0.92 ELSE 0.88 END END AS DOUBLE) AS confidence,
  CAST(CASE how WHEN 'vendor' THEN 100 WHEN 'named' THEN 70 WHEN 'cpe' THEN 40 WHEN 'alone' THEN 10 ELSE 90 END AS INT) AS rank, CASE how WHEN 'ubr' THEN '19045.' || ubr ELSE version END AS matched_version,
  CASE how WHEN 'kb' THEN required WHEN 'alias' THEN alias WHEN 'ubr' THEN CAST(fixed_ubr AS VARCHAR) ELSE CASE WHEN f IS NOT NULL THEN '1.' || f || '.0' END END AS fixed_version, CASE how WHEN 'kb' THEN required WHEN 'alias' THEN alias WHEN 'vendor' THEN coalesce(alias, id) END AS advisory FROM v"""


@query(LADDER)
def applicability_ladder(t):
    text = lambda head, c, tail="": F.concat(F.lit(head), c.cast("string"), F.lit(tail))
    one_of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    size, s = F.col("p_size"), F.col("s_suppkey")
    products = t("part").select(
        "p_partkey", one_of(("Windows", "Debian", "RedHat", "npm"), size % 4).alias("ecosystem"), F.col("p_name").alias("name"), F.when((size % 4 == 3) & (size % 5 == 0), "abc").otherwise(text("1.", size, ".0")).alias("version"),
        F.lit(19045).alias("build"), F.floor("p_retailprice").alias("ubr"), F.array(text("KB", size)).alias("kbs"),
    )
    alias = F.when(s % 3 == 0, text("GHSA-", s)).when(s % 3 == 1, text("kb", F.col("s_nationkey")))
    range_ = lambda ecosystem, package, fixed: F.struct(ecosystem.alias("ecosystem"), package.alias("package"), fixed.alias("fixed"))
    vendor = range_(one_of(("Debian", "RedHat", "npm", "Windows"), s % 4), F.lit("widget"), F.when(s % 6 > 0, text("1.", s % 50, ".0")))
    named = range_(F.lit("Other"), one_of(("COLD WIDGET", "Small Widget", "large bolt"), s % 3), text("1.", s % 40, ".0"))
    fix = F.struct(F.when(s % 5 == 0, text("KB", F.col("s_nationkey"))).alias("required_kb"), F.array(text("KB", s % 50)).alias("superseding_kbs"), F.when(s % 5 == 1, 19045).alias("target_build"), F.when(s % 5 == 1, s % 100 + 900).alias("fixed_ubr"))
    found = t("supplier").select("s_suppkey", text("CVE-", s).alias("id"), F.array_compact(F.array(alias)).alias("aliases"), F.array(vendor, named).alias("ranges"), (s % 2 == 0).alias("has_cpe"), F.when(s % 5 < 2, fix).alias("fix"))
    pairs = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(products, "p_partkey").join(found, "s_suppkey")
    return scans.applicability(pairs).select("p_partkey", "s_suppkey", "status", "reason", "confidence", "rank", "matched_version", "fixed_version", "advisory")


#: Advisories of packages: their ids, severities and fixes follow from the package's number and version.
KNOWN = """SELECT 'CVE-' || k || '-' || s_suppkey AS id, 'p' || p_partkey AS name, CAST(s_suppkey AS VARCHAR) AS version, ['Critical', 'High', 'Medium', 'Low'][(p_partkey + k) % 4 + 1] AS severity, (p_partkey + k) % 11 = 0 AS kev, p_partkey % 13 = 0 AND k = 1 AS malicious,
  CASE WHEN (p_partkey + k) % 6 > 0 THEN CAST(s_suppkey + k AS VARCHAR) END AS fix, k FROM (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem WHERE l_suppkey % 3 > 0 AND l_partkey % 3 = 0) CROSS JOIN range(1, 8) r(k) WHERE k <= p_partkey % 8"""


@query(f"""WITH d AS (SELECT DISTINCT ecosystem, name, version, CASE WHEN kind = 'lockfile' THEN 1 ELSE 0 END AS r, file, line FROM ({DEPENDENCIES}) WHERE version IS NOT NULL),
m AS (SELECT ecosystem, name, version, arg_min(file, (r, file, line)) AS file, arg_min(line, (r, file, line)) AS line, count(*) AS places FROM d GROUP BY 1, 2, 3),
a AS (SELECT * FROM ({KNOWN})), x AS (SELECT m.*, a.id, a.severity, a.kev, a.malicious, a.fix, a.k, (severity = 'Critical', severity = 'High', severity = 'Medium', severity = 'Low') AS s,
  row_number() OVER (PARTITION BY m.ecosystem, m.name, m.version, malicious ORDER BY kev DESC, severity = 'Critical' DESC, severity = 'High' DESC, severity = 'Medium' DESC, id) AS o FROM m JOIN a ON a.name = m.name AND a.version = m.version),
g AS (SELECT ecosystem, name, version, any_value(file) AS file, any_value(line) AS line, any_value(places) AS places, bool_or(malicious) AS bad, count(*) FILTER (NOT malicious) AS n, max(id) FILTER (malicious) AS mal,
  string_agg(id || ' (' || CASE severity WHEN 'Critical' THEN 'критическая' WHEN 'High' THEN 'высокая' WHEN 'Medium' THEN 'средняя' ELSE 'низкая' END || ')', ', ' ORDER BY o) FILTER (NOT malicious AND o <= 5) AS shown, string_agg(id, ', ' ORDER BY o) FILTER (NOT malicious AND kev) AS attacked,
  CASE WHEN count(fix) = count(*) THEN CAST(max(CAST(fix AS BIGINT)) AS VARCHAR) END AS target, CASE WHEN bool_or(malicious OR severity = 'Critical') THEN 'critical' WHEN bool_or(severity = 'High') THEN 'high' WHEN bool_or(severity = 'Medium') THEN 'medium' ELSE 'low' END AS severity FROM x GROUP BY 1, 2, 3)
SELECT ecosystem, name, version, CASE WHEN bad THEN 'malicious-dependency' ELSE 'vulnerable-dependency' END AS rule, severity, file, line, least(50, places - 1) AS others, target AS fixed_version,
  CASE WHEN bad THEN 'Пакет ' || name || ' ' || version || ' (' || ecosystem || ') опубликован злоумышленниками (' || mal || '): sum. Удалите его из проекта и проверьте машины, где он устанавливался: такой пакет мог выполнить свой код при установке.' || CASE WHEN n > 0 THEN ' Кроме того, известных уязвимостей: ' || n || '.' ELSE '' END
  ELSE name || ' ' || version || ' (' || ecosystem || '): известных уязвимостей ' || n || ': ' || shown || CASE WHEN n > 5 THEN ' и ещё ' || (n - 5) ELSE '' END || '.' || CASE WHEN attacked IS NOT NULL THEN ' Используются в реальных атаках (CISA KEV): ' || attacked || '.' ELSE '' END
    || CASE WHEN target IS NOT NULL THEN ' Обновите до ' || target || ' или новее.' ELSE ' Исправленной версии нет хотя бы для одной из них: замените библиотеку или закройте уязвимость по её описанию.' END END AS message FROM g""")
def dependency_findings(t):
    part, supplier, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("k")
    text = lambda head, *c: F.concat(F.lit(head), *(x.cast("string") for x in c))
    pairs = t("lineitem").where("l_suppkey % 3 > 0 AND l_partkey % 3 = 0").select("l_partkey", "l_suppkey").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))).where("k <= l_partkey % 8")
    bad = (part % 13 == 0) & (k == 1)
    known = pairs.select(
        text("CVE-", k, F.lit("-"), supplier).alias("id"), text("p", part).alias("key"), supplier.cast("string").alias("version"), F.element_at(F.array(*map(F.lit, ("Critical", "High", "Medium", "Low"))), ((part + k) % 4).cast("int") + 1).alias("severity"),
        F.lit(None).cast("double").alias("cvss"), ((part + k) % 11 == 0).alias("kev"), bad.alias("malicious"), F.lit("sum.").alias("summary"), F.when((part + k) % 6 > 0, (supplier + k).cast("string")).alias("fix"),
    )
    both = known.withColumn("ecosystem", F.explode(F.array(F.lit("npm"), F.lit("PyPI"))))
    found = scans.dependency_findings(dependencies(t), both, ("npm", "PyPI"))
    return found.select("ecosystem", "name", "version", "rule", "severity", "file", "line", F.size("other_places").cast("long").alias("others"), "fixed_version", "message")


@query(f"""WITH a AS (SELECT p_partkey, count(*) AS candidates, count(*) FILTER (status = 'Affected') AS affected, count(*) FILTER (status = 'Fixed') AS fixed FROM ({LADDER}) GROUP BY 1), b AS (SELECT part.p_partkey, coalesce(candidates, 0) AS candidates, coalesce(affected, 0) AS affected, coalesce(fixed, 0) AS fixed FROM part LEFT JOIN a ON a.p_partkey = part.p_partkey)
SELECT *, CASE WHEN affected > 0 THEN 'VULNERABILITIES_IDENTIFIED: ' || affected || ' affected' WHEN fixed > 0 THEN 'NO_ACTIVE_VULNERABILITIES: ' || fixed || ' patched/backported' ELSE 'NO_KNOWN_MATCHED_VULNERABILITIES' END AS message FROM b""")
def product_evaluations(t):
    return scans.evaluated(t("part"), applicability_ladder(t), "p_partkey")


@query("""WITH r AS (SELECT 'L-' || n_nationkey AS id, ['widget', 'cold', 'bolt', 'large bolt', 'GEAR'][n_nationkey % 5 + 1] AS pattern, ['1.' || n_nationkey, '.' || n_regionkey || '.'] AS versions FROM nation), p AS (SELECT DISTINCT upper(p_name) AS product, '1.' || p_size || '.' || p_partkey % 7 AS version FROM part)
SELECT DISTINCT product, version, id FROM p JOIN r ON contains(lower(product), pattern) AND (contains(version, versions[1]) OR contains(version, versions[2]))""")
def legacy_matches(t):
    nation = F.col("n_nationkey")
    versions = F.array(F.concat(F.lit("1."), nation.cast("string")), F.concat(F.lit("."), F.col("n_regionkey").cast("string"), F.lit(".")))
    records = t("nation").select(F.concat(F.lit("L-"), nation.cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, ("widget", "cold", "bolt", "large bolt", "GEAR"))), nation % 5 + 1).alias("pattern"), versions.alias("versions"))
    products = t("part").select(F.upper("p_name").alias("product"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string")).alias("version"))
    return scans.legacy_matches(products, records)


INSTALLED = "SELECT c_custkey, c_mktsegment = 'MACHINERY' AS server, [10240, 14393, 19045, 22621, 26100, 20348, 25398, 40000][c_nationkey % 8 + 1] AS build, CASE WHEN c_acctbal > 5000 THEN '27H1' ELSE 'dev' END AS display, CASE WHEN c_custkey % 3 = 0 THEN 'Server Core' ELSE 'Client' END AS kind, ['x86_64', 'aarch64', 'x86', 'mips'][c_custkey % 4 + 1] AS arch FROM customer"


@query(f"""WITH i AS ({INSTALLED}), n AS (SELECT *, CASE build WHEN 26100 THEN '2025' WHEN 25398 THEN '2022, 23H2 Edition' WHEN 20348 THEN '2022' WHEN 14393 THEN '2016' ELSE CASE WHEN server THEN '2028' END END AS s,
  CASE build WHEN 10240 THEN '' WHEN 14393 THEN '1607' WHEN 19045 THEN '22H2' WHEN 22621 THEN '22H2' WHEN 26100 THEN '24H2' ELSE CASE WHEN display = '27H1' THEN display END END AS r, CASE arch WHEN 'x86_64' THEN 'x64-based' WHEN 'aarch64' THEN 'ARM64-based' WHEN 'x86' THEN '32-bit' END AS a FROM i)
SELECT c_custkey, CASE WHEN a IS NULL THEN NULL WHEN server OR kind = 'Server Core' THEN 'Windows Server ' || s || CASE WHEN kind = 'Server Core' OR build = 25398 THEN ' (Server Core installation)' ELSE '' END
  ELSE CASE WHEN build >= 22000 THEN 'Windows 11' ELSE 'Windows 10' END || CASE WHEN r = '' THEN '' ELSE ' Version ' || r END || ' for ' || a || ' Systems' END AS product FROM n""")
def windows_product_names(t):
    one_of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    key = F.col("c_custkey")
    caption = F.when(F.col("c_mktsegment") == "MACHINERY", "Microsoft Windows Server 2028 Standard").otherwise("Microsoft Windows")
    build = one_of((10240, 14393, 19045, 22621, 26100, 20348, 25398, 40000), F.col("c_nationkey") % 8)
    name = text_functions.windows_product(caption, build, F.when(F.col("c_acctbal") > 5000, "27H1").otherwise("dev"), F.when(key % 3 == 0, "Server Core").otherwise("Client"), F.lit(None).cast("int"), one_of(("x86_64", "aarch64", "x86", "mips"), key % 4))
    return t("customer").select("c_custkey", name.alias("product"))


@query("""WITH a AS (SELECT DISTINCT p_partkey AS product_id, 'CVE-' || s_suppkey AS cve FROM part JOIN supplier ON p_size = s_suppkey AND s_suppkey < 20), b AS (SELECT DISTINCT p_partkey AS product_id, 'CVE-' || s_suppkey AS cve FROM part JOIN supplier ON s_nationkey = p_partkey % 25)
SELECT product_id, cve, 'package' AS source FROM a UNION ALL SELECT product_id, cve, 'cpe' FROM b WHERE product_id NOT IN (SELECT product_id FROM a)""")
def package_or_cpe(t):
    products = t("part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("long").alias("package"), (F.col("p_partkey") % 25).cast("int").alias("cpe"))
    cve = F.concat(F.lit("CVE-"), F.col("s_suppkey").cast("string")).alias("cve")
    return scans.by_package_or_cpe(products, t("supplier").where("s_suppkey < 20").select(F.col("s_suppkey").cast("long").alias("package"), cve), t("supplier").select(F.col("s_nationkey").cast("int").alias("cpe"), cve))


def _places(key):
    @query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 12) AS INT) AS place FROM part")
    def order(t):
        from pyspark.sql.window import Window

        return _packages(t).select("p_partkey", F.rank().over(Window.partitionBy("name").orderBy(key(F.col("version")))).alias("place"))


for _name, _key in (("maven", V.maven_key), ("composer", V.composer_key), ("rubygems", V.gem_key), ("nuget", V.nuget_key)):
    _places(_key)
    QUERIES[f"{_name}_order"], ORACLE_SQL[f"{_name}_order"] = QUERIES.pop("order"), ORACLE_SQL.pop("order")
