"""Queries of records of hosts and feeds, over texts made from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlations
from ..sources import host, manifests, projects
from ..sources import records as R
from .catalog import dealt, query

def text_of(column):
    return column.cast("string")


def _events(t):
    """Events as Windows writes them: by number and channel, data as members or as a list."""
    n = text_of(F.col("event_id"))
    body = lambda number, where, data: F.concat(F.lit(f'{{"Event": {{"System": {{"EventID": {number}, "Channel": "{where}", "Computer": "pc'), text_of(F.col("user_id")), F.lit('", "EventRecordID": '), n, F.lit("}, "), data, F.lit("}}"))
    listed = F.concat(F.lit('"EventData": {"Data": [{"#attributes": {"Name": "NewProcessName"}, "#text": "p'), n, F.lit('.exe"}, {"@Name": "CommandLine", "#text": "run '), n, F.lit('"}]}'))
    plain = F.concat(F.lit('"EventData": {"Image": "i'), n, F.lit('", "SourcePort": "'), text_of(F.col("event_id") % 70000), F.lit('", "DestinationPort": 7}'))
    service = F.concat(F.lit('"EventData": {"ServiceName": "s'), n, F.lit('", "ServiceFileName": "f"}'))
    kinds = (body(4688, "Security", listed), body(3, "Microsoft-Windows-Sysmon/Operational", plain), body('{"#text": 7045}', "System", service), body(9999, "Security", plain), F.concat(F.lit("no json "), n))
    return dealt(t("events").select("event_id", "user_id")).select("event_id", F.element_at(F.array(*kinds), (F.col("event_id") % 5).cast("int") + 1).alias("raw"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'process_create' WHEN 1 THEN 'network_connection' WHEN 2 THEN 'service_installed' ELSE 'windows_event' END AS kind, CASE WHEN event_id % 5 < 4 THEN 'pc' || user_id END AS computer,
  CASE event_id % 5 WHEN 0 THEN '{"new_process_name":"p' || event_id || '.exe","command_line":"run ' || event_id || '"}' WHEN 1 THEN '{"image":"i' || event_id || '","source_port":' || event_id % 70000 || '}' WHEN 2 THEN '{"service_name":"s' || event_id || '","service_file_name":"f"}' ELSE '{}' END AS details FROM events""")
def event_observations(t):
    return R.observations(_events(t), "raw").select("event_id", "kind", F.col("head.computer").alias("computer"), "details")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END AS members, CASE WHEN event_id % 5 IN (1, 3) THEN 'i' || event_id END AS image FROM events")
def event_data_maps(t):
    got = R.event_data(F.col("raw"))
    return _events(t).select("event_id", F.size(got).alias("members"), F.try_element_at(got, F.lit("Image")).alias("image"))


@query("""SELECT p_partkey, 'CVE-2024-' || (10000 + p_partkey) AS id, CASE WHEN p_partkey % 3 = 1 THEN 'dit is ' || p_name ELSE p_name END AS summary, CASE p_partkey % 3 WHEN 0 THEN '9.8' WHEN 1 THEN '5.5' END AS cvss, CASE WHEN p_partkey % 2 = 0 THEN 'cpe:a|cpe:b' ELSE '' END AS cpes FROM part""")
def cve_documents(t):
    key = F.col("p_partkey")
    said = F.when(key % 3 == 1, F.concat(F.lit('[{"lang": "nl", "value": "dit is '), "p_name", F.lit('"}]'))).otherwise(F.concat(F.lit('[{"lang": "nl", "value": "x"}, {"lang": "en", "value": "'), "p_name", F.lit('"}]')))
    score = F.when(key % 3 == 0, '{"cvssMetricV31": [{"cvssData": {"baseScore": 9.8}}], "cvssMetricV30": [{"cvssData": {"baseScore": 1.0}}]}').when(key % 3 == 1, '{"cvssMetricV30": [{"cvssData": {"baseScore": 5.5}}]}').otherwise("{}")
    nodes = F.when(key % 2 == 0, '[{"nodes": [{"cpeMatch": [{"criteria": "cpe:a"}]}, {"cpeMatch": [{"criteria": "cpe:b"}]}]}]').otherwise("[]")
    one = F.concat(F.lit('{"id": "CVE-2024-'), text_of(key + 10000), F.lit('", "descriptions": '), said, F.lit(', "metrics": '), score, F.lit(', "configurations": '), nodes, F.lit("}"))
    raw = F.when(key % 5 == 0, F.concat(F.lit('{"vulnerabilities": [{"cve": '), one, F.lit("}]}"))).otherwise(one)
    return R.cves(t("part").select(raw.alias("raw")), "raw").select((F.substring("id", 10, 20).cast("long") - 10000).alias("p_partkey"), "id", "summary", text_of(F.col("cvss")).alias("cvss"), F.array_join("cpes", "|").alias("cpes"))


@query("""SELECT 'doc' || s_suppkey AS document, 'CVE-' || s_suppkey AS cve, 'bold ' || s_name AS title, p AS product_id, CASE p WHEN 'p1' THEN 'Windows 10' END AS product, CASE WHEN s_suppkey % 2 = 0 THEN 'KB500' || s_suppkey END AS kb, '10.0.1.' || s_suppkey AS build, 'Critical' AS severity FROM supplier, (VALUES ('p1'), ('p2')) x(p)""")
def monthly_fix_rows(t):
    key = text_of(F.col("s_suppkey"))
    parts = (
        '{"DocumentTracking": {"Identification": {"ID": {"Value": "doc', key, '"}}}, "ProductTree": {"FullProductName": [{"ProductID": "p1", "Value": "Windows 10"}]}, "Vulnerability": [{"CVE": "CVE-', key, '", "Title": {"Value": "<b>bold</b> ', F.col("s_name"),
        '"}, "Threats": [{"Type": 0, "Description": {"Value": "x"}}, {"Type": 3, "Description": {"Value": "Critical"}}], "Remediations": [{"Type": 5, "ProductID": ["p1"]}, {"Type": 2, "FixedBuild": "10.0.1.', key, '", "ProductID": ["p1", "p2"], "Description": {"Value": "',
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("500"), key)).otherwise("Release Notes"), '"}}]}]}',
    )
    return R.monthly_fixes(t("supplier").select(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("raw")), "raw")


@query("""SELECT c_custkey AS pid, 'a) (b ' || c_nationkey AS name, 'S' AS state, CAST(1 AS INT) AS ppid, c_custkey * 10 AS start, 'n' || c_nationkey AS named, CAST(1000 AS BIGINT) AS uid, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey END AS rss_kb,
  CASE WHEN c_custkey % 3 > 0 THEN '/bin/x -a ' || c_custkey END AS command, c_custkey % 5 = 0 AS deleted, CASE WHEN c_custkey % 4 = 0 THEN 'u' || c_nationkey || '.service' END AS unit FROM customer""")
def process_files(t):
    key, nation = text_of(F.col("c_custkey")), text_of(F.col("c_nationkey"))
    stat = R.stat(F.concat(key, F.lit(" (a) (b "), nation, F.lit(") S 1 5 7 "), F.repeat(F.lit("0 "), F.lit(15)), key, F.lit("0 9")))
    status = R.status(F.concat(F.lit("Name:\tn"), nation, F.lit("\nUid:\t1000\t0\t0\n"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("VmRSS:\t "), key, F.lit(" kB\n")))))
    raw = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("/bin/x\0-a\0"), key, F.lit("\0"))).otherwise("")
    link = F.when(F.col("c_custkey") % 5 == 0, "/bin/x (deleted)").otherwise("/bin/x")
    group = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("1:cpu:/x\n0::/system.slice/u"), nation, F.lit(".service\n"))).otherwise("0::/user.slice/u.service")
    own = t("customer").select(stat.alias("s"), status.alias("t"), R.command_line(raw.cast("binary")).alias("command"), R.image(link).alias("i"), R.unit(group).alias("unit"))
    return own.select("s.pid", "s.name", "s.state", "s.ppid", "s.start", F.col("t.name").alias("named"), "t.uid", "t.rss_kb", "command", F.col("i.deleted").alias("deleted"), "unit").withColumn("pid", F.col("pid").cast("long"))


@query("SELECT s_suppkey, CASE i WHEN 0 THEN s_name ELSE 'second' END AS name, CASE i WHEN 0 THEN 'Running' END AS state FROM supplier, (VALUES (0), (1)) x(i) WHERE s_suppkey % 3 < 2 AND (i = 0 OR s_suppkey % 3 = 0)")
def collected_services(t):
    one = F.concat(F.lit('{"Name": "'), "s_name", F.lit('", "State": "Running"}'))
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" ["), one, F.lit(', {"Name": "second"}]'))).when(F.col("s_suppkey") % 3 == 1, one).otherwise("")
    return R.collected(t("supplier").select("s_suppkey", raw.alias("raw")), "raw", "services").select("s_suppkey", F.col("Name").alias("name"), F.col("State").alias("state"))


@query("""SELECT o_orderkey, 'p' || c_custkey AS owner, n_name AS service FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 > 0 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0""")
def socket_owners(t):
    """Sockets, by inode, with the process that holds them and the service of its control group."""
    sockets = t("orders").select("o_orderkey", F.col("o_custkey").alias("inode"))
    owners = t("customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("inode"), F.concat(F.lit("p"), text_of(F.col("c_custkey"))).alias("owner"), F.col("c_nationkey").alias("unit"))
    services = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("service"))
    return sockets.join(owners, "inode", "left").join(services, "unit", "left").select("o_orderkey", "owner", "service")


@query("SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 4 END) WHEN 1 THEN 'Complete' WHEN 2 THEN 'Partial' ELSE 'Unknown' END AS quality FROM orders GROUP BY 1")
def merged_quality(t):
    quality = F.when(F.col("o_orderstatus") == "O", "Complete").when(F.col("o_orderstatus") == "F", "Partial").otherwise("Unknown")
    return t("orders").groupBy("o_custkey").agg(correlations.worst_quality(F.max(correlations.rank_of_quality(quality))).alias("quality"))


@query("""SELECT 'p/' || p_partkey || '/' || CASE p_partkey % 4 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'pom.xml' WHEN 2 THEN 'package.json' ELSE 'build.gradle' END AS file,
  CASE p_partkey % 4 WHEN 0 THEN 'PyPI' WHEN 2 THEN 'npm' ELSE 'Maven' END AS ecosystem, CASE WHEN p_partkey % 2 = 1 THEN 'g:' ELSE '' END || 'a' || p_partkey AS name, '1.' || p_size || '.0' AS version, CASE WHEN p_partkey % 4 < 3 THEN 2 ELSE 1 END AS line
  FROM part UNION ALL SELECT 'p/' || p_partkey || '/requirements.txt', 'PyPI', 'other', NULL, 3 FROM part WHERE p_partkey % 4 = 0""")
def manifest_dependencies(t):
    key, version = text_of(F.col("p_partkey")), F.concat(F.lit("1."), text_of(F.col("p_size")), F.lit(".0"))
    kinds = (
        ("requirements.txt", F.concat(F.lit("# all\na"), key, F.lit("=="), version, F.lit("\nother>=2\n"))),
        ("pom.xml", F.concat(F.lit("<project><properties><v>"), version, F.lit("</v></properties><dependencies>\n<dependency><groupId>g</groupId><artifactId>a"), key, F.lit("</artifactId><version>${v}</version></dependency></dependencies></project>"))),
        ("package.json", F.concat(F.lit('{"dependencies": {\n"a'), key, F.lit('": "'), version, F.lit('"}}'))),
        ("build.gradle", F.concat(F.lit("implementation 'g:a"), key, F.lit(":"), version, F.lit("'"))),
    )
    one = F.element_at(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in kinds)), (F.col("p_partkey") % 4).cast("int") + 1)
    files = dealt(t("part").select("p_partkey", "p_size")).select(F.concat(F.lit("p/"), key, F.lit("/"), one["name"]).alias("file"), one["content"].alias("content"))
    return manifests.of_files(files).select("file", "ecosystem", "name", "version", "line")


@query("""SELECT 'pkg' || s_nationkey AS module, min('p/app/m' || s_suppkey || '.py') AS file, 2 AS line, count(*) AS files FROM supplier GROUP BY 1
  UNION ALL SELECT 'lib' || s_suppkey % 7, min('p/app/m' || s_suppkey || '.py'), 3, count(*) FROM supplier GROUP BY 1""")
def project_imports(t):
    """Imports of Python files, without quoted text, the standard library and the project's own modules."""
    value = F.concat(F.lit('"""import quoted"""\nimport os, pkg'), text_of(F.col("s_nationkey")), F.lit(" as p\nfrom lib"), text_of(F.col("s_suppkey") % 7), F.lit(".x import y\nfrom app.m1 import z\n"))
    return projects.python_imports(t("supplier").select(F.concat(F.lit("p/app/m"), text_of(F.col("s_suppkey")), F.lit(".py")).alias("file"), value.alias("value")))


@query("SELECT p_partkey, 'pkg:rpm/rocky/' || replace(p_name, ' ', '%20') || '@1:' || p_size || '~rc%2B?' || CASE WHEN p_partkey % 2 = 0 THEN 'arch=noarch&' ELSE '' END || 'distro=rocky-9.3' AS url FROM part")
def distribution_package_urls(t):
    version = F.concat(F.lit("1:"), text_of(F.col("p_size")), F.lit("~rc+"))
    more = {"distro": F.lit("rocky-9.3"), "epoch": F.lit(""), "arch": F.when(F.col("p_partkey") % 2 == 0, "noarch")}
    return t("part").select("p_partkey", host.package_url("rpm", F.lit("rocky"), F.col("p_name"), version, more).alias("url"))
