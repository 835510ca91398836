"""Cases that fix what columns and operators give: identifiers, targets, recipes, scores, views, chains of custody."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracewright.functions import blake3, recipes, text
from tracewright.operators import reports, scans, verification, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("product", "publisher", "version", "want"),
    [
        ("7-Zip 26.00 (x64)", "Igor Pavlov", "26.00", ("7-Zip", "cpe:2.3:a:igor_pavlov:7-zip:26.00:*:*:*:*:*:*:*", "pkg:generic/igor_pavlov/7-zip@26.00")),
        ("Docker Desktop", "Docker Inc.", "4.85.0", ("Docker Desktop", "cpe:2.3:a:docker_inc.:docker_desktop:4.85.0:*:*:*:*:*:*:*", "pkg:generic/docker_inc./docker_desktop@4.85.0")),
        ("draw.io 31.4.5", "", "", ("draw.io", "cpe:2.3:a:draw.io:draw.io:*:*:*:*:*:*:*:*", "pkg:generic/draw.io/draw.io@*")),
        ("Microsoft Edge 64-bit", "UNKNOWN", "1/2", ("Microsoft Edge", "cpe:2.3:a:microsoft:microsoft_edge:12:*:*:*:*:*:*:*", "pkg:generic/microsoft/microsoft_edge@12")),
        ("2.0", "Ärzte & Co", "é", ("2.0", "cpe:2.3:a:Ärzte__co:2.0:é:*:*:*:*:*:*:*", "pkg:generic/Ärzte__co/2.0@é")),
    ],
)
def test_identifiers_of_software(spark, product, publisher, version, want):
    assert tuple(one(spark, text.software_identifiers(F.lit(product), F.lit(publisher), F.lit(version)))) == want


def test_windows_products_and_severities(spark):
    yes = ["Windows 10", "windows 11,x", "Windows Server 2022 (Server Core installation)", "Windows 8.1 for x64", "Windows RT", "Windows  7"]
    no = ["Windows 8", "Windows XP", "Windows Server Update Services 3.0", "Microsoft .NET Framework 4.8 on Windows Server 2022", "Windows 10 on ARM", "Windowsill 10", "Windows"]
    rows = spark.createDataFrame([(n,) for n in yes + no], "n string").select("n", text.is_windows(F.col("n")).alias("w")).collect()
    assert {r["n"] for r in rows if r["w"]} == set(yes)
    for summary, severity in (("Important: kernel update", "Important"), (" Low : x", "Low"), ("important: x", None), ("High: x", None), ("Critical", None)):
        assert one(spark, text.severity_prefix(F.lit(summary))) == severity


def test_targets(spark):
    known = {
        "10.0.0.1": ("Address", ["10.0.0.1"]), "10.0.0.5/30": ("Cidr", ["10.0.0.5", "10.0.0.6"]), "10.0.0.5/31": ("Cidr", []), "10.0.0.5/32": ("Cidr", ["10.0.0.5"]), "10.0.0.254-10.0.1.1": ("Range", ["10.0.0.254", "10.0.0.255", "10.0.1.0", "10.0.1.1"]),
        "10.0.0.2-10.0.0.1": ("Invalid", None), "10.0.0.0/15": ("Invalid", None), "10.0.0.0/33": ("Invalid", None), "10.0.0.0-10.1.0.1": ("Invalid", None), "host.test": ("Hostname", []), "010.0.0.1": ("Hostname", []), "10.0.0.0/x": ("Hostname", []), "": ("Hostname", []),
    }
    rows = spark.createDataFrame([(k,) for k in known], "t string").withColumn("x", text.target(F.col("t"))).select("t", "x.kind", text.addresses(F.col("x")).alias("a")).collect()
    assert {r["t"]: (r["kind"], r["a"]) for r in rows} == known
    assert one(spark, F.size(text.addresses(text.target(F.lit("10.0.0.0/16"))))) == 65_534
    assert one(spark, text.target(F.lit(None).cast("string"))) is None


def test_recipe_steps(spark):
    cooked = lambda data, *steps: one(spark, recipes.cook(F.lit(data), list(steps)))
    assert cooked(b" 0x4a 4B\n", "hex_decode") == b"JK" and cooked(b"4a0x4b", "hex_decode") is None and cooked(b"4a4", "hex_decode") is None
    assert cooked(b"Zm w=\r\n", "base64_decode") is not None and cooked(b"Zmw", "base64_decode") is None and cooked(b"-_8=", "base64_decode") == b"\xfb\xff" and cooked(b"+_8=", "base64_decode") is None and cooked(b"Zm9=", "base64_decode") is None
    assert cooked(b"crypto", ("xor", b"KEY42"), ("xor", b"KEY42")) == b"crypto" and cooked(b"x", ("xor", b"")) is None and cooked(b"", "base64_encode", "base64_decode") == b""
    assert cooked(b"Hello, World!", "rot13") == b"Uryyb, Jbeyq!"


def test_twenty_steps_plan_in_linear_size(spark):
    rows = spark.createDataFrame([(b"text",)], "d binary")
    size = lambda n: len(rows.select(recipes.cook(F.col("d"), ["base64_encode", "base64_decode"] * n).alias("x"))._jdf.queryExecution().optimizedPlan().toString())
    assert size(20) < 2.5 * size(10)
    assert rows.select(recipes.cook(F.col("d"), ["base64_encode", "base64_decode"] * 10)).first()[0] == b"text"


def test_preview_and_flags(spark):
    secret = b"synt{uvqqra_va_cvcryvar}"
    rows = spark.createDataFrame([(1, secret), (2, b"\xff" * 70), (3, None)], "k int, d binary")
    got = {r["k"]: tuple(r)[1:] for r in recipes.preview(rows, F.col("d"), ["rot13"]).drop("d").collect()}
    assert got[1] == (secret.decode(), "flag{hidden_in_pipeline}", 24, 24, ["flag{hidden_in_pipeline}"]) and got[2] == got[3] == (None, None, None, None, None)
    shown = {r["k"]: tuple(r)[1:] for r in recipes.preview(rows, F.col("d"), []).drop("d").collect()}
    assert shown[2] == ("ff" * 64 + "...", "ff" * 64 + "...", 70, 70, [])
    found = one(spark, recipes.flags(F.lit("found ctf{m3m0ry_unp4cked_fl4g!} and flag{second_flag_here} x{abcd} flag{ab} CTF{a b c} ctf{m3m0ry_unp4cked_fl4g!}")))
    assert found == ["ctf{m3m0ry_unp4cked_fl4g!}", "flag{second_flag_here}"]


def test_techniques_of_commands(spark):
    rows = spark.createDataFrame([("powershell.exe -NoP -enc AAAA", ["a", "b"]), ("net user x", ["c"]), ("PowerShell", ["d"]), (None, ["e"])], "command_line string, evidence array<string>")
    got = [tuple(r)[2:] for r in reports.taxonomy(rows).collect()]
    assert got == [("T1059.001", "Execution", 0.95, "Corroborated", "a", "v1.0.0"), ("T1033", "Discovery", 0.65, "Candidate", "c", "v1.0.0")]


def test_shapes_systems_coverage_and_incidents(spark):
    nodes = spark.createDataFrame([("v", t, k) for k, t in enumerate(("Host", "Process", "NetworkSocket", "Identity", "File"))], "view string, entity_type string, k int")
    got = [(r["shape"], r["colour"], r["x"], r["y"]) for r in reports.diagram(nodes, ["k"]).orderBy("k").collect()]
    assert got == [("Circle", "#58a6ff", 0, 100), ("Hexagon", "#2ea043", 120, 100), ("Diamond", "#bc8cff", 240, 100), ("Square", "#39c5bb", 360, 100), ("Octagon", "#f85149", 480, 100)]
    system = lambda *ports: one(spark, reports.system_behind(F.array(*map(F.lit, ports))))["device"]
    assert (system(22, 445), system(22, 80), system(443), system(9)) == ("Workstation / Server", "Linux Server", "Network Device / Web Server", "Network Endpoint")
    ports = spark.createDataFrame([("a", "Open", "http"), ("a", "Open", "TCP-Service"), ("a", "Open", None), ("a", "OpenFiltered", None), ("b", "Timeout", None), ("b", "Timeout", None), ("b", "Closed", None), ("c", "Unknown", None), ("e", "Timeout", None), ("e", "Closed", None)], "h string, state string, service string")
    errors = spark.createDataFrame([("d",)], "h string")
    got = {r["h"]: r for r in reports.coverage(ports, "h", errors, nmap=True).collect()}
    assert {h: r["quality"] for h, r in got.items()} == {"a": "Full", "b": "Degraded", "c": "Partial", "d": "Partial", "e": "Full"}
    assert (got["a"]["identified"], got["a"]["unidentified"], got["a"]["filtered"], got["d"]["attempted"], got["a"]["confidence"]) == (1, 2, 1, 0, 0.95)
    facts = spark.createDataFrame([("c", "ws", "Dump", "High"), ("c", "ws", "Dump", "High"), ("c", "ws", "Seen", "Medium")], "case string, entity_key string, fact_type string, severity string")
    assert [r["recommendation"] for r in reports.recommendations(facts).collect()] == ["Isolate asset 'ws' exhibiting high risk indicator 'Dump'"] * 2
    assert tuple(reports.incident(facts, facts, facts.limit(0), "case").first()) == ("c", 3, 3, 0, 2)


TRUTH = "scenario string, criterion string, thing string, other string"
FACTS = "scenario string, entity_key string, fact_type string, data string, evidence int, evidence_strength double, pain_level string"


def test_scores_of_scenarios(spark):
    expected = [("Asset", "192.168.1.100", None), ("Asset", "192.168.1.105", None), ("Fact", "LSASS_Dump", None), ("Technique", "T1003.001", None), ("Stage", "CredentialAccess", None), ("Pyramid", "Tools", None)]
    truth = spark.createDataFrame([("S", *e) for e in expected], TRUTH)
    facts = spark.createDataFrame([("S", "192.168.1.100", "HostDiscovered", "null", 1, 1.0, None)], FACTS)
    scored = verification.criteria(truth, facts)
    rows = scored.orderBy("place").collect()
    assert [(r["name"].split()[0], r["points"], r["most"]) for r in rows] == [("Assets", 20, 40), ("Fact", 0, 20), ("Evidence", 20, 20), ("ATT&CK", 0, 20), ("Kill", 0, 15), ("Pyramid", 0, 15)]
    summary = verification.explained(scored, verification.totals(scored, truth)).first()["summary"]
    assert summary.startswith("Scenario: S | Total Score: 40/130 (30.8%)\n" + "-" * 40 + "\n- Assets Discovered (Coverage): +20 / 40 pts | Discovered 1/2 required assets\n")
    all_found = [("S", "192.168.1.100", "CredentialDump", '{"x":"LSASS"}', 2, 1.0, "Tools"), ("S", "192.168.1.105", "x", None, 0, 1.0, None)]
    full = verification.criteria(truth.union(spark.createDataFrame([("S", "Edge", "192.168.1.100", "192.168.1.105"), ("S", "Edge", "192.168.1.100", "other")], TRUTH)), spark.createDataFrame(all_found, FACTS))
    assert [(r["points"], r["most"]) for r in full.orderBy("place").collect()] == [(40, 40), (20, 20), (10, 20), (20, 20), (20, 40), (15, 15), (15, 15)]
    none = verification.criteria(truth, facts.limit(0))
    assert none.where("name LIKE 'Evidence%'").count() == 0 and verification.totals(none, truth).first()["percent"] == 0.0


PAIR = "ecosystem string, name string, version string, build int, ubr int, kbs array<string>, id string, aliases array<string>, ranges array<struct<ecosystem:string,package:string,fixed:string>>, has_cpe boolean, fix struct<required_kb:string,superseding_kbs:array<string>,target_build:int,fixed_ubr:int>"


@pytest.mark.parametrize(
    ("product", "vulnerability", "want"),
    [
        (("Ubuntu", "nginx", "1.18.0-0ubuntu1.6", None, None, []), ("C", ["USN-1"], [("Ubuntu", "nginx", "1.18.0-0ubuntu1.5")], True, None), ("Fixed", 0.98, 100, "USN-1")),
        (("Ubuntu", "nginx", "1.18.0-0ubuntu1.2", None, None, []), ("C", [], [("Ubuntu", "NGINX", "1.18.0-0ubuntu1.5")], True, None), ("Affected", 0.95, 100, "C")),
        (("RedHat", "log4j", "2.14.1-1.el8", None, None, []), ("C", [], [("RedHat", "log4j", "2.17.1-1.el8_5")], True, None), ("Affected", 0.95, 100, "C")),
        (("Debian", "libx", "1", None, None, []), ("C", [], [("Debian", "libx", None)], True, None), ("Affected", 0.85, 100, "C")),
        (("npm", "left", "1.2.3", None, None, []), ("C", [], [("PyPI", "LEFT", "1.2.4")], True, None), ("Affected", 0.88, 70, None)),
        (("npm", "left", "one", None, None, []), ("C", [], [("PyPI", "LEFT", "1.2.4")], True, None), ("Unknown", 0.4, 70, None)),
        (("npm", "left", "1.2.3", None, None, []), ("C", [], [], True, None), ("Candidate", 0.6, 40, None)),
        (("npm", "left", "1.2.3", None, None, []), ("C", [], [], False, None), ("Candidate", 0.3, 10, None)),
        (("Windows", "Windows 10", "10.0", 19045, 4529, ["KB5040442"]), ("C", [], [], True, ("5039212", ["KB5040442"], None, None)), ("Fixed", 0.96, 90, "5039212")),
        (("Windows", "Windows 10", "10.0", 19045, 4529, ["KB1"]), ("C", [], [], True, ("KB5039212", ["KB5040442"], None, None)), ("Affected", 0.96, 90, "KB5039212")),
        (("Windows", "Windows 10", "10.0", 19045, 4529, []), ("C", ["KB7"], [], True, (None, [], 19045, 4529)), ("Fixed", 0.94, 90, None)),
        (("Windows", "Windows 10", "10.0", 19044, 4529, []), ("C", ["x", "kb7"], [], True, (None, [], 19045, 4529)), ("Affected", 0.92, 90, "kb7")),
        (("Windows", "Windows 10", "10.0", 19044, None, []), ("C", [], [], False, None), ("Candidate", 0.3, 10, None)),
    ],
)
def test_applicability_ladder(spark, product, vulnerability, want):
    got = scans.applicability(spark.createDataFrame([(*product, *vulnerability)], PAIR)).first()
    assert (got["status"], got["confidence"], got["rank"], got["advisory"]) == want


def test_blake3_published_vectors(spark):
    # byte i of an input is i modulo 251
    known = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030", 3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
        5121: "628bd2cb2004694adaab7bbd778a25df25c47b9d4155a55f8fbd79f2fe154cff", 31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
    }
    data = {n: bytes(i % 251 for i in range(n)) for n in known}
    rows = spark.createDataFrame([(n, data[n]) for n in known] + [(-1, None)], "n int, d binary").select("n", blake3.digest(F.col("d")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in rows} == known | {-1: None}
    for size in (1024, 4096, 1 << 15):
        for n in (31744, 102400, 5121):
            if n > size:
                assert blake3.joined([blake3.part_value(data[n][at : at + size], at // 1024) for at in range(0, n, size)]) == known[n]


CUSTODY = "event_id string, session_id string, artifact_id string, case_id string, action string, actor_id string, timestamp_utc string, sha256 string, blake3 string, details_hash string"


def custody(spark, n):
    """A whole chain of n events, built by a plain version of the digest's bytes."""
    previous, rows = windows.GENESIS, []
    for k in range(1, n + 1):
        fields = [f"e{k}", "s", None if k % 2 else "art", "case", "INGEST", "é", f"2024-01-01T00:00:0{k}+00:00", "aa", "bb", "cc"]
        sized = lambda t: len((t or "").encode()).to_bytes(4) + (t or "").encode()
        raw = windows.CUSTODY_MARK + sized(previous) + k.to_bytes(8) + b"".join(map(sized, fields))
        digest = blake3.digests([raw])[0]
        rows.append((*fields, k, previous, digest))
        previous = digest
    return rows, CUSTODY + ", sequence_no long, previous_event_hash string, event_hash string"


def test_custody_chains(spark):
    rows, schema = custody(spark, 5)
    broken = lambda rows: [tuple(r)[1:] for r in windows.broken_custody(spark.createDataFrame(rows, schema)).collect()]
    assert broken(rows) == []
    change = lambda at, field, value: [tuple(value if (i, k) == (at, field) else x for k, x in enumerate(r)) for i, r in enumerate(rows)]
    for at, field in itertools.product((0, 3), (0, 2, 3, 4, 5, 6, 7, 8, 9)):
        assert broken(change(at, field, "other")) == [(at + 1, "digest")]
    assert broken(change(0, 11, "x")) == [(1, "genesis")] and broken(change(2, 11, "x")) == [(3, "previous")] and broken(rows[:2] + rows[3:]) == [(4, "sequence")]
    assert broken(change(4, 12, "x")) == [(5, "digest")] and broken(change(1, 12, "x")) == [(2, "digest")]
