"""Findings of dependencies, evaluations of products, names of Windows installations, and observations of hosts and captures."""

import json

from pyspark.sql import functions as F

from tests.test_captures import A, B, classic, tcp, udp6
from tracewright.functions import text
from tracewright.operators import observations, scans
from tracewright.sources import captures

DEPENDENCY = "ecosystem string, name string, version string, kind string, file string, line int"
ADVISORY = "ecosystem string, key string, version string, id string, severity string, cvss double, kev boolean, malicious boolean, summary string, fix string"


def test_findings_of_dependencies(spark):
    used = spark.createDataFrame(
        [("PyPI", "Flask_Login", "0.5", "lockfile", "poetry.lock", 9), ("PyPI", "flask-login", "0.5", "manifest", "requirements.txt", 3), ("PyPI", "flask-login", "0.5", "manifest", "requirements.txt", 3), ("npm", "evil", "1.0.0", "installed", "x", 1), ("npm", "fine", "1.0.0", "manifest", "p", 1), ("npm", "Loose", None, "manifest", "p", 2), ("npm", "lodash", "4.0.0", "bundled", "l.js", 7)],
        DEPENDENCY,
    )
    known = [("PyPI", "flask-login", "0.5", f"CVE-{k}", s, None, k == 3, False, "", f"0.{6 + k}") for k, s in enumerate(("Low", "Medium", "High", "Medium", "None", None, "Critical"))]
    known += [("npm", "evil", "1.0.0", "MAL-1", "Critical", None, False, True, "Steals things.", None), ("npm", "evil", "1.0.0", "CVE-9", "Low", None, False, False, "x", None), ("npm", "lodash", "4.0.0", "CVE-8", None, 5.0, None, None, "x", None), ("npm", "fine", "2.0.0", "CVE-7", "Low", None, False, False, "x", "3")]
    got = {r["name"]: r for r in scans.dependency_findings(used, spark.createDataFrame(known, ADVISORY), ("PyPI", "npm")).collect()}
    assert set(got) == {"flask-login", "evil", "lodash"}
    flask = got["flask-login"]
    assert (flask["rule"], flask["cwe"], flask["severity"], flask["file"], flask["line"], flask["other_places"], flask["fixed_version"]) == ("vulnerable-dependency", 1395, "critical", "requirements.txt", 3, ["poetry.lock:9"], "0.12")
    assert flask["message"] == (
        "flask-login 0.5 (PyPI): известных уязвимостей 7: CVE-3 (средняя), CVE-6 (критическая), CVE-2 (высокая), CVE-1 (средняя), CVE-0 (низкая) и ещё 2. Используются в реальных атаках (CISA KEV): CVE-3. Обновите до 0.12 или новее."
    )
    assert (got["evil"]["rule"], got["evil"]["cwe"], got["evil"]["severity"], got["evil"]["other_places"]) == ("malicious-dependency", 506, "critical", [])
    assert got["evil"]["message"].startswith("Пакет evil 1.0.0 (npm) опубликован злоумышленниками (MAL-1): Steals things. Удалите") and got["evil"]["message"].endswith(" Кроме того, известных уязвимостей: 1.")
    assert got["lodash"]["severity"] == "medium" and "CVE-8 (без оценки). Исправленной версии нет" in got["lodash"]["message"]


def test_evaluations_never_say_secure(spark):
    products = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "p string")
    assessed = spark.createDataFrame([("a", "Affected"), ("a", "Affected"), ("a", "Fixed"), ("b", "Fixed"), ("b", "Unknown"), ("c", "Candidate")], "p string, status string")
    got = {r["p"]: tuple(r)[1:] for r in scans.evaluated(products, assessed, "p").collect()}
    assert got == {
        "a": (3, 2, 1, "VULNERABILITIES_IDENTIFIED: 2 affected"), "b": (2, 0, 1, "NO_ACTIVE_VULNERABILITIES: 1 patched/backported"), "c": (1, 0, 0, "NO_KNOWN_MATCHED_VULNERABILITIES"), "d": (0, 0, 0, "NO_KNOWN_MATCHED_VULNERABILITIES"),
    }


def test_names_of_windows_installations(spark):
    known = [
        ("Microsoft Windows 11 Pro", 26100, "24H2", "Client", 1, "x86_64", "Windows 11 Version 24H2 for x64-based Systems"), ("Microsoft Windows 10", 10240, "", "Client", 1, "x86", "Windows 10 for 32-bit Systems"),
        ("x", 30000, "27H1", "Client", 1, "aarch64", "Windows 11 Version 27H1 for ARM64-based Systems"), ("x", 30000, "dev", "Client", 1, "x86_64", None), ("x", 26100, "", "Client", 3, "x86_64", "Windows Server 2025"),
        ("x", 20348, "", "Server Core", None, "x86_64", "Windows Server 2022 (Server Core installation)"), ("x", 25398, "", "Server", 2, "x86_64", "Windows Server 2022, 23H2 Edition (Server Core installation)"),
        ("Microsoft Windows Server 2028 Standard", 40000, "", None, None, "x86_64", "Windows Server 2028"), ("Microsoft Windows Server vNext", 40000, "", None, None, "x86_64", None), ("x", 19045, "22H2", "Client", 1, "riscv", None),
    ]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(known)], "k int, a string, b int, c string, d string, e int, f string, want string")
    for r in rows.select("*", text.windows_product(*map(F.col, "abcdef")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_observations_of_hosts(spark):
    hosts = spark.createDataFrame([("ws", "10.0.0.1", "windows"), ("box", "10.0.0.2", None)], "host string, host_ip string, platform string")
    processes = spark.createDataFrame([("ws", 1, 0, "init", None), ("ws", 2, 1, "bash", "bash -i"), ("box", 2, 1, "sh", None)], "host string, pid int, ppid int, name string, command_line string")
    tasks = spark.createDataFrame([("ws", "t1", "run.exe", "-x"), ("ws", "t2", "run.exe", "  "), ("ws", "t3", None, "-x")], "host string, task_name string, action string, arguments string")
    autoruns = spark.createDataFrame([("box", "HKLM", "v", "c:/x.exe")], "host string, key string, value_name string, resolved_executable string")
    rows = observations.of_hosts(hosts, processes=processes, tasks=tasks, autoruns=autoruns).collect()
    found = {(r["host"], r["source_tool"], r["raw_event_type"], (d := json.loads(r["data"])).get("process_name") or d.get("task_name") or d.get("item_name")): d for r in rows}
    assert len(rows) == 7 and found[("ws", "windows_process_collector", "process", "bash")]["parent_name"] == "init" and found[("box", "host_process_collector", "process", "sh")]["parent_name"] == ""
    assert found[("ws", "windows_process_collector", "process", "bash")] == {
        "pid": 2, "ppid": 1, "parent_name": "init", "executable_path": None, "command_line": "bash -i", "username": None, "uid": None, "exe_deleted": None, "sha256": None, "started_at": None, "process_name": "bash", "platform": "windows", "host": "ws", "host_ip": "10.0.0.1",
    }
    assert [found[("ws", "windows_task_collector", "scheduled_task", t)]["action"] for t in ("t1", "t2", "t3")] == ["run.exe -x", "run.exe", None]
    assert found[("box", "host_autorun_collector", "autorun", "v")]["target_path"] == "c:/x.exe"


def test_observations_of_captures(spark, tmp_path):
    ask, give = b"GET /x HTTP/1.1\r\nHost: h.test\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n"
    frames = [tcp(A, B, 9, 80, 1, 2), tcp(A, B, 9, 80, 2, 24, ask[:10]), tcp(B, A, 80, 9, 5, 24, give), tcp(A, B, 9, 80, 12, 24, ask[10:]), tcp(A, B, 9, 80, 50, 17), tcp(A, B, 8, 443, 1, 24, b"\x17\x03\x03\0\0"), tcp(A, B, 7, 9999, 1, 4, b"x"), udp6()]
    (tmp_path / "x.cap").write_bytes(classic(frames))
    rows = observations.of_capture(captures.packets(spark, str(tmp_path / "x.cap"))).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["raw_event_type"], []).append(r)
    assert {k: len(v) for k, v in kinds.items()} == {"network_socket": 8, "dns_message": 1, "network_flow": 4, "http_message": 1, "tls_handshake": 1}
    http = kinds["http_message"][0]
    assert (json.loads(http["data"])["uri"], json.loads(http["data"])["host"], http["flow_quality"], http["protocol_quality"], http["packet_index"]) == ("/x", "h.test", "Complete", "Complete", 0)
    assert json.loads(kinds["dns_message"][0]["data"]) == {"parse_error": "TruncatedRecord", "offset": 3, "source_ip": "::1", "destination_ip": "::2", "packet_index": 7} and kinds["dns_message"][0]["protocol_quality"] == "Degraded"
    assert json.loads(kinds["tls_handshake"][0]["data"])["parse_error"] == "InvalidHandshake" and kinds["tls_handshake"][0]["flow_quality"] == "Partial"
    assert sorted(r["flow_quality"] for r in kinds["network_flow"]) == ["Complete", "Complete", "Partial", "Truncated"]
    one = json.loads(kinds["network_socket"][0]["data"])
    assert one["destination_port"] == 80 and one["packet_locator"].startswith("pcap://offset/0x") and "tcp_flags" in one
