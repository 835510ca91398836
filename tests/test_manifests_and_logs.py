import json

import pytest

from tracewright.functions import octets, policy
from tracewright.sources import host, logs, manifests
from pyspark.sql import functions as F


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


CASES = {
    "requirements.txt": ("# all\nflask[async]==2.0.1 ; python_version>'3'\nnumpy>=1.2,<2 # why\n-r other.txt\nx @ https://a/b\nhttps://a/b.whl\ndjango \\\n  ==4.2 --hash=sha256:1\nb==1.*\n", [("flask", "2.0.1", "==2.0.1", 2), ("numpy", None, ">=1.2,<2", 3), ("x", None, "@ https://a/b", 5), ("django", "4.2", "==4.2", 7), ("b", None, "==1.*", 9)]),
    "constraints.txt": ("this is a text\nabout what binds us\nall\n", []),
    "package.json": ('{"name": "a",\n"dependencies": {"b": "1.2.3",\n"c": "^2.0.0", "d": "npm:real@3.0.0",\n"e": "file:../e"},\n"devDependencies": {"b": "v1.0.0-rc.1"}}', [("b", "1.2.3", "1.2.3", 2), ("c", None, "^2.0.0", 3), ("real", "3.0.0", "npm:real@3.0.0", 3), ("b", "1.0.0-rc.1", "v1.0.0-rc.1", 5)]),
    "package-lock.json": ('{"packages": {\n"": {"version": "1.0.0"},\n"node_modules/a": {"version": "1.0.1"},\n"node_modules/a/node_modules/@s/b": {"version": "2.0.0"},\n"node_modules/l": {"link": true, "version": "1.0.0"}}}', [("a", "1.0.1", "1.0.1", 3), ("@s/b", "2.0.0", "2.0.0", 4)]),
    "npm-shrinkwrap.json": ('{"dependencies": {\n"a": {"version": "1.0.0",\n"dependencies": {\n"b": {"version": "2.0.0"}}}}}', [("a", "1.0.0", "1.0.0", 2), ("b", "2.0.0", "2.0.0", 4)]),
    "yarn.lock": ('# yarn\n\n"@s/a@^1.0.0", "@s/a@^1.1.0":\n  version "1.2.0"\n  dependencies:\n    b "^2"\n\nb@^2:\n  version "2.0.0"\n', [("@s/a", "1.2.0", "1.2.0", 3), ("b", "2.0.0", "2.0.0", 8)]),
    "Pipfile.lock": ('{"default": {\n"a": {"version": "==1.0"},\n"b": {"git": "x"}}, "develop": {}}', [("a", "1.0", "==1.0", 2)]),
    "poetry.lock": ('[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2.0"\n\n[package.source]\ntype = "git"\nurl = "x"\n', [("a", "1.0", "1.0", 2)]),
    "Cargo.lock": ('version = 3\n\n[[package]]\nname = "own"\nversion = "0.1.0"\n\n[[package]]\nname = "serde"\nversion = "1.0.2"\nsource = "registry+https://x"\n', [("serde", "1.0.2", "1.0.2", 8)]),
    "go.mod": ("module a\n\nrequire b.c/d v1.2.3\nrequire (\n\te.f/g v2.0.0+incompatible // indirect\n\th v0.1.0\n)\n", [("b.c/d", "v1.2.3", "v1.2.3", 3), ("e.f/g", "v2.0.0", "v2.0.0+incompatible", 5), ("h", "v0.1.0", "v0.1.0", 6)]),
    "Gemfile.lock": ("GEM\n  remote: https://x/\n  specs:\n    a (1.0.0-x86_64-linux)\n      b (>= 1)\n    b (2.0)\n\nDEPENDENCIES\n  a (1)\n", [("a", "1.0.0", "1.0.0-x86_64-linux", 4), ("b", "2.0", "2.0", 6)]),
    "composer.json": ('{"require": {"php": ">=8",\n"a/b": "v1.2"}, "require-dev": {"c/d": "^1"}}', [("a/b", "1.2", "v1.2", 2), ("c/d", None, "^1", 2)]),
    "composer.lock": ('{"packages": [\n{"name": "a/b", "version": "v1.0"},\n{"name": "c/d", "version": "dev-main"}]}', [("a/b", "1.0", "v1.0", 2)]),
    "gradle.lockfile": ("# c\na.b:c:1.0=runtimeClasspath\nempty=x\n", [("a.b:c", "1.0", "1.0", 2)]),
    "packages.config": ('<packages>\n<package id="A" version="[1.0]" />\n<package id="B" version="[1,2)" />\n</packages>', [("A", "1.0", "[1.0]", 2), ("B", None, "[1,2)", 3)]),
    "packages.lock.json": ('{"dependencies": {"net6.0": {\n"A": {"type": "Direct", "resolved": "1.0"},\n"P": {"type": "Project", "resolved": "1"}}}}', [("A", "1.0", "1.0", 2)]),
    "uv.lock": ("not toml [", []),
    "other.json": ("{}", []),
    "pyproject.toml": ('[project]\ndependencies = [\n"flask==2.0",\n"numpy>=1",\n"no requirement!"]\n[project.optional-dependencies]\nx = ["rich[a]==1.*"]\n[dependency-groups]\ny = [{include-group = "x"}, "pytest==8.0"]\n[tool.poetry.dependencies]\npython = "^3.9"\na = "1.0"\nb = {version = "==2.0"}\nc = {path = "../c"}\n', [("flask", "2.0", "==2.0", 3), ("numpy", None, ">=1", 4), ("rich", None, "==1.*", 7), ("pytest", "8.0", "==8.0", 9), ("a", None, "1.0", 12), ("b", "2.0", "==2.0", 13)]),
    "Pipfile": ('[packages]\na = "==1.0"\nb = "*"\n[dev-packages]\nc = {version = "==2.0", extras = ["x"]}\nd = {git = "https://x"}\n', [("a", "1.0", "==1.0", 2), ("b", None, "*", 3), ("c", "2.0", "==2.0", 5)]),
    "pnpm-lock.yaml": ("lockfileVersion: 9\n\nimporters:\n  z@1.0.0:\n    x: 1\n\npackages:\n\n  '@s/a@1.2.3':\n    resolution: {integrity: x}\n  /b@2.0.0(c@1.0.0):\n    dev: true\n  /d/3.0.0_e@1.0.0:\n\nsnapshots:\n  f@1.0.0:\n", [("@s/a", "1.2.3", "1.2.3", 9), ("b", "2.0.0", "2.0.0", 11), ("d", "3.0.0", "3.0.0", 13)]),
    "pom.xml": ("<project xmlns='http://m'>\n<version>9</version><properties><v>1.0</v><w>${v}.1</w></properties>\n<dependencies>\n<dependency><groupId>a.b</groupId><artifactId>c</artifactId><version>${w}</version></dependency>\n<dependency><groupId>${project.groupId}</groupId><artifactId>d</artifactId><exclusions><exclusion><groupId>q</groupId></exclusion></exclusions></dependency>\n<dependency><groupId>e</groupId><artifactId>f</artifactId><version>[1,2)</version></dependency>\n</dependencies><build><plugins><plugin><dependencies><dependency><groupId>p</groupId><artifactId>p</artifactId></dependency></dependencies></plugin></plugins></build></project>", [("a.b:c", "1.0.1", "${w}", 4), ("${project.groupId}:d", None, "", 5), ("e:f", None, "[1,2)", 6)]),
    "build.gradle": ("dependencies {\n  implementation 'a.b:c:1.0'\n  // api 'x:y:1'\n  /* api 'x:y:2'\n */\n  api(platform(\"d:e:2.0@aar\"))\n  testImplementation group: 'f', name: 'g', version: '3.0'\n  runtimeOnly \"h:i:$v\"\n  api 'j:k'\n}\n", [("a.b:c", "1.0", "1.0", 2), ("d:e", "2.0", "2.0", 6), ("h:i", None, "$v", 8), ("j:k", None, "", 9), ("f:g", "3.0", "3.0", 7)]),
    "build.gradle.kts": ('dependencies {\n  implementation("a:b:1.+")\n  implementation(group = "c", name = "d", version = "2.0")\n}\n', [("a:b", None, "1.+", 2), ("c:d", "2.0", "2.0", 3)]),
    "A.csproj": ('<Project>\n<ItemGroup>\n<PackageReference Include="A" Version="1.0" />\n<PackageReference Include="B"><Version>[2.0]</Version></PackageReference>\n<PackageReference Include="C" />\n<PackageReference Include="D" Version="1.*" /></ItemGroup></Project>', [("A", "1.0", "1.0", 3), ("B", "2.0", "[2.0]", 4), ("C", None, "", 5), ("D", None, "1.*", 6)]),
    "Directory.Packages.props": ('<!DOCTYPE a [<!ENTITY b "c">]><Project><PackageVersion Include="A" Version="1" /></Project>', []),
}


@pytest.mark.parametrize("name", CASES)
def test_manifest(name):
    text, want = CASES[name]
    assert [(r[1], r[2], r[3], r[5]) for r in manifests.rows_of(f"/p/{name}", text)] == want
    assert [(r[1], r[5]) for r in manifests.rows_of(name, text.replace("\n", "\r\n"))] == [(w[0], w[3]) for w in want]
    assert list(manifests.rows_of(name, "")) == [] and list(manifests.rows_of(name, "[1]")) == []


def test_dependencies_of_a_tree(spark, tmp_path):
    for k, (name, (text, _)) in enumerate(CASES.items()):
        (tmp_path / str(k)).mkdir()
        put(tmp_path / str(k) / name, text)
    got = manifests.dependencies(spark, str(tmp_path))
    assert got.count() == sum(len(w) for _, w in CASES.values())
    assert {r[0] for r in got.select("ecosystem").distinct().collect()} == {"PyPI", "npm", "crates.io", "Go", "RubyGems", "Packagist", "Maven", "NuGet"}


def test_installed_packages():
    read = lambda path, text: [r[:4] + r[6:] for r in manifests.rows_of(path, text)]
    assert read("/p/site-packages/A-1.dist-info/METADATA", "Metadata-Version: 2.1\nName: A\nVersion: 1.0\n\nName: B\n") == [("PyPI", "A", "1.0", "1.0", "installed")]
    assert read("/p/METADATA", "Name: A\nVersion: 1.0\n") == []
    text = '{"name": "@s/a", "version": "1.2.3", "dependencies": {"b": "1.0.0"}}'
    assert read("/p/node_modules/@s/a/package.json", text) == [("npm", "@s/a", "1.2.3", "1.2.3", "installed")]
    assert read("/p/package.json", text) == [("npm", "b", "1.0.0", "1.0.0", "manifest")]


def test_numbered_events(spark, tmp_path):
    text = "\n".join(['{"EventID": 4688, "System": {"TimeCreated": {"@SystemTime": "2024-01-01T03:00:00.5+03:00"}}}', '{"EventID": "4624", "TimeCreated": "2024-01-01T00:00:00Z"}', "no json", "", '{"EventID": 4625, "TimeCreated": {"x": 1}}'])
    got = rows(logs.security(spark, put(tmp_path / "s", text)), "event_id", "raw_event_type", F.unix_millis("source_timestamp"))
    assert got == [(4688, "process_create", 1704067200500), (None, "security_event", 1704067200000), (4625, "logon_failure", None)]
    got = rows(logs.sysmon(spark, put(tmp_path / "y", '{"EventID": 3, "EventData": {"UtcTime": "2024-01-01T00:00:00Z"}}\n{"EventID": 99}')), "raw_event_type", F.unix_millis("source_timestamp"))
    assert got == [("sysmon_network_connect", 1704067200000), ("sysmon_event", None)]


def test_generic_logs(spark, tmp_path):
    read = lambda text: [(json.loads(r[0]), r[1]) for r in rows(logs.generic(spark, put(tmp_path / "g", text)), "data", F.unix_seconds("source_timestamp"))]
    one = '{"a": 1, "data": {"a": 2, "b": 3}, "event_data": {"b": 4}, "source_timestamp": "2024-01-01T00:00:00Z"}'
    flat = {"a": 2, "b": 4, "data": {"a": 2, "b": 3}, "event_data": {"b": 4}, "source_timestamp": "2024-01-01T00:00:00Z"}
    assert read(f"[{one}, 5]") == [(flat, 1704067200), (5, None)]
    assert read(f'{{"records": [{one}]}}') == [(flat, 1704067200)]
    assert read('{"a": 1}\n\n plain text \n[') == [({"a": 1}, None), ({"raw_message": "plain text"}, None), ({"raw_message": "["}, None)]
    assert read("") == []


def test_units_and_timers(spark, tmp_path):
    text = "[Unit]\nDescription=x\n# OnBootSec=0\n[Timer]\nOnBootSec=5min\nOnCalendar=daily\nOnCalendar=Mon \\\n  10:00\nbroken\n"
    path = put(tmp_path / "a.timer", text)
    assert rows(host.timers(spark, path), "schedule") == [("OnCalendar=daily; OnCalendar=Mon 10:00; OnBootSec=5min",)]
    assert rows(host.sections(spark, path).where("section = 'Unit'"), "key", "value") == [("Description", "x")]


def test_desktop_entries_and_start_files(spark, tmp_path):
    text = "[Desktop Entry]\nName=A\nExec=/bin/a --x=1\nX-GNOME-Autostart-enabled=False\n[Other]\nName=B\n"
    assert rows(host.desktop_entries(spark, put(tmp_path / "a.desktop", text)), "name", "exec", "hidden") == [("A", "/bin/a --x=1", True)]
    assert rows(host.start_commands(spark, put(tmp_path / "rc", "#!/bin/sh\n\n a b\nexit 0\n")), "line_no", "command") == [(3, "a b")]
    assert rows(host.preloaded(spark, put(tmp_path / "pre", "/a.so  /b.so # c\n\n/d.so")), "line_no", "library") == [(1, "/a.so"), (1, "/b.so"), (3, "/d.so")]


def test_firewall_rules(spark, tmp_path):
    text = "-P INPUT DROP\n-A INPUT -p tcp --dport 22 -j ACCEPT\n-A LOG2 -g X\n-A OUTPUT\n-N x\n"
    want = [("policy INPUT (ipv4)", "Inbound", "DROP", None), ("-A INPUT -p tcp --dport 22 -j ACCEPT (ipv4)", "Inbound", "ACCEPT", "tcp"), ("-A LOG2 -g X (ipv4)", "LOG2", "X", None), ("-A OUTPUT (ipv4)", "Outbound", "(no target)", None)]
    assert rows(host.firewall_rules(spark, put(tmp_path / "f", text), "ipv4"), "name", "direction", "action", "protocol") == want


@pytest.mark.parametrize("text, want", [
    ('ID=ubuntu\nVERSION_ID="24.04"\nVERSION="24.04.1 LTS"\nNAME="Ubuntu"\n# ID=x', ("ubuntu", "Ubuntu 24.04.1 LTS", "Ubuntu:24.04:LTS")), ("ID=Debian\nVERSION_ID=12.5\nPRETTY_NAME='Deb \"x\"'", ("debian", 'Deb "x"', "Debian:12")),
    ("ID=alpine\nVERSION_ID=3.19.1", ("alpine", "Linux", "Alpine:v3.19")), ("ID=alpine\nVERSION_ID=3", ("alpine", "Linux", None)), ("ID=rhel", ("rhel", "Linux", None)),
])
def test_os_releases(spark, tmp_path, text, want):
    assert rows(host.os_releases(spark, put(tmp_path / "os", text)), "id", "shown", "ecosystem") == [want]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(octets.hash_list(F.lit("MD5=a, SHA256=b=c,x,MD5=d"))) == {"SHA256": "b=c", "MD5": "d"}
    assert one(octets.escape(F.lit("a b~*é/"))) == "a%20b~%2A%C3%A9%2F" and one(octets.unescape(F.lit("%zz"))) is None and one(octets.unescape(F.lit("a+b"))) == "a b"
    assert one(octets.exclusive_or(F.lit(b"\x00\xff\x10"), b"\x01\x02")) == b"\x01\xfd\x11" and one(octets.exclusive_or(F.lit(b""), b"k")) == b""
    assert one(F.unix_millis(logs.dot_net_date(F.lit("/Date(1704067200000+0100)/")))) == 1704067200000 and one(logs.dot_net_date(F.lit("garbage"))) is None
    assert one(policy.safe_argv(F.array(F.lit("a"), F.lit("b\0")))) is False and one(policy.safe_argv(F.array())) is False and one(policy.safe_argv(F.array(F.lit("a")))) is True
    assert one(policy.may_follow(policy.JOB, F.lit("failed"), F.lit("running"))) is False and one(policy.may_follow(policy.JOB, F.lit("queued"), F.lit("cancelled"))) is True
