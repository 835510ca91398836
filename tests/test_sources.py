from pyspark.sql import functions as F

from tracewright.sources import feeds, host, projects, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_sockets(spark, tmp_path):
    head = "  sl  local_address rem_address   st tx_queue rx_queue tr tm->when retrnsmt   uid  timeout inode\n"
    row = "   {}: {} {} {} 00000000:00000000 00:00000000 00000000  101        0 2345 1\n"
    text = head + row.format(0, "0100007F:0035", "00000000:0000", "0A") + row.format(1, "00000000000000000000000001000000:0016", "0000000000000000FFFF00000100007F:01BB", "01") + row.format(2, "B80D01200000000000000000010000AA:0001", "zz:1", "0A") + "short\n"
    got = rows(host.sockets(spark, put(tmp_path / "tcp", text)), "local_ip", "local_port", "remote_ip", "remote_port", "state", "uid", "inode")
    assert got == [("127.0.0.1", 53, "0.0.0.0", 0, "Listen", 101, 2345), ("::1", 22, "::ffff:127.0.0.1", 443, "Established", 101, 2345)]


def test_short_form_of_addresses(spark):
    import ipaddress

    texts = ["00" * 16, "20010db8" + "00" * 11 + "01", "20010db8000000010000000000010000", "00010000000000020000000000030004", "fe80" + "00" * 6 + "0202b3fffe1e8329", "0001" * 8, "0001000200030004000500060000" + "0007"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(host.colons(F.col("t"))).collect()] == [str(ipaddress.IPv6Address(bytes.fromhex(t))) for t in texts]


def test_crontab(spark, tmp_path):
    path = put(tmp_path / "cron", "# c\nSHELL=/bin/sh\n\n17 *\t* * *  root  cd / && run x=1\n@reboot root /bin/up now\n1 2 3\n")
    assert rows(host.crontab(spark, path, True), "line_no", "schedule", "user", "command") == [(4, "17 * * * *", "root", "cd / && run x=1"), (5, "@reboot", "root", "/bin/up now")]
    assert rows(host.crontab(spark, path, False), "schedule", "user", "command")[0] == ("17 * * * *", None, "root  cd / && run x=1")


def test_packages(spark, tmp_path):
    text = "Package: libc6\nStatus: install ok installed\nSource: glibc (2.39-0)\nVersion: 2.39-1\nDescription: a\n Version: no\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n\nPackage: b\nStatus: install ok installed\nVersion: 3\nArchitecture: all\n"
    assert rows(host.packages(spark, put(tmp_path / "status", text)), "name", "version", "arch", "source_name", "source_version") == [("libc6", "2.39-1", "", "glibc", "2.39-0"), ("b", "3", "all", "b", "3")]


def test_users_and_groups(spark, tmp_path):
    passwd = put(tmp_path / "passwd", "root:x:0:0:root:/root:/bin/bash\n#no\nd:x:1:1:d:/:/usr/sbin/nologin\nbad:x:q:1:d:/:/bin/sh\ne:x:5:5::/:\n")
    assert rows(host.users(spark, passwd), "name", "uid", "login") == [("root", 0, True), ("d", 1, False), ("e", 5, False)]
    assert rows(host.user_groups(spark, put(tmp_path / "group", "sudo:x:27:ann, bob,\nx:y\n")), "name", "gid", "members") == [("sudo", 27, ["ann", "bob"])]


def test_feeds(spark, tmp_path):
    csv = put(tmp_path / "e.csv", "#model_version:v1\ncve,epss,percentile\nCVE-1,0.5,0.25\nCVE-2,x,1\n\nCVE-3,0.125\n")
    assert rows(feeds.scores(spark, csv), "cve", "epss", "percentile") == [("CVE-1", 0.5, 0.25)]
    logs = feeds.json_logs(spark, put(tmp_path / "l.json", '{"a": 1}\nnot json\n\n'))
    assert rows(logs.select(F.expr("try_variant_get(record, '$.a', 'int')").alias("a"), "raw"), "a", "raw") == [(1, '{"a": 1}'), (None, "not json")]
    kev = put(tmp_path / "k.json", '{"vulnerabilities": [{"cveID": "CVE-9", "product": "p"}, {"product": "q"}]}')
    assert rows(feeds.exploited(spark, kev), "cveID", "product") == [("CVE-9", "p")]
    osv = put(tmp_path / "o.json", '{"id": "G-1", "affected": [{"package": {"ecosystem": "PyPI", "name": "n"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}')
    assert rows(feeds.advisories(spark, osv), "id", "name", "step", "introduced", "fixed") == [("G-1", "n", 0, "0", None), ("G-1", "n", 1, None, "2")]
    xml = put(tmp_path / "n.xml", '<nmaprun><host><status state="up"/><address addr="AA" addrtype="mac"/><address addr="10.0.0.1" addrtype="ipv4"/><ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh"/></port><port protocol="udp" portid="53"><state state="closed"/></port></ports></host></nmaprun>')
    assert rows(feeds.scanned_ports(spark, xml), "ip", "port", "state", "service") == [("10.0.0.1", 22, "open", "ssh"), ("10.0.0.1", 53, "closed", None)]
    heads = spark.createDataFrame([(bytearray(b"ElfFile\0x"),), (bytearray.fromhex("d4c3b2a1"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in heads.select(feeds.sniff(F.col("c"))).collect()] == ["evtx", "pcap_us_le", "unknown"]


def test_sinks(spark, tmp_path):
    df = lambda *r: spark.createDataFrame(r, "k int, at int, v string")
    read = lambda t: sorted((tuple(r) for r in t.read().collect()), key=str)
    t = sinks.Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.insert_absent(df((1, 2, "b"), (1, 1, "a"), (None, 1, "n")), ["k"], ["at"])
    t.insert_absent(df((1, 0, "z"), (2, 1, "c"), (None, 0, "m")), ["k"], ["at"])
    assert read(t) == [(1, 1, "a"), (2, 1, "c"), (None, 1, "n")]
    t.upsert(df((1, 0, "new"), (3, 1, "d")), ["k"], ["at"])
    assert read(t) == [(1, 0, "new"), (2, 1, "c"), (3, 1, "d"), (None, 1, "n")]
    t.replace_partitions(df((1, 7, "x"), (2, 9, "y")), "at")
    t.append(df((4, 4, "e")))
    assert read(t) == [(1, 0, "new"), (1, 7, "x"), (2, 1, "c"), (2, 9, "y"), (3, 1, "d"), (4, 4, "e"), (None, 1, "n")]


def test_rpm_packages_and_package_urls(spark, tmp_path):
    text = "a-libs\t1\t3.0~rc\t2.el9\tx86_64\tRocky\tmy-a-3.0-2.el9.src.rpm\t17\ngpg-pubkey\t\t\t\t\t\t\t\nshort\t1\nb+\t(none)\t1:2\t1\tnoarch\t(none)\t(none)\tx\n"
    df = host.rpm_packages(spark, put(tmp_path / "rpm", text))
    assert rows(df, "name", "epoch", "version", "release", "arch", "vendor", "source_name", "installed") == [("a-libs", "1", "3.0~rc", "2.el9", "x86_64", "Rocky", "my-a", 17), ("b+", None, "1:2", "1", "noarch", "", None, None)]
    url = host.package_url("rpm", F.lit("rocky"), F.col("name"), F.concat_ws("-", "version", "release"), {"epoch": F.col("epoch"), "arch": F.col("arch"), "upstream": F.col("source")})
    assert rows(df, url) == [("pkg:rpm/rocky/a-libs@3.0~rc-2.el9?arch=x86_64&epoch=1&upstream=my-a-3.0-2.el9.src.rpm",), ("pkg:rpm/rocky/b%2B@1:2-1?arch=noarch",)]
    assert spark.range(1).select(host.package_url("deb", F.lit("debian"), F.lit("a b*"), F.lit("1"), {})).first()[0] == "pkg:deb/debian/a%20b%2A@1"


def test_dated_scores_and_vendor_ranges(spark, tmp_path):
    (tmp_path / "e").mkdir()
    put(tmp_path / "e" / "a.csv", "#model_version:v1,score_date:2024-07-15T00:00:00+0000\ncve,epss,percentile\nCVE-1,0.5,0.25\n")
    put(tmp_path / "e" / "b.csv", "cve,epss,percentile\nCVE-2,0.25,0.5\n")
    assert sorted(rows(feeds.dated_scores(spark, str(tmp_path / "e")), "cve", "epss", F.col("score_date").cast("string"))) == [("CVE-1", 0.5, "2024-07-15"), ("CVE-2", 0.25, None)]
    text = '[{"advisory_id": "U-1", "cve_id": "CVE-1", "ecosystem": "UBUNTU", "package_name": "a", "fixed_version": "2"}, {"advisory_id": "U-2", "cve_id": "CVE-1", "ecosystem": "rhel", "package_name": "a"}, {"advisory_id": "U-3", "cve_id": "CVE-2", "ecosystem": "x", "package_name": "b", "release": "9", "fixed_version": "3"}]'
    assert rows(feeds.vendor_ranges(spark, put(tmp_path / "v.json", text)), "advisory_id", "ecosystem", "introduced", "fixed", "release") == [("U-1", "Ubuntu", None, "2", None), ("U-3", "Generic", None, "3", "9")]


def test_python_imports(spark):
    main = "import os, numpy as np, own.x  # import no\nfrom yaml.a import b\n\'\'\'\nimport quoted\n\'\'\'\nfrom . import z\n  import requests; import q\nimport numpy\nx = \"\"\"import inside\"\"\"\nfrom app import y\n".replace("\\'", "'")
    files = [("p/app/main.py", main), ("p/app/b.py", "\nimport numpy\r\nimport attrs\r\n"), ("p/own/x.py", ""), ("p/tests/test_a.py", "import pytest"), ("p/c.txt", "import text"), ("p/n.py", None), ("p/long.py", '"""' + "import a\n" * 50_000 + '"""\nimport yaml\n')]
    df = spark.createDataFrame(files, "file string, value string")
    got = sorted(map(tuple, projects.python_imports(df).collect()))
    assert got == [("attrs", "p/app/b.py", 3, 1), ("numpy", "p/app/b.py", 2, 2), ("requests", "p/app/main.py", 7, 1), ("yaml", "p/app/main.py", 2, 2)]
    assert {r.module for r in projects.python_imports(df, True).collect()} == {"attrs", "numpy", "requests", "yaml", "pytest"}
    assert projects.python_imports(df.limit(0)).count() == 0
