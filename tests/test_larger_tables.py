"""What showed on larger tables alone: sides that are sent whole, groups that outgrow a limit, work that is done again for each row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import verification
from tracewright.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scenario_criteria", "explained_scores"])
def test_expected_things_are_not_sent_whole(spark, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, DATA))


def test_things_expected_twice_and_missing_texts(spark):
    truth = spark.createDataFrame([(1, "Asset", "a", None), (1, "Asset", "a", None), (1, "Edge", "a", "b"), (1, "Edge", "a", None), (1, "Fact", None, None), (2, "Asset", "a", None)], "scenario int, criterion string, thing string, other string")
    facts = spark.createDataFrame([(1, "a", "Kind", None, 1, 0.5, None), (1, "b", None, None, 0, 0.5, None)], "scenario int, entity_key string, fact_type string, data string, evidence int, evidence_strength double, pain_level string")
    got = verification.criteria(truth, facts).select("scenario", F.split_part("name", F.lit(" "), F.lit(1)).alias("n"), "points", "most").collect()
    assert {tuple(r) for r in got} == {(1, "Assets", 40, 40), (1, "Attack", 20, 40), (1, "Fact", 0, 20), (1, "Evidence", 10, 20), (2, "Assets", 0, 20)}


def test_digests_of_dns_answers_are_taken_of_a_batch_at_once(monkeypatch):
    from tracewright.functions import blake3, protocols

    calls, own = [], blake3.digests
    monkeypatch.setattr(blake3, "digests", lambda contents: calls.append(len(contents)) or own(contents))
    answer = bytes.fromhex("c00c000100010000000000040a000000")
    message = bytes.fromhex("123481800001000200000000016100000100" + "01") + answer[:-1] + b"\x07" + answer[:-1] + b"\x08"
    found = protocols.dns_messages([message, None, message[:20], message])
    assert calls == [2] and found[1] is None and found[0] == found[3] == protocols.dns_message(message)
    assert [a["rdata_hash"] for a in found[0]["answers"]] == [own([b"\x0a\0\0\x07"])[0], own([b"\x0a\0\0\x08"])[0]]


def test_messages_of_a_stream_of_more_pieces_than_the_limit(spark, tmp_path):
    # 6,000 messages take more than 4,096 segments; the names of equal length make up a stream of 25
    rows = spark.range(6000).select((F.col("id") + 100000).cast("int").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), F.lit(3).alias("c_nationkey"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["dns_over_streams"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(3, 6000, sum(range(100000, 106000)), "building")]


def test_candidates_go_through_no_shuffle(spark):
    from tracewright.operators import scans

    products = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, None, 1), (2, None, 2), (3, None, 3), (4, 6, 1), (5, None, None), (4, 6, 9)], "product_id int, package int, cpe int")
    packages = spark.createDataFrame([(5, "A"), (5, "A"), (5, "B"), (7, "C")], "package int, cve string")
    cpes = spark.createDataFrame([(1, "X"), (2, "X"), (2, "Y"), (2, "Y")], "cpe int, cve string")
    got = scans.by_package_or_cpe(products, packages, cpes)
    assert sorted(map(tuple, got.collect())) == [(1, "A", "package"), (1, "B", "package"), (2, "X", "cpe"), (2, "Y", "cpe"), (4, "X", "cpe")]
    # nothing is made different behind the lists of candidates
    assert plan(got).index("Union") < plan(got).index("Aggregate")


@pytest.mark.parametrize("n_products, n_cves", [(200, 50), (3, 700), (700, 3)])
def test_products_of_one_name_are_dealt_over_tasks(spark, monkeypatch, n_products, n_cves):
    from tracewright.operators import scans

    monkeypatch.setattr(scans, "BUNCH", 16, raising=False)
    # twice, and of a name that has a CVE without an id
    products = spark.range(n_products).select(F.col("id").alias("product_id"), F.lit(None).cast("int").alias("package"), F.explode(F.array(F.lit(1), F.lit(1))).alias("cpe"))
    cpes = spark.range(n_cves).select(F.lit(1).alias("cpe"), F.when(F.col("id") > 0, F.concat(F.lit("CVE-"), F.col("id"))).alias("cve"))
    packages = spark.createDataFrame([(5, "A")], "package int, cve string")
    got = scans.by_package_or_cpe(products, packages, cpes).withColumn("task", F.spark_partition_id()).collect()
    in_task = [sum(r["task"] == t for r in got) for t in {r["task"] for r in got}]
    assert max(in_task) < len(got) / 4
    assert sorted((r["product_id"], r["cve"] or "") for r in got) == sorted((k, f"CVE-{c}" if c else "") for k in range(n_products) for c in range(n_cves))


def test_a_vector_is_split_once(spark):
    from tracewright.functions import scalar

    rows = spark.createDataFrame([("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",), ("CVSS:3.1/AV:P/AC:H/PR:L/UI:R/S:C/C:L/I:N/A:L",), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H",), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:Z/S:U/C:H/I:H/A:H",), (None,)], "v string")
    got = rows.select(scalar.cvss3(F.col("v")).alias("s"))
    assert [r[0] for r in got.collect()] == [9.8, 3.3, None, None, None]
    assert plan(got).count("str_to_map") == 1


def test_exclusive_or_is_no_expression_of_each_byte(spark):
    from tracewright.functions import octets, recipes

    texts = [b"", None, b"\xff", bytes(range(256)) * 40]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, d binary")
    got = rows.select("k", octets.exclusive_or(F.col("d"), b"abc").alias("x"), recipes.cook(F.col("d"), [("xor", b"K"), "hex_encode"]).alias("y"))
    assert "conv(" not in plan(got)
    for r in got.collect():
        own = texts[r["k"]]
        assert (r["x"] if own is None else bytes(r["x"])) == (None if own is None else bytes(b ^ b"abc"[i % 3] for i, b in enumerate(own)))
        assert (r["y"] if own is None else bytes(r["y"])) == (None if own is None else bytes(b ^ 75 for b in own).hex().encode())


def test_statistics_of_more_rows_than_are_counted_at_once(spark, monkeypatch):
    from tracewright.functions import octets

    monkeypatch.setattr(octets, "PART", 7)
    assert octets._whole(b"abc" * 11).tolist() == [11 * (k in b"abc") for k in range(256)]
    rows = spark.range(600).select("id", F.repeat(F.lit("ab"), F.col("id").cast("int")).alias("text")).coalesce(1)
    whole = octets.byte_statistics(rows, "id", F.col("text").cast("binary")).collect()
    assert [(r["id"], r["n_bytes"], r["most"]) for r in whole] == [(k, 2 * k, k) for k in range(1, 600)]
    assert [(r["id"], r["kinds"], r["entropy"]) for r in octets.char_statistics(rows, "id", F.col("text")).collect()] == [(k, 2, 1.0) for k in range(1, 600)]


def test_custody_of_repeated_records_and_several_sessions(spark):
    from tracewright.operators import stores

    artifacts = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, None), (1, 10)], "a int, session_id int")
    records = spark.createDataFrame([(None, 10, 100), (1, 11, 100), (3, 11, 101), (3, 11, 101), (9, None, 102), (2, None, 102), (2, 10, 103)], "a int, session_id int, record_id int")
    got = stores.custody(artifacts, records, "a")
    assert sorted(map(tuple, got.collect())) == [(1, 100), (1, 101), (1, 103), (2, 100), (2, 102), (2, 103), (3, 101)]
    assert "HashAggregate" not in plan(got)[: plan(got).index("Union")]


def test_states_of_builds_are_grouped_by_host_alone(spark):
    from tracewright.operators import scans

    hosts = spark.createDataFrame([(1, "w", 1, 5, ["A"]), (1, "x", 2, 9, None), (2, "w", 2, 5, ["K"]), (2, None, 1, 1, []), (3, "y", 1, 1, []), (None, "w", 1, 7, []), (4, "w", None, 3, ["S"])], "host int, product string, branch int, ubr int, kbs array<string>")
    fixes = spark.createDataFrame([("a", "w", 1, 6, "K", ["S"]), ("a", "x", 2, 8, None, None), ("a", "w", 1, 7, "Z", []), ("b", "w", 1, 6, "Q", ["R"]), ("c", "x", 3, 6, "A", ["R"]), ("d", None, 1, 1, "A", []), (None, "y", 1, 2, "B", [])], "cve string, product string, branch int, ubr int, kb string, superseding array<string>")
    got = scans.windows_builds(hosts, fixes)
    want = {(1, "a", "Patched", 6), (1, "b", "Vulnerable", 6), (1, "c", "Unverified", None), (2, "a", "Patched", None), (2, "b", "Unverified", None), (3, None, "Vulnerable", 2), (None, "a", "Patched", 6), (None, "b", "Patched", 6), (4, "a", "Patched", None), (4, "b", "Unverified", None)}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # what comes out is as many rows as hosts times CVEs, and nothing groups it
    assert "Aggregate" not in plan(got)[: plan(got).index("Join")]


def test_versions_to_go_to_are_found_within_rows(spark):
    from tracewright.functions import versions
    from tracewright.operators import vulnerabilities

    sets = [(1, ["1.9", "1.10", None, "x"]), (2, ["x"]), (3, []), (4, None), (5, ["1.0", "1.0.0", "1.0rc1"]), (6, ["2", "1!0", "2.post1"]), (7, ["1.0.dev1", "01.00"])]
    got = spark.createDataFrame(sets, "k int, v array<string>").select("k", vulnerabilities.largest(F.col("v"), "PyPI").alias("top"))
    assert dict(map(tuple, got.collect())) == {1: "1.10", 2: None, 3: None, 4: None, 5: "1.0.0", 6: "1!0", 7: "01.00"}
    # plain numbers have the key that they had
    same = spark.createDataFrame([("1.2.0",), ("0",), ("0.0",), ("10.0.3",)], "v string").where(versions.python_key(F.col("v")) == versions.python_key(F.concat(F.lit("v"), "v")))
    assert same.count() == 4
    # dependencies are read once, and advisories once
    assert plan(catalog.QUERIES["dependency_findings"](spark, DATA)).split("Initial Plan")[-1].count("FileScan") == 2


def test_manifests_of_a_small_table_are_dealt_out(spark):
    from tracewright.sources import manifests

    assert "Exchange" in plan(catalog.QUERIES["manifest_dependencies"](spark, DATA))
    # more files, and more rows of a file, than leave a task at once
    many = "".join(f"a{k}==1.{k}\n" for k in range(5000)).encode()
    files = spark.range(5000).select(F.concat(F.lit("p/"), F.col("id").cast("string"), F.lit("/requirements.txt")).alias("file"), F.lit(b"b==2\n").alias("content"))
    got = manifests.of_files(files.union(spark.createDataFrame([("q/requirements.txt", bytearray(many)), ("r/package.json", bytearray(b"{"))], "file string, content binary")).coalesce(1))
    assert {tuple(r) for r in got.groupBy("name").count().where("count > 1").collect()} == {("b", 5000)}
    assert got.where("file = 'q/requirements.txt'").agg(F.count("*"), F.sum("line")).collect()[0] == (5000, 12502500)


def test_an_event_is_parsed_once(spark):
    from tracewright.sources import records

    asked = spark.range(1).select(records.event_head(F.lit("{}")).alias("h"))._jdf.queryExecution().logical().toString()
    assert asked.count("parse_json") == 1
    twice = '{"Event": {"System": {"EventID": 1}, "EventData": {"A": "x", "N": 1, "Data": [{"Name": "A", "value": "y"}, {"@Name": "B", "#text": "z"}, {"#text": "no"}]}}}'
    got = spark.createDataFrame([(twice,), ("no json",), (None,), ('{"EventID": 4}',)], "raw string").select(records.event_head(F.col("raw"))["number"].alias("n"), records.event_data(F.col("raw")).alias("d"))
    assert [tuple(r) for r in got.collect()] == [(1, {"A": "y", "B": "z"}), (None, {}), (None, {}), (4, {})]


def test_texts_give_only_runs_that_needles_may_have(spark, monkeypatch):
    from tracewright.operators import needles

    texts = spark.createDataFrame([(k, f"{k} some words of a text that no needle has " * 20) for k in range(50)] + [(90, "x A Needle of more than sixteen bytes É"), (91, "wxyz"), (92, "a needle of more than sixteen byte")], "t int, text string")
    asked = spark.createDataFrame([(1, "wxyz"), (1, "needle of MORE than sixteen bytes é"), (2, "of more than sixteen byte"), (3, "zz")], "n int, needle string")
    # two needles of one id are looked for, each by a run of its own
    assert sorted(map(tuple, needles.found(asked, "n", "needle", texts, "t", "text").collect())) == [(1, 90), (1, 91), (2, 90), (2, 92)]
    wanted = asked.select(F.explode(needles.runs(F.lower("needle").cast("binary"))).alias("_run")).distinct()
    assert needles.held_runs(texts.select(F.col("t").alias("_t"), F.col("text").alias("_text")), wanted, False).select("_t").distinct().count() < 10
    # texts that lie over several parts
    monkeypatch.setattr(needles, "PART", 7)
    data = b"abcabcabc" + b"bc"
    hits = [(int(t), r) for own, runs in needles._hits(np.frombuffer(data, "u1"), np.array([9, 11]), [2, 9], np.ones(needles.PLACES, bool)) for t, r in zip(own, runs.to_pylist(), strict=True)]
    assert set(hits) == {(0, b"ab"), (0, b"bc"), (0, b"ca"), (1, b"bc"), (0, b"abcabcabc")}


def test_a_flow_is_read_once_and_its_instances_are_told_apart_in_its_task(spark):
    from tracewright.operators import reassembly

    # a flow that is opened again after its end, and one that is not ended before it is
    rows = [(0, "SYN", 6, b"", True), (1, "ACK", 7, b"one", True), (2, "ACK", 9, b"eno", True), (3, "FIN", 10, b"", False), (4, "ACK", 10, b"!", True), (5, "SYN", 90, b"", True), (6, "ACK", 91, b"two", True), (7, "SYN", 92, b"o", True), (8, "ACK", 5, b"ok", False)]
    schema = "file string, packet_index long, ts_us long, captured long, original long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, tcp_flags string, tcp_sequence long, payload binary, issue string"
    given = [("f", n, n, len(d), len(d), "a" if f else "b", "b" if f else "a", 1 if f else 2, 2 if f else 1, "TCP", flag, q, d, None) for n, flag, q, d, f in rows]
    both = [reassembly.reassembled(spark.createDataFrame(given, schema), issues=k) for k in (True, False)]
    for found in both:
        got = {(r["instance"], r["forward"]): (bytes(r["bytes"]), r["first_us"], r["last_us"], r["issue_packets"]) for r in reassembly.streams_of(found).collect()}
        assert got == {(0, True): (b"oneno", 1, 4, {"OverlapIdentical": 1, "OverlapConflict": 1}), (1, True): (b"two", 6, 7, {"OverlapConflict": 1}), (1, False): (b"ok", 8, 8, {})}
    counted = {(r["instance"], r["issue"]): r["n"] for r in reassembly.issues_of(both[0]).groupBy("instance", "issue").agg(F.count_distinct("second_packet").alias("n")).collect()}
    assert counted == {(r["instance"], k): n for r in reassembly.streams_of(both[1]).collect() for k, n in r["issue_packets"].items()} and counted
    assert reassembly.issues_of(both[1]).count() == 0
    own = plan(catalog.QUERIES["stream_bytes"](spark, DATA))
    assert own.count("MapInArrow") == 1 and "Window" not in own and "Join" not in own


def test_targets_of_one_scope_are_dealt_and_meet_its_rows_last(spark):
    from tracewright.operators import scopes

    targets = spark.range(3000).coalesce(1).select("id", F.create_map(F.lit("k"), "id").alias("m"), F.when(F.col("id") < 2000, "host").otherwise("10.1.2.3").alias("t"))
    table = spark.range(300).select(F.col("id").alias("scope"), F.element_at(F.array(F.lit("host"), F.lit("10.1.0.0/16"), F.lit("10.1.2.0/24")), (F.col("id") % 3).cast("int") + 1).alias("b"))
    got = scopes.matches(targets, "t", table, "b")
    assert sorted(map(tuple, got.groupBy("b").count().collect())) == [("10.1.2.0/24", 100_000), ("host", 200_000)]
    assert got.select(F.spark_partition_id()).distinct().count() > 4


def test_decoding_makes_no_string_of_each_letter(spark):
    from tracewright.functions import recipes

    texts = [b"0x4A 4b\n", b"0x0x0X41", b"4a4", b"4g", b"\xc3\xa9", b"Zm w=", b"-_-_", b"-_+/", b"Zh==", b"Zm\tw=", b"Zg==Zg==", b"\xff", None, b""]
    got = spark.createDataFrame([(x,) for x in texts], "d binary").select(recipes.cook(F.col("d"), ["hex_decode"]).alias("h"), recipes.cook(F.col("d"), ["base64_decode"]).alias("b"))
    plain = lambda x: None if x is None else bytes(x)
    assert [plain(r["h"]) for r in got.collect()] == [b"JK", b"A", *[None] * 11, b""]
    assert [plain(r["b"]) for r in got.collect()] == [None, b"\xd3\x1d1\xd1~5", None, None, None, b"fl", b"\xfb\xff\xbf", None, None, None, None, None, None, b""]
    assert "translate(" not in plan(got) and "RLIKE" not in plan(got)
