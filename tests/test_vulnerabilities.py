from pyspark.sql import functions as F

from tracewright.operators import vulnerabilities as v


def test_intervals_of_events(spark):
    steps = [("r", 0, "0", None, None), ("r", 1, None, "2", None), ("r", 2, None, "2.5", None), ("r", 3, "3", None, None), ("r", 4, "4", None, None), ("r", 5, None, None, "5"), ("r", 6, "6", None, None), ("s", 0, None, "1", None)]
    events = spark.createDataFrame(steps, "id string, step int, introduced string, fixed string, last_affected string")
    got = {tuple(r) for r in v.intervals(events, ["id"]).collect()}
    assert got == {("r", None, "2", None), ("r", "3", None, None), ("r", "4", None, "5"), ("r", "6", None, None)}


def test_hits_fixes_and_targets(spark):
    packages = spark.createDataFrame([("a", "1.0"), ("a", "9"), ("b", "1"), (None, "1"), ("a", None), ("a", "odd one")], "name string, version string")
    ranges = spark.createDataFrame([("X", "a", None, "1.5", None, None), ("Y", "a", "0.5", "1.10", None, None), ("Z", "a", None, "0.1", None, ["odd one"]), ("W", "b", "1", None, None, None)], "id string, name string, introduced string, fixed string, last_affected string, versions array<string>")
    found = v.hits(packages, ranges, "PyPI")
    assert sorted((r.name, r.version, r.id) for r in found.collect()) == [("a", "1.0", "X"), ("a", "1.0", "Y"), ("a", "odd one", "Z"), ("b", "1", "W")]
    fixes = v.first_fix(found, ["name", "version", "id"], "PyPI")
    target = {(r.name, r.version): r.target for r in v.upgrade_target(fixes, ["name", "version"], "PyPI").collect()}
    assert target == {("a", "1.0"): "1.10", ("a", "odd one"): None, ("b", "1"): None}
    assert v.hits(packages.limit(0), ranges, "PyPI").count() == 0


def test_own_record_decides(spark):
    schema = "name string, id string, cve string"
    records = spark.createDataFrame([("a", "CVE-1", "CVE-1"), ("a", "ADV", "CVE-1"), ("a", "ADV", "CVE-2"), ("a", "CVE-3", "CVE-3"), ("a", "ADV", "CVE-3")], schema)
    found = records.where("id = 'ADV' OR id = 'CVE-3'")
    assert sorted((r.id, r.cve) for r in v.own_record_first(found, records, ["name"]).collect()) == [("ADV", "CVE-2"), ("ADV", "CVE-3"), ("CVE-3", "CVE-3")]


def test_enrichment_order_and_summary(spark):
    found = spark.createDataFrame([("CVE-1", "n", "High", 7.0, None, "2"), ("CVE-2", "n", "Critical", 9.0, True, None), ("CVE-3", "m", "High", None, None, None)], "id string, name string, severity string, cvss double, kev boolean, fix string")
    values = spark.createDataFrame([("UBUNTU-CVE-1", 0.3), ("DEBIAN-CVE-1", 0.9), ("CVE-2", 0.5), ("CVE-3", None)], "id string, epss double")
    rich = v.enrich(found, values, "epss")
    assert {r.id: r.epss for r in rich.collect()} == {"CVE-1": 0.3, "CVE-2": 0.5, "CVE-3": None}
    assert [r.id for r in rich.orderBy(*v.order()).collect()] == ["CVE-2", "CVE-1", "CVE-3"]
    assert tuple(v.summary(found).first()) == (3, 1, 2, 0, 0, 1, 2, 9.0)


def test_updates_and_aliases(spark):
    df = spark.createDataFrame([("K1", ["K1"], []), ("K1", ["K9"], ["K9"]), ("K1", ["K2"], None), ("K1", None, ["K9"])], "r string, i array<string>, s array<string>")
    assert [r[0] for r in df.select(v.updated(F.col("r"), F.col("i"), F.col("s"))).collect()] == [True, True, False, False]
    aliases = spark.createDataFrame([("G-1", "CVE-1"), ("O-1", "CVE-1"), ("O-2", None), ("P-1", "O-2"), ("Q", None)], "id string, alias string")
    got = {r.id: r.advisory for r in v.merged_advisories(aliases).collect()}
    assert got == {"CVE-1": "CVE-1", "G-1": "CVE-1", "O-1": "CVE-1", "O-2": "O-2", "P-1": "O-2", "Q": "Q"}
