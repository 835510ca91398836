from pyspark.sql import functions as F

from tracewright.functions import scalar as S
from tracewright.operators import joins


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cvss_published_examples(spark):
    assert one(spark, S.cvss3(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"))) == 10.0
    assert one(spark, S.cvss3(F.lit("CVSS:3.0/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H"))) == 8.8
    assert one(spark, S.cvss3(F.lit("AV:N"))) is None


def test_semver_order(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0", "1.2", "1.10.0", "v2"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(S.semver_key(F.col("v"))).collect()
    assert [r["v"] for r in rows] == order


def test_windows_two_parts(spark):
    assert tuple(one(spark, S.windows_key(F.lit("19045.10")))) == (10, 0, 19045, 10)


def test_scope_without_blocks_is_the_local_host(spark):
    assert one(spark, S.in_scope(F.lit("127.0.0.1"), [])) is True
    assert one(spark, S.in_scope(F.lit("10.1.2.3"), [])) is False
    assert one(spark, S.ip4(F.lit("300.1.1.1"))) is None


def test_interval_join_truncates_and_includes(spark):
    a = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, None)], "k int, at string").withColumn("at", F.to_timestamp("at"))
    b = spark.createDataFrame([(1, "2024-01-01 00:05:00.9"), (1, "2024-01-01 00:05:01")], "k int, other string").withColumn("other", F.to_timestamp("other"))
    assert joins.interval_join(a, b, ["k"], "at", "other", 300).count() == 1


def test_range_join_with_open_ends(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 50.0)], "k int, v double")
    ranges = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 6.0), (1, 10.0, None), (1, 7.0, 7.0)], "k int, lo double, hi double")
    got = {(r["v"], r["lo"]) for r in joins.range_join(points, ranges, ["k"], "v", "lo", "hi", 2.0).collect()}
    assert got == {(5.0, 5.0), (50.0, 10.0)}
