from pyspark.sql import functions as F

from tracewright.operators import facts
from tracewright.streaming import stateful

SCHEMA = "id int, user int, ts timestamp, v double"


def fold(rows):
    return facts.keyed_fold(rows, ["user"], "id", "ts", F.lit(0.5), "v")


def write(spark, path, rows):
    spark.createDataFrame(rows, "id int, user int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_followed_table_equals_one_fold_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    follow = stateful.Followed(spark, str(tmp_path / "out"), ["user"], fold, 4)
    write(spark, path, [(i, i % 5, f"2024-01-01 00:00:{i:02}", float(i)) for i in range(20)])
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    follow.follow(stream)
    # late and repeated rows
    write(spark, path, [(99, 2, "2023-01-01 00:00:00", 7.0), (3, 3, "2024-01-01 00:00:03", 3.0), (50, 9, "2024-02-01 00:00:00", 1.0)])
    got = follow.follow(stream)
    want = fold(spark.read.parquet(path))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # a batch that comes again changes nothing
    follow(spark.read.parquet(path).where("id IN (99, 50) OR id = 3 AND v < 0"), 1)
    assert spark.read.parquet(str(tmp_path / "out/folded")).count() == 6


def run(spark, df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_pairs_windows_and_duplicates(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, 1, "2024-01-01 00:00:00", 0.0), (2, 1, "2024-01-01 00:04:00", 0.0), (2, 1, "2024-01-01 00:04:00", 0.0), (3, 1, "2024-01-01 00:20:00", 0.0)])
    read = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    for k in ("a", "b", "c", "d"):
        (tmp_path / k).mkdir()
    pairs = stateful.close_pairs(read(), read(), "user", "ts", 300, "1 hour").where("id < r_id").select("id", "r_id")
    assert {tuple(r) for r in run(spark, pairs, tmp_path / "a").collect()} == {(1, 2)}
    once = stateful.without_duplicates(read(), ["id"], "ts", "1 hour").select("id")
    assert sorted(r[0] for r in run(spark, once, tmp_path / "b").collect()) == [1, 2, 3]
    tumbling = stateful.counts(read(), ["user"], "ts", "10 minutes", None, "1 hour").select("n")
    assert sorted(r[0] for r in run(spark, tumbling, tmp_path / "c", "complete").collect()) == [1, 3]
    gaps = stateful.sessions(read(), ["user"], "ts", "5 minutes", "1 hour").select("n")
    assert sorted(r[0] for r in run(spark, gaps, tmp_path / "d", "complete").collect()) == [1, 3]
