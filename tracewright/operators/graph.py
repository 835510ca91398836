"""Nodes, edges, layers, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nodes(parts: list[DataFrame]) -> DataFrame:
    """Distinct (id, kind, label) with the smallest label of an id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("id", "kind").agg(F.min("label").alias("label"), F.count("*").alias("n"))


def layer(nodes_: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges (src, dst) both of whose ends are nodes of these kinds."""
    own = nodes_.where(F.col("kind").isin(kinds)).select("id").distinct()
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the driver and all executors share; a temporary folder only where everything runs on one machine, until that run ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written once and read again, so that neither a lost executor nor a second use computes it anew."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """id and component, the smallest id that its edges (src, dst) reach. Stars are contracted until nothing changes; each round is written."""
    e = kept(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    alone = e.where("a = b").select("a")
    e = e.where("a > b")
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        e = kept(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select("b").union(alone).distinct().join(e.select("a"), F.col("b") == F.col("a"), "left_anti")
    return e.toDF("id", "component").union(roots.select("b", "b"))


def with_edges(labels: DataFrame, added: DataFrame) -> DataFrame:
    """labels (id, component), as components gives them, after edges (src, dst) were added: only components that the new edges connect change, and new ids come in.

    The new edges are followed between components, from smallest id to smallest id, so the work grows with them and not with what was there.
    """
    ends = added.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    ends = kept(ends)
    at = [ends.toDF(end, f"_{end}") for end in ("src", "dst")]
    between = added.where("src IS NOT NULL AND dst IS NOT NULL").join(at[0], "src").join(at[1], "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).where("src <> dst").distinct()
    moved = kept(components(between).where("id <> component")).toDF("component", "_to")
    new = ends.join(labels.select("id"), "id", "left_anti")
    return labels.union(new).join(moved, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))


def without_edges(labels: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """labels after edges were removed from edges, which are those that there were: the components that lost one are computed again from the edges they have left, others stay.

    An id stays, by itself where nothing holds it any more. Of an edge that is there several times all go; its direction doesn't matter.
    """
    way = lambda e: e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    gone = kept(way(removed))
    touched = kept(labels.join(gone.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi").select("component").distinct())
    members = kept(labels.join(touched, "component", "left_semi").select("id"))
    left = way(edges).join(gone, ["src", "dst"], "left_anti").join(members.withColumnRenamed("id", "src"), "src", "left_semi")
    again = components(left.union(members.select("id", "id")).toDF("src", "dst"))
    return labels.join(touched, "component", "left_anti").select("id", "component").union(again.select("id", "component"))
