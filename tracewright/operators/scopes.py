"""Addresses and names against tables of scopes: blocks of IPv4 and IPv6, single addresses, and names.

A block is met by the first bits of an address, so an address is looked up once for each length that the table's blocks have, of which there are 33 and 129 at most: equal joins,
no comparison of every address with every block. Of blocks that hold an address the longest counts.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as the local host, by its start or whole.
LOCAL_START, LOCAL = "127.", ("localhost", "::1")


def _bits(text: str | None) -> str | None:
    try:
        own = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{int(own):0{own.max_prefixlen}b}"


def _block(text: str | None) -> str | None:
    head, slash, size = (text or "").partition("/")
    bits = _bits(head)
    if bits is None or (slash and not (size.isascii() and size.isdigit() and int(size) <= len(bits))):
        return None
    return f"{len(bits)}:{bits[: int(size) if slash else len(bits)]}"


def _each(work):
    def run(data: pa.Array) -> pa.Array:
        return pa.array([work(x) for x in data.to_pylist()], pa.string())

    run.__annotations__ = {"data": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType())


#: The bits of an address, and those of a block behind the number that an address of its kind has; null for what is neither.
bits_of, block_of = _each(_bits), _each(_block)

#: Parts over which the targets of one scope are dealt, and tasks of the last join, whose sides are far smaller than its rows.
PARTS, TASKS = 16, 64


def matches(targets: DataFrame, target: str, scopes: DataFrame, pattern: str) -> DataFrame:
    """targets with the columns of the scope whose pattern holds its target most closely: an equal name, or the longest block of an address. Others are left out.

    Of equal patterns the rows of each come out. What isn't an address matches the very same text alone, and a block that can't be one matches nothing.
    A target gets the name of its block first, and the rows of that block's scopes last, so that these go through no shuffle.
    """
    # a block's name is its bits, and a name's is its text behind another mark
    block = block_of(F.col(pattern))
    own = scopes.where(F.col(pattern).isNotNull()).withColumn("_name", F.coalesce(F.concat(F.lit("b"), block), F.when(~F.contains(pattern, F.lit("/")), F.concat(F.lit("n"), pattern)))).where("_name IS NOT NULL")
    names = own.select("_name").distinct()
    blocks = names.where("_name LIKE 'b%'").select("_name", F.substring_index(F.substring("_name", 2, 9), ":", 1).cast("int").alias("_wide"), F.length(F.substring_index("_name", ":", -1)).alias("_size"))
    # 162 rows at most
    sizes = F.broadcast(blocks.select("_wide", "_size").distinct().groupBy("_wide").agg(F.collect_set("_size").alias("_sizes")))
    distinct = targets.select(F.col(target).alias("_t")).where("_t IS NOT NULL").distinct().withColumn("_bits", bits_of("_t"))
    looked = distinct.where("_bits IS NOT NULL").withColumn("_wide", F.length("_bits")).join(sizes, "_wide").withColumn("_size", F.explode("_sizes"))
    looked = looked.select("_t", F.concat(F.lit("b"), "_wide", F.lit(":"), F.expr("substring(_bits, 1, _size)")).alias("_name"))
    # of blocks that hold an address the longest has the longest name
    by_block = looked.join(names, "_name", "left_semi").groupBy("_t").agg(F.max_by("_name", F.length("_name")).alias("_name"))
    by_name = distinct.where("_bits IS NULL").select("_t", F.concat(F.lit("n"), "_t").alias("_name")).join(names, "_name", "left_semi")
    met = targets.join(by_block.unionByName(by_name), F.col(target) == F.col("_t")).drop("_t")
    # maps have no hash
    plain = [f.name for f in targets.schema if "map<" not in f.dataType.simpleString()]
    met = met.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(PARTS)).cast("int")).repartition(TASKS, "_name", "_part")
    own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return met.join(own, ["_name", "_part"]).drop("_name", "_part")


def in_scope(targets: DataFrame, target: str, scopes: DataFrame, pattern: str) -> DataFrame:
    """targets with in_scope: whether any pattern holds its target; where there are no patterns, whether it is the local host."""
    inside = matches(targets.select(target).distinct(), target, scopes.select(pattern).distinct(), pattern).select(target).distinct().withColumn("_in", F.lit(True))
    some = scopes.where(F.col(pattern).isNotNull()).select(F.lit(True).alias("_some")).limit(1)
    out = targets.join(inside, target, "left").join(F.broadcast(some), how="left")
    return out.withColumn("in_scope", F.when(F.col("_some"), F.coalesce("_in", F.lit(False))).otherwise(F.coalesce(is_local(F.col(target)), F.lit(False)))).drop("_in", "_some")


def is_local(target: Column) -> Column:
    return target.startswith(LOCAL_START) | target.isin(*LOCAL)
