"""Reads and changes of a workspace's tables: lookups, listings, details, states, invitations, memberships and what they record.

A change gives the new table; the sinks write it. Each is a join on keys or one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import policy
from . import windows


def listed(parents: DataFrame, children: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first children of each parent by order, as many as a page shows."""
    return windows.first_k(children.join(parents.select(key).distinct(), key, "left_semi"), [key], order, most)


def custody(artifacts: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records of an artifact: those of its own, and those of the session that it came in with; a record that is both counts once.

    What is counted once is found out by what an artifact and a record have of sessions, each a short list; the pairs themselves, which are far more than artifacts and records, go through no
    shuffle. Pairs that meet in several sessions are taken in the first of these.
    """
    came = artifacts.groupBy(key).agg(F.array_sort(F.collect_set("session_id")).alias("_came"))
    kept = records.groupBy("record_id").agg(F.array_sort(F.collect_set("session_id")).alias("_in"))
    at = F.explode("_in").alias("session_id")
    met = came.select(key, "_came", F.explode("_came").alias("session_id")).join(kept.select("record_id", "_in", at), "session_id")
    own = met.where(F.get(F.array_intersect("_came", "_in"), F.lit(0)) == F.col("session_id")).select(key, "record_id")
    direct = records.where(F.col(key).isNotNull()).select(key, "record_id").distinct().join(came, key).join(kept, "record_id", "left")
    return own.union(direct.where(~F.coalesce(F.arrays_overlap("_came", F.coalesce("_in", F.array().cast(kept.schema["_in"].dataType))), F.lit(False))).select(key, "record_id"))


def challenge_detail(challenges: DataFrame, artifacts: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each challenge with its number of artifacts, of jobs that are under way, of candidates, and the accepted flag."""
    count = lambda df, name: df.groupBy("challenge_id").agg(F.count("*").alias(name))
    found = candidates.groupBy("challenge_id").agg(F.count("*").alias("candidates"), F.min(F.when(F.col("state") == "accepted", F.col("value"))).alias("flag"))
    out = challenges
    for part in (count(artifacts, "artifacts"), count(jobs.where(F.col("state").isin("queued", "preparing", "running")), "active_jobs"), found):
        out = out.join(part, "challenge_id", "left")
    return out.select("challenge_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("artifacts", "active_jobs", "candidates")), "flag")


def with_states(table: DataFrame, wanted: DataFrame, key: str, states: dict[str, tuple[str, ...]]) -> DataFrame:
    """table with the wanted states of its rows where they may follow; changed says so, and is null where nothing was asked."""
    met = table.join(wanted.select(key, F.col("state").alias("_to")), key, "left")
    ok = policy.may_follow(states, F.col("state"), F.col("_to"))
    return met.withColumn("changed", F.when(F.col("_to").isNotNull(), ok)).withColumn("state", F.when(F.col("_to").isNotNull() & ok, F.col("_to")).otherwise(F.col("state"))).drop("_to")


def candidates(offered: DataFrame, expected: DataFrame) -> DataFrame:
    """Each value that is offered for a challenge once, trimmed and first come, and whether its digest is the expected one."""
    own = offered.withColumn("value", F.trim("value")).where("value <> ''").groupBy("challenge_id", "value").agg(F.min("at").alias("at"))
    met = own.join(expected, "challenge_id", "left")
    return met.select("challenge_id", "value", "at", F.when(F.sha2(F.col("value").cast("binary"), 256) == F.col("digest"), "accepted").otherwise("candidate").alias("state"))


def writeup(challenges: DataFrame, flags: DataFrame, steps: DataFrame) -> DataFrame:
    """A draft in Markdown for each challenge: its title, the accepted flags, and the steps in order."""
    lines = lambda df, order, text: df.groupBy("challenge_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("lines"))
    out = challenges.join(lines(flags, "value", "value").withColumnRenamed("lines", "_flags"), "challenge_id", "left").join(lines(steps, "step", "note").withColumnRenamed("lines", "_steps"), "challenge_id", "left")
    none = F.lit("- none")
    return out.select("challenge_id", F.concat(F.lit("# "), "title", F.lit("\n\n## Flags\n"), F.coalesce("_flags", none), F.lit("\n\n## Steps\n"), F.coalesce("_steps", none), F.lit("\n")).alias("markdown"))


def teams(teams_: DataFrame, members: DataFrame, presence: DataFrame) -> DataFrame:
    """Teams with how many members they have and how many of these are there now."""
    own = members.join(presence.where("online").select("user_id").distinct().withColumn("_on", F.lit(1)), "user_id", "left")
    counts = own.groupBy("team_id").agg(F.count("*").alias("members"), F.count("_on").alias("online"))
    return teams_.join(counts, "team_id", "left").select("team_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("members", "online")))


def valid(invitation: str = "") -> Column:
    """Whether an invitation is pending, not over, and has uses left; without a time or a number it has no end."""
    c = lambda name: F.col(f"{invitation}{name}")
    return (c("state") == "pending") & F.coalesce(c("expires") > c("now"), F.lit(True)) & F.coalesce(c("uses") < c("most"), F.lit(True))


def accept(invitations: DataFrame, accepting: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invitations and members after users (code, user_id, at) accept them, first come first served while uses are left; users that are members already use none."""
    new = accepting.join(invitations.where(valid()).select("code", "team_id", (F.coalesce(F.col("most"), F.lit(1 << 30)) - F.col("uses")).alias("_left")), "code").join(members.select("team_id", "user_id"), ["team_id", "user_id"], "left_anti")
    once = new.groupBy("code", "team_id", "user_id", "_left").agg(F.min("at").alias("at"))
    served = windows.first_k(once, ["code"], [F.asc("at"), F.asc("user_id")], 1 << 30).where(F.col("rank") <= F.col("_left"))
    used = served.groupBy("code").agg(F.count("*").alias("_n"))
    after = invitations.join(used, "code", "left").withColumn("uses", F.col("uses") + F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")
    return after, members.select("team_id", "user_id").union(served.select("team_id", "user_id")).distinct()


def transfer(members: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and records of an audit after owners (team_id, from_id, to_id) give teams to members; only an owner gives, and only to a member."""
    owners, others = members.where("role = 'owner'").select("team_id", F.col("user_id").alias("from_id")), members.select("team_id", F.col("user_id").alias("to_id"))
    done = transfers.join(owners, ["team_id", "from_id"], "left_semi").join(others, ["team_id", "to_id"], "left_semi")
    given, taken = done.select("team_id", F.col("from_id").alias("user_id"), F.lit("admin").alias("_r")), done.select("team_id", F.col("to_id").alias("user_id"), F.lit("owner").alias("_r"))
    after = members.join(given.union(taken), ["team_id", "user_id"], "left").select("team_id", "user_id", F.coalesce("_r", "role").alias("role"))
    return after, done.select("team_id", F.concat(F.lit("ownership "), F.col("from_id").cast("string"), F.lit(" -> "), F.col("to_id").cast("string")).alias("action"))


def without(table: DataFrame, gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """table and the tables that point to it, without the rows of the keys that are gone."""
    return [t.join(gone.select(key), key, "left_anti") for t in (table, *children)]


def lineage(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, ancestor and distance: what each id was made from (edges child, parent), up to depth steps back; of several ways the shortest."""
    reached = start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    front = reached
    for k in range(1, depth + 1):
        front = front.join(edges, F.col("ancestor") == F.col("child")).select("id", F.col("parent").alias("ancestor"), F.lit(k).alias("distance")).distinct()
        reached = reached.union(front)
    return reached.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))


def thread(messages: DataFrame, entity: Column) -> DataFrame:
    """Messages that refer to an entity or whose text holds its id."""
    return messages.where(F.coalesce(F.array_contains("refs", entity), F.lit(False)) | F.coalesce(F.contains("text", entity), F.lit(False)))


def feeds(status: DataFrame, now: Column) -> DataFrame:
    """Each feed with its rows and whether it is stale by the policy of its kind."""
    return status.select("feed", "records", policy.stale(F.col("kind"), F.col("imported"), now).alias("stale"))


def digest_or_too_large(content: Column, most: int) -> Column:
    return F.when(F.octet_length(content) <= most, F.sha2(content, 256)).otherwise("TooLarge")


def challenge_listing(challenges: DataFrame, category: str | None = None) -> DataFrame:
    """Challenges (id, competition_id, name, category, points, status, target_host, created_at), of one category if one is given: whether each has a target, and its place in its competition by points and age."""
    own = challenges if category is None else challenges.where(F.col("category") == category)
    place = F.row_number().over(Window.partitionBy("competition_id").orderBy(F.asc("points"), F.asc("created_at"), F.asc("id")))
    return own.select("id", "competition_id", "name", "category", "points", "status", F.col("target_host").isNotNull().alias("has_target"), place.alias("place"))
