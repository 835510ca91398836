"""Rules of states, roles, feeds and services as column functions. A null argument gives a null result unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may follow each state, roles with their permissions, and days that feeds stay fresh.
CHALLENGE = {"new": ("in_progress", "archived"), "in_progress": ("blocked", "solved", "archived"), "blocked": ("in_progress", "archived"), "solved": ("archived", "in_progress"), "archived": ("in_progress",)}
JOB = {"queued": ("preparing", "cancelled"), "preparing": ("running", "failed", "cancelled"), "running": ("succeeded", "failed", "cancelled", "timed_out", "interrupted")}
FRESH_DAYS = {"volatile": 2, "high_freq": 7, "standard": 14, "slow": 30}
ROLES = {
    "analyst": ("CaseRead", "EvidenceRead", "EvidenceAdd", "FindingCreate", "FindingConfirm", "ChatRead", "ChatWrite"),
    "responder": ("CaseRead", "EvidenceRead", "FindingCreate", "ChatRead", "ChatWrite"),
    "viewer": ("CaseRead", "EvidenceRead", "ChatRead"),
    "ctfparticipant": ("CtfIsolatedOnly", "ChatRead", "ChatWrite"),
}
#: Roles that may do all but these.
ALL_BUT = {"owner": (), "admin": ("CtfIsolatedOnly",), "lead": ("WorkspaceManage", "MemberRemove", "CtfIsolatedOnly")}


def may_follow(states: dict[str, tuple[str, ...]], state: Column, following: Column) -> Column:
    """Whether a state may change to the following one; each may stay as it is."""
    out = state == following
    for name, nexts in states.items():
        out = out | ((state == name) & following.isin(*nexts))
    return out


def may(role: Column, permission: Column) -> Column:
    """Whether a role has a permission; unknown roles are viewers."""
    name = F.replace(F.lower(role), F.lit("_"), F.lit(""))
    name = F.when(name.isin(*ROLES, *ALL_BUT), name).otherwise("viewer")
    out = F.lit(False)
    for known, own in ROLES.items():
        out = out | ((name == known) & permission.isin(*own))
    for known, barred in ALL_BUT.items():
        out = out | ((name == known) & (~permission.isin(*barred) if barred else F.lit(True)))
    return out


def stale(policy: Column, imported: Column, now: Column) -> Column:
    """Whether more whole days have passed since the import than the policy allows."""
    days = F.lit(None).cast("int")
    for name, n in FRESH_DAYS.items():
        days = F.when(policy == name, n).otherwise(days)
    return F.timestamp_diff("DAY", imported, now) > days


def open_to_hijack(path: Column) -> Column:
    """Whether a service's path has a space before the end of its program and no quotes around it."""
    path = F.trim(path)
    program = F.regexp_extract(path, r"(?is)^(.*?\.exe|.*)", 1)
    return ~path.rlike("^[\"']") & F.contains(program, F.lit(" "))


def safe_argv(argv: Column) -> Column:
    """Whether there are arguments, and none with a zero byte."""
    return (F.size(argv) > 0) & F.forall(argv, lambda a: ~F.contains(a, F.lit("\0")))


def case_access(asked: DataFrame, users: DataFrame, members: DataFrame, channels: DataFrame, teams: DataFrame) -> DataFrame:
    """The asked (case_id, user_id) that are allowed: owners and admins, members of the case, members of a team with a channel on it.

    The three ways are three joins on equal keys, whose results are put together; a condition of alternatives would compare all pairs.
    """
    asked = asked.select("case_id", "user_id").distinct()
    by_role = asked.join(users.where(F.lower("role").isin("owner", "admin")).select("user_id"), "user_id", "left_semi").select("case_id", "user_id")
    by_case = asked.join(members, ["case_id", "user_id"], "left_semi")
    own_teams = asked.join(teams.select("user_id", "team_id").distinct(), "user_id")
    by_team = own_teams.join(channels.select("case_id", "team_id"), ["case_id", "team_id"], "left_semi").select("case_id", "user_id")
    return by_role.union(by_case).union(by_team).distinct()


def rates(judged: DataFrame, category: str, real: str, found: str) -> DataFrame:
    """True and false positive rates of each category and their difference; a rate of nothing is 0."""
    n = lambda c: F.count_if(c).alias
    is_real, is_found = F.col(real), F.col(found)
    own = judged.groupBy(category).agg(n(is_real & is_found)("tp"), n(is_real & ~is_found)("fn"), n(~is_real & is_found)("fp"), n(~is_real & ~is_found)("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return own.withColumn("tpr", share("tp", "fn")).withColumn("fpr", share("fp", "tn")).withColumn("score", F.col("tpr") - F.col("fpr"))


# Ports of a quick scan, and those of a standard one, which is filled up with the lowest other ports.
QUICK_PORTS = (
    21, 22, 23, 25, 53, 80, 88, 110, 111, 135, 139, 143, 389, 443, 445, 465, 587, 636, 993, 995, 1433, 1521, 2049, 3306, 3389, 4444, 5432, 5900, 5985, 5986, 6379, 7001, 8080, 8443, 8888, 9090, 9200, 9300, 10250, 27017,
)
STANDARD_PORTS = (
    20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 88, 110, 111, 119, 123, 135, 137, 138, 139, 143, 161, 162, 179, 389, 443, 445, 465, 500, 514, 515, 520, 587, 631, 636, 873, 902, 989, 990, 993, 995, 1080, 1194, 1433, 1434, 1521, 1723, 2049, 2082, 2083,
    2086, 2087, 2181, 2222, 2375, 2376, 2483, 2484, 3000, 3128, 3268, 3269, 3306, 3389, 4000, 4444, 5000, 5432, 5672, 5900, 5984, 5985, 5986, 6000, 6379, 6667, 7000, 7001, 7077, 8000, 8008, 8080, 8081, 8443, 8500, 8888, 9000, 9042, 9090, 9092, 9100,
    9200, 9300, 9418, 9999, 10000, 10250, 11211, 27017, 50000, 50051, 51820,
)
STANDARD_SIZE, LAST_FILLED, LAST_PORT = 1000, 1024, 65_535


def filled_up_to() -> int:
    """The last port that a standard scan is filled up with."""
    own = set(STANDARD_PORTS)
    last = 0
    while len(own) < STANDARD_SIZE and last < LAST_FILLED:
        last += 1
        own.add(last)
    return last


def profile_ports(profile: Column) -> Column:
    """The ports of a scan's profile (Quick, Standard, Deep), in order; null for another."""
    listed = lambda ports: F.array(*map(F.lit, ports))
    standard = F.array_sort(F.array_union(listed(STANDARD_PORTS), F.sequence(F.lit(1), F.lit(filled_up_to()))))
    return F.when(profile == "Quick", listed(QUICK_PORTS)).when(profile == "Standard", standard).when(profile == "Deep", F.sequence(F.lit(1), F.lit(LAST_PORT)))


#: The members of a scenario's manifest.
MANIFEST = ("scenario_id", "title", "description", "difficulty", "signature")


def manifest(text: Column) -> Column:
    """A scenario's manifest in JSON: its members, or issue where it is none of texts for all of them, or isn't signed."""
    whole = F.try_parse_json(text)
    found = {n: F.when(F.schema_of_variant(F.try_variant_get(whole, f"$.{n}", "variant")) == "STRING", F.try_variant_get(whole, f"$.{n}", "string")) for n in MANIFEST}
    lacking = F.lit(False)
    for c in found.values():
        lacking = lacking | c.isNull()
    issue = F.when(lacking, "malformed").when(found["signature"] == "", "unsigned")
    return F.struct(*(F.when(issue.isNull(), c).alias(n) for n, c in found.items()), issue.alias("issue"))
