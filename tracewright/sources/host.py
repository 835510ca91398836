"""Text files of Linux hosts as tables. Paths may hold wildcards; each file is small, and files are dealt over tasks.

Lines that don't have the form of their file are left out; an empty file gives no rows. All columns are built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of TCP by code, shells without a login, and keys of timers in their order.
TCP_STATES = ("Established", "SynSent", "SynReceived", "FinWait1", "FinWait2", "TimeWait", "Closed", "CloseWait", "LastAck", "Listen", "Closing", "NewSynRecv")
NO_LOGIN = ("nologin", "false", "sync", "shutdown", "halt")
TIMER_KEYS = ("OnCalendar", "OnBootSec", "OnStartupSec", "OnUnitActiveSec", "OnUnitInactiveSec", "OnActiveSec")
LINE = r"\r?\n"


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no from 1, and line."""
    split = whole(spark, path).select("file", F.posexplode(F.split("value", LINE)).alias("line_no", "line"))
    return split.withColumn("line_no", F.col("line_no") + 1)


def number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def word(text: Column, k: int) -> Column:
    """The k-th 8 hexadecimal digits, their four bytes from last to first."""
    return F.concat(*(F.substring(text, 8 * k + j, 2) for j in (7, 5, 3, 1)))


def dotted(text: Column) -> Column:
    return F.concat_ws(".", *(number(F.substring(text, j, 2)).cast("string") for j in (1, 3, 5, 7)))


def colons(text: Column) -> Column:
    """The usual short form of an IPv6 address of 32 hexadecimal digits: its first longest run of zero groups becomes '::'."""
    full = F.concat_ws(":", *(F.lower(F.conv(F.substring(text, 4 * k + 1, 4), 16, 16)) for k in range(8)))

    def short(f: Column) -> Column:
        out = f
        for n in range(2, 9):
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
            out = F.when(f.rlike(run), F.regexp_replace(f, run, "$1::$2")).otherwise(out)
        return out

    mapped = F.lower(F.substring(text, 1, 24)) == "0" * 20 + "ffff"
    return F.when(mapped, F.concat(F.lit("::ffff:"), dotted(F.substring(text, 25, 8)))).otherwise(F.get(F.transform(F.array(full), short), F.lit(0)))


def address(text: Column) -> Column:
    """The address in front of the port, as the kernel prints it; null where it has another form."""
    return F.when(text.rlike("^[0-9A-Fa-f]{8}:"), dotted(word(text, 0))).when(text.rlike("^[0-9A-Fa-f]{32}:"), F.get(F.transform(F.array(F.concat(*(word(text, k) for k in range(4)))), colons), F.lit(0)))


def sockets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of /proc/net/tcp and its like."""
    p = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).where("line_no > 1").select("file", p.alias("p")).where(F.size("p") >= 10)
    at = {c: F.get("p", F.lit(k)) for c, k in (("local", 1), ("remote", 2), ("state", 3), ("uid", 7), ("inode", 9))}
    port = {c: number(F.regexp_extract(at[c], ":([0-9A-Fa-f]{1,4})$", 1)) for c in ("local", "remote")}
    code = number(F.when(at["state"].rlike("^[0-9A-Fa-f]{1,2}$"), at["state"]))
    name = F.coalesce(F.get(F.array(*map(F.lit, TCP_STATES)), (code - 1).cast("int")), F.lit("Unknown"))
    out = rows.select("file", address(at["local"]).alias("local_ip"), port["local"].alias("local_port"), address(at["remote"]).alias("remote_ip"), port["remote"].alias("remote_port"), code.alias("state_code"), name.alias("state"), at["uid"].try_cast("long").alias("uid"), at["inode"].try_cast("long").alias("inode"))
    return out.dropna()


def crontab(spark: SparkSession, path: str, system: bool) -> DataFrame:
    """Entries of crontabs; those of the system name a user after the schedule."""
    form = rf"^(@\S+|(?:\S+\s+){{4}}\S+)\s+{r'(\S+)\s+' if system else '()'}(\S.*)$"
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines(spark, path).withColumn("line", line).where(~F.col("line").rlike(r"^(#|[A-Za-z_][A-Za-z0-9_]*\s*=)") & F.col("line").rlike(form))
    user = F.regexp_extract("line", form, 2) if system else F.lit(None).cast("string")
    return rows.select("file", "line_no", F.regexp_replace(F.regexp_extract("line", form, 1), r"\s+", " ").alias("schedule"), user.alias("user"), F.regexp_extract("line", form, 3).alias("command"))


def packages(spark: SparkSession, path: str) -> DataFrame:
    """Installed packages of a dpkg status file, with the source package and its version."""
    rows = whole(spark, path).select("file", F.explode(F.split("value", r"\n\n")).alias("p")).select("file", F.split("p", LINE).alias("p"))

    def field(name: str) -> Column:
        # a field that is repeated counts as its last
        own = F.try_element_at(F.filter("p", lambda x: x.startswith(f"{name}:")), F.lit(-1))
        return F.trim(F.substring(own, len(name) + 2, 1 << 30))

    kept = {c: field(c) for c in ("Package", "Version", "Architecture", "Maintainer", "Source", "Status")}
    rows = rows.select("file", *(v.alias(c.lower()) for c, v in kept.items())).where("package IS NOT NULL AND version IS NOT NULL")
    rows = rows.where(F.get(F.split("status", r"\s+"), F.lit(2)) == "installed")
    form = r"^(.*?) \((.*?)\)*$"
    own = F.coalesce("source", "package")
    explicit = own.rlike(form)
    return rows.select(
        "file", F.col("package").alias("name"), "version", F.coalesce("architecture", F.lit("")).alias("arch"), F.coalesce("maintainer", F.lit("")).alias("maintainer"),
        F.trim(F.when(explicit, F.regexp_extract(own, form, 1)).otherwise(own)).alias("source_name"), F.when(explicit, F.trim(F.regexp_extract(own, form, 2))).otherwise(F.col("version")).alias("source_version"),
    )


def rpm_packages(spark: SparkSession, path: str) -> DataFrame:
    """Installed packages of a listing with tabs between name, epoch, version, release, arch, vendor, source and time of installation. Keys and shorter rows are left out."""
    p = F.split("value", "\t", -1)

    def field(k: int) -> Column:
        return F.get(p, F.lit(k))

    def known(k: int) -> Column:
        own = F.trim(field(k))
        return F.when(~own.isin("", "(none)"), own)

    rows = spark.read.text(path).where((F.size(p) >= 8) & ~field(0).isin("", "gpg-pubkey"))
    source = known(6)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), field(0).alias("name"), known(1).alias("epoch"), field(2).alias("version"), field(3).alias("release"), field(4).alias("arch"),
        F.coalesce(known(5), F.lit("")).alias("vendor"), source.alias("source"), F.nullif(F.regexp_extract(source, r"^(.+)-[^-]*-[^-]*\.(?:no)?src\.rpm$", 1), F.lit("")).alias("source_name"),
        F.trim(field(7)).try_cast("long").alias("installed"),
    )


def package_url(kind: str, distribution: Column, name: Column, version: Column, qualifiers: dict[str, Column]) -> Column:
    """The package URL of a package of a distribution; qualifiers that are null or empty are left out, the others stand by name."""

    def part(c: Column) -> Column:
        # form encoding differs from that of URLs in these
        out = F.url_encode(c)
        for form, own in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":")):
            out = F.replace(out, F.lit(form), F.lit(own))
        return out

    more = F.concat_ws("&", *(F.when(v != "", F.concat(F.lit(f"{k}="), part(v))) for k, v in sorted(qualifiers.items())))
    return F.concat(F.lit(f"pkg:{kind}/"), part(distribution), F.lit("/"), part(name), F.lit("@"), part(version), F.when(more != "", F.concat(F.lit("?"), more)).otherwise(""))


def _colons(spark: SparkSession, path: str, least: int) -> DataFrame:
    rows = lines(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    return rows.select("file", F.split("line", ":").alias("p")).where(F.size("p") >= least)


def users(spark: SparkSession, path: str) -> DataFrame:
    """Rows of passwd files, and whether the shell allows a login."""
    base = F.regexp_extract(F.trim("shell"), "([^/]*)$", 1)
    p = [F.get("p", F.lit(k)) for k in range(7)]
    rows = _colons(spark, path, 7).select("file", p[0].alias("name"), p[2].try_cast("long").alias("uid"), p[3].try_cast("long").alias("gid"), p[4].alias("gecos"), p[5].alias("home"), p[6].alias("shell"))
    return rows.where("uid IS NOT NULL AND gid IS NOT NULL").withColumn("login", (F.trim("shell") != "") & ~base.isin(*NO_LOGIN))


def user_groups(spark: SparkSession, path: str) -> DataFrame:
    """Rows of group files with their members."""
    members = F.filter(F.transform(F.split(F.get("p", F.lit(3)), ","), lambda m: F.trim(m)), lambda m: m != "")
    return _colons(spark, path, 4).select("file", F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(2)).try_cast("long").alias("gid"), members.alias("members")).where("gid IS NOT NULL")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, section, key and value of files with [sections]. Continued lines are joined; comments are left out."""
    from pyspark.sql.window import Window

    text = F.regexp_replace("value", r"(?m)^[ \t]*[#;].*$", "")
    text = F.regexp_replace(text, r"[ \t]*\\[ \t]*\r?\n[ \t]*", " ")
    rows = whole(spark, path).select("file", F.posexplode(F.split(text, LINE)).alias("line_no", "line")).withColumn("line", F.trim("line"))
    head = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1))
    # a file is small, and one task's own
    rows = rows.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no")))
    key, value = F.trim(F.regexp_extract("line", "^([^=]*)=", 1)), F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1))
    return rows.where(head.isNull() & F.contains("line", F.lit("="))).select("file", (F.col("line_no") + 1).alias("line_no"), F.coalesce("section", F.lit("")).alias("section"), key.alias("key"), value.alias("value"))


def timers(spark: SparkSession, path: str) -> DataFrame:
    """The schedule of each unit file with a [Timer]: its entries by kind, then as they stand."""
    rank = F.array_position(F.array(*map(F.lit, TIMER_KEYS)), F.col("key"))
    rows = sections(spark, path).where((F.col("section") == "Timer") & (rank > 0))
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "line_no", F.concat_ws("=", "key", "value").alias("entry"))))
    return rows.groupBy("file").agg(F.array_join(F.transform(listed, lambda x: x["entry"]), "; ").alias("schedule"))


def desktop_entries(spark: SparkSession, path: str) -> DataFrame:
    """name, exec and hidden of each file with a [Desktop Entry]; of repeated keys the last counts."""
    rows = sections(spark, path).where("section = 'Desktop Entry'")
    last = lambda key: F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("line_no")))
    off = ((F.col("key") == "Hidden") & (F.lower("value") == "true")) | ((F.col("key") == "X-GNOME-Autostart-enabled") & (F.lower("value") == "false"))
    return rows.groupBy("file").agg(last("Name").alias("name"), last("Exec").alias("exec"), F.bool_or(off).alias("hidden"))


def start_commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands of rc.local files."""
    rows = lines(spark, path).withColumn("command", F.trim("line"))
    return rows.where((F.col("command") != "") & ~F.col("command").startswith("#") & (F.col("command") != "exit 0")).select("file", "line_no", "command")


def preloaded(spark: SparkSession, path: str) -> DataFrame:
    """Libraries of ld.so.preload files, in order."""
    words = F.filter(F.split(F.regexp_replace("line", "#.*$", ""), r"\s+"), lambda w: w != "")
    return lines(spark, path).select("file", "line_no", F.explode(words).alias("library"))


def firewall_rules(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Policies and rules of `iptables -S` output."""
    p = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).withColumn("p", p).where(F.get("p", F.lit(0)).isin("-P", "-A") & (F.size("p") >= F.when(F.get("p", F.lit(0)) == "-P", 3).otherwise(2)))
    rest = F.slice("p", 3, F.size("p"))
    # a place from 1 is that of the next element from 0
    after = lambda flag: F.when(F.array_position(rest, flag) > 0, F.get(rest, F.array_position(rest, flag).cast("int")))
    is_policy, chain = F.get("p", F.lit(0)) == "-P", F.get("p", F.lit(1))
    name = F.when(is_policy, F.concat(F.lit("policy "), chain)).otherwise(F.trim("line"))
    direction = F.when(chain == "INPUT", "Inbound").when(chain == "OUTPUT", "Outbound").when(chain == "FORWARD", "Forward").otherwise(chain)
    action = F.when(is_policy, F.get("p", F.lit(2))).otherwise(F.coalesce(after("-j"), after("-g"), F.lit("(no target)")))
    return rows.select("file", "line_no", F.concat(name, F.lit(f" ({family})")).alias("name"), direction.alias("direction"), action.alias("action"), F.when(~is_policy, after("-p")).alias("protocol"))


def os_releases(spark: SparkSession, path: str) -> DataFrame:
    """id, name, version and the ecosystem of packages of each os-release file; empty where a value is absent."""
    own = F.filter(F.transform(F.split("value", LINE), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")) & ~x.startswith("#"))

    def value(name: str) -> Column:
        last = F.try_element_at(F.filter("l", lambda x: F.trim(F.substring_index(x, "=", 1)) == name), F.lit(-1))
        raw = F.trim(F.regexp_extract(last, "^[^=]*=(.*)$", 1))
        inner = F.regexp_replace(F.regexp_extract(raw, '^"(.*)"$', 1), r"\\(.)", "$1")
        return F.coalesce(F.when(raw.rlike('^".*"$'), inner).otherwise(F.regexp_replace(raw, "^'(.*)'$", "$1")), F.lit(""))

    rows = whole(spark, path).select("file", own.alias("l"))
    rows = rows.select("file", F.lower(value("ID")).alias("id"), value("NAME").alias("name"), value("VERSION").alias("version"), value("VERSION_ID").alias("version_id"), value("PRETTY_NAME").alias("pretty_name"))
    major, version = F.substring_index("version_id", ".", 1), F.col("version_id")
    lts = F.when(F.contains(F.concat("version", F.lit(" "), "pretty_name"), F.lit("LTS")), ":LTS").otherwise("")
    is_id = lambda name: F.col("id") == name
    ecosystem = (
        F.when(version == "", None).when(is_id("debian"), F.concat(F.lit("Debian:"), major)).when(is_id("ubuntu"), F.concat(F.lit("Ubuntu:"), version, lts))
        .when(is_id("almalinux"), F.concat(F.lit("AlmaLinux:"), major)).when(is_id("rocky"), F.concat(F.lit("Rocky Linux:"), major))
        .when(is_id("alpine") & F.contains(version, F.lit(".")), F.concat(F.lit("Alpine:v"), F.substring_index("version_id", ".", 2)))
        .when(is_id("opensuse-leap"), F.concat(F.lit("openSUSE:Leap "), version)).when(is_id("rhel"), F.lit("Red Hat"))
    )
    both = F.trim(F.concat_ws(" ", "name", "version"))
    shown = F.when(F.col("pretty_name") != "", F.col("pretty_name")).when(F.col("name") != "", both).otherwise("Linux")
    return rows.withColumn("shown", shown).withColumn("ecosystem", ecosystem)
