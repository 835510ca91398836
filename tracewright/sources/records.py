"""Records of Windows events, vulnerability databases, processes and Windows collectors as columns. All run in the JVM.

They work on columns of text, so that it doesn't matter whether a file, a table or a stream holds them. A text that isn't of its form gives null or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bound

NUMBER, BOOLEAN = "int", "boolean"
_PERSON = {"subject_user_name": "SubjectUserName", "subject_domain_name": "SubjectDomainName"}
_SERVICE = {"service_name": "ServiceName", "service_file_name": ("ImagePath", "ServiceFileName"), "service_type": "ServiceType", "start_type": "StartType", "service_account": "ServiceAccount"}
#: What events are called, by number and by where they come from, and the fields of each by the names of its data.
EVENTS: dict[tuple[str, int], tuple[str, dict]] = {
    ("Security", 4624): ("logon_success", {
        "target_user_name": "TargetUserName", "target_domain_name": "TargetDomainName", "logon_type": ("LogonType", NUMBER), "ip_address": "IpAddress", "ip_port": "IpPort", "workstation_name": "WorkstationName", "logon_process_name": "LogonProcessName",
    }),
    ("Security", 4688): ("process_create", {"new_process_name": "NewProcessName", "command_line": "CommandLine", "parent_process_name": "ParentProcessName", **_PERSON, "token_elevation_type": "TokenElevationType"}),
    ("Security", 4697): ("service_installed", _SERVICE),
    ("Security", 4720): ("user_account_created", {"target_user_name": "TargetUserName", **_PERSON}),
    ("System", 7045): ("service_installed", _SERVICE),
    ("Sysmon", 1): ("process_create", {"image": "Image", "command_line": "CommandLine", "parent_image": "ParentImage", "parent_command_line": "ParentCommandLine", "current_directory": "CurrentDirectory", "user": "User", "hashes_raw": "Hashes"}),
    ("Sysmon", 3): ("network_connection", {"image": "Image", "protocol": "Protocol", "source_ip": "SourceIp", "source_port": ("SourcePort", NUMBER), "destination_ip": "DestinationIp", "destination_port": ("DestinationPort", NUMBER), "user": "User"}),
    ("Sysmon", 7): ("image_load", {"image": "Image", "image_loaded": "ImageLoaded", "signed": ("Signed", BOOLEAN), "signature_status": "SignatureStatus", "hashes_raw": "Hashes"}),
    ("Sysmon", 10): ("process_access", {"source_image": "SourceImage", "target_image": "TargetImage", "granted_access": "GrantedAccess", "call_trace": "CallTrace"}),
    ("Sysmon", 11): ("file_create", {"image": "Image", "target_filename": "TargetFilename", "creation_utc_time": "CreationUtcTime"}),
    ("Sysmon", 22): ("dns_query", {"image": "Image", "query_name": "QueryName", "query_status": "QueryStatus", "query_results": "QueryResults"}),
}


def _member(whole: Column, kind: str, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(whole, p, kind) for p in paths))


def event_head(raw: Column) -> Column:
    """number, provider, channel, computer, user, record number and time of an event in JSON, whether its System stands under Event or on top."""
    both = lambda tail: [f"$.Event.System{tail}", f"$.System{tail}"]
    named = lambda one, attribute: [p for k in (f".{one}['#attributes'].{attribute}", f".{one}['@{attribute}']", f".{one}.{attribute}") for p in both(k)]
    # parsed once, however many members are looked for
    return bound(F.try_parse_json(raw), lambda whole: F.struct(
        _member(whole, "int", *both(".EventID"), *both(".EventID['#text']"), "$.EventID").alias("number"), _member(whole, "string", *named("Provider", "Name")).alias("provider"), _member(whole, "string", *both(".Channel"), "$.Channel").alias("channel"),
        _member(whole, "string", *both(".Computer")).alias("computer"), _member(whole, "string", *named("Security", "UserID")).alias("user_sid"), _member(whole, "long", *both(".EventRecordID")).alias("record_id"),
        F.to_timestamp(_member(whole, "string", *named("TimeCreated", "SystemTime"))).alias("time"),
    ))


def event_data(raw: Column) -> Column:
    """The named texts of an event's data as a map: its members, and the items of its list Data by their names; the last of a name counts."""
    own = F.coalesce(F.get_json_object(raw, "$.Event.EventData"), F.get_json_object(raw, "$.EventData"))
    return bound(own, lambda o: bound(_named_texts(o), lambda every: F.map_from_entries(_last_of_each(every))))


def _named_texts(own: Column) -> Column:
    members = F.from_json(own, "map<string,variant>")
    plain = F.filter(F.map_entries(members), lambda e: F.schema_of_variant(e["value"]) == "STRING")
    plain = F.transform(plain, lambda e: F.struct(e["key"].alias("k"), F.try_variant_get(e["value"], "$", "string").alias("v")))
    item = "array<struct<`#attributes`:struct<Name:string>,`@Name`:string,Name:string,`#text`:string,value:string>>"
    listed = F.from_json(F.get_json_object(own, "$.Data"), item)
    pairs = F.transform(listed, lambda i: F.struct(F.coalesce(i["#attributes"]["Name"], i["@Name"], i["Name"]).alias("k"), F.coalesce(i["#text"], i["value"]).alias("v")))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    return F.filter(F.concat(F.coalesce(plain, empty), F.coalesce(pairs, empty)), lambda p: p["k"].isNotNull())


def _last_of_each(every: Column) -> Column:
    return F.filter(every, lambda p, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda q: q["k"] == p["k"]))


def observations(records: DataFrame, raw: str) -> DataFrame:
    """records with head, the event's kind, its data, and details, the fields of that kind as JSON (no fields for kinds that aren't known)."""
    own = records.withColumn("head", event_head(F.col(raw))).withColumn("data", event_data(F.col(raw)))
    number, channel = F.col("head.number"), F.coalesce(F.col("head.channel"), F.lit(""))
    sysmon = F.contains(channel, F.lit("Sysmon")) | F.contains(F.coalesce(F.col("head.provider"), F.lit("")), F.lit("Sysmon"))
    kind, details = F.lit("windows_event"), F.lit("{}")
    for (source, n), (name, fields) in EVENTS.items():
        here = (number == n) & (sysmon if source == "Sysmon" else (channel == source) | ((n == 7045) & (F.col("head.provider") == "Service Control Manager")))
        kind, details = F.when(here, name).otherwise(kind), F.when(here, F.to_json(F.struct(*(_field(k, v) for k, v in fields.items())))).otherwise(details)
    return own.withColumn("kind", kind).withColumn("details", details)


def _field(name: str, given: str | tuple) -> Column:
    names, cast = (given, None) if isinstance(given, str) else (given[:1], given[1]) if given[-1] in (NUMBER, BOOLEAN) else (given, None)
    names = (names,) if isinstance(names, str) else names
    found = F.coalesce(*(F.try_element_at("data", F.lit(n)) for n in names))
    return (found if cast is None else found.try_cast(cast)).alias(name)


_SCORE = "array<struct<cvssData:struct<baseScore:double,vectorString:string>>>"
_CVE = (
    "struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:" + _SCORE + ",cvssMetricV30:" + _SCORE + ">,"
    "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>>"
)


def cves(documents: DataFrame, raw: str) -> DataFrame:
    """id, summary, score, vector, names of products and time of each CVE of documents that hold one or an envelope of many.

    The English description or else the first; scores of version 3.1 before those of 3.0.
    """
    one, many = F.from_json(F.col(raw), _CVE), F.from_json(F.col(raw), f"struct<vulnerabilities:array<struct<cve:{_CVE}>>>")
    items = F.coalesce(F.transform(many["vulnerabilities"], lambda v: v["cve"]), F.array(one))
    own = documents.select(F.explode(items).alias("c")).where("c.id IS NOT NULL")
    said = F.coalesce(F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"], F.get("c.descriptions", F.lit(0))["value"], F.lit(""))
    score = F.coalesce(F.get("c.metrics.cvssMetricV31", F.lit(0)), F.get("c.metrics.cvssMetricV30", F.lit(0)))["cvssData"]
    nodes = F.flatten(F.transform("c.configurations", lambda g: g["nodes"]))
    criteria = F.flatten(F.transform(nodes, lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))
    return own.select("c.id", said.alias("summary"), score["baseScore"].alias("cvss"), score["vectorString"].alias("vector"), F.coalesce(criteria, F.array().cast("array<string>")).alias("cpes"), F.to_timestamp("c.published").alias("published"))


def monthly_fixes(documents: DataFrame, raw: str) -> DataFrame:
    """A row for each CVE, product and fix of monthly documents: document, cve, title, product_id, product, kb, build and severity."""
    schema = (
        "struct<DocumentTracking:struct<Identification:struct<ID:struct<Value:string>>>,ProductTree:struct<FullProductName:array<struct<ProductID:string,Value:string>>>,Vulnerability:array<struct<CVE:string,Title:struct<Value:string>,"
        "Threats:array<struct<Type:int,Description:struct<Value:string>>>,Remediations:array<struct<Type:int,Description:struct<Value:string>,FixedBuild:string,ProductID:array<string>>>>>>"
    )
    own = documents.select(F.from_json(F.col(raw), schema).alias("d")).select(F.col("d.DocumentTracking.Identification.ID.Value").alias("document"), F.map_from_entries(F.transform("d.ProductTree.FullProductName", lambda p: F.struct(p["ProductID"], p["Value"]))).alias("products"), F.explode("d.Vulnerability").alias("v"))
    severity = F.get(F.filter("v.Threats", lambda x: x["Type"] == 3), F.lit(0))["Description"]["Value"]
    own = own.select("document", "products", F.col("v.CVE").alias("cve"), F.regexp_replace(F.col("v.Title.Value"), "<[^>]*>", "").alias("title"), severity.alias("severity"), F.explode("v.Remediations").alias("r")).where("r.Type = 2")
    own = own.select("*", F.explode("r.ProductID").alias("product_id"))
    kb = F.regexp_extract("r.Description.Value", "^(?:KB)?([0-9]{4,9})$", 1)
    return own.select("document", "cve", "title", "product_id", F.try_element_at("products", F.col("product_id")).alias("product"), F.when(kb != "", F.concat(F.lit("KB"), kb)).alias("kb"), F.col("r.FixedBuild").alias("build"), "severity")


def stat(text: Column) -> Column:
    """pid, name, state, parent, session and start of a process's stat; its name stands in brackets and may hold brackets."""
    form = r"(?s)^\s*(\d+)\s*\((.*)\)\s*(\S)\S*\s+(\d+)\s+\S+\s+(-?\d+)\s+(?:\S+\s+){15}(\d+)"
    g = lambda k: F.regexp_extract(text, form, k)
    return F.when(text.rlike(form), F.struct(g(1).cast("int").alias("pid"), g(2).alias("name"), g(3).alias("state"), g(4).cast("int").alias("ppid"), g(5).cast("int").alias("session"), g(6).cast("long").alias("start")))


def status(text: Column) -> Column:
    """name, real and effective user and resident kilobytes of a process's status."""
    g = lambda p, k=1: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    users = r"(?m)^Uid:\s*(\d+)(?:\s+(\d+))?"
    return F.struct(F.trim(g(r"(?m)^Name:[ \t]*(.*)$")).alias("name"), g(users).cast("long").alias("uid"), g(users, 2).cast("long").alias("euid"), F.coalesce(g(r"(?m)^VmRSS:\s*(\d+)\s*kB").cast("long"), F.lit(0)).alias("rss_kb"))


def command_line(raw: Column) -> Column:
    """Arguments that zero bytes part, with spaces between; null where there are none, as for threads of the kernel."""
    joined = F.trim(F.regexp_replace(F.regexp_replace(F.decode(raw, "UTF-8"), "\\x00+$", ""), "\\x00", " "))
    return F.when(joined != "", joined)


def image(link: Column) -> Column:
    """The path of a process's image, and whether it has been deleted."""
    gone = F.endswith(link, F.lit(" (deleted)"))
    return F.struct(F.regexp_replace(link, r" \(deleted\)$", "").alias("path"), gone.alias("deleted"))


def unit(cgroup: Column) -> Column:
    """The system service that a process belongs to; null if to none."""
    found = F.regexp_extract(cgroup, r"(?m)^[^:]*:[^:]*:(?=.*/system\.slice/).*/([^/\n]*\.service)(?:/[^\n]*)?$", 1)
    return F.when(found != "", found)


def items(raw: Column, schema: str) -> Column:
    """What a collector's JSON holds as an array of structs, whether it is an array, one object or nothing."""
    return F.coalesce(F.when(F.trim(raw).startswith("["), F.from_json(raw, f"array<{schema}>")), F.when(F.trim(raw).startswith("{"), F.array(F.from_json(raw, schema))), F.array().cast(f"array<{schema}>"))


#: Fields of what the collectors of Windows give, by what they collect.
COLLECTED = {
    "processes": "struct<ProcessId:int,ParentProcessId:int,Name:string,ExecutablePath:string,CommandLine:string>", "sockets": "struct<LocalAddress:string,LocalPort:int,RemoteAddress:string,RemotePort:int,State:string,OwningProcess:int>",
    "services": "struct<Name:string,DisplayName:string,State:string,StartMode:string,PathName:string,StartName:string>", "tasks": "struct<TaskName:string,TaskPath:string,State:string,Execute:string,Arguments:string>",
    "software": "struct<DisplayName:string,DisplayVersion:string,Publisher:string,InstallDate:string>", "users": "struct<Name:string,Enabled:boolean,SID:string>",
}


def collected(rows: DataFrame, raw: str, what: str) -> DataFrame:
    """A row for each item of a collector's JSON, with its fields; names of fields are found without regard to case."""
    return rows.select(*(c for c in rows.columns if c != raw), F.inline(items(F.col(raw), COLLECTED[what])))
