"""Scans of packages end to end: packages and advisories in, rated, ordered and summed-up findings out.

Everything is an equi-join on names, ids or hosts; what is joined to findings is far smaller than packages are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, versions
from . import needles, vulnerabilities
from .facts import severity_rank


def rating(found: DataFrame, ratings: DataFrame) -> DataFrame:
    """found (id, aliases) with severity and cvss of its id, or else of the first of its aliases, by name, that is rated."""
    ids = found.select("id", "aliases").distinct()
    keys = ids.select("id", F.posexplode(F.concat(F.array("id"), F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("place", "key"))
    best = keys.join(ratings.select(F.col("id").alias("key"), "cvss"), "key").where("cvss IS NOT NULL").groupBy("id").agg(F.min_by("cvss", F.struct("place", "cvss")).alias("cvss"))
    out = found.join(best, "id", "left")
    return out.withColumn("severity", scalar.cvss_band(F.col("cvss")))


def packages(installed: DataFrame, ranges: DataFrame, ratings: DataFrame, kev: DataFrame, epss: DataFrame, ecosystem: str) -> DataFrame:
    """A finding for each installed package (host, name, version) and advisory (id, aliases, name, introduced, fixed, last_affected) that it is in.

    With its rating, whether it is exploited, how likely that is, the smallest fix above the installed version, and its rank of order in words of
    vulnerabilities.order(): exploited ones first, then by severity, score and likelihood.
    """
    hits = vulnerabilities.hits(installed, ranges, ecosystem)
    fix, own = versions.key(F.col("fixed"), ecosystem), versions.key(F.col("version"), ecosystem)
    one = hits.groupBy("host", "name", "version", "id").agg(F.min_by("fixed", F.when(fix > own, fix)).alias("fix"), F.first("aliases").alias("aliases"))
    rated = rating(one, ratings)
    marked = rated.join(kev.select("id", F.lit(True).alias("kev")).distinct(), "id", "left")
    return vulnerabilities.enrich(marked, epss, "epss").select("host", "name", "version", "id", "fix", "severity", "cvss", F.coalesce("kev", F.lit(False)).alias("kev"), "epss")


def envelope(found: DataFrame, hosts: DataFrame, loaded: Column) -> DataFrame:
    """One row a host: status, findings by severity, those exploited and without a fix, and the largest score; hosts without findings too."""
    levels = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")]
    own = found.groupBy("host").agg(F.count("*").alias("findings"), *levels, F.count_if("kev").alias("exploited"), F.count_if(F.col("fix").isNull()).alias("unfixed"), F.max("cvss").alias("top"))
    counts = ["findings", "critical", "high", "medium", "low", "exploited", "unfixed"]
    out = hosts.join(own, "host", "left").select("host", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), "top")
    return out.withColumn("status", F.when(~loaded, "DATASET_MISSING").when(F.col("findings") > 0, "VULNERABLE").otherwise("NO_KNOWN_FINDINGS"))


#: Where a dependency was found, best place first, and what those places and severities are called; advisories and places that a finding lists.
PLACES = {"manifest": "файл зависимостей", "lockfile": "lock-файл", "bundled": "копия библиотеки в проекте", "cdn": "загрузка с CDN", "installed": "установлен в окружении проекта"}
RATINGS = {"Critical": "критическая", "High": "высокая", "Medium": "средняя", "Low": "низкая", "None": "низкая"}
UNRATED, LISTED, OTHER_PLACES = "без оценки", 5, 50
#: Severities of advisories in their order; one that isn't rated comes first.
LEVELS = ("Unknown", "None", "Low", "Medium", "High", "Critical")


def level(severity: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), severity), F.lit(1)) - 1)


def normal_name(ecosystem: Column, name: Column) -> Column:
    """A package's name as its ecosystem compares it."""
    return F.when(ecosystem == "PyPI", scalar.package_name(name, "PyPI")).when(ecosystem.isin("Packagist", "NuGet"), F.lower(name)).otherwise(name)


def package_places(dependencies: DataFrame) -> DataFrame:
    """ecosystem, key (the name as it is compared), version and places of each pinned package: manifests before lock files before others, then by file and line; each place (rank, file, line, kind, name) once."""
    rank = F.lit(len(PLACES))
    for k, kind in enumerate(PLACES):
        rank = F.when(F.col("kind") == kind, k).otherwise(rank)
    place = F.struct(rank.alias("rank"), "file", "line", "kind", "name")
    own = dependencies.where("version IS NOT NULL").groupBy("ecosystem", normal_name(F.col("ecosystem"), F.col("name")).alias("key"), "version")
    return own.agg(F.sort_array(F.collect_set(place)).alias("places"))


def grouped_dependencies(dependencies: DataFrame) -> DataFrame:
    """One row a pinned package: ecosystem, name as its first place has it, version, the places in order and how many there are."""
    shown = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["file"], p["line"].cast("string"))), ",")
    return package_places(dependencies).select("ecosystem", F.col("places")[0]["name"].alias("name"), "version", F.size("places").alias("n"), shown.alias("places"))


def dependency_findings(dependencies: DataFrame, advisories: DataFrame, ecosystems: tuple[str, ...]) -> DataFrame:
    """A finding for each pinned package that advisories (ecosystem, key, version, id, severity, cvss, kev, malicious, summary, fix) name: rule, cwe, severity, message, first place, other places, and the version to go to.

    A malicious package is critical, whatever its flaws. The version to go to is the largest fix by the order of the package's ecosystem, and null if an advisory has none; it is known for ecosystems alone.
    """
    keys = ["ecosystem", "key", "version"]
    rank = level(F.col("severity"))
    one = F.struct((~F.col("malicious")).alias("m"), (~F.col("kev")).alias("k"), (-rank).alias("s"), (-F.coalesce("cvss", F.lit(-1.0))).alias("c"), "id", "severity", "malicious", "kev", "summary")
    # fixes are null where an advisory has none, and their versions are looked at for packages that are met alone
    fixes = F.when(F.count("*") == F.count("fix"), F.collect_set("fix")).alias("_fixes")
    lists = advisories.withColumns({"malicious": F.coalesce("malicious", F.lit(False)), "kev": F.coalesce("kev", F.lit(False))}).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("a"), fixes)
    target = F.lit(None).cast("string")
    for ecosystem in ecosystems:
        target = F.when(F.col("ecosystem") == ecosystem, vulnerabilities.largest(F.col("_fixes"), ecosystem)).otherwise(target)
    met = package_places(dependencies).join(lists, keys).withColumn("target", target)
    bad, flaws = F.filter("a", lambda x: x["malicious"]), F.filter("a", lambda x: ~x["malicious"])
    met = met.withColumns({"bad": bad, "flaws": flaws, "main": F.col("places")[0]}).withColumn("worst", F.array_max(F.transform("flaws", lambda x: -x["s"])))
    who = F.concat(F.col("main.name"), F.lit(" "), "version", F.lit(" ("), "ecosystem", F.lit(")"))
    number, worst = F.size("flaws"), F.col("worst")
    first = F.get("bad", F.lit(0))
    summary = F.regexp_replace(F.coalesce(first["summary"], F.lit("")), r"\.+$", "")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    malicious = text(
        "Пакет ", who, " опубликован злоумышленниками (", first["id"], ")", F.when(F.coalesce(first["summary"], F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), summary)),
        ". Удалите его из проекта и проверьте машины, где он устанавливался: такой пакет мог выполнить свой код при установке.", F.when(number > 0, text(" Кроме того, известных уязвимостей: ", number, ".")).otherwise(""),
    )
    label = F.create_map(*(F.lit(x) for pair in RATINGS.items() for x in pair))
    shown = F.array_join(F.transform(F.slice("flaws", 1, LISTED), lambda x: F.concat(x["id"], F.lit(" ("), F.coalesce(F.try_element_at(label, x["severity"]), F.lit(UNRATED)), F.lit(")"))), ", ")
    exploited = F.array_join(F.transform(F.filter("flaws", lambda x: x["kev"]), lambda x: x["id"]), ", ")
    vulnerable = text(
        who, ": известных уязвимостей ", number, ": ", shown, F.when(number > LISTED, text(" и ещё ", number - LISTED)).otherwise(""), ".", F.when(exploited != "", text(" Используются в реальных атаках (CISA KEV): ", exploited, ".")).otherwise(""),
        F.when(F.col("target").isNotNull(), text(" Обновите до ", F.coalesce("target", F.lit("")), " или новее.")).otherwise(" Исправленной версии нет хотя бы для одной из них: замените библиотеку или закройте уязвимость по её описанию."),
    )
    is_bad = F.size("bad") > 0
    is_level = lambda *names: worst.isin(*(LEVELS.index(n) for n in names))
    severity = F.when(is_bad | is_level("Critical"), "critical").when(is_level("High"), "high").when(is_level("Low", "None"), "low").otherwise("medium")
    others = F.transform(F.slice("places", 2, OTHER_PLACES), lambda p: F.concat_ws(":", p["file"], p["line"].cast("string")))
    return met.select(
        "ecosystem", F.col("main.name").alias("name"), "version", F.when(is_bad, "malicious-dependency").otherwise("vulnerable-dependency").alias("rule"), F.when(is_bad, 506).otherwise(1395).alias("cwe"), severity.alias("severity"),
        F.when(is_bad, malicious).otherwise(vulnerable).alias("message"), F.col("main.file").alias("file"), F.col("main.line").alias("line"), others.alias("other_places"), F.col("target").alias("fixed_version"),
    )


def legacy_matches(products: DataFrame, records: DataFrame) -> DataFrame:
    """product, version and id of each product and record (id, pattern, versions) whose pattern the product's name holds, in lower case, and one of whose versions its version holds.

    Patterns are found by needles.found, which looks at no pair without a rare part in common; a pattern in upper case matches nothing, as it is compared with a name in lower case.
    """
    names = products.select(F.lower("product").alias("_low")).distinct()
    met = needles.found(records.select("pattern").distinct(), "pattern", "pattern", names, "_low", "_low", case=True)
    both = products.withColumn("_low", F.lower("product")).join(met, "_low").join(records.select("id", "pattern", F.explode(F.array_distinct("versions")).alias("_v")), "pattern")
    return both.where(F.contains("version", F.col("_v"))).select("product", "version", "id").distinct()


def evaluated(products: DataFrame, assessed: DataFrame, key: str) -> DataFrame:
    """One row a product: candidates, how many affect it and how many are fixed, and a status, which never says that a product is secure. assessed is as applicability gives it."""
    count = lambda status: F.count_if(F.col("status") == status)
    own = assessed.groupBy(key).agg(F.count("*").alias("candidates"), count("Affected").alias("affected"), count("Fixed").alias("fixed"))
    out = products.select(key).distinct().join(own, key, "left").select(key, *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("candidates", "affected", "fixed")))
    said = F.when(F.col("affected") > 0, F.format_string("VULNERABILITIES_IDENTIFIED: %d affected", "affected")).when(F.col("fixed") > 0, F.format_string("NO_ACTIVE_VULNERABILITIES: %d patched/backported", "fixed"))
    return out.withColumn("message", said.otherwise("NO_KNOWN_MATCHED_VULNERABILITIES"))


def unpinned(dependencies: DataFrame) -> DataFrame:
    """Dependencies without a version whose ecosystem and name no row pins."""
    pinned = dependencies.where("version IS NOT NULL").select("ecosystem", "name").distinct()
    return dependencies.where("version IS NULL").join(pinned, ["ecosystem", "name"], "left_anti").select("ecosystem", "name").distinct()


def dependency_order() -> list[Column]:
    """Malicious ones first, then exploited ones, by severity, score and id."""
    return [F.col("id").startswith("MAL-").desc(), F.coalesce("kev", F.lit(False)).desc(), severity_rank(F.col("severity")).desc(), F.coalesce("cvss", F.lit(-1.0)).desc(), F.asc("id")]


def windows_builds(hosts: DataFrame, fixes: DataFrame) -> DataFrame:
    """The state of each host (host, product, branch, ubr, kbs) and CVE that fixes (cve, product, branch, ubr, kb, superseded by kb) name for its product.

    A fix of the host's branch counts by build: patched where the host's is as new or an installed update is the fix or supersedes it. A CVE with fixes for other branches alone is
    unverified, never patched.

    A host may have several rows. They are put together first, and the fixes of a CVE once for each set of products that hosts have, so that a host and CVE are met once: no group is made of
    what comes out, which is as many rows as hosts times CVEs, and no task holds more than its share of hosts.
    """
    builds = hosts.where("product IS NOT NULL").repartition("host").groupBy("host").agg(F.collect_list(F.struct("product", "branch", "ubr", "kbs")).alias("_builds"))
    own = builds.withColumn("_products", F.array_sort(F.array_distinct(F.transform("_builds", lambda b: b["product"]))))
    sets = own.select("_products").distinct().withColumn("product", F.explode("_products")).join(fixes, "product")
    cves = sets.groupBy("_products", "cve").agg(F.collect_list(F.struct("product", "branch", "ubr", "kb", "superseding")).alias("_fixes"))
    lists = cves.groupBy("_products", F.pmod(F.hash("cve"), F.lit(SHARES)).alias("_share")).agg(F.collect_list(F.struct("cve", "_fixes")).alias("_cves"))
    # most hosts may have the same products, so they are dealt out, and the lists go to each part; hosts are small as files, and would be sent whole without a hint
    dealt = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    own = own.withColumn("_part", F.pmod(F.hash("host"), F.lit(SHARES))).repartition(SHARES, "_products", "_part")
    met = own.join(dealt.hint("merge"), ["_products", "_part"]).select("host", "_builds", F.explode("_cves").alias("_c")).select("host", "_builds", "_c.cve", "_c._fixes")
    here = lambda b, f: (b["product"] == f["product"]) & (b["branch"] == f["branch"])
    any_of = lambda test: F.exists("_builds", lambda b: F.exists("_fixes", lambda f: test(b, f)))
    good = lambda b, f: (here(b, f) & (b["ubr"] >= f["ubr"])) | ((b["product"] == f["product"]) & vulnerabilities.updated(f["kb"], b["kbs"], f["superseding"]))
    first = F.array_min(F.flatten(F.transform("_builds", lambda b: F.transform(F.filter("_fixes", lambda f: here(b, f)), lambda f: f["ubr"]))))
    state = F.when(any_of(good), "Patched").when(any_of(here), "Vulnerable").otherwise("Unverified")
    return met.select("host", "cve", state.alias("state"), first.alias("first_fix"))


def _outcome(status: str | Column, reason: Column, sure: float | Column, rank: int, matched: str | Column, fixed: Column, advisory: Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(status).alias("status"), reason.alias("reason"), as_column(sure).alias("confidence"), F.lit(rank).alias("rank"), as_column(matched).alias("matched_version"),
        fixed.cast("string").alias("fixed_version"), advisory.cast("string").alias("advisory"),
    )


def _by_range(own: Column, fix: Column, fixed: Column, words: tuple[str, str, str, str], sure: tuple[float, float, float], rank: int, advisory: Column) -> Column:
    """What a fix says of a version, by their keys: fixed, affected, or unknown where they have no order; affected where there is no fix."""
    version = F.col("version")
    says = lambda head, mark: F.concat(F.lit(f"{head}: current "), version, F.lit(f" {mark} fixed "), fixed)
    out = lambda status, reason, confidence: _outcome(status, reason, confidence, rank, version, fixed, advisory)
    return (
        F.when(fixed.isNull(), out("Affected", F.lit(words[3]), sure[2])).when(own >= fix, out("Fixed", says(words[0], ">="), sure[0])).when(own < fix, out("Affected", says(words[1], "<"), sure[1]))
        .otherwise(out("Unknown", F.concat(F.lit(words[2]), version), 0.4))
    )


def applicability(pairs: DataFrame) -> DataFrame:
    """pairs of a product and a vulnerability with what is known of it best, by this order and rank:

    1. of Windows products, an update that the fix asks for (90), its build, or an update that is an alias;
    2. a vendor's range, of the product's ecosystem and a name that the product's has in it, by the vendor's order of versions (100);
    3. a range of the product's very name, by semantic versions (70);
    4. a CPE (40); 5. the name alone (10), both of which make a candidate.

    Of the product: ecosystem, name, version, build, ubr, kbs. Of the vulnerability: id, aliases, ranges (ecosystem, package, fixed), has_cpe, and fix (required_kb,
    superseding_kbs, target_build, fixed_ubr), null for none. The first range that fits counts.
    """
    c, none = F.col, F.lit(None).cast("string")
    kb = lambda text: F.concat(F.lit("KB"), F.regexp_replace(F.upper(F.trim(text)), "^(KB)+", ""))
    has = lambda name: F.array_contains(F.coalesce(c("kbs"), F.array().cast("array<string>")), kb(name))
    required = c("fix.required_kb")
    by_kb = F.coalesce(has(required), F.lit(False)) | F.exists(F.coalesce(c("fix.superseding_kbs"), F.array().cast("array<string>")), lambda s: F.coalesce(has(s), F.lit(False)))
    update = lambda good, name, more, sure: _outcome(
        F.when(good, "Fixed").otherwise("Affected"), F.when(good, F.concat(F.lit("Required security update "), name, F.lit(f"{more} is installed"))).otherwise(F.concat(F.lit("Required security update "), name, F.lit(" is NOT installed"))),
        sure, 90, c("version"), name, name,
    )
    new = c("ubr") >= c("fix.fixed_ubr")
    ubr = F.concat(F.lit("OS UBR "), c("ubr").cast("string"), F.when(new, " >= ").otherwise(" < "), F.lit("required fixed UBR "), c("fix.fixed_ubr").cast("string"))
    by_build = _outcome(F.when(new, "Fixed").otherwise("Affected"), ubr, 0.94, 90, F.concat_ws(".", c("build").cast("string"), c("ubr").cast("string")), c("fix.fixed_ubr"), none)
    alias = F.get(F.filter("aliases", lambda a: F.upper(a).startswith("KB")), F.lit(0))
    windows = (
        F.when(required.isNotNull(), update(by_kb, required, " (or superseding KB)", 0.96)).when((c("build") == c("fix.target_build")) & c("ubr").isNotNull(), by_build)
        .when(alias.isNotNull(), update(F.coalesce(has(alias), F.lit(False)), alias, "", 0.92))
    )
    same = lambda r: F.lower(r["package"]) == F.lower(c("name"))
    first = lambda keep: F.get(F.filter(F.coalesce("ranges", F.array().cast("array<struct<ecosystem:string,package:string,fixed:string>>")), keep), F.lit(0))
    own = pairs.withColumn("_vendor", first(lambda r: (r["ecosystem"] == c("ecosystem")) & (same(r) | F.contains(c("name"), r["package"])))).withColumn("_named", first(same))
    advisory = F.coalesce(F.get("aliases", F.lit(0)), c("id"))
    words = ("Vendor security fix present", "Vulnerable vendor package", "Failed to parse version: ", "Vendor advisory notes package is affected with no fix recorded")
    by_vendor = None
    fixed = c("_vendor.fixed")
    for names, kind in ((("Debian", "Ubuntu"), "Debian"), (("RedHat",), "Red Hat")):
        found = _by_range(versions.key(c("version"), kind), versions.key(fixed, kind), fixed, words, (0.98, 0.95, 0.85), 100, advisory)
        by_vendor = F.when(c("ecosystem").isin(*names), found) if by_vendor is None else by_vendor.when(c("ecosystem").isin(*names), found)
    by_vendor = by_vendor.otherwise(_by_range(scalar.semver_key(c("version")), scalar.semver_key(fixed), fixed, words, (0.98, 0.95, 0.85), 100, advisory))
    fixed = c("_named.fixed")
    words = ("Package fix present", "Vulnerable package", "Cannot parse SemVer ", "Package advisory indicates affected without fixed version")
    by_name = _by_range(scalar.semver_key(c("version")), scalar.semver_key(fixed), fixed, words, (0.92, 0.88, 0.80), 70, none)
    cpe = F.concat(F.lit("NVD CPE match found for '"), c("name"), F.lit("', exact backport status requires vendor advisory check"))
    by_cpe = _outcome("Candidate", cpe, 0.60, 40, c("version"), none, none)
    alone = _outcome("Candidate", F.lit("Matched candidate product name, version applicability unresolved"), 0.3, 10, c("version"), none, none)
    best = F.when((c("ecosystem") == "Windows") & windows.isNotNull(), windows).when(c("_vendor").isNotNull(), by_vendor).when(c("_named").isNotNull(), by_name).when(c("has_cpe"), by_cpe).otherwise(alone)
    return own.withColumn("_best", best).select(*pairs.columns, "_best.*")


def by_package_or_cpe(products: DataFrame, packages_: DataFrame, cpes: DataFrame) -> DataFrame:
    """Candidates (product_id, cve, source) by a product's package, and by its CPE for those products alone that have none by package; each once.

    A product may have several rows. Those with the same packages, or CPEs, have the same candidates, so that these are made different once for each such set and not for each product.
    Bunches of products meet bunches of CVEs, and these pairs are dealt over tasks. What a product gets is as much as it has candidates; it comes out of the pairs last and goes through no shuffle.
    """
    known = packages_.select("package").distinct()
    some = products.join(known, "package").select("product_id").distinct()
    none = products.join(some, "product_id", "left_anti")
    met = _bunches_met(products.join(some, "product_id", "left_semi"), packages_, "package", "package").union(_bunches_met(none, cpes, "cpe", "cpe"))
    # a column is written faster where its values repeat
    dealt = met.repartition(TASKS, "_pair").select("_products", F.explode("_cves").alias("cve"), "source")
    return dealt.select(F.explode("_products").alias("product_id"), "cve", "source")


def _bunches_met(products: DataFrame, names: DataFrame, name: str, source: str) -> DataFrame:
    """Pairs (_pair, _products, _cves, source) of products and CVEs that belong together; a product and a CVE of it are in one pair alone."""
    own = products.where(F.col(name).isNotNull()).groupBy("product_id").agg(F.array_sort(F.collect_set(name)).alias("_names"))
    cves = names.select(name, "cve").distinct()
    sets = own.select("_names").distinct().withColumn(name, F.explode("_names")).join(cves, name).select("_names", "cve").distinct()
    met = _bunches(own, "product_id", "_products").join(_bunches(sets, "cve", "_cves"), "_names")
    return met.select(F.xxhash64("_names", "_products_part", "_cves_part").alias("_pair"), "_products", "_cves", F.lit(source).alias("source"))


def _bunches(rows: DataFrame, what: str, name: str) -> DataFrame:
    """rows (_names, what) as lists of about BUNCH each, as a set of names may have any number of them."""
    sizes = rows.groupBy("_names").agg(F.ceil(F.count("*") / BUNCH).alias("_n"))
    dealt = rows.join(sizes, "_names").groupBy("_names", F.pmod(F.xxhash64(what), F.col("_n")).alias(f"{name}_part"))
    # in structs, since lists are collected without nulls
    return dealt.agg(F.transform(F.collect_list(F.struct(what)), lambda x: x[what]).alias(name))


#: Into how many lists the CVEs of a host's products are dealt.
SHARES = 64
#: How many products, and how many CVEs, make up a bunch, and over how many tasks pairs of bunches are dealt. The rows of a pair may be in memory at once.
BUNCH, TASKS = 256, 128
