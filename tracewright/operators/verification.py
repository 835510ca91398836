"""Scores of investigations against what a scenario expects to be found.

truth has a row for each expected thing: scenario, criterion (one of CRITERIA but Evidence), thing and, for an edge, the other end.
facts has entity_key, fact_type, data (JSON), pieces of evidence, evidence_strength and pain_level by scenario. What a scenario expects is short, a list
that an author wrote; what is found is not. So the expected things go to the facts by scenario, as one array each, every fact says
which of them it meets, and only those numbers are grouped: facts are never paired with one another, nor all things with all facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Criteria in their order with their names, points of a thing and words of their explanation; the points of evidence are out of 20 in all.
CRITERIA = {
    "Asset": ("Assets Discovered (Coverage)", 20, "Discovered {}/{} required assets"),
    "Fact": ("Fact Detection (Correctness)", 20, "Identified {}/{} expected security facts"),
    "Evidence": ("Evidence Quality (Provenance)", 20, "{}/{} facts backed by cryptographic evidence provenance"),
    "Technique": ("ATT&CK Mapping (Accuracy)", 20, "Mapped {}/{} required ATT&CK techniques"),
    "Edge": ("Attack Graph (Edge Provenance)", 20, "Reconstructed {}/{} attack graph edges"),
    "Stage": ("Kill Chain Progression", 15, "Traced {}/{} Kill Chain attack stages"),
    "Pyramid": ("Pyramid of Pain (Depth)", 15, "Attained {}/{} required indicator depths"),
}
#: Words of a fact's type, as they are, or of its data in lower case, that stand for an expected fact; of the data, for a technique; of either, in lower case, for a stage.
FACT_WORDS = {"processexecution": (("Execution", "Process", "Dump"), ()), "lsass_dump": (("Credential",), ("lsass",))}
TECHNIQUE_WORDS = {
    "T1003.001": ("lsass", "procdump", "mimikatz"), "T1003": ("lsass", "procdump", "mimikatz"), "T1059.001": ("powershell", "-enc"), "T1059": ("powershell", "-enc"),
    "T1033": ("whoami", "net user"), "T1053.005": ("schtasks",), "T1053": ("schtasks",),
}
STAGE_WORDS = {"execution": (("execution",), ("powershell",)), "credentialaccess": (("credential",), ("lsass", "mimikatz")), "discovery": (("discovery",), ("whoami",)), "persistence": (("persist",), ("schtasks",))}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def met(criterion: Column, thing: Column) -> Column:
    """Whether the fact of a row is or says an expected thing; edges are asked for by their ends."""
    kind, data = F.col("fact_type"), F.lower("data")
    low, low_kind = F.lower(thing), F.lower(kind)
    fact = F.contains(low_kind, low)
    for name, (types, words) in FACT_WORDS.items():
        fact = fact | ((low == name) & (has_any(kind, types) | has_any(data, words)))
    technique, stage = F.contains(data, low), F.contains(low_kind, low) | F.contains(data, low)
    for name, words in TECHNIQUE_WORDS.items():
        technique = F.when(thing == name, has_any(data, words)).otherwise(technique)
    for name, (types, words) in STAGE_WORDS.items():
        stage = F.when(low == name, has_any(low_kind, types) | has_any(data, words)).otherwise(stage)
    own = F.when(criterion == "Asset", F.col("entity_key") == thing).when(criterion == "Fact", fact).when(criterion == "Technique", technique)
    return F.coalesce(own.when(criterion == "Stage", stage).when(criterion == "Pyramid", F.lower("pain_level") == low), F.lit(False))


def _asked(criterion: Column, thing: Column) -> Column:
    return F.struct(criterion.alias("criterion"), thing.alias("thing"))


def criteria(truth: DataFrame, facts: DataFrame) -> DataFrame:
    """scenario, place, name, points, most and explanation for each criterion that truth has things of, and for the evidence of facts.

    A thing that is expected twice counts twice. A missing text of a fact says nothing.
    """
    ends = F.flatten(F.transform(F.filter("expected", lambda x: x["criterion"] == "Edge"), lambda x: F.array(_asked(F.lit("Asset"), x["thing"]), _asked(F.lit("Asset"), x["other"]))))
    plain = F.transform(F.filter("expected", lambda x: x["criterion"] != "Edge"), lambda x: _asked(x["criterion"], x["thing"]))
    # as many things as an author wrote down for a scenario, those that are expected twice twice
    lists = truth.groupBy("scenario").agg(F.collect_list(F.struct("criterion", "thing", "other")).alias("expected")).withColumn("asked", F.array_distinct(F.concat(plain, ends)))
    says = F.filter("asked", lambda x: met(x["criterion"], x["thing"]))
    texts = facts.select("scenario", "entity_key", "fact_type", F.coalesce("data", F.lit("")).alias("data"), "pain_level").distinct()
    # sizes are estimated from those of columns read, which says nothing of what lists make of them: no side is to be taken for a small one and sent whole to the driver
    hits = texts.join(lists.select("scenario", "asked").hint("merge"), "scenario").select("scenario", F.explode(says).alias("x")).groupBy("scenario").agg(F.collect_set("x").alias("met"))
    own = lists.select("scenario", "expected").join(hits.hint("merge"), "scenario", "left")
    has = lambda criterion, thing: F.array_contains("met", _asked(criterion, thing))
    hit = lambda x: F.when(x["criterion"] == "Edge", has(F.lit("Asset"), x["thing"]) & has(F.lit("Asset"), x["other"])).otherwise(has(x["criterion"], x["thing"]))
    each = own.withColumn("criterion", F.explode(F.array_distinct(F.transform("expected", lambda x: x["criterion"])))).where("criterion IS NOT NULL")
    here = F.filter("expected", lambda x: x["criterion"] == F.col("criterion"))
    counted = each.select("scenario", "criterion", F.size(F.filter(here, lambda x: F.coalesce(hit(x), F.lit(False)))).cast("long").alias("hits"), F.size(here).cast("long").alias("all"))
    backed = (F.col("evidence") > 0) & (F.col("evidence_strength") > 0)
    evidence = facts.groupBy("scenario").agg(F.count_if(backed).alias("hits"), F.count("*").alias("all")).join(lists.select("scenario").hint("merge"), "scenario", "left_semi")
    out = counted.unionByName(evidence.withColumn("criterion", F.lit("Evidence")))
    place, name, points, words = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(0), F.lit("")
    for k, (criterion, (title, each, text)) in enumerate(CRITERIA.items()):
        here = F.col("criterion") == criterion
        first, middle, last = text.split("{}")
        place, name, points = F.when(here, k + 1).otherwise(place), F.when(here, title).otherwise(name), F.when(here, each).otherwise(points)
        words = F.when(here, F.concat(F.lit(first), F.col("hits").cast("string"), F.lit(middle), F.col("all").cast("string"), F.lit(last))).otherwise(words)
    is_evidence = F.col("criterion") == "Evidence"
    got = F.when(is_evidence, F.round(F.col("hits") / F.col("all") * points)).otherwise(F.col("hits") * points).cast("long")
    return out.select("scenario", place.alias("place"), name.alias("name"), got.alias("points"), F.when(is_evidence, points).otherwise(F.col("all") * points).cast("long").alias("most"), words.alias("explanation"))


def totals(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a scenario: points, the most there are, and the percentage, 100 where nothing could be had."""
    sums = scored.groupBy("scenario").agg(F.sum("points").alias("points"), F.sum("most").alias("most"))
    own = truth.select("scenario").distinct().join(sums.hint("merge"), "scenario", "left")
    own = own.select("scenario", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("points", "most")))
    return own.withColumn("percent", F.when(F.col("most") > 0, F.col("points") / F.col("most") * 100).otherwise(100.0))


def explained(scored: DataFrame, totals_: DataFrame) -> DataFrame:
    """scenario and a text: its points in all, and a line for each of its criteria, of which there are seven at most."""
    line = F.concat(F.lit("- "), "name", F.lit(": +"), "points", F.lit(" / "), "most", F.lit(" pts | "), "explanation", F.lit("\n"))
    lines = scored.groupBy("scenario").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    head = F.concat(F.lit("Scenario: "), F.col("scenario").cast("string"), F.lit(" | Total Score: "), "points", F.lit("/"), "most", F.lit(" ("), F.format_string("%.1f", F.bround("percent", 1)), F.lit("%)\n" + "-" * 40 + "\n"))
    return totals_.join(lines.hint("merge"), "scenario", "left").select("scenario", F.concat(head, F.coalesce("lines", F.lit(""))).alias("summary"))
