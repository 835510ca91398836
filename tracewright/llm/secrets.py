"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. A (blob, rule version) pair that the
ledger has is never scanned again; findings are kept by blob and joined back to all paths (doc_ids).

Defined cases: a null text is an empty one, which has no findings; equal texts are scanned once and every
row gets the findings; repeated rows and null doc_ids come back as they came; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import known, map_batches, new_path, sha, table, texts_of

RULES = "2"
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Kinds besides the base, in the order listed.
MORE = {"github": (re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}"), "_"), "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), "-----BEGIN ")}
ORDER = {kind: k for k, kind in enumerate((*BASE, *MORE))}
#: The session's setting that names a ledger to go on with, and paths of a blob from which on they are dealt over parts of so many.
LASTING, HOT = "spark.tracewright.secretLedger", 100_000
LEDGER = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, (pattern, cue) in MORE.items():
        if cue in text:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _blobs(batches):
    """Each text once a task, compressed for the shuffle: a hot blob leaves at most one row a task."""
    seen, squeeze = set(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs, packed = [], []
        for text in batch.column("text").to_pylist():
            raw = text.encode("utf-8", "surrogatepass")
            blob = hashlib.sha256(raw).digest()
            if blob not in seen:
                seen.add(blob)
                blobs.append(blob)
                packed.append(squeeze.compress(raw))
        yield {"blob": blobs, "packed": packed}


def _scan(batches):
    seen, open_up = set(), zstandard.ZstdDecompressor()
    for batch in batches:
        rows = {name.split()[0]: [] for name in LEDGER.split(", ")}
        for blob, packed in zip(batch.column("blob").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if blob in seen:
                continue
            seen.add(blob)
            spans = secret_spans(open_up.decompress(packed).decode("utf-8", "surrogatepass"))
            base = [x for x in spans if x[2] in BASE]
            count = {kind: sum(x[2] == kind for x in base) for kind in BASE}
            for name, value in zip(rows, (blob, RULES, *count.values(), sha(spelled(base)), spelled(spans)), strict=True):
                rows[name].append(value)
        yield rows


def scan(docs: DataFrame, ledger: str) -> DataFrame:
    """Scans what the ledger (a Parquet folder) hasn't seen under RULES, adds it there, and returns a row for each row of docs.

    Two scans at a time may both add a blob; it counts once all the same.
    """
    spark = docs.sparkSession
    texts = texts_of(docs)
    blobs = map_batches(texts.select("text"), _blobs, "blob binary, packed binary")
    seen = known(spark, ledger, LEDGER)
    if seen is not None:
        blobs = blobs.join(seen.where(F.col("rules") == RULES).select("blob"), "blob", "left_anti")
    map_batches(blobs.repartition("blob"), _scan, LEDGER).write.mode("append").parquet(ledger)
    found = spark.read.schema(LEDGER).parquet(ledger).where((F.col("rules") == RULES) & (F.col("spans") != "")).drop("rules").dropDuplicates(["blob"])
    paths = texts.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"))
    # a blob may be the text of a third of all paths: those of such a one are dealt over parts, and its findings go to each. There is at most one for HOT paths, 40 bytes each
    hot = paths.groupBy("blob").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("blob", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    found = found.join(F.broadcast(hot), "blob", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    paths = paths.join(F.broadcast(hot), "blob", "left").select("doc_id", "blob", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    return paths.join(found, ["blob", "part"], "left").drop("part")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a ledger of this run's own, or with the one that the setting LASTING names, which later runs go on with."""
    found = scan(table(spark, sf_dir, "documents"), spark.conf.get(LASTING, None) or new_path(spark, "ledger"))
    return found.select(
        "doc_id", *(F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in BASE),
        F.coalesce("base_sha256", F.lit(sha(""))).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql() -> str:
    assign = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [("assign", assign, 2, 6), ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24), ("github", "(gh[opsur]_[A-Za-z0-9]{36,})", 1, 1), ("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1)]
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d"
        for k, (kind, p, group, least) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
e AS (SELECT rid, k, kind, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(ms[i]) AS n
      FROM i WHERE length(gs[i]) >= least),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k <= 2) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
      FROM e GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


QUERIES = {"op1_secret_ledger": op1_secret_ledger}
ORACLE_SQL = {"op1_secret_ledger": _sql()}
