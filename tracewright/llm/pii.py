"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues; local parsers
expand each anchor to its boundaries and validate it. Base kinds give exactly the leftmost non-overlapping
matches of their patterns: an email is grown around its at-sign, a card, an address or a phone number from
the first digit or plus sign that no earlier match of its kind has taken.

Defined cases: a null text is an empty one, with no spans; repeated rows and null doc_ids come back as they
came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import change_batches, map_batches, sha, table, texts_of

BASE = ("email", "ip", "card", "phone")
MORE = ("login", "ssn")
ORDER = {kind: k for k, kind in enumerate((*BASE, *MORE))}
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz") | DIGITS | frozenset("+.-")
CUES = ("ssn", "SSN")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in (*((d, "0") for d in DIGITS), ("@", "@"), ("+", "+"), ("://", ":"), *((c, "s") for c in CUES)):
        a.add_word(word, kind)
    a.make_automaton()
    return a


def run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def back(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def domain(text: str, at: int) -> int:
    """End of label(.label)+ from at, or 0."""
    end = run(text, at, LABEL)
    dots, whole = 0, len(text)
    while at < end and end + 1 < whole and text[end] == "." and text[end + 1] in LABEL:
        end, dots = run(text, end + 1, LABEL), dots + 1
    return end if dots else 0


def quad(text: str, at: int) -> list[tuple[int, int]]:
    """The four parts of an address from at, or fewer."""
    parts = []
    while len(parts) < 4:
        end = run(text, at, DIGITS)
        if end == at:
            break
        parts.append((at, end))
        if end >= len(text) or text[end] != ".":
            break
        at = end + 1
    return parts


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def pii_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    found, free = [], dict.fromkeys(ORDER, 0)
    n = len(text)
    for last, cue in automaton().iter(text):
        if cue == "0":
            if last >= free["card"]:
                end, digits = last + 1, [text[last]]
                while end < n and (text[end] in DIGITS or (text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS)):
                    end += text[end] not in DIGITS
                    digits.append(text[end])
                    end += 1
                free["card"] = end
                if 16 <= len(digits) <= 19 and luhn("".join(digits)):
                    found.append(("card", last, end))
            if last >= free["ip"]:
                parts = quad(text, last)
                if len(parts) == 4:
                    free["ip"] = parts[3][1]
                    if all(small(text[a:b]) for a, b in parts):
                        found.append(("ip", last, parts[3][1]))
                else:
                    free["ip"] = parts[0][1]
        elif cue == "@":
            start = back(text, last, free["email"], LOCAL)
            if start < last and (end := domain(text, last + 1)):
                found.append(("email", start, end))
                free["email"] = end
        elif cue == "+":
            if last >= free["phone"] and last + 1 < n and text[last + 1] in DIGITS:
                end = back(text, run(text, last + 2, PHONE), last + 2, PHONE - DIGITS)
                if end > last + 3:
                    free["phone"] = end
                    if 8 <= sum(c in DIGITS for c in text[last:end]) <= 15:
                        found.append(("phone", last, end))
        elif cue == ":":
            # scheme://user:password@host
            start = back(text, last - 2, free["login"], SCHEME)
            while start < last - 2 and not text[start].isalpha():
                start += 1
            user = run(text, last + 1, LOCAL)
            if start < last - 2 and last + 1 < user < n and text[user] == ":":
                word = run(text, user + 1, LOCAL)
                host = run(text, word + 1, LABEL | {"."})
                if user + 1 < word < n and text[word] == "@" and host > word + 1:
                    found.append(("login", start, host))
                    free["login"] = host
        elif last - 2 >= free["ssn"]:
            # the cue, up to three of " :#", then 3-2-4 digits
            at = run(text, last + 1, frozenset(" :#"))
            end = at + 11
            shape = text[at:end]
            if 1 <= at - last - 1 <= 3 and len(shape) == 11 and all((c == "-") if k in (3, 6) else c in DIGITS for k, c in enumerate(shape)):
                found.append(("ssn", last - 2, end))
                free["ssn"] = end
    return sorted(found, key=lambda x: (ORDER[x[0]], x[1]))


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or run of overlapping spans, as <KIND>."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(batches):
    for batch in batches:
        rows = [pii_spans(t) for t in batch.column("text").to_pylist()]
        base = [[x for x in spans if x[0] in BASE] for spans in rows]
        yield {
            "doc_id": batch.column("doc_id"), **{f"n_{kind}": [sum(x[0] == kind for x in b) for b in base] for kind in BASE},
            "base_sha256": [sha(spelled(b)) for b in base], "spans": [spelled(x) for x in rows],
        }


def find(docs: DataFrame) -> DataFrame:
    """A row of counts and spans for each row of docs; no shuffle."""
    return map_batches(texts_of(docs), _find, OUT)


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span masked and n_chars made to fit; its columns and rows as they were."""
    at = docs.columns.index("text")

    def work(batch):
        clean = [None if t is None else masked(t, pii_spans(t)) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = change_batches(docs, work)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def op6_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def _sql() -> str:
    kinds = [
        ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
        ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_bool_and(list_transform(string_split(w, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(x, 3) AS INT) <= 255))"),
        ("card", "[0-9]([\\x20-]?[0-9])+", "length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda j: CASE WHEN (length(dg) - j) % 2 = 0 THEN CAST(dg[j] AS INT) ELSE (CAST(dg[j] AS INT) * 2) // 10 + (CAST(dg[j] AS INT) * 2) % 10 END)) % 10 = 0"),
        ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "length(dg) BETWEEN 8 AND 15"),
        ("login", "[a-z][a-z0-9+.-]*://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "true"),
        ("ssn", "(ssn|SSN)[ :#]{1,3}[0-9]{3}-[0-9]{2}-[0-9]{4}", "true"),
    ]
    found = " UNION ALL ".join(f"SELECT rid, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d" for k, (kind, p, _) in enumerate(kinds))
    keep = " OR ".join(f"(kind = '{kind}' AND {test})" for kind, _, test in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
w AS (SELECT rid, k, kind, ms[i] AS w, regexp_replace(ms[i], '[^0-9]', '', 'g') AS dg,
             CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM i),
e AS (SELECT *, s + length(w) AS n FROM w WHERE {keep}),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(BASE))},
             string_agg(kind || ':' || s || ':' || n, ',' ORDER BY k, s) FILTER (k <= 3) AS base, string_agg(kind || ':' || s || ':' || n, ',' ORDER BY k, s) AS spans
      FROM e GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


QUERIES = {"op6_anchor_pii": op6_anchor_pii}
ORACLE_SQL = {"op6_anchor_pii": _sql()}
