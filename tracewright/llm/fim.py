"""Fill-in-the-middle transformation by DuckDB inside mapInArrow.

Every Arrow batch is registered with a DuckDB connection of the task, and one statement cuts, reorders and digests its
texts; no Python code runs for a row. Where the cuts lie and which form a document takes follow from a SHA-256 of the
seed and the doc_id alone, so a lost task gives the same rows again, and nothing is shuffled.

A text is cut into blocks of UNITS code points, and only the blocks that hold a cut into single ones: a list of all code
points would take 16 bytes for each.

Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), with a marker before
each part. A text that holds a marker stays plain, and markers that overlap are refused; so the parts can be told again.

Defined cases: a null text is an empty one and stays plain; a null doc_id is an empty string in the hash; repeated rows
come back as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts_of

#: Code points of a block.
UNITS = 64
#: Markers of prefix, suffix and middle; share of plain documents is 100 - FIM of 100, that of spm among the others SPM of 100.
MARKERS, FIM, SPM = ("<P>", "<S>", "<M>"), 90, 20

#: The units of a list of blocks from a to b.
PIECE = f"""
CREATE TEMP MACRO units(block) AS regexp_extract_all(coalesce(block, ''), '(?s).');
CREATE TEMP MACRO piece(blocks, a, b) AS
    array_to_string(list_slice(units(blocks[a // {UNITS} + 1]), a % {UNITS} + 1, CASE WHEN a // {UNITS} = b // {UNITS} THEN b % {UNITS} ELSE {UNITS} END), '')
    || array_to_string(list_slice(blocks, a // {UNITS} + 2, b // {UNITS}), '')
    || CASE WHEN a // {UNITS} = b // {UNITS} THEN '' ELSE array_to_string(list_slice(units(blocks[b // {UNITS} + 1]), 1, b % {UNITS}), '') END;
"""

FORMED = f"""
WITH hashed AS (SELECT doc_id, text, sha256($seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(text, '(?s).{{1,{UNITS}}}') AS blocks FROM batch),
sized AS (
    SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r,
           {UNITS} * greatest(len(blocks) - 1, 0) + len(units(blocks[-1])) AS n FROM hashed),
drawn AS (
    SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR r[3] % 100 >= $fim THEN 'plain'
                WHEN r[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM sized),
formed AS (
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           CASE form WHEN 'plain' THEN text
                WHEN 'psm' THEN $p || piece(blocks, 0, a) || $s || piece(blocks, b, n) || $m || piece(blocks, a, b)
                ELSE $s || piece(blocks, b, n) || $p || piece(blocks, 0, a) || $m || piece(blocks, a, b) END AS output FROM drawn)"""

#: The text again, from form and output: what follows each marker, put in order.
RESTORED = """
CASE form WHEN 'plain' THEN output
     WHEN 'psm' THEN substr(string_split(output, $s)[1], len($p) + 1) || string_split(output, $m)[2] || string_split(string_split(output, $s)[2], $m)[1]
     ELSE string_split(string_split(output, $p)[2], $m)[1] || string_split(output, $m)[2] || substr(string_split(output, $p)[1], len($s) + 1) END"""


def checked(markers: tuple[str, str, str]) -> dict[str, str]:
    """The markers by the names of their parameters; ValueError where the end of one may be the start of one."""
    for i, x in enumerate(markers):
        for j, y in enumerate(markers):
            if not x or any(y.startswith(x[k:]) for k in range(1, len(x))) or (i != j and x in y):
                raise ValueError(f"markers {x!r} and {y!r} can't be told apart")
    return dict(zip("psm", markers, strict=True))


def _run(statement: str, values: dict, schema: str):
    names = [x.split()[0] for x in schema.split(",")]

    def work(batches):
        with duckdb.connect(config={"threads": 1}) as own:
            own.execute(PIECE)
            for batch in batches:
                own.register("batch", pa.Table.from_batches([batch]))
                out = own.sql(statement, params=values).to_arrow_table()
                own.unregister("batch")
                for part in out.to_batches():
                    yield {n: part.column(n) for n in names}

    return work


def _drawn(docs: DataFrame, select: str, schema: str, seed: int, markers: tuple[str, str, str], fim: int, spm: int) -> DataFrame:
    values = checked(markers) | {"seed": str(seed), "fim": fim, "spm": spm}
    return map_batches(texts_of(docs), _run(f"{FORMED} SELECT {select} FROM formed", values, schema), schema)


PARTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def transform(docs: DataFrame, seed: int = 1, markers: tuple[str, str, str] = MARKERS, fim: int = FIM, spm: int = SPM) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars and middle_chars (null if plain) and output of each document."""
    return _drawn(docs, "*", f"{PARTS}, output string", seed, markers, fim, spm)


def restore(formed: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id and text of what transform gave, from form and output alone."""
    statement = f"SELECT doc_id, {RESTORED} AS text FROM batch"
    return map_batches(formed.select("doc_id", "form", "output"), _run(statement, checked(markers), "doc_id long, text string"), "doc_id long, text string")


def digests(docs: DataFrame, seed: int = 1, markers: tuple[str, str, str] = MARKERS, fim: int = FIM, spm: int = SPM) -> DataFrame:
    """What transform gives, with digests of output and of the text that restore makes of it, in one pass."""
    select = f"doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({RESTORED}) AS restored_sha256"
    return _drawn(docs, select, f"{PARTS}, output_sha256 string, restored_sha256 string", seed, markers, fim, spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
             CAST('0x' || h[17:24] AS BIGINT) % 100 AS f, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s FROM d),
c AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR f >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, left(t, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLE_SQL = {"op11_fill_in_middle": SQL}
