"""What the source files of a project import, without the project's own modules and the standard library.

Files are rows (file, value), each as its whole text, as host.whole gives them. Null and empty texts import nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts in triple quotes, which aren't code.
QUOTED = r'(?s)""".*?"""' + r"|'''.*?'''"
FROM, IMPORT = r"^\s*from\s+([A-Za-z_]\w*)[\w.]*\s+import\b", r"^\s*import\s+([A-Za-z_][\w.]*.*)$"
#: Folders and names of files that hold tests.
TESTS = r"(^|/)(tests?|testing)/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$"


def python_imports(files: DataFrame, with_tests: bool = False, standard: Collection[str] | None = None) -> DataFrame:
    """module, its first file and line there, and the number of files that import it.

    The standard library is that of the running Python, or the modules given, so that results don't change with the driver. The project's own names are those of its files and folders. Relative imports name no module; of statements on one line, the first counts.
    """
    python = files.where(F.col("file").endswith(".py")).select("file", F.translate(F.coalesce("value", F.lit("")), "\u0001", " ").alias("value"))
    # a quoted text gives way to its line ends, so that lines keep their numbers
    breaks = F.regexp_replace("value", QUOTED, "\u0001$0\u0001")
    parts = F.transform(F.split(breaks, "\u0001"), lambda x: F.when(x.rlike(f"^(?:{QUOTED})$"), F.regexp_replace(x, r"[^\n]", "")).otherwise(x))
    code = python if with_tests else python.where(~F.col("file").rlike(TESTS))
    lines = code.select("file", F.posexplode(F.split(F.array_join(parts, ""), r"\r?\n")).alias("at", "line"))
    listed = F.split(F.regexp_replace(F.regexp_extract("line", IMPORT, 1), r"[#;].*$", ""), ",")
    names = F.when(F.col("line").rlike(FROM), F.array(F.regexp_extract("line", FROM, 1))).when(F.col("line").rlike(IMPORT), F.transform(listed, lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_]\w*)", 1)))
    found = lines.select("file", (F.col("at") + 1).alias("line"), F.explode(names).alias("module")).where("module <> ''")
    found = found.groupBy("file", "module").agg(F.min("line").alias("line"))
    own = python.select(F.explode(F.split(F.regexp_replace("file", r"\.py$", ""), "/")).alias("module")).distinct()
    known = sorted(sys.stdlib_module_names if standard is None else standard)
    return found.where(~F.col("module").isin(known)).join(own, "module", "left_anti").groupBy("module").agg(
        F.min(F.struct("file", "line")).alias("f"), F.count("*").alias("files")).select("module", "f.file", "f.line", "files")
