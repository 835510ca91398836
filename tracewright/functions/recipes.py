"""Recipes: steps that encode and decode bytes, one after another. Each is a column function of binary columns; what a step can't decode is null.

All run in the JVM but for zlib, which Spark has no function for, and the exclusive or, whose bytes one by one take the JVM far longer than numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import octets
from .scalar import bound, rot13

#: Bytes that a text may grow to when it is decompressed; a step that would go on is null.
LARGEST = 64 << 20
SAMPLE = 64
#: White space around a text that doesn't count.
BLANK = " \t\n\r\x0b\x0c"


def text(data: Column) -> Column:
    return F.try_validate_utf8(data.cast("string"))


def without(data: Column, letters: str) -> Column:
    """A text without some letters, looked for as bytes: a translation makes a string of each letter of the text."""
    return reduce(lambda d, x: F.replace(d, F.lit(x), F.lit("")), letters, data)


def hex_decode(data: Column) -> Column:
    # what isn't hexadecimal is null by itself
    def decoded(plain: Column) -> Column:
        return F.when(F.length(plain) % 2 == 0, F.unhex(plain))

    def marked(own: Column) -> Column:
        return F.when(own.startswith("0x") | own.startswith("0X"), F.regexp_replace(own, "^(0x)*(0X)*", "")).otherwise(own)

    return bound(without(bound(F.trim(text(data), F.lit(BLANK)), marked), " \n\r\t"), decoded)


def base64_decode(data: Column) -> Column:
    """Of the usual alphabet or that of URLs, with its padding, and no bits left over: what it decodes to encodes to it again."""

    def usual(plain: Column) -> Column:
        has = lambda letters: reduce(lambda a, b: a | b, (F.contains(plain, F.lit(x)) for x in letters))
        return F.when(~has("-_"), plain).when(~has("+/"), F.replace(F.replace(plain, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")))

    # what holds other letters doesn't encode to itself
    def decoded(u: Column) -> Column:
        return bound(F.when(F.length(u) % 4 == 0, F.try_to_binary(u, F.lit("base64"))), lambda found: F.when(base64_encode(found) == u.cast("binary"), found))

    # both in one level
    return F.aggregate(F.array(without(F.trim(text(data), F.lit(BLANK)), " \n\r")), F.lit(None).cast("string"), lambda _, plain: usual(plain), decoded)


def base64_encode(data: Column) -> Column:
    return F.replace(F.base64(data).cast("string"), F.lit("\r\n"), F.lit("")).cast("binary")


@F.pandas_udf(BinaryType())
def zlib_compress(data: pd.Series) -> pd.Series:
    return data.map(lambda d: zlib.compress(bytes(d), 6), na_action="ignore")


@F.pandas_udf(BinaryType())
def zlib_decompress(data: pd.Series) -> pd.Series:
    def one(d: bytes) -> bytes | None:
        try:
            engine = zlib.decompressobj()
            out = engine.decompress(bytes(d), LARGEST)
            return out if engine.eof else None
        except zlib.error:
            return None

    return data.map(one, na_action="ignore")


STEPS: dict[str, Callable[[Column], Column]] = {
    "hex_encode": lambda d: F.lower(F.hex(d)).cast("binary"), "hex_decode": hex_decode, "base64_encode": base64_encode, "base64_decode": base64_decode, "rot13": lambda d: rot13(text(d)).cast("binary"),
    "url_encode": lambda d: octets.escape(text(d)).cast("binary"), "url_decode": lambda d: octets.unescape(text(d)).cast("binary"), "zlib_compress": zlib_compress, "zlib_decompress": zlib_decompress,
    "reverse": lambda d: F.reverse(text(d)).cast("binary"), "lower": lambda d: F.lower(text(d)).cast("binary"), "upper": lambda d: F.upper(text(d)).cast("binary"),
}


#: Steps by name whose input isn't bound: those that run in Python, where it can't be, and those that bind what they use again. Spark resolves a level of bound values in a pass, and takes no more than 100.
UNBOUND = ("zlib_compress", "zlib_decompress", "hex_decode", "base64_decode")


def step(data: Column, how: str | tuple[str, bytes]) -> Column:
    if isinstance(how, tuple):
        return octets.exclusive_or(data, how[1])
    return STEPS[how](data) if how in UNBOUND else bound(data, STEPS[how])


def cook(data: Column, steps: Sequence[str | tuple[str, bytes]]) -> Column:
    """data after all steps, by name, the plan growing by one step at a time; ("xor", key) is the exclusive or with a repeated key, which is null for an empty one."""
    return reduce(step, steps, data)


def sample(data: Column) -> Column:
    """The first SAMPLE bytes as text with points for control characters, or as hexadecimal numbers where they are no text; and three points if there is more."""

    def shown(d: Column) -> Column:
        head = F.substring(d, 1, SAMPLE)
        return F.concat(F.coalesce(F.regexp_replace(F.try_validate_utf8(head.cast("string")), r"\p{Cc}", "."), F.lower(F.hex(head))), F.when(F.octet_length(d) > SAMPLE, "...").otherwise(""))

    return bound(data, shown)


def preview(rows: DataFrame, data: Column, steps: Sequence[str | tuple[str, bytes]], pattern: str | None = None) -> DataFrame:
    """rows with samples of data and of what the steps make of it, both lengths, and the flags in the output; all null where a step fails.

    The output is computed once, in a projection of its own, and all else from it.
    """
    own = rows.withColumn("_in", data).withColumn("_out", cook(data, steps))
    good = F.col("_out").isNotNull()
    return own.select(
        *rows.columns, F.when(good, sample(F.col("_in"))).alias("input_sample"), sample(F.col("_out")).alias("output_sample"), F.when(good, F.octet_length("_in")).alias("input_len"),
        F.octet_length("_out").alias("output_len"), flags(F.make_valid_utf8(F.col("_out").cast("string")), pattern).alias("flags"),
    )


#: A fixed value: what a flag looks like.
FLAG = r"(?i)(?:flag|ctf|sec|vuln)\{[a-zA-Z0-9_\-\+\.!@#$%^&*?]{3,128}\}"


def flags(data: Column, pattern: str | None = None) -> Column:
    """What matches the pattern, each once and in order."""
    return F.array_distinct(F.regexp_extract_all(data, F.lit(pattern or FLAG), F.lit(0)))
