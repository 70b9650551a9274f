"""Codes, names, prefixes and severity labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourlake.functions.times import col
from hourlake.reference_data import NULL_KEY_TEXT, WMO_TEXT

MILE_IN_KM = 1.609344
KEY_PATTERN = "^[A-Za-z0-9_-]{1,20}$"


def wind_to_kph(c: str | Column) -> Column:
    """Mean of the numbers in texts such as ``10 mph`` or ``10 to 15 mph``, times miles per km.

    Text without a number gives null. The factor is applied whatever unit the text names.
    """
    text = F.regexp_replace(F.lower(col(c)), "mph|kph|to", " ")
    numbers = F.regexp_extract_all(text, F.lit(r"(?<!\S)[+-]?(?:\d+\.?\d*|\.\d+)(?!\S)"), F.lit(0)).cast("array<double>")
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + 1).alias("n"))
    return F.aggregate(numbers, zero, add, lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"] * MILE_IN_KM))


def wmo_text(c: str | Column) -> Column:
    """Readable weather condition; an unlisted code becomes ``WMO n``, null stays null."""
    code = col(c).cast("int")
    names = F.create_map(*[F.lit(x) for pair in WMO_TEXT.items() for x in pair])
    return F.coalesce(names[code], F.concat(F.lit("WMO "), code.cast("string")))


def add_prefix(c: str | Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), col(c).cast("string"))


def strip_prefix(c: str | Column, prefix: str) -> Column:
    return F.regexp_replace(col(c), f"^{prefix}", "")


def name_or_code(name: str | Column, code: str | Column) -> Column:
    """Display name, the code itself where there is none."""
    return F.coalesce(F.nullif(F.trim(col(name)), F.lit("")), col(code))


def valid_key(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(KEY_PATTERN), F.lit(False))


def split_valid_keys(df: DataFrame, key_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a well-formed key, and the rejected rest."""
    ok = valid_key(key_col)
    return df.where(ok), df.where(~ok)


def severity(z: str | Column, warn: float = 2.0, crit: float = 3.0) -> Column:
    size = F.abs(col(z))
    return F.when(size >= crit, "critical").when(size >= warn, "warn").otherwise("info")


def severity_rank(c: str | Column) -> Column:
    """3 critical, 2 warning or high or severe, 1 moderate, else 0; reads any spelling of these."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return (
        F.when(text.contains("crit"), 3)
        .when(text.contains("warn") | text.contains("high") | text.contains("sev"), 2)
        .when(text.contains("mod"), 1)
        .otherwise(0)
    )


def is_high_severity(c: str | Column) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).isin("high", "critical", "severe")


def surrogate_key(*cols: str | Column) -> Column:
    """md5 over the key columns joined by ``-``, with a marker text standing for null."""
    marker = F.lit(NULL_KEY_TEXT)
    return F.md5(F.concat_ws("-", *[F.coalesce(col(c).cast("string"), marker) for c in cols]))
