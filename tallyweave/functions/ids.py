"""Identifiers from contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import normal, strip


def _part(x: Column | str | int) -> Column:
    """As text, stripped and lower-cased; null, 0, false and the empty string are all empty."""
    if not isinstance(x, Column):
        return F.lit(str(x or "").strip().lower())
    return F.coalesce(F.lower(strip(x.cast("string"))), F.lit(""))


def falsy_empty(x: Column) -> Column:
    """A number or flag as a part of an identifier: zero and false are empty."""
    text = x.cast("string")
    return F.when(text.isin("0", "0.0", "false"), F.lit("")).otherwise(text)


def amount_text(x: Column) -> Column:
    """A double as identifiers write it: whole numbers with one decimal, never an exponent below 1e16."""
    return F.when(x == F.floor(x), F.format_string("%.1f", x)).otherwise(x.cast("string"))


def stable_id(prefix: str, *parts: Column | str | int) -> Column:
    """prefix:16 hex digits of the parts' digest."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("|", *[_part(p) for p in parts]), 256), 1, 16))


def project_fingerprint(*fields: Column) -> Column:
    """The digest of normalised fields: equal for one project however it is written."""
    return F.sha2(F.concat_ws("|", *[normal(f.cast("string")) for f in fields]), 256)


def budget_hash(raw: Column, page: Column) -> Column:
    return F.sha2(F.concat(strip(F.coalesce(raw.cast("string"), F.lit(""))), F.lit("|page:"), F.coalesce(page.cast("string"), F.lit("0"))), 256)


def canonical_fiscal_year_id(year: Column) -> Column:
    cleaned = F.regexp_replace(strip(F.coalesce(year, F.lit(""))), r"\s+", " ")
    return stable_id("fiscal_year", F.when(cleaned == "", F.lit("unknown")).otherwise(cleaned))


def content_hash(content: Column) -> Column:
    """Of a file's bytes; empty where there is no file."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def padded_id(prefix: str, number: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.when(F.length(number.cast("string")) >= width, number.cast("string")).otherwise(F.lpad(number.cast("string"), width, "0")))
