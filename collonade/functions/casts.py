"""Values of collection fields: from text to types and back.

Every parse is tolerant: what doesn't parse is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest numeric prefix that a lenient float parser reads.
FLOAT_PREFIX = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
INT_PREFIX = r"^\s*([+-]?\d+)"
TRUE_WORDS, FALSE_WORDS = ["true", "1", "yes", "y"], ["false", "0", "no", "n"]
LIST_KINDS = {"multi_reference"}


def parse_float(c: Column) -> Column:
    """The number that the text starts with, or null."""
    return F.regexp_extract(c, FLOAT_PREFIX, 1).try_cast("double")


def parse_int(c: Column) -> Column:
    """The integer that the text starts with, or null."""
    return F.regexp_extract(c, INT_PREFIX, 1).try_cast("bigint")


def parse_date(c: Column) -> Column:
    """A timestamp from ISO forms or from the long text form of scripts (weekday and zone name dropped, the offset applied)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},? +", ""), r" GMT([+-]\d{4})?.*$", "")
    offset = F.regexp_extract(c, r" GMT([+-]\d{4})", 1)
    ahead = (F.concat(F.left(offset, F.lit(1)), F.substring(offset, 2, 2)).try_cast("int") * 60 + F.concat(F.left(offset, F.lit(1)), F.substring(offset, 4, 2)).try_cast("int")).cast("int")
    long = F.try_to_timestamp(bare, F.lit("MMM dd yyyy HH:mm:ss"))
    long = F.when(ahead.isNotNull() & (ahead != 0), F.timestamp_add("MINUTE", -ahead, long)).otherwise(long)
    iso = F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(c).try_cast("timestamp"))
    return F.coalesce(iso, long, F.try_to_timestamp(bare, F.lit("MMM d, yyyy")))


def parse_list(c: Column) -> Column:
    """A JSON array of ids, or an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def parse_tokens(c: Column) -> Column:
    """Reference tokens: a JSON list, else split at commas, else at semicolons, else one."""
    parts = F.when(F.contains(c, F.lit(",")), F.split(c, ",")).when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.array(c))
    cut = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), cut, F.array().cast("array<string>"))


def typed(c: Column, kind: str) -> Column:
    """A cell's text as its field's type; absent, null and empty cells are null (false for booleans stays false)."""
    c = F.nullif(c, F.lit(""))
    if kind == "number":
        return parse_float(c)
    if kind == "boolean":
        return F.when(c.isNotNull(), c.isin("true", "1", "yes"))
    if kind == "date":
        return parse_date(c)
    if kind in LIST_KINDS:
        return F.when(c.isNotNull(), parse_list(c))
    if kind in ("rich_text", "link"):
        return F.try_parse_json(c)
    return c


def as_text(c: Column, kind: str) -> Column:
    """A typed value as the text of a cell."""
    if kind == "boolean":
        return F.when(c, "true").when(~c, "false")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if kind in LIST_KINDS or kind in ("rich_text", "link"):
        return F.to_json(c)
    if kind == "number":
        whole = c.try_cast("bigint")
        return F.when(whole.cast("double") == c, whole.cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def coerced(c: Column, kind: str) -> Column:
    """An imported cell's text as the text to store, or null if it can't be converted."""
    cell = F.nullif(F.trim(c), F.lit(""))
    if kind == "number":
        return as_text(parse_float(cell), "number")
    if kind == "boolean":
        low = F.lower(cell)
        return F.when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false")
    if kind == "date":
        return as_text(parse_date(cell), "date")
    return cell


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))
