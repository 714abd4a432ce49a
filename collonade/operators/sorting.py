"""Orders and pages of items."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collonade.functions.casts import parse_float

PER_PAGE, MOST_PER_PAGE, LOAD_MORE, MOST_LOAD_MORE = 100, 1000, 10, 100


def mixed_keys(c: Column) -> list[Column]:
    """Sort keys that put '' first, then words that collate before digits, numbers by value, and other words."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    number = parse_float(text)
    word = F.collate(text, "UNICODE")
    rank = F.when(text == "", 0).when(number.isNotNull(), 2).when(word < F.collate(F.lit("0"), "UNICODE"), 1).otherwise(3)
    return [rank, F.when(rank == 2, number), word]


def natural_key(c: Column) -> Column:
    """Words by letter without regard to case and marks, with each run of digits compared as a number."""
    padded = F.regexp_replace(F.regexp_replace(c, r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    return F.collate(padded, "UNICODE_CI_AI")


def by_field(df: DataFrame, field: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    keys = [k.desc() if descending else k.asc() for k in mixed_keys(F.col(field))]
    return df.orderBy(*keys, *([tie] if tie else []))


def default_order(df: DataFrame, manual: str, created: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(manual).asc(), F.col(created).desc(), tie)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def sliced(df: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows from an offset on; offsets and limits of zero or less are ignored."""
    df = df.offset(offset) if offset > 0 else df
    return df.limit(limit) if limit > 0 else df


def page(df: DataFrame, number: int, per_page: int = PER_PAGE) -> DataFrame:
    """A page of an ordered frame: pages count from 1, at most MOST_PER_PAGE rows each."""
    per_page = min(max(1, per_page), MOST_PER_PAGE)
    return sliced(df, (max(1, number) - 1) * per_page, per_page)


def late_page(df: DataFrame, key: str, order: Sequence[Column], number: int, per_page: int = PER_PAGE) -> DataFrame:
    """A page whose other columns are read for its rows alone: only key and order are sorted, then the page's keys find their rows.

    order should leave no ties.  The keys are at most MOST_PER_PAGE, which is what is broadcast.
    """
    keys = page(df.orderBy(*order).select(key), number, per_page)
    return df.join(F.broadcast(keys), key, "left_semi").orderBy(*order)


def page_counts(df: DataFrame, per_page: int) -> DataFrame:
    """One row: total, total_pages."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / per_page)).cast("bigint").alias("total_pages"))


def load_more(df: DataFrame, offset: int, limit: int = LOAD_MORE) -> DataFrame:
    return sliced(df, max(0, offset), min(max(1, limit), MOST_LOAD_MORE))


def top_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, key: str, at: str, columns: Sequence[str], tie: str) -> DataFrame:
    """The newest row of each key, by an aggregate that needs no sort of the groups."""
    newest = F.max_by(F.struct(*columns), F.struct(at, tie))
    return df.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def in_given_order(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows with the given ids, with their position."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    places = spark.createDataFrame([(i, p) for p, i in enumerate(ids)], f"`{key}` {kind}, position bigint")
    return df.join(F.broadcast(places), key)


def by_type(df: DataFrame, field: str, kind: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Number fields by the number that they start with, zero where there is none; others by collation; blank where null."""
    key = F.coalesce(parse_float(F.col(field).cast("string")), F.lit(0.0)) if kind == "number" else F.collate(F.coalesce(F.col(field).cast("string"), F.lit("")), "UNICODE")
    return df.orderBy(key.desc() if descending else key.asc(), *([tie] if tie else []))


def clamped(value: str | int | None, default: int, most: int) -> int:
    """A page size from a request: the default if it is missing, zero or no number, else between 1 and most."""
    found = re.match(r"\s*[+-]?\d+", str(value if value is not None else ""))
    return min(max(1, int(found[0]) if found and int(found[0]) else default), most)


def api_page(df: DataFrame, number=None, per_page=None, limit=None) -> DataFrame:
    """A page by request parameters: a limit is the number of rows, but pages are still per_page apart."""
    size = clamped(per_page, PER_PAGE, MOST_PER_PAGE)
    start = (clamped(number, 1, sys.maxsize) - 1) * size
    return sliced(df, start, size if limit is None else clamped(limit, PER_PAGE, MOST_PER_PAGE))


def has_more(df: DataFrame, offset: int, limit: int = LOAD_MORE) -> DataFrame:
    """One row: total, and whether there are rows after those that load_more gives."""
    end = max(0, offset) + min(max(1, limit), MOST_LOAD_MORE)
    return df.agg(F.count("*").alias("total"), (F.count("*") > end).alias("has_more"))


def overridden(by: str | None, direction: str | None, set_by: str | None = None, set_direction: str | None = None) -> tuple[str | None, str]:
    """The sort that applies: inputs override field and direction where they are valid, each on its own."""
    chosen, way = (set_by or "").strip(), (set_direction or "").strip().lower()
    return chosen if chosen and chosen != "none" else by, way if way in ("asc", "desc") else direction or "asc"


def database_page(df: DataFrame, offset: int | None = None, limit: int | None = None, default: int = 25) -> DataFrame:
    """Rows of an ordered frame from an offset on; an offset without a limit has a default one."""
    if offset and offset > 0 and not limit:
        limit = default
    return sliced(df, offset or 0, limit or 0)


def collections_order(df: DataFrame, order: str, name: str, created: str) -> DataFrame:
    """Collections by their place, then by name as readers sort it, the oldest first."""
    return df.orderBy(order, F.collate(F.col(name), "UNICODE"), created)
