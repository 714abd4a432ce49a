"""Items of collections: one scan with all its filters, lookups, copies, sets of ids, and counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.functions.casts import parse_int
from collonade.functions.text import unique_slugs
from collonade.operators import eav, sorting
from collonade.operators.ordering import ranked


def scanned(df: DataFrame, key: str, published: bool = False, deleted: bool | None = False, search: str = "", fields: Sequence[str] = (), ids: DataFrame | None = None) -> DataFrame:
    """Items of a state: not deleted (only those that are, or all), that a text is part of in a field, and whose id is given; all filters in one scan.

    ids (a column of key's name) may be any number; none given is no filter, and an empty frame keeps nothing.
    """
    rows = eav.undeleted(eav.snapshot(df, published), deleted)
    rows = eav.searched(rows, fields, search)
    return rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_semi")


def paged(df: DataFrame, manual: str, created: str, tie: str, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of items in their default order with total, the number of all items, on each row."""
    total = df.agg(F.count("*").alias("total"))  # one row
    page = sorting.sliced(sorting.default_order(df, manual, created, tie), offset, limit)
    return page.join(F.broadcast(total))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The item of an id, deleted or not."""
    return df.where(F.col(key) == value)


def like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows with the pattern as part of a column, without regard to case; % and _ are wildcards."""
    return df.where(F.col(column).ilike(f"%{pattern}%"))


def referring(rows: DataFrame, field: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows with parent, a key of parents that their reference or list of references holds; a row for each one held."""
    wanted = parents.select(F.col(key).alias("parent")).distinct()
    if rows.schema[field].dataType.typeName() != "array":
        return rows.join(wanted, F.col(field) == F.col("parent"))
    return rows.withColumn("_one", F.explode(F.array_distinct(field))).join(wanted, F.col("_one") == F.col("parent")).drop("_one")


def grouped(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, ids, n): sorted ids of each group, which are its result and as long as it is."""
    return df.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("ids"), F.count("*").alias("n"))


def counted(df: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """(group, n), with 0 for groups (a column of group's name) that have no rows."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    return n if groups is None else groups.select(group).distinct().join(n, group, "left").fillna(0, ["n"])


def next_number(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """One more than the largest number that a column's text begins with, in each group if there is one; 1 where there is none."""
    number = parse_int(F.col(column).cast("string"))
    return df.groupBy(*([group] if group else [])).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def in_any(*ids: DataFrame) -> DataFrame:
    """Ids of any of the sets (one column each, named as in the first), once."""
    return reduce(lambda a, b: a.union(b), ids).distinct()


def in_all(*ids: DataFrame) -> DataFrame:
    """Ids of all of the sets, once; one shuffle, however many sets."""
    name = ids[0].columns[0]
    marked = [df.select(F.col(df.columns[0]).alias(name), F.lit(1 << k).alias("_in")) for k, df in enumerate(ids)]
    return reduce(DataFrame.union, marked).groupBy(name).agg(F.bit_or("_in").alias("_in")).where(F.col("_in") == (1 << len(ids)) - 1).select(name)


def in_first(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids of the first set that no other one has, once."""
    name = first.columns[0]
    marked = [df.select(F.col(df.columns[0]).alias(name), F.lit(k > 0).alias("_other")) for k, df in enumerate((first, *others))]
    return reduce(DataFrame.union, marked).groupBy(name).agg(F.bool_or("_other").alias("_other")).where("not _other").select(name)


def tagged(kinds: Mapping[str, DataFrame], tag: str = "kind") -> DataFrame:
    """Rows of several kinds in one frame with their kind; what a kind has no column for is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in kinds.items()])


def resequenced(kinds: Mapping[str, DataFrame], key: str, parent: str, order: str, tag: str = "kind") -> DataFrame:
    """(kind, key, order) of the siblings of all kinds that don't stand at their place 0, 1, 2, ... among each other."""
    rows = tagged({k: df.select(key, parent, order) for k, df in kinds.items()}, tag)
    placed = ranked(rows, [order, tag, key], parent, "_place").withColumn("_place", F.col("_place") - 1)
    return placed.where(~F.col(order).eqNullSafe(F.col("_place"))).select(tag, key, F.col("_place").alias(order))


def duplicated(items: DataFrame, chosen: DataFrame, key: str, name: str, slug: str, stamps: Sequence[str] = (), now: Column | None = None) -> DataFrame:
    """Copies of chosen items (a column of key's name): the next ids, "(Copy)" after the name, a slug of their own, and new times.

    A slug is the old one without a number at its end, with -copy, then -copy-1, -copy-2 and so on where those are in use; an empty one is
    copy-copy.  A missing name stays so.
    """
    top = items.agg(F.coalesce(F.max(parse_int(F.col(key).cast("string"))), F.lit(0)).alias("_top"))  # one row
    rows = ranked(items.join(chosen.select(key).distinct(), key, "left_semi"), [key], out="_rank").join(F.broadcast(top))
    bare = F.coalesce(F.nullif(F.trim(slug), F.lit("")), F.lit("copy"))
    rows = rows.withColumn("_base", F.concat(F.regexp_replace(bare, r"-\d+$", ""), F.lit("-copy")))
    named = unique_slugs(rows, "_base", "_rank", "_slug", taken=items.where(F.col(slug).isNotNull()).select(F.col(slug).alias("_base")), first=1)
    new = {key: (F.col("_top") + F.col("_rank")).cast(items.schema[key].dataType), name: F.concat(name, F.lit(" (Copy)")), slug: F.col("_slug")} | {c: now for c in stamps}
    return named.select(*[new[c].alias(c) if c in new else F.col(c) for c in items.columns])


def incremented(df: DataFrame, column: str, where: Column, by: int = 1) -> DataFrame:
    """Rows with a column raised where a condition holds for sure."""
    return df.withColumn(column, F.when(where, F.col(column) + by).otherwise(F.col(column)))


def replaced(items: DataFrame, new: DataFrame, key: str, protected: Sequence[str] = ("id", "created_at", "updated_at")) -> DataFrame:
    """The table with whole items replaced: what the new one (one row a key) doesn't give is null, but key and protected columns stay as they are."""
    given = [c for c in new.columns if c != key and c not in protected]
    fixed = {key, *protected}
    over = new.select(key, F.struct(*[F.col(c) for c in given]).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c] if c in given else F.lit(None)).otherwise(F.col(c)).alias(c)
    return items.join(over, key, "left").select(*[F.col(c) if c in fixed else value(c) for c in items.columns])


def failures(events: DataFrame, key: str, at: str, success: Column) -> DataFrame:
    """(key, failures, last_success): how often each has failed since it last succeeded, as a counter that a success resets would tell."""
    told = events.select(key, F.col(at).alias("_at"), F.coalesce(success, F.lit(False)).alias("_ok"))
    last = told.groupBy(key).agg(F.max(F.when(F.col("_ok"), F.col("_at"))).alias("last_success"))
    since = told.join(last, key).where(~F.col("_ok") & (F.col("last_success").isNull() | (F.col("_at") > F.col("last_success"))))
    return last.join(since.groupBy(key).agg(F.count("*").alias("failures")), key, "left").select(key, F.coalesce("failures", F.lit(0)).alias("failures"), "last_success")


def marked(log: DataFrame, key: str, chosen: DataFrame, status: str, value: str) -> DataFrame:
    """A log with the status of chosen rows (a column of key's name) set."""
    hit = chosen.select(key).distinct().withColumn("_hit", F.lit(True))
    return log.join(hit, key, "left").withColumn(status, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(status))).select(*log.columns)


def urls(pages: DataFrame, items: DataFrame, locales: DataFrame, slugs: DataFrame) -> DataFrame:
    """(page, item, locale, url): every page's address in every locale, and for pages of a collection every item's.

    pages: page, path, collection (null for one without items), skipped (error pages and those kept from search engines);
    items: item, collection, slug; locales: locale, is_default; slugs: item, locale, slug of translated items.  An item without a slug has
    no address, and the default locale has no prefix.  Items and locales of a page are a join by collection and, of the few
    locales there are, one list carried along.
    """
    codes = locales.agg(F.sort_array(F.collect_list(F.struct("locale", "is_default"))).alias("_locales"))  # one row
    live = pages.where(~F.coalesce("skipped", F.lit(False)))
    plain = live.where("collection IS NULL").select("page", "path", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit("").alias("slug"))
    listed = live.join(items.where("slug <> ''"), "collection").select("page", "path", "item", "slug")
    each = plain.unionByName(listed).join(F.broadcast(codes)).select("page", "path", "item", "slug", F.inline("_locales"))
    over = slugs.where("trim(slug) <> ''").groupBy("item", "locale").agg(F.max("slug").alias("_own"))
    told = each.join(over, ["item", "locale"], "left").withColumn("slug", F.when(F.col("is_default"), F.col("slug")).otherwise(F.coalesce("_own", "slug")))
    parts = F.array(F.when(~F.col("is_default"), F.col("locale")), F.nullif(F.trim(F.col("path")), F.lit("")), F.nullif(F.col("slug"), F.lit("")))
    return told.select("page", "item", "locale", F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "/")).alias("url"))
