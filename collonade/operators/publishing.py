"""Publishing and reverting: change sets, single items, children of parents, and whole sites.

Tables hold both states, told apart by is_published; every operation gives the whole new table,
so that a job that fails midway leaves the old one.  No batch sizes and no caps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state(df: DataFrame, published: bool) -> DataFrame:
    """Rows of one state that aren't deleted."""
    rows = df.where(F.col("is_published") == published)
    return rows.where("deleted_at is null") if "deleted_at" in df.columns else rows


def changed(draft: DataFrame, published: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Drafts without a published twin, and those that differ from it in an attribute; nulls are equal.

    The change set of values, fields, collections, pages, locales, components and all that is published alike.
    """
    twin = published.select(*keys, F.struct(*attributes).alias("_twin"))
    return draft.join(twin, list(keys), "left").where(~F.struct(*attributes).eqNullSafe(F.col("_twin"))).select(*draft.columns)


def changed_counts(draft: DataFrame, published: DataFrame, key: str, group: str, attributes: Sequence[str]) -> DataFrame:
    """(group, n): how many drafts of each group publishing would write, 0 where none."""
    new = changed(draft, published, [key], attributes).select(key, F.lit(1).alias("_new"))
    return draft.join(new, key, "left").groupBy(group).agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("n"))


def deleted_twins(df: DataFrame, key: str) -> DataFrame:
    """Published rows whose draft is deleted."""
    gone = df.where("not is_published and deleted_at is not null").select(key)
    return df.where("is_published").join(gone, key, "left_semi")


def preview(kinds: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """(kind, changed, deleted, total) of each kind of table, and of all as "total": what publishing would write, and what it would delete.

    kinds have a table of both states, its key, and the attributes that are compared.
    """
    one = []
    for name, (df, key, attributes) in kinds.items():
        new = changed(state(df, False), state(df, True), [key], attributes)
        counts = [new.agg(F.count("*").alias("changed")), deleted_twins(df, key).agg(F.count("*").alias("deleted"))]
        one.append(counts[0].join(counts[1]).select(F.lit(name).alias("kind"), "changed", "deleted", (F.col("changed") + F.col("deleted")).alias("total")))
    each = reduce(DataFrame.union, one)
    sums = each.agg(*[F.sum(c).alias(c) for c in ("changed", "deleted", "total")])
    return each.union(sums.select(F.lit("total"), "changed", "deleted", "total"))


def upserted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after publishing all its drafts without a test for changes, as locales and translations are: every draft goes over its twin.

    A deleted draft deletes its twin, and one without a twin publishes nothing.
    """
    draft = df.where("not is_published")
    twins = df.where("is_published").select(*keys)
    going = draft.where("deleted_at is null").unionByName(draft.where("deleted_at is not null").join(twins, list(keys), "left_semi").select(*df.columns))
    rest = df.where("is_published").join(draft.select(*keys), list(keys), "left_anti").select(*df.columns)
    return draft.unionByName(rest).unionByName(going.withColumn("is_published", F.lit(True)))


def child_orphans(children: DataFrame, parent: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not among parents; those without a parent are none."""
    return children.where(F.col(parent).isNotNull()).join(parents.select(F.col(key).alias(parent)), parent, "left_anti")


def _marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def unpublished(items: DataFrame, key: str, ids: DataFrame, publishable: bool = False) -> DataFrame:
    """The table without the published rows of ids; their drafts become publishable or not."""
    rows = _marked(items, key, ids).where("not (_hit and is_published)")
    return rows.withColumn("is_publishable", F.when(F.col("_hit"), F.lit(publishable)).otherwise(F.col("is_publishable"))).select(*items.columns)


def staged(items: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The table without the published rows of ids, whose drafts wait for the next publishing."""
    return unpublished(items, key, ids, publishable=True)


def published_now(items: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The table with ids published as their drafts are; ids without a draft change nothing."""
    drafts = state(items, False).join(ids.select(key), key, "left_semi")
    rest = _marked(items, key, drafts).where("not (_hit and is_published)")
    rest = rest.withColumn("is_publishable", F.col("is_publishable") | F.col("_hit")).select(*items.columns)
    return rest.unionByName(drafts.withColumn("is_published", F.lit(True)).withColumn("is_publishable", F.lit(True)).select(*items.columns))


def synced(df: DataFrame, keys: Sequence[str], parent: str, parents: DataFrame, publish: bool = True) -> DataFrame:
    """The table with the rows of given parents (a column of parent's name) copied into the other state, over what is there."""
    rows = state(df, not publish).join(parents.select(parent), parent, "left_semi").withColumn("is_published", F.lit(publish))
    return df.join(rows.select(*keys, "is_published"), [*keys, "is_published"], "left_anti").unionByName(rows.select(*df.columns))


@dataclass(frozen=True)
class Kind:
    """A table of a site: its key and, if its rows belong to others, the column that names them and their table."""

    name: str
    key: str
    parent: str | None = None
    of: str | None = None


def site(tables: Mapping[str, DataFrame], kinds: Sequence[Kind], publish: bool = True, preserve: Mapping[str, Column] | None = None) -> dict[str, DataFrame]:
    """All tables after publishing a site, or after reverting its drafts to what is published.

    kinds come parents first.  The target state of each table becomes what the source state holds: rows that are not
    deleted, publishable where a table says so, and whose parent is in the target state.  Rows of the target
    without a source go, but for those that meet preserve and have no twin (and a parent, where they need one).
    """
    done: dict[str, DataFrame] = {}
    for kind in kinds:
        df = tables[kind.name]
        rows = state(df, not publish)
        if publish and "is_publishable" in df.columns:
            rows = rows.where("is_publishable")
        target = rows.withColumn("is_published", F.lit(publish)).select(*df.columns)
        if preserve and kind.name in preserve:
            own = df.where((F.col("is_published") == publish) & preserve[kind.name])
            target = target.unionByName(own.join(df.where(F.col("is_published") != publish).select(kind.key), kind.key, "left_anti").select(*df.columns))
        if kind.of is not None:
            above = next(k for k in kinds if k.name == kind.of)
            there = done[kind.of].where(F.col("is_published") == publish).select(F.col(above.key).alias(kind.parent))
            target = target.join(there, kind.parent, "left_semi").select(*df.columns)
        done[kind.name] = df.where(F.col("is_published") != publish).unionByName(target)
    return done
