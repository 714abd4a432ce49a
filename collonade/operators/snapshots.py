"""Draft and published states: what differs, and what publishing makes of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collonade.functions.text import item_hash
from collonade.operators.ordering import ranked


def with_hash(df: DataFrame, fields: Sequence[str], out: str = "content_hash") -> DataFrame:
    """Add the hash of the fields' values, computed anew so that it can't be stale."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.withColumn(out, item_hash(values))


def compared(draft: DataFrame, published: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, status) of each key of either side: new, updated, deleted or same, by null-safe comparison."""
    d = draft.select(key, F.struct(*columns).alias("_d"))
    p = published.select(key, F.struct(*columns).alias("_p"))
    status = F.when(F.col("_p").isNull(), "new").when(F.col("_d").isNull(), "deleted").when(F.col("_d").eqNullSafe(F.col("_p")), "same").otherwise("updated")
    return d.join(p, key, "full_outer").select(key, status.alias("status"))


def change_counts(draft: DataFrame, published: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return compared(draft, published, key, columns).groupBy("status").agg(F.count("*").alias("n"))


def published_from(draft: DataFrame, published: DataFrame, key: str, publishable: str) -> DataFrame:
    """The published state after publishing: publishable drafts as they are, without those that aren't, and nothing that has no draft."""
    return draft.where(publishable).select(*published.columns)


def orphans(published: DataFrame, draft: DataFrame, key: str, preserve: DataFrame | None = None) -> DataFrame:
    """Published rows without a draft, but for those to preserve; over whole tables, however long."""
    gone = published.join(draft.select(key), key, "left_anti")
    return gone if preserve is None else gone.join(preserve.select(key), key, "left_anti")


def cascaded(parents: DataFrame, key: str, rows: DataFrame, parent: str, mark: str = "deleted") -> DataFrame:
    """Rows with mark true where their parent is in parents."""
    hit = parents.select(F.col(key).alias(parent)).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, parent, "left").withColumn(mark, F.coalesce("_hit", F.lit(False))).drop("_hit")


def resequenced(df: DataFrame, parent: str, order: Sequence[str], out: str = "position") -> DataFrame:
    """Add places 0, 1, 2 ... among siblings."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1).cast("bigint"))


def shifted(df: DataFrame, position: str, start: int) -> DataFrame:
    """Rows with positions from start on moved up by one."""
    return df.withColumn(position, F.when(F.col(position) >= start, F.col(position) + 1).otherwise(F.col(position)))


def numbered(df: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with key = the existing maximum + 1, 2, ... by order; no single task orders all rows."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
    rows = ranked(df, [order], out="_rank").join(F.broadcast(top))
    return rows.withColumn(key, F.col("_top") + F.col("_rank")).drop("_rank", "_top")
