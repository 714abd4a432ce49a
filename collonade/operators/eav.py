"""Entity-attribute-value cells and wide rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.functions.casts import as_text, typed


def to_cells(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(item, field, value): one row for each cell that isn't null, in one pass without a shuffle."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), as_text(F.col(f), k).alias("value")) for f, k in kinds.items()])
    return df.select(F.col(key).alias("item"), F.inline(cells)).where(F.col("value").isNotNull())


def to_rows(cells: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Wide rows of typed values; the fields are given, so that no job has to find them."""
    wide = cells.groupBy("item").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in kinds])
    return wide.select("item", *[typed(F.col(f), k).alias(f) for f, k in kinds.items()])


def to_maps(cells: DataFrame) -> DataFrame:
    """(item, values map): for collections with too many fields for columns."""
    return cells.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("values"))


def snapshot(df: DataFrame, published: bool) -> DataFrame:
    """Rows of the draft or of the published state; published items must be publishable too."""
    rows = df.where(F.col("is_published") == published)
    return rows.where("is_publishable") if published and "is_publishable" in df.columns else rows


def undeleted(df: DataFrame, deleted: bool | None = False) -> DataFrame:
    """Rows that aren't deleted, only those that are (True), or all (None)."""
    if deleted is None:
        return df
    return df.where(F.col("deleted_at").isNotNull() if deleted else F.col("deleted_at").isNull())


def with_ids(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows with the given ids; none for an empty list."""
    return df.where(F.col(key).isin(*ids)) if ids else df.limit(0)


def in_folder(df: DataFrame, folder: str, wanted: Sequence | None) -> DataFrame:
    """Rows in the given folders, None among them or alone being the root."""
    if wanted is None:
        return df.where(F.col(folder).isNull())
    test: Column = F.col(folder).isin(*[w for w in wanted if w is not None])
    return df.where(F.col(folder).isNull() | test if None in wanted else test)


def searched(df: DataFrame, fields: Sequence[str], query: str) -> DataFrame:
    """Rows with a field that the pattern (% and _ are wildcards) is part of; a blank query keeps all."""
    query = query.strip()
    if not query:
        return df
    return df.where(F.exists(F.array(*[F.col(f).cast("string") for f in fields]), lambda v: F.coalesce(v.ilike(f"%{query}%"), F.lit(False))))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without those that come anew, and the new ones."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def patched(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows with the columns of changes where these aren't null; of several changes for a key each column takes its greatest value."""
    columns = [c for c in changes.columns if c not in keys]
    new = changes.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    return old.join(new, list(keys), "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def without_volatile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)
