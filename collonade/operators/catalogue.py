"""The catalogue of collections and fields, and what it says about items."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collonade.functions.text import escape_like, file_size
from collonade.operators.hierarchy import reachable


def fields(df: DataFrame, collection=None, published: bool | None = None, computed: bool = True, search: str = "") -> DataFrame:
    """Fields of one collection or of all, of one state or both, by order; without computed ones if asked; search is part of the name."""
    if collection is not None:
        df = df.where(F.col("collection_id") == collection)
    if published is not None:
        df = df.where(F.col("is_published") == published)
    if not computed:
        df = df.where(~F.coalesce("is_computed", F.lit(False)))
    if search.strip():
        df = df.where(F.col("name").ilike(f"%{escape_like(search.strip())}%"))
    return df.orderBy("collection_id", "order", "id")


def with_fields(values: DataFrame, catalogue: DataFrame, attributes: Iterable[str] = ("name", "key", "type")) -> DataFrame:
    """Values with attributes of their field in the same state; values of fields that aren't in the catalogue go."""
    known = catalogue.select(F.col("id").alias("field_id"), "is_published", *attributes)
    return values.join(known, ["field_id", "is_published"])


def inverse_fields(catalogue: DataFrame, collections: DataFrame, target) -> DataFrame:
    """Fields of other collections that refer to the target, with the name of their collection."""
    to = catalogue.where((F.col("reference_collection_id") == target) & (F.col("collection_id") != target))
    return to.join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id")


def projected(df: DataFrame, root: str, wanted: Mapping[str, Iterable[str]]) -> DataFrame:
    """Columns, and fields of structs, that the projection of their path allows; paths without one keep all.

    Paths are names joined by dots from the root on ("orders", "orders.customer"); neither they nor names heed case.
    """
    allowed = {path.lower(): {name.strip().lower() for name in names if name.strip()} for path, names in wanted.items()}

    def kept(schema: T.StructType, path: str) -> list[T.StructField]:
        names = allowed.get(path.lower())
        return [f for f in schema.fields if not names or f.name.lower() in names]

    def rebuilt(c: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: rebuilt(x, kind.elementType, path))
        if not isinstance(kind, T.StructType):
            return c
        parts = [rebuilt(c[f.name], f.dataType, f"{path}.{f.name}").alias(f.name) for f in kept(kind, path)]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else F.lit(None)

    return df.select(*[rebuilt(F.col(f"`{f.name}`"), f.dataType, f"{root}.{f.name}").alias(f.name) for f in kept(df.schema, root)])


def with_status(df: DataFrame, column: str, wanted: str | None, allowed: Iterable[str]) -> DataFrame:
    """Rows of a status; one that isn't allowed is ignored and keeps all."""
    return df.where(F.col(column) == wanted) if wanted in set(allowed) else df


def by_slug(wanted: DataFrame, items: DataFrame, translations: DataFrame) -> DataFrame:
    """wanted (slug, locale) with id: the item whose slug in that locale it is, else whose own slug it is, else null.

    items: (id, slug); translations: (id, locale, slug).  Of several the least id counts.
    """
    over = translations.groupBy("slug", "locale").agg(F.min("id").alias("_over"))
    own = items.groupBy("slug").agg(F.min("id").alias("_own"))
    met = wanted.join(over, ["slug", "locale"], "left").join(own, "slug", "left")
    return met.withColumn("id", F.coalesce("_over", "_own")).drop("_over", "_own")


#: Names of the fields that an asset has as an item of a list of assets.
ASSET_FIELDS = ("__asset_filename", "__asset_url", "__asset_file_size", "__asset_mime_type", "__asset_width", "__asset_height")


def asset_fields(df: DataFrame, name: str, url: str, size: str, mime: str, width: str, height: str) -> DataFrame:
    """df with six text columns that stand for an asset's fields; what is missing is '', and a missing size is none at all."""
    values = [F.col(name), F.col(url), file_size(F.coalesce(F.col(size), F.lit(0))), F.col(mime), F.col(width), F.col(height)]
    return df.withColumns({k: F.coalesce(c.cast("string"), F.lit("")) for k, c in zip(ASSET_FIELDS, values, strict=True)})


def merged_ids(*lists: Column) -> Column:
    """Id lists in one, each id once, in order of first appearance; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(c.cast("array<string>"), none) for c in lists]))


def leading_to(fields: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """(id) of the references whose collection has a field of one of the kinds, itself or through further references, in any cycle.

    fields have (id, collection_id, type, reference_collection_id); references to many are neither followed nor found.
    """
    refs = fields.where("type = 'reference'").select("id", "collection_id", "reference_collection_id")
    has = fields.where(F.col("type").isin(*kinds) & (F.col("type") != "multi_reference")).select("collection_id")
    found = reachable(refs.select(F.col("reference_collection_id").alias("a"), F.col("collection_id").alias("b")), has)
    return refs.join(found.select(F.col("node").alias("reference_collection_id")), "reference_collection_id", "left_semi").select("id")
