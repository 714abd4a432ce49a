"""References between collections, resolved by joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 6


@dataclass
class Collection:
    """A wide frame with its key and the fields that refer to other collections."""

    name: str
    rows: DataFrame
    key: str
    references: dict[str, str] = field(default_factory=dict)


def nested(collections: dict[str, Collection], name: str, depth: int = DEPTH, seen: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a collection with each reference replaced by the struct of its target, null where it's missing.

    The schema's references are unrolled to a depth, and a collection on the way is not entered again.
    """
    own = collections[name]
    df = own.rows
    for ref, target in own.references.items():
        if depth < 1 or target in (*seen, name):
            continue
        to = nested(collections, target, depth - 1, (*seen, name))
        key = collections[target].key
        packed = to.select(F.col(key).alias("_key"), F.struct(*to.columns).alias("_target"))
        df = df.join(packed, df[ref] == packed["_key"], "left").drop("_key").withColumn(ref, F.col("_target")).drop("_target")
    return df


def dotted(df: DataFrame, ref: str, target: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with columns ref.field of the referenced row; the row's own columns stay as they are."""
    to = target.select(F.col(key).alias("_key"), *[F.col(f).alias(f"{ref}.{f}") for f in fields])
    return df.join(to, df[ref] == to["_key"], "left").drop("_key")


def many(df: DataFrame, key: str, ids: str, target: DataFrame, target_key: str, fields: Sequence[str], out: str) -> DataFrame:
    """Add out: the structs of the referenced rows in the order of the id list; missing ones are dropped."""
    spread = df.select(F.col(key).alias("_own"), F.posexplode(ids).alias("_at", "_id"))
    met = spread.join(target, spread["_id"] == target[target_key])
    packed = met.groupBy("_own").agg(F.array_sort(F.collect_list(F.struct("_at", F.struct(*fields).alias("v")))).alias("_rows"))
    packed = packed.select("_own", F.transform("_rows", lambda r: r["v"]).alias(out))
    return df.join(packed, df[key] == packed["_own"], "left").drop("_own")


def children(parents: DataFrame, key: str, rows: DataFrame, parent: str, order: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """Add out: for each parent the structs of the rows that point at it, in order; an empty list where there are none."""
    packed = rows.groupBy(F.col(parent).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(out))
    joined = parents.join(packed, parents[key] == packed["_parent"], "left").drop("_parent")
    return joined.withColumn(out, F.coalesce(out, F.filter(F.array(*[F.lit(None).cast(packed.schema[out].dataType.elementType)]), lambda x: F.lit(False))))


def holding(df: DataFrame, ids: str, wanted) -> DataFrame:
    """Rows whose id list holds the wanted id."""
    return df.where(F.array_contains(ids, wanted))


def overlaid(base: DataFrame, keys: Sequence[str], translations: DataFrame, column: str, value: str, done: Column | None = None) -> DataFrame:
    """Rows with a column replaced by its translation where that is complete and not blank; of several the greatest text."""
    use = F.trim(value) != ""
    use = use if done is None else use & done
    over = translations.where(use).groupBy(*keys).agg(F.max(value).alias("_over"))
    return base.join(over, list(keys), "left").withColumn(column, F.coalesce("_over", column)).drop("_over")


def present(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left_semi")


def absent(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left_anti")
