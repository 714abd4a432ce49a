"""Where ids are used: counts over several kinds of entities in one pass each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quoted string of a JSON text, of any length: possessive, so that the matcher keeps no state for each character.
QUOTED = r'"((?:[^"\\]++|\\.)++)"'


def strings_of(tree: Column) -> Column:
    """All strings of a JSON text, keys and values, once each: nested layers need no schema."""
    return F.array_distinct(F.regexp_extract_all(tree, F.lit(QUOTED), F.lit(1)))


def usage(sources: dict[str, tuple[DataFrame, Column]], ids: DataFrame, key: str) -> DataFrame:
    """(key, entity, uses): of each id the number of rows of each source whose array of strings holds it, and of all as "total"."""
    found = [df.select(F.lit(name).alias("entity"), F.explode(values).alias("_id")).groupBy("entity", "_id").agg(F.count("*").alias("uses")) for name, (df, values) in sources.items()]
    per = reduce(DataFrame.unionByName, found).join(ids.select(F.col(key).cast("string").alias("_id")), "_id", "left_semi")
    total = per.groupBy("_id").agg(F.sum("uses").alias("uses")).select("_id", F.lit("total").alias("entity"), "uses")
    return per.select("_id", "entity", "uses").unionByName(total).withColumnRenamed("_id", key)


def placeholders(df: DataFrame, columns: list[str], prefix: str = "id") -> DataFrame:
    """(value, placeholder): a stable name for each distinct value of the columns, numbered in order of the values."""
    from collonade.operators.snapshots import numbered

    spark = df.sparkSession
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).where("value IS NOT NULL").distinct()
    rows = numbered(values, spark.range(0).select(F.col("id").alias("n")), "n", "value")
    return rows.select("value", F.concat(F.lit("{{" + prefix + "-"), F.col("n").cast("string"), F.lit("}}")).alias("placeholder"))
