"""Files in and out: CSV with tolerant coercion, project dumps, sitemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collonade.functions.casts import coerced
from collonade.functions.text import escape_xml

VOLATILE = ["created_at", "updated_at", "deleted_at"]


OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "multiLine": False}


def last_of_each(header: Sequence[str | None]) -> dict[str, int]:
    """Column of each name; of columns with one name the last counts, and columns without a name don't."""
    return {h.strip(): i for i, h in enumerate(header) if h and h.strip()}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns by header, of columns with one name the last; cells trimmed, missing ones ''."""
    header = spark.read.options(**OPTIONS).csv(path).first()
    at = last_of_each([] if header is None else list(header))
    if not at:
        return spark.createDataFrame([], T.StructType([]))
    places = ", ".join(f"c{i} string" for i in range(max(at.values()) + 1))
    df = spark.read.options(**OPTIONS, header=True, enforceSchema=True).schema(places).csv(path)
    return df.select(*[F.coalesce(F.trim(F.col(f"c{i}")), F.lit("")).alias(name) for name, i in at.items()])


def coerced_rows(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows with converted cells, warnings with field and value of those that aren't empty and can't be converted)."""
    tried = df.select(*[c for c in df.columns if c not in kinds], *[F.struct(F.col(c).alias("raw"), coerced(F.col(c), k).alias("v")).alias(c) for c, k in kinds.items()])
    rows = tried.select(*[c for c in df.columns if c not in kinds], *[F.col(f"{c}.v").alias(c) for c in kinds])
    bad = tried.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}.raw").alias("value"), F.col(f"{c}.v").alias("v")) for c in kinds])))
    return rows, bad.where(F.col("v").isNull() & (F.trim("value") != "")).select("field", "value")


def dump(df: DataFrame, path: str) -> None:
    """Rows that aren't deleted, without volatile columns, as gzipped JSON lines."""
    rows = df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df
    rows.drop(*VOLATILE).write.mode("overwrite").json(path, compression="gzip")


def restore(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def catalogue(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of each column."""
    return [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema]


def sitemap_entries(df: DataFrame, url: str) -> DataFrame:
    """One XML entry a row, to be written as text between the head and foot of a sitemap."""
    return df.select(F.concat(F.lit("<url><loc>"), escape_xml(F.col(url)), F.lit("</loc></url>")).alias("entry"))
