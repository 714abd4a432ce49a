"""Types and references of imported columns, inferred from their values in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collonade.functions.casts import FALSE_WORDS, TRUE_WORDS, parse_date, parse_tokens
from collonade.operators.ordering import ranked

COVERAGE = 0.7


def column_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind): boolean, number, date, url or text, if every value that isn't empty is of it; text for empty columns."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("v")) for c in columns])))
    v = F.col("v")
    tests = {
        "boolean": F.lower(v).isin(*TRUE_WORDS, *FALSE_WORDS),
        "number": v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        "date": parse_date(v).isNotNull(),
        "url": v.rlike(r"^https?://\S+$"),
    }
    seen = cells.groupBy("column").agg(F.count("v").alias("n"), *[F.coalesce(F.bool_and(F.when(v.isNotNull(), F.coalesce(t, F.lit(False)))), F.lit(False)).alias(k) for k, t in tests.items()])
    kind = F.when(F.col("n") == 0, "text").when(F.col("boolean"), "boolean").when(F.col("number"), "number").when(F.col("date"), "date").when(F.col("url"), "url").otherwise("text")
    return seen.select("column", kind.alias("kind"))


def references(df: DataFrame, columns: Sequence[str], ids: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(column, target, coverage, multiple): the collection that most tokens of a column are ids of, if enough are.

    ids has (target, id).
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), parse_tokens(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias("tokens")) for c in columns])))
    tokens = cells.select("column", F.size("tokens").alias("width"), F.explode("tokens").alias("id")).groupBy("column", "id").agg(F.count("*").alias("k"), F.max("width").alias("width"))
    whole = tokens.groupBy("column").agg(F.sum("k").alias("total"), (F.max("width") > 1).alias("multiple"))
    votes = tokens.join(ids, "id").groupBy("column", "target").agg(F.sum("k").alias("hits"))
    best = votes.groupBy("column").agg(F.max_by(F.struct("target", "hits"), F.struct("hits", "target")).alias("b")).select("column", "b.*")
    share = F.col("hits") / F.col("total")
    return best.join(whole, "column").where(share >= coverage).select("column", "target", F.round(share, 4).alias("coverage"), "multiple")


def suggested_mapping(headers: Sequence[str], fields: Sequence[tuple[str, str]]) -> dict[str, str | None]:
    """Header -> key of the field (name, key) of the same name or key, whatever its case; None where there is none."""
    known = {n.strip().lower(): key for name, key in fields for n in (name, key)}
    return {h: known.get(h.strip().lower()) for h in headers}


def duplicate_targets(mapping: dict[str, str | None]) -> list[str]:
    used = [t for t in mapping.values() if t]
    return sorted({t for t in used if used.count(t) > 1})


def remapped(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows with an imported id replaced by its new one (old_id, new_id), null and unresolved = true where there is none."""
    joined = df.join(ids, df[column] == ids["old_id"], "left")
    missed = F.col(column).isNotNull() & F.col("new_id").isNull()
    return joined.withColumn("unresolved", missed).withColumn(column, F.col("new_id")).drop("old_id", "new_id")


def next_ids(df: DataFrame, order: Sequence[str], start: int, group: str) -> DataFrame:
    """Add id: start + 1, 2, ... within each group; places in range partitions, so that a large group is many tasks."""
    return ranked(df, list(order), group, "id").withColumn("id", F.lit(start) + F.col("id"))
