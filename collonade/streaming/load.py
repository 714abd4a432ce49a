"""A load of files that can be stopped and run again: each batch is taken once.

The stream's own checkpoint tells which files a batch has; the store's ledger tells which
batches are in, in the same commit as their rows.  A run that dies between the two is given
its last batch again, finds it in the ledger, and goes on.  There is no cursor
that could count successes only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collonade.functions.casts import coerced
from collonade.sources.store import Store

#: Examples that are kept of each kind of error.
EXAMPLES = 50
ERRORS = "problems"


@dataclass(frozen=True)
class Load:
    """Rows of text columns for a table: its name, the column of the row's own key, kinds of columns to convert, and those that must not be empty."""

    name: str
    table: str
    key: str
    kinds: Mapping[str, str] = field(default_factory=dict)
    required: Sequence[str] = ()


def problems(rows: DataFrame, load: Load) -> DataFrame:
    """(row, field, problem, value): cells that aren't empty and can't be converted, and required ones that are empty."""
    checks = [F.when(coerced(F.col(c), k).isNull() & (F.trim(F.col(c)) != ""), F.struct(F.lit(c).alias("field"), F.lit(f"not a {k}").alias("problem"), F.col(c).alias("value"))) for c, k in load.kinds.items()]
    checks += [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"), F.lit("").alias("value"))) for c in load.required]
    if not checks:
        return rows.select(F.col(load.key).alias("row"), F.lit("").alias("field"), F.lit("").alias("problem"), F.lit("").alias("value")).limit(0)
    return rows.select(F.col(load.key).alias("row"), F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))


def summed(found: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(field, problem, total, first): how many of each kind, exactly, and the first of them by row.

    Spark keeps no more than the first of each kind in a task before it shuffles them.
    """
    place = F.row_number().over(Window.partitionBy("field", "problem").orderBy("row", "value"))
    first = found.withColumn("_at", place).where(F.col("_at") <= examples).groupBy("field", "problem").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("first"))
    return found.groupBy("field", "problem").agg(F.count("*").alias("total")).join(first, ["field", "problem"])


def converted(rows: DataFrame, load: Load) -> DataFrame:
    """Rows with converted cells; those without a required one are left out, and count as failed."""
    kept = [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in load.required]
    for test in kept:
        rows = rows.where(test)
    return rows.select(*[coerced(F.col(c), load.kinds[c]).alias(c) if c in load.kinds else F.col(c) for c in rows.columns])


def load_files(spark: SparkSession, folder: str, schema: str, store: Store, load: Load, checkpoint: str, files_a_batch: int = 100, examples: int = EXAMPLES, after=None) -> None:
    """Take all CSV files of a folder that no run before has taken into the store, batch by batch.

    Each batch adds its rows and its errors in one commit.  after(batch), if given, is called when a batch is in the store and not yet in
    the stream's checkpoint, which is where a failure is hardest to get right.
    """
    source = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_a_batch).option("quote", '"').option("escape", '"').csv(folder)

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.fillna("", [f.name for f in batch.schema if f.dataType.simpleString() == "string"])
        noted = summed(problems(rows, load), examples).select(F.lit(load.name).alias("load"), F.lit(number).cast("bigint").alias("batch"), "field", "problem", "total", "first")
        store.insert({load.table: converted(rows, load), ERRORS: noted}, receipt=(load.name, number))
        if after:
            after(number)

    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def report(store: Store, name: str, examples: int = EXAMPLES) -> DataFrame:
    """(field, problem, total, first) of a whole load: exact totals, and the first of each kind over all batches."""
    rows = store.read(ERRORS).where(F.col("load") == name)
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, examples)
    return rows.groupBy("field", "problem").agg(F.sum("total").alias("total"), first.alias("first"))
