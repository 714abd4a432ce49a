"""An export of another content system: a folder of CSV files, one a collection, that refer to each other by item ids.

Each file has its own header, so its cells become rows (collection, row, field, value) at once, and
everything after that works on all collections together: ids in one pass, references in another.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collonade.functions.casts import parse_tokens
from collonade.operators.ordering import ranked
from collonade.sources.files import OPTIONS, last_of_each

COLLECTION, ITEM = "Collection ID", "Item ID"
COVERAGE = 0.7
CELL = "collection string, name string, row bigint, field string, value string"


def title(file: str) -> str:
    """A collection's name from its file's: what stands between the first and the second " - ", else the file's own."""
    parts = os.path.basename(unquote(file)).split(" - ")
    return parts[1] if len(parts) > 1 else re.sub(r"\.csv$", "", parts[0], flags=re.I)


def read_file(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(cells of a file, the collection's id in its first row): rows are numbered from 0 as they stand in the file.

    Cells are trimmed; a field without a value has no cell.
    """
    header = spark.read.options(**OPTIONS).csv(path).first()
    at = last_of_each([] if header is None else list(header))
    if not at:
        return spark.createDataFrame([], CELL).drop("collection"), None
    width = max(at.values()) + 1
    rows = spark.read.options(**OPTIONS, header=True, enforceSchema=True).schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
    rows = rows.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    numbered = ranked(rows, ["_block", "_line"], out="row")
    first = numbered.where("row = 1").first()
    own = first[f"c{at[COLLECTION]}"] if first is not None and COLLECTION in at else None
    cells = F.array(*[F.struct(F.lit(name).alias("field"), F.trim(F.col(f"c{i}")).alias("value")) for name, i in at.items()])
    made = numbered.select(F.lit(title(path)).alias("name"), (F.col("row") - 1).alias("row"), F.inline(cells))
    return made.where("value <> ''"), (own or "").strip() or None


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """(collection, name, row, field, value): all cells of an export's files; a file that names no collection is one by its own name.

    There is a plan for each file, so this is for as many files as an export has collections.
    """
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").orderBy("path").collect()]
    out = [spark.createDataFrame([], CELL)]
    for path in files:
        cells, own = read_file(spark, path)
        out.append(cells.select(F.lit(own or title(path)).alias("collection"), "name", "row", "field", "value"))
    return reduce(DataFrame.unionByName, out)


def items(cells: DataFrame) -> DataFrame:
    """(collection, row, old_id, id): every row's item with the id that it had, or its place where it had none, and a new one that is the same in each run."""
    old = F.max(F.when(F.col("field") == ITEM, F.col("value")))
    rows = cells.groupBy("collection", "row").agg(old.alias("old"))
    named = rows.withColumn("old_id", F.coalesce("old", F.concat_ws(":", "collection", F.col("row").cast("string"))))
    return named.select("collection", "row", "old_id", F.sha2(F.concat_ws("\x1f", "collection", "old_id"), 256).alias("id"))


def targets(cells: DataFrame, ids: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(collection, field, target, multiple): the collection that most of a field's tokens are items of, where enough are; the item's and the collection's own ids aside."""
    tokens = cells.where(~F.col("field").isin(COLLECTION, ITEM)).select("collection", "field", parse_tokens(F.col("value")).alias("t"))
    each = tokens.select("collection", "field", F.size("t").alias("width"), F.explode("t").alias("old_id")).groupBy("collection", "field", "old_id").agg(F.count("*").alias("k"), F.max("width").alias("width"))
    whole = each.groupBy("collection", "field").agg(F.sum("k").alias("total"), (F.max("width") > 1).alias("multiple"))
    known = ids.select(F.col("collection").alias("target"), "old_id").distinct()
    votes = each.join(known, "old_id").groupBy("collection", "field", "target").agg(F.sum("k").alias("hits"))
    best = votes.groupBy("collection", "field").agg(F.max_by("target", F.struct("hits", "target")).alias("target"), F.max("hits").alias("hits"))
    return best.join(whole, ["collection", "field"]).where(F.col("hits") >= coverage * F.col("total")).select("collection", "field", "target", "multiple")


def imported(cells: DataFrame, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(values, warnings) of an export: (collection, id, field, value) with references to the new ids, and (collection, field, value) that lead nowhere.

    A field with several tokens in any cell holds lists, written as JSON in their order; of a list what leads nowhere is left out, and a list of
    nothing is a warning.
    """
    ids = items(cells)
    refers = targets(cells, ids, coverage)
    own = cells.join(ids.select("collection", "row", "id"), ["collection", "row"])
    typed = own.join(refers, ["collection", "field"], "left")
    plain = typed.where("target IS NULL").select("collection", "id", "field", "value")
    spread = typed.where("target IS NOT NULL").select("collection", "id", "field", "value", "target", "multiple", F.posexplode(parse_tokens(F.col("value"))).alias("at", "old_id"))
    # An id that is there twice in a collection is one item.
    to = ids.groupBy(F.col("collection").alias("target"), "old_id").agg(F.min("id").alias("to"))
    met = spread.join(to, ["target", "old_id"], "left")
    packed = met.groupBy("collection", "id", "field", "value", "multiple").agg(F.array_sort(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("at", "to")))).alias("found"), F.min_by("to", "at").alias("one"))
    many = F.to_json(F.transform("found", lambda x: x["to"]))
    made = packed.withColumn("new", F.when(F.col("multiple"), many).otherwise(F.col("one")))
    warnings = made.where(F.when(F.col("multiple"), F.size("found") == 0).otherwise(F.col("one").isNull())).select("collection", "field", "value")
    return plain.unionByName(made.where("new IS NOT NULL").select("collection", "id", "field", F.col("new").alias("value"))), warnings
