"""What the operators of this subpackage share: tables, kept results, arrays."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task in Python works on at a time, whatever a batch holds: workers outlive their tasks, and keep what they once took.
ROWS = 256
#: White space that ends a word: space and \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine where none is set and all runs on it (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_collonade_dir", None):
        sc._collonade_dir = tempfile.mkdtemp(prefix="collonade-")
        sc.setCheckpointDir(sc._collonade_dir)
    return sc._collonade_dir


#: The scratch that is open, innermost last; each has the folders kept since it was opened.
_OPEN: list[scratch] = []


class scratch:
    """Kept tables made within are deleted at its end, but for those held; what is held belongs to the scratch around it, if any.

    Whatever is still to be computed then must rest on held or checkpointed tables only.  Shuffle files of what nothing refers to any
    more are let go of at once, and not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.held = spark, [], []

    def hold(self, *tables: DataFrame) -> None:
        self.held += [df._kept for df in tables if getattr(df, "_kept", None)]

    def __enter__(self) -> scratch:
        _OPEN.append(self)
        return self

    def __exit__(self, *error) -> None:
        _OPEN.remove(self)
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            if path in self.held:
                if _OPEN:
                    _OPEN[-1].paths.append(path)
            else:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(hadoop).delete(at, True)
        gc.collect()
        jvm.System.gc()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks it ran, and
    columns such as partition numbers stay what they were when first made.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    if _OPEN:
        _OPEN[-1].paths.append(path)
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small result of an iterative step."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_sized(left: DataFrame, right: DataFrame, on, how: str = "inner", salt: Column | None = None, salts: int = 1, max_bytes: int = 32 << 20) -> DataFrame:
    """Join with a kept right side: broadcast if its columns are at most max_bytes in memory, else by a shuffle.

    right must be a kept or checkpointed table, as its rows and its longest row are looked at first.  With a salt
    (an int below salts for each row of left) the shuffle deals the rows of one key to salts tasks.
    """
    size = F.lit(0)
    for f in right.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            size = size + F.coalesce(F.size(c), F.lit(0)) * 40
        elif isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        size = size + 24
    if (right.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= max_bytes:
        return left.join(F.broadcast(right), on, how)
    if salt is None:
        return left.join(right, on, how)
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(spread, [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ROWS rows, so that no more than those are held as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def prefixes(values: Column, add, block: int = 256) -> Column:
    """For each element of a bigint array what add makes of those before it, from 0; in blocks so that long arrays stay near linear."""

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        step = lambda acc, x: F.struct(add(acc["s"], x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
        return F.aggregate(xs, start, step, lambda acc: acc["a"])

    values = F.transform(values, lambda x: x.cast("bigint"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
        lambda b: F.slice(values, b * block + 1, F.lit(block)),
    )
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), add))
    whole = F.flatten(F.zip_with(blocks, running(sums), lambda x, base: F.transform(running(x), lambda y: add(base, y))))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def prefix_sums(values: Column) -> Column:
    """For each element the sum of those before it."""
    return prefixes(values, lambda a, x: a + x)


def prefix_maxima(values: Column) -> Column:
    """For each element (zero or more) the largest of those before it, or zero."""
    return prefixes(values, lambda a, x: F.greatest(a, x))
