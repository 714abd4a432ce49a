"""Packing by concatenate and cut.

All documents, each closed by an end token, form one long line of tokens that is
cut every ``window`` tokens.  Pass one tokenises, keeps the ids with each
document's place within its partition, and sums tokens by partition; pass two
turns the partition sums into prefix sums, adds them, and cuts each document at
the window borders, so that no row moves and only the last window is not full.

Defined results: a null or empty text is one end token; repeated rows are packed
as often as they occur; an empty table has no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collonade.llm.bpe import encoder
from collonade.llm.common import checkpoint, join_sized, keep, portions

WINDOW, END = 4096, 2


def tokenise(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Pass one, kept: key, part, local_start, doc_tokens, ids (little-endian unsigned 32-bit)."""
    close = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary, library=True), TaskContext.get().partitionId(), 0
        for batch in portions(batches):
            packed = [enc.encode(t or "") + close for t in batch.column(1).to_pylist()]
            sizes = [len(p) // 4 for p in packed]
            starts = []
            for n in sizes:
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=[key, "part", "local_start", "doc_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return keep(docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, part int, local_start bigint, doc_tokens bigint, ids binary"), "tokens")


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a piece: key, start, length, ids (binary), doc_tokens, sequence_id, offset, boundary.

    boundary tells whether the piece is its document's first or last ("first",
    "last", "whole" or "inner").
    """
    tokens = tokenise(docs, vocabulary, key, text)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    prefix = checkpoint(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")))
    placed = join_sized(tokens, prefix, "part").withColumn("at", F.col("part_start") + F.col("local_start"))
    cut = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(at div {window}, (at + doc_tokens - 1) div {window})")))
    first, last = F.expr(f"greatest(sequence_id * {window}, at)"), F.expr(f"least((sequence_id + 1) * {window}, at + doc_tokens)")
    pieces = cut.withColumns({"start": first - F.col("at"), "length": last - first, "offset": first - F.col("sequence_id") * window})
    ends = F.col("start") + F.col("length") == F.col("doc_tokens")
    return pieces.select(
        key,
        "start",
        "length",
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
        "doc_tokens",
        "sequence_id",
        "offset",
        F.when((F.col("start") == 0) & ends, "whole").when(F.col("start") == 0, "first").when(ends, "last").otherwise("inner").alias("boundary"),
    )


def digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op4 returns."""
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")
