"""A project of several tables that change all at once or not at all.

A store is a folder with ``data/<commit>/<table>/`` for rows and ``manifests/`` for what
is current.  Rows are written beside the old ones, read back and verified; then one manifest
file is written, by a job of one task, and the rename that commits that file is the
switch.  Until then, and if anything fails before it, every table reads as it
did.  Files are reached through Spark only, so a store can be anywhere that Spark writes to.
One writer at a time is assumed, as for any table that is overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version bigint, commit string, tables string, ledger string"


class Rejected(ValueError):
    """Rows that were written beside the store failed a check; the store is as it was."""


@dataclass(frozen=True)
class Table:
    """What a table must hold to: the columns of its key, and which columns refer to the key of which other table."""

    name: str
    key: Sequence[str]
    references: Mapping[str, str] = field(default_factory=dict)


def ordered(tables: Sequence[Table]) -> list[Table]:
    """The tables, each after those that it refers to; itself aside, a circle is an error."""
    left, done = {t.name: t for t in tables}, []
    while left:
        free = [t for t in left.values() if not any(r in left and r != t.name for r in t.references.values())]
        if not free:
            raise ValueError(f"tables refer to each other in a circle: {', '.join(sorted(left))}")
        done += free
        for t in free:
            del left[t.name]
    return done


def faults(rows: DataFrame, table: Table, others: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], old: DataFrame | None = None, expected: int | None = None) -> list[str]:
    """What is wrong with rows of a table: their number, null or repeated keys, keys that old rows have, references to nothing."""
    found = []
    key = list(table.key)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])).alias("nulls")).first()
    if expected is not None and counts["n"] != expected:
        found.append(f"{table.name}: {counts['n']} rows, {expected} expected")
    if counts["nulls"]:
        found.append(f"{table.name}: {counts['nulls']} rows without a key")
    if n := rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").count():
        found.append(f"{table.name}: {n} keys occur more than once")
    if old is not None and (n := rows.select(*key).join(old.select(*key), key, "left_semi").count()):
        found.append(f"{table.name}: {n} keys are there already")
    for column, other in table.references.items():
        there = others[other].select(F.col(keys[other][0]).alias(column))
        if n := rows.where(F.col(column).isNotNull()).join(there, column, "left_anti").count():
            found.append(f"{table.name}.{column}: {n} references to nothing in {other}")
    return found


class Store:
    """Tables of a folder; every change is one commit."""

    def __init__(self, spark: SparkSession, root: str, tables: Sequence[Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), {t.name: t for t in ordered(tables)}

    def current(self) -> dict:
        """The newest manifest: parts and schema of each table, and a ledger of what has been taken in."""
        files = self.spark.createDataFrame([], MANIFEST)
        path = f"{self.root}/manifests"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            files = self.spark.read.schema(MANIFEST).json(path)
        last = files.agg(F.max(F.struct("version", "commit", "tables", "ledger")).alias("m")).first()["m"]
        if last is None:
            return {"version": 0, "tables": {}, "ledger": {}}
        return {"version": last["version"], "tables": json.loads(last["tables"]), "ledger": json.loads(last["ledger"])}

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows of a table as of a manifest, by default the newest; a table that was never written has none and no columns."""
        entry = (manifest or self.current())["tables"].get(name)
        if entry is None:
            return self.spark.createDataFrame([], T.StructType([]))
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(*entry["parts"])

    def _written(self, commit: str, name: str, rows: DataFrame) -> tuple[str, DataFrame]:
        path = f"{self.root}/data/{commit}/{name}"
        rows.write.parquet(path)
        return path, self.spark.read.schema(rows.schema).parquet(path)

    def _switch(self, manifest: dict, commit: str, tables: dict, ledger: dict) -> None:
        row = [(manifest["version"] + 1, commit, json.dumps(tables), json.dumps(ledger))]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/manifests")

    def _parents(self, name: str, new: Mapping[str, DataFrame], staying: dict) -> dict[str, DataFrame]:
        """The tables that a table refers to: new rows where there are any, else those that stay."""
        out = {}
        for other in set(self.tables[name].references.values()):
            if other not in new and other not in staying["tables"]:
                raise Rejected(f"{name} refers to {other}, which is not there")
            out[other] = new[other] if other in new else self.read(other, staying)
        return out

    def replace(self, tables: Mapping[str, DataFrame], expected: Mapping[str, int] | None = None, whole: bool = False) -> int:
        """Put new rows in place of the tables', and with whole drop all others; the version that results.

        Parents are written first.  Rejected if a number of rows isn't the expected one, a key is null or repeated, or a
        reference of a new row, or of a row that stays, leads nowhere.
        """
        manifest, commit = self.current(), uuid.uuid4().hex
        staying = {"tables": {} if whole else {n: e for n, e in manifest["tables"].items() if n not in tables}}
        keys = {name: t.key for name, t in self.tables.items()}
        new, entries = {}, {}
        for name in (n for n in self.tables if n in tables):
            path, new[name] = self._written(commit, name, tables[name])
            entries[name] = {"parts": [path], "schema": json.loads(new[name].schema.json())}
            if found := faults(new[name], self.tables[name], self._parents(name, new, staying), keys, expected=(expected or {}).get(name)):
                raise Rejected("; ".join(found))
        for name in staying["tables"]:  # what stays must still find what it refers to
            if lost := {c: o for c, o in self.tables[name].references.items() if o in new}:
                own = Table(name, self.tables[name].key, lost)
                if found := [x for x in faults(self.read(name, manifest), own, new, keys) if "references to nothing" in x]:
                    raise Rejected("; ".join(found))
        self._switch(manifest, commit, staying["tables"] | entries, manifest["ledger"])
        return manifest["version"] + 1

    def insert(self, tables: Mapping[str, DataFrame], receipt: tuple[str, int] | None = None, checked: bool = True) -> bool:
        """Add rows to several tables at once, without rewriting what is there.

        A receipt (source, number) is noted in the same commit; rows with a receipt whose number the source has reached already
        are not taken again, and the answer is False.
        """
        manifest, commit = self.current(), uuid.uuid4().hex
        if receipt and manifest["ledger"].get(receipt[0], -1) >= receipt[1]:
            return False
        written = {name: self._written(commit, name, tables[name]) for name in self.tables if name in tables}
        keys = {name: t.key for name, t in self.tables.items()}
        for name, (_, rows) in written.items():
            old = self.read(name, manifest) if name in manifest["tables"] else None
            others = {}
            for other in self.tables[name].references.values():
                parts = [written[other][1]] if other in written else []
                parts += [self.read(other, manifest)] if other in manifest["tables"] else []
                if not parts:
                    raise Rejected(f"{other}: referred to and not there")
                others[other] = reduce(lambda a, b, k=keys[other][0]: a.select(k).union(b.select(k)), parts)
            if checked and (found := faults(rows, self.tables[name], others, keys, old)):
                raise Rejected("; ".join(found))
            if old is not None and old.schema.simpleString() != rows.schema.simpleString():
                raise Rejected(f"{name}: columns {rows.schema.simpleString()}, the table has {old.schema.simpleString()}")
        entries = dict(manifest["tables"])
        for name, (path, df) in written.items():
            before = entries.get(name, {"parts": [], "schema": json.loads(df.schema.json())})
            entries[name] = {"parts": [*before["parts"], path], "schema": before["schema"]}
        self._switch(manifest, commit, entries, manifest["ledger"] | ({receipt[0]: receipt[1]} if receipt else {}))
        return True


def dump(tables: Mapping[str, DataFrame], path: str, volatile: Sequence[str] = ("created_at", "updated_at", "deleted_at")) -> None:
    """All tables as gzipped JSON lines: rows that aren't deleted, without volatile columns, and a manifest of their schemas and numbers."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, df in tables.items():
        rows = (df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df).drop(*volatile)
        rows.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")
        entries.append((name, rows.schema.json(), spark.read.schema(rows.schema).json(f"{path}/{name}").count()))
    spark.createDataFrame(entries, "name string, schema string, n bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def restore(store: Store, path: str) -> int:
    """Put a dump in place of all that the store holds, or raise Rejected and leave the store as it was; the version that results.

    Tables of the dump that the store doesn't know are an error, as they would be lost without a word.
    """
    spark = store.spark
    entries = {r["name"]: r for r in spark.read.schema("name string, schema string, n bigint").json(f"{path}/manifest").collect()}
    if unknown := sorted(entries.keys() - store.tables.keys()):
        raise Rejected(f"the dump has tables that the store hasn't: {', '.join(unknown)}")
    rows = {name: spark.read.schema(T.StructType.fromJson(json.loads(e["schema"]))).json(f"{path}/{name}") for name, e in entries.items()}
    return store.replace(rows, {name: e["n"] for name, e in entries.items()}, whole=True)
