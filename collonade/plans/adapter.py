"""The star-schema tables as collections, with draft and published states derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collonade.operators.relations import Collection


class Tables:
    """Tables of a folder by attribute: Tables(spark, dir).orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def order_parts(self) -> DataFrame:
        """Orders' part ids in order: a multi-reference field."""
        lines = self.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
        return lines.withColumnRenamed("l_orderkey", "o_orderkey")

    def draft(self) -> DataFrame:
        """Customers as drafts: one in eleven is not publishable."""
        return self.customer.select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2).cast("string").alias("balance"), (F.col("c_custkey") % 11 != 0).alias("is_publishable"))

    def published(self) -> DataFrame:
        """The published twins: one in ten is missing, one in seven has another segment, and some have no draft."""
        c = self.customer.where("c_custkey % 10 <> 0")
        segment = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_mktsegment", F.lit("*"))).otherwise(F.col("c_mktsegment"))
        own = c.select("c_custkey", "c_name", segment.alias("c_mktsegment"), F.round("c_acctbal", 2).cast("string").alias("balance"), F.lit(True).alias("is_publishable"))
        gone = self.supplier.select((-F.col("s_suppkey") - 1).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("NONE").alias("c_mktsegment"), F.lit("0").alias("balance"), F.lit(True).alias("is_publishable"))
        return own.unionByName(gone)

    def fields(self) -> DataFrame:
        """Nations as fields of regions' collections, in both states: published ones lack some, and differ in name or data."""
        n = self.nation.select(
            F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("collection_id"), F.when(F.col("n_nationkey") % 8 == 0, (F.col("n_regionkey") + 1) % 5).alias("reference_collection_id"),
            F.col("n_name").alias("name"), F.lower("n_name").alias("key"), F.lit("text").alias("type"), (F.col("n_nationkey") % 7).alias("order"), (F.col("n_nationkey") % 5 == 0).alias("is_computed"), F.when(F.col("n_nationkey") % 3 == 0, "{}").alias("data"),
        )
        old = n.where("id % 4 <> 0").withColumn("name", F.when(F.col("id") % 6 == 1, F.concat("name", F.lit("*"))).otherwise(F.col("name"))).withColumn("data", F.when(F.col("id") % 6 == 3, F.lit(None)).otherwise(F.col("data")))
        return n.withColumn("is_published", F.lit(False)).unionByName(old.withColumn("is_published", F.lit(True)))

    def items(self) -> DataFrame:
        """Customers' drafts and published twins in one table; drafts of one in thirteen are deleted."""
        d = self.draft().withColumn("is_published", F.lit(False)).withColumn("deleted_at", F.when(F.col("c_custkey") % 13 == 0, F.lit("2024-01-01")))
        return d.unionByName(self.published().withColumn("is_published", F.lit(True)).withColumn("deleted_at", F.lit(None).cast("string")))

    def entries(self) -> DataFrame:
        """Orders as children of customers, in both states: one in three is published, with an old status."""
        d = self.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(False).alias("is_published"))
        return d.unionByName(d.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("old")).withColumn("is_published", F.lit(True)))

    def folders(self) -> DataFrame:
        """Regions, nations and a third level as a tree of folders."""
        r = self.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lower("r_name").alias("name"))
        n = self.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lower("n_name").alias("name"))
        s = self.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.lower("s_name").alias("name"))
        return r.union(n).union(s)

    def collections(self) -> dict[str, Collection]:
        return {
            "regions": Collection("regions", self.region, "r_regionkey"),
            "nations": Collection("nations", self.nation, "n_nationkey", {"n_regionkey": "regions"}),
            "customers": Collection("customers", self.customer, "c_custkey", {"c_nationkey": "nations"}),
            "orders": Collection("orders", self.orders, "o_orderkey", {"o_custkey": "customers"}),
        }
