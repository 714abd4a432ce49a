"""Version logs, delivery logs and event subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collonade.operators.ordering import ranked
from collonade.operators.sorting import sliced

NEWEST, EVERY = 50, 10


def newest(df: DataFrame, key: str, at: str, tie: str, n: int = NEWEST) -> DataFrame:
    """At most n rows of each key, the newest ones."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def with_snapshots(df: DataFrame, key: str, at: str, tie: str, every: int = EVERY) -> DataFrame:
    """Add is_snapshot: true for each every-th version of a key; places in range partitions, so that a busy key is many tasks."""
    return ranked(df, [at, tie], key, "_n").withColumn("is_snapshot", F.col("_n") % every == 0).drop("_n")


def young(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def history(df: DataFrame, key: str, entity, at: str, tie: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of one entity's versions, the newest first."""
    return sliced(df.where(F.col(key) == entity).orderBy(F.desc(at), F.desc(tie)), offset, limit)


def deliveries(events: DataFrame, subscriptions: DataFrame, kind: str, resource: str) -> DataFrame:
    """Events with each subscription to their kind whose resource is theirs or is not given.

    The join's side is left to Spark: there may be as many subscriptions as there are customers.
    """
    s = subscriptions.select("subscription", F.explode("kinds").alias("_kind"), F.col("resource").alias("_resource"))
    match = (events[kind] == s["_kind"]) & (s["_resource"].isNull() | (s["_resource"] == events[resource]))
    return events.join(s, match).drop("_kind", "_resource")


def form_summary(df: DataFrame, form: str, status: Column, at: str) -> DataFrame:
    """For each form how many submissions there are, how many are new, and the latest."""
    return df.groupBy(F.col(form).alias("form_id")).agg(F.count("*").alias("submission_count"), F.count_if(status).alias("new_count"), F.max(at).alias("latest_submission"))
