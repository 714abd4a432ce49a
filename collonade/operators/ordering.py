"""Manual order by positions with gaps: a move writes the moved rows, and nothing else while there is room.

New rows are GAP apart.  A row that moves gets a position between its new neighbours; where neighbours have
become so close that it doesn't fit, that group alone is spaced anew.  Neighbours and places are found in range
partitions, so that a group with most of the rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collonade.sources.folders import cut

GAP = 1 << 20


def _spread(df: DataFrame, order: list) -> DataFrame:
    """df sorted into range partitions, each row with its partition and its place there; kept, as both are read more than once."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return cut(ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))


def ranked(df: DataFrame, order: list[str], group: str | None = None, out: str = "rank") -> DataFrame:
    """df with out: 1, 2, ... by order, in each group if there is one; nulls of the group are a group.  order should leave no ties."""
    by = [group] if group else []
    spread = _spread(df, [*by, *order])
    parts = spread.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    all_ranked = spread.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_in"))
    if group:
        first = all_ranked.groupBy(F.col(group).alias("_g")).agg((F.min(out) - 1).alias("_first"))
        all_ranked = all_ranked.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(out, F.col(out) - F.col("_first"))
    return all_ranked.select(*df.columns, F.col(out).cast("bigint").alias(out))


def spaced(rows: DataFrame, key: str, order: list[str], group: str | None = None, out: str = "position", gap: int = GAP) -> DataFrame:
    """(key, out): positions gap, 2 gap, ... by order and key, in each group if there is one."""
    by = [group] if group else []
    own = rows.select(key, *by, *[c for c in order if c not in (key, *by)])
    return ranked(own, [*order, key], group, "_rank").select(key, (F.col("_rank") * gap).alias(out))


def moved(rows: DataFrame, moves: DataFrame, key: str, position: str, group: str, gap: int = GAP) -> DataFrame:
    """(key, position) of the rows to write so that each moved one stands behind its anchor, or first where that is null.

    moves are (key, anchor, rank): rows that move behind one anchor stand there by rank.  Anchors are rows of the same group that don't
    move themselves; a row that moves behind one of another group, behind none that is there, or twice is an error.  Where there is no room the
    whole group is written, spaced anew.
    """
    own = rows.select(key, F.col(group).alias("_group"), F.col(position).alias("_at"))
    wanted = cut(moves.select(key, "anchor", "rank").join(own.select(key, "_group"), key, "left"))
    anchors = own.select(F.col(key).alias("anchor"), F.col("_group").alias("_ag"), F.col("_at").alias("_low")).join(moves.select(F.col(key).alias("anchor")), "anchor", "left_anti")
    placed = cut(wanted.join(anchors, "anchor", "left"))
    bad = placed.where(F.col("_group").isNull() | (F.col("anchor").isNotNull() & ~F.coalesce(F.col("_ag") == F.col("_group"), F.lit(False)))).count()
    if bad or placed.groupBy(key).count().where("count > 1").count():
        raise ValueError("a row moves twice, isn't there, or moves behind a row that moves, isn't there or is of another group")
    # Of what stays: the next position after each place, by a sweep over (group, position) that meets both.
    staying = own.join(moves.select(key), key, "left_anti")
    lowest = F.coalesce("_low", F.lit(-(1 << 62)))
    spots = placed.groupBy("_group", lowest.alias("_low")).agg(F.count("*").alias("_m"))
    both = staying.select("_group", "_at", F.lit(0).alias("_kind")).union(spots.select("_group", F.col("_low").alias("_at"), F.lit(1).alias("_kind")))
    spread = _spread(both, ["_group", "_at", "_kind"])
    back = Window.partitionBy("_part").orderBy(F.desc("_in")).rowsBetween(Window.unboundedPreceding, -1)
    within = F.last(F.when(F.col("_kind") == 0, F.struct("_group", "_at")), ignorenulls=True).over(back)
    heads = spread.where("_kind = 0").groupBy("_part").agg(F.min(F.struct("_group", "_at")).alias("_head"))
    after = F.min("_head").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing))
    parts = spread.select("_part").distinct().join(heads, "_part", "left").select("_part", after.alias("_later"))
    spot = spread.withColumn("_next", within).where("_kind = 1").join(F.broadcast(parts), "_part").withColumn("_next", F.coalesce("_next", "_later"))
    ends = spot.select("_group", F.col("_at").alias("_low"), F.when(F.col("_next._group") == F.col("_group"), F.col("_next._at")).alias("_high"))
    known = placed.withColumn("_low", lowest).join(ends, ["_group", "_low"]).join(spots, ["_group", "_low"])
    turn = F.row_number().over(Window.partitionBy("_group", "_low").orderBy("rank", key))
    first = F.col("_low") == F.lit(-(1 << 62))
    step = F.when(first, F.lit(gap)).when(F.col("_high").isNull(), F.lit(gap)).otherwise(F.floor((F.col("_high") - F.col("_low")) / (F.col("_m") + 1)))
    # In front of all the new ones count down from the first row that stays; with none they begin at gap.
    base = F.when(first, F.coalesce(F.col("_high"), (F.col("_m") + 1) * gap) - (F.col("_m") + 1) * gap).otherwise(F.col("_low"))
    out = cut(known.withColumn("_step", step).withColumn("_turn", turn).select(key, "_group", (base + F.col("_step") * F.col("_turn")).cast("bigint").alias(position), F.col("_step").alias("_step"), "_low", "_turn"))
    full = cut(out.where("_step < 1").select("_group").distinct())
    if full.isEmpty():
        return out.select(key, position)
    # Old rows in their order, new ones behind their anchor by turn.
    in_full = lambda df: df.join(full, "_group", "left_semi")
    seats = in_full(staying).select(key, "_group", "_at", F.lit(0).cast("bigint").alias("_turn")).unionByName(in_full(out).select(key, "_group", F.col("_low").alias("_at"), F.col("_turn").cast("bigint").alias("_turn")))
    return out.join(full, "_group", "left_anti").select(key, position).unionByName(spaced(seats, key, ["_at", "_turn"], "_group", position, gap))


def reordered(rows: DataFrame, updates: DataFrame, key: str, position: str) -> DataFrame:
    """The table with given positions (key, position) on its undeleted drafts; published rows stay as they are."""
    new = updates.groupBy(key).agg(F.max(position).alias("_new"))
    hit = F.col("_new").isNotNull() & ~F.col("is_published")
    hit = hit & F.col("deleted_at").isNull() if "deleted_at" in rows.columns else hit
    return rows.join(new, key, "left").withColumn(position, F.when(hit, F.col("_new")).otherwise(F.col(position))).select(*rows.columns)
