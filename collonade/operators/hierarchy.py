"""Trees by parent reference.

Paths and closures of a whole tree are made by joins that double their reach: n levels
take about log2(n) rounds, and a cycle is an error.  A round that reaches r levels leaves the nodes at depth r or more,
and these grow fewer each round unless they lead into a cycle; so a cycle is seen as soon as all other lines are
done, and nothing grows along it.  What is above or below some ids is walked from these, a level a
round.  Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collonade.operators.ordering import ranked
from collonade.sources.folders import cut


def paths(df: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, path, depth): names from the root down, joined by slashes; nodes whose line doesn't end at a root are left out."""
    nodes = cut(df.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(name).cast("string").alias("path"), F.lit(0).alias("depth")))
    last = None
    while left := nodes.where("up is not null").count():
        if left == last:
            raise ValueError("the parents form a cycle")
        last = left
        above = nodes.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("depth").alias("depth2"))
        joined = nodes.join(above, "up", "left").where("up is null or path2 is not null")
        open_ = F.col("up").isNotNull()
        path = F.when(open_, F.concat_ws("/", "path2", "path")).otherwise(F.col("path"))
        depth = F.when(open_, F.col("depth") + F.col("depth2") + 1).otherwise(F.col("depth"))
        nodes = cut(joined.select("id", F.when(open_, F.col("up2")).alias("up"), path.alias("path"), depth.alias("depth")))
    return nodes.select(F.col("id").alias(key), "path", "depth")


def closure(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(ancestor, descendant, distance) of all pairs, a node and itself included."""
    near = cut(df.select(F.col(key).alias("ancestor"), F.col(key).alias("descendant"), F.lit(0).alias("distance")))
    step = df.where(F.col(parent).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(key).alias("descendant"))
    step = cut(step.join(df.select(F.col(key).alias("ancestor")), "ancestor", "left_semi"))
    last, reach = None, 1
    while left := step.count():  # near: distances below reach; step: pairs at that distance
        if left == last:
            raise ValueError("the parents form a cycle")
        last = left
        to = step.select("ancestor", F.col("descendant").alias("middle"))
        far = to.join(near.select(F.col("ancestor").alias("middle"), "descendant", "distance"), "middle")
        near = cut(near.union(far.select("ancestor", "descendant", F.col("distance") + reach)))
        step = cut(to.join(step.select(F.col("ancestor").alias("middle"), "descendant"), "middle").select("ancestor", "descendant"))
        reach *= 2
    return near


def _walked(df: DataFrame, key: str, parent: str, ids: DataFrame, up: bool) -> DataFrame:
    """(key): the given ids that df has, and what is above or below them.

    Each round joins only the nodes that the last one found, so the work is that of the lines walked and not of the
    whole tree's pairs; nodes that were there before are not walked again, so a cycle ends too.
    """
    edges = df.where(F.col(parent).isNotNull()).select(F.col(key).alias("a" if up else "b"), F.col(parent).alias("b" if up else "a"))
    own = df.select(F.col(key).alias("b"))
    front = cut(ids.select(F.col(key).alias("b")).distinct().join(own, "b", "left_semi"))
    found = front
    while True:
        step = edges.join(front.select(F.col("b").alias("a")), "a", "left_semi").select("b").distinct()
        front = cut((step.join(own, "b", "left_semi") if up else step).join(found, "b", "left_anti"))
        if front.isEmpty():
            return found.select(F.col("b").alias(key))
        found = cut(found.union(front))


def below(df: DataFrame, key: str, parent: str, ids: DataFrame) -> DataFrame:
    """(key): the given ids (a column of key's name) that df has, and all below them."""
    return _walked(df, key, parent, ids, up=False)


def above(df: DataFrame, key: str, parent: str, ids: DataFrame) -> DataFrame:
    """Rows of the given ids (a column of key's name) and of all their ancestors."""
    return df.join(_walked(df, key, parent, ids, up=True), key, "left_semi")


def subtree(df: DataFrame, key: str, parent: str, ids: DataFrame) -> DataFrame:
    """Rows of the given ids and of all below them."""
    return df.join(below(df, key, parent, ids), key, "left_semi")


def without_subtree(df: DataFrame, key: str, parent: str, ids: DataFrame) -> DataFrame:
    """Rows that neither are of the given ids nor below them: what a delete through all levels leaves."""
    return df.join(below(df, key, parent, ids), key, "left_anti")


def flattened(df: DataFrame, key: str, parent: str, order: str, collapsed: DataFrame | None = None) -> DataFrame:
    """(key, depth, index, path): index counts siblings from 0 by order and key, and path sorts each node before its children.

    What lies below collapsed nodes (a column of key's name) is left out.
    """
    placed = ranked(df.select(key, parent, order), [order, key], parent, "_place").select(key, parent, (F.col("_place") - 1).alias("index"))
    placed = placed.withColumn("_name", F.lpad(F.col("index").cast("string"), 19, "0"))
    flat = paths(placed, key, parent, "_name").join(placed.select(key, "index"), key)
    if collapsed is not None:
        first = df.join(collapsed.select(F.col(key).alias(parent)), parent, "left_semi").select(key)
        flat = flat.join(below(df, key, parent, first), key, "left_anti")
    return flat.select(key, "depth", "index", "path").orderBy("path")


def display_paths(df: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, path): names from the root down as readers see them, joined by " / "; a parent that isn't there counts as none."""
    there = df.select(F.col(key).alias("_p"), F.lit(True).alias("_there"))
    rooted = df.join(there, F.col(parent) == F.col("_p"), "left").withColumn(parent, F.when(F.col("_there"), F.col(parent)))
    # Slashes within names are kept apart from those between them.
    shown = paths(rooted.withColumn("_n", F.replace(F.col(name).cast("string"), F.lit("/"), F.lit("\x1f"))), key, parent, "_n")
    return shown.select(key, F.replace(F.replace("path", F.lit("/"), F.lit(" / ")), F.lit("\x1f"), F.lit("/")).alias("path"))


def descends(pairs: DataFrame, df: DataFrame, key: str, parent: str) -> DataFrame:
    """Pairs (node, ancestor) with descends: whether the node is below the ancestor; only the lines above the nodes are walked."""
    lines = above(df, key, parent, pairs.select(F.col("node").alias(key)).distinct())
    known = closure(cut(lines), key, parent).where("distance > 0").select(F.col("descendant").alias("node"), "ancestor", F.lit(True).alias("_is"))
    return pairs.join(known, ["node", "ancestor"], "left").select(*pairs.columns, F.coalesce("_is", F.lit(False)).alias("descends"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the starts (one column) and all that edges (a, b) lead to from them; cycles end the walk.

    A round joins only what the last one found, so hubs and cycles are entered once; nulls on either side are no nodes.
    """
    front = found = cut(starts.select(F.col(starts.columns[0]).alias("node")).where("node is not null").distinct())
    while True:
        step = edges.join(front.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        front = cut(step.where("node is not null").distinct().join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = cut(found.union(front))
