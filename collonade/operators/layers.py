"""Stored conditions of many collection layers, counted in one scan, and what is shown by these counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.operators.partial import All, Any, Condition, Tree, column, from_groups


@dataclass(frozen=True)
class Layer:
    """A layer that lists items of a collection: its stored condition, how many it skips, and how many it shows at most (0: all)."""

    id: str
    shown: Tree = None
    offset: int = 0
    limit: int = 0


@dataclass(frozen=True)
class Count:
    """A condition on how many items another layer of the page lists: has_items, has_no_items, or item_count with a relation and a number."""

    layer: str
    operator: str
    compare: str = "eq"
    value: int = 0


def counts(items: DataFrame, layers: Sequence[Layer], parent: str | None = None, parents: DataFrame | None = None) -> DataFrame:
    """(layer, found, rendered), with parent for each parent: how many items each layer's condition holds for, and how many it lists.

    All layers of a collection are counted by one aggregate over one scan.  With parents (a column of parent's name)
    those without items have zeros.
    """
    ids = [layer.id for layer in layers]
    if len(set(ids)) < len(ids):
        raise ValueError("two layers have one id")
    found = [F.count_if(F.coalesce(column(items, layer.shown), F.lit(False))).alias(f"_{k}") for k, layer in enumerate(layers)]
    by = [parent] if parent else []
    one = items.groupBy(*by).agg(*found)
    if parents is not None:
        one = parents.select(parent).distinct().join(one, parent, "left").fillna(0)
    left = lambda n, layer: F.greatest(n - layer.offset, F.lit(0))
    listed = lambda n, layer: F.least(left(n, layer), F.lit(layer.limit)) if layer.limit > 0 else left(n, layer)
    rows = [F.struct(F.lit(layer.id).alias("layer"), F.col(f"_{k}").alias("found"), listed(F.col(f"_{k}"), layer).cast("bigint").alias("rendered")) for k, layer in enumerate(layers)]
    return one.select(*by, F.inline(F.array(*rows)))


def holds(c: Count, of: Mapping[str, Column]) -> Column:
    """A count condition over the counts by layer; a layer that isn't there has none, and an unknown operator holds."""
    n = of.get(c.layer, F.lit(0))
    if c.operator == "has_items":
        return n > 0
    if c.operator == "has_no_items":
        return n == 0
    if c.operator == "item_count":
        return {"lt": n < c.value, "lte": n <= c.value, "gt": n > c.value, "gte": n >= c.value}.get(c.compare, n == c.value)
    return F.lit(True)


def visible(rows: DataFrame, counted: DataFrame, targets: Mapping[str, Sequence[Sequence[Count | Condition]]], parent: str | None = None) -> DataFrame:
    """(columns of parent or of rows, target, visible): whether each target is shown on each row, by groups of conditions on counts and on the row's own fields.

    Conditions are ORed inside a group and ANDed across; empty groups say nothing.  counted are the counts() of all layers that the
    targets name, one row a layer, or one for each parent.
    """
    named = sorted({c.layer for groups in targets.values() for group in groups for c in group if isinstance(c, Count)})
    wide = counted.groupBy(*([parent] if parent else [])).agg(*[F.coalesce(F.max(F.when(F.col("layer") == layer, F.col("rendered"))), F.lit(0)).alias(f"_n{k}") for k, layer in enumerate(named)], F.count("*").alias("_layers"))
    # Without a parent this is one row of a few counts, and of known size.
    joined = rows.join(wide, parent, "left") if parent else rows.join(F.broadcast(wide))
    of = {layer: F.coalesce(F.col(f"_n{k}"), F.lit(0)) for k, layer in enumerate(named)}

    def test(tree) -> Column:
        if isinstance(tree, Count):
            return holds(tree, of)
        if isinstance(tree, (All, Any)):
            out = test(tree.parts[0])
            for part in tree.parts[1:]:
                out = out & test(part) if isinstance(tree, All) else out | test(part)
            return out
        return F.lit(True) if tree is None else F.coalesce(column(joined, tree), F.lit(False))

    shown = [F.struct(F.lit(t).alias("target"), test(from_groups(groups)).alias("visible")) for t, groups in targets.items()]
    return joined.select(*rows.columns, F.inline(F.array(*shown)))


def pruned(layers: DataFrame, hidden: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Layers without those that are hidden and all below them."""
    from collonade.operators.hierarchy import without_subtree

    return without_subtree(layers, key, parent, hidden)
