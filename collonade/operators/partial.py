"""Trees of conditions of which some wait for an input: the part to apply now, and what is left for later.

A condition is static, or bound to inputs that readers set.  pushed() is the strongest
condition that a tree implies whatever the inputs; residual() is what must still hold of the rows that are left.
Both together are the tree.  The first goes into the scan; the second is compiled when
the inputs are known, and inputs that are not set leave their condition out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.operators.predicates import EMPTY, FULL, Condition, compiled, sure

BARE = (*EMPTY, *FULL, "has_items", "has_no_items")
LISTS = ("is_one_of", "is_not_one_of", "contains_all_of", "contains_exactly")


@dataclass(frozen=True)
class Bound:
    """A condition whose operands are the values of inputs; None for one that is the condition's own."""

    condition: Condition
    input: str | None = None
    input2: str | None = None


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Tree = Condition | Bound | All | Any | Not | None


def from_groups(groups: Sequence[Sequence[Condition | Bound]], dialect: str = "visibility") -> Tree:
    """The groups of a dialect as a tree: of visibility ORed inside and ANDed across, of public the other way round; empty groups say nothing."""
    inner, outer = (Any, All) if dialect == "visibility" else (All, Any) if dialect == "public" else (All, All)
    parts = tuple(inner(tuple(group)) for group in groups if group)
    return outer(parts) if parts else None


def bound(leaf: Bound, inputs: Mapping[str, str]) -> Condition | None:
    """The condition with its inputs' values, or None if it says nothing: an input that isn't set, or an unchecked box.

    Of a range one side is enough.  A single value for an operator on lists is a list of one.
    """
    c = leaf.condition
    value, value2 = (inputs.get(leaf.input, "") or "" if leaf.input else c.value), (inputs.get(leaf.input2, "") or "" if leaf.input2 else c.value2)
    if leaf.input and c.kind == "boolean" and value == "false":
        return None
    if c.operator == "is_between":
        return replace(c, value=value, value2=value2) if value or value2 else None
    if (leaf.input or c.operator not in BARE) and not value or leaf.input2 and not value2:
        return None
    if leaf.input and c.kind in ("reference", "multi_reference") and c.operator in LISTS:
        value = json.dumps([value])
    return replace(c, value=value, value2=value2)


def known(tree: Tree, inputs: Mapping[str, str]) -> Tree:
    """The tree with all inputs given; parts that say nothing are left out, and None is a tree that says nothing."""
    if isinstance(tree, Bound):
        return bound(tree, inputs)
    if isinstance(tree, Not):
        part = known(tree.part, inputs)
        return None if part is None else Not(part)
    if isinstance(tree, (All, Any)):
        parts = tuple(p for p in (known(p, inputs) for p in tree.parts) if p is not None)
        return None if not parts else parts[0] if len(parts) == 1 else type(tree)(parts)
    return tree


def waits(tree: Tree) -> bool:
    """Whether any condition of the tree is bound to an input."""
    if isinstance(tree, Bound):
        return bool(tree.input or tree.input2)
    return waits(tree.part) if isinstance(tree, Not) else any(map(waits, tree.parts)) if isinstance(tree, (All, Any)) else False


def inward(tree: Tree, negated: bool = False) -> Tree:
    """The tree with negations at its leaves only."""
    if isinstance(tree, Not):
        return inward(tree.part, not negated)
    if isinstance(tree, (All, Any)):
        kind = (Any if isinstance(tree, All) else All) if negated else type(tree)
        return kind(tuple(inward(p, negated) for p in tree.parts))
    return Not(tree) if negated and tree is not None else tree


def pushed(tree: Tree) -> Tree:
    """What can be applied now: true of every row that the tree can hold for, whatever the inputs; None if that is every row."""
    return _pushed(inward(known_static(tree)))


def known_static(tree: Tree) -> Tree:
    """The tree without static conditions that say nothing, and with no empty parts."""
    if isinstance(tree, Bound):
        return tree if waits(tree) else bound(tree, {})
    if isinstance(tree, Not):
        part = known_static(tree.part)
        return None if part is None else Not(part)
    if isinstance(tree, (All, Any)):
        parts = tuple(p for p in map(known_static, tree.parts) if p is not None)
        return type(tree)(parts) if parts else None
    return tree


def _pushed(tree: Tree) -> Tree:
    if not waits(tree):
        return tree
    if isinstance(tree, All):
        parts = tuple(p for p in map(_pushed, tree.parts) if p is not None)
        return All(parts) if parts else None
    if isinstance(tree, Any):
        # A part that may hold of every row leaves nothing to push, and so does one whose inputs may all be unset, as it then says
        # nothing and the others decide: these are implied either way, if each part implies something.
        parts = tuple(map(_pushed, tree.parts))
        return None if None in parts else Any(parts)
    return None


def residual(tree: Tree) -> Tree:
    """What is left to check, with its inputs, of rows for which pushed(tree) holds; None if nothing is."""
    return _residual(inward(known_static(tree)))


def _residual(tree: Tree) -> Tree:
    if not waits(tree):
        return None
    if isinstance(tree, All):
        parts = tuple(p for p in map(_residual, tree.parts) if p is not None)
        return parts[0] if len(parts) == 1 else All(parts)
    return tree


def column(df: DataFrame, tree: Tree, dialect: str = "visibility") -> Column:
    """A tree without inputs as one boolean column; a condition that can't be told of a row does not hold."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Not):
        return ~sure(column(df, tree.part, dialect))
    if isinstance(tree, (All, Any)):
        join: Callable = (lambda a, b: a & b) if isinstance(tree, All) else (lambda a, b: a | b)
        return reduce(join, [column(df, p, dialect) for p in tree.parts])
    if isinstance(tree, Bound):
        raise ValueError(f"the input of {tree.condition.field} is not known yet")
    return compiled(df, tree, dialect)


def now(df: DataFrame, tree: Tree, dialect: str = "visibility") -> DataFrame:
    """Rows that the tree may hold for: its pushed part as a filter, which reaches the scan."""
    part = pushed(tree)
    return df if part is None else df.where(column(df, part, dialect))


def later(df: DataFrame, tree: Tree, inputs: Mapping[str, str], dialect: str = "visibility") -> DataFrame:
    """Of the rows of now() those that the tree holds for with the inputs."""
    part = known(residual(tree), inputs)
    return df if part is None else df.where(column(df, part, dialect))
