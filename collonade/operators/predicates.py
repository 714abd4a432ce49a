"""Conditions on fields, compiled to one boolean column.

Four dialects differ in case, emptiness and what an unknown operator means:
``public`` (raw text, groups are ANDed inside and ORed across), ``visibility``
(typed values, ORed inside and ANDed across), ``builder`` (lower-cased text, one
flat AND) and ``exact`` (equality of text, one flat AND).  A condition that can't be
told of a row may be null, which keeps no row; only where one is complemented is it
made false first.  So comparisons of typed columns reach the scan as they are.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collonade.functions.casts import FLOAT_PREFIX, as_text, parse_date, parse_float

EMPTY, FULL = ("is_empty", "is_not_present", "does_not_exist"), ("is_not_empty", "is_present", "exists")
COMPARE: dict[str, Callable] = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}
COMPLEMENTS = {"is_not": "is", "does_not_contain": "contains", "is_not_one_of": "is_one_of", "has_no_items": "has_items"}


@dataclass(frozen=True)
class Condition:
    """operator on a field; kind is the field's type, compare the relation of item_count."""

    field: str
    operator: str
    value: str = ""
    value2: str = ""
    kind: str = "text"
    compare: str = "eq"


def sure(c: Column) -> Column:
    """The condition with false for what can't be told."""
    return F.coalesce(c, F.lit(False))


def number_of(text: str) -> float | None:
    """The number that an operand starts with."""
    found = re.match(FLOAT_PREFIX, text)
    return float(found[1]) if found else None


class Cell:
    """The views of one field that conditions need; typed columns are used as they are, so that scans can filter on them."""

    def __init__(self, df: DataFrame, field: str):
        self.type, self.raw = df.schema[field].dataType, F.col(f"`{field}`")
        self.listed = isinstance(self.type, T.ArrayType)

    @property
    def text(self) -> Column:
        if self.listed:
            return F.to_json(self.raw)
        return as_text(self.raw, "number") if isinstance(self.type, (T.FractionalType, T.DecimalType)) else self.raw.cast("string")

    @property
    def number(self) -> Column:
        return self.raw.cast("double") if isinstance(self.type, T.NumericType) else parse_float(self.text)

    def compared(self, relation: str, value: str) -> Column:
        """The cell's number against the operand's; an integer column is compared with an integer, so that nothing is lost and the scan can filter."""
        operand = number_of(value)
        if operand is None:
            return F.lit(False)
        if not isinstance(self.type, T.IntegralType):
            return COMPARE[relation](self.number, F.lit(operand))
        exact = re.match(r"\s*[+-]?\d+(?![\d.eE])", value)
        if exact or math.isfinite(operand) and operand == math.floor(operand):
            return COMPARE[relation](self.raw, F.lit(int(exact[0]) if exact else int(operand)))
        if relation == "eq":
            return F.lit(False)
        if math.isinf(operand):
            return self.raw.isNotNull() & F.lit((operand > 0) == (relation in ("lt", "lte")))
        return self.raw > F.lit(math.floor(operand)) if relation in ("gt", "gte") else self.raw < F.lit(math.ceil(operand))

    def told(self, relation: str, value: str) -> Column:
        """The cell's time against the operand's, as a value of the column's own type."""
        want = parse_date(F.lit(value))
        if isinstance(self.type, T.TimestampNTZType):
            want = F.convert_timezone(F.current_timezone(), F.lit("UTC"), want.cast("timestamp_ntz"))
        return COMPARE[relation](self.time, want)

    @property
    def time(self) -> Column:
        typed = isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))
        return self.raw if typed else parse_date(self.text)

    @property
    def items(self) -> Column:
        """The cell's list; only text that begins like one is parsed."""
        if self.listed:
            return self.raw.cast("array<string>")
        return F.when(F.startswith(F.ltrim(self.text), F.lit("[")), F.from_json(self.text, "array<string>"))


#: Case variants of an operand that are listed one by one; of longer ones only the range they lie in is told.
VARIANTS = 64


def spellings(low: str) -> list[str] | None:
    """All texts whose lower case is the operand's, or None if it isn't of ASCII or they are too many. The Kelvin sign is a k too."""
    letters = [{c, c.upper()} | ({"\u212a"} if c == "k" else set()) for c in low]
    if not low.isascii() or math.prod(map(len, letters)) > VARIANTS:
        return None
    return sorted("".join(x) for x in product(*letters))


def same_text(cell: Cell, value: str) -> Column:
    """The cell's text without regard to case, in a form that a scan can filter on."""
    low = value.lower()
    if isinstance(cell.type, T.IntegralType):
        return cell.raw == F.lit(int(value)) if re.fullmatch(r"-?(?:[1-9]\d{0,17})|0", value) else cell.raw.isNotNull() & F.lit(False)
    if not isinstance(cell.type, T.StringType):
        return F.lower(cell.text) == low
    found = spellings(low)
    if found is not None:
        return cell.raw == found[0] if len(found) == 1 else cell.raw.isin(*found)
    test = F.lower(cell.raw) == low
    # Capitals come first, and nothing that is an ASCII letter in lower case comes after it but the Kelvin sign.
    return (cell.raw >= low.upper()) & (cell.raw <= low.replace("k", "\u212a")) & test if low.isascii() else test


def operand_list(value: str) -> list[str] | None:
    try:
        got = json.loads(value)
    except ValueError:
        return None
    return [str(x) for x in got] if isinstance(got, list) else None


def common(cell: Cell, c: Condition) -> Column | None:
    """Operators on which public and visibility agree."""
    if c.operator in EMPTY:
        return F.coalesce(cell.text, F.lit("")) == ""
    if c.operator in FULL:
        return F.coalesce(cell.text, F.lit("")) != ""
    if c.operator in ("gt", "gte", "lt", "lte"):
        return cell.compared(c.operator, c.value)
    if c.operator == "is_before":
        return cell.told("lt", c.value)
    if c.operator == "is_after":
        return cell.told("gt", c.value)
    wanted = operand_list(c.value) if c.operator in ("is_one_of", "contains_all_of", "contains_exactly") else []
    if wanted is None:
        return F.lit(False)
    all_in = lambda: reduce(lambda a, b: a & b, [F.array_contains(cell.items, w) for w in wanted], cell.items.isNotNull())
    if c.operator == "is_one_of":
        if not wanted:
            return F.lit(False)
        overlap = F.arrays_overlap(cell.items, F.array(*map(F.lit, wanted)))
        if cell.listed:
            return sure(overlap)
        if isinstance(cell.type, T.IntegralType):
            whole = [int(w) for w in wanted if re.fullmatch(r"-?(?:[1-9]\d{0,17})|0", w)]
            return cell.raw.isin(*whole) if whole else cell.raw.isNotNull() & F.lit(False)
        one = cell.text.isin(*wanted)
        if not isinstance(cell.type, T.StringType):
            return one
        # What isn't one of them can only be a list, and those are told by how they begin; the first part is for the scan.
        begins = lambda mark: F.startswith(cell.raw, F.lit(mark))
        return (one | begins("[") | begins(" ")) & F.when(F.startswith(F.ltrim(cell.raw), F.lit("[")), one | sure(overlap)).otherwise(one)
    if c.operator == "contains_all_of":
        return sure(all_in())
    if c.operator == "contains_exactly":
        return sure(all_in() & (F.size(cell.items) == len(wanted)))
    return None


def public(cell: Cell, c: Condition) -> Column:
    """D1: text without regard to case; a date range may have one side only; unknown operators mean contains."""
    if c.operator in COMPLEMENTS:
        if c.operator == "is_not_one_of" and operand_list(c.value) is None:
            return F.lit(True)
        return ~sure(public(cell, Condition(c.field, COMPLEMENTS[c.operator], c.value, c.value2, c.kind, c.compare)))
    if (got := common(cell, c)) is not None:
        return got
    low = F.lower(cell.text)
    want = F.lit(c.value.lower())
    if c.operator == "is":
        return same_text(cell, c.value)
    if c.operator == "starts_with":
        return F.startswith(low, want)
    if c.operator == "ends_with":
        return F.endswith(low, want)
    if c.operator == "is_between":
        sides = [cell.told("gte", c.value)] * bool(c.value) + [cell.told("lte", c.value2)] * bool(c.value2)
        return reduce(lambda a, b: a & b, sides) if sides else F.lit(False)
    if c.operator == "has_items":
        if cell.listed:
            return sure(F.size(cell.raw) > 0)
        other = (F.coalesce(cell.text, F.lit("")) != "") & F.try_parse_json(cell.text).isNull()
        return F.when(cell.items.isNotNull(), F.size(cell.items) > 0).otherwise(other)
    if c.operator == "item_count" and c.kind == "multi_reference":
        return sure(COMPARE[c.compare](F.coalesce(F.size(cell.items), F.lit(0)), F.lit(int(c.value))))
    return F.contains(low, want)


def visibility(cell: Cell, c: Condition) -> Column:
    """D2: typed comparison with regard to case; both sides of a range are needed; unknown operators hold."""
    if c.operator in ("is", "is_not"):
        if c.kind == "number":
            same = sure(cell.compared("eq", c.value)) if c.operator == "is_not" else cell.compared("eq", c.value)
        elif c.kind == "boolean":
            same = sure(F.lower(cell.text) == c.value.lower())
        elif c.operator == "is" and c.value != "":
            return cell.text == c.value
        else:
            same = F.coalesce(cell.text, F.lit("")) == c.value
        return same if c.operator == "is" else ~same
    if c.operator in COMPLEMENTS:
        return ~sure(visibility(cell, Condition(c.field, COMPLEMENTS[c.operator], c.value, c.value2, c.kind, c.compare)))
    if (got := common(cell, c)) is not None:
        return got
    if c.operator == "contains":
        return F.contains(F.lower(F.coalesce(cell.text, F.lit(""))), F.lit(c.value.lower()))
    if c.operator == "is_between":
        return cell.told("gte", c.value) & cell.told("lte", c.value2)
    if c.operator == "has_items":
        return sure(F.size(cell.items) > 0)
    if c.operator == "item_count" and c.kind == "multi_reference":
        return sure(COMPARE[c.compare](F.coalesce(F.size(cell.items), F.lit(0)), F.lit(int(c.value))))
    return F.lit(True)


def builder(cell: Cell, c: Condition) -> Column:
    """D3: lower-cased text, a missing value being empty; operators it lacks mean contains."""
    low, want = F.lower(F.coalesce(cell.text, F.lit(""))), c.value.lower()
    simple = {
        "is": lambda: low == want,
        "is_not": lambda: low != want,
        "does_not_contain": lambda: ~F.contains(low, F.lit(want)),
        "starts_with": lambda: F.startswith(low, F.lit(want)),
        "ends_with": lambda: F.endswith(low, F.lit(want)),
        "is_empty": lambda: low == "",
        "is_not_empty": lambda: low != "",
    }
    if c.operator in simple:
        return simple[c.operator]()
    if c.operator in ("gt", "gte", "lt", "lte"):
        return cell.compared(c.operator, c.value)
    return F.contains(low, F.lit(want))


def exact(cell: Cell, c: Condition) -> Column:
    """D4: the same text."""
    return cell.text == c.value


DIALECTS = {"public": public, "visibility": visibility, "builder": builder, "exact": exact}


def compiled(df: DataFrame, c: Condition, dialect: str = "public") -> Column:
    return DIALECTS[dialect](Cell(df, c.field), c)


def active(conditions: Iterable[Condition]) -> list[Condition]:
    """Those that say something: an operator that needs an operand has one."""
    bare = (*EMPTY, *FULL, "has_items", "has_no_items")
    return [c for c in conditions if c.operator in bare or c.value not in ("", "false") or c.value2]


def where(df: DataFrame, groups: Sequence[Sequence[Condition]], dialect: str = "public") -> DataFrame:
    """Rows for which the groups of conditions hold; no groups, or only empty ones, keep all.

    Catalyst gets the groups as they are; nothing is expanded, so no cap on their number is needed.
    """
    if dialect == "exact":  # fields that don't exist are ignored
        groups = [[c for c in group if c.field in df.columns] for group in groups]
    tests = [[compiled(df, c, dialect) for c in group] for group in groups if group]
    if not tests:
        return df
    both, either = (lambda a, b: a & b), (lambda a, b: a | b)
    inner, outer = (both, either) if dialect == "public" else (either, both) if dialect == "visibility" else (both, both)
    return df.where(reduce(outer, [reduce(inner, t) for t in tests]))
