"""Filter interaction audit: what each filter removes, alone, after others, and in every order.

Each document gets a mask with a bit for each filter that it fails, and each part
of the corpus a table of counts by mask.  The subset-zeta transform turns these
counts into survivors: after ``len(filters)`` steps over an array of 2^filters
counts, entry T holds the documents whose mask lies within T, which are those that
survive the filters outside T.  What a filter removes after others is then the
difference between two neighbouring subsets, whatever the order in which the
others came, so all orders are read off one array, and the same holds for counts
of labelled documents.

Identity with an earlier text is decided table-wide: rows are first summed up by
(digest, part, labels, mask) on the map side, so a text with thousands of copies
is a few rows by the time its smallest id is looked for.

Defined results: a null text is an empty one; a null part is the empty string,
as one part with it; a null id is not smaller than any id, so that row never
fails by an earlier copy and makes no other fail; rows that share their id and
text are not copies of each other; of several labels of an id any 1 counts, and a
null label is none; the order of rows does not matter; texts are read whole; an
empty table has no parts and gives no rows; only the id, text and part are read, so
other names can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collonade.llm.common import WHITE
from collonade.llm.statistics import count_of

LETTERS = "ABCDE"
MARKS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def of_text(text: Column) -> dict[str, Column]:
    """The failures that a text alone decides: few words, few different words, capitals, marks.  The text must not be null."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * count_of(text, UPPER) > 10 * F.length(text),
        "D": count_of(text, MARKS) > 0,
    }


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", failures: Callable[[Column], dict[str, Column]] = of_text) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good or toxic, of each part and mask of failures.

    A mask has a bit for each of ``failures`` in order, and one above them for a text that a smaller id has too.
    """
    t = F.coalesce("text", F.lit(""))
    found = list(failures(t).values())
    own = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(found)), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), own.alias("mask"), F.unhex(F.sha2(t, 256)).alias("digest"))
    marks = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "bad"))]
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*marks).where("good + bad > 0")
    labelled = rows.join(known, "doc_id", "left").fillna(0, ["good", "bad"])
    group = ["digest", "part", "mask", "good", "bad"]
    # Rows of one id count once as the smallest id, and as often as they are there.
    by_id = labelled.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    summed = by_id.groupBy(*group).agg(F.sum("n").alias("n"), low.alias("low"), nameless.alias("nameless"))
    # By now a digest has a row for each part, mask and label that its copies have.
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    once = F.col("nameless") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    split = summed.withColumn("first", first).withColumn("once", once)
    entry = lambda mask, n: F.struct(mask.alias("mask"), n.alias("n"))
    both = F.array(entry(F.col("mask"), F.col("once")), entry(F.col("mask").bitwiseOR(F.lit(1 << len(found))), F.col("n") - F.col("once")))
    each = split.select("part", "good", "bad", F.explode(both).alias("x"))
    sums = {"n": F.col("x.n"), "good": F.col("x.n") * F.col("good"), "toxic": F.col("x.n") * F.col("bad")}
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(*[F.sum(v).cast("bigint").alias(k) for k, v in sums.items()])


def survivors(masks: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): arrays of 2^filters; entry T counts the documents that fail nothing outside the set T."""
    kinds = ["n", "good", "toxic"]
    by_mask = masks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*kinds)))).alias("m"))
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def counts(kind: str) -> Column:
        return F.transform(every, lambda i: F.coalesce(F.element_at("m", i)[kind], F.lit(0)).cast("bigint")).alias(kind)

    def with_filter(kind: str, bit: int) -> Column:
        """Subset-zeta: what lies within T is what lies within T without this filter, and what fails it too."""
        return F.transform(kind, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) > 0, x + F.get(F.col(kind), i - bit)).otherwise(x)).alias(kind)

    arrays = by_mask.select("part", *map(counts, kinds))
    for k in range(filters):
        arrays = arrays.select("part", *[with_filter(kind, 1 << k) for kind in kinds])
    return arrays


def steps(filters: str) -> list[dict]:
    """Every step of every order: its filter, and the sets of filters that documents may fail before and after it."""
    out = []
    for order in permutations(filters):
        left = (1 << len(filters)) - 1
        for k, letter in enumerate(order):
            bit = 1 << filters.index(letter)
            out.append({"filter_order": "".join(order), "step": k + 1, "filter": filters.index(letter), "before": left, "after": left & ~bit})
            left &= ~bit
    return out


def audit(masks: DataFrame, filters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order and step.

    masks are mask_counts of as many failures as there are letters; orders are listed one by one, so this is for a few filters.
    """
    n = len(filters)
    whole = (1 << n) - 1
    arrays = survivors(masks, n)
    left = lambda kind, allowed: F.get(F.col(kind), F.lit(allowed))
    rest = lambda bit: [s for s in range(whole + 1) if not s & bit]
    alone = {
        # Documents that fail this filter, that fail no other, and its removals over all orders: after each set of
        # other filters, as often as orders begin with an arrangement of that set.
        "fails": [left("n", whole) - left("n", whole & ~bit) for bit in (1 << k for k in range(n))],
        "unique_fails": [left("n", bit) - left("n", 0) for bit in (1 << k for k in range(n))],
        "shapley": [sum((factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (left("n", whole & ~s) - left("n", whole & ~s & ~bit)) for s in rest(bit)), F.lit(0)).cast("bigint") for bit in (1 << k for k in range(n))],
    }
    kind = "array<struct<filter_order:string,step:int,filter:int,before:int,after:int>>"
    table = F.from_json(F.lit(json.dumps(steps(filters))), kind)
    each = arrays.withColumns({k: F.array(*v) for k, v in alone.items()}).select("*", F.explode(table).alias("s"))
    at = lambda k, i: F.get(F.col(k), F.col(f"s.{i}"))
    lost = lambda k: at(k, "before") - at(k, "after")
    return each.select(
        "part",
        "s.filter_order",
        "s.step",
        at("n", "after").alias("kept"),
        lost("n").alias("removed"),
        (at("fails", "filter") - lost("n")).alias("redundant"),
        at("unique_fails", "filter").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        at("shapley", "filter").alias("shapley"),
    )


#: The same in SQL, by each document's first failing step in each order.
SQL = """
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, [w for w in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents),
own AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS low FROM words),
failing AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e FROM own),
masks AS (SELECT doc_id, part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask FROM failing),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
  AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s, bits[s] AS bit, list_sum(bits[1:s - 1])::INT AS before FROM orders, range(1, 6) r(s)),
told AS (SELECT part, o, s, bit, sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & coalesce(before, 0) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, o, s, bit)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told"""
