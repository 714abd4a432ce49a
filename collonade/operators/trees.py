"""Nested JSON of any depth as rows of strings, and canonical hashes of it.

A tree is opened in rounds, each an explode: what is below the last one's nodes takes their place, until only
scalars and empty ones are left, each with its path.  How many rounds there are is told by the deepest text.  A hash
is that of the canonical text, made in the tree's row.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.sources.folders import cut

#: Between the steps of a path; escaped where a name holds it.
STEP = "/"
MARKS = (("~", "~0"), (STEP, "~1"), ("[", "~2"))
#: Rounds in one plan; deeper trees go on from a checkpoint.
ROUNDS = 12
#: A string of a JSON text.
TEXT = r'"(?:[^"\\]++|\\.)*+"'


def depth(tree: Column) -> Column:
    """How deep the brackets of a JSON text are nested, those in its strings left out."""
    brackets = F.regexp_replace(F.regexp_replace(tree, TEXT, ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step, lambda a: a["most"])


def deepest(df: DataFrame, tree: str) -> int:
    """The depth of the deepest tree that can be read: a parser opens only so many levels, so no text asks for more rounds than that."""
    deep = depth(F.col(tree))
    return df.agg(F.max(F.when((deep <= ROUNDS) | F.try_parse_json(F.col(tree)).isNotNull(), deep))).first()[0] or 0


def canonical(df: DataFrame, tree: str, ignore: Sequence[str] = (), out: str = "_canonical") -> DataFrame:
    """Add out: each tree as JSON without white space, its attributes in order of their names, those named in ignore left out with all below them.

    An object of which nothing is left is an empty one.  Null where the text is null or no JSON.
    """
    whole = F.to_json(F.try_parse_json(F.col(tree)))
    if not ignore:
        return df.withColumn(out, whole)
    # How deep an ignored value may be, which is as deep as the pattern must go: by the texts that may hold one, be it written with escapes.
    may = F.col(tree).rlike("|".join([r"\\", *(re.escape(json.dumps(n, ensure_ascii=False)) for n in ignore)]))
    inner = ""
    for _ in range(deepest(df.where(may), tree)):
        inner = rf'[\[{{](?:{TEXT}|[^\[\]{{}}"]++{"|" + inner if inner else ""})*+[\]}}]'
    value = "|".join(x for x in (TEXT, inner, r"[^\[\]{},\"]++") if x)
    names = "|".join(re.escape(json.dumps(n, ensure_ascii=False)) for n in ignore)
    # A quote next to a brace or comma is the start of a name or the end of a text, and no colon follows a text.
    first = F.regexp_replace(whole, rf"(?<=\{{)(?:(?:{names}):(?:{value})(?:,|(?=\}})))++", "")
    return df.withColumn(out, F.regexp_replace(first, rf",(?:{names}):(?:{value})", ""))


def hashed(df: DataFrame, tree: str, ignore: Sequence[str] = (), out: str = "hash") -> DataFrame:
    """Add out: SHA-256 over each tree; the order of attributes and white space don't matter, the order of elements does.

    Attributes named in ignore (what only an editor needs) don't matter either.  A null or unreadable tree has a null hash.
    """
    return canonical(df, tree, ignore).withColumn(out, F.sha2("_canonical", 256)).drop("_canonical")


def hashes(df: DataFrame, key: str, tree: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(key, hash) of each row, as hashed() has it."""
    return hashed(df.select(key, tree), tree, ignore).select(key, "hash")


def strings(df: DataFrame, key: str, tree: str) -> DataFrame:
    """An inverted index (key, path, value) of all strings of the trees; places in lists are written [] in the path.

    Strings are rows of their own, so the rounds are explodes of one plan: what is a leaf stays as it is in the later ones.
    """
    spark, name = df.sparkSession, F.col("name")
    for mark, safe in MARKS:
        name = F.replace(name, F.lit(mark), F.lit(safe))
    step = F.coalesce(name, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    now = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(F.col(tree)).alias("v")).where("v IS NOT NULL")
    for i in range(1, deepest(df, tree) + 1):
        opened = spark.sql("SELECT n.key, n.path, n.v, c.pos, c.key AS name, c.value FROM {now} n, LATERAL variant_explode_outer(n.v) c", now=now)
        below = F.col("pos").isNotNull()
        now = opened.select("key", F.when(below, F.concat("path", F.lit(STEP), step)).otherwise(F.col("path")).alias("path"), F.when(below, F.col("value")).otherwise(F.col("v")).alias("v"))
        if i % ROUNDS == 0:
            now = cut(now)
    found = now.where(F.schema_of_variant("v") == "STRING")
    return found.select(F.col("key").alias(key), F.regexp_replace("path", r"/\[[0-9]+\](?=/|$)", "[]").alias("path"), F.variant_get("v", "$", "string").alias("value"), F.col("path").alias("exact"))


def bound(index: DataFrame, key: str, ids: DataFrame, id: str, places: Sequence[str], typed: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(key, id, path): where strings of an index stand for ids: at the end of a path in places, or next to a mark.

    typed has (place, mark, value): the place counts if the string at mark, which is beside the object that holds the place's last step, is value.  A label with the
    same text as an id stands at none of them.
    """
    ends = lambda place: F.col("path").endswith(STEP + place)
    hit = lambda rule, stem, mark: F.struct(F.lit(rule).alias("rule"), stem.alias("stem"), F.lit(mark).alias("mark"))
    # Rule 0 needs no mark: each place stands for itself.  All rules are looked for in one pass.
    hits = [F.when(reduce(lambda a, b: a | b, [ends(p) for p in places], F.lit(False)), hit(0, F.col("exact"), True))]
    for rule, (place, mark, value) in enumerate(typed, 1):
        steps = place.count(STEP) + 1
        hits.append(F.when(ends(place), hit(rule, F.regexp_replace("exact", rf"(/[^/]*){{{steps}}}$", ""), False)))
        hits.append(F.when(ends(mark) & (F.col("value") == value), hit(rule, F.regexp_replace("exact", r"/[^/]*$", ""), True)))
    found = index.select(key, "value", "path", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "value", "path", "h.*")
    # A mark has no place of its own but with rule 0.
    stands = F.when(~F.col("mark") | (F.col("rule") == 0), F.struct("value", "path"))
    grouped = found.groupBy(key, "rule", "stem").agg(F.max("mark").alias("marked"), F.collect_list(stands).alias("at")).where("marked")
    told = grouped.select(key, F.inline("at")).select(key, "value", "path")
    wanted = ids.select(F.col(id).cast("string").alias("value"))
    return told.join(wanted, "value", "left_semi").select(key, F.col("value").alias(id), "path").distinct()
