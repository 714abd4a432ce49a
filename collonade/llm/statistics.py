"""Text statistics in SQL functions alone, in one pass over the text and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import WHITE

SYMBOLS = "#*$%&|<>"
REPEAT = 5


def count_of(text: str | Column, characters: str) -> Column:
    """How many characters of the text are of the given ones."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper, n_digits, n_marks.

    A null text has no words.  Words are runs of anything but the six ASCII white
    space characters; a line counts if it has a word.  The input's own columns of
    these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    given = docs.columns
    one = docs.select(
        *[F.col(f"`{c}`") for c in given],
        t.alias("_t"),
        F.filter(F.split(t, WHITE), lambda w: w != "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    two = one.withColumns({
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        "_chars": F.length(F.translate(F.col("_t"), "\t\n\x0b\x0c\r ", "")).cast("bigint"),
    })
    # Windows of REPEAT words are compared by 64-bit hash; only texts that repeat one sort theirs.  Neighbours that
    # agree in the sorted order mark their positions, and a marked position covers what the next one does not.
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - REPEAT), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(REPEAT)]))
    three = two.withColumn("_win", F.when(F.size("_h") >= REPEAT, windows).otherwise(F.array().cast("array<bigint>")))
    order = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.withColumn("_s", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), order))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    marked = F.transform("_s", lambda x, i: F.when(same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1)), x["i"]))
    five = four.withColumn("_at", F.sort_array(F.filter(marked, lambda x: x.isNotNull())))
    steps = F.transform("_at", lambda p, i: F.least(F.lit(REPEAT), F.coalesce(F.get("_at", i + 1), p + REPEAT) - p))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    new = {
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.col("_chars"),
        "n_symbols": count_of("_t", SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "n_repeat_words": covered,
        "n_lines": F.size("_l").cast("bigint"),
        "n_distinct": F.size(F.array_distinct("_h")).cast("bigint"),
        "n_upper": F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("bigint"),
        "n_digits": count_of("_t", "0123456789"),
        "n_marks": count_of("_t", "!?;:=(){}[]/\\^~_+@"),
    }
    return five.select(*[F.col(f"`{c}`") for c in given if c not in new], *[v.alias(k) for k, v in new.items()])
