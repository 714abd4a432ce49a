"""Personal data: fixed kinds by expression, unseen identifiers by bootstrapped context.

Fixed kinds (e-mail, IPv4 address, payment card, phone) are found by expressions
with checks.  They and tokens of a well-formed shape (keys, hashes, account
numbers) are the seed entities.  Their contexts are lexical patterns: the word
before, the two words before, and the words on both sides (a name glued on by = or
: is a word before).  A pattern that holds SUPPORT different seeds gets all of its
slots in the corpus as edges to what stands there, whatever its shape, so that a
stop word's pattern has thousands of ordinary words against it.  Over this graph
Spark scores in turn patterns (the share of belief among their different
instances) and instances (by the confident patterns that hold them, less by the
share of their occurrences elsewhere) until no score changes.  Instances that come
to be believed give new patterns, and new slots, until no pattern is new.  What
stands in the slots of confident patterns gives spans of kind "id", and so do account
numbers, tokens and the like wherever they stand.  Fixed spans always stay.

All of it is SQL functions.  Each pass over the texts is a scan that joins the
words' contexts with the patterns looked for; slots are written only for patterns
whose instances in one row of PART can still make them confident, so the graph
stays in proportion to the seeds.  Where given instances are looked for, a bit map
of their hashes drops the other words inside their text, before words become rows.

Offsets are code points, ends exclusive.  Defined results: a null text has no
spans; empty tables give empty results; repeated rows are judged each for
themselves, and a repeated instance counts once in a pattern; ties can't arise, as
all patterns over the confidence count; texts of any length are read whole; other
columns are carried in a struct, so names can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import checkpoint, join_sized, keep, prefix_maxima, prefix_sums, scratch

# A match can only start where a run of its first characters starts, or where the last match ended: the guards say so,
# which spares long runs a start at each of their characters.  Looking back for doubled separators, not groups with
# optional parts, keeps the matcher from recursing on long runs.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])(?:[A-Za-z0-9.-](?<!\.\.))+(?<!\.)",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[0-9\x20-](?<![\x20-]{2}))+(?<=[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*EXPRESSIONS]
#: A word of a text: a name with what glues it to its value, or a run of anything but white space.
TOKEN = r"[A-Za-z_][A-Za-z_-]*+[=:](?=\S)|\S+"
#: What is trimmed off what stands in a slot, as a character class, and what is left of a word.
EDGES = r"""[\].,;:!?(){}<>"'`*#%&$|~…«»“”„‘’\[]"""
TRIMMED = re.sub(r"\\(.)", r"\1", EDGES[1:-1])
CORE = rf"^{EDGES}*+(\S*(?!{EDGES})\S)"
#: Stands for the start of a fixed span where contexts are read.
MARK = "\ue000"
# Shapes of identifiers, in lower case: hexadecimal keys, UUIDs, keys and tokens of services, account numbers, social security numbers.
SHAPES = r"^(?:[0-9a-f]{32,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?:akia|asia)[0-9a-z]{16}|gh[pousr]_[0-9a-z]{30,}|eyj[0-9a-z_-]{10,}\.[0-9a-z_.-]{10,}|[a-z]{2}[0-9]{2}[0-9a-z]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
#: What a text in lower case must hold somewhere for a word of it to have one of these shapes.
HINTS = r"[0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-|(?:akia|asia)[0-9a-z]{16}|gh[pousr]_|eyj[0-9a-z_-]{10}|[a-z]{2}[0-9]{2}[0-9a-z]{11}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
ACCOUNT = r"^[a-z]{2}[0-9]{2}[0-9a-z]{11,30}$"
#: Of these shapes what says by itself that it is personal or secret: a bare hash or UUID may name anything, and needs a context.
ALONE = r"^(?:(?:akia|asia)[0-9a-z]{16}|gh[pousr]_[0-9a-z]{30,}|eyj[0-9a-z_-]{10,}\.[0-9a-z_.-]{10,}|[a-z]{2}[0-9]{2}[0-9a-z]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
#: An identifier written in up to 16 groups.
GROUPS = r"^(?=\S*[0-9])[0-9A-Za-z]{1,8}(?: (?=[A-Z]*[0-9])[0-9A-Z]{1,8}(?![0-9A-Za-z])){1,15}"
SPAN = "array<struct<start:bigint,k:int,end:bigint>>"
#: One row in PART is counted before the patterns of all rows.
PART = 16
#: Bits of the map of instances looked for: 32 KB, whatever their number. It only saves rows, as a join follows.
SIEVE = 1 << 18
#: Confidence and belief in different instances that a pattern needs, belief from the shape alone, and belief that an instance needs.
CONFIDENT, SUPPORT, SHAPE_BELIEF, BELIEVED = 0.8, 3, 0.95, 0.5


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    value = lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.right(p, F.lit(3)).cast("int") <= 255).otherwise(F.lit(False))
        return F.forall(F.split(match, r"\."), part)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def span_of(kind: str):
    """A match and its start as a span, or null if the match fails its kind's check."""
    k = KINDS.index(kind)
    return lambda s, m: F.when(valid(kind, m), F.struct(s.cast("bigint").alias("start"), F.lit(k).alias("k"), (s + F.length(m)).cast("bigint").alias("end")))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add _spans, the fixed kinds' spans by start and kind, and _tokens, the identifier-like tokens with what surrounds them."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_t", F.when(t.rlike("[0-9@]"), t).otherwise(F.lit("")))
    needs = {"email": F.contains("_t", F.lit("@")), "ip": F.col("_t").rlike(r"[0-9]\.[0-9]"), "card": F.col("_t").rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.col("_t").rlike(r"\+[0-9]")}
    found = []
    for k, (kind, expression) in enumerate(EXPRESSIONS.items()):
        df = df.withColumn(f"_m{k}", F.when(needs[kind], F.regexp_extract_all("_t", F.lit(expression), F.lit(0))))
        df = df.withColumn(f"_p{k}", F.when(F.size(F.col(f"_m{k}")) > 0, F.slice(F.split("_t", expression, -1), 1, F.size(f"_m{k}"))))
        # The start of match i: all pieces up to its own, and all matches before it.
        steps = F.zip_with(f"_p{k}", F.concat(F.array(F.lit("")), F.slice(F.col(f"_m{k}"), F.lit(1), F.size(f"_m{k}") - 1)), lambda p, m: F.length(p) + F.length(m))
        df = df.withColumn(f"_d{k}", F.when(F.col(f"_p{k}").isNotNull(), steps))
        before = F.zip_with(prefix_sums(F.col(f"_d{k}")), F.col(f"_d{k}"), lambda a, x: a + x)
        df = df.withColumn(f"_s{k}", F.when(F.col(f"_p{k}").isNotNull(), before))
        spans = F.filter(
            F.zip_with(f"_s{k}", f"_m{k}", span_of(kind)),
            lambda x: x.isNotNull(),
        )
        df = df.withColumn(f"_f{k}", F.coalesce(spans.cast(SPAN), F.array().cast(SPAN)))
        found.append(f"_f{k}")
    df = df.withColumns({"_spans": F.sort_array(F.concat(*found)), **{f"n_{kind}": F.size(f"_f{k}").cast("bigint") for k, kind in enumerate(KINDS)}})
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], "_spans", *[f"n_{k}" for k in KINDS])


def stitched(text: Column, spans: Column, head, more) -> Column:
    """The text with each stretch of overlapping spans replaced: head(kind, start, end) for its first span, more(start, end) for what others add."""
    before = prefix_maxima(F.transform(spans, lambda s: s["end"]))

    def piece(s: Column, at: Column) -> Column:
        gap = F.substr(text, (at + 1).cast("int"), (s["start"] - at).cast("int"))
        longer = F.when(s["end"] > at, more(at, s["end"])).otherwise(F.lit(""))
        return F.when(s["start"] >= at, F.concat(gap, head(s["k"], s["start"], s["end"]))).otherwise(longer)

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    whole = F.concat(F.array_join(F.zip_with(spans, before, piece), ""), F.substr(text, (end + 1).cast("int")))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or stretch of overlapping spans, replaced by the kind of its first in brackets."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "id"]])
    return stitched(text, spans, lambda k, a, b: F.get(kinds, k), lambda a, b: F.lit(""))


def marked(text: Column, spans: Column) -> Column:
    """The text with each fixed span replaced by a word of the same length that starts with MARK and tells its content's hash."""
    own = lambda a, b: F.hex(F.xxhash64(F.lower(F.substr(text, (a + 1).cast("int"), (b - a).cast("int")))))
    return stitched(text, spans, lambda k, a, b: F.rpad(F.concat(F.lit(MARK), own(a, b)), (b - a).cast("int"), F.lit("x")), lambda a, b: F.repeat(F.lit("x"), (b - a).cast("int")))


def folded(text: Column) -> Column:
    """The text with the two characters replaced that have an ASCII letter in lower case, so that a text and its lower case have the same words."""
    return F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), F.translate(text, "\u212a\u0130", "ki")).otherwise(text)


def sieve(sought: DataFrame) -> DataFrame:
    """One row (_bits): SIEVE bits in longs, of which those of the kept instances' hashes are set."""
    at = F.col("instance").bitwiseAND(SIEVE - 1)
    own = sought.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(instance & 63 as int))")).alias("b"))
    longs = sought.sparkSession.range(SIEVE // 64).join(own, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")).alias("x"))
    return checkpoint(longs.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]).alias("_bits")))


def sifted(instance: Column) -> Column:
    """True if the bit of an instance's hash is set in _bits."""
    return F.getbit(F.get("_bits", F.shiftright(instance.bitwiseAND(SIEVE - 1), 6).cast("int")), instance.bitwiseAND(63).cast("int")) == 1


def contexts(rows: DataFrame, sought: DataFrame | None = None) -> DataFrame:
    """(_row, i, word, left, before, right) of each word of the marked texts _m, in lower case; before is the left word's left.

    With ``sought``, kept instances, words whose bit none of them has are left out.
    """
    bits = [] if sought is None else ["_bits"]
    rows = rows if sought is None else rows.crossJoin(F.broadcast(sieve(sought)))
    words = rows.select("_row", *bits, F.regexp_extract_all(F.lower(folded(F.col("_m"))), F.lit(TOKEN), F.lit(0)).alias("w"))
    if sought is not None:
        # One hash for each word and one look at the bits for each hash; only texts and words that pass get contexts.
        hashes = F.transform("w", lambda x: F.xxhash64(core(x)))
        words = words.where(F.exists(hashes, sifted))
        at = F.filter(F.transform(hashes, lambda h, i: F.when(sifted(h), i)), lambda i: i.isNotNull())
        place = lambda i: F.struct(i.alias("i"), F.get("w", i).alias("word"), F.get("w", i - 1).alias("left"), F.get("w", i - 2).alias("before"), F.get("w", i + 1).alias("right"))
        return words.select("_row", F.explode(F.transform(at, place)).alias("x")).select("_row", "x.*")
    none, n = F.array(F.lit(None).cast("string")), F.size("w")
    shifted = {"word": F.col("w"), "left": F.slice(F.concat(none, "w"), F.lit(1), n), "before": F.slice(F.concat(none, none, "w"), F.lit(1), n), "right": F.slice(F.concat("w", none), F.lit(2), n)}
    zipped = words.withColumns({k: v for k, v in shifted.items() if k != "word"})
    each = F.arrays_zip(F.col("w").alias("word"), "left", "before", "right")
    return zipped.select("_row", F.posexplode(each).alias("i", "c")).select("_row", "i", *[F.col("c")[k].alias(k) for k in shifted])


def patterns() -> Column:
    """The hashes of a context's patterns by kind: the word before, the words on both sides, the two words before; null where there is none."""
    one = F.when(F.col("left").isNotNull(), F.xxhash64(F.lit("l"), "left"))
    both = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), F.xxhash64(F.lit("b"), "left", "right"))
    two = F.when(F.col("before").isNotNull(), F.xxhash64(F.lit("l2"), "before", "left"))
    return F.array(one, both, two)


def core(word: Column | None = None) -> Column:
    """A word without its edges."""
    return F.btrim(F.col("word") if word is None else word, F.lit(TRIMMED))


def belief(word: Column) -> Column:
    """What is believed of a word without its context: 1 for fixed spans, SHAPE_BELIEF for the shapes, or 0."""
    return F.when(F.startswith(word, F.lit(MARK)), 1.0).when((F.length(word) >= 11) & word.rlike(SHAPES), SHAPE_BELIEF).otherwise(0.0)


def account(word: Column) -> Column:
    """True if a word of an account number's shape passes its check (the remainder by 97, letters counting from 10)."""
    turned = F.split(F.concat(F.substr(word, F.lit(5)), F.left(word, F.lit(4))), "")
    value = lambda c: F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), c) - 1
    step = lambda a, c: F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)).cast("int")
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def hinted(rows: DataFrame) -> DataFrame:
    """Rows with a word that may be believed without its context."""
    return rows.where(F.contains("_m", F.lit(MARK)) | F.lower(folded(F.col("_m"))).rlike(HINTS))


def lone(rows: DataFrame) -> DataFrame:
    """(_row, i) of words that are told by their shape wherever they stand; account numbers must pass their check."""
    shaped = rows.where(F.lower(folded(F.col("_m"))).rlike(HINTS))
    likely = contexts(shaped).where(F.length("word") >= 11).withColumn("word", core()).where((F.length("word") >= 11) & F.col("word").rlike(ALONE))
    return likely.where(F.when(F.col("word").rlike(ACCOUNT), account(F.col("word"))).otherwise(F.lit(True))).select("_row", "i")


def occurrences(rows: DataFrame) -> DataFrame:
    """(_row, i, word, kind, pattern) of each word and each of its patterns."""
    return contexts(rows).select("_row", "i", "word", F.posexplode(patterns()).alias("kind", "pattern")).where(F.col("pattern").isNotNull())


def seeds(rows: DataFrame) -> DataFrame:
    """(pattern, instance, score) of the words that are believed without their context."""
    likely = contexts(hinted(rows)).where(F.contains("word", F.lit(MARK)) | (F.length("word") >= 11)).withColumn("word", core())
    held = likely.withColumn("score", belief(F.col("word"))).where("score > 0")
    return held.select(F.explode(patterns()).alias("pattern"), F.xxhash64("word").alias("instance"), "score").where(F.col("pattern").isNotNull()).distinct()


def promising(held: DataFrame) -> DataFrame:
    """(pattern, s) of the patterns in (pattern, instance, score) that enough believed instances share."""
    return held.groupBy("pattern").agg(F.sum("score").alias("s")).where(F.col("s") >= SUPPORT * SHAPE_BELIEF)


def settle(edges: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) of the confident patterns and (instance, score) of all instances, once no score changes.

    edges: (pattern, instance, kind, prior, n), one row for each pair; totals: (instance, total), how often those without
    a prior occur at all.
    """
    prior = edges.groupBy("instance").agg(F.max("prior").alias("prior"))
    base = keep(prior.join(totals, "instance", "left"), "pii-instances")
    scores = base.select("instance", F.col("prior").alias("score"))
    before = None
    while True:
        marks = edges.join(scores, "instance").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
        marks = marks.withColumn("confidence", F.round(F.col("s") / (F.col("n") + 0.5), 9))
        high = checkpoint(marks.where((F.col("s") >= SUPPORT * SHAPE_BELIEF) & (F.col("confidence") >= CONFIDENT)).select("pattern", "confidence"))
        # An occurrence has one pattern of each kind, so the kind with the most tells how many are held.
        of = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in range(3)]
        lifted = join_sized(edges, high, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("new"), F.greatest(*of).alias("held"))
        after = base.join(lifted, "instance", "left")
        new = F.coalesce(F.col("new") * F.least(F.col("held") / F.col("total"), F.lit(1.0)), F.lit(0.0))
        scores = checkpoint(after.select("instance", F.round(F.greatest("prior", new), 9).alias("score")))
        now = tuple(scores.agg(F.count(F.when(F.col("score") > 0, 1)), F.round(F.sum("score"), 6)).first())
        if now == before:
            return high, scores
        before = now


def bootstrap(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_row, i): the words of (_row, _m) that confident patterns and belief tell to be identifiers; and (pattern, confidence)."""
    held = keep(seeds(rows), "pii-seeds")
    while True:
        wanted = checkpoint(promising(held))
        # Patterns that have too many different instances in a part of the rows alone to become confident need no slots;
        # this only saves work, as all others are counted over all rows.
        part = rows.where(F.pmod(F.xxhash64("_row"), F.lit(PART)) == 0)
        sizes = join_sized(occurrences(part), wanted.select("pattern"), "pattern").groupBy("pattern").agg(F.approx_count_distinct("word", 0.05).alias("n"))
        common = sizes.join(wanted, "pattern").where(F.col("n") * (CONFIDENT / 3) > F.col("s"))
        open_ones = checkpoint(wanted.join(common, "pattern", "left_anti").select("pattern"))
        places = join_sized(occurrences(rows), open_ones, "pattern").withColumn("word", core()).where("word <> ''")
        slots = keep(places.select("_row", "i", F.xxhash64("word").alias("instance"), "kind", "pattern", belief(F.col("word")).alias("prior")), "pii-slots")
        edges = slots.groupBy("pattern", "instance", "kind").agg(F.max("prior").alias("prior"), F.count("*").alias("n"))
        enough = wanted.join(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pattern").where(F.col("s") >= F.col("n") * (CONFIDENT / 2)).select("pattern")
        enough = checkpoint(enough)
        edges = keep(join_sized(edges, enough, "pattern", "left_semi"), "pii-graph")
        fillers = checkpoint(edges.where("prior = 0").select("instance").distinct())
        known = fillers.isEmpty()
        if known:
            totals = edges.sparkSession.range(0).select(F.col("id").alias("instance"), F.col("id").alias("total"))
        else:
            found = keep(join_sized(contexts(rows, fillers).select(F.xxhash64(core()).alias("instance"), patterns().alias("patterns")), fillers, "instance").groupBy("instance", "patterns").agg(F.count("*").alias("n")), "pii-fillers")
            totals = found.groupBy("instance").agg(F.sum("n").alias("total"))
        high, scores = settle(edges, totals)
        believed = checkpoint(scores.where(F.col("score") >= BELIEVED))
        if known:
            break
        more = found.join(believed, "instance").select(F.explode("patterns").alias("pattern"), "instance", "score").where(F.col("pattern").isNotNull()).distinct()
        held = keep(held.join(fillers, "instance", "left_anti").select("pattern", "instance", "score").unionByName(more), "pii-seeds")
        # Only patterns with more belief than before that have no edges yet can change anything.
        rising = promising(held).join(wanted.withColumnRenamed("s", "before"), "pattern", "left").where(F.col("before").isNull() | (F.col("s") > F.col("before") + 1e-6))
        if rising.join(enough, "pattern", "left_anti").isEmpty():
            break
    chosen = join_sized(join_sized(slots.where("prior < 1"), high, "pattern"), believed, "instance", "left_semi")
    return chosen.select("_row", "i").distinct(), high


def identifiers(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(_row, _more): spans of the chosen words of (_row, _m), with following groups where one is written in groups."""
    places = keep(chosen.groupBy("_row").agg(F.sort_array(F.collect_list("i")).alias("_at")), "pii-places")
    t = join_sized(rows, places, "_row").select("_row", "_m", "_at", folded(F.col("_m")).alias("f"))
    t = t.withColumns({"w": F.regexp_extract_all("f", F.lit(TOKEN), F.lit(0)), "g": F.split("f", TOKEN, -1)})
    steps = F.zip_with(F.slice(F.col("g"), F.lit(1), F.size("w")), F.concat(F.array(F.lit("")), F.slice(F.col("w"), F.lit(1), F.size("w") - 1)), lambda g, w: F.length(g) + F.length(w))
    t = t.withColumn("d", steps)
    t = t.withColumn("s", F.zip_with(prefix_sums(F.col("d")), F.col("d"), lambda a, x: a + x))

    def span(i: Column) -> Column:
        word = F.get("w", i)
        start = F.get("s", i) + F.length(F.regexp_extract(word, rf"^{EDGES}*", 0))
        grouped = F.length(F.regexp_extract(F.substr("_m", (start + 1).cast("int")), GROUPS, 0))
        return F.struct(start.alias("start"), F.lit(len(KINDS)).alias("k"), (start + F.greatest(F.length(F.regexp_extract(word, CORE, 1)), grouped)).cast("bigint").alias("end"))

    return t.select("_row", F.transform("_at", span).cast(SPAN).alias("_more"))


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row's carried columns, n_email, n_ip, n_card, n_phone, base (spans) and spans (all, "id" as kind 4)."""
    carry = docs.columns if carry is None else carry
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_doc"), F.col(text).alias("_text"))
    found = with_spans(held, "_text").withColumns({"_row": F.monotonically_increasing_id(), "_text": F.coalesce("_text", F.lit(""))})
    with scratch(docs.sparkSession) as made:
        rows = keep(found.withColumn("_m", marked(F.col("_text"), F.col("_spans"))).drop("_text"), "pii-rows")
        chosen = bootstrap(rows)[0].unionByName(lone(rows)).distinct()
        extra = keep(identifiers(rows, chosen), "pii-identifiers")
        made.hold(rows, extra)
    out = join_sized(rows.drop("_m"), extra, "_row", "left")
    return out.select("_doc", *[f"n_{k}" for k in KINDS], F.col("_spans").alias("base"), F.when(F.col("_more").isNull(), F.col("_spans")).otherwise(F.sort_array(F.concat("_spans", "_more"))).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in [*KINDS, "id"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op10 returns."""
    return found.select(F.col("_doc")[key].alias(key), *[f"n_{k}" for k in KINDS], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))

