"""Text functions as column expressions: slugs, checks, formats, escapes, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collonade.functions.casts import parse_date
from collonade.operators.ordering import ranked

# Lower-case letters and what stands for them in slugs.
LETTERS = {
    # Latin
    "ą": "a", "č": "c", "ę": "e", "ė": "e", "į": "i", "š": "s", "ų": "u", "ū": "u", "ž": "z",
    "ć": "c", "ł": "l", "ń": "n", "ó": "o", "ś": "s", "ź": "z", "ż": "z",
    "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss",
    "à": "a", "â": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "î": "i", "ï": "i", "ô": "o", "ù": "u", "û": "u", "ÿ": "y", "ç": "c",
    "á": "a", "í": "i", "ú": "u", "ñ": "n", "ã": "a", "õ": "o",
    "ě": "e", "ř": "r", "ť": "t", "ů": "u", "ý": "y", "ă": "a", "ș": "s", "ț": "t", "ğ": "g", "ı": "i", "ş": "s",
    "å": "a", "æ": "ae", "ø": "o", "ā": "a", "ē": "e", "ģ": "g", "ī": "i", "ķ": "k", "ļ": "l", "ņ": "n",
    # Greek
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    # Cyrillic
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "є": "ye", "і": "i", "ї": "yi", "ґ": "g",
    "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz",
}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
UNITS = ["B", "KB", "MB", "GB"]


def transliterate(c: Column) -> Column:
    """The text in lower case with other letters as plain ones."""
    c = F.lower(F.translate(c, "İ", "i"))
    for letter, plain in LETTERS.items():
        if len(plain) > 1:
            c = F.replace(c, F.lit(letter), F.lit(plain))
    one = {k: v for k, v in LETTERS.items() if len(v) == 1}
    return F.translate(c, "".join([*one, *(k for k, v in LETTERS.items() if not v)]), "".join(one.values()))


def slug(c: Column) -> Column:
    """Lower case, plain letters, digits and single hyphens."""
    return F.regexp_replace(F.regexp_replace(transliterate(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unique_slugs(df: DataFrame, base: str, order: str, out: str = "slug", taken: DataFrame | None = None, reserved: tuple[str, ...] = (), first: int = 2) -> DataFrame:
    """Add out: base for the first row of each base by order, then base-2, base-3 and so on (from first), without those in use.

    In use are the bases themselves, the slugs in taken (a column of base's name) and, as they are, the reserved ones.
    An empty base stays empty.  order should leave no ties in a base.  Numbers are places in range partitions, so that a
    base of many rows, or with many numbers in use, is many tasks.
    """
    old = df.select(F.col(base).alias("_s"), F.lit(False).alias("_old"))
    if taken is not None:
        old = old.union(taken.select(F.col(base), F.lit(True)))
    names = old.groupBy("_s").agg(F.max("_old").alias("_old"))
    ended = names.select(F.regexp_extract("_s", r"^(.*)-([0-9]{1,9})$", 1).alias("_base"), F.regexp_extract("_s", r"^(.*)-([0-9]{1,9})$", 2).alias("_n"))
    used = ended.where("_n <> '' AND _n NOT LIKE '0%'").select("_base", F.col("_n").cast("bigint").alias("_u")).where(F.col("_u") >= first).distinct()
    # The j-th number u in use has u - first + 1 - j free ones below it; the k-th free one is first - 1 + k and the number of those with fewer than k.
    used = ranked(used, ["_u"], "_base", "_j").select(F.col("_base").alias("_b"), (F.col("_u") - first + 1 - F.col("_j")).alias("_k"))
    lost = names.where("_old").select(F.col("_s").alias("_b0"), F.lit(True).alias("_lost"))
    rows = ranked(df, [order], base, "_place").join(lost, F.col(base) == F.col("_b0"), "left").drop("_b0")
    bare = ~F.coalesce("_lost", F.lit(False)) & (~F.col(base).isin(*reserved) if reserved else F.lit(True))
    rows = rows.withColumn("_k", F.when(bare, F.col("_place") - 1).otherwise(F.col("_place"))).drop("_lost")
    met = rows.select(F.col(base).alias("_b"), "_k", F.lit(0).alias("_kind"), F.struct(*rows.columns).alias("_row")).unionByName(used.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    swept = ranked(met, ["_k", "_kind"], "_b", "_at").where("_kind = 0").select("_row.*", "_at")
    number = F.col("_k") + first - 1 + F.col("_at") - F.col("_place")
    named = F.when((F.col("_k") == 0) | (F.col(base) == ""), F.col(base)).otherwise(F.concat_ws("-", F.col(base), number.cast("string")))
    return swept.withColumn(out, named).drop("_at", "_place", "_k")


def copy_slug(c: Column) -> Column:
    """The slug of a copy: without a number at its end, with -copy."""
    return F.concat(F.regexp_replace(c, r"-\d+$", ""), F.lit("-copy"))


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def is_phone(c: Column) -> Column:
    """Digits, spaces and the usual marks, with at least seven digits."""
    return F.coalesce(c.rlike(r"^[+]?[\d\s().-]+$") & (F.length(F.regexp_replace(c, r"\D", "")) >= 7), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(c, F.lit("HOST")).isNotNull(), F.lit(False))


def truncated(c: Column, limit: int = 50) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def file_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves one or more, to two digits."""
    k = F.when(n > 0, F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(3))).otherwise(0).cast("int")
    return F.concat_ws(" ", F.round(n / F.pow(F.lit(1024.0), k), 2).cast("decimal(18,2)").cast("string"), F.get(F.array(*map(F.lit, UNITS)), k))


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def decode_entities(c: Column) -> Column:
    """Numeric references, then the six common named ones, the ampersand last; what a numeric one gives may be part of a named one.

    Numbers that are no character (surrogates, zero, beyond U+10FFFF) stay as they are written.
    """
    digits = lambda x: F.regexp_extract(x, r"^&#[xX]?([0-9A-Fa-f]+);$", 1)
    code = lambda x: F.conv(digits(x), F.when(x.rlike("^&#[xX]"), 16).otherwise(10), 10).cast("bigint")
def decode_entities(c: Column) -> Column:
    """Common named references, whatever their case, and numeric ones as their characters, each once: what one gives is not decoded again.

    Numbers that are no character (zero, surrogates, beyond U+10FFFF) stay as they are written.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(x: Column) -> Column:
        tens, hexes = (F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in (r"^&#0*([0-9]{1,7});$", r"^&#[xX]0*([0-9A-Fa-f]{1,6});$"))
        n = F.coalesce(tens.cast("int"), F.conv(hexes, 16, 10).cast("int"))
        letter = F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(names, F.lower(x)), letter, x)

    parts = F.regexp_extract_all(c, F.lit(r"&#?[0-9A-Za-z]{1,12};|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def plain_text(html: Column) -> Column:
    """HTML without scripts, styles, comments and tags, with single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(bare, r"<[^>]*>", " ")), r"\s+", " "))


def display_date(ts: Column, zone: str) -> Column:
    """As "Jan 5, 2024, 13:45" in the zone; '' where there is no time."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "MMM d, yyyy, HH:mm"), F.lit(""))


def to_utc(local: Column, zone: str) -> Column:
    return F.to_utc_timestamp(local, zone)


def item_hash(values: Column) -> Column:
    """SHA-256 of (field, value) pairs in order of their field; a null value counts as ''."""
    part = lambda v: F.concat(F.lit('{"field_id":"'), v["field"], F.lit('","value":"'), F.coalesce(v["value"], F.lit("")), F.lit('"}'))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), part), ","), F.lit("]")), 256)


def interpolated(template: Column, fields: dict[str, Column]) -> Column:
    """The template with {{name}} replaced by the named columns, and unknown names removed."""
    for name, c in fields.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(c.cast("string"), F.lit("")))
    return F.regexp_replace(template, r"\{\{[^}]*\}\}", "")


def url_slug(path: Column, pattern: str) -> Column:
    """The part of a path where the pattern has {slug}, or null."""
    before, after = pattern.split("{slug}")
    return F.nullif(F.regexp_extract(path, f"^{before}([^/]+){after}$", 1), F.lit(""))


def escape_like(value: str) -> str:
    """A literal for LIKE patterns with backslash as escape."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def locale_of(path: Column, codes: list[str]) -> Column:
    """The path's first segment, in lower case, if it is one of the locale codes."""
    first = F.lower(F.split_part(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit(1)))
    return F.when(first.isin(*[c.lower() for c in codes]), first)


def hmac_sha256(message: Column, key: str) -> Column:
    """The message's signature in lower-case hexadecimal."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def rich_text(html: Column) -> Column:
    """Blocks of HTML (headings, paragraphs, quotes, list items) as a JSON document; marks within blocks are dropped."""
    # Possessive runs between tags: the matcher keeps no state for each character, so that a block may be of any length.
    block = F.lit(r"(?is)<(h[1-6]|p|div|blockquote|li)\b[^>]*>([^<]*+(?:<(?!/?(?:h[1-6]|p|div|blockquote|li)\b)[^<]*+)*+)")
    tags, bodies = F.regexp_extract_all(html, block, F.lit(1)), F.regexp_extract_all(html, block, F.lit(2))
    kind = lambda t: F.when(F.lower(t).rlike("^h[1-6]$"), "heading").when(F.lower(t) == "blockquote", "blockquote").when(F.lower(t) == "li", "listItem").otherwise("paragraph")
    level = lambda t: F.when(F.lower(t).rlike("^h[1-6]$"), F.substr(t, F.lit(2)).cast("int"))
    blocks = F.zip_with(tags, F.transform(bodies, plain_text), lambda t, b: F.struct(kind(t).alias("type"), level(t).alias("level"), F.array(F.struct(F.lit("text").alias("type"), b.alias("text"))).alias("content")))
    kept = F.filter(blocks, lambda b: b["content"][0]["text"] != "")
    whole = F.array(F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), F.array(F.struct(F.lit("text").alias("type"), plain_text(html).alias("text"))).alias("content")))
    return F.to_json(F.struct(F.lit("doc").alias("type"), F.when(F.size(kept) > 0, kept).otherwise(whole).alias("content")))


def rich_text_plain(doc: Column) -> Column:
    """The texts of a JSON document in order, joined by single spaces."""
    found = F.regexp_extract_all(doc, F.lit(r'"text":("(?:[^"\\]++|\\.)*+")'), F.lit(1))
    texts = F.transform(found, lambda t: F.from_json(F.concat(F.lit('{"t":'), t, F.lit("}")), "t string")["t"])
    return F.trim(F.regexp_replace(F.array_join(texts, " "), r"\s+", " "))


def displayed(c: Column, kind: str, zone: str = "UTC") -> Column:
    """A cell's text for readers, by the kind of its field: rich text as plain, dates in a zone; '' where it is null."""
    if kind == "rich_text":
        c = F.when(F.try_parse_json(c).isNotNull(), rich_text_plain(c)).otherwise(c)
    if kind == "date":
        c = display_date(parse_date(c), zone)
    return F.coalesce(c, F.lit(""))


def is_field_name(c: Column) -> Column:
    """Lower-case letters, digits and underscores, a letter first."""
    return F.coalesce(c.rlike("^[a-z][a-z0-9_]*$"), F.lit(False))


def is_collection_name(c: Column) -> Column:
    """Lower-case letters, digits and hyphens, a letter first."""
    return F.coalesce(c.rlike("^[a-z][a-z0-9-]*$"), F.lit(False))
