"""Variables in texts: tags that hold JSON and stand for a field's value.

All of it is column expressions: a text is cut into what is between its tags and the
tags, each tag is parsed and looked up in the row's maps, and the parts are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from collonade.functions.text import displayed

TAG = "inline-variable"


def looked_up(path: Column, source: Column, layer: Column, own: Column, page: Column, layers: Column | None = None) -> Column:
    """A value from the row's maps of texts: the page's only if the source is page; a named layer's where there is one; the row's own, and without a source else the page's."""
    get = lambda m: F.try_element_at(m, path)
    mine, others = get(own), get(page)
    found = F.when(source == "collection", mine).otherwise(F.coalesce(mine, others))
    if layers is not None:
        of_layer = F.try_element_at(layers, layer)
        found = F.when(layer.isNotNull() & of_layer.isNotNull(), get(of_layer)).otherwise(found)
    return F.when(source == "page", others).otherwise(found)


def resolved(text: Column, own: Column, page: Column | None = None, layers: Column | None = None, zone: str = "UTC", tag: str = TAG) -> Column:
    """The text with each <tag>{JSON}</tag> of a field replaced by the field's value, shown by its type, or '' where it has none.

    own, page and layers are maps of texts (of layers: maps by the layer's id); a field of a related row has the path of
    fields to it, joined by dots.  Tags that are no JSON or no field stay as they are; where there are neither own nor page
    values all tags go.  A null text is ''.
    """
    page = F.lit(None).cast("map<string,string>") if page is None else page
    pattern = rf"(?s)<{tag}>.*?</{tag}>"
    whole = F.coalesce(text, F.lit(""))
    tags = F.regexp_extract_all(whole, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(whole, pattern, -1)

    # Each step is an array of its own, so that what a later one names twice is made once.
    def parsed(t: Column) -> Column:
        body = F.trim(F.substr(t, F.lit(len(tag) + 3), F.length(t) - (2 * len(tag) + 5)))
        return F.struct(t.alias("tag"), F.try_parse_json(body).alias("v"))

    def read(x: Column) -> Column:
        get = lambda p: F.try_variant_get(x["v"], p, "string")
        more = F.filter(F.coalesce(F.try_variant_get(x["v"], "$.data.relationships", "array<string>"), F.array().cast("array<string>")), lambda y: y.isNotNull())
        field = get("$.data.field_id")
        path = F.when((get("$.type") == "field") & (field != ""), F.array_join(F.concat(F.array(field), more), "."))
        return F.struct(x["tag"].alias("tag"), path.alias("path"), get("$.data.source").alias("source"), get("$.data.collection_layer_id").alias("layer"), get("$.data.field_type").alias("kind"))

    def filled(x: Column) -> Column:
        found = F.when(x["path"].isNotNull(), looked_up(x["path"], x["source"], x["layer"], own, page, layers))
        return F.struct(x["tag"].alias("tag"), x["path"].alias("path"), x["kind"].alias("kind"), found.alias("found"))

    def value(x: Column) -> Column:
        shown = F.when(x["kind"] == "rich_text", displayed(x["found"], "rich_text")).when(x["kind"] == "date", displayed(x["found"], "date", zone)).otherwise(F.coalesce(x["found"], F.lit("")))
        return F.when(x["path"].isNotNull(), shown).otherwise(x["tag"])

    filled_tags = F.transform(F.transform(F.transform(tags, parsed), read), filled)
    values = F.when(own.isNull() & page.isNull(), F.transform(tags, lambda t: F.lit(""))).otherwise(F.transform(filled_tags, value))
    return F.concat_ws("", F.flatten(F.zip_with(between, values, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))))


def with_dates(df, kinds: dict[str, str], zone: str):
    """Rows with every field of kind date shown in the zone, '' where it is no date; other columns stay."""
    return df.withColumns({c: displayed(F.col(c).cast("string"), "date", zone) for c, k in kinds.items() if k == "date"})
