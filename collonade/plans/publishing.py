"""Queries of the field catalogue, change sets, publishing and reverting, typed sorts and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collonade.functions import text
from collonade.operators import catalogue, eav, hierarchy, publishing, relations, sorting
from collonade.operators.publishing import Kind
from collonade.plans.adapter import Tables
from collonade.plans.queries import TREE, query

DRAFT_FIELDS = "SELECT n_nationkey AS id, n_regionkey AS collection_id, CASE WHEN n_nationkey % 8 = 0 THEN (n_regionkey + 1) % 5 END AS reference_collection_id, n_name AS name, n_nationkey % 7 AS \"order\", n_nationkey % 5 = 0 AS is_computed FROM nation"
ITEMS = """(SELECT c_custkey, c_mktsegment AS segment, c_custkey % 11 <> 0 AS is_publishable, false AS is_published, c_custkey % 13 = 0 AS gone FROM customer UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN concat(c_mktsegment, '*') ELSE c_mktsegment END, true, true, false FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT -s_suppkey - 1, 'NONE', true, true, false FROM supplier)"""
ENTRIES = "(SELECT o_orderkey, o_custkey, o_orderstatus, false AS is_published FROM orders UNION ALL SELECT o_orderkey, o_custkey, 'old', true FROM orders WHERE o_orderkey % 3 = 0)"
SITE = [Kind("items", "c_custkey"), Kind("entries", "o_orderkey", "o_custkey", "items")]


@query(f"SELECT id, name FROM ({DRAFT_FIELDS}) WHERE NOT is_computed AND name ILIKE '%an%'")
def sc09_fields(t: Tables) -> DataFrame:
    return catalogue.fields(t.fields(), published=False, computed=False, search=" AN ").select("id", "name")


@query(f"SELECT id, name, \"order\" FROM ({DRAFT_FIELDS}) WHERE collection_id = 2")
def sc10_fields_of_one(t: Tables) -> DataFrame:
    return catalogue.fields(t.fields(), collection=2, published=False).select("id", "name", "order")


@query("SELECT s_suppkey AS item, CASE WHEN s_suppkey % 2 = 0 AND n_nationkey % 6 = 1 THEN concat(n_name, '*') ELSE n_name END AS name, lower(n_name) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1 OR n_nationkey % 4 <> 0")
def j01_values_with_fields(t: Tables) -> DataFrame:
    values = t.supplier.select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("field_id"), (F.col("s_suppkey") % 2 == 0).alias("is_published"))
    return catalogue.with_fields(values, t.fields()).select("item", "name", "key")


@query(f"SELECT id, r_name AS collection FROM ({DRAFT_FIELDS}) f JOIN region ON collection_id = r_regionkey WHERE reference_collection_id = 1 AND collection_id <> 1")
def j15_inverse_fields(t: Tables) -> DataFrame:
    collections = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return catalogue.inverse_fields(t.fields().where("not is_published"), collections, 1).select("id", "collection")


@query("SELECT c_custkey AS item, 'c_mktsegment' AS field, c_mktsegment AS value FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'c_name', c_name FROM customer WHERE c_custkey % 10 = 0")
def n02_value_changes(t: Tables) -> DataFrame:
    kinds = {"c_name": "text", "c_mktsegment": "text"}
    return publishing.changed(*[eav.to_cells(df, "c_custkey", kinds) for df in (t.draft(), t.published())], ["item", "field"], ["value"])


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 6 IN (1, 3)")
def n19_field_changes(t: Tables) -> DataFrame:
    attributes = ["name", "key", "type", "order", "reference_collection_id", "is_computed", "data"]
    df = t.fields()
    return publishing.changed(publishing.state(df, False), publishing.state(df, True), ["id"], attributes).select("id", "name")


@query("SELECT r_regionkey AS id FROM region WHERE r_regionkey IN (0, 3)")
def n22_unpublished_collections(t: Tables) -> DataFrame:
    draft = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") > 1, "{}").alias("sorting"))
    old = draft.where("id <> 0").withColumn("sorting", F.when(F.col("id") == 3, "[]").otherwise(F.col("sorting")))
    return publishing.changed(draft, old, ["id"], ["name", "sorting"]).select("id")


@query(f"SELECT segment AS c_mktsegment, CAST(count(*) FILTER (c_custkey % 10 = 0 OR c_custkey % 7 = 0) AS BIGINT) AS n FROM {ITEMS} WHERE NOT is_published GROUP BY 1")
def a08_publishable_counts(t: Tables) -> DataFrame:
    return publishing.changed_counts(t.draft(), t.published(), "c_custkey", "c_mktsegment", ["c_mktsegment"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 10 <> 0")
def j17_deleted_twins(t: Tables) -> DataFrame:
    return publishing.deleted_twins(t.items(), "c_custkey").select("c_custkey")


def some(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 5 = 1").select("c_custkey")


@query(f"SELECT c_custkey, is_published, CASE WHEN c_custkey > 0 AND c_custkey % 5 = 1 THEN false ELSE is_publishable END AS is_publishable FROM {ITEMS} WHERE NOT (is_published AND c_custkey > 0 AND c_custkey % 5 = 1)")
def n06_unpublished(t: Tables) -> DataFrame:
    return publishing.unpublished(t.items(), "c_custkey", some(t)).select("c_custkey", "is_published", "is_publishable")


@query(f"SELECT c_custkey, is_published, CASE WHEN c_custkey > 0 AND c_custkey % 5 = 1 THEN true ELSE is_publishable END AS is_publishable FROM {ITEMS} WHERE NOT (is_published AND c_custkey > 0 AND c_custkey % 5 = 1)")
def n06_staged(t: Tables) -> DataFrame:
    return publishing.staged(t.items(), "c_custkey", some(t)).select("c_custkey", "is_published", "is_publishable")


@query(f"""SELECT c_custkey, segment AS c_mktsegment, is_published, is_publishable OR (c_custkey > 0 AND c_custkey % 5 = 1 AND c_custkey % 13 <> 0) AS is_publishable FROM {ITEMS}
WHERE NOT (is_published AND c_custkey > 0 AND c_custkey % 5 = 1 AND c_custkey % 13 <> 0)
UNION ALL SELECT c_custkey, c_mktsegment, true, true FROM customer WHERE c_custkey % 5 = 1 AND c_custkey % 13 <> 0""")
def n06_published_now(t: Tables) -> DataFrame:
    return publishing.published_now(t.items(), "c_custkey", some(t)).select("c_custkey", "c_mktsegment", "is_published", "is_publishable")


@query(f"SELECT * FROM {ENTRIES} WHERE NOT is_published OR o_custkey % 5 <> 1 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, true FROM orders WHERE o_custkey % 5 = 1")
def n09_children_synced(t: Tables) -> DataFrame:
    return publishing.synced(t.entries(), ["o_orderkey"], "o_custkey", some(t).withColumnRenamed("c_custkey", "o_custkey"))


@query(f"SELECT o_orderkey, o_orderstatus, is_published FROM {ENTRIES} WHERE NOT is_published UNION ALL SELECT o_orderkey, o_orderstatus, true FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0")
def n12_site_published(t: Tables) -> DataFrame:
    return publishing.site({"items": t.items(), "entries": t.entries()}, SITE)["entries"].select("o_orderkey", "o_orderstatus", "is_published")


@query(f"SELECT c_custkey, segment AS c_mktsegment, is_published FROM {ITEMS} WHERE is_published UNION ALL SELECT c_custkey, segment, false FROM {ITEMS} WHERE is_published UNION ALL SELECT c_custkey, c_mktsegment, false FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 11 = 0")
def n11_site_reverted(t: Tables) -> DataFrame:
    preserve = {"items": ~F.col("is_publishable")}
    return publishing.site({"items": t.items(), "entries": t.entries()}, SITE, publish=False, preserve=preserve)["items"].select("c_custkey", "c_mktsegment", "is_published")


@query(f"""WITH RECURSIVE tree AS {TREE}, placed AS (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY name, id) - 1 AS "index" FROM tree),
walk AS (SELECT id, 0 AS depth, "index", lpad("index"::VARCHAR, 19, '0') AS path FROM placed WHERE parent IS NULL UNION ALL
SELECT p.id, w.depth + 1, p."index", concat(w.path, '/', lpad(p."index"::VARCHAR, 19, '0')) FROM walk w JOIN placed p ON p.parent = w.id WHERE w.id <> 'r1' AND w.id <> 'n3') SELECT * FROM walk""")
def h05_flattened(t: Tables) -> DataFrame:
    folders = t.folders()
    return hierarchy.flattened(folders, "id", "parent", "name", folders.where("id in ('r1', 'n3')").select("id"))


@query("SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def p02_projection(t: Tables) -> DataFrame:
    nested = relations.nested(t.collections(), "nations")
    kept = catalogue.projected(nested, "Nations", {"nations": ["N_NATIONKEY", " n_regionkey"], "nations.N_RegionKey": ["r_name"]})
    assert kept.schema["n_regionkey"].dataType.names == ["r_name"]
    return kept.select("n_nationkey", F.col("n_regionkey.r_name").alias("region"))


@query("SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 3 OFFSET 10")
def o03_typed_sort(t: Tables) -> DataFrame:
    rows = t.part.withColumn("size", F.concat(F.col("p_size").cast("string"), F.lit(" mm")))
    return sorting.api_page(sorting.by_type(rows, "size", "number", descending=True, tie="p_partkey"), "3", "5x", "3").select("p_partkey")


@query("SELECT count(*) AS total, count(*) > 120 AS has_more FROM customer")
def o12_has_more(t: Tables) -> DataFrame:
    return sorting.has_more(t.customer, 20, 1000)


@query("SELECT o_orderkey, o_orderstatus = 'F' AS of_status FROM orders")
def p12_status_ignored(t: Tables) -> DataFrame:
    every, some = (catalogue.with_status(t.orders, "o_orderstatus", s, ["F", "O", "P"]) for s in ("X", "F"))
    return every.join(some.select("o_orderkey", F.lit(True).alias("of_status")), "o_orderkey", "left").select("o_orderkey", F.coalesce("of_status", F.lit(False)).alias("of_status"))


@query("SELECT lower(n_name) AS slug, CAST(coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 END, n_nationkey) AS INTEGER) AS id FROM nation UNION ALL SELECT 'nowhere', NULL")
def j10_slug_lookup(t: Tables) -> DataFrame:
    items = t.nation.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"))
    over = items.where("id % 2 = 0").select((F.col("id") + 100).alias("id"), F.lit("de").alias("locale"), "slug")
    wanted = items.select("slug").union(t.region.where("r_regionkey = 0").select(F.lit("nowhere"))).withColumn("locale", F.lit("de"))
    return catalogue.by_slug(wanted, items, over).select("slug", "id")


@query("SELECT o_orderkey, concat('order ', o_orderkey) AS rich, strftime(o_orderdate + INTERVAL 9 HOUR, '%b %-d, %Y, %H:%M') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE '' END AS word FROM orders")
def s28_displayed(t: Tables) -> DataFrame:
    doc = F.format_string('{"type":"doc","content":[{"type":"text","text":"order"},{"type":"text","text":"%d"}]}', "o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    word = F.when(F.col("o_orderkey") % 2 == 0, "even")
    return t.orders.select("o_orderkey", text.displayed(doc, "rich_text").alias("rich"), text.displayed(date, "date", "Asia/Tokyo").alias("day"), text.displayed(word, "text").alias("word"))
