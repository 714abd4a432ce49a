"""Further queries: projections, scalars, usage, logs and snapshots of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collonade.functions import casts, text
from collonade.operators import eav, hierarchy, items, publishing, snapshots, sorting, usage, versions
from collonade.operators.predicates import Condition, where
from collonade.plans.adapter import Tables
from collonade.plans.queries import STATUS, TREE, query


@query(f"SELECT d.c_custkey, d.c_custkey % 11 <> 0 AS is_publishable, s.status <> 'new' AS is_published, s.status = 'updated' AS is_modified FROM customer d JOIN ({STATUS}) s ON s.c_custkey = d.c_custkey")
def p06_status(t: Tables) -> DataFrame:
    fields = ["c_name", "c_mktsegment", "balance"]
    d = snapshots.with_hash(t.draft(), fields)
    p = snapshots.with_hash(t.published(), fields, "old").select("c_custkey", "old")
    rows = d.join(p, "c_custkey", "left")
    return rows.select("c_custkey", "is_publishable", F.col("old").isNotNull().alias("is_published"), F.coalesce(F.col("old") != F.col("content_hash"), F.lit(False)).alias("is_modified"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (1, 2, 3, 50, 51) AND c_name ILIKE '%5%'")
def p11_ids_and_search(t: Tables) -> DataFrame:
    return eav.searched(eav.with_ids(t.customer, "c_custkey", [1, 2, 3, 50, 51]), ["c_name"], "5").select("c_custkey")


@query("SELECT p_partkey, replace(p_name, '#', '/') AS name FROM part")
def p04_as_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.replace(casts.as_text(F.col("p_name"), "text"), F.lit("#"), F.lit("/")).alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS day FROM orders")
def p04_date_as_text(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", casts.as_text(F.col("o_orderdate").cast("timestamp"), "date").alias("day"))


@query("SELECT * EXCLUDE (s_acctbal) FROM supplier")
def sk01_dump_columns(t: Tables) -> DataFrame:
    return eav.without_volatile(t.supplier, ["s_acctbal", "created_at"])


@query("SELECT n_nationkey, CAST(CASE WHEN n_regionkey = 2 THEN n_regionkey + 1 ELSE n_regionkey END AS INTEGER) AS n_regionkey FROM nation")
def sk07_increment(t: Tables) -> DataFrame:
    return items.incremented(t.nation, "n_regionkey", F.col("n_regionkey") == 2).select("n_nationkey", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT concat('<url><loc>', replace(url, '&', '&amp;'), '</loc></url>') AS entry FROM pages")
def sk08_sitemap(t: Tables) -> DataFrame:
    from collonade.sources.files import sitemap_entries

    return sitemap_entries(t.pages, "url")


@query("SELECT n_name AS value, concat('{{id-', row_number() OVER (ORDER BY n_name), '}}') AS placeholder FROM nation")
def sk09_placeholders(t: Tables) -> DataFrame:
    return usage.placeholders(t.nation, ["n_name"])


@query("SELECT c_custkey, upper(c_mktsegment) IN ('BUILDING') AS flag FROM customer")
def s22_truthy(t: Tables) -> DataFrame:
    word = F.when(F.col("c_mktsegment") == "BUILDING", "Yes").otherwise("off")
    return t.customer.select("c_custkey", casts.truthy(word).alias("flag"))


@query("SELECT l_orderkey AS o_orderkey, cast(count(DISTINCT l_partkey) AS INTEGER) AS n FROM lineitem GROUP BY 1")
def s23_parse_list(t: Tables) -> DataFrame:
    return t.order_parts().select("o_orderkey", F.size(casts.parse_list(F.to_json("parts"))).alias("n"))


@query("SELECT l_orderkey AS o_orderkey, string_agg(cast(l_partkey AS VARCHAR), '|' ORDER BY l_partkey) AS ids FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def s24_tokens(t: Tables) -> DataFrame:
    rows = t.order_parts().select("o_orderkey", F.array_join(F.col("parts").cast("array<string>"), " ; ").alias("v"))
    return rows.select("o_orderkey", F.array_join(casts.parse_tokens(F.col("v")), "|").alias("ids"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', round(n / 1024.0, 2)) ELSE printf('%.2f MB', round(n / 1048576.0, 2)) END AS size FROM (SELECT doc_id, n_chars * 16 AS n FROM documents)")
def s27_file_size(t: Tables) -> DataFrame:
    return t.documents.withColumn("n_chars", F.col("n_chars") * 16).select("doc_id", text.file_size(F.col("n_chars")).alias("size"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) IN ('de', 'fr') THEN regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) END AS locale FROM pages")
def s32_locale(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return t.pages.select("page_id", text.locale_of(path, ["DE", "fr"]).alias("locale"))


# The key's two pads, as any HMAC has them.
INNER, OUTER = (bytes(b ^ pad for b in b"key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"SELECT n_nationkey, sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(n_name)))) AS signature FROM nation")
def s34_hmac(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.hmac_sha256(F.col("n_name"), "key").alias("signature"))


@query()
def s16_rich_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.rich_text(F.col("html")).alias("doc"))


@query()
def s18_rich_text_plain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.rich_text_plain(text.rich_text(F.col("html"))).alias("plain"))


@query("""WITH u AS (SELECT 'lines' AS entity, l_partkey AS p, count(*) AS uses FROM lineitem GROUP BY 2 UNION ALL SELECT 'orders', l_partkey, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2)
SELECT cast(p AS VARCHAR) AS p_partkey, entity, uses FROM u UNION ALL SELECT cast(p AS VARCHAR), 'total', cast(sum(uses) AS BIGINT) FROM u GROUP BY 1""")
def h11_usage(t: Tables) -> DataFrame:
    trees = t.order_parts().select(F.to_json(F.struct(F.col("parts").cast("array<string>").alias("layers"))).alias("tree"))
    orders = F.filter(usage.strings_of(F.col("tree")), lambda s: s != "layers")
    return usage.usage({"lines": (t.lineitem, F.array(F.col("l_partkey").cast("string"))), "orders": (trees, orders)}, t.part, "p_partkey")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01' ORDER BY ts DESC, event_id LIMIT 10 OFFSET 5")
def v07_delivery_page(t: Tables) -> DataFrame:
    rows = t.events.where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")))
    return sorting.sliced(rows.orderBy(F.desc("ts"), "event_id"), 5, 10).select("event_id")


@query("SELECT user_id, max(event_id) FILTER (event_id % 10 = 0) AS last_snapshot FROM events GROUP BY 1 HAVING max(event_id) FILTER (event_id % 10 = 0) IS NOT NULL")
def v02_latest_snapshot(t: Tables) -> DataFrame:
    return sorting.latest(t.events.where("event_id % 10 = 0"), "user_id", "event_id", ["event_id"], "event_id").select("user_id", F.col("event_id").alias("last_snapshot"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'read' ELSE 'new' END AS status FROM events")
def v04_status_filter(t: Tables) -> DataFrame:
    log = t.events.withColumn("status", F.lit("new"))
    return items.marked(log, "event_id", t.events.where("event_id % 3 = 0"), "status", "read").select("event_id", "status")


@query("SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 0 AND o_orderstatus <> 'F'")
def n10_child_orphans(t: Tables) -> DataFrame:
    kept = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").where("o_orderkey % 4 = 0")
    return publishing.child_orphans(kept, "o_orderkey", t.orders.where("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey", "l_linenumber")


@query("SELECT p_partkey, 'updated' AS status FROM part WHERE p_size > 45 AND p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 9 = 0")
def n14_by_hash(t: Tables) -> DataFrame:
    fields = ["p_name", "p_size"]
    draft = snapshots.with_hash(t.part, fields)
    old = snapshots.with_hash(t.part.where("p_partkey % 9 <> 0").withColumn("p_size", F.least("p_size", F.lit(45))), fields)
    return snapshots.compared(draft, old, "p_partkey", ["content_hash"]).where("status <> 'same'")


@query("""WITH s AS (SELECT n_nationkey, n_name, CASE n_nationkey WHEN 1 THEN 'a-7' WHEN 2 THEN 'a' WHEN 3 THEN 'a-copy' WHEN 4 THEN 'a-copy-2' ELSE lower(n_name) END AS slug FROM nation),
r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM s WHERE n_nationkey IN (1, 2, 5, 6)) SELECT ((SELECT max(n_nationkey) FROM nation) + k)::INTEGER AS n_nationkey, concat(n_name, ' (Copy)') AS n_name,
CASE n_nationkey WHEN 1 THEN 'a-copy-1' WHEN 2 THEN 'a-copy-3' ELSE concat(regexp_replace(slug, '-[0-9]+$', ''), '-copy') END AS slug FROM r""")
def n17_duplicate(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    rows = t.nation.select("n_nationkey", "n_name", F.when(k == 1, "a-7").when(k == 2, "a").when(k == 3, "a-copy").when(k == 4, "a-copy-2").otherwise(F.lower("n_name")).alias("slug"))
    return items.duplicated(rows, rows.where("n_nationkey IN (1, 2, 5, 6)"), "n_nationkey", "n_name", "slug").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def o19_retention(t: Tables) -> DataFrame:
    return versions.newest(t.events, "user_id", "ts", "event_id").select("event_id")


BELOW = f"WITH RECURSIVE tree AS {TREE}, walk AS (SELECT id FROM tree WHERE parent = 'r1' OR id = 'r1' UNION SELECT t.id FROM walk w JOIN tree t ON t.parent = w.id)"


@query(f"{BELOW} SELECT id, name FROM tree WHERE id IN (SELECT id FROM walk)")
def h05_subtree(t: Tables) -> DataFrame:
    ids = t.region.where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return hierarchy.subtree(t.folders(), "id", "parent", ids).select("id", "name")


@query(f"{BELOW} SELECT id, name FROM tree WHERE id NOT IN (SELECT id FROM walk)")
def n16_delete_subtree(t: Tables) -> DataFrame:
    ids = t.region.where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return hierarchy.without_subtree(t.folders(), "id", "parent", ids).select("id", "name")


@query(f"WITH RECURSIVE tree AS {TREE}, walk AS (SELECT id, parent FROM tree WHERE id IN (SELECT concat('s', s_suppkey) FROM supplier WHERE s_acctbal < 0) UNION SELECT t.id, t.parent FROM walk w JOIN tree t ON w.parent = t.id) SELECT DISTINCT id FROM walk")
def h13_ancestors(t: Tables) -> DataFrame:
    ids = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return hierarchy.above(t.folders(), "id", "parent", ids).select("id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 17")
def f01_is_whole_number(t: Tables) -> DataFrame:
    return where(t.lineitem, [[Condition("l_quantity", "is", "17")]]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IN (17, 18)")
def f20_one_of_whole_numbers(t: Tables) -> DataFrame:
    return where(t.lineitem, [[Condition("l_quantity", "is_one_of", '["17", "18"]')]]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 210 MINUTE, '%Y-%m-%d %H:%M') AS utc FROM orders")
def s03_offset(t: Tables) -> DataFrame:
    said = F.concat(F.date_format("o_orderdate", "MMM dd yyyy HH:mm:ss"), F.lit(" GMT+0330 (zone)"))
    return t.orders.select("o_orderkey", F.date_format(casts.parse_date(F.concat(F.lit("Thu "), said)), "yyyy-MM-dd HH:mm").alias("utc"))
