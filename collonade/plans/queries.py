"""Queries over the adapter's collections, each with the same in SQL.

The SQL runs on the tables as they are; columns have the same names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collonade.functions import casts, text
from collonade.operators import eav, hierarchy, inference, items, publishing, relations, snapshots, sorting, versions
from collonade.operators.predicates import Condition, active, where
from collonade.plans.adapter import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register f(tables) under its name, with its SQL where there is one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def conditioned(name: str, table: str, key: str, groups, test: str, dialect: str = "public", make=None) -> None:
    """Register a query for the keys of rows where groups of conditions hold; test is the same in SQL."""

    def f(t: Tables) -> DataFrame:
        df = make(t) if make else getattr(t, table)
        return where(df, groups, dialect).select(key)

    f.__name__ = name
    query(f"SELECT {key} FROM {table} WHERE {test}")(f)


# The flagship: text and number conditions, an order, a page, and a reference.


@query("""
SELECT o.o_orderkey, round(o.o_totalprice, 2) AS total, c.c_name AS customer FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE (lower(o_orderstatus) = 'f' OR contains(lower(o_orderpriority), 'urgent')) AND o_totalprice > 1000
ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10 OFFSET 10""")
def minimum_slice(t: Tables) -> DataFrame:
    groups = [[Condition("o_orderstatus", "is", "F"), Condition("o_orderpriority", "contains", "URGENT")], [Condition("o_totalprice", "gt", "1000", kind="number")]]
    found = where(t.orders, groups, "visibility")
    page = sorting.page(found.orderBy(F.desc("o_totalprice"), "o_orderkey"), 2, 10)
    return relations.dotted(page, "o_custkey", t.customer, "c_custkey", ["c_name"]).select("o_orderkey", F.round("o_totalprice", 2).alias("total"), F.col("`o_custkey.c_name`").alias("customer"))


# F1 to F28 in the public dialect, over text, numbers, dates and lists.

C = Condition
blank = lambda t: t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
PRIORITY = "nullif(o_orderpriority, '5-LOW')"
ROWS = "orders"
for _name, _condition, _test in [
    ("f01_is", C("o_orderpriority", "is", "1-urgent"), f"coalesce(lower({PRIORITY}) = '1-urgent', false)"),
    ("f02_is_not", C("o_orderpriority", "is_not", "1-urgent"), f"NOT coalesce(lower({PRIORITY}) = '1-urgent', false)"),
    ("f03_contains", C("o_orderpriority", "contains", "SPEC"), f"contains(lower({PRIORITY}), 'spec')"),
    ("f04_does_not_contain", C("o_orderpriority", "does_not_contain", "spec"), f"NOT coalesce(contains(lower({PRIORITY}), 'spec'), false)"),
    ("f05_starts_with", C("o_orderpriority", "starts_with", "2-h"), f"starts_with(lower({PRIORITY}), '2-h')"),
    ("f06_ends_with", C("o_orderpriority", "ends_with", "MEDIUM"), f"ends_with(lower({PRIORITY}), 'medium')"),
    ("f07_is_empty", C("o_orderpriority", "is_empty"), f"coalesce({PRIORITY}, '') = ''"),
    ("f08_is_not_present", C("o_orderpriority", "is_not_present"), f"coalesce({PRIORITY}, '') = ''"),
    ("f09_is_not_empty", C("o_orderpriority", "is_not_empty"), f"coalesce({PRIORITY}, '') <> ''"),
    ("f10_is_present", C("o_orderpriority", "is_present"), f"coalesce({PRIORITY}, '') <> ''"),
    ("f11_exists", C("o_orderpriority", "exists"), f"coalesce({PRIORITY}, '') <> ''"),
    ("f12_does_not_exist", C("o_orderpriority", "does_not_exist"), f"coalesce({PRIORITY}, '') = ''"),
    ("f13_gt", C("o_totalprice", "gt", "150000.5abc"), "o_totalprice > 150000.5"),
    ("f14_gte", C("o_totalprice", "gte", "150000"), "o_totalprice >= 150000"),
    ("f15_lt", C("o_totalprice", "lt", "1e5"), "o_totalprice < 100000"),
    ("f16_lte", C("o_custkey", "lte", "77"), "o_custkey <= 77"),
    ("f17_is_before", C("o_orderdate", "is_before", "1995-03-15"), "o_orderdate < TIMESTAMP '1995-03-15'"),
    ("f18_is_after", C("o_orderdate", "is_after", "1997-01-01"), "o_orderdate > TIMESTAMP '1997-01-01'"),
    ("f19_is_between", C("o_orderdate", "is_between", "1995-01-01", "1995-06-30"), "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'"),
    ("f19_one_sided", C("o_orderdate", "is_between", "", "1994-06-30"), "o_orderdate <= TIMESTAMP '1994-06-30'"),
    ("f20_is_one_of", C("o_orderstatus", "is_one_of", '["F","P"]'), "o_orderstatus IN ('F', 'P')"),
    ("f21_is_not_one_of", C("o_orderpriority", "is_not_one_of", '["1-URGENT","2-HIGH"]'), f"NOT coalesce({PRIORITY} IN ('1-URGENT', '2-HIGH'), false)"),
    ("f28_unknown", C("o_orderpriority", "sounds_like", "high"), f"contains(lower({PRIORITY}), 'high')"),
]:
    conditioned(_name, ROWS, "o_orderkey", [[_condition]], _test, make=blank)

LISTS = "(SELECT l_orderkey AS o_orderkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem GROUP BY 1)"
for _name, _condition, _test in [
    ("f20_list_is_one_of", C("parts", "is_one_of", '["5","17","33"]'), "list_has_any(parts, [5, 17, 33])"),
    ("f22_has_items", C("parts", "has_items"), "len(parts) > 0"),
    ("f23_has_no_items", C("parts", "has_no_items"), "len(parts) = 0"),
    ("f24_contains_all_of", C("parts", "contains_all_of", '["5"]'), "list_has_all(parts, [5])"),
    ("f25_contains_exactly", C("parts", "contains_exactly", '["7"]'), "list_has_all(parts, [7]) AND len(parts) = 1"),
    ("f26_item_count", C("parts", "item_count", "4", kind="multi_reference", compare="gte"), "len(parts) >= 4"),
]:
    conditioned(_name, LISTS, "o_orderkey", [[_condition]], _test, make=Tables.order_parts)

for _name, _groups, _dialect, _test in [
    ("d2_is_case", [[C("o_orderstatus", "is", "f")]], "visibility", "o_orderstatus = 'f'"),
    ("d2_number_is", [[C("o_custkey", "is", "7.0", kind="number")]], "visibility", "o_custkey = 7"),
    ("d2_contains", [[C("o_orderpriority", "contains", "urg")]], "visibility", "contains(lower(o_orderpriority), 'urg')"),
    ("d2_groups", [[C("o_orderstatus", "is", "F"), C("o_orderstatus", "is", "P")], [], [C("o_totalprice", "lt", "90000")]], "visibility", "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice < 90000"),
    ("d2_half_range", [[C("o_orderdate", "is_between", "1995-01-01"), C("o_orderstatus", "is", "F")]], "visibility", "o_orderdate BETWEEN '1995-01-01' AND NULL OR o_orderstatus = 'F'"),
    ("d3_is", [[C("o_orderstatus", "is", "O"), C("o_orderpriority", "starts_with", "3")]], "builder", "o_orderstatus = 'O' AND starts_with(o_orderpriority, '3')"),
    ("d3_is_not", [[C("o_orderstatus", "is_not", "o")]], "builder", "lower(o_orderstatus) <> 'o'"),
    ("d4_exact", [[C("o_orderstatus", "", "P"), C("unheard", "", "x")]], "exact", "o_orderstatus = 'P'"),
    ("b01_and_in_group", [[C("o_orderstatus", "is", "f"), C("o_totalprice", "gt", "200000")]], "public", "o_orderstatus = 'F' AND o_totalprice > 200000"),
    ("b02_or_across_groups", [[C("o_orderstatus", "is", "p")], [C("o_custkey", "lt", "20"), C("o_orderstatus", "is", "o")]], "public", "o_orderstatus = 'P' OR (o_custkey < 20 AND o_orderstatus = 'O')"),
    ("b05_inactive", [active([C("o_orderstatus", "is", ""), C("o_orderstatus", "is", "f")])], "public", "o_orderstatus = 'F'"),
    ("b07_no_groups", [[]], "public", "true"),
]:
    conditioned(_name, ROWS, "o_orderkey", _groups, _test, _dialect)


# Scans and projections.


@query("""WITH k AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 13 = 0 AND c_mktsegment ILIKE '%u%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))
SELECT c_custkey, (SELECT count(*) FROM k)::BIGINT AS total FROM k ORDER BY c_mktsegment, c_custkey LIMIT 10 OFFSET 2""")
def sc01_items(t: Tables) -> DataFrame:
    """Deleted drafts with a text in a field and an id of a list: one scan, a page of it and the number of all."""
    found = items.scanned(t.items(), "c_custkey", deleted=True, search=" U ", fields=["c_mktsegment"], ids=t.orders.select(F.col("o_custkey").alias("c_custkey")))
    return items.paged(found, "c_mktsegment", "deleted_at", "c_custkey", 10, 2).select("c_custkey", "total")


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def sc04_point(t: Tables) -> DataFrame:
    return items.by_id(t.nation, "n_nationkey", 7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 13)")
def sc05_multi_get(t: Tables) -> DataFrame:
    return eav.with_ids(t.customer, "c_custkey", [3, 5, 8, 13]).select("c_custkey", "c_name")


@query("""SELECT r.r_name AS collection, count(n.n_nationkey) AS items, bool_or(coalesce(n.n_nationkey % 2 = 0, false)) AS has_published
FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY 1""")
def sc11_collections(t: Tables) -> DataFrame:
    n = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("k"), F.bool_or(F.col("n_nationkey") % 2 == 0).alias("p"))
    return t.region.join(F.broadcast(n), F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("collection"), F.coalesce("k", F.lit(0)).cast("bigint").alias("items"), F.coalesce("p", F.lit(False)).alias("has_published"))


CELL_KINDS = {"c_name": "text", "c_nationkey": "number", "c_mktsegment": "text"}


@query("""SELECT c_custkey AS item, 'c_name' AS field, c_name AS value FROM customer UNION ALL
SELECT c_custkey, 'c_nationkey', cast(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer""")
def sc07_cells(t: Tables) -> DataFrame:
    return eav.to_cells(t.customer, "c_custkey", CELL_KINDS)


@query("SELECT c_custkey AS item, c_name, cast(c_nationkey AS DOUBLE) AS c_nationkey, c_mktsegment FROM customer")
def a10_rows_from_cells(t: Tables) -> DataFrame:
    return eav.to_rows(eav.to_cells(t.customer, "c_custkey", CELL_KINDS), CELL_KINDS)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a_e%'")
def p14_ilike(t: Tables) -> DataFrame:
    return items.like(t.part, "p_name", "a_e").select("p_partkey", "p_name")


@query("SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 0) IS NULL OR n_regionkey IN (2, 3)")
def p13_folders(t: Tables) -> DataFrame:
    rows = t.nation.withColumn("folder", F.nullif("n_regionkey", F.lit(0)))
    return eav.in_folder(rows, "folder", [None, 2, 3]).select("n_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0")
def p07_snapshot(t: Tables) -> DataFrame:
    rows = t.draft().withColumns({"is_published": F.col("c_custkey") % 10 != 0, "deleted_at": F.when(F.col("c_custkey") % 13 == 0, F.lit("x"))})
    return eav.undeleted(eav.snapshot(rows, True)).select("c_custkey")


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def p03_typed(t: Tables) -> DataFrame:
    return t.events.select("event_id", casts.typed(F.get_json_object("props", "$.k"), "number").alias("k"))


# Sorts and pages.


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 21")
def o09_offset_limit(t: Tables) -> DataFrame:
    return sorting.sliced(t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey"), 21, 7).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size, p_partkey LIMIT 50 OFFSET 100")
def o10_page(t: Tables) -> DataFrame:
    return sorting.page(t.part.orderBy("p_size", "p_partkey"), 3, 50).select("p_partkey", "p_name")


@query("SELECT count(*) AS total, cast(greatest(1, ceil(count(*) / 12.0)) AS BIGINT) AS total_pages FROM nation")
def o10_page_counts(t: Tables) -> DataFrame:
    return sorting.page_counts(t.nation, 12)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100")
def o12_load_more(t: Tables) -> DataFrame:
    return sorting.load_more(t.customer.orderBy("c_custkey"), -3, 500).select("c_custkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def o14_top_per_group(t: Tables) -> DataFrame:
    return sorting.top_per_group(t.orders, "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT n_nationkey, n_name, CAST(list_position([9, 4, 1, 20], n_nationkey) - 1 AS BIGINT) AS position FROM nation WHERE n_nationkey IN (9, 4, 1, 20)")
def o16_given_order(t: Tables) -> DataFrame:
    return sorting.in_given_order(t.nation, "n_nationkey", [9, 4, 1, 20]).select("n_nationkey", "n_name", "position")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n = 1")
def o18_latest(t: Tables) -> DataFrame:
    return sorting.latest(t.conversations, "conv_id", "turn", ["turn", "role"], "role")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN v = '' THEN 0 WHEN n IS NOT NULL THEN 2 ELSE 3 END, n, v, p_partkey) AS place FROM (SELECT *, try_cast(v AS DOUBLE) AS n FROM (SELECT p_partkey, p_brand, CASE WHEN p_size < 10 THEN '' WHEN p_size < 30 THEN p_size::VARCHAR ELSE p_type END AS v FROM part))""")
def o02_mixed_sort(t: Tables) -> DataFrame:
    value = F.when(F.col("p_size") < 10, "").when(F.col("p_size") < 30, F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    rows = t.part.withColumn("v", value)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(*sorting.mixed_keys(F.col("v")), "p_partkey"))
    return rows.select("p_partkey", place.cast("bigint").alias("place"))


@query("SELECT n_nationkey, n_name FROM nation")
def o06_random(t: Tables) -> DataFrame:
    return sorting.shuffled(t.nation, 11).select("n_nationkey", "n_name")


# Relations.


@query("""SELECT o.o_orderkey, c.c_name AS customer, n.n_name AS nation, r.r_name AS region FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def j04_nested_reference(t: Tables) -> DataFrame:
    rows = relations.nested(t.collections(), "orders")
    c = "o_custkey"
    return rows.select("o_orderkey", F.col(f"{c}.c_name").alias("customer"), F.col(f"{c}.c_nationkey.n_name").alias("nation"), F.col(f"{c}.c_nationkey.n_regionkey.r_name").alias("region"))


@query("""SELECT l_orderkey AS o_orderkey, string_agg(p_name, '|' ORDER BY l_partkey) AS names FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def j05_multi_reference(t: Tables) -> DataFrame:
    rows = relations.many(t.order_parts(), "o_orderkey", "parts", t.part, "p_partkey", ["p_name"], "found")
    return rows.where("found IS NOT NULL").select("o_orderkey", F.array_join(F.transform("found", lambda x: x["p_name"]), "|").alias("names"))


@query("""SELECT c_custkey, n_name AS "nation", n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j06_dotted_path(t: Tables) -> DataFrame:
    rows = relations.dotted(t.customer, "c_nationkey", t.nation, "n_nationkey", ["n_name", "n_regionkey"])
    return rows.select("c_custkey", F.col("`c_nationkey.n_name`").alias("nation"), F.col("`c_nationkey.n_regionkey`").alias("region"))


@query("SELECT c_custkey, c_nationkey AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def j07_inverse_single(t: Tables) -> DataFrame:
    return items.referring(t.customer, "c_nationkey", t.nation.where("n_regionkey = 1"), "n_nationkey").select("c_custkey", F.col("parent").cast("int").alias("parent"))


@query("SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey AS parent FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 11")
def j07_inverse_list(t: Tables) -> DataFrame:
    return items.referring(t.order_parts(), "parts", t.part.where("p_size = 11"), "p_partkey").select("o_orderkey", "parent")


@query("""SELECT n_nationkey, count(s_suppkey) AS n, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def j08_children(t: Tables) -> DataFrame:
    rows = relations.children(t.nation, "n_nationkey", t.supplier, "s_nationkey", ["s_suppkey"], ["s_name"], "found")
    return rows.select("n_nationkey", F.size("found").cast("bigint").alias("n"), F.array_join(F.transform("found", lambda x: x["s_name"]), ",").alias("names"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN concat('T ', p_name) ELSE p_name END AS p_name FROM part""")
def j09_overlay(t: Tables) -> DataFrame:
    tr = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("T "), "p_name")).otherwise(F.lit("  ")).alias("value"))
    return relations.overlaid(t.part, ["p_partkey"], tr, "p_name", "value").select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j12_semi(t: Tables) -> DataFrame:
    return relations.present(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j13_anti(t: Tables) -> DataFrame:
    return relations.absent(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("SELECT n_regionkey, string_agg(cast(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS ids FROM nation GROUP BY 1")
def j14_group_ids(t: Tables) -> DataFrame:
    return items.grouped(t.nation, "n_regionkey", "n_nationkey").select("n_regionkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# Aggregates.


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def a01_count(t: Tables) -> DataFrame:
    return where(t.orders, [[C("o_orderstatus", "is", "F"), C("o_totalprice", "gt", "100000")]]).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS o_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a02_count_per_group(t: Tables) -> DataFrame:
    return items.counted(t.orders, "o_custkey", t.customer.select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT event_type AS form_id, count(*) AS submission_count, count(*) FILTER (value > 50) AS new_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_submission FROM events GROUP BY 1")
def a03_form_summary(t: Tables) -> DataFrame:
    return versions.form_summary(t.events, "event_type", F.col("value") > 50, "ts").withColumn("latest_submission", F.date_format("latest_submission", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT max(coalesce(try_cast(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT), 0)) AS top FROM customer")
def a04_max_parsed(t: Tables) -> DataFrame:
    return t.customer.agg(F.coalesce(F.max(casts.parse_int(F.regexp_extract("c_name", r"(\d+)$", 1))), F.lit(0)).alias("top"))


@query("SELECT DISTINCT user_id FROM events")
def a05_distinct(t: Tables) -> DataFrame:
    return items.in_any(t.events.select("user_id"))


STATUS = """SELECT coalesce(d.k, p.k) AS c_custkey, CASE WHEN p.k IS NULL THEN 'new' WHEN d.k IS NULL THEN 'deleted' WHEN d.seg = p.seg THEN 'same' ELSE 'updated' END AS status FROM
(SELECT c_custkey AS k, c_mktsegment AS seg FROM customer) d FULL JOIN
(SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN concat(c_mktsegment, '*') ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT -s_suppkey - 1, 'NONE' FROM supplier) p ON d.k = p.k"""


@query(f"SELECT status, count(*) AS n FROM ({STATUS}) GROUP BY 1")
def a06_change_counts(t: Tables) -> DataFrame:
    return snapshots.change_counts(t.draft(), t.published(), "c_custkey", ["c_name", "c_mktsegment", "balance"])


@query("""WITH c AS (SELECT 'items' AS kind, count(*) FILTER (c_custkey % 13 <> 0 AND (c_custkey % 10 = 0 OR c_custkey % 7 = 0)) AS changed, count(*) FILTER (c_custkey % 13 = 0 AND c_custkey % 10 <> 0) AS deleted FROM customer UNION ALL
SELECT 'entries', count(*) FILTER (NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'old')), 0 FROM orders UNION ALL SELECT 'fields', count(*) FILTER (n_nationkey % 4 = 0 OR n_nationkey % 6 IN (1, 3)), 0 FROM nation)
SELECT kind, changed::BIGINT AS changed, deleted::BIGINT AS deleted, (changed + deleted)::BIGINT AS total FROM c UNION ALL SELECT 'total', sum(changed)::BIGINT, sum(deleted)::BIGINT, sum(changed + deleted)::BIGINT FROM c""")
def a07_publish_preview(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    kinds = {
        "items": (t.items(), "c_custkey", ["c_name", "c_mktsegment", "balance"]),
        "entries": (t.entries().withColumn("deleted_at", none), "o_orderkey", ["o_orderstatus"]),
        "fields": (t.fields().withColumn("deleted_at", none), "id", ["name", "key", "type", "order", "reference_collection_id", "is_computed", "data"]),
    }
    return publishing.preview(kinds)


@query("SELECT o_orderkey, string_agg(cast(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def a11_collect_list(t: Tables) -> DataFrame:
    return t.order_parts().select("o_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("SELECT n_nationkey % 2 AS g, max(n_nationkey) + 1 AS next_id FROM nation GROUP BY 1")
def a14_next_id(t: Tables) -> DataFrame:
    rows = t.nation.select((F.col("n_nationkey") % 2).alias("g"), F.concat(F.col("n_nationkey").cast("string"), F.lit(" x")).alias("number"))
    return items.next_number(rows, "number", "g").select(F.col("g").cast("int").alias("g"), F.col("next").cast("int").alias("next_id"))


@query("SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS uses FROM lineitem GROUP BY 1")
def a15_usage(t: Tables) -> DataFrame:
    return t.order_parts().select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("uses"))


# Windows and sets.


@query("SELECT event_id, user_id, event_id % 7 = 0 AS odd, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) % 10 = 0 AS is_snapshot FROM events")
def w03_every_nth(t: Tables) -> DataFrame:
    return versions.with_snapshots(t.events, "user_id", "ts", "event_id").select("event_id", "user_id", (F.col("event_id") % 7 == 0).alias("odd"), "is_snapshot")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def w02_newest(t: Tables) -> DataFrame:
    return versions.newest(t.events, "user_id", "ts", "event_id", 5).select("event_id")


@query("SELECT n_name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name) AS id FROM nation")
def w04_sequential_ids(t: Tables) -> DataFrame:
    return snapshots.numbered(t.nation.select("n_name"), t.supplier.select(F.col("s_suppkey").alias("id")), "id", "n_name")


@query("""WITH s AS (SELECT concat('n', n_nationkey) AS id, n_regionkey AS parent, n_nationkey % 5 AS place, 'page' AS kind FROM nation UNION ALL SELECT concat('s', s_suppkey), s_suppkey % 5, s_suppkey % 3, 'folder' FROM supplier),
p AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY place, kind, id) - 1 AS want FROM s) SELECT kind, id, want AS place FROM p WHERE place <> want""")
def w06_resequence(t: Tables) -> DataFrame:
    """Pages and folders of one parent share one order; only those that move are written."""
    made = lambda df, key, letter, parent, place: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.col(parent).alias("parent") if isinstance(parent, str) else parent.alias("parent"), place.cast("bigint").alias("place"))
    n = made(t.nation, "n_nationkey", "n", F.col("n_regionkey").cast("bigint"), F.col("n_nationkey") % 5)
    return items.resequenced({"page": n, "folder": made(t.supplier, "s_suppkey", "s", F.col("s_suppkey") % 5, F.col("s_suppkey") % 3)}, "id", "parent", "place")


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u01_union(t: Tables) -> DataFrame:
    return items.in_any(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal < 0").select("c_custkey"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u02_intersect(t: Tables) -> DataFrame:
    return items.in_all(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal < 0").select("c_custkey"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u03_difference(t: Tables) -> DataFrame:
    return items.in_first(t.customer.select(F.col("c_custkey").alias("id")), t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT n_nationkey AS id, 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 'region', r_name FROM region")
def u05_tagged_union(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return items.tagged({"nation": n, "region": t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))})


# Snapshots.


@query(STATUS)
def n01_change_set(t: Tables) -> DataFrame:
    return snapshots.compared(t.draft(), t.published(), "c_custkey", ["c_name", "c_mktsegment", "balance"])


@query(f"SELECT s.c_custkey FROM ({STATUS}) s WHERE status IN ('new', 'updated')")
def n03_needs_publishing(t: Tables) -> DataFrame:
    fields = ["c_name", "c_mktsegment", "balance"]
    d, p = (snapshots.with_hash(x, fields).select("c_custkey", "content_hash") for x in (t.draft(), t.published()))
    both = d.join(p.withColumnRenamed("content_hash", "old_hash"), "c_custkey", "left")
    return both.where(~F.col("content_hash").eqNullSafe(F.col("old_hash"))).select("c_custkey")


@query("""SELECT s.c_custkey, CASE WHEN s.c_custkey >= 0 AND s.c_custkey % 11 = 0 AND s.status <> 'new' THEN 'deleted' ELSE s.status END AS status FROM (""" + STATUS + """) s
WHERE NOT (s.c_custkey >= 0 AND s.c_custkey % 11 = 0 AND s.status = 'new') AND (s.status <> 'same' OR (s.c_custkey >= 0 AND s.c_custkey % 11 = 0))""")
def n04_three_way(t: Tables) -> DataFrame:
    live = t.draft().where("is_publishable")
    return snapshots.compared(live, t.published(), "c_custkey", ["c_name", "c_mktsegment", "balance"]).where("status <> 'same'")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0")
def n07_publish(t: Tables) -> DataFrame:
    return snapshots.published_from(t.draft(), t.published(), "c_custkey", "is_publishable").select("c_custkey", "c_mktsegment")


@query("SELECT -s_suppkey - 1 AS c_custkey FROM supplier")
def n08_orphans(t: Tables) -> DataFrame:
    return snapshots.orphans(t.published(), t.draft(), "c_custkey").select("c_custkey")


@query("SELECT o_orderkey, coalesce(o_custkey % 5 = 0, false) AS deleted FROM orders")
def n15_cascade(t: Tables) -> DataFrame:
    gone = t.customer.where("c_custkey % 5 = 0")
    return snapshots.cascaded(gone, "c_custkey", t.orders, "o_custkey").select("o_orderkey", "deleted")


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey >= 10 THEN n_nationkey + 1 ELSE n_nationkey END AS INTEGER) AS position FROM nation")
def n26_shift(t: Tables) -> DataFrame:
    return snapshots.shifted(t.nation.withColumn("position", F.col("n_nationkey")), "position", 10).select("n_nationkey", "position")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT r_regionkey, r_name FROM region")
def sk04_upsert(t: Tables) -> DataFrame:
    new = t.region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return eav.upserted(t.nation.select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def sk06_patch(t: Tables) -> DataFrame:
    changes = t.region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return eav.patched(t.nation.select("n_nationkey", "n_name", "n_regionkey"), changes, ["n_nationkey"])


# Scalars.


@query("SELECT event_id, try_cast(regexp_extract(props, '\"k\": (\\d+)', 1) AS DOUBLE) AS number FROM events")
def s01_parse_float(t: Tables) -> DataFrame:
    return t.events.select("event_id", casts.parse_float(F.concat(F.lit("  "), F.regexp_extract("props", r'"k": (.*)', 1))).alias("number"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def s08_slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN b ELSE concat(b, '-', n) END AS slug FROM (SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS n FROM (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM part))""")
def s09_unique_slugs(t: Tables) -> DataFrame:
    return text.unique_slugs(t.part.select("p_partkey", text.slug(F.col("p_type")).alias("base")), "base", "p_partkey").select("p_partkey", "slug")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 0 HOUR, '%b %-d, %Y, %H:%M') AS shown FROM orders")
def s11_display_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.display_date(F.col("o_orderdate"), "UTC").alias("shown"))


@query("SELECT c_custkey, sha256(concat('[{\"field_id\":\"a\",\"value\":\"', c_name, '\"},{\"field_id\":\"b\",\"value\":\"', c_mktsegment, '\"}]')) AS hash FROM customer")
def s15_item_hash(t: Tables) -> DataFrame:
    pairs = F.array(F.struct(F.lit("b").alias("field"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("a").alias("field"), F.col("c_name").alias("value")))
    return t.customer.select("c_custkey", text.item_hash(pairs).alias("hash"))


@query("SELECT doc_id, regexp_matches(split_part(text, ' ', 1), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS is_email FROM documents")
def s19_email(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.is_email(F.split_part("text", F.lit(" "), F.lit(1))).alias("is_email"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN concat(left(text, 50), '...') ELSE text END AS shown FROM documents")
def s26_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncated(F.col("text")).alias("shown"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS safe FROM pages")
def s33_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.escape_xml(F.col("url")).alias("safe"))


@query("SELECT n_nationkey, concat('Hello ', n_name, ' of ', n_regionkey, '!') AS shown FROM nation")
def s29_interpolate(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.interpolated(F.lit("Hello {{n_name}} of {{n_regionkey}}!{{nothing}}"), {"n_name": F.col("n_name"), "n_regionkey": F.col("n_regionkey")}).alias("shown"))


@query("SELECT page_id, nullif(regexp_extract(url, '/en/([^/?#]+)', 1), '') AS slug FROM pages")
def s31_url_slug(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/en/"), F.nullif(F.regexp_extract("url", r"/en/([^/?#]+)", 1), F.lit("")))
    return t.pages.select("page_id", text.url_slug(path, "/en/{slug}").alias("slug"))


@query("SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_url FROM pages")
def s21_is_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.is_url(F.col("url")).alias("is_url"))


# Ingestion and inference.


@query("""WITH c AS (SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'flag', 'day', 'none']) AS "column", unnest([c_custkey::VARCHAR, c_name, c_acctbal::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'No' END, '2024-02-29', '']) AS v FROM customer)
SELECT "column", CASE WHEN count(nullif(trim(v), '')) = 0 THEN 'text' WHEN bool_and(lower(v) IN ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')) THEN 'boolean' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'number'
WHEN bool_and(TRY_CAST(v AS DATE) IS NOT NULL) THEN 'date' WHEN bool_and(starts_with(v, 'http')) THEN 'url' ELSE 'text' END AS kind FROM c GROUP BY 1""")
def i08_column_kinds(t: Tables) -> DataFrame:
    rows = t.customer.withColumns({"flag": F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("No"), "day": F.lit("2024-02-29"), "none": F.lit("")})
    return inference.column_kinds(rows, ["c_custkey", "c_name", "c_acctbal", "flag", "day", "none"])


@query("""WITH k AS (SELECT unnest(['nation', 'c_name']) AS "column", unnest([concat('n', c_nationkey), c_name]) AS id FROM customer), i AS (SELECT 'nations' AS target, concat('n', n_nationkey) AS id FROM nation UNION ALL SELECT 'regions', concat('r', r_regionkey) FROM region),
v AS (SELECT "column", target, count(i.id) AS hits, sum(count(*)) OVER (PARTITION BY "column") AS total FROM k LEFT JOIN i USING (id) GROUP BY 1, 2) SELECT "column", target, round(hits / total, 4)::DOUBLE AS coverage, false AS multiple FROM v WHERE target IS NOT NULL AND hits / total >= 0.7""")
def i09_references(t: Tables) -> DataFrame:
    rows = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("nation"), "c_name")
    ids = t.nation.select(F.lit("nations").alias("target"), F.concat(F.lit("n"), "n_nationkey").alias("id")).union(t.region.select(F.lit("regions"), F.concat(F.lit("r"), "r_regionkey")))
    return inference.references(rows, ["nation", "c_name"], ids)


@query("SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey + 1000 END AS c_nationkey, c_nationkey >= 20 AS unresolved FROM customer")
def i10_remap(t: Tables) -> DataFrame:
    ids = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("old_id"), (F.col("n_nationkey") + 1000).alias("new_id"))
    return inference.remapped(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", ids)


# Hierarchy and search.

TREE = "(SELECT concat('r', r_regionkey) AS id, NULL AS parent, lower(r_name) AS name FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), lower(n_name) FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), lower(s_name) FROM supplier)"


@query(f"""WITH RECURSIVE tree AS {TREE}, walk AS (SELECT id, name AS path, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, concat(w.path, '/', t.name), w.depth + 1 FROM walk w JOIN tree t ON t.parent = w.id) SELECT id, path, depth FROM walk""")
def h01_paths(t: Tables) -> DataFrame:
    return hierarchy.paths(t.folders(), "id", "parent", "name")


@query(f"""WITH RECURSIVE tree AS {TREE}, walk AS (SELECT id AS ancestor, id AS descendant, 0 AS distance FROM tree UNION ALL SELECT w.ancestor, t.id, w.distance + 1 FROM walk w JOIN tree t ON t.parent = w.descendant) SELECT * FROM walk""")
def h03_closure(t: Tables) -> DataFrame:
    return hierarchy.closure(t.folders(), "id", "parent")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%licensed under%' OR source ILIKE '%licensed under%'")
def h07_search(t: Tables) -> DataFrame:
    return eav.searched(t.documents, ["text", "source"], "  Licensed under ").select("doc_id")


@query("""WITH l AS (SELECT unnest(['en', 'de']) AS locale, unnest([true, false]) AS is_default), p AS (SELECT r_regionkey AS page, lower(r_name) AS path, r_regionkey AS c FROM region WHERE r_regionkey <> 4)
SELECT page, n_nationkey AS item, locale, concat('/', CASE WHEN is_default THEN '' ELSE concat(locale, '/') END, path, '/', CASE WHEN NOT is_default AND n_nationkey % 3 = 0 THEN concat('de-', n_nationkey) ELSE lower(n_name) END) AS url FROM p JOIN nation ON n_regionkey = c, l
UNION ALL SELECT 100 + page, NULL, locale, concat('/', CASE WHEN is_default THEN '' ELSE concat(locale, '/') END, 'about-', path) FROM p, l""")
def h06_urls(t: Tables) -> DataFrame:
    pages = t.region.select(F.col("r_regionkey").alias("page"), F.lower("r_name").alias("path"), F.col("r_regionkey").alias("collection"), (F.col("r_regionkey") == 4).alias("skipped"))
    plain = pages.select((F.col("page") + 100).alias("page"), F.concat(F.lit("about-"), "path").alias("path"), F.lit(None).cast("int").alias("collection"), "skipped")
    nations = t.nation.select(F.col("n_nationkey").alias("item"), F.col("n_regionkey").alias("collection"), F.lower("n_name").alias("slug"))
    locales = t.region.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "en").otherwise("de").alias("locale"), (F.col("r_regionkey") == 0).alias("is_default"))
    over = nations.where("item % 3 = 0").select("item", F.lit("de").alias("locale"), F.concat(F.lit("de-"), F.col("item").cast("string")).alias("slug"))
    return items.urls(pages.unionByName(plain), nations, locales, over)


# Versions and events.


@query("SELECT event_id FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id DESC LIMIT 20")
def v01_history(t: Tables) -> DataFrame:
    return versions.history(t.events, "user_id", 5, "ts", "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def v03_young(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("_now"))
    return versions.young(t.events.join(F.broadcast(now)), "ts", F.col("_now"), 7).select("event_id")


@query("""SELECT event_id, s AS subscription FROM events JOIN (VALUES ('all', 'click', NULL), ('all', 'view', NULL), ('five', 'error', 5), ('five', 'purchase', 5)) AS v(s, kind, resource)
ON event_type = kind AND (resource IS NULL OR resource = user_id)""")
def v05_subscriptions(t: Tables) -> DataFrame:
    subs = t.spark.createDataFrame([("all", ["click", "view"], None), ("five", ["error", "purchase"], 5)], "subscription string, kinds array<string>, resource bigint")
    return versions.deliveries(t.events, subs, "event_type", "user_id").select("event_id", "subscription")


@query("""WITH l AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1)
SELECT user_id, count(*) FILTER (event_type <> 'purchase' AND (last IS NULL OR event_id > last))::BIGINT AS failures FROM events JOIN l USING (user_id) GROUP BY 1""")
def v06_failures(t: Tables) -> DataFrame:
    return items.failures(t.events, "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "failures")


