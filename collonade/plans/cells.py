"""Further queries: cells that come in, their types and numbers, and the sorts and pages of what they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collonade.functions import text
from collonade.operators import catalogue, eav, inference, items, sorting
from collonade.plans.adapter import Tables
from collonade.plans.queries import query
from collonade.sources import files

RAW = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'n/a' WHEN c_custkey % 7 = 0 THEN '' ELSE ' ' || c_nationkey END AS score, CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS ok FROM customer"


def raw(t: Tables) -> DataFrame:
    """Customers as they stand in a file: numbers and booleans as text, some of them none."""
    k = F.col("c_custkey")
    score = F.when(k % 5 == 0, "n/a").when(k % 7 == 0, "").otherwise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string")))
    ok = F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("maybe")
    return t.customer.select("c_custkey", score.alias("score"), ok.alias("ok"))


@query(f"SELECT c_custkey, try_cast(trim(score) AS DOUBLE) AS score, CASE ok WHEN 'Yes' THEN 'true' WHEN 'no' THEN 'false' END AS ok FROM ({RAW})")
def i03_rows(t: Tables) -> DataFrame:
    return files.coerced_rows(raw(t), {"score": "number", "ok": "boolean"})[0].select("c_custkey", F.col("score").cast("double").alias("score"), "ok")


@query(f"SELECT field, value, count(*) AS n FROM (SELECT 'score' AS field, score AS value FROM ({RAW}) WHERE score = 'n/a' UNION ALL SELECT 'ok', ok FROM ({RAW}) WHERE ok = 'maybe') GROUP BY 1, 2")
def i03_warnings(t: Tables) -> DataFrame:
    bad = files.coerced_rows(raw(t), {"score": "number", "ok": "boolean"})[1]
    return bad.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 1000 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def i07_numbered(t: Tables) -> DataFrame:
    """Imported rows numbered on from the last id of their collection."""
    return inference.next_ids(t.orders, ["o_orderdate", "o_orderkey"], 1000, "o_custkey").select("o_orderkey", "id")


@query("SELECT c_custkey AS item, c_name AS name, CAST(c_nationkey AS DOUBLE) AS nation, c_custkey % 2 = 0 AS ok FROM customer")
def sc06_typed_rows(t: Tables) -> DataFrame:
    kinds = {"name": "text", "nation": "number", "ok": "boolean"}
    rows = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 2 == 0).alias("ok"))
    return eav.to_rows(eav.to_cells(rows, "c_custkey", kinds), kinds).withColumn("nation", F.col("nation").cast("double"))


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS id, p_partkey // 4 AS c, CASE WHEN p_size > 46 THEN 'image' WHEN p_size % 5 < 3 THEN 'reference' WHEN p_size % 5 = 3 THEN 'multi_reference' ELSE 'text' END AS type,
CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 2 ELSE p_partkey // 8 END AS r FROM part),
good AS (SELECT c FROM f WHERE type = 'image' UNION SELECT f.c FROM f JOIN good ON f.r = good.c WHERE f.type = 'reference') SELECT id FROM f WHERE type = 'reference' AND r IN (SELECT c FROM good)""")
def h12_leading_to(t: Tables) -> DataFrame:
    """References that lead to an image, up and down between the collections, with cycles."""
    size, k = F.col("p_size"), F.col("p_partkey")
    kind = F.when(size > 46, "image").when(size % 5 < 3, "reference").when(size % 5 == 3, "multi_reference").otherwise("text")
    to = F.when(k % 3 == 0, F.floor(k / 2)).otherwise(F.floor(k / 8))
    fields = t.part.select(k.alias("id"), F.floor(k / 4).alias("collection_id"), kind.alias("type"), to.alias("reference_collection_id"))
    return catalogue.leading_to(fields, ["image", "multi_reference"])


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part")
def o04_natural(t: Tables) -> DataFrame:
    """Labels with numbers, in either case: Size 9 comes before SIZE 10."""
    label = F.concat(F.when(F.col("p_partkey") % 2 == 0, "SIZE ").otherwise("Size "), F.col("p_size").cast("string"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(sorting.natural_key(label), "p_partkey"))
    return t.part.select("p_partkey", place.cast("bigint").alias("place"))


@query("SELECT n_nationkey FROM nation ORDER BY n_regionkey, n_nationkey DESC LIMIT 9")
def o05_manual(t: Tables) -> DataFrame:
    return sorting.default_order(t.nation, "n_regionkey", "n_nationkey", "n_name").limit(9).select("n_nationkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 30")
def o11_request_page(t: Tables) -> DataFrame:
    """A limit is the number of rows, and the page's start still goes by per_page."""
    return sorting.api_page(t.orders.orderBy("o_orderkey"), "2", "30", "7").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def o15_late_page(t: Tables) -> DataFrame:
    found = sorting.late_page(t.orders, "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20)
    return found.select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT p_partkey FROM part WHERE contains(CASE WHEN p_partkey % 3 = 0 THEN p_name || '_5%' ELSE p_name || 'x5y' END, '_5%')")
def s04_literal_search(t: Tables) -> DataFrame:
    """A search for text that holds LIKE's own signs."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "_5%").otherwise("x5y"))
    return items.like(t.part.select("p_partkey", name.alias("name")), "name", text.escape_like("_5%")).select("p_partkey")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS ts FROM orders), y AS (SELECT *, make_date(year(ts)::BIGINT, 3, 31) AS m, CASE WHEN year(ts) < 1996 THEN make_date(year(ts)::BIGINT, 9, 30) ELSE make_date(year(ts)::BIGINT, 10, 31) END AS o FROM d),
z AS (SELECT *, CAST(m - CAST(dayofweek(m) AS INTEGER) AS TIMESTAMP) + INTERVAL 3 HOUR AS a, CAST(o - CAST(dayofweek(o) AS INTEGER) AS TIMESTAMP) + INTERVAL 3 HOUR AS b FROM y)
SELECT o_orderkey, strftime(ts - CASE WHEN ts >= a AND ts < b THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M') AS utc FROM z""")
def s12_to_utc(t: Tables) -> DataFrame:
    """Local times of a zone with summer time, which ended in September before 1996; those of the hour that comes twice are the earlier ones."""
    local = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.col("o_orderdate").cast("timestamp_ntz")).cast("timestamp")
    return t.orders.select("o_orderkey", F.date_format(text.to_utc(local, "Europe/Berlin"), "yyyy-MM-dd HH:mm").alias("utc"))


@query("SELECT n_nationkey, n_name || '<&amp;' || chr(120000 + CAST(n_nationkey AS INTEGER)) || '&#0;&' AS shown FROM nation")
def s17_decoded(t: Tables) -> DataFrame:
    """Names whose letters are all written as numbers, by turns to ten and to sixteen, between named references."""
    k = F.col("n_nationkey")
    number = lambda c, i: F.when(i % 2 == 0, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(c))), F.lit(";")))
    written = F.array_join(F.transform(F.split("n_name", ""), number), "")
    return t.nation.select("n_nationkey", text.decode_entities(F.concat(written, F.lit("&LT;&amp;amp;&#"), (k + 120000).cast("string"), F.lit(";&#0;&"))).alias("shown"))


@query("""SELECT c_custkey, regexp_full_match(p, '[+]?[0-9 ().-]+') AND length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7 AS is_phone
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+1 (555) ' || c_custkey WHEN 1 THEN '0123.' || c_custkey WHEN 2 THEN '55+' || (c_custkey + 1000000) ELSE (c_custkey + 1000000) || ' ext' END AS p FROM customer)""")
def s20_phone(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    phone = F.when(k % 4 == 0, F.concat(F.lit("+1 (555) "), k)).when(k % 4 == 1, F.concat(F.lit("0123."), k)).when(k % 4 == 2, F.concat(F.lit("55+"), k + 1000000)).otherwise(F.concat(k + 1000000, F.lit(" ext")))
    return t.customer.select("c_custkey", text.is_phone(phone).alias("is_phone"))
