"""Round trips and fixtures that no SQL query covers."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from collonade.functions import casts, text
from collonade.operators import eav, hierarchy, inference, relations, snapshots, sorting, usage
from collonade.sources import files
from collonade.streaming import forms


def column(df, name):
    return [r[name] for r in df.collect()]


def test_casts(spark):
    df = spark.createDataFrame([("12abc",), (".5e1x",), ("1e",), ("0x10",), ("abc",), ("-Infinity",), (" 7",), (None,)], "v string")
    got = column(df.select(casts.parse_float(F.col("v")).alias("x")), "x")
    assert got == [12.0, 5.0, 1.0, 0.0, None, float("-inf"), 7.0, None]
    df = spark.createDataFrame([("Thu Jan 22 2026 19:21:05 GMT+0000 (Coordinated Universal Time)",), ("2024-02-30",), ("x",)], "v string")
    assert column(df.select(casts.parse_date(F.col("v")).alias("x")), "x") == [datetime.datetime(2026, 1, 22, 19, 21, 5), None, None]
    df = spark.createDataFrame([("a, b",), ("a;b",), ('["a","b"]',), ("",), (None,)], "v string")
    assert column(df.select(casts.parse_tokens(F.col("v")).alias("x")), "x") == [["a", "b"], ["a", "b"], ["a", "b"], [], []]


def test_cells_round_trip(spark):
    df = spark.createDataFrame([(1, "x", 2.5, True, ["a"]), (2, None, 3.0, False, [])], "item int, t string, n double, b boolean, m array<string>")
    kinds = {"t": "text", "n": "number", "b": "boolean", "m": "multi_reference"}
    assert sorted(eav.to_rows(eav.to_cells(df, "item", kinds), kinds).collect()) == sorted(df.collect())


def test_slugs_and_checks(spark):
    df = spark.createDataFrame([("Größe & Łódź – Ürün",), ("  ",), ("Привет",)], "v string")
    assert column(df.select(text.slug(F.col("v")).alias("x")), "x") == ["groesse-lodz-ueruen", "", "privet"]
    df = spark.createDataFrame([("+1 (212) 555-0100",), ("12345",), ("a@b.co",)], "v string")
    assert column(df.select(text.is_phone(F.col("v")).alias("x")), "x") == [True, False, False]
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024**3,)], "v bigint")
    assert column(df.select(text.file_size(F.col("v")).alias("x")), "x") == ["0.00 B", "1023.00 B", "1.50 KB", "5.00 GB"]
    df = spark.createDataFrame([("<p>a &amp;lt; b</p><script>x</script> c",)], "v string")
    assert column(df.select(text.plain_text(F.col("v")).alias("x")), "x") == ["a &lt; b c"]


def test_sorting(spark):
    df = spark.createDataFrame([(v,) for v in ["é", "B", "10", "", "a", "#", "9", "-1", "0"]], "v string")
    assert column(sorting.by_field(df, "v"), "v") == ["", "#", "-1", "0", "9", "10", "a", "B", "é"]
    assert column(sorting.by_field(df, "v", descending=True), "v") == ["é", "B", "a", "10", "9", "0", "-1", "#", ""]
    df = spark.createDataFrame([("Item 10",), ("item 9",), ("item 100",)], "v string")
    assert column(df.orderBy(sorting.natural_key(F.col("v"))), "v") == ["item 9", "Item 10", "item 100"]
    ids = spark.range(25).orderBy("id")
    assert [r.id for p in (1, 2, 3) for r in sorting.page(ids, p, 10).collect()] == list(range(25))


def test_references_with_cycle_and_missing(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "id int, other int")
    loop = {"a": relations.Collection("a", a, "id", {"other": "a"})}
    assert sorted(relations.nested(loop, "a").collect()) == sorted(a.collect())
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    pair = {"a": relations.Collection("a", a, "id", {"other": "b"}), "b": relations.Collection("b", b, "k")}
    assert {r.id: (r.other.v if r.other else None) for r in relations.nested(pair, "a").collect()} == {1: None, 2: "x", 3: None}


def test_publish_is_idempotent(spark):
    draft = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True)], "id int, v string, ok boolean")
    old = spark.createDataFrame([(2, "b", True), (3, "x", True), (4, "d", True)], "id int, v string, ok boolean")
    new = snapshots.published_from(draft, old, "id", "ok")
    assert {r.status for r in snapshots.compared(draft.where("ok"), new, "id", ["v"]).collect()} == {"same"}
    assert {(r.id, r.status) for r in snapshots.compared(draft, old, "id", ["v"]).collect()} == {(1, "new"), (2, "same"), (3, "updated"), (4, "deleted")}


def test_hierarchy(spark):
    tree = spark.createDataFrame([("a", None, "a"), ("b", "a", "b"), ("c", "b", "c"), ("x", "gone", "x"), ("r", None, "r")], "id string, parent string, name string")
    assert {(r.id, r.path) for r in hierarchy.paths(tree, "id", "parent", "name").collect()} == {("a", "a"), ("b", "a/b"), ("c", "a/b/c"), ("r", "r")}


def test_reachable_ends_in_cycles_and_hubs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 6), (7, None), (None, 8), (1, 2)] + [(4, i) for i in range(100, 150)], "a int, b int")
    from_ = lambda *ids: {r.node for r in hierarchy.reachable(edges, spark.createDataFrame([(i,) for i in ids], "x int")).collect()}
    assert from_(1) == {1, 2, 3, 4, *range(100, 150)} and from_(6) == {6} and from_(5, 7, None) == {5, 6, 7} and from_() == set()
    assert from_(999) == {999}


def test_small_cycle_beside_a_deep_line(spark):
    line = [(i, i - 1 if i else None, f"n{i}") for i in range(40)] + [(-1, -7, "dangling"), (-2, -1, "below")]
    cycle = [(1000, 1001, "x"), (1001, 1000, "y"), (1002, 1001, "z")]
    kinds = "id int, parent int, name string"
    clean = spark.createDataFrame(line, kinds)
    assert {r.id: r.depth for r in hierarchy.paths(clean, "id", "parent", "name").collect()} == {i: i for i in range(40)}
    assert hierarchy.closure(clean, "id", "parent").count() == 40 * 41 // 2 + 3
    odd = spark.createDataFrame(line + cycle + [(i, None, "root") for i in range(2000, 4000)], kinds)
    for f in (lambda: hierarchy.closure(odd, "id", "parent"), lambda: hierarchy.paths(odd, "id", "parent", "name")):
        with pytest.raises(ValueError, match="cycle"):
            f()


def test_decoded_references(spark):
    df = spark.createDataFrame([("a &AMP;lt; &#65;&#x1F600;&#xd800;&#0;&#1114112;&bogus; & &#0065;",), ("",), (None,), ("plain",), ("&" * 3 + "gt;",)], "v string")
    assert column(df.select(text.decode_entities(F.col("v")).alias("x")), "x") == ["a &lt; A\U0001f600&#xd800;&#0;&#1114112;&bogus; & A", "", None, "plain", "&&>"]


def test_late_page_reads_few_columns_for_its_sort(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    late = sorting.late_page(orders, "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 5)
    want = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(5).collect()
    assert late.select(orders.columns).collect() == want
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in late._jdf.queryExecution().toString() + late._jdf.queryExecution().executedPlan().treeString()


def test_mapping():
    assert inference.suggested_mapping([" Name ", "x"], [("name", "n"), ("Slug", "slug")]) == {" Name ": "n", "x": None}
    assert inference.duplicate_targets({"a": "n", "b": "n", "c": None}) == ["n"]


def test_csv_and_dump(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name,n,ok\n"a ""q"", b", 5x ,YES\n\nc,,maybe\n')
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    rows, bad = files.coerced_rows(df, {"n": "number", "ok": "boolean"})
    assert [tuple(r) for r in rows.collect()] == [('a "q", b', "5", "true"), ("c", None, None)]
    assert [tuple(r) for r in bad.collect()] == [("ok", "maybe")]
    own = spark.createDataFrame([(1, "x", None, "t"), (2, "y", "gone", "t")], "id int, v string, deleted_at string, created_at string")
    files.dump(own, str(tmp_path / "dump"))
    assert [tuple(r) for r in files.restore(spark, str(tmp_path / "dump"), "id int, v string").collect()] == [(1, "x")]


def test_numbering_has_no_gaps(spark):
    got = snapshots.numbered(spark.range(1000).select(F.col("id").alias("k")), spark.createDataFrame([(41,)], "id bigint"), "id", "k")
    assert [r.id for r in got.orderBy("k").collect()] == list(range(42, 1042))


def test_stream(spark, tmp_path, data):
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(str(tmp_path / "in"))
    out = forms.windowed_summary(stream, "event_type", F.col("value") > 50, "ts", "1 day")
    q = out.writeStream.format("memory").queryName("forms").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("forms").agg(F.sum("submission_count")).first()[0] == 1000


def test_signature(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("é",), ("",)], "v string")
    for key in ("k", "long" * 40):
        got = column(df.select(text.hmac_sha256(F.col("v"), key).alias("x")), "x")
        assert got == [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in ("é", "")]


def test_rich_text(spark):
    df = spark.createDataFrame([("<h2>A &amp; \"b\"</h2><ul><li>one<li>two</ul><p>x <b>y</b></p>",), ("bare",)], "v string")
    docs = column(df.select(text.rich_text(F.col("v")).alias("x")), "x")
    assert '"type":"heading","level":2' in docs[0]
    plain = column(df.select(text.rich_text_plain(text.rich_text(F.col("v"))).alias("x")), "x")
    assert plain == ['A & "b" one two x y', "bare"]


def test_blocks_and_strings_of_any_length(spark):
    words = 'a "b" \\ <i>c</i> ' * 20_000
    df = spark.createDataFrame([(f"<p>{words}</p><li>end", json.dumps({"k": words}))], "v string, j string")
    assert column(df.select(text.rich_text_plain(text.rich_text(F.col("v"))).alias("x")), "x") == ['a "b" \\ c ' * 20_000 + "end"]
    assert column(df.select(usage.strings_of(F.col("j")).alias("x")), "x") == [["k", json.dumps(words)[1:-1]]]


def test_slugs_are_unique_against_all_in_use(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a-2"), (3, "a"), (4, "atrium"), (5, "b"), (6, ""), (7, "")], "i int, base string")
    got = {r.i: r.slug for r in text.unique_slugs(df, "base", "i", reserved=("atrium",)).collect()}
    assert got == {0: "a", 1: "a-3", 2: "a-2", 3: "a-4", 4: "atrium-2", 5: "b", 6: "", 7: ""}
    taken = spark.createDataFrame([("b",), ("b-2",)], "base string")
    assert {r.i: r.slug for r in text.unique_slugs(df, "base", "i", taken=taken).collect()}[5] == "b-3"
    df = spark.createDataFrame([("Ελλαδα και",), ("Щука объект",), ("İstanbul",)], "v string")
    assert column(df.select(text.slug(F.col("v")).alias("x")), "x") == ["ellada-kai", "shchuka-obekt", "istanbul"]


def test_dates_with_an_offset(spark):
    df = spark.createDataFrame([("Thu Jan 22 2026 19:21:05 GMT+0200 (EET)",), ("Thu Jan 22 2026 19:21:05 GMT-0330",), ("Thu Jan 22 2026 19:21:05 GMT+0000 (Coordinated Universal Time)",)], "v string")
    got = column(df.select(F.date_format(casts.parse_date(F.col("v")), "HH:mm").alias("x")), "x")
    assert got == ["17:21", "22:51", "19:21"]


def test_deep_trees_and_cycles(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(150)], "id int, parent int, name string")
    got = {r.id: (r.path, r.depth) for r in hierarchy.paths(df, "id", "parent", "name").collect()}
    assert got == {i: ("/".join(f"n{j}" for j in range(i + 1)), i) for i in range(150)}
    pairs = {(r.ancestor, r.descendant): r.distance for r in hierarchy.closure(df, "id", "parent").collect()}
    assert pairs == {(i, j): j - i for j in range(150) for i in range(j + 1)}
    ring = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id int, parent int, name string")
    for f in (lambda: hierarchy.closure(ring, "id", "parent"), lambda: hierarchy.paths(ring, "id", "parent", "name")):
        with pytest.raises(ValueError, match="cycle"):
            f()
