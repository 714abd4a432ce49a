"""Scans with all filters, references, counters, copies, replacements and addresses, with nulls, ties and repeated rows."""

from pyspark.sql import functions as F

from collonade.operators import items, publishing


def at(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_one_scan_with_all_filters(spark):
    rows = [(1, "alpha", False, None, True), (2, "beta", False, "2024", True), (3, None, False, None, True), (1, "alpha", True, None, True), (4, "alps", True, None, False), (5, "gALa", False, None, False)]
    df = spark.createDataFrame(rows, "id int, name string, is_published boolean, deleted_at string, is_publishable boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert at(items.scanned(df, "id"), "id") == [(1,), (3,), (5,)]
    assert at(items.scanned(df, "id", published=True), "id") == [(1,)]
    assert at(items.scanned(df, "id", deleted=None), "id") == [(1,), (2,), (3,), (5,)] and at(items.scanned(df, "id", deleted=True), "id") == [(2,)]
    assert at(items.scanned(df, "id", search=" AL ", fields=["name"], ids=ids(1, 1, 2, 3)), "id") == [(1,)]
    assert at(items.scanned(df, "id", ids=ids()), "id") == []
    plan = items.scanned(df, "id", search="a", fields=["name"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1
    page = items.paged(items.scanned(df, "id"), "id", "name", "id", limit=1, offset=1)
    assert at(page, "id", "total") == [(3, 3)]


def test_references_single_and_listed(spark):
    parents = spark.createDataFrame([(1,), (2,), (1,), (None,)], "key int")
    one = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "name string, ref int")
    many = spark.createDataFrame([("a", [1, 1, 2]), ("b", []), ("c", None), ("d", [3, None, 2])], "name string, ref array<int>")
    assert at(items.referring(one, "ref", parents, "key"), "name", "parent") == [("a", 1)]
    assert at(items.referring(many, "ref", parents, "key"), "name", "parent") == [("a", 1), ("a", 2), ("d", 2)]


def test_sets_of_ids(spark):
    a, b, c = (spark.createDataFrame([(i,) for i in x], f"{n} int") for n, x in (("id", [1, 2, 2, 3, None]), ("x", [2, 3, 3, 9, None]), ("y", [3, 2, 1])))
    assert at(items.in_any(a, b), "id") == [(1,), (2,), (3,), (9,), (None,)]
    assert at(items.in_all(a, b, c), "id") == [(2,), (3,)] and at(items.in_all(a), "id") == [(1,), (2,), (3,), (None,)]
    assert at(items.in_first(a, b), "id") == [(1,)]
    assert at(items.counted(a, "id", spark.createDataFrame([(2,), (7,)], "id int")), "id", "n") == [(2, 2), (7, 0)]
    numbers = spark.createDataFrame([("a", "7 x"), ("a", "12"), ("b", "x"), ("b", None)], "g string, n string")
    assert at(items.next_number(numbers, "n", "g"), "g", "next") == [("a", 13), ("b", 1)] and items.next_number(numbers.limit(0), "n").first()["next"] == 1


def test_siblings_of_two_kinds(spark):
    pages = spark.createDataFrame([(1, "p", 0), (2, "p", 0), (3, None, 0)], "id int, up string, place bigint")
    folders = spark.createDataFrame([(1, "p", 1), (9, None, 0)], "id int, up string, place bigint")
    got = at(items.resequenced({"page": pages, "folder": folders}, "id", "up", "place"), "kind", "id", "place")
    assert got == [("folder", 1, 2), ("page", 2, 1), ("page", 3, 1)]


def test_copies(spark):
    rows = [(1, "A", "a", "t"), (2, "B", "a-9", "t"), (3, None, "a-copy", "t"), (4, "D", "", "t"), (5, "E", "a-copy-2", None), (6, "F", None, "t")]
    df = spark.createDataFrame(rows, "id int, name string, slug string, made string")
    chosen = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 1, 77)], "id int")
    got = sorted(at(items.duplicated(df, chosen, "id", "name", "slug", ["made"], F.lit("now")), "id", "name", "slug", "made"))
    assert got == [(7, "A (Copy)", "a-copy-1", "now"), (8, "B (Copy)", "a-copy-3", "now"), (9, None, "a-copy-copy", "now"), (10, "D (Copy)", "copy-copy", "now"), (11, "F (Copy)", "copy-copy-1", "now")]


def test_replacing_and_marking(spark):
    df = spark.createDataFrame([(1, "x", 5, "t1"), (2, "y", 6, "t2")], "id int, name string, n int, created_at string")
    new = spark.createDataFrame([(1, None, "later"), (9, "z", "later")], "id int, name string, created_at string")
    assert at(items.replaced(df, new, "id"), "id", "name", "n", "created_at") == [(1, None, None, "t1"), (2, "y", 6, "t2")]
    events = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, None), ("b", 1, False), ("c", 1, True)], "hook string, at int, ok boolean")
    assert at(items.failures(events, "hook", "at", F.col("ok")), "hook", "failures", "last_success") == [("a", 2, 2), ("b", 1, None), ("c", 0, 1)]
    assert at(items.incremented(events, "at", F.col("ok")), "at") == [(1,), (1,), (2,), (3,), (3,), (4,)]
    assert at(items.marked(events, "hook", spark.createDataFrame([("a",), ("a",)], "hook string"), "hook", "read"), "hook") == [("b",), ("c",), *[("read",)] * 4]


def test_addresses(spark):
    pages = spark.createDataFrame([(1, "", None, None), (2, "about", None, False), (3, "shop", "c", False), (4, "404", None, True)], "page int, path string, collection string, skipped boolean")
    things = spark.createDataFrame([(1, "c", "one"), (2, "c", ""), (3, "c", None), (4, "d", "four")], "item int, collection string, slug string")
    locales = spark.createDataFrame([("en", True), ("de", False)], "locale string, is_default boolean")
    over = spark.createDataFrame([(1, "de", "eins"), (1, "en", "unused"), (4, "de", "vier")], "item int, locale string, slug string")
    got = at(items.urls(pages, things, locales, over), "url")
    assert got == [("/",), ("/about",), ("/de",), ("/de/about",), ("/de/shop/eins",), ("/shop/one",)]


def test_preview_and_upserts(spark):
    rows = [(1, "a", False, None), (1, "a", True, None), (2, "b", False, None), (2, "c", True, None), (3, "d", False, None), (4, "e", False, "2024"), (4, "e", True, None), (5, "f", False, "2024"), (6, "g", True, None)]
    df = spark.createDataFrame(rows, "id int, v string, is_published boolean, deleted_at string")
    assert at(publishing.preview({"x": (df, "id", ["v"])}), "kind", "changed", "deleted", "total") == [("total", 2, 1, 3), ("x", 2, 1, 3)]
    done = publishing.upserted(df, ["id"])
    assert at(done.where("is_published"), "id", "v", "deleted_at") == [(1, "a", None), (2, "b", None), (3, "d", None), (4, "e", "2024"), (6, "g", None)]
    assert done.where("not is_published").count() == 5
    assert at(publishing.child_orphans(spark.createDataFrame([(1, 1), (2, 9), (3, None)], "c int, up int"), "up", df, "id"), "c") == [(2,)]
