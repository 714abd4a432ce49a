"""Restoring, loading, trees, variables, partial conditions, publishing with folders, manual order, foreign exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from collonade.functions import text, variables
from collonade.operators import eav, hierarchy, layers, ordering, pages, partial, relations, snapshots, trees
from collonade.operators.predicates import Condition
from collonade.plans import projects
from collonade.plans.adapter import Tables
from collonade.sources import export, store
from collonade.sources.store import Rejected, Store, Table
from collonade.streaming import load

TABLES = [Table("cells", ["id"], {"item": "items"}), Table("items", ["id"], {"collection": "collections", "above": "items"}), Table("collections", ["id"])]


def frames(spark, n=3, bad=None):
    out = {
        "collections": spark.createDataFrame([(1,), (2,)], "id int"),
        "items": spark.createDataFrame([(i, 1 + i % 2, i - 1 if i else None) for i in range(n)], "id int, collection int, above int"),
        "cells": spark.createDataFrame([(i, i % n, f"v{i}") for i in range(2 * n)], "id int, item int, value string"),
    }
    return out | ({bad[0]: bad[1]} if bad else {})


def contents(s):
    now = s.current()
    return {name: sorted(map(tuple, s.read(name, now).collect()), key=str) for name in now["tables"]}


def test_a_restore_is_whole_or_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TABLES)
    assert [t.name for t in store.ordered(TABLES)] == ["collections", "items", "cells"] and contents(s) == {}
    store.dump(frames(spark), str(tmp_path / "d"))
    assert store.restore(s, str(tmp_path / "d")) == 1
    before = contents(s)
    assert len(before["cells"]) == 6
    bad = {
        "cells.item": ("cells", spark.createDataFrame([(1, 77, "x")], "id int, item int, value string")),
        "more than once": ("cells", spark.createDataFrame([(1, 1, "x"), (1, 1, "y")], "id int, item int, value string")),
        "without a key": ("items", spark.createDataFrame([(None, 1, None)], "id int, collection int, above int")),
        "items.above": ("items", spark.createDataFrame([(0, 1, 5), (1, 1, None), (2, 1, None)], "id int, collection int, above int")),
    }
    for i, (why, wrong) in enumerate(bad.items()):
        store.dump(frames(spark, bad=wrong), str(tmp_path / f"b{i}"))
        with pytest.raises(Rejected, match=why):
            store.restore(s, str(tmp_path / f"b{i}"))
        assert contents(s) == before and s.current()["version"] == 1
    with pytest.raises(Rejected, match="expected"):
        s.replace(frames(spark), {"cells": 5}, whole=True)
    with pytest.raises(Rejected, match="other"):
        store.dump({"other": frames(spark)["items"]}, str(tmp_path / "o"))
        store.restore(s, str(tmp_path / "o"))
    # A parent may not go while its children stay.
    with pytest.raises(Rejected, match="cells.item"):
        s.replace({"items": frames(spark, 1)["items"]})
    assert contents(s) == before
    s.replace({n: f for n, f in frames(spark, 1).items() if n != "collections"})
    assert len(contents(s)["cells"]) == 2 and s.current()["version"] == 2
    with pytest.raises(ValueError, match="circle"):
        store.ordered([Table("a", ["i"], {"x": "b"}), Table("b", ["i"], {"x": "a"})])


def test_inserts_of_several_tables(spark, tmp_path):
    s = Store(spark, str(tmp_path), TABLES)
    with pytest.raises(Rejected, match="not there"):
        s.insert({"items": frames(spark)["items"]})
    assert s.insert(frames(spark), receipt=("a", 0)) and not s.insert(frames(spark), receipt=("a", 0))
    more = spark.createDataFrame([(9, 2, 2)], "id int, collection int, above int"), spark.createDataFrame([(90, 9, "new")], "id int, item int, value string")
    with pytest.raises(Rejected, match="there already"):
        s.insert({"items": frames(spark)["items"]})
    assert s.insert({"items": more[0], "cells": more[1]}, receipt=("a", 1))
    assert len(contents(s)["items"]) == 4 and s.current()["ledger"] == {"a": 1}


def test_a_load_goes_on_where_it_died(spark, tmp_path):
    """A run that dies after a batch is in the store, and before the stream has noted it, takes nothing twice."""
    (tmp_path / "in").mkdir()
    for i in range(4):
        lines = ["key,name,n"] + [f'{i}{j:02},"a ""b"", {j}",{"x" if j % 3 == 0 else j}' for j in range(20)] + [f"{i}99,,7"]
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join(lines) + "\n")
    job = load.Load("job", "rows", "key", {"n": "number"}, ["name"])
    tables = [Table("rows", ["key"]), Table(load.ERRORS, ["load", "batch", "field", "problem"])]

    def run(at, after=None):
        s = Store(spark, str(tmp_path / at), tables)
        load.load_files(spark, str(tmp_path / "in"), "key string, name string, n string", s, job, str(tmp_path / f"{at}-progress"), files_a_batch=1, examples=5, after=after)
        return s

    def die(number):
        if number == 2:
            raise RuntimeError("the driver is gone")

    with pytest.raises(Exception, match="the driver is gone"):
        run("one", die)
    partly = Store(spark, str(tmp_path / "one"), tables)
    assert partly.read("rows").count() == 60 and partly.current()["ledger"] == {"job": 2}
    got, want = run("one"), run("two")
    assert sorted(map(tuple, got.read("rows").collect())) == sorted(map(tuple, want.read("rows").collect()))
    assert got.read("rows").count() == 80 and got.current()["ledger"] == {"job": 3}
    told = {(r.field, r.problem): (r.total, [x.row for x in r.first]) for r in load.report(got, "job", 5).collect()}
    assert told == {("n", "not a number"): (28, ["000", "003", "006", "009", "012"]), ("name", "missing"): (4, ["099", "199", "299", "399"])}


def shuffled(tree, rng):
    if isinstance(tree, dict):
        items = [(k, shuffled(v, rng)) for k, v in tree.items()]
        rng.shuffle(items)
        return dict(items)
    return [shuffled(x, rng) for x in tree] if isinstance(tree, list) else tree


def grown(rng, depth):
    kind = rng.randrange(6) if depth else rng.randrange(4)
    if kind == 4:
        return {rng.choice("abc/[~é") + str(i): grown(rng, depth - 1) for i in range(rng.randrange(4))}
    if kind == 5:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(13))]
    return [None, True, rng.randrange(3), rng.choice(["", "1", "x\"y", "[0]"])][kind]


def test_hashes_of_trees(spark):
    rng = random.Random(3)
    made = [grown(rng, 5) for _ in range(60)]
    rows = [(f"{i}a", json.dumps(t)) for i, t in enumerate(made)] + [(f"{i}b", json.dumps(shuffled(t, rng), indent=1)) for i, t in enumerate(made)]
    got = {r.id: r.hash for r in trees.hashes(spark.createDataFrame(rows, "id string, tree string"), "id", "tree").collect()}
    same = {}
    for i, t in enumerate(made):
        assert got[f"{i}a"] == got[f"{i}b"]
        same.setdefault(json.dumps(t, sort_keys=True), set()).add(got[f"{i}a"])
    assert all(len(h) == 1 for h in same.values()) and len(set.union(*same.values())) == len(same)
    odd = [(1, "no json"), (2, None), (3, '{"open":true,"a":[1,2]}'), (4, '{"a":[1,2]}'), (5, '{"a":[2,1]}'), (6, '{"a":[1,{"open":1}]}'), (7, '{"a":[1,{}]}'), (8, '{"a":{"[0]":1}}'), (9, '{"a":[1]}')]
    h = {r.id: r.hash for r in trees.hashes(spark.createDataFrame(odd, "id int, tree string"), "id", "tree", ["open"]).collect()}
    assert h[1] is None and h[2] is None and h[3] == h[4] != h[5] and h[6] == h[7] and h[8] != h[9]
    assert trees.hashes(spark.createDataFrame([], "id int, tree string"), "id", "tree").count() == 0


def test_hashes_of_deep_trees(spark):
    """Deeper than one expression opens; a text that only looks deep asks for no rounds."""
    deep = lambda x, n=30: '{"a":[' * n + x + "]}" * n
    rows = [(1, deep("1")), (2, deep(" 1 ")), (3, deep("2")), (4, deep('{"open":[[1]]}')), (5, deep("{}")), (6, "[" * 5000), (7, '"' + "[" * 5000 + '"')]
    h = {r.id: r.hash for r in trees.hashes(spark.createDataFrame(rows, "id int, tree string"), "id", "tree", ["open"]).collect()}
    assert h[1] == h[2] != h[3] and h[4] == h[5] != h[1] and h[6] is None and h[7] is not None


def test_pages_of_orders_without_lines(spark, data):
    """Each has one section, which counts as changed where the deep value does."""
    t = Tables(spark, data)
    some = t.lineitem.where("l_orderkey % 3 <> 0")
    t.__dict__["lineitem"] = some
    t.__dict__["orders"] = t.orders.where("o_orderkey < 300")
    got = {r.id: (r.status, r.layers_changed) for r in projects.n13_unpublished_pages(t).where("id % 3 = 0 AND id % 10 IN (3, 4, 5)").collect()}
    assert len(got) == 30 and all(v == (("changed", True) if k % 10 == 5 else ("same", False)) for k, v in got.items())


def test_changed_components_are_not_broadcast(spark, data):
    """Their hashes are larger than the table's size tells."""
    plan = projects.n25_changed_components(Tables(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def without(tree, names):
    if isinstance(tree, dict):
        return {k: without(v, names) for k, v in tree.items() if k not in names}
    return [without(x, names) for x in tree] if isinstance(tree, list) else tree


def test_ignored_attributes_of_any_value(spark):
    """Wherever they stand, one after another, below each other, and where a text only looks like one."""
    rng, names = random.Random(5), ["open", 'o"p']

    def made(depth):
        kind = rng.randrange(4) if depth else 3
        if kind < 2:
            return {k: made(depth - 1) for k in rng.sample(["a", "open", 'o"p', "z", '{"open', ',"open":1'], rng.randrange(6))}
        return [made(depth - 1) for _ in range(rng.randrange(4))] if kind == 2 else rng.choice([None, 7, "{", ',"open":', '"open"', "a,", "\\", 'x\\"', True])

    cases = [made(6) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(c), json.dumps(without(c, names))) for i, c in enumerate(cases)], "id int, whole string, bare string")
    got, want = ({r.id: r.hash for r in trees.hashes(df, "id", c, ig).collect()} for c, ig in (("whole", names), ("bare", [])))
    assert got == want and len(set(want.values())) > 50


def test_ids_and_labels_are_told_apart(spark):
    docs = [(1, '{"sort_by":"f1","name":"f2"}'), (2, '[{"x":[{"fieldId":"f2"}]}]'), (3, '{"t":{"type":"field","data":{"field_id":"f1"}}}'), (4, '{"t":{"type":"asset","data":{"field_id":"f1"}}}'), (5, '{"data":{"field_id":"f1"},"other":{"type":"field"}}'), (6, '{"sort_by":"f\\u0031"}')]
    index = trees.strings(spark.createDataFrame(docs, "id int, tree string"), "id", "tree")
    ids = spark.createDataFrame([("f1",), ("f2",)], "field string")
    found = trees.bound(index, "id", ids, "field", ["sort_by", "x[]/fieldId"], [("data/field_id", "type", "field")])
    assert sorted((r.id, r.field) for r in found.collect()) == [(1, "f1"), (2, "f2"), (3, "f1"), (6, "f1")]


def test_strings_take_one_plan(spark):
    """Levels that fit one expression are opened without a checkpoint between them, deeper ones are found too."""
    below = lambda n: '{"a":[' * n + '{"sss":"f1","e":[],"n":1}' + "]}" * n
    index = trees.strings(spark.createDataFrame([(1, below(4)), (2, '"f1"'), (3, "[")], "id int, tree string"), "id", "tree")
    assert "Scan ExistingRDD[key" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, index.select("id", "path", "value").collect())) == [(1, "/a[]" * 4 + "/sss", "f1"), (2, "", "f1")]
    deep = trees.strings(spark.createDataFrame([(1, below(20))], "id int, tree string"), "id", "tree")
    assert [r.path for r in deep.collect()] == ["/a[]" * 20 + "/sss"]


def test_a_tag_is_parsed_once(spark):
    """Whatever is asked of it: the JSON of a tag, and the found value that may be rich text, are each parsed in one place."""
    none = F.lit(None).cast("map<string,string>")
    df = spark.range(1).select(variables.resolved(F.lit("x"), none, none).alias("x"))
    assert df._jdf.queryExecution().analyzed().toString().count("try_parse_json") == 2


def test_variables(spark):
    tag = lambda s: f"<v>{s}</v>"
    field = lambda **d: tag(json.dumps({"type": "field", "data": d}))
    cases = {
        f"a {field(field_id='n')}{field(field_id='n')} b": "a NN b",
        f"{field(field_id='r', relationships=['s', 't'])}": "deep",
        f"{field(field_id='p')}|{field(field_id='p', source='page')}|{field(field_id='p', source='collection')}": "own|page|own",
        f"{field(field_id='q')}|{field(field_id='q', source='collection')}|{field(field_id='none')}.": "Q||.",
        f"{field(field_id='n', collection_layer_id='L')}|{field(field_id='n', collection_layer_id='M')}": "of L|N",
        f"{field(field_id='d', field_type='date')}": "Jan 5, 2024, 14:00",
        f"{tag('{x')} {tag('[]')} {field()} {tag(json.dumps({'type': 'asset', 'data': {'field_id': 'n'}}))}": None,
        f"{tag(' ' + chr(10) + json.dumps({'type': 'field', 'data': {'field_id': 'n'}}) + chr(10))}": "N",
        "<v> unclosed": "<v> unclosed",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    m = lambda **d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    own = F.map_concat(m(n="N", p="own", d="2024-01-05T13:00:00"), F.create_map(F.lit("r.s.t"), F.lit("deep")))
    got = {r.t: r.x for r in df.select("t", variables.resolved(F.col("t"), own, m(p="page", q="Q"), F.create_map(F.lit("L"), m(n="of L")), "Europe/Berlin", tag="v").alias("x")).collect()}
    assert got == {t: t if x is None and t is not None else x or "" for t, x in cases.items()}
    none = F.lit(None).cast("map<string,string>")
    gone = df.select(variables.resolved(F.lit(f"a{tag('{x')}b{field(field_id='n')}"), none, tag="v").alias("x")).first().x
    assert gone == "ab"


FIELDS = [Condition("a", "gt", "3", kind="number"), Condition("b", "contains", "x"), Condition("b", "is", "xy"), Condition("a", "lt", "8", kind="number"), Condition("b", "is_empty")]


def any_tree(rng, depth):
    kind = rng.randrange(5) if depth else rng.randrange(2)
    if kind == 0:
        return rng.choice(FIELDS)
    if kind == 1:
        return partial.Bound(rng.choice([Condition("a", "gt", kind="number"), Condition("b", "contains"), Condition("b", "is_not")]), rng.choice("ijk"))
    if kind == 2:
        return partial.Not(any_tree(rng, depth - 1))
    return (partial.All, partial.Any)[kind - 3](tuple(any_tree(rng, depth - 1) for _ in range(rng.randrange(1, 4))))


def test_parts_of_conditions_make_the_whole(spark):
    """now() and later() together keep what the whole tree with its inputs keeps, and now() never depends on inputs."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 11, [None, "", "x", "xy", "z"][i % 5]) for i in range(77)], "i int, a int, b string").cache()
    split = 0
    for _ in range(25):
        tree = any_tree(rng, 3)
        inputs = {k: v for k, v in (("i", "5"), ("j", "x"), ("k", "")) if rng.random() < 0.7}
        whole = partial.known(tree, inputs)
        want = df.where(partial.column(df, whole)) if whole is not None else df
        first = partial.now(df, tree)
        assert sorted(r.i for r in partial.later(first, tree, inputs).collect()) == sorted(r.i for r in want.collect()), tree
        split += partial.pushed(tree) is not None and partial.residual(tree) is not None
    assert split >= 3


def test_the_static_part_reaches_the_scan(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    tree = partial.All((Condition("o_totalprice", "gt", "1000", kind="number"), partial.Any((Condition("o_orderstatus", "is", "F"), partial.Bound(Condition("o_orderstatus", "is"), "status")))))
    plan = partial.now(orders, tree)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert partial.bound(partial.Bound(Condition("a", "is", kind="boolean"), "i"), {"i": "false"}) is None
    assert partial.bound(partial.Bound(Condition("a", "is_between", "", "5"), "i"), {}).value2 == "5"
    with pytest.raises(ValueError, match="not known"):
        partial.column(orders, partial.Bound(Condition("o_orderkey", "gt"), "i"))


def test_layers_are_counted_in_one_scan(spark, data):
    lists = [layers.Layer(f"l{k}", partial.from_groups([[Condition("o_orderkey", "gt", str(k), kind="number")]]), offset=k, limit=k % 3) for k in range(12)]
    orders = spark.read.parquet(f"{data}/orders.parquet")
    counted = layers.counts(orders, lists)
    assert counted._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    n = orders.count()
    got = {r.layer: (r.found, r.rendered) for r in counted.collect()}
    for k in range(12):
        found = orders.where(F.col("o_orderkey") > k).count()
        assert got[f"l{k}"] == (found, min(found - k, k % 3) if k % 3 else found - k) and found <= n
    rows = spark.createDataFrame([(1, "x"), (2, None)], "i int, b string")
    targets = {"few": [[layers.Count("l0", "item_count", "lt", 5)]], "some": [[layers.Count("l0", "has_items")], [layers.Count("gone", "has_no_items"), Condition("b", "is", "y")]], "x": [[Condition("b", "is", "x"), layers.Count("gone", "has_items")]], "odd": [[layers.Count("l0", "unknown")]]}
    told = {(r.i, r.target): r.visible for r in layers.visible(rows, counted, targets).collect()}
    assert told == {(1, "few"): False, (2, "few"): False, (1, "some"): True, (2, "some"): True, (1, "x"): True, (2, "x"): False, (1, "odd"): True, (2, "odd"): True}


def test_pages_are_published_with_their_folders(spark):
    F_ = "id string, folder_id string, deleted_at string, is_published boolean"
    folders = [("a", None, None, False), ("b", "a", None, False), ("c", "b", None, False), ("x", "gone", None, False), ("y", "x", None, False), ("d", None, "2024", False), ("e", "d", None, False), ("d", None, None, True), ("r1", "r2", None, False), ("r2", "r1", None, False)]
    drafts = [("p1", "c", "1"), ("p2", "y", "2"), ("p3", "e", "3"), ("p4", None, "4"), ("p5", "c", "5"), ("p6", "b", "6"), ("p7", "r1", "7")]
    rows = [(i, f, n, None, False) for i, f, n in drafts] + [("p5", "c", "5", None, True), ("p6", "a", "6", None, True), ("p8", None, "8", "2024", False)]
    pages_df = spark.createDataFrame(rows, "id string, folder_id string, name string, deleted_at string, is_published boolean")
    ids = spark.createDataFrame([(f"p{i}",) for i in range(1, 10)], "id string")
    p, f = pages.publish(pages_df, spark.createDataFrame(folders, F_), ids, ["name"])
    assert sorted((r.id, r.folder_id) for r in p.where("is_published").collect()) == [("p1", "c"), ("p3", "e"), ("p4", None), ("p5", "c"), ("p6", "b")]
    assert sorted(r.id for r in f.where("is_published").collect()) == ["a", "b", "c", "d", "e"]
    assert p.where("not is_published").count() == 8
    again = pages.publish(p, f, ids, ["name"])
    assert sorted(map(str, again[0].collect())) == sorted(map(str, p.collect())) and sorted(map(str, again[1].collect())) == sorted(map(str, f.collect()))
    every = pages.publish_folders(spark.createDataFrame(folders, F_))
    assert {(r.id, r.deleted_at) for r in every.where("is_published").collect()} >= {("a", None), ("b", None), ("c", None), ("d", "2024")}


def test_moves(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, (i // 3 + 1) * (1 if i % 3 == 0 else 100)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g int, position bigint")
    movers = rng.sample(range(60), 20)
    still = [i for i in range(60) if i not in movers]
    moves = [(i, rng.choice([None] + [j for j in still if j % 3 == i % 3][:3]), rng.randrange(3)) for i in movers]
    new = ordering.moved(df, spark.createDataFrame(moves, "id int, anchor int, rank int"), "id", "position", "g", gap=10)
    got = {r.id: r.position for r in new.collect()}
    at = {i: got.get(i, p) for i, _, p in rows}
    for g in range(3):
        want = [i for i in still if i % 3 == g]
        for anchor in {a for i, a, _ in moves if i % 3 == g}:
            turn = [i for _, i in sorted((r, i) for i, a, r in moves if a == anchor and i % 3 == g)]
            k = 0 if anchor is None else want.index(anchor) + 1
            want[k:k] = turn
        assert sorted((i for i in at if i % 3 == g), key=at.get) == want and len({at[i] for i in want}) == 20
    assert {i for i in got if i % 3} <= set(movers)  # where there is room nothing else is written
    for bad in ([(1, 2, 0)], [(1, 4, 0), (4, None, 0)], [(99, None, 0)], [(1, 4, 0), (1, 7, 0)], [(1, 99, 0)]):
        with pytest.raises(ValueError, match="twice"):
            ordering.moved(df, spark.createDataFrame(bad, "id int, anchor int, rank int"), "id", "position", "g").count()


def test_ranks_and_slugs_of_a_hot_group(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice(["a"] * 8 + ["b", "a-3", "", None])) for i in range(400)], "i int, base string").repartition(5)
    got = sorted((r.base or "", r.base is None, r.i, r["rank"]) for r in ordering.ranked(df, ["i"], "base").collect())
    counts = {}
    for b, null, _, k in got:
        counts[b, null] = counts.get((b, null), 0) + 1
        assert k == counts[b, null]
    taken = [("a-2",), ("a-5",), ("b",), ("a-07",), ("a-1",)]
    named = {r.i: (r.base, r.slug) for r in text.unique_slugs(df.where("base IS NOT NULL"), "base", "i", taken=spark.createDataFrame(taken, "base string")).collect()}
    used, want = {b for b, _ in named.values()} | {t for t, in taken}, {}
    seen = {t for t, in taken}
    for i in sorted(named):
        base, n = named[i][0], 1
        if base and base not in seen:
            seen.add(base)
            want[i] = base
            continue
        n = 2
        while base and (f"{base}-{n}" in used or f"{base}-{n}" in want.values()):
            n += 1
        want[i] = f"{base}-{n}" if base else ""
    assert {i: s for i, (_, s) in named.items()} == want


def test_several_changes_for_a_key(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    changes = spark.createDataFrame([(1, "m", None), (1, None, 7), (1, "c", 3)], "k int, x string, y int")
    assert sorted(map(tuple, eav.patched(old, changes, ["k"]).collect())) == [(1, "m", 7), (2, "b", 2)]
    over = spark.createDataFrame([(1, "x"), (1, "y"), (2, " ")], "k int, t string")
    assert sorted(map(tuple, relations.overlaid(old, ["k"], over, "x", "t").select("k", "x").collect())) == [(1, "y"), (2, "b")]
    numbers = snapshots.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("o")), spark.createDataFrame([(41,)], "n bigint"), "n", "o")
    assert sorted((r.o, r.n) for r in numbers.collect()) == [(i, 42 + i) for i in range(1000)]


def test_walks_from_some_nodes(spark):
    df = spark.createDataFrame([(i, i - 1 if i % 20 else None) for i in range(100)] + [(201, 200), (200, 201), (300, 999)], "id int, parent int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    at = lambda d: sorted(r.id for r in d.select("id").collect())
    assert at(hierarchy.above(df, "id", "parent", ids(5, 43, 300, 12345))) == [*range(6), *range(40, 44), 300]
    assert at(hierarchy.subtree(df, "id", "parent", ids(15, 17))) == [*range(15, 20)]
    assert at(hierarchy.above(df, "id", "parent", ids(200))) == [200, 201]
    assert at(hierarchy.without_subtree(df, "id", "parent", ids(0, 20, 40, 60, 81, 300))) == [80, 200, 201]
    pairs = spark.createDataFrame([(5, 0), (0, 5), (5, 5), (43, 0), (7, None)], "node int, ancestor int")
    assert {(r.node, r.ancestor): r.descends for r in hierarchy.descends(pairs, df.where("id < 100"), "id", "parent").collect()} == {(5, 0): True, (0, 5): False, (5, 5): False, (43, 0): False, (7, None): False}


def test_foreign_exports(spark, tmp_path):
    (tmp_path / "shop - Makers - 1.csv").write_text('Collection ID,Item ID,Name,Name,,Best\nM,m1,old,New,x,t1\nM,m2,"a, ""b""",,y,t9\nM,m3,c,C,z,t2\n')
    (tmp_path / "Things.csv").write_text("Item ID,Maker,Makers,Price\nt1,m1,m1;m2,5\nt2,m2,\"[\"\"m3\"\",\"\"zz\"\"]\",6\nt3,m9,m9,7\nt4,m3,m1,8\n,m2,m2,9\n")
    (tmp_path / "notes.txt").write_text("not one of them")
    cells = export.read_export(spark, str(tmp_path))
    got = {(r.collection, r.row, r.field): r.value for r in cells.collect()}
    assert got["M", 0, "Name"] == "New" and ("M", 1, "Name") not in got and got["Things", 4, "Price"] == "9" and ("M", 0, "") not in got
    ids = {(r.collection, r.old_id): r.id for r in export.items(cells).collect()}
    assert ("Things", "Things:4") in ids and len(set(ids.values())) == 8
    values, warnings = export.imported(cells)
    old = {v: k for k, v in ids.items()}
    told = {(old[r.id][1], r.field): r.value for r in values.collect()}
    assert told["t1", "Maker"] == ids["M", "m1"] and json.loads(told["t1", "Makers"]) == [ids["M", "m1"], ids["M", "m2"]] and json.loads(told["t2", "Makers"]) == [ids["M", "m3"]]
    assert told["t3", "Price"] == "7" and ("t3", "Maker") not in told and told["t3", "Makers"] == "[]"
    assert {(r.collection, r.field, r.value) for r in warnings.collect()} >= {("Things", "Maker", "m9"), ("Things", "Makers", "m9")}
    assert export.title("/a/b/shop%20-%20Makers%20-%201.csv") == "Makers" and export.last_of_each(["a", "b", "a", " ", None]) == {"a": 2, "b": 1}


def test_sheets_with_clashing_headers(spark, tmp_path):
    from collonade.sources.files import read_csv

    (tmp_path / "a.csv").write_text('id, name,name,\n1,old, "new ""x""" ,z\n\n2,b\n')
    got = read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "name"] and sorted(map(tuple, got.collect())) == [("1", 'new "x"'), ("2", "")]
    (tmp_path / "b.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "b.csv")).columns == []
