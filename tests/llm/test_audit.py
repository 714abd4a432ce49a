import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from collonade.llm import centroids, filter_audit, queries, url_filter
from oracle import connection, differences


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    assert differences(queries.QUERIES[name](spark, data), connection(data), queries.ORACLES[name]) == ""


# Filter interaction audit.


def failing(rows):
    """The failures of each row, by brute force."""
    out = []
    for r in rows:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == t for o in rows)
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        out.append({k for k, v in zip("ABCDE", tests, strict=True) if v})
    return out


def audited(rows, labels):
    good = {x.doc_id for x in labels if x.quality == 1 and x.doc_id is not None}
    toxic = {x.doc_id for x in labels if x.toxic == 1 and x.doc_id is not None}
    out, removals = {}, Counter()
    all_fails = failing(rows)
    for part in {r.lang or "" for r in rows}:
        own = [(r.doc_id, f) for r, f in zip(rows, all_fails, strict=True) if (r.lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                fails = [x for x in own if letter in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(x[1] == {letter} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                removals[part, letter] += len(gone)
    return {(p, o, k): (*v, removals[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_against_brute_force(spark, odd, nothing, labels):
    rng = random.Random(3)
    base = ["word " * 120, " ".join(f"w{i}" for i in range(120)), "SHOUT " * 20, "a | b", " ".join(f"W{i}" for i in range(150)), "", None]
    rows = [(i if i % 11 else None, rng.choice(base), rng.choice(["en", "de", None, ""]), "s", 0, "m", 0.0) for i in range(1, 90)]
    docs = odd.union(spark.createDataFrame(rows, odd.schema))
    more = labels.union(labels.selectExpr("doc_id + 40", "1", "0"))
    got = filter_audit.audit(filter_audit.mask_counts(docs, more)).collect()
    want = audited(docs.collect(), more.collect())
    assert len(got) == len(want) and {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want
    assert filter_audit.audit(filter_audit.mask_counts(nothing, labels)).count() == 0
    assert filter_audit.audit(filter_audit.mask_counts(docs, labels.limit(0))).where("good_lost > 0").count() == 0


# URL filters.


def test_hosts_paths_and_rules(spark):
    urls = ["https://Sub.Example.ORG/es/1?x#y", "http://example.org", "ftp://a.com/de/", "http://a.com?/de/", "x", None, "", "http://notorg/", "http://org/", "http://fr.com/fr/x", "://z.com/de/q", "a://b://c.com/", "http://É.com/de/"]
    df = spark.createDataFrame([(i, u, None, "x", "h") for i, u in enumerate(urls)], "page_id int, url string, html string, node string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {
        0: ("sub.example.org", "/es/1", "example.org/es/", "block"),
        1: ("example.org", "", None, "allow"),
        2: ("a.com", "/de/", "com/de/", "block"),
        3: ("a.com", "", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("notorg", "/", None, "allow"),
        8: ("org", "/", "org/", "allow"),
        9: ("fr.com", "/fr/x", "com/fr/", "allow"),
        10: ("z.com", "/de/q", "com/de/", "block"),
        11: ("b:", "//c.com/", None, "allow"),
        12: ("É.com", "/de/", "com/de/", "block"),
    }


CASES = [
    # A chain of net pages that ends at a blocked URL, which is no page itself.
    (1, "http://a.net/1", '<link rel="canonical" href="http://b.net/2">'),
    (2, "https://b.net/2#top", '<meta http-equiv="refresh" content="0; url=//c.net/3">'),
    (3, "http://c.net/3", "<LINK HREF='http://example.org/es/z' REL='Canonical'>"),
    # A component with an allowed and a blocked URL: allow has precedence, and own rules stay.
    (10, "http://d.net/", '<link rel=canonical href=http://e.org/x>'),
    (11, "http://f.net/", '<link rel="canonical" href="http://e.org/x">'),
    (12, "http://g.com/de/1", '<link rel="canonical" href="http://f.net/">'),
    (13, "http://e.org/x", None),
    # Relative targets: /4/../5 is not followed to a rule, ../9 meets page 22.
    (20, "http://h.net/a/b/c", '<link rel="canonical" href="../9?q=1">'),
    (21, "http://h.net/a/9?q=1", '<meta content="5;URL=\'http://i.com/de/\'" http-equiv="Refresh">'),
    # No edges: in a comment, of another kind, to no web address, to itself.
    (30, "http://j.net/", '<!-- <link rel="canonical" href="http://i.com/de/"> --><link rel="stylesheet" href="http://i.com/de/">'),
    (31, "http://k.net/", '<link rel="canonical" href="mailto:x@i.com"><link rel="canonical" href="http://k.net/#a">'),
    (32, None, '<link rel="canonical" href="http://i.com/de/">'),
    (1, "http://a.net/1", '<link rel="canonical" href="http://b.net/2">'),
]


def test_decisions_reach_aliases(spark, tmp_path):
    df = spark.createDataFrame(CASES, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.verdict, r.by) for r in url_filter.judge(df).collect())
    block, allow, default = {1, 2, 3, 20, 21}, {10, 11}, {30, 31, 32}
    assert got == sorted((i, "block" if i in block or i == 12 else "allow", "default" if i in default else "rule" if i in (12, 13) else "alias") for i, _, _ in CASES) and allow
    # The SQL knows no relative paths; the rest is the same.
    (tmp_path / "t").mkdir()
    df.where("page_id <> 20").toPandas().to_parquet(tmp_path / "t" / "pages.parquet")
    there = spark.read.parquet(str(tmp_path / "t" / "pages.parquet"))
    assert differences(url_filter.digests(url_filter.judge(there)), connection(tmp_path / "t"), url_filter.SQL) == ""
    redirects = spark.createDataFrame([("http://j.net/", "http://i.com/de/"), (None, None), ("http://q.net", "/x")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, redirects).collect()}[30] == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_components_against_union_find(spark):
    """A chain, a hub and scattered pairs, in any order, with blocked ends."""
    rng = random.Random(9)
    urls = [f"http://s{i}.net/{i}" for i in range(300)]
    pairs = [(urls[i], urls[i + 1]) for i in range(60)] + [(urls[100], u) for u in urls[101:180]] + [(rng.choice(urls[180:]), rng.choice(urls[180:])) for _ in range(60)]
    pairs += [(urls[60], "http://x.com/de/1"), (urls[150], "http://y.com/fr/2"), (urls[151], "http://x.com/de/9")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    verdicts = {find("http://x.com/de/1"): "block", find("http://y.com/fr/2"): "allow"}
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == {i: verdicts.get(find(u), "allow") for i, u in enumerate(urls)}


# Centroid clustering.


def by_all_distances(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], c


def vectors(n, size, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 2, (6, size))
    rows = [(i, (middles[i % 6] + rng.normal(0, 0.2, size)).tolist()) for i in range(n)]
    rows += [(1000, [0.5] * size), (1000, [0.5] * size), (None, [0.25] * size), (1001, None), (1002, []), (1003, [1.0] * (size - 1)), (1004, [None, *[1.0] * (size - 1)])]
    return rows + [(1005, [float("nan")] * size), (1006, [float("inf"), *[0.0] * (size - 1)]), (1007, [-0.001] * size)] + [(2000 + i, [0.1] * size) for i in range(200)]


@pytest.mark.parametrize(("n", "size", "k"), [(600, 3, 9), (300, 64, 40), (3, 2, 400)])
def test_clusters_against_all_distances(spark, n, size, k):
    rows = vectors(n, size)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    told, last = centroids.cluster(df, k=k, size=size)
    want, c = by_all_distances(rows, k, 5, size)
    assert last.tolist() == c
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, told.collect()), key=key) == sorted(want, key=key)


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>")
    assert centroids.digests(centroids.cluster(df)).count() == 0
    with pytest.raises(Exception, match="fits a long"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<double>"))


def test_trees_prune_and_assign_whole_nodes():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(c, c + 40, (500, 4)) for c in (0, 1000, 2000)])
    tree = centroids.grown(np.arange(len(x)), x)
    _, points, nodes, boxes = tree
    for (start, end, _, _), box in zip(nodes, boxes.reshape(-1, 3, 4), strict=True):
        assert (box == [points[start:end].sum(0), points[start:end].min(0), points[start:end].max(0)]).all()
    c = np.array([[20] * 4, [1020] * 4, [2020] * 4])
    parts = list(centroids.filtered((tree[0], points, nodes, boxes.reshape(-1, 3, 4)), c))
    assert sum(e - s for _, s, e, _, _ in parts) == len(x) and sum(len(chosen) == 0 for *_, chosen in parts) >= 3
    assert len(parts) < len(x) / centroids.LEAF / 2  # most was never looked into
    # On a tie no candidate is pruned, and the smaller number wins.
    assert centroids.surviving(np.arange(2), np.array([[0, 0], [2, 0]]), np.array([1, 0]), np.array([1, 5])).tolist() == [0, 1]
    assert centroids.nearest(np.array([[1, 3]]), np.array([[2, 0], [0, 0]]))[0].tolist() == [0]
    far = np.array([[1 << 26] * 4])
    assert centroids.nearest(far, np.array([[-(1 << 26)] * 4, [(1 << 26) - 1] * 4]))[1].tolist() == [4]
