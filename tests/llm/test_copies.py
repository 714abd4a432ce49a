import random

import pytest
import xxhash

from collonade.llm import simhash


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def groups(keys, roots):
    out = {}
    for k, r in zip(keys, roots, strict=True):
        out.setdefault(r, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_query_against_brute_force(odd, nothing):
    rows = odd.where("doc_id is not null").collect()
    got = {r.doc_id: r for r in simhash.digests(simhash.group(odd, 3)).collect()}
    fps = [brute_fingerprint(r.text) for r in rows]
    assert all(got[r.doc_id].fingerprint == f"{f:016x}" for r, f in zip(rows, fps, strict=True))
    want = groups([r.doc_id for r in rows], brute_components(fps))
    assert groups([r.doc_id for r in rows], [got[r.doc_id].component_id for r in rows]) == want
    assert all(got[min(g)].component_id == min(g) for g in want)
    assert simhash.group(nothing, 3).count() == 0


@pytest.mark.parametrize("shard", [4, 4096])
def test_links_keep_components(spark, shard):
    rng = random.Random(2)
    fps = set()
    for _ in range(40):  # chains and clouds around centres, and one hot bucket
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}
    fps = sorted(fps)
    signed = [f - (f >> 63 << 64) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, shard=shard)).collect()}
    assert groups(signed, [roots.get(f, f) for f in signed]) == groups(signed, brute_components(fps))


def test_tree_follows_edges_within_the_radius():
    rng, tree, inside = random.Random(4), simhash.BkTree(3), []
    for _ in range(500):
        x = rng.getrandbits(64) if rng.random() < 0.5 or not inside else rng.choice(inside) ^ 1 << rng.randrange(64)
        assert sorted(tree.near(x)) == sorted(y for y in inside if (x ^ y).bit_count() <= 3)
        if x not in inside:
            tree.join(x, True)
            inside.append(x)


def test_query_links_by_bits_alone(odd):
    rows = odd.where("doc_id is not null").collect()
    got = {r.doc_id: r.component_id for r in simhash.group(odd, 3, similar=None).collect()}
    want = groups([r.doc_id for r in rows], brute_components([brute_fingerprint(r.text) for r in rows]))
    assert groups([r.doc_id for r in rows], [got[r.doc_id] for r in rows]) == want


@pytest.mark.parametrize("light, sampled", [(16, 64), (0, 1)])
def test_similar_texts_are_linked_whatever_their_bits(spark, monkeypatch, light, sampled):
    monkeypatch.setattr(simhash, "LIGHT", light)  # with 0 all goes by rounds
    monkeypatch.setattr(simhash, "SAMPLED", sampled)
    rng, texts = random.Random(9), ["", "two words", "Two  WORDS", "two words more"]
    for n in (30, 120, 120, 300):
        plain = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for edits in [0, 0, *[rng.randrange(1, 2 + n // 20) for _ in range(14)]]:
            own = list(plain)
            for i in rng.sample(range(n), edits):
                own[i] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    fps = [brute_fingerprint(t, 5) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    assert any(alike(sets[i], sets[j]) and (fps[i] ^ fps[j]).bit_count() > 3 for i in range(len(texts)) for j in range(i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.group(df, 5).collect()}
    assert groups(range(len(texts)), [got[i] for i in range(len(texts))]) == groups(range(len(texts)), parent)
    assert all(got[i] == min(j for j in got if got[j] == got[i]) for i in got)


def test_whole_prefixes_find_every_pair(spark):
    """Without a sketch the stage's links are those of all pairs, and with it the same here."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))] for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base * 3:
        changed = list(w)
        for _ in range(rng.randrange(1, 3)):
            changed[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(changed))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for sketch in (None, 16):
        assert {r.doc_id: r.component_id for r in simhash.group(df, 5, sketch=sketch).collect()} == {i: find(i) for i in range(len(texts))}


def test_only_sets_of_possible_pairs_are_shuffled(spark):
    """Texts that share a shingle but are far from similar have their sets moved once, when they are named, and no more."""
    rng, sc, before = random.Random(6), spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    texts = [" ".join([*(f"pair{i // 2}of{k}" for k in range(200)), *(f"{rng.getrandbits(40):x}" for _ in range(600))]) for i in range(600)]
    texts += [texts[0] + " more", texts[7] + " more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    sc.setJobGroup("sets-moved", "")
    try:
        first = simhash.with_prefixes(df, 5, 0.8)
        roots = {r.node: r.root for r in simhash.similar_links(df, first, 5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(roots) == 2
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, stages = sc._jsc.sc().statusStore(), {s for j in sc.statusTracker().getJobIdsForGroup("sets-moved") for s in sc.statusTracker().getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if sc.statusTracker().getStageInfo(s))  # those skipped have none
    whole = 8 * 796 * len(texts)
    assert moved < 1.5 * whole, (moved, whole)


def test_pairs_of_a_large_group_become_rows_only_if_they_may_be_similar(spark, monkeypatch):
    """Of many edited copies of one text, most too far apart, only pairs near the similarity are compared, and no link is lost."""
    rng, pairs, keep = random.Random(3), [], simhash.keep
    monkeypatch.setattr(simhash, "LIGHT", 8)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(200):
        own = list(base)
        for k in rng.sample(range(5, 145), rng.choice([1, 2, 3, 3, 3, 3])):
            own[k] = f"x{i}of{k}"
        texts.append(" ".join(own))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    alike = {(i, j) for i in range(200) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    root = list(range(200))
    for i, j in alike:
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]

    def counted(df, name):
        out = keep(df, name)
        if name.startswith("pairs"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "keep", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.group(df, 5).collect()} == dict(enumerate(root))
    assert len(set(root)) > 1 and sum(pairs) < 10 * len(texts), pairs


def test_signatures_bound_the_difference():
    rng = random.Random(8)
    for n in (0, 1, 40, 3000):
        a = {rng.getrandbits(63) for _ in range(n)}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(63) for _ in range(n // 9 + 1)}
        bits = [simhash.signature(simhash.as_set(list(s))[0]).tobytes() for s in (a, b)]
        assert len(bits[0]) * 8 == simhash.BITS and sum((x ^ y).bit_count() for x, y in zip(*bits, strict=True)) <= len(a ^ b)
