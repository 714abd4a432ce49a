"""SimHash near-dedup with BK-trees.

A fingerprint has a bit for each bit position that is set in over half of a
text's shingle hashes.  Fingerprints within ``radius`` bits agree on at least two
of ``radius + 2`` blocks of bits, so each is dealt to one bucket for each pair of
blocks, and what is linked meets in a bucket at least once.  A bucket is a shard
with its own BK-tree, whose children are keyed by their distance to the parent
and of which a search follows only the edges within the radius.  A bucket of more
than ``shard`` fingerprints is several trees; each fingerprint is then a member of
one and a query to those after it, so the trees stay bounded and no pair is lost.
Within a tree only links that join two parts so far apart are returned, so a
group of n copies costs n - 1 links and not n * n.

group() asks for more unless it is given no similarity: it links texts by the exact
Jaccard similarity of their sets of shingles, whatever the distance of their
fingerprints.  Candidates share one of the first shingles of each in one order,
by hash, with those last that a sample of the texts shows to be frequent; each is
confirmed on the whole sets.  Of a text whose shingles are mostly frequent ones the
first are as many as two sets so similar must share one of (prefix filter).  Of
others they are the first SKETCH: as half of the shingles are in random order, two
such sets have a similarity of 0.63 or more among these, and share none of the first
16 with a probability under 0.37^16, or one in eight million.  With ``sketch=None`` all
texts are compared by their whole prefixes, and no pair can be missed.

Defined results: a text without words has fingerprint zero and links like any
other; null and empty texts are alike; null keys count, but a group of null keys
only has a null component; texts are read whole, whatever their length; repeated
rows are in one group, which the smallest key names; an empty table gives no rows;
only the key and the text are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collonade.llm.common import checkpoint, join_sized, keep, portions, scratch

SEED, RADIUS, SHARD = 42, 3, 4096
#: The similarity from which texts are linked.
SIMILAR = 0.8
# These only set the cost. One text in SAMPLED is counted for the order of shingles, of which HEAVY are told apart. A shingle's
# texts that aren't linked yet are all compared if that is at most LIGHT pairs for each, or after rounds with CENTRES of them: ROUNDS, or
# as many as link one in YIELD of the places still open.
SAMPLED, HEAVY, LIGHT, ROUNDS, CENTRES, YIELD = 64, 100_000, 128, 6, 4, 1000
#: Counts of a set's members by their last bits, of which two sets have at most the lesser ones in common.
BINS = 256
#: Bits of a set's signature, each telling whether an odd number of its members end in that number: two sets differ in as many members at least as bits.
BITS = 512
#: First shingles that texts are compared by if at most half of theirs are frequent.
SKETCH = 16


def shingles(raw: bytes, words: int) -> list[int]:
    """The hashes of a text's shingles, in their order."""
    parts = raw.lower().split()  # of bytes: A-Z only, and the six white space bytes only
    if not parts:
        return []
    joined, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    of = xxhash.xxh64_intdigest
    return [of(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :].tolist(), strict=False)]


def fingerprint(raw: bytes, words: int) -> int:
    """The 64-bit fingerprint of a text in UTF-8, as a signed integer."""
    return folded(shingles(raw, words))


def folded(hashes: list[int]) -> int:
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            fps = [fingerprint(raw or b"", words) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


class BkTree:
    """Fingerprints by distance; join() tells which parts of it a fingerprint connects."""

    def __init__(self, radius: int):
        self.radius, self.root, self.children, self.parent = radius, None, {}, {}

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def near(self, x: int) -> list[int]:
        found, todo, r, children = [], [self.root] if self.root is not None else [], self.radius, self.children
        while todo:
            node = todo.pop()
            d = (node ^ x & 0xFFFFFFFFFFFFFFFF).bit_count()
            if d <= r:
                found.append(node)
            for edge, child in children[node].items():
                if d - r <= edge <= d + r:
                    todo.append(child)
        return found

    def join(self, x: int, member: bool) -> list[int]:
        """The roots of the parts within reach of x, which become one; x is inserted if it is a member."""
        roots = {self.find(node) for node in self.near(x)}
        if member:
            self.insert(x)
            roots.add(x)
        top = min(roots, default=None)
        for root in roots:
            self.parent[root] = top
        return [root for root in roots if root != x]

    def insert(self, x: int) -> None:
        self.parent[x], self.children[x] = x, {}
        if self.root is None:
            self.root = x
            return
        node = self.root
        while True:
            d = (node ^ x).bit_count()
            if (child := self.children[node].get(d)) is None:
                self.children[node][d] = x
                return
            node = child


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect all those within radius bits of each other."""
    n = radius + 2
    bounds = [64 * i // n for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned("fp", bounds[i]).bitwiseAND((1 << bounds[i + 1] - bounds[i]) - 1)
    tables = [F.struct(F.lit(t).alias("table"), (F.shiftleft(block(i), 32).bitwiseOR(block(j))).alias("key")) for t, (i, j) in enumerate(combinations(range(n), 2))]
    dealt = fps.select("fp", F.explode(F.array(*tables)).alias("b")).select("b.table", "b.key", "fp")
    sizes = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    met = dealt.join(sizes, ["table", "key"]).withColumn("home", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    roles = met.select("table", "key", "fp", "home", F.explode(F.expr("sequence(home, shards - 1)")).alias("shard"))
    roles = roles.select("table", "key", "shard", (F.col("home") == F.col("shard")).alias("member"), "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, BkTree(radius)
        for batch in batches:
            a, b = [], []
            for table, key, part, member, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (table, key, part) != at:
                    at, tree = (table, key, part), BkTree(radius)
                x = fp & 0xFFFFFFFFFFFFFFFF
                for y in tree.join(x, member):
                    a.append(fp)
                    b.append(y - (y >> 63 << 64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = roles.repartition("table", "key", "shard").sortWithinPartitions("table", "key", "shard", F.desc("member"), "fp")
    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that each node of the links (a, b) can reach.

    Large-star and small-star steps in turn: each round moves links nearer to the
    smallest node of their neighbourhood, until nothing changes.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def as_set(hashes: list[int]) -> tuple[np.ndarray, int]:
    """The different hashes, and a name of the set."""
    own = np.unique(np.array(hashes, np.uint64))
    h = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return own.view(np.int64), h - (h >> 63 << 64)


def bins(own: np.ndarray) -> np.ndarray | None:
    """How many members of a set have each of the BINS possible last bits; None if that is more than a short holds."""
    counts = np.bincount(own & (BINS - 1), minlength=BINS)
    return counts.astype(np.int16) if counts.max() < 1 << 15 else None


def signature(own: np.ndarray) -> np.ndarray:
    """The BITS bits of a set's signature, in longs."""
    odd = np.bincount(own & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def shingle_sets(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(sid, shingles, bins, bits): name, members, counts by last bits and signature of each row's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            got = [as_set(shingles(raw or b"", words)) for raw in batch.column(0).cast(pa.binary()).to_pylist()]
            columns = [pa.array([sid for _, sid in got], pa.int64()), pa.array([own for own, _ in got], pa.list_(pa.int64())), pa.array([bins(own) for own, _ in got], pa.list_(pa.int16())), pa.array([signature(own) for own, _ in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "shingles", "bins", "bits"])

    return docs.select(text).mapInArrow(run, "sid bigint, shingles array<bigint>, bins array<smallint>, bits array<bigint>")


def heavy(docs: DataFrame, words: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts share, sorted, and how many do."""
    sample = shingle_sets(docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLED)) == 0), words, text).groupBy("sid").agg(F.first("shingles").alias("shingles"))
    counts = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 3")
    rows = sorted((r["s"], r["count"]) for r in counts.orderBy(F.desc("count"), "s").limit(HEAVY).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def with_prefixes(docs: DataFrame, words: int, similar: float, key: str = "doc_id", text: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """(key, fp, sid, n, prefix) of each row: its set's name, size and first shingles, of which similar sets share one, or without a sketch are sure to."""
    known, often = heavy(docs, words, text)

    def prefix(own: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            counts = np.where(known[at] == own, often[at], 0)
        needed = len(own) - int(np.ceil(similar * len(own) - 1e-9)) + 1
        return own[np.lexsort((own, counts))][: min(needed, sketch) if sketch and 2 * np.count_nonzero(counts) <= len(own) else needed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            hashes = [shingles(raw or b"", words) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            fps, sets = [folded(h) for h in hashes], [as_set(h) for h in hashes]
            columns = [pa.array(fps, pa.int64()), pa.array([sid for _, sid in sets], pa.int64()), pa.array([len(own) for own, _ in sets], pa.int64()), pa.array([prefix(own) for own, _ in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "fp", "sid", "n", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint, sid bigint, n bigint, prefix array<bigint>")


def with_sides(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The kept pairs (a, b) with a column of their sets as p and q; only the sets that are in a pair are shuffled."""
    wanted = keep(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sets-in-pairs")
    own = join_sized(sets.select("sid", name), wanted, "sid", "left_semi")
    side = lambda c, to: own.select(F.col("sid").alias(c), F.col(name).alias(to))
    return pairs.join(side("a", "p"), "a").join(side("b", "q"), "b")


def similar_links(docs: DataFrame, prefixes: DataFrame, words: int, similar: float = SIMILAR, text: str = "text") -> DataFrame:
    """(node, root) over the links between sets (sid, n, prefix) whose Jaccard similarity is at least ``similar``.

    Of the texts that share a shingle only those are compared that no link joins yet.
    In a large group each is first compared with a few, round by round, which joins
    most of them; what is left of a shingle's pairs is compared in full.  Whole sets are only fetched of pairs that
    may be similar by their counts (bins), which bound what they share; of all other sets nothing is shuffled.
    """
    spark = docs.sparkSession
    with scratch(spark):
        return _similar_links(spark, docs, prefixes, words, similar, text)


def _similar_links(spark: SparkSession, docs: DataFrame, prefixes: DataFrame, words: int, similar: float, text: str) -> DataFrame:
    dealt = keep(prefixes.select("sid", "n", F.posexplode("prefix").alias("pos", "s")), "prefixes")
    shared = dealt.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
    met = keep(dealt.join(shared, "s"), "shared-shingles")
    wanted = keep(met.select("sid").distinct(), "shared-sets")
    sets = keep(join_sized(shingle_sets(docs, words, text), wanted, "sid", "left_semi").groupBy("sid").agg(F.first(F.struct("shingles", "bins", "bits")).alias("x")).select("sid", "x.*"), "shingle-sets")
    roots = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))  # of no Python rows, which would take workers of their own
    # The most that two sets can share, if a shingle at these places is the first of it.
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    possible = (most * (1 + similar) >= (F.col("x.n") + F.col("y.n")) * similar - 1e-6) & (F.col("x.comp") != F.col("y.comp"))
    # Sets so similar differ in few members, and so in few bits of their signatures.
    unlike = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    alike = unlike * (1 + similar) <= (F.col("x.n") + F.col("y.n")) * (1 - similar) + 1e-6
    last = False
    enough = lambda common, p, q: common >= similar * (p + q - common) - 1e-9
    for k in range(ROUNDS + 1):
        with scratch(spark) as round_:
            named = met.join(roots, met["sid"] == roots["node"], "left").select(*met.columns, F.coalesce("root", "sid").alias("comp"))
            parts = named.groupBy("s", "comp").agg(F.count("*").alias("c"))
            buckets = parts.groupBy("s").agg(F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("comp", F.struct("c", "comp")).alias("top")).where("parts > 1")
            light = (F.col("c") * F.col("c") - F.col("squares") <= 2 * LIGHT * F.col("c")) | F.lit(last or k == ROUNDS)
            buckets = keep(buckets.select("s", "top", light.alias("light")), f"open-shingles-{k}")
            if buckets.isEmpty():
                break
            now = keep(named.join(buckets, "s"), f"open-places-{k}")
            # From the first round on what is left has its signatures, so that a large group's pairs become rows only if they may be similar.
            fits, fields = (possible & alike, ["sid", "n", "pos", "comp", "bits"]) if k else (possible, ["sid", "n", "pos", "comp"])
            member = F.struct(*fields)
            rest = now.where("comp <> top").select("s", member.alias("x"))
            whole = now.where("light").select("s", "top", member.alias("y"))
            pairs = rest.join(whole, "s").where(fits & ((F.col("y.comp") == F.col("top")) | (F.col("x.sid") < F.col("y.sid"))))
            pairs = pairs.select("x", "y")
            # At first no set is linked, and half of the centres are those with the fewest rarer shingles: what others are edits of.
            first = lambda i, k=k: F.col("comp") != F.col("top") if k else F.when(F.lit(2 * i < CENTRES), F.col("pos")).otherwise(0)
            order = lambda i, k=k: F.struct(first(i).alias("first"), F.xxhash64("sid", F.lit(k), F.lit(i)), *fields)
            centres = now.where("not light").groupBy("s").agg(*[F.min(order(i)).alias(f"c{i}") for i in range(CENTRES)])
            centres = centres.select("s", F.explode(F.array(*[F.struct(*[F.col(f"c{i}")[f].alias(f) for f in fields]) for i in range(CENTRES)])).alias("y"))
            pairs = pairs.union(rest.join(centres, "s").where(fits).select("x", "y"))
            pairs = keep(pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct(), f"pairs-{k}")
            bounded = with_sides(pairs, sets, "bins")
            total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x.cast("int"))
            shared = total(F.zip_with("p", "q", lambda x, y: F.least(x, y)))
            near = keep(bounded.where(F.coalesce(enough(shared, total(F.col("p")), total(F.col("q"))), F.lit(True))).select("a", "b"), f"near-pairs-{k}")
            held = with_sides(near, sets, "shingles")
            similar_ones = held.where(enough(F.size(F.array_intersect("p", "q")), F.size("p"), F.size("q"))).select("a", "b")
            new = keep(similar_ones, f"links-{k}")
            linked = new.count()
            last = linked * YIELD <= now.count()
            # What is linked already goes on as stars, which need no further rounds.
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)) if linked else roots
            # The pairs of light buckets are all settled.
            left = now.where("not light").select(*met.columns)
            met = keep(left if k else left.join(sets.select("sid", "bits"), "sid"), f"left-shingles-{k}")
            round_.hold(met)
    return roots


def group(docs: DataFrame, words: int, radius: int = RADIUS, key: str = "doc_id", text: str = "text", similar: float | None = SIMILAR, sketch: int | None = SKETCH) -> DataFrame:
    """(key, fp, component_id): the smallest key within reach of each row over links of similar sets of shingles, or without ``similar`` of fingerprints.

    With sketch None whole prefixes are compared, which finds every pair for certain and takes several times the disk.
    """
    by = "fp" if similar is None else "sid"
    with scratch(docs.sparkSession) as made:
        own = keep(fingerprints(docs, words, key, text) if similar is None else with_prefixes(docs, words, similar, key, text, sketch), "fingerprints")
        more = [] if similar is None else [F.first(c).alias(c) for c in ("n", "prefix")]
        first = keep(own.groupBy(by).agg(F.min(key).alias("first_key"), *more), "distinct-fingerprints")
        roots = components(links(first.select("fp"), radius)) if similar is None else similar_links(docs, first, words, similar, text)
        reached = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root")).distinct()
        linked = reached.join(first, reached["node"] == first[by]).select("node", "root", "first_key")
        least = linked.groupBy("root").agg(F.min("first_key").alias("component_id"))
        of = linked.join(least, "root").select(F.col("node").alias(by), "component_id")
        classes = keep(first.join(of, by, "left").select(by, F.coalesce("component_id", "first_key").alias("component_id")), "classes")
        made.hold(own, classes)
    # Of thousands of copies all rows have one fingerprint: a kept table leaves the join plain, so that it can be broadcast or split.
    return join_sized(own.select(*dict.fromkeys([key, "fp", by])), classes, by).select(key, "fp", "component_id")


def digests(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op6 returns."""
    return grouped.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
