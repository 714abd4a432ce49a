"""Centroid clustering by kd-tree filtering, in whole numbers.

Vectors become whole numbers, floor(scale * x).  Each task packs those of its
partition, BLOCK at a time, into kd-trees whose nodes hold a count, componentwise sums and
a bounding box; the trees are written once.  In each round every task walks its trees
with all centroids as candidates: at a node the candidate nearest to the middle of the
box is held against each other one at the corner of the box that favours that one most, and what is
strictly farther even there is dominated in the whole box and pruned.  A node with one candidate left is assigned
whole, by its count and sums; a leaf is resolved exactly.  Tasks return sums for each
centroid and not vectors, so a round moves (centroids x components) numbers for each
task, however many vectors there are, and a hot vector is only a deep node.

All of it is exact: distances are whole numbers, ties go to the smaller number (a candidate that is
only as near as another one is not dominated), and means are floors of exact sums.

Defined results: a null vector, or one of another length or with a null or non-finite
component, is not kept; repeated rows each count; a null id is clustered like any other and
stands for the empty text when first centroids are drawn; rows equal in id and vector are
interchangeable there; with fewer vectors than centroids each vector begins one; an empty table
gives no rows; a component of 2^27 or more after scaling is an error, as a squared distance
would have no long; only the id and the vector are read, so other names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import keep

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2:"
#: Vectors of a tree, and of a leaf.  These set the cost only.
BLOCK, LEAF = 4096, 32
LARGEST = 1 << 27

TREE = "ids array<bigint>, points array<bigint>, nodes array<bigint>, boxes array<bigint>"


def whole_numbers(df: DataFrame, size: int = SIZE, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, v): kept vectors as floor(scale * x)."""
    v = F.col(vector)
    sound = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("bigint"))
    return df.where(v.isNotNull() & sound).select(F.col(key).alias("id"), scaled.alias("v"))


def grown(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, points, nodes, boxes) of a kd-tree: rows in leaf order; (start, end, left, right) and (sums, low, high) of each node."""
    order, nodes, boxes = np.arange(len(x)), [], []

    def grow(start: int, end: int) -> int:
        part = x[order[start:end]]
        low, high = part.min(0), part.max(0)
        at = len(nodes)
        nodes.append([start, end, -1, -1])
        boxes.append(np.concatenate([part.sum(0), low, high]))
        widest = int(np.argmax(high - low))
        if end - start > leaf and high[widest] > low[widest]:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(part[:, widest], middle)]
            nodes[at][2:] = grow(start, start + middle), grow(start + middle, end)
        return at

    grow(0, len(x))
    return ids[order], x[order], np.array(nodes, np.int64), np.array(boxes, np.int64)


def plant(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Trees of the vectors (id, v), one in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.slice(at, block)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                if np.abs(x).max() >= LARGEST:
                    raise ValueError(f"a component of {LARGEST} or more has no squared distance that fits a long")
                # A null id is told by a mark beside the id.
                ids = np.where(part.column(0).is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                columns = [pa.array([c.ravel()], pa.list_(pa.int64())) for c in grown(ids, x)]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "points", "nodes", "boxes"])

    return vectors.mapInArrow(run, TREE)


def trees_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    for row in range(len(batch)):
        ids, points, nodes, boxes = (c[row].values.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield ids, points.reshape(-1, size), nodes.reshape(-1, 4), boxes.reshape(-1, 3, size)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the nearest centroid, the first of several, and its squared distance; exact."""
    far = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * far * far < 1 << 53:  # whole numbers up to here are exact in floating point
        d = (centroids.astype(float) ** 2).sum(1) - 2 * x.astype(float) @ centroids.T.astype(float)
        d = (d + (x.astype(float) ** 2).sum(1)[:, None]).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def surviving(candidates: np.ndarray, centroids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The candidates that may be nearest somewhere in the box, or as near as any."""
    own = centroids[candidates]
    best = own[((2 * own - (low + high)) ** 2).sum(1).argmin()]
    corner = np.where(own > best, high, low)
    return candidates[((own - corner) ** 2).sum(1) <= ((best - corner) ** 2).sum(1)]


def filtered(tree: tuple[np.ndarray, ...], centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(node, start, end, candidates, chosen): parts of a tree, each assigned whole (one candidate) or by leaf; chosen has an index for each row of a leaf."""
    _, points, nodes, boxes = tree
    todo = [(0, np.arange(len(centroids)))] if len(nodes) else []
    while todo:
        at, candidates = todo.pop()
        start, end, left, right = nodes[at].tolist()
        candidates = surviving(candidates, centroids, boxes[at, 1], boxes[at, 2])
        if len(candidates) == 1:
            yield at, start, end, candidates, np.zeros(0, np.int64)
        elif left < 0:
            yield at, start, end, candidates, candidates[nearest(points[start:end], centroids[candidates])[0]]
        else:
            todo += [(left, candidates), (right, candidates)]


def gathered(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, total): of each centroid the sums of its vectors' components, and at place -1 their number."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for tree in trees_of(batch, size):
                for at, start, end, candidates, chosen in filtered(tree, centroids):
                    if len(chosen):
                        np.add.at(sums, chosen, tree[1][start:end])
                        np.add.at(counts, chosen, 1)
                    else:
                        sums[candidates[0]] += tree[3][at, 0]
                        counts[candidates[0]] += end - start
        used = np.flatnonzero(counts)
        values = np.concatenate([counts[used, None], sums[used]], 1)
        columns = [np.repeat(used, size + 1), np.tile(np.arange(-1, size), len(used)), values.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "place", "total"])

    parts = trees.mapInArrow(run, "cluster bigint, place bigint, total bigint")
    return parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def first_centroids(vectors: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and id."""
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of each kept vector, final centroids)."""
    spark = df.sparkSession
    vectors = whole_numbers(df, size, scale, key, vector)
    centroids = first_centroids(vectors, k)
    kind = df.schema[key].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance bigint"), centroids
    trees = keep(plant(vectors), "trees")
    for _ in range(rounds):
        # At most k rows for each component: no more than the centroids themselves.
        found = {(r["cluster"], r["place"]): int(r["total"]) for r in gathered(trees, centroids).collect()}
        for c in range(len(centroids)):
            if n := found.get((c, -1), 0):
                centroids[c] = [found[c, i] // n for i in range(size)]
    last = centroids.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in trees_of(batch, size):
                to = np.zeros(len(tree[0]), np.int64)
                for _, start, end, candidates, chosen in filtered(tree, last):
                    to[start:end] = chosen if len(chosen) else candidates[0]
                away = ((tree[1] - last[to]) ** 2).sum(1)
                ids = pa.array(tree[0], pa.int64(), mask=tree[0] == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(away, pa.int64())], names=["id", "cluster", "distance"])

    told = trees.mapInArrow(run, "id bigint, cluster int, distance bigint")
    return told.select(F.col("id").cast(kind).alias(key), "cluster", "distance"), last


def named(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def digests(clustered: tuple[DataFrame, np.ndarray], key: str = "vec_id") -> DataFrame:
    """What op13 returns."""
    told, centroids = clustered
    told = keep(told, "clustered") if len(centroids) else told
    # One row for each centroid.
    spread = {r["cluster"]: int(r["d"]) for r in told.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    entry = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>")
    at = lambda values, kind: F.get(entry(values, kind), F.col("cluster"))
    own: Column = at([spread.get(c, 0) for c in range(len(centroids))], "bigint")
    return told.select(key, "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(spread.values())).cast("bigint").alias("inertia"), at([named(c) for c in centroids], "string").alias("centroid_sha256"))


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> str:
    """The same in SQL, by all distances."""
    nearest_of = lambda r: f"""
far{r} AS MATERIALIZED (SELECT v.i, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM parts v JOIN c{r} c ON v.p = c.p GROUP BY v.i, c.k),
own{r} AS MATERIALIZED (SELECT i, k, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, k) = 1)"""  # noqa: E731
    moved = lambda r: f"""
sums{r} AS MATERIALIZED (SELECT k, p, sum(x) AS s, count(*) AS n FROM own{r} JOIN parts USING (i) GROUP BY k, p),
c{r + 1} AS MATERIALIZED (SELECT k, p, CASE WHEN n IS NULL THEN x ELSE ((s - (((s % n) + n) % n)) // n)::BIGINT END AS x FROM c{r} LEFT JOIN sums{r} USING (k, p))"""  # noqa: E731
    steps = "".join(nearest_of(r) + "," + moved(r) + "," for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {size} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {size}),
parts AS MATERIALIZED (SELECT i, unnest(v) AS x, unnest(range(1, {size + 1})) AS p FROM kept),
firsts AS (SELECT row_number() OVER (ORDER BY sha256('{seed}' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v FROM kept ORDER BY k LIMIT {k}),
c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, unnest(range(1, {size + 1})) AS p FROM firsts),{steps}{nearest_of(rounds)},
names AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM own{rounds} JOIN kept USING (i) JOIN names USING (k)"""
