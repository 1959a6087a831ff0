"""Centroid clustering (Lloyd's rounds over whole numbers) with partition-local ball trees.

Vectors are turned into whole numbers once and gathered, partition by partition, into blocks of up to BLOCK rows. Each block
becomes a metric tree: a ball holds a run of the block's vectors, with its count, the integer sum of its
vectors and the radius around their mean. Trees are written once to the shared folder; every round reads them.

In a round the centroids that may be nearest to some vector of a ball are narrowed on the way down: by the triangle
inequality all vectors of a ball of radius r around m are nearer to y than to z if |m - y| + r < |m - z| - r. Once
one centroid is left the whole ball goes to it by its count and sum. Balls of LEAF vectors or fewer are settled vector by
vector, in whole numbers, among the centroids left, so results are those of exhaustive assignment, ties
included. Tasks send a row for each block and centroid, added up before the shuffle; the driver sees one row a centroid.

Vectors with other than width components, or with null or non-finite ones, take no part. Rows without
an id are clustered, but are no starting centroids; rows that share an id are vectors each for itself, and start in the order of
their components. With fewer vectors than centroids there are as many centroids as vectors. Numbers beyond 2**50 are
held there, and distances and their sums at the largest long. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, vectors

BLOCK, LEAF = 4096, 16
EVEN = 32  # a ball is halved if its nearer ends would part it more unevenly
LARGEST = 1 << 50
PLAIN = 1 << 27  # up to here squared distances of 64 components fit a long
LONG = (1 << 63) - 1
TREES = "ids array<long>, width int, points array<long>, first array<int>, last array<int>, child array<int>, radius array<double>, sum array<long>"


@dataclass
class Tree:
    """A block's vectors in the order of their balls; ball 0 holds all, child is the first of a ball's two (0: a leaf)."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    sum: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the places in points that its vectors come from."""
        order = np.arange(len(points))
        balls, child, radius, sums = [(0, len(points))], [], [], []
        for first, last in balls:  # grows on the way
            own = points[order[first:last]]
            total = own.sum(axis=0)
            away = own - total / len(own)
            far = np.einsum("ij,ij->i", away, away)
            sums.append(total)
            radius.append(float(np.sqrt(far.max())))
            if len(own) <= LEAF or not radius[-1]:
                child.append(0)
                continue
            one = away[far.argmax()]
            other = away[((away - one) ** 2).sum(axis=1).argmax()]
            along = away @ (other - one)
            half = int((along < (along[far.argmax()] + (other @ (other - one))) / 2).sum())  # those nearer to one
            if half * EVEN < len(own) or (len(own) - half) * EVEN < len(own):
                half = len(own) // 2
            order[first:last] = order[first:last][np.argpartition(along, half)]
            child.append(len(balls))
            balls += [(first, first + half), (first + half, last)]
        first, last = np.array(balls).T
        return cls(points[order], first, last, np.array(child), np.array(radius), np.array(sums)), order

    def settle(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For each vector its centroid; the balls that went whole and the vectors that were settled one by one; how many distances that took."""
        cluster = np.full(len(self.points), -1)
        middle = self.sum / (self.last - self.first)[:, None]
        z = centroids.astype(np.float64)
        loose, balls, alive, work, whole = [], np.zeros(1, np.int64), np.ones((1, len(z)), bool), 0, []
        while len(balls):
            work += int(alive.sum())
            m, r = middle[balls], self.radius[balls]
            size = np.sqrt((m * m).sum(axis=1))[:, None] + np.sqrt((z * z).sum(axis=1))
            d = np.sqrt(np.maximum(0, (m * m).sum(axis=1)[:, None] - 2 * m @ z.T + (z * z).sum(axis=1)))
            give = 1e-6 * size + r[:, None] * (1 + 1e-6)  # more than rounding can be off
            farthest = np.where(alive, d + give, np.inf).min(axis=1)
            alive = alive & (d - give <= farthest[:, None])
            one = alive.sum(axis=1) == 1
            for b in np.flatnonzero(one):
                cluster[self.first[balls[b]] : self.last[balls[b]]] = alive[b].argmax()
            whole.append(balls[one])
            leaf = ~one & (self.child[balls] == 0)
            loose += [(np.arange(self.first[balls[b]], self.last[balls[b]]), alive[b]) for b in np.flatnonzero(leaf)]
            down = ~one & ~leaf
            children = self.child[balls[down]]
            balls, alive = np.concatenate([children, children + 1]), np.concatenate([alive[down]] * 2)
        at = np.concatenate([a for a, _ in loose]) if loose else np.empty(0, np.int64)
        if len(at):
            may = np.repeat(np.stack([m for _, m in loose]), [len(a) for a, _ in loose], axis=0)
            work += int(may.sum())
            best = None
            for j in range(len(centroids)):
                d = np.full(len(at), LONG, dtype=self.points.dtype)
                d[may[:, j]] = squared(self.points[at[may[:, j]]], centroids[j])
                nearer = may[:, j] if best is None else may[:, j] & ((d < best) | (cluster[at] < 0))
                best = d if best is None else np.where(nearer, d, best)
                cluster[at[nearer]] = j
        return cluster, np.concatenate(whole), at, work


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((points - centroid) ** 2).sum(axis=1)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are, or of Python's integers where squared distances may be beyond a long."""
    most = max((int(np.abs(a).max(initial=0)) * (a.shape[-1] / 64) ** 0.5 for a in arrays), default=0)
    return [a.astype(object) if most > PLAIN else a for a in arrays]


def trees(rows: DataFrame, scale: float, width: int) -> DataFrame:
    """A row for each block of rows (id, v): its ids, its tree. Written to the shared folder."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(first, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    together = pa.Table.from_batches(held)
                    yield block(together.slice(0, BLOCK))
                    held = together.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    def block(table: pa.Table) -> pa.RecordBatch:
        points = np.clip(np.floor(scale * vectors.matrix(table["v"], width)), -LARGEST, LARGEST).astype(np.int64)
        tree, order = Tree.over(points)
        lists = [np.asarray(x).ravel() for x in (tree.points, tree.first, tree.last, tree.child, tree.radius, tree.sum)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
        ids = table["id"].combine_chunks().take(pa.array(order))
        lists = [pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([width], pa.int32()), *lists], names=["ids", "width", "points", "first", "last", "child", "radius", "sum"])

    return common.save(rows.mapInArrow(blocks, TREES), "ball-trees")


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        width = batch["width"][i].as_py()
        points, first, last, child, radius, total = (np.asarray(batch[c][i].values) for c in ("points", "first", "last", "child", "radius", "sum"))
        yield batch["ids"][i].values, Tree(points.reshape(-1, width), first, last, child, radius, total.reshape(-1, width))


def sums(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, s0, s1, ...: count and componentwise sum of each centroid's vectors; work: the distances that all of it took, in centroid 0's row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        for batch in batches:
            for _, tree in _trees(batch):
                tree.points, z = exact(tree.points, centroids)
                cluster, whole, loose, work = tree.settle(z)
                n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
                np.add.at(n, cluster[tree.first[whole]], (tree.last - tree.first)[whole])
                np.add.at(total, cluster[tree.first[whole]], tree.sum[whole])
                np.add.at(n, cluster[loose], 1)
                np.add.at(total, cluster[loose], tree.points[loose].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array([work] + [0] * (k - 1), pa.int64()), *map(pa.array, total.T.copy())], names=["cluster", "n", "work", *(f"s{i}" for i in range(width))])

    columns = [f"s{i}" for i in range(centroids.shape[1])]
    partial = held.mapInArrow(run, "cluster int, n long, work long, " + ", ".join(f"{c} long" for c in columns))
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("work").alias("work"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in columns))


def assign(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch):
                tree.points, z = exact(tree.points, centroids)
                cluster = tree.settle(z)[0]
                distance = np.empty(len(cluster), np.int64)
                for j in np.unique(cluster):
                    distance[cluster == j] = np.minimum(squared(tree.points[cluster == j], z[j]), LONG)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return held.mapInArrow(run, "vec_id long, cluster int, distance long")


def starts(rows: DataFrame, k: int, seed: int, scale: float) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:id`."""
    named = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    picked = named.orderBy("h", "v").limit(k).collect()
    return np.array([np.clip(np.floor(scale * np.array(r["v"])), -LARGEST, LARGEST) for r in picked]).astype(np.int64)


def cluster(table: DataFrame, k: int, rounds: int, scale: float, width: int, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector after so many rounds and a last assignment."""
    spark = table.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where((F.size("v") == width) & finite)
    centroids = starts(rows, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    held = trees(rows, scale, width)
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in sums(held, centroids).where("n > 0").collect():  # a row a centroid
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    assigned = common.save(assign(held, centroids), "assigned-vectors")
    common.drop_saved(held)
    per = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, z.tolist())).encode()).hexdigest() for z in centroids]
    named = spark.createDataFrame([(j, min(LONG, s), min(LONG, sum(per.values())), digest[j]) for j, s in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 16, 3, 64.0, 64)


def _sql(k: int, rounds: int, width: int, scale: int, seed: int) -> str:
    """Exhaustive assignment, round after round."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {width} AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
), v AS MATERIALIZED (
  SELECT r, vec_id, unnest(range({width})) AS i, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x FROM kept
), picked AS (
  SELECT r, (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INTEGER AS cluster FROM kept WHERE vec_id IS NOT NULL
), z0 AS MATERIALIZED (
  SELECT cluster, i, x AS z FROM picked JOIN v USING (r) WHERE cluster < {k}
)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""d{n} AS (
  SELECT r, cluster, sum((x - z) * (x - z))::BIGINT AS distance FROM v JOIN z{n} USING (i) GROUP BY r, cluster
), a{n} AS MATERIALIZED (
  SELECT r, cluster, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (
  SELECT cluster, i, sum(x)::HUGEINT AS s, count(*) AS c FROM v JOIN a{n} USING (r) GROUP BY cluster, i
), z{n + 1} AS MATERIALIZED (
  SELECT cluster, i, coalesce((s - ((s % c) + c) % c) // c, z)::BIGINT AS z FROM z{n} LEFT JOIN m{n} USING (cluster, i)
)"""
            )
    steps.append(f"h AS (SELECT cluster, sha256(string_agg(z::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM z{rounds} GROUP BY cluster)")
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (cluster)
"""
    )


OP11_SQL = _sql(16, 3, 64, 64, 1)
