"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Shells: rows are told apart by the power of two of their length, since long vectors are neighbours of queries that
point elsewhere. Each shell has the same centroids, and a list is a centroid's rows of one shell.

Fitting: SAMPLE vectors at most (by row hash). One half, different directions only, is split at medians into balanced
cells whose means, moved a little under a penalty for large cells, are the centroids: about 4 sqrt(N), MOST_LISTS at
most. A graph joins each centroid to its nearest ones; it is searched in memory, best first from a few entries,
a batch at a time. The other half tells for each shell up to which ratio of distances lists must be read so that
TARGET of the true neighbours is found, taking as many neighbours as lie within the same distance among all rows.

Lists: every row goes to its nearest centroid and, being near a boundary, to others up to BOUNDARY times as far,
REPLICAS in all. A query reads a shell's lists whose centroids are up to the shell's ratio as far as its WALK-th nearest one. A shell
that no sampled row is in is read whole. Queries that find fewer than k are completed over all rows. Recall is tested
against brute force; work() tells how many pairs are scored.

A list is dealt into blocks of bounded size, and so are the queries that read it, so that neither a hot list nor
a hot query is one task's. In a block scores are a matrix product; the best are scored anew, each row by itself in
double precision, so equal vectors have equal scores wherever they lie. Only centroids, graph and list sizes are
on the driver or broadcast: MOST_LISTS rows for a shell, whatever the table.

Rows without an id and null, zero or not wholly finite vectors take no part; a shorter vector has zeros for the
components it lacks. Rows that bear the query's id are no candidates of it; of repeated rows each is one. Ties go to the smaller
id. A query has fewer than k rows only if there are fewer candidates. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common, vectors

MOST_LISTS = 2048
SAMPLE = 65_536
MEMBERS_A_LIST = 16  # of the sample's first half, at least
REPLICAS = 4
BOUNDARY = 1.15
FARTHEST = 1e300  # a ratio that any list is within
TARGET = 0.94
NEIGHBOURS = 24
WALK = 32  # centroids that a walk keeps in view
ASKED = 512
CELL_VECTORS, CELL_QUERIES = 8192, 2048
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratios: dict[int, float] = field(default_factory=dict)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions, as wide as the centroids, and shells."""
        largest = np.abs(x).max(axis=1, initial=0, keepdims=True)
        scaled = x / largest
        length = np.sqrt((scaled**2).sum(axis=1, keepdims=True))
        shells = np.floor(np.log2(largest[:, 0]) + np.log2(length[:, 0])).astype(np.int64)
        width, out = self.centroids.shape[1], scaled / length
        return (out[:, :width] if out.shape[1] >= width else np.hstack([out, np.zeros((len(out), width - out.shape[1]))])), shells

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 1 + (points**2).sum(axis=1)[:, None] - 2 * points @ self.centroids.T))

    def reference(self, d: np.ndarray) -> np.ndarray:
        """The distance that ratios count from: that of the WALK-th nearest centroid, which varies less than the nearest one's."""
        at = min(WALK, len(self.centroids)) - 1
        return np.partition(d, at, axis=1)[:, at]

    def search(self, points: np.ndarray, ratio: float = 1.0) -> np.ndarray:
        """Distances to the centroids that a best-first walk over the graph meets (inf: not met).

        A point's walk ends when the nearest centroid not yet gone through is farther than the WALK-th nearest met, and
        than ratio times that.
        """
        if not math.isfinite(ratio):
            return self.distances(points)
        k, n = len(self.centroids), len(points)
        d, gone = np.full((n, k), np.inf), np.zeros((n, k), bool)
        own = 1 + (points**2).sum(axis=1)
        every = np.arange(n)
        d[:, self.entries] = np.sqrt(np.maximum(0, own[:, None] - 2 * points @ self.centroids[self.entries].T))
        while len(every):
            open_ = np.where(gone[every], np.inf, d[every])
            at = open_.argmin(axis=1)
            now = open_[np.arange(len(every)), at]
            go = np.isfinite(now) & (now <= self.reference(d[every]) * max(1.0, ratio))
            every, at = every[go], at[go]
            gone[every, at] = True
            near = self.graph[at]
            met = np.sqrt(np.maximum(0, own[every, None] - 2 * np.einsum("ij,ikj->ik", points[every], self.centroids[near])))
            d[every[:, None], near] = met
        return d


def _balanced(x: np.ndarray, n_lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of unit length of n_lists cells of about equal size."""
    cells = [np.arange(len(x))]
    while len(cells) < n_lists:
        cells.sort(key=len)
        own = cells.pop()
        two = x[rng.choice(own, 2, replace=False)]
        for _ in range(4):
            first = np.argsort(x[own] @ (two[1] - two[0]), kind="stable")
            half = len(own) // 2
            two = np.stack([x[own[first[:half]]].mean(axis=0), x[own[first[half:]]].mean(axis=0)])
        cells += [own[first[:half]], own[first[half:]]]
    centroids, penalty = np.stack([x[c].mean(axis=0) for c in cells]), np.zeros(n_lists)
    for _ in range(4):
        near, least = np.empty(len(x), np.int64), 0.0
        for first in range(0, len(x), 4096):
            d = 1 - 2 * x[first : first + 4096] @ centroids.T + (centroids**2).sum(axis=1)
            near[first : first + 4096] = (d + penalty).argmin(axis=1)
            least += d.min(axis=1).sum()
        sizes = np.bincount(near, minlength=n_lists)
        penalty += 0.05 * least / len(x) * (sizes * n_lists / len(x) - 1)
        some = np.flatnonzero(sizes)
        sums = np.add.reduceat(x[np.argsort(near, kind="stable")], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0)
        centroids[some] = sums / sizes[some, None]
    lengths = np.sqrt((centroids**2).sum(axis=1, keepdims=True))
    return np.where(lengths > 1e-12, centroids / np.maximum(lengths, 1e-12), x[: len(centroids)])


def _replicas(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: each row's nearest list and those of its boundary."""
    nearest = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
    far = np.take_along_axis(d, nearest, axis=1)
    row, column = np.nonzero(np.isfinite(far) & (far <= far[:, :1] * BOUNDARY))
    return row, nearest[row, column]


def _calibrate(index: Index, x: np.ndarray, k: int, target: float) -> dict[int, float]:
    """For each shell of x the ratio at which target of the k nearest of some of x are found (0: none of them is in it)."""
    asked = x[:ASKED]
    scale = np.abs(x).max()
    scores = (asked / scale) @ (x / scale).T
    np.fill_diagonal(scores[:, : len(asked)], -np.inf)
    k = max(1, min(k, len(x) - 1))
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    met, back = np.unique(true, return_inverse=True)
    directions, shells = index.split(x[met])
    holds = np.zeros((len(met), len(index.centroids)), bool)
    for first in range(0, len(met), 2048):
        row, at = _replicas(index.search(directions[first : first + 2048]))
        holds[first + row, at] = True
    d = index.distances(index.split(asked)[0])
    reach = index.reference(d)
    nearest = np.stack([np.where(holds[b], one, np.inf).min(axis=1) for b, one in zip(back.reshape(true.shape), d)])
    # one that lies on a centroid is at no distance from its own lists and infinitely far from all others
    needed = np.divide(nearest, reach[:, None], out=np.where(nearest > 0, np.inf, 1.0), where=reach[:, None] > 0)
    of_shell = shells[back.reshape(true.shape)]
    ratios = {}
    for s in np.unique(of_shell):
        own = needed[of_shell == s]
        # few neighbours tell little about the rest of their shell, so more of them must be found
        least = np.sort(own)[math.ceil(min(1.0, target + 0.5 / math.sqrt(len(own))) * (len(own) - 1))]
        ratios[int(s)] = min(float(least), FARTHEST) + 1e-9
    return ratios


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, most_lists: int = MOST_LISTS, target: float = TARGET) -> Index | None:
    """rows: (id, v), as vectors.usable() gives them without zero vectors; k: how many neighbours will be asked for."""
    total = rows.count()
    wanted = 1 << math.ceil(math.log2(4 * math.sqrt(total))) if total else 0
    got = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(min(sample, 2 * MEMBERS_A_LIST * min(most_lists, wanted) + ASKED)).toArrow() if total else None
    if got is None or not got.num_rows:
        return None
    rng = np.random.default_rng(0)
    x = vectors.matrix(got["v"])
    x = x[rng.permutation(len(x))]
    index = Index(np.zeros((1, x.shape[1])), np.zeros((1, 1), np.int64), np.zeros(1, np.int64))
    learnt, checked = (x[: len(x) // 2], x[len(x) // 2 :]) if len(x) > 1 else (x, x)
    directions = np.unique(index.split(learnt)[0], axis=0)
    directions = directions[rng.permutation(len(directions))]
    n = max(1, min(most_lists, wanted, len(directions) // MEMBERS_A_LIST))
    index.centroids = _balanced(directions, n, rng)
    near = np.argsort(-(index.centroids @ index.centroids.T), axis=1)[:, 1 : NEIGHBOURS + 1]
    # beside the nearest some at random, so that all is connected
    index.graph = np.hstack([near, rng.integers(0, n, (n, 8))]) if n > 1 else np.zeros((1, 1), np.int64)
    index.entries = rng.choice(n, min(n, 8), replace=False)
    # among all rows k neighbours lie as near as this many of the rows at hand
    index.ratios = _calibrate(index, checked, math.ceil(k * len(checked) / total), target)
    every = np.unique(index.split(x)[1]).tolist()
    index.ratios = {s: index.ratios.get(s, 0.0) for s in every}
    return index


def _assigned(rows: DataFrame, shared, shells: list[int] | None) -> DataFrame:
    """row, id, v and list: a row for each list that a row is in, or, if shells are given, that it reads as a query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        n = len(own.centroids)
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                directions, of = own.split(vectors.matrix(batch["v"]))
                if shells is None:
                    row, at = _replicas(own.search(directions))
                    lists = of[row] * n + at
                else:
                    ratios = {s: own.ratios.get(s, math.inf) for s in shells}
                    d = own.search(directions, max(ratios.values()))
                    reach = own.reference(d)[:, None]
                    read = [(np.nonzero(np.isfinite(d) & (d <= reach * ratio)), s) for s, ratio in ratios.items()]
                    row, lists = (np.concatenate(c) for c in zip(*((r, s * n + at) for (r, at), s in read)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch["row"].take(take), batch["id"].take(take), batch["v"].take(take), pa.array(lists, pa.int64())], names=["row", "id", "v", "list"])

    return rows.mapInArrow(run, "row long, id long, v array<double>, list long")


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")


def _members(rows: DataFrame, shared) -> DataFrame:
    return common.save(_assigned(_marked(rows), shared, None), "posting-lists")


def _shells(members: DataFrame, index: Index) -> list[int]:
    """The shells of all rows: a number for each power of two a double may have, at most."""
    return [r[0] for r in members.select(F.floor(F.col("list") / len(index.centroids)).cast("int").alias("s")).distinct().collect()]


def work(queries: DataFrame, rows: DataFrame, index: Index) -> int:
    """How many pairs of a query and a list's row a search scores, before it completes queries that lack some."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    members = _members(rows, shared)
    asked = _assigned(_marked(queries), shared, _shells(members, index))
    both = members.groupBy("list").count().join(asked.groupBy("list").agg(F.count("*").alias("asked")), "list")
    return both.agg(F.sum(F.col("count") * F.col("asked"))).first()[0] or 0


def _score(asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """row (the query's), query_id, other (the candidate's row), vec_id, score: each query's best k of each block it meets."""
    # a row a list: how many blocks its members and its queries make
    sizes = members.groupBy("list").agg(F.ceil(F.count("*") / CELL_VECTORS).cast("int").alias("blocks"))
    sizes = sizes.join(asked.groupBy("list").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("qblocks")), "list")
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "list").withColumn("qb", dealt("qblocks")).select("list", "qb", "id", "row", "v", every("blocks").alias("b"))
    right = members.join(sizes, "list").withColumn("b", dealt("blocks")).select("list", "b", "id", "row", "v", every("qblocks").alias("qb"))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and c.num_rows:
            ids, rids, qids, qrows = (np.asarray(x) for x in (c["id"], c["row"], q["id"], q["row"]))
            a, b = vectors.matrix(q["v"]), vectors.matrix(c["v"])
            width = min(a.shape[1], b.shape[1])
            a, b = np.ascontiguousarray(a[:, :width]), np.ascontiguousarray(b[:, :width])
            for first in range(0, len(a), 256):
                rough = a[first : first + 256] @ b.T
                rough[ids[None, :] == qids[first : first + 256, None]] = -np.inf
                slack = 1e-9 * (1 + np.abs(rough, where=rough > -np.inf, out=np.zeros_like(rough)).max(initial=0))
                cut = np.partition(rough, len(b) - k, axis=1)[:, len(b) - k] - slack if len(b) > k else np.full(len(rough), -np.inf)
                for i, scores in enumerate(rough, first):
                    at = np.flatnonzero((scores >= cut[i - first]) & (scores > -np.inf))
                    exact = (b[at] * a[i]).sum(axis=1)
                    best = vectors.best_first(exact, ids[at], k)
                    out.append((qrows[i], qids[i], rids[at[best]], ids[at[best]], exact[best]))
        columns = list(zip(*out)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("row", "query_id", "others", "ids", "scores"), columns, types)})

    found = left.groupBy("list", "b", "qb").cogroup(right.groupBy("list", "b", "qb")).applyInArrow(cell, "row long, query_id long, others array<long>, ids array<long>, scores array<double>")
    found = found.select("row", "query_id", F.explode(F.arrays_zip("others", "ids", "scores")).alias("f"))
    return found.select("row", "query_id", F.col("f.others").alias("other"), F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))


def search(queries: DataFrame, rows: DataFrame, k: int, index: Index) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product found for each query."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # MOST_LISTS centroids at most
    members = _members(rows, shared)
    marked = common.save(_marked(queries), "queries")
    asked = common.save(_assigned(marked, shared, _shells(members, index)), "probed-lists")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")

    def ranked(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")

    found = common.save(ranked(_score(asked, members, k)), "found-neighbours")
    common.drop_saved(members, asked)
    short = common.save(marked.join(found.where(F.col("rank") == k).select("row"), "row", "left_anti"), "short-queries")
    if short.isEmpty():
        return found.drop("row")
    # few, or the table is small: each against all rows
    alone = F.lit(0).cast("long").alias("list")
    rest = ranked(_score(short.select("row", "id", "v", alone), _marked(rows).select("row", "id", "v", alone), k))
    return found.join(short.select("row"), "row", "left_anti").unionByName(rest).drop("row")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.usable(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")).where(F.exists("v", lambda x: x != 0))
    index = fit(rows, 20)
    if index is None:
        return spark.createDataFrame([], RESULT)
    return search(rows.where(F.col("id") % 20 == 0), rows, 20, index)
