"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks of bounded size; each pair of blocks is one cell. In a
cell the candidates become postings (for each term, which rows have it and with what weight), each
sparse query row adds its weighted postings into a dense score array, and the cell's best k are
taken by partition selection. The cells' lists are then merged for each query.

Every candidate is scored. Blocks are dealt by a hash of the row's number, so equal ids or vectors never gather in one.
Rows are copied once for each block of the other side, so blocks grow with the table, up to LARGEST_CELL rows.
Rows without an id, null vectors and vectors with null or non-finite components take no part; a
shorter vector has zero for the terms it lacks. Rows that bear the query's id are the query's own and
are no candidates of it; of repeated rows each is a candidate. Scores beyond a long are held at its
limits. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common, vectors

CANDIDATES_A_CELL = 4096
LARGEST_CELL = 65_536
MANY_BLOCKS = 256  # enough for all executors; with more, blocks are larger instead
FOUND = "qrow long, query_id long, vec_id long, score long"


def _score_cell(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int):
    for row in queries:
        scores = np.zeros(n, row.dtype)
        for t in np.flatnonzero(row):
            at, weights = postings[t]
            scores[at] += row[t] * weights
        yield scores


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, scale: float | None = None) -> DataFrame:
    """The k candidates of highest inner product with each query: query_id, rank, vec_id, score (long).

    queries, candidates: (id long, v array<double>), as vectors.usable() gives them; components become
    floor(scale * x), or floor(x) without scale.
    """
    n_cand, n_query = candidates.count(), queries.count()
    cand_blocks = max(1, min(MANY_BLOCKS, -(-n_cand // CANDIDATES_A_CELL)), -(-n_cand // LARGEST_CELL))
    query_blocks = max(1, -(-n_query // LARGEST_CELL))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = F.monotonically_increasing_id()
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = queries.select("id", "v", row.alias("row")).select("id", "v", F.col("row").alias("qrow"), dealt(query_blocks).alias("qb"), every(cand_blocks).alias("cb"))
    right = candidates.select("id", "v", row.alias("row")).select("id", "v", dealt(cand_blocks).alias("cb"), every(query_blocks).alias("qb"))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if q.num_rows and c.num_rows:
            ids, qids, qrows = (np.asarray(x) for x in (c["id"], q["id"], q["qrow"]))
            a, b = np.floor(vectors.matrix(q["v"]) * (scale or 1)), np.floor(vectors.matrix(c["v"]) * (scale or 1))
            width = min(a.shape[1], b.shape[1])
            a, b = a[:, :width], b[:, :width]
            most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
            if most < 2**62:
                a, b = a.astype(np.int64), b.astype(np.int64)
            else:  # beyond a long: Python's integers
                a, b = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b))
            postings = [((at := np.flatnonzero(b[:, t])), b[at, t]) for t in range(width)]
            for i, scores in enumerate(_score_cell(a, postings, len(ids))):
                other = ids != qids[i]
                own_ids, own_scores = (ids, scores) if other.all() else (ids[other], scores[other])
                best = vectors.best_first(own_scores, own_ids, k)
                found += [(qrows[i], qids[i], v, max(-(2**63), min(2**63 - 1, int(s)))) for v, s in zip(own_ids[best], own_scores[best])]
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("qrow", "query_id", "vec_id", "score"), columns)})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(cell, FOUND)
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.usable(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return exact_top_k(rows.where(F.col("id") % 50 == 0), rows, 5, 256.0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
