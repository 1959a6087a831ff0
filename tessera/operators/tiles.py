"""Joins of rectangles by tiles that adapt to where they lie, on both axes at once.

A rectangle is (id, side, c1, c2, lo1, hi1, lo2, hi2), its ends included; those of side 0 are joined with those of side 1 that
they meet on the same plane (c1, c2); one that ends before it begins meets nothing. A quadtree is made from a sample (SAMPLE rectangles at most, a number of the
driver's memory and nothing else): a tile is parted while it is estimated to hold more than MOST rectangles, unless parting it would
copy many of them because they are as large as the tile. Below the sample's grain tiles go on being parted alike, by rule. A rectangle is dealt to all tiles that it
meets; a pair is found in the one tile that has the lower corner of what both share, so pairs are found once.

Tiles that hold many rectangles for all that (one place, or large rectangles on top of each other) are cut into
runs of both sides, each pair of runs being a task's work, so no task gets a whole hot tile. Within a tile both sides are sorted along the first axis
and swept: of each the runs of the other that begin within it are compared on the second axis, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import checkpointed

SAMPLE = 1 << 15
MOST = 4096
COPIES = 1.5  # of the rectangles of a tile, by parting it
PAIRS_AT_ONCE = 1 << 20
CORNERS = ["lo1", "hi1", "lo2", "hi2"]
DEALT = "plane int, tile long, tx long, ty long, id long, side int, c1 int, c2 int, lo1 long, hi1 long, lo2 long, hi2 long"


@dataclass
class Quadtree:
    """Square nodes of a plane: lower corner x, y, side length, first of four children (0: a leaf), and into how many alike tiles a leaf is parted along an axis."""

    x: list[int]
    y: list[int]
    size: list[int]
    child: list[int]
    parts: list[int]

    @classmethod
    def over(cls, rects: np.ndarray, weight: float, most: int) -> Quadtree:
        """rects: rows of CORNERS, each standing for weight rectangles."""
        low = int(rects.min())
        span = max(1, int(rects.max()) - low + 1)
        tree = cls([low], [low], [1 << (span - 1).bit_length()], [], [])
        held = [rects]
        for node, own in enumerate(held):  # grows on the way
            size, x, y = tree.size[node], tree.x[node], tree.y[node]
            inside, half = [], size // 2
            if len(own) * weight > most and len(own) > 8 and half:
                corners = [(x, y), (x + half, y), (x, y + half), (x + half, y + half)]
                inside = [own[(own[:, 0] < cx + half) & (own[:, 1] >= cx) & (own[:, 2] < cy + half) & (own[:, 3] >= cy)] for cx, cy in corners]
            if inside and sum(map(len, inside)) <= COPIES * len(own):
                tree.child.append(len(held))
                tree.parts.append(1)
                for (cx, cy), some in zip(corners, inside):
                    tree.x.append(cx), tree.y.append(cy), tree.size.append(half)
                    held.append(some)
            else:
                tree.child.append(0)
                wide = float(np.median(np.maximum(own[:, 1] - own[:, 0], own[:, 3] - own[:, 2]))) + 1 if len(own) else size
                wanted = max(1.0, (len(own) * weight / most) ** 0.5)
                parts = int(min(wanted, max(1.0, size / (4 * wide)), size)) if not inside else 1
                tree.parts.append(1 << (parts.bit_length() - 1))
        return tree

    def deal(self, rects: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each rectangle and tile that it meets: its place in rects, the leaf, and the tile's place there."""
        x, y, size, child, parts = (np.array(v, np.int64) for v in (self.x, self.y, self.size, self.child, self.parts))
        end = self.x[0] + self.size[0] - 1, self.y[0] + self.size[0] - 1
        lo1, hi1, lo2, hi2 = (np.clip(rects[:, i], (x, y)[i // 2][0], end[i // 2]) for i in range(4))  # what the sample hasn't seen lies in the outermost tiles
        at, node, found = np.arange(len(rects)), np.zeros(len(rects), np.int64), []
        while len(at) or not found:
            leaf = child[node] == 0
            found.append((at[leaf], node[leaf]))
            at, node = np.repeat(at[~leaf], 4), (child[node[~leaf]][:, None] + np.arange(4)).ravel()
            meets = (lo1[at] < x[node] + size[node]) & (hi1[at] >= x[node]) & (lo2[at] < y[node] + size[node]) & (hi2[at] >= y[node])
            at, node = at[meets], node[meets]
        at, node = (np.concatenate(v) for v in zip(*found))
        width = size[node] // parts[node]
        first = [np.maximum(0, (low[at] - corner[node]) // width) for low, corner in ((lo1, x), (lo2, y))]
        last = [np.minimum(parts[node] - 1, (high[at] - corner[node]) // width) for high, corner in ((hi1, x), (hi2, y))]
        n1, n2 = last[0] - first[0] + 1, last[1] - first[1] + 1
        each = np.repeat(np.arange(len(at)), n1 * n2)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(n1 * n2) - n1 * n2, n1 * n2)
        return at[each], node[each], first[0][each] + nth // n2[each], first[1][each] + nth % n2[each]

    def holds(self, node: int, tx: int, ty: int, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Which points lie in a tile."""
        width, inside = self.size[node] // self.parts[node], np.ones(len(px), bool)
        for p, corner, root, t in ((px, self.x[node], self.x[0], tx), (py, self.y[node], self.y[0], ty)):
            p = np.clip(p, root, root + self.size[0] - 1)
            inside &= (p >= corner + t * width) & (p < corner + (t + 1) * width)
        return inside


def quadtrees(rects: DataFrame, most: int, sample: int = SAMPLE) -> dict[tuple[int, int], Quadtree]:
    """A quadtree for each plane, from a sample of rectangles."""
    n = rects.count()
    if not n:
        return {}
    some = rects.select("c1", "c2", *CORNERS) if n <= sample else rects.orderBy(F.xxhash64("id", "side")).limit(sample).select("c1", "c2", *CORNERS)
    rows = np.array([tuple(r) for r in some.collect()], np.int64)  # SAMPLE rows at most
    return {(int(a), int(b)): Quadtree.over(rows[(rows[:, 0] == a) & (rows[:, 1] == b)][:, 2:], n / len(rows), most) for a, b in np.unique(rows[:, :2], axis=0)}


def dealt(rects: DataFrame, trees: dict[tuple[int, int], Quadtree]) -> DataFrame:
    """rects, a row for each tile that they meet: plane and tile name it. A plane that the sample hasn't seen is one tile."""
    planes = {k: i for i, k in enumerate(trees)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2 = (np.asarray(batch[c]).astype(np.int64) for c in ("c1", "c2"))
            corners = np.stack([np.asarray(batch[c]).astype(np.int64) for c in CORNERS], axis=1)
            for a, b in np.unique(np.stack([c1, c2], axis=1), axis=0).tolist():
                mine = np.flatnonzero((c1 == a) & (c2 == b))
                if (a, b) in trees:
                    at, node, tx, ty = trees[a, b].deal(corners[mine])
                else:
                    at, node, tx, ty = (np.arange(len(mine)), *np.zeros((3, len(mine)), np.int64))
                plane = np.full(len(at), planes.get((a, b), -1), np.int32)
                kept = batch.take(pa.array(mine[at])).select(["id", "side", "c1", "c2", *CORNERS])
                yield pa.RecordBatch.from_arrays([pa.array(plane), pa.array(node), pa.array(tx), pa.array(ty), *kept.columns], names=[c.split()[0] for c in DEALT.split(", ")])

    return rects.select("id", "side", "c1", "c2", *CORNERS).mapInArrow(run, DEALT)


TILE = ["c1", "c2", "tile", "tx", "ty"]


def in_runs(tiles: DataFrame, most: int) -> DataFrame:
    """tiles with run0 and run1: tiles of more than most rectangles of a side are cut into runs of that side, and their others copied to each."""
    counts = tiles.groupBy(*TILE).agg(*(F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"n{s}") for s in (0, 1)))
    hot = counts.where(F.greatest("n0", "n1") > most).select(*TILE, *(F.greatest(F.lit(1), F.ceil(F.col(f"n{s}") / most)).cast("int").alias(f"k{s}") for s in (0, 1)))
    one = F.array(F.struct(F.lit(0).alias("run0"), F.lit(0).alias("run1")))
    own = lambda s: F.pmod(F.xxhash64("id"), F.col(f"k{s}")).cast("int")
    every = lambda s: F.sequence(F.lit(0), F.col(f"k{s}") - 1)
    runs = F.when(F.col("k0").isNull(), one).when(F.col("side") == 0, F.transform(every(1), lambda r: F.struct(own(0).alias("run0"), r.alias("run1")))).otherwise(F.transform(every(0), lambda r: F.struct(r.alias("run0"), own(1).alias("run1"))))
    return tiles.join(hot, TILE, "left").withColumn("runs", F.explode(runs)).select(*tiles.columns, "runs.*")


def swept(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places in a and b (rows of CORNERS) that meet, and how many pairs were compared, a bounded number at a time."""
    oa, ob = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    a, b = a[oa], b[ob]
    for left, right, ol, orr, turned, side in ((a, b, oa, ob, False, "left"), (b, a, ob, oa, True, "right")):
        first = np.searchsorted(right[:, 0], left[:, 0], side)  # of one start those of b count as later
        n = np.maximum(0, np.searchsorted(right[:, 0], left[:, 1], "right") - first)
        ends = np.cumsum(n)
        done = 0
        while done < len(left):
            base = ends[done - 1] if done else 0
            last = max(done + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
            each = np.repeat(np.arange(done, last), n[done:last])
            other = first[each] + np.arange(len(each)) - (ends[each] - n[each] - base)
            met = (left[each, 2] <= right[other, 3]) & (right[other, 2] <= left[each, 3])
            x, y = ol[each[met]], orr[other[met]]
            yield (y, x, len(each)) if turned else (x, y, len(each))
            done = last


def meeting(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray | None = None, b_ids: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Which of a meet some of b (with ids: some of smaller id), and how many pairs were compared: a few of b for each of a, then more for those that have met none."""
    order = np.argsort(b[:, 0], kind="stable")
    b = b[order]
    b_ids = None if b_ids is None else b_ids[order]
    reach = np.maximum.accumulate(b[:, 1]) if len(b) else b[:, 1]
    first, last = np.searchsorted(reach, a[:, 0], "left"), np.searchsorted(b[:, 0], a[:, 1], "right")  # all that may meet lie between
    met, left, step, compared = np.zeros(len(a), bool), np.flatnonzero(first < last), 4, 0
    while len(left):
        again = []
        for some in np.array_split(left, -(-len(left) * step // PAIRS_AT_ONCE)):
            other = first[some][:, None] + np.arange(step)
            there = other < last[some][:, None]
            other = np.minimum(other, len(b) - 1)
            o = b[other]
            hit = there & (o[:, :, 1] >= a[some, 0][:, None]) & (o[:, :, 0] <= a[some, 1][:, None]) & (o[:, :, 3] >= a[some, 2][:, None]) & (o[:, :, 2] <= a[some, 3][:, None])
            if b_ids is not None:
                hit &= b_ids[other] < a_ids[some][:, None]
            compared += int(there.sum())
            met[some] = hit.any(axis=1)
            first[some] += step
            again.append(some[~met[some] & (first[some] < last[some])])
        left, step = np.concatenate(again), min(2 * step, PAIRS_AT_ONCE)
    return met, compared


def _sides(table: pa.Table) -> tuple[np.ndarray, ...]:
    side = np.asarray(table["side"])
    ids, corners = np.asarray(table["id"]), np.stack([np.asarray(table[c]) for c in CORNERS], axis=1)
    return ids[side == 0], corners[side == 0], ids[side == 1], corners[side == 1]


def _join(a: DataFrame, b: DataFrame, most: int, sample: int) -> tuple[DataFrame, dict]:
    """Both sides in tiles and runs, and the quadtrees. a, b: id, c1, c2, lo1, hi1, lo2, hi2."""
    columns = ["c1", "c2", *CORNERS]
    planes = a.select("c1", "c2").distinct()
    both = a.select("id", F.lit(0).alias("side"), *columns).unionByName(b.join(planes, ["c1", "c2"], "left_semi").select("id", F.lit(1).alias("side"), *columns))
    kinds = {"id": "long", "side": "int", "c1": "int", "c2": "int", **dict.fromkeys(CORNERS, "long")}
    both = checkpointed(both.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).where("lo1 <= hi1 AND lo2 <= hi2"))
    trees = quadtrees(both, most, sample)
    return in_runs(checkpointed(dealt(both, trees)), most), trees


GROUP = [*TILE, "run0", "run1"]


def pairs(a: DataFrame, b: DataFrame, most: int = MOST, sample: int = SAMPLE, counted: bool = False) -> DataFrame:
    """(a_id, b_id) of rectangles that meet, each pair once; counted: rather how many pairs were compared, a row a tile."""
    tiles, trees = _join(a, b, most, sample)

    def run(table: pa.Table) -> pa.Table:
        ai, a, bi, b = _sides(table)
        tile = [table[c][0].as_py() for c in ("tile", "tx", "ty")]
        tree = trees.get((table["c1"][0].as_py(), table["c2"][0].as_py()))
        xs, ys, compared = [], [], 0
        for x, y, n in swept(a, b):
            if tree is not None:  # the tile that has the lower corner of what both share
                here = tree.holds(*tile, np.maximum(a[x, 0], b[y, 0]), np.maximum(a[x, 2], b[y, 2]))
                x, y = x[here], y[here]
            xs.append(ai[x])
            ys.append(bi[y])
            compared += n
        if counted:
            return pa.table({"compared": pa.array([compared], pa.int64())})
        return pa.table({"a_id": pa.array(np.concatenate([*xs, np.empty(0, np.int64)])), "b_id": pa.array(np.concatenate([*ys, np.empty(0, np.int64)]))})

    return tiles.groupBy(*GROUP).applyInArrow(run, "compared long" if counted else "a_id long, b_id long")


def those_meeting(a: DataFrame, b: DataFrame, most: int = MOST, sample: int = SAMPLE, earlier: bool = False, counted: bool = False) -> DataFrame:
    """The ids of a that meet some of b (earlier: some of smaller id); counted: rather how many pairs were compared, a row a tile."""
    tiles, _ = _join(a, b, most, sample)

    def run(table: pa.Table) -> pa.Table:
        ai, a, bi, b = _sides(table)
        met, compared = meeting(a, b, ai, bi) if earlier else meeting(a, b)
        return pa.table({"compared": pa.array([compared], pa.int64())}) if counted else pa.table({"id": pa.array(ai[met])})

    found = tiles.groupBy(*GROUP).applyInArrow(run, "compared long" if counted else "id long")
    return found if counted else found.distinct()
