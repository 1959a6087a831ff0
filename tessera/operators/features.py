"""Interval features: rectangles (feature_id, chr1_idx, start1, end1, chr2_idx, start2, end2, color, attributes).

A rectangle's color and attributes may be missing; a 1-D feature is one with both axes alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tiles
from tessera.plans.lineage import checkpointed, numbered

BOUNDS = ["chr1_idx", "start1", "end1", "chr2_idx", "start2", "end2"]
KEY = ["chr1_idx", "chr2_idx"]
COLUMNS = "feature_id long, feature_type string, chr1 string, chr1_idx int, start1 long, end1 long, chr2 string, chr2_idx int, start2 long, end2 long, color struct<r:int,g:int,b:int>, attributes map<string,string>"


def midpoint(start: Column, end: Column) -> Column:
    return (start + (end - start) / 2.0).cast("long")


def with_geometry(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "width1": F.col("end1") - F.col("start1"),
            "width2": F.col("end2") - F.col("start2"),
            "mid1": midpoint(F.col("start1"), F.col("end1")),
            "mid2": midpoint(F.col("start2"), F.col("end2")),
            "on_diagonal": (F.col("chr1_idx") == F.col("chr2_idx")) & (F.col("start1") == F.col("start2")) & (F.col("end1") == F.col("end2")),
            "lower_left": F.col("start2") > F.col("start1"),
            "upper_right": F.col("start2") < F.col("start1"),
        }
    )


def distance(resolution: int) -> Column:
    """Between the midpoints, in bins."""
    return F.abs(F.expr(f"cast(start1 + (end1 - start1) / 2D as bigint) div {resolution}") - F.expr(f"cast(start2 + (end2 - start2) / 2D as bigint) div {resolution}"))


def _swap(features: DataFrame, swap: Column) -> DataFrame:
    out = {}
    for a, b in (("chr1_idx", "chr2_idx"), ("start1", "start2"), ("end1", "end2"), ("chr1", "chr2")):
        if a in features.columns and b in features.columns:
            out[a], out[b] = F.when(swap, F.col(b)).otherwise(F.col(a)), F.when(swap, F.col(a)).otherwise(F.col(b))
    return features.withColumns(out)


def reflect(features: DataFrame) -> DataFrame:
    return _swap(features, F.lit(True))


def orient(features: DataFrame) -> DataFrame:
    """The lower chromosome first, within one the lower midpoint; features of an unknown chromosome go."""
    m1, m2 = midpoint(F.col("start1"), F.col("end1")), midpoint(F.col("start2"), F.col("end2"))
    known = features.where("chr1_idx IS NOT NULL AND chr2_idx IS NOT NULL")
    return _swap(known, (F.col("chr1_idx") > F.col("chr2_idx")) | ((F.col("chr1_idx") == F.col("chr2_idx")) & (m1 > m2)))


def in_order(features: DataFrame) -> DataFrame:
    return features.orderBy(*KEY, "start1", "start2", "end1", "end2")


def dedup(features: DataFrame) -> DataFrame:
    """One feature for each set of bounds: that of smallest feature_id."""
    kept = features.groupBy(*BOUNDS).agg(F.min("feature_id").alias("feature_id"))
    return features.join(kept.select("feature_id"), "feature_id", "left_semi")


def _reach(features: DataFrame) -> DataFrame:
    """lo1, hi1, lo2, hi2: the midpoints give or take half the widths."""
    half1, half2 = F.expr("(end1 - start1) div 2"), F.expr("(end2 - start2) div 2")
    m1, m2 = midpoint(F.col("start1"), F.col("end1")), midpoint(F.col("start2"), F.col("end2"))
    return features.withColumns({"lo1": m1 - half1, "hi1": m1 + half1, "lo2": m2 - half2, "hi2": m2 + half2})


def _mids(features: DataFrame) -> DataFrame:
    """id and corners, for tiles: the midpoints give or take half the widths."""
    return _reach(features).select(F.col("feature_id").alias("id"), F.col("chr1_idx").alias("c1"), F.col("chr2_idx").alias("c2"), *tiles.CORNERS)


def _rects(features: DataFrame) -> DataFrame:
    """id and corners, for tiles: the bounds."""
    bounds = zip(("start1", "end1", "start2", "end2"), tiles.CORNERS)
    return features.select(F.col("feature_id").alias("id"), F.col("chr1_idx").alias("c1"), F.col("chr2_idx").alias("c2"), *(F.col(c).alias(k) for c, k in bounds))


def hits(a: DataFrame, b: DataFrame, most: int = tiles.MOST) -> DataFrame:
    """(feature_id, other_id): features of a whose midpoint lies in a rectangle of b widened by half of a's widths.

    Both are dealt to tiles that adapt to where they lie on both axes; most: rectangles of a tile.
    """
    return tiles.pairs(_mids(a), _rects(b), most).select(F.col("a_id").alias("feature_id"), F.col("b_id").alias("other_id"))


def overlap(a: DataFrame, b: DataFrame, most: int = tiles.MOST) -> DataFrame:
    """Features of a that overlap some feature of b; a feature's search ends with the first."""
    met = tiles.those_meeting(_mids(a), _rects(b.dropDuplicates(BOUNDS)), most)
    return a.join(met.withColumnRenamed("id", "feature_id"), "feature_id", "left_semi")


def intersection(a: DataFrame, b: DataFrame, tolerance: int = 0) -> DataFrame:
    """Features of a whose four bounds are each within tolerance of some feature of b, each bounds once."""
    tile = max(1, 2 * tolerance + 1)
    near = a.select("feature_id", *BOUNDS, F.explode(F.sequence(F.floor((F.col("start1") - tolerance) / tile), F.floor((F.col("start1") + tolerance) / tile))).alias("tile"))
    other = b.select(*(F.col(c).alias(f"b_{c}") for c in BOUNDS)).distinct().withColumn("tile", F.floor(F.col("b_start1") / tile))
    same = (F.col("chr1_idx") == F.col("b_chr1_idx")) & (F.col("chr2_idx") == F.col("b_chr2_idx")) & (near["tile"] == other["tile"])
    for c in ("start1", "end1", "start2", "end2"):
        same = same & (F.abs(F.col(c) - F.col(f"b_{c}")) <= tolerance)
    return dedup(a.join(near.join(other, same, "left_semi").select("feature_id").distinct(), "feature_id", "left_semi"))


def _decided(table: pa.Table) -> pa.Table:
    """Of the features of a tile, in order: 0 shut out, 1 not known yet, 2 nothing here shuts it out. Those that lie in this tile alone are then accepted."""
    table = table.sort_by("id")
    reach = np.stack([np.asarray(table[c]) for c in tiles.CORNERS], axis=1)
    rect = np.stack([np.asarray(table[c]) for c in ("start1", "end1", "start2", "end2")], axis=1)
    alone = np.asarray(table["n"]) == 1
    verdict = np.full(len(reach), 2, np.int32)
    live, known, n = np.empty_like(rect), np.empty(len(rect), bool), 0  # those that are accepted or may be
    for i in range(len(reach)):
        lo1, hi1, lo2, hi2 = reach[i]
        own = live[:n]
        met = (own[:, 0] <= hi1) & (own[:, 1] >= lo1) & (own[:, 2] <= hi2) & (own[:, 3] >= lo2)
        if met.any():
            verdict[i] = 0 if known[:n][met].any() else 1
        if verdict[i]:
            live[n], known[n] = rect[i], alone[i] and verdict[i] == 2
            n += 1
    return pa.table({"id": table["id"], "verdict": pa.array(verdict)})


def add_unique(a: DataFrame, b: DataFrame, most: int = 1 << 15) -> DataFrame:
    """a, and those of b that do not overlap what is there by then, in the order of feature_id; a key that a lacks takes all of b's.

    What is accepted shuts out later ones. That is settled tile by tile (tiles adapt to where the undecided features
    lie): a tile's features, at most about most of them, the earliest first, are gone through in order by one task. A feature that lies in several tiles is
    accepted once none of them has anything earlier that may shut it out, and until then it leaves those that it may shut out
    undecided. The undecided ones are dealt anew, to fewer tiles; so a chain of rivals within a tile takes one round, however long it is.
    """
    columns = ["feature_id", *BOUNDS]
    have = a.select(*KEY).distinct()
    free = b.join(have, KEY, "left_anti").select(columns)
    left = b.join(have, KEY, "left_semi").select(columns)
    out = tiles.those_meeting(_mids(left), _rects(a.dropDuplicates(BOUNDS))).withColumnRenamed("id", "feature_id")
    left = checkpointed(left.join(out, "feature_id", "left_anti"))
    taken = []
    while not left.isEmpty():
        low, high = (lambda i: F.least(f"lo{i}", f"start{i}").alias(f"lo{i}")), (lambda i: F.greatest(f"hi{i}", f"end{i}").alias(f"hi{i}"))
        hull = _reach(left).select(F.col("feature_id").cast("long").alias("id"), F.lit(0).alias("side"), F.col("chr1_idx").cast("int").alias("c1"), F.col("chr2_idx").cast("int").alias("c2"), *(f(i).cast("long").alias(k) for k, f, i in zip(tiles.CORNERS, (low, high, low, high), (1, 1, 2, 2))))
        placed = checkpointed(tiles.dealt(hull, tiles.quadtrees(hull, most)).select("id", *tiles.TILE))
        counts = placed.groupBy(*tiles.TILE).agg(F.count("*").alias("size"))
        hot = counts.where(F.col("size") > 2 * most).select(*tiles.TILE, "size")
        cut = placed.join(hot, tiles.TILE).groupBy(*tiles.TILE).agg(F.expr(f"percentile_approx(id, array({', '.join(str(2.0**-k) for k in range(32))}), 10000)").alias("ids"), F.first("size").alias("size"))
        cut = cut.select(*tiles.TILE, F.element_at("ids", F.greatest(F.lit(1), F.least(F.lit(32), F.ceil(F.log2(F.col("size") / most)).cast("int") + 1))).alias("upto"))
        every = placed.groupBy("id").agg(F.count("*").alias("n"))
        now = placed.join(cut, tiles.TILE, "left").where("upto IS NULL OR id <= upto").join(every, "id")
        now = now.join(_reach(left).select(F.col("feature_id").cast("long").alias("id"), *tiles.CORNERS, "start1", "end1", "start2", "end2"), "id")
        found = now.groupBy(*tiles.TILE).applyInArrow(_decided, "id long, verdict int").groupBy("id").agg(F.min("verdict").alias("verdict"), F.count("*").alias("m"))
        found = checkpointed(found.join(every, "id").select("id", F.when(F.col("verdict") == 0, 0).when((F.col("verdict") == 2) & (F.col("m") == F.col("n")), 2).otherwise(1).alias("verdict")).where("verdict <> 1"))
        accepted = left.join(found.where("verdict = 2").select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
        taken.append(accepted)
        left = checkpointed(left.join(found.select(F.col("id").alias("feature_id")), "feature_id", "left_anti"))
        if not left.isEmpty():
            out = tiles.those_meeting(_mids(left), _rects(accepted), earlier=True).withColumnRenamed("id", "feature_id")
            left = checkpointed(left.join(out, "feature_id", "left_anti"))
    return reduce(DataFrame.unionByName, [a.select(columns), free, *taken])


def containing(features: DataFrame, points: DataFrame, most: int = tiles.MOST) -> DataFrame:
    """points (point_id, chr1_idx, chr2_idx, x, y) with the features whose closed rectangles hold them."""
    asked = points.select(F.col("point_id").alias("id"), F.col("chr1_idx").alias("c1"), F.col("chr2_idx").alias("c2"), *(F.col(p).alias(k) for p, k in zip("xxyy", tiles.CORNERS)))
    return tiles.pairs(asked, _rects(features), most).select(F.col("a_id").alias("point_id"), F.col("b_id").alias("feature_id"))


def without_first(features: DataFrame, gone: DataFrame) -> DataFrame:
    """features without the first (by feature_id) of each set of bounds in gone."""
    nth = F.row_number().over(Window.partitionBy(*BOUNDS).orderBy("feature_id"))
    first = features.withColumn("__n", nth).where("__n = 1").join(gone.select(*BOUNDS).distinct(), BOUNDS, "left_semi").select("feature_id")
    return features.join(first, "feature_id", "left_anti")


def exact(features: DataFrame, chr1: int, start1: int, end1: int, chr2: int, start2: int, end2: int) -> DataFrame:
    return features.where((F.col("chr1_idx") == chr1) & (F.col("chr2_idx") == chr2) & (F.col("start1") == start1) & (F.col("end1") == end1) & (F.col("start2") == start2) & (F.col("end2") == end2))


def set_attribute(features: DataFrame, key: str, value: Column, only_if_missing: bool = False) -> DataFrame:
    """The attribute set on every feature, or where it is missing."""
    own = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    new = F.map_concat(F.map_filter(own, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))
    return features.withColumn("attributes", F.when(F.map_contains_key(own, F.lit(key)), own).otherwise(new) if only_if_missing else new)


def attribute(key: str, kind: str = "string") -> Column:
    """An attribute as text, or as a number of a kind; null if it is missing or no such number."""
    return F.try_element_at("attributes", F.lit(key)).try_cast(kind)


def with_defaults(features: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Features as they are added to a list that has default attributes: those that are missing get them."""
    for key, value in defaults.items():
        features = set_attribute(features, key, F.lit(value), only_if_missing=True)
    return features


def attribute_keys() -> Column:
    return F.sort_array(F.map_keys(F.coalesce("attributes", F.create_map().cast("map<string,string>"))))


def clear_attributes(features: DataFrame) -> DataFrame:
    return features.withColumn("attributes", F.create_map().cast("map<string,string>"))


def text_line(chr1: Column, chr2: Column) -> Column:
    """Six bounds, four dots, the color and the attributes by sorted key, tab-separated."""
    color = F.concat_ws(",", F.coalesce(F.col("color.r"), F.lit(0)), F.coalesce(F.col("color.g"), F.lit(0)), F.coalesce(F.col("color.b"), F.lit(0)))
    values = F.transform(attribute_keys(), lambda k: F.try_element_at("attributes", k))
    return F.concat_ws("\t", chr1, F.col("start1").cast("string"), F.col("end1").cast("string"), chr2, F.col("start2").cast("string"), F.col("end2").cast("string"), *[F.lit(".")] * 4, color, values)


def process_by_key(features: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], most: int | None = None) -> DataFrame:
    """A function of each pair of chromosomes' features, a pandas frame at a time. A row-wise filter is better as where().

    most: the function is given runs of so many features of a pair at most, in the order of their starts; a pair of very many features is then the
    work of many tasks. Without it a frame has all features of a pair.
    """
    if most is None:
        return features.groupBy(*KEY).applyInPandas(fn, features.schema)
    placed = numbered(features, "__place", *KEY, "start1", "start2", "feature_id")
    first = placed.groupBy(*(F.col(k).alias(f"__{k}") for k in KEY)).agg(F.min("__place").alias("__first"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY])
    runs = placed.join(first, same).withColumn("__run", F.floor((F.col("__place") - F.col("__first")) / most))
    columns = features.columns
    return runs.groupBy(*KEY, "__run").applyInPandas(lambda frame: fn(frame.sort_values("__place")[columns].reset_index(drop=True)), features.schema)


def genome_wide_list(chromosomes: DataFrame, features: DataFrame) -> DataFrame:
    """1-D features (chr_idx, ...) of every chromosome but All; one without features has nulls."""
    own = chromosomes.where("idx > 0").select(F.col("idx").alias("chr_idx"))
    without = own.join(features.select("chr_idx").distinct(), "chr_idx", "left_anti")
    return F.broadcast(own).join(features, "chr_idx").unionByName(without, allowMissingColumns=True)  # a row a chromosome: its features are not gathered in one task
