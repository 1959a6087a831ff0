"""Operators that are dealt over ranges, runs, tiles and levels, against plain versions; exports and zoom lookup."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.operators import correlate, decay, features, genome, matrix
from tessera.sinks import text as sinks

MAPS = "chr1_idx int, chr2_idx int, bin_size int, bin_x int, bin_y int, oe double"
BOUNDS = "feature_id long, chr1_idx int, start1 long, end1 long, chr2_idx int, start2 long, end2 long"


def some_maps(spark, n):
    rng, rows, dense = np.random.default_rng(0), [], {}
    for c in (1, 2):
        upper = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.4))
        upper[5, :] = upper[:, 5] = 0  # a bin without records
        dense[c] = upper + upper.T - np.diag(np.diag(upper))
        rows += [(c, c, 1, i, j, float(upper[i, j])) for i in range(n) for j in range(i, n) if upper[i, j]]
    rows.append((1, 1, 1, 5, 5, float("nan")))
    return spark.createDataFrame(rows, MAPS), dense


def test_pearson_and_eigenvectors_of_two_maps(spark):
    n = 30
    df, dense = some_maps(spark, n)
    want = {}
    for c, d in dense.items():
        kept = [i for i in range(n) if i != 5]
        want[c] = kept, np.corrcoef((d - d.mean(axis=0))[kept])
    for tile, columns in ((7, 11), (4, 1000), (100, 100)):
        got = correlate.pearson(df, n, tile, columns).collect()
        assert len(got) == len({(r["chr_idx"], r["row"], r["col"]) for r in got}) == 2 * 29 * 29
        for r in got:
            kept, m = want[r["chr_idx"]]
            assert abs(r["value"] - m[kept.index(r["row"]), kept.index(r["col"])]) < 1e-9
    assert correlate.pearson(df.limit(0), n).count() == 0
    for which in (0, 1):
        found = {(r["chr_idx"], r["bin"]): r["value"] for r in correlate.eigenvector(df, {1: n, 2: n}, which).collect()}
        assert len(found) == 58
        for c, (kept, m) in want.items():
            v = np.linalg.eigh(m)[1][:, ::-1][:, which]
            v = v * np.sign(v[np.abs(v).argmax()])
            assert max(abs(found[c, b] - x) for b, x in zip(kept, v)) < 1e-6
    assert correlate.eigenvector(df.limit(0), n).count() == 0


@pytest.mark.parametrize("n", [40, 80])
def test_pearson_sends_tiles(spark, n):
    """Rows that are sent: tiles of cells, with the sums of each row tile, times row tiles; as few for a dense map as for a sparse one."""
    dense = spark.range(n * n).selectExpr("1 AS chr1_idx", "1 AS chr2_idx", "1 AS bin_size", f"cast(id div {n} AS int) AS bin_x", f"cast(id % {n} AS int) AS bin_y", "rand(1) AS oe").where("bin_x <= bin_y")
    a = correlate._cells(dense)
    tiles = n // 8
    sent = correlate._tiles(a, correlate._centred(a, n)[1], n, 8, n)
    assert a.count() == n * n and sent.count() == 2 * tiles * tiles
    assert correlate.pearson(dense, n, 8).count() == n * n


def plain_median(values, w):
    n, out = len(values), []
    for z in range(n):
        own = values[: 2 * z + 1] if z < w else values[z - w : z + w + 1]
        s = sorted(np.float32(x) for x in own)
        out.append(float(np.float32((float(s[(len(s) - 1) // 2]) + float(s[len(s) // 2])) / 2)))
    return out if 1 <= w < n else list(values)


@pytest.mark.parametrize("w", [0, 1, 3, 10, 40])
def test_rolling_medians_by_runs(spark, w):
    r = random.Random(w)
    vectors = {k: [r.random() for _ in range(n)] for k, n in ((1, 37), (2, 5), (3, 100))}
    df = spark.createDataFrame([(k, i, float(np.float32(x))) for k, v in vectors.items() for i, x in enumerate(v)], "k int, dist int, value double")
    got = decay.rolling_median(df, w, "k", run=16).orderBy("k", "dist").collect()
    assert [x["value"] for x in got] == [y for v in vectors.values() for y in plain_median([float(np.float32(x)) for x in v], w)]


def test_percentiles_and_monotone_points_by_ranges(spark):
    r = np.random.default_rng(2)
    values = [*r.normal(size=997).tolist(), *[0.5] * 200, float("nan")]
    m = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "row int, col int, value double").repartition(5)
    s = sorted(v for v in values if not math.isnan(v))

    def rank(p):
        pos = p * (len(s) + 1) / 100
        k = int(pos)
        return s[0] if pos < 1 else s[-1] if pos >= len(s) else s[k - 1] + (pos - k) * (s[k] - s[k - 1])

    for low, high in ((5, 95), (0, 100), (33.3, 50)):
        got = matrix.percentile_bounds(m, low, high).first()
        assert got["lower"] == pytest.approx(rank(low)) and got["upper"] == pytest.approx(rank(high))
    xs = [r.integers(0, 20) for _ in range(300)]
    points = spark.createDataFrame([(i, float(x), 1.0) for i, x in enumerate(xs)], "ord int, x double, y double").repartition(7)
    kept = [x["ord"] for x in matrix.monotone(points).orderBy("ord").collect()]
    assert kept == [i for i, x in enumerate(xs) if i == 0 or x > xs[i - 1]]


def rows_of_tasks(df):
    """The most rows of any partition that df's last shuffle fills."""
    return max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_row_medians_by_ranges(spark):
    r = np.random.default_rng(4)
    rows = {0: r.normal(size=501).tolist(), 1: [1.0] * 400, 2: [3.0], 3: [2.0, 5.0], 4: [1.0, float("nan"), float("nan")], 5: r.integers(0, 3, 100).astype(float).tolist()}
    m = spark.createDataFrame([(k, j, x) for k, v in rows.items() for j, x in enumerate(v)] + [(6, 0, None)], "row int, col int, value double").repartition(5)
    got = {x["row"]: x["value"] for x in matrix.row_medians(m).collect()}
    assert math.isnan(got.pop(4)) and got == {k: pytest.approx(float(np.median(v))) for k, v in rows.items() if k != 4}
    assert matrix.row_medians(m.limit(0)).count() == 0


def test_a_row_is_spread_over_tasks(spark):
    """One row of many cells: the ranges from which its median comes hold a part of it each."""
    from tessera.plans import lineage

    m = spark.range(400_000).selectExpr("0 AS row", "cast(id AS int) AS col", "cast((id * 7919) % 400009 AS double) AS value")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = lineage.cumulated(m.groupBy("row", "value").agg(F.count("*").alias("c")), "c", "before", "row", "value")
        assert per.count() == 400_000 and rows_of_tasks(per) < 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert matrix.row_medians(m).first()["value"] == pytest.approx(float(np.median((np.arange(400_000) * 7919) % 400009)))


def test_places_of_one_long_vector(spark):
    from tessera.plans import lineage

    n = 300_000
    v = spark.range(n).selectExpr("cast((id * 7919) % 300007 AS int) AS dist", "cast(id % 1000 AS double) AS value").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = lineage.numbered(v, "place", "dist")
    assert rows_of_tasks(placed) < 0.5 * n
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [x["place"] for x in placed.orderBy("dist").select("place").collect()]
    assert got == list(range(n))
    smooth = decay.rolling_median(v, 2).orderBy("dist").limit(2000).collect()
    values = [x["value"] for x in v.orderBy("dist").limit(2010).collect()]
    assert [x["value"] for x in smooth] == plain_median(values, 2)[:2000]


def test_tables_on_the_way_are_deleted(spark):
    import os

    from tessera.plans import lineage

    there = lambda paths: [os.path.isdir(p.removeprefix("file://")) for p in paths]
    with lineage.scratch(spark) as made:
        median = matrix.row_medians(spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "row int, col int, value double")).first()["value"]
        kept = lineage.checkpointed(spark.range(3))
        every = list(made)
        assert median == 2.0 and len(every) >= 2 and all(there(every))
        made.pop()
    assert there(every) == [False] * (len(every) - 1) + [True] and kept.count() == 3


def test_overlap_of_features_of_all_widths(spark):
    r = random.Random(3)

    def some(n, first):
        out = []
        for i in range(n):
            k, w = r.choice([1, 2]), [r.choice([10, 300, 5000, 80_000, 2_000_000]) for _ in range(2)]
            s = [r.randrange(0, 3_000_000) for _ in range(2)]
            out.append((first + i, k, s[0], s[0] + w[0], k, s[1], s[1] + w[1]))
        return out

    a, b = some(150, 0), some(150, 1000)
    want = set()
    for x in a:
        m1, m2, w1, w2 = x[2] + (x[3] - x[2]) // 2, x[5] + (x[6] - x[5]) // 2, (x[3] - x[2]) // 2, (x[6] - x[5]) // 2
        want |= {(x[0], y[0]) for y in b if x[1] == y[1] and y[2] - w1 <= m1 <= y[3] + w1 and y[5] - w2 <= m2 <= y[6] + w2}
    left, right = spark.createDataFrame(a, BOUNDS), spark.createDataFrame(b, BOUNDS)
    got = [tuple(x) for x in features.hits(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {x["feature_id"] for x in features.overlap(left, right).collect()} == {x for x, _ in want}
    points = [(i, r.choice([1, 2]), r.randrange(0, 3_000_000), r.randrange(0, 3_000_000)) for i in range(400)]
    asked = spark.createDataFrame([(i, k, k, x, y) for i, k, x, y in points], "point_id long, chr1_idx int, chr2_idx int, x long, y long")
    inside = {(i, f[0]) for i, k, x, y in points for f in a if f[1] == k and f[2] <= x <= f[3] and f[5] <= y <= f[6]}
    assert {(x["point_id"], x["feature_id"]) for x in features.containing(left, asked).collect()} == inside and inside
    assert features.hits(left.limit(0), right).count() == 0 and features.overlap(left, right.limit(0)).count() == 0


def test_matrix_kinds_are_numbers_of_their_formulas(spark):
    v = {"o": 6.0, "e": 2.0, "c": 3.0, "ec": 1.5, "avg_o": 1.25, "avg_c": 2.5, "e0": 0.5, "ec0": 0.75}
    own = spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} double" for k in v))
    got = own.select(*(catalog.matrix_kind(k, {n: F.col(n) for n in v}).alias(k) for k in catalog.MATRIX_KINDS)).first().asDict()
    ln, l1 = math.log, math.log1p
    oe, oe1, ce, ce1 = 3.0, 7 / 3, 2.0, 4 / 2.5
    eo, ceo = l1(6) / l1(2), l1(3) / l1(1.5)
    ratio, ratio1, ratio0, ratio01 = 2 * 2.0, 7 / 4 * (3.5 / 2.25), 2 * 1.5, 7 / 4 * (1.75 / 1.5)
    want = {"OBSERVED": 6, "EXPECTED": 2, "OE": oe, "OEV2": ln(oe), "OEP1": oe1, "OEP1V2": ln(oe1), "OME": 4, "LOG": l1(6), "LOGEO": eo, "METALOGEO": (l1(6) + 1) / (l1(2) + 1), "EXPLOGEO": math.exp(eo), "EXPLOGEOINV": math.exp(1 / eo)}
    want |= {"CONTROL": 3, "OECTRL": ce, "OECTRLV2": ln(ce), "OECTRLP1": ce1, "OECTRLP1V2": ln(ce1), "CME": 1.5, "LOGC": l1(3), "LOGCEO": ceo, "EXPLOGCEO": math.exp(ceo)}
    want |= {"RATIO": ratio, "RATIOV2": ln(ratio), "RATIOP1": ratio1, "RATIOP1V2": ln(ratio1), "RATIO0": ratio0, "RATIO0V2": ln(ratio0), "RATIO0P1": ratio01, "RATIO0P1V2": ln(ratio01)}
    want |= {"OERATIO": oe / ce, "OERATIOV2": ln(oe / ce), "OERATIOP1": oe1 / ce1, "OERATIOP1V2": ln(oe1 / ce1), "OERATIOMINUS": oe - ce, "OERATIOMINUSP1": oe1 - ce1, "LOGRATIO": l1(6) / l1(3), "LOGEORATIO": eo / ceo, "DIFF": 3}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x), k


def test_zoom_lookup(spark):
    rows = [(a, b, u, s) for a, b in ((0, 0), (1, 1)) for u, s in (("BP", 1000), ("BP", 500), ("BP", 100), ("FRAG", 20))]
    m = spark.createDataFrame(rows, "chr1_idx int, chr2_idx int, unit string, bin_size int")
    at = lambda df: sorted((r["chr1_idx"], r["bin_size"]) for r in df.collect())
    assert at(genome.zoom_of(m, "BP", 500)) == [(0, 500), (1, 500)] and at(genome.zoom_of(m, "BP", 750)) == [(0, 1000)] and at(genome.zoom_of(m, "BP", 90)) == [(0, 100)]
    assert at(genome.zoom_number(m, "BP")) == [(0, 1000), (1, 1000)] and at(genome.zoom_number(m, "BP", 2)) == [(0, 100), (1, 100)] and at(genome.zoom_number(m, "FRAG", 1)) == []
    assert genome.all_resolutions([10], [20], [1]) == [("BP", 10), ("BP", 20), ("FRAG", 1)]


def test_exports(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 1.23456), (0, 1, float("nan")), (1, 0, 2.0), (1, 1, -0.5)], "row int, col int, value double")
    assert [r["line"] for r in sinks.rounded_lines(m).orderBy("row").collect()] == ["1.235, NaN, 0", "2.0, -0.5, 0"]
    assert [r["line"] for r in sinks.matrix_lines(m, brackets=True).orderBy("row").collect()] == ["[1.23456, NaN]", "[2.0, -0.5]"]
    f = spark.createDataFrame([(1, "b", 2, 5, 6, "b", 2, 7, 8, None, {"q": "1", "p": "2"}), (2, "a", 1, 3, 4, "a", 1, 3, 4, None, {"p": "9"})], "feature_id long, chr1 string, chr1_idx int, start1 long, end1 long, chr2 string, chr2_idx int, start2 long, end2 long, color struct<r:int,g:int,b:int>, attributes map<string,string>")
    sinks.write_features(f, str(tmp_path / "f"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert sorted(lines) == sorted(["#chr1\tx1\tx2\tchr2\ty1\ty2\tname\tscore\tstrand1\tstrand2\tcolor\tp\tq", "a\t3\t4\ta\t3\t4\t.\t.\t.\t.\t0,0,0\t9", "b\t5\t6\tb\t7\t8\t.\t.\t.\t.\t0,0,0\t2\t1"])
    one = spark.createDataFrame([(2, 5, 6), (1, 7, 9)], "chr_idx int, start long, end long")
    sinks.write_one_dimensional(one, str(tmp_path / "g"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()) == ["1\t7\t9", "2\t5\t6"]


def meets(x, y):
    m1, m2, w1, w2 = x[2] + (x[3] - x[2]) // 2, x[5] + (x[6] - x[5]) // 2, (x[3] - x[2]) // 2, (x[6] - x[5]) // 2
    return x[1] == y[1] and y[2] - w1 <= m1 <= y[3] + w1 and y[5] - w2 <= m2 <= y[6] + w2


def crowd(n, first, seed):
    """Nine of ten in one small place, the others anywhere."""
    r = random.Random(seed)
    at = lambda: 500_000 + r.randrange(0, 3000) if r.random() < 0.9 else r.randrange(0, 50_000_000)
    return [(first + i, 1, x := at(), x + r.randrange(1, 60), 1, y := (at() if x > 600_000 else 500_000 + r.randrange(0, 3000)), y + r.randrange(1, 60)) for i in range(n)]


def test_tiles_of_a_crowded_place(spark):
    a, b = crowd(600, 0, 1), crowd(600, 10_000, 2)
    left, right = spark.createDataFrame(a, BOUNDS), spark.createDataFrame(b, BOUNDS)
    want = {(x[0], y[0]) for x in a for y in b if meets(x, y)}
    for most in (20, 200):
        got = [tuple(x) for x in features.hits(left, right, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {x["feature_id"] for x in features.overlap(left, right, most).collect()} == {x for x, _ in want}
    points = [(i, 1, 1, x[2] + i % 7, x[5] + i % 3) for i, x in enumerate(a)]
    asked = spark.createDataFrame(points, "point_id long, chr1_idx int, chr2_idx int, x long, y long")
    inside = {(p[0], f[0]) for p in points for f in b if f[2] <= p[3] <= f[3] and f[5] <= p[4] <= f[6]}
    assert {tuple(x) for x in features.containing(right, asked, 50).collect()} == inside and inside
    stacked = spark.createDataFrame([(i, 1, 0, 1_000_000, 1, 0, 1_000_000) for i in range(150)], BOUNDS)  # one tile, cut into runs
    assert features.hits(stacked, stacked, 20).distinct().count() == features.hits(stacked, stacked, 20).count() == 150 * 150


def test_comparisons_grow_with_the_crowd(spark):
    """Four times as many in the same density: about four times as many comparisons; the search for any partner needs fewer."""
    from tessera.operators import tiles

    made = []
    for n in (500, 2000):
        r = random.Random(n)
        side = int(3000 * (n / 500) ** 0.5)
        rows = [(i, 1, x := 500_000 + r.randrange(0, side), x + 40, 1, y := 500_000 + r.randrange(0, side), y + 40) for i in range(n)] + [(n, 1, 90_000_000, 90_000_001, 1, 90_000_000, 90_000_001)]
        df = spark.createDataFrame(rows, BOUNDS)
        mids, rects = features._mids(df), features._rects(df)
        made.append([f(mids, rects, 100, counted=True).groupBy().sum("compared").first()[0] for f in (tiles.pairs, tiles.those_meeting)])
    assert made[1][0] < 6 * made[0][0] and made[1][1] < 6 * made[0][1] and made[1][0] < 2000 * 2000 / 20
    dense = spark.createDataFrame([(i, 1, 0, 1000 + i, 1, 0, 1000) for i in range(3000)], BOUNDS)
    assert tiles.those_meeting(features._mids(dense), features._rects(dense), 500, counted=True).groupBy().sum("compared").first()[0] <= 3000 * 4 * 6


def plain_unique(a, b):
    have = {(x[1], x[4]) for x in a}
    there, out = list(a), []
    for f in sorted(b):
        if (f[1], f[4]) not in have or not any(meets(f, e) for e in there if e[4] == f[4]):
            out.append(f[0])
            if (f[1], f[4]) in have:
                there.append(f)
    return {x[0] for x in a} | set(out)


@pytest.mark.parametrize("most", [16, 1 << 15])
def test_unique_features_of_a_crowd(spark, most):
    a, b = crowd(40, 0, 5), crowd(500, 1000, 6)
    b += [(9000 + i, 3, i, i + 5, 3, i, i + 5) for i in range(4)]  # a key that a lacks
    got = features.add_unique(spark.createDataFrame(a, BOUNDS), spark.createDataFrame(b, BOUNDS), most)
    assert {r["feature_id"] for r in got.collect()} == plain_unique(a, b)


def test_a_long_chain_of_rivals_takes_few_jobs(spark):
    """Each feature meets the one before and the one after; every other one stays."""
    n = 10_000
    chain = spark.range(n).selectExpr("id AS feature_id", "1 AS chr1_idx", "id * 10 AS start1", "id * 10 + 12 AS end1", "1 AS chr2_idx", "id * 10 AS start2", "id * 10 + 12 AS end2")
    far = spark.createDataFrame([(n, 1, 10**9, 10**9 + 1, 1, 10**9, 10**9 + 1)], BOUNDS)
    spark.sparkContext.setJobGroup("chain", "chain")
    got = features.add_unique(far, chain)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 60
    assert sorted(r["feature_id"] for r in got.collect()) == [*range(0, n, 2), n]


def test_rows_of_one_chromosome_are_not_gathered(spark):
    """Names, cells and features of a few chromosomes stay in the tasks they are in: no task gets all rows of one."""
    chromosomes = spark.createDataFrame([(0, "All", 1), (1, "1", 5), (2, "X", 5), (3, "M", 5)], "idx int, name string, length long")
    many = spark.range(4000, numPartitions=4).select(F.lit("chrX").alias("name"), F.lit(2).alias("chr_idx"), F.lit(2).alias("chr1_idx"), F.col("id").cast("int").alias("bin_x"), F.col("id").cast("int").alias("bin_y"))

    def largest(df):
        return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    found = genome.resolve_names(many.select("name").unionByName(spark.createDataFrame([("7",), (None,)], "name string")), chromosomes)
    assert largest(found) <= 1000 and [tuple(r) for r in found.distinct().collect()] == [("chrX", 2, "X", 5)] and found.count() == 4000
    vector = spark.createDataFrame([(0, 6.0)], "dist int, value double")
    factors = spark.createDataFrame([(2, 2.0)], "chr_idx int, factor double")
    expected = decay.with_expected(many.select("chr1_idx", "bin_x", "bin_y"), F.broadcast(vector), factors)
    assert largest(expected) <= 1000 and [r[0] for r in expected.select("expected").distinct().collect()] == [3.0] and expected.count() == 4000
    own = features.genome_wide_list(chromosomes, many.select(F.col("bin_x").alias("feature_id"), "chr_idx"))
    assert largest(own) <= 1000 and own.columns == ["chr_idx", "feature_id"] and own.dtypes[0][1] == "int"
    assert {r["chr_idx"]: r["count"] for r in own.groupBy("chr_idx").count().collect()} == {1: 1, 2: 4000, 3: 1} and own.where("feature_id IS NULL").count() == 2
