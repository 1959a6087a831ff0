"""Properties, and brute force where SQL cannot say it."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import contacts, correlate, decay, features, matrix
from tessera.sinks import text as sinks
from tessera.sources import files

BOUNDS = "feature_id long, chr1_idx int, start1 long, end1 long, chr2_idx int, start2 long, end2 long"


def brute_add_unique(a, b):
    have = {(r[1], r[4]) for r in a}
    there, out = list(a), [r[0] for r in a]
    for r in sorted(b):
        _, c1, s1, e1, c2, s2, e2 = r
        m1, m2, w1, w2 = s1 + (e1 - s1) // 2, s2 + (e2 - s2) // 2, (e1 - s1) // 2, (e2 - s2) // 2
        hit = any(x[1] == c1 and x[4] == c2 and x[2] - w1 <= m1 <= x[3] + w1 and x[5] - w2 <= m2 <= x[6] + w2 for x in there)
        if (c1, c2) not in have or not hit:
            out.append(r[0])
            there.append(r)
    return sorted(out)


def some_features(n, first, seed, keys):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k, s1, s2 = r.choice(keys), r.randrange(0, 4000, 50), r.randrange(0, 4000, 50)
        out.append((first + i, k, s1, s1 + r.randrange(100, 600), k, s2, s2 + r.randrange(100, 600)))
    return out


def test_add_unique_is_greedy(spark):
    a, b = some_features(15, 0, 1, [1, 2]), some_features(120, 100, 2, [1, 2, 3])
    got = features.add_unique(spark.createDataFrame(a, BOUNDS), spark.createDataFrame(b, BOUNDS))
    assert sorted(r[0] for r in got.select("feature_id").collect()) == brute_add_unique(a, b)


def test_overlap_does_not_depend_on_tiles(spark):
    a, b = (spark.createDataFrame(some_features(60, 0, s, [1]), BOUNDS) for s in (3, 4))
    small, large = ({r[0] for r in features.overlap(a, b, t).select("feature_id").collect()} for t in (100, 1 << 20))
    assert small == large


def test_coarsen_in_two_steps(spark):
    rows = [(1, 1, 10, x, y, 1.0 + x) for x in range(40) for y in range(x, 40, 3)]
    df = spark.createDataFrame(rows, "chr1_idx int, chr2_idx int, bin_size int, bin_x int, bin_y int, counts double")
    once, twice = contacts.coarsen(df, 100, 10), contacts.coarsen(contacts.coarsen(df, 20, 10), 100, 20)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_pearson_is_corrcoef(spark):
    rng = np.random.default_rng(0)
    n = 12
    upper = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.6))
    dense = upper + upper.T - np.diag(np.diag(upper))
    rows = [(1, 1, 1, i, j, float(upper[i, j])) for i in range(n) for j in range(i, n) if upper[i, j]]
    df = spark.createDataFrame(rows, "chr1_idx int, chr2_idx int, bin_size int, bin_x int, bin_y int, oe double")
    want = np.corrcoef(dense - dense.mean(axis=0))
    for r in correlate.pearson(df, n).collect():
        assert abs(r["value"] - want[r["row"], r["col"]]) < 1e-9


def test_rolling_median_of_short_vectors(spark):
    v = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([5, 1, 4, 2, 3])], "k int, dist int, value double")
    assert [r["value"] for r in decay.rolling_median(v, 1, "k").orderBy("dist").collect()] == [5, 4, 2, 3, 2.5]
    assert [r["value"] for r in decay.rolling_median(v, 5, "k").orderBy("dist").collect()] == [5, 1, 4, 2, 3]


def test_normalise_keeps_infinities_and_drops_nan(spark):
    c = spark.createDataFrame([(1, 1, 1, 0, 1, 2.0), (1, 1, 1, 1, 1, 2.0), (1, 1, 1, 1, 2, 2.0), (1, 1, 1, 0, 3, 2.0)], "chr1_idx int, chr2_idx int, bin_size int, bin_x int, bin_y int, counts double")
    v = spark.createDataFrame([(1, 1, 0, 1.0), (1, 1, 1, 0.0), (1, 1, 2, float("nan"))], "chr_idx int, bin_size int, bin int, value double")
    assert [r["counts"] for r in contacts.normalise(c, v).collect()] == [float("inf")] * 2


def test_feature_files_and_export(spark, tmp_path):
    path = tmp_path / "loops.bedpe"
    path.write_text("#chr1\tx1\tx2\tchr2\ty1\ty2\tname\tscore\ts1\ts2\tcolor\tobserved\nchrB\t10\t20\tchrA\t30\t40\t.\t.\t.\t.\t0,0,255\t7\n# no feature\nchrZ\t1\t2\tchrA\t1\t2\t.\t.\t.\t.\t0,0,0\t1\n")
    genome = spark.createDataFrame([(1, "A", 100), (2, "B", 100)], "idx int, name string, length long")
    got = files.read_features(spark, str(path), genome).collect()
    assert len(got) == 1 and (got[0]["chr1_idx"], got[0]["start1"], got[0]["chr2_idx"], got[0]["start2"]) == (1, 30, 2, 10)
    assert got[0]["attributes"] == {"observed": "7"} and got[0]["feature_type"] == "PEAK" and got[0]["color"]["b"] == 255
    sinks.write_features(files.read_features(spark, str(path), genome), str(tmp_path / "out"))
    header = "#chr1\tx1\tx2\tchr2\ty1\ty2\tname\tscore\tstrand1\tstrand2\tcolor\tobserved"
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == [header, "A\t30\t40\tB\t10\t20\t.\t.\t.\t.\t0,0,255\t7"]


def test_chromosome_sizes(spark, tmp_path):
    path = tmp_path / "x.chrom.sizes"
    path.write_text("chr1 100\n\nchr2\t50\none two three\nchr3 7")
    assert [tuple(r) for r in files.read_chromosomes(spark, str(path)).orderBy("idx").collect()] == [(1, "chr1", 100), (2, "chr2", 50), (3, "chr3", 7)]


def test_matrix_text(spark, tmp_path):
    m = spark.createDataFrame([(1, 1, 4.0), (0, 1, 2.0), (0, 0, 1.0), (1, 0, 3.0)], "row int, col int, value double")
    sinks.write_matrix(m, str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["1.0, 2.0", "3.0, 4.0"]
    assert matrix.partitions(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert m.where(F.col("row") == 0).count() == 2
