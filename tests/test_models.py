"""Spline models, labels, lookups and small helpers against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import catalog, kinds, semantics
from tessera.operators import contacts, decay, features, genome, matrix, oe

MAPS = "chr1_idx int, chr2_idx int, bin_size int, bin_x int, bin_y int, counts double"


def spline(x, y):
    """A natural cubic spline by its 4 (n - 1) equations."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    power = lambda t, d: np.array([math.prod(range(k - d + 1, k + 1)) * t ** max(0, k - d) if k >= d else 0.0 for k in range(4)])
    for i in range(n):
        for at, value in ((x[i], y[i]), (x[i + 1], y[i + 1])):
            a[row, 4 * i : 4 * i + 4], b[row] = power(at, 0), value
            row += 1
    for i in range(n - 1):
        for d in (1, 2):
            a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8] = power(x[i + 1], d), -power(x[i + 1], d)
            row += 1
    a[row, :4] = power(x[0], 2)
    a[row + 1, -4:] = power(x[-1], 2)
    c = np.linalg.solve(a, b)

    def at(t):
        t = min(max(t, x[0]), x[-1])
        i = min(n - 1, max(0, int(np.searchsorted(x, t, "right")) - 1))
        return float(power(t, 0) @ c[4 * i : 4 * i + 4])

    return at


def some_contacts(seed, far):
    r = random.Random(seed)
    return [(x, x + d, float(r.randrange(1, 2 + 200 // (d + 1)))) for x in range(0, 60) for d in r.sample(range(far), min(far, 14))]


def plain_knots(cells, most):
    groups, at, width = [], 0, 1
    while at < most:
        for _ in range(10):
            groups.append((at, width))
            at += width
        width *= 5
    by = {}
    for x, y, c in cells:
        if y - x < most:
            by.setdefault(y - x, []).append(math.log1p(c))
    out = []
    for first, width in groups:
        places = range(first, min(first + width, most))
        own = [v for d in places for v in by.get(d, [])]
        if own and (len(places) == width or (len(places) > 10 and len(own) > 100)):
            out.append((sum(math.log1p(d) for d in places) / len(places), sum(own) / len(own)))
    tail = [v for d in by if d >= int(0.75 * most) for v in by[d]]
    return sorted(out + ([(math.log1p(most) + 1, sum(tail) / len(tail))] if tail else []))


@pytest.mark.parametrize("seed,far,most", [(1, 40, 50), (2, 150, 120)])
def test_log_spline(spark, seed, far, most):
    cells = some_contacts(seed, far)
    df = spark.createDataFrame([(1, 1, 1, x, y, c) for x, y, c in cells], MAPS)
    model = decay.LogSpline(df, most)
    knots = plain_knots(cells, most)
    f = spline([k[0] for k in knots], [k[1] for k in knots])
    highest = max(float(int(math.log1p(most))), knots[0][0])
    expected = lambda d: math.expm1(f(min(math.log1p(d), highest)))
    near = math.expm1(f(0.5))
    dist = F.col("bin_y") - F.col("bin_x")
    columns = model.expected(dist).alias("e"), model.percent_contact(F.col("counts"), dist).alias("p"), model.reasonable(F.col("counts"), dist, 0.1, 0.9).alias("r"), model.enriched(F.col("counts"), dist, 1.5).alias("u")
    for r in df.select((dist).alias("d"), "counts", *columns).collect():
        e = expected(r["d"])
        assert r["e"] == pytest.approx(e, rel=1e-6, abs=1e-9)
        if abs(near - e) > 1e-6:
            p = (r["counts"] - e) / (near - e)
            assert r["p"] == pytest.approx(p, rel=1e-4)
            assert min(abs(p - 0.1), abs(p - 0.9)) < 1e-6 or r["r"] == (0.1 < p < 0.9)
        assert abs(r["counts"] / e - 1.5) < 1e-6 or r["u"] == (r["counts"] / e > 1.5)


@pytest.mark.parametrize("seed,far,most", [(3, 40, 50), (4, 300, 250)])
def test_z_spline(spark, seed, far, most):
    cells = [c for c in some_contacts(seed, far) if c[1] - c[0] < most]
    df = spark.createDataFrame([(1, 1, 1, x, y, c) for x, y, c in cells], MAPS)
    buckets = {}
    for x, y, c in cells:
        d = y - x
        buckets.setdefault(0 if d == 0 else 1 + math.floor(math.log1p(d)), []).append((d, math.log1p(d), math.log1p(c)))
    rows = [(float(np.mean([v[1] for v in own])), float(np.mean([v[2] for v in own])), float(np.std([v[2] for v in own], ddof=1)) if len(own) > 2 else 0.0, max(v[0] for v in own)) for _, own in sorted(buckets.items())]
    x = [r[0] for r in rows]
    mean, std = spline(x, [r[1] for r in rows]), spline(x, [r[2] for r in rows])
    highest = float(int(math.log1p(min(most, max(int(math.expm1(max(x))), max(r[3] for r in rows))))))
    model = decay.ZSpline(df, most)
    dist = F.col("bin_y") - F.col("bin_x")
    for r in df.select(dist.alias("d"), "counts", model.z(F.col("counts"), dist).alias("z"), model.expected(dist).alias("e"), model.value(F.lit(1.5), dist).alias("v")).collect():
        at = min(math.log1p(r["d"]), highest)
        assert r["e"] == pytest.approx(math.expm1(mean(at)), rel=1e-6, abs=1e-9)
        assert r["v"] == pytest.approx(math.expm1(mean(at) + 1.5 * std(at)), rel=1e-6, abs=1e-9)
        if std(at) > 1e-6:
            assert r["z"] == pytest.approx((math.log1p(r["counts"]) - mean(at)) / std(at), rel=1e-5, abs=1e-7)


def test_moments_filled_up_with_zeros(spark):
    r = random.Random(9)
    own = {0: [r.random() - 0.7 for _ in range(30)], 1: [5.0, 7.0], 2: [-1.0], 4: [3.0, 3.0, 3.0, 9.0]}
    lengths = {0: 40, 1: 2, 2: 3, 3: 5, 5: 0}
    df = spark.createDataFrame([(k, v) for k, some in own.items() for v in some], "bucket int, c double")
    filled = decay.moments(df, "bucket", "c", spark.createDataFrame(list(lengths.items()), "bucket int, length int"))
    for got, add in ((decay.moments(df, "bucket", "c"), {}), (filled, lengths)):
        want = {k: own.get(k, []) + [0.0] * max(0, add.get(k, 0) - len(own.get(k, []))) for k in {*own, *add}}
        rows = {x["bucket"]: x for x in got.collect()}
        assert set(rows) == {k for k, v in want.items() if v}
        for k, x in rows.items():
            v = want[k]
            std = float(np.std(v, ddof=1)) if len(v) > 2 else 0.0
            assert tuple(x)[1:] == pytest.approx((len(v), float(np.mean(v)), std, min(v), max(*v, 0.0), max(*v, 0.0) - min(v)), abs=1e-12)


def test_relevant_derivatives(spark):
    m = np.array([[1.0, 1.0, 4.0, 4.2, 9.0], [2.0, 2.0, 1.0, 1.1, -9.0]])
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(2) for j in range(5)], "row int, col int, value double")
    d = m[:, :-1] - m[:, 1:]
    for discrete in (False, True):
        for positive in (False, True):
            own = np.rint(np.clip(d * 2, -3, 3)) if discrete else d
            own = own[:, np.abs(own).sum(axis=0) > 0]
            own = (own if discrete else np.clip(own * 2, -3, 3)) + (3 if positive else 0)
            got = {(r["row"], r["col"]): r["value"] for r in matrix.relevant_derivative(df, 2.0, 3.0, positive, discrete).collect()}
            assert got == {(i, j): pytest.approx(own[i, j]) for i in range(2) for j in range(own.shape[1])}


def test_functions_of_a_pairs_features(spark):
    bounds = "feature_id long, chr1_idx int, start1 long, end1 long, chr2_idx int, start2 long, end2 long"
    r = random.Random(2)
    rows = [(i, 1 if i < 90 else r.choice([1, 2]), x := r.randrange(1000), x + 5, 2, 7, 9) for i in range(100)]
    f = spark.createDataFrame(rows, bounds).repartition(3)

    def sized(frame):
        out = frame.copy()
        out["end2"] = len(frame)
        return out

    def in_order(frame):
        assert frame["start1"].is_monotonic_increasing
        return sized(frame)

    whole = {x["feature_id"]: x["end2"] for x in features.process_by_key(f, sized).collect()}
    pairs = [sum(x[1] == c for x in rows) for c in (1, 2)]
    assert whole == {x[0]: pairs[x[1] - 1] for x in rows}
    runs = features.process_by_key(f, in_order, 20).collect()
    assert sorted(x["feature_id"] for x in runs) == list(range(100)) and max(x["end2"] for x in runs) <= 20
    own = sorted((x["start1"], x["feature_id"], x["end2"]) for x in runs if x["chr1_idx"] == 1)
    assert [n for _, _, n in own] == [20] * (len(own) // 20 * 20) + [len(own) % 20] * (len(own) % 20)


def test_lookups(spark):
    bounds = "feature_id long, chr1_idx int, start1 long, end1 long, chr2_idx int, start2 long, end2 long"
    f = spark.createDataFrame([(1, 1, 5, 9, 11, 5, 9), (2, 11, 5, 9, 11, 5, 9), (3, 1, 5, 9, 11, 5, 8)], bounds)
    assert [r["feature_id"] for r in features.exact(f, 1, 5, 9, 11, 5, 9).collect()] == [1]
    assert features.exact(f, 1, 5, 9, 1, 5, 9).count() == 0
    names = spark.createDataFrame([(" chrX ",), ("MT",), ("chrmt",), ("2",)], "name string")
    assert [r[0] for r in names.select(genome.clean_name(F.col("name"))).collect()] == ["X", "M", "M", "2"]
    assert [r[0] for r in names.select(genome.clean_name(F.col("name"), "mm10")).collect()] == [" chrX ", "MT", "chrmt", "2"]
    assert catalog.finest_resolution("gw_kr") == 25_000 and catalog.finest_resolution("kr") == 0
    assert catalog.first_valid_norm(["kr", "Scale"], ["VC", "scale"]) == "SCALE" and catalog.norm_label(" own ") == "OWN"
    with pytest.raises(ValueError):
        catalog.first_valid_norm(["kr"], ["VC"])
    assert catalog.unit_of("bp") == "BP" and catalog.unit_of("x") is None and catalog.unit_of(None) is None
    assert catalog.BUILT_BY_DEFAULT == ("VC", "VC_SQRT", "SCALE", "INTER_SCALE", "GW_SCALE") and len(catalog.NORMS) == 11


def test_traits_of_matrix_kinds():
    of = kinds.kinds_of
    assert set(catalog.MATRIX_KINDS) <= set(kinds.LABELS) and len(kinds.TRAITS) == 13
    assert of("plain map") == ["OBSERVED", "CONTROL"] and of("written as a vector") == ["EXPECTED", "NORM"] and of("written as a matrix") == ["OBSERVED", "OE"]
    assert of("correlation") == ["PEARSON", "PEARSONCTRL", "PEARSONVS"] and of("correlation of the control") == ["PEARSONCTRL", "PEARSONVS"]
    assert of("difference") == ["OME", "CME", "OERATIOMINUS", "OERATIOMINUSP1", "OCMEVS", "DIFF"]
    assert set(of("side by side")) == {k for k in kinds.LABELS if k.endswith("VS") or k in ("OEVSV2", "OEVSP1", "OEVSP1V2", "NORM2OBSVSCTRL")}
    assert set(of("whole genome")) | set(of("expected values")) == set(kinds.LABELS) and not set(of("whole genome")) & set(of("expected values"))
    assert {"PROB", "PROB2", "PEARSON", "VS"} <= set(of("within chromosomes only")) and "OE" not in of("within chromosomes only")
    assert {"CONTROL", "VS", "RATIO", "DIFF"} <= set(of("control without expected values")) and not {"OECTRL", "OBSERVED"} & set(of("control without expected values"))
    assert set(of("adjustable colors")) == set(kinds.LABELS) - set(of("correlation")) and {"OEV2", "DIFF"} <= set(of("colors around zero")) and "OE" not in of("colors around zero")


def test_small_helpers(spark):
    nan, inf = float("nan"), float("inf")
    own = spark.createDataFrame([(0, 2.5), (1, 0.0), (2, -3.0), (3, nan), (4, inf), (5, 1.0), (6, 1e-12)], "i int, v double")
    v = F.col("v")
    got = own.select("i", oe.inter_expected(v).alias("e"), semantics.clamp(v, -1.0, 2.0).alias("c"), semantics.signum_clean(v).alias("s"), semantics.simple_log_clean(v).alias("l"), semantics.log_oe_plus(v, F.lit(3.0), 1.0).alias("o")).orderBy("i").collect()
    assert [r["e"] for r in got][:3] == [2.5, 1.0, 1.0] and got[5]["e"] == 1.0
    assert [r["c"] for r in got][:3] == [2.0, 0.0, -1.0] and math.isnan(got[3]["c"]) and got[4]["c"] == 2.0
    assert [r["s"] for r in got] == [1.0, 0.0, -1.0, 0.0, 1.0, 1.0, 1.0]
    assert got[0]["l"] == pytest.approx(math.log(2.5)) and all(math.isnan(got[i]["l"]) for i in (1, 2, 3, 4, 5)) and got[6]["l"] == pytest.approx(math.log(1e-12))
    assert got[0]["o"] == pytest.approx(math.log(3.5) / math.log(4.0))
    text = spark.createDataFrame([("abcdefghij", "a\tb\tc"), ("abcdef", "x"), ("", "")], "t string, k string")
    assert [tuple(r) for r in text.select(semantics.middle_ellipsis(F.col("t"), 3), semantics.token_from_end(F.col("k"), 1), semantics.token_from_end(F.col("k"), 2)).collect()] == [("abc...hij", "c", "b"), ("abcdef", "x", None), ("", "", None)]
    assert contacts.source_resolution([10, 25, 50, 100], 100) == 50 and contacts.source_resolution([10, 30, 50], 60) == 30
    with pytest.raises(ValueError):
        contacts.source_resolution([40], 100)


def test_summaries_and_averages(spark):
    cells = [(1, 1, 10, 0, 0, 2.0), (1, 1, 10, 0, 3, 5.0), (1, 1, 10, 2, 2, -1.0), (1, 1, 10, 1, 2, float("nan")), (1, 2, 10, 4, 4, 8.0)]
    df = spark.createDataFrame(cells, MAPS)
    got = {(r["chr1_idx"], r["chr2_idx"]): (r["n"], r["n_positive"], r["total"]) for r in contacts.summary(df.where("NOT isnan(counts)")).collect()}
    assert got == {(1, 1): (3, 2, 2.0 + 2 * 5.0), (1, 2): (1, 1, 8.0)}  # of a record on the diagonal one triangle has it
    lengths = spark.createDataFrame([(1, "a", 57), (2, "b", 80)], "idx int, name string, length long")
    average = {(r["chr1_idx"], r["chr2_idx"]): r["average"] for r in contacts.average_count(df.where("chr2_idx = 2"), lengths).collect()}
    assert average == {(1, 2): pytest.approx(8.0 / 5 / 8)}
