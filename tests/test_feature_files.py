"""Feature lists of four layouts in one folder, good lines and bad ones."""

import logging

import pytest
from pyspark.sql import functions as F

from tessera.operators import features
from tessera.sources import files

BEDPE = "#chr1\tx1\tx2\tchr2\ty1\ty2\tname\tscore\tstrand1\tstrand2\tcolor\to\tfdr_bl\n"
LOOPS = "chr1\tx1\tx2\tchr2\ty1\ty2\tcolor\te_donut\n"


@pytest.fixture
def genome(spark):
    return spark.createDataFrame([(0, "All", 1), (1, "A", 100), (2, "B", 100)], "idx int, name string, length long")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "some_loops.bedpe").write_text(
        BEDPE
        + "chrB\t10\t20\tA\t30\t40\t.\t.\t.\t.\t0,0,255\t7\t0.5\n"  # chromosomes in the other order
        + "A\t50\t60\tA\t5\t9\t.\t.\t.\t.\t1,2\t8\n"  # below the diagonal, half a colour, an attribute fewer
        + "A\t50\t60\tA\t5\t9\n"  # the same bounds again
        + "# a comment\n\n"
        + "A\t1\t2\n"  # too few columns
        + "A\t1\tx\tA\t3\t4\n"  # no number
        + "Z\t1\t2\tA\t3\t4\n"  # no such chromosome
        + "A\t1\t2\tA\t3\t4\t.\t.\t.\t.\t.\t1\t2\t3\n"  # more columns than the first line
    )
    (tmp_path / "old.txt").write_text(LOOPS + "A\t1\t3\tB\t5\t7\t9,8,7\t2.5\nA\t1\t3\tB\t5\t8\n")
    (tmp_path / "domains.PX2").write_text("chr\tstart\tend\tscore\nB\t7\t17\t3\nA\t1.5\t2\t1\n")
    (tmp_path / "pixels.px").write_text("chr1\tx\tchr2\ty\tcolor\tq\tq\nA\t100\tA\t50\t0,1,0\tfirst\tlast\n")
    return tmp_path


def found(df):
    return {(r["chr1_idx"], r["start1"], r["end1"], r["chr2_idx"], r["start2"], r["end2"]): r for r in df.collect()}


def test_all_layouts_in_one_folder(spark, folder, genome):
    got = found(files.read_features(spark, str(folder), genome, mode="permissive"))
    assert set(got) == {(1, 30, 40, 2, 10, 20), (1, 5, 9, 1, 50, 60), (1, 1, 3, 2, 5, 7), (1, 1, 3, 2, 5, 8), (2, 7, 17, 2, 7, 17), (1, 50, 5050, 1, 100, 5100)}
    loop, below = got[1, 30, 40, 2, 10, 20], got[1, 5, 9, 1, 50, 60]
    assert loop["attributes"] == {"observed": "7", "fdrBL": "0.5"} and tuple(loop["color"]) == (0, 0, 255) and (loop["chr1"], loop["chr2"]) == ("A", "B") and loop["feature_type"] == "PEAK"
    assert below["attributes"] == {"observed": "8"} and tuple(below["color"]) == (1, 2, 0)
    assert got[1, 1, 3, 2, 5, 7]["attributes"] == {"expectedDonut": "2.5"} and tuple(got[1, 1, 3, 2, 5, 7]["color"]) == (9, 8, 7) and got[1, 1, 3, 2, 5, 8]["attributes"] == {}
    assert got[2, 7, 17, 2, 7, 17]["attributes"] == {"score": "3"} and got[2, 7, 17, 2, 7, 17]["feature_type"] == "DOMAIN"
    assert got[1, 50, 5050, 1, 100, 5100]["attributes"] == {"q": "last"} and got[1, 50, 5050, 1, 100, 5100]["feature_type"] == "GENERIC"


def test_bad_lines_are_kept_aside(spark, folder, genome, caplog):
    bad = files.bad_lines(spark, str(folder), genome)
    assert sorted((r["reason"], r["_corrupt_record"]) for r in bad.collect()) == [
        ("bounds are not whole numbers", "A\t1\tx\tA\t3\t4"),
        ("bounds are not whole numbers", "A\t1.5\t2\t1"),
        ("more columns than the first line", "A\t1\t2\tA\t3\t4\t.\t.\t.\t.\t.\t1\t2\t3"),
        ("too few columns", "A\t1\t2"),
        ("unknown chromosome", "Z\t1\t2\tA\t3\t4"),
    ]
    with caplog.at_level(logging.WARNING):
        assert files.log_bad_lines(bad, 3) == 3
        assert len(caplog.records) == 4 and "not logged" in caplog.records[-1].getMessage()
        assert files.log_bad_lines(bad) == 5


def test_strict_reading_stops(spark, folder, genome, tmp_path):
    for name in ("some_loops.bedpe", "domains.PX2"):
        with pytest.raises(Exception, match="too few columns|more columns|not whole numbers"):
            files.read_features(spark, str(folder / name), genome).collect()
    assert set(found(files.read_features(spark, str(folder / "old.txt"), genome))) == {(1, 1, 3, 2, 5, 7), (1, 1, 3, 2, 5, 8)}
    only = tmp_path / "unknown.bedpe"
    only.write_text(BEDPE + "Q\t1\t2\tA\t3\t4\nA\t1\t2\tA\t3\t4\n")
    assert set(found(files.read_features(spark, str(only), genome))) == {(1, 1, 2, 1, 3, 4)}  # skipped, as before
    with pytest.raises(ValueError, match="strict or permissive"):
        files.read_features(spark, str(folder), genome, mode="other")
    empty = tmp_path / "empty.bedpe"
    empty.write_text("")
    assert files.read_features(spark, str(empty), genome).count() == 0


def test_large_files_are_split(spark, genome, tmp_path):
    """Parts of a file know its first line; each line is read once."""
    path = tmp_path / "large.bedpe"
    with path.open("w") as f:
        f.write(BEDPE)
        for i in range(30_000):
            f.write(f"A\t{i}\t{i + 1}\tB\t{i}\t{i + 2}\t.\t.\t.\t.\t0,0,0\t{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = files.parse_features(spark, str(path), genome)
        assert rows.rdd.getNumPartitions() > 3
        got = rows.select("start1", features.attribute("observed", "int").alias("o"), "reason").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["start1"] for r in got) == list(range(30_000)) and all(r["o"] == r["start1"] and r["reason"] is None for r in got)


def test_attributes(spark):
    f = spark.createDataFrame([(1, {"a": "1.5", "b": "x"}), (2, None)], "feature_id long, attributes map<string,string>")
    got = features.with_defaults(f, {"a": "9", "c": "0"}).orderBy("feature_id").collect()
    assert [r["attributes"] for r in got] == [{"a": "1.5", "b": "x", "c": "0"}, {"a": "9", "c": "0"}]
    typed = f.select(features.attribute("a", "double").alias("a"), features.attribute("b", "int").alias("b"), features.attribute("b").alias("t")).orderBy(F.desc("a")).first()
    assert tuple(typed) == (1.5, None, "x")
    assert features.set_attribute(f, "b", F.lit("y")).orderBy("feature_id").first()["attributes"]["b"] == "y"
    assert [r["k"] for r in f.select(features.attribute_keys().alias("k")).collect()] == [["a", "b"], []] and features.clear_attributes(f).first()["attributes"] == {}


def test_genomes_of_a_folder(spark, tmp_path):
    from tessera.operators import genome as operators

    (tmp_path / "b38.chrom.sizes").write_text("chr1 100\nchr2\t50\n\nthree words here\n")
    (tmp_path / "a19.chrom.sizes").write_text("chr1 99\nchr2 50\nchrX many")
    (tmp_path / "notes.txt").write_text("chr1 100\n")
    known = files.read_genomes(spark, str(tmp_path))
    assert sorted(tuple(r) for r in known.collect()) == [("a19", "a19", "chr1", 99), ("a19", "a19", "chr2", 50), ("b38", "b38", "chr1", 100), ("b38", "b38", "chr2", 50)]
    named = lambda rows: operators.infer_genome(spark.createDataFrame(rows, "idx int, name string, length long"), known).first()["genome"]
    assert named([(1, "chr1", 100)]) == "b38" and named([(1, "chr1", 99), (2, "chr2", 50)]) == "a19" and named([(1, "chr2", 50)]) == "a19" and named([(1, "chr2", 51)]) is None
