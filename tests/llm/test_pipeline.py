"""The pipeline's stages on null ids, repeated ids and rows, clashing columns, empty tables and long texts, and the whole of it."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, score string, lang_id int, n_removed string, d int, t string, id int, a int, n int, copies int"
EXTRA = (1, "k", "s", 2, "r", 3, "t", 4, 5, 6, 7)
STAGES = dict(corpus_pipeline.STAGES)
KEEPING = [n for n in STAGES if n != "packing"]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "line dedup", "SimHash near-dedup", "packing"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the test table, beside rows with odd ids, repeated rows and texts of odd sizes."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(150).collect()
    rows = [(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), *EXTRA) for r in docs]
    rows += [(None, docs[0]["text"] + " and more", "en", None, 1, *EXTRA), (None, "another without an id", "en", None, 1, *EXTRA), rows[5], (rows[6][0], "other text of that id", None, None, None, *EXTRA)]
    rows += [(9000, None, "en", "a.b", 0, *EXTRA), (9001, "", "en", "a.b", 0, *EXTRA), (9002, docs[1]["text"] * 50, "en", "a.b", 1, *EXTRA)]
    return spark.createDataFrame(rows, CLASHING).cache()


@pytest.mark.parametrize("name", KEEPING)
def test_stages_keep_rows_and_columns(spark, odd, name):
    got = STAGES[name](spark, odd, DATA).cache()
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    kept = got.select("doc_id", "row", "key", "score", "lang_id", "n_removed", "d", "t", "id", "a", "n", "copies")
    assert kept.subtract(odd.select(kept.columns)).count() == 0  # other columns as they were
    assert 0 < got.count() <= odd.count()
    assert STAGES[name](spark, odd.limit(0), DATA).count() == 0
    # the same rows in other partitions give the same result
    again = STAGES[name](spark, odd.repartition(5), DATA)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_packing_of_odd_rows(spark, odd):
    pieces = STAGES["packing"](spark, odd, DATA).cache()
    firsts = pieces.where("start = 0")
    assert firsts.count() == odd.count() and pieces.agg(F.sum("length")).first()[0] == firsts.agg(F.sum("doc_tokens")).first()[0]
    assert STAGES["packing"](spark, odd.limit(0), DATA).count() == 0


def test_near_duplicates_are_dropped_by_row(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a = words(300)
    near = [*a[:150], "changed", *a[151:]]
    texts = {k: " ".join(words(200)) for k in "bcdef"}
    rows = [(1, " ".join(a)), (3, " ".join(near)), (3, texts["b"]), (5, texts["c"]), (5, texts["d"]), (None, texts["e"]), (None, texts["f"]), (7, " ".join(a)), (7, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 9):
        got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"]) for x in corpus_pipeline.dedup_near(spark, df.repartition(n), "").collect())
        assert got == sorted([(1, rows[0][1]), (3, texts["b"]), (5, texts["c"]), (5, texts["d"]), (-1, texts["e"]), (-1, texts["f"])])


def test_the_whole_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
    whole = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert whole.columns == docs.columns
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
    assert 0.5 < whole.select("doc_id").distinct().count() / spark.read.parquet(f"{DATA}/documents.parquet").count() <= 1
