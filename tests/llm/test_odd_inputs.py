"""Extra columns whose names clash, repeated rows, ties and very long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, lang_id, license_scan, packing, simhash, token_shards

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CLASHING = "t string, ids int, size string, fp int, key string, row int, shard string, line string, unit int, license int, dice string, root int, bucket string, rank string, start string, length string, sequence_id string, offset string, n_tokens string, component_id string, fingerprint int, l int, p string, says int"
TEXTS = ["All rights reserved.", "Released under the MIT License.\n\nand more of it", "", None, "one two three four five", "one two three four five", "x " * 500, "Ünï çödé"]


def rows(spark, clashing):
    df = spark.createDataFrame([*enumerate(TEXTS), (1, TEXTS[1]), (None, "no id")], "doc_id long, text string")
    for c in CLASHING.split(", ") if clashing else ():
        name, kind = c.split()
        df = df.withColumn(name, F.lit(7).cast(kind))
    return df


def shards(df, folder):
    return token_shards.read_shards(token_shards.write_shards(df, BYTE, 0, f"file://{folder}", shard_bytes=200))


@pytest.mark.parametrize(
    "run",
    [
        lambda df, folder: license_scan.scan(df),
        lambda df, folder: simhash.near_duplicates(df),
        lambda df, folder: packing.pack(df, WORD, 1, capacity=64).drop("sequence_id", "offset"),
        lambda df, folder: bpe.digests(df, WORD),
        shards,
    ],
    ids=["license", "simhash", "packing", "bpe", "shards"],
)
def test_clashing_columns_change_nothing(spark, tmp_path, run):
    plain, clashing = run(rows(spark, False), tmp_path / "a"), run(rows(spark, True), tmp_path / "b")
    assert plain.columns == clashing.columns
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(plain) == order(clashing) and plain.count()


def test_ties_repeated_rows_and_no_templates(spark):
    twice = [("b-licence", "you may use this work freely"), ("a-licence", "you may use this work freely")]
    df = spark.createDataFrame([(1, "You may use this work freely!"), (1, "You may use this work freely!"), (2, "you may, use this; work freely\nyou may use this work freely")], "doc_id long, text string")
    found = sorted(tuple(r) for r in license_scan.scan(df, twice).collect() if r["line"] is not None)
    assert {(d, line, name) for d, line, name, _ in found} == {(1, 0, "a-licence"), (2, 0, "a-licence"), (2, 1, "a-licence")} and all(x[3] == 1.0 for x in found)
    assert license_scan.scan(df, []).count() == 0


def test_language_of_a_very_long_text(spark):
    words = {"en": "the house and the garden of this man ", "de": "das Haus und der Garten von diesem Mann "}
    some = [(i, words["de" if i % 2 else "en"] * 5, "de" if i % 2 else "en", "a.org") for i in range(60)]
    some += [(100, words["de"] * 60_000, None, None), (100, words["de"] * 60_000, None, None)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string")
    got = lang_id.identify(df, "doc_id", F.col("text"), F.col("lang"), F.col("source")).where("doc_id = 100").select("lang_id", "lang_posterior", "lang_kept").collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["lang_id"] == "de" and got[0]["lang_kept"]
