"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A line is what lies between line feeds, compared without spaces at its ends; lines without words are passed over. A gram
is the fewest lines on from a line that hold GRAM_WORDS words, a span the fewest lines on from a line, or back from
it, that hold RUN_WORDS words. A line's window are the grams that begin within the first RUN_WORDS - GRAM_WORDS words from it on;
all of them lie within its span. The gram of smallest hash in each window is a fingerprint. Copies of a run of
RUN_WORDS words have a span, so its window, so its fingerprint in common, however the words are dealt to lines and whatever
stands around them.

Fingerprints found at more than one place are joined to the spans that they were chosen for. Such spans are compared
whole: each place of a span but the first (by doc_id, text hash and line) repeats it. A repeated run consists of such
spans: those on from its lines and those back from its lines cover all of it, so matches are extended both ways to
its ends by joining spans that overlap or touch. All later places of a run are found, also where its lines first
occur elsewhere without the rest of it. They are deleted; the first place of every span stays.

Words are counted as spaces within a line plus one. Lines are equal if 60 bits of their MD5 and their
word counts are. Rows that share doc_id and text are one document and are treated alike; rows that share
only doc_id are different ones. A null doc_id comes before all others. Null texts stay null, empty ones
empty; a document of which every line goes has an empty text. The result has the input's columns and n_removed, which
replaces one of that name; an empty table gives an empty one. A key's places are never gathered: they are counted and joined,
and a hot fingerprint costs a row for each of its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

GRAM_WORDS = 12
RUN_WORDS = 50


def hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lines_of(docs: DataFrame) -> DataFrame:
    """d (doc_id), t (hash of the text), row, pos (from 0), h (the line's hash), n (its words); lines without words are left out."""
    line = F.trim("line")
    lines = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("row"), "text")
    lines = lines.select("d", "t", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(line != "")
    words = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return lines.select("d", "t", "row", "pos", hash60(line).alias("h"), words.alias("n"))


def spans(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """d, t, first, last (lines), span (its hash), g and at (the fingerprint of its first line's window, and where that is)."""
    in_order = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines_of(docs).withColumn("upto", F.sum("n").over(in_order)).withColumn("before", F.col("upto") - F.col("n"))
    on = Window.partitionBy("row").orderBy("before")
    back = Window.partitionBy("row").orderBy("upto").rangeBetween(1 - run_words, 0)
    ahead = on.rangeBetween(0, run_words - 1)
    words = F.concat_ws(":", F.col("h").cast("string"), F.col("n").cast("string"))
    hashed = lambda frame: hash60(F.array_join(F.collect_list(words).over(frame), ","))
    lines = lines.withColumn("g", hashed(on.rangeBetween(0, gram_words - 1)))
    lines = lines.withColumn("f", F.min(F.struct("g", "pos")).over(on.rangeBetween(0, run_words - gram_words)))
    found = lines.select(
        "d",
        "t",
        F.struct(F.col("pos").alias("first"), F.max("pos").over(ahead).alias("last"), hashed(ahead).alias("span"), "f", F.sum("n").over(ahead).alias("n")).alias("ahead"),
        F.struct(F.min("pos").over(back).alias("first"), F.col("pos").alias("last"), hashed(back).alias("span"), F.first("f").over(back).alias("f"), F.sum("n").over(back).alias("n")).alias("back"),
    )
    each = found.select("d", "t", F.explode(F.array("ahead", "back")).alias("s")).where(F.col("s.n") >= run_words)
    return each.select("d", "t", "s.first", "s.last", "s.span", F.col("s.f.g").alias("g"), F.col("s.f.pos").alias("at"))


def later_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """d, t, runs: for each document with repeated runs to delete their first and last lines."""
    every = common.save(spans(docs, run_words), "line-spans")
    where = F.xxhash64("d", "t", "at")
    repeated = every.groupBy("g").agg(F.min(where).alias("one"), F.max(where).alias("other")).where("one <> other").select("g")
    met = every.join(repeated, "g", "left_semi").select("span", "d", "t", "first", "last")
    place = F.struct("d", "t", "first", "last")
    firsts = met.groupBy("span").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other").select("span", "one")
    later = met.join(firsts, "span").where(place > F.col("one")).select("d", "t", "first", "last").distinct()

    in_order = Window.partitionBy("d", "t").orderBy("first", "last")
    reached = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = later.withColumn("begins", F.when(F.col("first") <= reached + 1, 0).otherwise(1))
    runs = begins.withColumn("run", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("d", "t", "run").agg(F.min("first").alias("start"), F.max("last").alias("end"))
    return runs.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs deleted from text, and n_removed, the lines that went."""
    own = common.apart(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    runs = later_runs(docs, run_words)
    joined = own.join(runs, F.col("id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("t")), "left")
    text = F.col("row.text")
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i <= r["end"])))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + (r["end"] - r["start"] + 1).cast("int"))
    text = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    columns = [text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_removed"]
    return joined.select(*columns, F.coalesce(removed, F.lit(0)).alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents", "doc_id", "text"))


#: What must go, without fingerprints: every line of a span that is at an earlier place too.
OP2_SQL = """
WITH lines AS (
  SELECT doc_id AS d, u.pos - 1 AS pos, trim(u.line) AS line
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos) u
), counted AS (
  SELECT d, pos, line, strlen(line) - strlen(replace(line, ' ', '')) + 1 AS n FROM lines WHERE line <> ''
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY d ORDER BY pos)::BIGINT AS upto, (sum(n) OVER (PARTITION BY d ORDER BY pos) - n)::BIGINT AS before FROM counted
), spans AS (
  SELECT d, pos AS first_line, max(pos) OVER w AS last_line, list(line) OVER w AS span, sum(n) OVER w AS n
  FROM summed WINDOW w AS (PARTITION BY d ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT d, min(pos) OVER w, pos, list(line) OVER w, sum(n) OVER w
  FROM summed WINDOW w AS (PARTITION BY d ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), hashed AS (
  SELECT d, first_line, last_line, md5(array_to_string(span, chr(10))) AS span FROM spans WHERE n >= 50
), placed AS (
  SELECT *, first_value((d, first_line, last_line)) OVER (PARTITION BY span ORDER BY d, first_line, last_line) AS one FROM hashed
), gone AS (
  SELECT d, list(DISTINCT pos) AS gone FROM (
    SELECT d, unnest(range(first_line, last_line + 1)) AS pos FROM placed WHERE (d, first_line, last_line) <> one
  ) GROUP BY d
)
SELECT doc_id, CASE WHEN gone IS NULL THEN text
    ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
  coalesce(len(gone), 0)::INTEGER AS n_removed
FROM documents LEFT JOIN gone ON d = doc_id
"""
