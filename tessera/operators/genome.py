"""The chromosome dimension: (idx, name, length), index 0 being the whole genome where it is present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "All"
#: Fixed value: assemblies that go by another name.
GENOME_ALIASES = {"GRCm38": "mm10"}


def with_all(chromosomes: DataFrame) -> DataFrame:
    """Prepends the pseudo-chromosome All of a thousandth of the total length; one that is there already is replaced."""
    real = chromosomes.where("idx > 0")
    return real.agg(F.lit(0).alias("idx"), F.lit(ALL).alias("name"), F.expr("sum(length) div 1000").alias("length")).unionByName(real)


def with_assembly(chromosomes: DataFrame, name: str = "pseudoassembly") -> DataFrame:
    """Appends a chromosome as long as all others together."""
    real = chromosomes.where("idx > 0")
    last = real.agg((F.max("idx") + 1).alias("idx"), F.lit(name).alias("name"), F.sum("length").alias("length"))
    return chromosomes.unionByName(last)


def clean_name(name: Column, genome: str = "hg19") -> Column:
    """Only hg19 names are cleaned: without spaces and "chr", in capitals, M for MT."""
    if genome != "hg19":
        return name
    short = F.upper(F.replace(F.trim(name), F.lit("chr"), F.lit("")))
    return F.when(short == "MT", F.lit("M")).otherwise(short)


def name_key(name: Column) -> Column:
    """Names are one and the same if they agree in lower case and without "chr"."""
    return F.replace(F.lower(F.trim(name)), F.lit("chr"), F.lit(""))


def resolve_names(names: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """names (name): those that the genome knows, with its idx, name and length."""
    asked = names.select(F.col("name").alias("asked"), name_key(F.col("name")).alias("k"))
    return asked.join(F.broadcast(chromosomes.withColumn("k", name_key(F.col("name")))), "k").drop("k")  # a row a chromosome: names asked for often are not gathered in one task


def is_all(name: Column) -> Column:
    return F.lower(name).contains("all")


def is_genome_wide(name: Column) -> Column:
    return F.lower(name) == "genomewide"


def autosomes(chromosomes: DataFrame) -> DataFrame:
    """Chromosomes of index above 0 without x, y or m in their names."""
    return chromosomes.where((F.col("idx") > 0) & ~F.col("name").rlike("(?i)[xym]"))


def split_parity(chromosomes: DataFrame) -> DataFrame:
    """part 1: odd index, part 2: even."""
    return autosomes(chromosomes).withColumn("part", F.when(F.col("idx") % 2 == 1, 1).otherwise(2))


def split_halves(chromosomes: DataFrame) -> DataFrame:
    """part 1 until the running length reaches half of the whole. The dimension is a few rows."""
    running = F.sum("length").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("length").over(Window.partitionBy())
    return autosomes(chromosomes).withColumn("part", F.when(2 * F.coalesce(running, F.lit(0)) < total, 1).otherwise(2))


def split_twos(chromosomes: DataFrame) -> DataFrame:
    """The first alone in part 1, then pairs by turns, part 2 first."""
    n = F.row_number().over(Window.orderBy("idx")) - 1
    return autosomes(chromosomes).withColumn("part", F.when(n == 0, 1).when(F.floor((n - 1) / 2) % 2 == 0, 2).otherwise(1))


def offsets(chromosomes: DataFrame, bin_size: int) -> DataFrame:
    """The first bin of each chromosome when all are laid end to end, and its end in thousands of base pairs."""
    before = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return chromosomes.where("idx > 0").select(
        "idx",
        "name",
        "length",
        F.coalesce(F.sum(F.expr(f"length div {bin_size} + 1")).over(before), F.lit(0)).cast("long").alias("bin_offset"),
        F.sum(F.expr("length div 1000")).over(until).cast("long").alias("boundary"),
    )


def pairs(chromosomes: DataFrame, bin_size: int, intra: bool = True, inter: bool = True) -> DataFrame:
    """Pairs of chromosomes, the lower index first, with both offsets."""
    at = offsets(chromosomes, bin_size)
    a = at.select(F.col("idx").alias("chr1_idx"), F.col("bin_offset").alias("offset_x"))
    b = at.select(F.col("idx").alias("chr2_idx"), F.col("bin_offset").alias("offset_y"))
    wanted = F.lit(False)
    if intra:
        wanted = wanted | (F.col("chr1_idx") == F.col("chr2_idx"))
    if inter:
        wanted = wanted | (F.col("chr1_idx") < F.col("chr2_idx"))
    return a.join(F.broadcast(b), wanted)  # a row a chromosome


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The chromosomes of a that b has with the same index and length, in a's order, with All anew."""
    return with_all(a.where("idx > 0").join(b.select("idx", "length"), ["idx", "length"], "left_semi").select("idx", "name", "length"))


def infer_genome(chromosomes: DataFrame, known: DataFrame) -> DataFrame:
    """known (genome, ord, name, length): the first genome of which any chromosome has the same name and length."""
    hit = known.join(chromosomes.where("idx > 0").select("name", "length"), ["name", "length"], "left_semi")
    return hit.agg(F.min_by("genome", "ord").alias("genome"))


def nearest_resolution(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """For each wanted bin_size the present one nearest to it; of two as near the lower."""
    far = F.struct(F.abs(F.col("wanted") - F.col("bin_size")), F.col("bin_size"))
    return wanted.select(F.col("bin_size").alias("wanted")).join(F.broadcast(present.select("bin_size").distinct()), F.lit(True)).groupBy("wanted").agg(F.min_by("bin_size", far).alias("bin_size"))  # a few zooms


def next_zoom(zooms: DataFrame) -> DataFrame:
    """Each bin_size with the next finer and coarser one of its unit; the last stays itself."""
    w = Window.partitionBy("unit").orderBy(F.desc("bin_size"))
    return zooms.select("unit", "bin_size", F.coalesce(F.lead("bin_size").over(w), "bin_size").alias("finer"), F.coalesce(F.lag("bin_size").over(w), "bin_size").alias("coarser"), (F.row_number().over(w) - 1).alias("position"))


def zoom_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("unit", "bin_size").intersect(b.select("unit", "bin_size"))


def all_resolutions(base_pairs: list[int], derived: list[int], fragments: list[int]) -> list[tuple[str, int]]:
    """Every zoom: those of base pairs, those derived from them, those of fragments."""
    return [*(("BP", b) for b in [*base_pairs, *derived]), *(("FRAG", f) for f in fragments)]


def zoom_number(matrices: DataFrame, unit: str, at: int = 0) -> DataFrame:
    """Of each pair's maps of a unit the one at a place, coarsest first (2: the first one whose correlations are taken)."""
    order = F.row_number().over(Window.partitionBy("chr1_idx", "chr2_idx").orderBy(F.desc("bin_size")))
    return matrices.where(F.col("unit") == unit).withColumn("place", order - 1).where(F.col("place") == at).drop("place")


def zoom_of(matrices: DataFrame, unit: str, bin_size: int) -> DataFrame:
    """The maps of that bin size; of the whole genome's own map, pair (0, 0), the nearest one, the coarser if two are as near."""
    own = matrices.where(F.col("unit") == unit)
    apart = F.abs(F.col("bin_size") - bin_size)
    order = F.row_number().over(Window.partitionBy("chr1_idx", "chr2_idx").orderBy(apart, F.desc("bin_size")))
    whole = (F.col("chr1_idx") == 0) & (F.col("chr2_idx") == 0)
    return own.withColumns({"place": order, "apart": apart}).where((F.col("apart") == 0) | (whole & (F.col("place") == 1))).drop("place", "apart")
