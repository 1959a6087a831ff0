"""Operators on contacts: (chr1_idx, chr2_idx, bin_size, bin_x, bin_y, counts), of intra maps one triangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import ieee_div, is_number

INTRA = "chr1_idx = chr2_idx"
MAP = ["chr1_idx", "chr2_idx", "bin_size"]


def scan(contacts: DataFrame, chr1: int, chr2: int, bin_size: int) -> DataFrame:
    """All records of one map; the pair may be given in either order."""
    a, b = sorted((chr1, chr2))
    return contacts.where((F.col("chr1_idx") == a) & (F.col("chr2_idx") == b) & (F.col("bin_size") == bin_size))


def positive(contacts: DataFrame) -> DataFrame:
    """Records of a count above zero; NaN is none."""
    return contacts.where(is_number(F.col("counts")) & (F.col("counts") > 0))


def to_positions(contacts: DataFrame) -> DataFrame:
    """Genome positions of the bins' starts."""
    return contacts.withColumns({"x": F.col("bin_x").cast("long") * F.col("bin_size"), "y": F.col("bin_y").cast("long") * F.col("bin_size")})


def mirror(contacts: DataFrame) -> DataFrame:
    """Both triangles: every record off the diagonal is given the other way round as well, in one pass."""
    both = F.when(F.col("bin_x") == F.col("bin_y"), F.array(F.struct(F.col("bin_x").alias("x"), F.col("bin_y").alias("y")))).otherwise(F.array(F.struct(F.col("bin_x").alias("x"), F.col("bin_y").alias("y")), F.struct(F.col("bin_y").alias("x"), F.col("bin_x").alias("y"))))
    rest = [c for c in contacts.columns if c not in ("bin_x", "bin_y")]
    return contacts.select(*rest, F.explode(both).alias("__b")).select(*rest, F.col("__b.x").alias("bin_x"), F.col("__b.y").alias("bin_y")).select(contacts.columns)


def region(contacts: DataFrame, x1: int, y1: int, x2: int, y2: int, below: bool = False) -> DataFrame:
    """Records within the closed rectangle of bins; below: those of the transposed rectangle too."""
    inside = F.col("bin_x").between(x1, x2) & F.col("bin_y").between(y1, y2)
    if below:
        inside = inside | (F.col("bin_x").between(y1, y2) & F.col("bin_y").between(x1, x2))
    return contacts.where(inside)


def _clip(contacts: DataFrame, x0: int, y0: int, rows: int, cols: int, fill_under: bool, diagonal_twice: bool) -> DataFrame:
    cells = [(F.col("bin_x") - x0, F.col("bin_y") - y0, F.lit(True))]
    if fill_under:
        cells.append((F.col("bin_y") - x0, F.col("bin_x") - y0, F.lit(True) if diagonal_twice else F.col("bin_x") != F.col("bin_y")))
    kept = F.array(*(F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), ok.alias("ok")) for r, c, ok in cells))
    every = contacts.select(F.explode(kept).alias("c"), F.col("counts").cast("double").alias("value")).where("c.ok")
    return every.select("c.row", "c.col", "value").where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def clip_sum(contacts: DataFrame, x0: int, y0: int, rows: int, cols: int, fill_under: bool = True) -> DataFrame:
    """Dense cells (row, col, value) of a region by summing; mirroring counts the diagonal twice, as adding does."""
    return _clip(contacts, x0, y0, rows, cols, fill_under, True).groupBy("row", "col").agg(F.sum("value").alias("value"))


def clip_overwrite(contacts: DataFrame, x0: int, y0: int, rows: int, cols: int, fill_under: bool = True) -> DataFrame:
    """Dense cells of a region by assignment: the diagonal once. A map has a record a cell, so no order matters."""
    return _clip(contacts, x0, y0, rows, cols, fill_under, False).groupBy("row", "col").agg(F.max("value").alias("value"))


def region_row_sums(contacts: DataFrame, x0: int, x1: int) -> DataFrame:
    """Sums of positive counts per bin of x0..x1: to x if it is inside, otherwise to y if that is, never to both."""
    at = F.when(F.col("bin_x").between(x0, x1), F.col("bin_x") - x0).when(F.col("bin_y").between(x0, x1), F.col("bin_y") - x0)
    return positive(contacts).select(at.alias("row"), "counts").where("row IS NOT NULL").groupBy("row").agg(F.sum(F.col("counts").cast("double")).alias("value"))


def with_offsets(contacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records of several maps in genome-wide bins. pairs: a row a pair, as genome.pairs() gives them."""
    placed = contacts.join(F.broadcast(pairs), ["chr1_idx", "chr2_idx"])
    return placed.select("chr1_idx", "chr2_idx", (F.col("bin_x") + F.col("offset_x")).alias("bin_x"), (F.col("bin_y") + F.col("offset_y")).alias("bin_y"), "counts")


def vector(norm_vectors: DataFrame, norm: str) -> DataFrame:
    """A norm's vector (chr_idx, bin_size, bin, value). VC_SQRT, where it is missing, is the root of VC."""
    norm = norm.upper()
    own = norm_vectors.where(F.col("norm") == norm).select("chr_idx", "bin_size", "bin", "value")
    if norm != "VC_SQRT":
        return own
    have = own.select("chr_idx", "bin_size").distinct()
    roots = norm_vectors.where("norm = 'VC'").select("chr_idx", "bin_size", "bin", F.sqrt("value").alias("value")).join(have, ["chr_idx", "bin_size"], "left_anti")
    return own.unionByName(roots)


def vector_slice(norm_vectors: DataFrame, first: int, last: int) -> DataFrame:
    """Bins first to last, both included, counted anew from 0."""
    return norm_vectors.where(F.col("bin").between(first, last)).withColumn("bin", F.col("bin") - first)


def normalise(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """counts / (v[x] * v[y]); NaN and missing factors drop a record, infinities stay.

    The joins are left to the planner: a vector is broadcast if it is small enough, else both sides are sorted
    by bin, where no key is hot beyond one bin of one map.
    """
    side = lambda c, b, n: vectors.select(F.col("chr_idx").alias(c), "bin_size", F.col("bin").alias(b), F.col("value").alias(n))
    both = contacts.join(side("chr1_idx", "bin_x", "__vx"), ["chr1_idx", "bin_size", "bin_x"]).join(side("chr2_idx", "bin_y", "__vy"), ["chr2_idx", "bin_size", "bin_y"])
    value = ieee_div(F.col("counts"), F.col("__vx").cast("double") * F.col("__vy").cast("double"))
    return both.withColumn("counts", value).where(is_number(F.col("counts"))).select(contacts.columns)


def coverage_vectors(contacts: DataFrame) -> DataFrame:
    """VC: each bin's symmetric row sum over its chromosome's mean row sum, of intra maps."""
    sums = mirror(contacts.where(INTRA)).groupBy(F.col("chr1_idx").alias("chr_idx"), "bin_size", F.col("bin_x").alias("bin")).agg(F.sum("counts").alias("s"))
    means = sums.groupBy("chr_idx", "bin_size").agg(F.avg("s").alias("m"))
    return sums.join(means, ["chr_idx", "bin_size"]).select(F.lit("VC").alias("norm"), "chr_idx", "bin_size", "bin", (F.col("s") / F.col("m")).alias("value"))


def symmetric_row_sums(contacts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Row sums with every record counted for x and, off the diagonal, for y."""
    return mirror(contacts).groupBy(*MAP, F.col("bin_x").alias("bin")).agg(F.sum(F.col("counts") * scale).alias("value"))


def summary(contacts: DataFrame) -> DataFrame:
    """Records, records above zero, and the counts of both triangles."""
    c = F.when(F.col("counts") > 0, F.col("counts")).otherwise(0.0)
    return contacts.groupBy(*MAP).agg(F.count("*").alias("n"), F.count_if(is_number(F.col("counts")) & (F.col("counts") > 0)).alias("n_positive"), F.sum(c * F.when(F.col("bin_x") != F.col("bin_y"), 2).otherwise(1)).alias("total"))


def source_resolution(present: list[int], wanted: int) -> int:
    """The largest stored bin size below the wanted one that divides it."""
    fits = [b for b in present if b < wanted and wanted % b == 0]
    if not fits:
        raise ValueError(f"no stored bin size divides {wanted}")
    return max(fits)


def coarsen(contacts: DataFrame, bin_size: int, source: int) -> DataFrame:
    """A coarser map by summing the bins of a finer one."""
    k = bin_size // source
    own = contacts.where(F.col("bin_size") == source)
    return own.groupBy("chr1_idx", "chr2_idx", F.expr(f"bin_x div {k}").cast("int").alias("bin_x"), F.expr(f"bin_y div {k}").cast("int").alias("bin_y")).agg(F.sum(F.col("counts").cast("double")).alias("counts")).select("chr1_idx", "chr2_idx", F.lit(bin_size).alias("bin_size"), "bin_x", "bin_y", "counts")


def average_count(contacts: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """A map's counts over its cells, lengths divided by the bin size without the last, partial bin."""
    sums = contacts.groupBy(*MAP).agg(F.sum("counts").alias("s"))
    side = lambda c, n: F.broadcast(chromosomes.select(F.col("idx").alias(c), F.col("length").alias(n)))  # noqa: E731  a row a chromosome
    cells = F.expr("(l1 div bin_size)"), F.expr("(l2 div bin_size)")
    return sums.join(side("chr1_idx", "l1"), "chr1_idx").join(side("chr2_idx", "l2"), "chr2_idx").select(*MAP, ieee_div(ieee_div(F.col("s"), cells[0]), cells[1]).alias("average"))


def block_number(bin_x: Column, bin_y: Column, block_bins: int, columns: int) -> Column:
    """The tile of a record: a clustering column for storing maps."""
    return (F.floor(bin_y / block_bins) * columns + F.floor(bin_x / block_bins)).cast("int")


def diagonal_block_number(bin_x: Column, bin_y: Column, block_bins: int, columns: int) -> Column:
    """The tile along and away from the diagonal, depths growing by powers of two."""
    along = F.floor((bin_x + bin_y) / 2 / block_bins)
    depth = F.floor(F.log2(F.lit(1.0) + F.abs(bin_x - bin_y) / F.sqrt(F.lit(2.0)) / block_bins))
    return (depth * columns + along).cast("int")
