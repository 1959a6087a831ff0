"""Pearson correlation of the rows of symmetric maps by products of tiles, and its eigenvectors without forming it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.contacts import mirror
from tessera.plans.lineage import checkpointed

TILE, COLUMNS, DENSE = 256, 1 << 15, 1 << 12
MOST_PARTS = 100_000
BLOCK = 8
MOST_STEPS = 100


def _dim(dims: int | dict[int, int]) -> Column:
    if isinstance(dims, int):
        return F.lit(dims)
    return F.create_map(*(F.lit(x) for item in dims.items() for x in item))[F.col("c")]


def _cells(oe: DataFrame) -> DataFrame:
    """c, i, k, a: both triangles; cells that are NaN are left out."""
    both = mirror(oe.select("chr1_idx", "chr2_idx", "bin_size", "bin_x", "bin_y", F.col("oe").alias("counts")))
    return both.select(F.col("chr1_idx").alias("c"), F.col("bin_x").alias("i"), F.col("bin_y").alias("k"), F.col("counts").alias("a")).where(~F.isnan("a"))


def _centred(a: DataFrame, dims: int | dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Columns (c, k, m), their means over all rows; and rows (c, i, s, q): sum and sum of squares once the means are taken off."""
    m = a.groupBy("c", "k").agg((F.sum("a") / F.first(_dim(dims))).alias("m"))
    total = m.groupBy("c").agg(F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("smm"))
    rows = a.join(m, ["c", "k"]).groupBy("c", "i").agg(F.sum("a").alias("sa"), F.sum(F.col("a") * F.col("m")).alias("sam"), F.sum(F.col("a") * F.col("a")).alias("q"))
    rows = rows.join(total, "c").select("c", "i", "sam", "smm", (F.col("sa") - F.col("sm")).alias("s"), (F.col("q") - 2 * F.col("sam") + F.col("smm")).alias("q"))
    return m, rows


def _tiles(a: DataFrame, rows: DataFrame, dims: int | dict[int, int], tile: int, columns: int) -> DataFrame:
    """c, t1, t2, b, second, i, k, a: each tile of cells (tile rows by so many columns) for each pair of row tiles that it has a part in.

    b is the block of columns; -1 has the rows' own sums instead. second: the tile is the pair's second one. A row is a whole tile, so
    these are as many rows as there are tiles times row tiles.
    """
    t = F.floor(F.col("i") / tile).cast("int").alias("t")
    cells = a.groupBy("c", t, F.floor(F.col("k") / columns).cast("int").alias("b")).agg(F.collect_list(F.struct("i", "k", "a")).alias("of"))
    cells = cells.select("c", "t", "b", F.col("of.i").alias("i"), F.col("of.k").alias("k"), F.col("of.a").alias("a"))
    own = rows.groupBy("c", t).agg(F.collect_list(F.struct("i", "sam", "s", "q")).alias("of"), F.first("smm").alias("smm"))
    own = own.select("c", "t", F.lit(-1).alias("b"), F.col("of.i").alias("i"), F.array().cast("array<int>").alias("k"), F.concat("of.sam", "of.s", "of.q", F.array("smm")).alias("a"))
    other = F.explode(F.sequence(F.lit(0), F.floor((_dim(dims) - 1) / tile).cast("int"))).alias("u")
    placed = cells.unionByName(own).select("*", other)
    return placed.select("c", F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"), "b", (F.col("t") > F.col("u")).alias("second"), "i", "k", "a")


def _multiplied(dims: int | dict[int, int], tile: int) -> Callable:
    """Correlations of the rows of two tiles, from their tiles of cells in the order of blocks: two tiles of one block are held at a time."""

    def product(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> np.ndarray:
        total = np.zeros((tile, tile))
        both = np.intersect1d(first[1], second[1])
        for some in np.array_split(both, -(-len(both) // DENSE)) if len(both) else []:
            dense = []
            for i, k, a in (first, second):
                at = np.minimum(np.searchsorted(some, k), len(some) - 1)
                met = some[at] == k
                m = np.zeros((tile, len(some)))
                np.add.at(m, (i[met] % tile, at[met]), a[met])
                dense.append(m)
            total += dense[0] @ dense[1].T
        return total

    def correlated(c: int, same: bool, one: tuple, two: tuple, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = dims if isinstance(dims, int) else dims[c]
        (i, sam1, s1, q1, smm), (j, sam2, s2, q2, _) = one, two
        s12 = g[np.ix_(i % tile, j % tile)] - sam1[:, None] - sam2 + smm
        spread = [np.sqrt(np.maximum(0, n * q - s * s)) for s, q in ((s1, q1), (s2, q2))]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (n * s12 - s1[:, None] * s2) / (spread[0][:, None] * spread[1])
        row, col = np.repeat(i, len(j)), np.tile(j, len(i))
        if same:
            value = np.where(i[:, None] <= j, value, value.T)
            value[i[:, None] == j] = 1.0
        pairs = [(row, col, value.ravel())] if same else [(row, col, value.ravel()), (col, row, value.ravel())]
        for x, y, v in pairs:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(x), pa.array(y), pa.array(v)], names=["chr_idx", "row", "col", "value"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, g, held = None, {}, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                c, t1, t2, b, second = (batch[name][at].as_py() for name in ("c", "t1", "t2", "b", "second"))
                i, k, a = (np.asarray(batch[name][at].values) for name in ("i", "k", "a"))
                if (c, t1, t2) != key:
                    if len(own) == 2:
                        yield from correlated(key[0], key[1] == key[2], own[False], own[True], g)
                    key, own, g, held = (c, t1, t2), {}, np.zeros((tile, tile)), None
                if b < 0:
                    order = np.argsort(i)
                    of = [a[m * len(i) : (m + 1) * len(i)][order] for m in range(3)]
                    own[second] = (i[order], *of, a[-1])
                    if t1 == t2:
                        own[True] = own[False]
                elif t1 == t2:
                    g += product((i, k, a), (i, k, a))
                elif not second:
                    held = b, (i, k, a)
                elif held and held[0] == b:
                    g += product(held[1], (i, k, a))
        if len(own) == 2:
            yield from correlated(key[0], key[1] == key[2], own[False], own[True], g)

    return run


def pearson(oe: DataFrame, dims: int | dict[int, int], tile: int = TILE, columns: int = COLUMNS) -> DataFrame:
    """(chr_idx, row, col, value) over rows that have any record. oe: contacts of intra maps with a column oe; dims: bins of a map, for all or by chromosome.

    Each row is centred by the columns' means over all rows, then rows are correlated: the product of the sparse matrix with
    its transpose, corrected by sums of rows and columns. It is taken by blocks: a pair of row tiles is one unit of work, to which come
    the tiles of both, a block of columns after the other, and which gives the values of all pairs of their rows.
    """
    a = checkpointed(_cells(oe))
    _, rows = _centred(a, dims)
    sizes = dims.values() if isinstance(dims, dict) else [dims] * a.select("c").distinct().count()
    pairs = sum((m := -(-n // tile)) * (m + 1) // 2 for n in sizes)  # a partition for each, so that few tiles are in a worker at once
    dealt = _tiles(a, rows, dims, tile, columns).repartition(min(MOST_PARTS, max(1, pairs)), "c", "t1", "t2").sortWithinPartitions("c", "t1", "t2", "b", "second")
    return dealt.mapInArrow(_multiplied(dims, tile), "chr_idx int, row int, col int, value double")


def _by_chromosome(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    c = np.asarray(batch["c"])
    for one in np.unique(c).tolist():
        yield one, np.flatnonzero(c == one)


def _rows(column: pa.Array, at: np.ndarray) -> np.ndarray:
    return np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1)


def _products(table: DataFrame, both: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each chromosome the transpose of one matrix times another, both made of the columns q and w: as many numbers as their widths make."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at in _by_chromosome(batch):
                left, right = both(c, _rows(batch["q"], at), _rows(batch["w"], at))
                total[c] = total.get(c, 0) + left.T @ right
        for c, m in total.items():
            yield pa.RecordBatch.from_pydict({"c": pa.array([c] * m.size, pa.int32()), "at": pa.array(np.arange(m.size), pa.int32()), "width": pa.array([m.shape[1]] * m.size, pa.int32()), "x": m.ravel()})

    found: dict[int, np.ndarray] = {}
    parts = table.mapInArrow(run, "c int, at int, width int, x double").groupBy("c", "at", "width").agg(F.sum("x").alias("x")).toPandas()
    for c, own in parts.groupby("c"):
        own = own.sort_values("at")
        found[int(c)] = own["x"].to_numpy().reshape(-1, int(own["width"].iloc[0]))
    return found


def _whitened(gram: np.ndarray, least: float) -> np.ndarray:
    """What makes columns of that Gram matrix orthonormal; directions shorter than least become zero."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    lengths = np.sqrt(np.maximum(values, 0))
    return np.where(lengths > least, vectors / np.where(lengths > least, lengths, 1), 0.0)


def eigenvector(oe: DataFrame, dims: int | dict[int, int], which: int = 0, tolerance: float = 1e-9) -> DataFrame:
    """(chr_idx, bin, value): of each map's Pearson matrix the which-th eigenvector by falling eigenvalue, its component of largest size being positive.

    The Pearson matrix is never formed: with the rows centred and of unit length it is Z times Z transposed, and a product with
    it is two sums over the sparse cells. A block Lanczos iteration with full reorthogonalisation takes such products; its
    vectors are a row a bin in the shared folder, and only the small matrices of their inner products
    go to the driver. It ends when the residual is below tolerance times the eigenvalue, or the space is exhausted.
    Rows without spread are left out.
    """
    cells = checkpointed(_cells(oe))
    m, rows = _centred(cells, dims)
    length = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / _dim(dims)))
    rows = rows.select("c", "i", length.alias("d"), (F.col("s") / _dim(dims)).alias("r")).where("d > 1e-9")
    rows, m = checkpointed(rows), checkpointed(m)
    width = max(BLOCK, 2 * which + 2)
    each = range(width)
    listed = lambda f: F.array(*(f(j) for j in each))

    def times(v: DataFrame) -> DataFrame:
        """c, i, w: the matrix times v (c, i, v)."""
        scaled = v.join(rows, ["c", "i"]).select("c", "i", "r", F.transform("v", lambda x: x / F.col("d")).alias("v"))
        sums = scaled.groupBy("c").agg(listed(lambda j: F.sum(F.col("v")[j])).alias("sv"), listed(lambda j: F.sum(F.col("r") * F.col("v")[j])).alias("srv"))
        down = cells.join(scaled.select("c", "i", "v"), ["c", "i"]).groupBy("c", "k").agg(listed(lambda j: F.sum(F.col("a") * F.col("v")[j])).alias("av"))
        # columns without cells have -srv each; a row a chromosome is joined
        u = m.join(down, ["c", "k"], "left").join(sums, "c").select("c", "k", "m", "srv", listed(lambda j: F.coalesce(F.col("av")[j], F.lit(0.0)) - F.col("m") * F.col("sv")[j] - F.col("srv")[j]).alias("u"))
        u = checkpointed(u)
        more = u.groupBy("c").agg(listed(lambda j: F.sum(F.col("m") * F.col("u")[j])).alias("mu"), listed(lambda j: F.sum(F.col("u")[j]) - (F.first(_dim(dims)) - F.count("*")) * F.first(F.col("srv")[j])).alias("su"))
        across = cells.join(u.select("c", "k", "u"), ["c", "k"]).groupBy("c", "i").agg(listed(lambda j: F.sum(F.col("a") * F.col("u")[j])).alias("au"))
        return rows.join(across, ["c", "i"]).join(more, "c").select("c", "i", listed(lambda j: (F.col("au")[j] - F.col("mu")[j] - F.col("r") * F.col("su")[j]) / F.col("d")).alias("w"))

    def mapped(table: DataFrame, make: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """c, i, q: a row of a matrix made of the columns q and w."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, at in _by_chromosome(batch):
                    out = make(c, _rows(batch["q"], at), _rows(batch["w"], at))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.int32()), batch["i"].take(pa.array(at)), lists], names=["c", "i", "q"])

        return table.mapInArrow(run, "c int, i int, q array<double>")

    start = checkpointed(rows.select("c", "i", F.array().cast("array<double>").alias("q"), listed(lambda j: F.xxhash64("i", F.lit(j)) / F.lit(2.0**63)).alias("w")))
    first = {c: _whitened(g, 0.0) for c, g in _products(start, lambda c, q, w: (w, w)).items()}
    q = mapped(start, lambda c, q, w: w @ first[c])
    small = {c: np.zeros((0, 0)) for c in first}
    chosen: dict[int, np.ndarray] = {}
    for step in range(MOST_STEPS):
        done = step * width
        after = checkpointed(q.join(times(q.select("c", "i", F.slice("q", done + 1, width).alias("v"))), ["c", "i"]))
        h = _products(after, lambda c, q, w: (q, w))
        again = _products(after, lambda c, q, w: (np.hstack([q, w - q @ h[c]]), w - q @ h[c]))
        rest, whiten = {c: x[: done + width] for c, x in again.items()}, {}
        for c, x in again.items():
            column = h[c] + rest[c]
            gram = x[done + width :] - rest[c].T @ rest[c]
            t = np.zeros((done + width,) * 2)
            t[:done, :done] = small[c]
            t[:, done:], t[done:, :done] = column, column[:done].T
            t[done:, done:] = (column[done:] + column[done:].T) / 2
            small[c] = t
            values, vectors = np.linalg.eigh(t)
            y = vectors[:, ::-1][:, min(which, len(values) - 1)]
            left = float(np.sqrt(max(0.0, y[done:] @ gram @ y[done:])))
            whiten[c] = _whitened(gram, 1e-10 * abs(values).max())
            if c not in chosen and (left <= tolerance * abs(values[::-1][min(which, len(values) - 1)]) or not whiten[c].any()):
                chosen[c] = y
        if len(chosen) == len(small) or step == MOST_STEPS - 1:
            break
        q = mapped(after, lambda c, q, w, h=h, rest=rest, whiten=whiten: np.hstack([q, (w - q @ h[c] - q @ rest[c]) @ whiten[c]]))
    if not small:
        return rows.select(F.col("c").alias("chr_idx"), F.col("i").alias("bin"), F.col("d").alias("value")).limit(0)
    if len(chosen) < len(small):
        raise ArithmeticError(f"no eigenvector within {MOST_STEPS} steps for chromosomes {sorted(set(small) - set(chosen))}")
    weights = {c: np.concatenate([y, np.zeros(done + width - len(y))])[:, None] for c, y in chosen.items()}
    found = checkpointed(mapped(after, lambda c, q, w: q @ weights[c]).select("c", "i", F.col("q")[0].alias("value")))
    sign = found.groupBy("c").agg(F.signum(F.max_by("value", F.struct(F.abs("value"), -F.col("i")))).alias("sign"))
    return found.join(sign, "c").select(F.col("c").alias("chr_idx"), F.col("i").alias("bin"), (F.col("value") * F.col("sign")).alias("value"))
