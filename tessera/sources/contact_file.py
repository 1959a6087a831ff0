"""Binary contact-map files as a data source: tiled sparse maps of many bin sizes, their vectors and their metadata.

    register(spark)
    spark.read.format("contactmap").option("table", "contacts").load(path)

path is a file, a folder of files, a URL (http or https) or a list of paths in JSON; each file is read for itself. Tables:

    chromosomes       idx, name, length
    resolutions       unit, bin_size
    attributes        key, value
    graphs            section, row, col, value
    matrices          chr1_idx, chr2_idx, unit, bin_size, sum_counts, block_bin_count, block_column_count, n_blocks
    contacts          chr1_idx, chr2_idx, unit, bin_size, bin_x, bin_y, counts
    norm_vectors      norm, chr_idx, unit, bin_size, bin, value
    expected          norm, unit, bin_size, dist, value
    expected_factors  norm, unit, bin_size, chr_idx, factor
    fragments         chr_idx, site, position

Planning reads headers and footers: a few numbers for each pair of chromosomes and each vector. What is found elsewhere, the heads of zoom
records and of vectors and the index of blocks, is read by tasks, which are given slices of the footer's index; a pair with many blocks is
given to several tasks, by the size that the footer states, each of which takes a run of about BLOCKS blocks. Only where HEADS pairs or fewer are asked for
are their zoom records looked up beforehand, so that other bin sizes take no tasks. A task leaves out blocks outside the region asked for and
decodes the others into Arrow batches. Filters on chr1_idx, chr2_idx, unit,
bin_size, norm, chr_idx and on bounds of bin_x, bin_y, bin and dist are used to leave out maps, blocks and parts of vectors; Spark applies them again
to the rows. Versions 6 to 9 are read; anything else is an error when the table is loaded. Missing cells of dense
blocks, vectors without any number and expected vectors without factors give no rows. An empty map gives an empty table. graphs are the three sections of numbers in the attribute of
that name; a text that breaks off gives no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.sources.http import HttpFile

#: The magic string, the versions that are read, and what a dense block holds where there is no record.
MAGIC, OLDEST, NEWEST, NO_COUNT = "HIC", 6, 9, -32768
BLOCKS = 256
VALUES = 1 << 20
HEADS, SLICE = 64, 1024  # pairs that are looked up when planning; pairs or vectors of a task
#: The sections of the attribute graphs, with their rows and columns.
GRAPHS = (("fragment_distance", 2000, 1), ("mapping_quality", 201, 3), ("distance_by_orientation", 100, 4))
SCHEMAS = {
    "chromosomes": "idx int, name string, length long",
    "resolutions": "unit string, bin_size int",
    "attributes": "key string, value string",
    "graphs": "section string, row int, col int, value long",
    "matrices": "chr1_idx int, chr2_idx int, unit string, bin_size int, sum_counts double, block_bin_count int, block_column_count int, n_blocks int",
    "contacts": "chr1_idx int, chr2_idx int, unit string, bin_size int, bin_x int, bin_y int, counts float",
    "norm_vectors": "norm string, chr_idx int, unit string, bin_size int, bin long, value double",
    "expected": "norm string, unit string, bin_size int, dist long, value double",
    "expected_factors": "norm string, unit string, bin_size int, chr_idx int, factor double",
    "fragments": "chr_idx int, site int, position int",
}
TYPES = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}


def opened(path: str) -> pa.NativeFile | HttpFile:
    if path.startswith(("http://", "https://")):
        return HttpFile(path)
    scheme, _, rest = path.partition(":")
    system, inner = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}" if rest else path)
    return system.open_input_file(inner)


class Cursor:
    """Reads little-endian values on from a place, a buffer at a time."""

    def __init__(self, file: pa.NativeFile | HttpFile, at: int = 0, ahead: int = 1 << 16) -> None:
        self.file, self.at, self.ahead, self.end = file, at, ahead, file.size()
        self.buffer, self.first = b"", at

    def take(self, size: int) -> bytes:
        if self.at < self.first or self.at + size > self.first + len(self.buffer):
            self.first = self.at
            self.buffer = self.file.read_at(min(max(size, self.ahead), self.end - self.at), self.at)
        if self.at + size > self.first + len(self.buffer):
            raise ValueError("the file ends too early")
        self.at += size
        return self.buffer[self.at - size - self.first : self.at - self.first]

    def value(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def text(self) -> str:
        out = bytearray()
        while (c := self.take(1)) != b"\0":
            out += c
        return out.decode("utf-8", "replace")


@dataclass
class Vector:
    """Where a vector's values are: those from first to last (excluded) of n. n below 0: its head at that place says how many, and all that are asked for are meant."""

    path: str
    labels: tuple
    at: int
    n: int
    kind: str
    first: int = 0
    last: int = 0


@dataclass
class Zoom:
    """A map of one bin size, and where its index of blocks is."""

    path: str
    version: int
    chr1: int
    chr2: int
    unit: str
    bin_size: int
    sum_counts: float
    block_bins: int
    columns: int
    n_blocks: int
    index_at: int


@dataclass
class Layout:
    """What a file's header and footer say."""

    path: str
    version: int = 0
    genome: str = ""
    attributes: list[tuple[str, str]] = field(default_factory=list)
    chromosomes: list[tuple[int, str, int]] = field(default_factory=list)
    resolutions: list[tuple[str, int]] = field(default_factory=list)
    fragments: list[Vector] = field(default_factory=list)
    matrices: dict[str, tuple[int, int]] = field(default_factory=dict)
    expected: list[Vector] = field(default_factory=list)
    factors: list[tuple] = field(default_factory=list)
    vectors: list[tuple[tuple, int, int]] = field(default_factory=list)

    @property
    def float_kind(self) -> str:
        return "f" if self.version > 8 else "d"

    @property
    def size_kind(self) -> str:
        return "q" if self.version > 8 else "i"


def layout_of(path: str) -> Layout:
    own = Layout(path)
    with opened(path) as file:
        c = Cursor(file)
        if file.size() < 8 or c.take(4) != MAGIC.encode() + b"\0":
            raise ValueError(f"not a contact map: {path}")
        own.version = c.value("i")
        if not OLDEST <= own.version <= NEWEST:
            raise ValueError(f"version {own.version} of {path} is not one of {OLDEST} to {NEWEST}")
        footer = c.value("q")
        own.genome = c.text()
        if own.version > 8:
            c.take(16)  # where the index of vectors is; it is found from the footer too
        own.attributes = [(c.text(), c.text()) for _ in range(c.value("i"))]
        own.chromosomes = [(i, c.text(), c.value(own.size_kind)) for i in range(c.value("i"))]
        for unit in ("BP", "FRAG"):
            own.resolutions += [(unit, c.value("i")) for _ in range(c.value("i"))]
        if any(unit == "FRAG" for unit, _ in own.resolutions):
            for idx, _, _ in own.chromosomes:
                n = c.value("i")
                own.fragments.append(Vector(path, (idx,), c.at, n, "i", 0, n))
                c.at += 4 * n

        c = Cursor(file, footer)
        vectors_at = c.value(own.size_kind) + c.at
        for _ in range(c.value("i")):
            key = c.text()
            own.matrices[key] = c.value("q"), c.value("i")
        _expected(own, c, False)
        if vectors_at < file.size():
            c.at = vectors_at
            _expected(own, c, True)
            for _ in range(c.value("i")):
                labels = c.text(), c.value("i"), c.text(), c.value("i")
                own.vectors.append((labels, c.value("q"), c.value(own.size_kind)))
    return own


def _expected(own: Layout, c: Cursor, labelled: bool) -> None:
    for _ in range(c.value("i")):
        labels = (c.text() if labelled else "NONE", c.text(), c.value("i"))
        n = c.value(own.size_kind)
        vector = Vector(own.path, labels, c.at, n, own.float_kind, 0, n)
        c.at += n * struct.calcsize(own.float_kind)
        factors = [(*labels, c.value("i"), c.value(own.float_kind)) for _ in range(c.value("i"))]
        own.expected += [vector] if factors else []
        own.factors += factors


def zooms_at(file: pa.NativeFile | HttpFile, path: str, version: int, n_chromosomes: int, at: int) -> Iterator[Zoom]:
    """The maps of a pair whose record is at a place; none for a pair of unknown chromosomes."""
    c = Cursor(file, at, 256)
    chr1, chr2 = c.value("i"), c.value("i")
    if not (0 <= chr1 < n_chromosomes and 0 <= chr2 < n_chromosomes):
        return
    for _ in range(c.value("i")):
        unit = c.text()
        c.take(4)
        total = c.value("f")
        c.take(12)
        bin_size, block_bins, columns, n = (c.value("i") for _ in range(4))
        yield Zoom(path, version, chr1, chr2, unit, bin_size, float(total), block_bins, columns, n, c.at)
        c.at += 16 * n


def graphs_of(text: str) -> list[tuple[str, int, int, int]]:
    """section, row, col, value of the numbers after each opening bracket; nothing if any is missing or no whole number."""
    words, at, rows = text.split(), 0, []
    try:
        for name, n_rows, n_columns in GRAPHS:
            at = words.index("[", at) + 1
            numbers = [int(w) for w in words[at : at + n_rows * n_columns]]
            if len(numbers) < n_rows * n_columns or not all(-(1 << 63) <= x < 1 << 63 for x in numbers):
                return []
            rows += [(name, i // n_columns, i % n_columns, x) for i, x in enumerate(numbers)]
            at += len(numbers)
    except ValueError:
        return []
    return rows


def decoded(block: bytes, version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins and counts of an inflated block."""
    if version < 7:
        rows = np.frombuffer(block, [("x", "<i4"), ("y", "<i4"), ("c", "<f4")], struct.unpack_from("<i", block)[0], 4)
        return rows["x"], rows["y"], rows["c"]
    _, x0, y0 = struct.unpack_from("<iii", block)
    flags = list(block[12 : 16 if version > 8 else 14])
    counts = "<i2" if flags[0] == 0 else "<f4"
    wide_x, wide_y = (flags[1] != 0, flags[2] != 0) if version > 8 else (False, False)
    at = 12 + len(flags)
    if flags[-1] == 2:
        n, width = struct.unpack_from("<ih", block, at)
        c = np.frombuffer(block, counts, n, at + 6)
        cell = np.flatnonzero(c != NO_COUNT if counts == "<i2" else ~np.isnan(c))
        return x0 + cell % width, y0 + cell // width, c[cell]
    if flags[-1] != 1:
        raise ValueError(f"blocks of type {flags[-1]} are not known")
    number_y, number_x = ("<i" if wide_y else "<h"), ("<i" if wide_x else "<h")
    entry = np.dtype([("x", "<i4" if wide_x else "<i2"), ("c", counts)])
    (n_rows,) = struct.unpack_from(number_y, block, at)
    at += 4 if wide_y else 2
    ys, lengths, parts = [], [], []
    head = struct.Struct(number_y + number_x[1])
    for _ in range(n_rows):
        y, n = head.unpack_from(block, at)
        parts.append(np.frombuffer(block, entry, n, at + head.size))
        ys.append(y)
        lengths.append(n)
        at += head.size + n * entry.itemsize
    cells = np.concatenate(parts) if parts else np.empty(0, entry)
    return x0 + cells["x"].astype(np.int64), y0 + np.repeat(np.array(ys, np.int64), lengths), cells["c"]


def may_meet(zoom: Zoom, numbers: np.ndarray, x: tuple[float, float], y: tuple[float, float]) -> np.ndarray:
    """Which blocks may hold records of the rectangle. Newer files number the blocks of a map within a chromosome by their depth from the diagonal."""
    size, columns = zoom.block_bins, max(1, zoom.columns)
    if zoom.version > 8 and zoom.chr1 == zoom.chr2:
        depth, along = numbers // columns, numbers % columns
        apart = max(0.0, x[0] - y[1], y[0] - x[1]), max(x[1] - y[0], y[1] - x[0])
        # a depth holds distances from (2^d - 1) to (2^(d+1) - 1) times sqrt(2) blocks, rounded down to it
        low, high = (np.exp2(depth) - 1) * size * np.sqrt(2) - 1, (np.exp2(depth + 1) - 1) * size * np.sqrt(2) + 1
        return (high >= apart[0]) & (low <= apart[1]) & ((along + 1) * size >= (x[0] + y[0]) / 2) & (along * size <= (x[1] + y[1]) / 2)
    row, column = numbers // columns, numbers % columns
    return ((column + 1) * size > x[0]) & (column * size <= x[1]) & ((row + 1) * size > y[0]) & (row * size <= y[1])


@dataclass
class Rows(InputPartition):
    """Rows that the driver has already."""

    rows: list[tuple]


@dataclass
class Blocks(InputPartition):
    zoom: Zoom
    first: int
    last: int
    x: tuple[float, float]
    y: tuple[float, float]


@dataclass
class Pairs(InputPartition):
    """Records of pairs of chromosomes; of their blocks, counted over all of them, those from first to last (None: the end)."""

    path: str
    version: int
    n_chromosomes: int
    records: list[int]
    first: int = 0
    last: int | None = None


@dataclass
class Values(InputPartition):
    vectors: list[Vector]
    absent_if_nan: bool


class ContactMapReader(DataSourceReader):
    def __init__(self, table: str, paths: list[str]) -> None:
        self.table, self.paths = table, paths
        self.equal: dict[str, set] = {}
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            low, high = self.bounds.get(name, (-np.inf, np.inf))
            if isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal[name] & values if name in self.equal else values
                if values and all(isinstance(v, (int, float)) for v in values):
                    self.bounds[name] = max(low, min(values)), min(high, max(values))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, (int, float)):
                self.bounds[name] = max(low, f.value), high
            elif isinstance(f, (LessThan, LessThanOrEqual)) and isinstance(f.value, (int, float)):
                self.bounds[name] = low, min(high, f.value)
            yield f  # Spark tests the rows as well

    def _asked(self, **values) -> bool:
        return all(v in self.equal[k] and self._within(k, v) for k, v in values.items() if k in self.equal) and all(self._within(k, v) for k, v in values.items())

    def _within(self, name: str, value) -> bool:
        low, high = self.bounds.get(name, (-np.inf, np.inf))
        return not isinstance(value, (int, float)) or low <= value <= high

    def partitions(self) -> list[InputPartition]:
        return [p for path in self.paths for p in self._of_file(layout_of(path))] or [Rows([])]

    def _of_file(self, own: Layout) -> Iterator[InputPartition]:
        match self.table:
            case "chromosomes":
                yield Rows(own.chromosomes)
            case "resolutions":
                yield Rows(own.resolutions)
            case "attributes":
                yield Rows(own.attributes)
            case "expected_factors":
                yield Rows(own.factors)
            case "graphs":
                yield Rows([r for key, text in own.attributes if key == "graphs" for r in graphs_of(text)])
            case "matrices" | "contacts":
                wanted = [(at, size) for key, (at, size) in own.matrices.items() if self._named(key)]
                yield from self._looked_up(own, wanted) if len(wanted) <= HEADS and self.table == "contacts" else self._dealt(own, wanted)
            case "fragments":
                yield from (p for v in own.fragments if self._asked(chr_idx=v.labels[0]) for p in self._parts([v], "site", False))
            case "expected":
                wanted = [v for v in own.expected if self._asked(norm=v.labels[0], unit=v.labels[1], bin_size=v.labels[2])]
                yield from self._parts(wanted, "dist", False)
            case "norm_vectors":
                wanted = [(labels, at, size) for labels, at, size in own.vectors if self._asked(norm=labels[0], chr_idx=labels[1], unit=labels[2], bin_size=labels[3])]
                some, held = [], 0
                for labels, at, size in wanted:
                    some.append(Vector(own.path, labels, at, -1, own.size_kind + own.float_kind))
                    held += max(size, 0)
                    if held >= VALUES * struct.calcsize(own.float_kind) or len(some) == SLICE:
                        yield Values(some, True)
                        some, held = [], 0
                if some:
                    yield Values(some, True)

    def _named(self, key: str) -> bool:
        """Whether a pair, as the footer names it, may be asked for."""
        first, _, second = key.partition("_")
        return not (first.isdigit() and second.isdigit()) or self._asked(chr1_idx=int(first), chr2_idx=int(second))

    def _wanted(self, z: Zoom) -> bool:
        return self._asked(chr1_idx=z.chr1, chr2_idx=z.chr2, unit=z.unit, bin_size=z.bin_size)

    def _looked_up(self, own: Layout, wanted: list[tuple[int, int]]) -> Iterator[Blocks]:
        everything = (-np.inf, np.inf)
        with opened(own.path) as file:
            for z in (z for at, _ in wanted for z in zooms_at(file, own.path, own.version, len(own.chromosomes), at) if self._wanted(z)):
                for first in range(0, z.n_blocks, BLOCKS):
                    yield Blocks(z, first, min(z.n_blocks, first + BLOCKS), self.bounds.get("bin_x", everything), self.bounds.get("bin_y", everything))

    def _dealt(self, own: Layout, wanted: list[tuple[int, int]]) -> Iterator[Pairs]:
        """Records in slices of about BLOCKS blocks; a larger one is shared out. A record's size is hardly more than its blocks' entries in the index."""
        made = lambda records, *run: Pairs(own.path, own.version, len(own.chromosomes), records, *run)
        some, held = [], 0
        for at, size in wanted:
            shares = -(-size // (16 * BLOCKS)) if self.table == "contacts" else 1
            if shares > 1:
                yield from (made([at], i * BLOCKS, (i + 1) * BLOCKS if i < shares - 1 else None) for i in range(shares))
                continue
            some.append(at)
            held += max(size, 0) // 16 if self.table == "contacts" else 0
            if held >= BLOCKS or len(some) == SLICE:
                yield made(some)
                some, held = [], 0
        if some:
            yield made(some)

    def _parts(self, vectors: list[Vector], place: str, absent_if_nan: bool) -> Iterator[Values]:
        """Vectors cut to the places asked for and dealt to parts of about VALUES values; one that may be absent is not split."""
        low, high = self.bounds.get(place, (-np.inf, np.inf))
        some, size = [], 0
        for v in vectors:
            first, last = int(max(0, low)), int(min(v.n, high + 1))
            step = max(1, last - first) if absent_if_nan else VALUES
            for at in range(first, last, step):
                some.append(Vector(v.path, v.labels, v.at, v.n, v.kind, at, min(last, at + step)))
                size += some[-1].last - at
                if size >= VALUES:
                    yield Values(some, absent_if_nan)
                    some, size = [], 0
        if some:
            yield Values(some, absent_if_nan)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(c.strip().split() for c in SCHEMAS[self.table].split(",")))
        schema = pa.schema([(n, TYPES[t]) for n, t in zip(names, types)])
        if isinstance(partition, Rows):
            columns = list(zip(*partition.rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
        elif isinstance(partition, Values):
            for v in partition.vectors:
                yield from self._values(self._headed(v) if v.n < 0 else v, schema, partition.absent_if_nan)
        elif isinstance(partition, Pairs):
            yield from self._records(partition, schema)
        elif isinstance(partition, Blocks):
            yield from self._blocks(partition, schema)

    def _headed(self, v: Vector) -> Vector:
        low, high = self.bounds.get("bin", (-np.inf, np.inf))
        with opened(v.path) as file:
            c = Cursor(file, v.at, 16)
            n = c.value(v.kind[0])
        first, last = int(max(0, low)), int(min(n, high + 1))
        return Vector(v.path, v.labels, c.at, n, v.kind[1], first, max(first, last))

    def _records(self, part: Pairs, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        everything = (-np.inf, np.inf)
        region = self.bounds.get("bin_x", everything), self.bounds.get("bin_y", everything)
        rows, done = [], 0
        with opened(part.path) as file:
            for z in (z for at in part.records for z in zooms_at(file, part.path, part.version, part.n_chromosomes, at)):
                first, last = max(part.first - done, 0), z.n_blocks if part.last is None else min(z.n_blocks, part.last - done)
                done += z.n_blocks
                if not self._wanted(z):
                    continue
                if self.table == "matrices":
                    rows.append((z.chr1, z.chr2, z.unit, z.bin_size, z.sum_counts, z.block_bins, z.columns, z.n_blocks))
                elif first < last:
                    yield from self._blocks(Blocks(z, first, last, *region), schema)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    @staticmethod
    def _values(v: Vector, schema: pa.Schema, absent_if_nan: bool) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<" + {"i": "i4", "f": "f4", "d": "f8"}[v.kind])
        with opened(v.path) as file:
            each = lambda a, b: np.frombuffer(file.read_at((b - a) * dtype.itemsize, v.at + a * dtype.itemsize), dtype)
            if absent_if_nan and all(np.isnan(each(a, min(v.n, a + VALUES))).all() for a in range(0, v.n, VALUES)):
                return
            for a in range(v.first, v.last, VALUES):
                own = each(a, min(v.last, a + VALUES))
                place = np.arange(a, a + len(own))
                columns = [pa.repeat(pa.scalar(x, t.type), len(own)) for x, t in zip(v.labels, schema)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(place).cast(schema[-2].type), pa.array(own).cast(schema[-1].type)], schema=schema)

    @staticmethod
    def _blocks(part: Blocks, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        z = part.zoom
        with opened(z.path) as file:
            entries = np.frombuffer(file.read_at(16 * (part.last - part.first), z.index_at + 16 * part.first), [("number", "<i4"), ("at", "<i8"), ("size", "<i4")])
            entries = entries[may_meet(z, entries["number"].astype(np.int64), part.x, part.y)]
            for at, size in zip(entries["at"].tolist(), entries["size"].tolist()):
                if not size:
                    continue
                x, y, c = decoded(zlib.decompress(file.read_at(size, at)), z.version)
                same = [pa.repeat(pa.scalar(v, t.type), len(x)) for v, t in zip((z.chr1, z.chr2, z.unit, z.bin_size), schema)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(c.astype(np.float32))], schema=schema)


class ContactMapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contactmap"

    def schema(self) -> str:
        table = self.options.get("table", "contacts")
        if table not in SCHEMAS:
            raise ValueError(f"{table} is none of {sorted(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema) -> ContactMapReader:
        return ContactMapReader(self.options.get("table", "contacts"), paths_of(self.options["path"]))


def paths_of(path: str) -> list[str]:
    """The files that a path means: itself, a folder's files in the order of their names, or a JSON list's."""
    if path.startswith(("http://", "https://")):
        return [path]
    if path.startswith("["):
        return [p for one in json.loads(path) for p in paths_of(one)]
    scheme, colon, rest = path.partition(":")
    system, inner = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}" if colon else path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContactMapSource)


def read(spark: SparkSession, path: str | list[str], table: str = "contacts") -> DataFrame:
    register(spark)
    return spark.read.format("contactmap").option("table", table).load(path if isinstance(path, str) else json.dumps(path))
