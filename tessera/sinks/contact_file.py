"""Contact maps as binary files: each task writes a file of the blocks dealt to it, under a name of its own."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.contacts import block_number, diagonal_block_number
from tessera.plans.lineage import checkpointed


def encoded(x: np.ndarray, y: np.ndarray, c: np.ndarray, version: int) -> bytes:
    """A block as a list of rows, counts as short numbers if all are, bins relative to the least."""
    x0, y0 = int(x.min()), int(y.min())
    short = bool(np.all((c == np.rint(c)) & (np.abs(c) < 32767)))
    wide_x, wide_y = (bool(v.max() - v.min() > 32767) for v in (x, y))
    if version < 9 and (wide_x or wide_y):
        raise ValueError(f"blocks of version {version} are 32,768 bins wide at most")
    out = bytearray(struct.pack("<iii", len(x), x0, y0) + bytes([0 if short else 1]))
    out += bytes([wide_x, wide_y, 1]) if version > 8 else bytes([1])
    rows, starts = np.unique(y, return_index=True)
    out += struct.pack("<i" if wide_y else "<h", len(rows))
    entry = np.dtype([("x", "<i4" if wide_x else "<i2"), ("c", "<i2" if short else "<f4")])
    for row, first, last in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(y)]):
        cells = np.empty(last - first, entry)
        cells["x"], cells["c"] = x[first:last] - x0, c[first:last]
        out += struct.pack(("<i" if wide_y else "<h") + ("i" if wide_x else "h"), row - y0, last - first) + cells.tobytes()
    return bytes(out)


RECORD = ["chr1_idx", "chr2_idx", "bin_size", "block", "bin_y", "bin_x", "counts"]
#: Records of a file: its compressed blocks, a byte or two for each record, are what a task holds.
A_FILE = 1 << 24


def encoded_blocks(batches: Iterable[pa.RecordBatch], version: int) -> Iterator[tuple[tuple[int, int, int], int, float, bytes]]:
    """Map, block number, sum of counts and compressed block, one block after the other, of records in the order of their blocks."""
    held: list[pa.RecordBatch] = []  # of one block, until the next begins

    def made(some: list[pa.RecordBatch]) -> tuple[tuple[int, int, int], int, float, bytes]:
        c = {n: np.concatenate([np.asarray(b[n]) for b in some]) for n in RECORD}
        a, b, bin_size, block = (int(c[k][0]) for k in RECORD[:4])
        return (a, b, bin_size), block, float(c["counts"].sum()), zlib.compress(encoded(c["bin_x"], c["bin_y"], c["counts"], version))

    for batch in batches:
        keys = np.stack([np.asarray(batch[k]).astype(np.int64) for k in RECORD[:4]], axis=1)
        starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for first, last in zip([0, *starts.tolist()], [*starts.tolist(), len(keys)]):
            if first == last:
                continue
            if held and any(held[-1][k][0].as_py() != batch[k][first].as_py() for k in RECORD[:4]):
                yield made(held)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield made(held)


def file_pieces(maps: dict[tuple[int, int, int], list[tuple[int, float, bytes]]], chromosomes: list[tuple[str, int]], genome: str, version: int, block_bins: int, columns: int) -> Iterator[bytes]:
    """A file from its start to its end: maps by (chr1, chr2, bin size), each a list of (block number, sum of counts, compressed block). Sizes are known beforehand, so nothing is written twice."""
    size = "<q" if version > 8 else "<i"
    text = lambda s: s.encode() + b"\0"
    bins = sorted({b for _, _, b in maps})
    tail = text(genome) + (struct.pack("<qq", 0, 0) if version > 8 else b"") + struct.pack("<i", 1) + text("software") + text("tessera")
    tail += struct.pack("<i", len(chromosomes)) + b"".join(text(n) + struct.pack(size, length) for n, length in chromosomes)
    tail += struct.pack(f"<i{len(bins)}ii", len(bins), *bins, 0)
    at = len(text("HIC")) + 12 + len(tail)
    index: dict[str, tuple[int, int]] = {}
    records: dict[tuple[int, int], bytes] = {}
    for pair in sorted({(a, b) for a, b, _ in maps}):
        own = sorted((k[2], v) for k, v in maps.items() if k[:2] == pair)
        record = bytearray(struct.pack("<iii", *pair, len(own)))
        for i, (bin_size, blocks) in enumerate(own):
            record += text("BP") + struct.pack("<iffffiiii", i, sum(s for _, s, _ in blocks), 0, 0, 0, bin_size, block_bins, columns, len(blocks))
            for number, _, block in blocks:
                record += struct.pack("<iqi", number, at, len(block))
                at += len(block)
        index[f"{pair[0]}_{pair[1]}"] = at, len(record)
        records[pair] = bytes(record)
        at += len(record)
    yield text("HIC") + struct.pack("<iq", version, at) + tail
    for pair, record in records.items():
        for _, blocks in sorted((k[2], v) for k, v in maps.items() if k[:2] == pair):
            for _, _, block in blocks:
                yield block
        yield record
    footer = struct.pack("<i", len(index)) + b"".join(text(k) + struct.pack("<qi", *v) for k, v in index.items()) + struct.pack("<i", 0)
    yield struct.pack(size, len(footer)) + footer + struct.pack("<ii", 0, 0)


def write_contacts(contacts: DataFrame, chromosomes: list[tuple[str, int]], folder: str, genome: str = "", version: int = 8, block_bins: int = 256, a_file: int = A_FILE) -> DataFrame:
    """Writes contacts (chr1_idx, chr2_idx, bin_size, bin_x, bin_y, counts) to files in folder, about a_file records each; returns their paths, a row a file.

    chromosomes: name and length of each index from 0 on. Blocks are dealt to tasks by map and number, so a large map fills
    many files; a task encodes a block at a time and holds only compressed ones. A task that is run again writes another file, and only the paths returned count.
    """
    columns = 1 + max(length for _, length in chromosomes) // block_bins
    place = F.col("bin_x"), F.col("bin_y"), block_bins, columns
    number = block_number(*place)
    if version > 8:
        number = F.when(F.col("chr1_idx") == F.col("chr2_idx"), diagonal_block_number(*place)).otherwise(number)
    rows = contacts.select("chr1_idx", "chr2_idx", "bin_size", number.alias("block"), "bin_y", "bin_x", F.col("counts").cast("float").alias("counts"))
    key = RECORD[:4]
    parts = max(1, -(-rows.count() // a_file))
    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key, "bin_y", "bin_x")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[int, int, int], list[tuple[int, float, bytes]]] = {}
        for of_map, *block in encoded_blocks(batches, version):
            maps.setdefault(of_map, []).append(tuple(block))
        if not maps:
            return
        path = f"{folder.rstrip('/')}/map-{uuid.uuid4().hex}.hic"
        system, inner = fs.FileSystem.from_uri(path)
        with system.open_output_stream(inner) as out:
            for piece in file_pieces(maps, chromosomes, genome, version, block_bins, columns):
                out.write(piece)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    return checkpointed(dealt.mapInArrow(write, "path string"))
