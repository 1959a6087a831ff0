"""Token-ID output: sorted-string-table shards of encoded documents.

A shard is one file of documents in ascending key order:

    block*   entries (shared key bytes u16, own key bytes u16, value bytes u32, own key bytes, value),
             keys prefix-compressed against the entry before; every RESTART-th entry has its whole key;
             after the entries the offsets of those whole keys (u32 each) and their count (u32)
    index    one entry a block: key bytes u16, key of its last document, offset u64, size u32
    filter   Bloom filter over the keys: number of hashes u8, then the bits
    footer   index offset and size, filter offset and size (u64 each), documents u64, tokens u64,
             bytes a token u8, "TSST1"

Keys are doc_ids as nine bytes that sort like them (b"\\0" for null, first of all). Values are
little-endian ids of 2 or 4 bytes. A reader finds a document by the filter, a binary search over
the sparse index and one over the block's whole keys.

Tasks write a file each under a name of their own and report it in a manifest; a task that is run
again writes another file, and files that no manifest names do not count. Rows with one doc_id are
all kept, in order of their text's hash, so that a doc_id of very many rows may fill several shards. A null text is the
empty document. An empty table gives no shards. Further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.chunks import library_encoder, pieces_of

MAGIC = b"TSST1"
FOOTER = struct.Struct("<QQQQQQB5s")
ENTRY = struct.Struct("<HHI")
RESTART = 8
BLOCK_BYTES = 64 << 10
BITS_A_KEY, HASHES = 10, 7
SHARD_BYTES, MOST_SHARDS = 32 << 20, 1 << 16  # of text; with more text than that shards are larger
FINEST = 4  # ranges for each shard, which are put together by bytes
MANIFEST = "shard int, path string, first_key binary, last_key binary, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def doc_id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bits(key: bytes, n_bits: int) -> list[int]:
    one, two = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(one + i * two) % n_bits for i in range(HASHES)]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; Hadoop's names of object stores are known too."""
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}" if rest else path)


class ShardWriter:
    """Writes entries that come in ascending key order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.index, self.keys, self.n_docs, self.n_tokens = bytearray(), [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.keys.append(key)
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if not self.in_block:
            return
        self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        self.index += struct.pack("<H", len(self.last)) + self.last + struct.pack("<QI", self.at, len(self.block))
        self.out.write(bytes(self.block))
        self.at += len(self.block)
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""

    def close(self) -> None:
        self._end_block()
        n_bits = max(64, BITS_A_KEY * len(self.keys)) // 8 * 8 + 8
        bits = bytearray(n_bits // 8)
        for key in self.keys:
            for b in _bits(key, n_bits):
                bits[b >> 3] |= 1 << (b & 7)
        bloom = bytes([HASHES]) + bytes(bits)
        footer = FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(bloom), self.n_docs, self.n_tokens, self.width, MAGIC)
        self.out.write(bytes(self.index) + bloom + footer)
        self.out.close()


class Shard:
    """Reads one shard by ranges: the footer, index and filter on opening, then blocks as they are asked for."""

    def __init__(self, path: str) -> None:
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        end = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_tokens, width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.last_keys, self.blocks = [], []
        index, at = self.file.read_at(index_size, index_at), 0
        while at < len(index):
            (n,) = struct.unpack_from("<H", index, at)
            self.last_keys.append(index[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QI", index, at + 2 + n))
            at += 14 + n
        self.bloom = self.file.read_at(bloom_size, bloom_at)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _entries(self, block: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        (n,) = struct.unpack_from("<I", block, len(block) - 4)
        end, key = len(block) - 4 * (n + 1), b""
        while at < end:
            shared, own, size = ENTRY.unpack_from(block, at)
            at += ENTRY.size
            key = key[:shared] + block[at : at + own]
            yield key, block[at + own : at + own + size]
            at += own + size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for offset, size in self.blocks:
            for key, value in self._entries(self.file.read_at(size, offset), 0):
                yield doc_id_of(key), np.frombuffer(value, self.dtype)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that doc_id here."""
        key, n_bits = key_of(doc_id), 8 * (len(self.bloom) - 1)
        if not all(self.bloom[1 + (b >> 3)] >> (b & 7) & 1 for b in _bits(key, n_bits)):
            return []
        found = []
        for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
            offset, size = self.blocks[k]
            block = self.file.read_at(size, offset)
            (n,) = struct.unpack_from("<I", block, size - 4)
            restarts = struct.unpack_from(f"<{n}I", block, size - 4 * (n + 1))
            # the last whole key below the one sought; entries of that key follow it
            r = bisect_left(restarts, key, key=lambda at: block[at + ENTRY.size : at + ENTRY.size + ENTRY.unpack_from(block, at)[1]])
            for here, value in self._entries(block, restarts[max(0, r - 1)]):
                if here > key:
                    return found
                if here == key:
                    found.append(np.frombuffer(value, self.dtype))
        return found


def _place(doc_id: int | None, t: int) -> tuple[bool, int, int]:
    return doc_id is not None, doc_id or 0, t


def _cuts(rows: DataFrame, shard_bytes: int) -> list[tuple[bool, int, int]]:
    """Where each shard begins: places of documents (doc_id, t, n: bytes) that part them into shards of about shard_bytes, MOST_SHARDS at most."""
    small = common.save(rows, "sizes")
    total = small.agg(F.sum("n")).first()[0] or 0
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    fine = small.repartitionByRange(FINEST * (total // size + 1), "doc_id", "t").groupBy(F.spark_partition_id().alias("part"))
    parts = fine.agg(F.min(F.struct("doc_id", "t")).alias("first"), F.sum("n").alias("n")).orderBy("part").collect()  # FINEST for each shard
    common.drop_saved(small)
    cuts, room = [], 0
    for r in parts:
        if not cuts or room + r["n"] > size:
            cuts.append(_place(r["first"]["doc_id"], r["first"]["t"]))
            room = 0
        room += r["n"]
    return cuts


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes docs (doc_id, text), appends end_id to each, and writes them to folder in ascending doc_id order.

    Returns the manifest (shard, path, first and last key, n_docs, n_tokens), one row for each shard that has documents;
    it is kept as a table, so the work is done once. Documents are dealt to shards by ranges of doc_id and the text's hash, which are
    found from sizes alone. Texts are encoded where they are read, and ids of two or four bytes are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    cuts = _cuts(rows.select("doc_id", "t", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), shard_bytes)
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    width = 2 if max(library_encoder(tokenizer).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dtype = np.dtype(f"<u{width}")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for whole in batches:
            for batch in pieces_of(whole):
                ids, counts = encoder.encode(batch["text"])
                ends = np.concatenate([[0], np.cumsum(counts + 1)])
                ids = np.insert(ids, ends[1:] - np.arange(1, len(ends)), end_id).astype(dtype)  # each document's end id
                offsets = pa.py_buffer((ends * width).astype(np.int32).tobytes())
                values = pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(ids.tobytes())])
                shard = [bisect_right(cuts, _place(d, t)) - 1 for d, t in zip(batch["doc_id"].to_pylist(), batch["t"].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch["doc_id"], batch["t"], values], names=["shard", "doc_id", "t", "ids"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, shard, keys = None, "", 0, []
        for batch in batches:
            if out is None and batch.num_rows:
                shard = batch["shard"][0].as_py()
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                system, inner = file_system(path)
                out = ShardWriter(system.open_output_stream(inner), width)
            doc_ids = batch["doc_id"].to_pylist()
            for doc_id, value in zip(doc_ids, batch["ids"]):
                out.add(key_of(doc_id), value.as_py())
            keys = [*keys[:1], *(key_of(d) for d in (doc_ids[:1] + doc_ids[-1:]))]
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "first_key": [keys[0]], "last_key": [keys[-1]], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens]})

    encoded = rows.select("doc_id", "t", "text").mapInArrow(encode, "shard int, doc_id long, t long, ids binary")
    dealt = encoded.repartitionById(max(1, len(cuts)), F.col("shard")).sortWithinPartitions("doc_id", "t")  # a task a shard
    return common.save(dealt.mapInArrow(write, MANIFEST), "token-shards-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum over shards is over one small row a shard.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = manifest.select("path", before.alias("first")).repartition(max(1, manifest.count()))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["first"].to_pylist()):
                ids, starts, counts, crcs = [], [], [], []
                with Shard(path) as shard:
                    for doc_id, value in shard.scan():
                        ids.append(doc_id)
                        starts.append(start)
                        counts.append(len(value))
                        crcs.append(zlib.crc32(value.astype("<u4").tobytes()))
                        start += len(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The documents of some doc_ids (one column, doc_id): doc_id, ids. A shard is asked only for ids within its keys."""
    rows = manifest.select("path", "first_key", "last_key").orderBy("shard").toArrow()  # a row a shard
    paths, firsts, lasts = ([x if isinstance(x, str) else bytes(x) for x in rows[c].to_pylist()] for c in ("path", "first_key", "last_key"))
    ranges = manifest.sparkSession.sparkContext.broadcast((paths, firsts, lasts))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, firsts, lasts = ranges.value
        for batch in batches:
            keys = [key_of(d) for d in batch["doc_id"].to_pylist()]
            asked = [(i, path) for i, key in enumerate(keys) for path in paths[bisect_left(lasts, key) : bisect_right(firsts, key)]]
            at = pa.array([i for i, _ in asked], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), pa.array([path for _, path in asked], pa.string())], names=["doc_id", "path"])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of = None, None
        for batch in batches:
            for doc_id, path in zip(batch["doc_id"].to_pylist(), batch["path"].to_pylist()):
                if path != of:
                    if shard is not None:
                        shard.__exit__(None, None, None)
                    shard, of = Shard(path).__enter__(), path
                got = shard.get(doc_id)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(got), pa.int64()), pa.array([v.tolist() for v in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])
        if shard is not None:
            shard.__exit__(None, None, None)

    wanted = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(route, "doc_id long, path string")
    return wanted.repartition("path", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("path", "doc_id").mapInArrow(find, "doc_id long, ids array<long>")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    folder = common.new_folder(spark, "token-shards")
    return read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, folder))
