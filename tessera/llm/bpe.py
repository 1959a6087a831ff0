"""BPE encoding and decoding by contiguous rank arrays.

A word is an array of parts and, beside it, the array of the ranks of adjacent parts. The least rank is
found by scanning, its boundary is deleted from both arrays, and the two ranks beside it are looked up
anew, until no pair has a rank. New words of about one length are done together, a row each, so that one
step of the scan is one numpy operation over all of them; a word longer than SHORT_WORD, where scanning
would cost its square, is merged with a heap of ranks over linked parts, in the same order.

Words come from a tokenizer file: its normalizer (NFC, white space to a space, lower case), the pattern of
its split, its special tokens in the text, its suffix for the end of a word. Decoding without a decoder in
the file joins the tokens with spaces. Null texts are empty; an empty text has no ids and decodes to the
empty text. Repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.chunks import BYTE_LETTERS, ChunkEncoder, pieces_of

NO_RANK = np.int32(2**31 - 1)
SHORT_WORD = 128
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 48, SHORT_WORD)


class RankEncoder(ChunkEncoder):
    leading_space = False

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.spec = spec["model"], spec
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = np.array([vocab[c] for c in BYTE_LETTERS], np.int64)
        self.final = np.array([vocab[c + suffix] for c in BYTE_LETTERS], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[s]] for p in pairs], np.int64) for s in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * len(self.tokens) + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = np.append(keys[order], 2**62), np.append(order, NO_RANK).astype(np.int32)
        self.width = len(self.tokens)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def split(self, text: str) -> list[bytes]:
        if text.isascii():
            text = text.lower()
        else:
            text = "".join([c.lower() for c in regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))])
        return [w.encode() for w in self.words.findall(text)]

    def merge_rows(self, parts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The merged parts of words of so many parts each; parts: a row a word, filled up on the right."""
        n, width = parts.shape
        out: list = [None] * n
        rows = np.arange(n)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        ranks[np.arange(width - 1) >= sizes[:, None] - 1] = NO_RANK
        column = np.arange(width)
        sizes = sizes.copy()
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = parts[i, : sizes[i]]
                go = ~done
                if not go.any():
                    return out
                rows, parts, ranks, sizes, at, least = rows[go], parts[go], ranks[go], sizes[go], at[go], least[go]
                keep = int(sizes.max())
                parts, ranks, column = parts[:, :keep], ranks[:, : keep - 1], column[:keep]
            i = np.arange(len(rows))
            # the boundary goes: what is right of it moves one place to the left
            parts[i, at] = self.merged[least]
            parts = np.take_along_axis(parts, np.minimum(column + (column > at[:, None]), len(column) - 1), axis=1)
            inner = column[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(inner + (inner >= at[:, None]), len(inner) - 1), axis=1)
            sizes -= 1
            ranks[i, sizes - 1] = NO_RANK
            before = at > 0
            ranks[i[before], at[before] - 1] = self.ranks(parts[i[before], at[before] - 1], parts[i[before], at[before]])
            after = at < sizes - 1
            ranks[i[after], at[after]] = self.ranks(parts[i[after], at[after]], parts[i[after], at[after] + 1])

    def merge_long(self, parts: np.ndarray) -> np.ndarray:
        value, n = parts.tolist(), len(parts)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        ranks = self.ranks(parts[:-1], parts[1:]).tolist()
        heap = [(r, i, value[i], value[i + 1]) for i, r in enumerate(ranks) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or value[i] != a or value[j] != b:
                continue
            value[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r = int(self.ranks(np.array([value[x]]), np.array([value[y]]))[0])
                    if r != NO_RANK:
                        heapq.heappush(heap, (r, x, value[x], value[y]))
        return np.array([v for v, live in zip(value, alive) if live], np.int64)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(at):
                rows = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in at]), np.uint8).reshape(-1, width)
                parts = self.inner[rows]
                parts[np.arange(len(at)), sizes[at] - 1] = self.final[rows[np.arange(len(at)), sizes[at] - 1]]
                for i, ids in zip(at.tolist(), self.merge_rows(parts, sizes[at])):
                    out[i] = ids
        for i in np.flatnonzero(sizes > low):
            letters = np.frombuffer(words[i], np.uint8)
            out[i] = self.merge_long(np.append(self.inner[letters[:-1]], self.final[letters[-1]]))
        return out

    def encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        found = [self.split(c) for c in chunks]
        at = {w: i for i, w in enumerate(dict.fromkeys(w for f in found for w in f))}
        ids = self.encode_words(list(at))
        none = np.empty(0, np.int64)
        return [ids[at[f[0]]] if len(f) == 1 else np.concatenate([none, *(ids[at[w]] for w in f)]) for f in found]

    def encode_whole(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += np.concatenate([np.empty(0, np.int64), *self.encode_words(self.split(part))]).astype(np.int64).tolist()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b" ".join([tokens[i] for i in ids])


_encoders: dict[str, RankEncoder] = {}


def rank_encoder(path: str) -> RankEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = RankEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of every text and the text they decode to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(tokenizer)
        for whole in batches:
            for batch in pieces_of(whole):
                ids, counts = encoder.encode(batch["text"])
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                decoded = [encoder.decode(ids[a:b].tolist()).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without sending ids and texts back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(tokenizer)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for whole in batches:
            for batch in pieces_of(whole):
                ids, counts = encoder.encode(batch["text"])
                own = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts), pa.array([sha(i.tobytes()) for i in own]), pa.array([sha(encoder.decode(i.tolist())) for i in own])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
