"""Token ids of whole texts, a batch at a time, each different chunk being encoded once.

A chunk starts at a space, at or after a line feed, or at a full stop or comma after a
letter. Both pre-tokenizers here never put characters from both sides of such an edge
into one token, so the ids of a text are the ids of its chunks one after the other. Texts where that does not hold (two
white-space characters in a row, other white space than space and line feed, something
that looks like a special token) are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Where a text must be encoded whole (RE2).
ODD = (
    r"[ \n][ \n]|<\||"
    r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
)
MARK = "\x1f"
#: Chunks kept in a worker; beyond that the store starts anew.
KEPT_CHUNKS = 400_000
BATCH_CHARS = 2_000_000


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


BYTE_LETTERS = byte_letters()


class ChunkEncoder:
    """Encodes batches of texts; subclasses say how a new chunk is encoded."""

    leading_space = True  # whether a chunk's space belongs to its tokens

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def encode_chunks(self, chunks: list[str]) -> list:
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def _add(self, chunks: pa.Array) -> None:
        ids = self.encode_chunks(chunks.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        more = int(sizes.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + more] = np.fromiter((x for i in ids for x in i), np.uint32, more)
        self.known = pa.concat_arrays([self.known, chunks])
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += more

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has. Null is the empty text."""
        ids, counts, first = [], [], 0
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
        while first < len(texts):
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + BATCH_CHARS, "right")))
            one, n = self._encode(pc.fill_null(texts[first:last], ""))
            ids.append(one)
            counts.append(n)
            first = last
        if not ids:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _store(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk its place in the store, and where each text's chunks begin."""
        marked = pc.replace_substring(texts, "\n", MARK + "\n" + MARK if self.leading_space else MARK)
        marked = pc.replace_substring_regex(marked, "([A-Za-z])([.,])", "\\1" + MARK + "\\2")
        split = pc.split_pattern(pc.replace_substring(marked, " ", MARK + " " if self.leading_space else MARK), MARK)
        values = split.flatten()
        coded = values.dictionary_encode()
        if len(self.known) > KEPT_CHUNKS:
            self.forget()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        if place.null_count:
            new = pc.is_null(place)
            place = np.asarray(pc.fill_null(place, 0)).astype(np.int64)
            place[np.asarray(new)] = len(self.known) + np.arange(pc.sum(new).as_py())
            self._add(coded.dictionary.filter(new))
        place = np.asarray(place).astype(np.int64)
        offsets = np.asarray(split.offsets).astype(np.int64)
        return place[np.asarray(coded.indices)] if len(values) else np.empty(0, np.int64), offsets - offsets[0]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(texts, ODD))
        if odd.any():
            texts_fast = pc.if_else(pa.array(odd), "", texts)
        else:
            texts_fast = texts
        place, offsets = self._store(texts_fast)
        size, start = self.size[place], self.start[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[offsets]
        counts = np.diff(bounds)
        if odd.any():
            parts = np.split(ids, bounds[1:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.asarray(self.encode_whole(texts[int(i)].as_py()), np.uint32)
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts


class LibraryEncoder(ChunkEncoder):
    """The tokenizers library's ids for a tokenizer file: model.tokenize() for each different word of the plain kinds, encode() for the rest."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        split = next((x for x in before.get("pretokenizers", []) if x["type"] == "Split"), None)
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
            # Fixed value: the byte-level pre-tokenizer's pattern.
            self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
            self.lower = False
        elif split and (spec.get("normalizer") or {}).get("normalizers", [{}])[-1].get("type") == "Lowercase":
            self.pattern = regex.compile(split["pattern"]["Regex"])
            self.lower = True
            self.leading_space = False
        else:
            self.pattern = None
        self.plain = regex.compile("[\n\x20-\x7e\xa1-ɏ]*")

    def encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.pattern is not None:
            return super()._encode(texts)
        ids = [x.ids for x in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for i in ids for x in i), np.uint32, int(counts.sum())), counts

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        tokenize = self.library.model.tokenize
        out = []
        for chunk in chunks:
            if chunk.isascii():
                if self.lower:
                    chunk = chunk.lower()
                if chunk.isalpha():
                    out.append([t.id for t in tokenize(chunk)])
                    continue
                if chunk[:1] == " " and chunk[1:].isalpha():
                    out.append([t.id for t in tokenize(BYTE_LETTERS[32] + chunk[1:])])
                    continue
            elif not self.plain.fullmatch(chunk):
                out.append(self.encode_whole(chunk))
                continue
            elif self.lower:
                chunk = self.library.normalizer.normalize_str(chunk)
            out.append([t.id for w in self.pattern.findall(chunk) for t in tokenize("".join([BYTE_LETTERS[b] for b in w.encode()]))])
        return out


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """This worker's encoder for a tokenizer file."""
    if ("library", path) not in _encoders:
        _encoders["library", path] = LibraryEncoder(path)
    return _encoders["library", path]


def pieces_of(batch: pa.RecordBatch, most: int = BATCH_CHARS, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, one row at least."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)) if batch.num_rows else np.empty(0)
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(first, last - first)
        first = last
