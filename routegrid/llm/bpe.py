"""Byte-level BPE over the vocabulary file of a public tokenizer."""
from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import id_type
from .hashing import slices

# How the byte-level pre-tokenizer of the vocabulary files splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings.

    Printable Latin-1 characters stand for themselves, the others for 256, 257, ... in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(b) if b in plain else shifted[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Merge ranks and token bytes; about 50,000 of each, so small enough to travel with a task.

    ``merges`` maps left * 2**20 + right to rank * 2**20 + merged.
    """

    name: str
    byte_ids: list[int]
    merges: dict[int, int]
    pieces: list[bytes]
    added: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a tokenizer file with a byte-level BPE model."""
        with open(path, "rb") as f:
            raw = f.read()
        spec = json.loads(raw)
        model, letters = spec["model"], _byte_letters()
        ids, byte_of = model["vocab"], {c: b for b, c in enumerate(letters)}
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges[ids[left] << 20 | ids[right]] = rank << 20 | ids[left + right]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        pieces = [b""] * (1 + max([*ids.values(), *added.values()]))
        for piece, i in ids.items():
            pieces[i] = bytes(byte_of[c] for c in piece)
        for piece, i in added.items():
            pieces[i] = piece.encode()
        return cls(hashlib.sha256(raw).hexdigest(), [ids[c] for c in letters], merges, pieces, added)


def merge(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply the merges to one piece, least rank first and leftmost among equals.

    Symbols form a doubly linked list.  The queue holds rank * 2**32 + place of adjacent pairs;
    an entry whose place no longer starts the pair of that rank is stale and skipped.
    """
    n, get = len(symbols), merges.get
    queue = []
    for i in range(n - 1):
        found = get(symbols[i] << 20 | symbols[i + 1])
        if found is not None:
            queue.append(found >> 20 << 32 | i)
    if not queue:
        return symbols
    heapify(queue)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        entry = heappop(queue)
        i = entry & 0xFFFFFFFF
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        found = get(symbols[i] << 20 | symbols[j])
        if found is None or found >> 20 != entry >> 32:
            continue
        merged = symbols[i] = found & 0xFFFFF
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = get(merged << 20 | symbols[k])
            if found is not None:
                heappush(queue, found >> 20 << 32 | i)
        h = before[i]
        if h >= 0:
            found = get(symbols[h] << 20 | merged)
            if found is not None:
                heappush(queue, found >> 20 << 32 | h)
    return [s for s in symbols if s >= 0]


class _Encoder(dict):
    """Packed 32-bit ids of stretches of text; short stretches are kept, up to ``most`` bytes of memory.

    A blank before a character that is no white space always starts a piece, so a text is cut
    there first; only stretches not seen before are split into pieces and merged.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 128 << 20):
        self.vocabulary, self.most, self.held = vocabulary, most, 0
        self.cut = re.compile(r" (?=[^\s\x85])").split
        self.split = regex.compile(PATTERN).findall
        names = sorted(vocabulary.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None

    def _keep(self, stretch: str, packed: bytes) -> bytes:
        if len(stretch) <= 48:
            self.held += 170 + len(stretch) + len(packed)  # with what the table and the objects take
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[stretch] = packed
        return packed

    def _piece(self, piece: str) -> bytes:
        ids = self.get(piece)
        if ids is not None:
            return ids
        byte_ids = self.vocabulary.byte_ids
        return self._keep(piece, array("i", merge([byte_ids[b] for b in piece.encode()], self.vocabulary.merges)).tobytes())

    def __missing__(self, stretch: str) -> bytes:
        pieces = self.split(stretch)
        packed = b"".join(map(self._piece, pieces))
        return packed if len(pieces) == 1 else self._keep(stretch, packed)

    def ordinary(self, text: str) -> bytes:
        first, *rest = self.cut(text)
        return b"".join([self[first], *[self[" " + s] for s in rest]])

    def encode(self, text: str) -> bytes:
        parts = self.special(text) if self.special else [text]
        if len(parts) == 1:
            return self.ordinary(text)
        added = self.vocabulary.added
        return b"".join(np.int32(added[p]).tobytes() if i % 2 else self.ordinary(p) for i, p in enumerate(parts))


_ENCODERS: dict[str, _Encoder] = {}  # of this worker process, by vocabulary


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids (array<int>): the token ids of every whole text.

    The strings of added tokens become those tokens.  A null or empty text has no ids.  Rows
    are encoded one by one, repeated rows alike; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(vocabulary.name, _Encoder(vocabulary))
        for part in slices(batches, "text", 4 << 20):
            packed = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            flat = np.frombuffer(b"".join(packed), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, text: the vocabulary strings of the ids, one after the other.

    Bytes that are not UTF-8 become U+FFFD.  No ids, or null, give an empty text; a null id or
    one outside the vocabulary gives nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array([*vocabulary.pieces, b""], object)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for ids in part.column("ids"):
                    own = ids.values.fill_null(-1).to_numpy() if ids.is_valid else np.zeros(0, np.int64)
                    own = np.where((own < 0) | (own >= len(pieces) - 1), len(pieces) - 1, own)
                    texts.append(b"".join(pieces[own].tolist()).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type(tokens)}, ids array<int>, text string")
