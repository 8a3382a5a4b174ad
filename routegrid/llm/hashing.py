"""Vectorised hashing of words and byte strings in Arrow text columns.

Everything here works on one Arrow batch inside a task.  Hashes are 64 bits wide, the same in
every process, and used as identities of words, shingles and byte strings.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_CHUNK = 1 << 18  # bytes hashed at once; bounds the temporary arrays, not the text


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    x = np.asarray(x, U64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


_BYTE = randoms(256, 1 << 20)
_PLACE = randoms(4096, 1 << 21) | U64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z to a-z

SPACED = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LETTERED = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
LETTERED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and the n + 1 offsets; a null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part has at most ``most`` bytes of text, or one row."""
    for batch in batches:
        _, offs = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_hashes(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z folded) and the n + 1 offsets of each text's words.

    A word is a longest run of bytes b with inside[b]; it never crosses texts.
    """
    hashes: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + _CHUNK)
        if end < n and inside[buf[end - 1]] and inside[buf[end]]:  # go on to the end of that word
            stop, step = int(offs[np.searchsorted(offs, end)]), 4096
            while end < stop:
                rest = np.flatnonzero(~inside[buf[end:min(stop, end + step)]])
                if len(rest):
                    end += int(rest[0])
                    break
                end, step = min(stop, end + step), step * 2
        part = buf[at:end]
        is_in = inside[part]
        first = is_in.copy()
        first[1:] &= ~is_in[:-1]
        cuts = offs[np.searchsorted(offs, at, "right"):np.searchsorted(offs, end)] - at
        first[cuts] = is_in[cuts]
        spots = np.flatnonzero(is_in)
        if len(spots):
            at_first = np.flatnonzero(first[spots])
            lengths = np.diff(np.append(at_first, len(spots)))
            rank = np.arange(len(spots)) - np.repeat(at_first, lengths)
            longest = int(lengths.max())
            place = _PLACE if longest <= len(_PLACE) else randoms(longest, 1 << 21) | U64(1)
            value = _BYTE[FOLD[part[spots]]] * place[rank]
            hashes.append(mix(np.add.reduceat(value, at_first) + lengths.astype(U64)))
            starts.append(spots[at_first] + at)
        at = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, offs)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i + k] for each i; runs over text ends, the caller masks those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j, factor in enumerate(randoms(k, 1 << 22) | U64(1)):
        out += words[j:j + n] * factor
    return mix(out)


def whole(words: np.ndarray, k: int) -> int:
    """Hash of a sequence shorter than k words, apart from those of k words."""
    return int(mix(gram_hashes(words, len(words)) + U64(k * 1000 + len(words)))[0])


def gram_owners(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the k-grams that lie in one text, and each one's text."""
    counts = np.maximum(np.diff(word_offs) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[owner] + word_offs[:-1][owner], owner


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for each i with a whole window, in two running minima."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w <= 32:
        out, have = x.copy(), 1
        while have < w:
            step = min(have, w - have)
            out = np.minimum(out[:-step], out[step:])
            have += step
        return out
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
