"""Document fingerprints by consistent weighted sampling."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import id_type
from .hashing import SPACED, U64, mix, randoms, text_buffer, word_hashes

_BLOCK = 1 << 11  # weighted terms sampled at once


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 32-bit ones."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -32)


def _draws(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and log c - r (1 - b) of each term and sample, with r, c ~ Gamma(2, 1) and b ~ U(0, 1).

    They depend on the term and the sample's number alone, so all documents see the same ones.
    """
    low = U64(0xFFFFFFFF)
    rate, shift, base = (np.empty((len(terms), samples), np.float32) for _ in range(3))
    for k, seeds in enumerate(randoms(3 * samples, 1 << 24).reshape(samples, 3)):
        a, b, c = (mix(terms ^ s) for s in seeds)
        r = -np.log(np.maximum(_uniform(a >> U64(32)) * _uniform(a & low), np.float32(1e-30)))
        log_c = np.log(-np.log(np.maximum(_uniform(b >> U64(32)) * _uniform(b & low), np.float32(1e-30))))
        u = np.minimum(_uniform(c >> U64(32)), np.float32(0.9999999))
        rate[:, k], shift[:, k], base[:, k] = r, u, log_c - r * (np.float32(1) - u)
    return rate, shift, base


def signatures(texts: list[str | None], samples: int) -> np.ndarray:
    """16-bit codes of the sampled (term, level) pairs, a row per text; zeros for a text without words.

    Terms are words (A-Z lower-cased) weighted by their number in the text.  For a weight w the
    level is t = floor(log w / r + b), and the sampled term has the least log c - r (t - b) - r.
    Two texts agree in a sample with a probability equal to the generalised Jaccard similarity
    of their weights (and once in 65,536 by chance).
    """
    out = np.zeros((len(texts), samples), np.uint16)
    words, offs = word_hashes(*text_buffer(pa.array([t or "" for t in texts], pa.string())), SPACED)
    if not len(words):
        return out
    owner = np.repeat(np.arange(len(texts)), np.diff(offs))
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])))
    weight = np.log(np.diff(np.append(first, len(words)))).astype(np.float32)
    words, owner = words[first], owner[first]
    terms, index = np.unique(words, return_inverse=True)
    rate, shift, base = _draws(terms, samples)
    least = np.full((len(texts), samples), np.inf, np.float32)
    for at in range(0, len(words), _BLOCK):
        end = min(len(words), at + _BLOCK)
        own, which = owner[at:end], index[at:end]
        key = base[which]  # a word that occurs once has level 0
        more = np.flatnonzero(weight[at:end])
        if len(more):
            many = which[more]
            key[more] -= rate[many] * np.floor(weight[at:end][more, None] / rate[many] + shift[many])
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        block, lengths = np.minimum.reduceat(key, starts, axis=0), np.diff(np.append(starts, len(own)))
        before = least[own[starts]]
        target = np.where(block < before, block, np.float32(-np.inf))
        rows, columns = np.nonzero(key == np.repeat(target, lengths, axis=0))
        term = which[rows]
        level = np.floor(weight[at:end][rows] / rate[term, columns] + shift[term, columns]).astype(np.int64)
        code = mix(words[at:end][rows] ^ mix(level.view(U64))) >> U64(48)
        out[own[rows], columns] = np.maximum(code, U64(1)).astype(np.uint16)
        least[own[starts]] = np.minimum(block, before)
    return out


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], following: list[str], samples: int) -> dict[str, list]:
    """Result rows of some documents; following[i] is the text after texts[i]."""
    n = len(texts)
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    # in a stretch of neighbours the next text is the next in the list: only the last is new
    extra = following[-1:] if texts[1:] == following[:-1] else following
    codes = signatures([*texts, *extra, *edited], samples)
    own, changed = codes[:n], codes[n + len(extra):]
    after = codes[1:n + 1] if len(extra) == 1 else codes[n:2 * n]
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).digest() for t in edited],
        "fingerprint": [c.astype(">u2").tobytes() for c in own], "edited_fingerprint": [c.astype(">u2").tobytes() for c in changed],
        "near_edited": (own == changed).mean(1).tolist(), "near_next": (own == after).mean(1).tolist(),
    }


def fingerprints(docs: DataFrame, samples: int = 64, most: int = 3 << 20) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness (the share of equal samples).

    The edited text has its last floor(n / 2) code points replaced by the first as many of the
    next document's (or all it has), in ascending order of id, then of text; after the last
    comes the first.  One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hexadecimal, 16 bits a sample), near_edited, near_next.

    Documents are range-partitioned once; each task walks its range in order, and only the first
    and last document of each range meet their neighbours in a second, small step.  A null text
    is empty; texts without words share the fingerprint of zeros; null ids come first.
    """
    kind = id_type(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    arrow = pa.schema([("doc_id", id_arrow), ("n_chars", pa.int64()), *[(c, pa.binary()) for c in names[2:5]], *[(c, pa.float64()) for c in names[5:]]])
    edge_arrow = pa.schema([*arrow, ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def edge(part: int, role: str, doc_id: object, text: str) -> pa.RecordBatch:
        row = {c: [None] for c in names} | {"doc_id": [doc_id], "part": [part], "role": [role], "text": [text]}
        return pa.RecordBatch.from_pydict(row, edge_arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        begun = False

        def done() -> pa.RecordBatch:
            """All waiting documents but the last, which waits for its successor."""
            row = _rows(ids[:-1], texts[:-1], texts[1:], samples)
            n = len(row["doc_id"])
            del ids[:-1], texts[:-1]
            return pa.RecordBatch.from_pydict(row | {"part": [part] * n, "role": ["whole"] * n, "text": [None] * n}, edge_arrow)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                if not begun:
                    yield edge(part, "first", doc_id, text)
                    begun = True
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= most and len(ids) > 1:
                    yield done()
                    size = len(texts[0])
        if len(ids) > 1:
            yield done()
        if ids:
            yield edge(part, "last", ids[0], texts[0])

    walked = stage(docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(
        walk, f"{schema}, part int, role string, text string"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                yield pa.RecordBatch.from_pydict(_rows(row["doc_id"], row["text"], row["following"], samples), arrow)

    # two rows per range
    firsts = walked.where("role = 'first'").select("part", "text")
    order = Window.orderBy("part")
    links = firsts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    following = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = walked.where("role = 'last'").select("part", "doc_id", "text").join(links, "part").join(following, "next_part")
    found = walked.where("role = 'whole'").select(*names).unionByName(lasts.select("doc_id", "text", "following").mapInArrow(close, schema))
    return found.withColumns({c: F.lower(F.hex(c)) for c in names[2:5]})
