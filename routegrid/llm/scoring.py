"""Stupid-backoff scores of documents under the n-gram counts of all other documents."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import id_type
from .hashing import SPACED, U64, gram_hashes, mix, slices, text_buffer, word_hashes

_BATCH = 12 << 20  # bytes of text whose n-grams are looked up together
_BUCKET = 16 << 20  # bytes of text per bucket of the count table


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word offsets of the texts, and for each place but the last the bigram that starts there."""
    words, offs = word_hashes(*text_buffer(texts), SPACED)
    return words, offs, mix(gram_hashes(words, 2) + U64(2))


def _inside(offs: np.ndarray) -> np.ndarray:
    """Which places start a bigram within one text."""
    ok = np.ones(max(int(offs[-1]) - 1, 0), bool)
    cuts = offs[1:-1] - 1
    ok[cuts[(cuts >= 0) & (cuts < len(ok))]] = False
    return ok


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and bigrams of a batch, sorted by hash, with their numbers."""
    words, offs, pairs = _grams(texts)
    return np.unique(np.concatenate([words, pairs[_inside(offs)]]), return_counts=True)


def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], U64)


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for number, texts in _by_batch(batches):
        grams, counts = _distinct(texts)
        cuts = [0, *np.searchsorted(grams, _edges(buckets)).tolist(), len(grams)]
        rows = [(b, grams[x:y], counts[x:y]) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([number] * len(rows), pa.int64()),
            "grams": pa.array([r[1].tobytes() for r in rows], pa.binary()),
            "counts": pa.array([r[2].astype(np.uint32).tobytes() for r in rows], pa.binary()),
        })


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """Texts of each batch number, as far as its rows follow one another here."""
    number, held = None, []
    for batch in batches:
        numbers = np.asarray(batch.column("batch"))
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if held and numbers[x] != number:
                yield number, pa.chunked_array(held).combine_chunks()
                held = []
            number = int(numbers[x])
            held.append(batch.column("text").slice(x, y - x))
    if held:
        yield number, pa.chunked_array(held).combine_chunks()


def _count(group: pa.Table) -> pa.Table:
    """One bucket of the count table, joined back to every batch that asked for its n-grams.

    A batch whose rows were read apart asks several times; it gets one answer for the union of what it asked.
    """
    group = group.sort_by("batch")
    asked = [np.frombuffer(x.as_py(), U64) for x in group.column("grams")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("counts")])
    _, index = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(index, weights=counts).astype(np.int64).astype(np.uint64)
    ends = np.cumsum([0, *map(len, asked)])
    batches, first = np.unique(np.asarray(group.column("batch")), return_index=True)
    asks = np.diff(np.append(first, len(asked)))
    # numbers follow the order of the hashes, and so do the answers
    small = [totals[index[ends[f]:ends[f + 1]] if n == 1 else np.unique(index[ends[f]:ends[f + n]])] for f, n in zip(first, asks)]
    return pa.table({
        "batch": pa.array(batches, pa.int64()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(batches), pa.int32()),
        "totals": pa.array([(t.astype(np.uint32) if t.max() < 1 << 32 else t).tobytes() for t in small], pa.binary()),
        "wide": pa.array([bool(t.max() >= 1 << 32) for t in small], pa.bool_()),
    })


def _own(owner: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """How often each place's n-gram occurs in its own text."""
    _, inverse, counts = np.unique(owner * size + index, return_inverse=True, return_counts=True)
    return counts[inverse]


def _score(texts: pa.Array, totals: np.ndarray, all_words: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, offs, pairs = _grams(texts)
    many = len(offs) - 1
    if not len(words):
        return np.zeros(many, np.int64), np.zeros(many), np.zeros(many, np.int64)
    inside = _inside(offs)
    known, index = np.unique(np.concatenate([words, pairs[inside]]), return_inverse=True)
    owner = np.repeat(np.arange(many), np.diff(offs))
    single, double = index[:len(words)], index[len(words):]
    left_single = totals[single].astype(np.int64) - _own(owner, single, len(known))
    at = np.flatnonzero(inside) + 1  # the second word of each bigram
    left_double = totals[double].astype(np.int64) - _own(owner[at], double, len(known))
    rest = np.maximum(all_words - np.diff(offs), 1)[owner]
    # a word that no other text has counts as alpha of one
    one = np.where(left_single > 0, left_single, alpha) / rest
    ratio = one.copy()
    ratio[at] = np.where(left_double > 0, left_double / np.maximum(left_single[at - 1], 1), alpha * one[at])
    back = np.zeros(len(words), np.int64)
    back[at] = left_double == 0
    return (np.diff(offs), np.bincount(owner, weights=np.log(ratio), minlength=many), np.bincount(owner, weights=back, minlength=many).astype(np.int64))


def backoff_scores(docs: DataFrame, alpha: float = 0.4) -> DataFrame:
    """doc_id, n_words, log_score, n_backoff of each text under the bigram counts of all other texts.

    With c the counts over all texts less the text's own, a word w after v scores c(v w) / c(v)
    if c(v w) > 0, else alpha c(w) / N, N being the words of all other texts (at least 1); a text's
    first word scores c(w) / N.  Where c(w) = 0, alpha stands for it.  ``log_score`` sums the
    natural logarithms over the text; ``n_backoff`` counts the words that backed off.

    1. Texts are put into batches of bounded size; each batch asks for its distinct words and
       bigrams with its own numbers of them (counts combine before the shuffle).
    2. The count table is partitioned by hash range into buckets; a bucket adds up its n-grams
       and answers each batch once.  A bucket gets an n-gram once per batch (once more for each
       further task that read rows of it), so a frequent one is no hot key; the number of buckets
       follows the input.
    3. Each batch meets its answers and sums the scores of each text.

    A null or empty text has no words and scores 0.  Repeated rows are texts of their own and
    count for each other.  Words are what white space separates, A-Z lower-cased.
    """
    kind = id_type(docs)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        size = 0
        for part in slices(batches, "text", _BATCH // 8):
            buf, offs = text_buffer(part.column("text"))
            if size and size + len(buf) > _BATCH:
                number, size = number + 1, 0
            size += len(buf)
            _, word_offs = word_hashes(buf, offs, SPACED)
            yield pa.RecordBatch.from_pydict({
                "batch": pa.array([number] * part.num_rows, pa.int64()), "doc_id": part.column("doc_id"), "text": part.column("text"),
                "n_words": pa.array(np.diff(word_offs), pa.int64()),
            })

    rows = stage(docs.select("doc_id", "text").mapInArrow(assign, f"batch long, doc_id {kind}, text string, n_words long"))
    size = rows.agg(F.sum("n_words").alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    all_words, buckets = int(size["words"] or 0), 1 + int(size["bytes"] or 0) // _BUCKET
    asked = rows.select("batch", "text").mapInArrow(lambda b: _ask(b, buckets), "bucket int, batch long, grams binary, counts binary")
    answers = stage(asked.groupBy("bucket").applyInArrow(_count, "batch long, bucket int, totals binary, wide boolean"))
    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        found = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "totals", "wide"))))
        totals = np.concatenate([np.frombuffer(t, np.uint64 if w else np.uint32).astype(np.uint64) for _, t, w in found]) if found else np.zeros(0, np.uint64)
        # distinct n-grams do not depend on the order of the batch's rows
        words, score, back = _score(left.column("text").combine_chunks() if left.num_rows else pa.array([], pa.string()), totals, all_words, alpha)
        return pa.table({
            "doc_id": left.column("doc_id").cast(id_arrow), "n_words": pa.array(words, pa.int64()), "log_score": pa.array(score, pa.float64()),
            "n_backoff": pa.array(back, pa.int64())})

    return rows.select("batch", "doc_id", "text").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        judge, f"doc_id {kind}, n_words long, log_score double, n_backoff long")
