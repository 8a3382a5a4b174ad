"""Benchmark decontamination by winnowed word fingerprints."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import released, stage
from .frames import KEY, batch_of, id_type, join_rows, list_of, row_key, texts
from .hashing import LETTERED, U64, gram_hashes, gram_owners, mix, signed, slices, text_buffer, window_min, word_hashes


def _winnow(words: np.ndarray, offs: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the flat word list) and k-gram hashes chosen by winnowing.

    Of every ``span - k + 1`` consecutive k-grams of a text the least hash is kept, at its last
    place, so two texts that share ``span`` words keep the same k-gram of that passage.
    """
    grams, width = gram_hashes(words, k), span - k + 1
    starts, _ = gram_owners(offs, span)
    if not len(starts):
        return np.zeros(0, np.int64), grams[:0]
    wanted = window_min(grams, width)[starts]
    kept, still = np.zeros(len(grams), bool), np.ones(len(starts), bool)
    for back in range(width - 1, -1, -1):
        hit = still & (grams[starts + back] == wanted)
        kept[starts[hit] + back] = True
        still &= ~hit
    where = np.flatnonzero(kept)
    return where, grams[where]


def _fingerprints(words: np.ndarray, offs: np.ndarray, span: int, k: int, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat fingerprint hashes, their word positions in their text, and n + 1 offsets.

    For each length in ``short`` every n-gram is a fingerprint besides the winnowed ones: items
    of fewer than ``span`` words are one window of just that length.
    """
    place, grams = _winnow(words, offs, span, k)
    places, hashes = [place], [grams]
    for m in short:
        at, _ = gram_owners(offs, m)
        places.append(at)
        hashes.append(mix(gram_hashes(words, m)[at] + U64(m)) if len(at) else grams[:0])
    place, grams = np.concatenate(places), np.concatenate(hashes)
    owner = np.searchsorted(offs, place, "right") - 1
    order = np.argsort(owner, kind="stable") if short else slice(None)
    ends = np.searchsorted(owner[order], np.arange(len(offs)))
    return grams[order], (place - offs[owner])[order], ends


def _benchmark_words(benchmark: DataFrame, span: int, k: int) -> DataFrame:
    """item_key, item_id, item_words and fingerprints of every non-empty item, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, offs = word_hashes(*text_buffer(part.column("text")), LETTERED)
            grams, pos = [], []
            for a, b in zip(offs, offs[1:]):
                g, p, _ = _fingerprints(words[a:b], np.array([0, b - a]), span, k, [int(b - a)] if 0 < b - a < span else [])
                grams.append(signed(g))
                pos.append(p.astype(np.int32))
            yield batch_of({
                "item_key": part.column("item_key"), "item_id": part.column("item_id"), "item_words": list_of(signed(words), offs),
                "gram": pa.array(grams, pa.list_(pa.int64())), "item_pos": pa.array(pos, pa.list_(pa.int32())),
            })

    items = benchmark.select(
        row_key("item_id", "text").alias("item_key"), F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    return items.mapInArrow(run, "item_key long, item_id string, item_words array<long>, gram array<long>, item_pos array<int>").where("size(item_words) > 0")


def _extended(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Per document: hit words and matching items, from its candidate diagonals."""
    for part in slices(batches, "text", 1 << 20):
        words, offs = word_hashes(*text_buffer(part.column("text")), LETTERED)
        n_hit, items = [], []
        for i, candidates in enumerate(part.column("candidates").to_pylist()):
            own, names = signed(words[offs[i]:offs[i + 1]]), set()
            step = np.zeros(len(own) + 1, np.int64)
            for c in candidates:
                item = np.array(c["item_words"], np.int64)
                for shift in set(c["shifts"]):  # all hits of a diagonal are extended at once
                    lo, hi = max(0, shift), min(len(own), shift + len(item))
                    same = np.concatenate([[False], own[lo:hi] == item[lo - shift:hi - shift], [False]])
                    edges = np.flatnonzero(same[1:] != same[:-1])
                    for a, b in zip(edges[::2], edges[1::2]):
                        if b - a >= min(span, len(item)):
                            step[lo + a] += 1
                            step[lo + b] -= 1
                            names |= {c["item_id"]} - {None}
            n_hit.append(int((np.cumsum(step)[:-1] > 0).sum()))
            items.append(sorted(names))
        yield batch_of({
            KEY: part.column(KEY), "doc_id": part.column("doc_id"), "n_hit": pa.array(n_hit, pa.int64()),
            "items": pa.array(items, pa.list_(pa.string())),
        })


def _marked(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 7, one_in: int = 20) -> DataFrame:
    """The rows of ``contamination`` with their _row_key."""
    bench = stage(_benchmark_words(benchmark, span, k))
    short = sorted(r[0] for r in bench.where(F.size("item_words") < span).select(F.size("item_words")).distinct().collect())  # under span values
    marks = stage(bench.select("item_key", F.inline(F.arrays_zip("gram", "item_pos"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            words, offs = word_hashes(*text_buffer(part.column("text")), LETTERED)
            grams, pos, ends = _fingerprints(words, offs, span, k, short)
            yield batch_of({
                KEY: part.column(KEY), "doc_id": part.column("doc_id"), "n_words": np.diff(offs),
                "gram": list_of(signed(grams), ends), "pos": list_of(pos.astype(np.int32), ends),
            })

    read = texts(docs).mapInArrow(run, f"{KEY} long, doc_id {id_type(docs)}, n_words long, gram array<long>, pos array<int>")
    # a first row per document carries its length through the join, whatever it matches
    rows = read.select(KEY, "doc_id", "n_words", F.inline(F.concat(
        F.array(F.struct(F.lit(None).cast("long").alias("gram"), F.lit(-1).alias("pos"))), F.arrays_zip("gram", "pos"))))
    met = stage(rows.join(marks, "gram", "left").where("pos < 0 OR item_key IS NOT NULL").select(
        KEY, "doc_id", "n_words", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")))
    candidates = (
        met.where("item_key IS NOT NULL").groupBy(KEY, "doc_id", "item_key").agg(F.collect_set("shift").alias("shifts"))
        .join(bench.select("item_key", "item_id", "item_words"), "item_key")
        .groupBy(KEY, "doc_id").agg(F.collect_list(F.struct("item_id", "item_words", "shifts")).alias("candidates"))
    )
    judged = join_rows(candidates, texts(docs)).mapInArrow(
        lambda batches: _extended(batches, span), f"{KEY} long, doc_id {id_type(docs)}, n_hit long, items array<string>")
    judged = judged.dropDuplicates([KEY, "doc_id"])  # repeated rows
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return join_rows(met.where("item_key IS NULL").select(KEY, "doc_id", "n_words"), judged, "left").select(
        KEY, "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 7, one_in: int = 20) -> DataFrame:
    """Words of each document that lie in a passage shared with a benchmark item.

    A window is ``span`` consecutive words of an item (all words of a shorter, non-empty item).
    A document word inside an occurrence of a window is hit; a document is contaminated when a
    word is hit and at least one word in ``one_in`` is.  One row per row of ``docs``: doc_id,
    n_words, n_hit, items (ids as strings, sorted), contaminated.

    Winnowing keeps, on both sides, the least k-gram hash of every run of ``span`` words; kept
    hashes are joined (Spark broadcasts the benchmark's side only if its written size allows)
    and each alignment found is extended along its diagonal.  Every shared window contains a
    shared fingerprint, so none is missed.

    A null or empty text has no words and is clean.  Null or empty items match nothing, items
    without an id hit words but have no name in ``items``, repeated rows on either side change
    nothing but their own row.
    """
    return _marked(docs, benchmark, span, k, one_in).drop(KEY)


def clean(docs: DataFrame, benchmark: DataFrame, **limits: int) -> DataFrame:
    """The documents that are not contaminated, with all their columns; each row is judged by its own id, null or not, and text."""
    with released(docs.sparkSession) as keep:
        bad = keep(_marked(docs, benchmark, **limits).where("contaminated").select(KEY, "doc_id").distinct())
    rows = docs.select(row_key("doc_id", "text").alias(KEY), "doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return join_rows(rows, bad, "left_anti").select("row.*")
