"""Jaccard join of word shingle sets by prefix filters under several global orders."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import released, stage
from .components import components
from .frames import KEY, batch_of, id_type, join_rows, list_of, row_key, texts
from .hashing import SPACED, U64, gram_hashes, gram_owners, mix, signed, slices, text_buffer, whole, word_hashes

_SKETCH_BITS = 18
_WORDS = 8  # 64-bit words of a text's parities
_PARITIES = [f"w{i}" for i in range(_WORDS)]


def _sets(part: pa.RecordBatch, k: int, column: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, their n + 1 offsets, and a hash of each word sequence."""
    words, offs = word_hashes(*text_buffer(part.column(column)), SPACED)
    counts = np.diff(offs)
    at, owner = gram_owners(offs, k)
    shingles = gram_hashes(words, k)[at] if len(at) else np.zeros(0, U64)
    few = np.flatnonzero((counts > 0) & (counts < k))  # the whole sequence is the one shingle
    shingles = np.concatenate([shingles, np.array([whole(words[offs[i]:offs[i + 1]], k) for i in few], U64)])
    owner = np.concatenate([owner, few])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    place = np.arange(len(words)) - np.repeat(offs[:-1], counts)
    running = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words + mix(place.astype(U64))), dtype=U64)])
    sequence = mix(running[offs[1:]] - running[offs[:-1]] + counts.astype(U64))
    return shingles, np.searchsorted(owner, np.arange(part.num_rows + 1)), sequence


def _frequencies(rows: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all texts fall into each of 2**18 slots; 2 MB whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SKETCH_BITS, np.int64)
        for part in slices(batches, "text", 4 << 20):
            words, offs = word_hashes(*text_buffer(part.column("text")), SPACED)
            at, _ = gram_owners(offs, k)
            if len(at):
                total += np.bincount((gram_hashes(words, k)[at] >> U64(64 - _SKETCH_BITS)).astype(np.int64), minlength=len(total))
        slot = np.flatnonzero(total)
        yield batch_of({"slot": slot.astype(np.int32), "n": total[slot]})

    found = rows.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << _SKETCH_BITS, np.int64)
    out[found["slot"]] = found["n"]
    return out


def _prefixes(shingles: np.ndarray, offs: np.ndarray, frequency: np.ndarray, percent: int, orders: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the prefix of each set, with n + 1 offsets.

    Every order puts frequent shingles last; the first by the count of their slot, the others by
    classes of that count and, within a class, by a hash of their own.  With a similarity of
    percent / 100 two sets share a shingle within the first n - ceil(n * percent / 100) + 1 of
    either, under every order.
    """
    sizes = np.diff(offs)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    length = sizes - -(-sizes * percent // 100) + 1
    counts = frequency[(shingles >> U64(64 - _SKETCH_BITS)).astype(np.int64)]
    rank = np.arange(len(shingles)) - np.repeat(offs[:-1], sizes)
    kept = rank < length[owner]
    ends = np.concatenate([[0], np.cumsum(np.minimum(sizes, length))])
    out = []
    for o in range(orders):
        if o == 0:
            order = np.lexsort((shingles, counts, owner))
        else:
            hashed = mix(shingles + U64(o)) >> U64(8)
            steps = np.floor(4 * np.log2(counts + 1.0)).astype(U64) << U64(56)
            order = np.lexsort((hashed | steps, owner))
        out.append((shingles[order][kept], ends))
    return out


def _parities(shingles: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each set, whether an odd number of its shingles falls into each of 512 slots, as 8 words.

    Every shingle that only one of two sets has turns one bit, so the bits that differ are never
    more than these shingles.
    """
    slot = mix(shingles + U64(0x9E37)) >> U64(58 - (_WORDS - 1).bit_length())
    bit, word = U64(1) << (slot & U64(63)), slot >> U64(6)
    out = []
    for w in range(_WORDS):
        running = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(np.where(word == w, bit, U64(0)))])
        out.append(running[offs[1:]] ^ running[offs[:-1]])
    return out


def _fits(percent: int) -> Column:
    """Whether the sizes and parities of sets a and b allow the similarity: (100 + percent) times what only one has <= (100 - percent) times both sizes."""
    differ = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _PARITIES[1:]), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _verified(pairs: DataFrame, contents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                (x, xo, _), (y, yo, _) = _sets(part, k, "text_a"), _sets(part, k, "text_b")
                good = []
                for i in range(part.num_rows):
                    p, q = x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]
                    both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                    good.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = contents.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = contents.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _filtered(pairs: DataFrame, prefixes: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow the similarity and that share a prefix shingle under every order.

    Sizes and parities come first, so that only the pairs they leave carry prefixes through a shuffle.
    """
    def side(name: str, columns: list[str]) -> DataFrame:
        return prefixes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    pairs = pairs.join(side("a", ["n", *_PARITIES]), "a").join(side("b", ["n", *_PARITIES]), "b").where(_fits(percent)).select("a", "b")
    others = [f"p{o}" for o in range(1, orders)]
    meet: Column = F.lit(True)
    for c in others:
        meet = meet & F.arrays_overlap(f"{c}_a", f"{c}_b")
    return pairs.join(side("a", others), "a").join(side("b", others), "b").where(meet).select("a", "b")


def _linked(docs: DataFrame, k: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """_row_key, doc_id, n (shingles) and label (one per component; of no use where n is 0) of every row, for ``similar_texts``."""
    rows = texts(docs)
    frequency = _frequencies(rows, k)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            shingles, offs, sequence = _sets(part, k)
            out = {KEY: part.column(KEY), "doc_id": part.column("doc_id"), "node": signed(sequence), "n": np.diff(offs),
                   **dict(zip(_PARITIES, map(signed, _parities(shingles, offs))))}
            for o, (tokens, ends) in enumerate(_prefixes(shingles, offs, frequency, percent, orders)):
                # filters of further orders work on 32 bits: they may pass too much, never too little
                out[f"p{o}"] = list_of(signed(tokens) if o == 0 else (tokens >> U64(32)).astype(np.uint32).view(np.int32), ends)
            yield batch_of(out)

    schema = f"{KEY} long, doc_id {id_type(docs)}, node long, n long, " + "".join(f"{w} long, " for w in _PARITIES) + "p0 array<long>" + "".join(f", p{o} array<int>" for o in range(1, orders))
    base = stage(rows.mapInArrow(read, schema))

    indexed = base.select("node", "n", F.explode("p0").alias("token"))
    # the node of a bucket with the least XOR with the token: another one in each bucket
    turned = F.col("node").bitwiseXOR(F.col("token"))
    buckets = indexed.groupBy("token").agg(F.min(turned).alias("lo"), F.max(turned).alias("hi")).where("lo < hi").select(
        "token", F.col("lo").bitwiseXOR(F.col("token")).alias("centre"))
    buckets = stage(buckets)  # a join right on top of an aggregate could not split a hot bucket
    members = stage(indexed.join(buckets, "token").select("token", "node", "n", "centre").distinct())
    nodes = members.select("node").distinct()
    known = base.join(nodes, "node")
    prefixes = stage(known.groupBy("node").agg(F.min(KEY).alias(KEY), *[F.first(c).alias(c) for c in ("n", *_PARITIES, *[f"p{o}" for o in range(1, orders)])]))

    def contents(pairs: DataFrame) -> DataFrame:
        """The texts of the nodes of some pairs."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return stage(rows.select(KEY, "text").join(prefixes.select(KEY, "node").join(nodes, "node"), KEY).select("node", "text"))

    spokes = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    likely = stage(_filtered(spokes, prefixes, percent, orders))
    found = contents(likely)
    # first a few centres of each node, then, where these left components apart, all of its centres
    nearest = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("a", "b"), "b"))), 1, 3)
    few = stage(likely.groupBy("a").agg(nearest.alias("c")).select("a", F.explode("c.b").alias("b")))
    links = stage(_verified(few, found, k, percent))
    labels = stage(components(links))

    def label_of(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}"))

    apart = likely.join(few, ["a", "b"], "left_anti").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left").where(
        F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    links = stage(links.unionByName(_verified(apart, found, k, percent)))
    labels = stage(components(links))
    tested = spokes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    placed = stage(members.join(labels, "node", "left").join(prefixes.select("node", *_PARITIES), "node").select(
        "token", "node", "n", *_PARITIES, F.coalesce("label", "node").alias("label")))
    largest = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(
        F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    mixed = placed.join(largest, "token")
    outer, inner = (rows.select("token", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "label", *_PARITIES)], *more)
                    for x, rows, more in (("a", mixed.where("label <> main"), []), ("b", mixed, ["main"])))
    # a pair of two outer nodes comes up from both sides; it is kept from one
    rest = outer.join(inner, "token").where(F.expr("label_a <> label_b AND (label_b = main OR a < b)") & _fits(percent)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    rest = stage(_filtered(rest, prefixes, percent, orders))
    more = stage(_verified(rest, contents(rest), k, percent)) if not rest.isEmpty() else rest
    if not more.isEmpty():
        labels = stage(components(links.unionByName(more)))

    return base.join(labels, "node", "left").select(KEY, "doc_id", "n", F.coalesce("label", "node").alias("label"))


def similar_texts(docs: DataFrame, k: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A text's set is its distinct shingles of k words (A-Z lower-cased; with fewer words the
    whole sequence; none without words).  Texts link when 100 * intersection >= percent * union.
    ``component_id`` is the least doc_id reachable over links, the row's own without any.

    Texts with one word sequence are one node.  Nodes meet where they share a shingle of their
    prefixes under the first order; a pair is verified on its whole sets only if its prefixes
    also meet under every other order.  These passes keep hot buckets from emitting all their pairs:

    1. every node of a bucket is paired with one centre, chosen by hash; of a node's centres first
       three are tested, then those of other components; links found make components;
    2. in each bucket, nodes outside the bucket's largest component are paired with those of
       other components.  Pairs inside a component need no test, so no link that would join two
       components is missed.

    Null and empty texts have no shingles and stay alone; so do ids that are null, which join no
    component id.  Repeated rows get equal results.
    """
    labelled = _linked(docs, k, percent, orders)
    least = labelled.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **limits: int) -> DataFrame:
    """Exactly one row of ``docs`` per component: that of the least id (a null id is the last), then of the least row key.

    Rows are told apart by id and text: rows that share an id are judged one by one, and of
    rows equal in both one stays.  A text without shingles is alone, so only its equal rows go.
    """
    with released(docs.sparkSession) as keep:  # only the rows that go are read later
        # a label and a row key may be the same number, so "n > 0" is part of the group
        each = stage(_linked(docs, **limits).groupBy(
            KEY, "doc_id", (F.col("n") > 0).alias("some"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col(KEY)).alias("part")
        ).agg(F.count(F.lit(1)).alias("times")))
        kept = each.groupBy("some", "part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", KEY)).alias("least")).select(
            F.col("least")[KEY].alias(KEY), F.col("least")["doc_id"].alias("doc_id"))
        repeated = keep(join_rows(each.where("times > 1"), kept, "left_semi").select(KEY, "doc_id"))
        left = keep(join_rows(each, kept, "left_anti").select(KEY, "doc_id").unionByName(repeated))
    rows = docs.select(row_key("doc_id", "text").alias(KEY), "doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = join_rows(rows, left, "left_anti")
    if not repeated.isEmpty():
        out = out.unionByName(join_rows(rows, repeated, "left_semi").dropDuplicates([KEY, "doc_id"]))
    return out.select("row.*")
