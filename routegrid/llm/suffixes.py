"""Removal of long strings that occur more than once, by distributed sorting of suffixes."""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import released, stage
from .frames import KEY, batch_of, id_type, row_key, texts
from .hashing import U64, mix, randoms, signed, slices, text_buffer, window_min

_CHUNK = 1 << 17  # windows hashed at once
_RANGE = 100_000  # windows sorted together, about
_PLACE_BITS = 20  # place of a k-gram within a chunk
_STEP = U64(0x9E3779B97F4A7C15)
_BYTE = randoms(256, 1 << 23)


class _Rolling:
    """Hashes of any substrings of a chunk from prefix sums; powers are shared by all chunks."""

    up = down = np.zeros(0, U64)

    def __init__(self, data: np.ndarray):
        if len(_Rolling.up) <= len(data):
            size = max(len(data) + 1, _CHUNK + 4096)
            _Rolling.up = np.multiply.accumulate(np.full(size, _STEP))
            _Rolling.down = np.multiply.accumulate(np.full(size, U64(pow(int(_STEP), -1, 1 << 64))))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * self.up[:len(data)], out=self.sums[1:])

    def fixed(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def _anchored(buf: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """The windows of ``length`` bytes of each text, in runs that share their anchor.

    The anchor of a window is its k-gram of least hash, the leftmost of equals; equal windows
    have equal anchors at equal places.  Returns per run: text, first window (in the text),
    number of windows, hash of the anchor, hash of the run's bytes, place of the anchor after
    the first window.
    """
    out: list[tuple[np.ndarray, ...]] = []
    width = length - k + 1
    place = U64((1 << _PLACE_BITS) - 1)
    for at in range(0, max(len(buf) - length + 1, 0), _CHUNK):
        data = buf[at:at + _CHUNK + length - 1]
        rolling = _Rolling(data)
        grams = rolling.fixed(k)
        grams = grams ^ (grams >> U64(29))
        grams *= U64(0xBF58476D1CE4E5B9)
        ranked = (grams & ~place) | np.arange(len(grams), dtype=U64)
        anchor = (window_min(ranked, width) & place).astype(np.int64)
        first = int(np.searchsorted(offs, at, "right")) - 1
        last = int(np.searchsorted(offs, at + len(anchor)))
        starts = np.maximum(offs[first:last] - at, 0)
        counts = np.maximum(np.minimum(offs[first + 1:last + 1] - at - length + 1, len(anchor)) - starts, 0)
        if not counts.sum():
            continue
        owner = np.repeat(np.arange(first, last), counts)
        spot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        mine = anchor[spot]
        new = np.ones(len(spot), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(spot)))
        p = spot[begin]
        out.append((
            owner[begin], p + at - offs[owner[begin]], many, mix(grams[mine[begin]]),
            rolling.between(p, p + many + length - 1), mine[begin] - p,
        ))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64), none
    return tuple(np.concatenate(x) for x in zip(*out))


# Front-coded runs -----------------------------------------------------------------------------

def front_code(strings: list[bytes], width: int) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Sorted strings of one width as common-prefix lengths and the rest of each.

    Equal strings become one entry; the third result is the entry of each string.
    """
    table = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), width)
    lcp = np.zeros(len(strings), np.int64)
    for at in range(1, len(strings), 1 << 14):
        end = min(len(strings), at + (1 << 14))
        differs = table[at:end] != table[at - 1:end - 1]
        lcp[at:end] = np.where(differs.any(1), differs.argmax(1), width)
    kept = lcp < width
    kept[:1] = True
    lcp, entry = lcp[kept], np.cumsum(kept) - 1
    rest = table[kept][np.arange(width) >= lcp[:, None]].tobytes()
    return lcp.astype(np.uint16), rest, entry


class _Run:
    """Reader of a front-coded run: the current string and its common prefix with the one before."""

    __slots__ = ("lcps", "rest", "width", "at", "read", "string", "lcp")

    def __init__(self, lcps: list[int], rest: bytes, width: int):
        self.lcps, self.rest, self.width = lcps, rest, width
        self.at, self.read, self.lcp = -1, 0, 0
        self.string: bytes | None = b""
        self.advance()

    def advance(self) -> None:
        self.at += 1
        if self.at == len(self.lcps):
            self.string = None
            return
        self.lcp = self.lcps[self.at]
        end = self.read + self.width - self.lcp
        self.string = self.string[:self.lcp] + self.rest[self.read:end]
        self.read = end


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one width, of which ``known`` bytes are equal."""
    step = 16
    n = len(a)
    while known < n and a[known:known + step] == b[known:known + step]:
        known += step
        step *= 2
    if known >= n:
        return n
    while a[known] == b[known]:
        known += 1
        if known == n:
            return n
    return known


def merge_runs(runs: list[_Run]) -> Iterator[tuple[int, int, int]]:
    """(run, entry, common prefix with the string before) in the order of all strings.

    A loser tree over the runs' heads.  Each head carries its common prefix with the last
    string that came out; of two heads the one with the longer prefix is the smaller, and only
    with equal prefixes are bytes compared, from there on.
    """
    k = len(runs)
    losers = [-1] * k
    prefix = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two heads; the loser's prefix becomes that with the winner."""
        x, y = runs[a].string, runs[b].string
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        common = _common(x, y, p)
        if common == len(x):
            a, b = min(a, b), max(a, b)
        elif x[common] > y[common]:
            a, b = b, a
        prefix[b] = common
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    last = 0
    while runs[winner].string is not None:
        run = runs[winner]
        yield winner, run.at, last
        run.advance()
        prefix[winner] = run.lcp
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
        last = prefix[winner]


# The job --------------------------------------------------------------------------------------

def _scan(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 2 << 20):
        owner, start, many, anchor, content, place = _anchored(*text_buffer(part.column("text")), length, k)
        yield batch_of({
            KEY: part.column(KEY).take(pa.array(owner)), "anchor": signed(anchor), "content": signed(content),
            "start": start.astype(np.int32), "many": many.astype(np.int32), "place": place.astype(np.int32),
        })


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each listed run of windows."""
    for part in slices(batches, "text", 1 << 20):
        out: dict[str, list] = {c: [] for c in (KEY, "anchor", "start", "many", "place", "alone", "bytes")}
        for key, text, listed in zip(*(part.column(c).to_pylist() for c in (KEY, "text", "listed"))):
            data = text.encode()
            for x in listed:
                out[KEY].append(key)
                out["bytes"].append(data[x["start"]:x["start"] + x["many"] - 1 + length])
                for c in ("anchor", "start", "many", "place", "alone"):
                    out[c].append(x[c])
        yield pa.RecordBatch.from_pydict(out, pa.schema([
            (KEY, pa.int64()), ("anchor", pa.int64()), ("start", pa.int32()), ("many", pa.int32()), ("place", pa.int32()),
            ("alone", pa.bool_()), ("bytes", pa.binary())]))


def _strings(anchor: int, data: bytes, many: int, place: int, length: int, k: int) -> list[bytes]:
    """What tells the run's windows from others: anchor, its place in the window, the bytes around it.

    The k bytes of the anchor itself are left out; its hash stands for them.
    """
    head = (anchor & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
    after = place + k
    return [head + (place - j).to_bytes(4, "big") + data[j:place] + data[after:j + length] for j in range(many)]


def _sorted_runs(batches: Iterator[pa.RecordBatch], length: int, k: int, splits: dict[int, list[bytes]], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of at most about ``most`` windows, cut where the bucket changes and at its splitters.

    Buckets follow the order of the strings.
    """
    from pyspark import TaskContext

    width, number = length - k + 12, 0
    strings: list[bytes] = []
    keys: list[int] = []
    starts: list[int] = []
    spots: list[int] = []
    alone: list[bool] = []
    buckets: list[int] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        order = sorted(range(len(strings)), key=strings.__getitem__)
        ranked, at = [strings[i] for i in order], np.array(buckets)[order]
        pieces = []
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(ranked)]
        for low, high in zip(edges, edges[1:]):
            cuts = [low, *[bisect_left(ranked, x, low, high) for x in splits.get(int(at[low]), ())], high]
            pieces += [(int(at[low]) << 31 | sub, a, b) for sub, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        for part, a, b in pieces:
            lcp, rest, entry = front_code(ranked[a:b], width)
            own = np.array(order[a:b])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "run": pa.array([TaskContext.get().partitionId() << 24 | number], pa.int64()),
                "lcps": pa.array([lcp.tobytes()], pa.binary()), "rest": pa.array([rest], pa.binary()),
                "entry": pa.array([entry.astype(np.int32).tobytes()], pa.binary()),
                "keys": pa.array([np.array(keys, np.int64)[own].tobytes()], pa.binary()),
                "starts": pa.array([np.array(starts, np.int32)[own].tobytes()], pa.binary()),
                "spots": pa.array([np.array(spots, np.int32)[own].tobytes()], pa.binary()),
                "alone": pa.array([np.array(alone, bool)[own].tobytes()], pa.binary()),
            })
        number += 1
        for x in (strings, keys, starts, spots, alone, buckets):
            x.clear()

    for batch in batches:
        for row in batch.to_pylist():
            found = _strings(row["anchor"], row["bytes"], row["many"], row["place"], length, k)
            strings += found
            keys += [row[KEY]] * len(found)
            starts += [row["start"]] * len(found)
            spots += range(row["start"], row["start"] + len(found))
            alone += [row["alone"]] * len(found)
            buckets += [row["bucket"]] * len(found)
            if len(strings) >= most:
                yield from flush()
    if strings:
        yield from flush()


def _merged(group: pa.Table, width: int) -> pa.Table:
    """For each run of a range, which of its entries equal one of another run."""
    numbers = group.column("run").to_pylist()
    runs = [_Run(np.frombuffer(a, np.uint16).tolist(), b, width) for a, b in zip(group.column("lcps").to_pylist(), group.column("rest").to_pylist())]
    marks = [bytearray(len(r.lcps)) for r in runs]
    before = (0, 0)
    for run, entry, common in merge_runs(runs):
        if common == width:
            marks[run][entry] = 1
            marks[before[0]][before[1]] = 1
        before = run, entry
    return pa.table({
        "part": group.column("part"), "run": pa.array(numbers, pa.int64()),
        "again": pa.array([bytes(m) for m in marks], pa.binary()),
    })


def _edges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes covered by repeated windows of runs that are not repeated as a whole."""
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            entry = np.frombuffer(row["entry"], np.int32)
            again = np.frombuffer(row["again"], np.uint8).astype(bool) | (np.bincount(entry) > 1)
            hit = again[entry] & np.frombuffer(row["alone"], bool)
            found = np.stack([np.frombuffer(row["keys"], np.int64)[hit], np.frombuffer(row["starts"], np.int32)[hit], np.frombuffer(row["spots"], np.int32)[hit]])
            found = found[:, np.lexsort(found[::-1])]
            new = np.ones(found.shape[1] + 1, bool)
            new[1:-1] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
            at = np.flatnonzero(new)
            yield batch_of({
                KEY: found[0, at[:-1]], "start": found[2, at[:-1]].astype(np.int32),
                "end": (found[2, at[1:] - 1] + length).astype(np.int32),
            })


def _repeated(docs: DataFrame, length: int) -> DataFrame:
    """(_row_key, start, end): the bytes of each text covered by a string of ``length`` bytes that occurs again.

    1. Every window of ``length`` bytes has an anchor, its k-gram (k four fifths of the length) of
       least hash.  Only windows whose anchor occurs at two places can be repeated.
    2. Runs of windows with one anchor whose whole bytes occur twice are repeated as they are.
    3. The windows of the other runs, and one example of each repeated run of the same anchor, are
       sorted: dealt out by ranges of the anchor's hash, so that a run is cut into few pieces
       however many runs there are, they make front-coded sorted runs, which are exchanged and
       combined by loser trees that compare no known prefix twice.  A common prefix of full
       width is a repeat.

    An anchor or run shared by very many texts is counted with map-side aggregates, joined with
    Spark's splitting of skewed partitions, and sorted as one entry per sorted run.
    Texts without a repeat have no row.  Rows are told apart by the hash of id and text.
    """
    k = length * 4 // 5
    rows = texts(docs).select(KEY, "text")
    runs = rows.mapInArrow(lambda b: _scan(b, length, k), f"{KEY} long, anchor long, content long, start int, many int, place int")
    # written first: a join right on top of an aggregate could not split a hot anchor
    common = stage(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    shared = stage(runs.join(common, "anchor"))
    kinds = stage(shared.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(KEY, "start", "many", "place")).alias("one")))
    whole = shared.join(kinds.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select(
        KEY, "start", (F.col("start") + F.col("many") + F.lit(length - 1)).alias("end"))

    open_ = stage(kinds.where("n = 1").select("anchor").distinct())
    listed = kinds.join(open_, "anchor").select("anchor", (F.col("n") == 1).alias("alone"), "one.*")
    listed = listed.groupBy(KEY).agg(F.collect_list(F.struct("anchor", "start", "many", "place", "alone")).alias("listed"))
    contexts = stage(rows.join(listed, KEY).mapInArrow(
        lambda b: _contexts(b, length), f"{KEY} long, anchor long, start int, many int, place int, alone boolean, bytes binary"))

    # equal windows have equal anchors: a task sorts the windows of few of the buckets that the anchors' hashes fall into
    windows = contexts.agg(F.sum("many")).first()[0] or 0
    many = 1 + windows // _RANGE
    bucketed = contexts.withColumn("bucket", F.expr(f"CAST(shiftright(shiftrightunsigned(anchor, 34) * {many}L, 30) AS INT)"))
    hot = {r["bucket"]: r for r in bucketed.groupBy("bucket").agg(F.sum("many").alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("n") > 4 * _RANGE).collect()}
    ranges = {x: 1 + r["n"] // _RANGE for x, r in hot.items()}
    width = length - k + 12
    # a bucket of an anchor in very many texts is dealt to several tasks and cut at splitters,
    # from a sample of bounded size: one window of about 50 contexts per range
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                strings = _strings(row["anchor"], row["bytes"], row["many"], row["place"], length, k)
                found.append(strings[row["start"] % len(strings)])
            yield pa.RecordBatch.from_pydict({"bucket": batch.column("bucket"), "string": pa.array(found, pa.binary())})

    def of_hot(values: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("bucket")], F.lit(0)) if values else F.lit(0)

    drawn = F.xxhash64(KEY, "start")
    picked: dict[int, list[bytes]] = {x: [] for x in hot}
    if hot:
        for r in bucketed.where(F.pmod(drawn, F.greatest(of_hot({x: r["rows"] for x, r in hot.items()}), F.lit(1))) < 50 * of_hot(ranges)).mapInArrow(
                some, "bucket int, string binary").collect():
            picked[r["bucket"]].append(bytes(r["string"]))
    splits = {x: [found[len(found) * i // ranges[x]] for i in range(1, ranges[x])] for x, found in ((x, sorted(f)) for x, f in picked.items()) if found}
    dealt = bucketed.repartition(2 * many, "bucket", F.pmod(drawn, F.greatest(of_hot(ranges), F.lit(1))))

    coded = stage(dealt.mapInArrow(
        lambda b: _sorted_runs(b, length, k, splits, 50_000),
        "part long, run long, lcps binary, rest binary, entry binary, keys binary, starts binary, spots binary, alone binary"))
    merged = coded.select("part", "run", "lcps", "rest").groupBy("part").applyInArrow(lambda t: _merged(t, width), "part long, run long, again binary")
    parts = coded.drop("lcps", "rest").join(merged, ["part", "run"]).mapInArrow(lambda b: _edges(b, length), f"{KEY} long, start int, end int")
    return whole.unionByName(parts)


def repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(_row_key, spans): what ``_repeated`` finds, as one list a text; its own tables are gone."""
    with released(docs.sparkSession) as keep:
        found = keep(_repeated(docs, length))
    return found.groupBy(KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _cut(text: str | None, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes outside the spans, and how many bytes and maximal runs are inside."""
    data = (text or "").encode()
    kept, at, removed, runs = [], 0, 0, 0
    for start, end in sorted((s["start"], s["end"]) for s in (() if spans is None else spans)):
        if start > at or not runs:
            kept.append(data[at:start])
            runs += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def removal(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): each text without its repeated bytes.

    Strings are judged on the input: of a string that occurs again every occurrence goes, within
    one text too.  A null or empty text has no bytes.  Repeated rows repeat each other; texts
    shorter than ``length`` bytes stay whole.  Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            found = [_cut(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
            kept = [x[0] for x in found]
            yield batch_of({
                "doc_id": part.column("doc_id"), "n_bytes": pa.array([len(a) + n for a, n, _ in found], pa.int64()),
                "n_removed": pa.array([n for _, n, _ in found], pa.int64()), "n_spans": pa.array([r for _, _, r in found], pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            })

    return texts(docs).join(repeats(docs, length), KEY, "left").select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes taken out of ``text`` (and ``n_chars`` to match, if there is one).

    What is left of a character that was cut in its middle goes too.  Null texts stay null.
    """
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else _cut(t, s)[0].decode("utf-8", "ignore") for t, s in zip(text, spans)], dtype=object)

    spans = repeats(docs, length)
    rows = docs.select(row_key("doc_id", "text").alias(KEY), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = rows.join(spans, KEY, "left").select("row", "spans", cut(F.col("row").getField("text"), F.col("spans")).alias("left"))
    hit = F.col("spans").isNotNull()
    fresh = {c: F.col("row").getField(c) for c in docs.columns}
    fresh["text"] = F.when(hit, F.col("left")).otherwise(fresh["text"])
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(hit, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(fresh["n_chars"])
    return out.select(*[column.alias(c) for c, column in fresh.items()])
