"""Random forests over 0/1 features, grown on every row.

Equal rows stand once with their number.  A tree draws each row Poisson(number) times, by a hash
of row and tree, and a node tries one random feature of each of sqrt(features) ranges for the
largest gain in Gini impurity.  Nodes of more than ``LOCAL`` rows are split level by level over
exact counts from all tasks; the rows of a smaller node go to one task, which grows what lies
below.  The model is a table of such parts, so neither driver nor task holds all of it.
"""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

# executors get these functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCAL = 100_000  # rows of a node that one task takes, at most
DEALT = 10_000_000  # rows times trees dealt out at once, about
COUNTS = 1 << 24  # counts a task holds for the nodes of a pass, at most
_U64 = np.uint64
_CHUNK = 1 << 15  # rows whose features are looked up at once
_SHARE = 1 << 20  # a tree's vote in whole numbers, so that sums do not depend on their order
_PART = "node int, feature binary, below binary, at binary, class binary, n binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    x = np.asarray(x, _U64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U64(shift)
        x *= _U64(factor)
    return x ^ (x >> _U64(31))


def _packed(v: pa.Array) -> pa.Array:
    kind, _, indices, values = v.flatten()
    found = []
    for dense, idx, val in zip(kind.to_numpy(zero_copy_only=False), indices, values):
        val = val.values.to_numpy(zero_copy_only=False)
        set_ = np.flatnonzero(val) if dense else idx.values.to_numpy(zero_copy_only=False)[val != 0]
        found.append(set_.astype(np.uint16).tobytes())
    return pa.array(found, pa.binary())


def packed(column: str = "features") -> Column:
    """The places of a vector that are not zero, in order, two bytes each."""
    return F.arrow_udf(_packed, "binary")(F.col(column))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """A row of ``size`` bits for each list of places."""
    out = np.zeros((len(column), (size + 7) // 8), np.uint8)
    places = np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64)
    rows = np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy(zero_copy_only=False) // 2)
    np.add.at(out.reshape(-1), rows * out.shape[1] + (places >> 3), (1 << (places & 7)).astype(np.uint8))
    return out


def _bit(x: np.ndarray, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
    return (x[rows, feature >> 3] >> (feature & 7).astype(np.uint8)) & 1


def _walk(feature: np.ndarray, below: np.ndarray, x: np.ndarray, start: int) -> np.ndarray:
    """The last node of each row."""
    node, going = np.full(len(x), start), np.arange(len(x))
    while True:
        f = feature[node[going]]
        going, f = going[f >= 0], f[f >= 0]
        if not len(going):
            return node
        node[going] = below[node[going]] + _bit(x, going, f)


def _times(row: np.ndarray, n: np.ndarray, root: int) -> np.ndarray:
    """How often each row is drawn: Poisson(n) from a hash of row and root."""
    u = ((_mix(row.view(_U64) ^ _U64(root)) >> _U64(11)).astype(float) + 0.5) / (1 << 53)
    out = np.zeros(len(u), np.int64)
    for i in np.flatnonzero(n > 500):
        out[i] = max(0, round(n[i] + n[i] ** 0.5 * NormalDist().inv_cdf(min(max(u[i], 1e-15), 1 - 1e-15))))
    left = np.flatnonzero(n <= 500)
    p, k = np.exp(-n[left].astype(float)), 0
    u = u[left]
    total = p.copy()
    while len(left) and k < 2000:
        on = u > total
        left, u, p, total = left[on], u[on], p[on], total[on]
        k += 1
        out[left] = k
        p = p * n[left] / k
        total = total + p
    return out


def _tried(path: np.ndarray, size: int, tries: int) -> np.ndarray:
    """One random feature of each of ``tries`` ranges, a row per node."""
    low = np.arange(tries + 1) * size // tries
    drawn = _mix(path[:, None] + (np.arange(1, tries + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)))
    return low[:-1] + (drawn % np.diff(low).astype(_U64)).astype(np.int64)


def _children(path: np.ndarray) -> np.ndarray:
    return _mix((path[:, None] * _U64(2) + np.arange(1, 3, dtype=_U64)) * _U64(0x9E3779B97F4A7C15))


def _hits(x: np.ndarray, rows: np.ndarray, node: np.ndarray, tried: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``rows``, place in the node's features) of the features that are set."""
    byte, bit = tried >> 3, (1 << (tried & 7)).astype(np.uint8)
    for at in range(0, len(rows), _CHUNK):
        q = node[at:at + _CHUNK]
        i, j = np.nonzero(x[rows[at:at + _CHUNK, None], byte[q]] & bit[q])
        yield i + at, j


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def grow(x: np.ndarray, y: np.ndarray, times: np.ndarray, path: int, depth: int, size: int, tries: int, classes: int) -> dict[str, np.ndarray]:
    """A tree of at most ``depth`` levels: feature (-1 at a leaf) and first child of each node, and the classes of each leaf."""
    feature, below = [np.full(1, -1)], [np.zeros(1, np.int64)]
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids, paths, made = np.zeros(1, np.int64), np.array([path], _U64), 1
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(rows):
        own = node * classes + y[rows]
        cells, n = _sums(own, times[rows].astype(np.int64))
        owner = cells // classes
        total, squares = np.bincount(owner, n, len(ids)), np.bincount(owner, n.astype(float) ** 2, len(ids))
        gain, best = np.full(len(ids), 0.0), np.full(len(ids), -1)
        if depth > 0:
            mixed = np.flatnonzero(squares[node] < total[node] ** 2)  # rows of nodes of several classes
            tried = _tried(paths, size, tries)
            found = [np.stack([(node[mixed[i]] * tries + j) * classes + y[rows[mixed[i]]], times[rows[mixed[i]]]])
                     for i, j in _hits(x, rows[mixed], node[mixed], tried)]
            if sum(f.shape[1] for f in found):
                key, n1 = _sums(*np.concatenate(found, 1))
                slot = key // classes
                first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                slots, at = slot[first], slot[first] // tries
                of_class = n[np.searchsorted(cells, slot // tries * classes + key % classes)]
                one, same, cross = (np.add.reduceat(v, first) for v in (n1.astype(float), n1.astype(float) ** 2, n1.astype(float) * of_class))
                zero = total[at] - one
                rest = squares[at] - 2 * cross + same
                gains = np.where(zero > 0, same / one + rest / np.maximum(zero, 1) - squares[at] / total[at], 0.0)
                gains[gains <= 1e-9 * total[at]] = 0.0
                np.maximum.at(gain, at, gains)
                top = np.flatnonzero((gains > 0) & (gains == gain[at]))[::-1]
                best[at[top]] = tried[at[top], slots[top] % tries]  # the first of equals
        split = best >= 0
        end = ~split[owner]
        leaves.append((ids[owner[end]], cells[end] % classes, n[end]))
        place = np.cumsum(split) - 1
        feature[-1][:] = best
        below[-1][split] = made + 2 * place[split]
        on = split[node]
        rows, node = rows[on], node[on]
        node = 2 * place[node] + _bit(x, rows, best[node])
        many = 2 * int(split.sum())
        ids, paths = made + np.arange(many), _children(paths[split]).reshape(-1)
        made += many
        if many:
            feature.append(np.full(many, -1))
            below.append(np.zeros(many, np.int64))
        depth -= 1
    leaf, class_, n = (np.concatenate(v) for v in zip(*leaves)) if leaves else (np.zeros(0, np.int64),) * 3
    order = np.argsort(leaf, kind="stable")
    at = np.searchsorted(leaf[order], np.arange(made + 1))
    return {"feature": np.concatenate(feature), "below": np.concatenate(below), "at": at, "class": class_[order], "n": n[order]}


def _row(node: int, part: dict[str, np.ndarray]) -> dict:
    return {"node": int(node), **{k: v.astype(np.int32).tobytes() for k, v in part.items()}}


@dataclass
class Top:
    """The nodes that all tasks know, the roots first; one without a feature ends a tree or has its part in the table."""

    size: int
    trees: int
    feature: np.ndarray
    below: np.ndarray


def _deal(batches: Iterator[pa.RecordBatch], top: Top, trees: list[int], roots: np.ndarray | None, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row under the node it comes to in each tree: with ``roots`` as often as drawn, but not under ``ends``."""
    for batch in batches:
        x = _matrix(batch.column("bits"), top.size)
        for t in trees:
            node = _walk(top.feature, top.below, x, t)
            if roots is None:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), batch.column("bits"), batch.column("shape")], ["node", "bits", "shape"])
                continue
            times = _times(batch.column("row").to_numpy(), batch.column("n").to_numpy(), int(roots[t]))
            kept = np.flatnonzero((times > 0) & ~np.isin(node, ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[kept], pa.int32()), batch.column("bits").take(pa.array(kept)), batch.column("label").take(pa.array(kept)), pa.array(times[kept])],
                ["node", "bits", "label", "times"])


def _count(batches: Iterator[pa.RecordBatch], top: Top, roots: np.ndarray, nodes: np.ndarray, tree: np.ndarray, paths: np.ndarray, tries: int, classes: int) -> Iterator[pa.RecordBatch]:
    """For some nodes: drawn rows by class, and by tried feature and class where the feature is set."""
    tried = _tried(paths, top.size, tries)
    place = np.full(len(top.feature), -1)
    place[nodes] = np.arange(len(nodes))
    own, hit = np.zeros(len(nodes) * classes, np.int64), np.zeros(len(nodes) * tries * classes, np.int64)
    for batch in batches:
        x, y = _matrix(batch.column("bits"), top.size), batch.column("label").to_numpy()
        row, n = batch.column("row").to_numpy(), batch.column("n").to_numpy()
        for t in np.unique(tree):
            times = _times(row, n, int(roots[t]))
            at = place[_walk(top.feature, top.below, x, t)]
            rows = np.flatnonzero((at >= 0) & (times > 0))
            at = at[rows]
            np.add.at(own, at * classes + y[rows], times[rows])
            for i, j in _hits(x, rows, at, tried):
                np.add.at(hit, (at[i] * tries + j) * classes + y[rows[i]], times[rows[i]])
    own, hit = own.reshape(len(nodes), -1), hit.reshape(len(nodes), -1)
    for i in np.flatnonzero(own.any(1)):
        yield pa.RecordBatch.from_pydict({"node": pa.array([nodes[i]], pa.int32()), "own": pa.array([own[i].tobytes()]), "hit": pa.array([hit[i].tobytes()])})


def _chooser(paths: np.ndarray, spot: dict[int, int], size: int, tries: int, classes: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """From the counts of a node: the feature of most gain, or -1, the rows on both sides and the node's classes."""
    def best(key, counts):
        node = key[0].as_py()
        own, hit = (sum(np.frombuffer(v.as_py(), np.int64) for v in counts.column(c)) for c in ("own", "hit"))
        one = hit.reshape(-1, classes).astype(float)
        zero = own - one
        n1, n0, n = one.sum(1), zero.sum(1), own.sum()
        gains = np.where(
            (n1 > 0) & (n0 > 0), (one ** 2).sum(1) / np.maximum(n1, 1) + (zero ** 2).sum(1) / np.maximum(n0, 1) - (own.astype(float) ** 2).sum() / n, 0.0)
        first = int(gains.argmax())
        feature = int(_tried(paths[spot[node]:spot[node] + 1], size, tries)[0][first]) if gains[first] > 1e-9 * n else -1
        return pa.table({
            "node": pa.array([node], pa.int32()), "feature": pa.array([feature], pa.int32()),
            "zero": pa.array([int(n0[first])]), "one": pa.array([int(n1[first])]), "own": pa.array([own.tobytes()])})
    return best


class Forest(Estimator):
    """Learns ``label`` (whole numbers from 0) from ``features`` (vectors of ``size`` zeros and ones)."""

    def __init__(self, size: int, trees: int, depth: int, seed: int):
        super().__init__()
        if size > 1 << 16:
            raise ValueError("a place takes two bytes")
        self.size, self.trees, self.depth, self.seed = size, trees, depth, seed

    def _fit(self, df: DataFrame) -> ForestModel:
        rows = df.select(packed().alias("bits"), F.col("label").cast("int").alias("label")).groupBy("bits", "label").agg(F.count(F.lit(1)).alias("n"))
        rows = stage(rows.withColumn("row", F.xxhash64("bits", "label")))
        found = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.max("label").alias("label")).first()
        size, depth, trees = self.size, self.depth, self.trees
        classes, tries = (found["label"] or 0) + 1, int(np.ceil(size ** 0.5))
        roots = _mix(np.arange(1, trees + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(self.seed))
        feature, below, paths, level, tree = [-1] * trees, [0] * trees, list(_mix(roots)), [0] * trees, list(range(trees))
        ends: list[dict] = []
        open_ = list(range(trees)) if (found["n"] or 0) > LOCAL else []
        while open_:
            top, later = Top(size, trees, np.array(feature), np.array(below)), []
            step = max(1, COUNTS // (tries * classes))
            for at in range(0, len(open_), step):
                nodes = np.array(open_[at:at + step])
                own = np.array([paths[i] for i in nodes], _U64)
                spot = {int(i): k for k, i in enumerate(nodes)}
                counted = rows.mapInArrow(
                    partial(_count, top=top, roots=roots, nodes=nodes, tree=np.array([tree[i] for i in nodes]), paths=own, tries=tries, classes=classes),
                    "node int, own binary, hit binary")
                best = counted.groupBy("node").applyInArrow(_chooser(own, spot, size, tries, classes), "node int, feature int, zero long, one long, own binary").collect()
                for r in sorted(best, key=lambda r: r["node"]):
                    i = r["node"]
                    if r["feature"] < 0 or level[i] >= depth:
                        n = np.frombuffer(r["own"], np.int64)
                        ends.append(_row(i, {"feature": np.full(1, -1), "below": np.zeros(1), "at": np.array([0, (n > 0).sum()]), "class": np.flatnonzero(n), "n": n[n > 0]}))
                        continue
                    feature[i], below[i] = r["feature"], len(feature)
                    for many, path in zip((r["zero"], r["one"]), _children(np.array([paths[i]], _U64))[0]):
                        if many > LOCAL:
                            later.append(len(feature))
                        feature.append(-1)
                        below.append(0)
                        paths.append(path)
                        level.append(level[i] + 1)
                        tree.append(tree[i])
            open_ = later
        top = Top(size, trees, np.array(feature), np.array(below))

        def grown(key: tuple, group: pa.Table) -> pa.Table:
            i = key[0].as_py()
            x = _matrix(group.column("bits").combine_chunks(), size)
            part = grow(x, group.column("label").to_numpy(), group.column("times").to_numpy(), int(paths[i]), depth - level[i], size, tries, classes)
            return pa.Table.from_pylist([_row(i, part)], _schema())

        parts = [df.sparkSession.createDataFrame([tuple(r.values()) for r in ends], _PART)] if ends else []
        for some in _rounds(trees, found["rows"]):
            dealt = rows.mapInArrow(
                partial(_deal, top=top, trees=some, roots=roots, ends=np.array([r["node"] for r in ends], np.int64)), "node int, bits binary, label int, times long")
            parts.append(stage(dealt.repartition(_tasks(rows, found["rows"] * len(some)), "node").groupBy("node").applyInArrow(grown, _PART)))
        model = parts[0]
        for p in parts[1:]:
            model = model.unionByName(p)
        return ForestModel(top, stage(model) if len(parts) > 1 else model)


def _schema() -> pa.Schema:
    return pa.schema([("node", pa.int32()), *[(c, pa.binary()) for c in ("feature", "below", "at", "class", "n")]])


def _rounds(trees: int, rows: int) -> list[list[int]]:
    step = max(1, min(trees, DEALT // max(rows, 1)))
    return [list(range(at, min(at + step, trees))) for at in range(0, trees, step)]


def _tasks(df: DataFrame, dealt: int) -> int:
    """Groups are as large as nodes allow, so their tasks must not be joined by size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt // 20_000)


class ForestModel(Model, MLWritable, MLReadable):
    """Adds ``prediction``: the class of most votes, each tree's vote shared by the classes of the leaf; the least of equals."""

    def __init__(self, top: Top, parts: DataFrame):
        super().__init__()
        self.top, self.parts = top, parts

    def _transform(self, df: DataFrame) -> DataFrame:
        top, votes = self.top, None
        shapes = stage(df.select(packed().alias("bits")).distinct().withColumn("shape", F.monotonically_increasing_id()))
        many = shapes.count()

        def vote(key: tuple, rows: pa.Table, part: pa.Table) -> pa.Table:
            if not part.num_rows or not rows.num_rows:
                return pa.table({"shape": pa.array([], pa.int64()), "class": pa.array([], pa.int32()), "share": pa.array([], pa.int64())})
            feature, below, at, class_, n = (np.frombuffer(part.column(c)[0].as_py(), np.int32) for c in ("feature", "below", "at", "class", "n"))
            leaf = _walk(feature, below, _matrix(rows.column("bits").combine_chunks(), top.size), 0)
            sizes = at[leaf + 1] - at[leaf]
            entry = np.repeat(at[leaf] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            whole = np.add.reduceat(n[entry].astype(float), np.cumsum(sizes) - sizes)
            return pa.table({
                "shape": np.repeat(rows.column("shape").to_numpy(), sizes), "class": class_[entry],
                "share": np.rint(n[entry] / np.repeat(whole, sizes) * _SHARE).astype(np.int64)})

        for some in _rounds(top.trees, many):
            dealt = shapes.mapInArrow(partial(_deal, top=top, trees=some, roots=None, ends=np.zeros(0, np.int64)), "node int, bits binary, shape long")
            tasks = _tasks(df, many * len(some))
            found = dealt.repartition(tasks, "node").groupBy("node").cogroup(self.parts.repartition(tasks, "node").groupBy("node")).applyInArrow(
                vote, "shape long, class int, share long")
            found = stage(found.groupBy("shape", "class").agg(F.sum("share").alias("share")))
            votes = found if votes is None else votes.unionByName(found)
        most = votes.groupBy("shape", "class").agg(F.sum("share").alias("share")).groupBy("shape").agg(F.max(F.struct("share", (-F.col("class")).alias("less"))).alias("x"))
        named = shapes.join(most.select("shape", (-F.col("x.less")).cast("double").alias("prediction")), "shape").select(F.col("bits").alias("_bits"), "prediction")
        return df.withColumn("_bits", packed()).join(named, "_bits", "left").drop("_bits")

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader()


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        top = self.instance.top
        extra = {"size": top.size, "trees": top.trees, "feature": top.feature.tolist(), "below": top.below.tolist()}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"top": extra})
        self.instance.parts.write.parquet(f"{path}/parts")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        top = found["top"]
        model = ForestModel(
            Top(top["size"], top["trees"], np.array(top["feature"]), np.array(top["below"])), self.sparkSession.read.schema(_PART).parquet(f"{path}/parts"))
        model._resetUid(found["uid"])
        return model
