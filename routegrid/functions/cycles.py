"""Ring members of one molecule: the only step that leaves the JVM."""
from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get the code with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ring_core(pairs: list[tuple[int, int]]) -> dict[int, set[int]]:
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    loose = [v for v in near if len(near[v]) < 2]
    while loose:
        v = loose.pop()
        for u in near.pop(v, ()):
            near[u].discard(v)
            if len(near[u]) == 1:
                loose.append(u)
    return near


def _systems(near: dict[int, set[int]]):
    """Connected parts of the ring core: each a set of atoms."""
    left = set(near)
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            for u in near[todo.pop()]:
                if u not in part:
                    part.add(u)
                    todo.append(u)
        left -= part
        yield part


def _walk(near: dict[int, set[int]], part: set[int]) -> list[int]:
    """Atoms of a part that is one plain ring."""
    start = min(part)
    ring, last, at = [start], start, min(near[start])
    while at != start:
        ring.append(at)
        at, last = next(u for u in near[at] if u != last), at
    return ring


def _candidates(near: dict[int, set[int]], part: set[int], edges: list[tuple[int, int]]):
    """Shortest cycles through a vertex and an edge of one part."""
    for root in part:
        back: dict[int, int | None] = {root: None}
        queue = [root]
        for v in queue:
            for u in sorted(near[v]):
                if u not in back:
                    back[u] = v
                    queue.append(u)

        def trail(v):
            out = []
            while v is not None:
                out.append(v)
                v = back[v]
            return out

        trails = {v: trail(v) for v in part}
        for a, b in edges:
            if back[a] != b and back[b] != a:
                left, right = trails[a], trails[b]
                if len(set(left) & set(right)) == 1:
                    yield left[::-1] + right[:-1]


def minimum_cycles(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Minimum cycle basis of one molecule, each cycle as atoms in ring order.

    Every connected part of the ring core is solved on its own: a part with as many bonds as
    atoms is one ring; otherwise candidate cycles are taken shortest first while independent
    over GF(2).  A cycle starts at its lowest atom and runs towards the lower of that atom's
    two ring neighbours; rings are listed by size, then atoms.
    """
    near = _ring_core(pairs)
    out = []
    for part in _systems(near):
        edges = sorted((a, b) for a in part for b in near[a] if a < b)
        if len(edges) == len(part):
            out.append(_walk(near, part))
            continue
        bit = {e: 1 << i for i, e in enumerate(edges)}
        found = {(len(r), tuple(sorted(r))): r for r in _candidates(near, part, edges)}
        basis: dict[int, int] = {}
        for key in sorted(found):
            ring = found[key]
            vec = 0
            for a, b in zip(ring, ring[1:] + ring[:1]):
                vec ^= bit[(a, b) if a < b else (b, a)]
            while vec and vec.bit_length() in basis:
                vec ^= basis[vec.bit_length()]
            if vec:
                basis[vec.bit_length()] = vec
                at = ring.index(min(ring))
                turned = ring[at:] + ring[:at]
                out.append(turned if turned[1] < turned[-1] else turned[:1] + turned[:0:-1])
            if len(basis) == len(edges) - len(part) + 1:
                break
    return sorted(out, key=lambda r: (len(r), sorted(r)))


def _per_batch(flat: pd.Series) -> pd.Series:
    def one(ends):
        if ends is None:
            return []
        return minimum_cycles([(int(a), int(b)) for a, b in zip(ends[::2], ends[1::2])])

    return flat.map(one)


def ring_lists(flat: Column) -> Column:
    """Rings of a flattened bond list [a0, b0, a1, b1, ...].

    Marked non-deterministic only so that Catalyst never inlines the call into a later
    lambda, where a Python function cannot run.
    """
    kind = T.ArrayType(T.ArrayType(T.IntegerType()))
    return F.pandas_udf(_per_batch, kind).asNondeterministic()(flat)
