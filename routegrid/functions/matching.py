"""Substructure test of one (target, query) pair of graphs, run inside Arrow batches."""
from __future__ import annotations

import sys
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get the code with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _links(flat) -> dict[int, dict[int, str]]:
    near: dict[int, dict[int, str]] = {}
    for text in flat:
        a, b, kind = text.split(" ")
        near.setdefault(int(a), {})[int(b)] = kind
    return near


def _rarest_first(kinds: dict[int, str], near: dict[int, dict[int, str]], count: Counter) -> list[tuple[int, str]]:
    order: list[tuple[int, str]] = []
    rest, beside = set(kinds), set()
    while rest:
        n = min(beside or rest, key=lambda n: (count[kinds[n]], n))
        order.append((n, kinds[n]))
        rest.discard(n)
        beside = (beside | set(near.get(n, ()))) & rest
    return order


def embeds(target_atoms, target_bonds, query_atoms, query_bonds) -> bool:
    """Whether every query atom maps to its own target atom with equal bonds in between.

    Atoms are texts ``number kind``.  Of each fragment the query atom whose kind is rarest in the
    target is placed first, then always the rarest one next to those placed.
    """
    t_near, q_near = _links(target_bonds), _links(query_bonds)
    t_kind = {int(n): k for n, k in (t.split(" ") for t in target_atoms)}
    q_kind_of = {int(n): k for n, k in (t.split(" ") for t in query_atoms)}
    if len(q_kind_of) > len(t_kind):
        return False
    order = _rarest_first(q_kind_of, q_near, Counter(t_kind.values()))
    placed: dict[int, int] = {}
    used: set[int] = set()

    def options(q):
        early = [(placed[p], kind) for p, kind in q_near.get(q, {}).items() if p in placed]
        if not early:
            return iter(t_kind), early
        return iter(t_near.get(early[0][0], {})), early

    def fits(q_kind, t, early):
        if t in used or t_kind[t] != q_kind:
            return False
        near = t_near.get(t, {})
        return all(near.get(p) == kind for p, kind in early)

    stack = []
    k = 0
    while k < len(order):
        q, q_kind = order[k]
        if len(stack) == k:
            stack.append(options(q))
        pool, early = stack[k]
        t = next((t for t in pool if fits(q_kind, t, early)), None)
        if t is None:
            stack.pop()
            if not stack:
                return False
            k -= 1
            used.discard(placed.pop(order[k][0]))
            continue
        placed[q] = t
        used.add(t)
        k += 1
    return True


def _per_batch(ta: pd.Series, tb: pd.Series, qa: pd.Series, qb: pd.Series) -> pd.Series:
    return pd.Series([row[0] is not None and embeds(*row) for row in zip(ta, tb, qa, qb)], dtype=bool)


def embeds_udf(*cols: str) -> Column:
    """Non-deterministic mark: keeps the call out of later lambdas and filters."""
    return F.pandas_udf(_per_batch, T.BooleanType()).asNondeterministic()(*[F.col(c) for c in cols])
