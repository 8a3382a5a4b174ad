"""Ring basis against brute force: all simple cycles, shortest first, kept while independent."""
import itertools
import random

from hypothesis import given, settings, strategies as st

from routegrid.functions.cycles import minimum_cycles
from routegrid.functions.matching import embeds


def all_cycles(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []

    def walk(path):
        for n in near[path[-1]]:
            if n == path[0] and len(path) > 2 and path[1] < path[-1]:
                out.append(list(path))
            elif n > path[0] and n not in path:
                walk(path + [n])

    for v in near:
        walk([v])
    return out


def basis_sizes(edges):
    edges = [tuple(sorted(e)) for e in edges]
    span = [frozenset()]
    sizes = []
    for c in sorted(all_cycles(edges), key=len):
        mask = frozenset(tuple(sorted(e)) for e in zip(c, c[1:] + c[:1]))
        if mask not in span:
            span += [s ^ mask for s in span]
            sizes.append(len(c))
    return sizes


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 8), st.integers(0, 4), st.randoms(use_true_random=False))
def test_sizes_match_brute_force(n, extra, rnd):
    edges = {(rnd.randrange(i), i) for i in range(1, n)}
    free = [e for e in itertools.combinations(range(n), 2) if e not in edges]
    edges |= set(rnd.sample(free, min(extra, len(free))))
    rings = minimum_cycles(sorted(edges))
    assert sorted(map(len, rings)) == sorted(basis_sizes(edges))
    for r in rings:
        assert all(tuple(sorted(e)) in edges for e in zip(r, r[1:] + r[:1]))


def brute_embeds(n_t, t_edges, n_q, q_edges):
    for m in itertools.permutations(range(n_t), n_q):
        if all(tuple(sorted((m[a], m[b]))) in t_edges for a, b in q_edges):
            return True
    return False


def test_matching_against_permutations():
    rnd = random.Random(7)
    for _ in range(150):
        n_t, n_q = rnd.randint(2, 6), rnd.randint(1, 4)
        t = {e for e in itertools.combinations(range(n_t), 2) if rnd.random() < 0.5}
        q = {(rnd.randrange(i), i) for i in range(1, n_q)}

        def form(n, edges):
            return [f"{i} C0" for i in range(n)], [f"{a} {b} 1" for x, y in edges for a, b in ((x, y), (y, x))]

        ta, tb = form(n_t, t)
        qa, qb = form(n_q, q)
        assert embeds(ta, tb, qa, qb) == (n_q <= n_t and brute_embeds(n_t, t, n_q, q))
