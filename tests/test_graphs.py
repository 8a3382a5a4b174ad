"""Cycles, components and shared expansion against plain recursion."""
import random

from routegrid.operators import routes as G
from routegrid.plans import graphs


def random_edges(rng, nodes, edges):
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})


def reach(edges):
    out = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for u, v in edges:
                if u == todo[-1] and v not in seen:
                    seen.add(v)
                    todo.insert(0, v)
            todo.pop()
        out[a] = seen
    return out


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for nodes, many in ((12, 14),):
        edges = random_edges(rng, nodes, many)
        far = reach(edges)
        want = {frozenset(b for b in far if b in far[a] and a in far[b]) for a in far if a in far[a]}
        table = spark.createDataFrame(edges, "src bigint, dst bigint")
        groups = {}
        for r in graphs.strong_components(table).collect():
            groups.setdefault(r["label"], set()).add(r["node"])
        assert {frozenset(g) for g in groups.values()} == want
        walkers = {r["node"] for r in graphs.long_walkers(table).collect()}
        assert {n for g in want for n in g} <= walkers
    chain = spark.range(200).selectExpr("id src", "id + 1 dst")
    assert graphs.long_walkers(chain).count() == 0 and graphs.strong_components(chain).count() == 0
    assert graphs.long_walkers(chain.where("false")).count() == 0


def unfolded(root, best, stock, max_depth):
    rows = []

    def go(path, line, smiles):
        depth = len(path)
        status = ("stock" if smiles in stock else "cycle" if smiles in line else "dead_end" if smiles not in best
                  else "depth" if max_depth is not None and depth >= max_depth else "expanded")
        rows.append((path, path[:-1] if path else None, smiles, depth, status, best[smiles][0] if status == "expanded" else None))
        if status == "expanded":
            for place, child in best[smiles][1]:
                go([*path, place], [*line, smiles], child)
    go([], [], root)
    return rows


def test_expansion_matches_recursion(spark):
    rng = random.Random(11)
    for seed in range(1):
        names = [f"m{i}" for i in range(14)]
        stock = set(names[10:])
        cands = [(names[t], rank, k, rng.choice(names[max(0, t - 2):t + 5] + names[10:]), 0.1 * rank) for t in range(9) for rank in (1, 2) for k in range(rng.randrange(1, 3))]
        best = {t: (0.1, [(k, s) for x, r, k, s, _ in cands if x == t and r == 1]) for t in names[:9]}
        targets = spark.createDataFrame([(i, n) for i, n in enumerate([*names, "unknown", "m0"])], "route_id bigint, smiles string")
        table = spark.createDataFrame(cands, "target string, rank bigint, ord bigint, smiles string, confidence double")
        for depth in (None, 3):
            got = G.expand_routes(targets, table, spark.createDataFrame([(s,) for s in stock], "smiles string"), max_depth=depth)
            assert got.columns == ["route_id", "path", "parent", "smiles", "depth", "status", "confidence"]
            mine = sorted((r["route_id"], str(tuple(r)[1:])) for r in got.collect())
            want = sorted((i, str(x)) for i, n in enumerate([*names, "unknown", "m0"]) for x in unfolded(n, best, stock, depth))
            assert mine == want, (seed, depth)


def test_a_deep_route_takes_few_rounds(spark, monkeypatch):
    chain = spark.range(120).selectExpr("concat('n', id) target", "1L rank", "0L ord", "concat('n', id + 1) smiles", "0.5D confidence")
    targets = spark.createDataFrame([(1, "n0")], "route_id bigint, smiles string")
    rounds = []
    real = G.grow
    monkeypatch.setattr(G, "grow", lambda start, step: real(start, lambda level: (rounds.append(1), step(level))[1]))
    got = G.expand_routes(targets, chain, targets.select("smiles").where("false"))
    assert got.count() == 121 and got.agg({"depth": "max"}).first()[0] == 120 and len(rounds) < 20
