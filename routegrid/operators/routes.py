"""Expanding targets into routes and flattening routes into numbered steps.

Candidates come in long form, ``candidates(target, rank, ord, smiles, confidence)``: one row
per reactant, so no list has to be gathered in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frontier import grow, union_all
from ..plans.graphs import long_walkers, strong_components
from ..plans.ranking import numbered
from ..plans.staging import stage
from .molecule import formula_and_mass


def short_circuit(targets: DataFrame, stock: DataFrame) -> DataFrame:
    """G1: targets that need no route become solved leaves."""
    return targets.join(stock.select("smiles").distinct(), "smiles", "left_semi").select(
        "route_id", "smiles", F.lit("stock").alias("status"))


def best_pathways(candidates: DataFrame) -> DataFrame:
    """The lowest rank of every target, as candidate rows."""
    best = candidates.groupBy("target").agg(F.min("rank").alias("rank"))
    return candidates.join(best, ["target", "rank"], "left_semi")


def solvable_pathways(candidates: DataFrame, stock: DataFrame) -> DataFrame:
    """Strict choice: a molecule is solved if in stock or if all reactants of some pathway
    are.  Grown round by round; a target takes the lowest rank among the pathways complete
    in the round that first solves it, so the choice cannot run in circles.

    All candidates meet the stock once.  Rounds go on from the reactants that were not in it, of
    targets not solved yet, and meet only what the round before solved."""
    parts = candidates.select("target", "rank", "ord", "smiles", "confidence")
    known = stage(stock.select("smiles").distinct())
    placed = parts.where("target IS NOT NULL AND rank IS NOT NULL").select("target", "rank", "smiles")
    missing = stage(placed.join(known, "smiles", "left_anti"))
    pathway = ["target", "rank"]
    done = placed.select(*pathway).distinct().join(missing.select(*pathway).distinct(), pathway, "left_anti")
    in_stock = known.select(F.col("smiles").alias("target"))
    fresh = stage(done.groupBy("target").agg(F.min("rank").alias("rank")).join(in_stock, "target", "left_anti"))
    chosen, gone = [], in_stock
    while not fresh.isEmpty():
        chosen.append(fresh)
        gone = fresh.select("target") if gone is None else fresh.select("target").unionByName(gone)
        now = fresh.select(F.col("target").alias("smiles"), F.lit(True).alias("_now"))
        met = stage(missing.join(gone, "target", "left_anti").join(now, "smiles", "left").select("target", "rank", "smiles", "_now"))
        done = met.groupBy(*pathway).agg(F.count("_now").alias("have"), F.count(F.lit(1)).alias("need")).where("have = need")
        fresh = stage(done.groupBy("target").agg(F.min("rank").alias("rank")))
        missing, gone = met.where("_now IS NULL").drop("_now"), None
    return parts.join(union_all(chosen), pathway, "left_semi") if chosen else parts.limit(0)


def _shared_graph(targets: DataFrame, best: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(molecules, edges, cyclic): every distinct molecule once, whatever number of routes needs it.

    ``molecules(id, smiles, status, confidence)``; ``edges(src, ord, dst, status)`` of molecules
    that are expanded; ``cyclic(id, label)``: those on a cycle and the strong component they are in.
    """
    heads = best.groupBy(F.col("target").alias("smiles")).agg(F.max("confidence").alias("confidence"), F.lit(True).alias("_has"))
    known = stock.select("smiles").distinct().withColumn("_stock", F.lit(True))
    texts = targets.select("smiles").unionByName(best.select("smiles")).unionByName(best.select(F.col("target").alias("smiles"))).distinct()
    status = F.when(F.col("_stock"), "stock").when(F.col("_has").isNull(), "dead_end").otherwise("expanded")
    molecules = stage(texts.join(known, "smiles", "left").join(heads, "smiles", "left").select(
        F.monotonically_increasing_id().alias("id"), "smiles", status.alias("status"), "confidence"))
    source = molecules.where("status = 'expanded'").select(F.col("id").alias("src"), F.col("smiles").alias("target"))
    edges = stage(best.select("target", "ord", "smiles").join(source, "target").join(molecules.select("smiles", F.col("id").alias("dst"), "status"), "smiles")
                  .select("src", "ord", "dst", "status"))
    live = edges.where("status = 'expanded'").select("src", "dst")
    looping = stage(long_walkers(live))
    if looping.isEmpty():
        cyclic = looping.select(F.col("node").alias("id"), F.col("node").alias("label"))
    else:
        among = live.join(looping.withColumnRenamed("node", "src"), "src", "left_semi").join(looping.withColumnRenamed("node", "dst"), "dst", "left_semi")
        cyclic = strong_components(among).withColumnRenamed("node", "id")
    return molecules, edges, cyclic


def _below(edges: DataFrame, growth: int = 8) -> DataFrame:
    """What stands below each source within some levels: ``src, steps, dst, status, loop, n, more``.

    Levels double (1, 2, 4, ...) while something goes deeper and the table stays under ``growth``
    times the edges; every molecule's part is made once and shared by all routes.  A walk does not
    go on through a molecule on a cycle (``loop``).  ``more``: what is below is not in the table.
    """
    most, first = 1, edges.count()
    size = first
    table = edges.select("src", F.array(F.col("ord").cast("bigint")).alias("steps"), "dst", "status", "loop", F.lit(1).alias("n"))
    on = "status = 'expanded' AND loop IS NULL AND n = {}"
    while size <= growth * first:
        ahead = table.where(on.format(most))
        deeper = ahead.select("src", F.col("steps").alias("_steps"), F.col("n").alias("_n"), F.col("dst").alias("_via")).join(
            table.withColumnRenamed("src", "_via"), "_via").select(
            "src", F.concat("_steps", "steps").alias("steps"), "dst", "status", "loop", (F.col("_n") + F.col("n")).alias("n"))
        deeper = stage(deeper)
        more = deeper.count()
        if not more:
            break
        table, most, size = table.unionByName(deeper), most * 2, size + more
    return table.withColumn("more", F.expr(on.format(most) + " OR (status = 'expanded' AND loop IS NOT NULL)"))


def expand_routes(
    targets: DataFrame, candidates: DataFrame, stock: DataFrame, max_depth: int | None = None, strict: bool = False
) -> DataFrame:
    """Route nodes ``route_id, path, parent, smiles, depth, status, confidence``.

    ``path`` holds the child places from the root, so sorting by it is pre-order.  Statuses:
    stock, expanded, cycle (an ancestor has the same text), depth, dead_end.  A node of the
    last three is not solved and is left out when the route is flattened.

    Routes are unfolded from keys of a graph in which every molecule stands once, several levels
    at a time.  Only molecules inside a strong component remember their ancestors in it, as
    keys; texts join at the end.
    """
    candidates = stage(candidates.select("target", "rank", "ord", "smiles", "confidence"))
    best = stage(solvable_pathways(candidates, stock) if strict else best_pathways(candidates))
    molecules, edges, cyclic = _shared_graph(targets, best, stock)
    cyclic = stage(cyclic)
    edges = edges.join(cyclic.select(F.col("id").alias("dst"), F.col("label").alias("loop")), "dst", "left").select("src", "ord", "dst", "status", "loop")
    edges = stage(edges)
    circling = cyclic.select(F.col("id").alias("src"), F.col("label").alias("_loop"))
    below = _below(edges.join(circling, "src", "left_anti"))
    one = stage(edges.join(circling, "src"))
    shallow = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    node = ["route_id", "path", "depth", "id", "status", "loop", "line", "more"]
    no_line = F.array().cast("array<bigint>")

    def cut(rows: DataFrame) -> DataFrame:
        if max_depth is None:
            return rows.select(*node)
        too_deep = (F.col("status") == "expanded") & (F.col("depth") >= max_depth)
        return rows.where(shallow).withColumn("more", F.col("more") & ~too_deep).withColumn("status", F.when(too_deep, "depth").otherwise(F.col("status"))).select(*node)

    def onward(level: DataFrame) -> DataFrame:
        ahead = level.where("more").select("route_id", F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("id").alias("src"), F.col("line").alias("_line"))
        plain = ahead.drop("_line").join(below, "src").select(
            "route_id", F.concat("_path", "steps").alias("path"), (F.col("_depth") + F.col("n")).alias("depth"), F.col("dst").alias("id"),
            "status", "loop", no_line.alias("line"), "more")
        if cyclic.isEmpty():
            return cut(plain)
        line = F.when(F.col("loop") == F.col("_loop"), F.array_append("_line", F.col("src"))).otherwise(no_line)
        again = F.coalesce(F.array_contains("line", F.col("dst")), F.lit(False))
        circle = ahead.join(one, "src").withColumn("line", line).withColumn("status", F.when(again, "cycle").otherwise(F.col("status"))).select(
            "route_id", F.array_append("_path", F.col("ord").cast("bigint")).alias("path"), (F.col("_depth") + 1).alias("depth"), F.col("dst").alias("id"),
            "status", "loop", "line", (F.col("status") == "expanded").alias("more"))
        return cut(plain.unionByName(circle))

    root = targets.select("route_id", "smiles").join(molecules.select("smiles", "id", "status"), "smiles").join(
        cyclic.withColumnRenamed("label", "loop"), "id", "left").select(
        "route_id", F.array().cast("array<bigint>").alias("path"), F.lit(0).alias("depth"), "id", "status", "loop", no_line.alias("line"),
        (F.col("status") == "expanded").alias("more"))
    nodes = union_all(grow(cut(root), onward))
    return nodes.join(molecules.select("id", "smiles", "confidence"), "id").select(
        "route_id", "path", F.when(F.col("depth") > 0, F.slice("path", F.lit(1), F.size("path") - 1)).alias("parent"), "smiles", "depth", "status",
        F.when(F.col("status") == "expanded", F.col("confidence")).alias("confidence"))


def expand_once(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """One molecule node and one reaction with its confidence, nothing below."""
    heads = best_pathways(candidates).groupBy("target").agg(F.max("confidence").alias("confidence"))
    return targets.join(heads, targets["smiles"] == heads["target"], "left").select("route_id", "smiles", "confidence")


def confidence_estimate(p: Column) -> Column:
    """G8."""
    lifted = F.when(p < 0.3, 1 - p).when(p < 0.45, p + 0.5).when(p < 0.6, p + 0.3).otherwise(p)
    return F.least(F.bround(lifted, 2), F.lit(0.99))


def solved_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status").isin("stock", "expanded"))


def flatten_route(nodes: DataFrame, basic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, molecules).

    ``steps(route_id, step, product, confidence)``: expanded molecules in pre-order.
    ``molecules(route_id, step, ord, smiles, role)``: what a step consumes; members of
    ``basic`` are reagents.
    """
    kept = solved_nodes(nodes)
    ranked = numbered(
        kept.where("status = 'expanded'").select("route_id", "path", "smiles", "confidence"),
        ["route_id"], ["path"], "step")
    ranked = stage(ranked)
    steps = ranked.select(
        "route_id", "step", F.col("smiles").alias("product"),
        confidence_estimate(F.col("confidence")).alias("confidence"))
    common = basic.select("smiles").distinct().withColumn("_basic", F.lit(True))
    used = (
        kept.where("parent IS NOT NULL").select("route_id", "parent", F.element_at("path", -1).alias("ord"), "smiles")
        .join(ranked.select("route_id", F.col("path").alias("parent"), "step"), ["route_id", "parent"])
        .join(common, "smiles", "left")
        .select("route_id", "step", "ord", "smiles",
                F.when(F.col("_basic"), "reagent").otherwise("reactant").alias("role"))
    )
    return steps, used


def resolve_dependencies(steps: DataFrame, molecules: DataFrame) -> DataFrame:
    """``route_id, step, ord, dep``: the step that makes each reactant, the later one if
    two do.  A step without such reactants keeps one row with NULL."""
    makers = steps.groupBy("route_id", F.col("product").alias("smiles")).agg(F.max("step").alias("dep"))
    needs = molecules.where("role = 'reactant'").join(makers, ["route_id", "smiles"]).select("route_id", "step", "ord", "dep")
    return steps.select("route_id", "step").join(needs, ["route_id", "step"], "left")


def format_route(nodes: DataFrame, basic: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, molecules and dependencies."""
    steps, molecules = flatten_route(nodes, basic)
    return steps, molecules, resolve_dependencies(steps, molecules)


def last_pairs(steps: DataFrame, molecules: DataFrame) -> DataFrame:
    """``route_id, step, smiles, product``: what a step consumes last, and what it makes."""
    last = molecules.groupBy("route_id", "step").agg(F.max_by("smiles", "ord").alias("smiles"))
    return steps.select("route_id", "step", "product").join(last, ["route_id", "step"])


def describe_steps(steps: DataFrame, molecules: DataFrame, types: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G4 and G6, complete: (steps, molecules) with formula and mass; steps also with a scalability.

    ``types(smiles, product, code)`` holds the predicted class of pairs.  A step takes the
    scalability of its last molecule's pair; ``N/A`` without a known class.  Each distinct text
    is analysed once and joins back by a digest.
    """
    texts = stage(molecules.select("smiles").unionByName(steps.select(F.col("product").alias("smiles"))).distinct().select(F.md5("smiles").alias("mol_id"), "smiles"))
    facts = stage(formula_and_mass(texts))
    pairs = last_pairs(steps, molecules).join(types.select("smiles", "product", "code").distinct(), ["smiles", "product"], "left")
    rated = scalability_index(pairs.select("route_id", "step", "code"), classes).select("route_id", "step", "scalability")
    full = (
        steps.withColumn("mol_id", F.md5("product")).join(facts, "mol_id").drop("mol_id")
        .join(rated, ["route_id", "step"], "left").withColumn("scalability", F.coalesce("scalability", F.lit("N/A")))
    )
    return full, molecules.withColumn("mol_id", F.md5("smiles")).join(facts, "mol_id").drop("mol_id")


def enrich_steps(
    steps: DataFrame, molecules: DataFrame, reagents: DataFrame, conditions: DataFrame, literature: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Conditions and closest literature onto steps; found reagents after the present ones."""
    key = ["route_id", "step"]
    last = molecules.groupBy(*key).agg(F.max("ord").alias("_last"))
    added = (
        reagents.join(last, key, "left")
        .select(*key, (F.coalesce("_last", F.lit(-1)) + 1 + F.col("ord")).cast("bigint").alias("ord"), "smiles",
                F.lit("reagent").alias("role"))
    )
    full = steps.join(conditions, key, "left").join(literature, key, "left")
    return full, molecules.select(*key, "ord", "smiles", "role").unionByName(added)


def reaction_type(pairs: DataFrame, predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Name and code of a predicted class; -1 and "Unknown Reaction" without one."""
    named = classes.select("code", "name")
    return (
        pairs.join(predictions.select("pair_id", F.col("prediction").cast("int").alias("code")), "pair_id", "left")
        .join(named, "code", "left")
        .select("pair_id", F.coalesce("name", F.lit("Unknown Reaction")).alias("name"),
                F.when(F.col("name").isNull(), -1).otherwise(F.col("code")).alias("code"))
    )


def scalability_index(df: DataFrame, classes: DataFrame, column: str = "code") -> DataFrame:
    """As text; ``N/A`` for an unknown class."""
    known = classes.select(F.col("code").alias(column), F.col("scalability").cast("string").alias("scalability"))
    return df.join(known, column, "left").withColumn(
        "scalability", F.coalesce("scalability", F.lit("N/A")))


def reaction_text(molecules: DataFrame, steps: DataFrame) -> DataFrame:
    """Reactants, then reagents, dot-joined, and the product after ``>>``."""
    texts = molecules.groupBy("route_id", "step").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((F.col("role") == "reagent").alias("r"), "ord", "smiles"))),
        lambda x: x["smiles"]), ".").alias("left_side"))
    return steps.join(texts, ["route_id", "step"], "left").select(
        "route_id", "step", F.concat(F.coalesce("left_side", F.lit("")), F.lit(">>"), "product").alias("reaction"))


def solved_flag(nodes: DataFrame) -> DataFrame:
    """Per route its stock leaves and whether every leaf is in stock."""
    leaves = nodes.where("status <> 'expanded'")
    return leaves.groupBy("route_id").agg(
        F.sum((F.col("status") == "stock").cast("int")).alias("in_stock"),
        F.min(F.col("status") == "stock").alias("solved"))
