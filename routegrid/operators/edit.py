"""Cutting a route at a step, putting a new branch in, and the tree view.

Tables: ``steps(route_id, step)`` and ``edges(route_id, step, dep)``.  Everything is keyed by
route, so any number of requests is handled in the same few joins.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frontier import closure
from ..plans.ranking import numbered
from ..plans.staging import stage


def downstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """H1: ``starts(route_id, step)`` and every step they depend on."""
    found = closure(
        starts.select("route_id", F.col("step").alias("node")),
        edges.select("route_id", F.col("step").alias("node"), F.col("dep").alias("next")), ["route_id"])
    return found.select("route_id", F.col("node").alias("step"))


def left_connection(edges: DataFrame, starts: DataFrame, removed: DataFrame) -> DataFrame:
    """H2: per route the first remaining step that depends on the start."""
    into = edges.join(starts.select("route_id", F.col("step").alias("dep")), ["route_id", "dep"])
    return (
        into.join(removed, ["route_id", "step"], "left_anti")
        .groupBy("route_id").agg(F.min("step").alias("left_step"))
    )


def keep_steps(steps: DataFrame, removed: DataFrame) -> DataFrame:
    """H3."""
    return steps.join(removed, ["route_id", "step"], "left_anti")


def keep_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """H3: both ends must remain."""
    gone = removed.select("route_id", F.col("step").alias("dep"))
    return edges.join(removed, ["route_id", "step"], "left_anti").join(gone, ["route_id", "dep"], "left_anti")


def renumber(new_steps: DataFrame, kept: DataFrame) -> DataFrame:
    """H4: ``route_id, step, new_step``: numbers go on after the highest remaining one."""
    highest = kept.groupBy("route_id").agg(F.max("step").alias("_max"))
    placed = numbered(new_steps.select("route_id", "step"), ["route_id"], ["step"], "_n")
    return placed.join(highest, "route_id", "left").select(
        "route_id", "step", (F.coalesce("_max", F.lit(0)) + F.col("_n")).cast("int").alias("new_step"))


def renumber_edges(new_edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """H4: both ends through the mapping."""
    own = mapping.select("route_id", "step", F.col("new_step").alias("_s"))
    dep = mapping.select("route_id", F.col("step").alias("dep"), F.col("new_step").alias("_d"))
    return new_edges.join(own, ["route_id", "step"]).join(dep, ["route_id", "dep"]).select(
        "route_id", F.col("_s").alias("step"), F.col("_d").alias("dep"))


def splice(
    steps: DataFrame, edges: DataFrame, starts: DataFrame, new_steps: DataFrame, new_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """H5: merged (steps with ``origin`` and ``old_step``, edges) of the routes in ``starts``."""
    asked = steps.join(starts.select("route_id").distinct(), "route_id", "left_semi")
    own_edges = edges.join(starts.select("route_id").distinct(), "route_id", "left_semi")
    removed = downstream(own_edges, starts)
    kept = stage(keep_steps(asked, removed))
    routes = starts.select("route_id").distinct()
    new_steps, new_edges = (t.join(routes, "route_id", "left_semi") for t in (new_steps, new_edges))
    mapping = stage(renumber(new_steps, kept))
    first = mapping.groupBy("route_id").agg(F.min("new_step").alias("dep"))
    bridge = left_connection(own_edges, starts, removed).join(first, "route_id").select(
        "route_id", F.col("left_step").alias("step"), "dep")
    merged = kept.select("route_id", "step", F.lit("kept").alias("origin"), F.col("step").alias("old_step")).unionByName(
        mapping.select("route_id", F.col("new_step").alias("step"), F.lit("new").alias("origin"), F.col("step").alias("old_step")))
    all_edges = keep_edges(own_edges, removed).select("route_id", "step", "dep").unionByName(bridge).unionByName(
        renumber_edges(new_edges, mapping))
    return merged, all_edges


def splice_status(requests: DataFrame, results: DataFrame, steps: DataFrame, new_counts: DataFrame, kept_counts: DataFrame) -> DataFrame:
    """H6: ``requests(request_id, route_id, smiles, step)`` -> status and message.

    ``results(route_id, target)`` are the stored routes, ``steps`` has ``n_products``.
    """
    known = results.select("route_id", "target")
    at = steps.select("route_id", "step", "n_products", F.lit(True).alias("_step"))
    rows = (
        requests.join(known, "route_id", "left").join(at, ["route_id", "step"], "left")
        .join(new_counts, "route_id", "left").join(kept_counts, "route_id", "left")
    )
    new, kept = F.coalesce("n_new", F.lit(0)), F.coalesce("n_kept", F.lit(0))
    status = (
        F.when(F.col("target").isNull() | (F.col("target") != F.col("smiles")), 400)
        .when(F.col("_step").isNull(), 404).when(F.col("n_products") == 0, 400)
        .when((new + kept) == 0, 500).otherwise(200)
    )
    message = (
        F.when(F.col("target").isNull(), "no previous result")
        .when(F.col("target") != F.col("smiles"), "no result for this molecule")
        .when(F.col("_step").isNull(), "step not found")
        .when(F.col("n_products") == 0, "step has no products")
        .when((new + kept) == 0, "nothing left")
        .when(new == 0, "no further steps needed").otherwise("ok")
    )
    return rows.select("request_id", status.alias("status"), message.alias("message"))


def add_root_step(products: DataFrame) -> DataFrame:
    """H7: ``products(route_id, step, ord, smiles)``: step 0 takes the first product of step 1."""
    lead = (F.col("step") == 1) & (F.col("ord") == 0)
    moved = products.where(lead).withColumn("step", F.lit(0).cast(products.schema["step"].dataType))
    rest = products.where(~lead).withColumn(
        "ord", F.when(F.col("step") == 1, F.col("ord") - 1).otherwise(F.col("ord")).cast(products.schema["ord"].dataType))
    return moved.unionByName(rest)


def parent_of_step(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """H8: the largest step that lists it; 0 for step 1; NULL for an orphan."""
    parents = edges.where("dep <> 1").groupBy("route_id", F.col("dep").alias("step")).agg(F.max("step").alias("p"))
    return steps.select("route_id", "step").join(parents, ["route_id", "step"], "left").select(
        "route_id", "step", F.when(F.col("step") == 1, 0).otherwise(F.col("p")).cast("int").alias("parent"))


def route_tree(parents: DataFrame, paths: bool = True) -> DataFrame:
    """H9: ``route_id, step, root, depth`` (and ``path``) of every step below a root (a step without parent, or step 0).

    Pointer doubling: every step knows an ancestor and how far up it is, and takes over that
    ancestor's own pointer.  A chain of n steps is done after log2(n) rounds.  Steps below a cycle
    or a missing parent belong to no root and are left out.
    """
    step = F.col("step").cast("int")
    zero = parents.where("parent = 0").select("route_id").distinct().select("route_id", F.lit(0).alias("step"), F.lit(None).cast("int").alias("parent"))
    nodes = parents.select("route_id", step.alias("step"), F.col("parent").cast("int").alias("parent")).unionByName(zero)
    line = [F.array("step").alias("path")] if paths else []
    state = stage(nodes.select("route_id", "step", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("step")).alias("root"),
                               F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), *line))
    left, before = state.where("up IS NOT NULL").count(), None
    while left and left != before:  # without progress only cycles are left
        above = state.select("route_id", F.col("step").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"),
                             *([F.col("path").alias("_path")] if paths else []))
        moved = state.where("up IS NOT NULL").join(above, ["route_id", "up"]).select(
            "route_id", "step", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"),
            *([F.concat("_path", "path").alias("path")] if paths else []))
        state = stage(state.where("up IS NULL").unionByName(moved))
        left, before = state.where("up IS NOT NULL").count(), left
    return state.where("up IS NULL").drop("up")


def dependency_edges(edges: DataFrame) -> DataFrame:
    """Edges as a graph list, from the dependency to the step."""
    return edges.select("route_id", F.col("dep").alias("source"), F.col("step").alias("target"))
