"""Predictions against ground truth.

Both sides come in long form, ``(id, place, mol)``: counts per id combine before the shuffle
and no list is gathered.  ``mol`` is the structure key where the text can be read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compare import text_structures
from .molecule import structure_key


def first_step(molecules: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What step 1 consumes, and its product."""
    return (
        molecules.where("step = 1").select("route_id", "ord", "smiles", "role"),
        steps.where("step = 1").select("route_id", "product"),
    )


def attach_results(truth: DataFrame, results: DataFrame) -> DataFrame:
    """On ``id``; rows with a NULL anywhere are dropped."""
    return truth.join(results, "id", "left").na.drop()


def product_mismatch(rows: DataFrame) -> DataFrame:
    """J3."""
    return rows.where(F.col("input") != F.col("product"))


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds ``mol``: the structure key of ``smiles``, or the text itself if unreadable."""
    keys = structure_key(text_structures(rows))
    return (
        rows.withColumn("mol_id", F.md5("smiles")).join(keys, "mol_id", "left")
        .withColumn("mol", F.coalesce("skey", "smiles")).drop("mol_id", "skey")
    )


def match_counts(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per id: sizes of both sides and how many predicted molecules are in the truth."""
    known = truth.select("id", "mol").distinct().withColumn("_hit", F.lit(1))
    got = predicted.select("id", "mol").join(known, ["id", "mol"], "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count("_hit").alias("n_common"))
    want = truth.groupBy("id").agg(F.count(F.lit(1)).alias("n_truth"))
    return want.join(got, "id", "left").na.fill(0, ["n_predicted", "n_common"])


def correctness(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``any_correct`` / ``all_correct`` (1/0): sizes agree and some / every predicted
    molecule is in the truth."""
    return scored(match_counts(truth, predicted))


def scored(counts: DataFrame) -> DataFrame:
    """The two flags of J4 from ``id, n_truth, n_predicted, n_common``."""
    same = F.col("n_truth") == F.col("n_predicted")
    return counts.select(
        "id",
        (same & (F.col("n_common") > 0)).cast("int").alias("any_correct"),
        (same & (F.col("n_common") == F.col("n_predicted"))).cast("int").alias("all_correct"),
    )


def not_common(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted molecules outside the truth, duplicates kept; swap the sides for
    ``missed``."""
    return predicted.join(truth.select("id", "mol").distinct(), ["id", "mol"], "left_anti")


def accuracy(scores: DataFrame, *group: str) -> DataFrame:
    """Percentages per group."""
    return scores.groupBy(*group).agg(
        F.round(100 * F.avg("any_correct"), 6).alias("any_pct"),
        F.round(100 * F.avg("all_correct"), 6).alias("all_pct"),
        F.count(F.lit(1)).alias("n"),
    )


def needs_review(scores: DataFrame) -> DataFrame:
    """J7."""
    return scores.where("any_correct <> 1")


def parse_truth_path(paths: DataFrame) -> DataFrame:
    """``paths(route_id, idx, text)`` of ``product>...>a.b`` -> product and reactants."""
    parts = F.split("text", ">")
    return paths.select(
        "route_id", "idx", parts[0].alias("product"), F.split(F.get(parts, F.lit(2)), r"\.").alias("reactants"))


def align_routes(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each truth route with the predicted route for the same first product, or NULL."""
    root = truth.where("idx = 0").select(F.col("route_id").alias("truth_id"), "product")
    made = predicted.where("idx = 0").groupBy("product").agg(F.min("route_id").alias("predicted_id"))
    return root.join(made, "product", "left")


def route_exact(truth: DataFrame, predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per truth route whether every step agrees (product and sorted reactants), and the
    first index that does not."""
    t = truth.select(
        F.col("route_id").alias("truth_id"), "idx", F.col("product").alias("tp"), F.array_sort("reactants").alias("tr"))
    p = predicted.select(
        F.col("route_id").alias("predicted_id"), "idx", F.col("product").alias("pp"), F.array_sort("reactants").alias("pr"))
    rows = t.join(pairs.select("truth_id", "predicted_id"), "truth_id", "left").join(p, ["predicted_id", "idx"], "left")
    same = F.coalesce((F.col("tp") == F.col("pp")) & (F.col("tr") == F.col("pr")), F.lit(False))
    return rows.groupBy("truth_id").agg(
        F.min(same).alias("exact"), F.min(F.when(~same, F.col("idx"))).alias("first_mismatch"))


def route_accuracy(flags: DataFrame, *group: str) -> DataFrame:
    """Percentage of exact routes."""
    return flags.groupBy(*group).agg(
        F.round((1 - F.sum(F.when(F.col("exact"), 0).otherwise(1)) / F.count(F.lit(1))) * 100, 6).alias("accuracy"))


def sample_n(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """A repeatable sample: the n least hashes (a distributed top-n), ordered by key."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(mixed, key).limit(n).orderBy(key)


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """J13."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def score_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """J4 from texts in grouped passes: texts become keys and numbers per id before they meet their structure keys."""
    tagged = truth.select("id", "smiles", F.lit(True).alias("is_truth")).unionByName(
        predicted.select("id", "smiles", F.lit(False).alias("is_truth")))
    keys = structure_key(text_structures(tagged))
    per_text = tagged.groupBy("id", F.md5("smiles").alias("mol_id")).agg(
        F.count_if("is_truth").alias("t"), F.count_if(~F.col("is_truth")).alias("p"))
    per_mol = per_text.join(keys, "mol_id", "left").groupBy("id", F.coalesce("skey", "mol_id").alias("mol")).agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"))
    common = F.when(F.col("mol").isNotNull() & (F.col("t") > 0), F.col("p")).otherwise(0)
    return scored(per_mol.groupBy("id").agg(
        F.sum("t").alias("n_truth"), F.sum("p").alias("n_predicted"), F.sum(common).alias("n_common")).where("n_truth > 0"))
