"""Batch runs and request tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CONFIG_DEFAULTS, CONFIG_MODEL_FIELDS, CONFIG_SECTIONS

CONFIG = "llm_models map<string,map<string,string>>, az_models map<string,map<string,string>>, defaults map<string,string>"


def sweep(molecules: DataFrame, folders: list[str], runs: int, models: DataFrame) -> DataFrame:
    """L1: every molecule with every folder key (``model:version``) and run number.

    The matrix is unrolled from a literal on each molecule row; the model map has one row per
    configured model.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("folder"), F.lit(r).alias("run")) for f in folders for r in range(1, runs + 1)])
    rows = molecules.select("*", F.explode(cells).alias("c")).select(*molecules.columns, "c.*")
    parts = F.split("folder", ":")
    keyed = rows.withColumn("model_key", parts[0]).withColumn("version", F.get(parts, F.lit(1)))
    return keyed.join(models, "model_key", "left")


def isolate_errors(df: DataFrame, ok: Column, error: Column) -> DataFrame:
    """L2: adds ``status`` and ``error``; no row stops the run."""
    good = F.coalesce(ok, F.lit(False))
    return df.withColumn("status", F.when(good, "ok").otherwise("error")).withColumn("error", F.when(~good, error))


def run_report(results: DataFrame) -> DataFrame:
    """L3: count, share and mean elapsed time per status.

    The total is a one-row aggregate of the already reduced counts.
    """
    per = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed").alias("mean_elapsed"))
    total = per.agg(F.sum("n")).scalar()
    return per.select("status", "n", F.round(F.col("n") / total, 6).alias("share"), F.round("mean_elapsed", 6).alias("mean_elapsed"))


def _flag(value: Column, default: Column) -> Column:
    return F.when(value.isNull(), default).otherwise(F.lower(value) == "true")


def resolve_requests(requests: DataFrame, models: DataFrame, defaults: dict, versions: list[str], strict: bool = False) -> DataFrame:
    """L4: requests with defaults filled in and a status.

    ``models(model_key, internal_name, supports_*)``.  A flag the model does not support is
    switched off, or refused when ``strict``.
    """
    filled = (
        requests.withColumn("model_key", F.coalesce("model_type", F.lit(defaults["model_type"])))
        .withColumn("version", F.coalesce("model_version", F.lit(defaults["model_version"])))
        .join(models, "model_key", "left")
    )
    flags = [("advanced_prompt", "supports_advanced_prompt"), ("stability_flag", "supports_stability_check"),
             ("hallucination_check", "supports_hallucination_check")]
    refused = F.lit(False)
    out = filled
    for name, needs in flags:
        out = out.withColumn(name, _flag(F.col(name), F.lit(defaults[name])))
        refused = refused | (F.col(name) & ~F.col(needs))
    bad_flag = refused if strict else F.lit(False)
    status = (
        F.when(F.col("smiles").isNull(), 400).when(F.col("internal_name").isNull(), 400)
        .when(~F.col("version").isin(versions), 400).when(bad_flag, 400).otherwise(200)
    )
    out = out.withColumn("status", status)
    for name, needs in flags:
        out = out.withColumn(name, F.when(F.col("status") == 200, F.col(name) & F.col(needs)))
    model = F.concat("internal_name", F.when(F.col("advanced_prompt"), ":adv").otherwise(""))
    return out.withColumn("model", F.when(F.col("status") == 200, model)).withColumn(
        "version", F.when(F.col("status") == 200, F.col("version")))


def check_config(configs: DataFrame) -> DataFrame:
    """``configs(config_id, text)`` -> one row per violation."""
    c = configs.withColumn("c", F.from_json("text", CONFIG)).select("config_id", "c.*")

    def absent(have: Column, names: list[str], prefix: str) -> Column:
        return F.transform(
            F.array_except(F.array(*[F.lit(n) for n in names]), have), lambda n: F.concat(F.lit(prefix), n))

    present = F.filter(
        F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in CONFIG_SECTIONS]), lambda n: n.isNotNull())
    models = F.flatten(F.transform(
        F.map_entries("llm_models"),
        lambda m: F.transform(
            F.array_except(F.array(*[F.lit(n) for n in CONFIG_MODEL_FIELDS]), F.map_keys(m["value"])),
            lambda f: F.concat(F.lit("model "), m["key"], F.lit(" lacks "), f))))
    none = F.array().cast("array<string>")

    def known(section: str, default: str, word: str) -> Column:
        name = F.col("defaults")[default]
        return F.when(
            F.col(section).isNotNull() & name.isNotNull() & ~F.array_contains(F.map_keys(section), name),
            F.array(F.concat(F.lit(word), name))).otherwise(none)

    found = F.concat(
        absent(present, CONFIG_SECTIONS, "missing section "),
        F.when(F.col("defaults").isNotNull(), absent(F.map_keys("defaults"), CONFIG_DEFAULTS, "missing default ")).otherwise(none),
        known("llm_models", "model_type", "unknown default model "),
        known("az_models", "model_version", "unknown default version "),
        F.coalesce(models, none),
    )
    return c.select("config_id", F.explode(found).alias("violation"))
