"""Input files as DataFrames."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.frontier import grow, union_all


def _tidy(df: DataFrame) -> DataFrame:
    """Trims header blanks and drops columns without a name."""
    named = [(c, c.strip()) for c in df.columns]
    return df.select(*[F.col(f"`{c}`").alias(t) for c, t in named if t and not t.startswith("_c")])


@contextmanager
def _few_listings(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by as many tasks as a shuffle has, not by one task each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """A1: CSV with a header that may hold blanks or a trailing comma."""
    return _tidy(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def read_reactions(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A2: CSV whose unnamed first column is the row id; ``output`` is dot-joined."""
    df = spark.read.csv(path, header=True)
    if df.columns[0] in ("_c0", ""):
        df = df.withColumnRenamed(df.columns[0], "row_id").withColumn("row_id", F.col("row_id").cast("bigint"))
    return df.withColumn("reaction_type", F.col("reaction_type").cast("int"))


def read_labelled_reactions(spark: SparkSession, path: str) -> DataFrame:
    """A3: TSV without the two provenance columns."""
    return spark.read.csv(path, header=True, sep="\t").drop("original_rxn", "source")


def read_routes(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A4: one JSON document per file; ``route_id`` is the last number in the file name, or that of a ``route_id=`` folder.

    A file that is no JSON document gives a row of NULLs whose ``_broken`` holds its text; the
    column is there if ``schema`` is given or Spark meets such a file while it infers one.
    """
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    if schema is not None:
        reader = reader.schema(f"{schema}, _broken string")
    with _few_listings(spark):
        docs = reader.json(path)
    if "route_id" in docs.columns:
        return docs.withColumn("route_id", F.col("route_id").cast("bigint"))
    named = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)[^0-9]*$", 1)
    return docs.select("*", named.cast("bigint").alias("route_id"))


def read_route_trees(trees: DataFrame) -> DataFrame:
    """A5: ``trees(route_id, text)`` of nested molecule/reaction JSON -> adjacency rows.

    ``route_id, path, parent, kind, smiles, in_stock, prob``; one pass per tree level.
    """
    def node(df: DataFrame) -> DataFrame:
        prob = "coalesce(try_variant_get(v, '$.metadata.policy_probability', 'double'), try_variant_get(v, '$.metadata.policy_probability[0]', 'double'))"
        return df.select(
            "route_id", "path", "parent",
            F.expr("CASE WHEN try_variant_get(v, '$.is_reaction', 'boolean') THEN 'reaction' ELSE 'mol' END").alias("kind"),
            F.expr("try_variant_get(v, '$.smiles', 'string')").alias("smiles"),
            F.expr("try_variant_get(v, '$.in_stock', 'boolean')").alias("in_stock"), F.expr(prob).alias("prob"),
            F.expr("to_json(try_variant_get(v, '$.children', 'variant'))").alias("below"))

    def deeper(level: DataFrame) -> DataFrame:
        trees_ = level.where("below IS NOT NULL").select("route_id", "path", F.expr("try_parse_json(below)").alias("w"))
        kids = trees_.lateralJoin(trees_.sparkSession.tvf.variant_explode(F.col("w").outer()))
        return node(kids.select(
            "route_id", F.array_append("path", F.col("pos")).alias("path"), F.col("path").alias("parent"), F.col("value").alias("v")))

    start = node(trees.select(
        "route_id", F.array().cast("array<int>").alias("path"), F.lit(None).cast("array<int>").alias("parent"),
        F.expr("try_parse_json(text)").alias("v")))
    return union_all(grow(start, deeper)).drop("below")


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(one row per model, the defaults) of one settings document."""
    return read_configs(spark, path)[:2]


def read_configs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A6 for a folder of settings documents: (models, defaults, texts that are no settings).

    Partition columns of the folder, such as a configuration's id, lead each row.
    """
    with _few_listings(spark):
        text = spark.read.text(path, wholetext=True)
    ids = [c for c in text.columns if c != "value"]
    model = "struct<internal_name:string,display_name:string,supports_advanced_prompt:boolean,supports_stability_check:boolean,supports_hallucination_check:boolean>"
    schema = f"llm_models map<string,{model}>, defaults map<string,string>, _broken string"
    c = text.select(*ids, "value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"}).alias("c"))
    good = c.where("c._broken IS NULL")
    models = good.select(*ids, F.explode("c.llm_models").alias("model_key", "m")).select(*ids, "model_key", "m.*")
    defaults = good.select(*ids, F.explode("c.defaults").alias("name", "value"))
    return models, defaults, c.where("c._broken IS NOT NULL").select(*ids, F.rtrim("value", F.lit("\n")).alias("value"))


def extract_xml_property(spark: SparkSession, path: str, kind: str = "SMILES", row_tag: str = "drug") -> DataFrame:
    """The property of one kind from every element."""
    schema = "name string, `calculated-properties` struct<property: array<struct<kind:string,value:string>>>"
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    hit = F.filter(F.col("`calculated-properties`.property"), lambda p: p["kind"] == kind)
    return df.select("name", F.get(hit, F.lit(0))["value"].alias("value")).where("value IS NOT NULL")


def load_result(spark: SparkSession, path: str) -> DataFrame:
    """``target, result``; a missing folder gives no rows, a broken line NULLs."""
    schema = "target string, result string, _broken string"
    try:
        df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
    except Exception as e:  # only a missing path is expected here
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "target string, result string")
    return df.select("target", "result")


def read_csv_lists(spark: SparkSession, path: str, schema: str, lists: list[str]) -> DataFrame:
    """A10: list columns come back from their text form."""
    df = spark.read.csv(path, header=True, schema=schema, escape='"')
    for c in lists:
        df = df.withColumn(c, F.from_json(c, "array<string>"))
    return df
