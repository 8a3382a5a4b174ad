"""Reaction classification in Spark ML pipelines."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage
from .compare import text_structures
from .forest import Forest
from .molecule import fingerprint

# Fingerprint bits per side, trees and seed of the classifier.
BITS = 2048
TREES = 100
SEED = 42
DEPTH = 20  # levels of a tree
SLICE = 4_000  # rows a task holds, about, where a caller bounds them


def split_rows(df: DataFrame, part: str) -> DataFrame:
    """K1."""
    return df.where(F.col("split") == part)


def encode_class(df: DataFrame, column: str = "rxn_class") -> DataFrame:
    """K2: classes numbered in alphabetical order."""
    return StringIndexer(inputCol=column, outputCol="label", stringOrderType="alphabetAsc").fit(df).transform(df)


def split_reaction(df: DataFrame) -> DataFrame:
    """K3: ``rxn`` into input and output at ``>>``."""
    parts = F.split("rxn", ">>")
    return df.withColumn("input", parts[0]).withColumn("output", F.get(parts, F.lit(1))).withColumn("n_parts", F.size(parts))


def with_fingerprints(df: DataFrame) -> DataFrame:
    """K4: bits of both sides; rows with an unreadable side are dropped.

    Every distinct text is hashed once.
    """
    texts = df.select(F.explode(F.array("input", "output")).alias("smiles"))
    bits = stage(fingerprint(text_structures(texts), 2, BITS).where("bits IS NOT NULL"))

    def side(tag: str) -> DataFrame:
        return bits.select(F.col("mol_id").alias(f"{tag}_key"), F.col("bits").alias(f"{tag}_bits"))

    return (
        df.withColumn("input_key", F.md5("input")).withColumn("output_key", F.md5("output"))
        .join(side("input"), "input_key").join(side("output"), "output_key").drop("input_key", "output_key")
    )


def features(df: DataFrame) -> DataFrame:
    """K5: both bit lists as one sparse vector."""
    vocabulary = [str(i) for i in range(BITS)]
    out = df
    for tag in ("input", "output"):
        words = out.withColumn("_words", F.transform(f"{tag}_bits", lambda b: b.cast("string")))
        counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_words", outputCol=f"{tag}_vec")
        out = counted.transform(words).drop("_words")
    return VectorAssembler(inputCols=["input_vec", "output_vec"], outputCol="features").transform(out).drop("input_vec", "output_vec")


def _drawn(df: DataFrame) -> Column:
    """A number below 2^30 from a row's columns."""
    return F.pmod(F.xxhash64(*[c for c in df.columns if c != "features"]), F.lit(1 << 30))


def bounded(df: DataFrame, most: int, label: str = "label") -> DataFrame:
    """About ``most`` rows at most, an equal share of each class first given to the small ones; all rows if there are no more.

    A row's features decide whether it is in, so the choice is the same in every run.  The
    driver sees one count per class; the shares, one per class, go to every task, since a join
    by class would deal the rows to as few tasks as there are classes.
    """
    counts = sorted(df.groupBy(label).count().collect(), key=lambda r: r["count"])
    left, shares = most, []
    for i, r in enumerate(counts):
        take = min(r["count"], left // (len(counts) - i))
        left -= take
        shares.append((r[label], take / r["count"]))
    if all(s == 1.0 for _, s in shares):
        return df
    wanted = df.sparkSession.createDataFrame(shares, f"{label} {df.schema[label].dataType.simpleString()}, _share double")
    return df.withColumn("_drawn", _drawn(df) / F.lit(float(1 << 30))).join(F.broadcast(wanted), label).where("_drawn < _share").drop("_drawn", "_share")


def train(df: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int | None = None) -> PipelineModel:
    """K6: deep trees on every row; on ``bounded`` ones only if a caller says so, then dealt by hash to slices of about ``SLICE``."""
    rows = df if most is None else bounded(df, most)
    if most is not None:
        rows = rows.repartition(1 + most // SLICE, _drawn(rows))
    return Pipeline(stages=[Forest(2 * BITS, trees, depth, SEED)]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """K7."""
    return model.transform(df)


def class_report(df: DataFrame) -> DataFrame:
    """K8: precision, recall, f1 and support per class of ``(label, prediction)``."""
    hit = (F.col("label") == F.col("prediction")).cast("int")
    cells = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))
    actual = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum("hits").alias("hits"))
    guessed = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("guessed"))
    p = F.coalesce(F.col("hits") / F.col("guessed"), F.lit(0.0))
    r = F.col("hits") / F.col("support")
    return actual.join(guessed, "class", "left").select(
        "class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), "support")


def accuracy(df: DataFrame) -> DataFrame:
    """K8: overall share of right predictions."""
    return df.agg(F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 6).alias("accuracy"))


def save_model(model: PipelineModel, path: str) -> None:
    """K9."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """K9."""
    return PipelineModel.load(path)


def class_scalability(names: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched with scalability, unmatched), by lower-case name."""
    known = classes.select(F.lower("name").alias("_n"), "code", "scalability")
    keyed = names.withColumn("_n", F.lower("name"))
    return keyed.join(known, "_n").drop("_n"), keyed.join(known, "_n", "left_anti").drop("_n")


def describe(df: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), bins: int = 1024) -> DataFrame:
    """``column, count, mean, stddev, min, p25, p50, p75, max`` of every numeric column, as doubles.

    Quantiles are exact: the value of rank ceil(q * count).  Each round counts the values of what
    is left of every range in ``bins`` equal bins and goes on with the bin that holds the rank,
    narrowed to the values that occur in it, until that is one value.  The driver sees no more
    than ``bins`` counts a column and quantile; nulls and NaN don't count.
    """
    spark = df.sparkSession
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select("x.*")
    values = values.where("v IS NOT NULL AND NOT isnan(v)")
    whole = values.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stddev"), F.min("v").alias("min"), F.max("v").alias("max"))
    rows = {r["column"]: r.asDict() for r in whole.collect()}
    ranges = {(c, q): (r["min"], r["max"], max(1, math.ceil(q * r["count"]))) for c, r in rows.items() for q in quantiles}
    while open_ := [(c, q, low, high) for (c, q), (low, high, _) in ranges.items() if low < high]:
        wanted = F.broadcast(spark.createDataFrame(open_, "column string, q double, low double, high double"))  # a row a column and quantile
        place = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        found = values.join(wanted, "column").where("v BETWEEN low AND high").groupBy("column", "q", place.alias("bin")).agg(
            F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("column", "q", "bin").collect()
        for key in [(c, q) for c, q, *_ in open_]:
            rank = ranges[key][2]
            for r in (r for r in found if (r["column"], r["q"]) == key):
                if rank <= r["n"]:
                    ranges[key] = (r["low"], r["high"], rank)
                    break
                rank -= r["n"]
    out = [(c, r["count"], r["mean"], r["stddev"], r["min"], *[ranges[c, q][0] for q in quantiles], r["max"]) for c, r in sorted(rows.items())]
    at = ", ".join(f"p{q * 100:g} double" for q in quantiles)
    return spark.createDataFrame(out, f"column string, count long, mean double, stddev double, min double, {at}, max double")
