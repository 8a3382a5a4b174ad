"""Memo tables: ``memo(key, input_args, result)``, one row per finished piece of work."""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def memo_args(*names: str) -> Column:
    """Arguments as JSON text with sorted names."""
    return F.to_json(F.struct(*sorted(names)))


def memo_key(fn: str, args: Column) -> Column:
    """``fn:`` and the md5 of the argument text."""
    return F.concat(F.lit(f"{fn}:"), F.md5(args))


def compute_missing(
    inputs: DataFrame, memo: DataFrame, fn: str, arg_names: list[str], compute: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(results for every input row, rows to append to the memo).

    ``compute`` gets each missing argument set once and returns it with a ``result`` column.
    A key that the memo holds several times still answers each input row once, with its least result.
    """
    args = memo_args(*arg_names)
    keyed = inputs.withColumn("input_args", args).withColumn("key", memo_key(fn, F.col("input_args")))
    wanted = keyed.select("key", "input_args", *arg_names).dropDuplicates(["key"])
    missing = wanted.join(memo.select("key"), "key", "left_anti")
    added = compute(missing).select("key", "input_args", "result")
    stored = memo.groupBy("key").agg(F.min("result").alias("result"))
    out = keyed.join(stored.unionByName(added.select("key", "result")), "key")
    return out, added


def clear_all(memo: DataFrame) -> DataFrame:
    """The empty memo."""
    return memo.where(F.lit(False))


def evict(memo: DataFrame, molecule: str) -> DataFrame:
    """I4: drops every entry whose argument text holds the molecule text anywhere."""
    return memo.where(~F.contains("input_args", F.lit(molecule)))


def evict_all(memo: DataFrame, molecules: DataFrame, automaton_chars: int = 2_000_000, task_chars: int = 16_000_000) -> DataFrame:
    """I4 for a table of molecules, by a multi-pattern automaton.

    Molecules are dealt to shards of about ``automaton_chars`` characters, argument texts to
    slices of about ``task_chars``; each (slice, shard) builds one Aho-Corasick automaton and
    reads every text once, up to its first hit.  A single shard sends every text once.  Only two
    sums reach the driver.
    """
    wanted = stage(molecules.select("smiles").where("smiles <> ''").distinct())
    texts = memo.select("key", "input_args").where("input_args IS NOT NULL")
    shards = 1 + (wanted.agg(F.sum(F.length("smiles"))).first()[0] or 0) // automaton_chars
    parts = 1 + (texts.agg(F.sum(F.length("input_args"))).first()[0] or 0) // task_chars

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = texts.select(F.pmod(F.xxhash64("key", "input_args"), F.lit(parts)).alias("_part"), every(shards).alias("_shard"), "key", "input_args")
    right = wanted.select(every(parts).alias("_part"), F.pmod(F.xxhash64("smiles"), F.lit(shards)).alias("_shard"), "smiles")
    by = ["_part", "_shard"]
    hit = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_holding, "key string").distinct()
    return memo.join(hit, "key", "left_anti")


def _holding(texts: pa.Table, molecules: pa.Table) -> pa.Table:
    """Keys of the texts that hold one of the molecules."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for molecule in molecules.column("smiles").to_pylist():
        automaton.add_word(molecule)
    keys: list[str] = []
    if len(automaton):
        automaton.make_automaton()
        for key, text in zip(texts.column("key").to_pylist(), texts.column("input_args").to_pylist()):
            if next(automaton.iter(text), None) is not None:
                keys.append(key)
    return pa.table({"key": pa.array(keys, pa.string())})
