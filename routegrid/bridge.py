"""Engine inputs derived from the driver's tables.

The tables hold no chemistry, so molecule texts are spelled from keys: each decimal digit of
a key is a chain fragment, followed by one of the fixture molecules.  Texts therefore differ
from row to row and their number grows with the table.  Every expression is written once, as
text that both Spark SQL and DuckDB accept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.settings import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FRAGMENTS = ["C", "CC", "C(C)", "C(=O)", "O", "N", "C(O)", "C(N)", "S", "C(F)"]

# Each starts with an atom that can take one more single bond; the last ones are broken.
POOL = [
    "C1CCCCC1", "Cc1ccccc1", "CC(=O)OC1=CC=CC=C1C(=O)O", "CN1C=NC2=C1C(=O)N(C)C(=O)N2C",
    "C1CN1", "C1CNC1", "C1CC2OCC12", "C1C2CC12", "C1CCNCCCC1", "C1CNCCNCCNCCN1",
    "C[CH2+]", "CC[C+](C)C", "C[CH+]C", "C[CH+]c1ccccc1", "CC=C[CH2+]", "C[C+](C)F",
    "C[C]C", "CC#C", "CC1=CC=C1", "CC1=CC=CC=CC=C1", "Cc1ccc2ccccc2c1", "CC1CC2CCC1C2",
    "CC(=O)Nc1ccc(O)cc1", "C[Si](C)(C)C#N", "CC(C)Cc1ccc(cc1)C(C)C(=O)O",
    "COc1ccc(OC)cc1", "COCc1ccccc1", "Cc1cnccn1", "C[n+]1ccccc1", "CC(=O)[O-].[Na+]",
    "CC.CO.O", "Cc1ccc[nH]1", "C/C=C/C", "C[C@H](N)C(=O)O", "CC1CCCCCC1", "CC1CCCCCCC1",
    "Cc1ccc(C)cc1", "Cc1cccc(Cl)c1", "Cc1ccccc1Br", "CC1CC2OC2C1", "C[N+](=O)[O-]",
    "CS(=O)(=O)C", "CP(=O)(O)O", "C%10CCCC%10", "CC([H])([H])C", "Cc1ccc(Cl)c(C)c1",
    "C1C[C]1", "C1CC1", "CCOC", "CC(=O)OC(C)C", "C1C2CC1C2", "CC1=CC2=CC=CC2=C1", "CNC(=O)c1ccc(C#N)cc1", "Cc1ccoc1C",
    "C1CC", "C(C", "C(C)(C)(C)(C)C", "Cx", "CC)C", "C=",
]


def text_of(key: str) -> str:
    """SQL text: the chain spelled by the digits of ``key``."""
    out = f"cast({key} AS string)"
    for digit, frag in enumerate(FRAGMENTS):
        out = f"replace({out}, '{digit}', '{frag}')"
    return out


def pool_of(number: str, pool: list[str] | None = None) -> str:
    """SQL text: a pool entry chosen by ``number`` (non-negative)."""
    pool = pool or POOL
    return f"split_part('{'~'.join(pool)}', '~', cast({number} % {len(pool)} + 1 AS int))"


def smiles_of(key: str, number: str) -> str:
    return f"concat({text_of(key)}, {pool_of(number)})"


PART_SMILES = smiles_of("p_partkey", "p_partkey")

VIEWS = {
    # one molecule per part
    "molecules": f"SELECT p_partkey AS mol_id, {PART_SMILES} AS smiles FROM part",
    # reactant and product share the chain; the tails differ or agree by size
    "pairs": (
        f"SELECT p_partkey AS pair_id, {PART_SMILES} AS reactant, "
        f"{smiles_of('p_partkey', '(p_partkey + p_size % 5)')} AS product FROM part"
    ),
    # stock: parts below a size
    "stock": f"SELECT {PART_SMILES} AS smiles FROM part WHERE p_size <= 35",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; nothing is registered in the session catalog."""
    return derive(spark, sf_dir, VIEWS[name])


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Evaluate a one-table SELECT over a driver table."""
    used = [t for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    tables = {t: load(spark, sf_dir, t) for t in used}
    sql = sql.replace("{", "{{").replace("}", "}}")  # spark.sql formats its text
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(sql, **tables)


def with_views(*names: str) -> str:
    """DuckDB: the same derived tables as leading CTEs."""
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
