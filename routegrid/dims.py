"""Lookup tables whose entries decide the results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Buyable or trivial molecules, as text. Some entries are not SMILES.
STOCK = [
    "CC", "O", "C", "CCO", "CCOC", "CCOCC", "CCOCO", "CCOCOC", "ClC(=O)O", "CC(=O)Cl",
    "Cl", "Br", "F", "I", "O=C=O", "CCCl", "CCBr", "CCF", "CO", "CC(=O)O", "CCN", "C=O",
    "CC=O", "CCCC", "C=C", "C#C", "ClCCl", "C1CCCCC1", "C1=CC=CC=C1", "C1CCOC1", "N#N",
    "O=O", "O=S(=O)(O)O", "CCOC(=O)C", "NC=O", "CC(=O)C", "CC#N", "C1C=CC=CC=1C", "CSCC",
    "NCCO", "CC(C)O", "CC=CC", "CC(C)(C)O", "CC(=O)N", "CC(C)C", "C=CC", "C1=CC=CC=C1O",
    "C1=CC=C(C=C1)O", "C1=CC=C(C=C1)Cl", "C1=CC=C(C=C1)Br", "C1=CC=C(C=C1)I",
    "P(=O)(O)O", "P(Cl)(Cl)Cl", "P", "[K+].[OH-]", "[Na+].[OH-]", "[Li+].[OH-]",
    "[K+].[Cl-]", "[Na+].[Cl-]", "[Li+].[Cl-]", "NaCN", "NaOH", "H2SO4", "HCl", "HBr",
    "HI", "H2O2", "H2O", "NH3", "H2", "O2", "N2", "CO2", "NaBr", "[K+].[C-]#N",
    "[Na+].[C-]#N", "CC(C)[Mg]Br",
]

# Reaction classes (code, class id, name, scalability 0-10).
REACTION_CLASSES = [
    (0, "7.2.1", "Amide to amine reduction", 8),
    (1, "7.9.2", "Carboxylic acid to alcohol reduction", 8),
    (2, "1.7.9", "Williamson ether synthesis", 9),
    (3, "8.1.5", "Alcohol to ketone oxidation", 2),
    (4, "10.1.2", "Chlorination", 8),
    (5, "6.3.1", "O-Bn deprotection", 9),
    (6, "10.2.1", "Nitration", 3),
    (7, "6.1.5", "N-Bn deprotection", 9),
    (8, "9.3.1", "Carboxylic acid to acid chloride", 10),
    (9, "3.1.5", "Bromo Suzuki-type coupling", 10),
    (10, "1.3.7", "Chloro N-arylation", 7),
    (11, "1.2.5", "Ketone reductive amination", 8),
    (12, "6.1.3", "N-Cbz deprotection", 0),
    (13, "8.1.4", "Alcohol to aldehyde oxidation", 2),
    (14, "2.3.1", "Isocyanate + amine reaction", 9),
    (15, "2.1.1", "Amide Schotten-Baumann", 9),
    (16, "2.1.7", "N-acetylation", 10),
    (17, "1.6.8", "Iodo N-alkylation", 7),
    (18, "1.6.4", "Chloro N-alkylation", 7),
    (19, "1.8.5", "Thioether synthesis", 9),
    (20, "3.4.1", "Stille reaction", 1),
    (21, "6.3.7", "Methoxy to hydroxy", 8),
    (22, "6.2.3", "CO2H-tBu deprotection", 8),
    (23, "9.1.6", "Hydroxy to chloro", 8),
    (24, "1.7.4", "Hydroxy to methoxy", 9),
    (25, "1.3.6", "Bromo N-arylation", 7),
    (26, "6.2.2", "CO2H-Me deprotection", 9),
    (27, "1.2.4", "Eschweiler-Clarke methylation", 8),
    (28, "7.3.1", "Nitrile reduction", 9),
    (29, "1.6.2", "Bromo N-alkylation", 7),
    (30, "7.1.1", "Nitro to amino", 9),
    (31, "6.2.1", "CO2H-Et deprotection", 8),
    (32, "2.6.1", "Ester Schotten-Baumann", 9),
    (33, "10.1.1", "Bromination", 8),
    (34, "6.1.1", "N-Boc deprotection", 9),
    (35, "1.2.1", "Aldehyde reductive amination", 9),
    (36, "1.7.7", "Mitsunobu aryl ether synthesis", 5),
    (37, "1.7.6", "Methyl esterification", 10),
    (38, "2.6.3", "Fischer-Speier esterification", 10),
    (39, "3.3.1", "Sonogashira coupling", 8),
    (40, "2.2.3", "Sulfonamide Schotten-Baumann", 9),
    (41, "10.1.5", "Wohl-Ziegler bromination", 2),
    (42, "3.1.6", "Chloro Suzuki-type coupling", 10),
    (43, "5.1.1", "N-Boc protection", 8),
    (44, "10.4.2", "Methylation", 8),
    (45, "2.7.2", "Sulfonic ester Schotten-Baumann", 9),
    (46, "1.3.8", "Fluoro N-arylation", 7),
    (47, "8.2.1", "Sulfanyl to sulfinyl", 8),
    (48, "2.1.2", "Carboxylic acid + amine reaction", 9),
    (49, "3.1.1", "Bromo Suzuki coupling", 10),
]

# Status codes and their descriptions.
STATUS_CODES = [
    (200, "SUCCESS"),
    (400, "call_LLM() Function failed."),
    (501, "split_cot_json() failed."),
    (502, "split_json_openAI() failed."),
    (503, "split_json_deepseek() failed."),
    (504, "validate_split_json() failed."),
    (505, "split_json_master() failed."),
]

# Model names by answer layout. Any other name uses the tagged layout.
JSON_ONLY_MODELS = [
    "gpt-4o", "chatgpt-4o-latest", "gpt-4o-mini", "gpt-4o-mini-2024-07-18", "o1",
    "o1-2024-12-17", "o1-mini", "o1-mini-2024-09-12", "o1-preview",
    "o1-preview-2024-09-12", "gpt-4o-realtime-preview",
    "gpt-4o-realtime-preview-2024-12-17", "gpt-4o-mini-realtime-preview",
    "gpt-4o-mini-realtime-preview-2024-12-17", "gpt-4o-2024-08-06",
]
THINK_MODELS = [
    "azure_ai/DeepSeek-R1", "deepinfra/deepseek-ai/DeepSeek-R1",
    "fireworks_ai/accounts/fireworks/models/deepseek-r1",
    "together_ai/deepseek-ai/DeepSeek-R1",
]

# The three protecting groups (symbol, name, text), longest text first.
PROTECTING_GROUPS = [("%", "OBn", "COCc1ccccc1"), ("&", "OEt", "COC"), ("$", "OMe", "OC")]

# Element -> (lowest valence, isotope mass, standard weight).
ELEMENTS = {
    "H": (1, 1.00782503223, 1.008),
    "Li": (1, 7.0160034366, 6.941),
    "B": (3, 11.00930536, 10.812),
    "C": (4, 12.0, 12.011),
    "N": (3, 14.00307400443, 14.007),
    "O": (2, 15.99491461957, 15.999),
    "F": (1, 18.99840316273, 18.998),
    "Na": (1, 22.9897692820, 22.99),
    "Mg": (2, 23.985041697, 24.305),
    "Al": (3, 26.98153853, 26.982),
    "Si": (4, 27.97692653465, 28.086),
    "P": (3, 30.97376199842, 30.974),
    "S": (2, 31.9720711744, 32.067),
    "Cl": (1, 34.968852682, 35.453),
    "K": (1, 38.9637064864, 39.098),
    "Ca": (2, 39.962590863, 40.078),
    "Fe": (2, 55.93493633, 55.845),
    "Cu": (1, 62.92959772, 63.546),
    "Zn": (2, 63.92914201, 65.39),
    "Se": (2, 79.9165218, 78.96),
    "Br": (1, 78.9183376, 79.904),
    "Pd": (2, 105.9034804, 106.42),
    "Sn": (4, 119.90220163, 118.711),
    "I": (1, 126.9044719, 126.904),
}

# Substituent signatures with a common name.
GROUP_NAMES = [
    ("C1", "Methyl"), ("C2", "Ethyl"), ("C3", "Propyl"), ("N1", "Amino"), ("O1", "Hydroxy"),
    ("O2", "Carboxyl"), ("O2.C1", "Carboxyl acid"), ("Cl1", "Chloro"), ("Br1", "Bromo"),
    ("F1", "Fluoro"), ("I1", "Iodo"), ("N1.C1", "Methylamino"), ("C1.O1", "Hydroxy methyl"),
    ("C1.N1", "Aminomethyl"), ("N1.O1", "Nitro"), ("N1.O2", "Nitro"), ("S1", "Thiol"),
]

# Score bands, lowest score first in each entry.
SCORE_MESSAGES = [
    (90, "Highly reliable transformation with minimal or no structural inconsistencies"),
    (80, "Generally reliable transformation with minor structural inconsistencies"),
    (70, "Mostly reliable transformation with some structural inconsistencies"),
    (50, "Questionable transformation with significant structural inconsistencies"),
    (30, "Likely hallucination with major structural inconsistencies"),
    (10, "Severe hallucination with critical structural inconsistencies"),
    (0, "Complete hallucination or invalid transformation"),
]

# Keys a service configuration must carry.
CONFIG_SECTIONS = ["llm_models", "az_models", "defaults"]
CONFIG_DEFAULTS = [
    "model_type", "advanced_prompt", "model_version", "stability_flag", "hallucination_check",
]
CONFIG_MODEL_FIELDS = [
    "internal_name", "display_name", "supports_advanced_prompt", "supports_stability_check",
    "supports_hallucination_check",
]


def stock(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in STOCK], "smiles string")


def reaction_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REACTION_CLASSES, "code int, class_id string, name string, scalability int"
    )


def status_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUS_CODES, "code int, description string")


def model_families(spark: SparkSession) -> DataFrame:
    rows = [(m, "json") for m in JSON_ONLY_MODELS] + [(m, "think") for m in THINK_MODELS]
    return spark.createDataFrame(rows, "model string, family string")


def protecting_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROTECTING_GROUPS, "symbol string, name string, text string")


def elements(spark: SparkSession) -> DataFrame:
    rows = [(el, m, w) for el, (_, m, w) in ELEMENTS.items()]
    return spark.createDataFrame(rows, "el string, isotope_mass double, weight double")


def group_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUP_NAMES, "signature string, name string")
