"""Small code tables used by the region and continent analyses.

Country codes are FIPS 10-4, not ISO 3166: UK is the United Kingdom, GM Germany,
CH China, RS Russia, SP Spain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Country code to world region.
REGIONS = {
    "US": "North America", "CA": "North America", "MX": "North America",
    "BR": "South America", "AR": "South America", "CO": "South America",
    "UK": "Europe", "FR": "Europe", "GM": "Europe", "IT": "Europe", "SP": "Europe",
    "RS": "Europe/Asia", "UP": "Europe", "PO": "Europe",
    "CH": "Asia", "JA": "Asia", "IN": "Asia", "KS": "Asia", "PK": "Asia",
    "IR": "Middle East", "IZ": "Middle East", "SA": "Middle East", "IS": "Middle East",
    "NI": "Africa", "ET": "Africa", "KE": "Africa", "SF": "Africa", "EG": "Africa",
    "AS": "Oceania", "NZ": "Oceania",
}

# Country code to continent.
CONTINENTS = {
    "US": "Americas", "CA": "Americas", "MX": "Americas", "BR": "Americas",
    "UK": "Europe", "FR": "Europe", "GM": "Europe", "RS": "Europe",
    "CH": "Asia", "IN": "Asia", "JA": "Asia",
    "NI": "Africa", "SF": "Africa", "EG": "Africa",
    "AS": "Oceania",
}

# Event root code to label.
ROOT_CODE_LABELS = {
    "01": "Declaraciones públicas",
    "02": "Apelaciones",
    "03": "Expresar intención",
    "04": "Consultar",
    "05": "Diplomacia",
    "06": "Cooperar materialmente",
    "07": "Dar ayuda",
    "08": "Ceder",
    "09": "Investigar",
    "10": "Exigir",
    "11": "Rechazar",
    "12": "Acusar",
    "13": "Amenazar",
    "14": "Protestas",
    "15": "Obstruir",
    "16": "Coerción",
    "17": "Asalto",
    "18": "Ataque",
    "19": "Violencia masiva",
    "20": "Uso de armas no convencionales",
}


def code_table(spark: SparkSession, entries: dict[str, str], code: str, label: str) -> DataFrame:
    """Two-column table of a fixed mapping, held inline in the plan."""
    rows = ", ".join(f"({_literal(key)}, {_literal(value)})" for key, value in entries.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS codes({code}, {label})")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_label(
    df: DataFrame,
    on: str,
    label: str,
    fixed: dict[str, str],
    lookup: DataFrame | None = None,
    missing: str | None = None,
) -> DataFrame:
    """Left-join a code table on ``on`` and fill codes it does not know with ``missing``.

    The built-in mappings have at most a few dozen rows and are broadcast. A caller's own
    ``lookup`` has no known bound, so Spark chooses its join from the measured size.
    """
    if lookup is None:
        right = F.broadcast(code_table(df.sparkSession, fixed, "_code", label))
    else:
        code, value = lookup.columns
        right = lookup.select(F.col(code).alias("_code"), F.col(value).alias(label))
    joined = df.join(right, df[on] == right["_code"], "left").drop("_code")
    return joined if missing is None else joined.fillna({label: missing})

