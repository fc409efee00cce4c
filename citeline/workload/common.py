"""What the registered queries share: table access and codes derived from keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code_of(key: Column) -> Column:
    """A code derived from a number: hex digits, with A-C written as O, I, S so that look-alikes occur."""
    return F.concat(F.lit("F"), F.translate(F.hex(key.cast("long")), "ABC", "OIS"))


CODE_SQL = "('F' || translate(upper(to_hex({k})), 'ABC', 'OIS'))"

# White space as the column expressions see it, in the SQL engine's regex dialect.
SPACE_SQL = r"[\s\v\p{Z}\x{85}\x1c-\x1f]"
