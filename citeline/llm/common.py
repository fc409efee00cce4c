"""What the queries of this subpackage share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def text_digest(column: str) -> Column:
    """SHA-256 of a text's bytes; with the identifier it names a row, as an identifier may be null or stand with several texts."""
    return F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 256))


def fresh(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
