"""Registries of manuals, machines and judgements, with their checks; content fingerprints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "struct<first:int,last:int>"
MANUALS = (
    f"id string, family string, title string, doc_ref string, version string, file string, url string, sha256 string,"
    f" fault_layout string, fault_pages {RANGE}, index_pages {RANGE}, safety_pages array<int>, models array<string>"
)
MACHINES = "id string, manual string, description string"
SCENARIOS = (
    "id string, type string, query string, machine_id string, expected_behavior string,"
    " expected_fault_codes array<string>, expected_causes array<string>,"
    " expected_sources array<struct<manual:string,pages:array<int>>>, reviewed boolean, notes string,"
    " source_url string, reference_answer string"
)
LAYOUTS = ("block", "table4")
SCENARIO_TYPES = ("fault_code", "symptom", "out_of_scope")
BEHAVIORS = ("diagnose", "escalate")


class RegistryError(ValueError):
    """A registry breaks one of its rules."""


def _few(rows: DataFrame, column: str, n: int = 5) -> list[str]:
    return [str(r[0]) for r in rows.select(column).limit(n).collect()]


def refuse(rows: DataFrame, column: str, message: str) -> None:
    """Raise when any row breaks a rule, naming the first few."""
    found = _few(rows, column)
    if found:
        raise RegistryError(f"{message}: {', '.join(found)}")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").orderBy(key)


def check_manuals(manuals: DataFrame) -> DataFrame:
    refuse(duplicates(manuals, "id"), "id", "duplicate manual ids")
    refuse(manuals.where(F.col("id").isNull() | ~F.col("fault_layout").isin(*LAYOUTS)), "id", "unknown fault layout")
    return manuals


def check_machines(machines: DataFrame, manuals: DataFrame) -> DataFrame:
    known = manuals.select(F.col("id").alias("manual"))
    refuse(machines.join(known, "manual", "left_anti"), "id", "machines refer to unknown manuals")
    refuse(duplicates(machines, "id"), "id", "duplicate machine ids")
    return machines


def check_scenarios(scenarios: DataFrame) -> DataFrame:
    refuse(duplicates(scenarios, "id"), "id", "duplicate scenario ids")
    wrong = ~F.col("type").isin(*SCENARIO_TYPES) | ~F.col("expected_behavior").isin(*BEHAVIORS) | F.col("query").isNull()
    refuse(scenarios.where(F.coalesce(wrong, F.lit(True))), "id", "scenarios with an unknown type or behaviour")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return scenarios.withColumns({
        "expected_fault_codes": none("expected_fault_codes", "array<string>"),
        "expected_causes": none("expected_causes", "array<string>"),
        "expected_sources": none("expected_sources", "array<struct<manual:string,pages:array<int>>>"),
        "reviewed": F.coalesce("reviewed", F.lit(False)),
    })


def load_manuals(spark: SparkSession, path: str) -> DataFrame:
    return check_manuals(spark.read.schema(MANUALS).json(path))


def load_machines(spark: SparkSession, path: str, manuals: DataFrame) -> DataFrame:
    return check_machines(spark.read.schema(MACHINES).json(path), manuals)


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return check_scenarios(spark.read.schema(SCENARIOS).json(path))


# --- fingerprints (A4) ------------------------------------------------------------------------------------------


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def file_fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, sha256) of the files in a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), fingerprint(F.col("content")).alias("sha256"))


def manifest_status(manifest: DataFrame, stored: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """(id, status): ``present`` where the stored hash agrees; else, of what was fetched, ``downloaded`` or
    ``checksum-mismatch``; ``missing`` where nothing is on hand.

    manifest: id, sha256; stored and fetched: id, sha256.
    """
    joined = manifest.select("id", F.col("sha256").alias("want")).join(
        stored.select("id", F.col("sha256").alias("have")), "id", "left"
    )
    again = (fetched if fetched is not None else stored).select("id", F.col("sha256").alias("got"))
    joined = joined.join(again, "id", "left")
    status = (
        F.when(F.col("have").eqNullSafe(F.col("want")), F.lit("present"))
        .when(F.col("got").isNull(), F.lit("missing"))
        .when(F.col("got") == F.col("want"), F.lit("downloaded"))
        .otherwise(F.lit("checksum-mismatch"))
    )
    return joined.select("id", status.alias("status"))
