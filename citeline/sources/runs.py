"""Snapshots of extractions and evaluation runs, written and read as JSON."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("manual_id", "kind").agg(F.count("*").alias("n"))


def save_extraction(chunks: DataFrame, faults: DataFrame, report: DataFrame, path: str) -> None:
    """Faults, counts per passage kind and the report, as JSON tables keyed by manual."""
    chunk_counts(chunks).write.mode("overwrite").json(f"{path}/chunk_counts")
    faults.write.mode("overwrite").json(f"{path}/faults")
    report.write.mode("overwrite").json(f"{path}/report")


def save_run(results: DataFrame, summary: DataFrame, config: DataFrame, scorecard: DataFrame, path: str) -> None:
    """A run under its own path; an existing run is never overwritten."""
    for name, table in (("results", results), ("summary", summary), ("config", config), ("scorecard", scorecard)):
        table.write.mode("errorifexists").json(f"{path}/{name}")


def load_run(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(summary, results); the last line of a duplicated id wins."""
    results = spark.read.schema(schema).json(f"{path}/results")
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = results.select("*", order.alias("__at"))
    rest = [c for c in results.columns if c != "id"]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "__at").alias("r")).select("id", "r.*")
    return spark.read.schema("metric string, value double, n long").json(f"{path}/summary"), last
