"""Stored tables of manuals: incremental, replaceable, readable by id.

Chunks, fault codes and lexicon are partitioned by (manual_id, sha256). A write fills the partitions of the
manuals it brings and leaves all others alone; running it again replaces the same partitions. The small ``manuals``
table says which sha256 of each manual is current. It is written last, as a new version, and readers join to it: a
reader sees the whole old or the whole new state of a manual, across all tables.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

TABLES = ("chunks", "fault_codes", "lexicon")


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/manuals")
    except AnalysisException:  # nothing stored yet
        return None


def _newest(versions: DataFrame | None) -> int:
    return 0 if versions is None else versions.agg(F.max("version")).first()[0]


def current_manuals(spark: SparkSession, root: str) -> DataFrame | None:
    versions = _versions(spark, root)
    return None if versions is None else versions.where(F.col("version") == _newest(versions)).drop("version")


def plan_ingest(incoming: DataFrame, stored: DataFrame | None, force: bool = False) -> DataFrame:
    """(id, sha256, status): ``unchanged`` where the stored hash is the same, else ``ingested``."""
    if force or stored is None:
        return incoming.select("id", "sha256", F.lit("ingested").alias("status"))
    have = stored.select("id", F.col("sha256").alias("stored_sha"))
    same = F.col("sha256").eqNullSafe(F.col("stored_sha"))
    return incoming.join(have, "id", "left").select(
        "id", "sha256", F.when(same, F.lit("unchanged")).otherwise(F.lit("ingested")).alias("status")
    )


def check_embedded(chunks: DataFrame, embeddings: DataFrame) -> None:
    """Every chunk has exactly one embedding and the other way round; otherwise nothing is written."""
    left = chunks.groupBy("manual_id").agg(F.count("*").alias("chunks"))
    right = embeddings.groupBy("manual_id").agg(F.count("*").alias("embeddings"))
    both = left.join(right, "manual_id", "full").na.fill(0)
    wrong = both.where("chunks <> embeddings").limit(3).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.manual_id}: {r.chunks} chunks but {r.embeddings} embeddings" for r in wrong))


def replace_manuals(
    spark: SparkSession, root: str, manuals: DataFrame, chunks: DataFrame, fault_codes: DataFrame, lexicon: DataFrame
) -> None:
    """Replace the given manuals in all tables. ``chunks`` carries its embeddings."""
    keys = manuals.select(F.col("id").alias("manual_id"), "sha256")
    for name, table in zip(TABLES, (chunks, fault_codes, lexicon)):
        rows = table.join(keys, "manual_id")
        # Rebalancing gathers small manuals into few files and splits a hot one over several tasks.
        spread = rows.hint("rebalance", "manual_id", "sha256")
        (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("manual_id", "sha256").parquet(f"{root}/{name}"))
    newest = _newest(_versions(spark, root))
    old = current_manuals(spark, root)
    stamped = manuals.withColumn("ingested_at", F.current_timestamp())
    if old is not None:
        kept = old.join(manuals.select("id"), "id", "left_anti")
        stamped = kept.unionByName(stamped, allowMissingColumns=True)
    stamped.write.parquet(f"{root}/manuals/version={newest + 1}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of the current state; superseded partitions are pruned by the join."""
    current = current_manuals(spark, root).select(F.col("id").alias("manual_id"), "sha256")
    # the key keeps its type: read from folder names, "007" would become a number
    kinds = {f.name: f.dataType for f in current.schema}
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in spark.read.parquet(f"{root}/{name}").schema])
    return spark.read.schema(schema).parquet(f"{root}/{name}").join(current, ["manual_id", "sha256"], "left_semi").drop("sha256")


def passages_by_id(ids: DataFrame, chunks: DataFrame, manuals: DataFrame) -> DataFrame:
    """The passages behind a list of ids, with the names of their manuals; unknown ids are silently absent."""
    names = manuals.select(F.col("id").alias("manual_id"), "family", "title")
    found = chunks.join(ids.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    return found.join(names, "manual_id", "left").select(
        F.col("id").alias("chunk_id"), F.col("manual_id").alias("manual"),
        F.coalesce("family", "manual_id").alias("family"), F.coalesce("title", "manual_id").alias("title"),
        F.col("heading_path").alias("heading"), "page_start", "page_end", "kind", "text",
    )
