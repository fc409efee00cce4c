"""Reports arriving as a stream: each micro-batch runs through retrieval and the evidence gate."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.operators.triage import EVIDENCE_THRESHOLD, evidence_gate, validate_reports
from citeline.plans.retrieve import Retrieval, retrieve
from citeline.session import scratch_path


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all data now available in the stream to parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def triage_batch(
    reports: DataFrame, passages: DataFrame, fault_codes: DataFrame, threshold: float = EVIDENCE_THRESHOLD,
    run: Callable[..., Retrieval] = retrieve, **options,
) -> tuple[DataFrame, Retrieval]:
    """(gated questions, retrieval) for one batch of valid reports."""
    found = run(reports, passages, fault_codes, **options)
    coded = found.matches.select("query_id").distinct().withColumn("has_code", F.lit(True))
    state = found.top.join(coded, "query_id", "left").withColumn("has_code", F.coalesce("has_code", F.lit(False)))
    return evidence_gate(state, threshold), found


def start_triage(
    reports: DataFrame, passages: DataFrame, fault_codes: DataFrame, target: str, checkpoint: str,
    threshold: float = EVIDENCE_THRESHOLD, **options,
):
    """Stream of reports (query_id, text) -> gated questions and ranked passages under ``target``.

    Ranking needs windows, which streams do not offer, so it runs per micro-batch. A batch writes its own
    ``batch=`` folder with overwrite, so a batch that is run again after a failure replaces itself.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = validate_reports(batch)
        gated, found = triage_batch(accepted, passages, fault_codes, threshold, **options)
        for name, table in (("gated", gated), ("ranked", found.ranked), ("rejected", rejected)):
            table.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

    return (
        reports.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def shared_run(spark: SparkSession, name: str) -> tuple[str, str]:
    """(target, checkpoint) for one streaming run in the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/state"
