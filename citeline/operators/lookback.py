"""Readings of a machine in the time before a report."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = "30 minutes"  # fixed value


def _within(report_ts: str, reading_ts: str, window: str) -> Column:
    after = F.col(reading_ts) >= F.col(report_ts) - F.expr(f"INTERVAL {window}")
    return after & (F.col(reading_ts) <= F.col(report_ts))


def recent_readings(
    reports: DataFrame, readings: DataFrame, window: str = WINDOW, machine: str = "machine_id",
    report_ts: str = "report_ts", reading_ts: str = "ts",
) -> DataFrame:
    """Reports joined to their machine's readings between report time minus the window and report time.

    Time is cut into slots of the window's length, and a report looks into its own slot and the one before. The
    join is then an equi-join on (machine, slot), so a machine that sends a third of all readings is spread over
    its slots instead of meeting all its reports in one task. A window of months takes slots of the longest such months.
    """
    start = "timestamp'2023-07-01 00:00:00'"
    seconds = F.expr(f"greatest(1, unix_timestamp({start} + INTERVAL {window}) - unix_timestamp({start}) + 1)")  # folded to a constant
    slot = lambda ts: F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    looking = reports.where(F.col(machine).isNotNull()).withColumn(
        "__slot", F.explode(F.array(slot(report_ts), slot(report_ts) - 1))
    )
    joined = looking.join(readings.withColumn("__slot", slot(reading_ts)), [machine, "__slot"])
    return joined.where(_within(report_ts, reading_ts, window)).drop("__slot")


def recent_readings_stream(
    reports: DataFrame, readings: DataFrame, window: str = WINDOW, lateness: str = "10 minutes",
    report_machine: str = "report_machine", machine: str = "machine_id", report_ts: str = "report_ts", reading_ts: str = "ts",
) -> DataFrame:
    """The same join of two streams; state older than the window plus the lateness allowed is dropped."""
    late_reports = reports.where(F.col(report_machine).isNotNull()).withWatermark(report_ts, lateness)
    late_readings = readings.withWatermark(reading_ts, lateness)
    return late_reports.join(
        late_readings, (F.col(report_machine) == F.col(machine)) & _within(report_ts, reading_ts, window)
    )
