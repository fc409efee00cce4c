"""Manuals to passages, fault records, lexicon and report: one job over all manuals."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.operators import audit, lexicon, lines as L, records as R
from citeline.session import settle


@dataclass
class Extraction:
    """Tables of one extraction run, keyed by manual."""

    chunks: DataFrame
    faults: DataFrame
    lexicon: DataFrame
    rejected: DataFrame
    notes: DataFrame
    report: DataFrame
    missing: DataFrame
    lookalikes: DataFrame
    titles_not_found: DataFrame


def extract(
    manuals: DataFrame, lines: DataFrame, outline: DataFrame, page_counts: DataFrame,
    table_rows: DataFrame | None = None, table_boxes: DataFrame | None = None,
) -> Extraction:
    """``manuals`` is the registry (id, fault_layout, fault_pages, index_pages, safety_pages, …); documents are
    named by manual id. Table manuals bring their detected rows and boxes."""
    kept, printed = L.strip_running_lines(lines)
    kept = settle(kept, "lines")
    spans = F.col("fault_pages.first").alias("first"), F.col("fault_pages.last").alias("last")
    block = manuals.where("fault_layout = 'block'").select(F.col("id").alias("doc_id"), *spans)
    records, rejected, consumed = R.block_faults(kept, block)
    notes = rejected.sparkSession.createDataFrame([], "doc_id string, note string")
    rejected = rejected.select("doc_id", "page", "reason", "raw")
    if table_rows is not None:
        spec = manuals.where("fault_layout = 'table4'").select(F.col("id").alias("doc_id"), *spans)
        within = F.col("page").between(F.col("first"), F.col("last"))
        rows = table_rows.join(spec, "doc_id").where(within).drop("first", "last")
        sections = R.section_of_pages(rows, outline)
        more, refused, table_notes = R.table_faults(rows, sections)
        records = records.unionByName(more)
        rejected = rejected.unionByName(refused.select("doc_id", "page", "reason", "raw"))
        notes = notes.unionByName(table_notes.select("doc_id", "note"))
        boxes = table_boxes.join(spec, "doc_id").where(within).drop("first", "last")
        consumed = consumed.unionByName(R.lines_in_boxes(kept, boxes).select("doc_id", "page", "idx"))
    records, consumed = settle(records, "records"), settle(consumed, "consumed")
    faults = R.dedupe_first(records, ["manual_id", "code_key"], "ord")
    duplicates = R.duplicate_notes(records).withColumnRenamed("manual_id", "doc_id")
    safety = manuals.select(F.col("id").alias("doc_id"), F.explode("safety_pages").alias("page"))
    documents = page_counts.join(manuals.select(F.col("id").alias("doc_id"), F.col("file").alias("name")), "doc_id")
    documents = documents.withColumn("name", F.regexp_replace("name", r"\.[^.]*$", ""))
    sections, lost = L.section_chunks(kept, outline, documents, consumed, safety)
    expected, unparsed = audit.expected_codes(kept, manuals, consumed)
    missing = audit.missing_codes(expected, faults.select(F.col("manual_id").alias("doc_id"), "code_key"))
    report = audit.manual_reports(
        manuals, faults, sections, rejected=rejected, missing=missing, unparsed=unparsed, duplicates=duplicates,
        mismatches=L.page_mismatches(printed),
    )
    return Extraction(
        chunks=sections.unionByName(R.fault_passages(faults)), faults=faults, lexicon=lexicon.build_lexicon(kept, faults),
        rejected=rejected, notes=notes, report=report, missing=missing,
        lookalikes=audit.lookalike_pairs(faults, ["manual_id"]), titles_not_found=lost,
    )
