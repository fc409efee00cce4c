"""Extraction audit: which codes a manual announces, which were extracted, and what a person must look at."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.functions.identifiers import code_key, lookalike_key, strip
from citeline.operators.lines import CODE_FONT, LEADER

# The index line, the heading-like line, the edge of the code column, heading size.
INDEX_LINE = r"(?U)^\[([^\]]+)\]\s+([A-Za-z0-9][A-Za-z0-9.\-]*?)\s*\.{2,}\s*(\d+)\s*$"
HEADING_LINE = r"(?U)^\[[^\]]+\]\s+(\S{2,6})$"
CODE_COLUMN = 0.2
HEADING_SIZE = 15
UNCHECKED_LEADER = "Overview"


def index_codes(lines: DataFrame, index_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected codes, unparsed leader lines) of index pages. ``index_pages``: doc_id, first, last."""
    inside = lines.join(index_pages, "doc_id").where(F.col("page").between(F.col("first"), F.col("last")))
    code = F.regexp_extract("text", INDEX_LINE, 2)
    expected = inside.where(F.col("text").rlike(INDEX_LINE)).select(
        "doc_id", code_key(code).alias("code_key"), code.alias("code"), "pos"
    )
    unparsed = inside.where(
        ~F.col("text").rlike(INDEX_LINE) & F.col("text").rlike(LEADER) & ~F.col("text").startswith(UNCHECKED_LEADER)
    ).select("doc_id", "pos", F.format_string("p%d: %s", "page", "text").alias("note"))
    return expected, unparsed


def table_column_codes(lines: DataFrame, consumed: DataFrame) -> DataFrame:
    first = F.get("spans", F.lit(0))
    owned = lines.join(consumed.select("doc_id", "page", "idx"), ["doc_id", "page", "idx"], "left_semi")
    return owned.where((F.col("x0") < F.col("page_w") * CODE_COLUMN) & first["font"].rlike(CODE_FONT)).select(
        "doc_id", code_key(first["text"]).alias("code_key"), strip(first["text"]).alias("code"), "pos"
    ).where("code_key <> ''")


def heading_codes(lines: DataFrame, fault_pages: DataFrame) -> DataFrame:
    inside = lines.join(fault_pages, "doc_id").where(F.col("page").between(F.col("first"), F.col("last")))
    first = F.get("spans", F.lit(0))
    code = F.regexp_extract("text", HEADING_LINE, 1)
    return inside.where(
        F.col("text").rlike(HEADING_LINE) & first["font"].contains("Bold") & (first["size"] >= HEADING_SIZE)
    ).select("doc_id", code_key(code).alias("code_key"), code.alias("code"), "pos")


def expected_codes(lines: DataFrame, manuals: DataFrame, consumed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected, unparsed): index pages where given, else the table column for table manuals, else headings."""
    span = lambda c: [F.col("id").alias("doc_id"), F.col(f"{c}.first").alias("first"), F.col(f"{c}.last").alias("last")]
    indexed, unparsed = index_codes(lines, manuals.where("index_pages is not null").select(*span("index_pages")))
    rest = manuals.where("index_pages is null")
    tables = rest.where("fault_layout = 'table4'").select(F.col("id").alias("doc_id"))
    column = table_column_codes(lines.join(tables, "doc_id", "left_semi"), consumed)
    headings = heading_codes(lines, rest.where("fault_layout <> 'table4'").select(*span("fault_pages")))
    found = indexed.unionByName(column).unionByName(headings)
    # The last spelling of a key in reading order is the one reported.
    return found.groupBy("doc_id", "code_key").agg(F.max_by("code", "pos").alias("code")), unparsed


def missing_codes(expected: DataFrame, extracted: DataFrame, manual: str = "doc_id") -> DataFrame:
    return expected.join(extracted.select(manual, "code_key").distinct(), [manual, "code_key"], "left_anti")


def lookalike_pairs(codes: DataFrame, group: list[str], key: str = "code_key") -> DataFrame:
    """Pairs of different keys that look the same, smaller key first.

    Keys sharing a look-alike key number at most 64, so the self-join stays small per key whatever the data.
    """
    keys = codes.select(*group, key).distinct().withColumn("fold", lookalike_key(F.col(key)))
    other = keys.withColumnRenamed(key, "other")
    return keys.join(other, [*group, "fold"]).where(F.col(key) < F.col("other")).select(
        *group, F.concat_ws("~", key, "other").alias("pair")
    )


def manual_reports(manuals: DataFrame, faults: DataFrame, chunks: DataFrame, **findings: DataFrame) -> DataFrame:
    """One row per manual with its counts and problem list.

    Findings are tables with a ``doc_id`` each: rejected, missing, unparsed, duplicates, mismatches.
    """
    report = manuals.select(F.col("id").alias("doc_id"))
    counts = [
        faults.groupBy(F.col("manual_id").alias("doc_id")).agg(F.count("*").alias("fault_records")),
        chunks.groupBy(F.col("manual_id").alias("doc_id")).agg(
            F.count_if(F.col("kind") == "section").alias("section_chunks"),
            F.count_if(F.col("kind") == "safety").alias("safety_chunks"),
        ),
    ]
    kinds = ("rejected", "missing", "unparsed", "duplicates", "mismatches")
    for kind in kinds:
        if kind in findings:
            counts.append(findings[kind].groupBy("doc_id").agg(F.count("*").alias(kind)))
    for table in counts:
        report = report.join(table, "doc_id", "left")
    absent = [k for k in kinds if k not in findings]
    report = report.withColumns({k: F.lit(None).cast("long") for k in absent}).na.fill(0)
    says = lambda kind, words: F.when(F.col(kind) > 0, F.format_string(f"%d {words}", kind))
    problems = F.array_compact(F.array(
        says("rejected", "rejected fault rows"),
        says("missing", "codes expected but not extracted"),
        says("unparsed", "unparsed index lines"),
        says("duplicates", "duplicate codes"),
        says("mismatches", "printed page numbers differ from PDF pages"),
        F.when(F.col("safety_chunks") == 0, F.lit("no safety chunk on the configured safety pages")),
    ))
    return report.withColumn("problems", problems)
