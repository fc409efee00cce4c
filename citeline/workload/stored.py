"""Registered queries: ingest, stored tables, lookback and streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.operators.lookback import recent_readings, recent_readings_stream
from citeline.session import scratch_path
from citeline.sources import registry, runs, store
from citeline.streaming import reports as stream
from citeline.workload.common import table
from citeline.workload.retrieval import HYBRID_SQL, hybrid_faults, passages


def fingerprint_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against a stored copy in which French texts changed and Spanish ones are missing."""
    docs = table(spark, sf, "documents")
    incoming = docs.select(F.col("doc_id").alias("id"), registry.fingerprint(F.col("text")).alias("sha256"))
    changed = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored = docs.where("lang <> 'es'").select(F.col("doc_id").alias("id"), registry.fingerprint(changed).alias("sha256"))
    plan = store.plan_ingest(incoming, stored)
    status = registry.manifest_status(incoming, stored).withColumnRenamed("status", "file_status")
    return plan.join(status, "id").select("id", "sha256", "status", "file_status")


FINGERPRINT_SQL = """select doc_id as id, sha256(text) as sha256, case when lang in ('fr', 'es') then 'ingested' else 'unchanged' end as status,
  case lang when 'fr' then 'checksum-mismatch' when 'es' then 'missing' else 'present' end as file_status from documents"""


def replace_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """Sources stored as manuals; everything replaced a second time, English-only sources' chunks with new content."""
    root = scratch_path(spark, "store")
    docs = table(spark, sf, "documents")

    def put(rows: DataFrame, version: str) -> None:
        chunks = rows.select(
            F.col("source").alias("manual_id"), F.concat_ws(":", "source", "doc_id").alias("id"),
            F.col("lang").alias("kind"), "text",
        )
        manuals = rows.groupBy(F.col("source").alias("id")).agg(
            F.sha2(F.concat(F.lit(version), F.count("*").cast("string")), 256).alias("sha256"), F.count("*").alias("page_count")
        )
        faults = chunks.where("kind = 'de'").select("manual_id", "id", F.length("text").alias("page"), "kind")
        lexicon = chunks.where("kind = 'fr'").select("manual_id", "id", "kind")
        store.replace_manuals(spark, root, manuals, chunks, faults, lexicon)

    put(docs, "first")
    put(docs, "first")  # the same content again: nothing doubles
    put(docs.where("lang <> 'es'"), "second")  # new content: old rows disappear from view
    counts = [
        store.read_table(spark, root, name).groupBy("manual_id").agg(F.count("*").alias("n")).withColumn("tbl", F.lit(name))
        for name in store.TABLES
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


REPLACE_SQL = """select source as manual_id, count(*) as n, 'chunks' as tbl from documents where lang <> 'es' group by 1
union all select source, count(*), 'fault_codes' from documents where lang = 'de' group by 1
union all select source, count(*), 'lexicon' from documents where lang = 'fr' group by 1"""


def passage_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Passages behind the ids cited in labels, some of which do not exist."""
    docs = table(spark, sf, "documents")
    chunks = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("manual_id"), F.col("lang").alias("heading_path"),
        F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("section").alias("kind"), "text",
    )
    manuals = docs.where("source < 'src2'").select(
        F.col("source").alias("id"), F.upper("source").alias("family"), F.initcap("source").alias("title")
    ).distinct()
    ids = table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("chunk_id"))
    found = store.passages_by_id(ids, chunks, manuals)
    return found.select("chunk_id", "manual", "family", "title", F.md5("text").alias("digest"))


FETCH_SQL = """select doc_id as chunk_id, source as manual, case when source < 'src2' then upper(source) else source end as family,
  case when source < 'src2' then 'Src' || source[4:] else source end as title, md5(text) as digest
from documents where doc_id in (select doc_id * 2 from labels)"""


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("manual_id"), F.col("lang").alias("kind"))
    return runs.chunk_counts(docs)


COUNTS_SQL = "select source as manual_id, lang as kind, count(*) as n from documents group by 1, 2"


def _reports_and_readings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    errors = events.where("event_type = 'error'").select(
        F.col("event_id").alias("report_id"), F.col("user_id").alias("machine_id"), F.col("ts").alias("report_ts")
    )
    return errors, events.select(F.col("user_id").alias("machine_id"), "ts", F.col("event_id").alias("reading_id"), "value")


def lookback(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as reports, all events of the same user in the day before as readings."""
    errors, readings = _reports_and_readings(spark, sf)
    return recent_readings(errors, readings, "1 day").select("report_id", "reading_id", "value")


LOOKBACK_SQL = """select e.event_id as report_id, r.event_id as reading_id, r.value from events e join events r on e.user_id = r.user_id
  and r.ts between e.ts - interval {w} and e.ts where e.event_type = 'error'"""


def lookback_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The default 30-minute window over two streams, run over all that is available."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema

    def events() -> DataFrame:
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))

    errors = events().where("event_type = 'error'").select(
        F.col("event_id").alias("report_id"), F.col("user_id").alias("report_machine"), F.col("ts").alias("report_ts")
    )
    readings = events().select(F.col("user_id").alias("machine_id"), "ts", F.col("event_id").alias("reading_id"), "value")
    joined = recent_readings_stream(errors, readings).select("report_id", "reading_id", "value")
    target, state = stream.shared_run(spark, "lookback")
    stream.run_available(joined, target, state)
    return spark.read.schema("report_id long, reading_id long, value double").parquet(target)


def report_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items arriving as a stream of reports, each micro-batch retrieved and gated."""
    schema = spark.read.parquet(f"{sf}/benchmark.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "benchmark.parquet").parquet(sf)
    arriving = arriving.select(F.col("item_id").alias("query_id"), "text")
    target, state = stream.shared_run(spark, "reports")
    stream.start_triage(arriving, passages(spark, sf), hybrid_faults(spark, sf), target, state, threshold=0.6).awaitTermination()
    gated = spark.read.parquet(f"{target}/gated")
    ranked = spark.read.parquet(f"{target}/ranked").groupBy("query_id").agg(F.count("*").alias("passages"))
    return gated.join(ranked, "query_id").select(
        "query_id", "has_code", F.round("top_score", 9).alias("top_score"), F.col("gate_reason").isNotNull().alias("gated"), "passages"
    )


def _plain_retrieval_sql() -> str:
    """The hybrid SQL for plain reports: no codes appended, no rewrites."""
    start = HYBRID_SQL.index("  union all select query_id, 1, rewrite")
    sql = HYBRID_SQL[:start].rstrip() + HYBRID_SQL[HYBRID_SQL.index("),\nterms as", start):]
    for old, new in (
        ("text || ' ' || code as txt", "text as txt"), ("where not fuzzy or not exists", "where false and not exists"),
        ("variant = 1 qualify", "variant = 0 qualify"),
    ):
        assert old in sql
        sql = sql.replace(old, new)
    return sql


REPORT_SQL = f"""select query_id, false as has_code, any_value(top_score) as top_score, any_value(top_score) < 0.6 as gated, count(*) as passages
from ({_plain_retrieval_sql()}) group by query_id"""


QUERIES = {
    "fingerprint_diff": (fingerprint_diff, FINGERPRINT_SQL),
    "replace_idempotent": (replace_idempotent, REPLACE_SQL),
    "passage_fetch": (passage_fetch, FETCH_SQL),
    "chunk_counts": (chunk_counts, COUNTS_SQL),
    "lookback": (lookback, LOOKBACK_SQL.format(w="1 day")),
    "lookback_stream": (lookback_stream, LOOKBACK_SQL.format(w="30 minutes")),
    "report_stream": (report_stream, REPORT_SQL),
}
