"""Judgements against what was retrieved and answered: one wide result row per judgement."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.operators import evaluate as E, triage


def expected_pages(scenarios: DataFrame) -> DataFrame:
    """(query_id, manual, page); an expected manual without pages keeps a row, so something is expected."""
    sources = scenarios.select(F.col("id").alias("query_id"), F.explode("expected_sources").alias("s"))
    return sources.select("query_id", F.col("s.manual").alias("manual"), F.explode_outer("s.pages").alias("page"))


def score_retrieval(scenarios: DataFrame, sources: DataFrame, detected: DataFrame, top: DataFrame, k: int = 5) -> DataFrame:
    """id, type, reviewed, top_score, hit_at_5, code_match.

    sources: query_id, n, manual_id, page_start, page_end, score (NULL for added safety passages, which do not
    count); detected: query_id, code; top: query_id, top_score. Codes are scored for code questions only.
    """
    asked = scenarios.withColumn("query_id", F.col("id"))
    retrieved = sources.where("score is not null").select(
        "query_id", F.col("n").alias("pos"), F.col("manual_id").alias("manual"), "page_start", "page_end"
    )
    hits = E.hit_at_k(expected_pages(scenarios), retrieved, asked, k).withColumnRenamed("hit", "hit_at_5")
    coded = asked.where("type = 'fault_code'").select("query_id", F.explode("expected_fault_codes").alias("code"))
    matched = E.code_match(coded, detected, asked).withColumnRenamed("matched", "code_match")
    return (
        asked.select("query_id", "type", "reviewed").join(top.select("query_id", F.bround("top_score", 3).alias("top_score")), "query_id", "left")
        .join(hits, "query_id").join(matched, "query_id").withColumnRenamed("query_id", "id")
    )


def score_answers(
    scenarios: DataFrame, retrieval: DataFrame, sources: DataFrame, answered: DataFrame, escalated: DataFrame,
    decided: DataFrame, known: DataFrame, expected_vectors: DataFrame, answer_vectors: DataFrame,
    threshold: float = E.CAUSE_THRESHOLD,
) -> DataFrame:
    """The full result table: ``retrieval`` (from ``score_retrieval``) plus everything scored on the response.

    Judgements without a response get ``error``. expected_vectors: query_id, n, text, vector; answer_vectors:
    query_id, rank, text, vector.
    """
    asked = scenarios.select(F.col("id").alias("query_id"), "expected_behavior")
    status = answered.select("query_id", "status").unionByName(escalated.select("query_id", "status"))
    in_scope = asked.where("expected_behavior = 'diagnose'")
    causes, _ = E.cause_at_3(expected_vectors, answer_vectors, in_scope, threshold)
    cited = answered.select("query_id", F.explode(F.concat(
        F.flatten(F.transform("probable_causes", lambda c: F.transform(c["citations"], lambda x: x["source_id"]))),
        F.flatten(F.transform("corrective_actions", lambda c: F.transform(c["citations"], lambda x: x["source_id"]))),
    )).alias("source_id")).join(in_scope, "query_id", "left_semi")
    refs = sources.select("query_id", "source_id", F.col("manual_id").alias("manual"), "page_start", "page_end", "kind")
    citations = E.citation_accuracy(cited, refs, expected_pages(scenarios))
    part = lambda column, field: F.transform(column, lambda x: x[field])
    texts = answered.select("query_id", F.array_join(F.concat(
        part("probable_causes", "cause"), F.array_compact(part("probable_causes", "fault_code")),
        part("corrective_actions", "action"), part("safety_warnings", "text"),
    ), "\n").alias("text"))
    scopes = sources.select("query_id", "manual_id").distinct()
    unknown = triage.unknown_identifiers(texts, scopes, known, ["query_id"])
    flags = E.hallucination_flags(status, unknown, decided.select("query_id", F.col("first_pass_violations").alias("violations")))
    rows = (
        asked.join(status, "query_id", "left").join(causes, "query_id", "left").join(citations, "query_id", "left")
        .join(flags, "query_id", "left")
    )
    outcome = E.refusal_flags(F.col("expected_behavior"), F.col("status"))
    scored = rows.select(
        F.col("query_id").alias("id"), "status", F.when(F.col("status").isNotNull(), F.col("cause_at_3")).alias("cause_at_3"),
        F.coalesce("correct", F.lit(0)).alias("citations_correct"), F.coalesce("total", F.lit(0)).alias("citations_total"),
        "raw_hallucination", "final_hallucination", *[c.alias(name) for name, c in outcome.items()],
        F.when(F.col("status").isNull(), F.lit("no response")).alias("error"),
    )
    return retrieval.join(scored, "id").withColumns({"translation_fallbacks": F.lit(0), "translation_total": F.lit(0)})
