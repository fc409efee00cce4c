"""A table of reports to answers or escalations, in two jobs around the model call.

``prepare`` writes what the model needs; ``judge`` takes the model's answers, two attempts at most, and decides.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.operators import lexicon, triage
from citeline.operators.lookback import recent_readings
from citeline.plans.retrieve import Retrieval, retrieve
from citeline.session import settle


@dataclass
class Prepared:
    """Long tables keyed by ``query_id``."""

    questions: DataFrame  # accepted and covered, with scope
    rejected: DataFrame  # invalid reports and unknown machines, with a reason
    uncovered: DataFrame  # (query_id, text, machine_id, reason): only models without a manual were named
    retrieval: Retrieval
    sources: DataFrame
    state: DataFrame  # (query_id, has_code, top_score, gate_reason)
    contexts: DataFrame  # (query_id, context) for questions that pass the gate


def prepare(
    reports: DataFrame, machines: DataFrame, manuals: DataFrame, passages: DataFrame, fault_codes: DataFrame,
    patterns: Sequence[tuple[str, str | None]], threshold: float = triage.EVIDENCE_THRESHOLD,
    readings: DataFrame | None = None, **options,
) -> Prepared:
    """reports: query_id, text, machine_id [, report_ts, rewrite, code_text]; passages also carry page_start and
    page_end. ``readings`` (machine_id, ts, signal, value, unit) need ``report_ts``."""
    valid, invalid = triage.validate_reports(reports)
    named = lexicon.named_models(valid, patterns)
    scoped, uncovered, unknown = triage.resolve_scope(valid, machines, named, lexicon.model_manuals(manuals))
    questions = settle(scoped, "questions")
    coverage = F.lit(triage.coverage_text(manuals).first()["coverage"])  # one sentence naming the registered manuals
    uncovered = uncovered.select("query_id", "text", "machine_id", triage.uncovered_reason(F.col("models"), coverage).alias("reason"))
    rejected = invalid.select("query_id", "reason").unionByName(unknown.select("query_id", F.lit("unknown machine").alias("reason")))
    found = retrieve(questions, passages, fault_codes, **options)
    sources = settle(triage.number_sources(found.ranked, passages, manuals, questions.select("query_id", "scope")), "sources")
    coded = found.matches.select("query_id").distinct().withColumn("has_code", F.lit(True))
    state = found.top.join(coded, "query_id", "left").withColumn("has_code", F.coalesce("has_code", F.lit(False)))
    state = settle(triage.evidence_gate(state, threshold), "state")
    # Gated questions leave here and never reach the model.
    open_ = questions.join(state.where("gate_reason is null"), "query_id", "left_semi")
    family = manuals.select(F.col("id").alias("machine_manual"), "family")
    labelled = open_.join(family, "machine_manual", "left").withColumn(
        "machine", F.when(F.col("family").isNotNull(), F.format_string("%s (%s)", "machine_id", "family")).otherwise(F.col("machine_id"))
    )
    line = triage.code_line(F.col("code"), F.col("manual_id"), F.col("page"), F.col("fuzzy"), F.col("token"))
    recent = None if readings is None else recent_readings(open_.select("query_id", "machine_id", "report_ts"), readings)
    contexts = triage.build_contexts(
        labelled.select("query_id", "text", "machine"), sources, found.matches.select("query_id", "ord", line.alias("line")), recent
    )
    return Prepared(questions, rejected, uncovered, found, sources, state, contexts)


@dataclass
class Judged:
    """Every question of ``Prepared`` (covered or not) is in exactly one of the first three tables."""

    answered: DataFrame
    escalated: DataFrame
    retry: DataFrame  # (query_id, attempt, repair): ask once more, with the violations to repair
    decided: DataFrame  # one row per question the model answered


def judge(prepared: Prepared, answers: DataFrame, known: DataFrame, last: bool = False) -> Judged:
    """Outcomes of all questions. ``answers``: query_id, attempt, answer_json; ``known`` as in
    ``lexicon.known_identifiers``. Questions the model gave nothing for escalate; so do those without a second attempt
    if this is the ``last`` call."""
    asked = answers.join(prepared.state.where("gate_reason is null"), "query_id", "left_semi")
    parsed = settle(triage.parse_answers(asked), "parsed")
    audited = triage.audit_answers(parsed, prepared.sources, known, carry=("answer",))
    decided = settle(triage.decide(audited), "decided")
    answered = triage.assemble_answers(decided, prepared.state, prepared.sources)
    retry = decided.where("repair is not null").select("query_id", (F.col("attempt") + 1).alias("attempt"), "repair")
    silent = prepared.state.where("gate_reason is null").join(decided, "query_id", "left_anti").select("query_id")
    if last:
        silent, retry = silent.unionByName(retry.select("query_id")), retry.limit(0)
    reasons = (
        decided.where("reason is not null").select("query_id", "reason")
        .unionByName(silent.withColumn("reason", F.lit(triage.NO_ANSWER)))
        .unionByName(prepared.uncovered.select("query_id", "reason"))
        .unionByName(prepared.state.where("gate_reason is not null").select("query_id", F.col("gate_reason").alias("reason")))
    )
    reported = prepared.questions.select("query_id", "text", "machine_id").unionByName(prepared.uncovered.drop("reason"))
    escalated = triage.escalations(reasons, reported, prepared.retrieval.matches, prepared.sources)
    return Judged(answered, escalated, retry, decided)
