"""Scoring of retrieved sources and answers against judgements; summaries and run comparison."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions.identifiers import code_key, lookalike_key
from citeline.functions.text import fixed
from citeline.session import settle

# Thresholds, metric labels, compared outcome fields, percentiles.
CAUSE_THRESHOLD = 0.65
METRICS = {
    "retrieval_hit_at_5": "Retrieval hit@5",
    "fault_code_match": "Fault code detected",
    "cause_in_top_3": "Correct cause in top 3",
    "citation_accuracy": "Citation accuracy",
    "hallucination_raw": "Hallucination (before guard)",
    "hallucination_final": "Hallucination (final answer)",
    "out_of_scope_refusal": "Correct out-of-scope refusal",
    "false_escalation": "False escalation (in scope)",
    "translation_fallback": "Translation shown in English",
}
RATES = {
    "retrieval_hit_at_5": "hit_at_5", "fault_code_match": "code_match", "cause_in_top_3": "cause_at_3",
    "hallucination_raw": "raw_hallucination", "hallucination_final": "final_hallucination",
    "out_of_scope_refusal": "refusal_correct", "false_escalation": "false_escalation",
}
FLIP_FIELDS = (
    "hit_at_5", "code_match", "status", "cause_at_3", "refusal_correct", "false_escalation", "final_hallucination",
)


# --- per-question scores (I1-I7) --------------------------------------------------------------------------------


def hit_at_k(expected: DataFrame, retrieved: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit): is an expected page covered within the first k? NULL where nothing is expected.

    expected: query_id, manual, page; retrieved: query_id, pos, manual, page_start, page_end. A question that
    expects a manual but no page counts as expecting something: give it a row with a NULL page.
    """
    top = retrieved.where(F.col("pos") <= k)
    on = (
        (F.col("e.query_id") == F.col("r.query_id")) & (F.col("e.manual") == F.col("r.manual"))
        & F.col("e.page").between(F.col("r.page_start"), F.col("r.page_end"))
    )
    hits = expected.alias("e").join(top.alias("r"), on, "left_semi").select("query_id").distinct()
    asked = expected.select("query_id").distinct().withColumn("asked", F.lit(True))
    scored = questions.select("query_id").join(asked, "query_id", "left").join(
        hits.withColumn("was_hit", F.lit(True)), "query_id", "left"
    )
    return scored.select("query_id", F.when(F.col("asked"), F.coalesce("was_hit", F.lit(False))).alias("hit"))


def code_match(expected: DataFrame, detected: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, matched): every expected code detected, exactly or as a look-alike; NULL where none is expected.

    expected and detected: query_id, code.
    """
    rows = expected.select("query_id", "code", F.lit(False).alias("seen")).unionByName(
        detected.select("query_id", "code", F.lit(True).alias("seen"))
    )
    # The key passes a generator, so that the look-alike key works it out once.
    rows = rows.select("query_id", "seen", F.explode_outer(F.array(code_key(F.col("code")))).alias("key"))
    rows = rows.select("query_id", "seen", lookalike_key(F.col("key")).alias("fold"))
    # Grouped before the shuffle, as look-alikes of a code share one key; a code without key is never seen.
    codes = rows.groupBy("query_id", "fold").agg(
        F.bool_or(~F.col("seen")).alias("wanted"), (F.bool_or("seen") & F.col("fold").isNotNull()).alias("seen")
    )
    verdict = codes.where("wanted").groupBy("query_id").agg(F.bool_and("seen").alias("matched"))
    return questions.select("query_id").join(verdict, "query_id", "left")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; vectors of a handful of short texts, so evaluated in place."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cause_at_3(
    expected: DataFrame, answers: DataFrame, questions: DataFrame, threshold: float = CAUSE_THRESHOLD, top: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, pairs). Per expected cause the closest of the first three answer causes, rounded to 3 digits.

    expected: query_id, n, text, vector; answers: query_id, rank, text, vector. Verdict: NULL where nothing is
    expected, false where nothing was answered.
    """
    heads = answers.where(F.col("rank") <= top).select(
        "query_id", "rank", F.col("text").alias("answer"), F.col("vector").alias("a_vector")
    )
    scored = expected.join(heads, "query_id").withColumn("sim", cosine(F.col("vector"), F.col("a_vector")))
    # Nearly equal similarities tie, and then the earlier answer counts.
    scored = scored.withColumn("place", F.struct(F.round("sim", 9), -F.col("rank")))
    pairs = scored.groupBy("query_id", "n").agg(
        F.first("text").alias("expected"), F.max_by(F.struct("answer", "rank", "sim"), "place").alias("b")
    ).select("query_id", "n", "expected", "b.answer", "b.rank", F.bround("b.sim", 3).alias("score"))
    best = pairs.groupBy("query_id").agg(F.bool_or(F.col("score") >= threshold).alias("hit"))
    asked = expected.select("query_id").distinct().withColumn("asked", F.lit(True))
    verdict = questions.select("query_id").join(asked, "query_id", "left").join(best, "query_id", "left")
    return verdict.select("query_id", F.when(F.col("asked"), F.coalesce("hit", F.lit(False))).alias("cause_at_3")), pairs


def citation_accuracy(citations: DataFrame, sources: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, correct, total) over cause and step citations.

    citations: query_id, item, source_id (one row per citation); sources: query_id, source_id, manual, page_start,
    page_end, kind; expected: query_id, manual, page. Safety sources do not count; unknown ids count as wrong.
    """
    resolved = citations.join(sources, ["query_id", "source_id"], "left").where(~F.coalesce(F.col("kind") == "safety", F.lit(False)))
    named = sources.alias("s").join(
        expected.alias("e"),
        (F.col("s.query_id") == F.col("e.query_id")) & (F.col("s.manual") == F.col("e.manual"))
        & F.col("e.page").between(F.col("s.page_start"), F.col("s.page_end")),
        "left_semi",
    ).select("query_id", "source_id", F.lit(1).alias("right"))
    return resolved.join(named, ["query_id", "source_id"], "left").groupBy("query_id").agg(
        F.count("right").alias("correct"), F.count("*").alias("total")
    )


def hallucination_flags(questions: DataFrame, unknown: DataFrame, first_pass: DataFrame) -> DataFrame:
    """(query_id, final_hallucination, raw_hallucination).

    unknown: rows of unknown identifiers in final answers; first_pass: query_id, violations.
    """
    final = unknown.select("query_id").distinct().withColumn("f", F.lit(True))
    joined = questions.select("query_id").join(final, "query_id", "left").join(first_pass, "query_id", "left")
    flag = F.coalesce("f", F.lit(False))
    early = F.coalesce(F.exists("violations", lambda v: v.contains("unknown identifier")), F.lit(False))
    return joined.select("query_id", flag.alias("final_hallucination"), (flag | early).alias("raw_hallucination"))


def refusal_flags(behavior: Column, status: Column) -> dict[str, Column]:
    """Tri-state outcome columns; each applies to one expected behaviour and is NULL for the other."""
    escalated = status == "escalate"
    return {
        "refusal_correct": F.when(behavior == "escalate", escalated),
        "false_escalation": F.when(behavior == "diagnose", escalated),
    }


# --- summaries (I9-I11) -----------------------------------------------------------------------------------------


def summarize(results: DataFrame) -> DataFrame:
    """One row per metric: (metric, value, n). Rates skip NULLs; citation and translation rates are micro-averages."""
    rate = lambda c: F.struct(F.avg(F.col(c).cast("double")).alias("value"), F.count(c).alias("n"))
    part = lambda a, b: F.struct(
        F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")).alias("value"), F.coalesce(F.sum(b), F.lit(0)).cast("long").alias("n")
    )
    struct = {name: rate(column) for name, column in RATES.items()}
    struct["citation_accuracy"] = part("citations_correct", "citations_total")
    struct["translation_fallback"] = part("translation_fallbacks", "translation_total")
    row = results.agg(*[struct[m].alias(m) for m in METRICS])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)["value"].alias("value"), F.col(m)["n"].alias("n")) for m in METRICS])
    return row.select(F.inline(cells))


def counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("scenarios"), F.count_if("reviewed").alias("reviewed"), F.count("error").alias("errors")
    )


def nearest_rank(values: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """(group, p, value): the value at index round-half-even(p/100 * (n-1)) of the sorted values; NULLs do not count.

    Equal values are counted first. Ranges of (group, value) that Spark samples to be of like size bracket the index;
    counts below a range are exact, and only the ranges that hold a wanted index are ordered, each in its own task.
    """
    tallies = values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # Written down, because both uses below must see the same ranges.
    tallies = settle(tallies.repartitionByRange(*group, "v").withColumn("part", F.spark_partition_id()), "tallies")
    ranges = tallies.groupBy(*group, "part").agg(F.sum("c").alias("c"))
    over = Window.partitionBy(*group)
    upto = over.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumns({"total": F.sum("c").over(over), "last": F.sum("c").over(upto)})
    wanted = ranges.withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents])))
    wanted = wanted.withColumn("at", F.bround(F.col("p") / 100.0 * (F.col("total") - 1)).cast("long"))
    wanted = wanted.where((F.col("at") < F.col("last")) & (F.col("at") >= F.col("last") - F.col("c"))).select(
        *group, "part", "p", (F.col("at") - (F.col("last") - F.col("c"))).alias("inside")
    )
    # A range is ordered once for all percentiles that fall into it.
    held = wanted.groupBy(*group, "part").agg(F.collect_list(F.struct("p", "inside")).alias("asked"))
    held = held.select("asked", *[F.col(c).alias(f"__{c}") for c in [*group, "part"]])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group, "part"]]  # a NULL in ``group`` is a group too
    run = Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tallies.join(held, same).withColumn("last", F.sum("c").over(run))
    hits = F.filter("asked", lambda a: (a["inside"] < F.col("last")) & (a["inside"] >= F.col("last") - F.col("c")))
    return ranked.select(*group, F.col("v").alias(value), F.explode(hits).alias("hit")).select(*group, "hit.p", value)


def percent_text(value: Column) -> Column:
    """"50.0%", or "n/a" for NULL."""
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.concat(fixed(value * 100, 1), F.lit("%")))


def scorecard_rows(summary: DataFrame) -> DataFrame:
    """(ord, label, shown, n) in scorecard order; metrics a run lacks show as n/a."""
    spec = summary.sparkSession.createDataFrame(
        [(i, m, label) for i, (m, label) in enumerate(METRICS.items())], "ord int, metric string, label string"
    )
    return spec.join(summary, "metric", "left").select(
        "ord", "label", percent_text(F.col("value")).alias("shown"), F.coalesce("n", F.lit(0)).alias("n")
    )


def scorecard_title(mode: str, reviewed: Column, scenarios: Column, system: str = "Evaluation") -> Column:
    base = F.format_string(f"{system} ({mode}): %d/%d scenarios reviewed", reviewed, scenarios)
    return F.concat(base, F.when(reviewed < scenarios, F.lit(" - PROVISIONAL")).otherwise(F.lit("")))


# --- run comparison (I12) ---------------------------------------------------------------------------------------


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ord, label, a, b, delta) of two summaries; a metric either run lacks gives n/a."""
    spec = a.sparkSession.createDataFrame(
        [(i, m, label) for i, (m, label) in enumerate(METRICS.items())], "ord int, metric string, label string"
    )
    joined = spec.join(a.select("metric", F.col("value").alias("va")), "metric", "left").join(
        b.select("metric", F.col("value").alias("vb")), "metric", "left"
    )
    delta = (F.col("vb") - F.col("va")) * 100
    shown = F.when(delta.isNull(), F.lit("n/a")).otherwise(F.concat(F.when(delta < 0, F.lit("")).otherwise(F.lit("+")), fixed(delta, 1), F.lit(" pts")))
    return joined.select("ord", "label", percent_text(F.col("va")).alias("a"), percent_text(F.col("vb")).alias("b"), shown.alias("delta"))


def run_flips(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = FLIP_FIELDS, key: str = "id") -> DataFrame:
    """(key, field, before, after): outcome fields that differ, NULL-safely, for ids present in both runs."""
    long = lambda df, name: df.select(key, F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for i, f in enumerate(fields)
    ])))
    joined = long(a, "before").join(long(b, "after"), [key, "ord", "field"])
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).drop("ord")


def flip_text(key: Column, field: Column, before: Column, after: Column) -> Column:
    word = lambda c: F.when(c.isNull(), F.lit("None")).when(c == "true", F.lit("True")).when(c == "false", F.lit("False")).otherwise(c)
    return F.concat(key, F.lit(": "), field, F.lit(" "), word(before), F.lit(" -> "), word(after))


# --- drafting (I13) ---------------------------------------------------------------------------------------------


def draft_targets(seeds: DataFrame, faults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets found, named targets not found).

    seeds: id, targets array<struct<manual,code>>; a target without manual expands to every manual holding the
    code. Per manual the exact key wins, then the first look-alike by key. Result rows are ordered by
    (target position, manual). Seeds are unique by id; a repeated one adds nothing.

    A target meets the records of a manual that look alike as one row and takes its own there, so the hits, several times the
    targets, stream to the result and no task sorts them.
    """
    targets = seeds.select("id", F.posexplode("targets").alias("t", "target")).select(
        "id", "t", F.col("target.manual").alias("wanted"), F.col("target.code").alias("want_code"),
        F.explode_outer(F.array(code_key(F.col("target.code")))).alias("want_key"),  # worked out once a row
    )
    # Dealt before the join: what a task sorts is then a share of the shuffle, not all targets of a file's split.
    targets = targets.repartition("id", "t").withColumn("fold", lookalike_key(F.col("want_key")))
    once = targets.dropDuplicates(["id", "t", "wanted", "want_key"]).select("id", "t", "wanted", "want_key", "fold")
    # Dealt by the key of the join, so that the records of a look-alike key, at most 64 a manual, are grouped where they are joined.
    keyed = faults.select("manual_id", F.struct("code_key", "code", "causes", "page", "page_end").alias("r"))
    keyed = keyed.withColumn("fold", lookalike_key(F.col("r.code_key"))).repartition("fold")
    index = keyed.groupBy("fold", "manual_id", "r.code_key").agg(F.min("r").alias("r"))
    index = index.groupBy("fold", "manual_id").agg(F.collect_list("r").alias("records"))
    # Sorts can spill; a broadcast table is held whole, and the size of a file says little of the rows'.
    hits = once.join(index.hint("merge"), "fold").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("manual_id")))
    placed = F.transform("records", lambda r: F.struct((r["code_key"] != F.col("want_key")).alias("other"), r["code_key"].alias("key"), r.alias("r")))
    best = hits.select("id", "t", "manual_id", F.array_min(placed)["r"].alias("r")).select(
        "id", "t", "manual_id", "r.code", "r.code_key", "r.causes", "r.page", "r.page_end"
    )
    lost = targets.where("wanted is not null").join(best.select("id", "t"), ["id", "t"], "left_anti").select(
        "id", F.concat("id", F.lit(": code "), "want_code", F.lit(" not found in "), "wanted").alias("problem")
    )
    return best, lost


def draft_scenarios(seeds: DataFrame, faults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafted judgements, problems). Hand-written expectations in a seed win; out-of-scope seeds expect none."""
    found, lost = draft_targets(seeds, faults)
    entry = F.struct(
        "t", "manual_id", "code", F.slice("causes", 1, 4).alias("causes"), F.sequence("page", "page_end").alias("pages"), "page"
    )
    grouped = found.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    none = F.array().cast("array<string>")
    rows = seeds.join(grouped, "id", "left").withColumn("found", F.coalesce("found", F.expr("slice(found, 1, 0)")))
    out = F.col("type") == "out_of_scope"
    given = lambda c: F.when(F.size(c) > 0, F.col(c))
    sources = F.transform("found", lambda f: F.struct(f["manual_id"].alias("manual"), f["pages"].alias("pages")))
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    notes = F.when(has, F.concat(F.lit("Drafted from "), F.array_join(
        F.transform("found", lambda f: F.format_string("%s %s p.%d", f["manual_id"], f["code"], f["page"])), ", ")
    )).when(out, F.coalesce("notes", F.lit("Out of scope: the system must escalate"))).otherwise(
        F.coalesce("notes", F.lit("Expectations written by hand from the manual text"))
    )
    empty_sources = F.array().cast("array<struct<manual:string,pages:array<int>>>")
    drafted = rows.select(
        "id", "type", "query", "machine_id", F.when(out, F.lit("escalate")).otherwise("diagnose").alias("expected_behavior"),
        F.coalesce(F.array_distinct(F.transform("found", lambda f: f["code"])), none).alias("expected_fault_codes"),
        F.when(out, none).otherwise(F.coalesce(given("expected_causes"), F.get("found", F.lit(0))["causes"], none)).alias("expected_causes"),
        F.when(out, empty_sources).otherwise(F.coalesce(given("expected_sources"), sources, empty_sources)).alias("expected_sources"),
        F.lit(False).alias("reviewed"), notes.alias("notes"),
    )
    return drafted, lost
