import json

from pyspark.sql import functions as F

from citeline.operators import evaluate as E, lexicon, triage
from citeline.plans.diagnose import judge, prepare
from citeline.plans.evaluate import score_answers, score_retrieval
from citeline.sources.registry import MANUALS, SCENARIOS


def test_reports_to_scored_answers(spark):
    manual = ("m1", "KXV600", "Manual", "D", "1", "m1.pdf", "u", "0", "block", (1, 2), None, [1], ["KXV600", "KXV630"])
    manuals = spark.createDataFrame([manual], MANUALS)
    machines = spark.createDataFrame([("P-1", "m1")], "id string, manual string")
    rows = [("m1:f:OHF", "m1", "fault", "Error codes > OHF", "overheating fan heat", 10, 10), ("m1:s0", "m1", "section", "Wiring", "motor cables", 5, 5),
            ("m1:s1", "m1", "safety", "Safety", "disconnect power", 2, 2)]
    passages = spark.createDataFrame(rows, "passage_id string, manual_id string, kind string, heading string, text string, page_start int, page_end int")
    faults = spark.createDataFrame([("m1", "OHF", "OHF", "Overheat", 10, "m1:f:OHF")], "manual_id string, code string, code_key string, name string, page int, chunk_id string")
    reports = spark.createDataFrame([("a", "OHF on the KXV630", None), ("b", "weather tomorrow", None), ("c", "trips on KXV999", None), ("d", "OHF", "P-1"), ("e", "x", "P-9"), ("f", " ", None)],
                                    "query_id string, text string, machine_id string")
    ready = prepare(reports, machines, manuals, passages, faults, [(r"(KXV)([0-9]{3})", None)])
    assert {r.query_id: r.scope for r in ready.questions.collect()} == {"a": ["m1"], "b": None, "d": ["m1"]}
    assert {r.query_id for r in ready.rejected.collect()} == {"e", "f"}
    assert ready.uncovered.first().reason == "This system has no manual for the KXV999. It has manuals for these drives: KXV600 series."
    contexts = {r.query_id: r.context for r in ready.contexts.collect()}
    assert set(contexts) == {"a", "d"} and "MACHINE: P-1 (KXV600)" in contexts["d"] and "- OHF (m1 p.10)" in contexts["a"]
    assert [(r.source_id, r.passage_id) for r in ready.sources.where("query_id = 'a'").orderBy("n").limit(1).collect()] == [("S1", "m1:f:OHF")]

    good = {"status": "diagnosis", "insufficient_reason": "", "probable_causes": [{"cause": "Fan blocked", "confidence": 0.9, "fault_code": "OHF", "source_ids": ["S1"]}],
            "corrective_actions": [], "safety_warnings": []}
    bad = good | {"probable_causes": [good["probable_causes"][0] | {"fault_code": "ZZ9Z"}]}
    answers = spark.createDataFrame([("a", 1, json.dumps(bad)), ("a", 2, json.dumps(good)), ("d", 1, json.dumps(bad)), ("d", 2, "{")], "query_id string, attempt int, answer_json string")
    known = lexicon.known_identifiers(spark.createDataFrame([("m1", "fault", "OHF")], "manual_id string, kind string, code_key string"))
    first = judge(ready, answers.where("attempt = 1"), known)
    assert sorted((r.query_id, r.attempt) for r in first.retry.collect()) == [("a", 2), ("d", 2)] and first.answered.count() == 0
    assert all("unknown identifier ZZ9Z" in r.repair for r in first.retry.collect())
    assert {r.query_id: r.reason for r in first.escalated.collect()}.keys() == {"b", "c"}
    ended = judge(ready, answers.where("query_id = 'a' and attempt = 1"), known, last=True)  # d was never answered
    reasons = {r.query_id: r.reason for r in ended.escalated.collect()}
    assert reasons.keys() == {"a", "b", "c", "d"} and reasons["a"] == reasons["d"] == triage.NO_ANSWER and ended.retry.count() == 0
    judged = judge(ready, answers, known)
    answered, escalated, decided = judged.answered, judged.escalated, judged.decided
    assert [r.query_id for r in answered.collect()] == ["a"]
    assert {r.query_id for r in escalated.collect()} == {"b", "c", "d"}

    spec = lambda i, t, behavior, codes, sources: (i, t, "q", None, behavior, codes, ["x"], sources, False, "", "", "")
    scenarios = spark.createDataFrame([spec("a", "fault_code", "diagnose", ["0HF"], [("m1", [10])]), spec("b", "out_of_scope", "escalate", [], []),
                                       spec("d", "symptom", "diagnose", [], [("m1", [99])]), spec("z", "symptom", "diagnose", [], [])], SCENARIOS)
    detected = ready.retrieval.matches.select("query_id", "code")
    part = score_retrieval(scenarios, ready.sources, detected, ready.state)
    vec = lambda rows, c: spark.createDataFrame(rows, f"query_id string, {c} int, text string, vector array<double>")
    out = score_answers(scenarios, part, ready.sources, answered, escalated, decided, known,
                        vec([("a", 1, "Fan stuck", [1.0, 0.1]), ("d", 1, "x", [1.0, 0.0])], "n"), vec([("a", 1, "Fan blocked", [1.0, 0.0])], "rank"))
    got = {r.id: r for r in out.collect()}
    a, b, d, z = (got[i] for i in "abdz")
    assert (a.hit_at_5, a.code_match, a.cause_at_3, a.citations_correct, a.citations_total) == (True, True, True, 1, 1)
    assert (a.final_hallucination, a.raw_hallucination, a.false_escalation, a.refusal_correct) == (False, True, False, None)
    assert (b.refusal_correct, b.false_escalation, b.cause_at_3, b.hit_at_5) == (True, None, None, None)
    assert (d.hit_at_5, d.code_match, d.cause_at_3, d.false_escalation, d.raw_hallucination) == (False, None, False, True, True)
    assert z.error == "no response" and z.hit_at_5 is None
    assert {r.metric: r.n for r in E.summarize(out).collect()}["cause_in_top_3"] == 2
