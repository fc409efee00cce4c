import pytest
from pyspark.sql import functions as F

from citeline.operators import triage
from citeline.operators.lookback import recent_readings
from citeline.session import scratch_path
from citeline.sources import registry, runs, store
from citeline.streaming import reports as stream


def manual(i, layout="block"):
    return (i, "KXV", "T", "D", "1", f"{i}.pdf", "u", "0", layout, (1, 2), None, [1], [i.upper()])


def test_registries(spark):
    manuals = registry.check_manuals(spark.createDataFrame([manual("m1"), manual("m2")], registry.MANUALS))
    with pytest.raises(registry.RegistryError, match="duplicate manual ids: m1"):
        registry.check_manuals(spark.createDataFrame([manual("m1"), manual("m1")], registry.MANUALS))
    machines = lambda *rows: spark.createDataFrame([(i, m, "") for i, m in rows], registry.MACHINES)
    registry.check_machines(machines(("p1", "m1"), ("p2", "m1")), manuals)
    with pytest.raises(registry.RegistryError, match="unknown manuals: p1"):
        registry.check_machines(machines(("p1", "m9")), manuals)
    with pytest.raises(registry.RegistryError, match="duplicate machine"):
        registry.check_machines(machines(("p1", "m1"), ("p1", "m2")), manuals)
    folder = scratch_path(spark, "scenarios")
    spark.createDataFrame([('{"id":"a","type":"symptom","query":"q","expected_behavior":"diagnose"}',)], "value string").write.text(folder)
    [loaded] = registry.load_scenarios(spark, folder).collect()
    assert (loaded.expected_causes, loaded.reviewed) == ([], False)
    with pytest.raises(registry.RegistryError, match="unknown type"):
        registry.check_scenarios(spark.read.schema(registry.SCENARIOS).json(folder).withColumn("type", F.lit("other")))


def test_fingerprints_and_incremental_ingest(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "id string, sha256 string")
    have = spark.createDataFrame([("a", "1"), ("b", "x")], "id string, sha256 string")
    got = spark.createDataFrame([("b", "2"), ("c", "y")], "id string, sha256 string")
    assert {r.id: r.status for r in registry.manifest_status(want, have, got).collect()} == {
        "a": "present", "b": "downloaded", "c": "checksum-mismatch", "d": "missing"}
    status = lambda **kw: {r.id: r.status for r in store.plan_ingest(want, have, **kw).collect()}
    assert status()["a"] == "unchanged" and status()["b"] == "ingested" and status(force=True)["a"] == "ingested"
    folder = scratch_path(spark, "files")
    spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(folder)
    [row] = registry.file_fingerprints(spark, folder, "*.txt").collect()
    assert row.sha256 == __import__("hashlib").sha256(b"x\n").hexdigest()


def test_replace_and_read(spark):
    root = scratch_path(spark, "store")

    def put(sha, n):
        ids = [(f"m1:s{i}", "m1", "section", "H", 1, 1, f"text {i}", [1.0]) for i in range(n)]
        chunks = spark.createDataFrame(ids, "id string, manual_id string, kind string, heading_path string, page_start int, page_end int, text string, embedding array<double>")
        store.check_embedded(chunks, chunks)
        manuals = spark.createDataFrame([("m1", sha, "KXV", "T")], "id string, sha256 string, family string, title string")
        faults = spark.createDataFrame([("m1", "OHF")] if sha == "a" else [], "manual_id string, code_key string")
        store.replace_manuals(spark, root, manuals, chunks, faults, faults.withColumn("kind", F.lit("fault")))

    put("a", 5)
    put("a", 5)
    assert store.read_table(spark, root, "chunks").count() == 5 and store.read_table(spark, root, "fault_codes").count() == 1
    put("b", 3)
    chunks, manuals = store.read_table(spark, root, "chunks"), store.current_manuals(spark, root)
    assert chunks.count() == 3 and store.read_table(spark, root, "fault_codes").count() == 0
    assert [r.sha256 for r in manuals.collect()] == ["b"]
    ids = spark.createDataFrame([("m1:s1",), ("nope",)], "chunk_id string")
    assert [(r.chunk_id, r.family) for r in store.passages_by_id(ids, chunks, manuals).collect()] == [("m1:s1", "KXV")]
    with pytest.raises(ValueError, match="3 chunks but 0 embeddings"):
        store.check_embedded(chunks, chunks.limit(0))


def test_runs(spark):
    path = scratch_path(spark, "run")
    results = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, n int").coalesce(1)
    summary = spark.createDataFrame([("hit", 0.5, 2)], "metric string, value double, n long")
    runs.save_run(results, summary, summary, summary, path)
    with pytest.raises(Exception, match="already exists"):
        runs.save_run(results, summary, summary, summary, path)
    found, last = runs.load_run(spark, path, "id string, n int")
    assert found.first().value == 0.5 and {r.id: r.n for r in last.collect()} == {"a": 3, "b": 2}


def test_reports_scope_and_gate(spark):
    asked = spark.createDataFrame([("a", "  OHF  "), ("b", " "), ("c", "x" * 2001), ("d", "a\x00b"), ("e", "a\tb")], "query_id string, text string")
    good, bad = triage.validate_reports(asked)
    assert {r.query_id: r.text for r in good.collect()} == {"a": "OHF", "e": "a\tb"} and bad.count() == 3
    asked = spark.createDataFrame([("a", "p1"), ("b", None), ("c", "p1"), ("d", None), ("e", "p9")], "query_id string, machine_id string")
    machines = spark.createDataFrame([("p1", "m1")], "id string, manual string")
    named = spark.createDataFrame([("c", 1, "KXV2"), ("d", 1, "OTHER")], "query_id string, nth int, model string")
    models = spark.createDataFrame([("KXV2", "m2")], "model string, manual_id string")
    scoped, uncovered, unknown = triage.resolve_scope(asked, machines, named, models)
    assert {r.query_id: r.scope for r in scoped.collect()} == {"a": ["m1"], "b": None, "c": ["m2"]}
    assert [r.query_id for r in uncovered.collect()] == ["d"] and [r.query_id for r in unknown.collect()] == ["e"]
    manuals = spark.createDataFrame([("m1", "KXV1", ["A"]), ("m2", "KXV2", ["B", "C"])], "id string, family string, models array<string>")
    reason = triage.uncovered_reason(F.array(F.lit("OTHER")), F.col("coverage"))
    assert triage.coverage_text(manuals).select(reason.alias("r")).first().r == (
        "This system has no manual for the OTHER. It has manuals for these drives: KXV1, KXV2 series.")
    state = spark.createDataFrame([("a", False, 0.1), ("b", True, 0.1), ("c", False, 0.14)], "query_id string, has_code boolean, top_score double")
    gated = {r.query_id: r.gate_reason for r in triage.evidence_gate(state).collect()}
    assert gated["a"].endswith("scored 0.10, below the evidence threshold of 0.14.") and gated["b"] is None and gated["c"] is None


def test_lookback(spark):
    reports = spark.createDataFrame([(1, "m", 10000), (2, None, 10000)], "report_id int, machine_id string, s int").select("report_id", "machine_id", F.timestamp_seconds("s").alias("report_ts"))
    readings = spark.createDataFrame([("m", s) for s in (8199, 8200, 9999, 10000, 10001)] + [("x", 9999)], "machine_id string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.s for r in recent_readings(reports, readings).collect()) == [8200, 9999, 10000]


def test_report_stream(spark):
    source = scratch_path(spark, "in")
    spark.createDataFrame([("a", "heat fan"), ("b", " "), ("c", "unrelated words")], "query_id string, text string").write.parquet(source)
    passages = spark.createDataFrame([("s1", "m", "section", "", "fan heat"), ("s2", "m", "section", "", "modbus")], "passage_id string, manual_id string, kind string, heading string, text string")
    faults = spark.createDataFrame([], "manual_id string, code string, code_key string, name string, page int, chunk_id string")
    target, state = stream.shared_run(spark, "triage")
    arriving = stream.stream_table(spark, source, "query_id string, text string")
    stream.start_triage(arriving, passages, faults, target, state).awaitTermination()
    gated = {r.query_id: r.gate_reason for r in spark.read.parquet(f"{target}/gated").collect()}
    assert gated["a"] is None and gated["c"] is not None and "b" not in gated
    assert spark.read.parquet(f"{target}/rejected").count() == 1


@pytest.mark.parametrize("window, want", [("2 hours", [1, 2]), ("10 minutes", [1])])
def test_lookback_reaches_as_far_as_its_window(spark, window, want):
    reports = spark.sql("SELECT 'm' AS machine_id, timestamp'2024-03-01 12:00:00' AS report_ts")
    readings = spark.sql("SELECT 'm' AS machine_id, ts, n FROM VALUES (timestamp'2024-03-01 11:55:00', 1), (timestamp'2024-03-01 10:05:00', 2), (timestamp'2024-03-01 12:00:01', 3) AS t(ts, n)")
    assert sorted(r.n for r in recent_readings(reports, readings, window).collect()) == want


def test_manual_ids_of_digits_stay_text(spark, tmp_path):
    manuals = spark.createDataFrame([("007", "a1"), ("7", "b2")], "id string, sha256 string")
    rows = spark.createDataFrame([("007", "x"), ("7", "y")], "manual_id string, text string")
    store.replace_manuals(spark, str(tmp_path), manuals, rows, rows, rows)
    assert sorted((r.manual_id, r.text) for r in store.read_table(spark, str(tmp_path), "chunks").collect()) == [("007", "x"), ("7", "y")]
