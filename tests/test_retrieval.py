import pytest
from pyspark.sql import functions as F

from citeline.operators import search
from citeline.operators.vectors import Lane, hash_counts, vector_topk
from citeline.plans.retrieve import joined_scores, retrieve

FAULTS = "manual_id string, code string, code_key string, name string, page int, chunk_id string"
PASSAGES = "passage_id string, manual_id string, kind string, heading string, text string"
CODES = [("loom", "WBK"), ("loom", "W-7"), ("loom", "L10"), ("loom", "SO5"), ("dobby", "L10"), ("dobby", "LI0")]


def code_rows(codes):
    return [(m, c, c, f"{c} alarm", 40, f"{m}:f:{c}") for m, c in codes]


ASKED = {  # question, scope -> (manual, code, is a look-alike)
    ("WBK again", None): [("loom", "WBK", False)],
    ("shows S05.", None): [("loom", "SO5", True)],
    ("L10 since noon", None): [("dobby", "L10", False), ("loom", "L10", False)],  # an exact code hides look-alikes of its manual
    ("LIO since noon", None): [("dobby", "L10", True), ("dobby", "LI0", True), ("loom", "L10", True)],
    ("L10 since noon", ("loom",)): [("loom", "L10", False)],
    ("W 7 lamp, W-7", None): [("loom", "W-7", False)],
    ("nothing woven", None): [],
}


def test_codes_in_questions(spark):
    rows = [(n, text, list(scope) if scope else None) for n, (text, scope) in enumerate(ASKED)]
    index = search.code_index(spark.createDataFrame(code_rows(CODES), FAULTS))
    hits = search.detect_codes(spark.createDataFrame(rows, "query_id int, text string, scope array<string>"), index).collect()
    assert [sorted((r.manual_id, r.code, r.fuzzy) for r in hits if r.query_id == n) for n in range(len(ASKED))] == list(ASKED.values())


def test_fusion_sums_reciprocal_ranks(spark):
    lanes = {0: [5, 1, 9], 1: [9, 2], 2: [2, 9]}
    rows = [("q", lane, rank, item) for lane, items in lanes.items() for rank, item in enumerate(items, 1)]
    fused = search.fuse(spark.createDataFrame(rows, "query_id string, lane_no int, rank int, passage_id int")).orderBy("fused_pos").collect()
    total = {i: sum(1 / (60 + items.index(i) + 1) for items in lanes.values() if i in items) for i in (1, 2, 5, 9)}
    assert [r.passage_id for r in fused] == sorted(total, key=total.get, reverse=True)


def test_pool_slots_and_pins(spark):
    frame = spark.createDataFrame
    fused = frame([(7, n, n) for n in range(11, 20)], "query_id int, passage_id int, fused_pos int").withColumn("fused_pos", F.col("fused_pos") - 10)
    exact = frame([(7, 12, 1, "WBK"), (7, 50, 2, "W-7")], "query_id int, passage_id int, ord int, code string")
    reserved = frame([(7, 19, 1)], "query_id int, passage_id int, slot int")
    pool = search.candidate_pool(fused, exact, reserved, cap=3)
    assert sorted(r.passage_id for r in pool.collect()) == [11, 13, 14, 19]
    slots = search.place_slots(pool.withColumn("score", F.col("passage_id") % 10 / 10.0 * F.when(F.col("passage_id") < 19, 1.0).otherwise(0.0)))
    order = [r.passage_id for r in slots.orderBy("pos").collect()]
    assert sorted(order) == [11, 13, 14, 19] and [p for p in order if p != 19] == [14, 13, 11]
    final = search.pin_exact(exact, slots, top_k=4).orderBy("pos").collect()
    assert [(r.passage_id, r.code) for r in final[:2]] == [(12, "WBK"), (50, "W-7")] and len(final) == 4


def test_vectors(spark):
    at = lambda i, v, m, k: (i, v, m, k)
    known = [at(1, [3.0, 4.0], "loom", "section"), at(2, [4.0, 3.0], "loom", "fault"), at(3, [0.0, 1.0], "dobby", "fault"), at(4, [0.0, 0.0], None, "section")]
    passages = spark.createDataFrame(known, "passage_id int, vector array<double>, manual_id string, kind string")
    asked = spark.createDataFrame([("up", [0.0, 2.0], None), ("in", [0.0, 5.0], ["loom", "none"]), ("out", [1.0, 0.0], [])], "query_id string, vector array<double>, scope array<string>")
    rows = vector_topk(asked, passages, [Lane("all", 2), Lane("faults", 1, "fault")]).orderBy("query_id", "lane", "rank").collect()
    assert [(r.query_id, r.lane, r.passage_id, round(r.score, 6)) for r in rows] == [
        ("in", "all", 1, 0.8), ("in", "all", 2, 0.6), ("in", "faults", 2, 0.6), ("up", "all", 3, 1.0), ("up", "all", 1, 0.8), ("up", "faults", 3, 1.0),
    ]


@pytest.mark.parametrize("k", [1, 7, 100])
def test_ties_leave_a_pack_as_k_rows(spark, k):
    """A zero vector is as near to every passage as to any other: the smallest identifiers stay."""
    passages = spark.range(90).select(F.format_string("p%02d", (F.col("id") * 37) % 90).alias("passage_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    asked = spark.createDataFrame([("zero", [0.0, 0.0])], "query_id string, vector array<double>")
    rows = vector_topk(asked, passages, [Lane("all", k)]).orderBy("rank").collect()
    assert [r.passage_id for r in rows] == [f"p{n:02d}" for n in range(min(k, 90))] and {r.score for r in rows} == {0.0}


def test_hashing_counts_words(spark):
    texts = spark.createDataFrame([(1, "Reed reed, REED and warp"), (2, "?!")], "id int, text string")
    assert sum(r.n for r in hash_counts(texts, "id", "text").where("id = 1").collect()) == 5


def test_retrieval_of_a_small_collection(spark):
    """Reranking, the cut, pins, rewrites and code texts, end to end."""
    rows = [("loom:s1", "loom", "section", "", "reed wire bent"), ("loom:s2", "loom", "section", "", "wire gauge table"), ("loom:s3", "loom", "section", "", "order form"),
            ("loom:f:WBK", "loom", "fault", "", "warp broken")]
    asked = spark.createDataFrame([("plain", "reed wire", None, None), ("coded", "WBK today", "unused words", None), ("rewritten", "it stopped", "gauge table", None), ("foreign", "warp", None, "WBK")],
                                  "query_id string, text string, rewrite string, code_text string")
    out = retrieve(asked, spark.createDataFrame(rows, PASSAGES), spark.createDataFrame(code_rows(CODES[:1]), FAULTS), top_k=2)
    ranked = {}
    for r in out.ranked.orderBy("query_id", "pos").collect():
        ranked.setdefault(r.query_id, []).append((r.passage_id, r.code))
    assert ranked["plain"] == [("loom:s1", None), ("loom:s2", None)] and ranked["rewritten"][0] == ("loom:s2", None)
    assert ranked["coded"][0] == ranked["foreign"][0] == ("loom:f:WBK", "WBK") and max(map(len, ranked.values())) == 2
    texts = {(r.query_id, r.variant): r.search_text for r in out.searches.collect()}
    assert texts[("rewritten", 1)] == "gauge table" and ("coded", 1) not in texts
    assert {r.query_id: r.top_score for r in out.top.collect()}["plain"] == 1.0


def test_scores_from_a_table(spark):
    given = spark.createDataFrame([(1, 10, 0.25)], "query_id int, passage_id int, score double")
    pool = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "query_id int, passage_id int")
    assert {(r.query_id, r.passage_id): r.score for r in joined_scores(given)(pool, None).collect()} == {(1, 10): 0.25, (1, 11): 0.0, (2, 10): 0.0}


def test_many_questions_meet_passages_in_a_grid(spark, monkeypatch):
    """More questions than a broadcast takes, with copies, zero vectors, scopes and kinds, against a loop."""
    import numpy as np
    from citeline.operators import vectors as V

    for name, value in (("QUESTIONS_PER_PASS", 16), ("QUESTIONS_PER_SHARE", 40), ("PASSAGES_PER_PACK", 32), ("BLOCK", 7)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(90, 4)).round(1)
    data[60:80], data[80:83] = data[3], 0.0
    rows = [(n, data[n].tolist(), str(n % 3), "fault" if n % 4 == 0 else "section") for n in range(90)]
    known = spark.createDataFrame(rows, "passage_id long, vector array<double>, manual_id string, kind string")
    scopes = {n: None if n % 2 else [str(n % 3), "9"] for n in range(90)}
    asked = spark.createDataFrame([(n, data[n].tolist(), scopes[n]) for n in range(90)], "query_id long, vector array<double>, scope array<string>")
    lanes = [V.Lane("all", 5), V.Lane("fault", 3, kind="fault")]
    found = V.vector_topk(asked, known, lanes)
    assert "CartesianProduct" in found._jdf.queryExecution().toString()
    got = {(r.query_id, r.lane, r["rank"]): (r.passage_id, r.score) for r in found.collect()}
    size = np.linalg.norm(data, axis=1)
    want = {}
    for q in range(90):
        for lane in lanes:
            fit = [p for p in range(90) if (scopes[q] is None or rows[p][2] in scopes[q]) and lane.kind in (None, rows[p][3])]
            score = {p: round(float(data[q] @ data[p] / (size[q] * size[p])), 9) if size[q] * size[p] else 0.0 for p in fit}
            for n, p in enumerate(sorted(fit, key=lambda p: (-score[p], p))[: lane.k]):
                want[q, lane.name, n + 1] = (p, score[p])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_unit_weights_shuffle_nothing(spark):
    from citeline.operators.vectors import hash_embedding, normalised, unit_weights

    texts = spark.createDataFrame([("a", "x y y z"), ("b", ""), ("c", None), ("d", "Q q 7")], "id string, text string")
    weights = unit_weights(hash_embedding(texts, "id", "text"), "id")
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    want = normalised(hash_counts(texts, "id", "text"), "id")
    assert sorted(map(tuple, weights.collect())) == sorted(map(tuple, want.collect()))


def test_candidates_by_one_pattern_equal_the_spelled_ones(spark):
    from citeline.functions import identifiers as I

    texts = ["line shows F1A2", "abc 12 F-10 x.y1", "ab1 ab1 1234 12a 1234567a abcdefg", "é1ab2é a..b1c x- y9z", "err 123", "err 12", "", "F10.", "-F10-", "a.b", None, "AB\n7x 8"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", I.query_code_candidates(F.col("text")).alias("now"), I._spelled_candidates(F.col("text")).alias("full")).collect()
    assert all(r.now == r.full for r in rows), [r for r in rows if r.now != r.full]


def test_detection_keys_are_worked_out_once(spark):
    index = search.code_index(spark.createDataFrame(
        [("m", "L10", "L10", "m:1"), ("m", "LI0", "LI0", "m:2"), ("n", "LI0", "LI0", "n:1"), ("n", "LONGCODE", "LONGCODE", "n:2"), (None, "ABC", "ABC", "x")],
        "manual_id string, code string, code_key string, chunk_id string",
    ))
    asked = spark.createDataFrame([("q", "L10 and LI0 but not LONGCODE"), ("r", "abc L1O"), ("s", None)], "query_id string, text string")
    found = search.detect_codes(asked, index)
    got = sorted((r.query_id, r.ord, r.token, r.fuzzy, r.chunk_id) for r in found.collect())
    assert got == [
        ("q", 1, "L10", False, "m:1"), ("q", 2, "L10", True, "n:1"), ("q", 3, "LI0", False, "m:2"),
        ("r", 1, "abc", False, "x"), ("r", 2, "L1O", True, "m:1"), ("r", 3, "L1O", True, "m:2"), ("r", 4, "L1O", True, "n:1"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_extract_all" in line for line in plan.splitlines() if "Filter" in line or "Join" in line)


def test_few_questions_meet_passages_as_they_stream(spark):
    """Passages are neither packed nor joined with the questions before they are compared, and keep their identifiers."""
    big = 2**60 + 1
    known = spark.createDataFrame([(None, [3], [1]), (big, [3], [2]), (7, [5], [1]), (8, [], [])], "passage_id long, buckets array<int>, counts array<int>")
    asked = spark.createDataFrame([("q", [3, 5], [2, 1]), ("zero", [], [])], "query_id string, buckets array<int>, counts array<int>")
    found = vector_topk(asked, known.coalesce(1), [Lane("vector", 3)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapIn") == 1, plan
    rows = [(r.query_id, r.passage_id, round(r.score, 6)) for r in found.orderBy("query_id", "rank").collect()]
    assert rows[:3] == [("q", None, 0.894427), ("q", big, 0.894427), ("q", 7, 0.447214)]
    assert rows[3:] == [("zero", None, 0.0), ("zero", 7, 0.0), ("zero", 8, 0.0)]
