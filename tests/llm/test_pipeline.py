"""The pipeline: every stage's decisions on planted rows, and the queries it is registered with."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeline.llm.workload import registry


def test_queries_are_registered():
    names = sorted(int(k[2:].split("_")[0]) for k in registry())
    assert names == list(range(1, 14))


def test_stages(spark, tmp_path):
    plain = lambda seed, n=40: " ".join(f"v{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(n))
    item = plain(900, 30)
    rows = [(i, plain(i), "en", "s", 1) for i in range(120)]
    rows += [(i, plain(i) + " zorch, zorch grumbel!", "en", "s", 1) for i in range(200, 240)]  # toxic
    rows += [(300, plain(3) + "\n", "en", "s", 1), (301, plain(4).replace(" ", "  ") + " ", "en", "s", 1)]  # copies; the longer one stays
    rows += [(302, plain(5) + " more", "en", "s", 1), (303, plain(6) + " " + item, "en", "s", 1), (304, None, "en", "s", 0), (305, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = [set(range(200, 240)), {3, 4, 305}, {302}, {303}, set()]
    left = {r[0] for r in rows}
    for (name, stage), out in zip(corpus_pipeline.STAGES, gone):
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        left -= out
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
        assert name == "packing" or docs.columns == columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_without_or_with_one_identifier_are_decided_by_their_text(spark, tmp_path):
    plain = lambda seed, n=40: " ".join(f"v{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(n))
    item, bad = plain(900, 30), " zorch, zorch grumbel!"
    rows = [(i, plain(i)) for i in range(120)] + [(i, plain(i) + bad) for i in range(200, 240)]
    rows += [(None, plain(301)), (None, plain(302) + bad), (None, plain(303) + " " + item)]  # clean, toxic, contaminated
    rows += [(400, plain(304)), (400, plain(305) + bad), (400, plain(306) + " " + item), (400, plain(307))]  # clean, toxic, contaminated, clean
    rows += [(401, plain(308)), (401, plain(7)), (401, plain(7)), (402, plain(309)), (402, plain(309).replace(" ", "  ")), (402, plain(8) + " more")]  # copies of 7 and 309, near 8
    rows += [(403, plain(310) + " more"), (404, plain(310)), (403, plain(311)), (None, plain(301))]  # 404 is near the first text of 403
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i >= 200)) for i in (*range(120), *range(200, 240))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r for r in rows if bad not in (r[1] or "")}
    gone = [set(), {(401, plain(7)), (402, plain(309))}, {(402, plain(8) + " more"), (404, plain(310))}, {(None, plain(303) + " " + item), (400, plain(306) + " " + item)}]
    for (name, stage), out in zip(corpus_pipeline.STAGES, gone):
        docs, left = stage(spark, docs, str(tmp_path)), left - out
        found = [tuple(r) for r in docs.collect()]
        assert set(found) == left, name
        assert name == "toxicity" or len(found) == len(left), name
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == len(left)


def test_extreme_identifiers_missing_ones_and_clashing_columns(spark, tmp_path):
    plain = lambda seed, n=40: " ".join(f"v{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(n))
    top, extra = 2**63 - 1, ["_row", "_sha", "_id", "_none", "found_id", "found_text", "component"]
    rows = [(top, plain(1)), (top, plain(2)), (-5, plain(2) + " more"), (None, plain(1) + " more"), (None, plain(3)), (None, plain(3) + " more"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in extra])
    spark.createDataFrame([(1, plain(9))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    found = {(r.doc_id, r.text) for r in left.collect()}
    one_of = [r for r in found if r[0] is None]
    assert found - set(one_of) == {(top, plain(1)), (-5, plain(2) + " more"), (7, "")} and len(one_of) == 1 and one_of[0] in rows[4:6]
    assert corpus_pipeline.exact(spark, docs, "").columns == docs.columns and corpus_pipeline.exact(spark, docs, "").count() == 7
    assert corpus_pipeline.leaked(spark, docs, str(tmp_path)).count() == 7
    none = docs.where("false")
    assert corpus_pipeline.near(spark, none, "").isEmpty() and corpus_pipeline.exact(spark, none, "").isEmpty() and corpus_pipeline.packed(spark, none, "").isEmpty()


def test_library_works_without_the_subpackage():
    entry = pytest.importorskip("__spark_entry__")
    assert "pipeline" in entry.queries() and "hybrid_retrieve" in entry.queries()


def test_contaminated_documents_go_with_one_block_of_the_benchmark_held_at_a_time(spark, tmp_path, monkeypatch):
    plain = lambda seed, n=40: " ".join(f"v{(seed * 7919 + k * k * 31 + k) % 99991}" for k in range(n))
    rows = [(i, plain(i) + (" " + plain(900 + i, 30) if i % 3 == 0 else "")) for i in range(12)] + [(None, plain(50)), (None, plain(51) + " " + plain(901, 30))]
    spark.createDataFrame([(i, plain(900 + i, 30)) for i in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline.decontamination, "BLOCK_SHINGLES", 120)
    left = corpus_pipeline.leaked(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert left._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert {tuple(r) for r in left.collect()} == {r for r in rows if len(r[1].split()) == 40}
