"""The written keyword index against the search over the texts, and the counting inside a row."""
import random

from pyspark.sql import functions as F

from citeline.functions.text import runs
from citeline.operators import search
from citeline.session import scratch_path
from citeline.sources.keyword_index import search_index, write_index


def loom_texts(n):
    rng = random.Random(4)
    words = ["reed", "warp", "weft", "heddle", "bobbin", "the", "Reed"]
    rows = [(i, f"m{i % 3}", rng.choice(words + [None]), " ".join(rng.choices(words, (1, 2, 4, 8, 16, 9, 1), k=rng.randrange(1, 30)))) for i in range(n)]
    return rows + [(n, "m0", None, None), (n + 1, "m1", "", ""), (n + 2, None, "warp", "reed " * 5000)]


def test_runs_count_distinct_values(spark):
    got = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "w array<string>").select(runs(F.col("w")).alias("r")).collect()
    assert [None if r.r is None else [tuple(x) for x in r.r] for r in got] == [[("a", 1), ("b", 2)], None, None]


def test_index_search_equals_search_of_texts(spark):
    passages = spark.createDataFrame(loom_texts(400), "passage_id int, manual_id string, heading string, text string")
    asked = spark.createDataFrame(
        [(1, "reed and warp", None), (2, "bobbin", None), (3, "absent", None), (4, "heddle reed weft", ["m1", "m9"]), (5, "the", None), (6, "reed", [])],
        "query_id int, text string, scope array<string>",
    )
    index = write_index(passages, scratch_path(spark, "index"), carry=["manual_id"], buckets=4, block_passages=7)
    terms = search.query_terms(asked)
    for scopes in (None, asked):
        for k in (1, 4, 1000):
            want = search.keyword_topk(terms, search.postings(passages, only=terms, carry=["manual_id"]), k, scopes)
            got = search_index(index, terms, k, scopes)
            key = lambda rows: sorted((r.query_id, r["rank"], r.passage_id, r.score) for r in rows.collect())
            assert key(got) == key(want) and {r.query_id for r in got.collect()} <= {1, 2, 4}.union({6} if scopes is None else set())
    assert index.peaks().select("block").distinct().count() > 40 and index.postings().where("lexeme = 'the'").isEmpty()


def test_index_of_no_passages(spark):
    none = spark.createDataFrame([], "passage_id int, heading string, text string")
    counted = search.postings(none)
    assert counted.count() == 0 and set(counted.columns) == {"passage_id", "lexeme", "heading_hits", "body_hits"}
    index = write_index(none, scratch_path(spark, "index"))
    assert search_index(index, search.query_terms(spark.createDataFrame([(1, "reed")], "query_id int, text string")), 3).isEmpty()


def test_a_lexeme_of_a_passage_is_one_posting_in_a_block_of_like_lengths(spark):
    texts = loom_texts(300)
    passages = spark.createDataFrame(texts, "passage_id int, manual_id string, heading string, text string")
    index = write_index(passages, scratch_path(spark, "index"), buckets=4, block_passages=7)
    want = {}
    for pid, _, heading, text in texts:
        for at, words in enumerate(((heading or "").lower().split(), (text or "").lower().split())):
            for word in words:
                if word != "the":
                    want.setdefault((pid, word), [0, 0])[at] += 1
    rows = index.postings().collect()
    assert sorted((r.passage_id, r.lexeme, r.heading_hits, r.body_hits) for r in rows) == sorted((*k, *v) for k, v in want.items())
    peaks, lengths, long = {}, {}, {pid: len(text or "").bit_length() for pid, _, _, text in texts}
    for r in rows:
        n, h, b = peaks.get((r.lexeme, r.block), (0, 0, 0))
        peaks[r.lexeme, r.block] = n + 1, max(h, r.heading_hits), max(b, r.body_hits)
        lengths.setdefault(r.block, set()).add(long[r.passage_id])
    got = index.peaks().collect()
    assert len(got) == len(peaks) and {(r.lexeme, r.block): (r.postings, r.heading_peak, r.body_peak) for r in got} == peaks
    assert all(len(found) == 1 for found in lengths.values())
