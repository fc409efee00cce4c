"""Hybrid retrieval for a whole table of questions."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.operators import search
from citeline.session import settle
from citeline.operators.vectors import Lane, hash_embedding, vector_topk

Embed = Callable[[DataFrame, str, str], DataFrame]
Score = Callable[[DataFrame, DataFrame], DataFrame]  # (pool, passages) -> pool with score


@dataclass
class Retrieval:
    """Long tables of one retrieval run, all keyed by ``query_id``."""

    matches: DataFrame  # recognised codes, in order
    searches: DataFrame  # texts searched: (query_id, variant, search_text, final)
    ranked: DataFrame  # (query_id, pos, passage_id, score, code, pins)
    top: DataFrame  # (query_id, top_score)


def joined_scores(scores: DataFrame) -> Score:
    """A reranker that looks up precomputed (query_id, passage_id, score) rows; absent scores count as 0."""

    def apply(pool: DataFrame, passages: DataFrame) -> DataFrame:
        found = pool.join(scores.select("query_id", "passage_id", "score"), ["query_id", "passage_id"], "left")
        return found.withColumn("score", F.coalesce("score", F.lit(0.0)))

    return apply


def retrieve(
    questions: DataFrame,
    passages: DataFrame,
    fault_codes: DataFrame,
    embed: Embed = hash_embedding,
    rerank: Score = search.overlap_rerank,
    candidates: int = search.CANDIDATES,
    top_k: int = search.TOP_K,
    fault_candidates: int = search.FAULT_CANDIDATES,
    fault_slots: int = search.FAULT_SLOTS,
    slot_position: int = search.SLOT_POSITION,
) -> Retrieval:
    """Exact codes pinned, keyword and vector rankings fused, reranked, fault slots placed, cut at top_k.

    questions: query_id, text [, scope array<string>] [, rewrite] [, code_text]
    passages: passage_id, manual_id, kind, heading, text
    fault_codes: manual_id, code, code_key, name, page, chunk_id
    """
    index = search.code_index(fault_codes)
    matches = search.detect_codes(questions, index)
    if "code_text" in questions.columns:
        second = search.detect_codes(questions.where("code_text is not null"), index, text="code_text")
        matches = search.append_matches(matches, second)
    # Every step settled here holds a bounded number of rows per question and feeds several branches.
    matches = settle(matches, "matches")
    coded = matches.select("query_id").distinct().withColumn("has_code", F.lit(True))

    has_scope = "scope" in questions.columns
    scope = F.col("scope") if has_scope else F.lit(None).cast("array<string>")
    rewrite = F.col("rewrite") if "rewrite" in questions.columns else F.lit(None).cast("string")
    plain = questions.select("query_id", "text", scope.alias("scope"), rewrite.alias("rewrite")).join(
        coded, "query_id", "left"
    )
    # The rewrite is searched too, only where no code was recognised; the last text also drives the reranker.
    variants = F.array_compact(
        F.array(F.col("text"), F.when(F.col("has_code").isNull() & (F.trim("rewrite") != ""), F.col("rewrite")))
    )
    searches = plain.select(
        "query_id", "scope", "has_code", F.size(variants).alias("n"), F.posexplode(variants).alias("variant", "search_text")
    )
    searches = searches.select(
        F.concat_ws(":", "variant", "query_id").alias("search_id"), "query_id", "variant", "scope", "has_code",
        "search_text", (F.col("variant") == F.col("n") - 1).alias("final"),
    )
    searches = settle(searches, "searches")

    terms = search.query_terms(searches, "search_text", "search_id")
    words = search.postings(passages, only=terms, carry=["manual_id"])
    keyword = search.keyword_topk(
        terms, words, candidates, scopes=searches if has_scope else None, question_id="search_id"
    ).withColumn("lane", F.lit("keyword"))

    asked = searches.join(embed(searches, "search_id", "search_text"), "search_id")
    seen = passages.withColumn("embedded", F.concat_ws("\n", "heading", "text"))
    known = passages.select("passage_id", "manual_id", "kind").join(embed(seen, "passage_id", "embedded"), "passage_id")
    lanes = [Lane("vector", candidates), Lane("fault", fault_candidates, kind="fault")]
    vector = vector_topk(
        asked if has_scope else asked.drop("scope"), known, lanes, question_id="search_id",
        question_count=searches.count(),
    )
    lanes_no = {"keyword": 0, "vector": 1}
    both = keyword.unionByName(vector).join(
        searches.select("search_id", "query_id", "variant", "final", "has_code"), "search_id"
    )
    # The fault lane serves questions without a code, and only their final text.
    both = both.where((F.col("lane") != "fault") | (F.col("final") & F.col("has_code").isNull()))
    lane_no = F.when(F.col("lane") == "fault", F.lit(4))
    for name, n in lanes_no.items():
        lane_no = lane_no.when(F.col("lane") == name, F.col("variant") * 2 + n)
    rankings = both.select(
        "query_id", lane_no.alias("lane_no"), "lane", "passage_id", F.col("rank").cast("int").alias("rank")
    )
    rankings = settle(rankings, "rankings")
    reserved = rankings.where((F.col("lane") == "fault") & (F.col("rank") <= fault_slots)).select(
        "query_id", "passage_id", F.col("rank").alias("slot")
    )

    fused = search.fuse(rankings)
    exact = matches.select("query_id", F.col("chunk_id").alias("passage_id"), "ord", "code")
    pool = search.candidate_pool(fused, exact, reserved, candidates)
    texts = searches.where("final").select("query_id", "search_text")
    pool = pool.join(passages.select("passage_id"), "passage_id", "left_semi").join(texts, "query_id")
    pool = settle(pool, "pool")
    readable = passages.select("passage_id", F.concat_ws("\n", "heading", "text").alias("passage"))
    scored = rerank(pool, readable).drop("search_text")
    placed = search.place_slots(scored, slot_position)
    stored = exact.join(passages.select("passage_id"), "passage_id", "left_semi")
    ranked = settle(search.pin_exact(stored, placed, top_k), "ranked")
    return Retrieval(matches, searches, ranked, search.top_scores(questions, ranked))
