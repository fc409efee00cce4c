"""Code detection, keyword search, rank fusion and the ordering of candidates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions.identifiers import (
    CANDIDATE_LENGTHS, lookalike_key, query_code_candidates, reads_like_display, token_key, words,
)
from citeline.functions.stopwords import STOP_WORDS
from citeline.functions.text import runs
from citeline.operators.scans import top_per_group

# Weights of heading and body hits, fusion constant, and the depths of every cut.
HEADING_WEIGHT = 1.0
BODY_WEIGHT = 0.4
FUSION_K = 60
CANDIDATES = 30
TOP_K = 8
FAULT_CANDIDATES = 10
FAULT_SLOTS = 2
SLOT_POSITION = 2

WORD = r"[\p{L}\p{N}]+"


# --- codes (F1-F3) ---------------------------------------------------------------------------------------------


def code_index(fault_codes: DataFrame) -> DataFrame:
    """The fault table keyed for detection: ``code_key`` plus its look-alike key."""
    # Both keys pass a generator, so that no later filter works them out again.
    key = fault_codes.select("*", F.explode_outer(F.array("code_key")).alias("__key"))
    fold = key.select("*", F.explode_outer(F.array(lookalike_key(F.col("__key")))).alias("fold"))
    return fold.withColumn("code_key", F.col("__key")).drop("__key")


def detect_codes(
    questions: DataFrame, index: DataFrame, text: str = "text", question_id: str = "query_id"
) -> DataFrame:
    """Codes of the index named in each question: (query, ord, token, fuzzy, *index columns).

    Exact matches come first per token; look-alikes count only for tokens that read like a display and only in
    manuals the same token does not match exactly; each passage is reported once, at its first match. Questions may
    carry ``scope`` (array of manual ids; NULL = all).
    """
    # One shuffle by question serves the two groupings below.
    hits = code_hits(questions, index, text, question_id).repartition(question_id)
    place = [
        F.col("tok_pos"), F.col("fuzzy"), F.when(F.col("fuzzy"), F.col("code_key")), F.col("manual_id"), F.col("code_key"),
    ]
    kept = [c for c in index.columns if c not in ("fold", "chunk_id")]
    first = hits.withColumn("__nth", F.row_number().over(Window.partitionBy(question_id, "chunk_id").orderBy(*place)))
    order = Window.partitionBy(question_id).orderBy(*place)
    return first.where("__nth = 1").select(
        question_id, F.row_number().over(order).alias("ord"), "token", "fuzzy", "chunk_id", *kept
    )


def code_hits(questions: DataFrame, index: DataFrame, text: str = "text", question_id: str = "query_id") -> DataFrame:
    """The matches of ``detect_codes`` without order, a passage once for every token and code that leads to it.

    Result: (query, tok_pos, token, fuzzy, *index columns). One equi-join on the look-alike key serves exact matches and look-alikes.
    Tokens that no code of the index begins like are dropped where they are cut, before any shuffle.
    """
    has_scope = "scope" in questions.columns
    carried = [question_id, *(["scope"] if has_scope else [])]

    def keyed(token: Column) -> Column:
        return F.struct(token.alias("token"), token_key(token).alias("tok_key"), lookalike_key(token_key(token)).alias("fold"))

    # Keys leave the generator as columns; as expressions they would be worked out again in every filter and join.
    tokens = questions.select(
        *carried, F.posexplode(F.transform(query_code_candidates(F.col(text)), keyed)).alias("tok_pos", "__t")
    ).select(*carried, "tok_pos", "__t.*")
    # A token is as long as its look-alikes, so other entries are never asked for.
    index = index.where(F.length("fold").between(*CANDIDATE_LENGTHS))
    beginning = (F.length("fold").alias("__length"), F.substring("fold", 1, 2).alias("__start"))
    # At most 38 * 38 starts of the characters of a token, at four lengths.
    known = index.select(*beginning).where(F.col("__start").rlike(r"^[A-Z0-9.\-]{2}$")).distinct()
    tokens = tokens.select("*", *beginning).join(F.broadcast(known), ["__length", "__start"], "left_semi").drop("__length", "__start")
    # The keys of a manual that look the same, at most 64, tell in the row whether the token has an exact match there.
    alike = Window.partitionBy("fold", "manual_id")
    index = index.withColumn("__keys", F.collect_set("code_key").over(alike))
    hits = tokens.join(index, "fold").withColumn("fuzzy", F.col("tok_key") != F.col("code_key"))
    hits = hits.where(~F.col("fuzzy") | (reads_like_display(F.col("token")) & ~F.array_contains("__keys", F.col("tok_key"))))
    if has_scope:
        hits = hits.where(F.col("scope").isNull() | F.array_contains("scope", F.col("manual_id")))
    return hits.drop("__keys", "fold", "tok_key", *(["scope"] if has_scope else []))


def append_matches(first: DataFrame, more: DataFrame, question_id: str = "query_id") -> DataFrame:
    """Matches of a second text after those of the first; passages already matched are not repeated."""
    stacked = first.withColumn("src", F.lit(0)).unionByName(more.withColumn("src", F.lit(1)))
    place = F.struct("src", "ord")
    cols = [c for c in first.columns if c not in (question_id, "chunk_id", "ord")]
    kept = stacked.groupBy(question_id, "chunk_id").agg(F.min_by(F.struct(place.alias("place"), *cols), place).alias("m"))
    order = Window.partitionBy(question_id).orderBy("m.place")
    return kept.select(
        question_id, F.row_number().over(order).alias("ord"), "chunk_id", *[F.col(f"m.{c}").alias(c) for c in cols]
    ).select(*first.columns)


# --- keyword search (F4) ---------------------------------------------------------------------------------------


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_terms(questions: DataFrame, text: str = "text", question_id: str = "query_id") -> DataFrame:
    """Distinct (query, lexeme) without stop words."""
    kept = F.filter(F.array_distinct(lexemes(F.col(text))), lambda w: ~w.isin(*STOP_WORDS))
    return questions.select(question_id, F.explode(kept).alias("lexeme"))


def postings(
    passages: DataFrame, only: DataFrame | None = None, heading: str | None = "heading", text: str = "text",
    passage_id: str = "passage_id", carry: Sequence[str] = (),
) -> DataFrame:
    """(passage, carried columns, lexeme, heading_hits, body_hits). ``only`` limits the lexemes.

    No text is shuffled. Without ``only`` the lexemes of a passage are counted inside its row, with two rows for a lexeme of
    both heading and body; with it, each occurrence of a wanted lexeme is a row. Sums over (passage, lexeme) are whole
    either way.
    """
    def marked(column: str, mark: str) -> Column:
        return F.transform(lexemes(F.coalesce(F.col(column), F.lit(""))), lambda w: F.concat(F.lit(mark), w))

    found = F.concat(marked(text, "b"), marked(heading, "h")) if heading else marked(text, "b")
    if only is None:
        # The outer form: for the plain one Spark adds a filter on the generator's input, which would count every row twice.
        rows = passages.select(passage_id, *carry, F.inline_outer(runs(found)).alias("lexeme", "n")).where("lexeme is not null")
    else:
        wanted = only.select("lexeme").distinct()
        wanted = wanted.select(F.explode(F.array(F.concat(F.lit("b"), "lexeme"), F.concat(F.lit("h"), "lexeme"))).alias("lexeme"))
        rows = passages.select(passage_id, *carry, F.explode_outer(found).alias("lexeme"), F.lit(1).cast("long").alias("n"))
        rows = rows.join(wanted, "lexeme", "left_semi")
    return rows.select(
        passage_id, *carry, F.expr("substring(lexeme, 2)").alias("lexeme"),
        F.when(F.col("lexeme").startswith("h"), F.col("n")).otherwise(0).alias("heading_hits"),
        F.when(F.col("lexeme").startswith("b"), F.col("n")).otherwise(0).alias("body_hits"),
    )


def keyword_topk(
    terms: DataFrame, index: DataFrame, k: int, scopes: DataFrame | None = None,
    question_id: str = "query_id", passage_id: str = "passage_id",
) -> DataFrame:
    """The k best passages per question by weighted lexeme hits: (query, passage, score, rank).

    ``scopes`` (query, scope) limits questions to manuals; the index must then carry ``manual_id``. Hits are summed
    as integers, so scores do not depend on the order of summation.
    """
    if scopes is not None:
        terms = terms.join(scopes.select(question_id, "scope"), question_id, "left")
    hits = index.join(terms, "lexeme")
    if scopes is not None:
        hits = hits.where(F.col("scope").isNull() | F.array_contains("scope", F.col("manual_id")))
    # Sums are partial before the shuffle; AQE turns the join into a broadcast join when the terms are few.
    scored = hits.groupBy(passage_id, question_id).agg(
        F.sum("heading_hits").alias("h"), F.sum("body_hits").alias("b")
    ).select(question_id, passage_id, (F.col("h") * HEADING_WEIGHT + F.col("b") * BODY_WEIGHT).alias("score"))
    return top_per_group(scored, [question_id], [F.col("score").desc(), F.col(passage_id)], k)


# --- fusion and ordering (F9-F15) ------------------------------------------------------------------------------


def fuse(rankings: DataFrame, k: int = FUSION_K, question_id: str = "query_id", item: str = "passage_id") -> DataFrame:
    """Reciprocal rank fusion of (query, lane_no, item, rank from 1): (query, item, fused, fused_pos).

    An item holds one row per lane, so its terms form a short list that is summed in lane order.
    """
    term = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    summed = rankings.groupBy(question_id, item).agg(
        F.array_sort(F.collect_list(F.struct("lane_no", term.alias("t")))).alias("terms")
    )
    fused = summed.select(
        question_id, item, F.aggregate("terms", F.lit(0.0), lambda acc, x: acc + x["t"]).alias("fused")
    )
    order = Window.partitionBy(question_id).orderBy(F.col("fused").desc(), F.col(item))
    return fused.withColumn("fused_pos", F.row_number().over(order))


def candidate_pool(
    fused: DataFrame, exact: DataFrame, reserved: DataFrame, cap: int = CANDIDATES,
    question_id: str = "query_id", passage_id: str = "passage_id",
) -> DataFrame:
    """Fused items without exact matches, cut to ``cap``, plus reserved items the cut dropped.

    ``reserved`` carries (query, item, slot). Result: (query, item, fused_pos, slot).
    """
    # Exact matches leave before the cut, so the cut ranks what is left.
    left = fused.join(exact.select(question_id, passage_id), [question_id, passage_id], "left_anti")
    order = Window.partitionBy(question_id).orderBy("fused_pos")
    left = left.withColumn("left_pos", F.row_number().over(order))
    tagged = left.join(reserved.select(question_id, passage_id, "slot"), [question_id, passage_id], "left")
    return tagged.where((F.col("left_pos") <= cap) | F.col("slot").isNotNull()).select(
        question_id, passage_id, "fused_pos", "slot"
    )


def overlap_rerank(
    pool: DataFrame, passages: DataFrame, question: str = "search_text", passage: str = "passage",
    question_id: str = "query_id", passage_id: str = "passage_id",
) -> DataFrame:
    """Add ``score``: the share of the question's distinct words that occur in the candidate passage.

    A passage wanted by many questions is cut into words once, then joined to them.
    """
    wanted = passages.join(pool.select(passage_id).distinct(), passage_id, "left_semi")
    has = wanted.select(passage_id, F.explode(F.array_distinct(words(F.col(passage)))).alias("word"))
    asked = pool.select(question_id, question).distinct().select(
        question_id, F.array_distinct(words(F.col(question))).alias("asked")
    )
    cells = pool.select(question_id, passage_id).join(asked, question_id)
    hits = (
        cells.select(question_id, passage_id, F.explode("asked").alias("word"))
        .join(has, [passage_id, "word"])
        .groupBy(question_id, passage_id)
        .agg(F.count("*").alias("__hits"))
    )
    sizes = asked.select(question_id, F.greatest(F.size("asked"), F.lit(1)).alias("__asked"))
    joined = pool.join(hits, [question_id, passage_id], "left").join(sizes, question_id)
    share = F.coalesce("__hits", F.lit(0)) / F.col("__asked")
    return joined.withColumn("score", share).drop("__hits", "__asked")


def place_slots(
    scored: DataFrame, slot_position: int = SLOT_POSITION, question_id: str = "query_id"
) -> DataFrame:
    """Add ``pos``: by score, ties in fused order, reserved items right after the first ``slot_position`` others."""
    is_reserved = F.col("slot").isNotNull()
    by_score = Window.partitionBy(question_id, is_reserved).orderBy(F.col("score").desc(), "fused_pos")
    everyone = Window.partitionBy(question_id)
    ranked = scored.withColumn("nth", F.row_number().over(by_score)).withColumns({
        "n_reserved": F.count("slot").over(everyone), "n_rest": F.count_if(~is_reserved).over(everyone),
        "slot_nth": F.row_number().over(Window.partitionBy(question_id, is_reserved).orderBy("slot")),
    })
    before = F.least(F.lit(slot_position), F.col("n_rest"))
    pos = F.when(is_reserved, before + F.col("slot_nth")).otherwise(
        F.col("nth") + F.when(F.col("nth") > slot_position, F.col("n_reserved")).otherwise(0)
    )
    return ranked.withColumn("pos", pos).drop("nth", "n_reserved", "n_rest", "slot_nth")


def pin_exact(
    matches: DataFrame, placed: DataFrame, top_k: int = TOP_K, question_id: str = "query_id",
    passage_id: str = "passage_id",
) -> DataFrame:
    """Exact matches first with score 1, then the placed candidates, cut at max(top_k, pins).

    ``matches``: (query, ord, passage, code). Result: (query, pos, passage, score, code, pins).
    """
    pinned = matches.select(
        question_id, passage_id, F.col("ord").alias("pos"), F.lit(1.0).alias("score"), "code", F.lit(1).alias("pin")
    )
    rest = placed.select(
        question_id, passage_id, F.col("pos"), "score", F.lit(None).cast("string").alias("code"), F.lit(0).alias("pin")
    )
    both = pinned.unionByName(rest)
    # Bounded groups: at most 32 candidates plus the matched entries of one question.
    group = Window.partitionBy(question_id)
    both = both.withColumn("pins", F.sum("pin").over(group)).withColumn(
        "final", F.row_number().over(group.orderBy(F.col("pin").desc(), "pos"))
    )
    return both.where(F.col("final") <= F.greatest(F.lit(top_k), F.col("pins"))).select(
        question_id, F.col("final").alias("pos"), passage_id, "score", "code", "pins"
    )


def top_scores(questions: DataFrame, retrieved: DataFrame, question_id: str = "query_id") -> DataFrame:
    """(query, top_score), 0 for questions that retrieved nothing."""
    best = retrieved.groupBy(question_id).agg(F.max("score").alias("top_score"))
    return questions.select(question_id).join(best, question_id, "left").withColumn(
        "top_score", F.coalesce("top_score", F.lit(0.0))
    )
