"""The identifiers each manual contains, and which manuals a question is about."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions.identifiers import (
    bracket_labels, code_key, code_like_tokens, label_key, lookalike_key, loose_label_key, strip, token_key, tokens,
)
from citeline.operators.lines import CODE_FONT

TRAILING_LABEL = r"(?U)\[([^\[\]]+)\]\s*$"  # fixed value


def first_entries(entries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest entry per key, by a pre-aggregated minimum."""
    rest = [c for c in entries.columns if c not in (*keys, *order)]
    record = F.struct(*rest)
    return entries.groupBy(*keys).agg(F.min_by(record, F.struct(*order)).alias("r")).select(*keys, "r.*")


def build_lexicon(lines: DataFrame, faults: DataFrame) -> DataFrame:
    """(manual_id, kind, code_key, code, label, first_page): the first occurrence per manual, kind and key.

    Fault codes and fault names come before anything printed on a page.
    """
    none = F.lit(None).cast("string")

    def entry(frame, kind, code, key, label, page, *order):
        names = ("o1", "o2", "o3", "o4", "o5")
        padded = [*order, *[F.lit(0)] * (5 - len(order))]
        return frame.select(
            "manual_id", F.lit(kind).alias("kind"), key.alias("code_key"), code.alias("code"), label.alias("label"),
            page.alias("first_page"), *[o.cast("long").alias(n) for o, n in zip(padded, names)],
        )

    page = F.col("page")
    named = entry(faults, "label", F.col("name"), label_key(F.col("name")), none, page, F.lit(0), F.col("ord"))
    coded = entry(faults, "fault", F.col("code"), F.col("code_key"), F.col("name"), page, F.lit(0), F.col("ord"))
    base = lines.withColumn("manual_id", F.col("doc_id"))
    with_before = F.zip_with(
        "spans", F.concat(F.array(F.lit("")), F.transform("spans", lambda s: s["text"])),
        lambda span, before: F.struct(span.alias("span"), before.alias("before")),
    )
    spans = base.select("manual_id", "page", "pos", F.posexplode(with_before).alias("n", "s"))
    spans = spans.where(F.col("s.span").isNotNull() & F.col("s.span.font").rlike(CODE_FONT))
    label = strip(F.regexp_extract("s.before", TRAILING_LABEL, 1))
    hmi = spans.select(
        "manual_id", "page", "pos", "n", F.when(F.col("s.before").rlike(TRAILING_LABEL), label).alias("label"),
        F.posexplode(tokens(F.col("s.span.text"))).alias("t", "token"),
    )
    hmi = entry(hmi, "hmi", F.col("token"), token_key(F.col("token")), F.col("label"), page, F.lit(1), F.col("pos"), F.col("n"), F.col("t"))
    printed = base.select("manual_id", "page", "pos", F.posexplode(code_like_tokens(F.col("text"))).alias("t", "token"))
    token = entry(printed, "token", F.col("token"), token_key(F.col("token")), none, page, F.lit(1), F.col("pos"), F.col("t"))
    bracketed = base.select("manual_id", "page", "pos", F.posexplode(bracket_labels(F.col("text"))).alias("t", "lab"))
    labels = entry(bracketed, "label", F.col("lab"), label_key(F.col("lab")), none, page, F.lit(1), F.col("pos"), F.col("t"))
    everything = named.unionByName(coded).unionByName(hmi).unionByName(token).unionByName(labels).where("code_key <> ''")
    return first_entries(everything, ["manual_id", "kind", "code_key"], ["o1", "o2", "o3", "o4", "o5"])


def key_spelling(key: Column) -> Column:
    """The key under which a code with this comparison key is known: equal for all its display look-alikes."""
    return F.concat(F.lit("c:"), lookalike_key(key))


def code_spelling(code: Column) -> Column:
    """``key_spelling`` of a code as it is written."""
    return key_spelling(code_key(code))


def token_spelling(token: Column) -> Column:
    """``code_spelling`` of a token of running text."""
    return key_spelling(token_key(token))


def label_spelling(label: Column) -> Column:
    """The key under which a label is known, whether its words are joined by blanks or underscores."""
    return F.concat(F.lit("l:"), loose_label_key(label_key(label)))


def known_identifiers(lexicon: DataFrame) -> DataFrame:
    """(manual_id, spelling): codes and labels of each manual as one long table for joins."""
    spelling = F.when(F.col("kind") == "label", label_spelling(F.col("code_key"))).otherwise(code_spelling(F.col("code_key")))
    return lexicon.select("manual_id", spelling.alias("spelling")).distinct()


# --- models named in a question (D9, D10) -----------------------------------------------------------------------


def named_models(
    questions: DataFrame, patterns: Sequence[tuple[str, str | None]], text: str = "text", question_id: str = "query_id"
) -> DataFrame:
    """(query, nth, model) in order of appearance, distinct. Each pattern is (regex, prefix).

    With a prefix the regex has one group, the number; without one, group 1 is the series and group 2 the number.
    The place of a match is the total length of the text pieces before it.
    """
    found = []
    for pattern, prefix in patterns:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        number = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if prefix else 2))
        series = F.lit(prefix) if prefix else None
        if series is None:
            models = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), number, lambda s, n: F.concat(s, n))
        else:
            models = F.transform(number, lambda n: F.concat(series, n))
        rows = questions.select(
            question_id, F.posexplode(models).alias("i", "m"), F.split(text, pattern, -1).alias("gaps"), whole.alias("wholes")
        )
        total = lambda texts: F.aggregate(texts, F.lit(0), lambda acc, t: acc + F.length(t))
        at = total(F.slice("gaps", F.lit(1), F.col("i") + 1)) + total(F.slice("wholes", F.lit(1), F.col("i")))
        found.append(rows.select(question_id, at.alias("at"), F.upper("m").alias("model")))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    firsts = hits.groupBy(question_id, "model").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy(question_id).orderBy("at", "model"))
    return firsts.select(question_id, nth.alias("nth"), "model")


def model_manuals(manuals: DataFrame) -> DataFrame:
    """(model, manual_id) from each manual's list of models; the last manual listing a model wins.

    The order is that of the column ``ord``, the place in the registry, where the table has it, then that of the ids.
    """
    place = F.struct("ord", "id") if "ord" in manuals.columns else F.struct("id")
    listed = manuals.select(F.col("id").alias("manual_id"), place.alias("place"), F.explode("models").alias("m"))
    return listed.groupBy(F.upper("m").alias("model")).agg(F.max_by("manual_id", "place").alias("manual_id"))
