"""Sentence-wise translation tables: masked segments out, restored texts back, originals where a check fails."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.functions.text import mask_spans, restore_spans, split_sentences, unspell_markers


def mask_corpus(texts: DataFrame, text: str = "text", code_keys: str | None = None) -> DataFrame:
    """Add ``masked`` and ``kept``. ``code_keys`` names an array column of codes protected in any case."""
    masked = mask_spans(F.col(text), F.col(code_keys) if code_keys else None)
    return texts.withColumn("__m", masked).select(*texts.columns, "__m.masked", "__m.kept")


def segments(masked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seg, segment): what goes to the translation model."""
    return masked.select(*keys, F.posexplode(split_sentences(F.col("masked"))).alias("seg", "segment"))


def restore_corpus(masked: DataFrame, asked: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, restored): translated segments joined in order, markers put back; NULL where any segment is blank or
    missing, a marker was lost, doubled or invented, or nothing is left.

    ``translated``: keys, seg, output. Segments of one text only are brought together.
    """
    joined = asked.select(*keys, "seg").join(translated.select(*keys, "seg", "output"), [*keys, "seg"], "left")
    output = F.trim(F.coalesce("output", F.lit("")))
    whole = joined.withColumn("out", output).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seg", "out"))).alias("parts"), F.bool_and(F.col("out") != "").alias("full")
    )
    text = F.when(F.col("full"), F.array_join(F.transform("parts", lambda p: p["out"]), " "))
    rejoined = masked.select(*keys, "kept").join(whole.select(*keys, text.alias("text")), keys, "left")
    restored = restore_spans(unspell_markers(F.col("text")), F.col("kept"))
    return rejoined.select(*keys, F.when(F.trim(restored) != "", restored).alias("restored"))


def with_fallback(originals: DataFrame, restored: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Add ``shown`` and ``fallback``: the translation, or the original where the translation failed its check."""
    joined = originals.join(restored, keys, "left")
    return joined.select(
        *originals.columns, F.coalesce("restored", text).alias("shown"), F.col("restored").isNull().alias("fallback")
    )
