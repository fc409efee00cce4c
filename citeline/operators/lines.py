"""From ordered lines of documents to section passages.

A ``lines`` table holds doc_id, page, idx, x0, y0, x1, y1, page_w, page_h, spans array<struct<text,font,size>>.
(page, idx) is the reading order; ``pos`` packs it into one number. Pages bound every block scanned here.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.functions.identifiers import collapse_spaces, strip
from citeline.operators.packing import pack_lines
from citeline.operators.scans import fill_forward, number_islands, running_extreme, running_sum
from citeline.session import settle

# Bands, repeat count, font shapes, piece size, title rules.
TOP_BAND = 0.08
BOTTOM_BAND = 0.92
MIN_REPEATS = 3
PAGE_NUMBER = r"^[0-9]{1,4}$"
CODE_FONT = r"(?i)DigitFont|CourierNew"
MAX_CHARS = 2800
LEADER = r"(?U)\.{5,}\s*\d+\s*$"
SKIPPED_TITLE = r"(?i)^(table of contents|contents)$"
TITLE_MIN = 8
TITLE_CUT = 40

PAGE_SPAN = 1 << 31


def line_text(spans: Column) -> Column:
    return strip(F.array_join(F.transform(spans, lambda s: s["text"]), ""))


def position(page: Column, idx: Column) -> Column:
    return page.cast("long") * PAGE_SPAN + idx


def with_text(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"text": line_text(F.col("spans")), "pos": position(F.col("page"), F.col("idx"))})


def lines_of_text(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Plain text as lines: (doc_id, idx, text)."""
    return documents.select(doc_id, F.posexplode(F.split(text, "\n")).alias("idx", "text"))


def page_range(lines: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    return lines.where(F.col("page").between(first, last))


# --- running headers, footers and page numbers (B1-B3) ----------------------------------------------------------


def in_band() -> Column:
    return (F.col("y1") <= TOP_BAND * F.col("page_h")) | (F.col("y0") >= BOTTOM_BAND * F.col("page_h"))


def repeated_texts(
    lines: DataFrame, group: list[str], unit: str, text: str = "norm", at_least: int = MIN_REPEATS
) -> DataFrame:
    """(group, text) pairs that occur in at least ``at_least`` distinct units."""
    return (
        lines.groupBy(*group, text)
        .agg(F.countDistinct(unit).alias("units"))
        .where(F.col("units") >= at_least)
    )


def strip_running_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept lines, printed page numbers). Repeated band texts and bare page numbers in a band are dropped."""
    banded = with_text(lines).withColumns({"band": in_band(), "norm": collapse_spaces(F.col("text"))})
    running = repeated_texts(banded.where("band"), ["doc_id"], "page").select(
        "doc_id", "norm", F.lit(True).alias("running")
    )
    numbers = banded.where(F.col("band") & F.col("text").rlike(PAGE_NUMBER))
    printed = numbers.groupBy("doc_id", "page").agg(F.max_by(F.col("text").cast("int"), "idx").alias("printed"))
    tagged = banded.join(running, ["doc_id", "norm"], "left")
    drop = F.col("band") & (F.col("running").isNotNull() | F.col("text").rlike(PAGE_NUMBER))
    return tagged.where(~drop).drop("band", "norm", "running"), printed


def page_mismatches(printed: DataFrame) -> DataFrame:
    return printed.where(F.col("printed").isNotNull() & (F.col("printed") != F.col("page")))


# --- outline: paths and starts (B4, B5) -------------------------------------------------------------------------


def outline_paths(outline: DataFrame, page_counts: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Add ``depth`` and ``path`` ("A > B > C") to outline entries on existing pages.

    A level may jump, so an entry's depth is at most one below the entry before it: depth = min(level, previous
    depth + 1), a running minimum. Its ancestors are the latest entries of each smaller depth.
    """
    kept = outline.join(page_counts, "doc_id").where(F.col("page").between(1, F.col("page_count"))).drop("page_count")
    kept = kept.withColumn("__b", F.floor(F.col("ord") / block_rows)).withColumn("__one", F.lit(1))
    kept = running_sum(kept, ["doc_id"], "__b", ["ord"], {"n": "__one"})
    kept = kept.withColumn("level1", F.greatest("level", F.lit(1)))
    kept = settle(kept, "outline").withColumn("slack", F.least(F.col("level1") - F.col("n"), F.lit(0)))
    floor = running_extreme(kept, ["doc_id"], "__b", ["ord"], {"lowest": "slack"}, F.min, F.least)
    deep = settle(floor, "depths").withColumn("depth", (F.col("n") + F.col("lowest")).cast("int"))
    deepest = outline.agg(F.max(F.greatest("level", F.lit(1))).alias("d")).first()["d"] or 1
    levels = range(1, int(deepest) + 1)
    deep = deep.withColumns({f"__t{d}": F.when(F.col("depth") == d, F.col("title")) for d in levels})
    filled = fill_forward(deep, ["doc_id"], "__b", ["ord"], {f"__a{d}": f"__t{d}" for d in levels})
    titles = F.array(*[F.when(F.col("depth") >= d, F.col(f"__a{d}")) for d in levels])
    return filled.withColumn("path", F.array_join(F.array_compact(titles), " > ")).select(
        *outline.columns, "depth", "path"
    )


def title_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def title_matches(line: Column, wanted: Column) -> Column:
    """Normalised titles agree: equal, or one begins with the other (at least eight characters)."""
    return (line != "") & (wanted != "") & (
        (line == wanted)
        | ((F.length(wanted) >= TITLE_MIN) & F.startswith(line, F.substring(wanted, 1, TITLE_CUT)))
        | ((F.length(line) >= TITLE_MIN) & F.startswith(wanted, line))
    )


def section_starts(lines: DataFrame, outline: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Where each outline entry begins: (doc_id, ord, title, path, start, found).

    An entry starts at the first line of its page that matches its title and is not before the previous start; when
    none does, it starts at the later of page top and previous start. A start always lies on the highest page seen
    so far in outline order, so entries chain only within that page: the fold below runs per (document, page).
    """
    texts = lines.select("doc_id", "page", "pos", title_key(F.col("text")).alias("line_key"))
    keyed = outline.withColumns({"title_key": title_key(F.col("title")), "__b": F.floor(F.col("ord") / block_rows)})
    high = running_extreme(keyed, ["doc_id"], "__b", ["ord"], {"high": "page"}, F.max, F.greatest)
    high = settle(high, "entries")
    # Entries behind the highest page cannot match any line at or after the previous start.
    able = high.where(F.col("page") == F.col("high"))
    hits = able.join(texts, ["doc_id", "page"]).where(title_matches(F.col("line_key"), F.col("title_key")))
    hits = hits.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list("pos")).alias("hits"))
    entries = settle(high.join(hits, ["doc_id", "ord"], "left"), "hits")
    entry = F.struct("ord", "title", "path", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"))
    pages = entries.groupBy("doc_id", "high").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    placed = F.aggregate(
        "entries",
        F.struct(
            position(F.col("high"), F.lit(0)).alias("at"),
            F.array().cast("array<struct<ord:int,start:bigint,found:boolean>>").alias("out"),
        ),
        lambda acc, e: _place(acc, e),
        lambda acc: acc["out"],
    )
    starts = pages.select("doc_id", F.inline(placed))
    return starts.join(entries.select("doc_id", "ord", "page", "title", "path"), ["doc_id", "ord"])


def _place(acc: Column, entry: Column) -> Column:
    first = F.get(F.filter(entry["hits"], lambda p: p >= acc["at"]), F.lit(0))
    start = F.coalesce(first, acc["at"])
    made = F.struct(entry["ord"].cast("int").alias("ord"), start.alias("start"), first.isNotNull().alias("found"))
    return F.struct(start.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))


def titles_not_found(starts: DataFrame) -> DataFrame:
    return starts.where(~F.col("found")).select("doc_id", "ord", F.format_string("p%d: %s", "page", "title").alias("note"))


# --- sections and chunks (B6-B11) -------------------------------------------------------------------------------


def assign_sections(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Give each line the latest start at or before it (``sec_ord``, ``path``, ``title``); earlier lines go."""
    marks = starts.select(
        "doc_id", F.shiftright("start", 31).cast("int").alias("page"), F.col("start").alias("pos"),
        F.lit(0).alias("is_line"), F.col("ord").alias("tie"),
        F.struct(F.col("ord").alias("sec_ord"), "path", "title").alias("mark"),
    )
    rows = lines.withColumns({
        "is_line": F.lit(1), "tie": F.lit(0), "mark": F.lit(None).cast(marks.schema["mark"].dataType),
    })
    both = rows.unionByName(marks, allowMissingColumns=True)
    filled = fill_forward(both, ["doc_id"], "page", ["pos", "is_line", "tie"], {"section": "mark"})
    return filled.where((F.col("is_line") == 1) & F.col("section").isNotNull()).select(
        *lines.columns, "section.sec_ord", "section.path", "section.title"
    )


def drop_noise(lines: DataFrame, consumed: DataFrame | None = None) -> DataFrame:
    """Without contents sections, dotted leaders and lines that fault records own."""
    kept = lines.where(~strip(F.col("title")).rlike(SKIPPED_TITLE) & ~F.col("text").rlike(LEADER))
    if consumed is not None:
        kept = kept.join(consumed.select("doc_id", "page", "idx"), ["doc_id", "page", "idx"], "left_anti")
    return kept


def kind_runs(lines: DataFrame, safety_pages: DataFrame) -> DataFrame:
    """Add ``kind``, the number ``run`` of each stretch of one kind within a section, and ``n`` within the run."""
    tagged = lines.join(
        safety_pages.select("doc_id", "page", F.lit("safety").alias("kind")), ["doc_id", "page"], "left"
    ).withColumn("kind", F.coalesce("kind", F.lit("section")))
    return number_islands(
        tagged, ["doc_id"], "page", ["pos"], ["kind", "sec_ord"],
        lambda before: (F.col("kind") != before["kind"]) | (F.col("sec_ord") != before["sec_ord"]), out="run", nth="n",
    )


def split_runs(lines: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Add ``piece``: section runs are packed greedily up to ``max_chars``, safety runs stay whole."""
    sized = lines.withColumn("cost", (F.length("text") + 1).cast("int"))
    packed = pack_lines(sized.where("kind <> 'safety'"), ["doc_id", "run"], "n", "cost", max_chars)
    whole = sized.where("kind = 'safety'").withColumn("piece", F.lit(0).cast("long"))
    return packed.unionByName(whole).drop("n", "cost")


def assemble_chunks(lines: DataFrame, manual_id: str = "doc_id") -> DataFrame:
    """Pieces as passages: id ``manual:sNNNNN`` counted over the non-empty passages of a manual."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    joined = lines.groupBy("doc_id", "run", "piece", "kind", "path").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min("pos").alias("at"),
        strip(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("text"),
    ).where("text <> ''").withColumn("__one", F.lit(1))
    joined = settle(joined, "pieces")
    counted = running_sum(joined, ["doc_id"], "page_start", ["at"], {"n": "__one"})
    return counted.select(
        F.format_string("%s:s%05d", F.col(manual_id), F.col("n") - 1).alias("id"), F.col(manual_id).alias("manual_id"),
        "kind", F.col("path").alias("heading_path"), "page_start", "page_end", "text",
    )


def embedding_text(family: Column, heading: Column, text: Column) -> Column:
    return F.concat(family, F.lit(" | "), heading, F.lit("\n"), text)


def passage_text(heading: Column, text: Column) -> Column:
    return F.concat(heading, F.lit("\n"), text)


def section_chunks(
    lines: DataFrame, outline: DataFrame, documents: DataFrame, consumed: DataFrame | None = None,
    safety_pages: DataFrame | None = None, max_chars: int = MAX_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, titles not found). ``documents``: doc_id, page_count, name (the path of documents without outline)."""
    pages = documents.select("doc_id", "page_count")
    starts = settle(section_starts(lines, settle(outline_paths(outline, pages), "paths")), "starts")
    bare = documents.join(starts.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("start"), F.lit(True).alias("found"),
        F.lit(0).alias("page"), F.lit("").alias("title"), F.col("name").alias("path"),
    )
    placed = assign_sections(lines, starts.unionByName(bare))
    kept = drop_noise(placed, consumed)
    if safety_pages is None:
        safety_pages = lines.sparkSession.createDataFrame([], "doc_id string, page int")
    split = split_runs(settle(kind_runs(kept, safety_pages), "runs"), max_chars)
    return assemble_chunks(split), titles_not_found(starts)
