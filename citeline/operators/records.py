"""Fault records from heading blocks and from ruled tables.

``lines`` here is the table of ``lines.with_text``; table rows are (doc_id, page, tbl, row, cells array<string>)
with NULL for merged cells.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.functions.identifiers import code_key, collapse_spaces, strip
from citeline.operators.lines import CODE_FONT
from citeline.operators.scans import fill_forward, number_islands, running_extreme
from citeline.session import settle

# Field labels, heading sizes, code shape, bullets, the sentence ends that close an item.
FIELD_LABELS = {"probable cause": "causes", "remedy": "remedies", "clearing the error code": "clearing"}
HEADING_SIZE = 15.0
TERMINATOR_SIZE = 17.0
CODE_SHAPE = r"^(?:[A-Z0-9][A-Z0-9.\-]{1,6}|-{2,4})$"
BULLET = r"(?U)^[•●▪][\s\x1c-\x1f]*"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CLOSES_ITEM = r"[.:!?]$"
CONTINUED = r"(?iU)\s*\(continued\)\s*$"
FOOTNOTE = r"(?U)\(\d+\)"
NO_CODE = "unreadable code"
NO_CAUSES = "no 'Probable Cause' content"
NO_REMEDIES = "no 'Remedy' content"
NO_CODE_FONT = "heading-like line without a code-font code"


# --- line classes and blocks (C1-C3) ----------------------------------------------------------------------------


def _span(n: int) -> Column:
    return F.get("spans", F.lit(n))


def is_fault_heading() -> Column:
    first, second = _span(0), _span(1)
    return F.coalesce(
        F.ltrim(first["text"]).startswith("[") & first["font"].contains("Bold") & (first["size"] >= HEADING_SIZE)
        & second["font"].rlike(CODE_FONT),
        F.lit(False),
    )


def is_terminator() -> Column:
    first = _span(0)
    return F.coalesce(first["font"].contains("Bold") & (first["size"] >= TERMINATOR_SIZE), F.lit(False)) & ~is_fault_heading()


def split_blocks(
    rows: DataFrame, opens: Column, closes: Column, keys: list[str], block: str, order: list[str],
    label: Column | None = None, default: str = "description",
) -> DataFrame:
    """Rows inside blocks, with ``block_at`` = the order key of the row that opened the block.

    An opening row starts a block, the next opening or closing row ends it; rows outside blocks drop out. ``label``
    names the ``field`` of its row and of the rows after it; an opening row starts over with ``default``. Both are
    the latest mark at or before a row, so one forward fill finds them.
    """
    at = F.struct(*order)
    kind = "struct<" + ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in order) + ">"
    marks = {"__mark": F.when(opens, F.struct(at.alias("at"))).when(closes, F.struct(F.lit(None).cast(kind).alias("at")))}
    fills = {"__block": "__mark"}
    if label is not None:
        marks["__label"] = F.when(opens, F.lit(default)).otherwise(label)
        fills["field"] = "__label"
    filled = fill_forward(rows.withColumns(marks), keys, block, order, fills)
    return filled.withColumn("block_at", F.col("__block.at")).where("block_at is not null").drop("__block", *marks)


# --- item assembly (C4) ----------------------------------------------------------------------------------------


def assemble_items(
    lines: DataFrame, group: list[str], block: str, order: list[str], text: str = "text", pages: list[str] | None = None
) -> DataFrame:
    """Join wrapped lines into items: (group, item_no, item).

    A bullet opens an item; a capitalised line after a line that ends a sentence opens one; anything else, also the
    text after a bare bullet, continues. Blank lines do not count.
    """
    trimmed = lines.withColumn("__t", strip(F.col(text))).where("__t <> ''")
    body = F.regexp_replace("__t", BULLET, "")
    rows = trimmed.select(*group, block, *[c for c in order if c != block], F.col("__t").rlike(BULLET).alias("bullet"),
                          strip(body).alias("body"))

    def opens(before: dict[str, Column]) -> Column:
        new_sentence = before["body"].rlike(CLOSES_ITEM) & F.col("body").rlike(r"(?U)^\p{Upper}")
        return F.col("bullet") | new_sentence

    numbered = number_islands(rows, group, block, order, ["bullet", "body"], opens, out="island")
    ordered = F.array_sort(F.collect_list(F.struct(*order, "body")))
    items = numbered.where("body <> ''").groupBy(*group, "island").agg(
        collapse_spaces(F.array_join(F.transform(ordered, lambda x: x["body"]), " ")).alias("item")
    )
    return items.select(*group, F.col("island").alias("item_no"), "item")


def collect_items(items: DataFrame, group: list[str], out: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("item_no", "item")))
    return items.groupBy(*group).agg(F.transform(ordered, lambda x: x["item"]).alias(out))


def items_of_cell(cell: Column) -> Column:
    """The same rule inside one table cell (a short text, folded in place)."""
    raw = F.transform(F.split(F.coalesce(cell, F.lit("")), LINE_BREAK, -1), strip)
    lines = F.filter(raw, lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        body = strip(F.regexp_replace(line, BULLET, ""))
        ends = acc["open"].rlike(CLOSES_ITEM) & line.rlike(r"(?U)^\p{Upper}")
        fresh = line.rlike(BULLET) | ends
        closed = F.when(fresh & (acc["open"] != ""), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        grown = F.when(fresh | (acc["open"] == ""), body).otherwise(F.concat_ws(" ", acc["open"], body))
        return F.struct(closed.alias("done"), grown.alias("open"))

    folded = F.aggregate(
        lines, start, step,
        lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    return F.transform(folded, collapse_spaces)


# --- block records (C5) ----------------------------------------------------------------------------------------


def block_faults(lines: DataFrame, fault_pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejected, consumed lines) of heading-block manuals. ``fault_pages``: doc_id, first, last."""
    inside = lines.join(fault_pages, "doc_id").where(F.col("page").between(F.col("first"), F.col("last"))).drop("first", "last")
    keys, block, order = ["doc_id"], "page", ["pos"]
    inside = inside.withColumns({"head": is_fault_heading(), "stop": is_terminator()})
    stray = inside.where(F.col("stop") & F.col("text").startswith("[")).select(
        "doc_id", "page", "pos", F.lit(NO_CODE_FONT).alias("reason"), F.col("text").alias("raw")
    )
    label = F.lit(None).cast("string")
    for phrase, field in FIELD_LABELS.items():
        label = F.when(F.lower("text") == phrase, F.lit(field)).otherwise(label)
    rows = split_blocks(
        inside.withColumn("label", label), F.col("head"), F.col("stop"), keys, block, order, label=F.col("label")
    )
    rows = settle(rows.withColumn("block_at", F.col("block_at.pos")), "blocks")
    content = rows.where(~F.col("head") & F.col("label").isNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    prose = content.where(F.col("field").isin("description", "clearing")).groupBy("doc_id", "block_at", "field").agg(
        strip(joined).alias("t")
    )
    prose = prose.groupBy("doc_id", "block_at").agg(
        F.max(F.when(F.col("field") == "description", F.col("t"))).alias("description"),
        F.max(F.when(F.col("field") == "clearing", F.col("t"))).alias("clearing"),
    )
    group = ["doc_id", "block_at", "field"]
    items = assemble_items(content.where(F.col("field").isin("causes", "remedies")), group, block, order)
    lists = collect_items(items, group, "items").groupBy("doc_id", "block_at").agg(
        F.max(F.when(F.col("field") == "causes", F.col("items"))).alias("causes"),
        F.max(F.when(F.col("field") == "remedies", F.col("items"))).alias("remedies"),
    )
    code_spans = F.filter(F.slice("spans", 2, F.greatest(F.size("spans"), F.lit(1))), lambda s: s["font"].rlike(CODE_FONT))
    heads = rows.where("head").select(
        "doc_id", "block_at", "page", F.col("text").alias("raw"),
        strip(F.regexp_replace(strip(_span(0)["text"]), r"^[\[\]]+|[\[\]]+$", "")).alias("name"),
        strip(F.array_join(F.transform(code_spans, lambda s: s["text"]), "")).alias("code"),
    )
    ends = rows.groupBy("doc_id", "block_at").agg(F.max("page").alias("page_end"))
    none = F.array().cast("array<string>")
    found = (
        heads.join(ends, ["doc_id", "block_at"]).join(prose, ["doc_id", "block_at"], "left")
        .join(lists, ["doc_id", "block_at"], "left")
        .withColumns({
            "description": F.coalesce("description", F.lit("")), "clearing": F.coalesce("clearing", F.lit("")),
            "causes": F.coalesce("causes", none), "remedies": F.coalesce("remedies", none),
            "code_key": code_key(F.col("code")),
        })
    )
    reasons = F.array_compact(F.array(
        F.when(~F.col("code_key").rlike(CODE_SHAPE), F.lit(NO_CODE)),
        F.when(F.size("causes") == 0, F.lit(NO_CAUSES)), F.when(F.size("remedies") == 0, F.lit(NO_REMEDIES)),
    ))
    judged = settle(found.withColumn("reason", F.array_join(reasons, "; ")), "judged")
    records = judged.where("reason = ''").select(
        F.col("doc_id").alias("manual_id"), "code", "code_key", "name", "description", "causes", "remedies", "clearing",
        "page", "page_end", F.lit("block").alias("layout"), none.alias("shared_with"), F.col("block_at").alias("ord"),
    )
    refused = judged.where("reason <> ''").select("doc_id", "page", F.col("block_at").alias("pos"), "reason", "raw")
    taken = judged.where("reason = ''").select("doc_id", "block_at")
    consumed = rows.join(taken, ["doc_id", "block_at"], "left_semi").select("doc_id", "page", "idx")
    return records, stray.unionByName(refused), consumed


# --- ruled tables (C6-C8) --------------------------------------------------------------------------------------


def section_of_pages(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, page, section): the last entry, in outline order, whose page is not after the page.

    Entry and page rows are merged in page order; the running maximum of (order, title) is the entry sought.
    """
    marks = outline.select("doc_id", "page", F.lit(0).alias("is_page"), F.struct("ord", "title").alias("entry"))
    marks = marks.groupBy("doc_id", "page", "is_page").agg(F.max("entry").alias("entry"))
    asked = pages.select("doc_id", "page").distinct().withColumn("is_page", F.lit(1))
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("__b", F.floor(F.col("page") / 256))
    seen = running_extreme(both, ["doc_id"], "__b", ["page", "is_page"], {"latest": "entry"}, F.max, _later)
    title = F.coalesce(F.col("latest.title"), F.lit(""))
    return seen.where("is_page = 1").select("doc_id", "page", strip(F.regexp_replace(title, CONTINUED, "")).alias("section"))


def _later(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (b > a), b).otherwise(a)


def table_faults(rows: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejected, notes) of ruled-table manuals. ``sections``: doc_id, page, section.

    Merged cause and remedy cells take those of the latest record accepted from its own cells; only rows local to
    themselves decide that, so both look-backs are forward fills in (page, table, row) order.
    """
    keys, block, order = ["doc_id"], "page", ["page", "tbl", "row"]
    widths = rows.groupBy("doc_id", "page", "tbl").agg(F.max(F.size("cells")).alias("width"))
    cell = lambda n: F.get("cells", F.lit(n))
    flat = rows.join(widths, ["doc_id", "page", "tbl"]).join(sections, ["doc_id", "page"], "left")
    first = strip(F.coalesce(cell(0), F.lit("")))
    flat = flat.withColumn("first", first).where(~F.startswith(F.lower("first"), F.lit("code")))
    tokens = F.filter(F.split(strip(F.regexp_replace("first", FOOTNOTE, " ")), r"(?U)\s+"), lambda t: t != "")
    spread = lambda c: collapse_spaces(F.coalesce(c, F.lit("")))
    # Ragged rows are padded to the table's width, in the raw text too.
    padded = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: spread(F.get("cells", i)))
    wide = F.col("width") >= 4
    flat = flat.withColumns({
        "blank": ~F.exists("cells", lambda c: F.coalesce(strip(c) != "", F.lit(False))),
        "code": F.coalesce(F.get(tokens, F.lit(0)), F.lit("")),
        "name": F.when(F.col("width") > 1, spread(cell(1))).otherwise(""),
        "raw": F.array_join(padded, " | "),
        "merged": wide & cell(2).isNull() & cell(3).isNull(),
        "own_causes": F.when(F.col("width") > 2, items_of_cell(cell(2))).otherwise(F.array().cast("array<string>")),
        "own_remedies": F.when(wide, items_of_cell(cell(3))).otherwise(F.array().cast("array<string>")),
    })
    notes = flat.where("blank").select(
        "doc_id", *order, F.format_string("p%d: blank table row skipped", "page").alias("note")
    )
    full = flat.where(~F.col("blank")).withColumn("code_ok", code_key(F.col("code")).rlike(CODE_SHAPE))
    own_ok = ~F.col("merged") & F.col("code_ok") & (F.size("own_causes") > 0) & (~wide | (F.size("own_remedies") > 0))
    full = full.withColumn("__own", F.when(own_ok, F.struct(F.col("own_causes").alias("causes"), F.col("own_remedies").alias("remedies"))))
    full = fill_forward(full, keys, block, order, {"donor": "__own"})
    none = F.array().cast("array<string>")
    inherits = F.col("merged") & F.col("donor").isNotNull()
    full = full.withColumns({
        "causes": F.when(inherits, F.col("donor.causes")).otherwise(F.col("own_causes")),
        "remedies": F.when(inherits, F.col("donor.remedies")).otherwise(F.col("own_remedies")),
    })
    reason = (
        F.when(~F.col("code_ok"), F.lit("unreadable code cell"))
        .when(F.size("causes") == 0, F.lit("no causes"))
        .when(wide & (F.size("remedies") == 0), F.lit("no remedy"))
    )
    full = full.withColumn("reason", reason).withColumn(
        "__accepted", F.when(F.col("reason").isNull(), F.struct(*order, "code"))
    )
    # The donor of a merged row is the latest accepted record before it, whichever kind it is.
    full = fill_forward(settle(full, "rows"), keys, block, order, {"prev": "__accepted"}, inclusive=False)
    full = settle(full, "donors")
    lent = full.where(inherits).groupBy("doc_id", F.col("prev.page").alias("page"), F.col("prev.tbl").alias("tbl"), F.col("prev.row").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o_{c}") for c in order], "code"))), lambda x: x["code"]).alias("lent")
    )
    accepted = full.where("reason is null").join(lent, ["doc_id", *order], "left")
    records = accepted.select(
        F.col("doc_id").alias("manual_id"), "code", code_key(F.col("code")).alias("code_key"), "name",
        F.lit("").alias("description"), "causes", "remedies", F.coalesce("section", F.lit("")).alias("clearing"),
        "page", F.col("page").alias("page_end"), F.lit("table4").alias("layout"),
        F.concat(F.when(inherits, F.array("prev.code")).otherwise(none), F.coalesce("lent", none)).alias("shared_with"),
        (F.col("page").cast("long") * (1 << 31) + F.col("tbl") * (1 << 20) + F.col("row")).alias("ord"),
    )
    rejected = full.where("reason is not null").select("doc_id", *order, "reason", "raw")
    narrow = full.where(F.col("reason").isNull() & ~wide).select(
        "doc_id", *order,
        F.format_string("p%d: %s comes from a %d-column table with no remedy column", "page", "code", "width").alias("note"),
    )
    return records, rejected, notes.unionByName(narrow)


def lines_in_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose centre lies in a table box of their page (edges count). ``boxes``: doc_id, page, bx0, by0, bx1, by1."""
    cx, cy = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    return lines.alias("l").join(
        boxes.alias("b"),
        (F.col("l.doc_id") == F.col("b.doc_id")) & (F.col("l.page") == F.col("b.page"))
        & cx.between(F.col("b.bx0"), F.col("b.bx1")) & cy.between(F.col("b.by0"), F.col("b.by1")),
        "left_semi",
    )


# --- dedupe and passages (C9, C10) ------------------------------------------------------------------------------


def dedupe_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row per key, found by a pre-aggregated minimum: no group is collected or sorted whole."""
    rest = [c for c in rows.columns if c not in keys]
    record = F.struct(order, *[c for c in rest if c != order])
    return rows.groupBy(*keys).agg(F.min_by(record, order).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in rest]
    )


def duplicate_notes(records: DataFrame) -> DataFrame:
    """Records after the first of their key: (manual_id, ord, note)."""
    firsts = records.groupBy("manual_id", "code_key").agg(
        F.min("ord").alias("first_ord"), F.min_by("page", "ord").alias("first_page")
    )
    later = records.join(firsts, ["manual_id", "code_key"]).where(F.col("ord") != F.col("first_ord"))
    return later.select("manual_id", "ord", F.format_string("%s (p%d, first seen p%d)", "code", "page", "first_page").alias("note"))


def fault_chunk_id(manual_id: Column, key: Column) -> Column:
    return F.concat(manual_id, F.lit(":f:"), key)


def fault_passages(faults: DataFrame) -> DataFrame:
    """Fault records as passages of kind ``fault``."""
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(
        F.array(F.concat(F.lit("Fault code "), F.col("code"), F.lit(": "), F.col("name"))),
        one((F.col("description") != "") & (F.lower("description") != F.lower("name")), F.col("description")),
        F.array(F.lit("Probable causes:")), bullets(F.col("causes")),
        one(F.size("remedies") > 0, F.lit("Remedies:")), bullets(F.col("remedies")),
        one(F.col("clearing") != "", F.concat(F.lit("Clearing: "), F.col("clearing"))),
        one(F.size("shared_with") > 0, F.concat(F.lit("Same causes and remedies as: "), F.array_join("shared_with", ", "))),
    )
    return faults.select(
        fault_chunk_id(F.col("manual_id"), F.col("code_key")).alias("id"), "manual_id", F.lit("fault").alias("kind"),
        F.concat(F.lit("Error codes > "), F.col("code"), F.lit(" ["), F.col("name"), F.lit("]")).alias("heading_path"),
        F.col("page").alias("page_start"), "page_end", F.array_join(parts, "\n").alias("text"),
    )
