import pytest
from pyspark.sql import functions as F
from shapes import DISPLAY, HEAVY, LINES, alarm, handbook, page_rows, part, title

from citeline.operators import audit, lexicon, records as R
from citeline.plans.extract import extract
from citeline.sources.registry import MANUALS

ALARMS = {
    40: [alarm("Warp break", "WBK"), "An end of the warp is broken.", "Probable Cause", "The warp is too tight for", "this yarn.", "Knots catch in the reed.",
         "Remedy", "• Lower the tension", "of the beam", "•", "Inspect the reed", "Clearing the Error Code", "Press reset twice."],
    41: [alarm("Weft stop", "W-7"), "Probable Cause", "Cone is empty.", "Remedy"],
    42: ["Fit a full cone.", title("Spare parts"), "Order by number."],
    43: [alarm("Beam", "BM1"), "Probable Cause", "Brake slips.", alarm("Lamp", "LMP"), "Remedy", "Wait.",
         alarm("Frame", "FRAMEWIDTH"), "Probable Cause", "Bent.", "Remedy", "Straighten.", alarm("Dobby", "", font=HEAVY, size=18.0)],
}


def test_alarm_blocks(spark):
    found, refused, owned = R.block_faults(handbook(spark, ALARMS), spark.createDataFrame([("loom", 40, 43)], "doc_id string, first int, last int"))
    warp, weft = found.orderBy("ord").collect()
    assert (warp.code, warp.name, warp.description, warp.clearing) == ("WBK", "Warp break", "An end of the warp is broken.", "Press reset twice.")
    assert warp.causes == ["The warp is too tight for this yarn.", "Knots catch in the reed."]
    assert warp.remedies == ["Lower the tension of the beam", "Inspect the reed"]
    assert (weft.code, weft.page, weft.page_end, weft.causes, weft.remedies) == ("W-7", 41, 42, ["Cone is empty."], ["Fit a full cone."])
    assert [(r.raw, r.reason) for r in refused.orderBy("pos").collect()] == [
        ("[Beam] BM1", R.NO_REMEDIES), ("[Lamp] LMP", R.NO_CAUSES), ("[Frame] FRAMEWIDTH", R.NO_CODE), ("[Dobby]", R.NO_CODE_FONT),
    ]
    lines = {(r.page, r.idx) for r in owned.collect()}
    assert lines == {(40, n) for n in range(13)} | {(41, n) for n in range(4)} | {(42, 0)}


RELAYS = [  # cells, then the record (causes, remedies, shared with) or the reason it is refused for
    (["Code", "Meaning", "Causes", "What to do"], None),
    (["L10", "Lamp relay stuck", "• Contacts welded\n• Coil open", "• Replace the relay\nK3"], (["Contacts welded", "Coil open"], ["Replace the relay K3"], ["L11"])),
    (["L11", "Lamp relay slow", None, None], (["Contacts welded", "Coil open"], ["Replace the relay K3"], ["L10"])),
    (["L12\n(2)", "Lamp fuse", "Fuse blown.\nHolder loose.", "Fit a fuse."], (["Fuse blown.", "Holder loose."], ["Fit a fuse."], ["L15"])),
    (["L13", "Lamp  glass", "Cracked", None], "no remedy"),
    (["L14", "Lamp wire", "", "Solder it"], "no causes"),
    (["", None, " ", None], None),
    (["#", "Odd", "x", "y"], "unreadable code cell"),
    (["L15", "Lamp cover", None, None], (["Fuse blown.", "Holder loose."], ["Fit a fuse."], ["L12"])),
]


def from_table(spark, rows):
    cells = spark.createDataFrame([("loom", 88, 0, n, r) for n, r in enumerate(rows)], "doc_id string, page int, tbl int, row int, cells array<string>")
    out = R.table_faults(cells, spark.createDataFrame([("loom", 88, "Restart needed")], "doc_id string, page int, section string"))
    return out[0].orderBy("ord").collect(), out[1].orderBy("row").collect(), [r.note for r in out[2].orderBy("row").collect()]


def test_alarm_tables(spark):
    records, refused, notes = from_table(spark, [cells for cells, _ in RELAYS])
    assert [(r.causes, r.remedies, r.shared_with) for r in records] == [w for _, w in RELAYS if isinstance(w, tuple)]
    assert [r.code for r in records] == ["L10", "L11", "L12", "L15"] and {r.clearing for r in records} == {"Restart needed"}
    assert [(r.row, r.reason) for r in refused] == [(n, w) for n, (_, w) in enumerate(RELAYS) if isinstance(w, str)]
    assert [r.raw for r in refused] == ["L13 | Lamp glass | Cracked | ", "L14 | Lamp wire |  | Solder it", "# | Odd | x | y"]
    assert notes == ["p88: blank table row skipped"]


def test_tables_without_a_remedy_column(spark):
    records, refused, notes = from_table(spark, [["Code", "Text", "Why"], ["Q.4", "Quill empty", "• Yarn ran out\n• Sensor dirty"], ["Q.5", "Quill loose", None]])
    assert [(r.code, r.causes, r.remedies) for r in records] == [("Q.4", ["Yarn ran out", "Sensor dirty"], [])]
    assert [r.reason for r in refused] == ["no causes"]
    assert notes == ["p88: Q.4 comes from a 3-column table with no remedy column"]


ITEMS = [
    (["Shed opens late.", "Cam worn", "on one side.", "", "Cam loose."], ["Shed opens late.", "Cam worn on one side.", "Cam loose."]),
    (["▪", "pick counter", "▪ clutch", "  and brake"], ["pick counter", "clutch and brake"]),
    (["Is the belt dry?", "then wax it", "Done!", "• Run"], ["Is the belt dry? then wax it Done!", "Run"]),
]


def test_wrapped_lines_become_items(spark):
    rows = [(d, n // 2, n, t) for d, (lines, _) in enumerate(ITEMS) for n, t in enumerate(lines)]
    frame = spark.createDataFrame(rows, "d int, b int, n int, text string")
    joined = R.collect_items(R.assemble_items(frame, ["d"], "b", ["n"]), ["d"], "items").orderBy("d").collect()
    assert [r["items"] for r in joined] == [want for _, want in ITEMS]
    cells = spark.createDataFrame([("\n".join(lines),) for lines, _ in ITEMS], "c string").select(R.items_of_cell(F.col("c")).alias("i")).collect()
    assert [r.i for r in cells] == [want for _, want in ITEMS]


def test_first_record_of_a_code_becomes_the_passage(spark):
    schema = ("manual_id string, code string, code_key string, page int, ord int, name string, description string, causes array<string>, remedies array<string>,"
              " clearing string, page_end int, shared_with array<string>")
    records = spark.createDataFrame([
        ("loom", "wbk", "WBK", 51, 7, "Again", "", ["x"], [], "", 51, []), ("loom", "WBK", "WBK", 40, 3, "Warp break", "warp BREAK", ["Knots.", "Dust."], [], "Reset.", 41, ["W-7", "W-8"]),
    ], schema)
    [passage] = R.fault_passages(R.dedupe_first(records, ["manual_id", "code_key"], "ord")).collect()
    assert (passage.id, passage.heading_path, passage.page_start, passage.page_end) == ("loom:f:WBK", "Error codes > WBK [Warp break]", 40, 41)
    assert passage.text.split("\n") == ["Fault code WBK: Warp break", "Probable causes:", "- Knots.", "- Dust.", "Clearing: Reset.", "Same causes and remedies as: W-7, W-8"]
    assert [r.note for r in R.duplicate_notes(records).collect()] == ["wbk (p51, first seen p40)"]


def test_models_in_questions(spark):
    patterns = [(r"(?i)\b(LX|LT)-?(\d{2})\b", None), (r"(?i)\bHalden\s+(\d{2})\b", "HD")]
    asked = {"lx20 stops": ["LX20"], "Halden 45 beside an LT-30": ["HD45", "LT30"], "LX20, LT-20, lx-20": ["LX20", "LT20"], "20 picks on LX200": []}
    rows = lexicon.named_models(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), patterns).orderBy("query_id", "nth").collect()
    assert [[r.model for r in rows if r.query_id == n] for n in range(len(asked))] == list(asked.values())


@pytest.mark.parametrize("first, second, winner", [("zeta", "alpha", "alpha"), ("alpha", "zeta", "zeta")])
def test_last_manual_in_the_registry_wins_a_model(spark, first, second, winner):
    manuals = spark.createDataFrame([(1, second, ["LX20"]), (0, first, ["lx20", "LT30"])], "ord int, id string, models array<string>")
    assert {r.model: r.manual_id for r in lexicon.model_manuals(manuals).collect()} == {"LX20": winner, "LT30": first}


def test_announced_codes(spark):
    """Index lines, the code column of a table, headings; unreadable leader lines are listed."""
    pages = {
        2: ["[Warp break] WBK ....... 40", "[Weft stop] W-7.....41", "Overview ........ 5", "Treadles ........ 6", "plain"],
        40: [alarm("Warp break", "WBK"), "[Not bold] NBD"],
        88: [[part("L10 ", DISPLAY), part("stuck")], [part("L11")]],
    }
    lines = handbook(spark, pages)
    reach = lambda a, b: spark.createDataFrame([("loom", a, b)], "doc_id string, first int, last int")
    listed, unread = audit.index_codes(lines, reach(1, 3))
    assert sorted(r.code for r in listed.collect()) == ["W-7", "WBK"] and [r.note for r in unread.collect()] == ["p2: Treadles ........ 6"]
    assert [r.code for r in audit.heading_codes(lines, reach(40, 40)).collect()] == ["WBK"]
    owned = spark.createDataFrame([("loom", 88, 0), ("loom", 88, 1)], "doc_id string, page int, idx int")
    assert [(r.code_key, r.code) for r in audit.table_column_codes(lines, owned).collect()] == [("L10", "L10")]
    keys = spark.createDataFrame([("loom", k) for k in ("L10", "LI0", "L1O", "WBK")] + [("other", "L1O")], "manual_id string, code_key string")
    assert sorted(r.pair for r in audit.lookalike_pairs(keys, ["manual_id"]).collect()) == ["L10~L1O", "L10~LI0", "L1O~LI0"]


def test_whole_handbook(spark):
    """Index, blocks, sections, lexicon and report of one manual in one job."""
    pages = {
        1: ["[Warp break] WBK ....... 40", "[Selvedge] SLV ...... 60", [part("Choose "), part("[Pick density]"), part(" PKD", DISPLAY)], "Run at LoP for an hour"],
        2: ["Guards", "Keep all guards shut"], 40: ALARMS[40], 41: ALARMS[41], 42: ALARMS[42],
    }
    manual = dict(id="loom", family="Halden", title="Care", doc_ref="H-1", version="3", file="h.pdf", url="", sha256="0", fault_layout="block",
                  fault_pages=(40, 42), index_pages=(1, 1), safety_pages=[2], models=["HD45"])
    outline = [("loom", 0, 1, "Guards", 2), ("loom", 1, 1, "Spare parts", 42)]
    out = extract(
        spark.createDataFrame([tuple(manual.values())], MANUALS), spark.createDataFrame(page_rows(pages), LINES),
        spark.createDataFrame(outline, "doc_id string, ord int, level int, title string, page int"), spark.createDataFrame([("loom", 42)], "doc_id string, page_count int"),
    )
    assert sorted(r.code for r in out.faults.collect()) == ["W-7", "WBK"] and [r.code for r in out.missing.collect()] == ["SLV"]
    chunks = out.chunks.collect()
    assert {c.id for c in chunks if c.kind == "fault"} == {"loom:f:WBK", "loom:f:W-7"} and [c.text for c in chunks if c.kind == "safety"] == ["Guards\nKeep all guards shut"]
    entries = {(e.kind, e.code_key): e.label for e in out.lexicon.collect()}
    assert entries[("hmi", "PKD")] == "Pick density" and entries[("fault", "WBK")] == "Warp break"
    assert ("token", "LOP") in entries and ("label", "pick density") in entries
    assert out.report.first().problems == ["1 codes expected but not extracted"]
