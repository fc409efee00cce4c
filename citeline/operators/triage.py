"""From questions to contexts, and from drafted answers to audited answers or escalations.

Everything is a long table keyed by ``query_id``; nested rows are built only for the result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions.identifiers import (
    bare_code, bracket_labels, code_key, code_like_tokens, collapse_spaces, same_text_key, strip, without_labels,
)
from citeline.functions.text import fixed
from citeline.operators.lexicon import key_spelling, label_spelling, token_spelling

# Input limits, thresholds, generic terms, message texts.
MAX_QUERY_CHARS = 2000
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EVIDENCE_THRESHOLD = 0.14
GENERIC_TERMS = (
    "AC", "DC", "PE", "EMC", "IGBT", "HMI", "PID", "PLC", "VFD", "LOTO", "PPE", "OK", "LED", "USB",
    "PC", "RMS", "UL", "IEC", "CSA", "CPU", "ID",
)
SOURCE_ID = r"^S[0-9]{1,2}$"
COLLECT = (
    "The exact code on the drive display, and whether it is flashing",
    "When it happens: at start, while accelerating, at steady speed, while braking or at stop",
    "How often and since when; anything changed recently (motor, cables, parameters, load, ambient)",
    "Drive model and rating-plate details",
)
NO_CAUSES = "no probable causes returned"
NO_ISOLATION = "steps require isolation but no safety warning cites a safety source"
DECLINED = "The retrieved manual passages do not cover this problem well enough to name a cause."
TELEMETRY_NOTE = "Telemetry is context only: causes and actions must still come from the SOURCES."
NO_ANSWER = "The language model could not produce an answer."
SCHEMA_VIOLATION = "schema: the answer does not follow the answer schema"

ANSWER = (
    "status string, insufficient_reason string,"
    " probable_causes array<struct<cause:string,confidence:double,fault_code:string,source_ids:array<string>>>,"
    " corrective_actions array<struct<action:string,requires_isolation:boolean,source_ids:array<string>>>,"
    " safety_warnings array<struct<text:string,source_ids:array<string>>>"
)
# The same answer with its texts as JSON values, which still show their types.
TYPED = (
    "status variant, insufficient_reason variant,"
    " probable_causes array<struct<cause:variant,fault_code:variant,source_ids:array<variant>>>,"
    " corrective_actions array<struct<action:variant,source_ids:array<variant>>>,"
    " safety_warnings array<struct<text:variant,source_ids:array<variant>>>"
)


# --- reports (G1-G4) --------------------------------------------------------------------------------------------


def validate_reports(reports: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted with stripped text, rejected with a reason). Length counts before stripping."""
    bare = strip(F.col(text))
    reason = (
        F.when(F.col(text).isNull(), F.lit("query is missing"))
        .when(F.length(text) > MAX_QUERY_CHARS, F.lit("query is too long"))
        .when(bare == "", F.lit("query must not be empty"))
        .when(bare.rlike(CONTROL), F.lit("query must not contain control characters"))
    )
    judged = reports.withColumn("reason", reason)
    return (
        judged.where("reason is null").drop("reason").withColumn(text, bare),
        judged.where("reason is not null"),
    )


def resolve_scope(
    questions: DataFrame, machines: DataFrame, named: DataFrame, manual_of_model: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scoped questions, uncovered questions, questions naming an unknown machine).

    ``scope`` is the array of manuals to search, NULL for all: models named in the text win over the machine's
    manual. A question naming only models without a manual is uncovered. ``named``: query_id, nth, model.
    """
    known = machines.select(F.col("id").alias("machine_id"), F.col("manual").alias("machine_manual"))
    placed = questions.join(known, "machine_id", "left")
    unknown = placed.where(F.col("machine_id").isNotNull() & F.col("machine_manual").isNull())
    models = named.join(manual_of_model, "model", "left").groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "model"))), lambda x: x["model"]).alias("models"),
        F.array_sort(F.collect_set("manual_id")).alias("covered"),
    )
    placed = placed.where(F.col("machine_id").isNull() | F.col("machine_manual").isNotNull()).join(models, "query_id", "left")
    has_cover = F.size(F.coalesce("covered", F.array().cast("array<string>"))) > 0
    scope = F.when(has_cover, F.col("covered")).when(F.col("machine_manual").isNotNull(), F.array("machine_manual"))
    placed = placed.withColumns({"scope": scope, "uncovered": F.col("models").isNotNull() & ~has_cover})
    kept = placed.drop("covered")
    return kept.where(~F.col("uncovered")).drop("uncovered"), kept.where("uncovered").drop("uncovered"), unknown


def coverage_text(manuals: DataFrame) -> DataFrame:
    """One row: the manuals on hand, by id (a registry, so small)."""
    name = F.when(F.size("models") > 1, F.concat("family", F.lit(" series"))).otherwise(F.col("family"))
    return manuals.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", name.alias("n")))), lambda x: x["n"]), ", ").alias("coverage")
    )


def uncovered_reason(models: Column, coverage: Column, system: str = "This system") -> Column:
    return F.concat(
        F.lit(f"{system} has no manual for the "), F.array_join(models, ", "),
        F.lit(". It has manuals for these drives: "), coverage, F.lit("."),
    )


def evidence_gate(questions: DataFrame, threshold: float = EVIDENCE_THRESHOLD) -> DataFrame:
    """Add ``gate_reason``: set where no code was recognised and the (unrounded) top score is below the threshold.

    ``questions``: query_id, has_code boolean, top_score.
    """
    reason = F.concat(
        F.lit("No fault code was recognised and the closest manual passage scored "), fixed(F.col("top_score"), 2),
        F.lit(f", below the evidence threshold of {threshold:.2f}."),
    )
    return questions.withColumn("gate_reason", F.when(~F.col("has_code") & (F.col("top_score") < threshold), reason))


# --- sources and contexts (F16, G5, G6) -------------------------------------------------------------------------


def number_sources(
    ranked: DataFrame, passages: DataFrame, manuals: DataFrame, scopes: DataFrame | None = None
) -> DataFrame:
    """Numbered sources per question: retrieved passages, then safety passages of the manuals involved.

    ``passages``: passage_id, manual_id, kind, heading, text, page_start, page_end. Involved manuals are the
    question's scope, or else those of its retrieved passages.
    """
    found = ranked.select("query_id", "pos", "passage_id", "score").join(passages, "passage_id")
    from_hits = found.select("query_id", "manual_id").distinct()
    if scopes is not None:
        scoped = scopes.where("scope is not null").select("query_id", F.explode("scope").alias("manual_id"))
        free = from_hits.join(scoped.select("query_id").distinct(), "query_id", "left_anti")
        from_hits = scoped.unionByName(free)
    safety = from_hits.join(passages.where("kind = 'safety'"), "manual_id").join(
        ranked.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti"
    )
    cols = ["query_id", "passage_id", "manual_id", "kind", "heading", "text", "page_start", "page_end"]
    both = found.select(*cols, "pos", "score").unionByName(
        safety.select(*cols, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("double").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("pos").asc_nulls_last(), "manual_id", "page_start", "passage_id")
    numbered = both.withColumn("n", F.row_number().over(order)).drop("pos")
    names = manuals.select(F.col("id").alias("manual_id"), "family", "title", "models")
    return numbered.join(names, "manual_id", "left").select(
        "query_id", "n", F.concat(F.lit("S"), F.col("n")).alias("source_id"), "passage_id", "manual_id",
        F.coalesce("title", "manual_id").alias("title"), F.coalesce("family", F.lit("")).alias("family"), "models",
        "page_start", "page_end", "heading", "kind", F.bround("score", 3).alias("score"), "text",
    )


def code_line(code: Column, manual: Column, page: Column, fuzzy: Column, token: Column) -> Column:
    base = F.format_string("%s (%s p.%d)", code, manual, page)
    typed = F.concat(F.lit(": the operator typed '"), token, F.lit("', which looks the same on the drive's 7-segment display"))
    return F.when(fuzzy, F.concat(base, typed)).otherwise(base)


def _ordered(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def build_contexts(
    questions: DataFrame, sources: DataFrame, code_lines: DataFrame | None = None, readings: DataFrame | None = None
) -> DataFrame:
    """(query_id, context): one prompt text per question from its numbered sources.

    ``questions``: query_id, text [, machine]; ``code_lines``: query_id, ord, line; ``readings``: query_id, ts,
    signal, value, unit.
    """
    known = lambda name: F.coalesce(F.col(name), F.lit(""))  # a missing heading or family leaves the source in place
    quoted = lambda name: F.replace(known(name), F.lit('"'), F.lit("'"))
    pages = F.when(F.col("page_start") == F.col("page_end"), F.format_string("p.%d", "page_start")).otherwise(
        F.format_string("pp.%d-%d", "page_start", "page_end")
    )
    many = F.size(F.coalesce("models", F.array().cast("array<string>"))) > 0
    model = F.when(many, F.concat(F.lit('models="'), F.array_join("models", ", "), F.lit('"'))).otherwise(
        F.concat(F.lit('model="'), known("family"), F.lit('"'))
    )
    block = F.concat(
        F.lit('<source id="'), F.col("source_id"), F.lit('" '), model, F.lit(' manual="'), quoted("title"),
        F.lit('" pages="'), pages, F.lit('" kind="'), F.col("kind"), F.lit('" section="'), quoted("heading"),
        F.lit('">\n'), known("text"), F.lit("\n</source>"),
    )
    blocks = sources.withColumn("block", block).groupBy("query_id").agg(F.array_join(_ordered("n", "block"), "\n\n").alias("blocks"))
    joined = questions.join(blocks, "query_id", "left")
    machine = F.coalesce("machine", F.lit("not specified")) if "machine" in questions.columns else F.lit("not specified")
    codes, telemetry = F.lit(None).cast("string"), F.lit(None).cast("string")
    if code_lines is not None:
        listed = code_lines.withColumn("line", F.concat(F.lit("- "), F.col("line")))
        listed = listed.groupBy("query_id").agg(F.array_join(_ordered("ord", "line"), "\n").alias("codes"))
        joined = joined.join(listed, "query_id", "left")
        codes = F.concat(F.lit("RECOGNISED FAULT CODES:\n"), F.col("codes"))
    if readings is not None:
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx")
        said = F.concat(stamp, F.lit(" "), F.col("signal"), F.lit("="), F.col("value").cast("string"), F.lit(" "), F.col("unit"))
        shown = readings.withColumn("line", said).groupBy("query_id").agg(F.array_join(_ordered("ts", "line"), "\n").alias("tele"))
        joined = joined.join(shown, "query_id", "left")
        telemetry = F.concat(F.lit("<telemetry>\n"), F.col("tele"), F.lit(f"\n</telemetry>\n\n{TELEMETRY_NOTE}"))
    parts = F.array(
        F.concat(F.lit("MACHINE: "), machine), codes, F.lit("SOURCES:"), F.col("blocks"), telemetry,
        F.concat(F.lit("OPERATOR QUERY:\n"), F.col("text")),
    )
    return joined.select("query_id", F.array_join(F.array_compact(parts), "\n\n").alias("context"))


# --- answers (G7-G13) -------------------------------------------------------------------------------------------


def parse_answers(raw: DataFrame, column: str = "answer_json") -> DataFrame:
    """Add ``answer`` (struct) and ``schema_ok``; malformed or incomplete JSON is a violation, not an error."""
    parsed = raw.withColumns({"answer": F.from_json(column, ANSWER), "__typed": F.from_json(column, TYPED)})
    a = F.col("answer")
    whole = (
        a.isNotNull() & a["status"].isin("diagnosis", "insufficient_evidence") & a["insufficient_reason"].isNotNull()
        & a["probable_causes"].isNotNull() & a["corrective_actions"].isNotNull() & a["safety_warnings"].isNotNull()
        & ~F.exists(a["probable_causes"], lambda x: x["cause"].isNull() | x["confidence"].isNull() | x["fault_code"].isNull() | x["source_ids"].isNull())
        & ~F.exists(a["corrective_actions"], lambda x: x["action"].isNull() | x["requires_isolation"].isNull() | x["source_ids"].isNull())
        & ~F.exists(a["safety_warnings"], lambda x: x["text"].isNull() | x["source_ids"].isNull())
    )
    ok = F.coalesce(whole & _texts_are_strings(F.col("__typed")), F.lit(False))
    return parsed.withColumn("schema_ok", ok).drop("__typed")


def _texts_are_strings(typed: Column) -> Column:
    """The text fields hold JSON strings and the id lists only strings; a parsed struct of strings no longer shows it."""
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))

    def items(field: str, *texts: str) -> Column:
        def right(x: Column) -> Column:
            ok = F.forall(x["source_ids"], is_text)
            for name in texts:
                ok = ok & is_text(x[name])
            return F.coalesce(ok, F.lit(False))

        return F.forall(typed[field], right)

    return (
        is_text(typed["status"]) & is_text(typed["insufficient_reason"]) & items("probable_causes", "cause", "fault_code")
        & items("corrective_actions", "action") & items("safety_warnings", "text")
    )


LABELS = {1: "cause", 2: "step", 3: "safety warning"}


def answer_items(answer: Column) -> Column:
    """The items of an answer as one array of (section 1-3, n, text, fault_code, source_ids)."""
    none = F.lit(None).cast("string")

    def part(section: int, field: str, text: str, code) -> Column:
        return F.transform(answer[field], lambda x, i: F.struct(
            F.lit(section).alias("section"), (i + 1).alias("n"), x[text].alias("text"), code(x).alias("fault_code"),
            x["source_ids"].alias("source_ids"),
        ))

    return F.concat(
        part(1, "probable_causes", "cause", lambda x: x["fault_code"]), part(2, "corrective_actions", "action", lambda x: none),
        part(3, "safety_warnings", "text", lambda x: none),
    )


def item_label(section: Column, n: Column) -> Column:
    label = F.lit(LABELS[3])
    for number in (1, 2):
        label = F.when(section == number, LABELS[number]).otherwise(label)
    return F.concat(label, F.lit(" "), n.cast("string"))


def text_mentions(text: Column) -> Column:
    """Bracketed labels and code-shaped tokens of a text: an array of (at, identifier, spellings).

    Labels come before tokens and are masked before tokens are taken. Source ids and generic terms are not
    identifiers; a trailing lowercase "s" may be a plural, so the word without it is a spelling too.
    """
    none = F.array().cast("array<struct<at:bigint,identifier:string,spellings:array<string>>>")
    labels = F.transform(bracket_labels(text), lambda lab, i: F.struct(
        i.cast("long").alias("at"), F.concat(F.lit("["), lab, F.lit("]")).alias("identifier"), F.array(label_spelling(lab)).alias("spellings")
    ))

    def forms(token: Column) -> Column:
        plural = (F.length(token) > 2) & token.endswith("s")
        return F.when(plural, F.array(token, F.left(token, F.length(token) - 1))).otherwise(F.array(token))

    placed = F.transform(code_like_tokens(without_labels(text)), lambda token, i: F.struct(
        (i + F.lit(1 << 32)).alias("at"), token.alias("identifier"), forms(token).alias("forms")
    ))
    kept = F.filter(placed, lambda t: ~t["identifier"].rlike(SOURCE_ID) & ~F.exists(t["forms"], lambda f: F.upper(f).isin(*GENERIC_TERMS)))
    tokens = F.transform(kept, lambda t: F.struct(
        t["at"].alias("at"), t["identifier"].alias("identifier"), F.transform(t["forms"], token_spelling).alias("spellings")
    ))
    # Neither a label nor a code is in a text without a bracket or a capital.
    return F.when(text.rlike(r"[A-Z\[]"), F.concat(F.when(text.contains("["), labels).otherwise(none), tokens)).otherwise(none)


def field_mentions(field: Column) -> Column:
    """The code field "[Name] CODE": each name and the code, as for texts."""
    names = F.transform(bracket_labels(field), lambda lab: F.struct(
        F.concat(F.lit("["), lab, F.lit("]")).alias("identifier"), F.array(label_spelling(lab)).alias("spellings")
    ))
    # Each value is bound by a lambda, so it is computed once.
    bare = F.filter(F.transform(F.array(F.when(field.contains("["), bare_code(field)).otherwise(collapse_spaces(field))), lambda b: F.struct(
        b.alias("identifier"), code_key(b).alias("key")
    )), lambda c: c["identifier"] != "")
    code = F.transform(bare, lambda c: F.struct(c["identifier"].alias("identifier"), F.array(key_spelling(c["key"])).alias("spellings")))
    found = F.concat(F.when(field.contains("["), names).otherwise(F.slice(names, 1, 0)), code)
    return F.transform(found, lambda m, i: F.struct(
        i.cast("long").alias("at"), m["identifier"].alias("identifier"), m["spellings"].alias("spellings")
    ))


def unknown_mentions(mentions: DataFrame, known: DataFrame, item: list[str]) -> DataFrame:
    """Mentions none of whose spellings any manual in scope knows: (item, at, identifier).

    ``mentions``: item, at, identifier, spellings, manuals (the scope, an array, may be NULL); known: (manual_id,
    spelling). A spelling meets its manuals as one row, so a mention is not repeated for every manual in scope.
    """
    holders = known.groupBy("spelling").agg(F.collect_set("manual_id").alias("holders"))
    spelled = mentions.select(
        *item, "at", "identifier", "manuals", F.size("spellings").alias("__forms"), F.explode("spellings").alias("spelling")
    )
    hit = F.coalesce(F.arrays_overlap("manuals", "holders"), F.lit(False))
    looked = spelled.join(holders, "spelling", "left").select(*item, "at", "identifier", "__forms", hit.alias("__hit"))
    # A mention of one spelling is settled here; only those with several go on as rows that know each other.
    judged = looked.where(~F.col("__hit") | (F.col("__forms") > 1)).groupBy(*item, "at", "identifier").agg(F.bool_or("__hit").alias("__hit"))
    return judged.where(~F.col("__hit")).drop("__hit")


def unknown_identifiers(
    texts: DataFrame, scopes: DataFrame, known: DataFrame, item: list[str], text: str = "text"
) -> DataFrame:
    """Identifiers of the texts that no manual in scope knows, each once per item, at its first place.

    ``item`` holds query_id; scopes: (query_id, manual_id); known: (manual_id, spelling).
    """
    manuals = scopes.groupBy("query_id").agg(F.collect_set("manual_id").alias("manuals"))
    rows = texts.join(manuals, "query_id", "left").select(*item, "manuals", F.explode(text_mentions(F.col(text))).alias("m"))
    found = unknown_mentions(rows.select(*item, "manuals", "m.*"), known, item)
    return found.groupBy(*item, "identifier").agg(F.min("at").alias("at"))


def repeated_causes(causes: DataFrame, keys: list[str], text: str = "text", n: str = "n") -> DataFrame:
    """Causes that say the same as an earlier one: (keys, n, first). The first is a pre-aggregated minimum."""
    keyed = causes.select(*keys, n, same_text_key(F.col(text)).alias("__same"))
    firsts = keyed.groupBy(*keys, "__same").agg(F.min(n).alias("first"))
    return keyed.join(firsts, [*keys, "__same"]).where(F.col(n) != F.col("first")).select(*keys, n, "first")


def audit_answers(
    answers: DataFrame, sources: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("query_id", "attempt"), carry: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, carried columns, violations): the ordered violation list of every parsed answer, empty when clean.

    An answer may use the identifiers of the manuals among its sources. Answers that decline are not checked.
    An answer and its sources meet in one row, as both are cells of a prompt; citations, repeats and isolation are
    checked there. Only mentions leave the row, for the join with the known spellings.
    """
    keys, carry = list(keys), list(carry)
    rest = [k for k in keys if k != "query_id"]
    one = F.struct("source_id", "manual_id", (F.col("kind") == "safety").alias("safe"))
    cells = sources.groupBy("query_id").agg(F.collect_list(one).alias("s")).select(
        "query_id", F.transform("s", lambda s: s["source_id"]).alias("__ids"),
        F.transform(F.filter("s", lambda s: s["safe"]), lambda s: s["source_id"]).alias("__safe"),
        F.array_compact(F.array_distinct(F.transform("s", lambda s: s["manual_id"]))).alias("manuals"),
    )
    active = F.col("schema_ok") & (F.col("answer.status") != "insufficient_evidence")
    met = answers.select(*{k: None for k in [*keys, *carry, "schema_ok", "answer"]}).join(cells, "query_id", "left").withColumn(
        "__items", F.when(active, answer_items(F.col("answer")))
    )

    def place(section, n, step, at, note) -> Column:
        number = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
        return F.struct(
            number(section, "int").alias("section"), number(n, "int").alias("n"), number(step, "int").alias("step"),
            number(at, "long").alias("at"), (note if isinstance(note, Column) else F.lit(note)).alias("note"),
        )

    # Mentions: a text reports an identifier once; a code field reports all it holds.
    mention = met.select(*keys, "manuals", F.explode("__items").alias("i")).select(
        *keys, "manuals", "i.section", "i.n", F.col("i.text").alias("text"), F.col("i.fault_code").alias("code")
    )
    stepped = lambda found, step: F.transform(found, lambda m: F.struct(F.lit(step).alias("step"), m["at"].alias("at"), m["identifier"].alias("identifier"), m["spellings"].alias("spellings")))
    listed = F.concat(
        stepped(text_mentions(F.col("text")), 2), stepped(field_mentions(F.coalesce("code", F.lit(""))), 3),
    )
    item = [*keys, "section", "n", "step"]
    mention = mention.select(*keys, "manuals", "section", "n", F.explode(listed).alias("m")).select(*keys, "manuals", "section", "n", "m.*")
    once = F.when(F.col("step") == 3, F.col("at"))
    unknown = unknown_mentions(mention, known, item).groupBy(*item, "identifier", once.alias("__once")).agg(F.min("at").alias("at"))
    says = F.concat(item_label(F.col("section"), F.col("n")), F.lit(": unknown identifier "), "identifier")
    unknown = unknown.groupBy("query_id").agg(
        F.collect_list(F.struct(*rest, place(F.col("section"), F.col("n"), F.col("step"), F.col("at"), says).alias("place"))).alias("__unknown")
    )

    # The rest is found in the row.
    a = F.col("answer")
    ids = F.coalesce("__ids", F.array().cast("array<string>"))
    checked = met.withColumns({
        "__missing": F.array_except(F.flatten(F.transform("__items", lambda i: i["source_ids"])), ids),
        "__same": F.when(active, F.transform(a["probable_causes"], lambda c: same_text_key(c["cause"]))),
    })

    def uncited(i: Column) -> Column:
        label = item_label(i["section"], i["n"])
        placed = F.transform(i["source_ids"], lambda s, at: F.struct(at.alias("at"), s.alias("id")))
        absent = F.filter(placed, lambda s: F.array_contains(F.col("__missing"), s["id"]))
        return F.when(F.size(i["source_ids"]) == 0, F.array(place(i["section"], i["n"], 1, 0, F.concat(label, F.lit(": no citation"))))).otherwise(
            F.transform(absent, lambda s: place(i["section"], i["n"], 1, s["at"], F.concat(label, F.lit(": unknown source id "), s["id"])))
        )

    firsts = F.transform("__same", lambda k, i: F.struct((i + 1).alias("n"), F.array_position("__same", k).alias("first")))
    repeats = F.when(F.size(F.array_distinct("__same")) < F.size("__same"), F.transform(
        F.filter(firsts, lambda r: r["n"] != r["first"]),
        lambda r: place(1, r["n"], 4, 0, F.format_string("cause %d repeats cause %d: list each cause once", r["n"], r["first"])),
    ))
    isolated = F.exists(a["corrective_actions"], lambda s: s["requires_isolation"])
    warned = F.exists(a["safety_warnings"], lambda w: F.arrays_overlap(w["source_ids"], F.coalesce("__safe", F.array().cast("array<string>"))))
    wrong = F.transform(
        F.filter("__unknown", lambda u: F.lit(True) if not rest else _all_of([u[k].eqNullSafe(F.col(k)) for k in rest])), lambda u: u["place"]
    )
    found = [
        F.when(active & (F.size(a["probable_causes"]) == 0), F.array(place(0, 0, 0, 0, NO_CAUSES))),
        F.flatten(F.transform("__items", uncited)), wrong, repeats,
        F.when(active & isolated & ~F.coalesce(warned, F.lit(False)), F.array(place(9, 0, 0, 0, NO_ISOLATION))),
        F.when(~F.col("schema_ok"), F.array(place(0, 0, 0, 0, SCHEMA_VIOLATION))),
    ]
    nothing = F.array().cast("array<struct<section:int,n:int,step:int,at:bigint,note:string>>")
    ordered = F.array_sort(F.concat(*[F.coalesce(f, nothing) for f in found]))
    return checked.join(unknown, "query_id", "left").select(
        *keys, *[c for c in carry if c not in keys], F.transform(ordered, lambda p: p["note"]).alias("violations")
    )


def _all_of(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for more in conditions[1:]:
        whole = whole & more
    return whole


# --- decisions (G14-G16) ----------------------------------------------------------------------------------------


def decide(audited: DataFrame, attempts: int = 2) -> DataFrame:
    """One row per question: the first clean attempt, the reason to escalate, or what to repair in the next attempt.

    ``audited``: query_id, attempt, violations, answer. Result: query_id, attempt, answer, reason (NULL = answered or to
    be asked again), first_pass_violations, final_violations, declined_note, repair (the violations as a list, only
    where no attempt was clean and attempts are left).
    """
    within = audited.where(F.col("attempt") <= attempts)
    clean = F.size("violations") == 0
    per_query = within.groupBy("query_id").agg(
        F.min_by(F.struct("attempt", "answer", "violations"), F.when(clean, F.col("attempt"))).alias("good"),
        F.max_by(F.struct("attempt", "violations"), "attempt").alias("last"),
        F.min_by("violations", "attempt").alias("first_pass_violations"),
    )
    failed = F.concat(
        F.lit("The drafted answer failed the grounding checks twice: "),
        F.array_join(F.slice("last.violations", 1, 3), "; "), F.lit("."),
    )
    again = F.col("good").isNull() & (F.col("last.attempt") < attempts)
    reason = F.when(F.col("good").isNull() & ~again, failed).when(
        F.col("good.answer.status") == "insufficient_evidence", F.lit(DECLINED)
    )
    return per_query.select(
        "query_id", F.coalesce("good.attempt", "last.attempt").alias("attempt"), F.col("good.answer").alias("answer"),
        reason.alias("reason"), "first_pass_violations",
        F.coalesce("good.violations", "last.violations").alias("final_violations"),
        F.when(reason == DECLINED, F.col("good.answer.insufficient_reason")).alias("declined_note"),
        F.when(again, F.array_join(F.transform("last.violations", lambda v: F.concat(F.lit("- "), v)), "\n")).alias("repair"),
    )


def capped_confidence(confidence: Column, has_code: Column, top_score: Column) -> Column:
    """Confidence within 0-1 and, without a recognised code, never above the retrieval strength."""
    cap = F.when(has_code, F.lit(1.0)).otherwise(F.greatest(top_score, F.lit(0.0)))
    return F.bround(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0), cap), 2)


def assemble_answers(decided: DataFrame, retrieval: DataFrame, sources: DataFrame) -> DataFrame:
    """Answered questions with ranked causes, steps, warnings and resolved citations.

    ``retrieval``: query_id, has_code, top_score.
    """
    answered = decided.where("reason is null and answer is not null").join(retrieval, "query_id")
    refs = sources.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "source_id", F.struct("source_id", "manual_id", "title", F.col("page_start").alias("page"))
    ))).alias("refs"))
    joined = answered.join(refs, "query_id")
    cite = lambda ids: F.transform(F.array_distinct(ids), lambda i: F.element_at(F.col("refs"), i))
    code = lambda c: F.when(bare_code(F.coalesce(c, F.lit(""))) != "", bare_code(c))
    causes = F.transform("answer.probable_causes", lambda c, i: F.struct(
        (i + 1).alias("rank"), c["cause"].alias("cause"),
        capped_confidence(c["confidence"], F.col("has_code"), F.col("top_score")).alias("confidence"),
        code(c["fault_code"]).alias("fault_code"), cite(c["source_ids"]).alias("citations"),
    ))
    steps = F.transform("answer.corrective_actions", lambda s, i: F.struct(
        (i + 1).alias("step"), s["action"].alias("action"), s["requires_isolation"].alias("requires_isolation"),
        cite(s["source_ids"]).alias("citations"),
    ))
    warnings = F.transform("answer.safety_warnings", lambda w: F.struct(w["text"].alias("text"), cite(w["source_ids"]).alias("citations")))
    return joined.select(
        "query_id", F.lit("diagnosis").alias("status"), causes.alias("probable_causes"),
        steps.alias("corrective_actions"), warnings.alias("safety_warnings"),
    )


def escalations(
    reasons: DataFrame, questions: DataFrame, matches: DataFrame, sources: DataFrame
) -> DataFrame:
    """Escalation rows: reason, summary, the first three non-safety sources, what to collect.

    reasons: (query_id, reason); questions: query_id, text, machine_id; matches: query_id, ord, code, manual_id.
    """
    codes = matches.withColumn("c", F.format_string("%s (%s)", "code", "manual_id")).groupBy("query_id").agg(
        F.array_join(_ordered("ord", "c"), ", ").alias("codes")
    )
    considered = sources.where("kind <> 'safety'").groupBy("query_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", "source_id"))), 1, 3), lambda x: x["source_id"]).alias("considered")
    )
    joined = reasons.join(questions, "query_id").join(codes, "query_id", "left").join(considered, "query_id", "left")
    summary = F.concat(
        F.lit('Operator report: "'), F.col("text"), F.lit('". Machine: '), F.coalesce("machine_id", F.lit("not specified")), F.lit("."),
        F.coalesce(F.concat(F.lit(" Fault code(s) recognised: "), F.col("codes"), F.lit(".")), F.lit("")),
        F.lit(" "), F.col("reason"), F.lit(" Escalate to a maintenance engineer; no cause was guessed."),
    )
    return joined.select(
        "query_id", F.lit("escalate").alias("status"), "reason", summary.alias("summary"),
        F.coalesce("considered", F.array().cast("array<string>")).alias("sources_considered"),
        F.array(*[F.lit(c) for c in COLLECT]).alias("collect"),
    )
