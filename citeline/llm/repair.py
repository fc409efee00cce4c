"""Repair of a conversation's structure by depth-first branch-and-bound.

A node of the search is (rows decided, last role written). Its edits are Delete (3), Insert of an empty text (2), Keep (0) and Rerole to user or
assistant (2); a truncated row that is not deleted adds 1, blank and duplicate rows can only be deleted, and the roles written must read as an
optional system turn followed by pairs of user and assistant, or nothing. The stack is explicit. A node's bound is its cost plus a
lower bound of the rows left: the least cost they can have behind its last role, the order of audits aside, from one pass over the rows
from the end. The bound is met, so the search branches only where prefixes tie. The child of the least bound, then of the least
initial, is searched first. A table per (rows decided, last role) keeps the least (cost, edits so far); a later prefix that is not less is cut, as
all its completions are. The incumbent is the least (cost, audit); a node whose bound is above its cost is cut, and the stack running
empty proves it optimal. Prefixes are chains of edits, compared from their last common edit.

A conversation's flags and row digests, some eighty bytes a row, are one group; its texts are not: they are sorted behind the plan of their
conversation and hashed as they come by.

Rows are taken by turn with nulls first, rows of one turn by the digest of role and text, so results do not depend on the order of reading. Null
roles and texts are one space. A role's initial is its first character; an empty role has an initial that fits nowhere. Rows without
conv_id are one conversation of their own. An empty table gives no row. Repeated rows count as duplicates; columns besides the four are not read.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
BLANK, DUPLICATE, TRUNCATED, FINE = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3  # last role written
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}
EMPTY = hashlib.sha256(b"").hexdigest()


def _bounds(rows: list[tuple[str, int]]) -> list[list[int]]:
    """Per place and last role: the least cost of the rows left, whatever the edits' initials. One pass from the end; an insert leads on in its place."""
    found: list[list[int]] = [[]] * (len(rows) + 1)
    for i in range(len(rows), -1, -1):
        if i == len(rows):
            here = [0, FAR, FAR, 0]
        else:
            (initial, fault), after = rows[i], found[i + 1]
            here = [cost + 3 for cost in after]
            if fault not in (BLANK, DUPLICATE):
                mark = int(fault == TRUNCATED)
                for last in NEXT:
                    here[last] = min(here[last], after[AFTER[last, NEXT[last]]] + 2 + mark)
                    if (last, initial) in AFTER:
                        here[last] = min(here[last], after[AFTER[last, initial]] + mark)
        here[USER], here[ASSISTANT] = min(here[USER], here[ASSISTANT] + 2), min(here[ASSISTANT], here[USER] + 2)
        here[START], here[SYSTEM] = (min(here[last], here[USER] + 2) for last in (START, SYSTEM))
        found[i] = here
    return found


class _Edit:
    """One edit of a prefix; its parent is the edit before."""

    __slots__ = ("letter", "before", "length")

    def __init__(self, letter: str, before: _Edit | None):
        self.letter, self.before, self.length = letter, before, before.length + 1 if before else 0


def _less(a: _Edit, b: _Edit) -> bool:
    """Whether prefix a is less than prefix b in ASCII order. A proper prefix of the other is the less."""
    shorter = a.length < b.length
    while a.length > b.length:
        a = a.before
    while b.length > a.length:
        b = b.before
    less = None
    while a is not b:
        if a.letter != b.letter:
            less = a.letter < b.letter
        a, b = a.before, b.before
    return shorter if less is None else less


def repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows given as (initial of the role, fault); the ASCII-least of several."""
    n, bound = len(rows), _bounds(rows)
    root = _Edit("", None)
    best: tuple[int, _Edit] | None = None
    table: list[dict[int, tuple[int, _Edit]]] = [{} for _ in range(n + 1)]
    table[0][START] = (0, root)
    stack = [(0, 0, START, root)]
    while stack:
        cost, i, last, edit = stack.pop()
        if table[i][last][1] is not edit:
            continue  # a better prefix came by
        least = cost + bound[i][last]
        if best is not None and least > best[0]:
            continue
        if i == n and last in (START, ASSISTANT):
            if best is None or cost < best[0] or cost == best[0] and _less(edit, best[1]):
                best = (cost, edit)
        children = [("I", 2, i, AFTER[last, NEXT[last]])]
        if i < n:
            initial, fault = rows[i]
            children.append(("D", 3, i + 1, last))
            if fault not in (BLANK, DUPLICATE):
                mark = int(fault == TRUNCATED)
                if (last, initial) in AFTER:
                    children.append(("K", mark, i + 1, AFTER[last, initial]))
                children.append(("R", 2 + mark, i + 1, AFTER[last, NEXT[last]]))
        ordered = sorted(((cost + more + bound[at][role], letter, cost + more, at, role) for letter, more, at, role in children), reverse=True)
        for least, letter, spent, at, role in ordered:  # the best child is pushed last and taken first
            if best is not None and least > best[0]:
                continue
            known, child = table[at].get(role), _Edit(letter, edit)
            if known is not None and (known[0] < spent or known[0] == spent and not _less(child, known[1])):
                continue
            table[at][role] = (spent, child)
            stack.append((spent, at, role, child))
    letters, edit = [], best[1]
    while edit.before is not None:
        letters.append(edit.letter)
        edit = edit.before
    return best[0], "".join(reversed(letters))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with one of five faults by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without final marks, repeated, user; `dropped` rows stay marked."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(part[3], ".!?", "")).otherwise(part[3])
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(part[2]).alias("role"), text.alias("text"), fate.alias("fate"))
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", "role", "text", "copy", (F.col("fate") == 0).alias("dropped"),
    )


def _place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("sha"), F.col("copy"))


PLAN = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plan(kind: str):
    def run(batches):
        for batch in batches:
            out = []
            for conv, rows in zip(batch.column("conv_id").to_pylist(), batch.column("rows").to_pylist()):
                seen, faults = set(), []
                for r in rows:
                    faults.append(BLANK if r["blank"] else DUPLICATE if r["at"]["sha"] in seen else TRUNCATED if r["open"] else FINE)
                    seen.add(r["at"]["sha"])
                turns = {r["at"]["turn"] for r in rows} - {None}
                roles = [r["initial"] for r in rows]
                cost, audit = repair(list(zip(roles, faults)))
                out.append((
                    conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                ))
            columns = list(zip(*out)) or [[]] * 8
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()]
            names = [p.split(" ")[0] for p in PLAN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def plans(rows: DataFrame) -> DataFrame:
    """One row a conversation: what is wrong with its damaged rows, and the cost and audit of its repair."""
    rows = rows.select(
        "conv_id", "dropped", F.struct(
            _place().alias("at"), F.when(F.col("role") == "", F.lit(" ")).otherwise(F.substring("role", 1, 1)).alias("initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{SPACE}*\z")).alias("open"),
        ).alias("row"),
    )
    # collect_list leaves out the nulls that dropped rows become, so a conversation without rows stays
    light = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("dropped"), F.col("row")))).alias("rows"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return light.mapInArrow(_plan(kind), PLAN.format(kind=kind))


def _write(batches):
    """Walks the rows of sorted conversations, each behind its plan: hashes what stays, with the inserted turns between."""
    plan, state, at, last = None, None, 0, START

    def put(role: str, text: str) -> None:
        nonlocal last, begun
        state.update((("\n" if begun else "") + role + ":" + text).encode())
        begun, last = True, AFTER[last, role[0]]

    def inserts() -> None:
        nonlocal at
        while at < len(plan["audit"]) and plan["audit"][at] == "I":
            put(ROLES[NEXT[last]], "")
            at += 1

    begun, names = False, [p.split(" ")[0] for p in PLAN.split(", ")]
    for batch in batches:
        done = []

        def finish() -> None:
            inserts()
            done.append((*plan.values(), state.hexdigest()))

        columns = [batch.column(c).to_pylist() for c in (*names, "role", "text")]
        for *values, role, text in zip(*columns):
            if role is None:
                if plan is not None:
                    finish()
                plan, state, at, last, begun = dict(zip(names, values)), hashlib.sha256(), 0, START, False
                continue
            inserts()
            letter, at = plan["audit"][at], at + 1
            if letter != "D":
                put(role if letter == "K" else ROLES[NEXT[last]], text)
        kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=[*names, "repaired_sha256"])
    if plan is not None:
        done = []
        inserts()
        done.append((*plan.values(), state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=[*names, "repaired_sha256"])


def repaired(rows: DataFrame) -> DataFrame:
    """The plans, each with the digest of the repaired conversation: `role:text` of its rows, joined by line feeds."""
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)))
    plan = plans(rows)
    kind = plan.schema["conv_id"].dataType.simpleString()
    numbers = plan.columns[1:]
    texts = rows.where("not dropped").select("conv_id", *[F.lit(None).cast(plan.schema[c].dataType).alias(c) for c in numbers], _place().alias("at"), "role", "text")
    heads = plan.select("*", F.lit(None).cast(texts.schema["at"].dataType).alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("at").asc_nulls_first())
    return both.select(*plan.columns, "role", "text").mapInArrow(_write, PLAN.format(kind=kind) + ", repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and its cheapest repair."""
    return repaired(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op12_conversation_repair": (op12_conversation_repair, None)}
