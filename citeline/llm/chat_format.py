"""Chat formatting in budgeted windows, in DataFrame operations only.

A turn is ``<|turn|>role<|says|>text<|end|>``. Control strings inside roles and texts (the three marks and any other ``<|name|>``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) get a backslash after their first character, and backslashes are
doubled, so no text holds a control string and every text can be had back.

Turns are ordered by number, role, text. Running sums of their tokens (words plus 4) cut a conversation into spans of whole turns: a turn
belongs to the half budget its running sum falls in, and a turn of more than half the budget is a span of its own, so a
span never exceeds the budget unless one turn does. A window is the system turn (where the conversation begins with one), up to
``HISTORY`` turns before the span of at most ``HISTORY_TOKENS`` tokens each, and the span. Repeated turns are masked: the loss
covers the text of each assistant turn once, in the window of its span. Spans of the loss are character offsets.

Null texts and roles count as empty; rows of a null conversation are one conversation; repeated rows are turns like
others; other columns are not looked at; an empty table gives no windows. A conversation's text is one cell only in ``read_back``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TOKENS = 2048, 2, 128
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = r"<\|[A-Za-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, text, n_repeated, loss array<struct<start, end>>) of the rows (conv_id, turn, role, text)."""
    half = budget // 2
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")) + 4)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    item = F.struct(escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss"))
    turns = turns.select("conv_id", "turn", "role", "text", "tokens", item.alias("item"))
    turns = turns.withColumn("pos", F.row_number().over(order)).withColumn("sum", F.sum("tokens").over(upto)).withColumn("long", F.col("tokens") > half)
    turns = turns.withColumn("slot", F.when(F.col("long"), F.lit(-1)).otherwise(F.floor((F.col("sum") - 1) / half)))
    before = F.lag("slot").over(order)
    turns = turns.withColumn("opens", (before.isNull() | F.col("long") | (before != F.col("slot"))).cast("int"))
    turns = turns.withColumn("window", F.sum("opens").over(upto))
    system = F.max(F.when((F.col("pos") == 1) & (F.col("role") == "system"), F.col("item"))).over(Window.partitionBy("conv_id"))
    turns = turns.withColumn("system", system)
    is_system = (F.col("pos") == 1) & (F.col("role") == "system")

    def placed(window: Column, place: Column, what: Column, repeated: bool) -> Column:
        return F.struct(window.alias("window"), place.cast("long").alias("place"), F.lit(repeated).alias("repeated"), what.alias("item"))

    uses = [
        placed(F.col("window"), F.col("pos"), F.col("item"), False),
        F.when((F.col("opens") == 1) & (F.col("window") > 1) & F.col("system").isNotNull(), placed(F.col("window"), F.lit(0), F.col("system"), True)),
    ]
    for k in range(1, history + 1):
        opens = F.lead("opens", k).over(order) == 1
        uses.append(F.when(opens & ~is_system & (F.col("tokens") <= history_tokens), placed(F.lead("window", k).over(order), F.col("pos"), F.col("item"), True)))
    used = turns.select("conv_id", F.array(*uses).alias("uses")).select("conv_id", F.explode(F.filter("uses", lambda u: u.isNotNull())).alias("use"))
    grouped = used.groupBy("conv_id", F.col("use.window").alias("window")).agg(F.sort_array(F.collect_list(F.struct("use.place", "use.repeated", "use.item"))).alias("items"))
    piece = f"'{TURN}' || x.item.role || '{SAYS}' || x.item.text || '{END}'"
    around = len(TURN) + len(SAYS)
    spans = (
        f"aggregate(items, struct(0 AS at, cast(array() AS array<struct<start:int,end:int>>) AS spans), (a, x) -> struct("
        f"a.at + length({piece}) AS at, IF(x.item.loss AND NOT x.repeated, array_append(a.spans, struct(a.at + {around} + length(x.item.role) AS start, "
        f"a.at + {around} + length(x.item.role) + length(x.item.text) AS end)), a.spans) AS spans), a -> a.spans)"
    )
    return grouped.select(
        "conv_id", "window", F.expr(f"array_join(transform(items, x -> {piece}), '')").alias("text"),
        F.expr("size(filter(items, x -> x.repeated))").alias("n_repeated"), F.expr(spans).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation from its windows: number and digest of its turns, length and digest of the text under the loss."""
    turns = F.expr(f"transform(filter(split(text, '<[|]end[|]>', -1), (x, i) -> i < size(split(text, '<[|]end[|]>', -1)) - 1), x -> substring(x, {len(TURN) + 1}))")
    parts = formatted.select("conv_id", "window", "loss", F.length("text").cast("long").alias("chars"), "text", turns.alias("turns"), "n_repeated")
    fresh = F.slice("turns", F.col("n_repeated") + 1, F.greatest(F.size("turns") - F.col("n_repeated"), F.lit(0)))
    said = F.transform(fresh, lambda t: F.concat(unescape(F.split_part(t, F.lit(SAYS), F.lit(1))), F.lit("\n"), unescape(F.split_part(t, F.lit(SAYS), F.lit(2))), F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    read = parts.select("conv_id", "window", "chars", F.size(fresh).cast("long").alias("n"), F.array_join(said, "").alias("said"), F.array_join(loss, "").alias("loss"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"))
    said, loss = F.expr("array_join(transform(w, x -> x.said), '')"), F.expr("array_join(transform(w, x -> x.loss), '')")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose turns are control strings, formatted and read back."""
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(windows(rows.unionByName(own)))


QUERIES = {"op5_chat_format": (op5_chat_format, None)}
