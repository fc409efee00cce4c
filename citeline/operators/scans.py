"""Ordered scans that never put one whole key into one task.

A plain window over ``partitionBy(document)`` sends a document's every line to one task. Here rows are windowed
inside bounded *blocks* (a page, a thousand lines, a day), each block is reduced to one summary row, the
summaries alone are windowed per key, and their result is joined back on (key, block). The big side is shuffled
once, on (key, block).

Each scan reads its input in two branches. Chains therefore settle their rows between scans (``session.settle``);
otherwise the plan would double with every step.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inside(keys: Sequence[str], block: str, order: Sequence[str]):
    return Window.partitionBy(*keys, block).orderBy(*order)


def _across(keys: Sequence[str], block: str):
    return Window.partitionBy(*keys).orderBy(block)


def fill_forward(
    rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], fills: dict[str, str],
    inclusive: bool = True,
) -> DataFrame:
    """Add, per ``fills`` item output -> source column, the latest non-null source at or before each row.

    With ``inclusive=False`` the row itself does not count.
    """
    keys, order = list(keys), list(order)
    window = _inside(keys, block, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    place = F.struct(*order)
    ends = rows.groupBy(*keys, block).agg(
        *[F.max_by(src, F.when(F.col(src).isNotNull(), place)).alias(f"__{out}") for out, src in fills.items()]
    )
    before = _across(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, block, *[F.last(f"__{out}", ignorenulls=True).over(before).alias(f"__{out}") for out in fills]
    )
    local = rows.withColumns({out: F.last(src, ignorenulls=True).over(window) for out, src in fills.items()})
    joined = local.join(carried, [*keys, block], "left")
    return joined.withColumns({out: F.coalesce(out, f"__{out}") for out in fills}).drop(
        *[f"__{out}" for out in fills]
    )


def running_sum(
    rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Add, per ``sums`` item output -> source column, the sum of the source up to and including each row."""
    keys, order = list(keys), list(order)
    window = _inside(keys, block, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _across(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, block).agg(*[F.sum(src).alias(f"__{out}") for out, src in sums.items()])
    carried = totals.select(
        *keys, block, *[F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in sums]
    )
    local = rows.withColumns({out: F.sum(src).over(window) for out, src in sums.items()})
    joined = local.join(carried, [*keys, block], "left")
    return joined.withColumns({out: F.col(out) + F.col(f"__{out}") for out in sums}).drop(
        *[f"__{out}" for out in sums]
    )


def running_extreme(
    rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], columns: dict[str, str],
    aggregate: Callable, pick: Callable,
) -> DataFrame:
    """Running minimum or maximum: ``aggregate``/``pick`` are F.min/F.least or F.max/F.greatest."""
    keys, order = list(keys), list(order)
    window = _inside(keys, block, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _across(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, block).agg(*[aggregate(src).alias(f"__{out}") for out, src in columns.items()])
    carried = ends.select(*keys, block, *[aggregate(f"__{out}").over(before).alias(f"__{out}") for out in columns])
    local = rows.withColumns({out: aggregate(src).over(window) for out, src in columns.items()})
    joined = local.join(carried, [*keys, block], "left")
    return joined.withColumns({out: pick(F.col(out), F.coalesce(f"__{out}", out)) for out in columns}).drop(
        *[f"__{out}" for out in columns]
    )


def number_islands(
    rows: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    looks_back: Sequence[str],
    starts: Callable[[dict[str, Column]], Column],
    out: str = "island",
    nth: str | None = None,
) -> DataFrame:
    """Number runs of consecutive rows, from 1 within each key; ``nth`` names a row number, from 0, within the run.

    ``starts`` gets the previous row's ``looks_back`` columns (NULL before the first row) and returns whether the
    current row opens a new run; a key's first row always does. ``starts`` may read, of the current row, the
    ``looks_back`` columns only.
    """
    keys, order, looks_back = list(keys), list(order), list(looks_back)
    window = _inside(keys, block, order)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def opens(previous: dict[str, Column]) -> Column:
        return F.coalesce(starts(previous), F.lit(False)).cast("long")

    inner = rows.withColumns({f"__p_{c}": F.lag(c).over(window) for c in looks_back}).withColumn(
        "__nth", F.row_number().over(window)
    )
    flag = F.when(F.col("__nth") == 1, F.lit(0)).otherwise(opens({c: F.col(f"__p_{c}") for c in looks_back}))
    inner = inner.withColumn("__open", flag.cast("long")).withColumn("__local", F.sum("__open").over(running))
    inner = inner.withColumn("__at", F.max(F.when(F.col("__open") == 1, F.col("__nth"))).over(running))

    place = F.struct(*order)
    seen = F.struct(*looks_back)
    summary = inner.groupBy(*keys, block).agg(
        F.min_by(seen, place).alias("__first"), F.max_by(seen, place).alias("__last"),
        F.sum("__open").alias("__inner"), F.count("*").alias("__rows"), F.max("__at").alias("__at"),
    )
    across = _across(keys, block)
    summary = summary.withColumn("__before", F.lag("__last").over(across)).select(
        *keys, block, "__inner", "__rows", "__at", "__before", *[F.col(f"__first.{c}").alias(c) for c in looks_back]
    )
    first_opens = F.when(F.col("__before").isNull(), F.lit(1)).otherwise(
        opens({c: F.col(f"__before.{c}") for c in looks_back})
    )
    summary = summary.withColumn("__head", first_opens.cast("long"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__base_row", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    opened = F.coalesce(F.col("__at"), F.when(F.col("__head") == 1, F.lit(1)))  # last opening row in the block
    summary = summary.withColumn("__opened", F.col("__base_row") + opened)
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.sum(F.col("__head") + F.col("__inner")).over(upto) - F.col("__inner")
    carried = summary.select(
        *keys, block, base.alias("__base"), "__base_row",
        F.when(F.col("__head") == 1, F.col("__base_row") + 1)
        .otherwise(F.last("__opened", ignorenulls=True).over(earlier)).alias("__carried"),
    )
    numbered = inner.drop("__open", *[f"__p_{c}" for c in looks_back]).join(carried, [*keys, block])
    numbered = numbered.withColumn(out, F.col("__base") + F.col("__local"))
    if nth:
        began = F.coalesce(F.col("__base_row") + F.col("__at"), F.col("__carried"))
        numbered = numbered.withColumn(nth, F.col("__base_row") + F.col("__nth") - began)
    return numbered.drop("__base", "__base_row", "__carried", "__local", "__at", "__nth")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group; Spark cuts to k inside every task before it shuffles."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
