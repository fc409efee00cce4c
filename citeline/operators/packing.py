"""Greedy packing of ordered lines into size-limited pieces, block by block.

Whether a line opens a new piece depends on the size of the piece before it, so packing is a sequential fold. A
run of lines is cut into blocks of ``block_rows`` lines. Each block maps "size of the piece that is still open on
entry" to "size open on exit"; the maps are composed per run (one row per block), which gives every block its
entry size, and then all blocks are packed independently.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _block_map(costs: np.ndarray, first: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For every entry size 0..limit+1: (size on exit, line that opened the piece open on exit, -1 = before here).

    limit+1 stands for a single line above the limit. Equal sizes stay equal, so they are merged as they arise.
    """
    group = np.arange(limit + 2)
    sizes, opened = np.arange(limit + 2), np.full(limit + 2, -1, dtype=np.int64)
    for n, cost in enumerate(costs):
        grown = sizes + cost
        fresh = (sizes == 0) | (grown > limit)
        sizes = np.minimum(np.where(fresh, cost, grown), limit + 1)
        opened = np.where(fresh, first + n, opened)
        if n % 8 == 7 and len(sizes) > 1:
            sizes, keep, inverse = np.unique(sizes, return_index=True, return_inverse=True)
            opened, group = opened[keep], inverse[group]
    return sizes[group], opened[group]


def _openings(costs, first: int, size: int, at: int, limit: int):
    """(opening line per line, size and opening line at the end)."""
    out = np.empty(len(costs), dtype=np.int64)
    for i, cost in enumerate(costs):
        if size == 0 or size + cost > limit:
            size, at = 0, first + i
        size += cost
        out[i] = at
    return out, min(size, limit + 1), at


def pack_lines(
    lines: DataFrame, keys: Sequence[str], order: str, cost: str, limit: int, block_rows: int = 4096
) -> DataFrame:
    """Add ``piece``: the number of the line that opens the piece a line belongs to.

    ``order`` must number the lines of each key 0, 1, 2, …; costs are at least 1. ``lines`` is read in three
    branches, so settle it first when it is not a stored table.
    """
    keys = list(keys)
    placed = lines.withColumn("__block", F.floor(F.col(order) / block_rows))
    spec = [*keys, "__block"]

    # Entry sizes. Runs of one block (nearly all) start at 0 and need no map.
    slim = placed.select(*spec, order, F.least(F.col(cost), F.lit(limit + 1)).cast("int").alias("__cost"))
    long_runs = slim.groupBy(*keys).agg(F.max("__block").alias("__last")).where(F.col("__last") > 0)
    id_fields = [placed.schema[c] for c in spec]
    integers = T.ArrayType(T.LongType())
    mapped_schema = T.StructType([*id_fields, T.StructField("__sizes", integers), T.StructField("__opened", integers)])

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes, opened = _block_map(pdf["__cost"].to_numpy(), int(pdf[order].iloc[0]), limit)
        row = {c: [pdf[c].iloc[0]] for c in spec}
        return pd.DataFrame({**row, "__sizes": [sizes.tolist()], "__opened": [opened.tolist()]})

    mapped = (
        slim.join(long_runs, keys)
        .where(F.col("__block") < F.col("__last"))
        .groupBy(*spec)
        .applyInPandas(block_map, mapped_schema)
    )
    entry_schema = T.StructType([*id_fields, T.StructField("__size", T.LongType()), T.StructField("__at", T.LongType())])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, size, at = None, 0, 0
        for pdf in batches:
            sizes, starts = [], []
            for key, exits, opened in zip(pdf[keys].itertuples(index=False, name=None), pdf["__sizes"], pdf["__opened"]):
                if key != current:
                    current, size, at = key, 0, 0
                at = int(opened[size]) if opened[size] >= 0 else at
                size = int(exits[size])
                sizes.append(size)
                starts.append(at)
            yield pdf[spec].assign(__block=pdf["__block"] + 1, __size=sizes, __at=starts)

    entries = mapped.repartition(*keys).sortWithinPartitions(*spec).mapInPandas(compose, entry_schema)

    # Packing proper: blocks stream through the tasks in order, nothing is held but the open size.
    slots = [*spec, order, "__size", "__at", cost]
    out_schema = T.StructType([*placed.schema.fields, T.StructField("piece", T.LongType())])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, size, at = None, 0, 0
        for pdf in batches:
            codes = pd.factorize(pd.MultiIndex.from_frame(pdf[spec]))[0]
            cuts = (np.flatnonzero(np.diff(codes)) + 1).tolist()
            nth, costs = pdf[order].to_numpy(), pdf[cost].to_numpy()
            pieces = []
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
                head = pdf[slots].iloc[lo]
                key = tuple(head[c] for c in spec)
                if key != current:
                    current, size, at = key, int(head["__size"]), int(head["__at"])
                opened, size, at = _openings(costs[lo:hi], int(nth[lo]), size, at, limit)
                pieces.append(opened)
            yield pdf.drop(columns=["__size", "__at"]).assign(piece=np.concatenate(pieces) if pieces else [])

    ready = placed.join(entries, spec, "left").select(
        *placed.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("__size", "__at")]
    )
    ordered = ready.repartition(*spec).sortWithinPartitions(*spec, order)
    return ordered.mapInPandas(pack, out_schema).drop("__block")
