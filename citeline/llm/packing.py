"""Packing: length buckets of least padding by dynamic programming, and token-budget batches inside each bucket.

The lengths of all rows make one histogram; the best ``buckets`` boundaries are found over it. Lengths up to ``FINE`` are bins of
their own; longer ones share a bin within 1/256 of each other, which keeps the histogram at some thousand rows whatever the
data; a bin's rows, sum and largest length are exact, and a boundary is the largest length of a bin. Rows are padded to the
boundary of their bucket; a batch has as many as the budget holds, at least one.

Places inside a bucket come from counts per hash part, summed, and a window over each part alone, so that no task orders
a whole bucket; batches run on over the parts, and only a bucket's last batch is not full. Null and empty texts have length 0 and
count as one token against the budget. Rows repeated under one identifier are packed each. No rows give no batches.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeline.llm.common import documents

BUCKETS, BUDGET = 16, 65_536
FINE = 1024  # lengths up to this one have bins of their own
PART_ROWS = 50_000  # rows of a bucket that one window orders, in the mean


def boundaries(lengths: list[int], rows: list[int], sums: list[int], buckets: int) -> tuple[list[int], int]:
    """(boundaries, padding) of the best cut of ascending bins into at most ``buckets`` runs."""
    n = len(lengths)
    top, count, total = np.array(lengths, np.float64), np.concatenate([[0], np.cumsum(rows)]).astype(np.float64), np.concatenate([[0], np.cumsum(sums)]).astype(np.float64)
    best = np.full((min(buckets, n) + 1, n + 1), np.inf)
    best[0, 0] = 0
    cut = np.zeros(best.shape, np.int64)
    for k in range(1, len(best)):
        for j in range(1, n + 1):
            cost = best[k - 1, :j] + top[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            cut[k, j] = i = int(cost.argmin())
            best[k, j] = cost[i]
    if not n:
        return [], 0
    k = int(best[:, n].argmin())
    padding, at, out = int(best[k, n]), n, []
    while k:
        out.append(lengths[at - 1])
        at, k = int(cut[k, at]), k - 1
    return out[::-1], padding


def pack(docs: DataFrame, key: str = "doc_id", column: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, n_tokens, bucket, padded_tokens, batch_id, batch_row) of every row; tokens are words."""
    rows = docs.select(F.col(key).alias("id"), F.regexp_count(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    bin_of = F.expr(f"IF(n <= {FINE}, n, {FINE} + bigint(ceil(ln(n / {FINE}) * 256)))")
    histogram = rows.groupBy(bin_of.alias("bin")).agg(F.max("n").alias("top"), F.count("*").alias("rows"), F.sum("n").alias("sum")).orderBy("bin").collect()
    edges, _ = boundaries([r.top for r in histogram], [r.rows for r in histogram], [r["sum"] for r in histogram], buckets)
    parts = max(1, sum(r.rows for r in histogram) // PART_ROWS)
    bucket = F.lit(0)
    for i, edge in list(enumerate(edges))[:0:-1]:
        bucket = F.when(F.col("n") > edges[i - 1], F.lit(i)) if bucket is None else F.when((F.col("n") > edges[i - 1]) & (F.col("n") <= edge), F.lit(i)).otherwise(bucket)
    # a row's own number spreads rows that repeat an identifier over the parts as well
    placed = rows.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("id", "n"), F.lit(parts)))
    before = placed.groupBy("bucket", "part").agg(F.count("*").alias("rows")).withColumn(
        "before", F.sum("rows").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("bucket", "part", F.coalesce("before", F.lit(0)).alias("before"))
    capacity = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, e in enumerate(edges) for x in (i, max(1, budget // max(e, 1))))), F.col("bucket")), F.lit(1)) if edges else F.lit(1)
    padded = F.element_at(F.create_map(*(F.lit(x) for i, e in enumerate(edges) for x in (i, e))), F.col("bucket")) if edges else F.lit(0)
    ordered = placed.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("id", "n")) - 1)
    place = F.col("place") + F.col("before")
    return ordered.join(before, ["bucket", "part"]).select(
        F.col("id").alias(key), F.col("n").alias("n_tokens"), "bucket", padded.cast("long").alias("padded_tokens"),
        F.format_string("%d-%d", "bucket", F.floor(place / capacity)).alias("batch_id"), (place % capacity).cast("long").alias("batch_row"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its length bucket and batch."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op3_packing": (op3_packing, None)}
