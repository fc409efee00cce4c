"""Prefix trie of conversations, by splitters and their skeleton.

A conversation is a path: one step per turn, of the SHA-256 of (role, text) and the text's bytes. Paths are dealt in ranges of
(path, conv_id). The splitters between ranges are sampled paths; the trie of their prefixes, the skeleton, is broadcast. A
node outside the skeleton lies in one range only, so a shard, which reads its range in order and keeps one open node per turn of the
current path, finishes it alone. A skeleton node may lie in many ranges: every shard leaves a partial aggregate of it, and a
reduction by node adds these up. Terms that count a node once (its bytes) are added by the shard that meets the sampled conversation
the node comes from. Whether a skeleton node is a leaf is known after the reduction; only ends of splitters can be one, and their
count is added to their at most ``TURNS`` ancestors then.

Bounds: at most ``SHARDS`` ranges; splitters are cut after ``TURNS`` turns, so the skeleton has at most SHARDS x TURNS nodes
of some hundred bytes. Conversations that agree in more turns than that stay in one range, which its task reads as a stream. A shard
holds at most ``PENDING`` finished nodes that wait for their parent's smallest member; further ones are joined to their parent
afterwards. The conversations that end in a node are hashed as they come by; those of a skeleton node are sent on in chunks of their
numerals, and one task hashes them in order, as the digest of one text asks for. One conversation's path, 40 bytes a turn, is one cell.

Rows without conv_id belong to no conversation and are left out. Null role or text counts as empty. Turns are ordered with nulls first, rows
of one turn by the digest of role and text, so repeated rows are turns of their own. A conversation without turns is a member of the root.
An empty table has no node. Columns besides the four are not read.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.session import settle

STEP = 40  # bytes of a step: 32 of the digest, 8 of the size
SHARDS = 4096
SHARD_BYTES = 16 << 20
TURNS = 64
SAMPLE = 16  # sampled paths a shard
PENDING = 1 << 18
CHUNK = 1 << 18
ROWS = 8192
EMPTY = hashlib.sha256(b"").hexdigest()

NODES = (
    "kind int, shard long, serial long, pshard long, pserial long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, line array<long>, first long, chunk binary"
)
ARROW = pa.schema([
    ("kind", pa.int32()), *((name, pa.int64()) for name in ("shard", "serial", "pshard", "pserial", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("line", pa.list_(pa.int64())), ("first", pa.int64()), ("chunk", pa.binary()),
])
LOCAL, PART, ENDS = 0, 1, 2
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def steps(conversations: DataFrame) -> DataFrame:
    """(conv_id, steps): the turns of every conversation in order, each as the hex digits of its step. Texts are hashed before the shuffle."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    step = F.concat(F.upper(digest), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), step.alias("step")).alias("at"),
    )
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).repartition("base")
    return rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns")).select("base", "conv_id", F.col("turns.step").alias("steps"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """Steps where conversation c begins with the first h turns of conversation c - c % 5; h is the checksum of c's numeral modulo 9."""
    own = steps(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    heads = own.where("base = conv_id").select("base", F.slice("steps", 1, 8).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.expr("slice(steps, h + 1, greatest(size(steps) - h, 0))")
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("steps"))


class _Skeleton:
    """Trie of the splitters' paths: node 0 is the root; ``owned`` names the nodes that a sampled conversation brings in first."""

    def __init__(self, keys: list[tuple[bytes, float]], ids: list[int]):
        self.keys, self.children, self.parents, self.owned = keys, [{}], [None], {}
        for (path, _), conv in zip(keys, ids):
            at = 0
            for i in range(0, len(path), STEP):
                step = path[i:i + STEP]
                if step not in self.children[at]:
                    self.children[at][step] = len(self.parents)
                    self.owned.setdefault(conv, set()).add(len(self.parents))
                    self.parents.append(at)
                    self.children.append({})
                at = self.children[at][step]

    def line(self, at: int) -> list[int]:
        """The node and its ancestors."""
        found = [at]
        while self.parents[found[-1]] is not None:
            found.append(self.parents[found[-1]])
        return found


def _key(path: bytes, conv: int) -> tuple[bytes, float]:
    """Place of a conversation among the splitters; beyond ``TURNS`` turns only those count."""
    cut = TURNS * STEP
    return (path, conv) if len(path) <= cut else (path[:cut], float("inf"))


class _Node:
    __slots__ = ("step", "size", "index", "serial", "n", "low", "children", "leaves", "saved", "ends", "first", "waiting", "asked")

    def __init__(self, step: bytes, index: int, serial: int):
        self.step, self.index, self.serial = step, index, serial
        self.size = int.from_bytes(step[32:], "big")
        self.n = self.children = self.leaves = self.saved = 0
        self.low, self.first, self.asked, self.waiting = None, None, False, []
        self.ends = bytearray() if index >= 0 else None


class _Shard:
    """Nodes of one range, read in the order of (path, conv_id)."""

    def __init__(self, shard: int, skeleton: _Skeleton, out: list):
        self.shard, self.skeleton, self.out = shard, skeleton, out
        self.open, self.serial, self.held, self.mine = [_Node(b"\0" * STEP, 0, 0)], 0, 0, set()

    def add(self, path: bytes, conv: int) -> None:
        depth, stack = len(path) // STEP, self.open
        shared = 0
        while shared < depth and shared + 1 < len(stack) and stack[shared + 1].step == path[shared * STEP:(shared + 1) * STEP]:
            shared += 1
        while len(stack) > shared + 1:
            self.close()
        for i in range(shared, depth):
            step, above = path[i * STEP:(i + 1) * STEP], stack[-1].index
            self.serial += 1
            stack.append(_Node(step, self.skeleton.children[above].get(step, -1) if above >= 0 else -1, self.serial))
        self.mine |= self.skeleton.owned.get(conv, set())
        end = stack[-1]
        end.n += 1
        end.low = conv if end.low is None else min(end.low, conv)
        numeral = str(conv).encode()
        if end.index < 0:
            if end.first is None:
                end.ends, end.first = hashlib.sha256(numeral), conv
            else:
                end.ends.update(b"," + numeral)
        else:
            if end.first is None:
                end.first = conv
            end.ends += (b"," if end.ends else b"") + numeral
            if len(end.ends) >= CHUNK:
                self.send(end)

    def send(self, node: _Node) -> None:
        if node.first is not None:
            self.out.append((ENDS, None, node.index, *[None] * 11, node.first, bytes(node.ends)))
            node.ends, node.first = bytearray(), None

    def close(self) -> None:
        """Finishes the deepest open node and adds it to its parent."""
        node, depth = self.open.pop(), len(self.open)
        above = self.open[-1] if self.open else None
        if node.index >= 0:
            self.send(node)
            node.saved += node.n * node.size - (node.size if node.index in self.mine else 0)
            kids = len(self.skeleton.children[node.index])
            self.out.append((
                PART, None, node.index, None, self.skeleton.parents[node.index], node.low, depth, None, node.n, node.children, node.leaves, node.saved,
                None, None if kids else self.skeleton.line(node.index), kids, None,
            ))
        else:
            node.saved += (node.n - 1) * node.size
            node.leaves += not node.children
            for row in node.waiting:
                self.out.append((LOCAL, row[0], row[1], None, None, row[2], depth + 1, node.low, *row[3:], None, None, None))
            self.held -= len(node.waiting)
            mine = (self.shard, node.serial) if node.asked else (None, None)
            row = (*mine, node.low, node.n, node.children, node.leaves, node.saved, node.ends.hexdigest() if node.ends else EMPTY)
            if above.index < 0 and self.held < PENDING:
                above.waiting.append(row)
                self.held += 1
            else:
                over = (-1, above.index) if above.index >= 0 else (self.shard, above.serial)
                above.asked = True
                self.out.append((LOCAL, row[0], row[1], *over, row[2], depth, None, *row[3:], None, None, None))
        if above is not None:
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)
            above.leaves += node.leaves
            above.saved += node.saved
            above.children += node.index < 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def _scan(skeleton):
    """The function over a sorted partition that yields finished nodes, partial skeleton nodes and chunks of members."""

    def run(batches):
        out, now = [], None
        for batch in batches:
            for shard, path, conv in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id"))):
                if now is None or now.shard != shard:
                    if now is not None:
                        while now.open:
                            now.close()
                    now = _Shard(shard, skeleton.value, out)
                now.add(path, conv)
                if len(out) >= ROWS:
                    yield _batch(out)
                    out.clear()
        if now is not None:
            while now.open:
                now.close()
        if out:
            yield _batch(out)

    return run


def _digests(batches):
    """SHA-256 of the chunks of every node, which come in order."""
    now, state, done = None, None, []
    for batch in batches:
        for serial, chunk in zip(batch.column("serial").to_pylist(), batch.column("chunk").to_pylist()):
            if serial != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = serial, hashlib.sha256(chunk)
            else:
                state.update(b"," + chunk)
    if now is not None:
        done.append((now, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["serial", "ends_sha256"])


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the conversations given as (conv_id, steps); ``shards`` is chosen from the bytes of the paths unless given."""
    spark = conversations.sparkSession
    paths = settle(conversations.select("conv_id", F.unhex(F.array_join("steps", "")).alias("path")), "paths")
    rows, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.length("path") + 8), F.lit(0))).first()
    if shards is None:
        shards = max(2 * spark.sparkContext.defaultParallelism, size // SHARD_BYTES + 1)
    shards = min(shards, SHARDS)
    part = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE * shards / max(rows, 1)))
    seen = paths.where(part).select(F.expr(f"substring(path, 1, {(TURNS + 1) * STEP})").alias("path"), "conv_id").collect()
    sample = sorted({_key(bytes(r.path), r.conv_id): r.conv_id for r in seen}.items())
    picked = [sample[i] for i in sorted({len(sample) * s // shards for s in range(1, shards)})] if sample else []
    skeleton = spark.sparkContext.broadcast(_Skeleton([k for k, _ in picked], [c for _, c in picked]))

    def deal(batches):
        keys = skeleton.value.keys
        for batch in batches:
            at = [bisect_right(keys, _key(p, c)) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column("path"), batch.column("conv_id")], names=["shard", "path", "conv_id"])

    dealt = paths.select("path", "conv_id").mapInArrow(deal, "shard long, path binary, conv_id long")
    found = settle(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(_scan(skeleton), NODES), "nodes")
    return _joined(found)


def _joined(found: DataFrame) -> DataFrame:
    """The finished nodes with their parents, and the skeleton's nodes reduced over the shards."""
    parts = found.where(F.col("kind") == PART).groupBy("serial", "pserial", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")],
        (F.sum("n_children") + F.max("first")).alias("n_children"), F.max("line").alias("line"),
    )
    chunks = found.where(F.col("kind") == ENDS).select("serial", "first", "chunk").repartition("serial").sortWithinPartitions("serial", "first")
    skeleton = settle(parts.join(chunks.mapInArrow(_digests, "serial long, ends_sha256 string"), "serial", "left"), "skeleton")
    leaves = skeleton.where("n_children = 0").select(F.explode("line").alias("serial")).groupBy("serial").agg(F.count("*").alias("more"))
    above = skeleton.select(F.col("serial").alias("pserial"), F.col("conv_id").alias("parent_conv_id"))
    upper = skeleton.join(leaves, "serial", "left").join(above, "pserial", "left")
    upper = upper.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more", F.lit(0))).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    local = found.where(F.col("kind") == LOCAL)
    asked = local.where("serial is not null").select(F.col("shard").alias("pshard"), F.col("serial").alias("pserial"), F.col("conv_id").alias("parent_conv_id"))
    parents = settle(above.select(F.lit(-1).cast("long").alias("pshard"), "pserial", "parent_conv_id").unionByName(asked), "parents")
    late = local.where("pserial is not null").drop("parent_conv_id").join(parents, ["pshard", "pserial"])
    return local.where("pserial is null").select(RESULT).unionByName(late.select(RESULT)).unionByName(upper.select(RESULT))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie(rebuild(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS tab),
c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
        lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h FROM c, crc),
t AS (SELECT conv_id, strlen(coalesce(text, ''))::BIGINT AS size, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS step, turn FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, step, size) AS n FROM t WHERE conv_id IS NOT NULL),
r AS (SELECT k.conv_id, o.n AS part, 0 AS own, size, step FROM k JOIN o ON o.conv_id = k.base AND o.n <= k.h UNION ALL
      SELECT k.conv_id, o.n, 1, size, step FROM k JOIN o ON o.conv_id = k.conv_id AND o.n > k.h),
p AS (SELECT conv_id, size, row_number() OVER w AS depth, string_agg(step, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, part)),
m AS (SELECT conv_id, 0 AS size, 0 AS depth, '' AS path FROM c UNION ALL SELECT * FROM p),
e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (SELECT depth, path, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
      sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (last = depth), '')) AS ends_sha256 FROM m JOIN e USING (conv_id) GROUP BY depth, path),
s AS (SELECT path, count(*) AS n_children FROM (SELECT DISTINCT left(path, length(path) - 64) AS path, path AS child FROM n WHERE depth > 0) GROUP BY path),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN s USING (path)),
u AS (SELECT a.path, sum((f.n_convs - 1) * f.size) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
      FROM (SELECT DISTINCT x.path, y.path AS below FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.depth <= y.depth) a JOIN f ON f.path = a.below GROUP BY a.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, g.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (path) LEFT JOIN f g ON f.depth > 0 AND g.path = left(f.path, length(f.path) - 64)
"""
QUERIES = {"op11_prefix_trie": (op11_prefix_trie, SQL)}
