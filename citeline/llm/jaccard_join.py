"""N-gram Jaccard join: T-occurrence search with DivideSkip over the inverted lists of word shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text's set holds its distinct shingles of five words; a text
with fewer words has its whole sequence as one; a null text or one without words has none and links with nothing. Two
texts link when 100 * intersection >= 75 * union. Shingles are compared by hash (about 54 bits).

1. Tasks send every shingle to a shard of the hash space; a shard knows every list's length and returns to the documents
   only the shingles that at least two documents have. Documents with too few of those to reach any overlap are done.
2. Rows are numbered in the written table; rows of equal sets are one class, held by its smallest number.
3. Of its shingles, shortest lists first, a document of n shingles needs only the first n - T + 1 (T: the least overlap with any
   partner) to meet each partner. Tasks reduce their part of such a list to its smallest member before it is shuffled, so
   a list is never gathered; documents of like size that meet form candidate blocks.
4. Inside a block the T-occurrence search runs: the L longest lists of a query are set aside, the short ones are
   heap-merged, and documents with at least T - L occurrences are probed in the long ones by binary search. A search
   looks for documents that are not linked yet, and every found one is searched from in turn, so a group of g copies costs
   about g searches of a shrinking index and no pairs. Blocks over ``BLOCK_DOCS`` are cut into slices, and every two slices are searched.

All rows of an identifier share one component, also where their texts differ: links of each of its texts are its links. A null identifier links with nothing and has a null component.
Columns besides key and text are not looked at; an empty table gives an empty table.
"""
from __future__ import annotations

import heapq
from bisect import bisect_left
from hashlib import blake2b
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.llm import shared, text
from citeline.llm.common import documents
from citeline.llm.components import components
from citeline.session import settle

WORDS, PERCENT = 5, 75
BLOCK_DOCS = 4096  # documents of a block searched by one task; larger blocks are sliced
MU = 0.0085  # DivideSkip: weight of a long list against a short one
_48 = np.uint64((1 << 48) - 1)


def least_overlap(n: int, percent: int) -> int:
    """The least intersection of a set of n with any partner."""
    return -(-percent * n // 100)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint16).reshape(-1, 4)[:, :3]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 4), np.uint16)
    out[:, :3] = np.frombuffer(blob, np.uint16).reshape(-1, 3)
    return out.reshape(-1).view(np.uint64)


def _sets(batch: pa.RecordBatch, column: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row of each), rows ascending."""
    raw, offsets = text.buffers(batch.column(column))
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in text.segments(offsets):
        h, row = text.shingle_hashes(*text.word_hashes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), words)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        hashes.append(h[first])
        rows.append(row[first] + a)
    return np.concatenate(hashes), np.concatenate(rows)


PART = "shard int, batch long, ids binary, counts binary, keys binary"
PART_ARROW = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
BACK = "batch long, ids binary, counts binary, keys binary, ranks binary"
BACK_ARROW = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("ids", "counts", "keys", "ranks"))])
DOCS = "id long, n long, digest binary, keys binary, ranks binary"


def _shared_shingles(docs: DataFrame, key: str, column: str, words: int, percent: int) -> DataFrame:
    """(id, n, digest, keys, ranks) of every row; keys and their list ranks only where a partner is possible."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            at = (part << 24) + number
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            hashes, rows = _sets(batch, column, words)
            sizes = np.bincount(rows, minlength=batch.num_rows)
            yield pa.RecordBatch.from_pydict({"shard": [-1 - part], "batch": [at], "ids": [ids.tobytes()], "counts": [sizes.astype(np.int64).tobytes()], "keys": [known.tobytes()]}, schema=PART_ARROW)
            live = known[rows]
            hashes, rows = hashes[live], rows[live]
            shard = shared.shard_of(hashes, shards)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                mine = order[bounds[s]:bounds[s + 1]]
                if len(mine):
                    row, counts = np.unique(rows[mine], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"shard": [s], "batch": [at], "ids": [row.astype(np.uint32).tobytes()], "counts": [counts.astype(np.uint32).tobytes()], "keys": [_pack(hashes[mine] & _48)]}, schema=PART_ARROW)

    def lists(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        if parts[0]["shard"] < 0:
            return pa.Table.from_pylist([{"batch": p["batch"], "ids": p["ids"], "counts": p["counts"], "keys": p["keys"], "ranks": None} for p in parts], schema=BACK_ARROW)
        keys = [_unpack(p["keys"]) for p in parts]
        _, inverse, lengths = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        lengths, back, done = lengths[inverse], [], 0
        shard = np.uint64(parts[0]["shard"] & 0xFFFF) << np.uint64(48)
        for p, k in zip(parts, keys):
            length = lengths[done:done + len(k)]
            done += len(k)
            row = np.repeat(np.frombuffer(p["ids"], np.uint32), np.frombuffer(p["counts"], np.uint32))
            keep = length > 1
            if keep.any():
                rows, counts = np.unique(row[keep], return_counts=True)
                back.append({"batch": p["batch"], "ids": rows.astype(np.uint32).tobytes(), "counts": counts.astype(np.uint32).tobytes(), "keys": (k[keep] | shard).tobytes(), "ranks": np.log2(length[keep]).astype(np.uint8).tobytes()})
        return pa.Table.from_pylist(back, schema=BACK_ARROW)

    def assemble(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        head = next(p for p in parts if p["ranks"] is None)
        ids, sizes, known = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["counts"], np.int64), np.frombuffer(head["keys"], bool)
        parts = [p for p in parts if p["ranks"] is not None]
        row = np.concatenate([np.zeros(0, np.uint32), *(np.repeat(np.frombuffer(p["ids"], np.uint32), np.frombuffer(p["counts"], np.uint32)) for p in parts)])
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(p["keys"], np.uint64) for p in parts)])
        ranks = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(p["ranks"], np.uint8) for p in parts)])
        order = np.lexsort((keys, ranks, row))
        row, keys, ranks = row[order], keys[order], ranks[order]
        bounds = np.searchsorted(row, np.arange(len(ids) + 1))
        out: dict[str, list] = {"digest": [], "keys": [], "ranks": []}
        for i, n in enumerate(sizes.tolist()):
            a, b = bounds[i], bounds[i + 1]
            if b > a and b - a >= least_overlap(n, percent):
                blob = np.sort(keys[a:b]).tobytes()
                out["digest"].append(blake2b(blob + n.to_bytes(8, "big"), digest_size=16).digest() if b - a == n else None)
                out["keys"].append(keys[a:b].tobytes())
                out["ranks"].append(ranks[a:b].tobytes())
            else:
                for values in out.values():
                    values.append(None)
        return pa.table({"id": pa.array(ids, pa.int64(), mask=~known), "n": pa.array(sizes, pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(column).cast("string").alias(column))
    return rows.mapInArrow(deal, PART).groupBy("shard").applyInArrow(lists, BACK).groupBy("batch").applyInArrow(assemble, DOCS)


def _meetings(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all documents with a common prefix shingle and like sizes into one candidate block."""
    width = -np.log(percent / 100) if percent < 100 else 1e-9

    def local(batches):
        """Per shingle and size band: members point to the smallest member of this task, which alone goes on."""
        for batch in batches:
            key, member = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, n, blob in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "keys"))):
                keys = np.frombuffer(blob, np.uint64)
                first = n - least_overlap(n, percent) + 1 - (n - len(keys))
                band = int(np.floor(np.log(n) / width))
                for b in (band, band + 1):
                    key.append(text.mix(keys[:first] + np.uint64(b * 0x9E3779B97F4A7C15 % 2**64)))
                    member.append(np.full(min(first, len(keys)), i))
            keys, members = np.concatenate(key), np.concatenate(member)
            order = np.lexsort((members, keys))
            keys, members = keys[order], members[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            low = np.repeat(members[start], np.diff(np.append(start, len(keys))))
            pairs = np.unique(np.stack([members, low], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(keys[start].view(np.int64)), pa.array(members[start]), pa.array(members[start])], names=["key", "a", "b"])

    met = settle(classes.select("id", "n", "keys").mapInArrow(local, "key long, a long, b long"), "meetings")
    inside = met.where("key is null").select("a", "b")
    sent = met.where("key is not null").select("key", F.col("a").alias("id"))
    low = sent.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b <> top").select("key", "b")
    return inside.union(sent.join(low, "key").where("id <> b").select(F.col("id").alias("a"), "b")).distinct()


class Index:
    """Inverted lists over the sets of a block, searched by DivideSkip."""

    def __init__(self, sizes: list[int], sets: list[list[int]], percent: int = PERCENT):
        self.sizes, self.sets, self.percent = sizes, sets, percent
        self.live = set(range(len(sets)))
        self._build()

    def _build(self) -> None:
        self.lists: dict[int, list[int]] = {}
        for i in sorted(self.live):
            for k in self.sets[i]:
                self.lists.setdefault(k, []).append(i)
        self.built = len(self.live)

    def take(self, found) -> None:
        """Removes documents that need not be found again."""
        self.live.difference_update(found)
        if len(self.live) * 2 < self.built:
            self._build()

    def linked(self, a: int, b: int, common: int) -> bool:
        return 100 * common >= self.percent * (self.sizes[a] + self.sizes[b] - common)

    def search(self, query: int) -> list[int]:
        """Live documents that link with the query."""
        lists = sorted((got for k in self.sets[query] if (got := self.lists.get(k))), key=len)
        least = least_overlap(self.sizes[query], self.percent)
        if not self.live or len(lists) < least:
            return []
        long = min(int(least / (MU * log2(max(len(lists[-1]), 2)) + 1)), least - 1)
        short, long_lists = lists[:len(lists) - long], lists[len(lists) - long:]
        out, at, times = [], -1, 0
        for doc in (*heapq.merge(*short), -1):
            if doc == at:
                times += 1
                continue
            if times >= least - long and at in self.live and at != query:
                common, left = times, long
                need = -(-self.percent * (self.sizes[query] + self.sizes[at]) // (100 + self.percent))
                for values in long_lists:
                    if common + left < need:
                        break
                    place = bisect_left(values, at)
                    common += place < len(values) and values[place] == at
                    left -= 1
                if common + left >= need and self.linked(query, at, common):
                    out.append(at)
            at, times = doc, 1
        return out


def forest(index: Index) -> list[tuple[int, int]]:
    """(document, smallest document it is linked with through others) of a block whose documents ascend."""
    out = []
    for root in range(len(index.sets)):
        if root not in index.live:
            continue
        index.take([root])
        queue = [root]
        while queue:
            found = index.search(queue.pop())
            index.take(found)
            queue.extend(found)
            out.extend((doc, root) for doc in found)
    return out


def _search(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) of a spanning forest of the links in each (block, left, right)."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("id", "n", "keys"))), key=lambda r: r[0])
        ids = [r[0] for r in rows]
        index = Index([r[1] for r in rows], [np.frombuffer(r[2], np.uint64).tolist() for r in rows], percent)
        pairs = forest(index)
        return pa.table({"a": pa.array([ids[a] for a, _ in pairs], pa.int64()), "b": pa.array([ids[b] for _, b in pairs], pa.int64())})

    return blocks.groupBy("block", "left", "right").applyInArrow(run, "a long, b long")


def join(docs: DataFrame, key: str = "doc_id", column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row. ``key`` is an integer column."""
    rows = settle(_shared_shingles(docs, key, column, words, percent).withColumn("row", F.monotonically_increasing_id()), "shingles")
    able = rows.where("keys is not null and id is not null")
    members = able.where("digest is not null").groupBy("digest").agg(F.min("row").alias("class"))
    copies = able.where("digest is not null").join(members, "digest").where("row <> class").select("row", "class")
    classes = able.join(copies.select("row"), "row", "left_anti").select(F.col("row").alias("id"), "n", "keys")
    near = components(_meetings(classes, percent))
    sizes = near.groupBy("component").count().withColumn("slices", F.ceil(F.col("count") / BLOCK_DOCS).cast("int"))
    near = near.join(sizes, "component").select("id", "component", "slices", F.expr("int(pmod(xxhash64(id), slices))").alias("slice"))
    cut = near.join(classes, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    blocks = cut.select(F.col("component").alias("block"), F.least("slice", "other").alias("left"), F.greatest("slice", "other").alias("right"), "id", "n", "keys")
    found = settle(_search(blocks, percent), "found")
    # every copy has the component of its class; a class without links is its own
    placed = rows.where("id is not null").select("row", "id", "n").join(copies, "row", "left")
    placed = settle(placed.select("id", "n", F.coalesce("class", "row").alias("class")), "placed")
    # the texts of one identifier belong together
    several = placed.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("top")).where("b <> top").select("id", "b")
    same = placed.join(several, "id").where("class <> b").select(F.col("class").alias("a"), "b")
    linked = components(found.union(same)).withColumnRenamed("id", "class")
    placed = placed.join(linked, "class", "left").select("id", "n", F.coalesce("component", "class").alias("component"))
    first = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(first, "component").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
    return named.union(rows.where("id is null").select("id", "n", F.lit(None).cast("long")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document that links lead to."""
    return join(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY 1) m ON m.x = d.doc_id
"""
QUERIES = {"op9_jaccard_join": (op9_jaccard_join, SQL)}
