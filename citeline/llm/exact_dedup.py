"""Exact dedup: owners of (length, content hash) insert whole normalised texts into Patricia tries.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty, and all empty
texts are equal. Of equal texts the row with most code points in the original stays, then the smallest identifier (null
last). Rows repeated with their identifier are one and the same choice: each is reported, all with the same ``keep_id``.
Columns besides key and text are not looked at, whatever their names. An empty table gives an empty table.

Every task first puts its own rows into tries, so a text that a third of all rows share leaves a task once. The distinct
texts go to their owner, a partition chosen by length and hash, whose tries merge them. A trie keeps its bytes in labels of
nodes; a terminal node keeps code points, smallest identifier and row count. Above ``TRIE_BYTES`` the largest subtree
moves to a file of the worker and later texts of that subtree follow it; at the end each moved subtree is merged alone.
The hash is SHA-256; a trie that finds two texts under one length and hash fails the job, so joining rows back to their
group by length and hash is exact.
"""
from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from citeline.llm.common import documents, fresh

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
TRIE_BYTES = 96 << 20  # bytes a task's trie holds before it moves a subtree to a file


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes, terminal=None):
        self.label, self.children, self.terminal = label, {}, terminal


def better(a: tuple, b: tuple) -> tuple:
    """The merge of two terminals (code points, identifier, rows): most code points, then smallest identifier, null last."""
    first = min(a, b, key=lambda t: (-t[0], t[1] is None, t[1] if t[1] is not None else 0))
    return first[0], first[1], a[2] + b[2]


class Trie:
    """A compressed radix trie over byte strings whose subtrees, by first byte, can move to files."""

    def __init__(self, limit: int = TRIE_BYTES, merge=better):
        self.limit, self.merge = limit, merge
        self.roots: dict[int, _Node] = {}
        self.sizes: dict[int, int] = {}
        self.files: dict[int, object] = {}

    def insert(self, key: bytes, terminal: tuple) -> None:
        """``key`` must not be empty."""
        first = key[0]
        if first in self.files:
            pickle.dump((key, terminal), self.files[first])
            return
        node = self.roots.get(first)
        if node is None:
            self.roots[first] = _Node(key, terminal)
            self.sizes[first] = len(key) + 100
        else:
            self.sizes[first] += self._into(node, key, terminal)
        if sum(self.sizes.values()) > self.limit:
            self._move(max(self.sizes, key=self.sizes.get))

    def _into(self, node: _Node, key: bytes, terminal: tuple) -> int:
        """Inserts below a node whose first byte fits; returns the bytes added."""
        at = 0
        while True:
            label = node.label
            if key.startswith(label, at):
                at += len(label)
            else:
                n = _common(label, key[at:at + len(label)])
                lower = _Node(label[n:], node.terminal)
                lower.children = node.children
                node.label, node.children, node.terminal = label[:n], {label[n]: lower}, None
                at += n
            if at == len(key):
                node.terminal = terminal if node.terminal is None else self.merge(node.terminal, terminal)
                return 100
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], terminal)
                return len(key) - at + 100
            node = child

    def _move(self, first: int) -> None:
        out = tempfile.TemporaryFile()
        for entry in self._walk(self.roots.pop(first)):
            pickle.dump(entry, out)
        del self.sizes[first]
        self.files[first] = out

    @staticmethod
    def _walk(root: _Node) -> Iterator[tuple[bytes, tuple]]:
        stack = [(root, b"")]
        while stack:
            node, above = stack.pop()
            key = above + node.label
            if node.terminal is not None:
                yield key, node.terminal
            stack.extend((child, key) for child in node.children.values())

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All keys with their terminals; the trie is empty afterwards."""
        for first in list(self.roots):
            yield from self._walk(self.roots.pop(first))
        self.sizes.clear()
        for out in self.files.values():
            out.seek(0)
            root = None
            while True:
                try:
                    key, terminal = pickle.load(out)
                except EOFError:
                    break
                if root is None:
                    root = _Node(key, terminal)
                else:
                    self._into(root, key, terminal)
            out.close()
            yield from self._walk(root)
        self.files.clear()


def _key(digest: bytes, body: bytes) -> bytes:
    """Length and hash lead the inserted bytes, so a subtree is a range of owners' keys."""
    return digest[:1] + struct.pack(">Q", len(body)) + digest + body


def normalised(column: pa.Array) -> list[bytes]:
    return [x.translate(None, WHITE) for x in column.fill_null("").cast(pa.binary()).to_pylist()]


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    entry = f"length long, digest binary, body binary, chars long, id {kind}, n long"

    def own(batches):
        trie, ids = Trie(TRIE_BYTES // 2), pa.null()
        for batch in batches:
            ids = batch.column("id").type
            column = batch.column("text")
            chars = pc.utf8_length(column.fill_null("")).to_pylist()
            for body, n, at in zip(normalised(column), chars, batch.column("id").to_pylist()):
                trie.insert(_key(hashlib.sha256(body).digest(), body), (n, at, 1))
        yield from _entries(trie, ids, True)

    def owners(batches):
        trie, ids = Trie(), pa.null()
        for batch in batches:
            ids = batch.column("id").type
            columns = [batch.column(c).to_pylist() for c in ("digest", "body", "chars", "id", "n")]
            for digest, body, chars, at, n in zip(*columns):
                trie.insert(_key(digest, body), (chars, at, n))
        yield from _entries(trie, ids, False)

    def digests(batches):
        for batch in batches:
            bodies = normalised(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())],
                names=["id", "length", "digest"],
            )

    groups = rows.mapInArrow(own, entry).repartition("length", "digest").mapInArrow(owners, f"length long, digest binary, keep_id {kind}, group_size long")
    signed = rows.mapInArrow(digests, f"id {kind}, length long, digest binary")
    return signed.join(groups, ["length", "digest"]).select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _entries(trie: Trie, ids: pa.DataType, whole: bool) -> Iterator[pa.RecordBatch]:
    """The trie's entries in batches of some megabytes, with the bytes of the text or, checked to be one a key, without."""
    held, size, seen = [], 0, set()

    def batch():
        columns = list(zip(*held))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())]
        if whole:
            arrays.append(pa.array(columns[2], pa.binary()))
            arrays.append(pa.array(columns[3], pa.int64()))
        arrays += [pa.array(columns[4], ids), pa.array(columns[5], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["length", "digest", "body", "chars", "id", "n"] if whole else ["length", "digest", "keep_id", "group_size"])

    last = None
    for key, (chars, at, n) in trie.items():
        length, digest = struct.unpack(">Q", key[1:9])[0], key[9:41]
        if not whole:
            if (length, digest) == last or (length, digest) in seen:
                raise ValueError(f"two texts of {length} bytes share the SHA-256 {digest.hex()}")
            seen.add((length, digest))
        held.append((length, digest, key[41:] if whole else None, chars, at, n))
        size += len(key) if whole else 64
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def survivors(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, one a group of equal texts.

    Rows are told apart by identifier and text hash, so distinct texts under a null or shared identifier all stay. Of rows
    equal in both, the one with most code points stays.
    """

    sha, own, none, whole = (fresh(name, docs.columns) for name in ("_sha", "_id", "_none", "_row"))

    def sign(batches):
        for batch in batches:
            signs = pa.array([hashlib.sha256(b).digest() for b in normalised(batch.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, signs], names=[*batch.schema.names, sha])

    by = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias(own), F.col(key).isNull().alias(none), sha]
    signed = docs.mapInArrow(sign, StructType([*docs.schema.fields, StructField(sha, BinaryType())]))
    longest = F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(text))
    # repeated rows leave their task once, and the join keeps the partitions of the grouping
    rows = signed.groupBy(*by).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), longest).alias(whole))
    kept = decided.where("kept").withColumn(sha, F.unhex("text_sha256")).select(*by).distinct()
    return rows.join(kept, [own, none, sha], "left_semi").select(f"{whole}.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the equal document that stays."""
    return deduplicate(documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
QUERIES = {"op8_exact_dedup": (op8_exact_dedup, SQL)}
