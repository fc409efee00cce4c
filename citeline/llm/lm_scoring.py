"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Counting. Words become 64-bit hashes; their counts make the vocabulary, sharded by hash range, and a word's number is its
place in it. A bigram is the pair of numbers in one 64-bit key, mixed reversibly so that every shard of keys has its share
of any hot word. Tasks send each shard one sorted array of keys with counts; a shard merges them and writes its keys
and counts as files of the shared folder. From the merged keys it also sends partial context and continuation statistics,
which are summed by number range and written likewise.

Scoring. Workers map those files and look all bigrams of a block of texts up by binary search of sorted keys, so a worker
holds a block of texts and never the model.

P(w|u) = max(c(uw) - D(c), 0) / c(u) + g(u) P(w), g(u) = (D1 n1(u) + D2 n2(u) + D3 n3+(u)) / c(u); P(w) is of the same form
over continuation counts, interpolated with 1 / (V + 1): V words and one unknown word, which share all probability.
A text is its words and one end token; its first token has the start of a text as context. After an unknown word the lower
order is used. Null and empty texts are one end token. Rows are scored one by one: repeated rows and ties get equal scores.
With no training text every probability is 1. Words that differ and share a hash (2**-64 a pair) would count as one.
Numbers of words are packed in 32 bits each, so a vocabulary may have 4.2 billion words; more is an error.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from citeline.llm import shared, text
from citeline.llm.common import documents, remainder

BLOCK = 1 << 23  # bytes of text scored at once
KEYS = 1 << 22  # bigrams a task holds before it sends them
END = np.uint64(text.hash_of(b"\n"))  # no word holds a line feed
_32 = np.uint64(32)


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with an end after each row, first token of every row plus the end)."""
    hashes, firsts = [], [np.zeros(1, np.int64)]
    done = 0
    for a, b in text.segments(offsets):
        words, first = text.word_hashes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        hashes.append(np.insert(words, first[1:], END))
        rows = first[1:] + np.arange(1, b - a + 1) + done
        firsts.append(rows)
        done = int(rows[-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(firsts)


def _blocks(batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        raw, offsets = text.buffers(batch.column(column))
        for a, b in text.segments(offsets, BLOCK):
            yield batch.slice(a, b - a), *_tokens(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums.astype(np.int64)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in the least width that holds them; the width is told by the length."""
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _counts(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(blob) // n if n else 1]).astype(np.int64)


def _sharded(keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    bounds = np.searchsorted(shared.shard_of(keys, shards), np.arange(shards + 1))
    for s in range(shards):
        a, b = bounds[s], bounds[s + 1]
        if b > a:
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([s], pa.int32()), "keys": pa.array([keys[a:b].tobytes()], pa.binary()),
                "counts": pa.array([_small(counts[a:b]).tobytes()], pa.binary()),
            })


BLOBS = "shard int, keys binary, counts binary"
SUMMARY = "part string, shard int, n long, total long, types long, of1 long, of2 long, of3 long, of4 long"


SUMMARY_ARROW = pa.schema([("part", pa.string()), ("shard", pa.int32()), *((k, pa.int64()) for k in ("n", "total", "types", "of1", "of2", "of3", "of4"))])


def _summary(part: str, shard: int, counts: np.ndarray) -> dict:
    of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    return dict(zip(SUMMARY_ARROW.names, (part, shard, len(counts), int(counts.sum()), int((counts > 0).sum()), *of)))


class Numbers:
    """Places of keys in an array that is sharded by key range."""

    def __init__(self, folder: str, name: str, sizes: list[int]):
        self.folder, self.name, self.sizes = folder, name, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1 of ascending keys, shard bounds)."""
        bounds = np.searchsorted(shared.shard_of(keys, len(self.sizes)), np.arange(len(self.sizes) + 1))
        out = np.full(len(keys), -1, np.int64)
        for s, n in enumerate(self.sizes):
            a, b = bounds[s], bounds[s + 1]
            if n and b > a:
                place, found = shared.find(shared.mapped(self.folder, f"{self.name}-{s}", "u8"), keys[a:b])
                out[a:b] = np.where(found, place + self.starts[s], -1)
        return out, bounds

    def values(self, name: str, keys: np.ndarray) -> np.ndarray:
        """Values of ascending keys, all of which are known, in the array that lies beside the keys."""
        place = self.find(keys)[0]
        if (place < 0).any():
            raise KeyError(f"a key is not in {self.name}")
        return _spread(self.folder, name, "i8", self.starts, place)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(hashes, return_inverse=True)
        return self.find(distinct)[0][inverse]


def _spread(folder: str, name: str, kinds: str, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values of a sharded array at ascending places."""
    bounds, out = np.searchsorted(places, starts), np.zeros(len(places), np.int64)
    for s in range(len(starts) - 1):
        a, b = bounds[s], bounds[s + 1]
        if b > a:
            out[a:b] = shared.mapped(folder, f"{name}-{s}", kinds)[places[a:b] - starts[s]]
    return out


def _discounts(of: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more; each D within 0.1 and its count, half the count where a needed class is empty."""
    n1, n2, n3, n4 = of
    if min(n1, n2, n3) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.1), k) for k, x in enumerate(d, 1))])


class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    def __init__(self, folder: str, words: list[int], pairs: list[int], tokens: int, pair_classes: list[int], word_classes: list[int], types: int):
        self.folder, self.tokens, self.types = folder, tokens, types
        self.words, self.pairs = Numbers(folder, "word", words), Numbers(folder, "pair", pairs)
        self.vocabulary = int(sum(words))
        self.pair_d, self.word_d = _discounts(pair_classes), _discounts(word_classes)
        m = word_classes
        rest = self.vocabulary - m[0] - m[1]
        self.word_rest = float(self.word_d[1] * m[0] + self.word_d[2] * m[1] + self.word_d[3] * rest) / types if types else 1.0

    def score(self, hashes: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        rows, v = len(first) - 1, self.vocabulary
        distinct, inverse = np.unique(hashes, return_inverse=True)
        number = self.words.find(distinct)[0]
        known = number >= 0
        place = np.clip(number, 0, None)
        values = {}
        for name in ("count", "follows", "total", "of1", "of2", "of3"):
            got = np.zeros(len(distinct) + 1, np.int64)
            if known.any():
                order = np.flatnonzero(known)
                got[order] = _spread(self.folder, name, "i8", self._ranges(), place[order])
            if name in ("total", "of1", "of2", "of3"):
                got[-1] = _spread(self.folder, name, "i8", self._ranges(), np.array([v]))[0]
            values[name] = got
        base = np.log10((values["count"][:-1] + 1) / (self.tokens + v + 1))
        d = self.word_d[np.clip(values["follows"], 0, 3)]
        lower = ((values["follows"] - d) / self.types if self.types else 0.0) * (values["follows"] > 0) + self.word_rest / (v + 1)
        total = values["total"]
        rest = (self.pair_d[1] * values["of1"] + self.pair_d[2] * values["of2"] + self.pair_d[3] * values["of3"]) / np.maximum(total, 1)
        rest[total == 0] = 1.0
        context = np.empty(len(inverse), np.int64)
        context[1:] = inverse[:-1]
        context[first[:-1]] = len(distinct)
        numbers = np.append(number, v)
        u, w = numbers[context], number[inverse]
        both = np.flatnonzero((u >= 0) & (w >= 0))
        key = text.mix((u[both].astype(np.uint64) << _32) | w[both].astype(np.uint64))
        order = np.argsort(key)
        at, _ = self.pairs.find(key[order])
        seen = at >= 0
        times = np.zeros(len(inverse))
        times[both[order[seen]]] = _spread(self.folder, "times", "i8", self.pairs.starts, at[seen])
        p = (times - self.pair_d[np.clip(times, 0, 3).astype(np.int64)]) / np.maximum(total[context], 1) + rest[context] * lower[inverse]
        row = np.repeat(np.arange(rows), np.diff(first))
        return {
            "n_tokens": np.diff(first), "n_known": np.bincount(row, known[inverse], rows).astype(np.int64),
            "base_score": np.bincount(row, base[inverse], rows), "score": np.bincount(row, np.log10(p), rows),
        }

    def _ranges(self) -> np.ndarray:
        shards = len(self.words.sizes)
        return np.array([(self.vocabulary + 1) * s // shards for s in range(shards + 1)], np.int64)


def train(texts: DataFrame, column: str = "text", shards: int | None = None) -> Model:
    """Counts the texts of a column. ``shards``: files an array is cut into; by default the number of shuffle partitions."""
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared.new_folder(spark, "lm")
    texts = texts.select(column)

    def count_words(batches):
        for _, hashes, _ in _blocks(batches, column):
            yield from _sharded(*_summed(hashes), shards)

    def merged(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        keys = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
        counts = [_counts(x, len(k)) for k, x in zip(keys, group.column("counts").to_pylist())]
        return group.column("shard")[0].as_py(), *_summed(np.concatenate(keys), np.concatenate(counts))

    def write_words(group: pa.Table) -> pa.Table:
        shard, keys, counts = merged(group)
        shared.write_array(folder, f"word-{shard}", keys)
        shared.write_array(folder, f"raw-{shard}", counts)
        return pa.Table.from_pylist([_summary("word", shard, counts)], schema=SUMMARY_ARROW)

    found = {r.shard: r for r in texts.mapInArrow(count_words, BLOBS).groupBy("shard").applyInArrow(write_words, SUMMARY).collect()}
    sizes = [found[s].n if s in found else 0 for s in range(shards)]
    tokens, v = sum(r.total for r in found.values()), sum(sizes)
    if v >= 2**32 - 1:
        raise ValueError("more than 2**32 - 2 distinct words")
    words = Numbers(folder, "word", sizes)
    ranges = np.array([(v + 1) * s // shards for s in range(shards + 1)], np.int64)

    def count_pairs(batches):
        held, n = [], 0
        for _, hashes, first in _blocks(batches, column):
            w = words.of(hashes).astype(np.uint64)
            u = np.empty_like(w)
            u[1:] = w[:-1]
            u[first[:-1]] = v
            held.append(text.mix((u << _32) | w))
            n += len(w)
            if n >= KEYS:
                yield from _sharded(*_summed(np.concatenate(held)), shards)
                held, n = [], 0
        if held:
            yield from _sharded(*_summed(np.concatenate(held)), shards)

    def statistics(kind: int, places: np.ndarray, columns: list[np.ndarray]) -> Iterator[dict]:
        bounds = np.searchsorted(places, ranges)
        for s in range(shards):
            a, b = bounds[s], bounds[s + 1]
            if b > a:
                blob = [_small(c[a:b]) for c in columns]
                yield {"part": "", "range": s, "kind": kind, "places": (places[a:b] - ranges[s]).astype(np.uint32).tobytes(), "widths": [x.itemsize for x in blob], "values": [x.tobytes() for x in blob]} | dict.fromkeys(("shard", "n", "of1", "of2", "of3", "of4"), 0)

    partial = "part string, range int, kind int, places binary, widths array<int>, values array<binary>, shard int, n long, of1 long, of2 long, of3 long, of4 long"
    partial_arrow = pa.schema([("part", pa.string()), ("range", pa.int32()), ("kind", pa.int32()), ("places", pa.binary()), ("widths", pa.list_(pa.int32())), ("values", pa.list_(pa.binary())), ("shard", pa.int32()), *((k, pa.int64()) for k in ("n", "of1", "of2", "of3", "of4"))])

    def write_pairs(group: pa.Table) -> pa.Table:
        shard, keys, counts = merged(group)
        shared.write_array(folder, f"pair-{shard}", keys)
        shared.write_array(folder, f"times-{shard}", counts)
        pair = text.unmix(keys)
        u, w = (pair >> _32).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(u, kind="stable")
        u, counts_u = u[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        of = [np.add.reduceat((counts_u == k) if k < 3 else (counts_u >= 3), first, dtype=np.int64) for k in (1, 2, 3)]
        rows = list(statistics(0, u[first], [np.add.reduceat(counts_u, first), *of]))
        w, follows = np.unique(w, return_counts=True)
        rows += statistics(1, w, [follows.astype(np.int64)])
        s = _summary("pair", shard, counts)
        rows.append({"part": "pair", "range": -1 - shard, "kind": -1, "places": b"", "widths": [], "values": []} | {k: s[k] for k in ("shard", "n", "of1", "of2", "of3", "of4")})
        return pa.Table.from_pylist(rows, schema=partial_arrow)

    def write_statistics(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        at = rows[0]["range"]
        if at < 0:
            return pa.Table.from_pylist([{"part": "pair", "shard": r["shard"], "n": r["n"], "total": 0, "types": 0} | {f"of{k}": r[f"of{k}"] for k in (1, 2, 3, 4)} for r in rows], schema=SUMMARY_ARROW)
        n = int(ranges[at + 1] - ranges[at])
        sums = np.zeros((5, n), np.int64)
        for r in rows:
            places = np.frombuffer(r["places"], np.uint32)
            for k, blob in enumerate(r["values"]):
                sums[k if r["kind"] == 0 else 4][places] += _counts(blob, len(places))
        for name, values in zip(("total", "of1", "of2", "of3", "follows"), sums):
            shared.write_array(folder, f"{name}-{at}", values)
        return pa.Table.from_pylist([_summary("follows", at, sums[4])], schema=SUMMARY_ARROW)

    got = (
        texts.mapInArrow(count_pairs, BLOBS).groupBy("shard").applyInArrow(write_pairs, partial)
        .groupBy("range").applyInArrow(write_statistics, SUMMARY).collect()
    )
    pairs, follows = {r.shard: r for r in got if r.part == "pair"}, {r.shard: r for r in got if r.part == "follows"}
    for s in set(range(shards)) - set(follows):  # ranges without any word
        for name in ("total", "of1", "of2", "of3", "follows"):
            shared.write_array(folder, f"{name}-{s}", np.zeros(int(ranges[s + 1] - ranges[s]), np.int64))
    total = lambda rows, k: [sum(r[f"of{i}"] for r in rows.values()) for i in k]
    _place_counts(spark, folder, sizes, ranges)
    return Model(folder, sizes, [pairs[s].n if s in pairs else 0 for s in range(shards)], tokens, total(pairs, (1, 2, 3, 4)), total(follows, (1, 2, 3, 4)), sum(r.total for r in follows.values()))


def _place_counts(spark: SparkSession, folder: str, sizes: list[int], ranges: np.ndarray) -> None:
    """Cuts the counts, which lie by hash shard, at the ranges of the other statistics; the start of texts has none."""
    starts, shards = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), len(sizes)

    def cut(batches):
        for batch in batches:
            for s in batch.column("s").to_pylist():
                a, b = int(ranges[s]), int(ranges[s + 1])
                parts = [shared.mapped(folder, f"raw-{k}", "i8")[max(a - starts[k], 0):max(b - starts[k], 0)] for k in range(shards) if sizes[k] and starts[k] < b and starts[k + 1] > a]
                values = np.concatenate([*parts, np.zeros(0, np.int64)])
                shared.write_array(folder, f"count-{s}", np.concatenate([values, np.zeros(b - a - len(values), np.int64)]))
            yield batch

    spark.range(0, shards, 1, min(shards, 200)).selectExpr("int(id) s").mapInArrow(cut, "s int").collect()


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; see the module's text for the model."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch, hashes, first in _blocks(batches, column):
            got = model.score(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(batch.num_rows, model.tokens)), pa.array(got["base_score"]), pa.array(got["score"])],
                names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select(key, column).mapInArrow(run, f"`{key}` {kind}, {SCORES}")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those whose crc32(doc_id) leaves no remainder of 2 by 7."""
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 7) == 2
    model = train(docs.where(~held))
    return score(docs, model).withColumn("held_out", held)


QUERIES = {"op1_lm_scoring": (op1_lm_scoring, None)}
