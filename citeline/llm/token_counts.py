"""Token counts: pieces are counted once per distinct pre-token and looked up for every text.

A pre-token is a run of marks of white space with the word after it: the model's pieces hold such marks only at their
start, so no merge crosses from a word to the next mark, and a text has as many tokens as its pre-tokens. This is checked
against the model when it is loaded. The library puts one mark before a text, so a pre-token's count is the library's own
count of the pre-token without its first mark.

The distinct pre-tokens of all texts are gathered by hash shard, each task sending a shard its own distinct ones; a shard
has the library count each once and writes hashes and counts as sorted arrays in the shared folder. A second pass over the
texts joins the frequencies of every text's pre-tokens to those arrays, mapped into memory, and sums; no token id is kept.
A shard fails the job if two pre-tokens share a hash, so the lookup is exact. Null and empty texts have no token; repeated
rows are counted alike; columns besides key and text are not looked at. Texts are taken whole, however long.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from citeline.llm import shared, text
from citeline.llm.common import documents
from citeline.llm.lm_scoring import Numbers

MARK = "▁"
BLOCK = 1 << 22
DISTINCT = 1 << 24  # bytes of distinct pre-tokens a task holds before it sends them


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("the model has pieces with white space after a letter: its texts have no pre-tokens")
    if model.encode("a", out_type=str) != [MARK + "a"] or model.encode("  a", out_type=str) == model.encode("a", out_type=str):
        raise ValueError("the model must put a mark before a text and keep white space")
    return model


def _spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, their row starts, starts, ends, first span of every row): every row has one space put before it.

    A mark itself (three bytes) counts as a space, as it does for the library.
    """
    marks = np.zeros(0, np.int64)
    if len(raw) > 2:
        marks = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
    if len(marks):
        raw, keep = raw.copy(), np.ones(len(raw), bool)
        raw[marks] = 0x20
        keep[marks + 1] = keep[marks + 2] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        raw, offsets = raw[keep], offsets - gone[offsets]
    filled = np.diff(offsets) > 0
    raw = np.insert(raw, offsets[:-1][filled], 0x20)
    at = offsets + np.concatenate([[0], np.cumsum(filled)])
    space = raw == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[at[:-1][filled]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(raw))
    return raw, at, starts, ends, np.searchsorted(starts, at)


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", column: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; ``model`` is the path of a sentencepiece model on every worker."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared.new_folder(spark, "pieces")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, column)

    def send(held: dict[int, bytes]):
        keys = np.fromiter(held, np.uint64, len(held))
        order = np.argsort(keys)
        words = list(held.values())
        bounds = np.searchsorted(shared.shard_of(keys[order], shards), np.arange(shards + 1))
        for s in range(shards):
            mine = order[bounds[s]:bounds[s + 1]]
            if len(mine):
                texts = [words[i] for i in mine]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([s], pa.int32()), "lengths": pa.array([np.array([len(w) for w in texts], np.uint32).tobytes()], pa.binary()),
                    "words": pa.array([b"".join(texts)], pa.binary()),
                })

    def distinct(batches):
        held, size = {}, 0
        for batch in batches:
            raw, offsets = text.buffers(batch.column(column))
            for a, b in text.segments(offsets, BLOCK):
                part, at, starts, ends, _ = _spans(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                for x, y in text.segments(np.append(starts, len(part)), text.SEGMENT):
                    base = starts[x]
                    hashes = text.Hasher(part[base:ends[y - 1]]).spans(starts[x:y] - base, ends[x:y] - base)
                    some, index = np.unique(hashes, return_index=True)
                    buffer = part[base:ends[y - 1]].tobytes()
                    for h, i in zip(some.tolist(), index.tolist()):
                        if h not in held:
                            held[h] = word = buffer[starts[x + i] - base:ends[x + i] - base]
                            size += len(word) + 100
                if size > DISTINCT:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    def pieces(group: pa.Table) -> pa.Table:
        """One row of one shard: the texts of its pre-tokens are merged by their bytes, each is counted once."""
        shard, words = group.column("shard")[0].as_py(), set()
        for lengths, joined in zip(group.column("lengths").to_pylist(), group.column("words").to_pylist()):
            ends = np.cumsum(np.frombuffer(lengths, np.uint32).astype(np.int64)).tolist()
            words.update(joined[a:b] for a, b in zip([0, *ends], ends))
        words = list(words)
        hashes = np.concatenate([text.Hasher(np.frombuffer(b"".join(words[a:a + 4096]), np.uint8)).spans(*_bounds(words[a:a + 4096])) for a in range(0, len(words), 4096)])
        order = np.argsort(hashes)
        hashes = hashes[order]
        if (hashes[1:] == hashes[:-1]).any():
            raise ValueError("two pre-tokens share a hash")
        library, counts = processor(model), np.zeros(len(words), np.int64)
        for a in range(0, len(words), 4096):
            some = [words[i].decode() for i in order[a:a + 4096]]
            counts[a:a + 4096] = [len(x) if w != " " else 1 for x, w in zip(library.encode([w[1:] for w in some], num_threads=1), some)]
        shared.write_array(folder, f"word-{shard}", hashes)
        shared.write_array(folder, f"count-{shard}", counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(words)], pa.int64())})

    blobs = "shard int, lengths binary, words binary"
    found = {r.shard: r.n for r in rows.mapInArrow(distinct, blobs).groupBy("shard").applyInArrow(pieces, "shard int, n long").collect()}
    numbers = Numbers(folder, "word", [found.get(s, 0) for s in range(shards)])

    def total(batches):
        for batch in batches:
            texts = batch.column(column)
            raw, offsets = text.buffers(texts)
            sums = [np.zeros(0, np.int64)]
            for a, b in text.segments(offsets, BLOCK):
                part, at, starts, ends, first = _spans(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                hashes = [np.zeros(0, np.uint64)]
                for x, y in text.segments(np.append(starts, len(part)), text.SEGMENT):
                    base = starts[x]
                    hashes.append(text.Hasher(part[base:ends[y - 1]]).spans(starts[x:y] - base, ends[x:y] - base))
                distinct_, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
                counts = numbers.values("count", distinct_)[inverse]
                sums.append(np.diff(np.concatenate([[0], np.cumsum(counts)])[first]))
            n = np.concatenate(sums)
            size = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(total, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words])
    return np.concatenate([[0], ends[:-1]]), ends


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document for piece_bpe_32k.model."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_token_counts": (op10_token_counts, None)}
