"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that together cover all of it. Two recurrent layers read a
window from both ends; at every byte a softmax over both states gives the probabilities of the languages, so every byte of
a text is labelled; a text's probabilities are the mean over all its bytes. Its language is the likeliest one (the first in
alphabetical order of equals), the score is its probability. Texts that are null or have no letter are ``und`` with score 0.

Trained on at most ``PER_LANGUAGE`` texts of each language, chosen by hash of the key, of each ``WINDOWS`` windows spread over the
whole text. Without labelled texts every text is ``und``. Repeated rows are labelled alike; a text is taken whole, however long;
columns besides key and text are not looked at by a prediction.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.llm import text
from citeline.llm.common import documents, remainder
from citeline.operators.scans import top_per_group

HIDDEN, WINDOW, BATCH = 8, 128, 2048  # HIDDEN: least units a side
PER_LANGUAGE, WINDOWS, SPAN, STEPS = 200, 3, 48, 160  # training sample: rows of a language, windows of a row, bytes of a window; steps


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Per direction: input table (256, 3H) for update, reset and candidate, and recurrent weights (H, 3H)."""

    languages: list[str]
    table: np.ndarray  # (2, 256, 3H)
    recurrent: np.ndarray  # (2, H, 3H)
    out: np.ndarray  # (2H, C)
    bias: np.ndarray  # (C,)

    @property
    def hidden(self) -> int:
        return self.recurrent.shape[1]

    def states(self, window: np.ndarray, side: int, mask: np.ndarray | None = None, keep: bool = False):
        """States (T, B, H) of one direction; with ``keep`` also what the way back needs."""
        (steps, rows), hidden = window.shape, self.hidden
        h = np.zeros((rows, hidden), np.float32)
        out = np.zeros((steps, rows, hidden), np.float32)
        kept = []
        table, weights = self.table[side], self.recurrent[side]
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            x, u = table[window[t]], h @ weights
            gates = _sigmoid(x[:, :2 * hidden] + u[:, :2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            candidate = np.tanh(x[:, 2 * hidden:] + r * u[:, 2 * hidden:])
            after = h + z * (candidate - h)
            if mask is not None:
                after *= mask[t][:, None]  # bytes beyond the end leave the state at zero, also for the way from the right
            if keep:
                kept.append((t, h, z, r, candidate, u[:, 2 * hidden:]))
            out[t] = h = after
        return out, kept

    def probabilities(self, window: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(B, C): probabilities of the languages, summed over the bytes of each window (T, B)."""
        hidden = self.hidden
        ahead, _ = self.states(window, 0, mask)
        back, _ = self.states(window, 1, mask)
        total = np.zeros((window.shape[1], len(self.languages)), np.float32)
        for t in range(len(window)):
            score = ahead[t] @ self.out[:hidden] + back[t] @ self.out[hidden:] + self.bias
            np.exp(score - score.max(1, keepdims=True), out=score)
            score /= score.sum(1, keepdims=True)
            total += score if mask is None else score * mask[t][:, None]
        return total


def units(languages: int) -> int:
    """Units a side: more languages need more of them."""
    return max(HIDDEN, -(-languages // 4))


def fit(windows: np.ndarray, mask: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on the mean cross-entropy of all bytes; windows and mask are (N, T), labels are numbers of languages."""
    random = np.random.default_rng(seed)
    c = len(languages)
    hidden = units(c)
    net = Network(
        languages, random.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32), random.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(np.float32),
        random.normal(0, 0.3, (2 * hidden, c)).astype(np.float32), np.zeros(c, np.float32),
    )
    weights = [net.table, net.recurrent, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by = [np.flatnonzero(labels == k) for k in range(c)]
    for step in range(1, steps + 1):
        pick = np.concatenate([random.choice(b, max(1, 96 // c)) for b in by])  # as many of each language
        window, m, y = windows[pick].T, mask[pick].T.astype(np.float32), labels[pick]
        gradients = _gradients(net, window, m, y)
        rate = 0.03 * (1 - step / (steps + 1)) + 0.002
        for w, g, a, b in zip(weights, gradients, first, second):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def _gradients(net: Network, window: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    hidden = net.hidden
    both = [net.states(window, side, mask, keep=True) for side in (0, 1)]
    joined = np.concatenate([both[0][0], both[1][0]], 2)
    score = joined @ net.out + net.bias
    score = np.exp(score - score.max(2, keepdims=True))
    score /= score.sum(2, keepdims=True)
    score[:, np.arange(len(labels)), labels] -= 1
    score *= mask[:, :, None] / max(mask.sum(), 1)
    d_out, d_bias = np.einsum("tbh,tbc->hc", joined, score), score.sum((0, 1))
    d_states = score @ net.out.T
    d_table, d_recurrent = np.zeros_like(net.table), np.zeros_like(net.recurrent)
    for side in (0, 1):
        carry = np.zeros((window.shape[1], hidden), np.float32)
        for t, h, z, r, candidate, u in reversed(both[side][1]):
            d = (carry + d_states[t, :, side * hidden:(side + 1) * hidden]) * mask[t][:, None]
            d_candidate = d * z * (1 - candidate**2)
            d_z, d_r = d * (candidate - h) * z * (1 - z), d_candidate * u * r * (1 - r)
            np.add.at(d_table[side], window[t], np.concatenate([d_z, d_r, d_candidate], 1))
            inner = np.concatenate([d_z, d_r, d_candidate * r], 1)
            d_recurrent[side] += h.T @ inner
            carry = d * (1 - z) + inner @ net.recurrent[side].T
    return [d_table, d_recurrent, d_out.astype(np.float32), d_bias.astype(np.float32)]


def cut(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the windows that cover every row."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][row] + place * size, np.minimum(size, lengths[row] - place * size), row


def pooled(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, C): mean probabilities over all bytes of each row."""
    out = np.zeros((len(offsets) - 1, len(net.languages)))
    start, length, row = cut(raw, offsets, WINDOW)
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), BATCH):
        some = order[a:a + BATCH]
        n = int(length[some[0]])
        at = start[some] + np.arange(n)[:, None]
        inside = np.arange(n)[:, None] < length[some]
        window = raw[np.minimum(at, len(raw) - 1)]
        got = net.probabilities(window, None if inside.all() else inside.astype(np.float32))
        np.add.at(out, row[some], got)
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def train(docs: DataFrame, key: str = "doc_id", column: str = "text", lang: str = "lang") -> Network | None:
    """The network of all languages that a row with letters is labelled with; None without such rows.

    The sample is bounded in rows a language (``PER_LANGUAGE``, those of least hash, ties by their windows) and in bytes a row.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(column).rlike(r"\p{L}"))
    spans = [F.expr(f"substring(cast(`{column}` AS string), 1 + int({k} * greatest(0, length(`{column}`) - {SPAN}) / {max(1, WINDOWS - 1)}), {SPAN})") for k in range(WINDOWS)]
    sample = rows.select(F.col(lang).alias("lang"), F.xxhash64(key, F.lit(3)).alias("place"), F.array(*spans).alias("spans"))
    got = top_per_group(sample, ["lang"], [F.col("place"), F.col("spans")], PER_LANGUAGE).select("lang", "spans").collect()
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    pieces = [(s.encode()[:SPAN], languages.index(r.lang)) for r in sorted(got, key=lambda r: (r.lang, r.spans)) for s in r.spans if s]
    windows, mask = np.zeros((len(pieces), SPAN), np.uint8), np.zeros((len(pieces), SPAN), bool)
    for i, (s, _) in enumerate(pieces):
        windows[i, :len(s)], mask[i, :len(s)] = np.frombuffer(s, np.uint8), True
    return fit(windows, mask, np.array([y for _, y in pieces]), languages)


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, offsets = text.buffers(batch.column(column))
            lettered = batch.column("lettered").to_pylist()
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b in text.segments(offsets, 1 << 22):
                p = pooled(net, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                best[a:b], score[a:b] = p.argmax(1), np.clip(p.max(1), 0, 1)
            labels = [net.languages[k] if x else "und" for k, x in zip(best.tolist(), lettered)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(labels, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=[key, "lang_pred", "score"])

    if net is None:
        return docs.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    lettered = F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select(key, column, lettered).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows outside the held-out quarter."""
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 4) == 2
    return predict(docs, train(docs.where(~held))).withColumn("held_out", held)


QUERIES = {"op2_language_id": (op2_language_id, None)}
