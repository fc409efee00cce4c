"""Toxicity: a weighted finite-state grammar over clauses.

Tokens are maximal runs of letters (ASCII, lower-cased, and all bytes from 0x80 on); punctuation and line ends part clauses.
A token is an insult, a threat, a target, a negation, a verb of reported speech or other. Four transducers run over a clause
and are composed into one machine: target (was anyone addressed), negation (the next ``SCOPE`` tokens are negated), report (the
rest of the clause is what someone said) and the emitter, which for every insult or threat puts out what it was seen
under. The score of a text is a logistic function of the weights of its matched clauses by kind; the weight of a kind is
learned, so a negated or reported insult counts as much as the labels say.

Learned from at most ``SAMPLE`` labelled rows (chosen by hash of the key): the insult lexicon of words and stems that toxic texts hold
far more often, at most ``LEXICON`` entries, with their log odds, and the weights of kinds. Threats, targets, negations and
verbs of speech are fixed lists. Null and empty texts match nothing and get the score of such texts; without labels the score is 0.
Repeated rows score alike; columns besides key, text and the labels' key and mark are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.llm import text
from citeline.llm.common import ascii_lower, documents, remainder

SAMPLE, LEXICON, SCOPE = 20_000, 2_000, 3
STEMS = (4, 5, 6, 7)  # lengths of stems in characters
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
KINDS = ("plain", "targeted", "negated", "reported", "threat")
LISTS = {
    THREAT: "kill murder hurt destroy stab shoot strangle beat tuer frapper détruire töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours u he she they him her them tu toi vous votre du dich dir ihr euch usted ustedes tú te vosotros",
    NEGATION: "not no never isn aren don doesn cannot ne pas jamais nicht kein keine nie nunca ni jamás",
    REPORT: "said says say called wrote quoted claimed told dit disait écrit sagte sagt schrieb dijo dice escribió",
}


class Transducer:
    """Deterministic, with an output on every move; a symbol without a move keeps the state and puts out the state's mark."""

    def __init__(self, start, moves: dict, mark):
        self.start, self.moves, self.mark = start, moves, mark

    def step(self, state, symbol):
        after = self.moves.get((state, symbol), state)
        return after, self.mark(state, symbol)


def compose(machines: list[Transducer], symbols: int) -> tuple[list[list[int]], list[list[tuple]]]:
    """(next state, outputs) tables of the reachable product; state 0 is the start."""
    start = tuple(m.start for m in machines)
    number, todo, moves, outputs = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        row, out = [], []
        for symbol in range(symbols):
            stepped = [m.step(s, symbol) for m, s in zip(machines, state)]
            after = tuple(s for s, _ in stepped)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
            out.append(tuple(o for _, o in stepped))
        moves.append(row)
        outputs.append(out)
    return moves, outputs


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """(next state, kind or -1) by state and symbol."""
    flag = lambda s, _: s
    target = Transducer(0, {(0, TARGET): 1}, flag)
    report = Transducer(0, {(0, REPORT): 1}, flag)
    fades = {(n, symbol): max(n - 1, 0) for n in range(SCOPE + 1) for symbol in range(6)}
    negation = Transducer(0, fades | {(n, NEGATION): SCOPE for n in range(SCOPE + 1)}, lambda s, _: s > 0)
    emitter = Transducer(0, {}, lambda _, symbol: symbol)
    moves, outputs = compose([target, report, negation, emitter], 6)

    def kind(out) -> int:
        addressed, said, negated, symbol = out
        if symbol not in (INSULT, THREAT):
            return -1
        if said or negated:
            return 3 if said else 2
        if symbol == THREAT:
            return 4 if addressed else -1
        return 1 if addressed else 0

    return moves, [[kind(o) for o in row] for row in outputs]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\r()[]{}|\""]] = True


@dataclass
class Lexicon:
    """Insult words and stems with their weights, as sorted hashes."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self):
        table = {text.hash_of(w.encode()): (INSULT, v) for w, v in self.words.items()}
        for symbol, some in LISTS.items():
            for w in some.split():
                table.setdefault(text.hash_of(w.encode()), (symbol, 1.0))
        self.keys = np.array(sorted(table), np.uint64)
        self.symbols = np.array([table[k][0] for k in self.keys.tolist()], np.int8)
        self.values = np.array([table[k][1] for k in self.keys.tolist()])
        by: dict[int, dict[int, float]] = {}
        for s, v in self.stems.items():
            by.setdefault(len(s.encode()), {})[text.hash_of(s.encode())] = v
        self.by_length = {n: (np.array(sorted(t), np.uint64), np.array([t[k] for k in sorted(t)])) for n, t in by.items()}

    def classes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, weight) of every token."""
        symbol, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        if not len(starts):
            return symbol, weight
        hasher = text.Hasher(raw)
        for n, (keys, values) in self.by_length.items():
            long = np.flatnonzero(ends - starts >= n)
            h = hasher.spans(starts[long], starts[long] + n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            symbol[long[hit]] = INSULT
            weight[long[hit]] = np.maximum(weight[long[hit]], values[at[hit]])
        h = hasher.spans(starts, ends)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = (self.keys[at] == h) & ((symbol != INSULT) | (self.values[at] > weight))
        symbol[hit], weight[hit] = self.symbols[at[hit]], self.values[at[hit]]
        return symbol, weight


MOVES, KIND = grammar()


def features(batch: pa.RecordBatch, column: str, lexicon: Lexicon) -> np.ndarray:
    """Weights of matched clauses by row and kind."""
    raw, offsets = text.buffers(batch.column(column))
    out = np.zeros((batch.num_rows, len(KINDS)))
    for a, b in text.segments(offsets):
        part = text.lowered(raw[offsets[a]:offsets[b]])
        at = offsets[a:b + 1] - offsets[a]
        starts, ends = text.runs(_LETTER[part], at)
        symbol, weight = lexicon.classes(part, starts, ends)
        hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(hits):
            continue
        row = np.searchsorted(at, starts, side="right") - 1
        breaks = np.concatenate([[0], np.cumsum(_BREAK[part])])
        clause = breaks[starts] + row
        for c in np.unique(clause[hits]).tolist():
            x, y = np.searchsorted(clause, [c, c + 1])
            state, best = 0, {}
            for s, w in zip(symbol[x:y].tolist(), weight[x:y].tolist()):
                kind = KIND[state][s]
                if kind >= 0:
                    best[kind] = best.get(kind, 0.0) + w
                state = MOVES[state][s]
            for kind, w in best.items():
                out[a + row[x], kind] += w
    return np.log1p(out)


def _parts(column: str = "text") -> Column:
    """Distinct words and stems of a text."""
    words = F.array_distinct(F.split(ascii_lower(F.coalesce(F.col(column), F.lit(""))), r"[^a-z\x{80}-\x{10FFFF}]+"))

    def stems(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 2), *map(stems, STEMS)))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that are not negative, by damped Newton steps with a weak ridge."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1], 0.1), 1e-3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-6)
        w = w - 0.7 * np.linalg.solve(hessian, gradient)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    keys = docs.select(F.col(key).alias("id")).where("id is not null").distinct()
    marks = marks.join(keys, "id", "left_semi")
    total = marks.count()
    if not total:
        return Model(Lexicon({}, {}), np.zeros(len(KINDS)), -30.0)
    # the hash picks sample / total of the labels; the limit holds what is broadcast to the sample's bound in any case
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / total)) + 1).limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(column).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.dropDuplicates(["text"]).persist()
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    often = max(3, positive // 50)
    in_toxic = rows.where("y = 1").select(F.explode(_parts()).alias("part")).groupBy("part").agg(F.count("*").alias("p")).where(F.col("p") >= often)
    candidates = {r.part: r.p for r in in_toxic.orderBy(F.desc("p"), "part").limit(20 * LEXICON).collect()}
    some = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in candidates], "part string"))
    in_clean = {r.part: r.n for r in rows.where("y = 0").select(F.explode(_parts()).alias("part")).join(some, "part").groupBy("part").agg(F.count("*").alias("n")).collect()}
    odds = {k: np.log((p + 0.5) / (positive + 1)) - np.log((in_clean.get(k, 0) + 0.5) / (negative + 1)) for k, p in candidates.items() if p >= 9 * in_clean.get(k, 0)}
    # a stem must hold clearly more texts than any one word that begins with it
    words = [k for k in odds if k[-1] != "*"]
    covered = {w[:n] + "*": max(candidates[v] for v in words if v.startswith(w[:n])) for w in words for n in STEMS if len(w) > n}
    odds = {k: v for k, v in odds.items() if k[-1] != "*" or candidates[k] > 1.2 * covered.get(k, 0)}
    best = sorted((k for k in odds if odds[k] > 1.5), key=lambda k: (-odds[k], k))[:LEXICON]
    lexicon = Lexicon({k: float(odds[k]) for k in best if k[-1] != "*"}, {k[:-1]: float(odds[k]) for k in best if k[-1] == "*"})

    def measured(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = features(batch, "text", lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    seen = rows.select("y", "text").mapInArrow(measured, "y int, x array<double>").collect()
    rows.unpersist()
    weights, bias = _logistic(np.array([r.x for r in seen]), np.array([r.y for r in seen], float))
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", column: str = "text", limit: float = 0.3) -> DataFrame:
    """(key, score, predicted) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p = model.score(features(batch, column, model.lexicon))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(p), pa.array((p >= limit).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(key, column).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def clean(docs: DataFrame, model: Model, column: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows that are not predicted to be toxic, with their columns; each row is decided by its own text."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch, column, model.lexicon)) < limit))

    return docs.mapInArrow(run, docs.schema)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs.where(remainder("doc_id", 4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the grammar learned from the labelled rows outside the held-out quarter."""
    docs = documents(spark, sf_dir)
    return score(docs, trained(spark, docs, sf_dir)).withColumn("held_out", remainder("doc_id", 4) == 2)


QUERIES = {"op4_toxicity": (op4_toxicity, None)}
