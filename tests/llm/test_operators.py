"""Each operator against a plain reading of its definition on small tables, and on awkward ones."""
import base64
import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeline.llm import (
    chat_format, decontamination, exact_dedup, jaccard_join, language_id, lm_scoring, packing, text, token_counts, toxicity, warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return WORD.findall(low(s))


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with copies, near copies, nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rnd = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)] + ["Über", "été", "A,", "b.\nC"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 30, 60]))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 60):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, "\t".join(w) + rnd.choice(["", " ", "\n"])))
    rows += [(60, None), (61, ""), (62, " \n"), (63, "w1 " * 9000), (64, "x" * 30000), (7, base[7]), (None, base[3]), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "n", "key", "shard", "hits", "w", "score", "kept", "component", "body", "item"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3), rows


def empty(corpus):
    return corpus[0].where("false")


def by_id(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_hashes_and_spans():
    keys = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    assert (text.unmix(text.mix(keys)) == keys).all()
    import pyarrow as pa

    raw, offsets = text.buffers(pa.array(["Ab c", None, "", "  ", "c\tab"]))
    hashes, first = text.word_hashes(raw, offsets)
    assert first.tolist() == [0, 2, 2, 2, 2, 4] and hashes[0] == hashes[3] == text.hash_of(b"ab") and hashes[1] == hashes[2]


def kneser_ney(train):
    """P(word, context) by the definition; None is the start, '\\n' the end."""
    pairs, count = collections.Counter(), collections.Counter()
    for t in train:
        tokens = words(t) + ["\n"]
        count.update(tokens)
        pairs.update(zip([None, *tokens[:-1]], tokens))
    follows = collections.Counter(w for _, w in pairs)
    pick = lambda of: [sum(c == k for c in of.values()) for k in (1, 2, 3, 4)]
    big, small = lm_scoring._discounts(pick(pairs)), lm_scoring._discounts(pick(follows))
    types, v = len(pairs), len(count)

    def lower(w):
        rest = sum(small[min(c, 3)] for c in follows.values()) / types if types else 1.0
        return (max(follows[w] - small[min(follows[w], 3)], 0) / types if types else 0) + rest / (v + 1)

    def p(w, u):
        total = sum(c for (x, _), c in pairs.items() if x == u)
        if not total:
            return lower(w)
        rest = sum(big[min(c, 3)] for (x, _), c in pairs.items() if x == u) / total
        c = pairs[u, w]
        return max(c - big[min(c, 3)], 0) / total + rest * lower(w)

    return p, count


def test_lm_scoring(corpus):
    frame, rows = corpus
    train = [t for i, t in rows if i is not None and i % 3]
    model = lm_scoring.train(frame.where("doc_id % 3 <> 0"), shards=3)
    p, count = kneser_ney(train)
    assert abs(sum(p(w, "w1") for w in count) + p("never seen", "w1") - 1) < 1e-9
    got = {r.doc_id: r for r in lm_scoring.score(frame, model).collect()}
    for i, t in [x for x in rows if x[0] is not None and x[0] < 62]:
        tokens = words(t) + ["\n"]
        want = sum(math.log10(p(w, u)) for u, w in zip([None, *tokens[:-1]], tokens))
        n, v = sum(count.values()), len(count)
        assert got[i].score == pytest.approx(want, rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
    assert lm_scoring.score(frame, lm_scoring.train(empty(corpus))).where("score <> 0").count() == 0
    assert lm_scoring.score(empty(corpus), model).count() == 0


def test_language_gradient_and_accuracy(spark, corpus):
    rnd = np.random.default_rng(2)
    windows, mask, labels = rnd.integers(97, 103, (6, 9)).astype(np.uint8), np.ones((6, 9), bool), np.array([0, 1, 2, 0, 1, 2])
    mask[3, 5:] = False
    net = language_id.fit(windows, mask, labels, ["a", "b", "c"], steps=2)
    for part in ("table", "recurrent", "out", "bias"):
        setattr(net, part, getattr(net, part).astype(np.float64))

    def loss():
        p = 0.0
        joined = np.concatenate([net.states(windows.T, s, mask.T.astype(float))[0].astype(float) for s in (0, 1)], 2)
        score = joined @ net.out + net.bias
        score -= np.log(np.exp(score).sum(2, keepdims=True))
        for b, y in enumerate(labels):
            p -= (score[:, b, y] * mask[b]).sum()
        return p / mask.sum()

    gradients = language_id._gradients(net, windows.T, mask.T.astype(float), labels)
    for part, gradient in zip(("table", "recurrent", "out", "bias"), gradients):
        values = getattr(net, part)
        for at in [np.unravel_index(k, values.shape) for k in np.argsort(-np.abs(gradient).ravel())[:3]]:
            keep = values[at]
            values[at] = keep + 1e-2
            up = loss()
            values[at] = keep - 1e-2
            down = loss()
            values[at] = keep
            assert (up - down) / 2e-2 == pytest.approx(gradient[at], rel=0.08, abs=2e-4)
    rows = [(i, "aba cab bac " * (1 + i % 7) if i % 2 else "xyz zzy yxx " * (1 + i % 7), "l1" if i % 2 else "l2") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(frame.where("doc_id < 60"))
    got = {r.doc_id: r for r in language_id.predict(frame, net).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ;"), (None, "aba" * 20000)], "doc_id long, text string")
    assert by_id(language_id.predict(odd, net), "doc_id", "lang_pred")[:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert language_id.train(frame.where("false")) is None and language_id.predict(odd, None).count() == 4


def test_packing(corpus):
    frame, rows = corpus
    for seed in range(6):
        rnd = random.Random(seed)
        lengths = sorted(rnd.sample(range(1, 50), 8))
        counts = [rnd.randint(1, 9) for _ in lengths]
        edges, padding = packing.boundaries(lengths, counts, [a * b for a, b in zip(lengths, counts)], 3)
        best = min(
            sum(n * (next(e for e in cut if e >= x) - x) for x, n in zip(lengths, counts))
            for cut in (sorted({*c, lengths[-1]}) for k in range(3) for c in itertools.combinations(lengths, k))
        )
        assert padding == best == sum(n * (next(e for e in edges if e >= x) - x) for x, n in zip(lengths, counts))
    got = packing.pack(frame, buckets=4, budget=200).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(words(t))) for i, t in rows)
    batches = collections.defaultdict(list)
    for r in got:
        batches[r.batch_id].append(r)
    for some in batches.values():
        assert len({r.padded_tokens for r in some}) == 1 and sorted(r.batch_row for r in some) == list(range(len(some)))
        assert all(r.n_tokens <= r.padded_tokens for r in some) and (len(some) == 1 or len(some) * some[0].padded_tokens <= 200 or some[0].padded_tokens == 0)
    assert packing.pack(empty(corpus)).count() == 0


def test_toxicity(spark, corpus):
    moves, kinds = toxicity.grammar()

    def run(symbols):
        state, out = 0, []
        for s in symbols:
            out.append(kinds[state][s])
            state = moves[state][s]
        return [k for k in out if k >= 0]

    I, H, T, N, R, O = toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER  # noqa: E741
    assert [run(x) for x in ([I], [T, I], [N, O, I], [N, O, O, O, I], [R, O, T, I], [T, H], [H], [N, H])] == [[0], [1], [2], [0], [3], [4], [], [2]]
    rnd = random.Random(1)
    plain = ["lorem", "ipsum", "dolor", "amet", "elit", "sed"]
    bad = ["grobnik", "snarfo", "snarfi", "snarfu"]
    rows = [(i, " ".join([rnd.choice(plain) for _ in range(20)] + ([rnd.choice(bad) + "!" for _ in range(3)] if i % 5 == 0 else []))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i in range(300))
    other = spark.createDataFrame([(1, "lorem snarfendo, ipsum"), (2, None), (3, ""), (4, "sed elit")], "doc_id long, text string")
    assert by_id(toxicity.score(other, model), "doc_id", "predicted") == [(1, 1), (2, 0), (3, 0), (4, 0)]
    assert toxicity.score(corpus[0], model).count() == len(corpus[1]) and toxicity.score(empty(corpus), model).count() == 0
    assert toxicity.score(frame, toxicity.train(frame, labels.where("false"))).where("predicted = 1").count() == 0


def test_chat_format(spark):
    rnd = random.Random(1)
    odd = [None, "", "\\", "<|end|>", "\\<s>[INST]\\\\ [/INST]<</SYS>>", "<<s>", "$1 \\1", "é😀 x", "<|says|>\n<|turn|>", "[[INST]<|a|><|b|>"]
    rows = [
        (c if c else None, t if rnd.random() < 0.9 else 0, rnd.choice(["user", "assistant", "system", "<|says|>", None]) if t else "system", rnd.choice([*odd, "a " * rnd.randint(0, 150)]))
        for c in range(12) for t in range(rnd.randint(1, 40))
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat_format.windows(frame, budget=300, history_tokens=40)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    later = windows.where("window > 1").collect()
    assert later and all(r.text.startswith("<|turn|>system<|says|>") for r in later if by[r.conv_id][0][1] == "system")
    assert {r.n_repeated for r in later} >= {1, 2} and all(r.n_repeated <= 3 for r in later)
    assert chat_format.read_back(chat_format.windows(frame.where("false"))).count() == 0


def test_warc(spark):
    rows = [(1, "u\r\n%", "same"), (5, "v", "same"), (3, None, "same"), (2, "w", None), (9, "x", ""), (4, "y", "é" * 200000), (5, "v", "same"), (None, "z", "own"), (None, "q", None)]
    pages = spark.createDataFrame(rows, "id long, url string, html string").select("id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).repartition(2)
    folder = warc.shared.new_folder(spark, "warc-test")
    index = warc.write(warc.roles(pages, 0), folder)
    got = {(r.id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index, folder).collect()}
    last = {"same": 5, "": 9}
    want = set()
    for i, u, h in rows:
        body = (h or "").encode()
        first = last.get(h or "", i)
        want.add((i, u, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    assert got == want and index.count() == len(rows)
    one = warc.read(index.where("id = 4"), folder).first()
    assert bytes(one.payload).decode() == "é" * 200000
    assert warc.read(index.where("false"), folder).count() == 0
    assert {r.record_type for r in warc.read(warc.write(warc.roles(pages, 5), f"{folder}-large"), f"{folder}-large").where("payload_bytes < 5").collect()} == {"response"}


def test_decontamination(spark, corpus):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, "  ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 6, 20, 33])))) for i in range(14)] + [(90, None), (91, ""), (92, "A b\tc d e f g h")]
    docs = [(500, None), (501, ""), (502, "a b c d e f g h"), (None, "A B C D e f g h")]
    for i in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        p = words(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 3)):
            if p:
                j = rnd.randrange(len(p))
                p[j:j + 1] = rnd.choice([["zz"], [], ["yy", p[j]]])
        j = rnd.randint(0, len(w))
        docs.append((i, " \n".join(w[:j] + p + w[j:])))
    count = lambda w, k: collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    want = {}
    for i, t in docs:
        w, want[i] = words(t), []
        for item, x in items:
            v = words(x)
            k = min(5, len(v))
            for s in range(max(len(w) - len(v), 0) + 1 if v else 0):
                a, b = count(w[s:s + len(v)], k), count(v, k)
                if sum((a & b).values()) * 100 >= 75 * sum((a | b).values()):
                    want[i].append(item)
                    break
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("w", F.lit(1))
    assert {r.doc_id: r["items"] for r in decontamination.find(frame, benchmark).collect()} == want
    assert {r.doc_id for r in decontamination.clean(frame, benchmark).collect()} == {i for i in want if not want[i]}
    assert decontamination.find(frame, benchmark.where("false")).where("contaminated").count() == 0
    assert decontamination.find(empty(corpus), benchmark).count() == 0


def test_decontamination_of_repeated_passages(spark):
    x, y, z, noise, rest = ([f"{c}{i}" for i in range(n)] for c, n in (("x", 40), ("y", 40), ("z", 40), ("n", 50), ("r", 200)))
    item, count = x + y + z, lambda w: collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    docs = [noise + z + y + z + y + x + rest, noise + z + y + x + rest, z + y + z + y + x, noise + z + y + z + y + rest]
    want = []
    for i, w in enumerate(docs):
        pairs = [(count(w[s:s + 120]), count(item)) for s in range(max(len(w) - 120, 0) + 1)]
        best = max(sum((a & b).values()) / sum((a | b).values()) for a, b in pairs)
        want.append((i, best >= 0.75, round(best if best >= 0.75 else 0.0, 9)))
    assert [w[1] for w in want] == [True, True, True, False] and round(want[0][2], 3) == 0.871
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    found = decontamination.find(frame, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.contaminated, round(r.similarity, 9)) for r in found) == want


def test_decontamination_broadcasts_in_proportion_to_the_items_and_holds_one_block(spark, monkeypatch):
    item = lambda seed, n: [f"v{(seed * 7919 + k * k * 31 + k) % 99991}" for k in range(n)]
    long, items = item(0, 1500), {i: item(i, 20) for i in range(1, 31)}
    docs = [(i, ["a", "b"] * i + items[i] + ["c"] * 9) for i in range(1, 20)] + [(50, items[3] + items[4]), (51, long[:1400] + item(77, 300)), (52, ["e"] * 40)]
    want = {i: [i] for i in range(1, 20)} | {50: [3, 4], 51: [99], 52: []}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in [*items.items(), (99, long)]], "item_id long, text string")
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: broadcast(sent.append(df) or df))
    assert {r.doc_id: r["items"] for r in decontamination.find(frame, benchmark).collect()} == want
    assert sent and max(df.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] for df in sent) < 1_500_000  # the texts have 12,000 bytes
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 700)
    several = decontamination.find(frame, benchmark)
    assert len(sent) > 6 and several._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert {r.doc_id: r["items"] for r in several.collect()} == want


def test_trie_moves_subtrees():
    rnd = random.Random(2)
    trie, want = exact_dedup.Trie(limit=3000), {}
    for i in range(800):
        key = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 9)))
        trie.insert(key, (len(key) % 3, i, 1))
        want[key] = exact_dedup.better(want[key], (len(key) % 3, i, 1)) if key in want else (len(key) % 3, i, 1)
    assert trie.files and dict(trie.items()) == want


def test_exact_dedup(corpus):
    frame, rows = corpus
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[body])[2]
        want.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    decided = exact_dedup.deduplicate(frame)
    assert by_id(decided, *decided.columns) == sorted(want, key=str)
    left = exact_dedup.survivors(frame, decided)
    assert left.columns == frame.columns and left.count() == len(groups)
    assert exact_dedup.deduplicate(empty(corpus)).count() == 0


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [4096, 3])
def test_jaccard_join(corpus, block, monkeypatch):
    frame, rows = corpus
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    want = components(rows)
    got = jaccard_join.join(frame).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len({c for _, c in want.values()}) < len(want) - 5
    assert block == 3 or jaccard_join.join(empty(corpus)).count() == 0


def test_jaccard_join_of_identifiers_with_several_texts(spark):
    """All texts of an identifier share a component, whichever of them is a copy of another's."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (12, c + " end"), (13, c), (13, a.upper() + " x"), (20, "alone"), (None, a)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 1), (5, 1), (5, 1), (9, 1), (9, 1), (12, 1), (13, 1), (13, 1), (20, 20)]
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(rows)


def test_every_labelled_language_is_learned(spark):
    rows = [(n, f"{chr(0x4E00 + n % 80) * 20}", f"l{n % 80:02d}") for n in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(frame)
    assert net.languages == sorted({r[2] for r in rows}) and net.hidden == 20
    texts = [(r[1] * k).encode() for r in rows[:9] for k in (1, 9)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for got, text in zip(language_id.pooled(net, raw, offsets), texts):  # window by window, byte by byte, without batches or masks
        sums = np.zeros(80)
        for a in range(0, len(text), language_id.WINDOW):
            window = np.frombuffer(text[a:a + language_id.WINDOW], np.uint8)[:, None]
            ahead, back = net.states(window, 0)[0][:, 0], net.states(window, 1)[0][:, 0]
            scores = np.concatenate([ahead, back], 1) @ net.out + net.bias
            sums += (np.exp(scores) / np.exp(scores).sum(1, keepdims=True)).sum(0)
        assert np.allclose(got, sums / len(text), atol=1e-4)


def test_jaccard_join_in_a_large_block(spark, monkeypatch):
    """Near copies of one text, chains beside them and documents that share only some shingles, cut into many slices."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 5)
    rnd = random.Random(8)
    base = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join(base[:-1] + [f"end{n}"])) for n in range(60)]
    for chain in range(3):  # every text links with the next one only
        rows += [(100 * (chain + 1) + n, " ".join(base[4 * n:] + [f"c{chain}x{k}" for k in range(4 * n)])) for n in range(12)]
    rows += [(500 + n, " ".join(base[:20] + [f"r{rnd.randrange(90)}" for _ in range(30)])) for n in range(30)]
    rnd.shuffle(rows)
    want = components(rows)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) < 80


def test_divide_skip_finds_all():
    rnd = random.Random(4)
    base = [rnd.sample(range(200), 40) for _ in range(4)]
    sets = [sorted(set(rnd.choice(base)[rnd.randint(0, 4):]) | set(rnd.sample(range(200), rnd.randint(0, 8)))) for _ in range(60)]
    for q in range(60):
        index = jaccard_join.Index([len(s) for s in sets], sets)
        index.take([q])
        want = [i for i, s in enumerate(sets) if i != q and 100 * len({*s} & {*sets[q]}) >= 75 * len({*s} | {*sets[q]})]
        assert index.search(q) == want


def test_token_counts(spark, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = ["  a  b", " a", "a ", "a\nb", "\n", "<s>x</s>", "▁a▁b", "a\x00b", "é  ▁ ▁▁x   ", "   ", "日本 語", "▁", "a b"]
    rows = corpus[1] + [(100 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = token_counts.count_tokens(frame, PIECES, limit=500)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 500) for i, t in rows]
    assert by_id(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.count_tokens(empty(corpus), PIECES).count() == 0
