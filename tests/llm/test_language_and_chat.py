import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinsmith.llm import chat, lm
from kinsmith.llm.common import words_of


def bursts(n=400, seed=9):
    """Documents of two kinds of words that keep together, so that what came before tells what comes."""
    r = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "ab"]
    out = []
    for d in range(n):
        mine = kinds[d % 2]
        out.append((d, " ".join(r.choice(mine) if r.random() < 0.95 else f"rare{r.randrange(2000)}" for _ in range(r.randrange(5, 60)))))
    return out


def base_scores(rows):
    c = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            c.update(words_of(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    return n, {d: (sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words_of(t), b""]), sum(c[w] > 0 for w in [*words_of(t), b""])) for d, t in rows}


@pytest.fixture(scope="module")
def scored(spark):
    rows = bursts()
    return rows, {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_base_is_exact(scored):
    rows, got = scored
    n, want = base_scores(rows)
    for d, t in rows:
        r = got[d]
        assert abs(r["base_score"] - want[d][0]) < 1e-6 and r["n_known"] == want[d][1]
        assert (r["n_tokens"], r["train_tokens"]) == (len(t.split()) + 1, n)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)


def test_model_beats_the_base_on_held_out_documents(scored):
    _, got = scored
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_few_shipped_words_give_the_same_base(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_SHIPPED", 10)
    rows = bursts(60)
    _, want = base_scores(rows)
    for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert abs(r["base_score"] - want[r["doc_id"]][0]) < 1e-6 and r["n_known"] == want[r["doc_id"]][1]


def small_model():
    g = lm.Gru(np.log(np.full(11, 0.08)), np.log(0.12))
    rng = np.random.default_rng(0)
    for k in g.p:
        g.p[k] = rng.normal(size=g.p[k].shape).astype(np.float32) * 0.5
    return g


def plain_score(g, ids):
    """Token by token, in double precision."""
    p = {k: v.astype(np.float64) for k, v in g.p.items()}
    h, prev, total, n = np.zeros(lm.HIDDEN), 0, 0.0, lm.HIDDEN
    for x in ids:
        a, hw = p["e"][prev] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = (1 / (1 + np.exp(-(a[i * n : (i + 1) * n] + hw[i * n : (i + 1) * n]))) for i in (0, 1))
        h = (1 - z) * np.tanh(a[2 * n :] + r * hw[2 * n :]) + z * h
        o, c = h @ p["wc"] + p["bc"], g.cls[x]
        total += o[c] - np.logaddexp.reduce(o)
        if c < g.classes:
            lo, hi = g.first[c], g.first[c + 1]
            w = h @ p["ww"][:, lo:hi] + p["bw"][lo:hi]
            total += w[x - lo] - np.logaddexp.reduce(w)
        prev = x
    return total


def test_lanes_carry_whole_documents(monkeypatch):
    monkeypatch.setattr(lm, "SCORE_LANES", 3)
    monkeypatch.setattr(lm, "SCORE_WINDOW", 4)
    g, r = small_model(), np.random.default_rng(2)
    docs = [np.append(r.integers(0, 12, size=n), 0) for n in (0, 1, 40, 7, 7, 3, 100)]
    assert np.allclose(g.score(docs), [plain_score(g, d) for d in docs], rtol=1e-4)
    assert g.score([]).tolist() == []


def test_every_whole_training_document_shapes_the_model(spark, monkeypatch):
    seen = []
    add = lm.Stream.add
    monkeypatch.setattr(lm.Stream, "add", lambda self, doc: (seen.append(len(doc)), add(self, doc))[1])
    rows = [t for d, t in bursts(40)] + ["", "a0 b0 " * 9000]
    known = lm.Known([lm.END, b"a0", b"b0"], [42, 9000, 9000], 20000, 99)
    gru = lm.Gru(known.log_mass, float(np.log(known.other)))
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])
    out = pa.Table.from_batches(lm._learner(known, gru)([batch])).to_pydict()
    want = [len(words_of(t)) + 1 for t in rows]
    assert seen == want and set(out["tokens"]) == {sum(want)}


def test_stream_learns_each_token_once_in_order(monkeypatch):
    monkeypatch.setattr(lm, "STREAM_LANES", 3)
    monkeypatch.setattr(lm, "STREAM_BLOCK", 40)
    g, r, pairs = small_model(), np.random.default_rng(4), Counter()
    learn = lm.Gru.learn

    def count(self, steps, h, adam, rate):
        for prev, goal in steps:
            pairs.update(zip(prev.tolist(), goal.tolist(), strict=True))
        assert [len(p) for p, _ in steps] == sorted((len(p) for p, _ in steps), reverse=True)
        return learn(self, steps, h, adam, rate)

    monkeypatch.setattr(lm.Gru, "learn", count)
    docs = [np.append(r.integers(1, 12, size=n), 0) for n in (0, 1, 400, 7, 7, 3, 100, 90, 41, 80, 39, 2)]
    stream = lm.Stream(g)
    for d in docs:
        stream.add(d)
    stream.finish()
    assert pairs == Counter(p for d in docs for p in zip([0, *d.tolist()], d.tolist(), strict=False))
    assert stream.tokens == sum(map(len, docs)) and all(np.isfinite(v).all() for v in g.p.values())


def test_few_lanes_learn_several_windows_in_a_step(monkeypatch):
    """A document that is left alone takes a step for as many ids as all lanes have, and each window's gradient is its own."""
    g, r, sizes = small_model(), np.random.default_rng(7), []
    learn = lm.Gru.learn
    monkeypatch.setattr(lm.Gru, "learn", lambda self, steps, *more: (sizes.append(sum(len(p) for p, _ in steps)), learn(self, steps, *more))[1])
    stream = lm.Stream(g)
    stream.add(np.append(r.integers(1, 12, size=40_000), 0))
    stream.finish()
    assert sum(sizes) == 40_001 and len(sizes) < 100 and max(sizes) <= lm.WINDOW * lm.STREAM_LANES

    kept = []

    class Keep:
        def apply(self, grad, rate):
            kept.append({k: v.copy() for k, v in grad.items()})

    ids = r.integers(0, 12, size=(3 * lm.WINDOW + 1, 2))
    steps, h0 = list(zip(ids[:-1], ids[1:], strict=True)), r.normal(size=(2, lm.HIDDEN)).astype(np.float32)
    end, h = learn(g, steps, h0, Keep(), 1.0), h0
    for at in range(0, len(steps), lm.WINDOW):
        h = learn(g, steps[at : at + lm.WINDOW], h, Keep(), 1.0)
    assert np.allclose(end, h, atol=1e-5)
    for k, v in kept[0].items():
        assert np.allclose(v, sum(one[k] for one in kept[1:]) / 3, atol=1e-5)


def test_gradients_through_a_window():
    g, r = small_model(), np.random.default_rng(6)
    prev, goal = r.integers(0, 12, size=(5, 3)), r.integers(0, 12, size=(5, 3))
    prev[2, 1], steps = 0, [(prev[t, : 3 - (t > 2)], goal[t, : 3 - (t > 2)]) for t in range(5)]
    h0 = r.normal(size=(3, lm.HIDDEN)).astype(np.float32)
    kept = {}

    class Keep:
        def apply(self, grad, rate):
            kept.update(grad)

    g.learn(steps, h0, Keep(), 1.0)

    def loss():
        p, total, n, h = {k: v.astype(np.float64) for k, v in g.p.items()}, 0.0, lm.HIDDEN, h0.astype(np.float64)
        for before, goals in steps:
            h = h[: len(before)] * (before > 0)[:, None]
            a, hw = p["e"][before] @ p["wx"] + p["b"], h @ p["wh"]
            z, q = (1 / (1 + np.exp(-(a[:, i * n : (i + 1) * n] + hw[:, i * n : (i + 1) * n]))) for i in (0, 1))
            h = (1 - z) * np.tanh(a[:, 2 * n :] + q * hw[:, 2 * n :]) + z * h
            total -= g.output(h, goals)[0].sum()
        return total / sum(len(b) for b, _ in steps)

    for k in ("e", "wx", "b", "wh"):
        g.p[k] = g.p[k].astype(np.float64)
        at = tuple(x[0] for x in np.unravel_index(np.argsort(-np.abs(kept[k]).ravel())[:1], kept[k].shape))
        old, e = g.p[k][at], 1e-4
        g.p[k][at] = old + e
        up = loss()
        g.p[k][at] = old - e
        down = loss()
        g.p[k][at] = old
        assert abs((up - down) / (2 * e) - kept[k][at]) < 1e-3 * abs(kept[k][at]) + 1e-5


def test_model_learns_when_all_documents_are_long(spark):
    r = random.Random(3)
    rows = [(d, " ".join(f"{'ab'[d % 2]}{r.randrange(30)}" for _ in range(20_000))) for d in range(24)]
    assert min(len(t) for _, t in rows) > 60_000
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.05 * sum(r["n_tokens"] for r in held)


def test_output_is_computed_in_pieces(monkeypatch):
    """None is larger than a block, and all together give what one piece gives, gradients included."""
    g, r, sizes, loss = small_model(), np.random.default_rng(8), [], lm._softmax_loss
    h, target = r.normal(size=(200, lm.HIDDEN)).astype(np.float32), r.integers(0, 12, size=200)
    monkeypatch.setattr(lm, "_softmax_loss", lambda x, at: (sizes.append(x.shape[1]), loss(x, at))[1])
    results = []
    for block in (200, 16):
        monkeypatch.setattr(lm, "OUTPUT_BLOCK", block)
        sizes.clear()
        grad = {k: np.zeros_like(v) for k, v in g.p.items()}
        results.append((*g.output(h, target, grad), *(grad[k] for k in sorted(grad))))
        assert max(sizes) <= block
    for one, many in zip(*results, strict=True):
        assert np.allclose(one, many, atol=1e-5)


def test_model_is_a_distribution():
    g = small_model()
    h = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(g.output(h, np.array([i]))[0][0]) for i in range(12))
    assert abs(total - 1) < 1e-5


def test_logits_are_lowered_only_where_exponentials_are_not_safe():
    """Small ones are taken as they are; those far beyond what exponentials hold give the same distribution."""
    x = np.array([[1.0, -2.0], [3.0, 0.5]], np.float32)
    given = x.copy()
    lm._softmax_loss(x, np.array([0, 1]))
    assert np.allclose(x, np.exp(given))
    g, h = small_model(), np.random.default_rng(1).normal(size=(12, lm.HIDDEN)).astype(np.float32)
    small = g.output(h, np.arange(12))[0]
    for k in ("bc", "bw"):
        g.p[k] += 500
    assert np.allclose(g.output(h, np.arange(12))[0], small, atol=1e-3)


def test_gradients_of_the_output_layer():
    g, r = small_model(), np.random.default_rng(3)
    for k in g.p:
        g.p[k] = g.p[k].astype(np.float64)
    h, target = r.normal(size=(6, lm.HIDDEN)), np.array([0, 3, 11, 5, 5, 10])
    grad = {k: np.zeros_like(v) for k, v in g.p.items()}
    _, dh = g.output(h, target, grad)
    for k, at in (("wc", (2, 1)), ("bw", (5,)), ("ww", (4, 3))):
        old, e = g.p[k][at], 1e-5
        losses = []
        for s in (e, -e):
            g.p[k][at] = old + s
            losses.append(-g.output(h, target)[0].mean())
        g.p[k][at] = old
        assert abs((losses[0] - losses[1]) / (2 * e) - grad[k][at]) < 1e-6


def test_scores_of_edge_cases(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A a " + "x" * 300), (3, "A a " + "x" * 300)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, rid int")
    got = lm.score_documents(df).collect()
    assert len(got) == 5 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    assert not [r for r in got if r["doc_id"] is None][0]["held_out"]
    assert lm.score_documents(df.limit(0)).count() == 0
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 10 == 0)
    one = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (one["train_tokens"], one["n_known"], one["held_out"]) == (0, 0, True) and np.isfinite(one["score"])


# ---- transcripts
def conversations(n=120, seed=4):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randrange(1, 4)
        for t, role in enumerate(roles):
            size = {"system": 8, "user": 12, "assistant": 60}[role]
            rows.append((c, t, role, "\n".join(" ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(3, size))) for _ in range(r.randrange(1, 4)))))
    return rows


@pytest.fixture(scope="module")
def talk(spark):
    raw = chat.raw_transcripts(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string"))
    train, test = raw.where("conv_id % 3 > 0"), raw.where("conv_id % 3 = 0")
    return chat.fit_hmm(train), test


def test_held_out_roles_are_recovered(talk):
    hmm, test = talk
    got = {(r["conv_id"], r["seq"]): r for r in chat.format_transcripts(test, hmm).collect()}
    want = {(r["conv_id"], r["seq"]): r for r in test.collect()}
    assert got.keys() == want.keys()
    assert sum(got[k]["role"] == want[k]["role"] for k in want) >= 0.93 * len(want)
    for k, r in got.items():
        if r["n_turns"] == 1 and r["role"] == want[k]["role"] and chat._MARKER.match(want[k]["text"]):
            assert r["rendered"] == f"<|{r['role']}|>\n" + chat._MARKER.sub("", want[k]["text"], count=1)


def test_states_against_trying_all_paths(talk):
    from itertools import product

    hmm, _ = talk
    r = random.Random(1)
    for n in (1, 2, 3, 4):
        ms = [hmm.matrix(r.randrange(chat.SYMBOLS)) for _ in range(n)]
        score = lambda p: sum(m[a, b] for m, a, b in zip(ms, (chat.START, *p), p, strict=False))  # noqa: E731,B023
        best = max(score(p) for p in product(range(chat.STATES), repeat=n))
        assert abs(score(chat.chain(ms, chat.START, None)) - best) < 1e-9
        assert abs(chat.product(ms)[chat.START].max() - best) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3])
def test_pieces_give_the_same_as_whole_transcripts(spark, talk, monkeypatch, n):
    hmm, test = talk
    r = random.Random(6)
    odd = [(i // 7, i % 7 if i % 5 else 2, "\n".join(r.choice(("User: a b", "Assistant: c", "", " ", "w " * r.randrange(1, 90), "A:")) for _ in range(r.randrange(1, 4))) + r.choice(("", "\n", "\n\n", "\n \n"))) for i in range(140)]
    for df in (test, spark.createDataFrame(odd, "conv_id long, seq long, text string")):
        monkeypatch.setattr(chat, "SEGMENTS", 256)
        whole = sorted(map(tuple, chat.format_transcripts(df, hmm).collect()))
        monkeypatch.setattr(chat, "SEGMENTS", n)
        assert sorted(map(tuple, chat.format_transcripts(df, hmm).collect())) == whole


def test_many_rows_of_one_seq_and_a_long_turn(spark, talk):
    hmm, _ = talk
    many = spark.range(20_000).selectExpr("cast(7 as long) conv_id", "cast(null as long) seq", "'User: hello' text")
    long = spark.createDataFrame([(8, 0, "User: x\n" + "Assistant: y\nz\n" * 40_000)], "conv_id long, seq long, text string")
    got = chat.format_transcripts(many.unionByName(long), hmm).groupBy("conv_id").agg({"*": "count", "n_lines": "sum", "n_turns": "max"}).collect()
    assert {r[0]: r["count(1)"] for r in got} == {7: 20_000, 8: 1} and {r[0]: r["sum(n_lines)"] for r in got} == {7: 20_000, 8: 80_002}


def test_repeated_turns_count_once_in_the_model(spark):
    raw = chat.raw_transcripts(spark.createDataFrame(conversations(20), "conv_id long, turn long, role string, text string"))
    again = raw.unionByName(raw.where("conv_id = 3")).unionByName(raw.where("conv_id = 3"))
    n = lambda df: df.select("conv_id", "seq", "role").distinct().count()
    assert n(raw) == n(again) and np.allclose(np.exp(chat.fit_hmm(raw).steps[chat.START]), np.exp(chat.fit_hmm(again).steps[chat.START]))


def test_transcript_edge_cases(spark, talk):
    hmm, _ = talk
    rows = [(1, 0, "User: hi\nAssistant: hello\n\nUser: bye"), (2, 0, None), (2, 1, ""), (None, 0, "Q: a"), (None, None, "A: b"), (3, 0, "[USER] x"), (3, 0, "[USER] x"), (2**60 + 1, 5, "<|assistant|>y")]
    df = spark.createDataFrame([(*r, "user") for r in rows], "conv_id long, seq long, text string, role string")
    got = {(r["conv_id"], r["seq"]): r for r in chat.format_transcripts(df, hmm).collect()}
    assert got[1, 0]["rendered"] == "<|user|>\nhi\n<|assistant|>\nhello\n\n<|user|>\nbye" and got[1, 0]["n_turns"] == 3
    assert got[2, 0]["n_lines"] == 1 and (2**60 + 1, 5) in got and (None, 0) in got
    assert chat.format_transcripts(df, hmm).count() == len(rows)
    assert chat.format_transcripts(df.limit(0), hmm).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert np.isfinite(chat.fit_hmm(chat.raw_transcripts(empty)).steps).all()


def test_markers():
    kinds = {"User: a": 2, "user : a": 2, "### Human: a": 2, "**Assistant**: a": 3, "[BOT] a": 3, "<|system|>a": 1, "Answer: a": 3, "users: a": 0, "a b": 0, "A of it": 0, "": 0, "Q: x": 2}
    for line, k in kinds.items():
        assert chat.observe(line)[0][0] // 14 == k, line
