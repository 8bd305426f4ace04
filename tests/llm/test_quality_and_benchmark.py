import math
import random
from collections import Counter

import numpy as np
import pytest

from kinsmith.llm import decontam, importance
from kinsmith.llm.common import WordHashes, words_of


def quality_corpus(n=900, seed=3):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randrange(20, 120))]
        kind = i % 5
        if kind == 3:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(("vile", "nasty"))
        if kind == 4:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), kind))
        if r.random() < 0.4:
            labels.append((i, int(kind != 4), int(kind == 3)))
    return rows, labels


@pytest.fixture(scope="module")
def graded(spark):
    rows, labels = quality_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rejects_what_the_labels_reject(graded):
    docs, labels = graded
    kept = {r["doc_id"] for r in importance.importance_sample(docs, labels, share=0.6).collect()}
    bad = [i for i in range(900) if i % 5 in (3, 4)]
    good = [i for i in range(900) if i % 5 not in (3, 4)]
    assert sum(i in kept for i in bad) <= 0.02 * len(bad)
    assert sum(i in kept for i in good) >= 0.98 * len(good)


def test_the_sample_is_what_a_recount_by_hand_gives(spark, graded):
    """Counts, ratios, summaries, weights, keys and the k-th of them, by plain loops."""
    import re as regex

    docs, labels = graded
    got = {r["doc_id"]: (r["log_weight"], r["key"]) for r in importance.importance_sample(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"]: int(r["quality"] >= 1 and r["toxic"] == 0) for r in labels.collect()}

    def shape(w):
        for pattern, by in (("[A-Z]+", "A"), ("[a-z]+", "a"), ("[0-9]+", "9"), (r"(.)\1+", r"\1")):
            w = regex.sub(pattern, by, w)
        return w

    codes = importance._Codes()

    def buckets(text):
        return [g.tolist() for g in importance._grams(codes, [text])[0]]

    # n-grams of equal words, shapes and beginnings have equal buckets, and others have others but for collisions
    first = {}
    for t in list(texts.values())[:60]:
        w = t.split()
        named = [[("w", x) for x in w], [("s", shape(x), shape(w[i - 1]) if i else "", i > 0 and w[i - 1] == x) for i, x in enumerate(w)], [("b", x[:4]) for x in w]]
        for names, bs in zip(named, buckets(t), strict=True):
            assert all(first.setdefault(name, b) == b for name, b in zip(names, bs, strict=True))
    raw, target = Counter(), Counter()
    for d, t in texts.items():
        for kind, bs in enumerate(buckets(t)):
            for b in bs if kind == 1 else set(bs):
                raw[b] += 1
                target[b] += good.get(d) == 1
    ends = [1 << importance.WORD_BITS, (1 << importance.WORD_BITS) + (1 << importance.SHAPE_BITS), importance.BUCKETS]
    kind_of = lambda b: sum(b >= e for e in ends)
    total = Counter()
    for b in raw:
        total["raw", kind_of(b)] += raw[b]
        total["target", kind_of(b)] += target[b]

    def expected(b):
        return raw[b] * total["target", kind_of(b)] / total["raw", kind_of(b)]

    def sure(t, e):
        return max(0.0, e - t + t * math.log(max(t, 1) / e) - 8) if t < 0.25 * e else 0.0

    def summaries(d):
        own = good.get(d) == 1
        words, shapes, starts = buckets(texts[d])
        times, n = Counter(shapes), len(words)
        ratio = lambda b, k: math.log((target[b] - own * k + 1) / (expected(b) + 1))
        r1, r2 = [ratio(b, 1) for b in words], [ratio(b, times[b]) for b in shapes]
        bad = [min(x + 1.5, 0) + min(y + 1.5, 0) for x, y in zip(r1, r2, strict=True)]
        mass = sum(sure(target[b] - own, expected(b)) for b in words + starts)
        w = texts[d].split()
        return [sum(r1 + r2) / n, math.log1p(-sum(bad)), sum(b < 0 for b in bad) / n, math.log1p(mass), sum(x == y for x, y in zip(w, w[1:], strict=False)) / n, math.log1p(n)]

    x = np.array([summaries(d) for d in good])
    weights = importance._fit(x, np.array([float(v) for v in good.values()]))
    z = x - x.mean(0)
    slope = ((np.array(list(good.values())) - 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]))))[:, None] * z).sum(0)
    assert np.allclose(slope, weights[:-1] * np.maximum(x.std(0), 1e-9) ** 2, atol=1e-3)  # the ridge's optimum
    noise = {r[0]: r[1] for r in docs.select("doc_id", importance._noise(docs["doc_id"])).collect()}
    keys = {d: (float(np.dot(summaries(d), weights[:-1]) + weights[-1]), noise[d]) for d in texts}
    k = round(len(texts) * sum(good.values()) / len(good))
    best = sorted(keys, key=lambda d: -sum(keys[d]))[:k]
    assert set(got) == set(best)
    for d, (weight, key) in got.items():
        assert abs(weight - keys[d][0]) < 1e-3 * max(1, abs(weight)) and abs(key - sum(keys[d])) < 1e-3 * max(1, abs(key))
    assert {d for d in keys if keys[d][0] > 0} != set(best)  # it samples, it doesn't cut at a weight
    assert abs(np.mean(list(noise.values())) - 0.5772) < 0.2 and abs(np.std(list(noise.values())) - 1.2825) < 0.2


def test_keep_good_returns_whole_rows_whatever_their_names(graded):
    docs, labels = graded
    chosen = {r["doc_id"] for r in importance.importance_sample(docs, labels).collect()}
    out = importance.keep_good(docs, labels)
    assert out.schema == docs.schema
    assert {r["doc_id"] for r in out.collect()} == chosen


def test_partitions_do_not_change_the_choice(graded):
    docs, labels = graded
    a = {r["doc_id"] for r in importance.importance_sample(docs.coalesce(1), labels).collect()}
    assert a == {r["doc_id"] for r in importance.importance_sample(docs.repartition(7), labels).collect()}


def test_counts_are_of_all_documents(spark):
    rows = [(1, "A b b"), (2, "b"), (3, None)]
    counts = spark.createDataFrame([(t, 1) for _, t in rows], "text string, good int").mapInArrow(importance._count, "bucket long, raw long, target long").groupBy().sum("raw", "target").first()
    assert tuple(counts) == (10, 10)  # words and beginnings once a document, all four shapes


def test_kth_largest(spark):
    r = random.Random(5)
    x = [r.gauss(0, 1000) for _ in range(700)] + [3.25] * 50
    df = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 2, 350, 700, 749, 750):
        assert importance._kth_largest(df, k, steps=16) == sorted(x, reverse=True)[k - 1]


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "c"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(str(r["doc_id"]) for r in importance.importance_sample(docs, none).collect())
    assert got == ["1", "1", "None"]
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.importance_sample(docs, odd).count() == 3
    assert importance.importance_sample(docs.limit(0), none).count() == 0
    assert importance.keep_good(docs.limit(0), none).count() == 0


# ---- contamination
def passages(seed=7):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    pick = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, pick(r.randrange(15, 50))) for i in range(20)]
    docs = []
    for d in range(120):
        words = pick(r.randrange(0, 300))
        if d % 3 == 0:
            own = list(r.choice(items)[1])
            for _ in range(d % 4):
                own[r.randrange(len(own))] = "changed"
            at = r.randrange(len(words) + 1)
            words = words[:at] + own + words[at:]
        docs.append((d, " ".join(words)))
    return docs, [(i, " ".join(w)) for i, w in items]


def reordered(n=400, seed=9):
    """Documents that hold an item rotated, with words put in, left out or changed, cut off, or twice; items share passages."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    pick = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [pick(r.randrange(6, 25)) for _ in range(3)]
    items = [[*pick(r.randrange(0, 40)), *(r.choice(shared) if i % 3 else []), *pick(r.randrange(6, 60))] for i in range(40)]
    items += [pick(k) for k in (1, 3, 4, 5, 6)] + [items[0]]
    docs = []
    for d in range(n):
        own = list(r.choice(items))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(own) + 1)
            match r.randrange(6):
                case 0:
                    own = own[at:] + own[:at]
                case 1:
                    own[at:at] = pick(r.randrange(1, 6))
                case 2:
                    del own[at : at + r.randrange(1, 6)]
                case 3:
                    own[at : at + 1] = pick(1)
                case 4:
                    own = own[at // 3 :]
                case 5:
                    own += own[: at // 2]
        front, back = (pick(r.choice((0, 2, 30, 100))) for _ in range(2))
        docs.append((d, " ".join(front + own + back)))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)]


def slide_every_window(docs, items):
    """By plain Python: every window of an item's length, clipped at the ends, and exact similarities."""
    words = lambda t: t.lower().split()
    h = WordHashes()
    shingles = lambda w, n: decontam.shingle_hashes(h.of([x.encode() for x in w]), n).tolist() if len(w) >= n else []
    sets = {i: (len(words(t)), frozenset(shingles(words(t), min(5, len(words(t)))))) for i, t in items if words(t)}
    counts = Counter(x >> 44 for _, s in sets.values() for x in {b for b in s})
    weight = lambda x: math.log(1 + len(sets) / counts.get(x >> 44, 1))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, (k, own) in sets.items():
            n = min(5, k)
            s, span, best = shingles(w, n), k - n + 1, None
            for a in range(1 - span, len(s)):
                lo, hi = max(0, a), min(len(s), a + span)
                window = frozenset(s[lo:hi])
                if window & own:
                    both = math.fsum(weight(x) for x in window & own)
                    sim = both / (math.fsum(map(weight, own)) + math.fsum(map(weight, window)) - both)
                    if sim >= 0.75 - 1e-12 and (best is None or (sim, -lo, lo - hi) > (best[0], -best[1], -best[2])):
                        best = (sim, lo, hi - lo)
            if best:
                out[d, i] = (best[1], best[2] + n - 1, best[0])
    return out


@pytest.mark.parametrize("made", [passages, reordered])
def test_finds_what_sliding_every_window_finds(spark, made):
    docs, items = made()
    want = slide_every_window(docs, items)
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r[0], r[1]): tuple(r)[2:] for r in got}
    assert found.keys() == want.keys() and len(want) > 10  # a recall of 1
    for k, (start, n, sim) in want.items():
        assert found[k][:2] == (start, n) and abs(found[k][2] - sim) < 1e-9


def test_swapped_halves_are_found():
    r = random.Random(4)
    items = [(i, " ".join(f"u{r.randrange(3000)}" for _ in range(100))) for i in range(50)]
    mark, h = decontam.Benchmark(items), WordHashes()
    for at in (10, 15, 20, 35, 50):
        for i, t in items:
            w = t.split()
            assert i in {m[0] for m in mark.matches(" ".join(["x"] * 30 + w[at:] + w[:at] + ["y"] * 40), h)}


def test_sliding_fingerprints_are_those_of_the_windows():
    r = np.random.default_rng(3)
    mark = decontam.Benchmark(passages()[1])
    s = decontam.mix(r.integers(0, 40, 400).astype(np.uint64))  # many repeats
    starts = np.arange(-20, 400)
    lo, hi = np.maximum(starts, 0), np.minimum(starts + 30, 400)
    lo, hi = lo[hi > lo], hi[hi > lo]
    got = mark.fingerprints(s, lo, hi)
    want = [mark.fingerprint(np.unique(s[a:b])) for a, b in zip(lo, hi, strict=True)]
    assert np.array_equal(got, np.array(want))


def test_multi_index_misses_no_fingerprint_within_the_radius():
    r = np.random.default_rng(1)
    prints = r.integers(0, 256, (60, decontam.BLOCKS)).astype(np.uint8)
    group = decontam.Group(list(range(60)), prints)
    for i, p in enumerate(prints):
        bits = np.unpackbits(p)
        bits[r.choice(128, decontam.RADIUS, replace=False)] ^= 1
        q = np.packbits(bits)
        near = np.flatnonzero(np.bitwise_count(prints ^ q).sum(1) <= decontam.RADIUS)
        assert i in near and group.within(q[None])[1].tolist() == near.tolist()


@pytest.mark.parametrize(("made", "parts"), [(passages, 2), (reordered, 2), (reordered, 7)])
def test_benchmark_in_parts_gives_the_same(spark, monkeypatch, made, parts):
    docs, items = made(seed=8)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontam.contaminated(d, b).collect()}
    monkeypatch.setattr(decontam, "MOST_CHARS", -(-sum(len(t) for _, t in items) // parts))
    assert len(list(decontam._parts(b))) == parts
    assert {tuple(r) for r in decontam.contaminated(d, b).collect()} == whole and len(whole) > 10
    clean = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    assert clean == {x for x, _ in docs} - {r[0] for r in whole}


def test_contamination_edge_cases(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"x {item} y", 1), (2, None, 2), (3, "", 3), (None, item.upper(), 4), (5, "ab cd", 5), (6, "x ab cd", 6), (1, f"x {item} y", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "ab cd")], "item_id long, text string")
    got = sorted(((r[0] or 0), r[1], r[2], r[3]) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, 7, 0, 10), (1, 7, 1, 10), (1, 7, 1, 10), (5, 10, 0, 2), (6, 10, 1, 2)]
    clean = decontam.decontaminate(docs, bench)
    assert clean.schema == docs.schema and sorted(r["doc_id"] for r in clean.collect()) == [2, 3]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == 7


def test_fingerprints_stay_near_when_most_shingles_are_shared():
    r = np.random.default_rng(5)
    b = decontam.Benchmark([])
    shared, far = r.integers(1, 1 << 62, 300).astype(np.uint64), 0
    for _ in range(200):
        own = r.integers(1 << 62, 1 << 63, 11).astype(np.uint64)  # one changed word changes five of six
        b.weight = np.full(1 << decontam.BIN_BITS, np.log(2))
        b.weight[decontam._bins(own)] = np.log(1001)
        one, two = (b.fingerprint(np.concatenate([shared, own[k : k + 6]])) for k in (0, 5))
        far += np.bitwise_count(one ^ two).sum() > decontam.RADIUS
    assert far == 0
