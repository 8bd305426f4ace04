import random
from itertools import combinations

import numpy as np

from kinsmith.llm import common, minhash
from kinsmith.llm.common import WordHashes, words_of
from kinsmith.llm.graph import connected_components


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> component over rows (doc_id, text) with different ids."""
    sets = {d: shingles(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(30, 200))]
        if r.random() < 0.5:
            base += passage
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 8)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    return list(enumerate(texts))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}


def test_against_brute_force(spark):
    rows = corpus()
    got, want = run(spark, rows), brute(rows)
    assert {d: v[:2] for d, v in got.items()} == want
    assert all(kept == (d == c) for d, (_, c, kept) in got.items())
    assert len({c for _, c in want.values()}) < len(want)


def test_blocks_of_one_row_find_the_same(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    assert {d: v[:2] for d, v in run(spark, rows).items()} == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, "A b"), (2, "a B"), (3, ""), (4, None), (5, " \t\n"), (6, "a b c"), (7, long), (8, long + " y"), (None, "a b"), (9, "É é"), (10, "é é")]
    got = run(spark, rows)
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True)
    assert got[6] == (1, 6, True) and got[8][1] == 7 and got[7][0] == 19_996
    assert got[None] == (1, None, True)
    assert got[9][1] != got[10][1]  # only A-Z are lower-cased


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r[0], r[2], r[3]) for r in minhash.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.keep_one(df).count() == 1
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_keeps_columns_with_any_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, True), (2, "a b c d e f", 3, 4, False), (None, "a b c d e f", 5, 6, None)], "doc_id long, text string, rep int, key int, kept boolean")
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([r for r in df.collect() if r["doc_id"] != 2], key=str)


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 7, 300, 5000):
        s = minhash.sketch(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 250)
        assert s.max() < np.uint64(500) << np.uint64(32)


def test_sketch_agreement_concentrates_about_similarity():
    h = WordHashes()
    a = np.unique(h.of([b"%d" % i for i in range(1000)]))
    b = np.unique(h.of([b"%d" % i for i in range(200, 1200)]))
    share = np.mean(minhash.sketch(a, 4000) == minhash.sketch(b, 4000))
    assert abs(share - 800 / 1200) < 0.03


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 200)] + [(5, 5), (None, 1)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 200)}}


def test_repeated_ids_with_and_without_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = text.replace("w59", "x")
    rows = [(1, text), (1, None), (1, ""), (2, other), (3, other + " y"), (2, " "), (4, None), (4, "a b")]
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and {(d, c) for d, _, c, _ in got} >= {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(n for d, n, _, _ in got if d == 1) == [0, 0, 56]


def test_tables_of_intermediate_results_go(spark):
    before = common.tables_written()
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7, i % 7 + 40))) for i in range(60)]
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in common.tables_written() if p not in before]
    assert sorted(left) == ["reps", "signatures", "small"]
