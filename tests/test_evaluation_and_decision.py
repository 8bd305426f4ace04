import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from kinsmith.operators import decision, evaluation


def frames(spark, predicted, truth, universe):
    pairs = "s1_idx long, rec_idx long"
    return spark.createDataFrame(predicted, pairs), spark.createDataFrame(truth, pairs), spark.createDataFrame([(u,) for u in universe], "s1_idx long")


@pytest.mark.parametrize(
    ("predicted", "truth", "score"),
    [({47, 193, 812}, {47, 812}, 1.25 * (2 / 3) / (0.25 * (2 / 3) + 1)), (set(), set(), 1.0), ({1}, set(), 0.0), (set(), {1, 2}, 0.0), ({3}, {1}, 0.0), ({1, 2}, {1, 2}, 1.0), ({1}, {1, 2}, 1.25 / 1.5)],
)
def test_scores_of_sets(predicted, truth, score):
    assert math.isclose(evaluation.f05_of_sets(predicted, truth), score)


def test_per_entity_equals_sets(spark):
    r = random.Random(1)
    truth = {s: set(r.sample(range(40), r.randrange(5))) for s in range(300)}
    pred = {s: set(r.sample(range(40), r.randrange(5))) for s in range(300)}
    long = lambda d: [(s, x) for s, xs in d.items() for x in xs]
    p, t, u = frames(spark, long(pred) + long(pred)[:50], long(truth), range(300))
    got = {row["s1_idx"]: row["f05"] for row in evaluation.per_entity(p, t, u).collect()}
    assert all(math.isclose(got[s], evaluation.f05_of_sets(pred[s], truth[s])) for s in range(300))
    mean = evaluation.macro(evaluation.per_entity(p, t, u)).first()["macro_f05"]
    assert math.isclose(mean, sum(got.values()) / 300)


def test_pairs_outside_the_universe_do_not_count(spark):
    rows = evaluation.per_entity(*frames(spark, [(0, 1), (5, 2)], [(0, 1), (5, 9)], [0])).collect()
    assert [(r["s1_idx"], r["f05"]) for r in rows] == [(0, 1.0)]


def test_report_of_singletons(spark):
    row = evaluation.macro(evaluation.per_entity(*frames(spark, [(1, 1)], [], [1, 2]))).first()
    assert (row["singleton_acc"], row["pair_recall"], row["pair_precision"], row["macro_f05"]) == (0.5, 0.0, 0.0, 0.5)


def test_auc_with_ties(spark):
    r = random.Random(2)
    rows = [(r.randrange(2), r.randrange(6) / 5) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(evaluation.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()[0], want)
    assert evaluation.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()[0] is None


def brute_scores(p, miss):
    """By enumerating all outcomes, further links being three trials."""
    n, extra = len(p), [miss / 3] * 3
    out = np.zeros(n + 1)
    for bits in itertools.product((0, 1), repeat=n + 3):
        pr = math.prod(q if b else 1 - q for q, b in zip([*p, *extra], bits, strict=True))
        for k in range(1, n + 1):
            tp, total = sum(bits[:k]), sum(bits)
            if tp:
                out[k] += pr * 1.25 * tp / (1.25 * tp + 0.25 * (total - tp) + (k - tp))
    out[0] = math.prod(1 - q for q in p) * math.exp(-miss)
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("miss", [0.0, 0.3])
def test_expected_scores_against_enumeration(seed, miss):
    r = np.random.default_rng(seed)
    p = sorted(r.random(int(r.integers(1, 7))), reverse=True)
    want = brute_scores(p, miss)
    assert np.allclose(decision.expected_scores(p, miss), want)
    assert decision.best_k(p, miss)[0] == int(want.argmax())


def test_prefix_examples():
    assert decision.best_k([0.3, 0.1])[0] == 0
    assert decision.best_k([0.99, 0.98, 0.05])[0] == 2
    assert np.allclose(decision.expected_scores([0.95, 0.9, 0.2]), [0.004, 0.783976, 0.915677, 0.723033], atol=1e-6)


@pytest.mark.parametrize("miss", [0.0, 0.3])
def test_lists_of_all_lengths_at_once(miss):
    r = np.random.default_rng(3)
    lists = [np.sort(r.random(int(n)) ** 0.5)[::-1] for n in r.integers(0, 9, 60)] + [np.array([0.9, np.nan])]
    want = [int(brute_scores(p.tolist(), miss).argmax()) for p in lists[:-1]] + [0]
    assert decision.best_ks(pd.Series(lists), miss).tolist() == want
    assert decision.best_ks(pd.Series([], dtype=object), miss).tolist() == []


def test_expected_selection_of_frames(spark):
    df = spark.createDataFrame([(0, 5, 0.95), (0, 6, 0.9), (1, 7, 0.2)], "s1_idx long, rec_idx long, p double")
    assert sorted(r["rec_idx"] for r in decision.expected_f05(df, "p").collect()) == [5, 6]
    many = spark.createDataFrame([(0, i, 0.99) for i in range(60)], "s1_idx long, rec_idx long, p double")
    assert sorted(r["rec_idx"] for r in decision.expected_f05(many, "p").collect()) == list(range(25))


def test_exclusivity(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.2), (2, 10, 0.6)], "rec_idx long, s1_idx long, p double")
    chosen = lambda m: sorted((r["rec_idx"], r["s1_idx"]) for r in decision.exclusive(df, "p", m).collect())
    assert chosen(0.1) == [(1, 10), (2, 10)]
    assert chosen(0.8) == [(2, 10)]


def test_each_record_at_most_once_in_any_order(spark):
    r = random.Random(3)
    rows = [(rec, s, r.randrange(5) / 4) for rec in range(50) for s in r.sample(range(30), 4)]
    schema = "rec_idx long, s1_idx long, p double"
    a = sorted(map(tuple, decision.exclusive(spark.createDataFrame(rows, schema), "p", 0.0).collect()))
    r.shuffle(rows)
    assert a == sorted(map(tuple, decision.exclusive(spark.createDataFrame(rows, schema).repartition(7), "p", 0.0).collect()))
    assert len({x[0] for x in a}) == len(a) == 50


def test_tuning_returns_the_best_rule_first(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.4), (3, 2, 0.8)], "rec_idx long, s1_idx long, p double")
    truth, universe = spark.createDataFrame([(1, 1), (2, 3)], "s1_idx long, rec_idx long"), spark.createDataFrame([(1,), (2,)], "s1_idx long")
    found = decision.tune(pairs, "p", truth, universe, (0.0,), (0.3, 0.6), (0.0,))
    assert len(found) == 3 and found[0]["macro_f05"] == max(r["macro_f05"] for r in found) == 1.0
    assert {(r["s1_idx"], r["rec_idx"]) for r in decision.decide(pairs, "p", found[0]).collect()} == {(1, 1), (2, 3)}


def test_pruned_pairs_are_candidates(spark):
    df = spark.createDataFrame([(i, j, i % 7, j % 9) for i in range(20) for j in range(20)], "rec_idx long, s1_idx long, rank_r int, rank_s int")
    kept = decision.prune(df, 2, 3)
    assert kept.join(df, ["rec_idx", "s1_idx"], "left_anti").count() == 0
    assert kept.count() == sum(i % 7 < 2 or j % 9 < 3 for i in range(20) for j in range(20))
