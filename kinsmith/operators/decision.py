"""From probabilities to a set of pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinsmith.operators.evaluation import macro, per_entity

MOST_CANDIDATES = 25
#: Further true links that were never candidates: this many Bernoulli trials share their expected number.
MISS_TRIALS = 3


def prune(candidates: DataFrame, k_rec: int, k_s1: int) -> DataFrame:
    return candidates.where((F.col("rank_r") < k_rec) | (F.col("rank_s") < k_s1))


def second_best(c: str, by: str) -> Column:
    """The second largest value of a group, or the largest of a single row."""
    w = Window.partitionBy(by).orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.nth_value(c, 2).over(w), F.max(c).over(Window.partitionBy(by)))


def exclusive(pairs: DataFrame, p: str, margin: float) -> DataFrame:
    """Each record's best entity, if it leads the second by the margin; a record's only candidate stays. Ties: least s1_idx."""
    by_rank = Window.partitionBy("rec_idx").orderBy(F.desc(p), "s1_idx")
    # the runner-up is the next row of the same order, so one sort does for both
    out = pairs.withColumns({"_rank": F.row_number().over(by_rank), "_next": F.lead(p).over(by_rank)})
    lead = F.col(p) - F.coalesce(F.col("_next"), F.lit(-1.0))
    return out.where((F.col("_rank") == 1) & (lead >= margin)).drop("_rank", "_next")


def threshold(pairs: DataFrame, p: str, tau: float) -> DataFrame:
    return pairs.where(F.col(p) >= tau)


def counts_distribution(p: Sequence[float]) -> np.ndarray:
    """Of how many of independent events happen."""
    d = np.ones(1)
    for x in p:
        d = np.convolve(d, (1 - x, x))
    return d


def _one_more(d: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rows' distributions of counts with one more event in each, of probability x."""
    out = np.pad(d * (1 - x), ((0, 0), (0, 1)))
    out[:, 1:] += d * x
    return out


def expected_scores(p: Sequence[float] | np.ndarray, miss: float = 0.0) -> np.ndarray:
    """Expected F-score (beta 0.5) of taking the first k of the candidates, for k = 0..n; p in descending order.

    p is one list, or a table with a list of the same length in each row; the result has rows accordingly.
    """
    p = np.asarray(p, float)
    if p.ndim == 1:
        return expected_scores(p[None], miss)[0]
    n = p.shape[1]
    out = np.empty((len(p), n + 1))
    out[:, 0] = np.exp(np.log(np.maximum(1 - p, 1e-12)).sum(1) - miss)
    rest = [np.tile(counts_distribution([miss / MISS_TRIALS] * MISS_TRIALS), (len(p), 1))]
    for i in range(n - 1, -1, -1):
        rest.append(_one_more(rest[-1], p[:, i, None]))
    hit = np.ones((len(p), 1))
    for k in range(1, n + 1):
        hit = _one_more(hit, p[:, k - 1, None])
        other = rest[n - k]
        a, b = np.arange(k + 1)[:, None], np.arange(other.shape[1])[None, :]
        out[:, k] = ((hit @ (1.25 * a / (1.25 * a + 0.25 * b + (k - a) + (a == 0)))) * other).sum(1)
    return out


def best_k(p: Sequence[float], miss: float = 0.0) -> tuple[int, float]:
    """The least k of the highest expected score, and that score."""
    e = expected_scores(p, miss)
    k = int(_best(e[None])[0])
    return k, float(e[k])


def _best(e: np.ndarray) -> np.ndarray:
    """The first place of each row's highest score; 0 where a probability was missing."""
    return np.where(np.isnan(e[:, 0]), 0, np.nan_to_num(e, nan=-1.0).argmax(1))


def best_ks(lists: pd.Series, miss: float = 0.0) -> np.ndarray:
    """best_k of every list; lists of equal length are one table, so that no step is taken list by list."""
    out, sizes = np.zeros(len(lists), np.int32), lists.map(len).to_numpy(np.int64)
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        out[at] = _best(expected_scores(np.stack(lists.iloc[at].to_list()).astype(float), miss))
    return out


def expected_f05(pairs: DataFrame, p: str, miss: float = 0.0, most: int = MOST_CANDIDATES) -> DataFrame:
    """The pairs of each entity's best prefix by expected score, among its `most` best candidates. Ties: least rec_idx.

    Only the best candidates of an entity are gathered, so an entity of very many candidates is no burden.
    """

    @pandas_udf("int")
    def choose(ps: pd.Series) -> pd.Series:
        return pd.Series(best_ks(ps, miss))

    order = Window.partitionBy("s1_idx").orderBy(F.desc(p), "rec_idx")
    top = pairs.select("s1_idx", "rec_idx", p).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    lists = top.groupBy("s1_idx").agg(F.array_sort(F.collect_list(F.struct("_r", "rec_idx", p))).alias("c"))
    chosen = lists.withColumn("k", choose(F.transform("c", lambda x: x[p].cast("double"))))
    return chosen.where("k > 0").select("s1_idx", F.explode(F.slice("c", F.lit(1), F.col("k"))).alias("x")).select("s1_idx", F.col("x.rec_idx").alias("rec_idx"), F.col(f"x.{p}").alias(p))


#: Pairs under this probability are left out before the expected-score rule.
LEAST_P = 0.01


def decide(pairs: DataFrame, p: str, rule: dict) -> DataFrame:
    """Apply a rule as tune() returns it."""
    own = exclusive(pairs.select("rec_idx", "s1_idx", p), p, rule["margin"])
    if rule["method"] == "threshold":
        return threshold(own, p, rule["tau"])
    return expected_f05(own.where(F.col(p) >= LEAST_P), p, rule["miss"])


def tune(pairs: DataFrame, p: str, truth: DataFrame, universe: DataFrame, margins: Sequence[float], taus: Sequence[float], misses: Sequence[float]) -> list[dict]:
    """All rules of the grid with their scores on the universe, best first; of equal ones the first tried.

    Exclusivity sees all competitors, also of entities outside the universe. Only one row of scores a rule reaches the driver.
    """
    found = []
    for margin in margins:
        own = exclusive(pairs.select("rec_idx", "s1_idx", p), p, margin).join(universe.select("s1_idx"), "s1_idx", "left_semi").persist()
        rules = [{"method": "threshold", "margin": margin, "tau": t} for t in taus] + [{"method": "expected_f", "margin": margin, "miss": m} for m in misses]
        for rule in rules:
            chosen = threshold(own, p, rule["tau"]) if "tau" in rule else expected_f05(own.where(F.col(p) >= LEAST_P), p, rule["miss"])
            found.append(rule | macro(per_entity(chosen, truth, universe)).first().asDict())
        own.unpersist()
    return sorted(found, key=lambda r: -r["macro_f05"])
