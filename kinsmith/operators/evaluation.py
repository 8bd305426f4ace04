"""Set-based evaluation of predicted pairs, and recall of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsmith.functions.numeric import f_half
from kinsmith.sources.tables import stored

KEYS = ["s1_idx", "rec_idx"]


def per_entity(predicted: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """A row for each s1 of the universe: n_pred, n_true, tp, fp, fn and the F-score with beta 0.5.

    Repeated pairs count once; pairs of entities outside the universe don't count.
    """
    marked = predicted.select(*KEYS).distinct().withColumn("p", F.lit(1)).join(truth.select(*KEYS).distinct().withColumn("t", F.lit(1)), KEYS, "full")
    counts = marked.groupBy("s1_idx").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    out = universe.select("s1_idx").distinct().join(counts, "s1_idx", "left").na.fill(0, ["n_pred", "n_true", "tp"])
    out = out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_true") - F.col("tp")})
    return out.withColumn("f05", f_half(F.col("tp"), F.col("fp"), F.col("fn")))


def f05_of_sets(predicted: set, truth: set) -> float:
    """The same score for one entity, of Python sets."""
    tp = len(predicted & truth)
    bottom = 1.25 * tp + 0.25 * (len(truth) - tp) + len(predicted) - tp
    return 1.25 * tp / bottom if bottom else 1.0


def macro(entities: DataFrame) -> DataFrame:
    """One row: the mean score, pair precision and recall, and the share of entities without links that got none."""
    share = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1))
    return entities.agg(
        F.avg("f05").alias("macro_f05"),
        share("tp", "n_pred").alias("pair_precision"),
        share("tp", "n_true").alias("pair_recall"),
        F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double"))).alias("singleton_acc"),
        F.count(F.lit(1)).alias("n_s1"),
    )


def match_bucket(n: Column) -> Column:
    """Number of true links as reports group it."""
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def by_bucket(entities: DataFrame) -> DataFrame:
    """Mean score and number of entities by number of true links."""
    return entities.groupBy(match_bucket(F.col("n_true")).alias("bucket")).agg(F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n_s1"))


def by_partition(entities: DataFrame, partitions: DataFrame, name: str = "country") -> DataFrame:
    """Mean score by a column of partitions(s1_idx, name)."""
    return entities.join(partitions.select("s1_idx", name), "s1_idx").groupBy(name).agg(F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n_s1"))


# Limits (record side, entity side) that recall is reported for.
RECALL_GRID = ((3, 0), (5, 0), (10, 0), (20, 0), (3, 10), (5, 10), (5, 20), (10, 30), (20, 30))


def recall_grid(truth: DataFrame, candidates: DataFrame, groups: DataFrame, by: Sequence[str], grid: Sequence[tuple[int, int]] = RECALL_GRID) -> DataFrame:
    """Recall of true links by group and limits, all limits from one scan.

    groups has s1_idx or rec_idx or both, and the columns `by`. A candidate is hit within limits (r, s) if its rank_r is
    under r or its rank_s under s.
    """
    keys = [k for k in KEYS if k in groups.columns]
    g = truth.select(*KEYS).join(candidates.select(*KEYS, "rank_r", "rank_s"), KEYS, "left").join(groups, keys)
    hits = {f"recall_{r}_{s}": F.avg(F.coalesce((F.col("rank_r") < r) | (F.col("rank_s") < s), F.lit(False)).cast("double")) for r, s in grid}
    return g.groupBy(*by).agg(*(v.alias(k) for k, v in hits.items()), F.count(F.lit(1)).alias("n_links"))


def candidates_per_entity(candidates: DataFrame, n_entities: int, grid: Sequence[tuple[int, int]] = RECALL_GRID) -> DataFrame:
    """One row: candidates within each of the limits, for each entity."""
    return candidates.agg(*((F.count_if((F.col("rank_r") < r) | (F.col("rank_s") < s)) / F.lit(float(n_entities))).alias(f"per_s1_{r}_{s}") for r, s in grid))


def auc(scored: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """One row: area under the ROC curve by ranks, ties at their mean rank. Rows are aggregated by score first.

    A row with weight n counts as n equal ones.
    """
    w = F.col(weight).cast("long") if weight is not None else F.lit(1).cast("long")
    g = scored.groupBy(F.col(score).alias("x")).agg(F.sum(w).alias("n"), F.sum(F.col(label).cast("long") * w).alias("pos"))
    # a running count over distinct scores, by ranges; stored, as a second evaluation could cut the ranges elsewhere
    run = F.sum("n").over(Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    part = stored(g.repartitionByRange("x").withColumn("p", F.spark_partition_id()).withColumn("run", run), "scores")
    sizes = part.groupBy("p").agg(F.sum("n").alias("size"))
    before = sizes.select("p", F.coalesce(F.sum("size").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = part.join(before, "p").withColumn("rank", F.col("before") + F.col("run") - (F.col("n") - 1) / 2)
    total = ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    neg = F.col("n") - F.col("pos")
    return total.select(F.when((F.col("pos") > 0) & (neg > 0), (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).alias("auc"))
