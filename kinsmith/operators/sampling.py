"""Folds, exact-size samples and subsets, all by hash of keys: the same rows whatever the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsmith.sources.tables import with_rank

MOST_MATCHES = 6


def order_key(keys: Sequence[str], seed: int) -> Column:
    """60 bits of the MD5 of the keys and the seed as text, with colons between: other engines can compute it too."""
    text = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def exact_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int) -> DataFrame:
    """n rows without replacement, or all if there are fewer. The order is a column, or each comparison would hash again."""
    return df.withColumn("_order", order_key(keys, seed)).orderBy("_order", *keys).limit(n).drop("_order")


def key_sample(df: DataFrame, fraction: float, key: str, seed: int) -> DataFrame:
    """All rows of about a fraction of the keys."""
    return df.where(F.pmod(order_key([key], seed), F.lit(1_000_000)) < F.lit(fraction * 1_000_000))


def with_stratified_bucket(df: DataFrame, name: str, stratum: str, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """Round-robin number of each row within its stratum, in the given order and then by keys; strata can be of any size."""
    tagged = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    ranked = with_rank(tagged, "_rank", [*(f"_o{i}" for i in range(len(order))), *keys], [stratum])
    return ranked.withColumn(name, (F.col("_rank") % n).cast("int")).drop("_rank", *(f"_o{i}" for i in range(len(order))))


def with_strata(s1: DataFrame, truth: DataFrame, partition: str = "country") -> DataFrame:
    """n_true and the stratum: the partition and up to MOST_MATCHES true links."""
    n = truth.groupBy("s1_idx").agg(F.count(F.lit(1)).alias("n_true"))
    out = s1.select("s1_idx", partition).join(n, "s1_idx", "left").na.fill(0, ["n_true"])
    return out.withColumn("stratum", F.concat(F.col(partition).cast("string"), F.lit("_"), F.least("n_true", F.lit(MOST_MATCHES)).cast("string")))


def folds(s1: DataFrame, truth: DataFrame, n_folds: int, partition: str = "country", order: Sequence[Column] | None = None, seed: int = 42) -> DataFrame:
    """(s1_idx, fold, n_true, stratum), every stratum dealt evenly to the folds."""
    strata = with_strata(s1, truth, partition)
    by = order if order is not None else [order_key(["s1_idx"], seed)]
    return with_stratified_bucket(strata, "fold", "stratum", ["s1_idx"], n_folds, by).select("s1_idx", "fold", "n_true", "stratum")


def dev_subset(s1: DataFrame, rec: DataFrame, truth: DataFrame, s1_fraction: float, rec_fraction: float, partition: str = "country", seed: int = 43) -> tuple[DataFrame, DataFrame]:
    """A stratified fraction of the entities; their matches and a fraction of the records that match nothing."""
    strata = with_strata(s1, truth, partition)
    n = round(1 / s1_fraction)
    dev_s1 = with_stratified_bucket(strata, "_b", "stratum", ["s1_idx"], n, [order_key(["s1_idx"], seed)]).where("_b = 0").select("s1_idx")
    matches = truth.join(dev_s1, "s1_idx", "left_semi").select("rec_idx")
    free = rec.select("rec_idx").join(truth.select("rec_idx"), "rec_idx", "left_anti")
    return dev_s1, matches.unionByName(exact_sample(free, round(free.count() * rec_fraction), ["rec_idx"], seed + 1)).distinct()


def hide_entities(features: DataFrame, fraction: float, recompute, context_columns: Sequence[str], seed: int = 49) -> DataFrame:
    """Without a random fraction of the entities, whose records so become distractors; context features are made anew."""
    kept = features.where(F.pmod(order_key(["s1_idx"], seed), F.lit(1_000_000)) >= F.lit(fraction * 1_000_000))
    return recompute(kept.drop(*context_columns))
