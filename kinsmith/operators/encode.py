"""Text embeddings and training triplets. The default embedder hashes character n-grams; any other fits the same shape."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.operators.sampling import exact_sample, order_key
from kinsmith.sources.tables import with_rank

DIMS, GRAM = 256, 3


def with_grams(df: DataFrame, text: str, out: str = "_grams") -> DataFrame:
    """Character n-grams of the text between two marks, cut from an array of characters, so that long texts take linear time."""
    letters = F.split(F.concat(F.lit("^"), F.coalesce(F.col(text), F.lit("")), F.lit("$")), "")
    starts = lambda c: F.sequence(F.lit(0), F.greatest(F.size(c) - F.lit(GRAM), F.lit(0)))
    df = df.withColumn("_letters", letters)
    return df.withColumn(out, F.transform(starts(F.col("_letters")), lambda i: F.concat_ws("", *(F.get("_letters", i + k) for k in range(GRAM))))).drop("_letters")


def embed(df: DataFrame, text: str, out: str = "embedding", dims: int = DIMS, as_array: bool = False) -> DataFrame:
    """Hashed n-gram counts with unit norm, as a vector or an array of floats."""
    hashed = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dims).transform(with_grams(df, text))
    unit = Normalizer(inputCol="_tf", outputCol=out).transform(hashed).drop("_grams", "_tf")
    return unit.withColumn(out, vector_to_array(out, "float32")) if as_array else unit


def weighted_embed(df: DataFrame, corpus: DataFrame, text: str, out: str = "embedding", dims: int = DIMS) -> DataFrame:
    """The same with bins weighted by the rarity that corpus shows: what "training" means for this embedder."""
    bins = lambda d: HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dims, binary=False).transform(with_grams(d, text))
    model = IDF(inputCol="_tf", outputCol="_w").fit(bins(corpus))
    unit = Normalizer(inputCol="_w", outputCol=out).transform(model.transform(bins(df)))
    return unit.drop("_grams", "_tf", "_w").withColumn(out, vector_to_array(out, "float32"))


def _next_in_group(s1: DataFrame, groups: list[str], name: str, seed: int) -> DataFrame:
    """(s1_idx, name): the next entity of the group in order of a hash, the first one for the last; groups can be of any size."""
    ranked = with_rank(s1.select("s1_idx", *groups).withColumn("_h", order_key(["s1_idx"], seed)), "_rank", ["_h", "s1_idx"], groups)
    same = lambda: reduce(and_, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups))
    renamed = [F.col(g).alias(f"_{g}") for g in groups]
    sizes = s1.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).select(*renamed, "_n")
    wanted = ranked.join(sizes, same()).select("s1_idx", *groups, ((F.col("_rank") + 1) % F.col("_n")).alias("_wanted"))
    return wanted.join(ranked.select(*renamed, "_rank", F.col("s1_idx").alias(name)), same() & (F.col("_wanted") == F.col("_rank"))).select("s1_idx", name)


def triplets(truth: DataFrame, s1: DataFrame, n: int, seed: int, partition: str = "country") -> DataFrame:
    """(rec_idx, s1_idx, neg_idx, twin): linked pairs and, for each, another entity of the same partition: one of the same
    name if there is any (twin), else any other; null if there is none.

    Groups are walked in order of a hash and never gathered: the negative is the next entity of the group, and the last
    one's is the first.
    """
    chosen = exact_sample(truth.select("rec_idx", "s1_idx"), n, ["rec_idx", "s1_idx"], seed)
    near, other = _next_in_group(s1, [partition, "name_core"], "near", seed), _next_in_group(s1, [partition], "other", seed)
    twin = F.col("near") != F.col("s1_idx")
    neg = F.when(twin, F.col("near")).when(F.col("other") != F.col("s1_idx"), F.col("other"))
    return chosen.join(near.join(other, "s1_idx"), "s1_idx").select("rec_idx", "s1_idx", neg.alias("neg_idx"), twin.alias("twin"))
