"""Words that differ between both names, and how telling each is."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.functions.numeric import smoothed_log_odds
from kinsmith.operators.encode import embed

MOST_WORDS = 4
KINDS = {"extra": "wf_ex", "miss": "wf_ms"}


def differing_words(pairs: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    """(s1_idx, rec_idx, extra, miss, ntok_diff): words that only the record's name has, or only the entity's; and how
    many more words the entity's has."""
    x = pairs.select("s1_idx", "rec_idx").join(s1.select("s1_idx", F.col("name_core").alias("a")), "s1_idx", "left").join(rec.select("rec_idx", F.col("name_core").alias("b")), "rec_idx", "left")
    a, b = F.split("a", " "), F.split("b", " ")
    diff = F.regexp_count("a", F.lit(" ")) - F.regexp_count("b", F.lit(" "))
    return x.select("s1_idx", "rec_idx", F.array_except(b, a).alias("extra"), F.array_except(a, b).alias("miss"), diff.alias("ntok_diff"))


def long_words(diff: DataFrame) -> DataFrame:
    """(s1_idx, rec_idx, kind, tok): up to MOST_WORDS of either kind, the first ones."""
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.slice(k, 1, MOST_WORDS).alias("toks")) for k in KINDS))
    return diff.select("s1_idx", "rec_idx", F.inline(parts)).select("s1_idx", "rec_idx", "kind", F.explode("toks").alias("tok")).where("tok <> ''")


def word_counts(words: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, tok, fold, n, pos) from words and labels(s1_idx, rec_idx, y, fold)."""
    return words.join(labels, ["s1_idx", "rec_idx"]).groupBy("kind", "tok", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))


def log_odds(counts: DataFrame, prior: float) -> DataFrame:
    """(kind, tok, lo, n) from all folds."""
    t = counts.groupBy("kind", "tok").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return t.select("kind", "tok", smoothed_log_odds(F.col("n"), F.col("pos"), F.lit(prior)).alias("lo"), "n")


def out_of_fold_log_odds(counts: DataFrame, prior: float) -> DataFrame:
    """(kind, tok, fold, lo): from all folds but the row's own."""
    t = counts.groupBy("kind", "tok").agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"))
    return counts.join(t, ["kind", "tok"]).select("kind", "tok", "fold", smoothed_log_odds(F.col("n_all") - F.col("n"), F.col("pos_all") - F.col("pos"), F.lit(prior)).alias("lo"))


def fit_table(counts: DataFrame, prior: float, holdout: int, min_n: int = 30) -> DataFrame:
    """Words seen at least min_n times outside the holdout fold."""
    return log_odds(counts.where(F.col("fold") != holdout), prior).where(F.col("n") >= min_n)


def fit_transfer(table: DataFrame, alpha: float = 3.0) -> dict[str, LinearRegressionModel]:
    """A ridge regression for each kind, from words' embeddings to log-odds, weighted by ln(1 + n)."""
    out = {}
    for kind in KINDS:
        one = embed(table.where(F.col("kind") == kind), "tok", "features").withColumn("w", F.log1p("n")).persist()
        if n := one.count():
            out[kind] = LinearRegression(labelCol="lo", weightCol="w", elasticNetParam=0.0, regParam=alpha / n, standardization=False).fit(one)
        one.unpersist()
    return out


def transferred(words: DataFrame, models: dict[str, LinearRegressionModel]) -> DataFrame:
    """(kind, tok, emb): predicted log-odds of every distinct word; null without a model of its kind."""
    distinct = words.select("kind", "tok").distinct()
    out = None
    for kind in KINDS:
        one = distinct.where(F.col("kind") == kind)
        part = models[kind].transform(embed(one, "tok", "features")).select("kind", "tok", F.col("prediction").alias("emb")) if kind in models else one.withColumn("emb", F.lit(None).cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def word_features(pairs: DataFrame, words: DataFrame, scores: DataFrame, emb: DataFrame) -> DataFrame:
    """pairs with 10 columns: for both kinds the number of words and the least and greatest log-odds, looked up and predicted.

    scores is out_of_fold_log_odds() joined by fold, if words have one, or log_odds(). Words without a value give null.
    """
    on = ["kind", "tok", *(["fold"] if "fold" in words.columns else [])]
    x = words.join(scores.select(*on, "lo"), on, "left").join(emb, ["kind", "tok"], "left")
    cols = []
    for kind, tag in KINDS.items():
        own = F.col("kind") == kind
        cols.append(F.count_if(own).cast("double").alias(f"{tag}_n"))
        cols += [f(F.when(own, F.col(c))).alias(f"{tag}_{c}_{name}") for c in ("lo", "emb") for name, f in (("min", F.min), ("max", F.max))]
    keys = ["s1_idx", "rec_idx"]
    out = pairs.drop(*(c for c in pairs.columns if c.startswith("wf_")))
    return out.join(x.groupBy(*keys).agg(*cols), keys, "left").na.fill(0, [f"{t}_n" for t in KINDS.values()])
