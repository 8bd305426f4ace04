"""Cross-fitted models over pairs with pluggable learners, a scorer of pairs of texts, and self-training."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from kinsmith.operators.encode import with_grams
from kinsmith.operators.evaluation import auc
from kinsmith.operators.sampling import exact_sample, key_sample
from kinsmith.sources.tables import stored

KEYS = ["s1_idx", "rec_idx"]
NOT_FEATURES = (*KEYS, "y", "fold", "pA", "pB", "pC")
#: Stands for a missing feature, beside a column that says so.
MISSING = -1.0
MOST_LOGIT = 50.0
#: Rows that a task of a text pair scorer's fit should have.
FIT_ROWS = 50_000

Learner = Callable[[DataFrame], Model]


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def labelled(features: DataFrame, truth: DataFrame, folds: DataFrame) -> DataFrame:
    """features with y (1 for a true link) and the entity's fold."""
    t = truth.select(*KEYS).distinct().withColumn("y", F.lit(1))
    return features.join(t, KEYS, "left").na.fill(0, ["y"]).join(folds.select("s1_idx", "fold"), "s1_idx", "left")


def with_vector(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A vector of the named columns; columns that can be missing get a flag each."""
    filled = df.select("*", *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(f"_v_{c}") for c in names), *(F.col(c).isNull().cast("double").alias(f"_m_{c}") for c in names))
    columns = [f"_{k}_{c}" for c in names for k in "vm"]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled).drop(*columns)


def gbt_learner(max_iter: int = 40, max_depth: int = 6, rate: float = 0.1, seed: int = 42) -> Learner:
    """Boosted trees that stop early on the rows with `valid`."""

    def fit(df: DataFrame) -> Model:
        return GBTClassifier(labelCol="y", featuresCol="features", maxIter=max_iter, maxDepth=max_depth, stepSize=rate, subsamplingRate=0.8, seed=seed, validationIndicatorCol="valid", maxMemoryInMB=512).fit(df)

    return fit


def logistic_learner(reg: float = 1e-3, max_iter: int = 25) -> Learner:
    def fit(df: DataFrame) -> Model:
        return LogisticRegression(labelCol="y", featuresCol="features", regParam=reg, maxIter=max_iter).fit(df.where("not valid"))

    return fit


def predict(model: Model, df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """df with the model's probability; the order of names is that of training."""
    scored = model.transform(with_vector(df, names))
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def cross_fit(df: DataFrame, names: Sequence[str], n_folds: int, out: str, learner: Learner, s1_fraction: float = 1.0, seed: int = 42, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, list[Model]]:
    """Out-of-fold probabilities of labelled(); the mean of all models on `others`, if given; the models.

    No row is scored by a model that saw its fold. Models learn from all pairs of a sample of entities.
    """
    sample = key_sample(df, s1_fraction, "s1_idx", seed) if s1_fraction < 1 else df
    ready = with_vector(sample.select(*KEYS, "y", "fold", *names), names).persist()
    models, parts = [], []
    for k in range(n_folds):
        model = learner(ready.withColumn("valid", F.col("fold") == k))
        models.append(model)
        parts.append(predict(model, df.where(F.col("fold") == k), names, out))
    ready.unpersist()
    scored = reduce(DataFrame.unionByName, parts)
    return scored, mean_prediction(models, others, names, out) if others is not None else None, models


def mean_prediction(models: Sequence[Model], df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """The models' mean probability."""
    scored = df
    for i, m in enumerate(models):
        scored = predict(m, scored, names, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return scored.withColumn(out, mean).drop(*(f"_p{i}" for i in range(len(models))))


def save_models(models: Sequence[Model], path: str) -> None:
    """All models of a cross-fit, to a folder that the cluster shares."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/{i}")


def load_models(kind: type[Model], path: str, n: int) -> list[Model]:
    return [kind.load(f"{path}/{i}") for i in range(n)]


# ---- pairs of texts
def uncertain(pairs: DataFrame, p: str, low: float, high: float) -> DataFrame:
    return pairs.where(F.col(p).between(low, high)).select(*KEYS)


def pair_texts(pairs: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    """pairs with text_a and text_b: name and address of both sides."""
    text = F.concat_ws(" | ", F.coalesce("name", F.lit("")), F.coalesce("address", F.lit("")))
    return pairs.join(s1.select("s1_idx", text.alias("text_a")), "s1_idx").join(rec.select("rec_idx", text.alias("text_b")), "rec_idx")


class TextPairScorer:
    """Logistic regression on hashed n-grams that both texts have, or only one has. score() adds a logit."""

    def __init__(self, dims: int = 1024, reg: float = 1e-2):
        self.dims, self.reg, self.model = dims, reg, None

    def _vectors(self, df: DataFrame) -> DataFrame:
        x = with_grams(with_grams(df, "text_a", "_a"), "text_b", "_b")
        mark = lambda tag, c: F.transform(c, lambda g: F.concat(F.lit(tag), g))
        x = x.withColumn("_g", F.concat(mark("=", F.array_intersect("_a", "_b")), mark("-", F.array_except("_a", "_b")), mark("+", F.array_except("_b", "_a"))))
        both, all_ = F.size(F.array_intersect("_a", "_b")), F.greatest(F.size(F.array_union("_a", "_b")), F.lit(1))
        x = HashingTF(inputCol="_g", outputCol="_h", numFeatures=self.dims, binary=True).transform(x.withColumn("_j", both / all_))
        return VectorAssembler(inputCols=["_h", "_j"], outputCol="features").transform(x).drop("_a", "_b", "_g", "_h", "_j")

    def fit(self, df: DataFrame, weight: str | None = None) -> TextPairScorer:
        """From (text_a, text_b, y). Without rows every score is 0. A row with weight n stands for n equal ones."""
        w = F.col(weight).cast("double") if weight is not None else F.lit(1.0)
        rows, total, squares = df.agg(F.count(F.lit(1)), F.sum(w), F.sum(w * w)).first()
        if not rows:
            return self
        learner = LogisticRegression(labelCol="y", featuresCol="features", regParam=self.reg, maxIter=50)
        if weight is not None:
            # Spark's variance of weighted rows is larger than that of repeated ones by the inverse of this, and scales the penalty
            if total > 1:
                learner.setRegParam(self.reg * (total - squares / total) / (total - 1))
            learner.setWeightCol(weight)
        # each of up to 50 steps is a job, so few rows are not spread over many tasks
        self.model = learner.fit(self._vectors(df.coalesce(-(-rows // FIT_ROWS))))
        return self

    def score(self, df: DataFrame, out: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(0.0))
        scored = self.model.transform(self._vectors(df))
        # a sample of one class has an infinite intercept
        logit = F.greatest(F.least(vector_to_array("rawPrediction")[1], F.lit(MOST_LOGIT)), F.lit(-MOST_LOGIT))
        return scored.withColumn(out, logit).select(*df.columns, out)


HALVES = {"a": (1, 2), "b": (3, 4)}


def cross_scorers(df: DataFrame, make: Callable[[], TextPairScorer] = TextPairScorer, weight: str | None = None) -> dict[str, TextPairScorer]:
    """One scorer a half of the folds, from (text_a, text_b, y, fold). Both are fitted at once."""
    fit = inheritable_thread_target(df.sparkSession)(lambda own: make().fit(df.where(F.col("fold").isin(*own)), weight))
    with ThreadPoolExecutor(len(HALVES)) as pool:
        return dict(zip(HALVES, pool.map(fit, HALVES.values()), strict=True))


def cross_score(df: DataFrame, scorers: dict[str, TextPairScorer], out: str = "ce") -> DataFrame:
    """Each half is scored by the other's model, the rest (holdout, unlabelled, no fold) by the mean of both."""
    both = scorers["b"].score(scorers["a"].score(df, "_sa"), "_sb")
    fold = F.col("fold") if "fold" in df.columns else F.lit(None).cast("int")
    score = F.when(fold.isin(*HALVES["a"]), F.col("_sb")).when(fold.isin(*HALVES["b"]), F.col("_sa")).otherwise((F.col("_sa") + F.col("_sb")) / 2)
    return both.withColumn(out, score).drop("_sa", "_sb")


def extend_band(scored: DataFrame, pairs: DataFrame, p: str, low: float, high: float) -> DataFrame:
    """Pairs of a wider band that have no score yet."""
    return uncertain(pairs, p, low, high).join(scored.select(*KEYS), KEYS, "left_anti")


def with_scores(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Features with the sparse score (null outside the band) and whether there is one."""
    out = features.join(scores.select(*KEYS, "ce"), KEYS, "left")
    return out.withColumn("in_band", F.col("ce").isNotNull().cast("double"))


# ---- self-training
def pseudo_labels(pairs: DataFrame, p: str, pos_p: float = 0.995, neg_p: float = 0.02, neg_cos: float = 0.8, second_below: float = 0.05) -> DataFrame:
    """(s1_idx, rec_idx, y): sure links that lead their record's list, and sure non-links that look close."""
    w = Window.partitionBy("rec_idx")
    best = w.orderBy(F.desc(p), "s1_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = pairs.withColumns({"_max": F.max(p).over(w), "_n": F.count(F.lit(1)).over(w), "_second": F.nth_value(p, 2).over(best)})
    pos = (F.col(p) >= pos_p) & (F.col(p) == F.col("_max")) & ((F.col("_n") == 1) | (F.col("_second") < second_below))
    neg = (F.col(p) <= neg_p) & (F.col("cos") >= neg_cos)
    return x.where(pos | neg).select(*KEYS, F.when(pos, 1).otherwise(0).alias("y"))


def adapt(scorers: dict[str, TextPairScorer], pseudo: DataFrame, known: DataFrame, guard: DataFrame, n_each: int, seed: int = 42, make: Callable[[], TextPairScorer] = TextPairScorer, weight: str | None = None) -> tuple[dict[str, TextPairScorer], dict[str, tuple[float, float]]]:
    """Scorers fitted on equal parts of pseudo-labelled and known pairs, and their AUC on guard pairs before and after.

    pseudo(text_a, text_b, y), known(..., fold), guard(..., y); samples have n_each rows of a kind at most.
    weight is a column of guard, where a row stands for several.
    """
    ids = ["s1_idx", "rec_idx"]
    drawn = lambda df: stored(exact_sample(df, n_each, ids, seed).select("text_a", "text_b", "y"), "sample")
    mixed = reduce(DataFrame.unionByName, [drawn(pseudo.where(F.col("y") == v)) for v in (1, 0)])
    out, guards = {}, {}
    for h, own in HALVES.items():
        out[h] = make().fit(mixed.unionByName(drawn(known.where(F.col("fold").isin(*own)))))
        guards[h] = tuple(auc(s.score(guard, "_s"), "y", "_s", weight).first()[0] for s in (scorers[h], out[h]))
    return out, guards


def updated(scores: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """scores(s1_idx, rec_idx, ce) with those of new in their place."""
    return scores.join(new.select(*keys, F.col("ce").alias("_new")), list(keys), "left").withColumn("ce", F.coalesce("_new", "ce")).drop("_new")
