"""A linkage run: named stages, each a parquet table, in an order that follows from what they read."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsmith.operators import blocking, decision, features, mining, models, normalize, prepare, sampling, wordfeat
from kinsmith.operators.encode import embed
from kinsmith.operators.evaluation import macro, per_entity
from kinsmith.sources.tables import ContractError, write_json, write_tsv


@dataclass
class Stage:
    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]


@dataclass
class Run:
    """Executes stages with everything they need before them. Finished tables are read again, not made again."""

    spark: SparkSession
    folder: str
    stages: dict[str, Stage] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    #: What stages fit beside their tables: models with their features, scorers, rules.
    kept: dict[str, object] = field(default_factory=dict)

    def stage(self, name: str, *reads: str) -> Callable:
        def put(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.stages[name] = Stage(name, reads, make)
            return make

        return put

    def order(self, targets: Sequence[str]) -> list[str]:
        """What has to run for the targets, each after all that it reads. A cycle is an error."""
        need, graph = list(targets), {}
        while need:
            name = need.pop()
            if name in self.tables or name in graph:
                continue
            if name not in self.stages:
                raise KeyError(f"no stage or table {name!r}")
            graph[name] = [r for r in self.stages[name].reads if r not in self.tables]
            need += graph[name]
        return list(TopologicalSorter(graph).static_order())

    def __call__(self, *targets: str) -> DataFrame:
        for name in self.order(targets):
            began = time.time()
            s = self.stages[name]
            path = f"{self.folder}/{name}"
            s.make(*(self.tables[r] for r in s.reads)).write.mode("overwrite").parquet(path)
            self.tables[name] = self.spark.read.parquet(path)
            self.seconds[name] = round(time.time() - began, 3)
        return self.tables[targets[-1]]

    def log(self, path: str) -> None:
        write_json(self.seconds, path)


@dataclass
class Settings:
    """What a run can be told; the numbers are starting points for small tables."""

    n_folds: int = 5
    holdout: int = 0
    k_rec: int = 3
    k_s1: int = 10
    max_block: int = 50
    min_count: int = 2
    margins: tuple[float, ...] = (0.0, 0.1)
    taus: tuple[float, ...] = (0.5, 0.7)
    misses: tuple[float, ...] = (0.0, 0.05)
    band: tuple[float, float] = (0.02, 0.98)
    s1_fraction: float = 1.0
    learner: models.Learner = field(default_factory=models.logistic_learner)


KEYS = ["s1_idx", "rec_idx"]


def linkage(spark: SparkSession, folder: str, s1: DataFrame, rec: DataFrame, truth: DataFrame, settings: Settings | None = None, new: tuple[DataFrame, DataFrame] | None = None) -> Run:
    """The stages from keyed tables s1(s1_idx, name, address, country), rec(rec_idx, name, address, country, src) and
    truth(s1_idx, rec_idx) to links: folds, maps, normal forms, candidates, features, models A, B and C, and decision.

    `new` is a pair of such tables without truth, with entity_id. Its stages are named new_...: what is fitted on the labelled
    tables predicts its links, new_lists are the report and new_checks its counts of faults. A run makes what its targets
    need: "report" trains only, "new_candidates" predicts nothing, "new_lists" does all.
    """
    c = settings or Settings()
    run = Run(spark, folder, tables={"s1": s1, "rec": rec, "truth": truth})
    run.stage("folds", "s1", "truth")(lambda s1, truth: sampling.folds(s1, truth, c.n_folds))
    _map_stages(run, c)
    _split_stages(run, c, "")
    _training_stages(run, c)
    _decision_stages(run, c)
    if new is not None:
        run.tables |= {"new_s1": new[0], "new_rec": new[1]}
        _split_stages(run, c, "new_")
        _prediction_stages(run, c)
    return run


def export(run: Run, path: str) -> None:
    """Write the lists of links and of candidates of the new tables as TSV, after checking them; a fault is an error."""
    if bad := [f"{r['n']} {r['check']}" for r in run("new_checks").collect() if r["n"]]:
        raise ContractError(f"the report has {', '.join(bad)}")
    for name in ("new_lists", "new_candidate_lists"):
        write_tsv(run(name), f"{path}/{name.removeprefix('new_')}", "source1_entity_id")


def _map_stages(run: Run, c: Settings) -> None:
    """Token maps, mined without the holdout."""

    @run.stage("linked", "truth", "folds", "s1", "rec")
    def _(truth, folds, s1, rec):
        return mining.linked_tokens(truth.join(folds.where(F.col("fold") != c.holdout), "s1_idx", "left_semi"), s1, rec)

    run.stage("name_map", "linked")(lambda linked: mining.name_map(linked, c.min_count))
    run.stage("addr_map", "linked")(lambda linked: mining.address_map(linked, max(c.min_count, 5)))


def _split_stages(run: Run, c: Settings, tag: str) -> None:
    """Normal forms, candidates and features of pairs of a split, labelled or not."""

    @run.stage(f"{tag}s1_norm", f"{tag}s1", "name_map", "addr_map")
    def _(s1, names, addresses):
        return normalize.normalize(s1, "s1_idx", names, addresses).join(s1.select("s1_idx", "country"), "s1_idx")

    @run.stage(f"{tag}rec_norm", f"{tag}rec", "name_map", "addr_map")
    def _(rec, names, addresses):
        return normalize.normalize(rec, "rec_idx", names, addresses).join(rec.select("rec_idx", "country", "src"), "rec_idx")

    def embedded(norm: DataFrame, key: str) -> DataFrame:
        return embed(normalize.texts_for_embedding(norm, key), "text", as_array=True).join(norm.select(key, "country"), key).select(key, "country", "embedding")

    run.stage(f"{tag}s1_emb", f"{tag}s1_norm")(lambda norm: embedded(norm, "s1_idx"))
    run.stage(f"{tag}rec_emb", f"{tag}rec_norm")(lambda norm: embedded(norm, "rec_idx"))

    @run.stage(f"{tag}candidates", f"{tag}s1_emb", f"{tag}rec_emb", f"{tag}s1_norm", f"{tag}rec_norm")
    def _(s1e, rece, s1n, recn):
        dense = blocking.dense_candidates(s1e, rece, c.k_rec, c.k_s1)
        lex = blocking.lexical_candidates(blocking.lexical_keys(s1n, "s1_idx"), blocking.lexical_keys(recn, "rec_idx"), c.max_block)
        both = blocking.add_lexical(dense, lex, s1e, rece)
        return decision.prune(both.where("not lex"), c.k_rec, c.k_s1).unionByName(both.where("lex")).drop("lex")

    @run.stage(f"{tag}pair_features", f"{tag}candidates", f"{tag}s1_norm", f"{tag}rec_norm")
    def _(cand, s1n, recn):
        f1 = features.name_frequencies(s1n, recn, "s1_idx", "s1_name_freq", "n_rec_same")
        f2 = features.name_frequencies(recn, s1n, "rec_idx", "rec_name_freq", "n_s1_same")
        return features.context_features(features.pair_features(cand, s1n, recn, f1, f2))

    @run.stage(f"{tag}words", f"{tag}candidates", f"{tag}s1_norm", f"{tag}rec_norm")
    def _(cand, s1n, recn):
        return wordfeat.long_words(wordfeat.differing_words(cand, s1n, recn))


def _training_stages(run: Run, c: Settings) -> None:
    """Labels, words' log-odds, and the models A, B and C by cross-fit, each with what it predicts out of fold."""

    @run.stage("labels", "candidates", "truth", "folds")
    def _(cand, truth, folds):
        return models.labelled(cand.select(*KEYS), truth, folds)

    @run.stage("word_counts", "words", "labels")
    def _(words, labels):
        return wordfeat.word_counts(words, labels)

    def prior(labels: DataFrame) -> float:
        return labels.agg(F.avg("y")).first()[0] or 0.0

    run.stage("word_odds", "word_counts", "labels")(lambda counts, labels: wordfeat.log_odds(counts, prior(labels)))

    @run.stage("features", "pair_features", "words", "labels", "word_counts")
    def _(feat, words, labels, counts):
        p = prior(labels)
        run.kept["transfer"] = fitted = wordfeat.fit_transfer(wordfeat.fit_table(counts, p, c.holdout, min_n=c.min_count))
        return wordfeat.word_features(feat, words.join(labels, KEYS), wordfeat.out_of_fold_log_odds(counts, p), wordfeat.transferred(words, fitted))

    def crossed(out: str):
        def make(df: DataFrame, labels: DataFrame) -> DataFrame:
            names = models.feature_columns(df)
            scored, _, fitted = models.cross_fit(df.join(labels, KEYS), names, c.n_folds, out, c.learner, c.s1_fraction)
            models.save_models(fitted, f"{run.folder}/models_{out}")
            run.kept[out] = fitted, names
            return scored.select(*KEYS, out)

        return make

    run.stage("pred_a", "features", "labels")(crossed("pA"))
    run.stage("features_b", "features", "pred_a")(lambda feat, pa: features.consensus_features(feat.join(pa, KEYS), "pA"))
    run.stage("pred_b", "features_b", "labels")(crossed("pB"))

    @run.stage("pair_scores", "pred_a", "labels", "s1", "rec")
    def _(pa, labels, s1, rec):
        band = models.pair_texts(models.uncertain(pa, "pA", *c.band), s1, rec).join(labels, KEYS)
        run.kept["scorers"] = scorers = models.cross_scorers(band)
        return models.cross_score(band, scorers).select(*KEYS, "ce")

    run.stage("features_c", "features_b", "pair_scores")(models.with_scores)
    run.stage("pred_c", "features_c", "labels")(crossed("pC"))


def _decision_stages(run: Run, c: Settings) -> None:
    """The best rule for each model on the holdout; a later model replaces an earlier one only where it is strictly better."""

    def decided(tag: str):
        def make(pred, truth, folds):
            hold = folds.where(F.col("fold") == c.holdout)
            run.kept[f"rule_{tag}"] = best = decision.tune(pred, f"p{tag.upper()}", truth, hold, c.margins, c.taus, c.misses)[0]
            chosen = decision.decide(pred, f"p{tag.upper()}", best)
            return chosen.select(*KEYS).withColumns({"rule": F.lit(best["method"]), "holdout_f05": F.lit(best["macro_f05"])})

        return make

    for tag in "abc":
        run.stage(f"links_{tag}", f"pred_{tag}", "truth", "folds")(decided(tag))

    @run.stage("links", "links_a", "links_b", "links_c")
    def _(*links):
        run.kept["best"] = best = max("abc", key=lambda tag: run.kept[f"rule_{tag}"]["macro_f05"] or 0.0)
        return links["abc".index(best)]

    run.stage("report", "links", "truth", "s1")(lambda links, truth, s1: macro(per_entity(links, truth, s1)))


def _prediction_stages(run: Run, c: Settings) -> None:
    """Links of the new tables by what the training has fitted: means of all folds' models, and the chosen rule."""

    @run.stage("new_features", "new_pair_features", "new_words", "word_odds", "features")
    def _(feat, words, odds, _):
        return wordfeat.word_features(feat, words, odds, wordfeat.transferred(words, run.kept["transfer"]))

    def mean_of(out: str):
        def make(feat: DataFrame, _: DataFrame) -> DataFrame:
            fitted, names = run.kept[out]
            return models.mean_prediction(fitted, feat, names, out).select(*KEYS, out)

        return make

    run.stage("new_pred_a", "new_features", "pred_a")(mean_of("pA"))
    run.stage("new_features_b", "new_features", "new_pred_a")(lambda feat, pa: features.consensus_features(feat.join(pa, KEYS), "pA"))
    run.stage("new_pred_b", "new_features_b", "pred_b")(mean_of("pB"))

    @run.stage("new_pair_scores", "new_pred_a", "new_s1", "new_rec", "pair_scores")
    def _(pa, s1, rec, _):
        return models.cross_score(models.pair_texts(models.uncertain(pa, "pA", *c.band), s1, rec), run.kept["scorers"]).select(*KEYS, "ce")

    run.stage("new_features_c", "new_features_b", "new_pair_scores")(models.with_scores)
    run.stage("new_pred_c", "new_features_c", "pred_c")(mean_of("pC"))

    @run.stage("new_links", "new_pred_a", "new_pred_b", "new_pred_c", "links")
    def _(*tables):
        best = run.kept["best"]
        return decision.decide(tables["abc".index(best)], f"p{best.upper()}", run.kept[f"rule_{best}"]).select(*KEYS)

    run.stage("new_lists", "new_s1", "new_rec", "new_links")(prepare.export_lists)
    run.stage("new_candidate_lists", "new_s1", "new_rec", "new_candidates")(lambda s1, rec, cand: prepare.export_lists(s1, rec, cand, "candidate_entity_ids"))
    run.stage("new_checks", "new_lists", "new_s1", "new_rec")(prepare.check_lists)
