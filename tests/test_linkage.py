import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsmith.operators import blocking, encode, features, mining, models, normalize, prepare, sampling, wordfeat
from kinsmith.plans.run import Run, Settings, export, linkage
from kinsmith.sources import tables as src


# ---- normal forms and maps
def test_normalize(spark):
    rows = [(1, "Acme Intl. L.L.C. & Co f/k/a Old Acme Ltd", "0025 bis Main Street Street, #7"), (2, None, None), (3, "Ltd Limited", "null"), (4, "श्री Foo Pvt", "x")]
    names = spark.createDataFrame([("intl", "international inc")], "tok string, to string")
    got = {r["k"]: r for r in normalize.normalize(spark.createDataFrame(rows, "k long, name string, address string"), "k", names).collect()}
    r = got[1]
    assert (r["name_core"], r["legal"], r["name_alt"], r["addr"], r["nums"]) == ("acme international and", "co inc llc", "old acme", "0025 main st 7", ["25", "7"])
    assert (got[2]["name_core"], got[2]["addr"], got[2]["nums"], got[2]["nonlatin"]) == ("", "", [], False)
    assert (got[3]["name_core"], got[3]["legal"], got[3]["addr"]) == ("", "ltd", "")
    assert (got[4]["name_core"], got[4]["nonlatin"], got[4]["legal"]) == ("shrii foo", True, "pvt")


def test_best_target_ties_and_limits(spark):
    pairs = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("b", "b"), ("b", "b"), ("c", "z")], "tok string, to string")
    assert [tuple(r) for r in mining.best_target(pairs, 2, 0.5).select("tok", "to", "count", "n", "share").collect()] == [("a", "x", 2, 4, 0.5)]


def test_name_map_aligns_by_position(spark):
    linked = spark.createDataFrame([(["shri", "ram"], ["श्री", "राम"])] * 2 + [(["x"], ["श्री", "राम"])], "n_s1 array<string>, n_rec array<string>")
    assert {(r["tok"], r["to"]) for r in mining.name_map(linked).collect()} == {("श्री", "shri"), ("राम", "ram")}


def test_address_map_needs_rare_variants(spark):
    linked = spark.createDataFrame([(["maharashtra", "1"], ["mh", "2"])] * 6 + [(["p", "q"], ["p"])] * 3, "a_s1 array<string>, a_rec array<string>")
    assert [(r["tok"], r["to"], r["count"]) for r in mining.address_map(linked).collect()] == [("mh", "maharashtra", 6)]


def test_components(spark):
    s1 = spark.createDataFrame([(1, "5 rue x, Île de France"), (2, "y, Île de France")], "s1_idx long, address string")
    rec = spark.createDataFrame([(1, "5 rue x, IDF"), (2, "y, I.D.F")], "rec_idx long, address string")
    links = spark.createDataFrame([(1, 1), (2, 2)], "s1_idx long, rec_idx long")
    found = mining.component_map(links, s1, rec, min_count=1, min_share=0.5)
    assert {(r["from"], r["to"]) for r in found.collect()} == {("idf", "ile de france"), ("i d f", "ile de france")}
    assert sorted(r["address"] for r in mining.apply_components(rec, "rec_idx", found).collect()) == ["5 rue x,ile de france", "y,ile de france"]


# ---- candidates
@pytest.mark.parametrize("plain", [0, 10**9])
def test_nearest_neighbours(spark, monkeypatch, plain):
    monkeypatch.setattr(blocking, "MOST_PLAIN", plain)
    monkeypatch.setattr(blocking, "QUERY_BLOCK", 8)
    monkeypatch.setattr(blocking, "BASE_BLOCK", 16)
    g = np.random.default_rng(1)
    x = np.round(g.normal(size=(90, 6)), 1)
    x[10:20] = x[10]
    side = lambda ids, key: spark.createDataFrame([(int(i), int(i % 2), [float(v) for v in x[i]]) for i in ids], f"{key} long, country int, embedding array<double>")
    got = blocking.nearest(side(range(0, 40), "rec_idx"), side(range(10, 90), "s1_idx"), "rec_idx", "s1_idx", 3, "rank_r").collect()
    want = set()
    for q in range(40):
        best = sorted((-round(float(x[q] @ x[b]), 9), b) for b in range(10, 90) if b % 2 == q % 2)[:3]
        want |= {(q, b, n) for n, (_, b) in enumerate(best)}
    assert {(r["rec_idx"], r["s1_idx"], r["rank_r"]) for r in got} == want


def test_lexical_blocks_and_their_limit(spark):
    norm = lambda rows, key: blocking.lexical_keys(spark.createDataFrame(rows, f"{key} long, country string, name_core string, addr string, nums array<string>"), key)
    s = norm([(i, "X", "same name", f"{i} longword st", [str(i)]) for i in range(5)] + [(9, "X", "ab", "", [])], "s1_idx")
    r = norm([(1, "X", "same name", "", []), (2, "X", "zz", "3 longword", ["3"]), (3, "X", "same z", "", ["4"]), (4, "Y", "same name", "", []), (5, "X", "ab", "", [])], "rec_idx")
    pairs = lambda n: {(p["rec_idx"], p["s1_idx"]) for p in blocking.lexical_candidates(s, r, n).collect()}
    assert pairs(50) == {(1, i) for i in range(5)} | {(2, 3), (3, 4)}
    assert pairs(4) == {(2, 3), (3, 4)}


@pytest.mark.parametrize("size", [3, 2**21])
def test_pairs_of_kinds_are_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(blocking, "KEY_RANGE", size)
    rows = [(i, i % 2, "xyz"[i % 3 % (1 + i % 4)]) for i in range(30)] + [(40, None, "x"), (41, 5, None), (42, 5, "x")]
    df = spark.createDataFrame(rows, "k long, g int, name string").withColumn("fold", F.col("k") % 5)
    pairs = blocking.spelled_out(blocking.pairs_of_kinds(df, "k", ["g"], ["name"], ["fold"]), "a", "b")
    want = [(a, b, x, y, a % 5) for a, g, x in rows for b, h, y in rows if g is not None and g == h and a < b]
    assert sorted(map(str, map(tuple, pairs.select("a", "b", "a_name", "b_name", "a_fold").collect()))) == sorted(map(str, want))


# ---- features
def test_context_and_consensus_features(spark):
    r = random.Random(4)
    rows = [(rec, s, r.random(), r.random() * 100, r.random() * 100, float(r.randrange(2)), float(r.randrange(2))) for rec in range(20) for s in r.sample(range(8), 3)]
    df = spark.createDataFrame(rows, "rec_idx long, s1_idx long, cos double, nm_tset double, ad_tset double, num_first_eq double, ad_empty_b double")
    got = {(x["rec_idx"], x["s1_idx"]): x for x in features.consensus_features(features.context_features(df), "cos").collect()}
    for rec, s, p, nm, _, num, _ in rows:
        x, mine, theirs = got[rec, s], [v for v in rows if v[0] == rec], [v for v in rows if v[1] == s]
        ps = sorted((v[2] for v in mine), reverse=True)
        assert x["r_n"] == 3 and x["s_n"] == len(theirs) and abs(x["r_nm_gap"] - (max(v[3] for v in mine) - nm)) < 1e-9
        assert x["rb_second"] == ps[1] and x["rb_rank"] == ps.index(p) + 1
        assert abs(x["rb_gap"] - (p - ps[1] if p == ps[0] else p - ps[0])) < 1e-12
        others = [v for v in theirs if v[0] != rec]
        if others:
            assert abs(x["peer_num"] - sum(v[2] * v[5] for v in others) / sum(v[2] for v in others)) < 1e-6
            assert abs(x["peer_num_diff"] - (num - x["peer_num"])) < 1e-12


def test_pair_features_have_their_columns(spark):
    base = [(1, "Acme Corp", "12 Main Road", "X"), (2, "Other", "", "X")]
    s = normalize.normalize(spark.createDataFrame(base, "s1_idx long, name string, address string, country string"), "s1_idx").withColumn("country", F.lit("X"))
    r = normalize.normalize(spark.createDataFrame([(7, "Acme f/k/a Foo", "12b Main Rd", "X"), (8, None, None, "X")], "rec_idx long, name string, address string, country string"), "rec_idx").withColumns({"country": F.lit("X"), "src": F.lit(3)})
    pairs = spark.createDataFrame([(1, 7, 0.5, 0, 255), (2, 8, 0.1, 1, 2)], "s1_idx long, rec_idx long, cos double, rank_r int, rank_s int")
    f = features.pair_features(pairs, s, r, features.name_frequencies(s, r, "s1_idx", "s1_name_freq", "n_rec_same"), features.name_frequencies(r, s, "rec_idx", "rec_name_freq", "n_s1_same"))
    assert len(models.feature_columns(f)) == 50
    a, b = f.orderBy("s1_idx").collect()
    assert (a["nm_eq"], a["nm_ratio"], a["legal_a_empty"], a["legal_b_empty"], a["num_first_eq"], a["num_a0_in_b"], a["ad_alpha_inter"], a["src3"], a["n_rec_same"]) == (1, 100, 0, 1, 1, 1, 1, 1, 1)
    assert (b["ad_empty_b"], b["nm_tset"], b["num_n_a"], b["num_first_eq"], b["nm_alt_ratio"], b["ad_ntok_b"]) == (1, 0, 0, 0, 0, 0)


def test_word_features(spark):
    name = lambda rows, key: spark.createDataFrame(rows, f"{key} long, name_core string")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "s1_idx long, rec_idx long")
    d = wordfeat.differing_words(pairs, name([(1, "a b")], "s1_idx"), name([(1, "a c d e f g"), (2, "a b")], "rec_idx"))
    words = wordfeat.long_words(d)
    assert sorted((r["kind"], r["tok"]) for r in words.collect()) == [("extra", "c"), ("extra", "d"), ("extra", "e"), ("extra", "f"), ("miss", "b")]
    scores = spark.createDataFrame([("extra", "c", 0.5), ("extra", "d", -1.0)], "kind string, tok string, lo double")
    out = {r["rec_idx"]: r for r in wordfeat.word_features(pairs, words, scores, wordfeat.transferred(words, {})).collect()}
    assert (out[1]["wf_ex_n"], out[1]["wf_ex_lo_min"], out[1]["wf_ex_lo_max"], out[1]["wf_ms_n"], out[1]["wf_ms_lo_min"]) == (4, -1.0, 0.5, 1, None)
    assert (out[2]["wf_ex_n"], out[2]["wf_ex_emb_min"]) == (0, None)


# ---- folds, samples, models
def test_folds_are_even_within_strata(spark):
    s1 = spark.createDataFrame([(i, "XY"[i % 2]) for i in range(200)], "s1_idx long, country string")
    truth = spark.createDataFrame([(i, j) for i in range(0, 200, 3) for j in range(i % 9)], "s1_idx long, rec_idx long")
    f = sampling.folds(s1, truth, 5)
    n = f.groupBy("stratum", "fold").count().groupBy("stratum").agg(F.max("count").alias("hi"), F.min("count").alias("lo"), F.count("*").alias("k"))
    assert f.count() == 200 and all(r["hi"] - r["lo"] <= 1 for r in n.collect() if r["k"] == 5)
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, sampling.folds(s1.repartition(9), truth, 5).collect()))


def test_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "s1_idx")
    a = {r[0] for r in sampling.exact_sample(df, 30, ["s1_idx"], 1).collect()}
    assert len(a) == 30 and a == {r[0] for r in sampling.exact_sample(df.repartition(5), 30, ["s1_idx"], 1).collect()}
    assert sampling.exact_sample(df, 1000, ["s1_idx"], 1).count() == 100
    pairs = df.select("s1_idx", F.explode(F.array(F.lit(1), F.lit(2))).alias("rec_idx"))
    kept = sampling.key_sample(pairs, 0.4, "s1_idx", 3).groupBy("s1_idx").count().collect()
    assert 15 < len(kept) < 65 and all(r["count"] == 2 for r in kept)


def labelled_pairs(spark, n=400):
    r = random.Random(5)
    rows = [(i % 40, i, x := r.random(), r.random(), int(x + r.gauss(0, 0.1) > 0.6), i % 40 % 3) for i in range(n)]
    return spark.createDataFrame(rows, "s1_idx long, rec_idx long, a double, b double, y int, fold int")


@pytest.mark.parametrize("learner", [models.logistic_learner(), models.gbt_learner(3, 2)])
def test_cross_fit_scores_all_rows_once_and_well(spark, learner):
    df = labelled_pairs(spark).withColumn("a", F.when(F.col("rec_idx") % 17 != 0, F.col("a")))  # some are missing
    out, others, fitted = models.cross_fit(df, ["a", "b"], 3, "p", learner, others=df.drop("y", "fold"))
    assert out.count() == others.count() == 400 and out.select("rec_idx").distinct().count() == 400 and len(fitted) == 3
    from kinsmith.operators.evaluation import auc

    assert auc(out, "y", "p").first()[0] > 0.85


def test_no_model_sees_its_fold(spark):
    seen = []

    def learner(df):
        seen.append({r["fold"] for r in df.where("not valid").select("fold").distinct().collect()})
        return models.logistic_learner()(df)

    models.cross_fit(labelled_pairs(spark), ["a", "b"], 3, "p", learner)
    assert seen == [{0, 1, 2} - {k} for k in range(3)]


def test_cross_scores_use_the_other_half(spark):
    df = spark.createDataFrame([(i, i, "abc" if i % 2 else "xyz", "abc", i % 2, i % 5) for i in range(60)], "s1_idx long, rec_idx long, text_a string, text_b string, y int, fold int")
    scorers = models.cross_scorers(df, lambda: models.TextPairScorer(64))
    a, b = ({r["rec_idx"]: r["s"] for r in scorers[h].score(df, "s").collect()} for h in "ab")
    for r in models.cross_score(df, scorers).collect():
        want = b[r["rec_idx"]] if r["fold"] in (1, 2) else a[r["rec_idx"]] if r["fold"] in (3, 4) else (a[r["rec_idx"]] + b[r["rec_idx"]]) / 2
        assert abs(r["ce"] - want) < 1e-9


def test_weights_stand_for_repeated_rows(spark):
    rows = [(f"{'abc'[i % 3]}lpha {i % 5}", f"{'abd'[i % 4 % 3]}lpha {i % 2}", int(i % 7 < 3), 1 + i * i % 6) for i in range(40)]
    df = spark.createDataFrame(rows, "text_a string, text_b string, y int, n long")
    each = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    got, want = (sorted(r["s"] for r in x.score(df, "s").collect()) for x in (models.TextPairScorer(64).fit(df, "n"), models.TextPairScorer(64).fit(each)))
    assert np.allclose(got, want, atol=1e-4)
    from kinsmith.operators.evaluation import auc

    scored = df.withColumn("s", F.length("text_a") * 1.0 + F.col("n") % 3)
    repeated = scored.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert abs(auc(scored, "y", "s", "n").first()[0] - auc(repeated, "y", "s").first()[0]) < 1e-12


def test_pseudo_labels_and_updates(spark):
    rows = [(1, 1, 0.999, 0.0), (2, 1, 0.01, 0.9), (3, 2, 0.999, 0.0), (4, 2, 0.2, 0.0), (5, 3, 0.996, 0.1)]
    df = spark.createDataFrame(rows, "s1_idx long, rec_idx long, p double, cos double")
    assert {tuple(r) for r in models.pseudo_labels(df, "p").collect()} == {(1, 1, 1), (2, 1, 0), (5, 3, 1)}
    ce = df.select("s1_idx", "rec_idx", F.col("p").alias("ce"))
    assert {r["ce"] for r in models.updated(ce, ce.where("rec_idx = 1").withColumn("ce", F.lit(7.0))).collect()} == {7.0, 0.999, 0.2, 0.996}


def test_triplets(spark):
    s1 = spark.createDataFrame([(1, "X", "n"), (2, "X", "n"), (3, "X", "m"), (4, "Y", "n")], "s1_idx long, country string, name_core string")
    truth = spark.createDataFrame([(1, 10), (3, 11), (4, 12)], "s1_idx long, rec_idx long")
    got = {r["s1_idx"]: r for r in encode.triplets(truth, s1, 10, 1).collect()}
    assert (got[1]["neg_idx"], got[1]["twin"]) == (2, True) and got[3]["neg_idx"] in (1, 2) and not got[3]["twin"] and got[4]["neg_idx"] is None


# ---- tables
def sources(spark):
    cols = "entity_id string, name string, address string, country string"
    s1 = spark.createDataFrame([("S1_b", "n", "a", "X"), ("S1_a", "n", "a", "X"), ("S1_c", "n", "a", "Y")], cols)
    s2, s3 = spark.createDataFrame([("S2_1", "n", "a", "X")], cols), spark.createDataFrame([("S3_1", "n", "a", "X"), ("S3_2", "n", "a", "Y")], cols)
    return s1, s2, s3


def test_prepare_export_and_checks(spark):
    truth = spark.createDataFrame([("S1_a", "S3_1,S2_1"), ("S1_b", ""), ("S1_c", "S3_2")], "source1_entity_id string, matched_entity_ids string")
    s1, rec, links = prepare.prepare(*sources(spark), truth)
    assert [r["entity_id"] for r in s1.orderBy("s1_idx").collect()] == ["S1_a", "S1_b", "S1_c"]
    assert [(r["rec_idx"], r["entity_id"], r["src"]) for r in rec.orderBy("rec_idx").collect()] == [(0, "S2_1", 2), (1, "S3_1", 3), (2, "S3_2", 3)]
    lists = prepare.export_lists(s1, rec, links)
    assert {tuple(r) for r in lists.collect()} == {("S1_a", "S2_1,S3_1"), ("S1_b", ""), ("S1_c", "S3_2")}
    assert all(r["n"] == 0 for r in prepare.check_lists(lists, s1, rec).collect())
    bad = spark.createDataFrame([("S1_a", "S2_1,zz"), ("S1_x", "S2_1")], "source1_entity_id string, matched_entity_ids string")
    assert {r["check"]: r["n"] for r in prepare.check_lists(bad, s1, rec).collect()} == {"missing": 2, "unknown": 1, "repeated": 0, "unknown_ids": 1, "listed_twice": 1}


@pytest.mark.parametrize("row", [("S1_a", "nowhere"), ("S1_zz", "S2_1")])
def test_unknown_links_are_an_error(spark, row):
    with pytest.raises(src.ContractError, match="unknown"):
        prepare.prepare(*sources(spark), spark.createDataFrame([row], "source1_entity_id string, matched_entity_ids string"))


def test_twice_linked_records_are_an_error(spark):
    truth = spark.createDataFrame([("S1_a", "S2_1"), ("S1_b", "S2_1")], "source1_entity_id string, matched_entity_ids string")
    with pytest.raises(src.ContractError, match="more than once"):
        prepare.prepare(*sources(spark), truth)


def test_tsv_is_verbatim(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1_1\t"a\\ \t b"\t\nS1_2\tn\t\tX\n'.replace("\t b\"\t\n", "\t b\"\tY\n"), encoding="utf-8")
    got = [tuple(r) for r in src.read_source(spark, str(tmp_path / "x.tsv"), "S1_").orderBy("entity_id").collect()]
    assert got == [("S1_1", '"a\\ ', ' b"', "Y"), ("S1_2", "n", "", "X")]
    with pytest.raises(src.ContractError, match="prefix"):
        src.read_source(spark, str(tmp_path / "x.tsv"), "S2_")
    with pytest.raises(src.ContractError, match="rows"):
        src.read_source(spark, str(tmp_path / "x.tsv"), "S1_", 3)


def test_row_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(500)], "x double, k int").repartition(6)
    got = [tuple(r) for r in src.with_row_index(df, "i", ["x", "k"]).orderBy("i").select("i", "x").collect()]
    assert [i for i, _ in got] == list(range(500)) and [x for _, x in got] == sorted(x for _, x in got)


def test_rank_within_groups_of_any_size(spark):
    r = random.Random(8)
    rows = [(r.choice([None, "a", "b", "b", "b"]), r.randrange(50), i) for i in range(600)]
    got = src.with_rank(spark.createDataFrame(rows, "g string, x int, k int").repartition(5), "i", ["x", "k"], ["g"]).collect()
    assert len(got) == 600
    for g in (None, "a", "b"):
        own = sorted((x, k) for a, x, k in rows if a == g)
        assert [(v["x"], v["k"]) for v in sorted((v for v in got if v["g"] == g), key=lambda v: v["i"])] == own


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "/data")
    (tmp_path / "c.yaml").write_text("paths: {data: $PLACE/x}\nmodel: {flag: true, n: 3, f: 0.5}\n")
    c = src.load_config(tmp_path / "c.yaml", ["model.flag=false", "model.n=7"])
    assert c == {"paths": {"data": "/data/x"}, "model": {"flag": False, "n": 7, "f": 0.5}}
    with pytest.raises(KeyError):
        src.load_config(tmp_path / "c.yaml", ["model.zz=1"])


# ---- the run
def test_order_follows_from_what_stages_read(spark, tmp_path):
    run = Run(spark, str(tmp_path), tables={"in": spark.range(3)})
    run.stage("c", "b", "a")(lambda b, a: b.join(a, "id"))
    run.stage("b", "a")(lambda a: a.where("id > 0"))
    run.stage("a", "in")(lambda x: x)
    assert run.order(["c"]) == ["a", "b", "c"] and run("c").count() == 2 and set(run.seconds) == {"a", "b", "c"}
    assert run.order(["c"]) == []
    run.stage("x", "y")(lambda y: y)
    run.stage("y", "x")(lambda x: x)
    with pytest.raises(Exception, match="cycle"):
        run.order(["x"])
    with pytest.raises(KeyError):
        run.order(["nothing"])


def test_linkage_finds_links(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfgmnprst") + r.choice("aeiou") for _ in range(3))
    s1 = [(i, f"{word()} {word()} Inc", f"{r.randrange(1, 99)} {word()} Road, {word()}", "XY"[i % 2]) for i in range(60)]
    rec, links = [], []
    for i, name, address, country in s1:
        for _ in range(i % 3):
            k = len(rec)
            rec.append((k, name.replace(" Inc", r.choice(["", " Incorporated"])), address.replace("Road", "Rd"), country, 2))
            links.append((i, k))
    for _ in range(30):
        rec.append((len(rec), f"{word()} {word()}", f"{r.randrange(99)} {word()} Street", r.choice("XY"), 3))
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    run = linkage(spark, str(tmp_path), t(s1, "s1_idx long, name string, address string, country string"), t(rec, "rec_idx long, name string, address string, country string, src int"), t(links, "s1_idx long, rec_idx long"), Settings(n_folds=3, taus=(0.5,), margins=(0.0,), misses=(0.0,)))
    found = {(x["s1_idx"], x["rec_idx"]) for x in run("links_b").collect()}
    assert len(found & set(links)) >= 0.9 * len(links) and len(found - set(links)) <= 0.1 * len(links)


def _companies(spark, seed, first=0):
    """Entities, records of theirs with typos, moved legal forms and cut addresses, and namesakes elsewhere."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfgmnprst") + r.choice("aeiou") for _ in range(3))
    typo = lambda w: w[: (k := r.randrange(len(w)))] + w[k + 1 :] if len(w) > 4 and r.random() < 0.3 else w
    s1, rec, links = [], [], []
    for i in range(first, first + 90):
        a, b, street, town = word(), word(), word(), word()
        number, country = r.randrange(1, 99), "XY"[i % 2]
        s1.append((i, f"S1-{i}", f"{a} {b} Inc", f"{number} {street} Road, {town}", country))
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            k = first + len(rec)
            rec.append((k, f"S2-{k}", f"{typo(a)} {typo(b)}{r.choice(('', ' Incorporated', ' inc.'))}", f"{number} {typo(street)} Rd{r.choice(('', f', {town}'))}", country, 2))
            links.append((i, k))
        if r.random() < 0.3:
            rec.append((first + len(rec), f"S3-{first + len(rec)}", f"{a} {word()}", f"{r.randrange(1, 99)} {word()} Street, {town}", country, 3))
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return t(s1, "s1_idx long, entity_id string, name string, address string, country string"), t(rec, "rec_idx long, entity_id string, name string, address string, country string, src int"), t(links, "s1_idx long, rec_idx long")


def test_new_tables_are_linked_checked_and_exported(spark, tmp_path):
    s1, rec, truth = _companies(spark, 7)
    new_s1, new_rec, new_truth = _companies(spark, 8, first=1000)
    run = linkage(spark, str(tmp_path / "run"), s1, rec, truth, Settings(n_folds=5, taus=(0.5,), margins=(0.0,), misses=(0.0,)), new=(new_s1, new_rec))
    export(run, str(tmp_path / "out"))
    assert {r["check"]: r["n"] for r in run("new_checks").collect()} == dict.fromkeys(("missing", "unknown", "repeated", "unknown_ids", "listed_twice"), 0)
    want = {(f"S1-{a}", f"S2-{b}") for a, b in map(tuple, new_truth.collect())}
    lists = src.read_tsv(spark, str(tmp_path / "out" / "lists"), ["source1_entity_id", "matched_entity_ids"]).collect()
    assert len(lists) == 90
    found = {(r[0], x) for r in lists for x in r[1].split(",") if x}
    assert len(found & want) >= 0.85 * len(want) and len(found - want) <= 0.1 * len(want)
    candidates = {(r[0], x) for r in src.read_tsv(spark, str(tmp_path / "out" / "candidate_lists"), ["source1_entity_id", "candidate_entity_ids"]).collect() for x in r[1].split(",") if x}
    assert found <= candidates
    saved = models.load_models(type(run.kept["pA"][0][0]), f"{run.folder}/models_pA", 5)
    again = models.mean_prediction(saved, run("new_features"), run.kept["pA"][1], "pA").select("s1_idx", "rec_idx", "pA")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, run("new_pred_a").collect()))


def test_a_run_makes_what_its_targets_need(spark, tmp_path):
    s1, rec, truth = _companies(spark, 7)
    order = linkage(spark, str(tmp_path), s1, rec, truth, new=(s1, rec)).order
    assert not any(n.startswith("new_") for n in order(["report"]))
    assert not any(n.startswith(("pred", "features", "links")) for n in order(["new_candidates"]))
    assert {"pred_a", "new_pred_c", "links", "new_lists"} <= set(order(["new_checks"]))
