import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from kinsmith.operators import blocking, models
from kinsmith.plans.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that fit models by fold take long; the linkage tests cover them.
SLOW = {"run1_linkage", "trn1_train_a_then_b", "mdl3_cross_fit_gbt", "adp1_self_training", "prd1_mean_of_folds", "prd2_mean_of_folds_with_scores"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf), con.sql(SQL[name])
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    rows = lambda data, names: sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in data)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """80 parts of one brand and size with four names."""
    folder = str(tmp_path_factory.mktemp("copies"))
    rows = [(i, ("red nut", "red bolt", "blue nut", "blue bolt")[i * i % 7 % 4], "b", 1) for i in range(80)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["adp1_self_training", "crs3_text_pair_scorer", "crs4_cross_scores"])
def test_scorers_read_each_pair_of_texts_once_a_fold(spark, copies, monkeypatch, name):
    read, fit = [], models.TextPairScorer.fit
    monkeypatch.setattr(models.TextPairScorer, "fit", lambda self, df, *more: (read.append(df.count()), fit(self, df, *more))[1])
    got = {(r["s1_idx"], r["rec_idx"]): r["ce"] for r in QUERIES[name](spark, copies).collect()}
    assert set(got) == {(a, b) for a in range(80) for b in range(a + 1, 80)}
    assert read[0] <= 4 * 4 * 5


@pytest.mark.parametrize("name", ["crs3_text_pair_scorer", "crs4_cross_scores"])
def test_pairs_of_texts_are_spelled_out_once_and_few_are_fitted_in_one_task(spark, copies, monkeypatch, name):
    """For the result alone: the pairs that a kind stands for are counted without them."""
    spelled, tasks, out, fit = [], [], blocking.spelled_out, models.LogisticRegression.fit
    monkeypatch.setattr(blocking, "spelled_out", lambda *a: (spelled.append(1), out(*a))[1])
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, df: (tasks.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    assert QUERIES[name](spark, copies).count() == 80 * 79 // 2
    assert len(spelled) == 1 and set(tasks) == {1}


def test_counted_pairs_equal_those_spelled_out(spark, monkeypatch):
    """Also of keys below 0, in several ranges, and of kinds without a pair."""
    monkeypatch.setattr(blocking, "KEY_RANGE", 8)
    rows = [(k * k * 5 % 97 - 40 + 8 * (k % 7), "xy"[k % 2], "abc"[k % 3], k % 5) for k in range(60)]
    df = spark.createDataFrame(sorted({r[0]: r for r in rows}.values()), "key long, grp string, name string, fold int")
    pairs = blocking.pairs_of_kinds(df, "key", ["grp"], ["name"], ["fold"])
    kind = ["a_name", "a_fold", "b_name"]
    # the function on whole lists runs in this process, where the small range holds
    met = [(tuple(r[c] for c in kind), r["a_keys"], r["b_keys"]) for r in pairs.collect()]
    got = Counter()
    for (key, *_), n in zip(met, blocking._pairs_in_order.func(*(pa.array([m[i] for m in met], pa.list_(pa.int64())) for i in (1, 2))).to_pylist(), strict=True):
        got[key] += n
    data = [(r["key"], r["grp"], r["name"], r["fold"]) for r in df.collect()]
    assert +got == Counter((x[2], x[3], y[2]) for x in data for y in data if x[0] < y[0] and x[1] == y[1])


@pytest.mark.parametrize("name", ["sim1_ratio", "sim2_token_set_ratio", "sim3_token_sort_ratio", "sim4_partial_ratio", "sim5_partial_token_set_ratio"])
def test_names_are_compared_before_pairs_are_spelled_out(spark, copies, name):
    got = QUERIES[name](spark, copies)
    assert got.count() == 80 * 79 // 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and plan.rindex("Generate") < plan.index("ArrowEvalPython")


@pytest.mark.parametrize("name", ["sim2_token_set_ratio", "sim3_token_sort_ratio", "sim4_partial_ratio", "sim5_partial_token_set_ratio"])
def test_keys_far_apart_are_compared_no_more_often(spark, tmp_path, monkeypatch, name):
    """Keys a billion apart are of the same few kinds: lists are cut by their length, not by the keys' numbers."""
    rows, read, out = [(k * 10**9, ("red nut", "red bolt", "blue nut")[k % 3], "b", 1) for k in range(-20, 20)], [], blocking.spelled_out
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(blocking, "spelled_out", lambda pairs, *more: (read.append(pairs.count()), out(pairs, *more))[1])
    got = {(r["a"], r["b"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]} and read == [9]


@pytest.mark.parametrize("name", ["sim3_token_sort_ratio", "sim4_partial_ratio", "sim5_partial_token_set_ratio"])
def test_a_frequent_name_is_spelled_out_in_pieces(spark, tmp_path, monkeypatch, name):
    """All pairs of two lists are in memory at once, so lists are short however many parts have a name."""
    most, out = [], blocking.spelled_out
    spark.range(1100).selectExpr("id p_partkey", "'red nut' p_name", "'b' p_brand", "1 p_size").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(blocking, "spelled_out", lambda pairs, *more: (most.append(pairs.selectExpr("max(size(a_keys) * size(b_keys))").first()[0]), out(pairs, *more))[1])
    got = QUERIES[name](spark, str(tmp_path))
    assert got.selectExpr("count(*)", "count(distinct a, b)", "sum(int(a < b))", "min(score)").first() == (*[1100 * 1099 // 2] * 3, 100.0)
    assert most[0] <= 2**18


def test_component_map_of_twins_in_several_languages(spark, con, tmp_path):
    """Copies of one text, of any language and source, also without one."""
    rows = [(i, "same", ("en", "fr", None)[i % 3], ("src1", "news", None)[i % 4 % 3]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = con.cursor()
    c.execute(f"create temp table documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in QUERIES["geo1_component_map"](spark, str(tmp_path)).collect()] == c.execute(SQL["geo1_component_map"]).fetchall()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    """A copy without that subpackage and the pipeline still imports, with all other queries."""
    import shutil

    shutil.copytree(ROOT / "kinsmith", tmp_path / "kinsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[-2:] == [str(len(QUERIES)), "False"]


def test_nothing_else_imports_the_training_data_operators():
    found = [p for p in (ROOT / "kinsmith").rglob("*.py") if "llm" not in p.parts and "kinsmith.llm" in p.read_text()]
    assert found == []
