"""Evaluation, decision, competition, blocking and sampling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.operators import blocking, decision, evaluation, features, models, sampling
from kinsmith.plans.catalog import ROLES, Tables, query
from kinsmith.sources.tables import shared_folder

_W = f"with {ROLES}"
_EX = """, ranked as (select *, row_number() over (partition by rec_idx order by p desc, s1_idx) rk, lead(p) over (partition by rec_idx order by p desc, s1_idx) nx from cand),
ex as (select rec_idx, s1_idx, p from ranked where rk = 1 and p - coalesce(nx, -1) >= 0.1::double)"""
_PRED = """, pred as (select s1_idx, rec_idx from ex where p >= 0.7::double)"""
_PE = """, pc as (select s1_idx, count(*) n_pred from pred group by 1), tc as (select s1_idx, count(*) n_true from truth group by 1),
hc as (select s1_idx, count(*) tp from pred join truth using (s1_idx, rec_idx) group by 1),
pe0 as (select s1_idx, country, coalesce(n_pred, 0) n_pred, coalesce(n_true, 0) n_true, coalesce(tp, 0) tp from s1 left join pc using (s1_idx) left join tc using (s1_idx) left join hc using (s1_idx)),
pe as (select *, n_pred - tp fp, n_true - tp fn, case when 1.25 * tp + 0.25 * (n_true - tp) + (n_pred - tp) > 0
  then (1.25 * tp)::double / (1.25 * tp + 0.25 * (n_true - tp) + (n_pred - tp))::double else 1.0::double end f05 from pe0)"""


def _predicted(t: Tables) -> DataFrame:
    return decision.threshold(decision.exclusive(t.candidates(), "p", 0.1), "p", 0.7)


def _entities(t: Tables) -> DataFrame:
    return evaluation.per_entity(_predicted(t), t.truth(), t.s1())


@query("agg11_per_entity_f05", f"{_W}{_EX}{_PRED}{_PE} select s1_idx, n_pred, n_true, tp, fp, fn, round(f05, 6) f05 from pe")
def _(t):
    return _entities(t)


@query("agg12_macro_report", f"{_W}{_EX}{_PRED}{_PE} select round(avg(f05), 6) macro_f05, round(sum(tp)::double / greatest(sum(n_pred), 1), 6) pair_precision, round(sum(tp)::double / greatest(sum(n_true), 1), 6) pair_recall, round(avg(case when n_true = 0 then (n_pred = 0)::int::double end), 6) singleton_acc, count(*) n_s1 from pe")
def _(t):
    return evaluation.macro(_entities(t))


@query("agg12_by_match_bucket", f"{_W}{_EX}{_PRED}{_PE} select case when n_true = 0 then '0' when n_true = 1 then '1' when n_true <= 3 then '2-3' else '4+' end bucket, round(avg(f05), 6) macro_f05, count(*) n_s1 from pe group by 1")
def _(t):
    return evaluation.by_bucket(_entities(t))


@query("agg12_by_country", f"{_W}{_EX}{_PRED}{_PE} select country::bigint country, round(avg(f05), 6) macro_f05, count(*) n_s1 from pe group by 1")
def _(t):
    return evaluation.by_partition(_entities(t), t.s1())


@query("evl1_evaluate_pairs", f"{_W}, pred as (select s1_idx, rec_idx from cand where p >= 0.75::double){_PE} select round(avg(f05), 6) macro_f05, count(*) n_s1 from pe")
def _(t):
    return evaluation.macro(evaluation.per_entity(decision.threshold(t.candidates(), "p", 0.75), t.truth(), t.s1())).select("macro_f05", "n_s1")


@query("dec1_exclusive", f"{_W}{_EX} select rec_idx, s1_idx, round(p, 6) p from ex")
def _(t):
    return decision.exclusive(t.candidates(), "p", 0.1).select("rec_idx", "s1_idx", "p")


@query("fil6_threshold", f"{_W} select rec_idx, s1_idx, round(p, 6) p from cand where p >= 0.6::double")
def _(t):
    return decision.threshold(t.candidates(), "p", 0.6).select("rec_idx", "s1_idx", "p")


# The distributions of true links among the first k candidates and among the others, as lists, step by step.
_DP = """, low as (select s1_idx, rec_idx, p, r from (select *, row_number() over (partition by s1_idx order by p desc, rec_idx) r from ex where p >= 0.01::double) where r <= 25),
size as (select s1_idx, count(*) n from low group by 1),
hit as (select s1_idx, 0::bigint k, [1::double] d from size union all select hit.s1_idx, k + 1, [coalesce(d[i], 0) * (1 - p) + coalesce(d[i - 1], 0) * p for i in range(1, len(d) + 2)] from hit join low on low.s1_idx = hit.s1_idx and r = k + 1),
rest as (select s1_idx, n k, [1::double] d from size union all select rest.s1_idx, k - 1, [coalesce(d[i], 0) * (1 - p) + coalesce(d[i - 1], 0) * p for i in range(1, len(d) + 2)] from rest join low on low.s1_idx = rest.s1_idx and r = k),
a as (select s1_idx, k, unnest(d) pa, generate_subscripts(d, 1) - 1 a from hit), b as (select s1_idx, k, unnest(d) pb, generate_subscripts(d, 1) - 1 b from rest),
e as (select s1_idx, k, sum(case when k = 0 then (case when b = 0 then pb else 0 end) when a = 0 then 0 else pa * pb * (1.25::double * a) / (1.25::double * a + 0.25::double * b + (k - a)) end) e from a join b using (s1_idx, k) group by 1, 2),
pick as (select s1_idx, min(k) k from (select *, max(round(e, 10)) over (partition by s1_idx) m from e) where round(e, 10) = m group by 1)
select low.s1_idx, rec_idx, round(p, 6) p from low join pick using (s1_idx) where r <= k"""


@query("dec2_expected_f05", f"with recursive {ROLES}{_EX}{_DP}")
def _(t):
    own = decision.exclusive(t.candidates(), "p", 0.1).where("p >= 0.01")
    return decision.expected_f05(own, "p").select("s1_idx", "rec_idx", "p")


_PICK = _DP.split("\nselect low.s1_idx, rec_idx")[0]


@query("mth5_best_prefix", f"with recursive {ROLES}{_EX}{_PICK} select s1_idx, k from pick where k > 0")
def _(t):
    """How many candidates of each entity are worth taking, by the distribution of its true links."""
    own = decision.exclusive(t.candidates(), "p", 0.1).where("p >= 0.01")
    return decision.expected_f05(own, "p").groupBy("s1_idx").agg(F.count(F.lit(1)).alias("k"))


@query("dec2_expected_f05_with_misses")
def _(t):
    return decision.expected_f05(t.candidates(), "p", miss=0.05).select("s1_idx", "rec_idx", "p")


_GRID = f"""{_W}{_EX.split(", ex as")[0].split(",\nex as")[0]}, rules as (select margin, tau from (values (0.0::double), (0.2::double)) m(margin), (values (0.6::double), (0.8::double)) u(tau)),
pred as (select margin, tau, s1_idx, rec_idx from ranked, rules where rk = 1 and p - coalesce(nx, -1) >= margin and p >= tau),
pc as (select margin, tau, s1_idx, count(*) n_pred from pred group by all), hc as (select margin, tau, s1_idx, count(*) tp from pred join truth using (s1_idx, rec_idx) group by all), tc as (select s1_idx, count(*) n_true from truth group by 1),
g as (select margin, tau, s1_idx, coalesce(n_pred, 0) np, coalesce(n_true, 0) nt, coalesce(tp, 0) tp from rules cross join s1 left join tc using (s1_idx) left join pc using (margin, tau, s1_idx) left join hc using (margin, tau, s1_idx))
select 'threshold' method, margin, tau, round(avg(case when 1.25 * tp + 0.25 * (nt - tp) + (np - tp) > 0 then (1.25 * tp)::double / (1.25 * tp + 0.25 * (nt - tp) + (np - tp))::double else 1 end), 6) macro_f05 from g group by all"""


def _tuned(t: Tables, misses: tuple[float, ...] = ()) -> list[dict]:
    return decision.tune(t.candidates(), "p", t.truth(), t.s1(), (0.0, 0.2), (0.6, 0.8), misses)


@query("dec3_tune_thresholds", _GRID)
def _(t):
    rows = [(r["method"], float(r["margin"]), float(r["tau"]), float(r["macro_f05"])) for r in _tuned(t)]
    return t.spark.createDataFrame(rows, "method string, margin double, tau double, macro_f05 double")


@query("dec3_tune_expected_scores")
def _(t):
    rows = [(r["method"], float(r["margin"]), r.get("tau"), r.get("miss"), float(r["macro_f05"])) for r in _tuned(t, (0.0, 0.05))]
    return t.spark.createDataFrame(rows, "method string, margin double, tau double, miss double, macro_f05 double")


@query("dec4_apply_best")
def _(t):
    return decision.decide(t.candidates(), "p", _tuned(t)[0]).select("s1_idx", "rec_idx")


@query("dec4_apply_threshold", f"{_W}{_EX} select s1_idx, rec_idx from ex where p >= 0.8::double")
def _(t):
    return decision.decide(t.candidates(), "p", {"method": "threshold", "margin": 0.1, "tau": 0.8}).select("s1_idx", "rec_idx")


# ---- competition windows
_CTX = """, c as (select *, p cos from cand), w as (select rec_idx, s1_idx, cos, nm_tset, ad_tset, count(*) over r::double r_n, max(cos) over r r_cos_max, max(nm_tset) over r r_nm_max, max(ad_tset) over r r_ad_max,
 count(*) over s::double s_n, max(cos) over s s_cos_max, (row_number() over (partition by rec_idx order by cos desc, s1_idx, rec_idx))::double r_cos_rank, (row_number() over (partition by s1_idx order by cos desc, s1_idx, rec_idx))::double s_cos_rank
 from c window r as (partition by rec_idx), s as (partition by s1_idx))"""
_CTX = _CTX.replace("count(*) over r::double", "(count(*) over r)::double").replace("count(*) over s::double", "(count(*) over s)::double")


@query("win9_context_features", f"{_W}{_CTX} select rec_idx, s1_idx, r_n, round(r_cos_max, 6) r_cos_max, r_nm_max, r_ad_max, s_n, round(s_cos_max, 6) s_cos_max, r_cos_rank, s_cos_rank, round(r_cos_max - cos, 6) r_cos_gap, r_nm_max - nm_tset r_nm_gap, r_ad_max - ad_tset r_ad_gap, round(s_cos_max - cos, 6) s_cos_gap from w")
def _(t):
    return features.context_features(t.candidates().withColumnRenamed("p", "cos")).select("rec_idx", "s1_idx", *features.CONTEXT)


@query(
    "win10_consensus_features",
    f"""{_W}, w as (select *, max(p) over r rb_max, row_number() over ro rb_rank, coalesce(nth_value(p, 2) over (partition by rec_idx order by p desc, s1_idx, rec_idx rows between unbounded preceding and unbounded following), max(p) over r) rb_second,
 sum((p > 0.5::double)::int) over r rb_n05, sum(p) over r rb_sum, max(p) over s sb_max, sum(p) over s sb_sum, sum((p > 0.5::double)::int) over s sb_n05, sum((p > 0.9::double)::int) over s sb_n09,
 row_number() over (partition by s1_idx order by p desc, s1_idx, rec_idx) sb_rank, sum(p * num_first_eq) over s wnum, sum(p * ad_tset) over s wad, sum(p * nm_tset) over s wnm, sum(p * ad_empty_b) over s wemp
 from cand window r as (partition by rec_idx), s as (partition by s1_idx), ro as (partition by rec_idx order by p desc, s1_idx, rec_idx)), o as (select *, greatest(sb_sum - p, 1e-6::double) other from w)
 select rec_idx, s1_idx, round(rb_max, 6) rb_max, round(rb_second, 6) rb_second, rb_rank::double rb_rank, rb_n05::double rb_n05, round(rb_sum, 6) rb_sum, round(case when rb_rank = 1 then p - rb_second else p - rb_max end, 6) rb_gap,
 round(sb_max, 6) sb_max, round(sb_sum, 6) sb_sum, sb_n05::double sb_n05, sb_n09::double sb_n09, sb_rank::double sb_rank, round(sb_sum - p, 6) sb_sum_other,
 round((wnum - p * num_first_eq) / other + 1e-9::double, 4) peer_num, round((wad - p * ad_tset) / other + 1e-9::double, 4) peer_ad, round((wnm - p * nm_tset) / other + 1e-9::double, 4) peer_nm, round((wemp - p * ad_empty_b) / other + 1e-9::double, 4) peer_emp from o where sb_sum - p > 0.001::double""",
)
def _(t):
    out = features.consensus_features(t.candidates(), "p").where("sb_sum_other > 0.001")
    names = ["rb_max", "rb_second", "rb_rank", "rb_n05", "rb_sum", "rb_gap", "sb_max", "sb_sum", "sb_n05", "sb_n09", "sb_rank", "sb_sum_other"]
    return out.select("rec_idx", "s1_idx", *names, *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("peer_num", "peer_ad", "peer_nm", "peer_emp")))


@query("win4_second_best", f"{_W} select distinct rec_idx, round(coalesce(nth_value(p, 2) over (partition by rec_idx order by p desc rows between unbounded preceding and unbounded following), max(p) over (partition by rec_idx)), 6) second_p from cand")
def _(t):
    return t.candidates().select("rec_idx", decision.second_best("p", "rec_idx").alias("second_p")).distinct()


# ---- candidates
_VEC = """with q as (select vec_id rec_idx, label country, embedding::double[] v from embeddings where vec_id % 2 = 1), b as (select vec_id s1_idx, label country, embedding::double[] v from embeddings where vec_id % 2 = 0),
pairs as (select rec_idx, s1_idx, list_inner_product(q.v, b.v) cos from q join b using (country)),
ranked as (select *, row_number() over (partition by rec_idx order by round(cos, 9) desc, s1_idx) - 1 rr, row_number() over (partition by s1_idx order by round(cos, 9) desc, rec_idx) - 1 rs from pairs),
dense as (select rec_idx, s1_idx, cos, case when rr < 3 then rr else 255 end rank_r, case when rs < 5 then rs else 255 end rank_s from ranked where rr < 3 or rs < 5)"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings
    side = lambda bit, key: e.where(F.col("vec_id") % 2 == bit).select(F.col("vec_id").alias(key), F.col("label").alias("country"), "embedding")
    return side(0, "s1_idx"), side(1, "rec_idx")


@query("jn11_knn_both_directions", f"{_VEC} select rec_idx, s1_idx, round(cos, 5) cos, rank_r, rank_s from dense")
def _(t):
    s, r = _sides(t)
    return blocking.dense_candidates(s, r, 3, 5).withColumn("cos", F.round("cos", 5))


@query("srt5_running_top_k", f"{_VEC} select rec_idx, s1_idx, round(cos, 5) cos, rank_r from dense where rank_r < 3")
def _(t):
    """By blocks, whatever the size."""
    s, r = _sides(t)
    return blocking.nearest(r, s, "rec_idx", "s1_idx", 3, "rank_r", most_plain=0).withColumn("cos", F.round("cos", 5))


@query("jn7_full_outer_union", f"{_VEC} select count(*) n, sum((rank_r < 255)::int)::bigint n_r, sum((rank_s < 255)::int)::bigint n_s from dense")
def _(t):
    s, r = _sides(t)
    d = blocking.dense_candidates(s, r, 3, 5)
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank_r") < 255).alias("n_r"), F.count_if(F.col("rank_s") < 255).alias("n_s"))


@query("fil5_prune", f"{_VEC} select rec_idx, s1_idx from dense where rank_r < 2 or rank_s < 3")
def _(t):
    s, r = _sides(t)
    return decision.prune(blocking.dense_candidates(s, r, 3, 5), 2, 3).select("rec_idx", "s1_idx")


@query("agg13_recall_grid", f"""{_VEC}, gt as (select rec_idx, s1_idx from pairs where abs(rec_idx - s1_idx) = 1)
 select country::bigint country, {", ".join(f"round(avg(coalesce((rank_r < {a} or rank_s < {b})::int, 0)), 6) recall_{a}_{b}" for a, b in ((1, 0), (3, 0), (3, 5)))}, count(*) n_links from gt left join dense using (rec_idx, s1_idx) join b using (s1_idx) group by 1""")
def _(t):
    s, r = _sides(t)
    truth = r.select("rec_idx", "country").join(s.select("s1_idx", "country"), "country").where(F.abs(F.col("rec_idx") - F.col("s1_idx")) == 1)
    return evaluation.recall_grid(truth, blocking.dense_candidates(s, r, 3, 5), s.select("s1_idx", "country"), ["country"], ((1, 0), (3, 0), (3, 5)))


_LEX = """with norm as (select c_custkey idx, c_nationkey country, lower(c_mktsegment) name_core, 'road ' || lower(c_name) || ' main' addr, [c_custkey % 40] nums from customer),
keys as (select idx, country, case when length(name_core) >= 3 then name_core end k1, (nums[1])::varchar || '|' || 'customer' k2, name_core || '|' || (nums[1])::varchar k3 from norm),
long as (select idx, country, 'k1' kind, k1 val from keys union all select idx, country, 'k2', k2 from keys union all select idx, country, 'k3', k3 from keys),
s as (select * from long where idx % 3 = 0), r as (select * from long where idx % 3 > 0), few as (select country, kind, val from s group by all having count(*) <= 4),
lex as (select distinct r.idx rec_idx, s.idx s1_idx from r join s using (country, kind, val) join few using (country, kind, val))"""


def _lexical(t: Tables) -> DataFrame:
    c = t.customer
    nums = F.array((F.col("c_custkey") % 40).cast("string"))
    norm = c.select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("country"), F.lower("c_mktsegment").alias("name_core"), F.concat(F.lit("road "), F.lower("c_name"), F.lit(" main")).alias("addr"), nums.alias("nums"))
    keys = blocking.lexical_keys(norm, "idx")
    s, r = keys.where("idx % 3 = 0").withColumnRenamed("idx", "s1_idx"), keys.where("idx % 3 > 0").withColumnRenamed("idx", "rec_idx")
    return blocking.lexical_candidates(s, r, 4)


@query("jn12_lexical_keys", f"{_LEX} select rec_idx, s1_idx from lex")
def _(t):
    return _lexical(t)


@query("jn13_add_lexical", f"""{_VEC}, lex as (select rec_idx, s1_idx, cos from pairs where abs(rec_idx - s1_idx) <= 9)
 select rec_idx, s1_idx, round(cos, 5) cos, rank_r, rank_s, false lex from dense union all select rec_idx, s1_idx, round(cos, 5), 255, 255, true from lex where not exists (select 1 from dense d where d.rec_idx = lex.rec_idx and d.s1_idx = lex.s1_idx)""")
def _(t):
    s, r = _sides(t)
    lex = r.select("rec_idx", "country").join(s.select("s1_idx", "country"), "country").where(F.abs(F.col("rec_idx") - F.col("s1_idx")) <= 9).select("rec_idx", "s1_idx")
    return blocking.add_lexical(blocking.dense_candidates(s, r, 3, 5), lex, s, r).withColumn("cos", F.round("cos", 5))


@query("fea1_name_frequencies", """with a as (select c_custkey s1_idx, c_nationkey country, c_mktsegment name_core from customer where c_custkey % 2 = 0), b as (select c_custkey rec_idx, c_nationkey country, c_mktsegment name_core from customer where c_custkey % 2 = 1)
 select s1_idx, count(*) over (partition by country, name_core) s1_name_freq, coalesce(n, 0) n_rec_same from a left join (select country, name_core, count(*) n from b group by 1, 2) using (country, name_core)""")
def _(t):
    side = lambda w, key: t.customer.where(w).select(F.col("c_custkey").alias(key), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("name_core"))
    return features.name_frequencies(side("c_custkey % 2 = 0", "s1_idx"), side("c_custkey % 2 = 1", "rec_idx"), "s1_idx", "s1_name_freq", "n_rec_same")


# ---- folds and samples
_STRATA = ", st as (select s1_idx, country, coalesce(n, 0) n_true, country || '_' || least(coalesce(n, 0), 6) stratum from s1 left join (select s1_idx, count(*) n from truth group by 1) using (s1_idx))"


@query("fld1_folds", f"{_W}{_STRATA} select s1_idx, (row_number() over (partition by stratum order by (s1_idx * 2654435761) % 1000003, s1_idx) - 1) % 5 fold, n_true, stratum from st")
def _(t):
    return sampling.folds(t.s1(), t.truth(), 5, order=[(F.col("s1_idx") * 2654435761) % 1000003])


@query("win8_round_robin", "select o_orderkey, (row_number() over (partition by o_orderpriority order by (o_orderkey * 7919) % 104729, o_orderkey) - 1) % 4 bucket from orders")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority")
    return sampling.with_stratified_bucket(o, "bucket", "o_orderpriority", ["o_orderkey"], 4, [(F.col("o_orderkey") * 7919) % 104729]).drop("o_orderpriority")


def _key(keys: str, seed: int) -> str:
    """The order in which samples are drawn, in SQL."""
    return f"(('0x' || substr(md5({keys} || ':{seed}'), 1, 15))::bigint)"


@query("smp1_exact_sample", f"{_W} select s1_idx, rec_idx from truth order by {_key('rec_idx', 42)}, rec_idx limit 200")
def _(t):
    return sampling.exact_sample(t.truth(), 200, ["rec_idx"], 42)


@query("smp1_exact_sample_size", "select least(200, count(*)) n, least(200, count(distinct o_orderkey)) ids from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def _(t):
    return sampling.exact_sample(t.truth(), 200, ["rec_idx"], 42).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec_idx").alias("ids"))


@query("smp2_key_sample", f"{_W} select s1_idx, rec_idx from cand where {_key('s1_idx', 42)} % 1000000 < 350000")
def _(t):
    return sampling.key_sample(t.candidates(), 0.35, "s1_idx", 42).select("s1_idx", "rec_idx")


@query(
    "smp3_dev_subset",
    f"""{_W}{_STRATA}, dev as (select s1_idx from st qualify (row_number() over (partition by stratum order by {_key("s1_idx", 43)}, s1_idx) - 1) % 10 = 0),
 free as (select o_orderkey rec_idx, row_number() over (order by {_key("o_orderkey", 44)}, o_orderkey) r, count(*) over () n from orders where o_orderkey not in (select rec_idx from truth))
 select 's1' side, s1_idx idx from dev union all select * from (select 'rec' side, rec_idx idx from truth where s1_idx in (select s1_idx from dev) union select 'rec', rec_idx from free where r <= round_even(n * 0.1, 0))""",
)
def _(t):
    s, r = sampling.dev_subset(t.s1(), t.orders.select(F.col("o_orderkey").alias("rec_idx")), t.truth(), 0.1, 0.1)
    return s.select(F.lit("s1").alias("side"), F.col("s1_idx").alias("idx")).unionByName(r.select(F.lit("rec").alias("side"), F.col("rec_idx").alias("idx")))


@query(
    "smp4_hidden_entities",
    f"""{_W}{_CTX.replace("from cand)", "from cand where " + _key("s1_idx", 49) + " % 1000000 >= 190000)")} select s1_idx, rec_idx, r_n, round(r_cos_max, 6) r_cos_max, r_nm_max, r_ad_max, s_n, round(s_cos_max, 6) s_cos_max,
 r_cos_rank, s_cos_rank, round(r_cos_max - cos, 6) r_cos_gap, r_nm_max - nm_tset r_nm_gap, r_ad_max - ad_tset r_ad_gap, round(s_cos_max - cos, 6) s_cos_gap from w""",
)
def _(t):
    ctx = features.context_features(t.candidates().withColumnRenamed("p", "cos"))
    return sampling.hide_entities(ctx, 0.19, features.context_features, features.CONTEXT).select("s1_idx", "rec_idx", *features.CONTEXT)


# ---- bands, labels, pseudo labels
@query("crs1_uncertain_band", f"{_W} select s1_idx, rec_idx from cand where p between 0.3::double and 0.7::double")
def _(t):
    return models.uncertain(t.candidates(), "p", 0.3, 0.7)


@query("crs5_extend_band", f"{_W} select s1_idx, rec_idx from cand where p between 0.2::double and 0.8::double and not (p between 0.3::double and 0.7::double)")
def _(t):
    c = t.candidates()
    return models.extend_band(models.uncertain(c, "p", 0.3, 0.7), c, "p", 0.2, 0.8)


@query("mdl1_labels", f"{_W} select c.s1_idx, c.rec_idx, (t.rec_idx is not null)::bigint y, c.s1_idx % 5 fold from cand c left join truth t using (s1_idx, rec_idx)")
def _(t):
    return models.labelled(t.candidates().select("s1_idx", "rec_idx"), t.truth(), t.s1().withColumn("fold", F.col("s1_idx") % 5))


@query("adp1_pseudo_labels", f"""{_W}, x as (select *, max(p) over (partition by rec_idx) mx, count(*) over (partition by rec_idx) n, nth_value(p, 2) over (partition by rec_idx order by p desc, s1_idx rows between unbounded preceding and unbounded following) sec from cand),
 y as (select *, p >= 0.9::double and p = mx and (n = 1 or sec < 0.3::double) pos, p <= 0.05::double and nm_tset >= 80 neg from x) select s1_idx, rec_idx, (case when pos then 1 else 0 end)::bigint y from y where pos or neg""")
def _(t):
    return models.pseudo_labels(t.candidates().withColumn("cos", F.col("nm_tset")), "p", 0.9, 0.05, 80.0, 0.3)


@query("agg14_auc_and_corr", f"""{_W}, l as (select c.p, (t.rec_idx is not null)::int y from cand c left join truth t using (s1_idx, rec_idx)), r as (select *, avg(rn) over (partition by p) ar from (select *, row_number() over (order by p) rn from l))
 select round((sum(case when y = 1 then ar end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6)::double auc, round(corr(p, y), 6) r from r""")
def _(t):
    x = models.labelled(t.candidates().select("s1_idx", "rec_idx", "p"), t.truth(), t.s1().withColumn("fold", F.lit(0)))
    return evaluation.auc(x, "y", "p").withColumn("k", F.lit(1)).join(x.agg(F.corr("p", "y").alias("r")).withColumn("k", F.lit(1)), "k").drop("k")


@query("trn2_with_scores", f"{_W} select c.s1_idx, c.rec_idx, round(case when c.p between 0.3::double and 0.7::double then c.p * 2 end, 6) ce, (c.p between 0.3::double and 0.7::double)::int::double in_band from cand c")
def _(t):
    c = t.candidates()
    ce = c.where(F.col("p").between(0.3, 0.7)).select("s1_idx", "rec_idx", (F.col("p") * 2).alias("ce"))
    return models.with_scores(c.select("s1_idx", "rec_idx"), ce)


@query("adp1_update_scores", f"{_W} select s1_idx, rec_idx, round(case when s1_idx % 3 = 0 then 1 - p else p end, 6) ce from cand")
def _(t):
    c = t.candidates().select("s1_idx", "rec_idx", F.col("p").alias("ce"))
    return models.updated(c, c.where("s1_idx % 3 = 0").withColumn("ce", 1 - F.col("ce")))


def _features(t: Tables) -> DataFrame:
    f = features.context_features(t.candidates().withColumnRenamed("p", "cos"))
    return models.labelled(f, t.truth(), t.s1().withColumn("fold", (F.col("s1_idx") % 3).cast("int")))


@query("mdl3_cross_fit_gbt")
def _(t):
    """Boosted trees by fold."""
    f = _features(t)
    return models.cross_fit(f, models.feature_columns(f), 3, "pA", models.gbt_learner(5, 3))[0].select("s1_idx", "rec_idx", "fold", "y", "pA")


@query("trn1_train_a_then_b")
def _(t):
    """Out-of-fold A, consensus features from it, then out-of-fold B."""
    f = _features(t)
    a = models.cross_fit(f, models.feature_columns(f), 3, "pA", models.logistic_learner())[0].persist()
    b = features.consensus_features(a, "pA")
    return models.cross_fit(b, models.feature_columns(b), 3, "pB", models.logistic_learner())[0].select("s1_idx", "rec_idx", "pA", "pB")


@query("prd1_mean_of_folds")
def _(t):
    """Mean prediction of all folds' models on pairs that none has seen."""
    f = _features(t)
    names = models.feature_columns(f)
    _, out, _ = models.cross_fit(f.where("fold < 2"), names, 2, "pA", models.logistic_learner(), others=f.where("fold = 2").select("s1_idx", "rec_idx", *names))
    return out.select("s1_idx", "rec_idx", "pA")


@query("prd2_mean_of_folds_with_scores")
def _(t):
    """Predictions that also know the scores of uncertain pairs, for pairs that no model has seen."""
    f = _features(t)
    ce = f.where(F.col("cos").between(0.3, 0.7)).select("s1_idx", "rec_idx", (F.col("cos") * 4 - 2).alias("ce"))
    f = models.with_scores(f, ce)
    names = models.feature_columns(f)
    _, out, _ = models.cross_fit(f.where("fold < 2"), names, 2, "pC", models.logistic_learner(), others=f.where("fold = 2").select("s1_idx", "rec_idx", *names))
    return out.select("s1_idx", "rec_idx", "pC")


@query("mdl4_feature_columns", "select unnest(['r_n', 'r_cos_max', 'r_nm_max', 'r_ad_max', 's_n', 's_cos_max', 'r_cos_gap', 'r_nm_gap', 'r_ad_gap', 's_cos_gap', 'r_cos_rank', 's_cos_rank', 'cos', 'nm_tset', 'ad_tset', 'num_first_eq', 'ad_empty_b']) feature")
def _(t):
    return t.spark.createDataFrame([(c,) for c in models.feature_columns(_features(t))], "feature string")


@query("snk3_saved_models", "select count(*) n, 0::bigint different from cand".replace("select", f"{_W} select", 1))
def _(t):
    """Saved and loaded models predict the same."""
    f = _features(t).persist()
    names = ["cos", "nm_tset"]
    _, _, fitted = models.cross_fit(f, names, 2, "pA", models.logistic_learner())
    path = f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}"
    models.save_models(fitted, path)
    again = models.load_models(type(fitted[0]), path, 2)
    both = models.mean_prediction(again, models.mean_prediction(fitted, f.select("s1_idx", "rec_idx", *names), names, "a"), names, "b")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("different"))
