"""Projection, join, aggregation, window, sorting and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsmith.functions.arrays import distinct_join, ordered_join
from kinsmith.functions.numeric import bucket, clip, f_half, l2_normalized, smoothed_log_odds
from kinsmith.functions.text import replace_by
from kinsmith.operators import mining, wordfeat
from kinsmith.operators.mining import hinted
from kinsmith.plans.catalog import ROLES, query
from kinsmith.sources import tables as src

_W = f"with {ROLES}"


# ---- sources
@query("src3_pruned_scan", "select o_orderkey, o_custkey from orders where o_totalprice > 200000")
def _(t):
    return src.read_columns(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"]).where("o_totalprice > 200000").select("o_orderkey", "o_custkey")


@query("src4_count", "select count(*) n from lineitem")
def _(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("src5_matrix_scan", "select vec_id, len(embedding) dims, round(embedding[1]::double, 6) x0, round(embedding[64]::double, 6) x63 from embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).alias("x0"), F.get("embedding", F.lit(63)).alias("x63"))


@query("row1_row_index", "select row_number() over (order by s_acctbal, s_suppkey) - 1 idx, s_suppkey from supplier")
def _(t):
    return src.with_row_index(t.supplier.select("s_acctbal", "s_suppkey"), "idx", ["s_acctbal", "s_suppkey"]).select("idx", "s_suppkey")


@query("src2_contract_checks", "select count(*) n, count(distinct s_name) ids, sum((not starts_with(s_name, 'Supplier#'))::int)::bigint bad from supplier")
def _(t):
    s = src.check_entities(t.supplier.withColumnRenamed("s_name", "entity_id"), "Supplier#")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("ids"), F.count_if(~F.col("entity_id").startswith("Supplier#")).alias("bad"))


# ---- projections and filters
@query("prj1_project", "select c_custkey id, upper(c_mktsegment) segment, c_nationkey::varchar nation, 'x' tag from customer")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.upper("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.lit("x").alias("tag"))


@query("prj2_drop_by_prefix", "select c_custkey, c_name from customer")
def _(t):
    c = t.customer.withColumnsRenamed({"c_nationkey": "wf_a", "c_acctbal": "wf_b", "c_mktsegment": "wf_c"})
    return c.drop("not_there", *(x for x in c.columns if x.startswith("wf_")))


@query("prj3_map_or_keep", "select c_custkey, coalesce(s_name, c_name) who from customer left join supplier on s_suppkey = c_custkey")
def _(t):
    return t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left").select("c_custkey", F.coalesce("s_name", "c_name").alias("who"))


@query("prj4_chained_case", "select case when p_size <= 10 then 'small' when p_size <= 30 then 'medium' else 'large' end size, count(*) n from part group by 1")
def _(t):
    return t.part.groupBy(F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("prj5_fill_nulls", "select d.doc_id, coalesce(quality, -1)::bigint quality, toxic is null missing from documents d left join labels using (doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNull().alias("missing"))


@query("prj6_clip", "select l_orderkey, l_linenumber::bigint l_linenumber, case when l_quantity is not null then least(greatest(l_quantity, 10), 40) end::double q from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", clip(F.col("l_quantity"), 10.0, 40.0).alias("q"))


@query("prj7_dict_replace", "select event_id, case event_type when 'click' then 'tap' when 'view' then 'look' else event_type end kept, case event_type when 'click' then 'tap' when 'view' then 'look' end strict from events".replace(" strict from", " only_mapped from"))
def _(t):
    names = {"click": "tap", "view": "look"}
    return t.events.select("event_id", replace_by(F.col("event_type"), names).alias("kept"), replace_by(F.col("event_type"), names, keep=False).alias("only_mapped"))


@query("prj8_composite_text", "select n_nationkey::bigint n_nationkey, n_name || '_' || n_regionkey key from nation")
def _(t):
    return t.nation.select("n_nationkey", F.concat("n_name", F.lit("_"), F.col("n_regionkey").cast("string")).alias("key"))


@query("fil1_compound_filter", "select o_orderkey from orders where (o_orderstatus = 'F' or o_totalprice > 300000) and not o_orderpriority = '5-LOW'")
def _(t):
    return t.orders.where(((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 300000)) & ~(F.col("o_orderpriority") == "5-LOW")).select("o_orderkey")


@query("fil2_between", "select l_orderkey, l_linenumber::bigint l_linenumber from lineitem where l_discount between 0.05 and 0.07")
def _(t):
    return t.lineitem.where(F.col("l_discount").between(0.05, 0.07)).select("l_orderkey", "l_linenumber")


@query("fil3_in_and_not_in", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def _(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(t.truth().select(F.col("s1_idx").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("fil4_mask_by_key", "select c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey = 1")
def _(t):
    mask = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 1).alias("keep"))
    return t.customer.join(mask, "c_nationkey").where("keep").select("c_custkey")


@query("fil7_regex_and_prefix", "select p_partkey from part where regexp_matches(p_name, '^[a-m]') and starts_with(p_brand, 'Brand#1')")
def _(t):
    return t.part.where(F.col("p_name").rlike("^[a-m]") & F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("gth1_gather_by_key", f"{_W} select rec_idx, s1_idx, c_name, o_orderstatus from truth join customer on c_custkey = s1_idx join orders on o_orderkey = rec_idx")
def _(t):
    return t.truth().join(t.customer.select(F.col("c_custkey").alias("s1_idx"), "c_name"), "s1_idx").join(t.orders.select(F.col("o_orderkey").alias("rec_idx"), "o_orderstatus"), "rec_idx")


@query("slc1_partitioned_map", "select count(*) n, sum(l_linenumber)::bigint total from lineitem")
def _(t):
    return t.lineitem.select("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


# ---- joins
@query("jn1_inner_single", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("jn2_inner_composite", f"{_W} select s1_idx, rec_idx, round(p, 6) p from cand join truth using (s1_idx, rec_idx)")
def _(t):
    return t.candidates().join(t.truth(), ["s1_idx", "rec_idx"]).select("s1_idx", "rec_idx", "p")


@query("jn3_left_fill", f"{_W} select s1_idx, coalesce(n, 0) n from s1 left join (select s1_idx, count(*) n from truth group by 1) using (s1_idx)")
def _(t):
    return t.s1().select("s1_idx").join(t.truth().groupBy("s1_idx").agg(F.count(F.lit(1)).alias("n")), "s1_idx", "left").na.fill(0)


@query("jn4_left_keeps_order", "select doc_id, string_agg(coalesce(m, w), ' ' order by pos) txt from (select doc_id, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) pos from documents) left join (values ('the', 'THE'), ('of', 'OF')) v(k, m) on w = k group by 1")
def _(t):
    words = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    table = t.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("w"), F.lit(b).alias("m")) for a, b in (("the", "THE"), ("of", "OF"))))))
    return words.join(hinted(table), "w", "left").withColumn("w", F.coalesce("m", "w")).groupBy("doc_id").agg(ordered_join("pos", "w", " ").alias("txt"))


@query("jn5_semi", f"{_W} select s1_idx from s1 where s1_idx in (select s1_idx from truth)")
def _(t):
    return t.s1().select("s1_idx").join(t.truth(), "s1_idx", "left_semi")


@query("jn6_anti", f"{_W} select s1_idx from s1 where s1_idx not in (select s1_idx from truth)")
def _(t):
    return t.s1().select("s1_idx").join(t.truth(), "s1_idx", "left_anti")


@query("jn8_right_universe", f"{_W} select s1_idx, coalesce(n, 0) n from (select s1_idx, count(*) n from truth join orders on o_orderkey = rec_idx where o_totalprice > 150000 group by 1) right join s1 using (s1_idx)")
def _(t):
    n = t.truth().join(t.orders.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("rec_idx")), "rec_idx", "left_semi").groupBy("s1_idx").agg(F.count(F.lit(1)).alias("n"))
    return n.join(t.s1().select("s1_idx"), "s1_idx", "right").select("s1_idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn9_suffixes", "select a.n_nationkey::bigint n_nationkey, a.n_name, b.n_name n_name_r from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def _(t):
    r = t.nation.select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("n_name_r"))
    return t.nation.join(r, "n_regionkey").where("n_nationkey < k").select("n_nationkey", "n_name", "n_name_r")


@query("jn10_twins_in_group", "select a.p_partkey, count(*) twins from part a join part b on a.p_name = b.p_name and a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey group by 1")
def _(t):
    # members of a group are counted, not gathered
    w = Window.partitionBy("p_name", "p_brand")
    return t.part.select("p_partkey", (F.count(F.lit(1)).over(w) - 1).alias("twins")).where("twins > 0")


@query("jn14_map_application", """with w as (select doc_id, unnest(string_split(text, ' ')) tok from documents), m as (select tok, min(doc_id)::varchar t from w group by 1 having count(*) between 5 and 20)
 select doc_id, count(*) n, sum((t is not null)::int)::bigint mapped, count(distinct coalesce(t, tok)) kinds from w left join m using (tok) group by 1""")
def _(t):
    w = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("tok"))
    m = w.groupBy("tok").agg(F.min("doc_id").cast("string").alias("to"), F.count(F.lit(1)).alias("n")).where("n between 5 and 20").drop("n")
    return w.join(hinted(m), "tok", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("to").alias("mapped"), F.count_distinct(F.coalesce("to", "tok")).alias("kinds"))


# ---- aggregates
@query("agg1_group_counts", "select l_suppkey, count(*) n from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("agg2_statistics", "select l_returnflag, round(sum(l_quantity), 6) s, round(avg(l_quantity), 6) m, min(l_quantity) lo, max(l_quantity) hi, median(l_quantity) med, round(stddev_samp(l_quantity), 6) sd from lineitem group by 1")
def _(t):
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(q).alias("s"), F.avg(q).alias("m"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.median(q).alias("med"), F.stddev_samp(q).alias("sd"))


@query("agg3_rates", "select o_orderpriority, round(avg((o_orderstatus = 'F')::int), 6) rate from orders group by 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))


@query("agg4_conditional", "select user_id, round(coalesce(sum(value) filter (event_type = 'purchase'), 0), 6) spent, bool_or(event_type = 'error') failed, count(*) filter (event_type = 'click') clicks from events group by 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("spent"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("agg5_ordered_list", "select o_custkey, string_agg(o_orderstatus, '' order by o_orderkey) statuses from orders group by 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(ordered_join("o_orderkey", "o_orderstatus", "").alias("statuses"))


@query("agg6_distinct_list", "select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) kinds from orders group by 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(distinct_join(F.col("o_orderpriority"), ",").alias("kinds"))


@query("agg7_members", "select n_regionkey::bigint n_regionkey, len(list(n_nationkey)) n, list_min(list(n_nationkey))::bigint first from nation group by 1")
def _(t):
    m = F.collect_list("n_nationkey")
    return t.nation.groupBy("n_regionkey").agg(F.size(m).alias("n"), F.array_min(m).alias("first"))


@query("agg8_distinct", "select count(distinct p_name) names, count(distinct p_brand || p_type) kinds, (select count(*) from (select distinct l_orderkey, l_suppkey from lineitem)) pairs from part")
def _(t):
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").distinct().agg(F.count(F.lit(1)).alias("pairs")).withColumn("k", F.lit(1))
    return t.part.agg(F.count_distinct("p_name").alias("names"), F.count_distinct(F.concat("p_brand", "p_type")).alias("kinds")).withColumn("k", F.lit(1)).join(pairs, "k").drop("k")


@query("agg8_keep_first", "select o_custkey, min(o_orderkey) first_order from orders group by 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_order"))


@query("agg9_best_target", """with p as (select p_name tok, p_brand target from part), c as (select tok, target, count(*) c from p group by 1, 2), n as (select tok, count(*) n from p group by 1),
 b as (select *, row_number() over (partition by tok order by c desc, target) r from c) select tok, target "to", c "count", n, round(c / n, 6) share from b join n using (tok) where r = 1 and c >= 3 and c / n >= 0.05""")
def _(t):
    return mining.best_target(t.part.select(F.col("p_name").alias("tok"), F.col("p_brand").alias("to")), 3, 0.05)


_WORDS = """with w as (select d.doc_id, unnest(list_distinct(string_split(lower(text), ' '))) tok, quality y, d.doc_id % 5 fold from documents d join labels using (doc_id)), c as (select tok, fold, count(*) n, sum(y)::bigint pos from w group by 1, 2)"""
_LO = lambda n, p: f"(ln(least(greatest(({p} + 30 * 0.8::double) / ({n} + 30), 1e-4::double), 0.9999::double)) - ln(1 - least(greatest(({p} + 30 * 0.8::double) / ({n} + 30), 1e-4::double), 0.9999::double)))"


def _word_counts(t):
    docs = t.documents.join(t.labels, "doc_id")
    w = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("tok"), F.col("quality").alias("y"), (F.col("doc_id") % 5).alias("fold"))
    return w.groupBy(F.lit("extra").alias("kind"), "tok", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))


@query("agg10_out_of_fold_log_odds", f"{_WORDS}, t as (select tok, sum(n) tn, sum(pos) tp from c group by 1) select tok, fold, round({_LO('(tn - n)', '(tp - pos)')}, 6) lo from c join t using (tok)")
def _(t):
    return wordfeat.out_of_fold_log_odds(_word_counts(t), 0.8).drop("kind")


@query("wrd3_full_log_odds", f"{_WORDS}, t as (select tok, sum(n)::bigint n, sum(pos) pos from c group by 1) select tok, round({_LO('n', 'pos')}, 6) lo, n from t")
def _(t):
    return wordfeat.log_odds(_word_counts(t), 0.8).drop("kind")


@query("wrd3_fit_table", f"{_WORDS}, t as (select tok, sum(n)::bigint n, sum(pos) pos from c where fold <> 0 group by 1 having sum(n) >= 30) select tok, round({_LO('n', 'pos')}, 6) lo, n from t")
def _(t):
    return wordfeat.fit_table(_word_counts(t), 0.8, 0).drop("kind")


@query("wrd3_ridge_transfer")
def _(t):
    table = wordfeat.fit_table(_word_counts(t), 0.8, 0)
    return wordfeat.transferred(table, wordfeat.fit_transfer(table))


@query("agg15_quantiles", "select event_type, quantile_cont(value, 0.25) q25, quantile_cont(value, 0.5) q50, quantile_cont(value, 0.95) q95 from events group by 1".replace("quantile_cont(value, 0.25)", "round(quantile_cont(value, 0.25), 6)").replace("quantile_cont(value, 0.5)", "round(quantile_cont(value, 0.5), 6)").replace("quantile_cont(value, 0.95)", "round(quantile_cont(value, 0.95), 6)"))
def _(t):
    return t.events.groupBy("event_type").agg(*(F.percentile("value", F.lit(q)).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q95", 0.95))))


@query("agg15_unpivot", "select o_orderstatus, kind, v from (select o_orderstatus, count(*)::double n, round(avg(o_totalprice), 6) mean from orders group by 1) unpivot (v for kind in (n, mean))")
def _(t):
    g = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("mean"))
    return g.unpivot(["o_orderstatus"], ["n", "mean"], "kind", "v")


# ---- windows
@query("win1_partition_count", "select l_orderkey, l_linenumber::bigint l_linenumber, l_partkey, count(*) over (partition by l_orderkey) n from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"))


_PAIRS = "with x as (select l_orderkey, l_suppkey, sum(l_quantity) q from lineitem group by 1, 2)"


def _order_supplier(t):
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))


@query("win2_partition_aggregates", f"{_PAIRS} select l_orderkey, l_suppkey, max(q) over w m, sum(q) over w s, sum((q > 20)::int) over w::bigint big from x window w as (partition by l_suppkey)".replace("over w::bigint big", "over w big").replace("sum((q > 20)::int) over w big", "(sum((q > 20)::int) over w)::bigint big"))
def _(t):
    w = Window.partitionBy("l_suppkey")
    return _order_supplier(t).select("l_orderkey", "l_suppkey", F.max("q").over(w).alias("m"), F.sum("q").over(w).alias("s"), F.count_if(F.col("q") > 20).over(w).alias("big"))


@query("win3_ordinal_rank", f"{_PAIRS} select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by q desc, l_suppkey) r from x")
def _(t):
    return _order_supplier(t).select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("q"), "l_suppkey")).alias("r"))


@query("win5_adjacent_repeats", "select user_id, count(*) kept from (select user_id, event_type, lag(event_type) over (partition by user_id order by event_id) prev from events) where prev is null or prev <> event_type group by 1")
def _(t):
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.withColumn("prev", prev).where("prev is null or prev <> event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("win6_group_key", "select p_partkey, p_brand || '|' || p_size gid, count(*) over (partition by p_brand, p_size) n from part")
def _(t):
    return t.part.select("p_partkey", F.concat("p_brand", F.lit("|"), F.col("p_size").cast("string")).alias("gid"), F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size")).alias("n"))


@query("win7_share_of_total", "select lang, source, round(count(*) / sum(count(*)) over (partition by lang), 6) share from documents group by 1, 2")
def _(t):
    g = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.select("lang", "source", (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("share"))


# ---- order, limit, sets
@query("srt1_multi_key_sort", "select row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) pos, c_custkey from customer")
def _(t):
    return src.with_row_index(t.customer.select("c_mktsegment", (-F.col("c_acctbal")).alias("neg"), "c_custkey"), "i", ["c_mktsegment", "neg", "c_custkey"]).select((F.col("i") + 1).alias("pos"), "c_custkey")


@query("srt2_top_n", "select l_partkey, count(*) n from lineitem group by 1 order by n desc, l_partkey limit 15")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(15)


@query("set1_union_all", "select kind, count(*) n from (select 'c' kind, c_custkey k from customer union all select 's', s_suppkey from supplier) group by 1")
def _(t):
    u = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k")).unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k")))
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("set2_union_coerced", "select n_nationkey::bigint k from nation union all select s_suppkey from supplier")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k")))


@query("set3_union_distinct", f"{_W} select s1_idx, rec_idx from truth union select s1_idx, rec_idx from cand where p > 0.9::double")
def _(t):
    return t.truth().select("s1_idx", "rec_idx").union(t.candidates().where("p > 0.9").select("s1_idx", "rec_idx")).distinct()


@query("set4_horizontal_by_key", "select c_custkey, c_name, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by 1, 2")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey", "c_name").join(n, "c_custkey", "left").na.fill(0, ["n"])


@query("set5_except_rows", f"{_W} select s1_idx, rec_idx from cand where p > 0.5::double except select s1_idx, rec_idx from truth")
def _(t):
    return t.candidates().where("p > 0.5").select("s1_idx", "rec_idx").join(t.truth(), ["s1_idx", "rec_idx"], "left_anti")


# ---- numbers
@query("mth1_log_odds", "select p_partkey, round(ln(least(greatest((p_size + 15.0::double) / 80, 1e-4::double), 0.9999::double)) - ln(1 - least(greatest((p_size + 15.0::double) / 80, 1e-4::double), 0.9999::double)), 6) lo from part")
def _(t):
    return t.part.select("p_partkey", smoothed_log_odds(F.lit(50), F.col("p_size"), F.lit(0.5)).alias("lo"))


@query("mth2_f_half", "select l_orderkey, l_linenumber::bigint l_linenumber, l_partkey, round(case when 1.25 * a + 0.25 * c + b > 0 then (1.25 * a)::double / (1.25 * a + 0.25 * c + b)::double else 1 end, 6) f from (select *, l_orderkey % 3 a, l_partkey % 2 b, l_suppkey % 4 c from lineitem)")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", f_half(F.col("l_orderkey") % 3, F.col("l_partkey") % 2, F.col("l_suppkey") % 4).alias("f"))


@query("mth3_bucket_round_abs", "select c_custkey, c_custkey % 7 b, round(abs(c_acctbal), 0) a from customer")
def _(t):
    return t.customer.select("c_custkey", bucket(F.col("c_custkey"), 7).alias("b"), F.round(F.abs("c_acctbal")).alias("a"))


@query("mth4_l2_normalize", "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) norm, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) x0 from embeddings")
def _(t):
    unit = l2_normalized(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x)), 4).alias("norm"), F.round(F.get(unit, F.lit(0)), 5).alias("x0"))


@query("mth6_correlation", "select round(corr(l_quantity, l_extendedprice), 6) r, round(stddev_samp(l_extendedprice), 4) sd, median(l_tax) med from lineitem")
def _(t):
    return t.lineitem.agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"), F.median("l_tax").alias("med"))
