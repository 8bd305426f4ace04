"""Features of candidate pairs: similarities, frequencies, and competition within lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from kinsmith.functions import similarity as sim
from kinsmith.functions.arrays import coverage, first, jaccard

#: The pairs of strings that are compared, with what is computed of each.
_COMPARISONS = {
    "nm": ("ratio", "tset", "tsort", "partial", "jw", "pset"),
    "ad": ("ratio", "tset", "tsort", "partial", "jw", "pset"),
    "alt": ("tset",),
    "raw": ("tset", "ratio"),
    "flat": ("ratio", "partial"),
    "a0": ("partial",),
    "all": ("partial",),
}
_KINDS = {"ratio": sim.ratio, "tset": sim.token_set_ratio, "tsort": sim.token_sort_ratio, "partial": sim.partial_ratio, "jw": sim.jaro_winkler, "pset": sim.partial_token_set_ratio}
_OUTPUTS = [f"{c}_{k}" for c, kinds in _COMPARISONS.items() for k in kinds]

CONTEXT = ("r_n", "r_cos_max", "r_nm_max", "r_ad_max", "s_n", "s_cos_max", "r_cos_gap", "r_nm_gap", "r_ad_gap", "s_cos_gap", "r_cos_rank", "s_cos_rank")


@pandas_udf(StructType([StructField(c, DoubleType()) for c in _OUTPUTS]))
def _compare(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """All string similarities of a batch of pairs in one crossing to Python."""
    cached = {k: lru_cache(maxsize=50_000)(f) for k, f in _KINDS.items()}
    for columns in batches:
        out = {}
        for i, (name, kinds) in enumerate(_COMPARISONS.items()):
            pairs = list(zip(columns[2 * i], columns[2 * i + 1], strict=True))
            for k in kinds:
                out[f"{name}_{k}"] = [cached[k](a, b) for a, b in pairs]
        yield pd.DataFrame(out)


def name_frequencies(norm: DataFrame, other: DataFrame, key: str, own: str, cross: str, partition: str = "country") -> DataFrame:
    """(key, own, cross): how many rows of the same side, and of the other, have this name within the partition."""
    by = [partition, "name_core"]
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return norm.select(key, *by).join(n(norm, own), by).join(n(other, cross), by, "left").na.fill(0, [cross]).select(key, own, cross)


def _flag(c: Column) -> Column:
    return c.cast("double")


def pair_features(pairs: DataFrame, s1: DataFrame, rec: DataFrame, s1_freq: DataFrame, rec_freq: DataFrame) -> DataFrame:
    """pairs(s1_idx, rec_idx, cos, rank_r, rank_s) with 50 features.

    s1 and rec are normalized tables, rec also with src; the frequencies are name_frequencies() of both sides. Every input
    joins by its id. Expressions do what they can; similarities take one Arrow UDF with a struct result.
    """
    sides = lambda df, tag, key: df.select(key, *(F.col(c).alias(f"{tag}_{c}") for c in ("name_core", "name_alt", "name_raw", "legal", "addr", "nums", "nonlatin")))
    x = pairs.join(sides(s1, "a", "s1_idx"), "s1_idx").join(sides(rec, "b", "rec_idx").join(rec.select("rec_idx", "src"), "rec_idx"), "rec_idx")
    digits = lambda c: F.transform(c, lambda e: F.regexp_extract(e, r"^([0-9]+)", 1))
    x = x.withColumns({"an": digits(F.col("a_nums")), "bn": digits(F.col("b_nums"))})
    x = x.withColumns({"a0": F.coalesce(first(F.col("an")), F.lit("")), "b0": F.coalesce(first(F.col("bn")), F.lit("")), "ball": F.array_join("bn", " ")})
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0)))
    x = x.withColumns({"aw": words(F.col("a_addr")), "bw": words(F.col("b_addr"))})
    flat = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    s = _compare("a_name_core", "b_name_core", "a_addr", "b_addr", "a_name_core", "b_name_alt", "a_name_raw", "b_name_raw", flat("a_name_core"), flat("b_name_core"), "a0", "b0", "a0", "ball")
    x = x.withColumn("s", s)
    spaces = lambda c: F.regexp_count(c, F.lit(" "))
    six = lambda tag: {f"{tag}_{k}": F.col(f"s.{tag}_{k}") for k in _COMPARISONS[tag]}
    out = six("nm") | {
        "nm_alt_ratio": F.when(F.col("b_name_alt") != "", F.col("s.alt_tset")).otherwise(F.lit(0.0)),
        "raw_tset": F.col("s.raw_tset"), "raw_ratio": F.col("s.raw_ratio"),
        "nm_nospace_ratio": F.col("s.flat_ratio"), "nm_nospace_partial": F.col("s.flat_partial"),
        "nm_len_a": F.length("a_name_core"), "nm_len_b": F.length("b_name_core"),
        "nm_ntok_diff": spaces("a_name_core") - spaces("b_name_core"),
        "nm_eq": F.col("a_name_core") == F.col("b_name_core"),
        "legal_eq": F.col("a_legal") == F.col("b_legal"), "legal_b_empty": F.col("b_legal") == "", "legal_a_empty": F.col("a_legal") == "",
        "nonlatin_b": F.col("b_nonlatin"),
    } | six("ad") | {
        "ad_empty_b": F.col("b_addr") == "",
        "ad_ntok_a": spaces("a_addr") + 1, "ad_ntok_b": spaces("b_addr") + (F.col("b_addr") != "").cast("int"),
        "ad_alpha_inter": F.size(F.array_intersect("aw", "bw")), "ad_alpha_cov_b": coverage(F.col("aw"), F.col("bw")), "ad_alpha_cov_a": coverage(F.col("bw"), F.col("aw")),
        "num_n_a": F.size("an"), "num_n_b": F.size("bn"), "num_inter": F.size(F.array_intersect("an", "bn")),
        "num_jac": jaccard(F.col("an"), F.col("bn")), "num_b_cov": coverage(F.col("an"), F.col("bn")),
        "num_first_eq": (F.col("a0") == F.col("b0")) & (F.col("a0") != ""), "num_a0_in_b": F.array_contains("bn", F.col("a0")),
        "num_first_lev": F.levenshtein("a0", "b0"), "num_first_partial": F.col("s.a0_partial"), "num_a0_vs_ball_partial": F.col("s.all_partial"),
        "num_len_a0": F.length("a0"),
        "cos": F.col("cos"), "rank_r": F.col("rank_r"), "rank_s": F.col("rank_s"),
    }
    x = x.select("s1_idx", "rec_idx", *(_flag(v).alias(k) for k, v in out.items()), _flag(F.col("src") == 3).alias("src3"))
    x = x.join(s1_freq, "s1_idx", "left").join(rec_freq, "rec_idx", "left")
    return x.withColumns({c: F.col(c).cast("double") for c in ("s1_name_freq", "n_rec_same", "rec_name_freq", "n_s1_same")})


def context_features(df: DataFrame) -> DataFrame:
    """12 features of the competition among a record's and an entity's candidates. Rank ties go to the least ids.

    Needs cos, nm_tset and ad_tset. One window specification a side, so each side is shuffled once.
    """
    r, s = Window.partitionBy("rec_idx"), Window.partitionBy("s1_idx")
    ids = ["s1_idx", "rec_idx"]
    out = df.withColumns({"r_n": F.count(F.lit(1)).over(r).cast("double"), "r_cos_max": F.max("cos").over(r), "r_nm_max": F.max("nm_tset").over(r), "r_ad_max": F.max("ad_tset").over(r), "r_cos_rank": F.row_number().over(r.orderBy(F.desc("cos"), *ids)).cast("double")})
    out = out.withColumns({"s_n": F.count(F.lit(1)).over(s).cast("double"), "s_cos_max": F.max("cos").over(s), "s_cos_rank": F.row_number().over(s.orderBy(F.desc("cos"), *ids)).cast("double")})
    gap = lambda a, b: F.col(a) - F.col(b)
    return out.withColumns({"r_cos_gap": gap("r_cos_max", "cos"), "r_nm_gap": gap("r_nm_max", "nm_tset"), "r_ad_gap": gap("r_ad_max", "ad_tset"), "s_cos_gap": gap("s_cos_max", "cos")})


def consensus_features(df: DataFrame, p: str) -> DataFrame:
    """19 features from first probabilities: competition, and what the entity's other candidates say, weighted by them.

    Needs num_first_eq, ad_tset, nm_tset and ad_empty_b. A weighted mean of the others is that of all without the row's
    own share, over at least 1e-6.
    """
    r, s = Window.partitionBy("rec_idx"), Window.partitionBy("s1_idx")
    ids, w = ["s1_idx", "rec_idx"], F.col(p)
    best = r.orderBy(F.desc(p), *ids)
    out = df.withColumns({
        "rb_max": F.max(p).over(r), "rb_rank": F.row_number().over(best).cast("double"),
        "rb_second": F.coalesce(F.nth_value(p, 2).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.max(p).over(r)),
        "rb_n05": F.count_if(w > 0.5).over(r).cast("double"), "rb_sum": F.sum(p).over(r),
    })
    signals = {"num": "num_first_eq", "ad": "ad_tset", "nm": "nm_tset", "emp": "ad_empty_b"}
    out = out.withColumns({
        "sb_max": F.max(p).over(s), "sb_sum": F.sum(p).over(s), "sb_n05": F.count_if(w > 0.5).over(s).cast("double"), "sb_n09": F.count_if(w > 0.9).over(s).cast("double"),
        "sb_rank": F.row_number().over(s.orderBy(F.desc(p), *ids)).cast("double"),
        **{f"_{k}": F.sum(w * F.col(c)).over(s) for k, c in signals.items()},
    })
    others = F.greatest(F.col("sb_sum") - w, F.lit(1e-6))
    out = out.withColumns({
        "rb_gap": F.when(F.col("rb_rank") == 1, w - F.col("rb_second")).otherwise(w - F.col("rb_max")),
        "sb_sum_other": F.col("sb_sum") - w,
        **{f"peer_{k}": (F.col(f"_{k}") - w * F.col(c)) / others for k, c in signals.items()},
    })
    out = out.withColumns({f"peer_{k}_diff": F.col(signals[k]) - F.col(f"peer_{k}") for k in ("num", "ad", "nm")})
    return out.drop(*(f"_{k}" for k in signals))
