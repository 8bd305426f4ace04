"""Token and component equivalences mined from linked pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsmith.functions.arrays import ordered_join
from kinsmith.functions.text import NON_LATIN, clean_address, clean_name, clean_tokens, component_key, tokens

#: Tables up to this many rows may be broadcast; larger ones are joined by shuffling.
MOST_BROADCAST = 200_000
_NUMBER = r"^[0-9]+[a-z]?$"


def hinted(small: DataFrame) -> DataFrame:
    """Broadcast behind a check of its size."""
    return F.broadcast(small) if small.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else small


def best_target(pairs: DataFrame, min_count: int, min_share: float, totals: DataFrame | None = None, changed_only: bool = True) -> DataFrame:
    """(tok, to, count, n, share): each token's most frequent counterpart, if frequent enough. Ties: least `to`.

    n is the token's number of rows, in pairs or in totals(tok, n).
    """
    c = pairs.groupBy("tok", "to").agg(F.count(F.lit(1)).alias("count"))
    n = totals if totals is not None else pairs.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    best = c.withColumn("_r", F.row_number().over(Window.partitionBy("tok").orderBy(F.desc("count"), "to"))).where("_r = 1").drop("_r")
    out = best.join(n, "tok").withColumn("share", F.col("count") / F.col("n")).where((F.col("count") >= min_count) & (F.col("share") >= min_share))
    return out.where("tok <> to") if changed_only else out


def linked_tokens(truth: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    """(s1_idx, rec_idx, n_s1, a_s1, n_rec, a_rec): tokens of names and addresses of both sides of each pair."""

    def side(df: DataFrame, key: str, tag: str) -> DataFrame:
        return df.select(key, tokens(clean_tokens(clean_name(F.col("name")))).alias(f"n_{tag}"), tokens(clean_tokens(clean_address(F.col("address")))).alias(f"a_{tag}"))

    return truth.select("s1_idx", "rec_idx").join(side(s1, "s1_idx", "s1"), "s1_idx").join(side(rec, "rec_idx", "rec"), "rec_idx")


def name_map(linked: DataFrame, min_count: int = 2, min_share: float = 0.5) -> DataFrame:
    """Tokens in other scripts with the Latin token at the same place, where both names have as many tokens."""
    same = linked.where(F.array_join("n_rec", " ").rlike(NON_LATIN) & (F.size("n_rec") == F.size("n_s1")))
    aligned = same.select(F.explode(F.arrays_zip(F.col("n_rec").alias("tok"), F.col("n_s1").alias("to"))).alias("x")).select("x.tok", "x.to")
    return best_target(aligned.where(F.col("tok").rlike(r"[^\x00-\x{024F}]")), min_count, min_share)


def co_occurring(linked: DataFrame, rec: str = "a_rec", s1: str = "a_s1") -> DataFrame:
    """(tok, to): each token that only the record has with each that only the entity has, numbers left out."""
    d = linked.select(F.array_except(rec, s1).alias("r"), F.array_except(s1, rec).alias("s"))
    co = d.select(F.explode("r").alias("tok"), "s").select("tok", F.explode("s").alias("to"))
    return co.where(~F.col("tok").rlike(_NUMBER) & ~F.col("to").rlike(_NUMBER))


def address_map(linked: DataFrame, min_count: int = 5, min_share: float = 0.5, most_rare: float = 0.1) -> DataFrame:
    """Variants of address tokens: mostly paired with one other token, and rare on the entities' side."""
    n = linked.select(F.explode(F.array_except("a_rec", "a_s1")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    found = best_target(co_occurring(linked), min_count, min_share, n)
    side = lambda c, name: linked.select(F.explode(F.array_distinct(c)).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias(name))
    counted = found.join(side("a_s1", "s1_cnt"), "tok", "left").join(side("a_rec", "rec_cnt"), "tok", "left").na.fill(0, ["s1_cnt", "rec_cnt"])
    return counted.where(F.col("s1_cnt") < most_rare * F.col("rec_cnt")).drop("s1_cnt", "rec_cnt")


def with_component_keys(df: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): the components of each address as keys, in order; only names: no digit, at most four words."""
    parts = df.select(key, F.posexplode(F.split("address", ",")).alias("pos", "part")).select(key, "pos", component_key(F.col("part")).alias("k"))
    good = parts.where("k <> '' and not k rlike '[0-9]' and regexp_count(k, ' ') <= 3")
    return good.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda x: x["k"]).alias(out))


def component_map(confident: DataFrame, s1: DataFrame, rec: DataFrame, min_count: int = 500, min_share: float = 0.6) -> DataFrame:
    """(from, to, c, share) from confident pairs(s1_idx, rec_idx): components that only one side has."""
    known = confident.join(s1.select("s1_idx"), "s1_idx", "left_semi").join(rec.select("rec_idx"), "rec_idx", "left_semi").select("s1_idx", "rec_idx")
    x = known.join(with_component_keys(s1, "s1_idx", "a"), "s1_idx", "left").join(with_component_keys(rec, "rec_idx", "b"), "rec_idx", "left")
    x = x.select(F.coalesce("a", F.array()).alias("a"), F.coalesce("b", F.array()).alias("b"))
    d = x.select(F.array_except("b", "a").alias("r"), F.array_except("a", "b").alias("s"))
    n = d.select(F.explode("r").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    co = d.select(F.explode("r").alias("tok"), "s").select("tok", F.explode("s").alias("to"))
    best = best_target(co, min_count, min_share, n, changed_only=False)
    return best.select(F.col("tok").alias("from"), "to", F.col("count").alias("c"), "share")


def apply_components(df: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """df with mapped components of `address` replaced, the others and their order kept."""
    parts = df.select(key, F.posexplode(F.split("address", ",")).alias("pos", "part")).withColumn("k", component_key(F.col("part")))
    found = parts.join(hinted(mapping.select(F.col("from").alias("k"), "to")), "k", "left").withColumn("part", F.coalesce("to", "part"))
    whole = found.groupBy(key).agg(ordered_join("pos", "part", ",").alias("address"))
    return df.drop("address").join(whole, key, "left").na.fill("", ["address"])
