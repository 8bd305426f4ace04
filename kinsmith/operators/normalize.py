"""Normal forms of names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.functions.arrays import filled, without_repeats
from kinsmith.functions.text import (
    LEGAL_FORMS, NON_LATIN, STREET_WORDS, clean_address, clean_name, clean_tokens, is_non_latin, numbers, other_name, replace_by, romanized, tokens, without_other_name,
)
from kinsmith.operators.mining import apply_components, hinted


def map_tokens(long: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """long(..., tok) with mined targets in place of tokens, and what is then still in another script romanized.

    Tokens are romanized once for each distinct one.
    """
    if mapping is not None:
        long = long.join(hinted(mapping.select("tok", "to")), "tok", "left").withColumn("tok", F.coalesce("to", "tok")).drop("to")
    other = long.where(F.col("tok").rlike(NON_LATIN)).select("tok").distinct().withColumn("latin", romanized("tok"))
    return long.join(other, "tok", "left").withColumn("tok", F.coalesce("latin", "tok")).drop("latin")


def normalize(df: DataFrame, key: str, names: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """(key, name_raw, nonlatin, name_core, name_alt, legal, addr, nums) of df(key, name, address).

    Tokens go through the mined map, romanization and the fixed table, in this order; equal neighbours count once. Legal
    forms leave the name wherever they stand. Null names and addresses are empty.
    """
    name = clean_name(F.coalesce("name", F.lit("")))
    base = df.select(key, name.alias("_name"), clean_tokens(clean_address(F.coalesce("address", F.lit("")))).alias("_addr"))
    base = base.withColumns({"name_raw": clean_tokens(F.col("_name")), "_core": clean_tokens(without_other_name(F.col("_name"))), "_alt": clean_tokens(other_name(F.col("_name")))})
    parts = base.select(key, F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.col(c).alias("text")) for w, c in (("n", "_core"), ("o", "_alt"), ("a", "_addr"))))).alias("p"))
    long = parts.select(key, "p.w", F.posexplode(tokens(F.col("p.text"))).alias("pos", "tok")).where("tok <> ''")
    mapped = map_tokens(long.where("w <> 'a'"), names).unionByName(map_tokens(long.where("w = 'a'"), addresses).withColumn("tok", replace_by(F.col("tok"), STREET_WORDS)))
    texts = mapped.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("w") == w, F.struct("pos", "tok")))).alias(w) for w in "noa"))
    # a mapped token can be several words, so tokens are split once more
    words = lambda w: without_repeats(filled(F.flatten(F.transform(F.coalesce(w, F.array()), lambda x: F.split(x["tok"], " ")))))
    legal = lambda t: replace_by(t, LEGAL_FORMS, keep=False)
    core = lambda ws: F.array_join(F.filter(ws, lambda t: legal(t).isNull()), " ")
    out = base.select(key, "name_raw", is_non_latin(F.col("name_raw")).alias("nonlatin")).join(texts, key, "left")
    forms = F.array_sort(F.array_distinct(F.filter(F.transform(words("n"), legal), lambda t: t.isNotNull())))
    out = out.select(key, "name_raw", "nonlatin", core(words("n")).alias("name_core"), core(words("o")).alias("name_alt"), F.array_join(forms, " ").alias("legal"), F.array_join(words("a"), " ").alias("addr"))
    return out.withColumn("nums", numbers(F.col("addr")))


def normalize_split(df: DataFrame, key: str, names: DataFrame | None, addresses: DataFrame | None, component_map: DataFrame | None) -> DataFrame:
    """normalize(), with address components replaced first where such a map was mined."""
    return normalize(apply_components(df, key, component_map) if component_map is not None else df, key, names, addresses)


def texts_for_embedding(norm: DataFrame, key: str) -> DataFrame:
    """(key, text): the template for embeddings."""
    return norm.select(key, F.concat(F.lit("query: "), "name_core", F.lit(" "), "legal", F.lit(" | "), "addr").alias("text"))
