"""Candidate pairs: exact nearest neighbours within partitions, and equal keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from kinsmith.functions.arrays import dot, first, longest

#: Rank of a candidate that a side's list doesn't have.
NOT_RANKED = 255
#: Rows of a block on either side; blocks of queries that share one copy of a base block; up to this many pairs of rows
#: altogether, plain expressions compare them.
QUERY_BLOCK, BASE_BLOCK, COPY_BLOCKS, MOST_PLAIN = 4096, 32_768, 32, 4_000_000
#: A list holds at most this many of a kind's keys, next to each other, however far apart their numbers are. Spark keeps all
#: pairs of two lists in memory before it hands on the first one.
KEY_RANGE = 512


def nearest(queries: DataFrame, base: DataFrame, q: str, b: str, k: int, rank: str, partition: str = "country", most_plain: int | None = None) -> DataFrame:
    """(q, b, cos, rank): the k largest inner products of each query with the base's rows of its partition.

    queries(q, partition, embedding), base(b, partition, embedding). Ranks count from 0, ties (to 9 places) go to the least b. A few
    million pairs are compared by expressions in a plain equal join. Beyond that both sides are cut into blocks of
    bounded size. A base block goes to a task once for each COPY_BLOCKS blocks of queries, which stream past it, a matrix
    product each that keeps k rows a query. So a task holds two blocks, and what is shuffled are the base, and the queries
    once for each base block of their partition.
    """
    most_plain = MOST_PLAIN if most_plain is None else most_plain
    n = queries.groupBy(partition).count().withColumnRenamed("count", "nq").join(base.groupBy(partition).count().withColumnRenamed("count", "nb"), partition)
    x, y = queries.select(q, partition, F.col("embedding").alias("x")), base.select(b, partition, F.col("embedding").alias("y"))
    if (n.agg(F.sum(F.col("nq") * F.col("nb"))).first()[0] or 0) <= most_plain:
        scored = x.join(y, partition).select(q, b, dot(F.col("x"), F.col("y")).alias("cos"))
    else:
        scored = _by_blocks(x, y, q, b, k, partition, n)
    order = Window.partitionBy(q).orderBy(F.desc("cos"), b)
    scored = scored.withColumn("cos", F.round("cos", 9))  # so that equal vectors tie however their products were summed
    return scored.withColumn(rank, F.row_number().over(order) - 1).where(F.col(rank) < k)


def _by_blocks(x: DataFrame, y: DataFrame, q: str, b: str, k: int, partition: str, sizes: DataFrame) -> DataFrame:
    kind = x.schema[partition].dataType.simpleString()
    # every partition is cut by its own size
    blocks = sizes.select(partition, F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("nq"), F.ceil(F.col("nb") / BASE_BLOCK).cast("int").alias("nb"))
    fields = f"{partition} {kind}, block int, nq int, nb int, ids binary, m binary"

    def pack(df: DataFrame, key: str, vector: str, n: str) -> DataFrame:
        def one(group: pd.DataFrame) -> pd.DataFrame:
            ids, m = group[key].to_numpy(np.int64), np.stack(group[vector].to_numpy()).astype(np.float64)
            return group[[partition, "block", "nq", "nb"]].head(1).assign(ids=ids.tobytes(), m=m.tobytes())

        cut = df.join(blocks, partition).withColumn("block", F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
        return cut.groupBy(partition, "block").applyInPandas(one, fields)

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ib, base = np.empty(0, np.int64), np.empty((0, 0))
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                m = np.frombuffer(r.m).reshape(len(ids), -1)
                if r.is_base:
                    ib, base = ids, m
                    continue
                s = np.round(m @ base.T, 9)
                rows, cols = [], []
                for i in range(len(ids)):
                    top = np.arange(len(ib))
                    if len(ib) > k:
                        top = np.flatnonzero(s[i] >= np.partition(s[i], -k)[-k])
                        top = top[np.lexsort((ib[top], -s[i, top]))[:k]]
                    rows.append(np.full(len(top), i))
                    cols.append(top)
                i, j = np.concatenate(rows), np.concatenate(cols)
                yield pd.DataFrame({q: ids[i], b: ib[j], "cos": s[i, j]})

    copies = F.ceil(F.col("nq") / COPY_BLOCKS).cast("int")
    bases = pack(y, b, "y", "nb").select(partition, F.col("block").alias("at"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.lit(True).alias("is_base"), "ids", "m")
    asked = pack(x, q, "x", "nq").select(partition, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("at"), F.pmod("block", copies).cast("int").alias("copy"), F.lit(False).alias("is_base"), "ids", "m")
    keys = [partition, "at", "copy"]
    met = bases.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, F.desc("is_base"))
    return met.select("is_base", "ids", "m").mapInPandas(multiply, f"{q} long, {b} long, cos double")


def dense_candidates(s1: DataFrame, rec: DataFrame, k_rec: int, k_s1: int, partition: str = "country") -> DataFrame:
    """(rec_idx, s1_idx, cos, rank_r, rank_s): both directions' nearest, as one full outer join."""
    r = nearest(rec, s1, "rec_idx", "s1_idx", k_rec, "rank_r", partition)
    s = nearest(s1, rec, "s1_idx", "rec_idx", k_s1, "rank_s", partition).withColumnRenamed("cos", "cos_s")
    both = r.join(s, ["rec_idx", "s1_idx"], "full")
    rank = lambda c: F.coalesce(F.col(c), F.lit(NOT_RANKED)).cast("smallint").alias(c)
    return both.select("rec_idx", "s1_idx", F.coalesce("cos", "cos_s").alias("cos"), rank("rank_r"), rank("rank_s"))


def lexical_keys(norm: DataFrame, key: str, partition: str = "country") -> DataFrame:
    """(key, partition, k1, k2, k3): the name, the first number with the longest word, the first name word with the number.

    A key is null where a part is missing; names count from three characters on.
    """
    number = first(F.col("nums"))
    word = longest(F.regexp_extract_all(F.col("addr"), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0)))
    return norm.select(
        key, partition,
        F.when(F.length("name_core") >= 3, F.col("name_core")).alias("k1"),
        F.concat(number, F.lit("|"), word).alias("k2"),
        F.concat(first(F.split("name_core", " ")), F.lit("|"), number).alias("k3"),
    )


def lexical_candidates(s1_keys: DataFrame, rec_keys: DataFrame, max_block: int = 50, partition: str = "country") -> DataFrame:
    """(rec_idx, s1_idx) that share a key within a partition; keys of more than max_block entities are left out.

    The three keys are one long table with the kind as part of the key, so there is one join.
    """

    def long(df: DataFrame, key: str) -> DataFrame:
        kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("k1", "k2", "k3")))
        return df.select(key, partition, F.inline(kinds)).where("value is not null")

    s = long(s1_keys, "s1_idx")
    few = s.groupBy(partition, "kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_block).drop("n")
    on = [partition, "kind", "value"]
    return long(rec_keys, "rec_idx").join(s.join(few, on, "left_semi"), on).select("rec_idx", "s1_idx").distinct()


def add_lexical(dense: DataFrame, lexical: DataFrame, s1: DataFrame, rec: DataFrame) -> DataFrame:
    """Dense candidates and the pairs that only keys found, with their inner products, unranked; `lex` marks the latter."""
    new = lexical.join(dense, ["rec_idx", "s1_idx"], "left_anti")
    scored = new.join(s1.select("s1_idx", F.col("embedding").alias("x")), "s1_idx").join(rec.select("rec_idx", F.col("embedding").alias("y")), "rec_idx")
    none = F.lit(NOT_RANKED).cast("smallint")
    more = scored.select("rec_idx", "s1_idx", dot(F.col("x"), F.col("y")).alias("cos"), none.alias("rank_r"), none.alias("rank_s"), F.lit(True).alias("lex"))
    return dense.withColumn("lex", F.lit(False)).unionByName(more)


def pairs_of_kinds(df: DataFrame, key: str, within: Sequence[str], kind: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows with equal `within`, and a lesser key first, by kinds: what depends on kinds alone is computed once.

    Rows of equal `within` and `kind` are of one kind; first rows also differ by `more`. A row of the result is two kinds
    (a_<column>, b_<column>) and the keys that each has (a_keys, b_keys); spelled_out() makes pairs of keys from it. Rows of equal `within` meet in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: small lists make many pairs
    rows = df.select(key, *within, *kind, *more).repartition(n, *within)

    def side(tag: str, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*within, *by).orderBy(key)) - 1
        lists = rows.withColumn("range", F.floor(place / KEY_RANGE)).groupBy(*within, *by, "range").agg(F.collect_list(key).alias("keys"), F.min(key).alias("least"), F.max(key).alias("most"))
        return lists.select(*within, *(F.col(c).alias(f"{tag}_{c}") for c in (*by, "keys", "least", "most")))

    met = side("a", *kind, *more).join(side("b", *kind).hint("merge"), list(within)).where("a_least < b_most")
    return met.drop(*within, "a_least", "a_most", "b_least", "b_most")


def spelled_out(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of pairs_of_kinds() as pairs of keys, a less than b, with all other columns."""
    each = pairs.withColumn(a, F.explode("a_keys")).drop("a_keys").withColumn(b, F.explode("b_keys")).drop("b_keys")
    return each.where(F.col(a) < F.col(b))


@arrow_udf(LongType())
def _pairs_in_order(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many pairs of a key of a and a larger one of b each row has; keys count by their places among the batch's."""
    row_a, row_b = (np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in (a, b))
    x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
    keys = np.unique(np.concatenate([x, y]))
    step = len(keys)
    y = np.sort(row_b * step + np.searchsorted(keys, y))
    more = np.searchsorted(y, (row_a + 1) * step) - np.searchsorted(y, row_a * step + np.searchsorted(keys, x), "right")
    return pa.array(np.bincount(row_a, more, len(a)).astype(np.int64))


def counted(pairs: DataFrame, n: str) -> DataFrame:
    """Rows of pairs_of_kinds() with how many pairs of keys each has, instead of the keys; rows without any are left out."""
    return pairs.withColumn(n, _pairs_in_order("a_keys", "b_keys")).drop("a_keys", "b_keys").where(F.col(n) > 0)
