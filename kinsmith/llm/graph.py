"""Connected components of a link table, without ever gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.llm.common import discard, materialize


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable, for each node with a link to another.

    Alternates two star operations until nothing changes: every node's larger neighbours are hung on its smallest
    neighbour, then every node and its smaller neighbours. Each needs a minimum by node, which aggregates before the
    shuffle, and a join in which a node with very many links is an ordinary skewed key. The number of rounds grows with
    the logarithm of the longest chain. No links give no rows; null ends are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialize(e, "edges")
    before = _state(e)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        old, e = e, materialize(small, "small")
        discard(old, large)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out.stored_at = e.stored_at  # what the result reads, for discard()
    return out
