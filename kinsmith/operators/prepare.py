"""Source tables to keyed tables and links, and links to report lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.functions.arrays import distinct_join
from kinsmith.sources.tables import ContractError, with_row_index


def exploded_links(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, entity_id) from comma lists; an empty list has none."""
    return truth.select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("entity_id")).where("entity_id <> ''")


def prepare(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame | None, expected_links: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """s1(s1_idx, ...), rec(rec_idx, ..., src) with S2 first, and links(s1_idx, rec_idx).

    Every linked id has to be found, no record may have two entities, and the number of links may be off by 1 % at most.
    """
    entities = with_row_index(s1, "s1_idx", ["entity_id"])
    both = s2.withColumn("src", F.lit(2).cast("tinyint")).unionByName(s3.withColumn("src", F.lit(3).cast("tinyint")))
    rec = with_row_index(both, "rec_idx", ["src", "entity_id"])
    if truth is None:
        return entities, rec, None
    links = exploded_links(truth).join(entities.select(F.col("entity_id").alias("source1_entity_id"), "s1_idx"), "source1_entity_id", "left").join(rec.select("entity_id", "rec_idx"), "entity_id", "left")
    links = links.select("s1_idx", "rec_idx").persist()
    r = links.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s1_idx").isNull() | F.col("rec_idx").isNull()).alias("lost"), F.count_distinct("rec_idx").alias("recs")).first()
    if r["lost"]:
        raise ContractError(f"{r['lost']} links name unknown ids")
    if r["recs"] != r["n"]:
        raise ContractError(f"{r['n'] - r['recs']} records are linked more than once")
    if expected_links is not None and abs(r["n"] - expected_links) > 0.01 * expected_links:
        raise ContractError(f"{r['n']} links instead of about {expected_links}")
    return entities, rec, links


def export_lists(s1: DataFrame, rec: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, name): the sorted distinct record ids of every entity as a comma list, empty for none."""
    lists = pairs.select("s1_idx", "rec_idx").join(rec.select("rec_idx", F.col("entity_id").alias("id")), "rec_idx").groupBy("s1_idx").agg(distinct_join(F.col("id"), ",").alias(name))
    return s1.select("s1_idx", F.col("entity_id").alias("source1_entity_id")).join(lists, "s1_idx", "left").select("source1_entity_id", F.coalesce(name, F.lit("")).alias(name))


def export_monitors(s1: DataFrame, rec: DataFrame, pairs: DataFrame, partition: str = "country") -> DataFrame:
    """By partition: links an entity, share of entities without any, share of records with any."""
    per_s1 = s1.select("s1_idx", partition).join(pairs.groupBy("s1_idx").agg(F.count(F.lit(1)).alias("n")), "s1_idx", "left").na.fill(0, ["n"])
    a = per_s1.groupBy(partition).agg(F.avg("n").alias("mean_matches"), F.avg((F.col("n") == 0).cast("double")).alias("singleton_rate"))
    b = pairs.select("rec_idx").distinct().withColumn("hit", F.lit(1.0)).join(rec.select("rec_idx", partition), "rec_idx", "right").groupBy(partition).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("assigned_rate"))
    return a.join(b, partition, "full")


def check_lists(lists: DataFrame, s1: DataFrame, rec: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row of counts that are all 0 for a valid report: missing, repeated and unknown entities, unknown record ids,
    records listed twice."""
    ids = lists.select("source1_entity_id", F.explode(F.split(name, ",")).alias("id")).where("id <> ''")
    known = s1.select(F.col("entity_id").alias("source1_entity_id"))
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    checks = {
        "missing": known.join(lists, "source1_entity_id", "left_anti"),
        "unknown": lists.join(known, "source1_entity_id", "left_anti"),
        "repeated": lists.groupBy("source1_entity_id").count().where("count > 1"),
        "unknown_ids": ids.join(rec.select(F.col("entity_id").alias("id")), "id", "left_anti"),
        "listed_twice": ids.groupBy("id").count().where("count > 1"),
    }
    parts = [one(df, "n").select(F.lit(k).alias("check"), "n") for k, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
