"""Reading and writing with explicit schemas, and checks as aggregates."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_COLUMNS = ("entity_id", "business_name", "business_address", "country")


class ContractError(ValueError):
    """A table breaks what its reader promises."""


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], empty_for_missing: bool = True) -> DataFrame:
    """Verbatim text: tab-separated with a header, no quoting, no trimming, all strings; missing is empty, or null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    df = reader.option("enforceSchema", False).csv(path)
    return df.na.fill("") if empty_for_missing else df


def write_tsv(df: DataFrame, path: str, order: str | None = None, one_file: bool = False) -> None:
    """Unquoted TSV, the report format, in part files; rows in order of one column if given, from file to file.

    One file, which takes one task, only on request.
    """
    rows = df.repartition(1) if one_file else df.repartitionByRange(order) if order else df
    if order:
        rows = rows.sortWithinPartitions(order)
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def check_entities(df: DataFrame, prefix: str, expected_rows: int | None = None) -> DataFrame:
    """The same rows, after checking in one pass that ids are unique, present and begin with a prefix, and how many there are."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("ids"), F.count_if(~F.coalesce(F.col("entity_id").startswith(prefix), F.lit(False))).alias("bad")).first()
    if r["ids"] != r["n"]:
        raise ContractError(f"{r['n'] - r['ids']} repeated or missing entity ids")
    if r["bad"]:
        raise ContractError(f"{r['bad']} entity ids without the prefix {prefix!r}")
    if expected_rows is not None and r["n"] != expected_rows:
        raise ContractError(f"{r['n']} rows instead of {expected_rows}")
    return df


def read_source(spark: SparkSession, path: str, prefix: str, expected_rows: int | None = None) -> DataFrame:
    """Entities of one source: entity_id, name, address, country."""
    df = check_entities(read_tsv(spark, path, ENTITY_COLUMNS), prefix, expected_rows)
    return df.withColumnsRenamed({"business_name": "name", "business_address": "address"})


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def count_rows(spark: SparkSession, path: str) -> int:
    """From the files' footers."""
    return spark.read.parquet(path).count()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this library that the driver and all executors share: in spark.checkpoint.dir; without it, where Spark
    runs on one machine a temporary one, and else in the warehouse."""
    for get in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := get():
            return f"{found.rstrip('/')}/kinsmith"
    if not spark.sparkContext.master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kinsmith"
    own = tempfile.mkdtemp(prefix="kinsmith-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}/kinsmith"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: a cut lineage that outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, name: str, order: Sequence[Column | str], groups: Sequence[str] = ()) -> DataFrame:
    """Numbers from 0 in the given order within each group, or over all rows, for groups of any size.

    Rows are range-partitioned by group and order and sorted, so that a large group spreads over many tasks, and get
    consecutive ids. For each partition and group, a small table then has the first id and how many rows of the group come
    before. The sorted rows are stored first, because a second evaluation could cut the ranges elsewhere.
    """
    keys = [*groups, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    rows = stored(rows, "ranked")
    sizes = rows.groupBy("_p", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_p").alias("_q"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = rows.join(shift, on)
    return out.withColumn(name, F.col("_i") + F.col("_shift")).select(*df.columns, name)


def with_row_index(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Dense numbers from 0 in order of the given columns, without sorting all rows in one place."""
    return with_rank(df, name, order)


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write, and read again from there. The path must not be one that df reads."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_config(path: str | Path, overrides: Sequence[str] = ()) -> dict:
    """YAML settings with ~ and environment variables expanded in texts; overrides are section.key=value.

    An override takes the type of the value it replaces; unknown keys are an error.
    """
    import os

    import yaml

    def expand(x: object) -> object:
        if isinstance(x, dict):
            return {k: expand(v) for k, v in x.items()}
        return os.path.expandvars(os.path.expanduser(x)) if isinstance(x, str) else x

    config = expand(yaml.safe_load(Path(path).read_text()))
    for item in overrides:
        name, _, value = item.partition("=")
        *section, key = name.split(".")
        at = config
        for s in section:
            at = at[s]
        if key not in at:
            raise KeyError(name)
        old = at[key]
        if isinstance(old, bool):
            if value.lower() not in ("true", "false"):
                raise ValueError(f"{name} is true or false")
            at[key] = value.lower() == "true"
        else:
            at[key] = type(old)(value) if old is not None else value
    return config


def write_json(value: object, path: str | Path) -> None:
    Path(path).write_text(json.dumps(value, indent=1, sort_keys=True))
