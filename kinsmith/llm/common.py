"""Helpers shared by the operators of this subpackage: shared storage, word hashing, reading tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the maximal runs without space, tab, line feed, vertical tab, form feed or carriage return,
#: which are the bytes that bytes.split() splits at.
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; without it, where Spark runs on one machine
    a folder of our own, as in tests, and else the warehouse."""
    for get in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := get():
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own = tempfile.mkdtemp(prefix="kinsmith-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Paths of the tables that materialize() has written and that are still there.
_TABLES: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again. A lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinsmith/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _TABLES.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "stored_at", None)) in _TABLES:
            _delete(df.sparkSession, [path])


def tables_written() -> list[str]:
    """Paths of all materialized tables that are still there."""
    return list(_TABLES)


def discard_since(before: list[str], keep: DataFrame) -> None:
    """Delete all materialized tables but those that were there before, and `keep`, which has to be one itself."""
    _delete(keep.sparkSession, [p for p in _TABLES if p not in before and p != keep.stored_at])


def small_batches(df: DataFrame) -> DataFrame:
    """Bound what Arrow holds at once for each task: texts can be long, and a batch is held on both sides of the pipe.

    Both are settings of the session, and plans read them when they run, so they stay; smaller values are left alone.
    """
    conf = df.sparkSession.conf
    for name, most, now in (("maxRecordsPerBatch", 1000, "10000"), ("maxBytesPerBatch", 4 << 20, "64MB")):
        if not 0 < _bytes(conf.get(f"spark.sql.execution.arrow.{name}", now)) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def _bytes(setting: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    number = setting.strip().lower().removesuffix("b")
    return int(number) if number.lstrip("-").isdigit() else int(number[:-1]) * units[number[-1]]


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words of a whole text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets all words when it holds more than `most`, so its memory is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, in order; fewer words give one for the whole sequence, none give none."""
    n = len(h)
    if n == 0:
        return h
    width = min(n, size)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width) * _M2, np.uint64)
        for k in range(width):
            out = (out + h[k : n - width + 1 + k]) * _GOLDEN
            out ^= out >> np.uint64(29)
        return mix(out)


def column_slices(batches: Iterator, step: int = 256) -> Iterator[dict[str, list]]:
    """Arrow batches as small dicts of Python lists, so that few texts are held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
