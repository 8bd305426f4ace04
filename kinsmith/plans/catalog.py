"""Registry of queries over the driver's tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType)


class Tables:
    """The driver's tables by name, and the linkage roles that they play."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def s1(self) -> DataFrame:
        """Customers as entities; the nation is the partition."""
        return self.customer.select(F.col("c_custkey").alias("s1_idx"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"))

    def truth(self) -> DataFrame:
        """Links of some orders to their customers, so that some customers have none."""
        return self.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("s1_idx"), F.col("o_orderkey").alias("rec_idx"))

    def candidates(self) -> DataFrame:
        """Three customers for each order, the right one among them, with scores from whole-number arithmetic."""
        n = self.customer.count()
        o = self.orders.select(F.col("o_orderkey").alias("rec_idx"), F.col("o_custkey").alias("c"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))).alias("d"))
        o = o.withColumn("s1_idx", (F.col("c") + F.col("d")) % n)
        m = (F.col("rec_idx") * 31 + F.col("s1_idx") * 17) % 1000
        own = F.when(F.col("d") == 0, 500 + F.floor(m / 2)).otherwise(F.floor(m * 7 / 10))
        o = o.withColumn("p", own.cast("double") / 1000)
        mod = lambda a, b, k: ((F.col("rec_idx") * a + F.col("s1_idx") * b) % k).cast("double")
        return o.select("rec_idx", "s1_idx", "p", mod(7, 3, 101).alias("nm_tset"), mod(5, 11, 101).alias("ad_tset"), mod(1, 1, 2).alias("num_first_eq"), (F.col("rec_idx") % 5 == 0).cast("double").alias("ad_empty_b"))


#: The same roles for SQL, to put after WITH.
ROLES = """
s1 as (select c_custkey s1_idx, c_name name, c_nationkey country from customer),
truth as (select o_custkey s1_idx, o_orderkey rec_idx from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'),
cand0 as (select o_orderkey rec_idx, (o_custkey + d) % (select count(*) from customer) s1_idx, d from orders, (values (0), (1), (7)) v(d)),
cand1 as (select *, (rec_idx * 31 + s1_idx * 17) % 1000 m from cand0),
cand as (select rec_idx, s1_idx, (case when d = 0 then 500 + m // 2 else m * 7 // 10 end)::double / 1000::double p, ((rec_idx * 7 + s1_idx * 3) % 101)::double nm_tset,
  ((rec_idx * 5 + s1_idx * 11) % 101)::double ad_tset, ((rec_idx + s1_idx) % 2)::double num_first_eq, (rec_idx % 5 = 0)::int::double ad_empty_b from cand1)
"""


def query(name: str, sql: str | None = None, rounded: Collection[str] = ()) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register f(tables). Whole numbers become long and floats double, as the SQL has them, doubles to 6 places.

    The columns `rounded` are doubles that f has rounded before it repeats them.
    """

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            cols = []
            for field in df.schema.fields:
                c = F.col(f"`{field.name}`")
                if isinstance(field.dataType, _WHOLE):
                    c = c.cast("long")
                elif isinstance(field.dataType, T.FloatType | T.DoubleType) and field.name not in rounded:
                    c = F.round(c.cast("double"), 6)
                cols.append(c.alias(field.name))
            return df.select(*cols)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return put
