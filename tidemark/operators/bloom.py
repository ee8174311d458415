"""Bloom filters of bounded size, built and tested inside the JVM.

They use Catalyst's own filter expressions, which have no name in SQL, so they
need a session that lives in the driver's JVM (not a remote one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import col, materialize, scratch_path

#: Bits of one filter at most (4 MiB).
MAX_BITS = 1 << 25
#: Filters that a stage holds at once (64 MiB).
TOGETHER = 16


def _expression(spark: SparkSession, make) -> Column:
    """A column from a Catalyst expression."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = spark.sparkContext._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return ClassicColumn(utils.column(make(jvm.org.apache.spark.sql.catalyst.expressions, utils.expression)))


def _aggregate(spark: SparkSession, hashed: Column, keys: int, bits: int) -> Column:
    """The filter over a column of hashes, as an aggregate."""

    def make(expressions, expression):
        lit = lambda n: expression(F.lit(n).cast("bigint")._jc)
        filled = expressions.aggregate.BloomFilterAggregate(expression(hashed._jc), lit(max(keys, 1)), lit(bits))
        return filled.toAggregateExpression()

    return _expression(spark, make)


class BloomFilter:
    """Definite "no" for keys that are not in a column; "perhaps" for the rest.

    The keys' hashes are cut into ranges, each with a filter of its own, so that
    no filter grows beyond its bound and none loses its selectivity, however
    many keys there are.  The filters lie in a table.
    """

    def __init__(self, spark: SparkSession, filters: DataFrame | None, keys: int, ranges: int, bits: int) -> None:
        self._spark, self._filters, self.keys, self.ranges, self.bits = spark, filters, keys, ranges, bits

    @property
    def false_positive_rate(self) -> float:
        """Expected share of absent keys that pass."""
        if not self.keys:
            return 0.0
        keys = self.keys / self.ranges
        k = max(1, round(self.bits / keys * math.log(2)))
        return (1 - math.exp(-k * keys / self.bits)) ** k

    def _test(self, hashed: Column, ranges: range) -> Column:
        """The test of each hash against the filter of its range, for some ranges."""
        out = F.lit(False)
        for r in ranges:
            filled = self._filters.where(F.col("range") == r).select("filter").scalar()
            passes = _expression(self._spark, lambda e, x, f=filled: e.BloomFilterMightContain(x(f._jc), x(hashed._jc)))
            passes = F.coalesce(passes, F.lit(False))  # a range without keys has no filter
            out = passes if self.ranges == 1 else F.when(_range(hashed, self.ranges) == r, passes).otherwise(out)
        return out

    def might_contain(self, key: Column) -> Column:
        """False only if the key is certainly absent; null for a null key.

        Only for as many filters as a stage can hold; :meth:`mark` has no bound.
        """
        if self.ranges > TOGETHER:
            raise ValueError(f"{self.ranges} filters are too many for one expression; use mark")
        if not self.keys:
            return F.when(key.isNotNull(), F.lit(False))
        return F.when(key.isNotNull(), self._test(F.xxhash64(key), range(self.ranges)))

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with a column ``name``: the result of the test of column ``key``.

        With more filters than a stage can hold the rows are written once, cut by
        groups of ranges, and each group is read and tested by itself.
        """
        if self.ranges <= TOGETHER:
            return rows.withColumn(name, self.might_contain(col(key)))
        groups = -(-self.ranges // TOGETHER)
        hashed = F.xxhash64(col(key))
        path = scratch_path(self._spark, "ranges")
        place = F.coalesce(F.floor(_range(hashed, self.ranges) / TOGETHER), F.lit(0)).cast("int")
        rows.withColumn("__group", place).write.partitionBy("__group").parquet(path)
        stored = self._spark.read.schema(rows.withColumn("__group", place).schema).parquet(path)
        out = None
        for g in range(groups):
            held = range(g * TOGETHER, min(self.ranges, (g + 1) * TOGETHER))
            part = stored.where(F.col("__group") == g).drop("__group")
            part = part.withColumn(name, F.when(col(key).isNotNull(), self._test(hashed, held)))
            part = materialize(part, "marked")  # so that the driver holds the filters of one group at a time
            out = part if out is None else out.unionByName(part)
        return out


def _range(hashed: Column, ranges: int) -> Column:
    """Range of a hash; taken from its high bits, which the filters use less than the low ones."""
    return F.pmod(F.shiftright(hashed, 20), F.lit(ranges)).cast("int")


def bloom_filter(df: DataFrame, key: str, *, bits_per_key: int = 10, max_bits: int = MAX_BITS) -> BloomFilter:
    """Filter over the distinct non-null values of ``key``, ``bits_per_key`` bits a key.

    More keys than ``max_bits`` are enough for are spread over several filters by
    ranges of their hash.  Each filter is a distributed aggregate.  Over an empty
    column no key passes.
    """
    spark = df.sparkSession
    keys = df.where(col(key).isNotNull()).select(F.xxhash64(col(key)).alias("h"))
    n = keys.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    ranges = max(1, math.ceil(n * bits_per_key / max_bits))
    # ranges differ a little in size, and n is an estimate
    bits = max(64, min(max_bits, math.ceil(n * bits_per_key / ranges)))
    if not n:
        return BloomFilter(spark, None, 0, 1, bits)
    if ranges > 1:  # one task a range, over distinct hashes
        keys = keys.distinct().repartition(ranges, _range(F.col("h"), ranges))
    filled = _aggregate(spark, F.col("h"), math.ceil(n / ranges), bits)
    made = keys.groupBy(_range(F.col("h"), ranges).alias("range")).agg(filled.alias("filter"))
    return BloomFilter(spark, materialize(made, "filters"), n, ranges, bits)
