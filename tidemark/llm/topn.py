"""The N highest-scoring items of every group, by bisection of cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import MIN_HEAVY_ROWS, heavy_keys, is_heavy
from tidemark.scratch import BucketedRuns, col, materialize

_LOWEST = -(1 << 63)
#: Cutoff tables of up to this many groups are broadcast (about 50 bytes a group).
BROADCAST_GROUPS = 100_000
#: Bits of the code that one round decides: 8 halvings, 256 midpoints counted at once.
BITS = 8


def order_code(c: Column, kind: T.DataType) -> Column:
    """A long that orders like ``c``."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10**kind.scale)).cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), d).cast("bigint")
        return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    raise TypeError(f"cannot order {kind.simpleString()} by a long code")


def _unsigned(c: Column) -> Column:
    return c.bitwiseXOR(F.lit(_LOWEST))


class _Items:
    """The items of all groups, and how they meet one row of state per group.

    While the groups are few the state is broadcast.  Otherwise the items lie
    hash-bucketed by group, written once, and the state, one row a group, comes to
    the buckets: no round shuffles items.  Groups that hold very many items
    are spread over all buckets by their identifiers' hash, and their state, a bounded list, is broadcast.
    """

    def __init__(self, items: DataFrame, groups: int, heavy: list) -> None:
        self.spark, self.heavy, self.many = items.sparkSession, heavy, groups > BROADCAST_GROUPS
        if not self.many:
            self.rows = materialize(_once(items, []).select("g", "c1", "c2", "s"), "items")
            return
        types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
        ddl = f"h bigint, g {types['g']}, c1 bigint, c2 bigint, s {types['s']}"
        store = BucketedRuns(self.spark, ["h", "g"], ddl, hashed=True)
        hot = is_heavy(F.col("g"), heavy)
        placed = items.withColumn("h", F.when(hot, F.xxhash64("i")).otherwise(F.xxhash64("g")))
        # by bucket first, so that the removal of repeated items and the writing share one shuffle; repeated items of
        # heavy groups are combined before it
        parts = [_once(placed.where(~hot).repartition(store.buckets, "h", "g"), ["h"])]
        if heavy:
            parts.append(_once(placed.where(hot), ["h"]))
        store.write(parts, 0)
        self.rows = store.frame().drop(BucketedRuns.RUN)

    def bounds(self, bounds: list[Column]) -> DataFrame:
        """Number and bounds of the items per group."""
        if not self.many:
            return self.rows.groupBy("g").agg(F.count("*").alias("n"), *bounds)
        hot = is_heavy(F.col("g"), self.heavy)
        cold = self.rows.where(~hot).groupBy("h", "g").agg(F.count("*").alias("n"), *bounds).drop("h")
        if not self.heavy:
            return cold
        return cold.unionByName(self.rows.where(hot).groupBy("g").agg(F.count("*").alias("n"), *bounds))

    def meet(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """``rows`` (items, or some of them) of the groups in ``state``, with its columns beside ``sg``."""
        if not self.many:
            return rows.join(F.broadcast(state), F.col("g") == F.col("sg")).drop("sg")
        packed = state.select("sg", F.struct(*[c for c in state.columns if c != "sg"]).alias("st"))
        # items of a heavy group have other hashes than their group's
        cold = packed.where(~is_heavy(F.col("sg"), self.heavy)).withColumn("sh", F.xxhash64("sg"))
        out = rows.join(cold.hint("merge"), (F.col("h") == F.col("sh")) & (F.col("g") == F.col("sg")), "left").drop("sg", "sh")
        if self.heavy:
            hot = packed.where(is_heavy(F.col("sg"), self.heavy)).select(F.col("sg").alias("hg"), F.col("st").alias("ht"))
            out = out.join(F.broadcast(hot), F.col("g") == F.col("hg"), "left").drop("hg")
            out = out.withColumn("st", F.coalesce("st", "ht")).drop("ht")
        return out.where(F.col("st").isNotNull()).select(*rows.columns, "st.*")


def _once(items: DataFrame, more: list[str]) -> DataFrame:
    """Items with the highest score of each identifier."""
    once = items.groupBy("g", *more, "i").agg(F.max("c1").alias("c1"), F.max("s").alias("s"))
    return once.withColumn("c2", F.bitwise_not("i"))


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest score, lowest identifier first among equals.

    Output: ``group``, ``ident``, ``score``; exactly ``min(n, items)`` rows per group.

    Method: every item has an order-preserving code, the score followed by the
    complement of the identifier, which makes it unique in its group.  Per group
    an interval of codes is kept that must contain the cutoff.  A round counts,
    for all groups at once, the items above 255 midpoints of the interval (eight
    halvings by bits) with partial aggregation, and keeps the part in which the
    count reaches ``n``, shrunk to the codes that occur there.  A group is done
    when its count is exactly ``n``.  No rows of a group are ever gathered: a
    round sends at most 256 counts per group and task.  The second round writes
    down the items that lie in the intervals it found, and later rounds read only those that
    the one before left.  At most 17 rounds are needed; real data takes three or four.

    An identifier that occurs several times in a group counts once, with its
    highest score.  Rows with null group, score or identifier are left out;
    empty input gives no rows.  ``ident`` must be integral, ``score`` numeric, a
    date or a time.  Other columns are ignored, whatever their names.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    raw = df.select(
        col(group).alias("g"), order_code(col(score), kinds[score]).alias("c1"), col(ident).cast("bigint").alias("i"), col(score).alias("s")
    ).where(F.col("g").isNotNull() & F.col("c1").isNotNull() & F.col("i").isNotNull())
    total, groups = raw.agg(F.count(F.lit(1)), F.approx_count_distinct("g")).first()
    heavy = heavy_keys(raw, F.col("g"), min_rows=MIN_HEAVY_ROWS, total=total) if groups > BROADCAST_GROUPS else []
    items = _Items(raw, groups, heavy)

    bounds = [f(c).alias(a) for f, c, a in ((F.min, "c1", "lo1"), (F.max, "c1", "hi1"), (F.min, "c2", "lo2"), (F.max, "c2", "hi2"))]
    start = items.bounds(bounds)
    start = materialize(start.withColumnRenamed("g", "sg").withColumn("need", F.lit(n).cast("bigint")), "bounds")
    done = [start.where(F.col("n") <= n).select("sg", F.lit(_LOWEST).alias("cut1"), F.lit(_LOWEST).alias("cut2"))]
    active = start.where(F.col("n") > n).select("sg", "lo1", "hi1", "lo2", "hi2", "need")
    left = active.count() if n > 0 else 0
    rows = items.rows.drop("s")
    codes = rows.columns
    first = True
    while left:
        by_score = F.col("lo1") < F.col("hi1")
        lo, hi = (_unsigned(F.when(by_score, F.col(a)).otherwise(F.col(b))) for a, b in (("lo1", "lo2"), ("hi1", "hi2")))
        # position of the highest bit in which the two ends differ
        width = F.length(F.bin(lo.bitwiseXOR(hi)))
        state = active.withColumn("by_score", by_score).withColumn("shift", F.greatest(F.lit(0), width - F.lit(BITS)).cast("int"))
        near = items.meet(rows, state).where(
            F.col("c1").between(F.col("lo1"), F.col("hi1")) & (F.col("by_score") | F.col("c2").between(F.col("lo2"), F.col("hi2")))
        )
        if not first:  # in the first round nothing falls away but groups that are done
            near = materialize(near, "near")
            rows = near.select(*codes)
        first = False
        near = near.withColumn("u", _unsigned(F.when(F.col("by_score"), F.col("c1")).otherwise(F.col("c2"))))
        near = near.withColumn("part", F.expr("shiftrightunsigned(u, shift)"))
        counts = near.groupBy("g", "need", "by_score", "part").agg(F.count("*").alias("n"), *bounds)
        # at most 256 rows per group
        above = F.sum("n").over(Window.partitionBy("g").orderBy(F.col("part").desc()))
        hit = counts.withColumn("above", above).where((F.col("above") >= F.col("need")) & (F.col("above") - F.col("n") < F.col("need")))
        hit = materialize(hit, "cutoffs")
        exact = F.col("above") == F.col("need")
        cut2 = F.when(F.col("by_score"), F.lit(_LOWEST)).otherwise(F.col("lo2"))
        done.append(hit.where(exact).select(F.col("g").alias("sg"), F.col("lo1").alias("cut1"), cut2.alias("cut2")))
        active = hit.where(~exact).select(
            F.col("g").alias("sg"), "lo1", "hi1", "lo2", "hi2", (F.col("need") - F.col("above") + F.col("n")).alias("need")
        )
        left = active.count()
    cuts = done[0]
    for c in done[1:]:
        cuts = cuts.unionByName(c)
    if n <= 0:
        cuts = cuts.where(F.lit(False))
    inside = (F.col("c1") > F.col("cut1")) | ((F.col("c1") == F.col("cut1")) & (F.col("c2") >= F.col("cut2")))
    found = items.meet(items.rows, cuts).where(inside)
    return found.select(F.col("g").alias(group), F.bitwise_not("c2").alias(ident), F.col("s").alias(score))
