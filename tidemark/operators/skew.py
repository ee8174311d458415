"""Joins and per-key results that a few heavy keys cannot slow down.

Heavy keys are found on a bounded sample.  At most ``2 / share`` keys can pass
the threshold, whatever the size of the data, so the list that comes to the
driver and what is broadcast for it has a fixed bound.  The sample only decides
how a row is processed, never what comes out: a key that is missed goes the
ordinary way and gets the same result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import col, own_columns, shuffle_partitions

#: Rows that the heavy-key sample has at most on average.
SAMPLE_ROWS = 400_000
#: A key with fewer rows than this is never worth a way of its own.
MIN_HEAVY_ROWS = 50_000
#: Rows of the smaller side that may be broadcast for heavy keys.
BROADCAST_ROWS = 100_000
#: Pairs of one key up to which a full join is left to Spark, whose generated code holds them all in memory.
KEY_PAIRS = 100_000
#: Pairs that a task of a spread full join makes.
TASK_PAIRS = 20_000_000
#: Rows of one key that an anti-join on more than the key may hold in memory: Spark keeps all that a row is compared with.
HELD_ROWS = 200_000


def balanced_share(spark: SparkSession) -> float:
    """Share from which a key counts as heavy: what two average shuffle partitions hold.

    A lighter key cannot make a task much longer than the others.  It lies
    between 0.2 % and 0.01 %, which bounds the number of heavy keys by 20,000.
    """
    return max(1e-4, min(2e-3, 2 / shuffle_partitions(spark)))


def heavy_keys(
    df: DataFrame,
    key: Column,
    *,
    share: float | None = None,
    sample_rows: int = SAMPLE_ROWS,
    min_rows: int = 0,
    total: int | None = None,
    seed: int = 7,
) -> list:
    """Values of ``key`` that hold about ``share`` of all rows of ``df`` or more.

    A Bernoulli sample of about ``sample_rows`` rows is counted; a key passes if
    its share of the sample is at least half of ``share``.  At 1 % a key is
    missed with a probability below 1e-50 (an expected count of 4,000 would have
    to come out below 2,000), at the least share, 0.01 %, with about 0.1 %.
    Null is never returned.  An empty input gives an empty list.  ``min_rows``
    drops keys estimated to hold fewer rows.  ``share`` is
    :func:`balanced_share` by default.
    """
    share = balanced_share(df.sparkSession) if share is None else share
    n = df.count() if total is None else total
    if n < max(1, min_rows):
        return []
    fraction = min(1.0, sample_rows / n)
    seen = df.select(key.alias("k"))
    if fraction < 1:
        seen = seen.sample(False, fraction, seed)
    least = max(share / 2 * n * fraction, min_rows * fraction, 1)
    found = seen.where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("c"))
    return [r["k"] for r in found.where(F.col("c") >= least).limit(math.ceil(4 / share)).collect()]


def is_heavy(key: Column, heavy: Sequence) -> Column:
    """True for rows whose key is in ``heavy``; never null."""
    if not heavy:
        return F.lit(False)
    return F.coalesce(key.isin(list(heavy)), F.lit(False))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    *,
    heavy: Sequence | None = None,
    residual: Column | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_side_rows: int | None = None,
    merge: bool = False,
    salts: int | None = None,
) -> DataFrame:
    """Join ``left`` with ``right`` on one key, with heavy left keys kept apart.

    ``how`` is inner, left, left_semi or left_anti; column names of the two
    sides must differ.  If ``right`` turns out to have at most ``broadcast_rows``
    rows (a count that stops there tells), it is broadcast and nothing of
    ``left`` is shuffled.  Otherwise, or if ``heavy`` is given:

    * rows with a heavy key (found by sampling) meet a broadcast of the right rows
      of those keys; if these are more than ``broadcast_rows`` (counted, unless
      ``heavy_side_rows`` gives a proven bound), they are instead copied ``salts``
      times (by default the number of shuffle partitions) and the heavy left rows are spread over the salts;
    * rows with a null key never match and go with these, so they are not
      gathered in one task;
    * all other rows are joined by an ordinary shuffle, by sort-merge if ``merge``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not support {how}")
    salts = salts or shuffle_partitions(left.sparkSession)
    lk, rk = col(left_key), col(right_key)
    on = lk == rk
    if residual is not None:
        on = on & residual
    if heavy is None:
        if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
            return left.join(F.broadcast(right), on, how)
        heavy = heavy_keys(left, lk, min_rows=MIN_HEAVY_ROWS)
    hot = is_heavy(lk, heavy)
    cold = left.where(lk.isNotNull() & ~hot)
    parts = [cold.join(right.hint("merge") if merge else right, on, how)]
    # rows without a key go with the heavy ones, where they cost no shuffle; they match nothing there either
    keyless = lk.isNull() if how in ("left", "left_anti") else F.lit(False)
    apart, right_hot = left.where(hot | keyless), right.where(is_heavy(rk, heavy))
    size = heavy_side_rows if heavy_side_rows is not None else right_hot.limit(broadcast_rows + 1).count() if heavy else 0
    if size <= broadcast_rows:
        parts.append(apart.join(F.broadcast(right_hot), on, how))
    else:
        # the task's number spreads rows that are alike in everything
        salt = F.pmod(F.xxhash64(*[col(c) for c in left.columns], F.spark_partition_id()), F.lit(salts)).cast("int")
        spread = apart.withColumn("__salt_l", salt)
        copies = right_hot.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = spread.join(copies, on & (F.col("__salt_l") == F.col("__salt_r")), how)
        parts.append(joined.drop("__salt_l", "__salt_r"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unequal(kind: T.DataType) -> bool:
    """Values of the type cannot be compared or hashed."""
    return any(x in kind.simpleString() for x in ("map<", "variant"))


def _loose(kind: T.DataType) -> bool:
    """Values of the type may be equal and still not alike."""
    return any(x in kind.simpleString() for x in ("float", "double", "collate"))


def full_join(
    left: DataFrame,
    right: DataFrame,
    on: Column,
    keys: Sequence[tuple[Column, Column]],
    *,
    residual: bool = True,
    key_pairs: int = KEY_PAIRS,
    task_pairs: int = TASK_PAIRS,
    broadcast_rows: int = BROADCAST_ROWS,
    held_rows: int = HELD_ROWS,
) -> DataFrame | None:
    """Full join that hands its rows on one by one; None if no key has more than ``key_pairs`` pairs.

    ``on`` is the condition, ``keys`` the pairs of expressions it sets equal, ``residual`` tells whether it
    says more.  Pairs are counted by key first.  The side with more rows of a key keeps all its rows in a left
    join with the other; rows of the other side that match nothing come from an anti-join.  If the other side
    has at most ``broadcast_rows`` rows, it is broadcast and the first is dealt evenly to the tasks; otherwise
    keys with more than ``task_pairs`` pairs (so their number is bounded by that of the result's rows) are cut
    into salts, for each of which the other side's rows of the key are copied.  The anti-join holds the first
    side's rows of a key if ``residual``: keys with more than ``held_rows`` are cut likewise, and a row is alone if
    no salt has a match.  Both sides are read more than once, so they must give the same rows each time.  Columns
    are those of ``left``, then of ``right``.
    """
    names = [f"__k{i}" for i in range(len(keys))]

    def counted(df: DataFrame, side: int) -> DataFrame:
        return df.groupBy(*[k[side].alias(n) for k, n in zip(keys, names)]).agg(F.count("*").alias(f"__n{side}"))

    n0, n1 = (F.coalesce(F.col(f"__n{side}"), F.lit(0)).cast("double") for side in (0, 1))
    counts = counted(left, 0).join(counted(right, 1), names, "full").select(*names, n0.alias("__n0"), n1.alias("__n1"))
    pairs = F.col("__n0") * F.col("__n1")
    matched = F.when(pairs > 0, F.struct(F.greatest("__n0", "__n1").alias("n"), (F.col("__n1") > F.col("__n0")).alias("right")))
    seen = counts.agg(F.max(pairs).alias("most"), F.sum(pairs).alias("pairs"), F.max(matched).alias("longest")).collect()[0]
    if (seen["most"] or 0) <= key_pairs:
        return None
    # the side that a row of the other one meets piece by piece is the one with fewer rows of a key
    at = int(seen["longest"]["right"])
    large, small = (right, left) if at else (left, right)
    parts = max(shuffle_partitions(left.sparkSession), math.ceil(seen["pairs"] / task_pairs))

    def cut(few: DataFrame, weight: Column, most: int) -> tuple[DataFrame, DataFrame, Column]:
        """``large`` dealt to the salts of keys that weigh more than ``most``, ``few`` copied for each, and what joins them."""
        found = counts.where(weight > most).select(*names, F.ceil(weight / most).cast("int").alias("__salts"))
        listed = found.collect()

        def salted(df: DataFrame, side: int, salt: Column, name: str) -> DataFrame:
            own = own_columns(df)
            same = [k[side] == F.col(n) for k, n in zip(keys, names)]
            cuts = df.sparkSession.createDataFrame(listed, found.schema)
            met = df.join(F.broadcast(cuts), functools.reduce(lambda a, b: a & b, same), "left").select(*own, salt.alias(name))
            return met.repartition(parts, *[k[side] for k in keys], F.col(name))

        # rows without a key match nothing and need not be gathered; the task's number spreads rows that are alike in everything
        keyless = functools.reduce(lambda a, b: a | b, [k[at].isNull() for k in keys])
        salts = F.when(keyless, parts).otherwise(F.coalesce("__salts", F.lit(1)))
        hashed = [c for c, f in zip(own_columns(large), large.schema) if not _unequal(f.dataType)]
        dealt = salted(large, at, F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), salts).cast("int"), "__salt_l")
        copied = salted(few, 1 - at, F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)), "__salt_r")
        return dealt, copied, on & (F.col("__salt_l") == F.col("__salt_r"))

    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = large.repartition(parts).join(F.broadcast(small), on, "left")
    else:
        dealt, copied, both = cut(small, F.greatest(pairs, "__n0", "__n1"), task_pairs)
        joined = dealt.join(copied, both, "left")
    if residual:
        alone = small.join(large, on, "left_anti")
        asked = alone._jdf.queryExecution().analyzed().condition().get().references()
        attributes = small._jdf.queryExecution().analyzed().output()
        told = [(c, f.dataType) for i, (c, f) in enumerate(zip(own_columns(small), small.schema)) if asked.contains(attributes.apply(i))]
        if seen["longest"]["n"] > held_rows and not any(_unequal(t) for _, t in told):
            dealt, copied, both = cut(small.select(*[c for c, _ in told]), F.col(f"__n{at}"), held_rows)
            met = copied.join(dealt, both, "left_semi").select(*[c.alias(f"__c{i}") for i, (c, _) in enumerate(told)])
            # rows that the condition cannot tell apart match alike; values may be equal and still not alike, as 0.0 and -0.0
            alike = [c.eqNullSafe(F.col(f"__c{i}")) for i, (c, _) in enumerate(told)]
            alike += [c.cast("string").eqNullSafe(F.col(f"__c{i}").cast("string")) for i, (c, t) in enumerate(told) if _loose(t)]
            alone = small.join(met, functools.reduce(lambda a, b: a & b, alike), "left_anti")
    else:
        there = counted(large, at).select(*names)
        alone = small.join(there, functools.reduce(lambda a, b: a & b, [k[1 - at] == F.col(n) for k, n in zip(keys, names)]), "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in large.schema]
    rest = [c.alias(f.name) for c, f in zip(own_columns(small), small.schema)]
    return joined.select(*own_columns(left), *own_columns(right)).union(alone.select(*(rest + empty if at else empty + rest)))


def per_key_results(
    fact: DataFrame,
    key: str,
    *,
    sums: dict[str, Column] | None = None,
    distinct: dict[str, Column] | None = None,
    dim: DataFrame | None = None,
    dim_key: str | None = None,
    dim_columns: Sequence[str] = (),
    share: float | None = None,
    salts: int | None = None,
    heavy: Sequence | None = None,
) -> DataFrame:
    """One row per key: row count, sums, distinct counts, and columns of a dimension.

    Heavy keys (found by sampling) and the rest take separate ways which are
    then united:

    * heavy rows meet a broadcast table of the heavy keys, which carries the
      dimension's columns if there is one, so they are not shuffled by key; their results are
      built in two steps, first per (key, salt of the counted value), then per key, with as many salts as
      there are shuffle partitions, so that a key can fill the whole cluster;
    * the remaining rows are joined with the dimension and grouped by an
      ordinary shuffle on the key.

    ``dim_key`` must be unique in ``dim``; that also bounds the broadcast by the
    number of heavy keys.  A key that ``dim`` lacks gets null columns.  Null keys
    give no row.  Output: ``key``, ``row_count``, the names of ``sums`` and
    ``distinct``, then ``dim_columns``.  Other columns of the input are ignored,
    whatever their names.  An empty input gives no rows.
    """
    sums, distinct = dict(sums or {}), dict(distinct or {})
    salts = salts or shuffle_partitions(fact.sparkSession)
    names_s, names_d = list(sums), list(distinct)
    rows = fact.select(
        col(key).alias("k"),
        *[e.alias(f"s{i}") for i, e in enumerate(sums.values())],
        *[e.alias(f"d{i}") for i, e in enumerate(distinct.values())],
    ).where(F.col("k").isNotNull())
    if heavy is None:
        heavy = heavy_keys(rows, F.col("k"), share=share)
    hot = is_heavy(F.col("k"), heavy)
    dims = None
    if dim is not None:
        dims = dim.select(col(dim_key).alias("dk"), *[col(c).alias(f"c{i}") for i, c in enumerate(dim_columns)])
    listed = fact.sparkSession.createDataFrame([(k,) for k in heavy], T.StructType([T.StructField("hk", rows.schema["k"].dataType)]))
    carried = [f"c{i}" for i in range(len(dim_columns))]
    agg_s = [F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))]

    def attach(part: DataFrame, is_hot: bool) -> DataFrame:
        if dims is None:
            return part.join(F.broadcast(listed), F.col("k") == F.col("hk"), "left_semi") if is_hot else part
        if not is_hot:
            return part.join(dims, F.col("k") == F.col("dk"), "left").drop("dk")
        return part.join(F.broadcast(dims.where(is_heavy(F.col("dk"), heavy))), F.col("k") == F.col("dk"), "left").drop("dk")

    first = [F.first(c).alias(c) for c in carried]

    def cold_part() -> DataFrame:
        part = attach(rows.where(~hot), False)
        d = [F.count_distinct(f"d{i}").alias(f"d{i}") for i in range(len(distinct))]
        return part.groupBy("k").agg(F.count("*").alias("n"), *agg_s, *d, *first)

    def hot_part() -> DataFrame:
        part = attach(rows.where(hot), True)
        out = part.groupBy("k").agg(F.count("*").alias("n"), *agg_s, *first)
        for i in range(len(distinct)):
            value = F.col(f"d{i}")
            salt = F.pmod(F.xxhash64(value), F.lit(salts)).cast("int").alias("salt")
            counted = (
                part.where(value.isNotNull())
                .groupBy("k", salt)
                .agg(F.count_distinct(value).alias("x"))
                .groupBy(F.col("k").alias(f"k{i}"))
                .agg(F.sum("x").alias(f"d{i}"))
            )
            # one row per heavy key on both sides: the size is bounded by the list
            out = out.join(F.broadcast(counted), F.col("k") == F.col(f"k{i}"), "left").drop(f"k{i}")
            out = out.withColumn(f"d{i}", F.coalesce(F.col(f"d{i}"), F.lit(0).cast("bigint")))
        return out

    united = cold_part()
    if heavy:
        united = united.unionByName(hot_part())
    return united.select(
        F.col("k").alias(key),
        F.col("n").alias("row_count"),
        *[F.col(f"s{i}").alias(n) for i, n in enumerate(names_s)],
        *[F.col(f"d{i}").alias(n) for i, n in enumerate(names_d)],
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(dim_columns)],
    )


def heavy_hitters(fact: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, with exact counts.

    Candidates come from the sample (see :func:`heavy_keys`, threshold half of
    ``share``).  Per-key counts come from :func:`per_key_results`, the candidates
    by the broadcast way and the rest by the ordinary way, so a key the sample
    missed would still be found.  Null is no key, though its rows belong to all
    rows.  Output: ``key``, ``row_count``.
    """
    total = fact.count()
    heavy = heavy_keys(fact, col(key), share=share, total=total)
    counts = per_key_results(fact.select(col(key)), key, share=share, heavy=heavy)
    return counts.where(F.col("row_count") >= share * total)
