"""Rebuilding a table's state from a feed of inserts, updates and deletes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import SAMPLE_ROWS
from tidemark.scratch import col

PUT, DELETE = 0, 1


def _signed_sum(versions: DataFrame, group: list[str], payload: list[str], keep_deletes: bool) -> DataFrame:
    """Net rows of each group of versions (group columns, k, seq, op, payload).

    Every version adds its after-image (+1) and takes away its before-image
    (-1), which is the version with the next lower seq in its group.  The sums of
    the multiplicities are formed per image and images with a positive sum stay.
    A delete has no after-image unless ``keep_deletes``, in which case its
    tombstone stands for one.
    """
    w = Window.partitionBy(*group).orderBy("seq")
    image = ["seq", "op", *payload]
    before = F.lag(F.struct(*image)).over(w)
    real = F.lit(True) if keep_deletes else F.col("x.op") == PUT
    signed = (
        versions.select(*group, F.struct(*image).alias("after"), before.alias("before"))
        .select(
            *group,
            F.explode(
                F.array(
                    F.struct(F.col("after").alias("x"), F.lit(1).alias("m")),
                    F.struct(F.col("before").alias("x"), F.lit(-1).alias("m")),
                )
            ).alias("e"),
        )
        .select(*group, F.col("e.x").alias("x"), F.col("e.m").alias("m"))
        .where(F.col("x").isNotNull() & real)
    )
    seq, op = F.col("x.seq").alias("seq"), F.col("x.op").alias("op")
    net = signed.select(*group, seq, op, *[F.col(f"x.{p}").alias(p) for p in payload], "m")
    # the window has already placed a group in one partition, so this needs no shuffle
    net = net.groupBy(*group, "seq").agg(
        F.sum("m").alias("m"), F.first("op").alias("op"), *[F.first(p).alias(p) for p in payload]
    )
    return net.where(F.col("m") > 0).drop("m")


#: Rows of the sample that a key must have to be cut into blocks; bounds the list of such keys.
LEAST_SAMPLED = 20


def hot_groups(versions: DataFrame, total: int, target_rows: int) -> list:
    """(key hash, lowest seq, highest seq, blocks) of the keys with very many changes.

    They are taken from a sample of about SAMPLE_ROWS rows, so there are at most
    SAMPLE_ROWS / LEAST_SAMPLED of them, about 20,000.
    """
    if total <= target_rows:
        return []
    fraction = min(1.0, SAMPLE_ROWS / total)
    s = versions.select("h", "seq")
    if fraction < 1:
        s = s.sample(False, fraction, 11)
    least = max(LEAST_SAMPLED, target_rows * fraction)
    g = s.groupBy("h").agg(F.count("*").alias("c"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    found = g.where(F.col("c") >= least).collect()
    return [(r["h"], r["lo"], r["hi"], math.ceil(r["c"] / fraction / target_rows) + 1) for r in found]


def block_of(seq: str) -> Column:
    """Block of a row joined with its key's line of :func:`hot_groups`.

    It is monotone in ``seq``, and clamped, so a bound that the sample missed only makes an end block larger.
    """
    lo, hi, n = F.col("lo").cast("double"), F.col("hi").cast("double"), F.col("blocks")
    cut = F.floor((F.col(seq).cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * n)
    return F.greatest(F.lit(0), F.least(n - 1, cut)).cast("bigint")


def _once(rows: DataFrame, k: list[str], p: list[str]) -> DataFrame:
    """One row per key and seq; the lowest (op, payload) if copies disagree."""
    if not p:
        return rows.groupBy(*k, "seq").agg(F.min("op").alias("op"))
    one = rows.groupBy(*k, "seq").agg(F.min(F.struct("op", *p)).alias("v"))
    return one.select(*k, "seq", F.col("v.op").alias("op"), *[F.col(f"v.{x}").alias(x) for x in p])


def apply_changes(
    feed: DataFrame,
    key: Sequence[str],
    seq: str,
    op: str,
    payload: Sequence[str] = (),
    *,
    base: DataFrame | None = None,
    target_rows: int = 200_000,
) -> DataFrame:
    """Current rows of the table that ``feed`` describes: ``key``, ``seq``, ``payload``.

    ``op`` is 0 for a put (insert or update), 1 for a delete; changes of any
    other kind, and changes with a null ``seq`` or ``op``, alter nothing.
    ``base`` holds rows that were there before (``key``, ``seq``, ``payload``);
    they count as puts at their own ``seq``.

    Method: a signed multiset.  Repeated deliveries of a change (same key and
    seq) collapse to one first; if copies disagree, the lowest (op, payload) wins.  Each change then adds +1 of
    its after-image and -1 of its before-image, multiplicities are summed, and
    images with a positive sum are the state.  Order of arrival plays no part.

    A key with very many rows has its repeated deliveries combined before the
    shuffle and is cut into blocks of its seq range, each summed
    in a task of its own; the blocks' net versions are then summed once more.
    Which keys are cut is decided on a sample (about 20,000 keys at most, which
    is what is broadcast); the result is the same for any decision.

    Nulls in key columns are values like others, as are null and empty payloads.
    An empty feed gives the base, or nothing.  Other columns are ignored.
    """
    k, p = [f"k{i}" for i in range(len(key))], [f"p{i}" for i in range(len(payload))]

    def shaped(df: DataFrame, op_col) -> DataFrame:
        return df.select(
            *[col(c).alias(a) for c, a in zip(key, k)],
            col(seq).cast("bigint").alias("seq"),
            op_col.cast("int").alias("op"),
            *[col(c).alias(a) for c, a in zip(payload, p)],
        )

    rows = shaped(feed, col(op)).where(F.col("op").isin(PUT, DELETE) & F.col("seq").isNotNull())
    if base is not None:
        rows = rows.unionByName(shaped(base, F.lit(PUT)).where(F.col("seq").isNotNull()))
    h = F.xxhash64(*k)
    total = feed.count()
    hot = hot_groups(rows.withColumn("h", h), total, target_rows)
    table = F.broadcast(feed.sparkSession.createDataFrame(hot, "hh bigint, lo bigint, hi bigint, blocks int"))
    cold = rows.join(table, h == F.col("hh"), "left_anti") if hot else rows
    # one shuffle, by key, serves the removal of copies, the window and the sums
    out = _signed_sum(_once(cold.repartition(*k), k, p), k, p, keep_deletes=False).select(*k, "seq", *p)
    if hot:
        # copies meet in the tasks that read them, as one message may have very many
        one = _once(rows.join(table.select("hh"), h == F.col("hh"), "left_semi"), k, p)
        blocks = one.join(table, h == F.col("hh")).select(*k, "seq", "op", *p, block_of("seq").alias("block"))
        net = _signed_sum(blocks, [*k, "block"], p, keep_deletes=True).drop("block")
        out = out.unionByName(_signed_sum(net, k, p, keep_deletes=False).select(*k, "seq", *p))
    return out.select(
        *[F.col(a).alias(c) for c, a in zip(key, k)],
        F.col("seq").alias(seq),
        *[F.col(a).alias(c) for c, a in zip(payload, p)],
    )
