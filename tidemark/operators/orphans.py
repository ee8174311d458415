"""References to records that are missing, deleted, or arrive later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bloom import bloom_filter
from tidemark.operators.skew import skew_join
from tidemark.scratch import col


@dataclass(frozen=True)
class Reference:
    """A column of the child that names a key of a parent table.

    ``since`` and ``until`` are the parent's columns for the time from which a
    row is there and the time at which it was deleted (null: still there).
    ``blank_is_none`` makes the empty string no reference.
    """

    name: str
    column: str
    parent: DataFrame
    parent_key: str
    since: str
    until: str
    blank_is_none: bool = False


def orphans(child: DataFrame, at: str, carry: Sequence[str], references: Sequence[Reference]) -> DataFrame:
    """Rows of ``child`` whose reference has no valid parent row at time ``at``.

    A parent row is valid if ``since <= at`` and ``until`` is null or ``> at``.
    Output: ``ref_table`` (the reference's name), ``carry`` columns, ``at``; one
    row per orphan reference of each child row, so repeated child rows come out
    repeatedly.

    Keys that a Bloom filter of the parents' keys rejects are orphans for
    certain: they go on without a key, which matches nothing and is not shuffled.
    The others are verified by an exact anti-join in the same pass.  The filters' sizes are
    bounded (see :mod:`bloom`), the anti-join keeps heavy keys apart, and parents
    are only broadcast whole if they were counted and are few.

    A null reference is none.  A row whose ``at`` is null meets no valid parent,
    so its references are orphans; likewise parents whose ``since`` is null are
    never valid.  Keys of two numeric types, or two types of dates and times, are compared in
    their common type, keys of other unlike types as strings.  Empty parents make every
    reference an orphan.  Columns not named are ignored, whatever their names.
    """
    parts = []
    for ref in references:
        key, pkey = col(ref.column), col(ref.parent_key)
        kind = common_key_type(child.schema[ref.column].dataType, ref.parent.schema[ref.parent_key].dataType, child.sparkSession)
        key, pkey = key.cast(kind), pkey.cast(kind)
        carried = [f"v{i}" for i in range(len(carry))]
        rows = child.select(
            key.alias("k"), col(at).alias("t"), *[col(c).alias(v) for c, v in zip(carry, carried)]
        ).where(F.col("k").isNotNull())
        if ref.blank_is_none:
            rows = rows.where(F.col("k") != "")
        parents = ref.parent.select(pkey.alias("pk"), col(ref.since).alias("since"), col(ref.until).alias("until"))
        parents = parents.where(F.col("pk").isNotNull())
        valid = (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("until") > F.col("t")))
        marked = bloom_filter(parents, "pk").mark(rows, "k", "perhaps")
        marked = marked.select(F.when(F.col("perhaps"), F.col("k")).alias("k"), "t", *carried)
        found = skew_join(marked, parents, "k", "pk", "left_anti", residual=valid)
        parts.append(
            found.select(
                F.lit(ref.name).alias("ref_table"),
                *[F.col(v).alias(c) for c, v in zip(carry, carried)],
                F.col("t").alias(at),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_key_type(a: T.DataType, b: T.DataType, spark: SparkSession) -> T.DataType:
    """The type in which keys of two types are compared."""
    if a == b:
        return a
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if any(isinstance(a, kind) and isinstance(b, kind) for kind in (T.NumericType, times)):
        both = F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)).alias("x")
        return spark.range(0).select(both).schema["x"].dataType
    return T.StringType()


def month(at: Column) -> Column:
    """Month of a time as ``YYYY-MM``."""
    return F.date_format(at, "yyyy-MM")
