"""Exactly one copy of messages that were delivered more than once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import MIN_HEAVY_ROWS, heavy_keys, is_heavy
from tidemark.scratch import BucketedRuns, col


class UpsertStore:
    """Hash-bucketed, sorted storage in which a write with an identifier is idempotent.

    Every batch becomes one run: its rows are hashed into buckets and sorted by
    the identifiers' hash.  :meth:`compact` merges the sorted
    runs bucket by bucket, without a shuffle, so that equal identifiers collapse
    to one row, as they do on reading (:meth:`merged`); the store goes on after
    it.  Identifiers that hold very many rows of a batch are
    reduced in the tasks that read them, before the shuffle, and are a part of
    the run of their own.  They are found by sampling unless given; that only
    decides on the way, never on the result.

    Which copy stays: the one that is lowest in ``order`` (``keep="first"``) or
    highest (``keep="last"``); nulls sort lowest.  ``order`` should end in a
    unique column; otherwise equal copies are told apart by their payload.

    Nulls in identifier columns are values like others (a null equals a null).
    An empty batch writes an empty run.  Columns not named are ignored, whatever
    their names; ``copies`` counts the rows seen per identifier and may not be
    the name of a stored column.  Repeating a batch under the same run number
    replaces that run, or does nothing if that run was merged with others; either
    way nothing changes.  Opened again on its ``path`` a store goes on as it was.
    """

    def __init__(
        self,
        spark: SparkSession,
        sample: DataFrame,
        ids: Sequence[str],
        order: Sequence[str],
        payload: Sequence[str] = (),
        *,
        keep: str = "first",
        path: str | None = None,
        buckets: int | None = None,
    ) -> None:
        if keep not in ("first", "last"):
            raise ValueError("keep is first or last")
        self.ids, self.rest = list(ids), [*order, *[c for c in payload if c not in order]]
        if "copies" in (*self.ids, *self.rest):
            raise ValueError("copies is a reserved name")
        self.keep, self.spark = keep, spark
        types = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
        ddl = ", ".join(f"`{c}` {types[c]}" for c in (*self.ids, *self.rest)) + ", `copies` BIGINT"
        self.runs = BucketedRuns(spark, self.ids, ddl, path=path, buckets=buckets, meta={"keep": keep, "order": list(order)})

    def _collapse(self, df: DataFrame, copies: Column, by: Sequence[str] = ()) -> DataFrame:
        best = F.min if self.keep == "first" else F.max
        # led by the hash, which decides nearly every comparison of a sort by its first eight bytes
        agg = df.groupBy(self._hash().alias("__hash"), *by, *[col(c) for c in self.ids]).agg(
            best(F.struct(*[col(c) for c in self.rest])).alias("__best"), F.sum(copies).alias("copies")
        )
        return agg.select(
            *by, *[col(c) for c in self.ids], *[F.col("__best").getField(c).alias(c) for c in self.rest], F.col("copies")
        )

    def _hash(self) -> Column:
        return F.xxhash64(*[col(c) for c in self.ids])

    def heavy(self, df: DataFrame, total: int | None = None) -> list[int]:
        """Hashes of the identifiers that hold very many rows of ``df``, from a sample."""
        return heavy_keys(df, self._hash(), min_rows=MIN_HEAVY_ROWS, total=total)

    def upsert(self, batch: DataFrame, run: int, *, heavy: Sequence[int] | None = None) -> bool:
        """Store a batch as run ``run``; False if that run was merged before, which changes nothing."""
        return self.upsert_all(batch, {run: None}, heavy=heavy)

    def upsert_all(self, rows: DataFrame, runs: Mapping[int, Column | None], *, heavy: Sequence[int] | None = None) -> bool:
        """Store several batches in one pass: each row belongs to the first run whose condition is true (or None)."""
        if all(self.runs.merged(r) for r in runs):
            return False
        if heavy is None:
            heavy = self.heavy(rows)
        number = F.lit(None).cast("int")
        for r, test in reversed(runs.items()):
            number = F.lit(r) if test is None else F.when(test, F.lit(r)).otherwise(number)
        rows = rows.select(number.alias("__batch"), *[col(c) for c in (*self.ids, *self.rest)])
        hot = is_heavy(self._hash(), heavy)
        parts = [rows.where(~hot).withColumn("copies", F.lit(1).cast("bigint"))]
        if heavy:
            parts.append(self._collapse(rows.where(hot), F.lit(1), ["__batch"]))
        return self.runs.write_all(parts, {r: F.col("__batch") == r for r in runs})

    def merged(self) -> DataFrame:
        """One row per identifier over all runs, merged on reading."""
        return self._collapse(self.runs.frame(), F.col("copies"))

    def compact(self, *, fan_in: int | None = None) -> DataFrame:
        """Merge the sorted runs bucket by bucket into one run, and return the store's rows.

        With ``fan_in`` only the newest runs of like size are merged, and only if
        there are that many: the upkeep of a store that takes batches for ever.
        """
        chosen = self.runs.entries() if fan_in is None else self.runs.to_merge(fan_in)
        if len(chosen) > 1 or any(not e.get("merged") for e in chosen):  # what was merged alone has one row per identifier
            self.runs.merge(chosen, self._collapse(self.runs.read(chosen), F.col("copies")))
        return self.merged()

    def close(self) -> None:
        """Leave the catalog; what is stored stays."""
        self.runs.close()


def deduplicate(
    df: DataFrame,
    ids: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str] = (),
    *,
    batch_by: str,
    batches: int = 4,
    keep: str = "first",
) -> DataFrame:
    """Run a whole table through an :class:`UpsertStore` in ``batches`` deliveries.

    ``batch_by`` is a numeric or timestamp column; its range is cut into equal
    spans, one per batch, and rows where it is null come with the first.  The
    batches are written as runs of their own in one pass over the table and then merged.
    """
    store = UpsertStore(df.sparkSession, df, ids, order, payload, keep=keep)
    total, tests = spans(df, batch_by, batches)
    heavy = store.heavy(df, total)
    store.upsert_all(df, dict(enumerate(tests)), heavy=heavy)
    store.compact()
    store.runs.vacuum()
    found = store.runs.plain()
    store.close()
    return found


def spans(df: DataFrame, by: str, n: int) -> tuple[int, list[Column]]:
    """Number of rows, and tests that cut ``df`` into ``n`` parts of equal spans of ``by``, in ascending order.

    The bounds come from one aggregate; nulls belong to the first part.
    """
    t = col(by)
    total, lo, hi = df.agg(F.count(F.lit(1)), F.min(t), F.max(t)).first()
    if lo is None or n <= 1 or lo == hi:
        return total, [F.lit(True)]
    cuts = [lo + (hi - lo) * i / n for i in range(1, n)]
    if isinstance(lo, int):
        cuts = [lo + (hi - lo) * i // n for i in range(1, n)]
    edges = [None, *[F.lit(c).cast(df.schema[by].dataType) for c in cuts], None]
    out = []
    for a, b in zip(edges, edges[1:]):
        test = F.lit(True)
        if a is not None:
            test = test & (t > a)
        if b is not None:
            test = test & ((t <= b) | t.isNull()) if a is None else test & (t <= b)
        out.append(test)
    return total, out


def slices(df: DataFrame, by: str, n: int) -> list[DataFrame]:
    """The parts of :func:`spans` as DataFrames."""
    return [df.where(test) for test in spans(df, by, n)[1]]
