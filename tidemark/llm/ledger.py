"""Has this key been seen before?  An exact ledger of keys on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import MIN_HEAVY_ROWS, heavy_keys, is_heavy
from tidemark.scratch import BucketedRuns, col


class KeyLedger:
    """First arrival of every key, hash-partitioned and sorted on disk.

    Each batch is written once, bucketed like the history, and then meets it
    bucket by bucket in sort-merge left joins on the key, which shuffle neither.
    Within a batch the earliest arrival of a key has rank 1 and is the one that
    is kept.  Keys the history lacks are appended as one more run.  No answer is
    approximate: the error rate is zero.

    The place of a row is the hash of its key.  Rows of keys that hold very many
    rows of a batch, and rows without a key, take a hash of their contents instead
    and so are spread over all buckets; these keys' first arrivals are formed by
    partial aggregation and are broadcast to their rows (one row per such key,
    of which there are at most about 20,000, see :func:`heavy_keys`).

    Batches should come in order of arrival.  A late batch is answered correctly
    and lowers the stored first arrival of its keys; only answers that were
    given before it came are not revised.

    Repeating a batch under its run number replaces that run and is answered
    from the runs before it.  A run that was merged with others by
    :meth:`compact` is not written again; its repeated batch is answered from
    all keys up to the runs it was merged with.  Opened again on its ``path``, a
    ledger goes on after its last run.

    The rows of a batch are kept for its answers until ``KEPT`` more batches have
    come; answers that have not been read by then can no longer be read.
    """

    #: Batches whose rows are kept.
    KEPT = 16

    def __init__(
        self, spark: SparkSession, key_type: str = "string", at_type: str = "timestamp_ntz", *, path: str | None = None, buckets: int | None = None
    ) -> None:
        self.spark = spark
        self.store = BucketedRuns(spark, ["h", "k"], f"`h` BIGINT, `k` {key_type}, `first_at` {at_type}", path=path, buckets=buckets, hashed=True)
        self._staged: list[BucketedRuns] = []

    @property
    def runs(self) -> int:
        """The number the next batch gets."""
        return self.store.next_run()

    def _firsts(self, stored: DataFrame) -> DataFrame:
        return stored.groupBy("h", "k").agg(F.min("first_at").alias("first_at"))

    def first_seen(self, up_to: int | None = None) -> DataFrame:
        """(k, first_at), one row per key; grouped bucket by bucket without a shuffle."""
        return self._firsts(self.store.frame(up_to)).drop("h")

    def compact(self, *, fan_in: int | None = None) -> None:
        """Merge runs bucket by bucket, without a shuffle; with ``fan_in`` only the newest of like size.

        Answers that have not been read when the next but one compaction starts
        can no longer be read.
        """
        chosen = self.store.entries() if fan_in is None else self.store.to_merge(fan_in)
        if chosen and (len(chosen) > 1 or len(chosen[0]["parts"]) > 1):
            self.store.merge(chosen, self._firsts(self.store.read(chosen)))

    def close(self) -> None:
        """Leave the catalog; what is stored stays."""
        self.store.close()

    def observe(
        self,
        batch: DataFrame,
        key: str,
        at: str,
        *,
        writes: Column | None = None,
        carry: Sequence[str] = (),
        heavy: Sequence | None = None,
        seen: str = "seen",
        run: int | None = None,
    ) -> DataFrame:
        """Answer a batch and add its keys to the ledger.

        Output: the ``carry`` columns and ``seen``: whether the key occurred in a
        writing row with a strictly earlier ``at``, in this batch or before.
        ``writes`` tells which rows add their key (default: all); the others only
        ask.  Rows that share the earliest time are all unseen.  A null key or
        time is never seen and adds nothing; the empty string is a key.  Other
        columns are ignored, whatever their names; ``seen`` may not be one of
        ``carry``.  ``heavy`` names keys that hold very many rows (found by
        sampling if not given).  ``run`` is the batch's number, by default the
        next one.
        """
        run = self.runs if run is None else run
        return next(self.observe_all(batch, key, at, {run: None}, writes=writes, carry=carry, heavy=heavy, seen=seen))

    def observe_all(
        self,
        rows: DataFrame,
        key: str,
        at: str,
        batches: Mapping[int, Column | None],
        *,
        writes: Column | None = None,
        carry: Sequence[str] = (),
        heavy: Sequence | None = None,
        seen: str = "seen",
    ) -> Iterator[DataFrame]:
        """Answers of several batches, one after another, which are written in one pass over ``rows``.

        ``batches`` maps run numbers, ascending, to the tests that tell a batch's
        rows (None: all); a row belongs to the first test that is true.  See
        :meth:`observe`.
        """
        if seen in carry:
            raise ValueError(f"{seen} is already a column")
        kept = [f"v{i}" for i in range(len(carry))]
        if heavy is None:
            heavy = heavy_keys(rows, col(key), min_rows=MIN_HEAVY_ROWS)
        number = F.lit(None).cast("int")
        for r, test in reversed(batches.items()):
            number = F.lit(r) if test is None else F.when(test, F.lit(r)).otherwise(number)
        shaped = rows.select(
            col(key).alias("k"),
            col(at).alias("t"),
            F.coalesce(F.lit(True) if writes is None else writes, F.lit(False)).alias("w"),
            number.alias("b"),
            *[col(c).alias(v) for c, v in zip(carry, kept)],
        )
        k, t = F.col("k"), F.col("t")
        apart = is_heavy(k, heavy) | k.isNull()
        # the task's number spreads rows that are alike in everything
        spread = F.xxhash64("t", *kept, F.spark_partition_id())
        shaped = shaped.withColumn("h", F.when(apart, spread).otherwise(F.xxhash64(k)))
        types = {f.name: f.dataType.simpleString() for f in shaped.schema.fields}
        ddl = ", ".join(f"`{c}` {types[c]}" for c in ("h", "k", "t", "w", *kept))
        staged = BucketedRuns(self.spark, ["h", "k"], ddl, buckets=self.store.buckets, hashed=True)
        self._staged.append(staged)
        while len(self._staged) > self.KEPT:
            self._staged.pop(0).drop()
        staged.write_all(shaped, {r: None if test is None else F.col("b") == r for r, test in batches.items()})

        for place, run in enumerate(batches):
            # the staged batches are numbered alike, each a part of its own
            batch = staged.read([staged.entries()[place]])
            self._append(batch, run, heavy)
            stored = self.store.read([e for e in self.store.entries() if e["runs"][0][0] <= run])
            # bucket by bucket
            known = self._firsts(stored).select(F.col("h").alias("hh"), F.col("k").alias("hk"), "first_at")
            found = batch.join(known.hint("merge"), (F.col("h") == F.col("hh")) & (k == F.col("hk")), "left")
            first = F.col("first_at")
            if heavy:
                # one row per heavy key, as many as are listed
                hot = stored.where(is_heavy(k, heavy)).groupBy(F.col("k").alias("ok")).agg(F.min("first_at").alias("hot_at"))
                found = found.join(F.broadcast(hot), F.col("k") == F.col("ok"), "left")
                first = F.coalesce(first, F.col("hot_at"))
            earlier = F.coalesce(first < t, F.lit(False))
            yield found.select(*[F.col(v).alias(c) for v, c in zip(kept, carry)], earlier.alias(seen))

    def _append(self, batch: DataFrame, run: int, heavy: Sequence) -> None:
        """Add the keys of a batch that no earlier run has, or has later."""
        if self.store.merged(run):
            return
        before = [e for e in self.store.entries() if e["runs"][0][0] <= run and e["runs"] != [[run, run]]]
        writing = batch.where(F.col("w") & F.col("k").isNotNull() & F.col("t").isNotNull())
        hot = is_heavy(F.col("k"), heavy)
        # keys are in their bucket already, but for the heavy ones
        parts = [writing.where(~hot).groupBy("h", "k")]
        if heavy:
            parts.append(writing.where(hot).groupBy(F.xxhash64("k").alias("h"), "k"))
        new = []
        for i, p in enumerate(parts):
            fresh = p.agg(F.min("t").alias("t"))
            if before:
                stored = self.store.read(before)
                known = self._firsts(stored if i == 0 else stored.where(hot))
                known = known.select(F.col("h").alias("hh"), F.col("k").alias("hk"), "first_at").hint("merge")
                fresh = fresh.join(known, (F.col("h") == F.col("hh")) & (F.col("k") == F.col("hk")), "left")
                fresh = fresh.where(F.col("first_at").isNull() | (F.col("t") < F.col("first_at")))
            new.append(fresh.select("h", "k", F.col("t").alias("first_at")))
        self.store.write(new, run)


def answer_batches(
    ledger: KeyLedger, key: str, at: str, sink: Callable[[DataFrame, int], None], *, writes: Column | None = None, carry: Sequence[str] = (), fan_in: int | None = 8
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: micro-batch n becomes run n of the ledger and its answers go to ``sink(answers, n)``.

    A batch that is replayed, also after a restart, is answered again and adds
    nothing; ``sink`` should take a batch number twice.  Runs of like size are
    merged when there are ``fan_in`` of them (None: never).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(ledger.observe(batch, key, at, writes=writes, carry=carry, run=batch_id), batch_id)
        if fan_in:
            ledger.compact(fan_in=fan_in)

    return write
