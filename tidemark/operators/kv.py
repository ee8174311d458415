"""A multi-version key-value table as a change log.

The log has the columns key, seq, vtype (1 value, 0 tombstone) and value.  What
a reader sees at a snapshot is, per key, the version with the highest seq at or
below it, unless that is a tombstone.  All operators are aggregations with
partial combine, so a key with very many versions does not slow a task down.
"""

from __future__ import annotations

import base64
import bisect
import json
import os
import socket
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.changes import block_of, hot_groups
from tidemark.operators.skew import MIN_HEAVY_ROWS, heavy_keys, skew_join
from tidemark.scratch import Manifest, col, create_text, discard, materialize, names, read_text, scratch_path, size_of

TOMBSTONE, VALUE = 0, 1


# -- operators on logs


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Newest version per key at or below ``snapshot``, tombstones included.

    A version is told by key and seq; if copies of one disagree any of their types and values may come out.
    """
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    # columns of fixed width keep this a hash aggregate, which a struct would not
    newest_of = [F.max_by(c, "seq").alias(c) for c in ("vtype", "value")]
    return log.groupBy("key").agg(F.max("seq").alias("seq"), *newest_of)


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, seq, value) that a reader sees at ``snapshot``."""
    return newest(log, snapshot).where(F.col("vtype") == VALUE).select("key", "seq", "value")


def between(log: DataFrame, start=None, end=None, prefix=None, order: Column | None = None) -> DataFrame:
    """Versions whose key is at least ``start``, below ``end`` and begins with ``prefix``.

    With ``order`` (an expression of the key) the bounds apply to that expression.
    Restricting the log first lets the bounds reach the scan.
    """
    k = F.col("key") if order is None else order
    if start is not None:
        log = log.where(k >= F.lit(start))
    if end is not None:
        log = log.where(k < F.lit(end))
    if prefix is not None:
        log = log.where(k.startswith(F.lit(prefix)))
    return log


def scan(log: DataFrame, *, start=None, end=None, prefix=None, snapshot: int | None = None, reverse: bool = False, order: Column | None = None) -> DataFrame:
    """Visible rows in key order (bytewise for strings and binary), or in the order of ``order``."""
    rows = visible(between(log, start, end, prefix, order), snapshot)
    k = F.col("key") if order is None else order
    return rows.orderBy(k.desc() if reverse else k.asc())


def seek(log: DataFrame, target, *, snapshot: int | None = None) -> DataFrame:
    """The first visible row whose key is at least ``target``."""
    return scan(log, start=target, snapshot=snapshot).limit(1)


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """One log of several runs, ordered by key and newest version first."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.col("key").asc(), F.col("seq").desc())


def concatenate(runs: Sequence[DataFrame]) -> DataFrame:
    """One sorted log of sorted runs whose key ranges follow one another: no row is moved or compared.

    Only the first and last key of each run are looked at; ranges that overlap are an error.
    """
    ends = [r.agg(F.min("key"), F.max("key")).first() for r in runs]
    placed = sorted(((lo, hi, r) for (lo, hi), r in zip(ends, runs) if lo is not None), key=lambda x: x[0])
    for (_, hi, _), (lo, _, _) in zip(placed, placed[1:]):
        if lo <= hi:
            raise ValueError("the runs overlap")
    return reduce(DataFrame.union, [r for _, _, r in placed] or list(runs[:1]))


def compact(log: DataFrame, oldest_snapshot: int, *, whole: bool = True) -> DataFrame:
    """Drop versions that no reader can see any more.

    A version goes if a newer one has seq <= ``oldest_snapshot``; so of the
    versions up to the snapshot one per key stays, and all later ones.  A
    tombstone up to the snapshot goes too if ``whole`` says that no older
    version lies elsewhere.
    """
    later = log.where(F.col("seq") > oldest_snapshot).select("key", "seq", "vtype", "value")
    kept = newest(log, oldest_snapshot)
    if whole:
        kept = kept.where(F.col("vtype") == VALUE)
    return later.unionByName(kept.select("key", "seq", "vtype", "value"))


def read_at(reads: DataFrame, versions: DataFrame, key: Sequence[str], seq: str, value: str, *, latest: int = 0, target_rows: int = 200_000) -> DataFrame:
    """What reads of many snapshots find: the columns of ``reads``, ``found_seq`` and ``found_value``.

    A read at ``seq`` finds the version of its key with the highest seq at or
    below; a read at ``latest`` finds the newest one.  Of several values under
    one (key, seq) the highest counts, null lowest.  A read finds nothing (nulls) if there is
    no version, or if a key column or its ``seq`` is null.  ``versions`` has the
    columns ``key``, ``seq`` and ``value``; its other columns are ignored.

    Reads and versions are not paired: they are put in one order of seq per key
    and each read takes the last version before it, in one shuffle.  A key with very many of
    both goes another way: its versions and the different seqs asked for are combined in
    the tasks that read them and cut into blocks of the seq range, whose last
    versions are carried on from block to block, and the answers go back to the
    reads by a join that keeps heavy (key, seq) apart.
    """
    k = [f"k{i}" for i in range(len(key))]
    kept = [f"v{i}" for i in range(len(reads.columns))]

    def shaped(df: DataFrame, s: Column, *more: Column) -> DataFrame:
        rows = df.select(*[col(c).alias(a) for c, a in zip(key, k)], s.cast("bigint").alias("s"), *more)
        for a in [*k, "s"]:
            rows = rows.where(F.col(a).isNotNull())
        return rows.select(F.xxhash64(*k).alias("h"), "*")

    # a read at ``latest`` comes after all versions
    at = F.when(col(seq) == latest, F.lit((1 << 63) - 1)).otherwise(col(seq))
    known = F.lit(True)
    for c in (*key, seq):
        known = known & col(c).isNotNull()
    stored = shaped(versions, col(seq), col(value).alias("v"))
    asking = shaped(reads, at, *[col(c).alias(v) for c, v in zip(reads.columns, kept)])
    nothing = F.lit(None).cast(stored.select(F.struct("s", "v").alias("x")).schema["x"].dataType).alias("x")
    out = [reads.where(~known).select(*[col(c).alias(v) for c, v in zip(reads.columns, kept)], nothing)]

    total = versions.count() + reads.count()
    both = stored.select("h", F.col("s").alias("seq")).unionByName(asking.where(F.col("s") != (1 << 63) - 1).select("h", F.col("s").alias("seq")))
    hot = hot_groups(both, total, target_rows)
    table = F.broadcast(reads.sparkSession.createDataFrame(hot, "hh bigint, lo bigint, hi bigint, blocks int"))
    is_hot = F.col("h") == F.col("hh")

    def cold(df: DataFrame) -> DataFrame:
        return df.join(table, is_hot, "left_anti") if hot else df

    # a version at the seq of a read comes before it, and the highest value of a seq last
    version = F.when(~F.col("asks"), F.struct("s", "v"))
    order = Window.partitionBy("h", *k).orderBy("s", "asks", "v").rowsBetween(Window.unboundedPreceding, 0)
    events = cold(stored).withColumn("asks", F.lit(False)).unionByName(cold(asking).withColumn("asks", F.lit(True)), allowMissingColumns=True)
    out.append(events.withColumn("x", F.last(version, ignorenulls=True).over(order)).where("asks").select(*kept, "x"))
    if hot:
        out.append(_read_hot(stored.join(table, is_hot), asking.join(table, is_hot), k, kept))
    found = reduce(DataFrame.unionByName, out)
    return found.select(*[F.col(v).alias(c) for c, v in zip(reads.columns, kept)], F.col("x.s").alias("found_seq"), F.col("x.v").alias("found_value"))


def _read_hot(stored: DataFrame, asking: DataFrame, k: list[str], kept: list[str]) -> DataFrame:
    """Reads of keys with very many rows, which carry their bounds: the ``kept`` columns and ``x``."""
    place = ["h", *k, "block"]
    versions = stored.groupBy(*place[:-1], "s", block_of("s").alias("block")).agg(F.max(F.struct("v")).alias("m"))
    versions = versions.select(*place, "s", F.lit(False).alias("asks"), F.struct("s", F.col("m.v").alias("v")).alias("x"))
    asked = asking.select(*place[:-1], "s", block_of("s").alias("block")).distinct()
    asked = asked.select(*place, "s", F.lit(True).alias("asks"), F.lit(None).cast(versions.schema["x"].dataType).alias("x"))
    last = F.last("x", ignorenulls=True).over(Window.partitionBy(*place).orderBy("s", "asks").rowsBetween(Window.unboundedPreceding, 0))
    inside = versions.unionByName(asked).withColumn("x", last).where("asks")
    before = F.last("e", ignorenulls=True).over(Window.partitionBy("h", *k).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # one row a block; a block without versions passes on what came before it
    ends = versions.groupBy(*place).agg(F.max_by("x", "s").alias("e")).unionByName(asked.select(*place, F.col("x").alias("e")).distinct())
    ends = ends.groupBy(*place).agg(F.first("e", ignorenulls=True).alias("e")).withColumn("e", before)
    found = inside.join(ends, place, "left").select(F.xxhash64(*k, "s").alias("rh"), *[F.col(c).alias(f"r_{c}") for c in (*k, "s")], F.coalesce("x", "e").alias("x"))
    left = asking.select(F.xxhash64(*k, "s").alias("lh"), *k, "s", *kept)
    same = F.lit(True)
    for c in (*k, "s"):
        same = same & (F.col(c) == F.col(f"r_{c}"))
    heavy = heavy_keys(left, F.col("lh"), min_rows=MIN_HEAVY_ROWS)
    # a heavy hash stands for one (key, seq), or for a few that share it
    return skew_join(left, found, "lh", "rh", "left", residual=same, heavy=heavy, heavy_side_rows=len(heavy)).select(*kept, "x")


def approximate_size(log: DataFrame, start=None, end=None) -> DataFrame:
    """Bytes of keys and values in a key range, all versions: one row, ``bytes``."""
    size = F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    return between(log, start, end).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def sequence(batch: DataFrame, order: Sequence[str], base: int) -> DataFrame:
    """Number the rows of a batch in ``order``: seq = base, base + 1, ...

    Rows are range-partitioned by ``order`` and numbered within partitions; the
    partitions' offsets come from their counts, so no task sees all rows.
    ``order`` must be unique for the numbering to be a fixed one.
    """
    placed = batch.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "ordered")
    counts = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    offset, at = {}, base
    for p in sorted(counts):
        offset[p], at = at, at + counts[p]
    w = Window.partitionBy("__part").orderBy(*order)
    if not offset:
        return placed.drop("__part").withColumn("seq", F.lit(None).cast("bigint"))
    start = F.create_map(*[F.lit(x).cast("bigint") for kv in offset.items() for x in kv])
    return placed.withColumn("seq", start[F.col("__part").cast("bigint")] + F.row_number().over(w) - 1).drop("__part")


# -- a store


class Snapshots:
    """Seqs that readers hold, in ascending order; equal ones are shared and counted."""

    def __init__(self) -> None:
        self._seqs: list[int] = []
        self._readers: dict[int, int] = {}

    def acquire(self, seq: int) -> int:
        if self._seqs and seq < self._seqs[-1]:
            raise ValueError("snapshots must not go back")
        if seq not in self._readers:
            bisect.insort(self._seqs, seq)
            self._readers[seq] = 0
        self._readers[seq] += 1
        return seq

    def release(self, seq: int) -> None:
        self._readers[seq] -= 1
        if not self._readers[seq]:
            del self._readers[seq]
            self._seqs.remove(seq)

    def oldest(self) -> int | None:
        return self._seqs[0] if self._seqs else None


class KV:
    """An ordered, persistent map of string or binary keys with snapshots.

    A write is in a file of the write-ahead log before it returns, and in
    memory; what has gathered there is flushed as one parquet run.  Batches
    given as DataFrames are runs of their own.  Readers unite the runs and what
    is in memory.  A :class:`Manifest` says which runs make up the store, so a
    flush or compaction that is broken off leaves it as it was.  Opening a path
    again continues after its highest seq, with the writes that had not been flushed.

    Runs have levels: new ones come to level 0; a compaction merges a level into
    the next.  The level to be compacted is the one with the highest score,
    which is the number of runs over ``LEVEL0_RUNS`` for level 0 and the bytes
    over what the level may hold for the others.  From a score of 1 on, writes
    compact by themselves unless ``auto_compact`` is off.

    One writer at a time: the path holds a lock from opening to :meth:`close`.
    After a crash the lock stays and ``break_lock`` opens the path all the same.
    Parquet keeps min/max statistics of keys per row group and, with
    ``bloom=True``, Bloom filters, by which point reads skip row groups.
    ``comparator`` names an expression of ``key`` by which scans order; a store
    must be opened again with the name it was made with.
    """

    LEVEL0_RUNS, LEVELS = 4, 7
    #: Bytes that level 1 may hold; every further level may hold ten times as many.
    LEVEL1_BYTES = 1 << 30

    def __init__(
        self, spark: SparkSession, path: str | None = None, *, key_type: str = "string", value_type: str = "string",
        flush_rows: int = 10_000, bloom: bool = True, comparator: str = "key", auto_compact: bool = True, break_lock: bool = False,
    ) -> None:
        self.spark, self.path = spark, (path or scratch_path(spark, "kv")).rstrip("/")
        self.schema = T._parse_datatype_string(f"key {key_type}, seq bigint, vtype tinyint, value {value_type}")
        self.flush_rows, self.bloom, self.comparator, self.auto_compact = flush_rows, bloom, comparator, auto_compact
        self._rows: list[tuple] = []
        self.snapshots = Snapshots()
        self.closed = True
        self._lock(break_lock)
        try:
            self._manifest = Manifest(spark, self.path)
            held = self._manifest.state
            if held.get("comparator", comparator) != comparator:
                raise ValueError("the store was made with another comparator")
            if held.get("schema", self.schema.simpleString()) != self.schema.simpleString():
                raise ValueError(f"the store was made as {held['schema']}")
            self.runs: list[dict] = held.get("runs", [])
            self.last_seq: int = held.get("last_seq", 0)
            self.last_batch: int = held.get("last_batch", -1)
            self._retired: list[str] = held.get("retired", [])
            if not held:
                self._commit(self.runs)
            self._recover()
        except BaseException:
            self._unlock()
            raise
        self.closed = False

    # -- files

    def _lock(self, take: bool) -> None:
        file = f"{self.path}/lock"
        if take:
            discard(self.spark, file)
        try:
            create_text(self.spark, file, f"{socket.gethostname()} {os.getpid()}")
        except OSError:
            raise RuntimeError(f"the store at {self.path} is in use by {read_text(self.spark, file)}") from None

    def _unlock(self) -> None:
        discard(self.spark, f"{self.path}/lock")

    def _commit(self, runs: list[dict], retired: Sequence[str] | None = None) -> None:
        retired = self._retired if retired is None else list(retired)
        state = {"comparator": self.comparator, "schema": self.schema.simpleString(), "runs": runs, "last_seq": self.last_seq, "last_batch": self.last_batch, "retired": retired}
        self._manifest.commit(state)
        self.runs, self._retired = runs, retired

    def _recover(self) -> None:
        """Read back the writes that were acknowledged but not flushed."""
        for name in sorted(names(self.spark, f"{self.path}/wal")):
            if name.endswith(".json"):
                for key, seq, vtype, value in json.loads(read_text(self.spark, f"{self.path}/wal/{name}")):
                    if seq > self.last_seq:
                        self._rows.append((_plain(key), seq, vtype, _plain(value)))
        self.last_seq = max([self.last_seq, *[r[1] for r in self._rows]])

    def _run(self, df: DataFrame, level: int) -> dict:
        """Write rows as a run, sorted by key, newest first."""
        name = f"run-{uuid.uuid4().hex[:16]}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        writer = rows.sortWithinPartitions("key", F.col("seq").desc()).write
        if self.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(f"{self.path}/{name}")
        return {"name": name, "level": level, "bytes": size_of(self.spark, f"{self.path}/{name}")}

    def _read(self, runs: Sequence[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r['name']}" for r in runs])

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the store is closed")

    def log(self) -> DataFrame:
        """All versions, stored and in memory."""
        self._open()
        stored = self._read(self.runs)
        return stored.unionByName(self.spark.createDataFrame(self._rows, self.schema)) if self._rows else stored

    # -- writes

    def put(self, key, value) -> int:
        return self.write([("put", key, value)])

    def delete(self, key) -> int:
        return self.write([("delete", key)])

    def write(self, ops: Iterable[tuple]) -> int:
        """Apply ("put", key, value) and ("delete", key) in order and as a whole; returns the last seq."""
        self._open()
        rows = []
        for op in ops:
            if op[0] not in ("put", "delete"):
                raise ValueError(f"unknown operation {op[0]}")
            value = op[2] if op[0] == "put" else None
            rows.append((op[1], self.last_seq + 1 + len(rows), VALUE if op[0] == "put" else TOMBSTONE, value))
        if not rows:
            return self.last_seq
        text = json.dumps([(_tagged(k), seq, vtype, _tagged(v)) for k, seq, vtype, v in rows])
        create_text(self.spark, f"{self.path}/wal/{rows[0][1]:019d}.json", text)
        self._rows += rows
        self.last_seq += len(rows)
        if len(self._rows) >= self.flush_rows:
            self.flush()
        return self.last_seq

    def write_frame(self, rows: DataFrame, order: Sequence[str], *, batch: int | None = None) -> int:
        """Apply rows (key, vtype, value and the columns of ``order``) in that order.

        With a ``batch`` number nothing is done if that batch or a later one was applied before.
        """
        self._open()
        if batch is not None and batch <= self.last_batch:
            return self.last_seq
        self.flush()
        run = self._run(sequence(rows, order, self.last_seq + 1), 0)
        self.last_seq = self._read([run]).agg(F.coalesce(F.max("seq"), F.lit(self.last_seq))).first()[0]
        self.last_batch = self.last_batch if batch is None else batch
        self._commit([*self.runs, run])
        self._keep_up()
        return self.last_seq

    def flush(self) -> None:
        """Write what is in memory as a run; the write-ahead log is then no longer needed."""
        self._open()
        if self._rows:
            run = self._run(self.spark.createDataFrame(self._rows, self.schema).coalesce(1), 0)
            self._commit([*self.runs, run])
            self._rows = []
            discard(self.spark, f"{self.path}/wal")
            self._keep_up()

    # -- reads

    def get(self, key, snapshot: int | None = None):
        """Value of a key, or None if it is not there."""
        row = visible(self.log().where(F.col("key") == F.lit(key)), snapshot).first()
        return row["value"] if row else None

    def get_many(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        """(key, value) of the keys of a DataFrame that are there."""
        wanted = keys.select(F.col("key")).distinct()
        return visible(self.log().join(wanted, "key", "left_semi"), snapshot).select("key", "value")

    def scan(self, start=None, end=None, *, prefix=None, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
        order = None if self.comparator == "key" else F.expr(self.comparator)
        return scan(self.log(), start=start, end=end, prefix=prefix, snapshot=snapshot, reverse=reverse, order=order)

    def seek(self, target, snapshot: int | None = None):
        return self.scan(start=target, snapshot=snapshot).first()

    def snapshot(self) -> int:
        return self.snapshots.acquire(self.last_seq)

    def release(self, snapshot: int) -> None:
        self.snapshots.release(snapshot)

    def approximate_size(self, start=None, end=None) -> int:
        return approximate_size(self.log(), start, end).first()[0]

    # -- compaction

    def _oldest(self) -> int:
        held = self.snapshots.oldest()
        return self.last_seq if held is None else held

    def scores(self) -> list[float]:
        """How full each level is; the last one takes everything."""
        at = [[r for r in self.runs if r["level"] == i] for i in range(self.LEVELS - 1)]
        return [len(at[0]) / self.LEVEL0_RUNS, *[sum(r["bytes"] for r in at[i]) / (self.LEVEL1_BYTES * 10 ** (i - 1)) for i in range(1, len(at))]]

    def pick(self) -> tuple[int, float]:
        """The level with the highest score, the upper one of equals, and that score."""
        scores = self.scores()
        return scores.index(max(scores)), max(scores)

    def needs_compaction(self) -> bool:
        return self.pick()[1] >= 1

    def compact_level(self, level: int) -> None:
        """Merge a level into the next one, without versions no reader needs."""
        merged = [r for r in self.runs if r["level"] in (level, level + 1)]
        if merged:
            # a tombstone may go if no lower level can hold what it hides
            whole = not any(r["level"] > level + 1 for r in self.runs)
            new = compact(self._read(merged), self._oldest(), whole=whole)
            self._replace(merged, new, level + 1)

    def _replace(self, old: Sequence[dict], new: DataFrame, level: int) -> None:
        # range-partitioned by key, so that later range reads touch few files
        run = self._run(new.repartitionByRange(F.col("key")), level)
        gone = self._retired
        # replaced runs stay until the next compaction, for frames made before this one
        self._commit([*[r for r in self.runs if r not in old], run], [r["name"] for r in old])
        for name in gone:
            discard(self.spark, f"{self.path}/{name}")

    def _keep_up(self) -> None:
        while self.auto_compact and self.needs_compaction():
            self.compact_level(self.pick()[0])

    def compact(self, start=None, end=None) -> None:
        """Rewrite a key range, or everything, without versions no reader needs."""
        self.flush()
        if not self.runs:
            return
        log = self._read(self.runs)
        new = compact(between(log, start, end), self._oldest())
        if start is not None or end is not None:
            outside = F.lit(False)
            if start is not None:
                outside = outside | (F.col("key") < F.lit(start))
            if end is not None:
                outside = outside | (F.col("key") >= F.lit(end))
            new = new.unionByName(log.where(outside).select(*new.columns))
        self._replace(self.runs, new, max(1, *[r["level"] for r in self.runs]))

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.closed = True
            self._unlock()

    def destroy(self) -> None:
        self.closed = True
        discard(self.spark, self.path)


def _tagged(value):
    """A key or value as JSON can hold it."""
    if isinstance(value, (bytes, bytearray)):
        return {"bytes": base64.b64encode(value).decode()}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"keys and values are text, bytes, numbers or booleans, not {type(value).__name__}")


def _plain(value):
    return bytearray(base64.b64decode(value["bytes"])) if isinstance(value, dict) else value
