"""Percentiles with relative rank error, from sketches that can be merged."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import col

#: Items per section of a compactor.
K = 48
#: Stated error: the rank of an answer is off by at most this share of
#: min(rank, n - rank), or by one, with a probability of 99.7 % (three standard deviations).
RELATIVE_ERROR = 0.01
#: Bytes of sketches a task holds before it hands on what it has, and bytes of a batch that it hands on.
HELD_BYTES, BATCH_BYTES = 256 << 20, 32 << 20
#: What an empty sketch takes in memory, roughly.
_OVERHEAD = 512


class Tail:
    """Compactors that protect one tail (``sign`` 1: the high values, -1: the low ones).

    Level h holds items of weight 2^h.  A full level is sorted; its half next to
    the protected tail, and a varying number of sections before it, stay
    untouched; of the rest every other item moves up a level.  The number of
    sections follows the trailing ones of a counter, so that items are compacted
    the less often the nearer they are to the tail.
    """

    def __init__(self, sign: int, seed: int, levels: list | None = None, counters: list[int] | None = None) -> None:
        self.sign, self.levels, self.counters = sign, levels or [np.empty(0, np.int64)], counters or [0]
        self._coins = np.random.default_rng(seed)

    @staticmethod
    def sections(counter: int) -> int:
        """More sections as a level has been compacted more often."""
        return max(3, counter.bit_length() + 1)

    def add(self, other: Sequence[np.ndarray], counters: Sequence[int]) -> None:
        while len(self.levels) < len(other):
            self.levels.append(np.empty(0, np.int64))
            self.counters.append(0)
        for h, (items, c) in enumerate(zip(other, counters)):
            if len(items):
                self.levels[h] = np.concatenate([self.levels[h], items])
            self.counters[h] |= c
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            items, c = self.levels[h], self.counters[h]
            s = self.sections(c)
            if len(items) >= 2 * K * s:
                ones = (c ^ (c + 1)).bit_length() - 1
                kept = K * s + K * (s - min(ones + 1, s))
                m = (len(items) - kept) & ~1
                # ascending from the unprotected end
                items = np.sort(items) if self.sign > 0 else np.sort(items)[::-1]
                up = items[int(self._coins.integers(2)) : m : 2]
                self.levels[h] = items[m:].copy()
                self.counters[h] = c + 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0, np.int64))
                    self.counters.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])
            h += 1


class QuantileSketch:
    """Values of one group: all of them while few, then two one-sided compactor stacks.

    Answers below the median come from the stack that protects the low tail,
    the others from the one that protects the high tail, so the rank error is
    relative to the distance from the nearer end.
    """

    RAW = 2 * K * 3

    def __init__(self, seed: int = 1) -> None:
        self.n, self.seed = 0, seed
        self.raw: np.ndarray | None = np.empty(0, np.int64)
        self.low = self.high = None

    def _split(self) -> None:
        self.low, self.high = Tail(-1, self.seed), Tail(1, self.seed + 1)
        for t in (self.low, self.high):
            t.add([self.raw], [0])
        self.raw = None

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        if self.raw is not None:
            self.raw = np.concatenate([self.raw, values])
            if len(self.raw) > self.RAW:
                self._split()
        else:
            for t in (self.low, self.high):
                t.add([values], [0])

    def merge(self, other: QuantileSketch) -> None:
        if other.raw is not None:
            self.update(other.raw)
            return
        if self.raw is not None:
            self._split()
        self.n += other.n
        self.low.add(other.low.levels, other.low.counters)
        self.high.add(other.high.levels, other.high.counters)

    def quantiles(self, qs: Sequence[float]) -> list[int | None]:
        """For each q the least value whose rank is at least q * n."""
        if not self.n:
            return [None] * len(qs)
        tables = {}

        def table(which: str):
            if which not in tables:
                levels = [self.raw] if self.raw is not None else getattr(self, which).levels
                v = np.concatenate(levels)
                w = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(levels)])
                o = np.argsort(v, kind="stable")
                tables[which] = v[o], np.cumsum(w[o])
            return tables[which]

        out = []
        for q in qs:
            v, cum = table("low" if q < 0.5 else "high")
            rank = max(1, int(np.ceil(q * self.n - 1e-9)))
            out.append(int(v[min(np.searchsorted(cum, rank), len(v) - 1)]))
        return out

    @property
    def nbytes(self) -> int:
        """Bytes of the values held."""
        if self.raw is not None:
            return _OVERHEAD + self.raw.nbytes
        return _OVERHEAD + sum(x.nbytes + 100 for t in (self.low, self.high) for x in t.levels)

    def to_bytes(self) -> bytes:
        if self.raw is not None:
            return np.concatenate([np.array([self.n, 0], np.int64), self.raw]).tobytes()
        parts = [np.array([self.n, 1], np.int64)]
        for t in (self.low, self.high):
            parts.append(np.array([len(t.levels), *[len(x) for x in t.levels], *t.counters], np.int64))
            parts += t.levels
        return np.concatenate(parts).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, seed: int = 1) -> QuantileSketch:
        a, s = np.frombuffer(data, np.int64), cls(seed)
        s.n = int(a[0])
        if not a[1]:
            s.raw = a[2:]
            return s
        s.raw, at = None, 2
        for name, sign in (("low", -1), ("high", 1)):
            m = int(a[at])
            sizes, counters = a[at + 1 : at + 1 + m], [int(c) for c in a[at + 1 + m : at + 1 + 2 * m]]
            at += 1 + 2 * m
            levels = []
            for size in sizes:
                levels.append(a[at : at + size])
                at += int(size)
            setattr(s, name, Tail(sign, seed + (sign > 0), levels, counters))
        return s


def _seed(key: object, salt: int) -> int:
    return zlib.crc32(repr((key, salt)).encode())


def _batches(sketches: Iterable[tuple[str, QuantileSketch]]) -> Iterator[pa.RecordBatch]:
    """Serialized sketches in batches of bounded size."""
    names: list[str] = []
    data: list[bytes] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["g", "sketch"])

    for g, sketch in sketches:
        names.append(g)
        data.append(sketch.to_bytes())
        size += len(data[-1]) + len(g)
        if size >= BATCH_BYTES or len(names) >= 10_000:
            yield batch()
            names, data, size = [], [], 0
    if names:
        yield batch()


def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch the values of each group in a task; hands on what it has when that grows large."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    salt = ctx.partitionId() if ctx else 0
    waiting: dict[str, QuantileSketch] = {}
    held = 0
    for b in batches:
        g = b.column("g").dictionary_encode()
        codes = g.indices.to_numpy(zero_copy_only=False)
        values = b.column("x").to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        codes, values = codes[order], values[order]
        cuts = np.flatnonzero(np.diff(codes)) + 1
        names = g.dictionary.to_pylist()
        for a, z in zip([0, *cuts], [*cuts, len(codes)]):
            if z > a:
                key = names[codes[a]]
                s = waiting.get(key)
                if s is None:
                    s = waiting[key] = QuantileSketch(_seed(key, salt))
                else:
                    held -= s.nbytes
                s.update(values[a:z])
                held += s.nbytes
        if held > HELD_BYTES:
            yield from _batches(waiting.items())
            waiting.clear()
            held = 0
    yield from _batches(waiting.items())


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge sketches that come sorted by group."""

    def merged() -> Iterator[tuple[str, QuantileSketch]]:
        key, current = None, None
        for b in batches:
            for g, s in zip(b.column("g"), b.column("sketch")):  # one at a time, as a batch may hold many large ones
                g, s = g.as_py(), s.as_py()
                if current is not None and g == key:
                    current.merge(QuantileSketch.from_bytes(s))
                    continue
                if current is not None:
                    yield key, current
                key, current = g, QuantileSketch.from_bytes(s, _seed(g, -1))
        if current is not None:
            yield key, current

    yield from _batches(merged())


_SKETCH = "g string, sketch binary"


def merge_sketches(sketches: DataFrame, fan_in: int = 64) -> DataFrame:
    """One sketch per group from sketches of parts (days, partitions, ...): (g, sketch).

    Sketches of a group are merged in two steps, so no task reads all partial
    sketches of a heavy group at once when these are many.
    """
    first = sketches.withColumn("part", F.pmod(F.xxhash64("sketch"), F.lit(fan_in)).cast("int"))
    half = first.repartition("g", "part").sortWithinPartitions("g").select("g", "sketch").mapInArrow(_merge, _SKETCH)
    return half.repartition("g").sortWithinPartitions("g").mapInArrow(_merge, _SKETCH)


def sketch_groups(df: DataFrame, group: Column, value: str, *, merged: bool = True) -> DataFrame:
    """Sketches of ``value`` per ``group`` (a string column): (g, sketch).

    Values are integral (dates, times and decimals can be cast).  Null values
    and null groups are left out.  Every task sketches what it reads before the
    shuffle, so heavy groups cost one sketch per task.
    """
    rows = df.select(group.alias("g"), col(value).cast("bigint").alias("x"))
    rows = rows.where(F.col("g").isNotNull() & F.col("x").isNotNull())
    part = rows.mapInArrow(_partial, _SKETCH)
    return merge_sketches(part) if merged else part


def read_quantiles(sketches: DataFrame, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(g, n, one column per quantile)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [QuantileSketch.from_bytes(s) for s in b.column("sketch").to_pylist()]
            values = [s.quantiles(qs) for s in found]
            cols = [pa.array([v[i] for v in values], pa.int64()) for i in range(len(qs))]
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array([s.n for s in found], pa.int64()), *cols], ["g", "n", *names])

    return sketches.mapInArrow(read, "g string, n bigint, " + ", ".join(f"`{n}` bigint" for n in names))
