"""Filling containers of fixed capacity with texts, by harmonic classes."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import DEFAULT_TOKENIZER, local_vocabulary, ship_vocabulary, token_counter
from tidemark.scratch import col

#: Number of harmonic classes; shorter texts than capacity / CLASSES share one class.
CLASSES = 24
#: Closed packs whose room a task remembers.
REMEMBERED = 4_096

SCHEMA = "pack_name string, pack_id string, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"


class HarmonicPacker:
    """Packs for one capacity, filled in one pass by one worker.

    Class j (1 <= j < classes) takes the sizes in (C / (j + 1), C / j]; its packs
    hold exactly j texts of the class, so whatever they are they fit.  A text of
    class j goes into the class's open pack, which is closed after its j-th text.
    Shorter texts (at most C / classes) fill packs of their own until the next
    does not fit.  Before it opens a pack, or takes a place in one, a text of
    class 2 or more uses the room that a closed pack has left, if one has enough;
    of several the one with the least room is taken.
    """

    def __init__(self, capacity: int, classes: int = CLASSES) -> None:
        self.capacity, self.classes = capacity, classes
        self.open: dict[int, list[int]] = {}  # class -> [pack, texts, tokens]
        self.packs = 0
        self.rooms: list[int] = []  # ascending sizes of the rooms below, each size once
        self.having: dict[int, list[int]] = {}  # room -> packs that have it
        self.remembered = 0

    def _close(self, pack: int, room: int) -> None:
        if room < 1:
            return
        if room not in self.having:
            bisect.insort(self.rooms, room)
            self.having[room] = []
        self.having[room].append(pack)
        self.remembered += 1
        if self.remembered > REMEMBERED:  # the least room is the least use
            self._take(0)

    def _take(self, at: int) -> int:
        room = self.rooms[at]
        pack = self.having[room].pop()
        self.remembered -= 1
        if not self.having[room]:
            del self.having[room], self.rooms[at]
        return pack

    def _new(self) -> int:
        self.packs += 1
        return self.packs - 1

    def place(self, size: int) -> int:
        """Pack number for a text of 1 <= size <= capacity tokens."""
        j = self.capacity // size
        if j > 1:
            at = bisect.bisect_left(self.rooms, size)
            if at < len(self.rooms):
                room = self.rooms[at]
                pack = self._take(at)
                self._close(pack, room - size)
                return pack
        if j >= self.classes:
            j = 0
        o = self.open.pop(j, None)
        if o is not None and o[2] + size > self.capacity:  # only in the class of short texts
            self._close(o[0], self.capacity - o[2])
            o = None
        o = o or [self._new(), 0, 0]
        o[1] += 1
        o[2] += size
        if o[1] == j:
            self._close(o[0], self.capacity - o[2])
        else:
            self.open[j] = o
        return o[0]

    def pieces(self, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(pack, piece, start, tokens) of a text; only one longer than the capacity is divided.

        Full pieces take a pack each; what is left over is packed like a text.
        """
        full, rest = divmod(size, self.capacity)
        if size <= self.capacity:
            full, rest = 0, size
        for i in range(full):
            yield self._new(), i, i * self.capacity, self.capacity
        if rest:
            yield self.place(rest), full, full * self.capacity, rest


def pack_texts(
    df: DataFrame, ident: str, text: str, capacities: dict[str, int], *, tokenizer: str = DEFAULT_TOKENIZER, classes: int = CLASSES
) -> DataFrame:
    """Assign every text to packs of each capacity: one row per piece.

    Output: pack_name, pack_id, doc_id, piece_no, start_token, n_tokens.  Each
    worker packs what it reads in one pass without a shuffle; a pack belongs to
    one task, and at most ``classes`` packs per capacity and task stay partly
    filled.  A pack's tokens never exceed its capacity.  A text longer than the
    capacity is divided into full packs and a rest; no other text is divided.

    Null and empty texts have no tokens, so nothing of them is packed.  Repeated
    rows are packed repeatedly.  Other columns are ignored, whatever their
    names.  An empty input gives no rows.  Capacities below 1 are refused.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be at least 1")
    wanted = dict(capacities)
    ship_vocabulary(df.sparkSession, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        count = token_counter(local_vocabulary(tokenizer))
        packers = {name: HarmonicPacker(c, classes) for name, c in wanted.items()}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = count([t or "" for t in texts])
            rows: list[tuple] = []
            for name, packer in packers.items():
                for i, n in zip(ids, sizes):
                    rows += [(name, f"{name}/{part}/{p}", i, k, s, m) for p, k, s, m in packer.pieces(n)]
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["pack_name", "pack_id", "doc_id", "piece_no", "start_token", "n_tokens"]
            )

    if not wanted:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return df.select(col(ident).cast("bigint").alias("doc_id"), col(text).alias("txt")).mapInArrow(run, SCHEMA)


def read_capacities(spark: SparkSession, path: str) -> dict[str, int]:
    """The table of capacities (a handful of rows; more than 1,000 are refused)."""
    rows = spark.read.parquet(path).select("pack_name", "capacity").where(F.col("capacity").isNotNull()).limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("too many capacities")
    return {r["pack_name"]: r["capacity"] for r in rows}
