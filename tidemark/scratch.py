"""Places for intermediate tables, and tables kept as hash-bucketed runs.

Intermediate results that must outlive an executor are written as parquet
below the shared folder named by ``spark.checkpoint.dir``.  Where that setting
is missing (tests, a laptop) a temporary folder is used, which is refused on a
cluster because the executors could not see it.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_roots: dict[str, str] = {}
_databases: dict[str, str] = {}


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path, 0 if there is none."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file or folder to a path that is not in use; anything else is an error."""
    fs, target = _fs(spark, new)
    if fs.exists(target) or not fs.rename(_fs(spark, old)[1], target):
        raise OSError(f"cannot move {old} to {new}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Make a new file as a whole: it is written under another name and then moved; one that exists is an error."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    fs, p = _fs(spark, part)
    out = fs.create(p)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        rename(spark, part, path)
    except OSError:
        fs.delete(p, False)
        raise


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table; removed when the driver exits."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not _is_local(spark):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _roots[app] = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"

        fs, root = _fs(spark, _roots[app])

        def clean() -> None:
            with contextlib.suppress(Exception):
                fs.delete(root, True)

        atexit.register(clean)
    return f"{_roots[app]}/{name}-{uuid.uuid4().hex[:12]}"


def drop_database_at_exit(spark: SparkSession, name: str) -> None:
    """Leave no entry of a database of this application in the catalog."""

    def drop() -> None:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")

    atexit.register(drop)


def scratch_database(spark: SparkSession) -> str:
    """The application's database for tables over scratch folders; dropped when the driver exits."""
    app = spark.sparkContext.applicationId
    if app not in _databases:
        name = f"tidemark_scratch_{uuid.uuid4().hex[:16]}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'catalog')}'")
        _databases[app] = name
        drop_database_at_exit(spark, name)
    return _databases[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table early."""
    with contextlib.suppress(Exception):
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def column_of(spark: SparkSession, expression: JavaObject) -> Column:
    """A Catalyst expression as a column."""
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, also where names repeat, and in frames made from it."""
    attributes = df._jdf.queryExecution().analyzed().output()
    return [column_of(df.sparkSession, attributes.apply(i)) for i in range(attributes.size())]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def col(name: str):
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _intervals(runs: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Spans of run numbers, adjoining ones joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(map(tuple, runs)):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class Manifest:
    """What a store consists of: numbered small files, of which the last one counts.

    A new state is a new file, made as a whole, so a change that is broken off
    leaves the state before it; of two writers the second is refused.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path}/_manifest"
        self.number = self._last()
        self.state: dict = json.loads(read_text(spark, self._file(self.number))) if self.number else {}

    def _file(self, number: int) -> str:
        return f"{self.path}/{number:09d}.json"

    def _last(self) -> int:
        return max((int(n[:9]) for n in names(self.spark, self.path) if n.endswith(".json")), default=0)

    def commit(self, state: dict) -> None:
        if self._last() != self.number:
            raise RuntimeError(f"another writer has changed {self.path}")
        create_text(self.spark, self._file(self.number + 1), json.dumps(state))
        self.number, self.state = self.number + 1, state
        if self.number > 2:
            discard(self.spark, self._file(self.number - 2))


class BucketedRuns:
    """A table kept as runs: each run is hash-bucketed by ``ids`` and sorted by their hash.

    With ``hashed`` the first of ``ids`` is a 64-bit hash and the rows are sorted
    by it, so that a join or aggregate on ``ids`` sorts what is nearly in order.

    On disk it is a parquet table partitioned by part and bucketed by ``ids``,
    so that grouping or joining by ``ids`` needs no shuffle of what is stored.
    A :class:`Manifest` beside the data says which parts make up which runs.  It changes
    after the parts are there: a write that was broken off leaves the store as it was.

    * Writing a run under a number that exists replaces that run.
    * :meth:`merge` puts one run in the place of several; writing one of those
      again changes nothing.
    * Opened again on its ``path`` a store goes on as it was.  Other ``ids``,
      columns, numbers of buckets or ``meta`` than it was made with are refused.

    Parts that are no longer in use stay until the next merge but one, so that
    frames made before a merge can still be read after it.
    """

    RUN = "__run"

    def __init__(
        self,
        spark: SparkSession,
        ids: Sequence[str],
        schema: str,
        *,
        path: str | None = None,
        buckets: int | None = None,
        meta: Mapping | None = None,
        hashed: bool = False,
    ) -> None:
        self.spark, self.ids, self.hashed = spark, list(ids), hashed
        self.path = (path or scratch_path(spark, "runs")).rstrip("/")
        fields = T._parse_datatype_string(schema)
        self.columns = fields.names
        made = {"ids": self.ids, "columns": fields.simpleString(), "meta": dict(meta or {})}
        self._manifest = Manifest(spark, self.path)
        held = self._manifest.state
        self._entries: list[dict] = held.get("entries", [])
        self._retired: list[int] = held.get("retired", [])
        self.buckets = held.get("buckets") or buckets or shuffle_partitions(spark)
        if held and (held["made"] != json.loads(json.dumps(made)) or buckets not in (None, self.buckets)):
            raise ValueError(f"the runs at {self.path} have {self.buckets} buckets and were made as {held['made']}")
        self._made = made
        self.name = f"{scratch_database(spark)}.runs_{uuid.uuid4().hex}"
        keys = ", ".join(f"`{c}`" for c in ids)
        spark.sql(
            f"CREATE TABLE {self.name} ({schema}, `{self.RUN}` INT) USING parquet PARTITIONED BY (`{self.RUN}`) "
            f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        there = set(names(spark, self.path)) if held else set()
        live = [p for e in self._entries for p in e["parts"] if f"{self.RUN}={p}" in there]
        if live:
            spark.sql(f"ALTER TABLE {self.name} ADD " + " ".join(f"PARTITION (`{self.RUN}`={p})" for p in live))

    def _commit(self, entries: list[dict], retired: list[int]) -> None:
        """Make ``entries`` what the store consists of."""
        entries = sorted(entries, key=lambda e: e["runs"])
        self._manifest.commit({"made": self._made, "buckets": self.buckets, "entries": entries, "retired": retired})
        self._entries, self._retired = entries, retired

    def _store(self, df: DataFrame, parts: Mapping[int, Column | None]) -> None:
        """Write rows as the parts (ascending numbers) whose condition they meet first."""
        number = F.lit(None).cast("int")
        for p, test in reversed(parts.items()):
            number = F.lit(p) if test is None else F.when(test, F.lit(p)).otherwise(number)
        rows = df.select(*[col(c) for c in self.columns], number.alias(self.RUN))
        if all(t is not None for t in parts.values()):
            rows = rows.where(F.col(self.RUN).isNotNull())
        # no shuffle if the rows already lie in that partitioning
        rows = rows.repartition(self.buckets, *[col(c) for c in self.ids])
        # one long to sort by: the part, then the upper half of the hash in its signed order
        hashed = col(self.ids[0]) if self.hashed else F.xxhash64(*[col(c) for c in self.ids])
        high = F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(1 << 63))), 32)
        rows = rows.sortWithinPartitions(F.shiftleft(F.col(self.RUN).cast("bigint"), 32).bitwiseOR(high))
        # the writer sorts by part and bucket, which are in order, so that takes one pass; without the partition's
        # number in this expression the optimizer would drop the sort above for the writer's
        part = (F.col(self.RUN) + F.spark_partition_id() * 0).cast("int").alias(self.RUN)
        rows.select(*[col(c) for c in self.columns], part).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    @staticmethod
    def _new_part() -> int:
        return uuid.uuid4().int & 0x7FFFFFFF

    def _size(self, part: int) -> int:
        return size_of(self.spark, f"{self.path}/{self.RUN}={part}")

    def next_run(self) -> int:
        """One more than the highest run that was written, 0 if there is none."""
        return max((hi + 1 for e in self._entries for _, hi in e["runs"]), default=0)

    def merged(self, run: int) -> bool:
        """Whether ``run`` has been merged with others."""
        return any(lo <= run <= hi for e in self._entries if e["runs"] != [[run, run]] for lo, hi in e["runs"])

    def write(self, df: DataFrame | Sequence[DataFrame], run: int) -> bool:
        """Store rows (with the columns of the schema) as run ``run``; False if it was merged before, which changes nothing.

        Several frames become parts of the one run, each in its own partitioning.
        """
        return self.write_all(df, {run: None})

    def write_all(self, df: DataFrame | Sequence[DataFrame], runs: Mapping[int, Column | None]) -> bool:
        """Store several runs in one pass: each row belongs to the first run whose condition is true (or None)."""
        frames = [df] if isinstance(df, DataFrame) else list(df)
        runs = {r: c for r, c in runs.items() if not self.merged(r)}
        if not runs:
            return False
        new = {r: {"parts": [], "runs": [[r, r]]} for r in runs}
        for f in frames:
            parts = dict(zip(sorted(self._new_part() for _ in runs), runs.items()))
            self._store(f, {p: test for p, (_, test) in parts.items()})
            for p, (r, _) in parts.items():
                new[r]["parts"].append(p)
        for e in new.values():
            e["bytes"] = sum(self._size(p) for p in e["parts"])
        old = [e for e in self._entries if e["runs"][0][0] in new and e["runs"] == new[e["runs"][0][0]]["runs"]]
        kept = [e for e in self._entries if e not in old]
        self._commit([*kept, *new.values()], [*self._retired, *[p for e in old for p in e["parts"]]])
        return True

    def frame(self, up_to: int | None = None) -> DataFrame:
        """All runs, or those numbered ``up_to`` and below."""
        live = self._entries
        if up_to is not None:
            if any(e["runs"][0][0] <= up_to < e["runs"][-1][1] for e in live):
                raise ValueError(f"run {up_to} has been merged with later ones")
            live = [e for e in live if e["runs"][-1][1] <= up_to]
        return self.read(live)

    def entries(self) -> list[dict]:
        """What the store consists of: runs, or what they were merged into."""
        return list(self._entries)

    def read(self, entries: Sequence[dict]) -> DataFrame:
        parts = [p for e in entries for p in e["parts"]]
        return self.spark.table(self.name).where(F.col(self.RUN).isin(parts) if parts else F.lit(False))

    def to_merge(self, fan_in: int = 4) -> list[dict]:
        """The newest runs that together are worth merging, oldest first; none if these are fewer than ``fan_in``.

        From the newest run backwards a run is added while it has at most twice
        the bytes of those chosen so far, so a row is rewritten a logarithmic
        number of times however many runs there are.
        """
        chosen: list[dict] = []
        size = 0
        for e in reversed(self._entries):
            if chosen and e["bytes"] > 2 * size:
                break
            chosen.insert(0, e)
            size += e["bytes"]
        return chosen if len(chosen) >= fan_in else []

    def merge(self, entries: Sequence[dict], df: DataFrame) -> None:
        """Put ``df``, which says what the runs of ``entries`` say, in their place as one run."""
        part = self._new_part()
        self._store(df, {part: None})
        entry = {"parts": [part], "runs": _intervals([i for e in entries for i in e["runs"]]), "bytes": self._size(part), "merged": True}
        gone = self._retired
        self._commit([*[e for e in self._entries if e not in entries], entry], [p for e in entries for p in e["parts"]])
        self._remove(gone)

    def _remove(self, parts: Sequence[int]) -> None:
        for p in parts:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (`{self.RUN}`={p})")
            discard(self.spark, f"{self.path}/{self.RUN}={p}")

    def vacuum(self) -> None:
        """Remove parts that are no longer in use, also those of the last merge."""
        gone = self._retired
        self._commit(self._entries, [])
        self._remove(gone)

    def plain(self) -> DataFrame:
        """All rows read as files, which stays possible after :meth:`close`."""
        schema = self.spark.table(self.name).drop(self.RUN).schema
        folders = [f"{self.path}/{self.RUN}={p}" for e in self._entries for p in e["parts"]]
        folders = [f for f in folders if exists(self.spark, f)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def close(self) -> None:
        """Leave the catalog; what is stored stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.close()
        discard(self.spark, self.path)
