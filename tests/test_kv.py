import random
from collections import Counter
from contextlib import closing as KV_closing

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import kv
from tidemark.operators.kv import KV


class Model:
    """All versions in a list; a snapshot is a length."""

    def __init__(self):
        self.ops = []

    def state(self, snapshot=None):
        out = {}
        for seq, (k, v) in enumerate(self.ops if snapshot is None else self.ops[:snapshot], 1):
            out[k] = (seq, v)
        return {k: v for k, (_, v) in out.items() if v is not None}


def test_put_get_delete_and_snapshots(spark):
    db = KV(spark)
    db.put("foo", "v1")
    s = db.snapshot()
    db.put("foo", "v2")
    db.write([("put", "bar", ""), ("delete", "foo"), ("put", "", "empty key")])
    assert db.get("foo") is None and db.get("bar") == "" and db.get("") == "empty key" and db.get("nope") is None
    assert db.get("foo", s) == "v1"
    db.flush()
    assert db.get("foo", s) == "v1" and db.last_seq == 5
    assert [r["key"] for r in db.scan().collect()] == ["", "bar"]
    assert [r["key"] for r in db.scan(reverse=True).collect()] == ["bar", ""]
    assert db.seek("a")["key"] == "bar" and db.seek("c") is None
    with pytest.raises(ValueError):
        db.write([("merge", "x", "y")])
    db.close()
    with pytest.raises(ValueError):
        db.get("foo")


def test_reopening_continues(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = KV(spark, path)
    db.put("a", "1")
    db.close()
    again = KV(spark, path)
    assert again.last_seq == 1 and again.get("a") == "1"
    again.put("a", "2")
    again.close()
    with KV_closing(KV(spark, path)) as third:
        assert third.get("a") == "2"
    with pytest.raises(ValueError):
        KV(spark, path, comparator="reverse(key)")
    again.destroy()
    assert KV(spark, path).get("a") is None


def test_compaction_keeps_what_snapshots_see(spark):
    db = KV(spark)
    for i in range(3):
        db.write([("put", k, f"{k}{i}") for k in "abcd"])
    s = db.snapshot()
    db.write([("delete", "a"), ("put", "b", "last")])
    db.flush()
    before = db.log().count()
    db.compact()
    assert before == 14 and db.log().count() == 6
    assert db.get("a") is None and db.get("a", s) == "a2" and db.get("b", s) == "b2" and db.get("b") == "last"
    db.release(s)
    db.compact("a", "b")
    assert Counter(r["key"] for r in db.log().collect()) == {"b": 2, "c": 1, "d": 1}
    db.compact()
    assert db.log().count() == 3 and db.approximate_size() == len("blast" "cc2" "dd2")
    assert db.approximate_size("c", "d") == 3


def test_acknowledged_writes_survive_a_crash(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = KV(spark, path, value_type="binary")
    db.put("a", bytearray(b"\xff\x00"))
    db.flush()
    db.write([("put", "b", bytearray(b"2")), ("delete", "a"), ("put", "c", None)])
    del db  # no close, no flush
    with pytest.raises(RuntimeError):
        KV(spark, path, value_type="binary")
    again = KV(spark, path, value_type="binary", break_lock=True)
    assert bytes(again.get("b")) == b"2" and again.get("a") is None and again.last_seq == 4
    assert again.put("d", bytearray(b"4")) == 5
    again.flush()
    assert sorted(r["seq"] for r in again.log().collect()) == [1, 2, 3, 4, 5]
    again.close()
    with KV_closing(KV(spark, path, value_type="binary")) as third:
        assert [r["key"] for r in third.scan().collect()] == ["b", "c", "d"] and third.last_seq == 5


def test_a_flush_that_broke_off_is_done_again(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = KV(spark, path)
    db.put("a", "1")
    db._run(spark.createDataFrame(db._rows, db.schema), 0)  # written, but not committed
    again = KV(spark, path, break_lock=True)
    assert again.log().count() == 1 and again.get("a") == "1"


def test_a_second_writer_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = KV(spark, path)
    with pytest.raises(RuntimeError, match="in use"):
        KV(spark, path)
    db.put("a", "1")
    thief = KV(spark, path, break_lock=True)
    thief.put("b", "2")
    thief.flush()
    with pytest.raises(RuntimeError):
        db.flush()
    db.closed = True
    thief.close()
    KV(spark, path).close()


def test_levels_are_picked_by_score(spark, tmp_path):
    db = KV(spark, f"file://{tmp_path}/db", auto_compact=False)
    for i in range(3):
        db.put("a", str(i))
        db.flush()
    assert db.pick() == (0, 0.75) and not db.needs_compaction()
    db.delete("a")
    db.flush()
    assert db.pick() == (0, 1.0)
    db.compact_level(0)
    assert [r["level"] for r in db.runs] == [1] and db.log().count() == 0
    db.put("b", "x" * 100)
    db.flush()
    db.compact_level(0)
    db.LEVEL1_BYTES = 10
    assert db.pick()[0] == 1 and db.needs_compaction()
    db.compact_level(1)
    assert [r["level"] for r in db.runs] == [2]
    db.delete("b")
    db.flush()
    db.compact_level(0)  # the tombstone stays, as level 2 holds what it hides
    assert db.log().count() == 2 and db.get("b") is None
    db.compact_level(1)
    assert db.log().count() == 0


def test_compaction_by_itself_keeps_runs_few(spark):
    db = KV(spark, flush_rows=1)
    for i in range(9):
        db.put(f"k{i % 3}", str(i))
        assert len(db.runs) <= 4
    assert {r["key"]: r["value"] for r in db.scan().collect()} == {"k0": "6", "k1": "7", "k2": "8"}


def test_batches_from_frames(spark):
    db = KV(spark)
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("key"), (F.col("id") % 5 != 0).cast("tinyint").alias("vtype"), F.col("id").cast("string").alias("value"), "id")
    db.put("0", "before")
    assert db.write_frame(rows, ["id"]) == 1001
    log = {r["seq"]: r["value"] for r in db.log().where("seq > 1").collect()}
    assert log == {i + 2: str(i) for i in range(1000)}
    want = {}
    for i in range(1000):
        want[str(i % 7)] = str(i) if i % 5 else None
    assert {r["key"]: r["value"] for r in db.scan().collect()} == {k: v for k, v in want.items() if v}
    keys = spark.createDataFrame([("2",), ("2",), ("1",), ("x",)], "key string")
    assert [r["key"] for r in db.get_many(keys).collect()] == ["2"]


def test_snapshot_list():
    s = kv.Snapshots()
    assert s.oldest() is None
    s.acquire(3), s.acquire(3), s.acquire(7)
    with pytest.raises(ValueError):
        s.acquire(5)
    s.release(3)
    assert s.oldest() == 3
    s.release(3)
    assert s.oldest() == 7


def test_binary_keys_sort_by_unsigned_bytes(spark):
    db = KV(spark, key_type="binary", value_type="binary")
    keys = [b"\xff", b"a", b"\x7f", b"", b"b", b"\x80"]
    db.write([("put", bytearray(k), bytearray(k)) for k in keys])
    assert [bytes(r["key"]) for r in db.scan().collect()] == sorted(keys)
    assert bytes(db.get(bytearray(b"\x80"))) == b"\x80"


def test_comparator_orders_scans(spark):
    db = KV(spark, comparator="reverse(key)")
    db.write([("put", k, k) for k in ("az", "by", "cx")])
    assert [r["key"] for r in db.scan().collect()] == ["cx", "by", "az"]


OPS = st.lists(st.tuples(st.sampled_from("abcde"), st.one_of(st.none(), st.text("xy", max_size=2))), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(OPS, st.integers(0, 25), st.integers(0, 25))
def test_against_a_model(spark, ops, snap, flush_at):
    db, model = KV(spark), Model()
    for i, (k, v) in enumerate(ops):
        db.delete(k) if v is None else db.put(k, v)
        model.ops.append((k, v))
        if i == flush_at:
            db.flush()
    snap = min(snap, len(ops))
    for s in (None, snap):
        assert {r["key"]: r["value"] for r in db.scan(snapshot=s).collect()} == model.state(s)
    log = db.log()
    kept = kv.compact(log, snap)
    for s in range(snap, len(ops) + 1):
        assert {r["key"]: r["value"] for r in kv.visible(kept, s).collect()} == model.state(s)
    # the rule in its other form: a version goes if the next newer one is not after the snapshot
    by_key = {}
    for seq, (k, v) in enumerate(ops, 1):
        by_key.setdefault(k, []).append((seq, v))
    want = set()
    for k, versions in by_key.items():
        for (seq, v), newer in zip(versions, [*versions[1:], None]):
            hidden = newer is not None and newer[0] <= snap
            if not hidden and not (v is None and seq <= snap):
                want.add((k, seq))
    assert {(r["key"], r["seq"]) for r in kept.collect()} == want


@pytest.mark.parametrize("target", [200_000, 5])
def test_reads_at_many_snapshots(spark, monkeypatch, target):
    from tidemark.operators import changes

    monkeypatch.setattr(changes, "LEAST_SAMPLED", 5)
    r = random.Random(3)
    keys = ["hot"] * 5 + ["a", "b", "", None]
    versions = [(r.choice("xy"), r.choice(keys), r.choice([None, *range(1, 90, 3)]), r.choice(["p", "q", "", None]), 1) for _ in range(600)]
    reads = [(i, r.choice(["x", "y", None]), r.choice([*keys, "none"]), r.choice([None, 0, 0, *range(1, 95)]), "s", 2) for i in range(500)]
    reads += [(1000 + i, "x", "hot", 50, "s", 2) for i in range(60)]
    want = {}
    for i, t, k, s, *_ in reads:
        hits = [(v[2], v[3] is not None, v[3]) for v in versions if None not in (t, k, s, v[2]) and v[:2] == (t, k) and (s == 0 or v[2] <= s)]
        best = max(hits, key=lambda h: (h[0], h[1], h[2] or ""), default=(None, None, None))
        want[i] = (best[0], best[2])
    got = kv.read_at(
        spark.createDataFrame(reads, "id long, t string, k string, at long, s string, x int"),
        spark.createDataFrame(versions, "t string, k string, at long, value string, id int"),
        ["t", "k"], "at", "value", target_rows=target,
    )
    assert got.columns == ["id", "t", "k", "at", "s", "x", "found_seq", "found_value"]
    rows = got.collect()
    assert len(rows) == len(reads) and {r["id"]: (r["found_seq"], r["found_value"]) for r in rows} == want


def test_reads_over_nothing(spark):
    reads = spark.createDataFrame([(1, "a", 0), (2, "a", 5)], "id long, k string, at long")
    none = spark.createDataFrame([], "k string, at long, value string")
    assert {tuple(r) for r in kv.read_at(reads, none, ["k"], "at", "value").collect()} == {(1, "a", 0, None, None), (2, "a", 5, None, None)}
    assert kv.read_at(reads.limit(0), none, ["k"], "at", "value").count() == 0


def test_concatenation_wants_disjoint_runs(spark):
    a, b, none = (spark.createDataFrame(r, "key long, seq long") for r in ([(5, 1), (9, 1)], [(1, 1), (4, 2)], []))
    assert [r["key"] for r in kv.concatenate([a, none, b]).collect()] == [1, 4, 5, 9]
    assert kv.concatenate([none]).count() == 0
    with pytest.raises(ValueError):
        kv.concatenate([a, spark.createDataFrame([(9, 2)], "key long, seq long")])
