"""Stores on a path that already holds runs, with all Python objects gone in between."""

import os

import pytest

from tidemark.operators.upsert import UpsertStore
from tidemark.scratch import BucketedRuns, scratch_database

SCHEMA = "k string, at long"


def store(spark, path, **more):
    return UpsertStore(spark, spark.createDataFrame([], SCHEMA), ["k"], ["at"], path=path, **more)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(s):
    return {tuple(r) for r in s.merged().collect()}


def test_store_goes_on_after_reopening_compaction_and_replay(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store(spark, path, buckets=3).upsert(rows(spark, ("a", 1), ("b", 1)), 0)
    two = store(spark, path)
    assert two.upsert(rows(spark, ("a", 2)), 1)
    want = {("a", 1, 2), ("b", 1, 1)}
    assert held(two) == want
    two.compact()
    assert held(two) == want
    assert not two.upsert(rows(spark, ("a", 2)), 1) and held(two) == want
    three = store(spark, path)
    assert held(three) == want and three.runs.buckets == 3
    assert not three.upsert(rows(spark, ("a", 1), ("b", 1)), 0)
    assert three.upsert(rows(spark, ("a", 0), ("c", 9)), 2)
    assert held(three) == {("a", 0, 3), ("b", 1, 1), ("c", 9, 1)}
    assert three.upsert(rows(spark, ("c", 9)), 2)  # a run not merged yet is replaced
    assert held(store(spark, path)) == {("a", 1, 2), ("b", 1, 1), ("c", 9, 1)}


def test_a_run_that_comes_after_later_ones_were_merged_is_kept(spark, tmp_path):
    s = store(spark, f"file://{tmp_path}/store")
    s.upsert(rows(spark, ("a", 5)), 0)
    s.upsert(rows(spark, ("a", 4)), 2)
    s.compact()
    assert s.upsert(rows(spark, ("a", 3)), 1) and held(s) == {("a", 3, 3)}
    s.compact()
    assert [e["runs"] for e in s.runs.entries()] == [[[0, 2]]]


def test_other_layouts_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store(spark, path, buckets=3).upsert(rows(spark, ("a", 1)), 0)
    for wrong in ({"buckets": 5}, {"keep": "last"}):
        with pytest.raises(ValueError):
            store(spark, path, **wrong)
    with pytest.raises(ValueError):
        UpsertStore(spark, rows(spark), ["at"], ["k"], path=path)


def test_a_broken_off_write_changes_nothing_and_two_writers_do_not_mix(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one, other = store(spark, path), store(spark, path)
    one.upsert(rows(spark, ("a", 1)), 0)
    one.runs._store(spark.createDataFrame([("x", 1, 1)], f"{SCHEMA}, copies long"), {77: None})
    assert held(store(spark, path)) == {("a", 1, 1)}
    with pytest.raises(RuntimeError):
        other.upsert(rows(spark, ("z", 1)), 0)
    assert held(store(spark, path)) == {("a", 1, 1)}


def test_frames_made_before_a_merge_can_be_read_after_it(spark, tmp_path):
    s = store(spark, f"file://{tmp_path}/store")
    for i in range(3):
        s.upsert(rows(spark, ("a", i)), i)
    before = s.merged()
    s.compact()
    assert {tuple(r) for r in before.collect()} == {("a", 0, 3)}
    s.upsert(rows(spark, ("a", 7)), 3)
    s.compact()  # now the first runs are removed
    folders = [n for n in os.listdir(f"{tmp_path}/store") if n.startswith("__run=")]
    assert len(folders) == 3 and held(s) == {("a", 0, 4)}
    with pytest.raises(ValueError):
        s.runs.frame(1)


def test_upkeep_keeps_the_number_of_runs_small(spark, tmp_path):
    s = store(spark, f"file://{tmp_path}/store", buckets=1)
    most = 0
    for i in range(12):
        s.upsert(rows(spark, (f"k{i}", i)), i)
        s.compact(fan_in=3)
        most = max(most, len(s.runs.entries()))
    assert most <= 4 and s.merged().count() == 12


def test_closed_stores_leave_no_catalog_entry(spark):
    runs = BucketedRuns(spark, ["k"], "k string")
    listed = {t.name for t in spark.catalog.listTables(scratch_database(spark))}
    assert runs.name.split(".")[1] in listed
    runs.drop()
    assert runs.name.split(".")[1] not in {t.name for t in spark.catalog.listTables(scratch_database(spark))}
