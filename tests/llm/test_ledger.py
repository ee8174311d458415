import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.ledger import KeyLedger, answer_batches
from tidemark.operators.upsert import slices

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key string, at timestamp_ntz, writes boolean, k int, t int, w int, first_at int"


def make(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else r.choice([None, "", *[f"k{j}" for j in range(n // 4)]])
        at = r.choice([None, *range(n // 3)])
        out.append((i, key, None if at is None else T0 + dt.timedelta(minutes=at), r.random() < 0.7, 1, 2, 3, 4))
    return out


def truth(rows):
    first = {}
    for _, k, t, w, *_ in rows:
        if w and k is not None and t is not None and (k not in first or t < first[k]):
            first[k] = t
    return {i: k in first and t is not None and first[k] < t for i, k, t, *_ in rows}


@pytest.mark.parametrize("heavy", [None, ["hot"], ["hot", "k1", "unknown"], []])
@pytest.mark.parametrize("batches", [1, 4])
def test_answers_have_no_errors(spark, heavy, batches):
    rows = make(900, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    ledger, got = KeyLedger(spark), {}
    for b in slices(df, "at", batches):
        out = ledger.observe(b, "key", "at", writes=F.col("writes"), carry=["id", "k"], heavy=heavy)
        got |= {r["id"]: r["seen"] for r in out.collect()}
    assert got == truth(rows)
    firsts = ledger.first_seen()
    assert firsts.count() == len({k for _, k, t, w, *_ in rows if w and k is not None and t is not None})


def test_neither_history_nor_batch_is_shuffled_again(spark):
    df = spark.createDataFrame(make(200, 2), SCHEMA)
    ledger = KeyLedger(spark)
    ledger.observe(df, "key", "at", carry=["id"], heavy=[])
    assert "Exchange" not in ledger.first_seen()._jdf.queryExecution().executedPlan().toString()
    out = ledger.observe(df, "key", "at", carry=["id"], heavy=[])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_batch_does_not_see_later_ones(spark):
    ledger = KeyLedger(spark)
    one = spark.createDataFrame([(1, "a", T0)], "id long, key string, at timestamp_ntz")
    two = spark.createDataFrame([(2, "a", T0 + dt.timedelta(1)), (3, "b", T0)], "id long, key string, at timestamp_ntz")
    first = ledger.observe(one, "key", "at", carry=["id"])
    second = ledger.observe(two, "key", "at", carry=["id"])
    assert [tuple(r) for r in first.collect()] == [(1, False)]
    assert {tuple(r) for r in second.collect()} == {(2, True), (3, False)}


def test_late_batches_are_answered_and_lower_the_first_arrival(spark):
    ledger = KeyLedger(spark)
    schema = "id long, key string, at timestamp_ntz"
    ledger.observe(spark.createDataFrame([(1, "a", T0 + dt.timedelta(5))], schema), "key", "at")
    late = ledger.observe(spark.createDataFrame([(2, "a", T0)], schema), "key", "at", carry=["id"])
    assert [tuple(r) for r in late.collect()] == [(2, False)]
    after = ledger.observe(spark.createDataFrame([(3, "a", T0 + dt.timedelta(1))], schema), "key", "at", carry=["id"])
    assert [tuple(r) for r in after.collect()] == [(3, True)]
    assert ledger.first_seen().count() == 1


def test_empty_batches_and_clashing_result_name(spark):
    df = spark.createDataFrame([], SCHEMA)
    ledger = KeyLedger(spark)
    assert ledger.observe(df, "key", "at", carry=["id"]).count() == 0
    with pytest.raises(ValueError):
        ledger.observe(df.withColumn("seen", F.lit(1)), "key", "at", carry=["seen"])
    named = ledger.observe(df.withColumn("seen", F.lit(1)), "key", "at", carry=["seen"], seen="known")
    assert named.columns == ["seen", "known"]


def one(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, key string, at long")


def answers(ledger, batch, **more):
    return {tuple(r) for r in ledger.observe(batch, "key", "at", carry=["id"], **more).collect()}


@pytest.mark.parametrize("heavy", [[], ["a"]])
def test_a_ledger_goes_on_after_reopening_compaction_and_replay(spark, tmp_path, heavy):
    path = f"file://{tmp_path}/ledger"
    first = one(spark, (1, "a", 1), (2, "b", 1), (3, "a", 2))
    ledger = KeyLedger(spark, at_type="bigint", path=path, buckets=3)
    assert answers(ledger, first, heavy=heavy) == {(1, False), (2, False), (3, True)}
    again = KeyLedger(spark, at_type="bigint", path=path)
    assert again.runs == 1 and again.store.buckets == 3
    second = one(spark, (4, "a", 3), (5, "c", 3))
    assert answers(again, second, heavy=heavy) == {(4, True), (5, False)}
    assert answers(again, second, heavy=heavy, run=1) == {(4, True), (5, False)} and again.runs == 2
    again.compact()
    assert again.runs == 2 and len(again.store.entries()) == 1 and again.first_seen().count() == 3
    third = KeyLedger(spark, at_type="bigint", path=path)
    assert answers(third, second, heavy=heavy, run=1) == {(4, True), (5, False)} and third.runs == 2
    assert answers(third, one(spark, (6, "c", 4), (7, "d", 4), (8, None, 4)), heavy=heavy) == {(6, True), (7, False), (8, False)}
    assert {tuple(r) for r in third.first_seen().collect()} == {("a", 1), ("b", 1), ("c", 3), ("d", 4)}
    with pytest.raises(ValueError):
        KeyLedger(spark, at_type="bigint", path=path, buckets=5)


def test_a_late_batch_meets_what_was_merged_over_it(spark, tmp_path):
    ledger = KeyLedger(spark, at_type="bigint", buckets=2)
    answers(ledger, one(spark, (1, "a", 1)), run=0)
    answers(ledger, one(spark, (2, "b", 9)), run=2)
    ledger.compact()
    assert answers(ledger, one(spark, (3, "a", 5), (4, "b", 5), (5, "b", 10)), run=1) == {(3, True), (4, False), (5, True)}
    assert {tuple(r) for r in ledger.first_seen().collect()} == {("a", 1), ("b", 5)}


def test_rows_kept_for_answers_are_bounded(spark):
    ledger = KeyLedger(spark, at_type="bigint", buckets=1)
    ledger.KEPT = 2
    for i in range(4):
        assert answers(ledger, one(spark, (i, "a", i)), heavy=[]) == {(i, i > 0)}
    assert len(ledger._staged) == 2


def test_a_stream_is_answered_across_restarts(spark, tmp_path):
    path, got = f"file://{tmp_path}/ledger", {}

    def sink(answers, number):
        got[number] = {tuple(r) for r in answers.collect()}

    batches = [one(spark, (i, "a", i), (10 + i, f"k{i}", i)) for i in range(5)]
    for numbers in ([0, 1, 2], [2, 3], [3, 4]):
        ledger = KeyLedger(spark, at_type="bigint", path=path, buckets=2)
        write = answer_batches(ledger, "key", "at", sink, carry=["id"], fan_in=2)
        for n in numbers:
            write(batches[n], n)
        ledger.close()
    assert got == {i: {(i, i > 0), (10 + i, False)} for i in range(5)}
    assert KeyLedger(spark, at_type="bigint", path=path).runs == 5
