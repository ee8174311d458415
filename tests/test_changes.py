import random

import pytest

from tidemark.operators.changes import apply_changes

SCHEMA = "tenant string, key string, seq long, kind int, value string, h string, block int, m int"


def make(n, seed, keys=40):
    r = random.Random(seed)
    changes = []
    for s in range(n):
        hot = s % 3 == 0
        key = ("hot", "k") if hot else (r.choice(["a", "A", "", None]), r.choice([*map(str, range(keys)), "", None]))
        changes.append((*key, s, r.choice([0, 0, 0, 1, 2]), r.choice(["v", "", None, f"v{s}"]), "h", 1, 2))
    feed = changes + [c for c in changes if r.random() < 0.3]
    feed += [("a", "1", None, 0, "no seq", "h", 1, 2), ("a", "1", 10**6, None, "no kind", "h", 1, 2)]
    r.shuffle(feed)
    return feed


def model(feed, base=()):
    state = {}
    for t, k, s, v in base:
        state[t, k] = (s, 0, v)
    for t, k, s, kind, v, *_ in feed:
        if s is not None and kind in (0, 1) and ((t, k) not in state or s > state[t, k][0]):
            state[t, k] = (s, kind, v)
    return {(t, k, s, v) for (t, k), (s, kind, v) in state.items() if kind == 0}


@pytest.mark.parametrize("target_rows", [10, 200_000])
def test_state(spark, target_rows):
    feed = make(1500, 1)
    df = spark.createDataFrame(feed, SCHEMA)
    got = apply_changes(df, ["tenant", "key"], "seq", "kind", ["value"], target_rows=target_rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, model(feed)))


def test_keys_only(spark):
    feed = make(600, 2)
    got = apply_changes(spark.createDataFrame(feed, SCHEMA), ["tenant", "key"], "seq", "kind", target_rows=20)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x[:3]) for x in model(feed))


def test_base_rows_count_as_earlier_puts(spark):
    feed = make(300, 3)
    base = [("a", "1", -5, "old"), ("base", "only", -1, None), ("hot", "k", -9, "old")]
    b = spark.createDataFrame(base, "tenant string, key string, seq long, value string")
    got = apply_changes(spark.createDataFrame(feed, SCHEMA), ["tenant", "key"], "seq", "kind", ["value"], base=b)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, model(feed, base)))


def test_copies_that_disagree_have_a_fixed_winner(spark):
    rows = [("t", "k", 1, 0, "b", "", 0, 0), ("t", "k", 1, 0, "a", "", 0, 0), ("t", "k", 1, 1, "a", "", 0, 0)]
    got = apply_changes(spark.createDataFrame(rows, SCHEMA), ["tenant", "key"], "seq", "kind", ["value"])
    assert [tuple(r) for r in got.collect()] == [("t", "k", 1, "a")]


def test_empty_feed(spark):
    assert apply_changes(spark.createDataFrame([], SCHEMA), ["tenant", "key"], "seq", "kind", ["value"]).count() == 0


@pytest.mark.parametrize("others", [[], [("t", "k", 4, 0, "u", "", 0, 0)]])
def test_a_message_delivered_very_often(spark, others):
    rows = [("t", "k", 5, 0, "v", "", 0, 0)] * 2000 + [*others, ("t", "j", 6, 0, "w", "", 0, 0)]
    got = apply_changes(spark.createDataFrame(rows, SCHEMA), ["tenant", "key"], "seq", "kind", ["value"], target_rows=50)
    assert {tuple(r) for r in got.collect()} == {("t", "k", 5, "v"), ("t", "j", 6, "w")}


def test_one_shuffle_serves_keys_that_are_not_heavy(spark):
    df = spark.createDataFrame(make(300, 6), SCHEMA)
    got = apply_changes(df, ["tenant", "key"], "seq", "kind", ["value"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
