import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.upsert import UpsertStore, deduplicate, slices

SCHEMA = "tenant string, seq long, at long, id long, value string, run long, n long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(900):
        hot = i % 3 == 0
        tenant = "hot" if hot else r.choice(["a", "A", "", None])
        seq = 1 if hot else r.choice([*range(60), None])
        out.append((tenant, seq, r.choice([*range(50), None]), i, r.choice(["x", "", None]), r.choice([*range(8), None]), i))
    return out


def lowest(v):
    return tuple((x is not None, x) for x in v)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_one_copy_of_each(spark, rows, keep):
    df = spark.createDataFrame(rows, SCHEMA)
    got = deduplicate(df, ["tenant", "seq"], ["at", "id"], ["value"], batch_by="run", batches=4, keep=keep)
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    best = min if keep == "first" else max
    want = {(*k, *best(((x[2], x[3], x[4]) for x in g), key=lowest), len(g)) for k, g in groups.items()}
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_repeating_a_batch_changes_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    store = UpsertStore(spark, df, ["tenant", "seq"], ["at", "id"])
    a, b = df.where("n % 2 = 0"), df.where("n % 2 = 1")
    store.upsert(a, 0)
    store.upsert(b, 1)
    before = sorted(map(repr, store.merged().collect()))
    store.upsert(a, 0)
    assert sorted(map(repr, store.merged().collect())) == before
    store.upsert(df.limit(0), 2)
    assert sorted(map(repr, store.compact().collect())) == before


def test_merging_runs_needs_no_shuffle(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    store = UpsertStore(spark, df, ["tenant", "seq"], ["at", "id"])
    store.upsert(df, 0)
    assert "Exchange" not in store.merged()._jdf.queryExecution().executedPlan().toString()


def test_empty_table_and_reserved_name(spark, rows):
    df = spark.createDataFrame([], SCHEMA)
    assert deduplicate(df, ["tenant", "seq"], ["at", "id"], batch_by="run").count() == 0
    with pytest.raises(ValueError):
        UpsertStore(spark, df.withColumn("copies", F.lit(1)), ["copies"], ["at"])


def test_slices_cover_everything_once(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    parts = slices(df, "run", 3)
    ids = [r["id"] for p in parts for r in p.select("id").collect()]
    assert sorted(ids) == list(range(900))


@pytest.mark.parametrize("by, batches", [("one", 4), ("run", 1), ("none", 4)])
def test_a_single_batch_is_collapsed_too(spark, by, batches):
    rows = [("a", 1, i, i, None, 1, 1) for i in range(5)] + [("b", 2, 7, 7, None, 2, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"one": F.lit(1), "none": F.lit(None).cast("int")})
    got = deduplicate(df, ["tenant", "seq"], ["at", "id"], batch_by=by, batches=batches)
    assert {tuple(r) for r in got.collect()} == {("a", 1, 0, 0, 5), ("b", 2, 7, 7, 1)} and got.count() == 2
