import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.bloom import bloom_filter
from tidemark.operators.orphans import Reference, month, orphans

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + dt.timedelta(days=n)


CHILD = "id long, dep long, st string, loaded_at timestamp_ntz, k string, since int, pk int"
PARENT = "id long, code string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


@pytest.fixture(scope="module")
def data():
    r = random.Random(4)
    parents = [(i, f"S{i}", at(r.randrange(100)), at(r.choice([None, None, 60, 120]))) for i in range(40)]
    parents += [(3, "S3", at(80), None), (None, None, at(0), None), (7, "S7", None, None)]
    child = []
    for i in range(800):
        d = 5 if i % 3 == 0 else r.choice([None, *range(60)])
        child.append((i % 700, d, r.choice([None, "", "s1", *[f"S{j}" for j in range(50)]]), at(r.choice([None, *range(150)])), "x", 1, 2))
    return child, parents


def expected(child, parents, which):
    out = []
    for row in child:
        ref, t = (row[1], row[3]) if which == "dep" else (row[2], row[3])
        if ref is None or ref == "":
            continue
        j = 0 if which == "dep" else 1
        ok = any(p[j] == ref and p[2] is not None and t is not None and p[2] <= t and (p[3] is None or p[3] > t) for p in parents)
        if not ok:
            out.append((which, row[0], t))
    return out


def refs(p):
    return [Reference("dep", "dep", p, "id", "loaded_at", "deleted_at"), Reference("st", "st", p, "code", "loaded_at", "deleted_at", blank_is_none=True)]


def test_orphans(spark, data):
    child, parents = data
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parents, PARENT)
    got = sorted(map(repr, map(tuple, orphans(c, "loaded_at", ["id"], refs(p)).collect())))
    assert got == sorted(map(repr, expected(child, parents, "dep") + expected(child, parents, "st")))


def test_keys_of_unlike_types_and_empty_tables(spark, data):
    child, parents = data
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parents, PARENT)
    texts = p.withColumn("id", F.col("id").cast("string"))
    got = orphans(c, "loaded_at", ["id"], refs(texts)[:1])
    assert got.count() == len(expected(child, parents, "dep"))
    none = orphans(c, "loaded_at", ["id"], refs(p.limit(0)))
    assert none.count() == sum(r[1] is not None for r in child) + sum(bool(r[2]) for r in child)
    assert orphans(c.limit(0), "loaded_at", ["id"], refs(p)).count() == 0


def test_month(spark):
    df = spark.createDataFrame([(at(40),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(month(F.col("t"))).collect()] == ["2024-02", None]


def test_bloom_filter(spark):
    df = spark.range(0, 20_000, 2).toDF("k")
    f = bloom_filter(df, "k")
    probe = spark.range(20_000).select("id", f.might_contain(F.col("id")).alias("p"))
    hits = {r["id"] for r in probe.where("p").collect()}
    assert hits >= set(range(0, 20_000, 2))
    wrong = len(hits) - 10_000
    assert wrong <= 0.03 * 10_000 and f.false_positive_rate < 0.02
    assert "might_contain" in probe._jdf.queryExecution().executedPlan().toString()
    assert spark.createDataFrame([(None,)], "k long").select(f.might_contain(F.col("k")).alias("p")).first()[0] is None


@pytest.mark.parametrize("max_bits", [10_000, 1 << 10])
def test_more_keys_than_one_filter_holds_are_spread_over_many(spark, max_bits):
    df = spark.range(0, 20_000, 2).toDF("k")
    f = bloom_filter(df, "k", max_bits=max_bits)
    assert f.ranges >= 100_000 // max_bits and f.bits <= max_bits and f.false_positive_rate < 0.02
    rows = spark.range(20_000).withColumn("id", F.when(F.col("id") != 77, F.col("id")))
    marked = f.mark(rows, "id", "p")
    got = {r["id"]: r["p"] for r in marked.collect()}
    assert marked.count() == 20_000 and got[None] is None
    assert all(got[i] for i in range(0, 20_000, 2))
    assert sum(bool(v) for v in got.values()) - 10_000 <= 400
    if f.ranges > 16:
        with pytest.raises(ValueError):
            f.might_contain(F.col("id"))


def test_no_keys_let_nothing_through(spark):
    f = bloom_filter(spark.range(0).toDF("k"), "k")
    assert f.false_positive_rate == 0 and f.mark(spark.range(5), "id", "p").where("p").count() == 0


@pytest.mark.parametrize("kind", ["double", "int", "decimal(20,3)", "float"])
def test_numbers_of_unlike_types_are_compared_as_numbers(spark, kind):
    p = spark.createDataFrame([(i, None, at(0), None) for i in range(5)], PARENT)
    c = spark.range(8).select(F.col("id"), F.col("id").cast(kind).alias("dep"), F.lit(None).cast("string").alias("st"), F.lit(at(3)).cast("timestamp_ntz").alias("loaded_at"))
    assert sorted(r["id"] for r in orphans(c, "loaded_at", ["id"], refs(p)[:1]).collect()) == [5, 6, 7]


def test_definite_orphans_are_kept_in_the_one_scan_of_the_child(spark, data):
    child, parents = data
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parents, PARENT)
    plan = orphans(c, "loaded_at", ["id"], refs(p)[:1])._jdf.queryExecution().executedPlan().toString()
    assert "might_contain" in plan and "Union" not in plan
