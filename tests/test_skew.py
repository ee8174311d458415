import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.skew import heavy_hitters, heavy_keys, per_key_results, skew_join


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else None if i % 50 == 1 else "" if i % 50 == 2 else f"k{r.randrange(300)}"
        out.append((k, r.randrange(40) if i % 7 else None, i, f"x{i % 5}"))
    return out


SCHEMA = "k string, v long, n long, salt string"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("heavy", [["hot"], ["hot", "k1", "", "absent"], [], None])
def test_skew_join_equals_plain_join(spark, rows, how, broadcast_rows, heavy):
    left = spark.createDataFrame(rows, SCHEMA)
    right = spark.createDataFrame([("hot", 1), ("hot", 30), ("", 5), (None, 6), *[(f"k{i}", i) for i in range(0, 300, 2)]], "rk string, rv long")
    residual = F.col("rv") > F.col("v")
    got = skew_join(left, right, "k", "rk", how, heavy=heavy, residual=residual, broadcast_rows=broadcast_rows)
    want = left.join(right, (F.col("k") == F.col("rk")) & residual, how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_skew_join_rejects_other_kinds(spark, rows):
    left = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        skew_join(left, left.select(F.col("k").alias("q")), "k", "q", "full")


@pytest.mark.parametrize("heavy", [None, [], ["hot", "k3"]])
def test_per_key_results(spark, rows, heavy):
    df = spark.createDataFrame(rows, SCHEMA)
    dim = spark.createDataFrame([("hot", "H"), ("k3", None), ("k4", "four")], "id string, label string")
    got = per_key_results(
        df, "k", sums={"total": F.col("v")}, distinct={"values": F.col("v"), "salts": F.col("salt")}, dim=dim, dim_key="id", dim_columns=["label"], heavy=heavy
    )
    want = defaultdict(lambda: [0, None, set(), set()])
    for k, v, _, s in rows:
        if k is not None:
            w = want[k]
            w[0] += 1
            w[3].add(s)
            if v is not None:
                w[1] = (w[1] or 0) + v
                w[2].add(v)
    labels = {"hot": "H", "k4": "four"}
    expected = {(k, n, t, len(v), len(s), labels.get(k)) for k, (n, t, v, s) in want.items()}
    assert got.columns == ["k", "row_count", "total", "values", "salts", "label"]
    assert {tuple(r) for r in got.collect()} == expected
    assert got.count() == len(expected)


def test_heavy_keys_on_a_sample(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert heavy_keys(df, F.col("k"), share=0.01, sample_rows=20_000) == ["hot"]
    assert heavy_keys(df.limit(0), F.col("k")) == []


def test_heavy_hitters_count_null_rows_in_the_total(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 2 + [(None,)] * 8, "k string")
    assert {tuple(r) for r in heavy_hitters(df, "k", 0.5).collect()} == {("a", 10)}
    assert heavy_hitters(df.limit(0), "k", 0.5).count() == 0
