import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import topn
from tidemark.llm.topn import top_n

SCHEMA = "dep long, id long, pay long, g string, c1 int, need int, n int"


def make(n, seed, spread):
    r = random.Random(seed)
    out = []
    for i in range(n):
        dep = 1 if i % 3 == 0 else r.choice([None, 2, 3, *range(10, 60)])
        ident = r.choice([None, r.randrange(-n, n), r.randrange(-(2**62), 2**62), i])
        out.append((dep, ident, r.choice([None, 0, *spread]), "x", 1, 2, 3))
    out += out[: n // 10]
    return out


def truth(rows, n):
    best = {}
    for d, i, p, *_ in rows:
        if None not in (d, i, p):
            best[d, i] = max(p, best.get((d, i), p))
    groups = {}
    for (d, i), p in best.items():
        groups.setdefault(d, []).append((-p, i))
    return {(d, i, -p) for d, g in groups.items() for p, i in sorted(g)[:n]}


SPREADS = {
    "wide": [*range(-1000, 1000)],
    "ties": [5, 6],
    "one": [0],
    "extremes": [-(2**63), 2**63 - 1, -1, 1, 2**62],
}


@pytest.mark.parametrize("spread", SPREADS)
@pytest.mark.parametrize("n", [1, 60])
def test_against_sorting(spark, spread, n):
    rows = make(1200, 3, SPREADS[spread])
    got = top_n(spark.createDataFrame(rows, SCHEMA), "dep", "pay", "id", n)
    assert got.columns == ["dep", "id", "pay"]
    assert sorted(map(tuple, got.collect())) == sorted(truth(rows, n))


@pytest.mark.parametrize("spread, least", [("wide", 1), ("ties", 1), ("extremes", 1), ("ties", 10_000)])
def test_many_groups_take_the_way_without_broadcast(spark, monkeypatch, spread, least):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(topn, "MIN_HEAVY_ROWS", least)
    rows = make(900, 4, SPREADS[spread])
    got = top_n(spark.createDataFrame(rows, SCHEMA), "dep", "pay", "id", 3).collect()
    assert len(got) == len(truth(rows, 3)) and {tuple(r) for r in got} == truth(rows, 3)


@pytest.mark.parametrize("heavy", [[], [1]])
def test_with_many_groups_no_round_shuffles_items(spark, monkeypatch, heavy):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    raw = spark.createDataFrame([(i % 40, i, i, i) for i in range(400)], "g long, c1 long, i long, s long")
    items = topn._Items(raw, 40, heavy)
    state = topn.materialize(items.bounds([F.min("c1").alias("lo1")]).withColumnRenamed("g", "sg"), "state")
    met = items.meet(items.rows, state)
    assert met.count() == 400 and met.columns[-2:] == ["n", "lo1"]
    plan = met._jdf.queryExecution().executedPlan().toString()
    # the one shuffle is of the state, one row a group
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(sh") == 1 == plan.count("Exchange hashpartitioning")


def test_empty_and_zero(spark):
    df = spark.createDataFrame(make(50, 5, [1]), SCHEMA)
    assert top_n(df.limit(0), "dep", "pay", "id", 5).count() == 0
    assert top_n(df, "dep", "pay", "id", 0).count() == 0


CODES = [
    ("double", [float("-inf"), -1.5, -0.0, 1e-300, 2.0, float("inf")]),
    ("date", [dt.date(1900, 1, 1), dt.date(1970, 1, 1), dt.date(2020, 2, 29)]),
    ("timestamp_ntz", [dt.datetime(1900, 1, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 2)]),
    ("decimal(10,2)", [decimal.Decimal("-1.10"), decimal.Decimal("0.01"), decimal.Decimal("7.00")]),
    ("int", [-5, 0, 7]),
]


@pytest.mark.parametrize("kind, values", CODES, ids=[c[0] for c in CODES])
def test_codes_keep_the_order(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").coalesce(1)
    codes = [r[0] for r in df.select(topn.order_code(F.col("v"), df.schema["v"].dataType)).collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)


def test_zeros_are_equal_and_strings_refused(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "v double")
    assert len({r[0] for r in df.select(topn.order_code(F.col("v"), T.DoubleType())).collect()}) == 1
    with pytest.raises(TypeError):
        topn.order_code(F.col("v"), T.StringType())
