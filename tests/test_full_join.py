"""Full joins whose keys have many pairs: rows are handed on one by one, not a key at a time."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import nodes, same_as_oracle
from tidemark.operators.skew import full_join
from tidemark.plans.engine import Engine
from tidemark.queries import reference


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """900 customers and 500 suppliers, most of them of two nations; nations and balances of one side only, and null ones."""
    d = f"file://{tmp_path_factory.mktemp('crowded')}"
    i = F.col("id")
    nation = F.when(i % 10 < 5, 1).when(i % 10 < 8, 2)
    c = spark.range(900).select(i.alias("c_custkey"), nation.when(i % 10 == 8, 3).cast("int").alias("c_nationkey"), F.when(i % 7 > 0, (i % 90).cast("double")).alias("c_acctbal"))
    s = spark.range(500).select(i.alias("s_suppkey"), nation.when(i % 10 == 8, 4).cast("int").alias("s_nationkey"), F.when(i % 9 > 0, (i % 100).cast("double")).alias("s_acctbal"))
    c.write.parquet(f"{d}/customer.parquet")
    s.write.parquet(f"{d}/supplier.parquet")
    return d


@pytest.fixture
def crowded_duck(crowded):
    import duckdb

    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.execute(f"create view {t} as select * from '{crowded.removeprefix('file://')}/{t}.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["j4_full", "j5_full_residual"])
def test_no_key_is_held(spark, crowded, crowded_duck, name):
    df = reference.queries()[name](spark, crowded)
    assert "FullOuter" not in nodes(df)
    same_as_oracle(df, crowded_duck, reference.SQL[name])


@pytest.mark.parametrize(
    "sql",
    [
        "select s.*, c.* from supplier s full join customer c on c.c_nationkey = s.s_nationkey",
        "select c_nationkey, s_nationkey, count(*) as n, count(c_custkey) as c, count(s_suppkey) as s from customer full join supplier on c_nationkey = s_nationkey group by c_nationkey, s_nationkey",
        "select t.a, t.b from (select c.c_custkey + 1 as a, s.s_suppkey as b from customer c full outer join supplier s on c.c_nationkey = s.s_nationkey and s.s_suppkey < 480) t where t.a is null or t.b is null or t.a > 700",
        "select a.c_custkey as x, b.c_custkey as y from customer a full join customer b on a.c_nationkey = b.c_nationkey and a.c_acctbal + 80 < b.c_acctbal",
        "select c.c_custkey, s.s_suppkey, r.s_suppkey as again from customer c full join supplier s on c.c_nationkey = s.s_nationkey full join supplier r on r.s_suppkey = c.c_custkey",
    ],
)
def test_full_joins_in_other_queries(spark, crowded, crowded_duck, sql):
    with Engine(spark) as e:
        for t in ("customer", "supplier"):
            e.register_parquet(t, f"{crowded}/{t}.parquet")
        df = e.sql(sql)
        assert nodes(df).count("FullOuter") == sql.count("s_suppkey = c.c_custkey")
        same_as_oracle(df, crowded_duck, sql)


@pytest.mark.parametrize("residual", [False, True])
@pytest.mark.parametrize("swapped", [False, True])
@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "task_pairs": 40}])
def test_full_join_equals_plain_join(spark, residual, swapped, options):
    r = random.Random(5)
    many = [(r.choice([None, "hot", "hot", "a", "b", "left"]), r.randrange(4), r.randrange(20)) for _ in range(300)]
    few = [(r.choice([None, "hot", "b", "c"]), r.randrange(4), r.randrange(20)) for _ in range(40)]
    left = spark.createDataFrame(few if swapped else many, "k string, j int, v int")
    right = spark.createDataFrame(many if swapped else few, "q string, p int, w int")
    on = (left.k == right.q) & (left.j == right.p)
    if residual:
        on = on & (left.v > right.w + 6)
    got = full_join(left, right, on, [(left.k, right.q), (left.j, right.p)], residual=residual, key_pairs=5, **options)
    want = left.join(right, on, "full")
    assert got.columns == want.columns and "FullOuter" not in nodes(got)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_few_pairs_are_left_to_spark(spark):
    left, right = spark.createDataFrame([(1,)] * 10, "a int"), spark.createDataFrame([(1,)] * 10 + [(2,)] * 500, "b int")
    assert full_join(left, right, left.a == right.b, [(left.a, right.b)], key_pairs=100) is None
    assert full_join(left, right, left.a == right.b, [(left.a, right.b)], key_pairs=99) is not None
    assert full_join(left.limit(0), right, left.a == right.b, [(left.a, right.b)], key_pairs=0) is None


def test_sides_that_may_change_are_read_once(spark, crowded):
    with Engine(spark) as e:
        for t in ("customer", "supplier"):
            e.register_parquet(t, f"{crowded}/{t}.parquet")
        df = e.sql("select t.c_custkey, s.s_suppkey from (select c_custkey, c_nationkey from customer limit 800) t full join supplier s on t.c_nationkey = s.s_nationkey")
        assert "FullOuter" in nodes(df)


def test_rows_without_a_match_hold_no_key(spark, tmp_path):
    """250,000 customers of one nation: the anti-join on the whole condition would hold them all."""
    import duckdb

    d, i = f"file://{tmp_path}", F.col("id")
    spark.range(250_000).select(i.alias("c_custkey"), F.when(i % 50 > 0, 1).cast("int").alias("c_nationkey"), (i % 1000).cast("double").alias("c_acctbal")).write.parquet(f"{d}/customer.parquet")
    spark.range(20).select(i.alias("s_suppkey"), F.when(i < 18, 1).otherwise(2).cast("int").alias("s_nationkey"), (990 + i % 12).cast("double").alias("s_acctbal")).write.parquet(f"{d}/supplier.parquet")
    df = reference.queries()["j5_full_residual"](spark, d)
    plan = nodes(df)
    assert "LeftSemi" in plan and not [x for x in plan.splitlines() if "LeftAnti" in x and ">" in x.partition("LeftAnti")[2]]
    duck = duckdb.connect()
    for t in ("customer", "supplier"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    same_as_oracle(df, duck, reference.SQL["j5_full_residual"])


@pytest.mark.parametrize("swapped", [False, True])
@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "task_pairs": 40}])
def test_cut_anti_join_equals_plain_join(spark, swapped, options):
    r = random.Random(6)
    many = [(r.choice([None, "hot", "hot", "a"]), r.choice([None, 0.0, 1.0, 2.0, float("nan")]), r.randrange(20)) for _ in range(300)]
    few = [(r.choice([None, "hot", "a", "b"]), r.choice([None, 0.0, -0.0, 1.0, 2.0, float("nan")]), r.randrange(20)) for _ in range(80)]
    left = spark.createDataFrame(few if swapped else many, "k string, j double, v int")
    right = spark.createDataFrame(many if swapped else few, "q string, p double, w int")
    sign = (left.j if swapped else right.p).cast("string") != "-0.0"
    on = (left.k == right.q) & (left.j > right.p - 1 if swapped else left.j - 1 < right.p) & sign
    got = full_join(left, right, on, [(left.k, right.q)], key_pairs=5, held_rows=7, **options)
    want = left.join(right, on, "full")
    assert nodes(got).count("LeftSemi") == 1 and "FullOuter" not in nodes(got)
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))


def test_columns_that_cannot_be_compared(spark):
    left = spark.createDataFrame([("hot", i, {"x": i % 5}) for i in range(40)], "k string, v int, m map<string,int>")
    right = spark.createDataFrame([("hot", i, {"x": i}) for i in range(8)], "q string, w int, n map<string,int>")
    for on, cut in ((left.v < right.w, 1), (left.m["x"] == right.n["x"] + right.w, 0), (left.m["x"] > right.w, 1)):
        on = (left.k == right.q) & on
        got = full_join(left, right, on, [(left.k, right.q)], key_pairs=5, held_rows=7)
        assert nodes(got).count("LeftSemi") == cut
        assert Counter(map(str, got.collect())) == Counter(map(str, left.join(right, on, "full").collect()))
