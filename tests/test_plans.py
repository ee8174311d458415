"""What plans must look like: pushdown, pruning, limits and join strategies."""

import re

import pytest

from tests.helpers import nodes
from tidemark.operators.skew import skew_join
from tidemark.plans.engine import Engine


@pytest.fixture(scope="module")
def engine(spark, sf):
    with Engine(spark) as e:
        for t in ("orders", "customer", "lineitem", "nation", "region"):
            e.register_parquet(t, f"{sf}/{t}.parquet")
        yield e


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_and_columns_reach_the_scan(engine):
    p = nodes(engine.sql("select x.k from (select o_orderkey as k, o_totalprice as v, o_custkey as c from orders) x where x.c = 5 and x.v > 10"))
    assert re.search(r"PushedFilters: \[IsNotNull\(o_custkey\), IsNotNull\(o_totalprice\), EqualTo\(o_custkey,5\), GreaterThan\(o_totalprice", p)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in p


def test_filter_on_each_side_of_an_inner_join(engine):
    p = optimized(engine.sql("select o_orderkey from orders join customer on o_custkey = c_custkey where o_totalprice > 10 and c_acctbal < 5"))
    join = p.index("Join Inner")
    assert p.index("o_totalprice", join) > join and re.search(r"Filter.*c_acctbal", p[join:]) and "Filter" not in p[:join]


def test_left_join_pushes_only_to_the_left(engine):
    p = optimized(engine.sql("select c_custkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 10 where c_acctbal < 5"))
    assert "Join LeftOuter" in p and p.index("Filter") > p.index("Join LeftOuter")


def test_filter_on_the_right_makes_a_left_join_inner(engine):
    assert "Join Inner" in optimized(engine.sql("select c_custkey from customer left join orders on o_custkey = c_custkey where o_totalprice > 10"))


def test_full_join_keeps_residual_in_the_condition(engine):
    p = optimized(engine.sql("select c_custkey from customer full join orders on o_custkey = c_custkey and o_totalprice > 10"))
    assert re.search(r"Join FullOuter, .*o_totalprice", p)


def test_limit_goes_below_projection_and_to_the_outer_side(engine):
    p = optimized(engine.sql("select c_custkey + 1 as x from customer left join orders on c_custkey = o_custkey limit 2 offset 1"))
    assert p.index("LocalLimit 3", p.index("Join LeftOuter")) > 0


def test_limit_stays_above_an_order(engine):
    p = nodes(engine.sql("select o_orderkey from orders order by o_totalprice desc limit 3"))
    assert "TakeOrderedAndProject" in p and "NULLS FIRST" in p and "rangepartitioning" not in p


def test_projections_and_filters_combine(engine):
    p = optimized(engine.sql("select a + 1 as b from (select o_orderkey + 1 as a, o_custkey from orders where o_custkey > 1) t where t.o_custkey < 9"))
    assert p.count("Project") == 1 and p.count("Filter") == 1


def test_constants_are_folded(engine):
    assert "= 3)" in optimized(engine.sql("select o_orderkey from orders where o_custkey = 1 + 2"))


def test_scalar_subquery_runs_once_and_is_no_join(engine):
    p = optimized(engine.sql("select o_orderkey, (select max(c_acctbal) from customer) as m from orders"))
    assert "scalar-subquery" in p and "Join" not in p


def test_small_side_is_broadcast_and_large_sides_are_sorted(engine, spark):
    assert "BroadcastHashJoin" in nodes(engine.sql("select n_name from nation join region on n_regionkey = r_regionkey"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" in nodes(engine.sql("select o_orderkey from orders join customer on o_custkey = c_custkey"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_aggregation_is_partial_first(engine):
    p = nodes(engine.sql("select l_returnflag, sum(l_quantity) from lineitem group by l_returnflag"))
    assert "partial_sum" in p and p.index("partial_sum") > p.index("Exchange hashpartitioning")


def test_heavy_rows_are_not_shuffled(engine):
    left = engine.table("orders")
    right = engine.table("customer")
    p = nodes(skew_join(left, right, "o_custkey", "c_custkey", "left", heavy=[1, 2], heavy_side_rows=2, merge=True))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" in p and p.count("Exchange hashpartitioning") == 2


def test_explain(engine):
    assert [r["type"] for r in engine.sql("explain select n_name from nation").collect()] == ["logical_plan", "logical_plan_opt", "physical_plan"]
    text = engine.explain("select n_name from nation where n_nationkey = 1")
    assert text.startswith("original plan:") and "optimized plan:" in text


def test_shell(spark, sf):
    import io

    from tidemark.__main__ import interactive

    out = io.StringIO()
    with Engine(spark) as e:
        lines = [f"\\load parquet nation {sf}/nation.parquet\n", "\\dt\n", "select count(n_name) as n\n", "from nation;\n", "select nope;\n", "\\explain select 1\n", "\\q\n", "select 9;\n"]
        interactive(e, lines, out)
    text = out.getvalue()
    assert "loaded nation" in text and "| 25 |" in text and "error:" in text and "optimized plan" in text and "| 9 |" not in text


def test_tables_shown_say_when_there_are_more_rows(spark):
    from tidemark.plans.render import table_text

    assert "there are more" in table_text(spark.range(5), 4) and "there are more" not in table_text(spark.range(4), 4)


def test_typed_lines_are_remembered(monkeypatch, tmp_path):
    from tidemark.__main__ import typed

    lines = iter(["select 1", ";"])

    def typing(prompt):
        try:
            return next(lines)
        except StopIteration:
            raise EOFError from None

    monkeypatch.setattr("builtins.input", typing)
    assert list(typed(tmp_path / "history")) == ["select 1\n", ";\n"]
    assert (tmp_path / "history").exists()
