"""Types, overloads, aggregates and key-value tables of the SQL surface."""

import pytest

from tidemark.operators.kv import KV
from tidemark.plans.engine import Engine


@pytest.fixture
def engine(spark):
    with Engine(spark) as e:
        rows = [(7, 2, 9, 4, 5.0, "x"), (-7, 2, -9, 4, 6.0, "y"), (None, 2, None, None, None, None)]
        e.register_rows("t", rows, "i int, s smallint, b bigint, y tinyint, d double, v string")
        yield e


@pytest.mark.parametrize(
    "expression, kind, first",
    [
        ("i / 2", "int", 3), ("i / s", "int", 3), ("s / s", "smallint", 1), ("y / s", "smallint", 2), ("b / i", "bigint", 1), ("i / s / 2", "int", 1),
        ("d / i", "double", 5 / 7), ("(i + s) / 2 + i / 2", "int", 7), ("case when i / 2 > 1 then i / 2 else 0 end", "int", 3), ("b / 2 * (i / 2)", "bigint", 12),
    ],
)
def test_division_has_the_type_of_its_operands(engine, expression, kind, first):
    df = engine.sql(f"select {expression} as q from t where v = 'x'")
    assert df.schema["q"].dataType.simpleString() == kind
    assert df.first()[0] == first


def test_distinct_on_is_distinct(engine):
    assert sorted(r[0] for r in engine.sql("select distinct on (i, d) s from t").collect()) == [2]
    assert engine.sql("select count(*) as n from (select distinct on (s) s, y from t where y = 4) x").first()[0] == 1


@pytest.fixture
def described(engine):
    def named(text):
        return lambda *a: None if None in a else f"{text}({','.join(str(x) for x in a)})"

    engine.register_udf("f", named("int"), "string", arguments=["int", "int"])
    engine.register_udf("f", named("double"), "string", arguments=["double", "double"])
    engine.register_udf("f", named("text"), "string", arguments=["varchar"])
    engine.register_udf("f", named("one"), "string", arguments=["bigint"])
    return engine


@pytest.mark.parametrize(
    "call, want",
    [
        ("f(i, i)", "int(7,7)"), ("f(s, i)", "int(2,7)"), ("f(d, i)", "double(5.0,7.0)"), ("f(b, i)", "double(9.0,7.0)"), ("f(v)", "text(x)"), ("f(b)", "one(9)"),
        ("f(f(v))", "text(text(x))"), ("f(f(i, s)) || f(s)", "text(int(7,2))one(2)"), ("F(null, i)", None),
    ],
)
def test_calls_take_the_nearest_signature(described, call, want):
    assert described.sql(f"select {call} as r from t where v = 'x'").first()[0] == want


@pytest.mark.parametrize("call", ["f(v, i)", "f()", "f(i, i, i)", "f(null)"])
def test_calls_without_a_nearest_signature_are_errors(described, call):
    with pytest.raises(TypeError):
        described.sql(f"select {call} as r from t")


def test_an_aggregate_of_ones_own(engine):
    engine.register_udaf("spread", lambda x: float((x.max() - x.min()) if x.notna().any() else 0), "double")
    assert engine.sql("select spread(i) as r from t").first()[0] == 14.0
    assert [tuple(r) for r in engine.sql("select v, spread(d) as r from t group by v order by v").collect()] == [(None, 0.0), ("x", 0.0), ("y", 0.0)]


def test_a_key_value_store_is_a_table(engine, spark):
    db = KV(spark)
    db.write([("put", "a", "1"), ("put", "b", "2")])
    then = db.snapshot()
    db.write([("delete", "a"), ("put", "c", None)])
    engine.register_kv("kv", db)
    engine.register_kv("before", db, then)
    assert [tuple(r) for r in engine.sql("select key, value from kv order by key").collect()] == [("b", "2"), ("c", None)]
    assert engine.sql("select count(*) as n from before b join kv k on b.key = k.key").first()[0] == 1
    assert "kv" in [r["table_name"] for r in engine.sql("show tables").collect()]


def test_aliases_in_where_resolve_by_the_error_s_parameters(engine):
    assert engine.sql("select i + 1 as next from t where next > 5").first()[0] == 8
    with pytest.raises(Exception, match="nothing"):
        engine.sql("select nothing from t where i > 1")
