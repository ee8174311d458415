import pytest
from pyspark.sql import types as T

from tidemark.functions import types
from tidemark.plans.lexer import render, statements, tokenize


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Integer", "Bigint", "Bigint"), ("Tinyint", "UTinyint", "Smallint"), ("Integer", "UInteger", "Bigint"), ("Bigint", "UTinyint", "Double"),
        ("Smallint", "UBigint", "Double"), ("UTinyint", "UInteger", "UInteger"), ("Float", "Integer", "Double"), ("Float", "Smallint", "Float"),
        ("SqlNull", "Varchar", "Varchar"), ("Date", "SqlNull", "Date"), ("Varchar", "Integer", None), ("Boolean", "Integer", None), ("Varchar", "Date", "Date"),
    ],
)
def test_common_type(a, b, want):
    assert types.common_type(a, b) == want == types.common_type(b, a)


def test_overloads():
    adds = {"add_int": ["Integer", "Integer"], "add_big": ["Bigint", "Bigint"], "add_double": ["Double", "Double"]}
    assert types.choose_overload(["Bigint", "Bigint"], adds) == "add_big"
    assert types.choose_overload(["Double", "Integer"], adds) == "add_double"
    with pytest.raises(TypeError, match="ambiguous"):
        types.choose_overload(["SqlNull", "SqlNull"], adds)
    with pytest.raises(TypeError, match="no function"):
        types.choose_overload(["Varchar", "Integer"], adds)
    with pytest.raises(TypeError):
        types.choose_overload(["Integer"], adds)


def test_type_names():
    assert types.logical(["varchar"]) == "Varchar" and types.logical(["INT", "UNSIGNED"]) == "UInteger" and types.logical(["char", "10"]) == "Varchar"
    for bad in (["BLOB"], ["DATE", "UNSIGNED"]):
        with pytest.raises(ValueError):
            types.logical(bad)
    assert types.from_spark(T.ShortType()) == "Smallint" and types.from_spark(T.BinaryType()) == "binary"


def test_lexer_leaves_literals_and_comments_alone():
    sql = "select 'a;b -- no' as \"x;y\", 1.5e3 /* ; */ from t; -- end ;\nselect 2"
    assert [render(s) for s in statements(sql)] == ["select 'a;b -- no' as `x;y` , 1.5e3 from t", "select 2"]
    assert [t.text for t in tokenize("a<=b!=c=>d")] == ["a", "<=", "b", "!=", "c", "=>", "d"]
