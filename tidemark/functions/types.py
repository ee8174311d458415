"""SQL type names, unsigned ranges, implicit casts and static type checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SQL type names and the logical types they stand for.
SQL_NAMES = {
    "BOOLEAN": "Boolean", "BOOL": "Boolean", "TINYINT": "Tinyint", "SMALLINT": "Smallint", "INT": "Integer", "INTEGER": "Integer",
    "BIGINT": "Bigint", "FLOAT": "Float", "REAL": "Float", "DOUBLE": "Double", "CHAR": "Varchar", "VARCHAR": "Varchar",
    "NVARCHAR": "Varchar", "TEXT": "Varchar", "STRING": "Varchar", "DATE": "Date", "INTERVAL": "Interval",
}

#: Logical types and the Spark types that store them.
SPARK = {
    "Boolean": "boolean", "Tinyint": "tinyint", "Smallint": "smallint", "Integer": "int", "Bigint": "bigint",
    "UTinyint": "smallint", "USmallint": "int", "UInteger": "bigint", "UBigint": "decimal(20,0)", "Float": "float",
    "Double": "double", "Varchar": "string", "Date": "date", "Interval": "interval day to second", "SqlNull": "void",
}

#: Highest value of the unsigned types.
UNSIGNED_MAX = {"UTinyint": 2**8 - 1, "USmallint": 2**16 - 1, "UInteger": 2**32 - 1, "UBigint": 2**64 - 1}

_SIGNED = ["Tinyint", "Smallint", "Integer", "Bigint"]
_UNSIGNED = ["UTinyint", "USmallint", "UInteger", "UBigint"]
NUMERIC = {*_SIGNED, *_UNSIGNED, "Float", "Double"}


def logical(words: list[str]) -> str:
    """Logical type of a type name such as ``["SMALLINT", "UNSIGNED"]``; a length is ignored."""
    head = words[0].upper()
    if head not in SQL_NAMES:
        raise ValueError(f"unsupported type {' '.join(words)}")
    name = SQL_NAMES[head]
    if any(w.upper() == "UNSIGNED" for w in words[1:]):
        if name not in _SIGNED:
            raise ValueError(f"{name} cannot be unsigned")
        return "U" + name if name != "Tinyint" else "UTinyint"
    return name


def from_spark(kind: T.DataType) -> str:
    """Logical type that a Spark type shows as; types without one keep Spark's name."""
    names = {
        T.BooleanType: "Boolean", T.ByteType: "Tinyint", T.ShortType: "Smallint", T.IntegerType: "Integer", T.LongType: "Bigint",
        T.FloatType: "Float", T.DoubleType: "Double", T.StringType: "Varchar", T.DateType: "Date", T.NullType: "SqlNull",
        T.DayTimeIntervalType: "Interval", T.YearMonthIntervalType: "Interval",
    }
    for k, n in names.items():
        if isinstance(kind, k):
            return n
    return kind.simpleString()


def spark_type(name: str) -> str:
    return SPARK.get(name, name)


def store(value: Column, name: str) -> Column:
    """Cast for storing into a column of logical type ``name``; what does not fit is an error."""
    if name in UNSIGNED_MAX:
        wide = value.cast("decimal(38,0)")
        fits = wide.isNull() | wide.between(F.lit(0), F.lit(str(UNSIGNED_MAX[name])).cast("decimal(38,0)"))
        error = F.raise_error(F.concat(F.lit(f"value out of range for {name}: "), wide.cast("string")))
        return F.when(fits, wide).otherwise(error.cast("decimal(38,0)")).cast(SPARK[name])
    return value.cast(spark_type(name))


def common_type(a: str, b: str) -> str | None:
    """Type to which two logical types are brought for an operation, or None if there is none.

    Two signed or two unsigned integers meet at the wider one; a signed and an
    unsigned one at a signed type that holds both, else at Double.  Null meets
    anything at the other's type.  Varchar meets only Varchar (and Date, which a
    string can be read as).
    """
    if a == b or b == "SqlNull":
        return a
    if a == "SqlNull":
        return b
    pair = {a, b}
    if pair == {"Varchar", "Date"}:
        return "Date"
    if not pair <= NUMERIC:
        return None
    if "Double" in pair:
        return "Double"
    if "Float" in pair:
        other = (pair - {"Float"}).pop()
        return "Float" if other in ("Tinyint", "UTinyint", "Smallint", "USmallint") else "Double"
    if pair <= set(_SIGNED):
        return max(pair, key=_SIGNED.index)
    if pair <= set(_UNSIGNED):
        return max(pair, key=_UNSIGNED.index)
    s, u = next(x for x in pair if x in _SIGNED), next(x for x in pair if x in _UNSIGNED)
    rank = max(_SIGNED.index(s), _UNSIGNED.index(u) + 1)
    return "Double" if s == "Bigint" or rank > 3 else _SIGNED[rank]


def cast_cost(a: str, b: str) -> int:
    """0 for the same type, 1 for an implicit cast, -1 for none."""
    if a == b:
        return 0
    return 1 if common_type(a, b) == b else -1


def choose_overload(arguments: list[str], overloads: dict[str, list[str]]) -> str:
    """Name of the overload with the lowest sum of cast costs; ties and misses are errors."""
    costs = {}
    for name, wanted in overloads.items():
        each = [cast_cost(a, w) for a, w in zip(arguments, wanted)]
        if len(wanted) == len(arguments) and -1 not in each:
            costs[name] = sum(each)
    if not costs:
        raise TypeError(f"no function takes ({', '.join(arguments)})")
    best = [n for n, c in costs.items() if c == min(costs.values())]
    if len(best) > 1:
        raise TypeError(f"ambiguous call with ({', '.join(arguments)}): {', '.join(best)}")
    return best[0]
