"""Full joins of analyzed plans, given to the operator that spreads them where a key has many pairs."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.skew import full_join
from tidemark.plans.checks import _children
from tidemark.scratch import column_of

#: Nodes whose rows may differ each time they are computed, or that have no meaning outside the whole plan.
_ONLY_ONCE = {"GlobalLimit", "LocalLimit", "Offset", "Tail", "Sample", "CTERelationRef", "UnionLoopRef"}


def spread_full_joins(df: DataFrame) -> DataFrame:
    """``df`` with those full joins replaced of which a key has too many pairs to be held (see :func:`full_join`).

    Joins on no equality, of streams, or of sides that may not give the same rows twice stay as they are.
    """
    plan = df._jdf.queryExecution().analyzed()
    changed = _spread(df.sparkSession, plan)
    return df if changed is plan else _frame(df.sparkSession, changed)


def _frame(spark: SparkSession, plan: JavaObject) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _items(seq: JavaObject) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _repeatable(plan: JavaObject) -> bool:
    return plan.getClass().getSimpleName() not in _ONLY_ONCE and all(_repeatable(c) for c in _children(plan))


def _spread(spark: SparkSession, plan: JavaObject) -> JavaObject:
    before = list(_children(plan))
    after = [_spread(spark, c) for c in before]
    if any(a is not b for a, b in zip(after, before)):
        plan = plan.withNewChildren(spark._jvm.PythonUtils.toSeq(after))
    if plan.getClass().getSimpleName() != "Join" or plan.joinType().sql() != "FULL OUTER":
        return plan
    found = spark._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(plan)
    if found.isEmpty() or plan.isStreaming() or not plan.deterministic() or not _repeatable(plan):
        return plan
    parts = found.get()
    keys = [(column_of(spark, a), column_of(spark, b)) for a, b in zip(_items(parts._2()), _items(parts._3()))]
    on = column_of(spark, plan.condition().get())
    joined = full_join(_frame(spark, plan.left()), _frame(spark, plan.right()), on, keys, residual=parts._4().isDefined())
    return plan if joined is None else joined._jdf.queryExecution().analyzed()
