"""Every query of the package, against DuckDB where SQL can say it."""

import pytest

from tests.helpers import same_as_oracle
from tidemark.llm import queries
from tidemark.llm.quantiles import RELATIVE_ERROR

QUERIES, ORACLE = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, sf, duck, name):
    same_as_oracle(QUERIES[name](spark, sf), duck, ORACLE[name])


def test_percentile_errors_are_within_what_is_stated(spark, sf):
    rows = queries.p6_error(spark, sf).collect()
    assert {(r["field_name"], r["percentile"]) for r in rows} == {(f, q) for f in ("department_id", "job_title") for q in queries.QUANTILES}
    assert all(r["rank_error"] <= 1 or r["relative_error"] <= RELATIVE_ERROR for r in rows)
    assert queries.p6_monthly(spark, sf).where("n < 1 or p50 is null").count() == 0


def test_packs(spark, sf):
    for r in queries.p8_fill(spark, sf).collect():
        assert r["fullest"] <= r["capacity"] and 0 < r["fill"] <= 1
    packed = queries.p8_packs(spark, sf)
    assert packed.groupBy("pack_name", "doc_id", "piece_no").count().where("count > 1").count() == 0


def test_shares(spark, sf):
    rows = queries.p9_shares(spark, sf).collect()
    assert len(rows) == 10 and all(r["most_copies"] <= r["max_repeats"] for r in rows)


def test_queries_are_registered():
    import __spark_entry__

    assert QUERIES.keys() <= __spark_entry__.queries().keys()
