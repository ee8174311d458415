"""Queries pN_ for the general problems (2, 3, 4, 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changes import apply_changes
from tidemark.operators.orphans import Reference, month, orphans
from tidemark.operators.skew import heavy_hitters, per_key_results
from tidemark.operators.upsert import UpsertStore, deduplicate, slices
from tidemark.scratch import scratch_path


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that came more than once, from the compacted stores."""
    req = spark.read.parquet(f"{d}/update_kv_request.parquet")
    res = spark.read.parquet(f"{d}/update_kv_response.parquet")
    with ThreadPoolExecutor(2) as pool:  # the two stores have nothing to do with each other
        a = pool.submit(deduplicate, req, ["tenant", "seq"], ["arrived_at", "delivery_id"], batch_by="batch_id")
        b = pool.submit(deduplicate, res, ["tenant", "seq"], ["answered_at", "response_id"], batch_by="answered_at")
        once_req, once_res = a.result(), b.result()
    parts = [(once_req, "update_kv_request"), (once_res, "update_kv_response")]
    a, b = [x.where(F.col("copies") >= 2).select(F.lit(n).alias("source_table"), "tenant", "seq") for x, n in parts]
    return a.unionByName(b)


def p2_requests_once(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one whole request per (tenant, seq): the first that arrived."""
    req = spark.read.parquet(f"{d}/update_kv_request.parquet")
    once = deduplicate(
        req, ["tenant", "seq"], ["arrived_at", "delivery_id"], ["value_type", "key", "value"], batch_by="batch_id"
    )
    return once.select("tenant", "seq", "delivery_id", "value_type", "key", "value", "copies")


def p2_reopened(spark: SparkSession, d: str) -> DataFrame:
    """p2_requests_once through a store that is closed, merged, opened again, and gets a batch twice."""
    req = spark.read.parquet(f"{d}/update_kv_request.parquet")
    shape = [["tenant", "seq"], ["arrived_at", "delivery_id"], ["value_type", "key", "value"]]
    batches, path = slices(req, "batch_id", 4), scratch_path(spark, "reopened")
    store = UpsertStore(spark, req, *shape, path=path)
    for run, batch in enumerate(batches[:2]):
        store.upsert(batch, run)
    store.compact()
    store.close()
    store = UpsertStore(spark, req, *shape, path=path)
    for run, batch in enumerate(batches):  # the first two come again
        store.upsert(batch, run)
    return store.merged().select("tenant", "seq", "delivery_id", "value_type", "key", "value", "copies")


def p2_responses_once(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one answer per (tenant, seq): the last that came, whatever the others said."""
    res = spark.read.parquet(f"{d}/update_kv_response.parquet")
    once = deduplicate(
        res, ["tenant", "seq"], ["answered_at", "response_id"], ["value_type", "ack"], batch_by="answered_at", keep="last"
    )
    return once.select("tenant", "seq", "response_id", "value_type", "ack", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys present at the end, with the seq of their last change."""
    feed = spark.read.parquet(f"{d}/update_kv_request.parquet")
    return apply_changes(feed, ["tenant", "key"], "seq", "value_type")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole table at the end: tenant, key, seq, value."""
    feed = spark.read.parquet(f"{d}/update_kv_request.parquet")
    return apply_changes(feed, ["tenant", "key"], "seq", "value_type", ["value"])


def _employee_orphans(spark: SparkSession, d: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("employee", "department", "state")}
    refs = [
        Reference("department", "department_id", t["department"], "id", "loaded_at", "deleted_at"),
        Reference("state", "state", t["state"], "state_code", "loaded_at", "deleted_at", blank_is_none=True),
    ]
    rows = orphans(t["employee"], "loaded_at", ["id"], refs)
    return rows.select("ref_table", month(F.col("loaded_at")).alias("period"), "id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Employees with an orphan reference, per referenced table and month."""
    return _employee_orphans(spark, d)


def p4_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of employees with an orphan reference per table and month."""
    return _employee_orphans(spark, d).groupBy("ref_table", "period").agg(F.count("*").alias("employees"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 1 % of all rows."""
    req = spark.read.parquet(f"{d}/update_kv_request.parquet")
    emp = spark.read.parquet(f"{d}/employee.parquet")
    a = heavy_hitters(req, "tenant", 0.01).select(F.lit("tenant").alias("field_name"), F.col("tenant").alias("field_key"))
    b = heavy_hitters(emp, "department_id", 0.01).select(
        F.lit("department_id").alias("field_name"), F.col("department_id").cast("string").alias("field_key")
    )
    return a.unionByName(b)


def p7_tenant_results(spark: SparkSession, d: str) -> DataFrame:
    """Per tenant: deliveries, distinct keys and messages, deletions, bytes of values."""
    req = spark.read.parquet(f"{d}/update_kv_request.parquet")
    return per_key_results(
        req,
        "tenant",
        sums={
            "deletions": F.when(F.col("value_type") == 1, 1).otherwise(0),
            "value_bytes": F.coalesce(F.octet_length("value"), F.lit(0)),
        },
        distinct={"keys": F.col("key"), "messages": F.col("seq")},
    )


def p7_department_results(spark: SparkSession, d: str) -> DataFrame:
    """Per department: rows, employees, pay, and the department's latest name."""
    emp = spark.read.parquet(f"{d}/employee.parquet")
    dep = spark.read.parquet(f"{d}/department.parquet")
    latest = (
        dep.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("loaded_at", "department_name")).alias("x"))
        .select("id", F.col("x.department_name").alias("department_name"))
    )
    return per_key_results(
        emp,
        "department_id",
        sums={"salaries": F.col("salary")},
        distinct={"employees": F.col("id"), "job_titles": F.col("job_title")},
        dim=latest,
        dim_key="id",
        dim_columns=["department_name"],
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_requests_once": p2_requests_once,
        "p2_reopened": p2_reopened,
        "p2_responses_once": p2_responses_once,
        "p3_found": p3_found,
        "p3_state": p3_state,
        "p4_found": p4_found,
        "p4_orphan_counts": p4_orphan_counts,
        "p7_found": p7_found,
        "p7_tenant_results": p7_tenant_results,
        "p7_department_results": p7_department_results,
    }


_ONCE = """
          select tenant, seq, delivery_id, value_type, key, value, copies from (
            select *, count(*) over (partition by tenant, seq) as copies,
              row_number() over (partition by tenant, seq order by arrived_at nulls first, delivery_id nulls first) as rn
            from update_kv_request) where rn = 1"""

_LAST = """
  select tenant, key, value_type, seq, value,
         row_number() over (partition by tenant, key order by seq desc, value_type, value nulls first) as rn
  from (select distinct tenant, key, value_type, seq, value from update_kv_request where value_type in (0, 1))
"""

_ORPHANS = """
  select distinct 'department' as ref_table, strftime(e.loaded_at, '%Y-%m') as period, e.id
  from employee e
  where e.department_id is not null and not exists (
    select 1 from department p where p.id = e.department_id and p.loaded_at <= e.loaded_at
      and (p.deleted_at is null or p.deleted_at > e.loaded_at))
  union all
  select distinct 'state', strftime(e.loaded_at, '%Y-%m'), e.id
  from employee e
  where e.state is not null and e.state <> '' and not exists (
    select 1 from state p where p.state_code = e.state and p.loaded_at <= e.loaded_at
      and (p.deleted_at is null or p.deleted_at > e.loaded_at))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
          select 'update_kv_request' as source_table, tenant, seq from update_kv_request
          group by tenant, seq having count(*) >= 2
          union all
          select 'update_kv_response', tenant, seq from update_kv_response
          group by tenant, seq having count(*) >= 2""",
        "p2_requests_once": _ONCE,
        "p2_reopened": _ONCE,
        "p2_responses_once": """
          select tenant, seq, response_id, value_type, ack, copies from (
            select *, count(*) over (partition by tenant, seq) as copies,
              row_number() over (partition by tenant, seq order by answered_at desc nulls last, response_id desc nulls last) as rn
            from update_kv_response) where rn = 1""",
        "p3_found": f"select tenant, key, seq from ({_LAST}) where rn = 1 and value_type = 0",
        "p3_state": f"select tenant, key, seq, value from ({_LAST}) where rn = 1 and value_type = 0",
        "p4_found": _ORPHANS,
        "p4_orphan_counts": f"""
          select ref_table, period, count(*) as employees from ({_ORPHANS}) group by ref_table, period""",
        "p7_found": """
          select 'tenant' as field_name, tenant as field_key from update_kv_request
          where tenant is not null group by tenant
          having count(*) >= 0.01 * (select count(*) from update_kv_request)
          union all
          select 'department_id', cast(department_id as varchar) from employee
          where department_id is not null group by department_id
          having count(*) >= 0.01 * (select count(*) from employee)""",
        "p7_tenant_results": """
          select tenant, count(*) as row_count,
            cast(sum(case when value_type = 1 then 1 else 0 end) as bigint) as deletions,
            cast(sum(coalesce(strlen(value), 0)) as bigint) as value_bytes,
            count(distinct key) as keys, count(distinct seq) as messages
          from update_kv_request where tenant is not null group by tenant""",
        "p7_department_results": """
          select e.department_id, count(*) as row_count, cast(sum(e.salary) as bigint) as salaries,
            count(distinct e.id) as employees, count(distinct e.job_title) as job_titles,
            any_value(d.department_name) as department_name
          from employee e left join (
            select id, department_name from (
              select *, row_number() over (partition by id order by loaded_at desc, department_name desc nulls last) as rn
              from department) where rn = 1) d on d.id = e.department_id
          where e.department_id is not null group by e.department_id""",
    }
