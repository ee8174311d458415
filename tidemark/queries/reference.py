"""Queries of the reference inventory and their SQL.

SQL queries run through the engine's own SQL surface, key-value queries through
the operators of :mod:`tidemark.operators.kv`.  Keys begin with the inventory's
handles; those of its section P have ``sel_`` before it, as ``pN_`` names the
queries of the problems.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import kv
from tidemark.operators.bloom import bloom_filter
from tidemark.operators.kv import KV
from tidemark.operators.upsert import slices
from tidemark.plans.engine import Engine
from tidemark.plans.render import rows_text
from tidemark.scratch import scratch_path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: Queries whose text both engines read: key -> SQL.
SQL = {
    # S1,P1
    "s1_scan_projection": "select o_orderkey, o_custkey, o_orderstatus from orders",
    # S10,F14
    "s10_select_constants": "select 1 as i, 'abc' as s, true as b, cast(2.5 as double) as d from region where r_regionkey=0",
    # S11
    "s11_values_list": "select col1 as id, col2 as name from values (1,'a'),(2,'b'),(3,null) t(col1,col2)",
    # P2
    "sel_p2_qualified_wildcard": "select n.*, r.r_name from nation n join region r on n.n_regionkey=r.r_regionkey",
    # P3
    "sel_p3_alias_in_where": "select r_regionkey+1 as a, r_name from region where a >= 2",
    # P3,A2
    "sel_p3_alias_in_group_order": "select count(o_orderkey) as c1, o_orderstatus as c2 from orders group by c2 order by c1 desc",
    # P4
    "sel_p4_table_alias": "select t.c_custkey, t.c_mktsegment from customer as t where t.c_acctbal > 0",
    # P5,P6,F12
    "sel_p5_filter_and": (
        "select o_orderkey from orders where o_totalprice > 250000 and o_orderstatus = 'O' and o_orderpriority = '1-URGENT'"
    ),
    # P5,F12
    "sel_p5_filter_or": "select o_orderkey from orders where o_custkey > 100 or o_orderstatus = 'F'",
    # J1,J7
    "j1_inner": "select o.o_orderkey, c.c_name from orders o inner join customer c on o.o_custkey=c.c_custkey",
    # J1
    "j1_inner_multikey": (
        "select a.l_orderkey, a.l_linenumber, b.l_quantity from lineitem a join lineitem b on "
        "a.l_orderkey=b.l_orderkey and a.l_linenumber=b.l_linenumber"
    ),
    # J2,J10
    "j2_left": "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey=o.o_custkey",
    # J3
    "j3_right": "select o.o_orderkey, c.c_custkey from orders o right join customer c on o.o_custkey=c.c_custkey",
    # J4
    "j4_full": "select c.c_custkey, s.s_suppkey from customer c full join supplier s on c.c_nationkey=s.s_nationkey",
    # J5
    "j5_left_residual": (
        "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey=o.o_custkey and "
        "o.o_totalprice > 100000"
    ),
    # J5
    "j5_right_residual": (
        "select o.o_orderkey, c.c_custkey from orders o right join customer c on o.o_custkey=c.c_custkey and "
        "o.o_totalprice > c.c_acctbal*50"
    ),
    # J5
    "j5_full_residual": (
        "select c.c_custkey, s.s_suppkey from customer c full join supplier s on c.c_nationkey=s.s_nationkey and "
        "c.c_acctbal > s.s_acctbal"
    ),
    # J5
    "j5_inner_residual": (
        "select c.c_custkey, s.s_suppkey from customer c join supplier s on c.c_nationkey=s.s_nationkey and "
        "c.c_acctbal > s.s_acctbal"
    ),
    # J6
    "j6_cross": "select r.r_name, n.n_name from region r cross join nation n where r.r_regionkey = 0",
    # J6
    "j6_comma": "select r.r_name, n.n_name from region r, nation n where n.n_nationkey < 3",
    # J8
    "j8_multiway_mixed": (
        "select c.c_custkey, n.n_name, r.r_name from customer c left join nation n on c.c_nationkey=n.n_nationkey "
        "right join region r on n.n_regionkey=r.r_regionkey"
    ),
    # J9
    "j9_theta": "select s.s_suppkey, n.n_nationkey from supplier s join nation n on s.s_nationkey < n.n_nationkey",
    # Q1
    "q1_derived_nested": (
        "select t2.k from (select t1.k, t1.v from (select o_orderkey as k, o_totalprice as v, o_orderstatus as s from "
        "orders where o_orderstatus = 'O') t1 where t1.v > 1000) t2 where t2.k > 10"
    ),
    # Q1,J6
    "q1_derived_agg_cross": "select c.c_custkey, m.mx from customer c cross join (select max(c_acctbal) as mx from customer) m",
    # Q2
    "q2_scalar_select": (
        "select c_custkey, (select max(o_orderkey) from orders) + (select min(o_orderkey) from orders) as mix from "
        "customer"
    ),
    # Q3
    "q3_scalar_where": (
        "select o_orderkey from orders where o_totalprice >= (select max(o_totalprice) from orders) or o_orderkey "
        "= (select min(o_orderkey) from orders)"
    ),
    # A1,A3,A5,A7,A8
    "a1_global": (
        "select count(o_orderkey) as c, cast(sum(o_custkey) as bigint) as s, min(o_orderkey) as mn, "
        "max(o_orderpriority) as mx from orders"
    ),
    # A1 (D10)
    "a1_global_empty": (
        "select count(o_orderkey) as c, cast(sum(o_custkey) as bigint) as s, max(o_orderkey) as mx from orders "
        "where o_orderkey < 0"
    ),
    # A2
    "a2_group_multi": (
        "select l_returnflag, l_linestatus, count(l_orderkey) as c, cast(sum(cast(l_quantity as bigint)) as "
        "bigint) as q, min(l_shipdate) as mn, max(l_extendedprice) as mx from lineitem group by l_returnflag, "
        "l_linestatus"
    ),
    # A2
    "a2_group_expr": "select o_custkey % 7 as g, count(o_orderkey) as c from orders group by o_custkey % 7",
    # A2 (D9)
    "a2_group_null_keys": (
        "select nullif(o_orderstatus,'O') as k, nullif(o_custkey % 3, 0) as k2, count(o_orderkey) as c from orders "
        "group by nullif(o_orderstatus,'O'), nullif(o_custkey % 3, 0)"
    ),
    # A4
    "a4_count_distinct": "select count(distinct o_custkey) as c from orders",
    # A6
    "a6_sum_distinct_group": "select o_orderstatus, cast(sum(distinct o_custkey) as bigint) as s from orders group by o_orderstatus",
    # A5
    "a5_sum_cents": (
        "select o_orderstatus, cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint) as cents from orders "
        "group by o_orderstatus"
    ),
    # A9
    "a9_arith_on_agg": "select cast(sum(o_custkey+1) as bigint) + 1 as v, max(o_orderkey)-min(o_orderkey) as r from orders",
    # A10
    "a10_distinct_multi": "select distinct o_orderstatus, o_orderpriority from orders",
    # O2,O3
    "o2_sort_hidden_col": "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10",
    # O3
    "o3_limit_offset": "select o_orderkey from orders order by o_orderkey limit 5 offset 7",
    # O3
    "o3_offset_only": "select n_nationkey from nation order by n_nationkey offset 20",
    # O3
    "o3_limit_zero": "select o_orderkey from orders limit 0",
    # O4
    "o4_topk": (
        "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, "
        "l_linenumber limit 20"
    ),
    # F1,F2,F3
    "f1_f3_arith": "select o_orderkey+o_custkey as a, o_orderkey-o_custkey as s, o_orderkey*o_custkey as m from orders",
    # F4
    "f4_int_div": "select o_orderkey, o_orderkey / 7 as d from orders",
    # F5
    "f5_modulo": "select o_orderkey, o_orderkey % 7 as r from orders",
    # F4
    "f4_float_div": "select o_orderkey, o_totalprice / 4 as d from orders",
    # F6,F9
    "f6_date_plus_day": "select o_orderkey, cast(o_orderdate as date) + interval '1' day as d from orders",
    # F7
    "f7_interval_plus_month": "select o_orderkey, interval '1' month + cast(o_orderdate as date) as d from orders",
    # F7
    "f7_interval_plus_year": "select o_orderkey, interval '1' year + cast(o_orderdate as date) as d from orders",
    # F8 (D11)
    "f8_date_minus": (
        "select o_orderkey, cast(o_orderdate as date) - interval '1' day as d, cast(o_orderdate as date) - "
        "interval '1' month as m from orders"
    ),
    # F11
    "f11_compare_all": (
        "select o_orderkey, o_custkey = 5 as eq, o_custkey <> 5 as ne, o_custkey < 5 as lt, o_custkey <= 5 as le, "
        "o_custkey > 5 as gt, o_orderstatus >= 'O' as ge from orders"
    ),
    # F12
    "f12_kleene": (
        "select c_custkey, (nullif(c_custkey % 3, 0) > 1 and c_acctbal > 0) as x, (nullif(c_custkey % 3, 0) > 1 or "
        "c_acctbal > 0) as y from customer"
    ),
    # F13
    "f13_cast_widen": "select cast(n_nationkey as bigint) as b, cast(n_nationkey as double) as d from nation",
    # P5
    "sel_p5_filter_null_dropped": "select c_custkey from customer where nullif(c_custkey % 3, 0) > 1",
    # A3,A4 (D6)
    "a4_count_distinct_nulls": (
        "select count(nullif(o_custkey % 4, 0)) as c, count(distinct nullif(o_custkey % 4, 0)) as cd, "
        "cast(sum(distinct nullif(o_custkey % 4, 0)) as bigint) as sd from orders"
    ),
    # J1 (D9)
    "j1_null_keys_do_not_match": (
        "select count(a.c_custkey) as c from customer a join customer b on nullif(a.c_custkey % 50, 0) = "
        "nullif(b.c_custkey % 50, 0)"
    ),
    # A10
    "a10_distinct_on": "select distinct on (o_orderstatus) o_orderstatus, o_orderpriority from orders",
    # F4
    "f4_int_types": "select n_nationkey / 2 as i, n_nationkey / n_regionkey as j, (n_nationkey + 1) / 2 + 7 / 2 as k from nation where n_regionkey > 0",
    # F13
    "f13_implicit_widen": (
        "select n_nationkey + c_custkey as s, n_regionkey * c_acctbal as p, n_nationkey < c_acctbal as lt from nation "
        "join customer on n_nationkey = c_nationkey"
    ),
    # F15
    "f15_constant_limit": "select n_nationkey from nation order by n_nationkey limit 2 + 3 offset 1 + 1",
    # O1
    "o1_sort_desc_nulls_first": "select o_orderkey, nullif(o_custkey % 5, 0) as g from orders order by g desc nulls first, o_orderkey",
    # O1
    "o1_sort_asc_nulls_first": "select o_orderkey, nullif(o_custkey % 5, 0) as g from orders order by g asc nulls first, o_orderkey",
}

#: Oracle texts that differ from the engine's.
ORACLE = {
    "a10_distinct_on": "select distinct o_orderstatus, o_orderpriority from orders",
    "f4_int_types": "select n_nationkey // 2 as i, n_nationkey // n_regionkey as j, (n_nationkey + 1) // 2 + 7 // 2 as k from nation where n_regionkey > 0",
    "s11_values_list": "select col1 as id, col2 as name from (values (1,'a'),(2,'b'),(3,null)) t(col1,col2)",
    "f4_int_div": "select o_orderkey, o_orderkey // 7 as d from orders",
    "f6_date_plus_day": "select o_orderkey, cast(cast(o_orderdate as date) + interval '1' day as date) as d from orders",
    "f7_interval_plus_month": "select o_orderkey, cast(cast(o_orderdate as date) + interval '1' month as date) as d from orders",
    "f7_interval_plus_year": "select o_orderkey, cast(cast(o_orderdate as date) + interval '1' year as date) as d from orders",
    "f8_date_minus": (
        "select o_orderkey, cast(cast(o_orderdate as date) - interval '1' day as date) as d, cast(cast(o_orderdate "
        "as date) - interval '1' month as date) as m from orders"
    ),
}

# -- key-value queries: user_id is the key, event_id the seq, an error event a tombstone

def _log(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    vtype = F.when(F.col("event_type") == "error", kv.TOMBSTONE).otherwise(kv.VALUE)
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), vtype.alias("vtype"), "value")


def _kv(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("k"), "seq", F.col("value").alias("v"))


def k1_k2_put_delete(spark: SparkSession, d: str) -> DataFrame:
    """Every key is put or deleted once more."""
    log = _log(spark, d)
    vtype = F.when(F.col("key") % 2 == 0, kv.TOMBSTONE).otherwise(kv.VALUE)
    more = log.select("key").distinct()
    more = more.select("key", (F.col("key") + 1_000_000_000).alias("seq"), vtype.alias("vtype"), F.lit(1.5).alias("value"))
    return _kv(kv.visible(log.unionByName(more)))


def k3_write_batch(spark: SparkSession, d: str) -> DataFrame:
    """Sequence numbers of an ordered batch: base, base + 1, ..."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    return kv.sequence(events, ["ts", "event_id"], 100).select("event_id", "seq")


def k4_get_latest(spark: SparkSession, d: str) -> DataFrame:
    return _kv(kv.visible(kv.between(_log(spark, d), 3, 4)))


def _half(spark: SparkSession, d: str) -> int:
    """The seq in the middle of the log."""
    return (spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] or 0) // 2


def k5_snapshot_get(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot that leaves half of the log in sight at every scale."""
    return _kv(kv.visible(_log(spark, d), _half(spark, d)))


def k7_scan(spark: SparkSession, d: str) -> DataFrame:
    return _kv(kv.scan(_log(spark, d)))


def k8_reverse_scan(spark: SparkSession, d: str) -> DataFrame:
    return _kv(kv.scan(_log(spark, d), reverse=True))


def k9_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return _kv(kv.scan(_log(spark, d), start=3, end=9))


def k9_seek(spark: SparkSession, d: str) -> DataFrame:
    return _kv(kv.seek(_log(spark, d), 10))


def k9_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("key", F.concat(F.lit("user/"), F.col("key").cast("string")))
    return _kv(kv.scan(log, prefix="user/1"))


def k10_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    runs = [log.where(F.col("seq") % 3 == i) for i in range(3)]
    return kv.merge_runs(runs).select(F.col("key").alias("k"), "seq", F.col("vtype").alias("vt"))


def k11_concatenation(spark: SparkSession, d: str) -> DataFrame:
    """Three sorted runs of disjoint key ranges read one after another, with the place of each row."""
    log = _log(spark, d)
    third = (log.agg(F.max("key")).first()[0] or 0) // 3 + 1
    runs = [log.where(F.floor(F.col("key") / third) == i).orderBy("key", F.desc("seq")) for i in (2, 0, 1)]
    return _positions(kv.concatenate(runs).select(F.col("key").alias("k"), F.col("seq").alias("n")))


def k12_comparator(spark: SparkSession, d: str) -> DataFrame:
    """Range scan in the order of another expression of the key."""
    return _kv(kv.scan(_log(spark, d), start=-20, end=-10, order=-F.col("key")))


def k14_compaction(spark: SparkSession, d: str) -> DataFrame:
    """The oldest snapshot is in the middle of the log, so that the versions of its first half collapse."""
    return kv.compact(_log(spark, d), _half(spark, d)).select(F.col("key").alias("k"), "seq", F.col("vtype").alias("vt"))


def k16_approx_size(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    log = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit(1).alias("vtype"), F.col("props").alias("value"))
    return kv.approximate_size(log, 3, 9).select(F.col("bytes").alias("b"))


def k17_bloom_filter(spark: SparkSession, d: str) -> DataFrame:
    """Point reads through a Bloom filter: keys that pass are then looked up exactly."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    customers = spark.read.parquet(f"{d}/customer.parquet").where(F.col("c_acctbal") > 5000)
    passed = orders.where(bloom_filter(customers, "c_custkey").might_contain(F.col("o_custkey")))
    return passed.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


def k25_request_service(spark: SparkSession, d: str) -> DataFrame:
    """ListKV over UpdateKV: the value a read finds at its seq (0: the latest); tombstone updates are not stored."""
    upd = spark.read.parquet(f"{d}/update_kv_request.parquet").where(F.col("value_type") == 0)
    ask = spark.read.parquet(f"{d}/list_kv_request.parquet")
    found = kv.read_at(ask.select("request_id", "tenant", "key", "seq"), upd, ["tenant", "key"], "seq", "value")
    return found.select("request_id", F.col("found_seq").alias("seq"), F.col("found_value").alias("value"))


# -- sources, sinks and definitions: each goes through files or tables that it makes itself


def _with_engine(spark: SparkSession, d: str, script: str, **tables: str) -> DataFrame:
    engine = Engine(spark)
    for name in tables or TABLES:
        engine.register_parquet(name, f"{d}/{name}.parquet")
    return engine.sql(script)


def _nation_csv(spark: SparkSession, d: str, **options) -> str:
    path = scratch_path(spark, "nation") + ".csv"
    spark.read.parquet(f"{d}/nation.parquet").coalesce(1).write.options(**options).csv(path)
    return path


_NATION = "select cast(n_nationkey as int) as n_nationkey, n_name, cast(n_regionkey as int) as n_regionkey from "


def s2_csv_table(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.register_csv("nation_csv", _nation_csv(spark, d, header=True))
    return engine.sql(_NATION + "nation_csv")


def s3_memory_table(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.register_rows("mem", [(1, "a"), (2, ""), (3, None)], "id bigint, name string")
    return engine.sql("select id, name from mem where id < 3")


def s5_append_table(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "create table t(k bigint, s varchar); insert into t select o_orderkey, o_orderstatus from orders; "
                        "insert into t select o_orderkey, 'again' from orders; select k, s from t")  # fmt: skip


def s6_seq_table_scan(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "select r_regionkey, r_name from seq_table_scan(region) r")


def s7_read_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _nation_csv(spark, d, header=False, sep="|")
    return Engine(spark).sql(
        f"select column_1 as n_nationkey, column_2 as n_name, column_3 as n_regionkey from read_csv('{path}', header=>false, delim=>'|')"
    )


def s8_replacement_scan(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).sql(_NATION + f"'{_nation_csv(spark, d, header=True)}' t where t.n_regionkey > 1")


def s18_create_table_as(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "create table big as select o_orderkey, o_totalprice from orders where o_totalprice > 300000; select o_orderkey, o_totalprice from big")


def s19_insert_columns(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "create table t(a int unsigned, b varchar, c date); insert into t(c, a) select cast(o_orderdate as date), o_custkey from orders; select a, b, c from t")


def s20_copy_from(spark: SparkSession, d: str) -> DataFrame:
    path = _nation_csv(spark, d, header=True, sep="|")
    return Engine(spark).sql(
        f"create table n(n_nationkey int, n_name varchar, n_regionkey int); copy n from '{path}' (delimiter '|', header); select n_nationkey, n_name, n_regionkey from n"
    )


def s13_query_tables(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "create table made(a int, b varchar); select schema_name, schema_oid, table_name, table_oid from query_tables()", region="", nation="")


def s15_show_tables(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "create table made(a int, b varchar); create table gone(a int); drop table gone; show tables", region="", nation="")


def s14_s16_describe(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "create table made(a int, b smallint unsigned, c varchar); describe made")


def s21_explain(spark: SparkSession, d: str) -> DataFrame:
    """The three plans and what tells them apart: where the filter is, and which columns are read."""
    plans = _with_engine(spark, d, "explain select x.k from (select o_orderkey as k, o_custkey as c, o_totalprice from orders) x where x.c = 1 + 2", orders="")
    return plans.select(
        "type",
        F.col("plan").contains("SubqueryAlias").alias("has_alias"),
        F.col("plan").rlike(r"= 3\b|,3\)").alias("constant_folded"),
        F.col("plan").contains("PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,3)]").alias("filter_in_scan"),
        F.col("plan").contains("ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>").alias("columns_pruned"),
    )


def s22_explain_text(spark: SparkSession, d: str) -> DataFrame:
    """Both plans as text, and the operators in each."""
    engine = Engine(spark)
    engine.register_parquet("nation", f"{d}/nation.parquet")
    text = engine.explain("select count(n_name) as n from nation where n_regionkey = 1")
    rows = [(name, all(word in part for word in ("Aggregate", "Filter", "n_regionkey"))) for name, part in zip(("original", "optimized"), text.split("optimized plan:"))]
    return spark.createDataFrame(rows, "plan string, complete boolean")


def s23_result_text(spark: SparkSession, d: str) -> DataFrame:
    """A result as lines of text (25 rows)."""
    df = _with_engine(spark, d, "select n_nationkey, nullif(n_regionkey, 0) as r, '' as e, n_regionkey > 2 as b from nation", nation="")
    return spark.createDataFrame([(line,) for line in rows_text(df)], "line string")


def sel_p7_errors(spark: SparkSession, d: str) -> DataFrame:
    """Statements and whether they are refused."""
    engine = Engine(spark)
    engine.register_parquet("nation", f"{d}/nation.parquet")
    tried = [
        "select nothing from nation", "select n_name from nowhere", "select n_nationkey from nation a join nation b on a.n_name = b.n_name",
        "select n_name from nation where n_name > 5", "select n_name, count(*) from nation", "selec 1", "select * from (select 1 as a)", "insert into nation values (1)",
        "select n_name from nation",
    ]
    rows = []
    for text in tried:
        try:
            engine.sql(text)
            rows.append((text, False))
        except Exception:
            rows.append((text, True))
    return spark.createDataFrame(rows, "statement string, refused boolean")


def _positions(df: DataFrame) -> DataFrame:
    """The rows of a sorted result with their place in it."""
    return kv.sequence(df.withColumn("at", F.monotonically_increasing_id()), ["at"], 0).drop("at")


def o1_default_desc(spark: SparkSession, d: str) -> DataFrame:
    """Where rows stand in a sort that says nothing about nulls."""
    return _positions(_with_engine(spark, d, "select o_orderkey, nullif(o_custkey % 5, 0) as g from orders order by g desc, o_orderkey", orders=""))


def o1_default_asc(spark: SparkSession, d: str) -> DataFrame:
    return _positions(_with_engine(spark, d, "select o_orderkey, nullif(o_custkey % 5, 0) as g from orders order by g, o_orderkey desc", orders=""))


# -- the store: all events, in the order of event_id, numbered from 1


def _store(spark: SparkSession, d: str, batches: int = 1, **options) -> tuple[KV, list[DataFrame]]:
    events = _log(spark, d).withColumnRenamed("seq", "n").withColumn("n", F.col("n").cast("bigint"))
    options = {"key_type": "bigint", "value_type": "double"} | options
    return KV(spark, **options), slices(events, "n", batches)


def k6_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot taken in the middle of the log still shows that state after everything was written and compacted."""
    db, parts = _store(spark, d, 2)
    db.write_frame(parts[0], ["n"])
    then = db.snapshot()
    for p in parts[1:]:
        db.write_frame(p, ["n"])
    db.compact()
    out = _kv(db.scan(snapshot=then))
    db.close()
    return out


def k13_k15_levels(spark: SparkSession, d: str) -> DataFrame:
    """Runs flushed one after another are compacted by level, by themselves; what is left is one version a key or so."""
    db, parts = _store(spark, d, 9)
    for p in parts:
        db.write_frame(p, ["n"])
    few = len(db.runs) <= KV.LEVEL0_RUNS and max(r["level"] for r in db.runs) >= 1
    out = db.scan().select(F.col("key").alias("k"), "seq", F.col("value").alias("v"), F.lit(few).alias("runs_are_few"))
    db.close()
    return out


def k19_k22_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledged writes that were not flushed are there after a crash; a second writer is refused meanwhile."""
    db, parts = _store(spark, d)
    db.write_frame(parts[0], ["n"])
    db.write([("put", -1, 0.5), ("put", -2, 1.5), ("delete", -1)])
    try:
        KV(spark, db.path, key_type="bigint", value_type="double")
        refused = False
    except RuntimeError:
        refused = True
    again = KV(spark, db.path, key_type="bigint", value_type="double", break_lock=True)
    out = again.scan().select(F.col("key").alias("k"), F.col("value").alias("v"), F.lit(refused).alias("refused"))
    again.close()
    return out


def s4_kv_table(spark: SparkSession, d: str) -> DataFrame:
    """A key-value store joined as a table."""
    db, parts = _store(spark, d)
    db.write_frame(parts[0], ["n"])
    engine = Engine(spark)
    engine.register_kv("latest", db)
    engine.register_parquet("customer", f"{d}/customer.parquet")
    out = engine.sql("select c.c_custkey, l.value from customer c join latest l on c.c_custkey = l.key")
    db.close()
    return out


def f10_typed_constants(spark: SparkSession, d: str) -> DataFrame:
    return _with_engine(spark, d, "select n_nationkey, integer '12' as i, date '2020-02-30' as bad, date '2020-02-29' as good from nation")


def f9_interval_units(spark: SparkSession, d: str) -> DataFrame:
    """Units below a day keep the type a date."""
    day = "cast(o_orderdate as date)"
    return _with_engine(spark, d, f"select o_orderkey, {day} + interval '36' hour as h, {day} - interval '1' minute as m, {day} + interval '2' week as w from orders")


def u1_scalar_function(spark: SparkSession, d: str) -> DataFrame:
    """A vectorized scalar function registered for SQL."""
    engine = Engine(spark)
    engine.register_parquet("nation", f"{d}/nation.parquet")

    @F.pandas_udf("bigint")
    def doubled(x: pd.Series) -> pd.Series:
        return x.astype("int64") * 2

    engine.register_udf("doubled", doubled)
    return engine.sql("select n_nationkey, doubled(n_regionkey) as twice from nation")


def u3_overloads(spark: SparkSession, d: str) -> DataFrame:
    """One name with four signatures; each call takes the one with the fewest implicit casts."""
    engine = Engine(spark)
    for t in ("nation", "customer"):
        engine.register_parquet(t, f"{d}/{t}.parquet")

    def named(text: str):
        def f(*columns: pd.Series) -> pd.Series:
            return text + columns[0].astype(str).str.len().gt(0).map({True: "", False: "?"})

        return F.pandas_udf(f, "string")

    for kinds in (["int", "int"], ["bigint", "bigint"], ["double", "double"], ["varchar"]):
        engine.register_udf("kind", named(" ".join(kinds)), arguments=kinds)
    return engine.sql(
        "select c_custkey, kind(n_nationkey, n_regionkey) as a, kind(c_custkey, c_custkey) as b, kind(c_acctbal, n_nationkey) as c, kind(kind(n_name)) as d "
        "from customer join nation on c_nationkey = n_nationkey"
    )


def a11_user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate of one's own in a grouped query."""
    engine = Engine(spark)
    engine.register_parquet("customer", f"{d}/customer.parquet")
    engine.register_udaf("spread", lambda x: float(x.max() - x.min()), "double")
    return engine.sql("select c_nationkey, spread(c_custkey) as s, spread(c_acctbal * 0 + 1) as z from customer group by c_nationkey")


def u2_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A table function registered for SQL."""

    @F.udtf(returnType="n int, square int")
    class Squares:
        def eval(self, upto: int):
            for i in range(upto):
                yield i, i * i

    engine = Engine(spark)
    engine.register_udtf("squares", Squares)
    return engine.sql("select n, square from squares(10)")


_FUNCTIONS = [
    k1_k2_put_delete, k3_write_batch, k4_get_latest, k5_snapshot_get, k7_scan, k8_reverse_scan, k9_range_scan, k9_seek, k9_prefix_scan, k10_merge_runs,
    k11_concatenation, k12_comparator, k14_compaction, k16_approx_size, k17_bloom_filter, k25_request_service, s2_csv_table, s3_memory_table, s5_append_table,
    s6_seq_table_scan, s7_read_csv, s8_replacement_scan, s18_create_table_as, s19_insert_columns, s20_copy_from, s13_query_tables, s14_s16_describe, s15_show_tables, s21_explain,
    s22_explain_text, s23_result_text, sel_p7_errors, o1_default_desc, o1_default_asc, k6_snapshots, k13_k15_levels, k19_k22_recovery, s4_kv_table,
    f9_interval_units, f10_typed_constants, u1_scalar_function, u2_table_function, u3_overloads, a11_user_aggregate,
]


def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    words = set(re.findall(r"\w+", text))
    used = [t for t in TABLES if t in words]

    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(spark)
        for t in used:
            engine.register_parquet(t, f"{d}/{t}.parquet")
        return engine.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _sql_query(v) for k, v in SQL.items()} | {f.__name__: f for f in _FUNCTIONS}


_HALF = "(select max(event_id) // 2 from events)"

_EVENTS = "(select user_id as k, event_id as seq, case when event_type = 'error' then 0 else 1 end as vt, value as v from events)"


_NUMBERED = """(select user_id as k, event_id as n, row_number() over (order by event_id) as seq,
    case when event_type = 'error' then 0 else 1 end as vt, value as v from events)"""


def _newest(log: str, where: str = "true") -> str:
    return (
        "select k, seq, v from (select *, row_number() over (partition by k order by seq desc) as rn "
        f"from {log} l where {where}) t where rn = 1 and vt = 1"
    )


_ADDED = f"""
  (select k, seq, vt, v from {_EVENTS} union all
   select distinct user_id, user_id + 1000000000, case when user_id % 2 = 0 then 0 else 1 end, 1.5 from events)"""


def oracle_sql() -> dict[str, str]:
    found = {k: ORACLE.get(k, v) for k, v in SQL.items()}
    nation = "select n_nationkey, n_name, n_regionkey from nation"
    return found | {
        "k1_k2_put_delete": _newest(_ADDED),
        "k3_write_batch": "select event_id, 99 + row_number() over (order by ts, event_id) as seq from events",
        "k4_get_latest": _newest(_EVENTS, "k = 3"),
        "k5_snapshot_get": _newest(_EVENTS, f"seq <= {_HALF}"),
        "k7_scan": _newest(_EVENTS),
        "k8_reverse_scan": _newest(_EVENTS),
        "k9_range_scan": _newest(_EVENTS, "k >= 3 and k < 9"),
        "k9_seek": _newest(_EVENTS, "k >= 10") + " order by k limit 1",
        "k9_prefix_scan": f"select 'user/' || k as k, seq, v from ({_newest(_EVENTS)}) where 'user/' || k like 'user/1%'",
        "k10_merge_runs": f"select k, seq, vt from {_EVENTS}",
        "k11_concatenation": f"select k, seq as n, row_number() over (order by k, seq desc) - 1 as seq from {_EVENTS}",
        "k12_comparator": _newest(_EVENTS, "-k >= -20 and -k < -10"),
        "k14_compaction": (
            f"select k, seq, vt from (select *, lag(seq) over (partition by k order by seq desc) as newer from {_EVENTS} l) t "
            f"where not (coalesce(newer <= {_HALF}, false) or (vt = 0 and seq <= {_HALF}))"
        ),
        "k16_approx_size": "select cast(sum(length(cast(user_id as varchar)) + length(props)) as bigint) as b from events where user_id >= 3 and user_id < 9",
        "k17_bloom_filter": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)",
        "k25_request_service": """
          select request_id, useq as seq, value from (
            select r.request_id, u.seq as useq, u.value,
              row_number() over (partition by r.request_id order by u.seq desc nulls last, u.value desc nulls last) as rn
            from list_kv_request r left join update_kv_request u on u.value_type = 0 and u.tenant = r.tenant and u.key = r.key
              and (r.seq = 0 or u.seq <= r.seq)) where rn = 1""",
        "s2_csv_table": nation,
        "s3_memory_table": "select cast(id as bigint) as id, name from (values (1, 'a'), (2, '')) t(id, name)",
        "s5_append_table": "select o_orderkey as k, o_orderstatus as s from orders union all select o_orderkey, 'again' from orders",
        "s6_seq_table_scan": "select r_regionkey, r_name from region",
        "s7_read_csv": nation,
        "s8_replacement_scan": nation + " where n_regionkey > 1",
        "s18_create_table_as": "select o_orderkey, o_totalprice from orders where o_totalprice > 300000",
        "s19_insert_columns": "select o_custkey as a, cast(null as varchar) as b, cast(o_orderdate as date) as c from orders",
        "s20_copy_from": nation,
        "s13_query_tables": (
            "select * from (values ('main', cast(1 as int), 'region', cast(2 as int)), ('main', 1, 'nation', 3), ('main', 1, 'made', 4)) "
            "t(schema_name, schema_oid, table_name, table_oid)"
        ),
        "s15_show_tables": "select * from (values ('main', 'region'), ('main', 'nation'), ('main', 'made')) t(schema_name, table_name)",
        "s14_s16_describe": "select 'made' as table_name, '[a, b, c]' as column_names, '[Integer, USmallint, Varchar]' as column_types",
        "s21_explain": (
            "select * from (values ('logical_plan', true, false, false, false), ('logical_plan_opt', false, true, false, false), "
            "('physical_plan', false, true, true, true)) t(type, has_alias, constant_folded, filter_in_scan, columns_pruned)"
        ),
        "s22_explain_text": "select * from (values ('original', true), ('optimized', true)) t(plan, complete)",
        "s23_result_text": (
            "select n_nationkey || ' ' || coalesce(cast(nullif(n_regionkey, 0) as varchar), 'NULL') || ' (empty) ' || "
            "case when n_regionkey > 2 then 'true' else 'false' end as line from nation"
        ),
        "sel_p7_errors": """
          select * from (values ('select nothing from nation', true), ('select n_name from nowhere', true),
            ('select n_nationkey from nation a join nation b on a.n_name = b.n_name', true), ('select n_name from nation where n_name > 5', true),
            ('select n_name, count(*) from nation', true), ('selec 1', true), ('select * from (select 1 as a)', true),
            ('insert into nation values (1)', true), ('select n_name from nation', false)) t(statement, refused)""",
        "o1_default_desc": """
          select o_orderkey, nullif(o_custkey % 5, 0) as g,
            row_number() over (order by nullif(o_custkey % 5, 0) desc nulls first, o_orderkey) - 1 as seq from orders""",
        "o1_default_asc": """
          select o_orderkey, nullif(o_custkey % 5, 0) as g,
            row_number() over (order by nullif(o_custkey % 5, 0) nulls first, o_orderkey desc) - 1 as seq from orders""",
        "k6_snapshots": _newest(_NUMBERED, "n <= (select max(event_id) // 2 from events)"),
        "k13_k15_levels": f"select *, true as runs_are_few from ({_newest(_NUMBERED)})",
        "k19_k22_recovery": f"select k, v, true as refused from (select k, v from ({_newest(_NUMBERED)}) union all select -2, 1.5)",
        "s4_kv_table": f"select c.c_custkey, l.v as value from customer c join ({_newest(_NUMBERED)}) l on c.c_custkey = l.k",
        "f9_interval_units": """
          select o_orderkey, cast(o_day + interval '36' hour as date) as h, cast(o_day - interval '1' minute as date) as m,
            cast(o_day + interval '14' day as date) as w
          from (select o_orderkey, cast(o_orderdate as date) as o_day from orders)""",
        "f10_typed_constants": "select n_nationkey, 12 as i, cast(null as date) as bad, date '2020-02-29' as good from nation",
        "u1_scalar_function": "select n_nationkey, cast(n_regionkey * 2 as bigint) as twice from nation",
        "u3_overloads": "select c_custkey, 'int int' as a, 'bigint bigint' as b, 'double double' as c, 'varchar' as d from customer",
        "a11_user_aggregate": "select c_nationkey, cast(max(c_custkey) - min(c_custkey) as double) as s, cast(0 as double) as z from customer group by c_nationkey",
        "u2_table_function": "select cast(i as int) as n, cast(i * i as int) as square from range(10) t(i)",
    }
