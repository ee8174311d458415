"""Queries pN_ for the problems tagged llm (1, 5, 6, 8, 9, 10) and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.divergence import divergence
from tidemark.llm.ledger import KeyLedger
from tidemark.llm.mixing import BLOCK_TOKENS, mix_sources, reached_shares
from tidemark.llm.packing import pack_texts, read_capacities
from tidemark.llm.quantiles import RELATIVE_ERROR, merge_sketches, read_quantiles, sketch_groups
from tidemark.llm.repetition import repetition
from tidemark.llm.tokens import with_tokens
from tidemark.llm.topn import top_n
from tidemark.operators.skew import MIN_HEAVY_ROWS, heavy_keys
from tidemark.operators.upsert import spans
from tidemark.scratch import materialize, scratch_path

#: Batches, in order of arrival, in which the key ledger sees the two tables.
LEDGER_BATCHES = 4


def _key_rows(spark: SparkSession, d: str) -> DataFrame:
    req = spark.read.parquet(f"{d}/update_kv_request.parquet")
    ask = spark.read.parquet(f"{d}/list_kv_request.parquet")
    a = req.select(F.lit("update_kv_request").alias("source_table"), F.col("delivery_id").alias("record_id"), "key", "arrived_at", F.lit(True).alias("writes"))
    b = ask.select(F.lit("list_kv_request").alias("source_table"), F.col("request_id").alias("record_id"), "key", "arrived_at", F.lit(False).alias("writes"))
    return a.unionByName(b)


def _key_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _key_rows(spark, d)
    total, tests = spans(rows, "arrived_at", LEDGER_BATCHES)
    heavy = heavy_keys(rows, F.col("key"), min_rows=MIN_HEAVY_ROWS, total=total)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ledger = KeyLedger(spark, types["key"], types["arrived_at"])
    carry = ["source_table", "record_id"]
    answers = ledger.observe_all(rows, "key", "arrived_at", dict(enumerate(tests)), writes=F.col("writes"), carry=carry, heavy=heavy)
    return reduce(DataFrame.unionByName, answers)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key occurs in an update with a strictly earlier arrival."""
    return _key_answers(spark, d).where("seen").select("source_table", "record_id")


def p1_reopened(spark: SparkSession, d: str) -> DataFrame:
    """p1_found with a ledger that is closed and merged after two batches, opened again, and gets the second batch twice."""
    rows = _key_rows(spark, d)
    _, tests = spans(rows, "arrived_at", LEDGER_BATCHES)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    path, carry = scratch_path(spark, "reopened"), ["source_table", "record_id"]
    out = []

    def answer(ledger: KeyLedger, run: int) -> DataFrame:
        found = ledger.observe(rows.where(tests[run]), "key", "arrived_at", writes=F.col("writes"), carry=carry, run=run)
        return materialize(found.where("seen").drop("seen"), "answers")

    ledger = KeyLedger(spark, types["key"], types["arrived_at"], path=path)
    half = len(tests) // 2
    out += [answer(ledger, run) for run in range(half)]
    ledger.compact()
    ledger.close()
    ledger = KeyLedger(spark, types["key"], types["arrived_at"], path=path)
    out[half - 1 :] = [answer(ledger, run) for run in range(max(0, half - 1), len(tests))]
    ledger.compact(fan_in=2)
    return reduce(DataFrame.unionByName, out)


def p1_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per table: answers, how many said "seen", and how many are wrong by an independent count."""
    rows = _key_rows(spark, d)
    said = _key_answers(spark, d).select(F.col("source_table").alias("st"), F.col("record_id").alias("rid"), "seen")
    first = rows.where(F.col("writes") & F.col("key").isNotNull()).groupBy(F.col("key").alias("fk")).agg(F.min("arrived_at").alias("f"))
    truth = rows.join(first, F.col("key") == F.col("fk"), "left").select("source_table", "record_id", F.coalesce(F.col("f") < F.col("arrived_at"), F.lit(False)).alias("truth"))
    both = said.join(truth, (F.col("st") == F.col("source_table")) & (F.col("rid") == F.col("record_id")))
    wrong = F.sum((F.col("seen") != F.col("truth")).cast("bigint"))
    return both.groupBy("source_table").agg(
        F.count("*").alias("answers"), F.sum(F.col("seen").cast("bigint")).alias("seen"), wrong.alias("wrong"), (wrong / F.count("*")).alias("error_rate")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best paid employees of each department."""
    emp = spark.read.parquet(f"{d}/employee.parquet")
    return top_n(emp, "department_id", "salary", "id", 5).select("department_id", "id")


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best paid employees of each department, with salary and rank."""
    emp = spark.read.parquet(f"{d}/employee.parquet")
    top = top_n(emp, "department_id", "salary", "id", 100)
    order = Window.partitionBy("department_id").orderBy(F.col("salary").desc(), F.col("id"))
    return top.select("department_id", "id", "salary", F.row_number().over(order).alias("rank"))


QUANTILES = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
_SEP = "\x1f"


def _monthly_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches per (field, value of the field, month)."""
    emp = spark.read.parquet(f"{d}/employee.parquet")
    # an employee row belongs to a department and to a job title; a null is no group
    fields = F.array(
        F.when(F.col("department_id").isNotNull(), F.concat(F.lit(f"department_id{_SEP}"), F.col("department_id").cast("string"))),
        F.when(F.col("job_title").isNotNull(), F.concat(F.lit(f"job_title{_SEP}"), F.col("job_title"))),
    )
    month = F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit(""))
    rows = emp.select("salary", month.alias("month"), F.explode(fields).alias("field"))
    return sketch_groups(rows, F.concat("month", F.lit(_SEP), "field"), "salary")


def _fields(df: DataFrame, *names: str) -> DataFrame:
    parts = F.split("g", _SEP, len(names))
    return df.select(*[parts[i].alias(n) for i, n in enumerate(names)], *[c for c in df.columns if c != "g"])


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Salary percentiles per department and per job title, merged from monthly sketches."""
    monthly = _monthly_sketches(spark, d)
    whole = merge_sketches(monthly.select(F.substring_index("g", _SEP, -2).alias("g"), "sketch"))
    return _fields(read_quantiles(whole, list(QUANTILES.values()), list(QUANTILES)), "field_name", "field_key").withColumn(
        "relative_rank_error", F.lit(RELATIVE_ERROR)
    )


def p6_monthly(spark: SparkSession, d: str) -> DataFrame:
    """The same per month of loading."""
    found = read_quantiles(_monthly_sketches(spark, d), list(QUANTILES.values()), list(QUANTILES))
    return _fields(found, "month", "field_name", "field_key")


def _rank_errors(spark: SparkSession, d: str, estimates: DataFrame, monthly: bool) -> DataFrame:
    """Per group and percentile: n, the answer's rank error in rows, and the distance of its rank from the nearer end."""
    by = ["month", "field_name", "field_key"][0 if monthly else 1 :]
    listed = [F.struct(F.lit(k).alias("q"), F.lit(v).alias("share"), F.col(k).alias("answer")) for k, v in QUANTILES.items()]
    long = materialize(estimates, "percentiles").select(*[F.col(c).alias(f"e_{c}") for c in by], "n", F.explode(F.array(*listed)).alias("e"))
    long = long.select(*[f"e_{c}" for c in by], "n", "e.*")
    emp = spark.read.parquet(f"{d}/employee.parquet").where(F.col("salary").isNotNull())
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("field_key")) for c in ("department_id", "job_title")])
    month = F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("")).alias("month")
    values = emp.select("salary", month, F.explode(pairs).alias("p")).select("month", "p.*", "salary").groupBy(*by, "salary").agg(F.count("*").alias("c"))
    on = F.lit(True)
    for c in by:
        on = on & (F.col(c) == F.col(f"e_{c}"))
    both = values.join(long, on)
    ranks = both.groupBy(*by, "n", "q", "share").agg(
        F.sum(F.when(F.col("salary") < F.col("answer"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("salary") <= F.col("answer"), F.col("c")).otherwise(0)).alias("upto")
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n") - F.lit(1e-9)))
    off = F.greatest(F.lit(0), F.col("below") + 1 - rank, rank - F.col("upto")).alias("off")
    return ranks.select(*by, "n", F.col("q").alias("percentile"), off, F.greatest(F.lit(1), F.least(rank, F.col("n") - rank)).alias("near"))


def p6_error(spark: SparkSession, d: str) -> DataFrame:
    """Largest rank error of any group, per field and percentile, measured against all rows.

    ``rank_error`` is in rows, ``relative_error`` divides it by the distance of
    the rank from the nearer end.
    """
    return _rank_errors(spark, d, p6_percentiles(spark, d), False).groupBy("field_name", "percentile").agg(
        F.count("*").alias("groups"), F.max("off").alias("rank_error"), F.max(F.col("off") / F.col("near")).alias("relative_error")
    )


def _within(errors: DataFrame) -> DataFrame:
    good = (F.col("off") <= 1) | (F.col("off") <= F.lit(RELATIVE_ERROR) * F.col("near"))
    return errors.select(*[c for c in errors.columns if c not in ("off", "near")], good.alias("within_stated_error"))


def p6_within(spark: SparkSession, d: str) -> DataFrame:
    """For every group and percentile whether the answer's rank is within the stated error of the exact one."""
    return _within(_rank_errors(spark, d, p6_percentiles(spark, d), False))


def p6_monthly_within(spark: SparkSession, d: str) -> DataFrame:
    """The same for the answers per month."""
    return _within(_rank_errors(spark, d, p6_monthly(spark, d), True))


def _packs(spark: SparkSession, d: str, only: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    sizes = read_capacities(spark, f"{d}/pack_capacity.parquet")
    if only is not None:
        sizes = {k: v for k, v in sizes.items() if k == only}
    return pack_texts(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", sizes), sizes


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be divided to fit the packs of 'long'."""
    rows, _ = _packs(spark, d, "long")
    # a divided document is the one that has a piece numbered 1
    return rows.where(F.col("piece_no") == 1).select("doc_id")


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all documents with their packs, for every capacity."""
    return _packs(spark, d)[0]


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: packs, pieces, divided documents, and the share of room that is used."""
    rows, sizes = _packs(spark, d)
    capacity = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    packs = rows.groupBy("pack_name", "pack_id").agg(
        F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"), F.sum((F.col("piece_no") == 1).cast("bigint")).alias("divided")
    )
    return (
        packs.groupBy("pack_name")
        .agg(F.count("*").alias("packs"), F.sum("pieces").alias("pieces"), F.sum("divided").alias("divided"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .withColumn("capacity", capacity[F.col("pack_name")])
        .withColumn("fill", F.col("tokens") / (F.col("packs") * F.col("capacity")))
    )


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents packed, packs over capacity, documents with tokens lost or doubled, documents divided without need.

    Tokens are counted a second time, apart from the packing.
    """
    rows, sizes = _packs(spark, d)
    rows = materialize(rows, "packs")
    capacity = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    over = rows.groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > capacity[F.col("pack_name")])
    over = over.groupBy(F.col("pack_name").alias("on")).agg(F.count("*").alias("overfull"))
    # pieces follow one another if their starts sum up as their lengths say
    per = rows.groupBy("pack_name", "doc_id").agg(
        F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("piece_no").alias("numbers")
    )
    docs = spark.read.parquet(f"{d}/documents.parquet")
    truth = with_tokens(docs, "doc_id", "text").where("n_tokens > 0").select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("tokens"))
    truth = truth.withColumn("name", F.explode(F.array(*[F.lit(n) for n in sizes])))
    both = truth.join(per, (F.col("id") == F.col("doc_id")) & (F.col("name") == F.col("pack_name")), "full")
    right = F.coalesce((F.col("packed") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("pieces") == F.col("numbers")), F.lit(False))
    needless = F.coalesce((F.col("pieces") > 1) & (F.col("tokens") <= capacity[F.col("name")]), F.lit(False))
    found = both.groupBy(F.coalesce("name", "pack_name").alias("pack_name")).agg(
        F.count("*").alias("documents"), F.sum((~right).cast("bigint")).alias("wrong_tokens"), F.sum(needless.cast("bigint")).alias("needlessly_divided")
    )
    # one row a capacity on either side
    out = found.join(over, F.col("pack_name") == F.col("on"), "left")
    return out.select("pack_name", "documents", F.coalesce("overfull", F.lit(0)).cast("bigint").alias("overfull"), "wrong_tokens", "needlessly_divided")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn, with how often each is used."""
    return mix_sources(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_target.parquet"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares per listed source."""
    return reached_shares(p9_mix(spark, d), spark.read.parquet(f"{d}/mix_target.parquet"))


#: How far a source's reached share may be from its target.
SHARE_TOLERANCE = 0.01


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source: whether its share was reached, and no document is used too often, twice, or belongs elsewhere.

    The target is that of the sources that have documents, 0 for the others.  Off
    by SHARE_TOLERANCE, and what one block and one document make up, it counts as reached.
    """
    docs, targets = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "mix_target"))
    drawn = materialize(p9_mix(spark, d), "drawn")
    there = docs.where(F.col("text") != "").select(F.col("source").alias("ts")).distinct()
    shares = reached_shares(drawn, targets).join(there, F.col("source") == F.col("ts"), "left")
    share = F.when(F.col("ts").isNotNull(), F.col("target_share")).otherwise(F.lit(0.0))
    whole = F.sum(share).over(Window.partitionBy())  # a row per listed source
    largest = drawn.agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")), F.lit(1)).alias("all_tokens"))
    alien = drawn.join(docs.select(F.col("doc_id").alias("di"), F.col("source").alias("so")), (F.col("doc_id") == F.col("di")) & (F.col("source") == F.col("so")), "left_anti")
    twice = drawn.groupBy("doc_id").count().where("count > 1").select("doc_id")
    bad = alien.select("doc_id").unionByName(twice).agg(F.count("*").alias("bad"))
    off = F.abs(F.col("reached_share") - share / whole)
    out = shares.withColumn("off", off).join(F.broadcast(largest)).join(F.broadcast(bad))  # single rows
    room = F.lit(SHARE_TOLERANCE) + (F.col("longest") + BLOCK_TOKENS) / F.col("all_tokens")
    return out.select("source", (F.col("off") <= room).alias("share_reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("bad") == 0).alias("rows_valid"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which 30 % or more repeat earlier words."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return repetition(docs, "doc_id", "text").where(F.col("n_repeated") * 10 >= F.col("n_words") * 3).where("n_repeated > 0").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words, repeated words and their share for every document."""
    return repetition(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def p10_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every document's characters and common words from those of its language."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    # spellings of a tag such as EN, en-US and en_GB name one language
    language = F.lower(F.regexp_extract(F.trim("lang"), "^[A-Za-z]+", 0))
    found = divergence(docs, "doc_id", "text", language)
    return found.select("doc_id", "n_words", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_reopened": p1_reopened,
        "p1_error_rate": p1_error_rate,
        "p5_found": p5_found,
        "p5_ranked": p5_ranked,
        "p6_percentiles": p6_percentiles,
        "p6_monthly": p6_monthly,
        "p6_error": p6_error,
        "p6_within": p6_within,
        "p6_monthly_within": p6_monthly_within,
        "p8_found": p8_found,
        "p8_packs": p8_packs,
        "p8_fill": p8_fill,
        "p8_checks": p8_checks,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p9_checks": p9_checks,
        "p10_found": p10_found,
        "p10_shares": p10_shares,
        "p10_divergence": p10_divergence,
    }


_ANSWERS = """
  select r.source_table, r.record_id, coalesce(f.first_at < r.arrived_at, false) as seen
  from (select 'update_kv_request' as source_table, delivery_id as record_id, key, arrived_at from update_kv_request
        union all
        select 'list_kv_request', request_id, key, arrived_at from list_kv_request) r
  left join (select key, min(arrived_at) as first_at from update_kv_request where key is not null group by key) f using (key)
"""

_BEST = """
  select department_id, id, salary, row_number() over (partition by department_id order by salary desc, id) as rank
  from (select department_id, id, max(salary) as salary from employee
        where department_id is not null and id is not null and salary is not null group by department_id, id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"select source_table, record_id from ({_ANSWERS}) where seen",
        "p1_reopened": f"select source_table, record_id from ({_ANSWERS}) where seen",
        "p1_error_rate": f"""
          select source_table, count(*) as answers, cast(sum(cast(seen as int)) as bigint) as seen,
            cast(0 as bigint) as wrong, cast(0 as double) as error_rate
          from ({_ANSWERS}) group by source_table""",
        "p5_found": f"select department_id, id from ({_BEST}) where rank <= 5",
        "p5_ranked": f"select department_id, id, salary, rank from ({_BEST}) where rank <= 100",
        "p6_within": _GROUPS.format("'' as month", "", "field_name, field_key"),
        "p6_monthly_within": _GROUPS.format("coalesce(strftime(loaded_at, '%Y-%m'), '') as month", "month, ", "month, field_name, field_key"),
        "p8_found": r"""
          select doc_id from documents where len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) > (select capacity from pack_capacity where pack_name = 'long')""",
        "p8_checks": """
          select pack_name, (select count(*) from documents where text <> '') as documents, cast(0 as bigint) as overfull,
            cast(0 as bigint) as wrong_tokens, cast(0 as bigint) as needlessly_divided from pack_capacity""",
        "p9_checks": """
          select source, true as share_reached, true as repeats_kept, true as rows_valid
          from (select distinct source from mix_target)""",
        "p10_divergence": _DIVERGENCE,
        "p10_found": _REPEATED.format("select doc_id from s where n_repeated * 10 >= n_words * 3 and n_repeated > 0"),
        "p10_shares": _REPEATED.format("select doc_id, n_words, n_repeated, n_repeated / greatest(n_words, 1) as share from s"),
    }


#: Groups and percentiles of problem 6; an answer cannot be said in SQL, its error can be bounded.
_GROUPS = """
  with f as (
    select {0}, 'department_id' as field_name, cast(department_id as varchar) as field_key from employee where salary is not null
    union all select {0}, 'job_title', job_title from employee where salary is not null)
  select {1}field_name, field_key, count(*) as n, q.percentile, true as within_stated_error
  from f, (select unnest(['p01', 'p10', 'p50', 'p90', 'p95', 'p99', 'p999']) as percentile) q
  where field_key is not null group by {2}, q.percentile
"""

#: Jensen-Shannon distances of each document's classes and words to those of its language, in bits, as square roots.
_DIVERGENCE = r"""
  with d as (select doc_id, coalesce(lower(regexp_extract(trim(lang), '^[A-Za-z]+')), '') as lang, coalesce(text, '') as txt from documents),
  w as (select doc_id, lang, unnest(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')) as item from d),
  words as (select doc_id, lang, item, count(*) as n from w group by all),
  ranked as (select lang, item, sum(n) as n, row_number() over (partition by lang order by sum(n) desc, item) as r from words group by lang, item),
  chars as (
    select doc_id, lang, x.item, x.n from d, lateral (select unnest([
      {'item': 'upper', 'n': len(regexp_extract_all(txt, '\p{Lu}'))}, {'item': 'lower', 'n': len(regexp_extract_all(txt, '\p{Ll}'))},
      {'item': 'letter', 'n': len(regexp_extract_all(txt, '[\p{Lt}\p{Lm}\p{Lo}]'))}, {'item': 'digit', 'n': len(regexp_extract_all(txt, '\p{N}'))},
      {'item': 'space', 'n': len(regexp_extract_all(txt, '[\p{Z}\t\n\x0b\f\r]'))},
      {'item': 'other', 'n': length(txt) - len(regexp_extract_all(txt, '[\p{L}\p{N}\p{Z}\t\n\x0b\f\r]'))}]) as x) t where x.n > 0),
  mine as (
    select 'class' as kind, doc_id, lang, item, n from chars
    union all
    select 'word', s.doc_id, s.lang, coalesce(r.item, '') as item, sum(s.n)
    from words s left join ranked r on r.lang = s.lang and r.item = s.item and r.r <= 200 group by all),
  ref as (select kind, lang, item, sum(n) as n from mine group by all),
  p as (select *, n / sum(n) over (partition by kind, doc_id) as x from mine),
  q as (select *, n / sum(n) over (partition by kind, lang) as y from ref),
  js as (
    select kind, doc_id, sqrt(greatest(0, (sum(x * log2(2 * x / (x + y)) + y * log2(2 * y / (x + y))) + 1 - sum(y)) / 2)) as distance
    from p join q using (kind, lang, item) group by kind, doc_id),
  counted as (select doc_id, len(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')) as n_words from d)
  select c.doc_id, c.n_words, case when c.n_words >= 20 then round(k.distance, 6) end as class_distance,
    case when c.n_words >= 20 then round(j.distance, 6) end as word_distance
  from counted c left join js k on k.doc_id = c.doc_id and k.kind = 'class' left join js j on j.doc_id = c.doc_id and j.kind = 'word'
"""

#: Words as runs of letters and digits; a run of five is repeated if an equal one begins earlier.
_REPEATED = r"""
  with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as words from documents),
  p as (select doc_id, len(words) as n_words, words, unnest(range(1, greatest(len(words) - 3, 1))) as i from w),
  r as (select doc_id, i, row_number() over (partition by doc_id, words[i : i + 4] order by i) as nth from p),
  q as (select distinct doc_id, i + unnest(range(0, 5)) as at from r where nth > 1),
  s as (select w.doc_id, len(w.words) as n_words, count(q.at) as n_repeated from w left join q using (doc_id) group by all)
  {}"""
