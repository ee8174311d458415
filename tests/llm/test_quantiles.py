import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quantiles import RELATIVE_ERROR, QuantileSketch, merge_sketches, read_quantiles, sketch_groups

QS = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999]


def relative_errors(sketch, values):
    """Rank error of each answer over the distance of its rank from the nearer end."""
    v = np.sort(values)
    n, out = len(v), []
    for q, x in zip(QS, sketch.quantiles(QS)):
        rank = max(1, int(np.ceil(q * n - 1e-9)))
        below, upto = np.searchsorted(v, x, "left"), np.searchsorted(v, x, "right")
        off = max(0, below + 1 - rank, rank - upto)
        out.append((off - 1) / max(1, min(rank, n - rank)) if off > 1 else 0.0)
    return out


SHAPES = {
    "random": lambda n, r: r.permutation(n),
    "ascending": lambda n, r: np.arange(n),
    "descending": lambda n, r: np.arange(n)[::-1].copy(),
    "lognormal": lambda n, r: (r.lognormal(10, 2, n)).astype(np.int64),
    "ties": lambda n, r: r.integers(0, 7, n),
}


@pytest.mark.parametrize("parts", [1, 50])
def test_error_stays_within_what_is_stated(parts):
    """Of all answers, over all shapes, at most 0.3 % may miss the stated error, as stated; the sizes stay bounded."""
    r = np.random.default_rng(7)
    over = total = 0
    for shape in SHAPES:
        for trial in range(6):
            values = SHAPES[shape](200_000, r).astype(np.int64)
            whole = QuantileSketch(trial)
            for i, part in enumerate(np.array_split(values, parts)):
                s = QuantileSketch(1000 * trial + i)
                for chunk in np.array_split(part, max(1, len(part) // 3000)):
                    s.update(chunk)
                whole.merge(QuantileSketch.from_bytes(s.to_bytes(), 5))
            assert whole.n == len(values)
            for t in (whole.low, whole.high):
                assert sum(len(x) << h for h, x in enumerate(t.levels)) == len(values)
            assert len(whole.to_bytes()) < 120_000
            errors = relative_errors(whole, values)
            over += sum(e > RELATIVE_ERROR for e in errors)
            total += len(errors)
    assert total == 300 and over <= 0.003 * total


def test_few_values_are_exact():
    s = QuantileSketch()
    assert s.quantiles([0.5]) == [None]
    s.update(np.array([5, -(2**62), 7, 7], np.int64))
    assert s.quantiles([0, 0.25, 0.5, 0.75, 1]) == [-(2**62), -(2**62), 5, 7, 7]


SCHEMA = "dep long, pay long, g string, x int, sketch int, month string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    return [(1 if i % 3 == 0 else r.choice([None, *range(2, 40)]), r.choice([None, *range(5000)]), "", 1, 2, f"m{i % 5}") for i in range(20_000)]


def test_groups_and_parts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    direct = sketch_groups(df, F.col("dep").cast("string"), "pay")
    monthly = sketch_groups(df, F.concat_ws("/", "month", F.col("dep").cast("string")), "pay").where("g like '%/%'")
    merged = merge_sketches(monthly.select(F.substring_index("g", "/", -1).alias("g"), "sketch"))
    want = {}
    for d, p, *_ in rows:
        if d is not None and p is not None:
            want.setdefault(str(d), []).append(p)
    for sketches in (direct, merged):
        got = {r["g"]: r for r in read_quantiles(sketches, [0.5, 0.99], ["p50", "p99"]).collect()}
        assert got.keys() == want.keys()
        for g, values in want.items():
            v = np.sort(values)
            assert got[g]["n"] == len(v)
            for name, q in (("p50", 0.5), ("p99", 0.99)):
                rank = int(np.ceil(q * len(v)))
                below, upto = np.searchsorted(v, got[g][name], "left"), np.searchsorted(v, got[g][name], "right")
                off = max(0, below + 1 - rank, rank - upto)
                assert off <= 1 + RELATIVE_ERROR * min(rank, len(v) - rank)


def test_empty_and_null(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sketch_groups(df.limit(0), F.lit("a"), "pay").count() == 0
    assert sketch_groups(df.where("pay is null"), F.lit("a"), "pay").count() == 0
    assert sketch_groups(df, F.lit(None).cast("string"), "pay").count() == 0


def test_partial_results_are_handed_on_before_they_grow_large(spark, rows, monkeypatch):
    import pyarrow as pa

    from tidemark.llm import quantiles

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", ""] * 50), pa.array(range(200), pa.int64())], ["g", "x"])
    assert sum(b.num_rows for b in quantiles._partial([batch, batch])) == 4
    monkeypatch.setattr(quantiles, "HELD_BYTES", 100)
    assert sum(b.num_rows for b in quantiles._partial([batch, batch])) == 8


def test_batches_handed_on_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import quantiles

    monkeypatch.setattr(quantiles, "BATCH_BYTES", 5_000)
    sketches = []
    for i in range(20):
        sketches.append((f"g{i}", QuantileSketch(i)))
        sketches[-1][1].update(np.arange(200))
        assert abs(sketches[-1][1].nbytes - 1600) < 1000
    parts = list(quantiles._batches(sketches))
    assert sum(b.num_rows for b in parts) == 20 and max(b.nbytes for b in parts) < 5_000 + 2_000
    again = pa.Table.from_batches(list(quantiles._merge(parts)))
    assert again.num_rows == 20
