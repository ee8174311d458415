import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.packing import HarmonicPacker, pack_texts, read_capacities
from tidemark.llm.tokens import DEFAULT_TOKENIZER, token_counter, with_tokens


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(1, 40), st.lists(st.integers(0, 1000), max_size=200))
def test_packs_hold_everything_and_never_too_much(capacity, classes, sizes):
    p = HarmonicPacker(capacity, classes)
    used = {}
    for size in sizes:
        pieces = list(p.pieces(size))
        assert sum(x[3] for x in pieces) == size
        assert (len(pieces) > 1) == (size > capacity)
        assert [x[1] for x in pieces] == list(range(len(pieces)))
        assert [x[2] for x in pieces] == [capacity * i for i in range(len(pieces))]
        for pack, _, _, n in pieces:
            assert n > 0
            used[pack] = used.get(pack, 0) + n
    assert all(v <= capacity for v in used.values())
    assert sorted(used) == list(range(p.packs))


def test_room_is_used():
    r = random.Random(1)
    sizes = [max(1, int(r.lognormvariate(4.6, 0.9))) for _ in range(20_000)]
    for capacity in (512, 1024, 4096):
        p = HarmonicPacker(capacity)
        for s in sizes:
            list(p.pieces(s))
        assert sum(sizes) / (p.packs * capacity) > 0.97


def test_a_class_takes_its_number_of_texts():
    p = HarmonicPacker(100, 5)
    assert [p.place(s) for s in (40, 45, 35, 34, 60)] == [0, 0, 1, 1, 2]
    assert p.place(34) == 2  # the least room that is enough
    assert p.place(20) == 1


DOCS = [(1, "one two three"), (1, "one two three"), (2, ""), (3, None), (4, "word " * 3000), (5, "x" * 20_000), (6, "<|endoftext|> ü 漢字 \U0001f600")]


def docs(spark):
    return spark.createDataFrame([(*d, "c", 1, 2) for d in DOCS], "doc_id long, text string, pack_name string, n_tokens int, piece_no int")


def test_texts(spark):
    df = docs(spark)
    rows = pack_texts(df, "doc_id", "text", {"small": 64, "big": 4096}).collect()
    count = token_counter()
    want = {}
    for i, t in DOCS:
        if t:
            want[i] = want.get(i, 0) + count([t])[0]
    for name, capacity in (("small", 64), ("big", 4096)):
        mine = [r for r in rows if r["pack_name"] == name]
        got, packs = {}, {}
        for r in mine:
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
            packs[r["pack_id"]] = packs.get(r["pack_id"], 0) + r["n_tokens"]
        assert got == want and max(packs.values()) <= capacity
    assert pack_texts(df.limit(0), "doc_id", "text", {"a": 5}).count() == 0
    assert pack_texts(df, "doc_id", "text", {}).count() == 0
    with pytest.raises(ValueError):
        pack_texts(df, "doc_id", "text", {"a": 0})


def test_no_shuffle(spark):
    plan = pack_texts(docs(spark), "doc_id", "text", {"a": 64})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_token_counts_by_every_library(spark):
    import os

    folder = os.path.dirname(DEFAULT_TOKENIZER)
    texts = ["", "Hello world, hello!", "ü 漢字", "<|endoftext|>"]
    a = token_counter(DEFAULT_TOKENIZER)(texts)
    assert token_counter(f"{folder}/byte_bpe_50k.json")(texts) == a
    assert a[0] == 0 and a[3] > 1
    assert all(n > 0 for n in token_counter(f"{folder}/piece_bpe_32k.model")(texts)[1:])
    with pytest.raises(ValueError):
        token_counter("vocabulary.txt")
    got = with_tokens(docs(spark), "doc_id", "text", ["n_tokens"]).toDF("doc_id", "kept", "counted")
    assert {(r["doc_id"], r["kept"]) for r in got.collect()} == {(i, 1) for i in range(1, 7)}
    assert got.where("counted = 0").count() == 2


def test_capacities(spark, sf):
    assert read_capacities(spark, f"{sf}/pack_capacity.parquet") == {"short": 512, "medium": 1024, "long": 4096}


def test_divided_documents(spark, sf):
    from tidemark.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"] for r in with_tokens(docs, "doc_id", "text").where(F.col("n_tokens") > 4096).collect()}
    got = [r["doc_id"] for r in queries.p8_found(spark, sf).collect()]
    assert sorted(got) == sorted(want)
