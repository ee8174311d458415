import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence as dv


def test_distance():
    assert dv.jensen_shannon({"a": 1}, {"a": 5}) == 0
    assert dv.jensen_shannon({"a": 1}, {"b": 5}) == 1
    assert dv.jensen_shannon({}, {}) == 0 and dv.jensen_shannon({"a": 1}, {}) == 1
    assert dv.jensen_shannon({"a": 1, "b": 1}, {"a": 1}) == pytest.approx(0.5579, abs=1e-3)


def test_classes():
    assert dv.character_classes("aB 1漢!²") == {"lower": 1, "upper": 1, "space": 1, "digit": 2, "letter": 1, "other": 1}


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(dv, "_HELD", 3)
    normal = "the cat and the dog went to the sea and saw a ship on the water with a man in it"
    rows = [(i, normal, "en") for i in range(50)] + [(90, "zq " * 40, "en"), (91, None, "en"), (92, "", None), (93, "short", "en"), (94, "zq " * 40, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n_words int, kind string")
    got = {r["doc_id"]: r for r in dv.divergence(df, "doc_id", "text", F.col("lang")).collect()}
    assert len(got) == len(rows)
    assert got[90]["word_distance"] > got[1]["word_distance"] + 0.5 and got[90]["class_distance"] > got[1]["class_distance"]
    assert all(got[i]["word_distance"] is None for i in (91, 92, 93)) and got[94]["word_distance"] == 0
    assert dv.divergence(df.limit(0), "doc_id", "text", F.col("lang")).count() == 0


def test_rare_languages_share_a_reference(spark, monkeypatch):
    monkeypatch.setattr(dv, "LANGUAGES", 1)
    rows = [("a", "x y z"), ("a", "x"), ("b", "q"), ("c", "q r")]
    got = dv.language_references(spark.createDataFrame(rows, "lang string, txt string"))
    assert {(r["lang"], r["item"], r["n"]) for r in got.where("kind = 'word'").collect()} == {("a", "x", 2), ("a", "y", 1), ("a", "z", 1), ("", "q", 2), ("", "r", 1)}
