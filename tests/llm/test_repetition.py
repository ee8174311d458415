import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.repetition import repeated_words, repetition


def brute(text):
    words = re.findall(r"[^\W_]+", text.lower())
    marked = set()
    for i in range(len(words) - 4):
        if any(words[j : j + 5] == words[i : i + 5] for j in range(i)):
            marked |= set(range(i, i + 5))
    return len(words), len(marked)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "A", "c.", "-", "d_e", "é"]), max_size=60))
def test_against_brute_force(words):
    text = " ".join(words)
    assert repeated_words(text) == brute(text)


def test_definition():
    assert repeated_words("a a a a a") == (5, 0)
    assert repeated_words("a a a a a a") == (6, 5)
    assert repeated_words("one two three four five One, TWO three-four five") == (10, 5)
    assert repeated_words("one two three four") == (4, 0)
    assert repeated_words("x1_y2 漢字 ü") == (4, 0)


def test_rows(spark):
    long = "the same five words again " * 40_000
    rows = [(1, "w"), (1, "w"), (2, None), (3, ""), (4, long), (None, "a b c d e a b c d e")]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "id long, text string, n_words int, share double")
    got = sorted(map(repr, map(tuple, repetition(df, "id", "text").collect())))
    want = [(1, 1, 0, 0.0)] * 2 + [(2, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 200_000, 199_995, 199_995 / 200_000), (None, 10, 5, 0.5)]
    assert got == sorted(map(repr, want))
    assert repetition(df.limit(0), "id", "text").count() == 0
