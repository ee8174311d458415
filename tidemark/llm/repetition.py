"""The share of a text that repeats earlier parts of the same text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.scratch import col

#: Words in succession that make a repetition.
WORDS = 5
_WORD = re.compile(r"[^\W_]+")


def repeated_words(text: str, size: int = WORDS) -> tuple[int, int]:
    """(words, repeated words) of a text.

    Words are unbroken runs of letters and digits in lower case.  A word is
    repeated if it lies in ``size`` successive words that also begin at an
    earlier word.  Work and memory grow linearly with the text.
    """
    words = _WORD.findall(text.lower())
    n = len(words)
    if n < size:
        return n, 0
    runs = list(zip(*[words[i:] for i in range(size)]))
    if len(set(runs)) == len(runs):
        return n, 0
    seen: set = set()
    repeated = end = 0
    for i, run in enumerate(runs):
        if run in seen:
            repeated += i + size - max(i, end)
            end = i + size
        else:
            seen.add(run)
    return n, repeated


def repetition(df: DataFrame, ident: str, text: str, *, size: int = WORDS) -> DataFrame:
    """(ident, n_words, n_repeated, share) for every row.

    Texts are judged one by one, whole, where they are read; nothing is
    shuffled.  Null texts, empty ones and those of fewer than ``size`` words have
    share 0.  Repeated rows give repeated results; other columns are ignored,
    whatever their names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [repeated_words(t or "", size) for t in b.column(1).to_pylist()]
            share = [r / n if n else 0.0 for n, r in found]
            cols = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["i", "n_words", "n_repeated", "share"])

    kind = df.schema[ident].dataType.simpleString()
    out = df.select(col(ident).alias("i"), col(text).alias("txt")).mapInArrow(run, f"i {kind}, n_words bigint, n_repeated bigint, share double")
    return out.withColumnRenamed("i", ident)
