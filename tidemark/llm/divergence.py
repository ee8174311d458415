"""How far a text's characters and common words are from those of its language."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import col

#: Most frequent words per language that are told apart; all others count as one.
COMMON_WORDS = 200
#: Languages that have a reference of their own; the rest share one.
LANGUAGES = 200
#: Texts with fewer words are not judged.
MIN_WORDS = 20
#: Counts a task holds before it hands them on.
_HELD = 200_000
_WORD = re.compile(r"[^\W_]+")


def character_classes(text: str) -> Counter:
    """Numbers of upper- and lower-case letters, other letters, digits, white space and other characters."""
    out: Counter = Counter()
    for ch, n in Counter(text).items():
        out[_class(ch)] += n
    return out


@cache
def _class(ch: str) -> str:
    """Class of a character by its Unicode category."""
    kind = unicodedata.category(ch)
    if kind in ("Lu", "Ll"):
        return "upper" if kind == "Lu" else "lower"
    if kind[0] in "LN":
        return "letter" if kind[0] == "L" else "digit"
    return "space" if kind[0] == "Z" or ch in "\t\n\v\f\r" else "other"


def jensen_shannon(p: dict, q: dict) -> float:
    """Distance (0 to 1, the square root of the divergence in bits) of two tables of counts."""
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 1.0 if a or b else 0.0
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, total / 2))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(held)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([held[k] for k in keys], pa.int64())], ["lang", "kind", "item", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for word, n in Counter(_WORD.findall(text.lower())).items():
                held[lang, "word", word] += n
            for c, n in character_classes(text).items():
                held[lang, "class", c] += n
            if len(held) > _HELD:
                yield flush()
                held.clear()
    if held:
        yield flush()


def language_references(texts: DataFrame) -> DataFrame:
    """(lang, kind, item, n) of the language references, from all texts (lang, txt).

    Tasks count before the shuffle.  At most LANGUAGES + 1 languages with
    COMMON_WORDS words and six character classes each come out.
    """
    counts = texts.mapInArrow(_count, "lang string, kind string, item string, n bigint")
    counts = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    size = counts.where("kind = 'class'").groupBy("lang").agg(F.sum("n").alias("size"))
    own = F.broadcast(size.orderBy(F.desc("size"), "lang").limit(LANGUAGES).select(F.col("lang").alias("own")))
    named = counts.join(own, F.col("lang") == F.col("own"), "left")
    named = named.groupBy(F.coalesce("own", F.lit("")).alias("lang"), "kind", "item").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    ranked = named.withColumn("r", F.row_number().over(top))
    common = ranked.where(F.col("r") <= COMMON_WORDS).drop("r")
    rest = named.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n"))
    return common.unionByName(rest.select("lang", F.lit("total").alias("kind"), F.lit("").alias("item"), "n"))


def divergence(df: DataFrame, ident: str, text: str, language: Column) -> DataFrame:
    """(ident, n_words, class_distance, word_distance) for every row.

    Both are Jensen-Shannon distances to the reference of the row's language,
    which is made of all texts of that language in ``df``.  Texts with fewer than
    MIN_WORDS words, null ones included, are not judged: their distances are null.
    Null languages share the reference of those too rare to have one.
    """
    rows = df.select(col(ident).alias("i"), F.coalesce(language, F.lit("")).alias("lang"), F.coalesce(col(text), F.lit("")).alias("txt"))
    tables: dict = {}
    for r in language_references(rows.select("lang", "txt")).collect():  # about 40,000 short rows at most
        tables.setdefault(r["lang"], {"word": {}, "class": {}, "total": {}})[r["kind"]][r["item"]] = r["n"]
    for t in tables.values():
        t["word"][""] = max(0, t.pop("total").get("", 0) - sum(t["word"].values()))
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for lang, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = _WORD.findall(t.lower())
                ref = tables.get(lang) or tables.get("")
                if len(words) < MIN_WORDS or ref is None:
                    found.append((len(words), None, None))
                    continue
                common = ref["word"]
                mine = Counter(w if w in common else "" for w in words)
                found.append((len(words), jensen_shannon(character_classes(t), ref["class"]), jensen_shannon(mine, common)))
            cols = [pa.array(x, k) for x, k in zip(zip(*found), (pa.int64(), pa.float64(), pa.float64()))] if found else [pa.array([], k) for k in (pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["i", "n_words", "class_distance", "word_distance"])

    out = rows.mapInArrow(run, f"i {kind}, n_words bigint, class_distance double, word_distance double")
    return out.withColumnRenamed("i", ident)
