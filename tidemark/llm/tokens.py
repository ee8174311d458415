"""Token counts by public tokenizers, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tidemark.scratch import col

#: Vocabulary used unless another path is given.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the byte-level BPE vocabularies split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def token_counter(path: str = DEFAULT_TOKENIZER, pattern: str = PATTERN) -> Callable[[Sequence[str]], list[int]]:
    """A function from texts to token counts; the kind of file decides the library.

    ``.tiktoken`` (rank file), ``.json`` (tokenizers) and ``.model``
    (sentencepiece) are known.  Strings of special tokens count as ordinary text.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = enc.encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(list(texts), add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(list(texts), num_threads=1)]
    raise ValueError(f"unknown kind of tokenizer file: {path}")


_shipped: set[tuple[str, str]] = set()


def ship_vocabulary(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file of the driver to the executors, which need not have it at that path; once per application."""
    key = spark.sparkContext.applicationId, path
    if key not in _shipped and os.path.isfile(path):
        spark.sparkContext.addFile(path)
        _shipped.add(key)


def local_vocabulary(path: str) -> str:
    """Where a worker finds a vocabulary: the file sent to it, else the path itself."""
    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.isfile(sent) else path


def with_tokens(df: DataFrame, ident: str, text: str, carry: Sequence[str] = (), *, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(ident, carry columns, n_tokens); a null or empty text has 0 tokens."""
    fields = [df.schema[c] for c in (ident, *carry)]
    ship_vocabulary(df.sparkSession, tokenizer)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_counter(local_vocabulary(tokenizer))
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = tokens([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [f"c{i}" for i in range(len(fields))] + ["n_tokens"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", n_tokens bigint"
    named = df.select(*[col(f.name).alias(f"c{i}") for i, f in enumerate(fields)], col(text).alias("txt"))
    out = named.mapInArrow(count, schema)
    return out.toDF(*[f.name for f in fields], "n_tokens")
