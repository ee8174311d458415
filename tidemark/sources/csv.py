"""Reading CSV with the engine's conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import col


def read_csv(
    spark: SparkSession, path: str, *, header: bool = True, delim: str = ",", schema: str | T.StructType | None = None
) -> DataFrame:
    """A CSV file or folder as a DataFrame.

    Names are lower-cased; without a header they are ``column_1`` and so on.
    Types are inferred from all rows unless ``schema`` is given; large jobs should
    give one, which saves that pass.  An empty cell is the empty string in a
    string column and null in others.
    """
    reader = spark.read.option("header", header).option("sep", delim).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    names = [f"column_{i + 1}" for i in range(len(df.columns))] if not header and schema is None else [c.strip().lower() for c in df.columns]
    df = df.toDF(*names)
    blank = [F.coalesce(col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema.fields]
    return df.select(*blank)
