"""Topic source (A5): each call of the reference becomes one row of a table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.text import is_blank
from quire.schemas import TOPIC


def topics_frame(spark: SparkSession, rows) -> DataFrame:
    """A table of given rows; made from Arrow, so that Spark knows its size."""
    schema = to_arrow_schema(TOPIC)
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), TOPIC)


def read_topics(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A topic table from files (Parquet, CSV, JSON, ...), with the declared
    schema; an optional ``pmids`` column of a Parquet table is kept."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "parquet":
        found = reader.load(path)
        names = [*TOPIC.fieldNames(), *(c for c in ("pmids",) if c in found.columns)]
        return found.select(*names)
    return reader.schema(TOPIC).load(path)


def valid_topics(topics: DataFrame) -> DataFrame:
    """P5: blank compound or disease is rejected."""
    return topics.filter(~is_blank(F.col("compound")) & ~is_blank(F.col("disease")))
