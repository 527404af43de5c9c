"""Corpus sources: the article view over ``documents`` and id fetch.

Only the columns a query needs are selected, so Parquet column pruning keeps
the scan narrow (``ReadSchema`` shows just ``doc_id``/``text`` for matching).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import DEFAULT_FALLBACK, parse_pub_date, with_fallback


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Use every core on small inputs: when the scan yields fewer splits than
    the default parallelism (one row group, say), deal rows round-robin over
    that many partitions. A large input already has more splits than cores and
    is returned as is, so it is never shuffled here."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def articles(documents: DataFrame, fallback: _dt.datetime = DEFAULT_FALLBACK,
             dp: Column | None = None) -> DataFrame:
    """Article rows (``ARTICLE`` schema plus ``doc_id`` and raw ``dp``). ``dp``:
    the raw publication date over the documents' columns (default: none)."""
    dp = F.lit("") if dp is None else dp
    text = F.coalesce(F.col("text"), F.lit(""))
    title = F.split_part(text, F.lit("\n"), F.lit(1))
    d = F.col("doc_id")
    return (documents
            .select("doc_id", "text", "source", "lang")
            .select(
                d,
                d.cast("string").alias("pmid"),
                title.alias("title"),
                F.expr("substring(coalesce(text, ''), length(split_part(coalesce(text, ''), "
                       "'\\n', 1)) + 2)").alias("abstract"),
                F.array().cast("array<string>").alias("authors"),
                F.coalesce(F.col("source"), F.lit("")).alias("journal"),
                F.array(F.coalesce(F.col("lang"), F.lit(""))).alias("keywords"),
                dp.alias("dp"))
            .withColumn("publication_date_parsed", parse_pub_date(F.col("dp")))
            .withColumn("publication_date",
                        with_fallback(F.col("publication_date_parsed"), fallback))
            .withColumn("conclusion", F.lit(None).cast("string"))
            .withColumn("effect_type", F.lit(None).cast("string"))
            .withColumn("evidence_strength", F.lit(None).cast("string")))


def fetch_articles(arts: DataFrame, ids: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Full rows for an id list (column ``pmid``; extra ``keep`` columns
    such as ``topic_id``/``rank`` are carried). Unknown ids vanish; an empty
    list gives an empty result. Spark broadcasts the list when it is small."""
    ids = ids.select("pmid", *keep)
    return arts.join(ids, "pmid") if keep else arts.join(ids.distinct(), "pmid", "left_semi")
