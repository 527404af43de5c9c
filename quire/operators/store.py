"""Parquet stores: B1-B3, J2, W3, A1, A2.

Layout: ``<store>/run_id=<run>/[bucket=<b>/]part-*.parquet`` and a commit
manifest (``operators/manifest.py``). A run is written to a directory of its own
and seen once the manifest names it, so a failed job leaves nothing that a
reader sees and no job overwrites what another reads.

The article store is bucketed by a hash of the pmid: insert-if-absent reads the
pmid column of those buckets only that the batch touches. Plain Parquet has no
unique constraint, so a writer compares its rows with the store it has seen
and, if another writer committed meanwhile, with that writer's runs alone before
it tries again: first commit wins, whatever the interleaving.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.vectors import hash_embed
from quire.functions.text import article_content
from quire.operators import manifest
from quire.operators.manifest import Manifest
from quire.schemas import ANALYSIS_STORE, ARTICLE_STORE
from quire.session import cut_lineage

#: Buckets of a new article store; more for stores beyond some 10^9 articles.
BUCKETS = 32
PLACE = [T.StructField("run_id", T.StringType()), T.StructField("bucket", T.IntegerType())]


def create_store(spark: SparkSession, path: str, schema: T.StructType, buckets: int | None = None) -> Manifest:
    """Create an empty store if missing (existing data is kept). Stores
    whose key is the pmid are bucketed by it."""
    found = manifest.latest(spark, path)
    if found is not None:
        return found
    if buckets is None:
        buckets = BUCKETS if "pmid" in schema.fieldNames() else 0
    manifest.publish(spark, path, Manifest(0, buckets))      # another creator may be first
    return manifest.latest(spark, path)


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1/A2: scan with the declared schema (no inference, no run_id column)."""
    seen = manifest.latest(spark, path)
    if seen is None:
        raise ValueError(f"no store at {path}")
    return read_runs(spark, path, schema, seen.runs.values()).select(*schema.fieldNames())


def read_runs(spark: SparkSession, path: str, schema: T.StructType, runs: Iterable[str]) -> DataFrame:
    """The rows of some runs, with their ``run_id`` and ``bucket``."""
    full = T.StructType(schema.fields + PLACE)
    paths = [os.path.join(path, r) for r in runs]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*paths)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_run(df: DataFrame, path: str, name: str, buckets: int) -> str:
    """Write a run that no manifest names yet; returns its directory. Buckets
    are rebalanced: small ones share a task, a large one is split."""
    directory = f"run_id={name}-{uuid.uuid4().hex[:8]}"
    if buckets:
        df = df.withColumn("bucket", bucket_of(F.col("pmid"), buckets)).hint("rebalance", "bucket")
        df.write.partitionBy("bucket").parquet(os.path.join(path, directory))
    else:
        df.write.parquet(os.path.join(path, directory))
    return directory


def append_run(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """B2: add a run without looking at others (a log); returns its name."""
    spark, name = df.sparkSession, run_id or uuid.uuid4().hex[:12]
    seen = manifest.latest(spark, path) or create_store(spark, path, df.schema)
    if name in seen.runs:
        raise ValueError(f"run {name} is stored already")
    directory = write_run(df, path, name, seen.buckets)
    while not manifest.publish(spark, path, seen.with_run(name, directory)):
        seen = manifest.latest(spark, path)
    return name


def article_rows(fetched: DataFrame, run_ts: _dt.datetime, embed=hash_embed) -> DataFrame:
    """W3 + C3/C4: one ``ARTICLE_STORE`` row per pmid of a batch; inside the batch
    the first write wins in (topic_id, rank) order, keeping that topic's
    labels. ``min_by`` aggregates partially map-side, so a pmid that many
    topics share is no hot spot."""
    order = F.struct(F.col("topic_id"), F.col("rank"))
    first = (fetched.groupBy("pmid")
             .agg(F.min_by(F.struct("title", "abstract", "compound", "disease"), order).alias("w"))
             .select("pmid", "w.*"))
    return first.select(
        "pmid", "title", "abstract",
        embed(article_content(F.col("title"), F.col("abstract"))).alias("content_vector"),
        "compound", "disease",
        F.lit(run_ts).cast("timestamp_ntz").alias("created_at"))


def new_articles(rows: DataFrame, stored: DataFrame, buckets: int) -> DataFrame:
    """Rows whose pmid is not stored yet (insert-if-absent).

    The store grows without bound while a batch is small: only buckets that
    the batch touches are listed and read, the batch's pmids cut their pmid
    column down to those that collide, then the anti join has two small sides.
    ``rows`` is read three times, so pass a written table."""
    touched = [r[0] for r in rows.select(bucket_of(F.col("pmid"), buckets)).distinct().collect()]   # <= buckets
    hits = (stored.filter(F.col("bucket").isin(touched)).select("pmid")
            .join(rows.select("pmid"), "pmid", "left_semi"))
    return rows.join(hits, "pmid", "left_anti")


@dataclass
class StagedInsert:
    """A written run that waits for its commit."""

    spark: SparkSession
    path: str
    name: str
    seen: Manifest
    directory: str

    def commit(self) -> str | None:
        """Publish the run; returns its directory. Where others committed since
        ``seen``, rows that they store are taken out first. A run whose
        name is committed already (a retry) is dropped: None."""
        while not manifest.publish(self.spark, self.path, self.seen.with_run(self.name, self.directory)):
            now = manifest.latest(self.spark, self.path)
            mine, old = os.path.join(self.path, self.directory), self.directory
            if self.name in now.runs:
                manifest.delete(self.spark, mine)
                return None
            others = [d for n, d in now.runs.items() if n not in self.seen.runs]
            rows = read_runs(self.spark, self.path, ARTICLE_STORE, [old]).select(*ARTICLE_STORE.fieldNames())
            rest = new_articles(rows, read_runs(self.spark, self.path, ARTICLE_STORE, others), now.buckets)
            self.directory = write_run(rest, self.path, self.name, now.buckets)
            manifest.delete(self.spark, mine)
            self.seen = now
        return self.directory


def stage_insert(spark: SparkSession, path: str, rows: DataFrame, name: str | None = None,
                 finish: Callable[[DataFrame], DataFrame] = lambda new: new) -> StagedInsert:
    """Write the new ones of ``rows`` (a written table, one row per pmid) as a
    run that is not committed yet. ``finish`` makes ``ARTICLE_STORE`` rows of
    them, so that costly columns are computed for new articles only."""
    seen, name = create_store(spark, path, ARTICLE_STORE), name or uuid.uuid4().hex[:12]
    stored = read_runs(spark, path, ARTICLE_STORE, seen.runs.values())
    new = finish(new_articles(rows, stored, seen.buckets)).select(*ARTICLE_STORE.fieldNames())
    return StagedInsert(spark, path, name, seen, write_run(new, path, name, seen.buckets))


def store_articles(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """B1: append the new articles; returns what was written. ``rows`` (match,
    fetch, embed) are computed once."""
    directory = stage_insert(spark, path, cut_lineage(rows, "article-rows")).commit()
    return read_runs(spark, path, ARTICLE_STORE, [directory]).select(*ARTICLE_STORE.fieldNames())


def store_analyses(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """B2: append, never deduplicate (the store is a log)."""
    create_store(spark, path, ANALYSIS_STORE)
    append_run(rows.select(*ANALYSIS_STORE.fieldNames()), path)
