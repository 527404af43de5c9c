"""Exact dedup as a stateful stream.

A stream over the files of a table keeps one state per digest, on disk
(RocksDB) and without expiry: how many rows had it, the row that stays (the
stable identifier) and where that row's bytes are (the content locator: file
and row number). The state is a streaming aggregate, so a task sends one row
per digest however many copies it has read, and a hot digest is no hot task.
A later run on the same store reads new files only and goes on from the state.

A digest alone proves nothing. Every row whose digest the state counts more
than once is a hit: the bytes at the locator are fetched and compared in full
with those of the row. A digest with a row that differs is settled by grouping
its rows by their whole normalised text.

Scale: no text goes into the state. Texts are shuffled once to meet their
digest's state (a join, whose large partitions Spark splits) and only hits are
compared. The store lies in the shared folder of the session, so the state
survives lost executors.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.common import quoted, without
from quire.session import cut_lineage, stage_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All stores of an executor share one bounded block cache and write buffer.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # A store per state partition: files are not padded in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # A batch uploads its changes, not whole snapshots.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_KEYS = "digest binary, n long, keep struct<doc_id: long, file: string, row: long>, batch long"
_RANK = ("doc_id", "file", "row")


def sha256(texts: pd.Series) -> pd.Series:
    """SHA-256 of each text (UTF-8 bytes), A-Z lower-cased; null counts as empty."""
    # bytes.lower changes A-Z only.
    return pd.Series([hashlib.sha256(bytes(t).lower() if t is not None else b"").digest() for t in texts])


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def located(rows: DataFrame, digest) -> DataFrame:
    """(doc_id, text, digest, file, row) of a table read from files."""
    own = F.pandas_udf(digest, "binary")(F.col("text").cast("binary"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("digest"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _stream_path(spark: SparkSession, source: str) -> str:
    """A stream reads folders or patterns: a single file becomes a pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{source[:-1]}[{source[-1]}]" if fs.getFileStatus(path).isFile() else source


def ingest(spark: SparkSession, source: str, store: str, digest=sha256, max_files: int | None = None) -> None:
    """Takes the files of ``source`` that the stream of ``store`` has not seen
    into its state, and writes the changed states of each micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = located(reader.parquet(_stream_path(spark, source)), digest).select("digest", "doc_id", "file", "row")
    kept = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct(*_RANK)).alias("keep"))

    def write(changed: DataFrame, batch: int) -> None:
        # A batch that runs again after a failure replaces its own files.
        (changed.withColumn("batch", F.lit(batch).cast("long"))
         .write.mode("overwrite").parquet(os.path.join(store, "keys", f"part={batch}")))

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        (kept.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(store, "stream")).start().awaitTermination())
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def states(spark: SparkSession, store: str) -> DataFrame:
    """(digest, n, keep): the newest state of every digest of ``store``."""
    keys = spark.read.schema(_KEYS).option("recursiveFileLookup", "true").parquet(os.path.join(store, "keys"))
    newest = keys.groupBy("digest").agg(F.max(F.struct("batch", "n", "keep")).alias("x"))
    return newest.select("digest", "x.n", "x.keep")


def compared(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Hits (rows whose digest occurs again): doc_id, text, digest, file, row
    and ``same``, whether the bytes equal those that the state points to."""
    again = keys.where("n > 1").select("digest", F.col("keep.file").alias("at_file"), F.col("keep.row").alias("at_row"))
    hits = cut_lineage(rows.join(again, "digest"), "dedup-hits")
    content = hits.where("file = at_file AND row = at_row").select("digest", F.col("text").alias("content"))
    raw, there = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("content"), F.lit(""))
    # The content is there unless a file went meanwhile: such a row is not the same.
    same = F.coalesce(F.when(raw == there, True).otherwise(normalised(F.col("text")) == normalised(F.col("content"))),
                      F.lit(False))
    return hits.join(content, "digest", "left").select("doc_id", "text", "digest", "file", "row", same.alias("same"))


def decide(spark: SparkSession, source: str, store: str, digest=sha256) -> DataFrame:
    """One row per row of ``source``: doc_id, keep_id, group_size, kept, digest, file, row."""
    rows, keys = located(spark.read.parquet(source), digest), cut_lineage(states(spark, store), "dedup-states")
    hits = compared(rows, keys)
    differ = cut_lineage(hits.where("NOT same").select("digest", "doc_id", "file", "row"), "dedup-differ")
    known = keys.select("digest", F.col("n").alias("group_size"), "keep")
    out = rows.drop("text").join(known, "digest", "left")
    if not differ.isEmpty():
        bad = cut_lineage(differ.select("digest").distinct(), "dedup-bad")
        texts = cut_lineage(rows.join(bad, "digest", "left_semi")
                            .select("doc_id", "digest", "file", "row", normalised(F.col("text")).alias("whole")),
                            "dedup-split")
        groups = texts.groupBy("digest", "whole").agg(F.count("*").alias("group_size"),
                                                      F.max(F.struct(*_RANK)).alias("keep"))
        split = texts.join(groups, ["digest", "whole"]).select(*out.columns)
        out = out.join(bad, "digest", "left_anti").unionByName(split)
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                      ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
                      "digest", "file", "row")


def deduplicate(spark: SparkSession, source: str, store: str | None = None, digest=sha256,
                max_files: int | None = None) -> DataFrame:
    """Decisions on every row of the Parquet table ``source`` (a file or a
    folder): doc_id, keep_id, group_size, kept, digest, file, row. ``store`` is
    a folder that later runs go on from (none: one of this application).

    Of equal texts the row with the largest doc_id stays; a null id is smaller
    than any, and rows that share the largest id go by file and row number, so
    exactly one row of each group has ``kept``. Null and empty texts are equal.
    Other columns of the table are not read. An empty table gives an empty one.
    """
    store = store or os.path.join(stage_root(spark), f"dedup-{os.urandom(6).hex()}")
    ingest(spark, source, store, digest, max_files)
    return decide(spark, source, store, digest)


def drop_copies(spark: SparkSession, source: str, **options) -> DataFrame:
    """The rows of ``source`` that stay, with the table's columns."""
    kept = deduplicate(spark, source, **options).where("kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    rows = spark.read.parquet(source)
    cols = [quoted(c) for c in without(rows, "__file", "__row")]
    rows = rows.select(*cols, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(kept, ["__file", "__row"]).drop("__file", "__row")


def op12(spark, sf_dir):
    return deduplicate(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
