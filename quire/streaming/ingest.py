"""Incremental ingest of MEDLINE files into the article store.

File source -> parse (A3/C1) -> per micro-batch: one row per pmid, then
insert-if-absent against the buckets that the batch touches (J2) -> commit. The
store itself is the dedup state, so streaming state stays empty however many
PMIDs arrive, and other writers of the store are seen too. A run is named by
the streaming query's id (kept in its checkpoint) and the batch number: a batch
that is run again after a failure is skipped if the manifest names it and
written anew otherwise, so a restart cannot insert a PMID twice and a new
checkpoint on the same store never touches what another one has written.
"""

from __future__ import annotations

import datetime as _dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import article_content
from quire.functions.vectors import hash_embed
from quire.operators.manifest import latest
from quire.operators.store import create_store, read_store, stage_insert
from quire.schemas import ARTICLE_STORE
from quire.session import cut_lineage
from quire.sources.medline import RECORD_SEP, map_medline, parse_records, record_blocks


def medline_stream(spark: SparkSession, src: str) -> DataFrame:
    """Mapped records, with ``arrival``: file time, file, place in the read."""
    raw = (spark.readStream.format("text").option("lineSep", RECORD_SEP)
           .option("recursiveFileLookup", "true").load(src))
    raw = raw.select(F.struct("_metadata.file_modification_time", "_metadata.file_path",
                              "_metadata.file_block_start").alias("file"), record_blocks(F.col("value")).alias("block"))
    raw = raw.filter(F.col("block").rlike(r"\S"))
    return map_medline(raw.select(parse_records(F.col("block")).alias("record"), "file"), keep=("file",))


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the streaming query that owns a checkpoint; survives restarts."""
    return json.loads(spark.read.text(os.path.join(checkpoint, "metadata")).first()[0])["id"]


def rows_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The ``rows`` (a written table) at some places, joined by the shorter of two
    lists, those of the rows wanted and of the others: a batch that is all new
    or all known takes no shuffle of its texts."""
    wanted = cut_lineage(places.select("place"), "ingest-wanted")
    if 2 * wanted.count() <= rows.count():
        return rows.join(wanted, "place", "left_semi")
    return rows.join(cut_lineage(rows.select("place").join(wanted, "place", "left_anti"), "ingest-other"),
                     "place", "left_anti")


def _batch_writer(store: str, checkpoint: str, run_ts: _dt.datetime, embed):
    def article_store_rows(new: DataFrame) -> DataFrame:
        return new.select("pmid", "title", "abstract",
                          embed(article_content(F.col("title"), F.col("abstract"))).alias("content_vector"),
                          F.lit(None).cast("string").alias("compound"),
                          F.lit(None).cast("string").alias("disease"),
                          F.lit(run_ts).cast("timestamp_ntz").alias("created_at"))

    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        run = f"stream-{query_id(spark, checkpoint)}-{batch_id}"
        if run in latest(spark, store).runs:     # committed before a restart
            return
        # Parsed once; who is first and who is stored is settled without the texts.
        placed = cut_lineage(batch.withColumn("place", F.monotonically_increasing_id()), "ingest-batch")
        # One row per pmid inside the batch: the first to arrive wins.
        first = placed.groupBy("pmid").agg(F.min(F.struct("file", "place")).alias("w")).select("pmid", "w.place")
        first = cut_lineage(first, "ingest-first")  # read by the joins
        stage_insert(spark, store, first, run, lambda new: article_store_rows(rows_at(placed, new))).commit()
    return write


def start_ingest(spark: SparkSession, src: str, store: str, checkpoint: str,
                 run_ts: _dt.datetime, embed=hash_embed, available_now: bool = True):
    """Start the ingest query; with ``available_now`` it stops when the files
    present at start are done."""
    create_store(spark, store, ARTICLE_STORE)
    # What a batch need not have is left out here: its plan is fixed before the writer sees it.
    w = (medline_stream(spark, src).select("pmid", "title", "abstract", "file").writeStream
         .foreachBatch(_batch_writer(store, checkpoint, run_ts, embed))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def run_ingest(spark: SparkSession, src: str, store: str, checkpoint: str,
               run_ts: _dt.datetime, embed=hash_embed) -> DataFrame:
    q = start_ingest(spark, src, store, checkpoint, run_ts, embed)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return read_store(spark, store, ARTICLE_STORE)
