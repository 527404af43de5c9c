"""The corpus pipeline: documents, through five stages, to token digests.

Each stage reads what the one before it kept. ``run`` writes every stage as
Parquet under the shared folder of the session (see
``quire.session.checkpoint_root``) and reads it back as the next one's input.

What a stage has materialised is needed until its result is written, so a stage
begins by deleting what the stages before it left: the disk holds the working
tables of one stage at a time.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, line_dedup, mixing, quality, simhash
from quire.session import cut_lineage, release_stages, stage_scope

SCOPE = "pipeline-work"


def stage(function):
    """A stage whose working tables go once the next stage begins."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_stages(spark, SCOPE)
        with stage_scope(SCOPE):
            return function(spark, docs, sf_dir)
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the host limits go from the rest."""
    return quality.clean(docs)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest document that holds them only."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.drop_near_duplicates(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as many times as the mix takes them."""
    return mixing.mix(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every kept text: count and digests of ids and decoded text."""
    return bpe.encode_digests(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: SQL cannot express the tokenizer or XXH64; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, uuid.uuid4().hex[:12]
    for i, (name, apply) in enumerate(STAGES[:-1]):
        result = apply(spark, docs, sf_dir)
        with stage_scope(f"pipeline-{own}-{i}"):
            docs = cut_lineage(result, name)
        if before is not None:      # the input of this stage has been read
            release_stages(spark, before)
        before = f"pipeline-{own}-{i}"
    return STAGES[-1][1](spark, docs, sf_dir)
