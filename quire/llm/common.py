"""Small helpers shared by the training-data operators.

``cut_lineage`` (a written Parquet table in the folder that
``spark.checkpoint.dir`` names) comes from the session module; nothing here
touches a machine-local folder.
"""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.session import cut_lineage

ROW_ID = "__row"
#: Stands for a null doc_id inside an operator: sorts after every real id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str = "doc_id"):
    """``column`` as long; null becomes ``NULL_ID``."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_of(column):
    """Inverse of ``id_key``."""
    return F.when(column != F.lit(NULL_ID), column)


def without(df: DataFrame, *names: str) -> list[str]:
    """``df``'s columns except ``names`` (compared without case, as Spark does)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str):
    return F.col(f"`{name.replace('`', '``')}`")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a row id, so that later joins identify a row
    even where ids, texts or whole rows repeat. Ids differ between runs;
    results never depend on them except to tell equal rows apart."""
    kept = [quoted(c) for c in without(df, ROW_ID)]
    return cut_lineage(df.select(*kept, F.monotonically_increasing_id().alias(ROW_ID)), name)


def per_worker(key: str, make):
    """One value per Python worker process (vocabularies, lookup tables)."""
    store = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
