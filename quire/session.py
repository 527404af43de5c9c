"""Session helpers: one place for the settings every job relies on.

On a cluster the session is created by the platform; ``configure`` only adds
settings that are not already present, so cluster values win.
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The annotation JSON may repeat a key; the last one wins, as in Python.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "quire",
                  shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g")
               # Checkpoint files of collected DataFrames are removed.
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def ship_code() -> None:
    """Pickle this package's functions by value, so Python workers on any
    executor run them without the package being installed there."""
    import sys

    from pyspark import cloudpickle

    try:
        cloudpickle.register_pickle_by_value(sys.modules["quire"])
    except (ValueError, KeyError):
        pass


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults that are runtime-settable and not yet set."""
    ship_code()
    for k, v in DEFAULTS.items():
        try:
            if spark.conf.get(k, None) in (None, ""):
                spark.conf.set(k, v)
        except Exception:  # static conf on a running session: keep the cluster value
            pass
    # These two matter for exact results, so they are always pinned.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none (tests, local runs) it is a folder under the
    warehouse, on the session's default filesystem; a local one is refused
    unless the master is local, since other executors would not see it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
        jvm = sc._jvm
        fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.getScheme() == "file" and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique directory name under the checkpoint root."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_SCOPES: list[str] = []


@contextlib.contextmanager
def stage_scope(name: str):
    """Stages materialised inside go to a folder of their own (``name``), which
    ``release_stages`` can delete while the others stay. Gives the names of all
    scopes around, outermost first, which ``release_stages`` takes."""
    _SCOPES.append(name)
    try:
        yield tuple(_SCOPES)
    finally:
        _SCOPES.pop()


def stage_root(spark: SparkSession, *scopes: str) -> str:
    """Folder of this application's materialised stages (under the checkpoint root)."""
    return os.path.join(checkpoint_root(spark), "quire-stages", spark.sparkContext.applicationId, *scopes)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back: the plan runs once (``Dataset.checkpoint`` runs it twice
    and writes row objects), the files survive executor loss, and later reads
    are column-pruned. Never a local checkpoint. ``release_stages`` removes
    them once the results that read them are written."""
    path = os.path.join(stage_root(df.sparkSession, *_SCOPES), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession, *scopes: str) -> bool:
    """Delete this application's materialised stages (any Hadoop filesystem), or
    only those of a scope. Call it after the DataFrames built on them have been
    written or collected."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_root(spark, *scopes))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True)) if fs.exists(path) else False
