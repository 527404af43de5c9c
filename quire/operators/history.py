"""History: R6, W5, J4, C10, P4, S1.

Topic identity is ``(compound, disease)`` compared null-safely (a missing
value matches a missing value, as ``filter_by(x=None)`` does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"  # strftime('%Y-%m-%d %H:%M:%S')


def _same_topic(left: DataFrame, right: DataFrame):
    return (left["compound"].eqNullSafe(right["compound"])
            & left["disease"].eqNullSafe(right["disease"]))


def analysis_history(store: DataFrame, topics: DataFrame) -> DataFrame:
    """R6 for a table of topics: every stored analysis of each topic, newest
    first as ``rank`` (S1), vector dropped and ``analysis_time`` added (C10)."""
    t = topics.select("topic_id", "compound", "disease").alias("t")
    s = store.select("compound", "disease", "content", "created_at", "total_papers").alias("s")
    j = s.join(t, _same_topic(s, t)).select(
        "t.topic_id", "s.compound", "s.disease", "s.content", "s.created_at", "s.total_papers")
    # A topic analysed very often must not land whole in one task: rows are
    # numbered within (topic, hour), after the rows of the topic's later hours,
    # which a partial aggregate counts. Rows without a time come last.
    j = j.withColumn("_hour", F.coalesce(F.date_trunc("hour", F.col("created_at").cast("timestamp")).cast("long"),
                                         F.lit(-(2**62))))
    hours = j.groupBy("topic_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("topic_id").orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("topic_id", "_hour", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    own = F.row_number().over(Window.partitionBy("topic_id", "_hour").orderBy(F.desc("created_at"), F.asc("content")))
    return (j.join(hours, ["topic_id", "_hour"])
            .withColumn("rank", (F.col("_later") + own).cast("int"))
            .drop("_hour", "_later")
            .withColumn("analysis_time", F.date_format("created_at", TIME_FORMAT)))


def latest_analysis(store: DataFrame, include_empty: bool = True) -> DataFrame:
    """The newest analysis per (compound, disease); ``max_by`` is a
    partial aggregate, so a topic analysed very often is no hot spot.
    With ``include_empty=False`` zero-paper analyses are ignored (D8)."""
    s = store if include_empty else store.filter(F.col("total_papers") > 0)
    return (s.groupBy("compound", "disease")
            .agg(F.max_by(F.struct("created_at", "content", "total_papers"),
                          F.struct("created_at", "content")).alias("h"))
            .select("compound", "disease", "h.created_at", "h.content", "h.total_papers"))


def plan_topics(topics: DataFrame, store: DataFrame, strict_history: bool = False) -> DataFrame:
    """``route`` = 'history' when a usable stored analysis exists and the
    topic does not ask for ``refresh``; else 'analyze'. Zero-paper analyses
    count as history only with ``strict_history``."""
    latest = latest_analysis(store, include_empty=strict_history).alias("h")
    t = topics.alias("t")
    j = t.join(latest, _same_topic(t, latest), "left")
    has = F.col("h.created_at").isNotNull() & ~F.coalesce(F.col("t.refresh"), F.lit(False))
    return j.select("t.*", F.when(has, "history").otherwise("analyze").alias("route"),
                    F.col("h.created_at").alias("history_time"),
                    F.col("h.content").alias("history_content"),
                    F.col("h.total_papers").alias("history_papers"))
