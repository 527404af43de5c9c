"""History gate, newest first, zero-paper analyses, refresh."""
import datetime as dt

from quire.operators.history import analysis_history, latest_analysis, plan_topics
from quire.schemas import ANALYSIS_STORE


def _store(spark):
    return spark.createDataFrame([
        ("a", "b", None, "old", dt.datetime(2024, 1, 1), 3),
        ("a", "b", None, "new", dt.datetime(2024, 2, 1), 5),
        ("c", "d", None, "empty", dt.datetime(2024, 1, 20), 0),
        (None, "e", None, "nullc", dt.datetime(2024, 1, 5), 1),
    ], ANALYSIS_STORE)


def _topics(spark):
    return spark.createDataFrame([
        (0, "a", "b", None, None, False), (1, "c", "d", None, None, False),
        (2, "x", "y", None, None, False), (3, "a", "b", None, None, True),
        (4, None, "e", None, None, False)],
        "topic_id int, compound string, disease string, start_year int, end_year int, refresh boolean")


def test_gate_splits_without_overlap_or_loss(spark):
    r = {x["topic_id"]: x["route"] for x in plan_topics(_topics(spark), _store(spark)).collect()}
    assert r == {0: "history", 1: "analyze", 2: "analyze", 3: "analyze", 4: "history"}
    strict = {x["topic_id"]: x["route"] for x in
              plan_topics(_topics(spark), _store(spark), strict_history=True).collect()}
    assert strict[1] == "history"


def test_latest_and_history_order(spark):
    latest = {(x["compound"], x["disease"]): x["content"] for x in latest_analysis(_store(spark)).collect()}
    assert latest[("a", "b")] == "new"
    h = analysis_history(_store(spark), _topics(spark).filter("topic_id = 0")).orderBy("rank").collect()
    assert [x["content"] for x in h] == ["new", "old"]
    assert h[0]["analysis_time"] == "2024-02-01 00:00:00"


def test_rank_equals_row_number_in_a_topic_analysed_often(spark):
    """240,000 analyses of one topic, every store column kept."""
    from pyspark.sql import Window, functions as F
    store = spark.range(240_000).select(
        F.lit("a").alias("compound"), F.lit("b").alias("disease"), F.array(F.lit(1.0).cast("float")).alias("content_vector"),
        F.concat(F.lit("c"), F.col("id")).alias("content"),
        F.when(F.col("id") % 1000 > 0, F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,(id * 7919) % 900000)"))
        .alias("created_at"), F.col("id").alias("total_papers"))
    got = analysis_history(store, _topics(spark).filter("topic_id = 0")).select("rank", "content", "created_at", "total_papers")
    want = store.select(F.row_number().over(Window.orderBy(F.desc("created_at"), "content")).alias("rank"),
                        "content", "created_at", "total_papers")
    assert got.count() == 240_000 and got.exceptAll(want).count() == 0
