"""End-to-end plans: R7 analyse topics, R8 answer topics (J4 -> R1 -> R7 -> U1),
and the four caller-facing tools of the reference (K1).

Everything is one lazy plan; shuffle boundaries are the postings aggregate,
the per-topic scoring aggregate, the per-topic top-k and the per-topic report
aggregate. After the top-k every per-topic group is bounded by k.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.annotate import annotate_lexicon, annotate_recorded
from quire.operators.history import TIME_FORMAT, plan_topics
from quire.operators.match import search_literature
from quire.operators.report import analysis_rows, topic_reports
from quire.operators.store import article_rows, create_store, read_store, store_analyses, store_articles
from quire.schemas import ANALYSIS_STORE, ARTICLE_STORE
from quire.session import cut_lineage
from quire.sources.corpus import fetch_articles
from quire.sources.topics import valid_topics

RUN_TS = _dt.datetime(2024, 6, 1)
MAX_RESULTS = 5


def fetch_ranked(arts: DataFrame, topics: DataFrame, effect_terms, k: int = MAX_RESULTS, **kw) -> DataFrame:
    """R1 + A4: the top-k articles of every topic with their full rows and the
    topic labels: (topic_id, rank, score, compound, disease, pmid, title, ...)."""
    vt = valid_topics(topics)
    ranked = search_literature(arts, vt, effect_terms, k, **kw)
    return _labelled(arts, vt, ranked.select("pmid", "topic_id", "rank", "score"))


def fetch_given(arts: DataFrame, topics: DataFrame) -> DataFrame:
    """A4 for topics that name their articles (column ``pmids``): the same rows
    as ``fetch_ranked``, ranked by place in the list (a repeated id counts
    once, at its first place). Unknown ids vanish."""
    vt = valid_topics(topics)
    given = (vt.select("topic_id", F.posexplode(F.array_distinct("pmids")).alias("i", "pmid"))
             .select("pmid", "topic_id", (F.col("i") + 1).alias("rank"), F.lit(None).cast("double").alias("score")))
    return _labelled(arts, vt, given)


def _labelled(arts: DataFrame, topics: DataFrame, ranked: DataFrame) -> DataFrame:
    # Written first: Spark then knows how few rows there are and scans the
    # corpus against them instead of shuffling its texts.
    ranked = cut_lineage(ranked, "ranked")
    fetched = fetch_articles(arts, ranked, keep=("topic_id", "rank", "score"))
    return fetched.join(topics.select("topic_id", "compound", "disease"), "topic_id")


def analyze_topics(arts: DataFrame, topics: DataFrame, effect_terms, responses: DataFrame | None = None,
                   k: int = MAX_RESULTS, run_ts: _dt.datetime = RUN_TS, on_error: str = "fail_topic",
                   annotator: str = "recorded", **kw) -> tuple[DataFrame, DataFrame]:
    """R7 for a topic table: (reports, annotated articles). Topics with a
    ``pmids`` column are analysed on those articles, others on a search."""
    fetched = (fetch_given(arts, topics) if "pmids" in topics.columns
               else fetch_ranked(arts, topics, effect_terms, k, **kw))
    fetched = cut_lineage(fetched, "fetched")  # at most k rows per topic, read by both sides of the next join
    if annotator == "recorded":
        annotated = annotate_recorded(fetched, responses)
    elif annotator == "lexicon":
        annotated = annotate_lexicon(fetched)
    else:
        raise ValueError("annotator must be 'recorded' or 'lexicon'")
    reports = topic_reports(valid_topics(topics), annotated, run_ts, on_error)
    return reports, annotated


def history_store_rows(arts: DataFrame, responses: DataFrame, effect_terms,
                       runs, **kw) -> DataFrame:
    """``ANALYSIS_STORE`` rows of earlier analyses, computed from the corpus in
    one pass (each run is a topic row with its own timestamp)."""
    spark = arts.sparkSession
    t = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], False) for r in runs],
                              "topic_id int, compound string, disease string, "
                              "start_year int, end_year int, refresh boolean")
    when = spark.createDataFrame([(r[0], r[5]) for r in runs], "topic_id int, ts timestamp_ntz")
    reports, _ = analyze_topics(arts, t, effect_terms, responses, on_error="skip", **kw)
    reports = (reports.join(F.broadcast(when), "topic_id")
               .withColumn("analysis_date", F.col("ts")).drop("ts"))
    return analysis_rows(reports)


def answer_topics(arts: DataFrame, topics: DataFrame, analysis_store: DataFrame, effect_terms,
                  responses: DataFrame | None = None, k: int = MAX_RESULTS,
                  run_ts: _dt.datetime = RUN_TS, on_error: str = "fail_topic",
                  strict_history: bool = False, annotator: str = "recorded", **kw) -> DataFrame:
    """R8 (flagship): history first, new analysis for the rest, merged.

    (topic_id, compound, disease, provenance, status, analysis_time,
    total_papers, content)."""
    vt = valid_topics(topics)
    # One row per topic, written so that both branches below share one lookup.
    routed = cut_lineage(plan_topics(vt, analysis_store, strict_history))
    todo = routed.filter(F.col("route") == "analyze").select(*topics.columns)
    reports, _ = analyze_topics(arts, todo, effect_terms, responses, k, run_ts, on_error,
                                annotator, **kw)
    return _answers(routed, reports)


def _answers(routed: DataFrame, reports: DataFrame) -> DataFrame:
    """Stored answers and fresh ones."""
    hist = (routed.filter(F.col("route") == "history")
            .select("topic_id", "compound", "disease",
                    F.lit("history").alias("provenance"), F.lit("ok").alias("status"),
                    F.date_format("history_time", TIME_FORMAT).alias("analysis_time"),
                    F.col("history_papers").alias("total_papers"),
                    F.col("history_content").alias("content")))
    fresh = reports.select("topic_id", "compound", "disease", "provenance", "status",
                           F.date_format("analysis_date", TIME_FORMAT).alias("analysis_time"),
                           "total_papers", "content")
    return hist.unionByName(fresh)


def stored_articles_of_run(arts: DataFrame, topics: DataFrame, effect_terms,
                           k: int = MAX_RESULTS, run_ts: _dt.datetime = RUN_TS, **kw) -> DataFrame:
    """B1 input of one run: the fetched articles, first write wins."""
    return article_rows(fetch_ranked(arts, topics, effect_terms, k, **kw), run_ts)


def answer_and_store(arts: DataFrame, topics: DataFrame, article_path: str, analysis_path: str, effect_terms,
                     responses: DataFrame | None = None, k: int = MAX_RESULTS, run_ts: _dt.datetime = RUN_TS,
                     on_error: str = "fail_topic", annotator: str = "recorded", **kw) -> DataFrame:
    """R8 with its write-back: answers all topics, then stores the analysed
    articles (first write wins) and the new reports, so that a later run finds
    them as history. Returns the answers, written once before the stores grow."""
    spark = arts.sparkSession
    create_store(spark, analysis_path, ANALYSIS_STORE)
    create_store(spark, article_path, ARTICLE_STORE)
    history = read_store(spark, analysis_path, ANALYSIS_STORE)
    routed = cut_lineage(plan_topics(valid_topics(topics), history), "routed")
    todo = routed.filter(F.col("route") == "analyze").select(*topics.columns)
    reports, annotated = analyze_topics(arts, todo, effect_terms, responses, k, run_ts, on_error, annotator, **kw)
    annotated, reports = cut_lineage(annotated, "annotated"), cut_lineage(reports, "reports")
    answers = cut_lineage(_answers(routed, reports), "answers")
    store_articles(spark, article_path, article_rows(annotated, run_ts))
    store_analyses(spark, analysis_path, analysis_rows(reports))
    return answers
