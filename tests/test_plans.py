"""Plan shape: no cross joins anywhere, top-k limited map-side, pruned scans."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

KEYS = ["search_literature", "bm25_topk", "hybrid_search", "cosine_topk", "answer_topics",
        "conversation_tail", "analysis_history", "topic_report", "store_articles"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_join(spark, key):
    plan = _plan(E.queries()[key](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["search_literature", "bm25_topk", "conversation_tail"])
def test_top_k_is_limited_before_the_shuffle(spark, key):
    plan = _plan(E.queries()[key](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_match_scan_reads_only_needed_columns(spark, ctx001):
    from quire.operators.match import postings
    plan = _plan(postings(ctx001.dt, spark.createDataFrame([("er",)], "token string")))
    scans = [l for l in plan.split("\n") if "FileScan parquet" in l]
    assert scans and all("ReadSchema: struct<doc_id:bigint,text:string>" in l for l in scans)


def test_one_plan_for_any_number_of_queries(spark):
    from quire.operators.search import search_similar_articles
    store = spark.createDataFrame([("p1", "t", "a", [1.0, 0.0], "c", "d")],
                                  "pmid string, title string, abstract string, content_vector array<float>, "
                                  "compound string, disease string")
    from pyspark.sql import functions as F

    def embed(text):
        return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    for n in (10, 5000):
        q = spark.range(n).select(F.col("id").alias("query_id"), F.lit("text").alias("text"))
        out = search_similar_articles(store, q, 5, embed=embed)
        assert "strategy=broadcast" not in out._jdf.queryExecution().analyzed().toString()
        assert out.count() == n


def test_a_match_groups_nothing_by_topic_or_document(spark, ctx001):
    """Beyond the postings, a match is two joins of ids; effect terms cost no exchange."""
    from quire.fixtures import FIXTURE_EFFECT_TERMS
    from quire.operators.match import build_index, match_topics, topic_vocabulary
    t = ctx001.topics()
    index = build_index(ctx001.dt, topic_vocabulary(t, FIXTURE_EFFECT_TERMS), FIXTURE_EFFECT_TERMS)
    plan = match_topics(ctx001.arts, t, FIXTURE_EFFECT_TERMS, index=index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in plan and plan.count("Join ") <= 3
    with pytest.raises(ValueError):
        match_topics(ctx001.arts, t, ("other",), index=index)
