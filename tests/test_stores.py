"""First write wins; store twice = store once; append-only log."""
import datetime as dt


from pyspark.sql import functions as F

from quire.operators.manifest import latest
from quire.operators.store import (article_rows, create_store, new_articles, read_runs, read_store, stage_insert,
                                   store_analyses, store_articles)
from quire.schemas import ANALYSIS_STORE, ARTICLE_STORE
from quire.session import fresh_path

TS1, TS2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def _fetched(spark, rows):
    return spark.createDataFrame(rows, "topic_id int, rank int, pmid string, title string, "
                                       "abstract string, compound string, disease string")


def test_first_write_wins_inside_and_across_runs(spark):
    path = fresh_path(spark, "t-articles")
    run1 = _fetched(spark, [(2, 1, "p1", "t", "a", "c2", "d2"), (1, 3, "p1", "t", "a", "c1", "d1"),
                            (1, 1, "p2", "t", "a", "c1", "d1")])
    store_articles(spark, path, article_rows(run1, TS1))
    run2 = _fetched(spark, [(0, 1, "p1", "t", "a", "c0", "d0"), (0, 2, "p3", "t", "a", "c0", "d0")])
    store_articles(spark, path, article_rows(run2, TS2))
    s = {r["pmid"]: r for r in read_store(spark, path, ARTICLE_STORE).collect()}
    assert sorted(s) == ["p1", "p2", "p3"]
    assert s["p1"]["compound"] == "c1" and s["p1"]["created_at"] == TS1   # lowest (topic, rank) of run 1
    assert s["p3"]["created_at"] == TS2
    # storing the same batch again adds nothing
    store_articles(spark, path, article_rows(run2, TS2))
    assert read_store(spark, path, ARTICLE_STORE).count() == 3


def test_create_is_idempotent_and_analyses_append(spark):
    path = fresh_path(spark, "t-analyses")
    create_store(spark, path, ANALYSIS_STORE)
    create_store(spark, path, ANALYSIS_STORE)
    assert read_store(spark, path, ANALYSIS_STORE).count() == 0
    rows = spark.createDataFrame([("c", "d", [1.0], "x", TS1, 3)], ANALYSIS_STORE)
    store_analyses(spark, path, rows)
    store_analyses(spark, path, rows)
    assert read_store(spark, path, ANALYSIS_STORE).count() == 2


def test_release_stages(spark):
    from quire.session import cut_lineage, release_stages, stage_root
    import os
    df = cut_lineage(spark.range(10))
    assert df.count() == 10 and os.path.isdir(stage_root(spark).replace("file:", ""))
    assert release_stages(spark)
    assert not os.path.exists(stage_root(spark).replace("file:", ""))


def _articles(spark, pmids, title):
    from quire.session import cut_lineage
    return cut_lineage(spark.createDataFrame([(p, title, "a", None, "c", "d", TS1) for p in pmids], ARTICLE_STORE))


def test_interleaved_writers_keep_one_row_per_pmid(spark):
    path = fresh_path(spark, "t-two-writers")
    store_articles(spark, path, _articles(spark, ["p0"], "zero"))
    a = stage_insert(spark, path, _articles(spark, ["p0", "p1", "p2"], "a"))
    b = stage_insert(spark, path, _articles(spark, ["p0", "p2", "p3"], "b"))
    c = stage_insert(spark, path, _articles(spark, ["p1", "p3"], "c"))
    for staged in (b, a, c):                      # the first commit wins, not the first to write
        staged.commit()
    got = sorted((r["pmid"], r["title"]) for r in read_store(spark, path, ARTICLE_STORE).collect())
    assert got == [("p0", "zero"), ("p1", "a"), ("p2", "b"), ("p3", "b")]


def test_what_is_not_committed_is_not_seen(spark):
    path = fresh_path(spark, "t-uncommitted")
    staged = stage_insert(spark, path, _articles(spark, ["p1"], "a"), name="run")
    again = stage_insert(spark, path, _articles(spark, ["p1"], "retry"), name="run")
    assert read_store(spark, path, ARTICLE_STORE).count() == 0
    assert again.commit() and staged.commit() is None          # one of two attempts at a run counts
    assert [r["title"] for r in read_store(spark, path, ARTICLE_STORE).collect()] == ["retry"]


def test_two_log_writers_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor
    path = fresh_path(spark, "t-log")
    create_store(spark, path, ANALYSIS_STORE)
    rows = spark.createDataFrame([("c", "d", [1.0], "x", TS1, 3)], ANALYSIS_STORE)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: store_analyses(spark, path, rows), range(6)))
    assert read_store(spark, path, ANALYSIS_STORE).count() == 6


def test_insert_reads_touched_buckets_only(spark):
    path = fresh_path(spark, "t-buckets")
    create_store(spark, path, ARTICLE_STORE, buckets=16)
    store_articles(spark, path, _articles(spark, [f"p{i}" for i in range(400)], "t"))
    runs = latest(spark, path).runs.values()
    stored = read_runs(spark, path, ARTICLE_STORE, runs)
    assert len(stored.inputFiles()) == 16
    delta = new_articles(_articles(spark, ["p7", "new"], "t"), stored, 16)
    assert [r["pmid"] for r in delta.collect()] == ["new"]
    plan = delta._jdf.queryExecution().executedPlan().toString()
    touched = {r[0] for r in stored.filter(F.col("pmid") == "p7").select("bucket").collect()}
    assert "PartitionFilters: [bucket#" in plan or "PartitionFilters: [isnotnull(bucket" in plan, plan
    assert all(str(b) in plan for b in touched)
