"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame with
flat columns (arrays joined to strings) whose names match the oracle SQL."""

from __future__ import annotations

import datetime as _dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixtures import (FIXTURE_EFFECT_TERMS, FIXTURE_TOPICS, HISTORY_RUNS, LEXICON_NEGATIVE, LEXICON_POSITIVE,
                            PHRASE_EFFECTS, PHRASE_TOPICS, cue_model, raw_date, recorded_responses)
from quire.operators.history import TIME_FORMAT, analysis_history, latest_analysis, plan_topics
from quire.operators.bm25 import bm25_topk
from quire.operators.match import corpus_stats, corpus_stats_frame, doc_tokens, match_topics
from quire.plans.answer import (analyze_topics, answer_topics, fetch_ranked, history_store_rows,
                                RUN_TS)
from quire.session import configure, cut_lineage
from quire.sources.corpus import articles, read_table, spread
from quire.sources.topics import topics_frame

EFFECT = FIXTURE_EFFECT_TERMS
# Topic 2 again with refresh = true: it must bypass its history.
ANSWER_TOPICS = FIXTURE_TOPICS + [(7, "thon", "thble", None, 2010, True)]


class Ctx:
    """Inputs of one query run, read once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.documents = spread(read_table(spark, sf_dir, "documents"))
        self.arts = articles(self.documents, dp=raw_date(F.col("doc_id")))
        self.responses = recorded_responses(self.documents)
        self._dt = None
        self._stats = None

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def dt(self):
        if self._dt is None:
            self._dt = doc_tokens(self.arts)
        return self._dt

    @property
    def stats(self):
        if self._stats is None:
            self._stats = corpus_stats(self.dt)
        return self._stats

    def kw(self):
        # Corpus statistics come out of each match's postings pass (or the
        # shared index), so no separate pass over the corpus is made here.
        kw = {"dt": self.dt}
        if getattr(self, "index", None) is not None:
            kw["index"] = self.index
        return kw

    def with_index(self, *topic_rows):
        """Postings index for the vocabulary of several topic tables, built
        once and shared by every match of this run."""
        from quire.operators.match import build_index, topic_vocabulary
        words = [topic_vocabulary(self.topics(rows), EFFECT) for rows in topic_rows]
        self.index = build_index(self.dt, functools.reduce(DataFrame.unionByName, words), EFFECT)
        return self

    def topics(self, rows=None):
        return topics_frame(self.spark, FIXTURE_TOPICS if rows is None else rows)


def _reports(c: Ctx, on_error="skip"):
    return analyze_topics(c.arts, c.topics(), EFFECT, c.responses, on_error=on_error, **c.kw())


def flat_articles(col="articles"):
    return F.array_join(F.transform(col, lambda a: F.concat_ws(
        ":", a["rank"].cast("string"), a["pmid"], F.coalesce(a["effect_type"], F.lit("-")),
        F.coalesce(a["evidence_strength"], F.lit("-")), F.coalesce(a["conclusion"], F.lit("-")))), ";")


# ------------------------------------------------------------------ queries

def q_search_literature(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    from quire.operators.match import search_literature
    return (search_literature(c.arts, c.topics(), EFFECT, 5, **c.kw())
            .select("topic_id", "pmid", "score", F.col("rank").cast("int").alias("rank")))


def q_match_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    notime = [(t[0], t[1], t[2], None, None, False) for t in FIXTURE_TOPICS]
    return match_topics(c.arts, c.topics(notime), EFFECT, **c.kw()).select("topic_id", "pmid", "score")


def q_match_topics_years(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return match_topics(c.arts, c.topics(), EFFECT, **c.kw()).select(
        "topic_id", "pmid", F.col("year").alias("yr"), "score")


def q_topic_report(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    r, _ = _reports(c)
    return r.select("topic_id", "compound", "disease", "total_papers", "positive_effects",
                    "negative_effects", "neutral_effects",
                    F.array_join("key_findings", "|").alias("key_findings"),
                    "evidence_summary", flat_articles().alias("articles"), "content",
                    F.date_format("analysis_date", TIME_FORMAT).alias("analysis_date"),
                    "provenance", "status")


def q_topic_report_strict(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    r, _ = _reports(c, on_error="fail_topic")
    return r.select("topic_id", "total_papers", "positive_effects", "content", "status",
                    "failed_annotations")


def q_effect_counts(spark, sf_dir):
    r, _ = _reports(Ctx(spark, sf_dir))
    return r.select("topic_id", "total_papers", "positive_effects", "negative_effects",
                    "neutral_effects")


def q_key_findings(spark, sf_dir):
    r, _ = _reports(Ctx(spark, sf_dir))
    return r.select("topic_id", F.array_join("key_findings", "|").alias("key_findings"),
                    F.size("key_findings").alias("n_findings"))


def q_report_articles(spark, sf_dir):
    r, _ = _reports(Ctx(spark, sf_dir))
    return r.select("topic_id", flat_articles().alias("articles"))


def q_evidence_summary(spark, sf_dir):
    _, ann = _reports(Ctx(spark, sf_dir))
    return (ann.filter(F.col("evidence_strength").isNotNull())
            .groupBy("topic_id", "evidence_strength").agg(F.count(F.lit(1)).alias("n_articles")))


def q_report_content(spark, sf_dir):
    r, _ = _reports(Ctx(spark, sf_dir))
    return r.select("topic_id", "content")


def q_annotate_recorded(spark, sf_dir):
    _, ann = _reports(Ctx(spark, sf_dir))
    return ann.select("topic_id", F.col("rank").cast("int").alias("rank"), "pmid", "annotation_ok",
                      "effect_type", "evidence_strength",
                      F.array_join("findings", "|").alias("findings"), "conclusion")


def _history(c: Ctx):
    return history_store_rows(c.arts, c.responses, EFFECT, HISTORY_RUNS, **c.kw())


def q_latest_analysis(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return latest_analysis(_history(c)).select(
        "compound", "disease", F.date_format("created_at", TIME_FORMAT).alias("analysis_time"),
        "total_papers", "content")


def q_analysis_history(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return analysis_history(_history(c), c.topics()).select(
        "topic_id", F.col("rank").cast("int").alias("rank"), "compound", "disease",
        "analysis_time", "total_papers", "content")


def q_plan_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return plan_topics(c.topics(ANSWER_TOPICS), _history(c)).select(
        "topic_id", "route", F.date_format("history_time", TIME_FORMAT).alias("history_time"))


def _history_topic_rows():
    return [(r[0], r[1], r[2], r[3], r[4], False) for r in HISTORY_RUNS]


def q_answer_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir).with_index(ANSWER_TOPICS, _history_topic_rows())
    return answer_topics(c.arts, c.topics(ANSWER_TOPICS), _history(c), EFFECT, c.responses,
                         on_error="skip", **c.kw())


def q_corpus_stats(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return corpus_stats_frame(c.dt).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def q_bm25_topk(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    q = c.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25_topk(c.arts, q, 5, **c.kw()).select(
        "query_id", "pmid", "score", F.col("rank").cast("int").alias("rank"))


def q_parse_pub_date(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.arts.select("pmid", "dp",
                         F.date_format("publication_date_parsed", TIME_FORMAT).alias("parsed"),
                         F.date_format("publication_date", TIME_FORMAT).alias("publication_date"))


# ------------------------------------------------------------------ scalars, sources

def q_valid_messages(spark, sf_dir):
    from quire.functions.text import is_blank
    conv = Ctx(spark, sf_dir).table("conversations")
    return conv.filter(~is_blank(F.col("text"))).select("conv_id", "turn", "role")


def q_topic_query_text(spark, sf_dir):
    from quire.functions.text import topic_query_text
    c = Ctx(spark, sf_dir)
    t = c.topics()
    n = match_topics(c.arts, t, EFFECT, **c.kw()).groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n_matches"))
    return t.join(n, "topic_id", "left").select(
        "topic_id", topic_query_text(F.col("compound"), F.col("disease"), F.col("start_year"),
                                     F.col("end_year")).alias("query_text"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def q_render_prompt(spark, sf_dir):
    from quire.operators.annotate import with_prompt
    c = Ctx(spark, sf_dir)
    fetched = fetch_ranked(c.arts, c.topics(), EFFECT, **c.kw())
    return with_prompt(fetched).select("topic_id", "pmid", "prompt")


def q_extract_json(spark, sf_dir):
    from quire.functions.annotation import extract_json
    r = Ctx(spark, sf_dir).responses
    return r.select("pmid", extract_json(F.col("response")).alias("span"))


def q_parse_annotation(spark, sf_dir):
    from quire.operators.annotate import parse_responses
    r = parse_responses(Ctx(spark, sf_dir).responses)
    return r.select("pmid", "annotation_ok", "effect_type", "evidence_strength",
                    F.array_join("findings", "|").alias("findings"), "conclusion")


def q_article_content(spark, sf_dir):
    from quire.functions.text import article_content
    a = Ctx(spark, sf_dir).arts
    content = article_content(F.col("title"), F.col("abstract"))
    return a.select("pmid", F.length(content).alias("n_chars"), F.md5(content).alias("md5"))


def q_fetch_articles(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    fetched = fetch_ranked(c.arts, c.topics(), EFFECT, **c.kw())
    return fetched.select("topic_id", F.col("rank").cast("int").alias("rank"), "pmid", "title",
                          "journal", F.array_join("keywords", ",").alias("keywords"),
                          F.date_format("publication_date", TIME_FORMAT).alias("publication_date"))


def q_conversation_tail(spark, sf_dir):
    from quire.operators.memory import conversation_tail
    conv = Ctx(spark, sf_dir).table("conversations")
    return conversation_tail(conv, budget=100).select("conv_id", "turn", "role", "n_tokens", "running")


# ------------------------------------------------------------------ vectors

def _vec_summary(v):
    return (F.size(F.filter(v, lambda x: x > 0)).alias("nnz"),
            F.round(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)),
                                F.lit(0.0).cast("double"), lambda a, b: a + b), 5).alias("checksum"))


def q_embed_documents(spark, sf_dir):
    from quire.functions.text import article_content
    from quire.functions.vectors import hash_embed
    a = Ctx(spark, sf_dir).arts
    v = a.select("pmid", hash_embed(article_content(F.col("title"), F.col("abstract"))).alias("v"))
    return v.select("pmid", *_vec_summary(F.col("v")))


def q_cosine_topk(spark, sf_dir):
    from quire.operators.search import cosine_topk
    e = Ctx(spark, sf_dir).table("embeddings")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"),
                                              F.col("embedding").alias("vec"))
    return cosine_topk(e.select("vec_id", F.col("embedding").alias("vec")), q, 5,
                       item_key="vec_id").select("query_id", "vec_id", "score",
                                                 F.col("rank").cast("int").alias("rank"))


def _bench_queries(c):
    return c.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


def q_search_similar_analyses(spark, sf_dir):
    from quire.operators.search import search_similar_analyses
    c = Ctx(spark, sf_dir)
    return search_similar_analyses(cut_lineage(_history(c), "stored"), _bench_queries(c), 5).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "compound", "disease",
        F.date_format("created_at", TIME_FORMAT).alias("analysis_time"), "score")


def _article_store_rows(c: Ctx):
    from quire.plans.answer import stored_articles_of_run
    return stored_articles_of_run(c.arts, c.topics(), EFFECT, **c.kw())


def q_search_similar_articles(spark, sf_dir):
    from quire.operators.search import search_similar_articles
    c = Ctx(spark, sf_dir)
    return search_similar_articles(cut_lineage(_article_store_rows(c), "stored"), _bench_queries(c), 5).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "pmid", "compound", "disease",
        "similarity")


def q_search_similar_filtered(spark, sf_dir):
    from quire.operators.search import search_similar_articles
    c = Ctx(spark, sf_dir)
    return search_similar_articles(cut_lineage(_article_store_rows(c), "stored"), _bench_queries(c), 5,
                                   compound="ther").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "pmid", "compound", "disease",
        "similarity")


def q_hybrid_search(spark, sf_dir):
    from quire.operators.search import hybrid_search
    c = Ctx(spark, sf_dir)
    return hybrid_search(c.arts, _bench_queries(c), 5, 20, **c.kw()).select(
        "query_id", "pmid", "r_dense", "r_text", "score", F.col("rank").cast("int").alias("rank"))


# ------------------------------------------------------------------ stores

STORE_RUN_1 = _dt.datetime(2024, 5, 1)


def _write_article_store(c: Ctx) -> str:
    """Two runs into a fresh store: the history topics, then the answer topics."""
    from quire.operators.store import store_articles
    from quire.plans.answer import stored_articles_of_run
    from quire.session import fresh_path
    path = fresh_path(c.spark, "article_store")
    hist = [(r[0], r[1], r[2], r[3], r[4], False) for r in HISTORY_RUNS]
    store_articles(c.spark, path, stored_articles_of_run(c.arts, c.topics(hist), EFFECT,
                                                         run_ts=STORE_RUN_1, **c.kw()))
    store_articles(c.spark, path, stored_articles_of_run(c.arts, c.topics(ANSWER_TOPICS), EFFECT,
                                                         run_ts=RUN_TS, **c.kw()))
    return path


def q_store_articles(spark, sf_dir):
    from quire.operators.store import read_store
    from quire.schemas import ARTICLE_STORE
    c = Ctx(spark, sf_dir).with_index(ANSWER_TOPICS, _history_topic_rows())
    s = read_store(spark, _write_article_store(c), ARTICLE_STORE)
    return s.select("pmid", "compound", "disease",
                    F.date_format("created_at", TIME_FORMAT).alias("created_at"))


def q_scan_articles(spark, sf_dir):
    from quire.operators.store import read_store
    from quire.schemas import ARTICLE_STORE
    c = Ctx(spark, sf_dir).with_index(ANSWER_TOPICS, _history_topic_rows())
    s = read_store(spark, _write_article_store(c), ARTICLE_STORE)
    return s.select("pmid", "title", F.length("abstract").alias("abstract_chars"),
                    *_vec_summary(F.col("content_vector")))


def _write_analysis_store(c: Ctx) -> str:
    from quire.operators.report import analysis_rows
    from quire.operators.store import store_analyses
    from quire.session import fresh_path
    path = fresh_path(c.spark, "analysis_store")
    store_analyses(c.spark, path, _history(c))
    reports, _ = analyze_topics(c.arts, c.topics(), EFFECT, c.responses, on_error="skip", **c.kw())
    store_analyses(c.spark, path, analysis_rows(reports))
    return path


def q_store_analyses(spark, sf_dir):
    from quire.operators.store import read_store
    from quire.schemas import ANALYSIS_STORE
    c = Ctx(spark, sf_dir).with_index(FIXTURE_TOPICS, _history_topic_rows())
    s = read_store(spark, _write_analysis_store(c), ANALYSIS_STORE)
    return s.groupBy("compound", "disease").agg(F.count(F.lit(1)).alias("n_analyses"),
                                                F.sum("total_papers").alias("papers"))


def q_scan_analyses(spark, sf_dir):
    from quire.operators.store import read_store
    from quire.schemas import ANALYSIS_STORE
    c = Ctx(spark, sf_dir).with_index(FIXTURE_TOPICS, _history_topic_rows())
    s = read_store(spark, _write_analysis_store(c), ANALYSIS_STORE)
    return s.select("compound", "disease", F.date_format("created_at", TIME_FORMAT).alias("analysis_time"),
                    "total_papers", "content", *_vec_summary(F.col("content_vector")))


def q_report_json(spark, sf_dir):
    from quire.operators.report import report_json
    from quire.schemas import REPORT
    from quire.session import fresh_path
    c = Ctx(spark, sf_dir)
    r, _ = _reports(c)
    path = fresh_path(spark, "reports_json")
    report_json(r).select("json").write.text(path)
    back = spark.read.text(path).select(F.from_json("value", REPORT).alias("r")).select("r.*")
    return back.select("topic_id", "total_papers", "positive_effects",
                       F.array_join("key_findings", "|").alias("key_findings"),
                       flat_articles().alias("articles"), "content", "status")


# ------------------------------------------------------------------ MEDLINE, stream

def _medline_files(c: Ctx) -> str:
    from quire.session import fresh_path
    from quire.sources.medline import write_medline
    path = fresh_path(c.spark, "medline")
    write_medline(c.arts, path)
    return path


def q_read_medline(spark, sf_dir):
    from quire.sources.medline import read_medline, tag_text
    c = Ctx(spark, sf_dir)
    recs = read_medline(spark, _medline_files(c))
    return recs.select(F.coalesce(tag_text(F.col("record"), "PMID"), F.lit("")).alias("pmid"),
                       F.size("record").alias("n_tags"),
                       F.array_join(F.transform("record", lambda e: e["key"]), ",").alias("tags"))


def q_map_medline(spark, sf_dir):
    from quire.sources.medline import map_medline, read_medline
    c = Ctx(spark, sf_dir)
    m = map_medline(read_medline(spark, _medline_files(c)))
    return m.select("pmid", "title", "abstract", "journal",
                    F.array_join("authors", "|").alias("authors"),
                    F.array_join("keywords", "|").alias("keywords"), "dp",
                    F.date_format("publication_date_parsed", TIME_FORMAT).alias("parsed"))


def q_validate_articles(spark, sf_dir):
    from quire.functions.validate import validate
    from quire.schemas import ARTICLE
    from quire.sources.medline import map_medline, read_medline
    c = Ctx(spark, sf_dir)
    m = map_medline(read_medline(spark, _medline_files(c)))
    v = validate(m, ARTICLE)
    return v.select("pmid", F.size("validation_errors").alias("n_errors"),
                    F.array_join("validation_errors", ",").alias("errors"))


def q_stream_ingest(spark, sf_dir):
    from quire.session import fresh_path
    from quire.sources.medline import write_medline
    from quire.streaming.ingest import run_ingest
    c = Ctx(spark, sf_dir)
    src, store, ck = (fresh_path(spark, "ingest_src"), fresh_path(spark, "ingest_store"),
                      fresh_path(spark, "ingest_ckpt"))
    write_medline(c.arts, src + "/f1")
    run_ingest(spark, src, store, ck, STORE_RUN_1)
    # Second delivery: every article again with another title; first write wins.
    write_medline(c.arts.withColumn("title", F.concat(F.lit("v2 "), F.col("title"))), src + "/f2")
    out = run_ingest(spark, src, store, ck, RUN_TS)
    return out.select("pmid", "title", F.date_format("created_at", TIME_FORMAT).alias("created_at"))


def q_annotate_lexicon(spark, sf_dir):
    from quire.operators.annotate import annotate_lexicon
    c = Ctx(spark, sf_dir)
    fetched = fetch_ranked(c.arts, c.topics(), EFFECT, **c.kw())
    a = annotate_lexicon(fetched, positive=LEXICON_POSITIVE, negative=LEXICON_NEGATIVE)
    return a.select("topic_id", "pmid", "effect_type", "evidence_strength",
                    F.array_join("findings", "|").alias("findings"), "conclusion")


def q_annotate_model(spark, sf_dir):
    from quire.operators.annotate import annotate_with
    c = Ctx(spark, sf_dir)
    fetched = fetch_ranked(c.arts, c.topics(), EFFECT, **c.kw())
    a = annotate_with(fetched, cue_model)
    return a.select("topic_id", "pmid", "effect_type", "evidence_strength",
                    F.array_join("findings", "|").alias("findings"))


# ------------------------------------------------------------------ phrases, write-back, tools, bad rows

def q_match_topics_phrase(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return match_topics(c.arts, c.topics(PHRASE_TOPICS), PHRASE_EFFECTS, dt=c.dt).select("topic_id", "pmid", "score")


def q_answer_topics_twice(spark, sf_dir):
    """The second run over the same stores finds the first one's reports."""
    from quire.plans.answer import answer_and_store
    from quire.session import fresh_path
    c = Ctx(spark, sf_dir).with_index(ANSWER_TOPICS)
    paths = fresh_path(spark, "twice-articles"), fresh_path(spark, "twice-analyses")
    for ts in (RUN_TS, _dt.datetime(2024, 7, 1)):
        out = answer_and_store(c.arts, c.topics(ANSWER_TOPICS), *paths, EFFECT, c.responses, run_ts=ts,
                               on_error="skip", **c.kw())
    return out


def q_analyze_by_pmids(spark, sf_dir):
    """Reports on given article lists: each topic's matches, worst first."""
    from quire.operators.match import search_literature
    c = Ctx(spark, sf_dir)
    found = search_literature(c.arts, c.topics(), EFFECT, 5, **c.kw()).groupBy("topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "pmid")), asc=False), lambda x: x["pmid"]).alias("pmids"))
    r, _ = analyze_topics(c.arts, c.topics().join(found, "topic_id", "left"), EFFECT, c.responses, on_error="skip")
    return r.select("topic_id", "total_papers", "positive_effects", F.array_join("key_findings", "|").alias("key_findings"),
                    flat_articles().alias("articles"), "status")


def q_tool_search_literature(spark, sf_dir):
    from quire.tools import search_literature
    c = Ctx(spark, sf_dir)
    return c.topics().transform(search_literature, c.arts, 5, EFFECT).select(
        "topic_id", "pmid", "score", F.col("rank").cast("int").alias("rank"))


def q_tool_analyze_literature(spark, sf_dir):
    from quire.tools import analyze_literature
    c = Ctx(spark, sf_dir)
    return c.topics().transform(analyze_literature, c.arts, c.responses, 5, EFFECT, on_error="skip").select(
        "topic_id", "total_papers", "positive_effects", "negative_effects", "neutral_effects")


def q_tool_query_previous_analyses(spark, sf_dir):
    from quire.tools import query_previous_analyses
    c = Ctx(spark, sf_dir)
    return c.topics().transform(query_previous_analyses, _history(c)).select(
        "topic_id", "rank", "compound", "disease", "analysis_time", "total_papers", "content")


def q_tool_search_similar_articles(spark, sf_dir):
    from quire.tools import search_similar_articles
    c = Ctx(spark, sf_dir)
    return _bench_queries(c).transform(search_similar_articles, cut_lineage(_article_store_rows(c), "stored"), 5).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "pmid", "compound", "disease", "similarity")


def q_create_store(spark, sf_dir):
    """Creating a store that exists keeps its rows."""
    from quire.operators.store import append_run, create_store, read_store
    from quire.schemas import ANALYSIS_STORE
    from quire.session import fresh_path
    docs, path = Ctx(spark, sf_dir).documents, fresh_path(spark, "created")
    create_store(spark, path, ANALYSIS_STORE)
    rows = docs.select(F.col("source").alias("compound"), F.col("lang").alias("disease"),
                       F.lit(None).cast("array<float>").alias("content_vector"), F.col("text").alias("content"),
                       F.lit(RUN_TS).cast("timestamp_ntz").alias("created_at"), F.col("n_chars").alias("total_papers"))
    append_run(rows, path)
    create_store(spark, path, ANALYSIS_STORE)
    return read_store(spark, path, ANALYSIS_STORE).groupBy("compound", "disease").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_papers").alias("chars"))


def q_validate_rows(spark, sf_dir):
    """Articles with missing titles, ids, journals and list elements."""
    from quire.functions.validate import validate
    from quire.schemas import ARTICLE
    a = Ctx(spark, sf_dir).arts
    bad = (a.withColumn("title", F.when(F.col("abstract") != "", F.col("title")))
           .withColumn("authors", F.array(F.element_at("keywords", 1), F.nullif("journal", F.lit("src1"))))
           .withColumn("pmid", F.when(F.element_at("keywords", 1) != "es", F.col("pmid")))
           .withColumn("journal", F.nullif("journal", F.lit("src2"))))
    v = validate(bad, ARTICLE)
    return v.select("doc_id", F.size("validation_errors").alias("n_errors"),
                    F.array_join("validation_errors", ",").alias("errors"))


def q_map_medline_no_pmid(spark, sf_dir):
    """Records without a PMID (every document that is not English) are dropped."""
    from quire.session import fresh_path
    from quire.sources.medline import map_medline, read_medline, write_medline
    c = Ctx(spark, sf_dir)
    path = fresh_path(spark, "medline")
    write_medline(c.arts.withColumn("pmid", F.when(F.element_at("keywords", 1) == "en", F.col("pmid")).otherwise("")), path)
    return map_medline(read_medline(spark, path)).select("pmid", "title")


def q_valid_topics(spark, sf_dir):
    """Topics made from documents: blank ones (no second line) are rejected."""
    from quire.sources.topics import valid_topics
    a = Ctx(spark, sf_dir).arts
    return valid_topics(a.select("doc_id", F.col("abstract").alias("compound"), F.col("journal").alias("disease"))
                        ).select("doc_id", F.length("compound").alias("n"), "disease")


QUERIES = {
    "match_topics_phrase": q_match_topics_phrase,
    "answer_topics_twice": q_answer_topics_twice,
    "analyze_by_pmids": q_analyze_by_pmids,
    "tool_search_literature": q_tool_search_literature,
    "tool_analyze_literature": q_tool_analyze_literature,
    "tool_query_previous_analyses": q_tool_query_previous_analyses,
    "tool_search_similar_articles": q_tool_search_similar_articles,
    "create_store": q_create_store,
    "validate_rows": q_validate_rows,
    "map_medline_no_pmid": q_map_medline_no_pmid,
    "valid_topics": q_valid_topics,
    "search_literature": q_search_literature,
    "match_topics": q_match_topics,
    "match_topics_years": q_match_topics_years,
    "topic_report": q_topic_report,
    "topic_report_fail_topic": q_topic_report_strict,
    "effect_counts": q_effect_counts,
    "key_findings": q_key_findings,
    "report_articles": q_report_articles,
    "evidence_summary": q_evidence_summary,
    "report_content": q_report_content,
    "annotate_recorded": q_annotate_recorded,
    "latest_analysis": q_latest_analysis,
    "analysis_history": q_analysis_history,
    "plan_topics": q_plan_topics,
    "answer_topics": q_answer_topics,
    "corpus_stats": q_corpus_stats,
    "bm25_topk": q_bm25_topk,
    "parse_pub_date": q_parse_pub_date,
    "valid_messages": q_valid_messages,
    "topic_query_text": q_topic_query_text,
    "render_prompt": q_render_prompt,
    "extract_json": q_extract_json,
    "parse_annotation": q_parse_annotation,
    "article_content": q_article_content,
    "fetch_articles": q_fetch_articles,
    "conversation_tail": q_conversation_tail,
    "embed_documents": q_embed_documents,
    "cosine_topk": q_cosine_topk,
    "search_similar_analyses": q_search_similar_analyses,
    "search_similar_articles": q_search_similar_articles,
    "search_similar_filtered": q_search_similar_filtered,
    "hybrid_search": q_hybrid_search,
    "store_articles": q_store_articles,
    "scan_articles": q_scan_articles,
    "store_analyses": q_store_analyses,
    "scan_analyses": q_scan_analyses,
    "report_json": q_report_json,
    "read_medline": q_read_medline,
    "map_medline": q_map_medline,
    "validate_articles": q_validate_articles,
    "stream_ingest": q_stream_ingest,
    "annotate_lexicon": q_annotate_lexicon,
    "annotate_model": q_annotate_model,
}
