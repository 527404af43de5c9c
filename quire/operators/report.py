"""Per-topic evidence report: G1-G6, J3, C9, R7.

After the per-topic top-k there are at most k articles per topic, so the
per-topic ``collect_list`` calls below hold at most k entries each; no group
grows with the corpus.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.functions.vectors import hash_embed

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Effect labels counted (exact, lower case), findings kept per report, and the
# report text (C9; findings joined by ", ").
POSITIVE, NEGATIVE, NEUTRAL = "positive", "negative", "neutral"
MAX_FINDINGS = 5
REPORT_TEXT = ("%s对%s的分析报告：\n"
               "总计分析文献：%s篇\n"
               "正面效果：%s篇，负面效果：%s篇，中性效果：%s篇\n"
               "主要发现：%s")
# ---------------------------------------------------------------------------

ON_ERROR = ("fail_topic", "skip")


def report_content(compound: Column, disease: Column, total: Column, pos: Column,
                   neg: Column, neu: Column, findings: Column) -> Column:
    """The report text that is stored and embedded."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    found = F.array_join(F.slice(F.coalesce(findings, F.array()), 1, MAX_FINDINGS), ", ")
    return F.format_string(REPORT_TEXT, s(compound), s(disease), s(total), s(pos), s(neg), s(neu), found)


def evidence_summary(strong: Column, moderate: Column, weak: Column) -> Column:
    """G6 text: the evidence-strength distribution (ours; never computed upstream)."""
    return F.concat(F.lit("strong: "), strong.cast("string"), F.lit(", moderate: "),
                    moderate.cast("string"), F.lit(", weak: "), weak.cast("string"))


def topic_aggregates(annotated: DataFrame) -> DataFrame:
    """G1-G4, G6 per topic over annotated articles (topic_id, rank, pmid, title,
    annotation_ok, effect_type, evidence_strength, findings, conclusion)."""
    eff = F.col("effect_type")
    st = F.col("evidence_strength")
    entry = F.struct(F.col("rank").cast("int").alias("rank"), "pmid", "title", "conclusion",
                     "effect_type", "evidence_strength")
    return (annotated.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.count_if(eff == POSITIVE).alias("positive_effects"),
        F.count_if(eff == NEGATIVE).alias("negative_effects"),
        F.count_if(eff == NEUTRAL).alias("neutral_effects"),
        F.count_if(st == "strong").alias("strong_evidence"),
        F.count_if(st == "moderate").alias("moderate_evidence"),
        F.count_if(st == "weak").alias("weak_evidence"),
        F.count_if(~F.col("annotation_ok")).alias("failed_annotations"),
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"),
                                             F.col("findings").alias("f")))).alias("_fl"),
        F.array_sort(F.collect_list(entry)).alias("articles"))
        .withColumn("key_findings", F.slice(F.flatten(F.transform(
            "_fl", lambda x: F.coalesce(x["f"], F.array().cast("array<string>")))), 1, MAX_FINDINGS))
        .drop("_fl"))


def topic_reports(topics: DataFrame, annotated: DataFrame, run_ts: _dt.datetime,
                  on_error: str = "fail_topic") -> DataFrame:
    """One report row per topic; a topic with no article still gets a
    zero report. ``on_error='fail_topic'`` (as the reference) turns a topic with
    any failed annotation into a ``status='error'`` row with no report;
    ``'skip'`` keeps it, the failed articles counting only in ``total_papers``."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    agg = topic_aggregates(annotated)
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    r = (topics.select("topic_id", "compound", "disease")
         .join(agg, "topic_id", "left")
         .select("topic_id", "compound", "disease",
                 *[z(c).alias(c) for c in (
                     "total_papers", "positive_effects", "negative_effects", "neutral_effects",
                     "strong_evidence", "moderate_evidence", "weak_evidence",
                     "failed_annotations")],
                 F.coalesce("key_findings", F.array().cast("array<string>")).alias("key_findings"),
                 F.coalesce("articles", F.array().cast(
                     "array<struct<rank:int,pmid:string,title:string,conclusion:string,"
                     "effect_type:string,evidence_strength:string>>")).alias("articles")))
    # A topic without a searchable token finds nothing: an error, not "no papers".
    wordless = (F.size(tokens(F.col("compound"))) == 0) | (F.size(tokens(F.col("disease"))) == 0)
    failed = wordless | (F.lit(on_error == "fail_topic") & (F.col("failed_annotations") > 0))
    content = report_content(F.col("compound"), F.col("disease"), F.col("total_papers"),
                             F.col("positive_effects"), F.col("negative_effects"),
                             F.col("neutral_effects"), F.col("key_findings"))
    summary = evidence_summary(F.col("strong_evidence"), F.col("moderate_evidence"),
                               F.col("weak_evidence"))
    keep_null = lambda c, name: F.when(~failed, c).alias(name)
    return r.select(
        "topic_id", "compound", "disease", "total_papers",
        keep_null(F.col("positive_effects"), "positive_effects"),
        keep_null(F.col("negative_effects"), "negative_effects"),
        keep_null(F.col("neutral_effects"), "neutral_effects"),
        keep_null(F.col("key_findings"), "key_findings"),
        keep_null(summary, "evidence_summary"),
        keep_null(F.col("articles"), "articles"),
        keep_null(content, "content"),
        F.lit(run_ts).cast("timestamp_ntz").alias("analysis_date"),
        F.lit("new").alias("provenance"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        "failed_annotations")


def analysis_rows(reports: DataFrame, embed=hash_embed) -> DataFrame:
    """B2 input: one ``ANALYSIS_STORE`` row per successful report."""
    return (reports.filter(F.col("status") == "ok")
            .select("compound", "disease",
                    embed(F.col("content")).alias("content_vector"),
                    "content", F.col("analysis_date").alias("created_at"),
                    F.col("total_papers").cast("long").alias("total_papers")))


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON document per report."""
    cols = [c for c in reports.columns]
    return reports.select("topic_id", F.to_json(F.struct(*cols)).alias("json"))
