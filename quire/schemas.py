"""Declared schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()
TS = T.TimestampNTZType()
STRS = T.ArrayType(T.StringType())
VEC = T.ArrayType(T.FloatType())


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# One article (title/abstract/journal default to '', lists to []).
ARTICLE = T.StructType([
    _f("pmid", S, False), _f("title", S, False), _f("abstract", S, False),
    _f("authors", STRS, False), _f("publication_date", TS, False),
    _f("journal", S, False), _f("keywords", STRS, False),
    _f("publication_date_parsed", TS), _f("conclusion", S),
    _f("effect_type", S), _f("evidence_strength", S),
])

# Stored articles: pmid unique, first write wins.
ARTICLE_STORE = T.StructType([
    _f("pmid", S, False), _f("title", S), _f("abstract", S),
    _f("content_vector", VEC), _f("compound", S), _f("disease", S),
    _f("created_at", TS),
])

# Stored analyses: an append-only log.
ANALYSIS_STORE = T.StructType([
    _f("compound", S), _f("disease", S), _f("content_vector", VEC),
    _f("content", S), _f("created_at", TS), _f("total_papers", L),
])

TOPIC = T.StructType([
    _f("topic_id", I, False), _f("compound", S), _f("disease", S),
    _f("start_year", I), _f("end_year", I), _f("refresh", T.BooleanType()),
])

REPORT_ARTICLE = T.StructType([
    _f("rank", I), _f("pmid", S), _f("title", S), _f("conclusion", S),
    _f("effect_type", S), _f("evidence_strength", S),
])

REPORT = T.StructType([
    _f("topic_id", I), _f("compound", S), _f("disease", S),
    _f("total_papers", L), _f("positive_effects", L),
    _f("negative_effects", L), _f("neutral_effects", L),
    _f("key_findings", STRS), _f("evidence_summary", S),
    _f("articles", T.ArrayType(REPORT_ARTICLE)), _f("analysis_date", TS),
    _f("provenance", S), _f("status", S), _f("content", S), _f("failed_annotations", L),
])
