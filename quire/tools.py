"""K1: the four tools of the upstream assistant as DataFrame functions.

Each takes the driving table first, so it chains with ``DataFrame.transform``:

    topics.transform(search_literature, articles)
    topics.transform(analyze_literature, articles, responses)
    topics.transform(query_previous_analyses, analysis_store)
    queries.transform(search_similar_articles, article_store, limit=5)
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.functions.text import DEFAULT_EFFECT_TERMS
from quire.operators.history import analysis_history
from quire.operators.match import search_literature as _search
from quire.operators.search import search_similar_articles as _similar
from quire.plans.answer import analyze_topics


def search_literature(topics: DataFrame, articles: DataFrame, max_results: int = 5,
                      effect_terms=DEFAULT_EFFECT_TERMS) -> DataFrame:
    """(topic_id, doc_id, pmid, year, score, rank): the most relevant matches."""
    return _search(articles, topics, effect_terms, max_results)


def analyze_literature(topics: DataFrame, articles: DataFrame, responses: DataFrame | None = None,
                       max_results: int = 5, effect_terms=DEFAULT_EFFECT_TERMS,
                       **kw) -> DataFrame:
    """One report per topic (search, fetch, annotate, aggregate); topics with a
    ``pmids`` column are analysed on those articles instead of a search."""
    return analyze_topics(articles, topics, effect_terms, responses, max_results, **kw)[0]


def query_previous_analyses(topics: DataFrame, analysis_store: DataFrame) -> DataFrame:
    """Every stored analysis of each topic, newest first."""
    return analysis_history(analysis_store, topics)


def search_similar_articles(queries: DataFrame, article_store: DataFrame, limit: int = 5,
                            compound: str | None = None, disease: str | None = None,
                            **kw) -> DataFrame:
    """Stored articles most similar to each query text (optional filters)."""
    return _similar(article_store, queries, limit, compound=compound, disease=disease, **kw)
