"""Topic matching and text relevance: P1, P2, J6, G7, R1, W1.

Plan shape (one pass over the corpus text per match, or none with an index):

  documents --tokenise (effect terms are decided here, per document), explode-->
     --left semi join with the query vocabulary
     --partial agg by document--> one row per document: its query tokens with
        their positions, its length, whether it holds an effect term; written once
        |-- lengths ............................. N, average length (G7)
        '-- agg by token (partial) .............. document frequency

  topics: one row each, with its terms, the weights of its tokens and its
  rarest compound or disease token as anchor; a topic with a token that no
  document holds has no anchor and emits no row
     anchors x tokens of documents with an effect term --> ids only (topic, doc)
     --join the topic, join the document's row--> phrases and BM25 are
       expressions over that one row; survivors --> top-k per topic

Beyond the postings exchange nothing is grouped: the two joins are all that a
match shuffles, and they carry candidates. Spark picks broadcasts from the
sizes it measures and splits skewed partitions. Candidates are bounded by the
document frequency of each topic's rarest token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.dates import in_year_range, year_bounds
from quire.functions.text import article_content, tokens
from quire.session import cut_lineage
from quire.sources.topics import valid_topics

# BM25 (Robertson & Zaragoza 2009); idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
K1 = 1.2
B = 0.75
SCORE_DP = 6


@dataclass(frozen=True)
class CorpusStats:
    n_docs: int
    avgdl: float


def doc_tokens(arts: DataFrame) -> DataFrame:
    """(doc_id, pmid, year, toks) of the article text (title, newline, abstract)."""
    return arts.select(
        "doc_id", "pmid",
        F.year("publication_date_parsed").alias("year"),
        tokens(article_content(F.col("title"), F.col("abstract"))).alias("toks"))


def corpus_stats_frame(dt: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl). Compute once per corpus version and keep."""
    return dt.agg(F.count(F.lit(1)).alias("n_docs"),
                  F.avg(F.size("toks").cast("double")).alias("avgdl"))


def corpus_stats(dt: DataFrame) -> CorpusStats:
    row = corpus_stats_frame(dt).first()
    return CorpusStats(int(row["n_docs"]), float(row["avgdl"] or 0.0))


# Every document emits one posting of this (otherwise impossible, empty) token,
# so that it has a row, and corpus statistics come out of the same pass.
DOC_ROW = ""


def holds_any(toks, terms) -> Column:
    """Whether a token array holds one of the constant ``terms``, a term's
    tokens adjacent and in order."""
    phrases = F.array(*(tokens(F.lit(t)) for t in terms)).cast("array<array<string>>")
    spaced = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return F.exists(phrases, lambda p: (F.size(p) > 0) & F.when(
        F.size(p) == 1, F.array_contains(toks, F.get(p, F.lit(0)))).otherwise(
        F.contains(spaced, F.concat(F.lit(" "), F.array_join(p, " "), F.lit(" ")))))


def postings(dt: DataFrame, vocabulary: DataFrame, effect_terms=()) -> DataFrame:
    """One row per document: doc_id, pmid, year, dl (length), effect (whether
    it holds an effect term) and words, the places (token, pos) of its tokens
    of ``vocabulary`` (column token)."""
    marker = vocabulary.sparkSession.range(1).select(F.lit(DOC_ROW).alias("token"))
    doc = ["doc_id", "pmid", "year", "dl", "effect"]
    # Two selects: the exploded rows must not carry the token array along. The
    # outer explode (no array is empty) keeps Spark from adding a filter on the
    # array, which would tokenise the text once more.
    rows = (dt.select("doc_id", "pmid", "year", F.size("toks").alias("dl"), holds_any(F.col("toks"), effect_terms).alias("effect"),
                      F.concat("toks", F.array(F.lit(DOC_ROW))).alias("marked"))
            .select(*doc, F.posexplode_outer("marked").alias("pos", "token")))
    rows = rows.join(vocabulary.select("token").unionByName(marker).distinct(), "token", "left_semi")
    places = F.collect_list(F.when(F.col("token") != DOC_ROW, F.struct("token", "pos")))
    return rows.groupBy(*doc).agg(places.alias("words"))


@dataclass(frozen=True)
class PostingsIndex:
    """Postings of a corpus written once for a vocabulary and effect terms;
    matches whose tokens are in it share it instead of scanning the corpus."""
    df: DataFrame
    effect_terms: tuple = ()

    def stats(self) -> CorpusStats:
        """G7 from the lengths: a small aggregate, no pass over the texts."""
        row = self.df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("a")).first()
        return CorpusStats(int(row["n"]), float(row["a"] or 0.0))


def build_index(dt: DataFrame, vocabulary: DataFrame, effect_terms=()) -> PostingsIndex:
    return PostingsIndex(cut_lineage(postings(dt, vocabulary, effect_terms), "postings"), tuple(effect_terms))


def topic_vocabulary(topics: DataFrame, effect_terms) -> DataFrame:
    """Distinct tokens of the topics and effect terms."""
    return topic_terms(topics, effect_terms).select("token").distinct()


def document_frequency(post: DataFrame) -> DataFrame:
    return (post.select(F.explode(F.array_distinct("words.token")).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("df")))


def idf(df, n_docs: int) -> Column:
    n = F.lit(float(n_docs))
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_part(weight, tf, dl, stats: CorpusStats, k1: float = K1, b: float = B) -> Column:
    avgdl = F.lit(stats.avgdl if stats.avgdl > 0 else 1.0)
    tf = tf.cast("double")
    return weight * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


# --------------------------------------------------------------------------- topics


def topic_groups(topics: DataFrame, effect_terms) -> DataFrame:
    """(topic_id, lo, hi, kind, gidx, toks, glen): one row per term group.

    Groups: the compound phrase, the disease phrase and each effect term. A
    group matches only with its tokens adjacent and in order.
    """
    lo, hi = year_bounds(F.col("start_year"), F.col("end_year"))
    effects = [F.struct(F.lit("effect").alias("kind"), F.lit(i).alias("gidx"),
                        tokens(F.lit(t)).alias("toks"))
               for i, t in enumerate(effect_terms)]
    groups = F.array(
        F.struct(F.lit("compound").alias("kind"), F.lit(0).alias("gidx"),
                 tokens(F.col("compound")).alias("toks")),
        F.struct(F.lit("disease").alias("kind"), F.lit(0).alias("gidx"),
                 tokens(F.col("disease")).alias("toks")),
        *effects)
    return (valid_topics(topics)
            .select("topic_id", lo.alias("lo"), hi.alias("hi"),
                    F.explode(groups).alias("g"))
            .select("topic_id", "lo", "hi", "g.kind", "g.gidx", "g.toks",
                    F.size("g.toks").alias("glen"))
            .filter(F.col("glen") > 0))


def topic_terms(topics: DataFrame, effect_terms) -> DataFrame:
    """(topic_id, lo, hi, kind, gidx, glen, offset, token)."""
    return topic_groups(topics, effect_terms).select(
        "topic_id", "lo", "hi", "kind", "gidx", "glen", F.posexplode("toks").alias("offset", "token"))


def holds_phrase(words, toks) -> Column:
    """Whether the places ``words`` (token, pos) have the tokens ``toks``
    adjacent and in order; one token is a phrase of length one."""
    starts = F.transform(toks, lambda t, i: F.transform(F.filter(words, lambda w: w["token"] == t), lambda w: w["pos"] - i))
    common = F.aggregate(F.slice(starts, 2, F.size(starts)), F.get(starts, F.lit(0)), F.array_intersect)
    return F.size(common) > 0


def topic_score(words, stats: CorpusStats) -> Column:
    """BM25 of a document's places over a topic's ``weights``, null unless it
    holds both phrases of the topic."""
    def scored(own):
        score = F.aggregate("weights", F.lit(0.0), lambda s, w: s + bm25_part(
            w["idf"], F.size(F.filter(own, lambda x: x["token"] == w["token"])), F.col("dl"), stats))
        return F.when(holds_phrase(own, F.col("compound")) & holds_phrase(own, F.col("disease")), F.round(score, SCORE_DP))
    # The lambda over a one-element array binds the topic's places to one name.
    own = F.filter(words, lambda x: F.array_contains("weights.token", x["token"]))
    return F.get(F.transform(F.array(own), scored), F.lit(0))


def match_topics(arts: DataFrame, topics: DataFrame, effect_terms,
                 stats: CorpusStats | None = None, dt: DataFrame | None = None,
                 index: PostingsIndex | None = None) -> DataFrame:
    """P1 + P2 + J6 + BM25: (topic_id, doc_id, pmid, year, score) of every
    article that holds the compound, the disease and one effect term, within
    the topic's year range, scored by BM25 over the topic's distinct tokens.

    A topic whose compound or disease has no token matches nothing here and is
    reported as an error by ``topic_reports``. An ``index`` has the effect
    terms built in; other ones are an error."""
    terms = topic_terms(topics, effect_terms)
    if index is None:
        index = build_index(dt if dt is not None else doc_tokens(arts), terms.select("token").distinct(), effect_terms)
    if index.effect_terms != tuple(effect_terms):
        raise ValueError("the index was built for other effect terms")
    post, stats = index.df, stats or index.stats()

    # One row per topic: its rarest compound or disease token as anchor (df 0
    # where no document holds one of them), its two phrases and its weights.
    named = F.col("kind") != "effect"
    dfreq = document_frequency(post)
    weighed = terms.join(dfreq, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))

    def phrase(kind):
        found = F.collect_list(F.when(F.col("kind") == kind, F.struct("offset", "token")))
        return F.transform(F.array_sort(found), lambda x: x["token"]).alias(kind)
    rows = cut_lineage(weighed.groupBy("topic_id", "lo", "hi").agg(
        F.min(F.when(named, F.struct("df", "token"))).alias("a"), phrase("compound"), phrase("disease"),
        F.array_sort(F.collect_set(F.struct("token", idf(F.col("df"), stats.n_docs).alias("idf")))).alias("weights")),
        "topic-rows").filter("a.df > 0 AND size(compound) > 0 AND size(disease) > 0")

    anchors = rows.select("topic_id", "lo", "hi", F.col("a.token").alias("token"))
    candidates = (post.filter("effect").select("doc_id", "year", F.explode(F.array_distinct("words.token")).alias("token"))
                  .join(anchors, "token").filter(in_year_range(F.col("year"), F.col("lo"), F.col("hi")))
                  .select("topic_id", "doc_id"))
    pairs = (candidates.join(rows.select("topic_id", "compound", "disease", "weights"), "topic_id")
             .join(post.select("doc_id", "pmid", "year", "dl", "words"), "doc_id"))
    return (pairs.select("topic_id", "doc_id", "pmid", "year", topic_score(F.col("words"), stats).alias("score"))
            .filter("score IS NOT NULL"))


def top_k(scored: DataFrame, key: str, k: int, order_key: str = "pmid") -> DataFrame:
    """The k best rows per ``key`` by score, ties by ``order_key``.

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so each map task sends at most k rows per key even
    when one key holds most of the candidates.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc(order_key))
    return (scored.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def search_literature(arts: DataFrame, topics: DataFrame, effect_terms,
                      k: int = 5, **kw) -> DataFrame:
    """The k most relevant matching articles per topic, with ``rank``."""
    return top_k(match_topics(arts, topics, effect_terms, **kw), "topic_id", k)
