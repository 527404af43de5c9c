"""P1/J6 including multi-word (phrase) terms, checked against brute force."""
import re


from quire.operators.match import match_topics
from quire.sources.corpus import articles

DOCS = [
    (1, "Vitamin D and rickets\nvitamin d treatment helped"),
    (2, "D vitamin for rickets\nno effect seen"),            # tokens present, not adjacent in order
    (3, "vitamin x d\nrickets therapy"),                     # not adjacent
    (4, "title\nVITAMIN-D reduced rickets; effect strong"),  # adjacent after tokenising
    (5, "nothing here\nat all"),
    (6, "vitamin d\nbone rickets disease, no therapy word"),  # has therapy
]
TOPICS = [(0, "vitamin d", "rickets", None, None, False), (1, "rickets", "vitamin", None, None, False)]
EFFECT = ("treatment", "therapy", "effect")


def tok(s):
    return [t for t in re.split("[^a-z0-9]+", s.lower()) if t]


def has_phrase(toks, phrase):
    n = len(phrase)
    return any(toks[i:i + n] == phrase for i in range(len(toks) - n + 1))


def brute(text, compound, disease):
    t = tok(text)
    return (has_phrase(t, tok(compound)) and has_phrase(t, tok(disease))
            and any(has_phrase(t, tok(e)) for e in EFFECT))


def test_phrase_match(spark):
    docs = spark.createDataFrame([(d, t, "en", "s") for d, t in DOCS],
                                 "doc_id long, text string, lang string, source string")
    topics = spark.createDataFrame(TOPICS, "topic_id int, compound string, disease string, "
                                           "start_year int, end_year int, refresh boolean")
    got = {(r["topic_id"], r["doc_id"]) for r in match_topics(articles(docs), topics, EFFECT).collect()}
    want = {(tid, d) for tid, c, dz, *_ in TOPICS for d, t in DOCS if brute(t, c, dz)}
    assert got == want
    assert (0, 1) in got and (0, 2) not in got and (0, 4) in got


def test_postings_index_gives_same_matches(spark, ctx001):
    from quire.operators.match import build_index, topic_vocabulary
    from quire.fixtures import FIXTURE_EFFECT_TERMS
    t = ctx001.topics()
    words = topic_vocabulary(t, FIXTURE_EFFECT_TERMS).unionByName(spark.createDataFrame([("unused",)], "token string"))
    idx = build_index(ctx001.dt, words, FIXTURE_EFFECT_TERMS)
    a = match_topics(ctx001.arts, t, FIXTURE_EFFECT_TERMS, dt=ctx001.dt, stats=ctx001.stats)
    b = match_topics(ctx001.arts, t, FIXTURE_EFFECT_TERMS, dt=ctx001.dt, index=idx)
    assert sorted(a.collect()) == sorted(b.collect())


TOPIC = "topic_id int, compound string, disease string, start_year int, end_year int, refresh boolean"


def _docs(spark, rows):
    return articles(spark.createDataFrame([(d, t, "en", "s") for d, t in rows],
                                          "doc_id long, text string, lang string, source string"))


def test_topics_in_other_scripts(spark):
    arts = _docs(spark, [(1, "维生素D与抑郁症\n有 effect"), (2, "抑郁症 维生素C effect"), (3, "café au lait, café effect"),
                         (4, "ビタミンと 抑郁 症 effect 维 生素D")])
    topics = spark.createDataFrame([(0, "维生素D", "抑郁症", None, None, False), (1, "caf", "lait", None, None, False),
                                    (2, "Café", "lait", None, None, False), (3, "?!", "lait", None, None, False)], TOPIC)
    got = {(r["topic_id"], r["doc_id"]) for r in match_topics(arts, topics, EFFECT).collect()}
    # White space between single-character tokens does not part them.
    assert got == {(0, 1), (0, 4), (2, 3)}


def test_a_topic_without_a_token_is_an_error_not_a_zero_report(spark):
    from quire.plans.answer import analyze_topics
    arts = _docs(spark, DOCS)
    topics = spark.createDataFrame([(0, "?!", "rickets", None, None, False), (1, "absent", "rickets", None, None, False)], TOPIC)
    responses = spark.createDataFrame([], "pmid string, response string")
    got = {r["topic_id"]: r["status"] for r in analyze_topics(arts, topics, EFFECT, responses)[0].collect()}
    assert got == {0: "error", 1: "ok"}


def test_topics_that_match_nothing_emit_no_rows(spark, ctx001):
    """Rows leaving the candidate join are bounded by the rarest token."""
    from quire.operators.match import build_index, topic_vocabulary
    from quire.fixtures import FIXTURE_EFFECT_TERMS
    topics = spark.createDataFrame([(i, f"absent{i}", "ther", None, None, False) for i in range(200)], TOPIC)
    out = match_topics(ctx001.arts, topics, FIXTURE_EFFECT_TERMS, dt=ctx001.dt,
                       index=build_index(ctx001.dt, topic_vocabulary(topics, FIXTURE_EFFECT_TERMS), FIXTURE_EFFECT_TERMS))
    out.write.format("noop").mode("overwrite").save()
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "CartesianProduct" not in plan


def test_tokens_of_long_runs_and_mixed_scripts(spark):
    from pyspark.sql import functions as F

    from quire.functions.text import tokens
    texts = ["é" * 200_000, "x" * 200_000 + " y", "Ünï-code 12a ٣٤ naïve", "維生素D・ビタミン ไทย", None, "_-!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", tokens(F.col("t")).alias("k")).collect()}
    assert got[0] == [texts[0]] and [len(x) for x in got[1]] == [200_000, 1]
    assert got[2] == ["ünï", "code", "12a", "٣٤", "naïve"]
    assert got[3] == ["維", "生", "素", "d", "・", "ビ", "タ", "ミ", "ン", "ไ", "ท", "ย"]
    assert got[4] == got[5] == []
