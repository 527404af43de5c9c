"""K2/K3 hooks: caller models run inside Spark; C14 quarantine split."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.functions.validate import split_valid
from quire.operators.annotate import annotate_with
from quire.operators.search import search_similar_articles
from quire.schemas import ARTICLE


def test_annotate_with_model(spark):
    fetched = spark.createDataFrame(
        [(0, 1, "p1", "good result", "abs", "c", "d"), (0, 2, "p2", "bad", "abs", "c", "d")],
        "topic_id int, rank int, pmid string, title string, abstract string, compound string, disease string")

    def model(prompts):
        out = []
        for p in prompts:
            eff = "positive" if "good result" in p else "negative"
            out.append('ok {"effect_type": "%s", "findings": ["x"]}' % eff)
        return out

    rows = {r["pmid"]: r for r in annotate_with(fetched, model).collect()}
    assert rows["p1"]["effect_type"] == "positive" and rows["p2"]["effect_type"] == "negative"
    assert rows["p1"]["findings"] == ["x"] and rows["p1"]["annotation_ok"]


def test_custom_embedder(spark):
    @F.pandas_udf("array<float>")
    def length_embed(s: pd.Series) -> pd.Series:
        return pd.Series([np.array([len(x), 1.0], dtype=np.float32) for x in s])

    store = spark.createDataFrame(
        [("p1", "t", "a", [10.0, 1.0], "c", "d"), ("p2", "t", "a", [1.0, 1.0], "c", "d")],
        "pmid string, title string, abstract string, content_vector array<float>, compound string, disease string")
    q = spark.createDataFrame([(7, "x" * 10)], "query_id long, text string")
    hits = search_similar_articles(store, q, 1, embed=length_embed).collect()
    assert hits[0]["pmid"] == "p1" and abs(hits[0]["similarity"] - 1.0) < 1e-6


def test_validation_split(spark):
    df = spark.createDataFrame(
        [("1", "t", "a", ["x"], None, "j", []), (None, "t", "a", [], None, "j", []),
         ("3", "t", "a", ["x", None], None, "j", [])],
        "pmid string, title string, abstract string, authors array<string>, "
        "publication_date timestamp_ntz, journal string, keywords array<string>")
    df = df.withColumn("publication_date", F.coalesce("publication_date", F.lit("2020-01-01").cast("timestamp_ntz")))
    good, bad = split_valid(df, ARTICLE)
    assert [r["pmid"] for r in good.collect()] == ["1"]
    errs = {r["pmid"]: r["validation_errors"] for r in bad.collect()}
    assert errs == {None: ["pmid"], "3": ["authors"]}


def test_tools_chain_with_transform(spark, ctx001):
    from quire.tools import search_literature
    from quire.fixtures import FIXTURE_EFFECT_TERMS
    r = ctx001.topics().transform(search_literature, ctx001.arts, 3, FIXTURE_EFFECT_TERMS)
    assert r.groupBy("topic_id").count().filter("count > 3").count() == 0
    assert r.count() > 0


def test_a_loaded_model_is_set_up_once_per_task(spark, tmp_path):
    from quire.operators.annotate import annotate_loaded
    log = str(tmp_path)

    def load():
        import json
        import os
        import uuid
        token, calls = uuid.uuid4().hex, [0]
        open(os.path.join(log, token), "w").close()

        def model(prompts):
            calls[0] += 1
            assert len(prompts) <= 5
            return [json.dumps({"effect_type": "neutral", "findings": [token, str(calls[0])]}) for _ in prompts]
        return model

    fetched = spark.range(300).repartition(3).selectExpr(
        "0 topic_id", "cast(id as int) rank", "concat('p', id) pmid", "'t' title", "'a' abstract",
        "'c' compound", "'d' disease")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = annotate_loaded(fetched, load, batch_size=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokens = {r["findings"][0] for r in rows}
    assert len(rows) == 300 and len(tokens) == 3 == len(list(tmp_path.iterdir()))
    assert max(int(r["findings"][1]) for r in rows) >= 15       # many calls, one load


def test_no_prompt_no_load_and_a_short_answer_fails(spark):
    import pytest
    from quire.operators.annotate import annotate_loaded
    schema = "topic_id int, rank int, pmid string, title string, abstract string, compound string, disease string"

    def broken():
        raise RuntimeError("loaded")

    assert annotate_loaded(spark.createDataFrame([], schema), broken).count() == 0
    one = spark.createDataFrame([(0, 1, "p1", "t", "a", "c", "d")], schema)
    with pytest.raises(Exception, match="0 answers to 1 prompts"):
        annotate_loaded(one, lambda: lambda prompts: []).collect()
