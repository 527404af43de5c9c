"""C6-C8 JSON span and parse cases (FIXTURES §4), G1-G5 report rules."""
import datetime as dt

from pyspark.sql import functions as F

from quire.operators.annotate import parse_responses
from quire.operators.report import topic_reports

FENCED = 'Here:\n```json\n{"effect_type": "negative",\n "findings": ["x"]}\n```'
CASES = [
    ('x {"effect_type":"positive","findings":["a","b"],"n":{"k":1}} tail', True, "positive", ["a", "b"]),
    (FENCED, True, "negative", ["x"]),
    ("no json", False, None, None),
    ("} {", False, None, None),
    ("{bad}", False, None, None),
    ('{"a":1,"a":2}', True, None, None),
    ('{"findings":null}', True, None, None),
    ('{"findings":"str"}', True, None, None),
    (None, False, None, None),
    ("{ }] ]]a}}", False, None, None),
    ("{}] [{}", False, None, None),
    ('{},"b":{}', False, None, None),
    ('{"a":{}},"b":{"c":1}', False, None, None),
    ('{"effect_type":"a]}"}', True, "a]}", None),
]


def test_parse_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "i int, response string")
    rows = {r["i"]: r for r in parse_responses(df).collect()}
    for i, (_, ok, eff, findings) in enumerate(CASES):
        assert rows[i]["annotation_ok"] is ok, CASES[i][0]
        assert rows[i]["effect_type"] == eff
        assert rows[i]["findings"] == findings


def test_duplicate_key_last_wins(spark):
    df = spark.createDataFrame([('{"effect_type":"neutral","effect_type":"positive"}',)], "response string")
    assert parse_responses(df).first()["effect_type"] == "positive"


def _ann(spark, rows):
    schema = ("topic_id int, rank int, pmid string, title string, annotation_ok boolean, "
              "effect_type string, evidence_strength string, findings array<string>, conclusion string")
    return spark.createDataFrame(rows, schema)


def _topics(spark, ids):
    return spark.createDataFrame([(i, f"c{i}", f"d{i}", None, None, False) for i in ids],
                                 "topic_id int, compound string, disease string, start_year int, "
                                 "end_year int, refresh boolean")


def test_report_counts_findings_and_empty_topic(spark):
    rows = [
        (1, 1, "a", "t", True, "positive", "strong", ["f1", "f2", "f3"], "c"),
        (1, 2, "b", "t", True, "unclear", "weak", None, "c"),          # counts in no bucket
        (1, 3, "c", "t", True, "negative", "moderate", ["f4", "f4", "f5"], "c"),  # duplicates kept
        (1, 4, "d", "t", True, "neutral", "weak", ["f6"], "c"),
    ]
    r = {x["topic_id"]: x for x in topic_reports(_topics(spark, [1, 2]), _ann(spark, rows),
                                                 dt.datetime(2024, 6, 1)).collect()}
    a = r[1]
    assert (a["total_papers"], a["positive_effects"], a["negative_effects"], a["neutral_effects"]) == (4, 1, 1, 1)
    assert a["positive_effects"] + a["negative_effects"] + a["neutral_effects"] <= a["total_papers"]
    assert a["key_findings"] == ["f1", "f2", "f3", "f4", "f4"]
    assert [x["rank"] for x in a["articles"]] == [1, 2, 3, 4]
    assert a["content"].startswith("c1对d1的分析报告：\n总计分析文献：4篇\n")
    assert a["content"].endswith("主要发现：f1, f2, f3, f4, f4")
    b = r[2]
    assert b["status"] == "ok" and b["total_papers"] == 0 and b["key_findings"] == []
    assert b["content"].endswith("主要发现：")


def test_fail_topic_vs_skip(spark):
    rows = [(1, 1, "a", "t", True, "positive", "strong", ["f"], "c"),
            (1, 2, "b", "t", False, None, None, None, None)]
    t = _topics(spark, [1])
    strict = topic_reports(t, _ann(spark, rows), dt.datetime(2024, 6, 1), "fail_topic").first()
    assert strict["status"] == "error" and strict["content"] is None and strict["positive_effects"] is None
    skip = topic_reports(t, _ann(spark, rows), dt.datetime(2024, 6, 1), "skip").first()
    assert skip["status"] == "ok" and skip["total_papers"] == 2 and skip["positive_effects"] == 1


def _py_span(text):
    start, end = text.find("{"), text.rfind("}") + 1
    return text[start:end] if start >= 0 and end > start else None


def _py_ok(text):
    import json
    span = _py_span(text)
    if span is None:
        return False
    try:
        return isinstance(json.loads(span), dict)
    except ValueError:
        return False


def test_span_and_parse_match_python_on_random_text(spark):
    from hypothesis import given, settings, strategies as st
    from quire.functions.annotation import extract_json
    samples = []

    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list('{}"a:1, []x\n')), max_size=16))
    def collect(s):
        samples.append(s)

    collect()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, response string")
    out = parse_responses(df.withColumn("span", extract_json(F.col("response")))).collect()
    for r in out:
        s = samples[r["i"]]
        assert r["span"] == _py_span(s), s
        assert r["annotation_ok"] == _py_ok(s), s
