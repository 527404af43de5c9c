"""Inputs that stand in for remote services and user calls in the registered
queries and tests: topic tables, publication dates, recorded model responses,
a caller model. The engine itself does not import this module.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topics with phrases and letters beyond a-z that occur in the synthetic corpus.
PHRASE_TOPICS = [
    (0, "Thanedble the", "of the", None, None, False),
    (1, "anea eriner thanea", "the and", None, None, False),
    (2, "für", "und der", None, None, False),
    (3, "de la", "ré", None, None, False),
    (4, "the the", "is", 2000, None, False),
    (5, "the of anea eriner", "für", None, None, False),
    (6, "维生素D", "抑郁症", None, None, False),
]
PHRASE_EFFECTS = ("er", "attion to", "la de")

# Topics of the test fixtures: (topic_id, compound, disease, start, end, refresh).
FIXTURE_TOPICS = [
    (0, "ther", "ble", None, None, False),
    (1, "thth", "tion", 2000, None, False),
    (2, "thon", "thble", None, 2010, False),
    (3, "der", "und", 1995, 2015, False),
    (4, "than", "thre", 0, 0, False),
    (5, "le", "que", None, None, False),
    (6, "quercetin", "cancer", None, None, False),
]
# Effect terms that occur in the synthetic corpus (the default three do not).
FIXTURE_EFFECT_TERMS = ("er", "ing", "ed")

# Past runs that fill the analysis store of the fixtures (compound, disease,
# years, time): topic 0 twice, topic 2 once, topic 3 once with no paper.
HISTORY_RUNS = [
    (100, "ther", "ble", None, None, _dt.datetime(2024, 1, 1)),
    (101, "ther", "ble", 2010, None, _dt.datetime(2024, 2, 1)),
    (102, "thon", "thble", None, 2010, _dt.datetime(2024, 1, 15)),
    (103, "der", "und", 1900, 1901, _dt.datetime(2024, 1, 20)),
]

# Cue words that occur in the synthetic corpus.
LEXICON_POSITIVE = ("er", "ing")
LEXICON_NEGATIVE = ("ed", "tion")


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def raw_date(doc_id: Column) -> Column:
    """The stand-in MEDLINE ``DP`` string of a document (seven shapes)."""
    y = (F.lit(1990) + F.pmod(doc_id, F.lit(35))).cast("string")
    mm = _pad2(F.lit(1) + F.pmod(doc_id, F.lit(12)))
    dd = _pad2(F.lit(1) + F.pmod(doc_id, F.lit(28)))
    kind = F.pmod(doc_id, F.lit(7))
    return (F.when(kind == 0, F.concat(y, F.lit("-"), mm, F.lit("-"), dd))
            .when(kind == 1, F.concat(y, F.lit("/"), mm))
            .when(kind == 2, y)
            .when(kind == 3, F.concat(y, F.lit(" Jan 15")))
            .when(kind == 4, F.concat(y, F.lit("Spring")))
            .when(kind == 5, F.lit(""))
            .otherwise(F.concat(y, F.lit("-13-01"))))


# Recorded responses: derived from the id by a fixed rule, with the variety a
# model produces: valid objects, an unknown label, a missing key, no JSON.

def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def recorded_response(doc_id: Column) -> Column:
    d = doc_id
    ds = d.cast("string")
    effect = (F.when(F.pmod(d, F.lit(5)) == 0, "positive")
              .when(F.pmod(d, F.lit(5)) == 1, "negative")
              .when(F.pmod(d, F.lit(5)) == 2, "neutral")
              .otherwise("unclear"))
    strength = (F.when(F.pmod(d, F.lit(3)) == 0, "strong")
                .when(F.pmod(d, F.lit(3)) == 1, "moderate")
                .otherwise("weak"))
    f0 = _q(F.concat(F.lit("f"), ds, F.lit(".0")))
    f1 = _q(F.concat(F.lit("f"), ds, F.lit(".1")))
    nf = F.pmod(d, F.lit(4))
    findings = (F.when(nf == 0, F.lit(""))
                .when(nf == 1, F.concat(F.lit(', "findings": ['), f0, F.lit("]")))
                .otherwise(F.concat(F.lit(', "findings": ['), f0, F.lit(", "), f1, F.lit("]"))))
    obj = F.concat(F.lit('{"effect_type": '), _q(effect),
                   F.lit(', "evidence_strength": '), _q(strength), findings,
                   F.lit(', "conclusion": '), _q(F.concat(F.lit("c"), ds)), F.lit("}"))
    return F.when(F.pmod(d, F.lit(5)) == 4, F.lit("no object here")) \
        .otherwise(F.concat(F.lit("Sure: "), obj, F.lit(" done")))


def recorded_responses(documents: DataFrame) -> DataFrame:
    """``(pmid, response)`` for every document."""
    return documents.select(F.col("doc_id").cast("string").alias("pmid"),
                            recorded_response(F.col("doc_id")).alias("response"))


def cue_model(prompts):
    """A stand-in caller model for K3: counts cue words in each prompt and
    answers with a JSON object (runs in Python workers via mapInPandas)."""
    import json

    import regex

    from quire.functions.text import TOKEN_RUN
    rule = regex.compile(regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), TOKEN_RUN), regex.V1)
    out = []
    for p in prompts:
        toks = rule.findall((p or "").lower())
        score = sum(t in LEXICON_POSITIVE for t in toks) - sum(t in LEXICON_NEGATIVE for t in toks)
        eff = "positive" if score > 0 else "negative" if score < 0 else "neutral"
        mag = abs(score)
        strength = "strong" if mag >= 5 else "moderate" if mag >= 2 else "weak"
        out.append("Result: " + json.dumps({"effect_type": eff, "evidence_strength": strength,
                                            "findings": [f"score {score}"]}))
    return out
