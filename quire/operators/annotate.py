"""Annotation: prompt, response, typed fields.

Three ways to obtain the response text of a (topic, article):
  * ``annotate_recorded`` joins a recorded ``(pmid, response)`` table (A6 a);
  * ``annotate_with`` runs a caller's model over Arrow batches of prompts with
    ``mapInPandas`` (A6 b / K3); ``annotate_loaded`` has each task load its
    model once, before its first prompt;
  * ``annotate_lexicon`` is a deterministic Catalyst rule for offline runs.
All three feed the same parse, so the report code sees one shape:
``annotation_ok`` plus ``effect_type``, ``evidence_strength``, ``findings``,
``conclusion``.
"""

from __future__ import annotations

from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.annotation import annotation_fields, is_object, parse_annotation
from quire.functions.text import render_prompt, tokens


def with_prompt(fetched: DataFrame) -> DataFrame:
    """C5 per (topic, article); needs compound, disease, title, abstract."""
    return fetched.withColumn(
        "prompt", render_prompt(F.col("compound"), F.col("disease"),
                                F.col("title"), F.col("abstract")))


def parse_responses(df: DataFrame) -> DataFrame:
    """C6-C8 on column ``response``: typed fields plus ``annotation_ok``.

    A missing response, text without a JSON span, invalid JSON or JSON that is
    not an object is an annotation error (the reference raises).
    """
    v = parse_annotation(F.col("response"))
    f = annotation_fields(F.col("_v"))
    return (df.withColumn("_v", v)
            .withColumn("annotation_ok", F.col("_v").isNotNull() & is_object(F.col("_v")))
            .select("*", *[F.when(F.col("annotation_ok"), c).alias(n) for n, c in f.items()])
            .drop("_v"))


def annotate_recorded(fetched: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join of the fetched articles with recorded responses. The big
    response table is first cut to the fetched ids by a semi join."""
    keys = ["topic_id", "pmid"] if "topic_id" in responses.columns else ["pmid"]
    ids = fetched.select(*keys).distinct()
    wanted = responses.join(ids, keys, "left_semi")
    drop = [c for c in ("conclusion", "effect_type", "evidence_strength") if c in fetched.columns]
    return parse_responses(fetched.drop(*drop).join(wanted, keys, "left"))


def annotate_with(fetched: DataFrame, model: Callable[[Iterable[str]], Iterable[str]]) -> DataFrame:
    """K3: ``model`` maps a batch of prompts to a batch of response texts.

    It runs inside ``mapInPandas``; each task builds its batches from its own
    partition, so the work spreads with the data."""
    return annotate_loaded(fetched, lambda: model)


def annotate_loaded(fetched: DataFrame, load: Callable[[], Callable[[Iterable[str]], Iterable[str]]],
                    batch_size: int | None = None) -> DataFrame:
    """K3 with a model that is costly to set up: ``load`` returns the model. It is
    called at most once in a task, and only where the task has a prompt; what
    it returns lives in the worker and is not shipped. ``batch_size``: most
    prompts that a call of the model gets (default: an Arrow batch). The model
    must answer each prompt it gets."""
    base = with_prompt(fetched)
    out_schema = T.StructType(base.schema.fields + [T.StructField("response", T.StringType())])

    def run(batches):
        model = None
        for pdf in batches:
            if len(pdf) and model is None:
                model = load()
            prompts, answers = pdf["prompt"].tolist(), []
            for i in range(0, len(prompts), batch_size or len(prompts) or 1):
                answers += model(prompts[i:i + (batch_size or len(prompts))])
            if len(answers) != len(prompts):
                raise ValueError(f"the model gave {len(answers)} answers to {len(prompts)} prompts")
            yield pdf.assign(response=pd.Series(answers, index=pdf.index, dtype="object"))

    drop = [c for c in ("conclusion", "effect_type", "evidence_strength") if c in fetched.columns]
    return parse_responses(base.mapInPandas(run, out_schema).drop(*drop))


# ---------------------------------------------------------------- lexicon rule

# Default cue words for English abstracts (ours; the reference uses a model).
POSITIVE_CUES = ("improved", "improves", "improvement", "benefit", "beneficial",
                 "effective", "reduced", "protective", "inhibited", "suppressed")
NEGATIVE_CUES = ("worse", "worsened", "harmful", "toxic", "toxicity", "adverse",
                 "increased", "ineffective", "failed", "risk")
SENTENCE_SPLIT = r"[.!?]\s+"


def lexicon_response(title, abstract, positive=POSITIVE_CUES, negative=NEGATIVE_CUES,
                     max_findings: int = 3):
    """A JSON response text from cue counts: the sign of (positive - negative)
    gives the effect, its size the strength (>=5 strong, >=2 moderate, else
    weak); findings are the first sentences holding a cue; the conclusion is
    the last sentence of the abstract."""
    toks = tokens(F.concat_ws("\n", title, abstract))
    pos = F.array(*[F.lit(t) for t in positive])
    neg = F.array(*[F.lit(t) for t in negative])
    npos = F.size(F.filter(toks, lambda t: F.array_contains(pos, t)))
    nneg = F.size(F.filter(toks, lambda t: F.array_contains(neg, t)))
    score = npos - nneg
    effect = F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")
    mag = F.abs(score)
    strength = F.when(mag >= 5, "strong").when(mag >= 2, "moderate").otherwise("weak")
    sentences = F.filter(F.split(F.coalesce(abstract, F.lit("")), SENTENCE_SPLIT),
                         lambda s: s != F.lit(""))
    cues = F.concat(pos, neg)
    findings = F.slice(F.filter(sentences, lambda s: F.arrays_overlap(tokens(s), cues)),
                       1, max_findings)
    conclusion = F.coalesce(F.try_element_at(sentences, F.lit(-1)), F.lit(""))
    obj = F.struct(effect.alias("effect_type"), strength.alias("evidence_strength"),
                   findings.alias("findings"), conclusion.alias("conclusion"))
    return F.to_json(obj)


def annotate_lexicon(fetched: DataFrame, positive=POSITIVE_CUES, negative=NEGATIVE_CUES) -> DataFrame:
    drop = [c for c in ("conclusion", "effect_type", "evidence_strength") if c in fetched.columns]
    return parse_responses(
        fetched.drop(*drop).withColumn(
            "response", lexicon_response(F.col("title"), F.col("abstract"), positive, negative)))


def model_from_pandas(fn: Callable[[pd.Series], pd.Series]):
    """Adapter: a pandas ``Series -> Series`` model for ``annotate_with``."""
    return lambda prompts: fn(pd.Series(list(prompts), dtype="object")).tolist()
