"""Annotation responses: cut the JSON out of free text and type it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Greedy: from the first '{' to the last '}' after it; '' when there is none.
JSON_SPAN = r"(?s)\{.*\}"


def extract_json(text: Column) -> Column:
    """The JSON span of a response, or null when there is none."""
    span = F.regexp_extract(F.coalesce(text, F.lit("")), JSON_SPAN, 0)
    return F.when(span != F.lit(""), span)


def single_json_value(span: Column) -> Column:
    """True when ``span`` is exactly one JSON value. The parsers stop after the
    first value and ignore what follows ('{}x' parses), and also after the
    first closing bracket of a wrapper. So the span must be the only element
    of an array and, between two other keys, one value of an object."""
    alone = F.json_array_length(F.concat(F.lit("["), span, F.lit("]"))) == 1
    keys = F.json_object_keys(F.concat(F.lit('{"a":'), span, F.lit(',"z":1}')))
    return F.coalesce(alone & (F.size(keys) == 2), F.lit(False))


def parse_annotation(text: Column) -> Column:
    """Dynamic parse to VARIANT; null for no span, invalid JSON or text
    after the JSON value (as Python's json.loads)."""
    span = extract_json(text)
    return F.when(single_json_value(span), F.try_parse_json(span))


def annotation_fields(v: Column) -> dict[str, Column]:
    """The four keys the report reads; a missing key is null.

    ``findings`` that is not an array of strings (null, a string) gives null,
    so it adds nothing to the report.
    """
    return {
        "effect_type": F.try_variant_get(v, "$.effect_type", "string"),
        "evidence_strength": F.try_variant_get(v, "$.evidence_strength", "string"),
        "findings": F.try_variant_get(v, "$.findings", "array<string>"),
        "conclusion": F.try_variant_get(v, "$.conclusion", "string"),
    }


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
