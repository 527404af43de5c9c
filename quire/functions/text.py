"""Text expressions: tokens, article content, search text, prompt.

All of them are Catalyst expressions, so they run inside whole-stage codegen
(or, for the higher-order ones, in the JVM) and never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token rule: lower-case; a token is a run of letters, marks and digits of any
# script, but a single character in blocks of scripts written without spaces
# (such terms then match as phrases of adjacent characters): Thai and Lao,
# Myanmar, Khmer, kana, Han.
UNSPACED = (r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}"
            r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}")
# One class per run, so that a run of any length is matched without recursion.
TOKEN_RUN = rf"[{UNSPACED}]|[a-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]]+"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Search expression (C12):
#   "{compound} AND {disease} AND (treatment OR therapy OR effect)"
#   date suffix, both years: " AND ({start}[PDAT]:{end}[PDAT])"
#   start only: " AND {start}[PDAT]:3000[PDAT]"
#   end only:   " AND 1900[PDAT]:{end}[PDAT]"
DEFAULT_EFFECT_TERMS = ("treatment", "therapy", "effect")
OPEN_START_YEAR = 1900
OPEN_END_YEAR = 3000
# Annotation prompt (C5), as rendered, with its leading newline and indentation.
PROMPT_TEMPLATE = """
        请分析以下医学文献的内容，查找关于{compound}与{disease}之间的治疗效果的关键发现，并提取以下关键信息：

        标题：{title}
        摘要：{abstract}

        请以JSON格式返回以下关键信息：
        {{
            "effect_type": "positive/negative/neutral",
            "evidence_strength": "strong/moderate/weak",
            "findings": ["发现1", "发现2", ...],
            "conclusion": "总结性结论"
        }}
        """
# ---------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """array<string> of the lower-cased text's tokens, as one expression."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RUN), 0)


def article_content(title: Column, abstract: Column) -> Column:
    """The text that is embedded and matched: title, newline, abstract."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"),
                    F.coalesce(abstract, F.lit("")))


def whitespace_tokens(text: Column) -> Column:
    """K4 default token counter: white-space words of the trimmed text."""
    return F.size(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"))


def _py_str(c: Column) -> Column:
    # f-string rendering of an optional value: None prints as "None".
    return F.coalesce(c.cast("string"), F.lit("None"))


def topic_query_text(compound: Column, disease: Column, start_year: Column,
                     end_year: Column) -> Column:
    """The search expression the reference would send, as an audit column."""
    s = F.coalesce(start_year, F.lit(0))
    e = F.coalesce(end_year, F.lit(0))
    base = F.concat(_py_str(compound), F.lit(" AND "), _py_str(disease),
                    F.lit(" AND (treatment OR therapy OR effect)"))
    suffix = (F.when((s != 0) & (e != 0),
                     F.concat(F.lit(" AND ("), s.cast("string"), F.lit("[PDAT]:"),
                              e.cast("string"), F.lit("[PDAT])")))
              .when(s != 0, F.concat(F.lit(" AND "), s.cast("string"),
                                     F.lit(f"[PDAT]:{OPEN_END_YEAR}[PDAT]")))
              .when(e != 0, F.concat(F.lit(f" AND {OPEN_START_YEAR}[PDAT]:"),
                                     e.cast("string"), F.lit("[PDAT]")))
              .otherwise(F.lit("")))
    return F.concat(base, suffix)


def render_prompt(compound: Column, disease: Column, title: Column,
                  abstract: Column) -> Column:
    """The annotation prompt for one (topic, article)."""
    head, rest = PROMPT_TEMPLATE.split("{compound}", 1)
    mid1, rest = rest.split("{disease}", 1)
    mid2, rest = rest.split("{title}", 1)
    mid3, tail = rest.split("{abstract}", 1)
    tail = tail.replace("{{", "{").replace("}}", "}")
    return F.concat(F.lit(head), _py_str(compound), F.lit(mid1), _py_str(disease),
                    F.lit(mid2), F.coalesce(title, F.lit("")), F.lit(mid3),
                    F.coalesce(abstract, F.lit("")), F.lit(tail))


def is_blank(text: Column) -> Column:
    """P5: missing or only white space of any script (str.strip() == '')."""
    return F.coalesce(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "") == F.lit(""), F.lit(True))
