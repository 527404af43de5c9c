"""Quality rules from cross-document line frequency (DataFrame functions only).

A line's key is the line without white space at its ends, A-Z lower-cased. A
host (``source``) holds a line above limit if more than ``MIN_DOCS`` and more
than ``HOST_SHARE`` of its distinct documents have it. Such lines are removed,
and a document that loses more than ``MAX_LOST`` of its words is depleted and
rejected. Documents that fail the base rules are rejected as well.

Distinct documents: a document counts by its whole set of normalised lines, on
both sides of the share test. Copies, in whatever order, case or number their
lines stand, are one document; pages of a template are as many as they differ.

Plan: one scan computes the base figures and the line hashes and writes them
without the texts; the counts are partial aggregates over hashes; the verdict
joins lines with the lines above limit, again hashes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.llm.common import ROW_ID, number_rows, quoted, table, without
from quire.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20        # percent of words in repeated windows
MIN_DOCS = 20
HOST_SHARE = 0.1
MAX_LOST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def window_hashes(hashed):
    """Hash of every 5-word window, from the column of word hashes."""
    starts = F.slice(hashed, 1, F.greatest(F.size(hashed) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(hashed, i + k) for k in range(1, WINDOW))))


def repeated_words(windows):
    """Words covered by windows that occur twice or more: window hashes are
    sorted with their positions, equal neighbours mark repeats, and the sorted
    positions of these give the covered words."""
    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A lambda over a one-element array binds the sorted windows to one name.
    return F.get(F.transform(F.array(order), _covered), F.lit(0))


def _covered(order):
    n, none = F.size(order), F.array(F.lit(None).cast("long"))
    before = F.concat(none, F.slice(order["h"], 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(order["h"], 2, F.greatest(n - 1, F.lit(0))), none)
    near = F.arrays_zip(order["h"].alias("h"), order["i"].alias("i"), before.alias("b"), after.alias("a"))
    at = F.array_sort(F.transform(F.filter(near, lambda x: x["a"].eqNullSafe(x["h"]) | x["b"].eqNullSafe(x["h"])),
                                  lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, zero, lambda s, i: F.struct(
        (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])


def measured(docs: DataFrame, *extra) -> DataFrame:
    """Base figures and hashed lines of every text (null: no words), one scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [docs.select(c).columns[0] for c in extra]
    df = docs.select(*extra, text.alias("text"), words(text).alias("w"))
    df = df.select("*", F.transform("w", lambda w: F.xxhash64(w)).alias("hashed"),
                   F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    df = df.withColumn("wins", window_hashes(F.col("hashed")))
    df = df.select(
        *names,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("wins")) < F.size("wins"), repeated_words(F.col("wins")))
        .otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(
            line_hash(x).alias("line"), F.size(words(x)).alias("words"))).alias("lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def line_key(line):
    return F.translate(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), UPPER, LOWER)


def line_hash(line):
    """64-bit hash of a line's key."""
    return F.xxhash64(line_key(line))


def lines_above_limit(slim: DataFrame, min_docs: int, host_share: float) -> DataFrame:
    """(host, line) of the lines above limit; ``slim`` has host and lines."""
    whole = F.xxhash64(F.sort_array(F.array_distinct("lines.line"))).alias("doc")
    hosts = slim.select("host", whole).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = (slim.select("host", whole, F.explode("lines.line").alias("line")).distinct()
              .groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs))
    return counts.join(hosts, "host").where(F.col("docs") > host_share * F.col("host_docs")).select("host", "line")


def verdicts(slim: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE,
             max_lost: float = MAX_LOST) -> DataFrame:
    """``slim`` (a written table with row ids, host, figures and lines) plus
    ``n_lost_words``, ``lost`` (hashes of removed lines) and ``kept``."""
    above = lines_above_limit(slim, min_docs, host_share)
    own = slim.select(ROW_ID, "host", F.explode("lines").alias("x")).select(
        ROW_ID, "host", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    own = own.groupBy(ROW_ID, "host", "line").agg(F.sum("words").alias("words"))
    lost = own.join(above, ["host", "line"]).groupBy(ROW_ID).agg(
        F.sum("words").alias("n_lost_words"), F.collect_set("line").alias("lost"))
    out = slim.drop("lines").join(lost, ROW_ID, "left")
    out = out.withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)).cast("long"))
    depleted = F.col("n_lost_words") > max_lost * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def _host():
    return F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")


def judge(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: doc_id, the figures, base_failed, n_lost_words, kept.

    Null text: no words, so it fails the base rules. Null source: a host of
    its own, with the empty source. Repeated rows get equal verdicts. An empty
    table gives an empty table.
    """
    slim = number_rows(measured(docs, F.col("doc_id"), _host()), "quality")
    return verdicts(slim, **limits).drop(ROW_ID, "host", "lost")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without rejected documents and, in the rest, without the lines
    above limit; the input's columns."""
    numbered = number_rows(docs, "quality-docs")
    slim = cut_lineage(measured(numbered, F.col(ROW_ID), _host()), "quality")
    kept = verdicts(slim, **limits).where("kept").select(ROW_ID, F.col("lost").alias("__lost"))
    text = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.array_join(
        F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__lost", line_hash(x))), "\n"))
    cols = without(numbered, ROW_ID, "__lost")
    return numbered.join(kept, ROW_ID).select(
        *(text.alias(c) if c.lower() == "text" else quoted(c) for c in cols))


def op6(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
