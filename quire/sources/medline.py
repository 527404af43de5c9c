"""MEDLINE tagged text: reader (A3), tag-to-column mapping (C1, P3), writer.

Records are blocks separated by a blank line, so the text source splits on
"\\n\\n" or, for files with CRLF lines, on "\\r\\n\\r\\n" (``lineSep``): a file is
split across tasks like any text file, and a record never needs more than its
own block. The first line end of each file says which; a block that holds
blank lines of the other kind is cut once more. A stream does not look into
its files beforehand and reads a CRLF file as one block. Inside a block:

* a line starting with six spaces continues the previous tag;
* a tag line is ``KEY`` (first four characters, right-trimmed), then from the
  seventh character on its value; trailing white space is dropped;
* text tags (PMID, TI, AB, DP, TA, ...) join all their lines with one space;
* list tags keep one element per line, except MH whose continuation lines are
  appended to the last element with a space (the usual MEDLINE parser rules);
* a blank continuation line stands for a line break.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import DEFAULT_FALLBACK, parse_pub_date, with_fallback

RECORD_SEP, CRLF_RECORD_SEP = "\n\n", "\r\n\r\n"
SNIFF_BYTES = 8192  # the first line end of a file lies within them, or LF is assumed
CONT = "\u0001"  # marks a folded continuation line inside one tag line
# Tags whose continuation lines fold into the last element.
FOLD_TAGS = ("MH", "AD")


# Characters before or at which ``$`` matches, beyond "\n": a pattern that ends
# in ``$`` is tried on strings alone whose last character lets it match.
_LINE_ENDS = ("\r", "\u0085", "\u2028", "\u2029")


def _rstrip(c: Column) -> Column:
    return F.when(F.substring(c, -1, 1).isin(*" \t\n\x0b\f", *_LINE_ENDS), F.regexp_replace(c, r"\s+$", "")).otherwise(c)


def _is_blank(c: Column) -> Column:
    return ~c.rlike(r"\S")


def record_blocks(text: Column) -> Column:
    """One row per record block of a read block, line ends normalised."""
    blocks = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\n+")
    blocks = F.when(text.contains("\r") | text.contains("\n\n"), blocks).otherwise(F.array(text))
    return F.explode_outer(blocks)


def parse_records(blocks: Column) -> Column:
    """array<struct<key:string, parts:array<string>>>: one entry per tag line,
    ``parts`` = its value and its continuation lines, in order."""
    b = F.when(blocks.startswith("\n") | F.substring(blocks, -1, 1).isin("\n", *_LINE_ENDS),
               F.regexp_replace(blocks, r"^\n+|\n+$", "")).otherwise(blocks)
    folded = F.replace(b, F.lit("\n      "), F.lit(CONT))
    lines = F.filter(F.split(folded, "\n"), lambda l: ~_is_blank(l))

    def entry(line):
        segs = F.split(line, CONT)
        parts = F.transform(segs, lambda s, i: F.when(
            i == 0, _rstrip(F.substring(s, 7, 1 << 30))).otherwise(
            F.when(_is_blank(s), F.lit("\n")).otherwise(_rstrip(s))))
        return F.struct(_rstrip(F.substring(line, 1, 4)).alias("key"), parts.alias("parts"))

    return F.filter(F.transform(lines, entry), lambda e: e["key"] != F.lit(""))


def tag_text(rec: Column, key: str) -> Column:
    """Text tag: every line of every occurrence joined by one space; null if absent."""
    vals = F.flatten(F.transform(F.filter(rec, lambda e: e["key"] == F.lit(key)),
                                 lambda e: e["parts"]))
    return F.when(F.size(vals) > 0, F.array_join(vals, " "))


def tag_list(rec: Column, key: str) -> Column:
    """List tag: one element per line (MH/AD: continuations folded into the last)."""
    hits = F.filter(rec, lambda e: e["key"] == F.lit(key))
    if key in FOLD_TAGS:
        return F.transform(hits, lambda e: F.array_join(e["parts"], " "))
    return F.flatten(F.transform(hits, lambda e: e["parts"]))


def has_crlf(spark: SparkSession, file: str) -> bool:
    """Whether the first line of a file ends with CRLF."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).open(path)
    try:
        head = bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(
            sc._jvm.org.apache.commons.io.input.BoundedInputStream(stream, SNIFF_BYTES)))
    finally:
        stream.close()
    end = head.find(b"\n")
    return end > 0 and head[end - 1:end] == b"\r"


def _raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(value): what lies between blank lines, by each file's own line ends."""
    def blocks(sep, source):
        return spark.read.option("lineSep", sep).text(source)

    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    with ThreadPoolExecutor(16) as pool:
        crlf = list(pool.map(lambda f: has_crlf(spark, f), files))
    if not any(crlf):
        return blocks(RECORD_SEP, path)
    if all(crlf):
        return blocks(CRLF_RECORD_SEP, path)
    return blocks(RECORD_SEP, [f for f, c in zip(files, crlf) if not c]).unionByName(
        blocks(CRLF_RECORD_SEP, [f for f, c in zip(files, crlf) if c]))


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """A3: one row per record block: (record array<struct<key, parts>>)."""
    return (_raw_blocks(spark, path)
            .select(record_blocks(F.col("value")).alias("block"))
            .filter(~_is_blank(F.col("block")))
            .select(parse_records(F.col("block")).alias("record")))


def map_medline(records: DataFrame, fallback=DEFAULT_FALLBACK, keep: tuple[str, ...] = ()) -> DataFrame:
    """C1 + P3: article columns; '' and [] for absent tags; records without a
    PMID are dropped. Also keeps the raw date ``dp``."""
    r = F.col("record")
    s = lambda k: F.coalesce(tag_text(r, k), F.lit(""))
    # Inlined: the filter below would else be pushed down with a parse of its own.
    out = records.select(F.inline(F.array(F.struct(
        s("PMID").alias("pmid"), s("TI").alias("title"), s("AB").alias("abstract"),
        tag_list(r, "AU").alias("authors"), s("DP").alias("dp"), s("TA").alias("journal"),
        tag_list(r, "MH").alias("keywords")))), *keep)
    return (out.filter(F.col("pmid") != F.lit(""))
            .withColumn("publication_date_parsed", parse_pub_date(F.col("dp")))
            .withColumn("publication_date", with_fallback(F.col("publication_date_parsed"), fallback)))


def to_medline(arts: DataFrame) -> DataFrame:
    """One MEDLINE record text per article (``value``), for files and tests."""
    def line(tag, v):
        return F.concat(F.lit(tag.ljust(4) + "- "), F.regexp_replace(v, "\n", "\n      "))

    def many(tag, arr):
        return F.array_join(F.transform(arr, lambda x: line(tag, x)), "\n")

    parts = [
        F.when(F.col("pmid") != "", line("PMID", F.col("pmid"))),
        F.when(F.col("title") != "", line("TI", F.col("title"))),
        F.when(F.col("abstract") != "", line("AB", F.col("abstract"))),
        F.when(F.col("dp") != "", line("DP", F.col("dp"))),
        F.when(F.size("authors") > 0, many("AU", F.col("authors"))),
        F.when(F.col("journal") != "", line("TA", F.col("journal"))),
        F.when(F.size("keywords") > 0, many("MH", F.col("keywords"))),
    ]
    return arts.select(F.concat_ws("\n", *parts).alias("value"))


def write_medline(arts: DataFrame, path: str) -> None:
    to_medline(arts).write.mode("overwrite").option("lineSep", RECORD_SEP).text(path)
