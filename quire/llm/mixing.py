"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share ``budget`` words by weight; a target stops at ``MAX_COPIES``
times its source's size and the excess goes to the others by weight until
none is above. Each round is one aggregate over the source table.

Copies: a document expects ``target / source size`` copies (times its own
relative weight, if a weight column is given). Its whole part is certain; the
rest ``p`` is its inclusion probability in a sample whose size in words is
fixed. The sample is Pareto's: rank by ``(u / (1 - u)) / (p / (1 - p))`` with
``u`` a hash of the id, the text and, among rows equal in both, a number (rows
without an id are not drawn together), and go down that order, taking every document that
fits in the words still needed, until none fits. One larger document is added
at last where that leaves a smaller gap.

Scale: the order is never sorted whole. The rank is mapped to (0, 1) and cut
into ``BINS``; per source and bin one partial sum of words finds the bin where
a document first does not fit, and only that bin's documents are sorted. The
next round does the same with the documents behind that are no larger than
what is still needed, few after the first rounds. Joins with the source table
split a source's rows over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import ROW_ID, number_rows, quoted, table, without
from quire.session import cut_lineage

MAX_COPIES = 3
BINS = 4096
SALTS = 32
SEED = 9
ORDER = ["rank", "doc_id", "size", "tie", ROW_ID]
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_key(source):
    """Never null, so that it can be a join key: the null source is 'n'."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def cycling_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating over sources by code point, null last. One
    row per source goes through this window, not the documents."""
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    return sources.withColumn("weight", ((order - 1) % 3 + 1).cast("double"))


def targets(sources: DataFrame, budget: float | None = None, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (source_size, weight) plus ``target``. ``budget`` None: all sizes."""
    sources = cut_lineage(sources, "mix-sources")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(total or 0) if budget is None else float(budget)
    level, capped = budget / weight if weight else 0.0, -1
    limit = max_copies * F.col("source_size")
    while True:
        full = limit < F.col("weight") * F.lit(level)
        n, used, free = sources.agg(F.count(F.when(full, 1)), F.sum(F.when(full, limit).otherwise(0)),
                                    F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = max(level, (budget - used) / free), n
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))


def by_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source; the rows of one source are split over ``SALTS``
    tasks, each with a copy of the source's single row."""
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(ROW_ID), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(copies, ["key", "salt"], how).drop("salt")


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (row id, doc_id, source, tie) plus ``copy``: 0, or a number from
    1 among rows equal in the three, which are interchangeable. A large group
    is numbered in ``SALTS`` parts, shifted by the sizes of those before."""
    same = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "source")]
    groups = (rows.groupBy("doc_id", "source", "tie").agg(F.count("*").alias("n")).where("n > 1")
              .select(F.col("doc_id").alias("__doc_id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"),
                      F.xxhash64("doc_id", "source", "tie").alias("group")))
    again = cut_lineage(rows.join(groups, [*same, rows["tie"] == F.col("__tie")]).select(
        ROW_ID, "group", F.pmod(F.xxhash64(ROW_ID), F.lit(SALTS)).cast("int").alias("part")), "mix-copies")
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = again.groupBy("group", "part").agg(F.count("*").alias("n")).select(
        "group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    number = F.row_number().over(Window.partitionBy("group", "part").orderBy(ROW_ID))
    copies = again.withColumn("i", number).join(shift, ["group", "part"]).select(ROW_ID, (F.col("i") + F.col("shift")).alias("copy"))
    return rows.join(copies, ROW_ID, "left").withColumn("copy", F.coalesce("copy", F.lit(0)).cast("long"))


def plan_mix(slim: DataFrame, weights=cycling_weights, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``slim`` (row id, doc_id, source, size, tie and, if documents differ in
    weight, doc_weight) plus source_size, target, copies."""
    slim = cut_lineage(numbered_copies(slim), "mix-numbered").withColumn("key", source_key(F.col("source")))
    if "doc_weight" not in slim.columns:
        slim = slim.withColumn("doc_weight", F.lit(1.0))
    per = slim.groupBy("key", "source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("doc_weight")).alias("weighted"))
    rate = cut_lineage(targets(weights(per), budget).select(
        "key", "source_size", "target",
        F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(0.0).alias("rate")), "mix-rates")

    # First 52 bits of an MD5 as a uniform number strictly inside (0, 1).
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                       F.col("tie"), F.col("copy").cast("string"))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    expected = F.least(F.col("rate") * F.col("doc_weight"), F.lit(float(MAX_COPIES)))
    ranked = (by_source(slim, rate).withColumn("u", u)
              .withColumn("whole", F.floor(expected)).withColumn("p", expected - F.col("whole"))
              # q / (1 + q) of the Pareto rank q = odds(u) / odds(p): same order, within (0, 1).
              .withColumn("rank", F.when(F.col("p") > 0, F.col("u") * (1 - F.col("p"))
                                         / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p")))
                          .otherwise(1.0))
              .withColumn("bin", F.floor(F.col("rank") * BINS).cast("int")))
    ranked = cut_lineage(ranked, "mix-ranked")

    need = cut_lineage(ranked.groupBy("key").agg(
        (F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("need")), "mix-need")
    left, taken = ranked.where("p > 0").select("key", "bin", *ORDER), None
    while True:
        now = cut_lineage(_fitting(left, need).select("key", "size", ROW_ID), "mix-taken")
        taken = now if taken is None else taken.unionByName(now)
        used = now.groupBy("key").agg(F.sum("size").alias("used"))
        need = cut_lineage(need.join(used, "key", "left").select(
            "key", (F.col("need") - F.coalesce("used", F.lit(0))).alias("need")), "mix-need")
        # Documents of size 0 fill nothing, so they are taken in the first round or not at all.
        left = cut_lineage(by_source(left.where("size > 0").join(now.select(ROW_ID), ROW_ID, "left_anti"), need)
                           .where("size <= need").drop("need"), "mix-left")
        if left.isEmpty():
            break
    taken = taken.select(ROW_ID, F.lit(1).alias("extra"))
    chosen = cut_lineage(ranked.join(taken, ROW_ID, "left").withColumn("extra", F.coalesce("extra", F.lit(0))), "mix-chosen")

    # All that are left are larger than the need: the nearest one, if that leaves less.
    more = (by_source(chosen.where("extra = 0 AND p > 0 AND size > 0"), need)
            .withColumn("off", F.col("size") - F.col("need")).where("off < need")
            .groupBy("key").agg(F.min(F.struct("off", *ORDER)).alias("x"))
            .select(F.col(f"x.{ROW_ID}").alias(ROW_ID), F.lit(1).alias("more")))
    chosen = chosen.join(more, ROW_ID, "left").withColumn("extra", F.coalesce("more", "extra")).drop("more")
    return chosen.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))


def _fitting(rows: DataFrame, need: DataFrame) -> DataFrame:
    """Of ``rows`` (key, bin and ``ORDER``) those ahead of the first of their
    source that does not fit in its need."""
    by_bin = rows.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (by_bin.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(need, "key")
           .where("before <= need").groupBy("key")
           .agg(F.max(F.struct("bin", "before")).alias("x"), F.max("need").alias("need"))
           .select("key", F.col("x.bin").alias("cut_bin"), F.col("x.before").alias("before"), "need"))
    placed = by_source(rows, cut_lineage(cut, "mix-cut"))
    edge = (placed.where("bin = cut_bin")
            .withColumn("upto", F.sum("size").over(Window.partitionBy("key").orderBy(*ORDER)
                                                   .rowsBetween(Window.unboundedPreceding, 0)))
            .where("before + upto <= need").select(*rows.columns))
    return placed.where("bin < cut_bin").select(*rows.columns).unionByName(edge)


def _slim(docs: DataFrame):
    return docs.select(ROW_ID, "doc_id", "source", n_words(F.col("text")).alias("size"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("tie"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Nulls: a null text has size 0, a null source is a source of its own
    (last), a null doc_id hashes as 'null', beside the text. Documents of size 0
    take 0 words. Rows equal in id, source and text are numbered, so that each
    has an own random number; which of them has which is not determined. Ties
    of the rank go by id, size, text hash. An empty table gives an empty table.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    return _taken(plan_mix(number_rows(slim, "mix-slim"), **options))


def _taken(plan: DataFrame) -> DataFrame:
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it has copies, with the
    input's columns."""
    numbered = number_rows(docs, "mix-docs")
    slim = cut_lineage(_slim(numbered), "mix-slim")
    copies = plan_mix(slim, **options).where("copies > 0").select(ROW_ID, F.col("copies").alias("__copies"))
    cols = without(numbered, ROW_ID, "__copies")
    return (numbered.join(copies, ROW_ID)
            .withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*map(quoted, cols)))


def op9(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents"))
