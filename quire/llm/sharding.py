"""Sharding along a Hilbert curve (DataFrame functions only).

Four metadata dimensions (source, language, size, id) are quantised to
``BITS`` bits each, by rank: the bins of a dimension hold about equally many
rows, whatever its values (long common prefixes, outliers), and null has a bin
of its own. Rows are ordered by the Hilbert index of their cell, and
the order is cut into runs of equal row counts, so that a shard covers a
compact region in all dimensions at once and filters on any of them prune
shards.

Scale: the order is never sorted whole. Rows are counted per cell (at most
2 ** (4 * BITS)) and per sub-cell (``SUBS`` hash classes of a cell, so that a
hot cell is not one task's work); running sums over cells, then over the
sub-cells of a cell, give each sub-cell its first position, and rows are
numbered within sub-cells only. Texts are not shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import ROW_ID, number_rows, quoted, table, without
from quire.session import cut_lineage

N_SHARDS = 24
BITS = 4
DIMS = 4
SUBS = 4096


VALUES = (1 << BITS) - 1   # bins of a dimension's values; bin 0 is for null


def cut_points(slim: DataFrame) -> list[list]:
    """Per dimension the ``VALUES`` - 1 values where a bin ends (none: no value
    is in or below that bin; no ends: no value at all).

    Numbers: quantiles of a sketch of fixed size. Names: their counts, cut
    into ranges by value; sums of the ranges, then sums within them, give every
    name the rows before it, so no task sorts all names."""
    shares = [i / VALUES for i in range(1, VALUES)]
    numbers = slim.agg(*(F.percentile_approx(c, shares, 10_000).alias(c) for c in ("d2", "d3"))).first()
    out = []
    for c in ("d0", "d1"):
        names = slim.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))
        names = cut_lineage(names.repartitionByRange("name").withColumn("part", F.spark_partition_id()), "shard-names")
        parts = names.groupBy("part").agg(F.sum("n").alias("rows"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"),
                             F.sum("rows").over(Window.partitionBy()).alias("total"))
        within = F.sum("n").over(Window.partitionBy("part").orderBy("name"))
        # A name belongs where the middle of its rows lies.
        bins = names.withColumn("middle", within - F.col("n") / 2).join(parts, "part").select(
            "name", F.floor((F.col("base") + F.col("middle")) * VALUES / F.col("total")).alias("bin"))
        ends = {r.bin: r.end for r in bins.groupBy("bin").agg(F.max("name").alias("end")).collect()}  # at most VALUES
        out.append([max((e for b, e in ends.items() if b <= i), default=None) for i in range(VALUES - 1)] if ends else [])
    return out + [numbers[c] or [] for c in ("d2", "d3")]


def _bin(x, ends: list):
    """0 for null, else 1 plus the number of bin ends below the value."""
    above = sum((F.lit(1) if e is None else (x > F.lit(e)).cast("int") for e in ends), F.lit(1))
    return F.when(x.isNull(), F.lit(0)).otherwise(above).cast("int")


def _rot(x, by, left: bool):
    """4-bit word rotated by the column ``by``."""
    back = F.pmod(F.lit(DIMS) - by, F.lit(DIMS))
    a, b = (by, back) if left else (back, by)
    # Multiplying and dividing by powers of two, as shifts take constants only.
    up = (x * F.pow(F.lit(2), a)).cast("int")
    down = F.floor(x / F.pow(F.lit(2), b)).cast("int")
    return (up.bitwiseOR(down)).bitwiseAND(F.lit((1 << DIMS) - 1))


def hilbert_index(cell):
    """Position of a cell on the curve. ``cell`` packs the bins, dimension 0 in
    the high bits. State: index so far, entry point and direction of the
    sub-cube (the usual Gray-code walk with rotation)."""
    gray = [i ^ (i >> 1) for i in range(1 << DIMS)]
    # Entry point and axis within each sub-cube, by its number on the walk.
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, 1 << DIMS)]

    def ones(x):
        return (x ^ (x + 1)).bit_length() - 1 if x & 1 else 0
    axis = [0 if i == 0 else (ones(i) if i % 2 else ones(i - 1)) % DIMS for i in range(1 << DIMS)]
    place = [gray.index(g) for g in range(1 << DIMS)]

    def pick(values, i):
        return F.get(F.array(*map(F.lit, values)), i)

    def step(s, level):
        # The level's bit of every dimension, dimension 0 lowest.
        bits = reduce(lambda a, b: a.bitwiseOR(b), [
            F.pmod(F.floor(cell / F.pow(F.lit(2), (DIMS - 1 - d) * BITS + level)), F.lit(2)).cast("int") * F.lit(1 << d)
            for d in range(DIMS)])
        w = pick(place, _rot(bits.bitwiseXOR(s["e"]), s["d"] + 1, left=False))
        return F.struct((s["h"] * (1 << DIMS) + w).alias("h"),
                        s["e"].bitwiseXOR(_rot(pick(entry, w), s["d"] + 1, left=True)).cast("int").alias("e"),
                        F.pmod(s["d"] + pick(axis, w) + 1, F.lit(DIMS)).cast("int").alias("d"))

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    levels = F.array(*map(F.lit, range(BITS - 1, -1, -1)))
    return F.aggregate(levels, start, step, lambda s: s["h"])


def assign(slim: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """``slim`` (doc_id, size, text_crc32 and dimensions d0..d3, a written
    table) plus curve (index), shard and slot."""
    bins = [_bin(F.col(f"d{i}"), ends) for i, ends in enumerate(cut_points(slim))]
    cell = reduce(lambda a, b: a * (1 << BITS) + b, bins)
    rows = slim.withColumn("cell", cell).withColumn(
        "sub", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SUBS)).cast("int"))

    subs = rows.groupBy("cell", "sub").agg(F.count("*").alias("n"))
    cells = subs.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("curve", hilbert_index(F.col("cell")))
    cells = cells.select("cell", "curve", F.coalesce(F.sum("n").over(
        Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    first = subs.withColumn("within", F.coalesce(F.sum("n").over(
        Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = first.join(cells, "cell").select("cell", "sub", "curve", "total", (F.col("base") + F.col("within")).alias("at"))
    number = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("doc_id", "size", "text_crc32"))
    rows = rows.join(first, ["cell", "sub"]).withColumn("position", F.col("at") + number - 1)
    shard = F.expr(f"(position * {n_shards}) DIV total")
    start = F.expr(f"(CAST(shard AS BIGINT) * total + {n_shards - 1}) DIV {n_shards}")
    return (rows.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - start)
            .drop("cell", "sub", "at", "total", "position"))


def slim_rows(docs: DataFrame, *extra) -> DataFrame:
    """Size (UTF-8 bytes plus 8), checksum and dimensions of every row, no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    dims = [F.col("source").cast("string"), F.col("lang").cast("string"), size, F.col("doc_id").cast("long")]
    return docs.select(*extra, "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"),
                       *(c.alias(f"d{i}") for i, c in enumerate(dims)))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) of every row: counts of
    shards differ by one at most, slots are gapless from 0 in curve order.

    A null text is empty; a null source, lang or id has the first bin of its
    dimension. Repeated rows get positions of their own. With fewer rows than
    shards some shards are empty; an empty table gives an empty table.
    """
    slim = cut_lineage(slim_rows(docs), "shard-rows")
    return assign(slim, n_shards).drop(*(f"d{i}" for i in range(DIMS)))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, rows_per_file: int = 1_000_000) -> DataFrame:
    """Writes ``docs`` in folders ``shard=N``, rows in curve order and at most
    ``rows_per_file`` to a task, and returns the manifest: per shard its rows
    and the ranges of the dimensions, by which readers skip whole shards. An
    input column named shard is replaced by the folder's number."""
    numbered = number_rows(docs, "shard-docs")
    placed = assign(cut_lineage(slim_rows(numbered, ROW_ID), "shard-rows"), n_shards)
    own = [quoted(c) for c in without(numbered, ROW_ID, "shard", "__slot", "__file")]
    rows = numbered.select(ROW_ID, *own).join(placed.select(ROW_ID, "shard", F.col("slot").alias("__slot")), ROW_ID)
    rows = rows.withColumn("__file", F.expr(f"__slot DIV {rows_per_file}"))
    (rows.repartition("shard", "__file").sortWithinPartitions("shard", "__slot")
     .select(*own, "shard").write.partitionBy("shard").parquet(path))
    ends = [f(c).alias(f"{n}_{c}") for c in ("source", "lang", "size", "doc_id") for n, f in (("min", F.min), ("max", F.max))]
    labels = numbered.select(ROW_ID, "source", "lang")
    return (placed.select(ROW_ID, "shard", "size", "doc_id").join(labels, ROW_ID)
            .groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends))


def op7(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")
