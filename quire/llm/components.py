"""Connected components of a link table, as iterated joins.

Alternating large-star and small-star steps: each step is a partial aggregate
(minimum per node, combined before the shuffle) joined back to the links, so
no task gathers a node's neighbours. Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.session import cut_lineage


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long) that is
    not itself the smallest of its component; ``component`` is the smallest
    node reachable. Self links and repeated links are ignored."""
    links = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links")
    before = _state(links)
    while before[0]:
        # Large star: every neighbour above a node is linked to the node's minimum.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        # Small star: a node and its lower neighbours are linked to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        links = cut_lineage(
            joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                            F.struct("a", F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b").where("a <> b").distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
