"""W4 + K4: the tail of each conversation that fits a token budget.

Newest turns are kept while their running token sum stays within the budget;
then leading assistant turns are dropped, so the kept history starts with a
non-assistant turn. With the default counter every turn counts at least one
token, so at most ``budget`` turns per conversation can be kept: a partial
top-``budget`` (WindowGroupLimit, map side) caps what any task receives for
one conversation, however long it is.

A caller's counter may return 0, so no such bound holds. Then the turns are
sorted by range over (conversation, turn), which cuts a long conversation into
pieces, and a piece's running sums start from the totals of the newer pieces:
no task holds more than a piece, and only totals meet per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import whitespace_tokens
from quire.session import cut_lineage

DEFAULT_BUDGET = 4096  # chat memory token limit of the reference


def conversation_tail(conv: DataFrame, budget: int = DEFAULT_BUDGET, count_tokens=None,
                      max_turns: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text, n_tokens, running) of the kept turns.

    ``count_tokens``: Column -> Column; the default counts white-space words.
    ``max_turns``: a proven bound on kept turns (default: ``budget`` for the
    default counter, which never returns 0). Without one, for a caller's
    counter (which must not be negative), conversations are summed in pieces."""
    if count_tokens is None:
        count_tokens = whitespace_tokens
        max_turns = budget if max_turns is None else max_turns
    t = conv.select("conv_id", "turn", "role", "text")
    if max_turns is None:
        return _tail_by_pieces(t, budget, count_tokens)
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = t.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= max_turns).drop("_rn")
    run = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = (t.withColumn("n_tokens", count_tokens(F.col("text")).cast("long"))
            .withColumn("running", F.sum("n_tokens").over(run))
            .filter(F.col("running") <= budget))
    # Oldest kept non-assistant turn, over the same (bounded) partition.
    first = F.min(F.when(F.col("role") != "assistant", F.col("turn"))).over(
        Window.partitionBy("conv_id"))
    return (kept.withColumn("_first", first)
            .filter(F.col("turn") >= F.col("_first")).drop("_first"))


def _tail_by_pieces(turns: DataFrame, budget: int, count_tokens) -> DataFrame:
    """The tail without a bound on the number of kept turns."""
    counted = turns.withColumn("n_tokens", count_tokens(F.col("text")).cast("long"))
    pieces = (counted.repartitionByRange("conv_id", F.desc("turn"))
              .withColumn("_piece", F.spark_partition_id()))
    # Written, so that a piece stays the same rows in both uses below.
    pieces = cut_lineage(pieces, "conversation-pieces")
    newer = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = (pieces.groupBy("conv_id", "_piece").agg(F.sum("n_tokens").alias("_sum"))
              .select("conv_id", "_piece", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_before"))
              .filter(F.col("_before") <= budget))      # pieces beyond the budget are not read on
    run = (Window.partitionBy("conv_id", "_piece").orderBy(F.desc("turn"))
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = (pieces.join(before, ["conv_id", "_piece"])
            .withColumn("running", F.sum("n_tokens").over(run) + F.col("_before"))
            .filter(F.col("running") <= budget))
    # The oldest kept non-assistant turn is a partial minimum per conversation;
    # it goes to the turns by piece, never by conversation.
    first = kept.filter(F.col("role") != "assistant").groupBy("conv_id").agg(F.min("turn").alias("_first"))
    firsts = before.select("conv_id", "_piece").join(first, "conv_id")
    return (kept.join(firsts, ["conv_id", "_piece"]).filter(F.col("turn") >= F.col("_first"))
            .select("conv_id", "turn", "role", "text", "n_tokens", "running"))
