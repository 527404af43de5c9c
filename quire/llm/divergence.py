"""Source divergence audit by Gustavson row accumulation.

Per language, every source is a row of a sparse matrix (source x kept term) of
smoothed, rounded term shares. The divergence of two sources is the sum over
all kept terms of the absolute difference of their shares. A term that a source
lacks has the source's baseline share (count 0), which is not zero, so with
A_g(x) the sum of |share - x| over the terms that g holds, b the baselines and
n the numbers of terms held

    D(g, h) = A_g(b_h) + A_h(b_g) + (V - n_g - n_h) |b_g - b_h|
              + sum over common terms of |p_g - p_h| - |p_g - b_h| - |b_g - p_h| + |b_g - b_h|

The last sum is accumulated row by row: a source scatters its terms through
the term-major index (the sources that hold a term, side by side) into one
dense accumulator with a cell per peer. No pair of postings becomes a row.

Scale: terms are counted per task before any shuffle. The index is cut into
blocks of terms (about ``POSTINGS`` postings, or 16 times the language's
sources if that is more); a block goes to one task with the baselines of the
language's sources, and what it emits is one accumulator per source, summed
over the blocks by a partial aggregate. A hot source is spread over all blocks
of its terms, a hot term has one posting per source. All arithmetic is in
integers (decimals where a product could pass 64 bits).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import table
from quire.session import cut_lineage

MIN_DOCS = 30
ADDED = 5                # added to every count
UNIT = 1_000_000_000     # shares are in units of one over this
TOP_TERMS = 50
POSTINGS = 4096
HELD = 400_000           # distinct (source, term) counts that a task holds
CHUNK = 1 << 20          # bytes of a long text split at a time
#: A byte of a term becomes itself (A-Z in lower case), any other a space.
_TERM = bytes(i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x61 <= i <= 0x7A else 0x20 for i in range(256))


# -- counts ----------------------------------------------------------------------

def _pieces(text: bytes):
    """Terms of a text, some at a time; a piece ends at a space."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches):
    """(lang, source, text) -> (lang, source, term, n, docs) summed per task.
    The empty term stands for the group itself, so that none is lost."""
    counts, docs = {}, {}

    def flush():
        for key, n in counts.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(terms), pa.string()), pa.array([key[1]] * len(terms), pa.string()),
                 pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()),
                 pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[key][t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            key = (lang, source)
            if key not in counts:
                counts[key], docs[key] = Counter({b"": 0}), Counter()
            own, before, seen = counts[key], len(counts[key]), set()
            for terms in _pieces(text.translate(_TERM)):
                own.update(terms)
                seen.update(terms)
            docs[key].update(seen)
            held += len(own) - before
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over whole texts; null lang, source and
    text count as ''. Every group has a row with the empty term."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return (docs.select(blank[0].alias("lang"), blank[1].alias("source"), text.alias("text"))
            .mapInArrow(_count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


# -- shares ----------------------------------------------------------------------

def share(count, total, kept):
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * kept)), exact; null
    where no term is kept."""
    wide = [c.cast("decimal(20,0)") for c in (count, total, kept)]
    up = F.lit(UNIT).cast("decimal(10,0)") * (wide[0] + ADDED)
    return F.when(kept > 0, F.call_function("div", up, wide[1] + ADDED * wide[2]) + 1).cast("long")


def shares(counts: DataFrame, min_docs: int = MIN_DOCS):
    """(postings, sources, langs): lang, source, term, n, p of every kept term
    held; lang, source, total, held, kept, b per source; lang, kept, total per language."""
    kept = (counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("lang_n"))
            .where(F.col("d") >= min_docs).drop("d"))
    held = cut_lineage(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "divergence-held")
    by_source = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = (held.select("lang", "term", "lang_n").distinct()
             .groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")))
    none = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "held", "kept", "lang_total")]
    sources = (counts.where("term = ''").select("lang", "source").join(by_source, ["lang", "source"], "left")
               .join(langs, "lang", "left").select("lang", "source", *none))
    sources = cut_lineage(sources.withColumn("b", share(F.lit(0), F.col("total"), F.col("kept"))), "divergence-sources")
    postings = held.join(sources.drop("b", "held"), ["lang", "source"])
    postings = postings.select(
        "lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return cut_lineage(postings, "divergence-postings"), sources


# -- pairs -----------------------------------------------------------------------

def accumulate(sources, base, row, term, p):
    """Yields (source number, peers, sums) of a block. ``base`` are the baseline
    shares of the language's sources, (row, term, p) the block's postings. The
    sums hold A_g(b_h) for every peer, and the common terms' part for peers of
    a larger number (each pair once)."""
    order = np.argsort(term, kind="stable")
    row, term, p = row[order], term[order], p[order]       # term-major
    first = np.searchsorted(term, term, "left")
    last = np.searchsorted(term, term, "right")
    by_row = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[by_row], np.arange(sources + 1))
    sorted_base = np.sort(base)
    back = np.searchsorted(sorted_base, base)
    for g in range(sources):
        own = by_row[cuts[g]:cuts[g + 1]]
        if not len(own):
            continue
        # A_g at every baseline, by sums below and above.
        low = np.sort(p[own])
        upto = np.concatenate([[0], np.cumsum(low)])
        k = np.searchsorted(low, sorted_base)
        sums = (sorted_base * (2 * k - len(low)) + upto[-1] - 2 * upto[k])[back]
        # Scatter the row's terms through the index.
        size = last[own] - first[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        mine, peer = np.repeat(p[own], size), row[at]
        later = peer > g
        mine, peer, theirs = mine[later], peer[later], p[at[later]]
        np.add.at(sums, peer, np.abs(mine - theirs) - np.abs(mine - base[peer]) - np.abs(base[g] - theirs)
                  + np.abs(base[g] - base[peer]))
        yield g, sums


def _blocks(batches):
    """Rows sorted by (lang, block, term): a block's baselines (empty term),
    then its postings -> (lang, source, peer, value)."""
    def block(lang, rows):
        names = [r[0] for r in rows if r[1] == ""]
        at = {s: i for i, s in enumerate(names)}
        base = np.array([r[2] for r in rows if r[1] == ""], np.int64)
        held = [r for r in rows if r[1] != ""]
        number: dict = {}
        row = np.array([at[r[0]] for r in held], np.int64)
        term = np.array([number.setdefault(r[1], len(number)) for r in held], np.int64)
        p = np.array([r[2] for r in held], np.int64)
        for g, sums in accumulate(len(names), base, row, term, p):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array([names[g]] * len(names), pa.string()),
                 pa.array(names, pa.string()), pa.array(sums)], names=["lang", "source", "peer", "value"])

    key, held = None, []
    for batch in batches:
        for lang, number, source, term, p in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, number) != key:
                if held:
                    yield from block(key[0], held)
                key, held = (lang, number), []
            held.append((source, term, p))
    if held:
        yield from block(key[0], held)


def divergences(postings: DataFrame, sources: DataFrame, per_block: int = POSTINGS) -> DataFrame:
    """(lang, source, peer, value) for every ordered pair of a language's sources."""
    size = sources.groupBy("lang").agg(F.sum("held").alias("postings"), F.count("*").alias("sources"))
    blocks = size.select("lang", F.expr(f"1 + postings DIV greatest({per_block}, 16 * sources)").alias("blocks"))
    base = sources.where("kept > 0").join(blocks, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
        F.lit("").alias("term"), F.col("b").alias("p"))
    rows = postings.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "p")
    parts = (base.unionByName(rows).repartition("lang", "block").sortWithinPartitions("lang", "block", "term")
             .mapInArrow(_blocks, "lang string, source string, peer string, value long"))
    one_way = parts.where("source <> peer").select(
        "lang", F.least("source", "peer").alias("a"), F.greatest("source", "peer").alias("z"), "value")
    sums = one_way.groupBy("lang", "a", "z").agg(F.sum("value").alias("value"))

    # Every pair of a language's sources is a row of the result.
    left = sources.select("lang", "kept", F.col("source").alias("a"), F.col("b").alias("b_a"), F.col("held").alias("n_a"))
    right = sources.select("lang", F.col("source").alias("z"), F.col("b").alias("b_z"), F.col("held").alias("n_z"))
    pairs = left.join(right, "lang").where("a < z").join(sums, ["lang", "a", "z"], "left")
    value = F.coalesce(F.col("value"), F.lit(0)) + F.coalesce(
        (F.col("kept") - F.col("n_a") - F.col("n_z")) * F.abs(F.col("b_a") - F.col("b_z")), F.lit(0))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("z").alias("peer")),
                             F.struct(F.col("z").alias("source"), F.col("a").alias("peer"))))
    return pairs.select("lang", value.alias("value"), both.alias("x")).select("lang", "x.source", "x.peer", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other
    source of the language by divergence. Part ``term``: the terms that the
    source has more of than its language, at most ``top_terms``.

    Null lang, source and text are ''. A group without a kept term is still a
    source of its language; a language without kept terms has divergences 0.
    Repeated rows are documents of their own. Ties go by item in UTF-8 order.
    An empty table gives an empty table.
    """
    counts = cut_lineage(term_counts(docs.select("lang", "source", "text")), "divergence-counts")
    postings, sources = shares(counts, min_docs)
    pair = divergences(postings, sources).select("lang", "source", F.lit("pair").alias("part"),
                                                 F.col("peer").alias("item"), "value")
    term = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (pair.withColumn("rank", F.row_number().over(by))
            .unionByName(term.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)))


def op13(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(any_value(v), 0) AS v FROM d LEFT JOIN l USING (lang) GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, g.v
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT f.*, 1 + (1000000000::HUGEINT * (f.n + 5)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + 5 * f.v) AS p,
         1 + (1000000000::HUGEINT * (f.lang_n + 5)) // (l.total + 5 * f.v) AS q
  FROM full_counts f JOIN l ON l.lang = f.lang
), diff AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(diff.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN diff ON diff.lang = a.lang AND diff.source = a.source AND diff.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
