"""Line dedup over a sharded minimal perfect hash.

1. Every document emits the 128-bit hashes of its distinct line keys; a
   partial aggregate counts documents and finds the smallest id per hash.
2. Hashes found in two or more documents are dealt to shards. Each shard
   builds a minimal perfect hash (levels of bit arrays with rank counts); the
   slot of a hash indexes three compact arrays: fingerprint, count, owner.
3. Documents probe the arrays: probe rows stream through the task that holds
   their shard's arrays (sorted so that the arrays come first), so a task
   keeps one shard and one Arrow batch. The probes of every shard are counted
   first; a shard is copied once per ``PROBES_PER_TASK`` of them and a
   document's probes choose a copy by id, so a line held by a third of all
   documents is never one task's work, at any size. Lines are not joined with
   lines.
4. Each document gets the hashes it loses and drops those lines.

The probability that a line is dropped wrongly is that of a 128-bit collision.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import ROW_ID, id_key, quoted, without
from quire.session import cut_lineage

MIN_CHARS = 10
KEYS_PER_SHARD = 100_000
PROBES_PER_TASK = 200_000
_GAMMA = 2.0
_MAX_LEVELS = 48


# -- line keys ---------------------------------------------------------------

def line_keys(text: str | None) -> list[bytes]:
    """The key of every ``\\n`` line: ASCII white space stripped at both ends
    and A-Z lower-cased (both are what ``bytes`` methods do)."""
    return [line.strip() for line in (text or "").encode().lower().split(b"\n")]


def counted(key: bytes, min_chars: int) -> bool:
    """Whether the key has at least ``min_chars`` code points."""
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


# -- minimal perfect hash ------------------------------------------------------

def _slots(h1: np.ndarray, level: int, size: int) -> np.ndarray:
    """Pseudo-random slot below ``size`` for each 64-bit hash at a level."""
    x = h1 ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_shard(h1, h2, counts, owners) -> bytes:
    """Bit arrays, ranks, fingerprints, counts and owners of distinct hashes."""
    h1, h2 = np.asarray(h1, np.int64).view(np.uint64), np.asarray(h2, np.int64).view(np.uint64)
    levels, left = [], np.arange(len(h1))
    slot = np.full(len(h1), -1, np.int64)
    base = 0
    for level in range(_MAX_LEVELS):
        if not len(left):
            break
        size = max(64, int(_GAMMA * len(left)) // 64 * 64 + 64)
        at = _slots(h1[left], level, size)
        hits = np.bincount(at, minlength=size)
        alone = hits[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]) + base
        slot[left[alone]] = _rank(words, ranks, at[alone])
        levels.append((words, ranks.astype(np.uint32)))
        base += int(alone.sum())
        left = left[~alone]
    # Hashes that still collide (equal first halves) get the last slots; the
    # reader finds them by a scan of this short tail.
    slot[left] = base + np.arange(len(left))
    order = np.argsort(slot, kind="stable")
    out = [struct.pack("<III", len(levels), len(h1), len(left))]
    out += [struct.pack("<I", len(w)) for w, _ in levels]
    for words, ranks in levels:
        out += [words.tobytes(), ranks.tobytes()]
    out += [h1[left].tobytes(), h2[order].tobytes(),
            np.asarray(owners, np.int64)[order].tobytes(),
            np.minimum(np.asarray(counts, np.int64)[order], 2**32 - 1).astype(np.uint32).tobytes()]
    return b"".join(out)


def _rank(words, ranks, at):
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return ranks[word].astype(np.int64) + np.bitwise_count(below)


class Shard:
    """Reads what ``build_shard`` wrote; ``probe`` is vectorised."""

    def __init__(self, blob: bytes):
        n_levels, n, tail = struct.unpack_from("<III", blob, 0)
        sizes = struct.unpack_from(f"<{n_levels}I", blob, 12)
        at = 12 + 4 * n_levels

        def take(dtype, count):
            nonlocal at
            a = np.frombuffer(blob, dtype, count, at)
            at += a.nbytes
            return a

        self.levels = [(take(np.uint64, s), take(np.uint32, s)) for s in sizes]
        self.tail = take(np.uint64, tail)
        self.prints = take(np.uint64, n)
        self.owners = take(np.int64, n)
        self.counts = take(np.uint32, n)

    def probe(self, h1, h2):
        """(found, count, owner) of each 128-bit hash."""
        h1, h2 = np.asarray(h1, np.int64).view(np.uint64), np.asarray(h2, np.int64).view(np.uint64)
        slot, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = _slots(h1[left], level, 64 * len(words))
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            slot[left[hit]] = _rank(words, ranks, at[hit])
            left = left[~hit]
        first = len(self.prints) - len(self.tail)
        for i, key in enumerate(self.tail):
            slot[left[(h1[left] == key) & (h2[left] == self.prints[first + i])]] = first + i
        safe = np.maximum(slot, 0)
        if not len(self.prints):
            none = np.zeros(len(h1), bool)
            return none, none.astype(np.uint32), none.astype(np.int64)
        found = (slot >= 0) & (self.prints[safe] == h2)
        return found, np.where(found, self.counts[safe], 0), np.where(found, self.owners[safe], 0)


# -- Spark ---------------------------------------------------------------------

def _emit_keys(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {key_hash(k) for k in set(line_keys(text)) if counted(k, min_chars)}
                ids += [doc] * len(own)
                hashes += own
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                names=["doc", "h1", "h2"])
    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    blob = build_shard(pdf.h1.to_numpy(), pdf.h2.to_numpy(), pdf.docs.to_numpy(), pdf.owner.to_numpy())
    return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "arrays": [blob]})


def _probe(batches):
    """Rows arrive sorted by (shard, salt, kind): the arrays, then the probes."""
    shard, current = None, None
    for batch in batches:
        keys = batch.column("shard").to_numpy(zero_copy_only=False)
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        h1 = batch.column("h1").to_numpy(zero_copy_only=False)
        h2 = batch.column("h2").to_numpy(zero_copy_only=False)
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(kind == 0)
        cuts = np.unique(np.concatenate([[0], heads, np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if kind[a] == 0:
                shard, current = Shard(batch.column("arrays")[int(a)].as_py()), keys[a]
                a += 1
            if a == b or current != keys[a]:  # a shard without repeated lines has no arrays
                continue
            found, counts, owner = shard.probe(h1[a:b], h2[a:b])
            lose = found & (counts >= 2) & (owner != doc[a:b])
            if lose.any():
                both = np.stack([h1[a:b][lose], h2[a:b][lose]], 1)
                lines = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc[a:b][lose]), lines.cast(pa.binary())], names=["doc", "line"])


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD,
                   probes_per_task: int = PROBES_PER_TASK) -> DataFrame:
    """(doc, line): hashes of the line keys that each document loses.

    ``doc`` is the id (``NULL_ID`` for null). Rows that share an id are one
    document. A key in two or more documents stays only in the smallest id.
    """
    keys = cut_lineage(
        docs.select(id_key().alias("doc"), F.col("text"))
        .mapInArrow(_emit_keys(min_chars), "doc long, h1 long, h2 long"), "line-keys")
    counts = cut_lineage(
        keys.groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.min("doc").alias("owner"), F.max("doc").alias("last"))
        .where("owner < last").drop("last"), "line-counts")
    shards = max(1, -(-counts.count() // keys_per_shard))
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")
    arrays = (counts.select(shard, "h1", "h2", "docs", "owner")
              .groupBy("shard").applyInPandas(_build, "shard int, arrays binary"))
    # One row per shard: into how many copies its probes are dealt.
    copies = cut_lineage(keys.groupBy(shard).agg(F.ceil(F.count("*") / probes_per_task).cast("int").alias("copies")),
                         "line-copies")
    salted = arrays.join(copies, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"),
        *(F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "doc")), "arrays")
    probes = keys.select("*", shard).join(copies, "shard").select(
        "shard", F.pmod(F.xxhash64("doc"), F.col("copies")).cast("int").alias("salt"),
        F.lit(1).alias("kind"), "h1", "h2", "doc", F.lit(None).cast("binary").alias("arrays"))
    return (salted.unionByName(probes).repartition("shard", "salt")
            .sortWithinPartitions("shard", "salt", "kind")
            .mapInArrow(_probe, "doc long, line binary"))


def _cut_lines(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
    out, lines, dropped = [], [], []
    for t, h in zip(text, lost):
        t = t or ""
        parts = t.split("\n")
        lines.append(len(parts))
        if h is None or not len(h):
            out.append(t)
            dropped.append(0)
            continue
        gone = {bytes(x) for x in h}
        kept = [p for p, k in zip(parts, line_keys(t)) if not k or key_hash(k) not in gone]
        out.append("\n".join(kept))
        dropped.append(len(parts) - len(kept))
    return pd.DataFrame({"text": out, "n_lines": lines, "n_dropped": dropped})


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD,
                probes_per_task: int = PROBES_PER_TASK) -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, plus ``n_lines`` (before)
    and ``n_dropped``; input columns with these two names are replaced.

    Null and empty texts are one empty line and give ''. Every line of a lost
    key goes, ties cannot occur (ids order the documents), rows that share a
    doc_id are one document, a null doc_id counts as the largest id. An empty
    table gives an empty table.
    """
    lost = (repeated_lines(docs, min_chars, keys_per_shard, probes_per_task).groupBy("doc")
            .agg(F.collect_set("line").alias("__lost")).withColumnRenamed("doc", "__doc"))
    kept = without(docs, "n_lines", "n_dropped", "__doc", "__lost", ROW_ID)
    cut = F.col("__cut")
    cut_lines = F.pandas_udf(_cut_lines, "text string, n_lines long, n_dropped long")
    return (docs.select(*map(quoted, kept), id_key().alias("__doc")).join(lost, "__doc", "left")
            .withColumn("__cut", cut_lines("text", "__lost"))
            .select(*(cut["text"].alias(c) if c.lower() == "text" else quoted(c) for c in kept),
                    cut["n_lines"].alias("n_lines"), cut["n_dropped"].alias("n_dropped")))


def op2(spark, sf_dir):
    from quire.llm.common import table
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (
  SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), f AS (
  SELECT l.doc_id, l.i, l.line, (r.k IS NOT NULL AND l.doc_id <> r.owner) AS gone FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
