"""SimHash near-dedup by anchor-point covering.

Fingerprints link at ``MAX_BITS`` = 3 or fewer differing bits, so one of the
two 32-bit halves differs in at most one bit. Anchors of a half are the points
of a covering code: the [31,26] Hamming code (covering radius 1) times one free
bit. A fingerprint is replicated to every anchor within covering radius plus
threshold (1 + 1 = 2) of each half: 17 anchors where the half is not a code
word, else 2. Of two linked fingerprints, the anchor nearest to one half is
within 2 of the other, so they meet there and no link is lost. Anchors have 27
bits, so unrelated fingerprints rarely meet, at any input size.

Per anchor, distinct fingerprints are compared by a search that removes each
one found, which emits a spanning forest of the links, never all pairs. Equal
fingerprints (copies) are one node from the start. The components of the
forest, found by joins, are the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import ROW_ID, id_key, id_of, number_rows, quoted, table, without
from quire.llm.components import components
from quire.session import cut_lineage

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_BLOCK = 65_536


# -- fingerprints --------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[lo:hi].tolist(), (ends[lo + shingle - 1:hi + shingle - 1] - 1).tolist())],
                     np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *extra) -> DataFrame:
    """(doc, fp) per row: the id (``NULL_ID`` for null) and the signed
    fingerprint, and the columns ``extra``."""
    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in text], dtype="int64")
    return docs.select(id_key().alias("doc"), fp("text").alias("fp"), *extra)


# -- anchors -------------------------------------------------------------------

def _syndromes(v: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the low 31 bits: XOR of the numbers (from 1) of set bits."""
    s = np.zeros(len(v), np.uint32)
    for i in range(31):
        s ^= ((v >> np.uint32(i)) & np.uint32(1)) * np.uint32(i + 1)
    return s


def _pairs() -> np.ndarray:
    """Row s: the masks of the 15 bit pairs whose numbers have XOR s (row 0 unused)."""
    rows = [[0] * 15]
    for s in range(1, 32):
        rows.append([(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)])
    return np.array(rows, np.uint32)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor): every anchor within distance 2 of each 32-bit half."""
    s = _syndromes(half)
    near = np.where(s > 0, half ^ (np.uint32(1) << (np.maximum(s, 1) - np.uint32(1))), half)
    rows = np.arange(len(half))
    off = np.flatnonzero(s)
    wide = half[off][:, None] ^ _pairs()[s[off]]
    return (np.concatenate([rows, rows, np.repeat(off, 15)]),
            np.concatenate([near, near ^ np.uint32(1 << 31), wide.ravel()]))


def _replicate(batches):
    """fp -> (anchor key, fp) for the anchors of both halves."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        u = fp.view(np.uint64)
        for part in (0, 1):
            at, anchor = anchors(((u >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int64) | (part << 32)), pa.array(fp[at])], names=["anchor", "fp"])


def spanning_links(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each found
    neighbour leaves the pool, so at most len - 1 links come out."""
    out, pool = [], fp
    while len(pool) > 1:
        frontier, pool = [pool[0]], pool[1:]
        while frontier and len(pool):
            x = frontier.pop()
            near = np.bitwise_count(pool ^ x) <= max_bits
            if near.any():
                found = pool[near]
                out += [(x, y) for y in found]
                frontier += list(found)
                pool = pool[~near]
    return out


def _compare(max_bits: int):
    def links(anchor, fp):
        """Links of whole anchors, sorted by anchor."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        hit = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
        found = list(zip(fp[hit].tolist(), fp[hit + 1].tolist()))
        for a, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found += [(int(x), int(y)) for x, y in spanning_links(fp[a:a + n], max_bits)]
        a, b = zip(*sorted(set(found))) if found else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))],
            names=["a", "b"])

    def run(batches):
        held = [np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            now = [np.concatenate([held[0], batch.column(0).to_numpy()]),
                   np.concatenate([held[1], batch.column(1).to_numpy().view(np.uint64)])]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [x[last:] for x in now]
            if last:
                yield links(*(x[:last] for x in now))
        if len(held[0]):
            yield links(*held)
    return run


# -- groups --------------------------------------------------------------------

def _roots(prints: DataFrame, first, max_bits: int) -> DataFrame:
    """(fp, root, first) per distinct fingerprint of the written table
    ``prints``: the group's root and the fingerprint's aggregate ``first``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the anchors cover at most 3 differing bits")
    nodes = cut_lineage(prints.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    links = (nodes.select("fp").mapInArrow(_replicate, "anchor long, fp long")
             .repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(_compare(max_bits), "a long, b long"))
    return nodes.join(components(links), F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc, fp, component) per row of ``docs``: ids as ``id_key`` gives them,
    ``component`` the smallest id reachable over links, itself included.

    Texts without words (null, empty, blank) have fingerprint 0 and are linked
    like any other. Each row has the component of its own fingerprint, also
    where rows share an id. An empty table gives an empty table. The covering
    holds for ``max_bits`` up to 3.
    """
    prints = cut_lineage(fingerprints(docs, shingle), "simhash")
    groups = _roots(prints, F.min("doc"), max_bits)
    least = groups.groupBy("root").agg(F.min("first").alias("component"))
    final = groups.join(least, "root").select("fp", "component")
    return prints.join(final, "fp").select("doc", "fp", "component")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, null
    last (of rows that repeat it, the one with the smallest text hash). Groups
    are of rows, so rows of different groups stay, whatever their ids."""
    numbered = number_rows(docs, "simhash-docs")
    prints = cut_lineage(fingerprints(numbered, shingle, F.xxhash64("text").alias("hash"), F.col(ROW_ID)), "simhash")
    groups = _roots(prints, F.min(F.struct("doc", "hash", ROW_ID)), max_bits)
    keep = groups.groupBy("root").agg(F.min("first").alias("x")).select(F.col(f"x.{ROW_ID}").alias(ROW_ID))
    return numbered.join(keep, ROW_ID, "left_semi").select(*map(quoted, without(docs, ROW_ID)))


def op10(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(id_of(F.col("doc")).alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        id_of(F.col("component")).alias("component_id"))
