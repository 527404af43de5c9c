"""Removal of repeated 400-byte strings by prefix-free parsing.

Parse. A rolling hash of ``TRIGGER`` bytes triggers a phrase boundary where it
is 0 modulo ``MODULUS``; phrases run from trigger to trigger and overlap by the
trigger, so they are prefix free. A 400-byte string holds a dozen whole
phrases, and equal strings hold equal phrases. Each string is dealt by the
phrase of least hash among those it holds; neighbouring positions with the
same such phrase are one run, so there is a row for some 150 positions.

Dictionary. Runs are identified by a 128-bit hash of all bytes their strings
cover. A phrase that occurs in one run only proves all strings of that run
unique. Equal runs prove all their strings repeated, and one of them stands
for all from here on: highly repetitive text shrinks to its dictionary. Equal
runs that a task sees together become one before the exchange; phrases and
runs are counted by partial aggregates, and the counts go back to the rows by
joins of written tables, whose hot keys Spark splits: a phrase held by a third
of all documents is not one task's work.

Combination. What is left are phrases with several different runs (edges of
copies). For each phrase, the suffix order of what precedes it (read backwards)
and the order of the parse from it on, both with longest common prefixes, are
combined into corpus order: two strings that start e bytes before the phrase
are equal exactly if they share a class of depth e in the first order and of
depth 400 - e in the second. No string is compared with all others.

A phrase with more than ``HOT`` different runs is split: its positions are
dealt by the hash of their own string. So are the positions whose string holds
no whole phrase (long stretches without a trigger).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import id_key, per_worker, quoted, table, without
from quire.session import cut_lineage, release_stages, stage_scope

LENGTH = 400
TRIGGER = 32
MODULUS = 24
HOT = 20_000
SEGMENT = 1 << 20     # positions of a long text parsed at a time
BATCH = 4096          # runs combined at a time
_BASE = 0x9E3779B97F4A7C15
_CELLS = 1 << 21      # elements of a class matrix


# -- parse -----------------------------------------------------------------------

def _powers(n: int):
    """Powers of the hash base and of its inverse modulo 2**64, and a 64-bit
    value for each byte, all by rule."""
    def powers(base, size):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def make(size):
        rng = np.random.Generator(np.random.PCG64(400))
        return (powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size), rng.integers(0, 2**64, 256, np.uint64))
    size = 1 << max(21, (n + 1).bit_length())
    return per_worker(f"suffix-powers-{size}", lambda: make(size))


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(values, lo, hi):
    """Index of the (first) least value of each range [lo, hi), hi > lo."""
    level = np.frexp(np.maximum(hi - lo, 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    index = np.arange(len(values))
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        a, b = index[lo[at]], index[hi[at] - (1 << k)]
        out[at] = np.where(values[b] < values[a], b, a)
        if len(index) > 1 << k:
            a, b = index[:-(1 << k)], index[1 << k:]
            index = np.concatenate([np.where(values[b] < values[a], b, a), index[len(a):]])
    return out


def runs(parts: list[bytes], counts: list[int], length: int = LENGTH):
    """Runs of the concatenated ``parts``; strings start at the first
    ``counts[i]`` positions of part i. Returns arrays (start, end, phrase
    start, phrase hash); phrase start -1: the strings hold no whole phrase."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    power, inverse, value = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power[:len(data)])])
    grams = _mixed((total[TRIGGER:] - total[:-TRIGGER]) * inverse[:len(total) - TRIGGER])
    at = np.flatnonzero(grams % np.uint64(MODULUS) == 0)
    part = np.searchsorted(first, at, "right") - 1
    inside = at + TRIGGER <= first[part] + sizes[part]
    at, part = at[inside], part[inside]
    whole = np.flatnonzero((part[1:] == part[:-1]) & (at[1:] + TRIGGER - at[:-1] <= length))
    start, stop = at[whole], at[whole + 1] + TRIGGER
    name = _mixed((total[stop] - total[start]) * inverse[start])

    begin, end = first, first + np.array(counts, np.int64)
    cuts = np.unique(np.concatenate([begin, end, start + 1, stop - length]))
    cuts = cuts[cuts >= 0]
    own = np.searchsorted(begin, cuts, "right") - 1
    cuts, own = cuts[cuts < end[own]], own[cuts < end[own]]
    until = np.minimum(np.append(cuts[1:], end[-1]), end[own])
    lo, hi = np.searchsorted(start, cuts), np.searchsorted(stop, cuts + length, "right")
    phrase = np.full(len(cuts), -1, np.int64)
    some = np.flatnonzero(hi > lo)
    phrase[some] = _least(name, lo[some], hi[some])
    new = np.ones(len(cuts), bool)
    new[1:] = (phrase[1:] != phrase[:-1]) | (own[1:] != own[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(cuts)) - 1
    phrase = phrase[head]
    safe = np.maximum(phrase, 0)
    if not len(start):
        return own[head], cuts[head], until[tail], phrase, np.zeros(len(head), np.uint64)
    return (own[head], cuts[head], until[tail], np.where(phrase >= 0, start[safe], -1),
            np.where(phrase >= 0, name[safe], np.uint64(0)))


_ROWS = "kind int, doc long, th long, pos long, n long, key long, h1 long, h2 long, at long"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _parse(length: int):
    """(doc, th, bytes) -> runs (kind 0), positions without a phrase (kind 1)
    and stretches that repeat within what a task sees at once (kind 2). Of equal
    runs or positions that a task sees at once, one is a row of kind 0 or 1 and
    all are of kind 2."""
    def rows(units):
        parts = [t[a:a + SEGMENT + length - 1] for _, _, t, a in units]
        counts = [min(SEGMENT, max(0, len(p) - length + 1)) for p in parts]
        own, start, end, phrase, name = runs(parts, counts, length)
        data = memoryview(b"".join(parts))
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
        docs = np.array([u[0] for u in units], np.int64)
        texts = np.array([u[1] for u in units], np.int64)
        base = np.array([u[3] for u in units], np.int64) - first
        digest = xxhash.xxh3_128_digest

        def hashes(a, b):
            h = np.frombuffer(b"".join([digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist())]), np.int64)
            return h.reshape(-1, 2)

        def batch(kind, own, pos, n, key, h, at):
            cols = [np.full(len(pos), kind, np.int32), docs[own], texts[own], pos + base[own], n, key, h[:, 0], h[:, 1], at]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_NAMES)

        def stretches(o, pos, n):
            # A key of its own (the position) keeps these rows spread.
            zero = np.zeros((len(pos), 2), np.int64)
            return batch(2, o, pos, n, docs[o] ^ (pos << 20), zero, zero[:, 0])

        def alike(h):
            _, one, back, n = np.unique(h, axis=0, return_index=True, return_inverse=True, return_counts=True)
            return one, n[back.reshape(-1)] > 1

        has = phrase >= 0
        o, s, e = own[has], start[has], end[has]
        key, at, h = name[has].view(np.int64), phrase[has] - s, hashes(s, e - 1 + length)
        one, again = alike(h)
        yield batch(0, o[one], s[one], (e - s)[one], key[one], h[one], at[one])
        if again.any():
            yield stretches(o[again], s[again], (e - s)[again])
        o, s, e = own[~has], start[~has], end[~has]
        if len(s):
            pos = np.concatenate([np.arange(a, b) for a, b in zip(s, e)])
            o = np.repeat(o, e - s)
            h = hashes(pos, pos + length)
            one, again = alike(h)
            yield batch(1, o[one], pos[one], np.ones(len(one), np.int64), h[one, 0], h[one], np.zeros(len(one), np.int64))
            if again.any():
                o, pos = o[again], pos[again]
                head = np.flatnonzero(np.append(True, (np.diff(pos) != 1) | (np.diff(o) != 0)))
                yield stretches(o[head], pos[head], np.diff(np.append(head, len(pos))))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                for a in range(0, max(0, len(text) - length + 1), SEGMENT):
                    held.append((doc, th, text, a))
                    size += min(len(text) - a, SEGMENT)
                    if size >= SEGMENT:
                        yield from rows(held)
                        held, size = [], 0
        if held:
            yield from rows(held)
    return run


# -- combination -------------------------------------------------------------------

def _common(strings: list[bytes], groups: np.ndarray, width: int):
    """(order, lcp): strings in sorted order within their groups, and the
    common prefix of each with the one before it (-1 at a group's first)."""
    order = np.array([i for _, _, i in sorted(zip(groups.tolist(), strings, range(len(strings))))], np.int64)
    padded = np.frombuffer(b"".join(strings[i][:width].ljust(width, b"\0") for i in order), np.uint8)
    padded = padded.reshape(len(order), width)
    sizes = np.minimum([len(strings[i]) for i in order], width)
    lcp = np.full(len(order), -1, np.int64)
    differ = padded[1:] != padded[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(sizes[1:], sizes[:-1]))
    g = groups[order]
    lcp[1:][g[1:] != g[:-1]] = -1
    return order, lcp


def _classes(order, lcp, depths):
    """[string, depth]: number of the class of strings that share ``depth`` bytes."""
    at = np.arange(len(order))[:, None]
    heads = np.maximum.accumulate(np.where(lcp[:, None] < depths[None, :], at, 0), axis=0)
    out = np.empty_like(heads)
    out[order] = heads
    return out


def combine(groups, texts, at, n, length: int = LENGTH):
    """Repeated strings among runs. Run i covers ``texts[i]``, its phrase starts
    at ``at[i]``, its strings at 0 .. n[i] - 1; runs of one group share their
    phrase. Returns (run, first position, last position) of repeated stretches."""
    left = _common([t[:a][::-1] for t, a in zip(texts, at)], groups, length)
    right = _common([t[a:] for t, a in zip(texts, at)], groups, length)
    low, high = np.maximum(at - n + 1, 0), np.minimum(at, length)  # e = distance to the phrase
    sizes = np.bincount(groups)[groups]
    out = []

    # Two runs: the common prefixes are the answer.
    def of_pair(order, lcp):
        second = np.flatnonzero((sizes[order] == 2) & (lcp >= 0))
        first, rest = order[second - 1], order[second]
        by = np.argsort(groups[rest], kind="stable")
        return np.minimum(first, rest)[by], np.maximum(first, rest)[by], lcp[second][by]
    a, b, before = of_pair(*left)
    _, _, after = of_pair(*right)
    e_low = np.maximum(length - after, np.maximum(low[a], low[b]))
    e_high = np.minimum(before, np.minimum(high[a], high[b]))
    hit = e_low <= e_high
    for x in (a[hit], b[hit]):
        out.append(np.stack([x, at[x] - e_high[hit], at[x] - e_low[hit]], 1))

    # More: classes for every distance e, a block of distances at a time.
    many = np.flatnonzero(sizes > 2)
    if len(many):
        place = np.full(len(groups), -1, np.int64)
        place[many] = np.arange(len(many))

        def only(order, lcp):
            keep = place[order] >= 0
            return place[order[keep]], lcp[keep]
        left, right = only(*left), only(*right)
        m, low, high, at = len(many), low[many], high[many], at[many]
        marks = []
        step = max(1, _CELLS // m)
        for e in range(int(low.min()), int(high.max()) + 1, step):
            es = np.arange(e, min(e + step, int(high.max()) + 1))
            pair = _classes(*left, es) * m + _classes(*right, length - es)
            pair[(es < low[:, None]) | (es > high[:, None])] = -1
            order = np.argsort(pair, axis=0, kind="stable")
            pair = np.take_along_axis(pair, order, 0)
            same = (pair[1:] == pair[:-1]) & (pair[1:] >= 0)
            twice = np.zeros(pair.shape, bool)
            twice[1:] |= same
            twice[:-1] |= same
            flags = np.zeros(pair.shape, bool)
            np.put_along_axis(flags, order, twice, 0)
            run, column = np.nonzero(flags)
            marks.append(np.stack([run, at[run] - es[column]], 1))
        marks = np.concatenate(marks)
        marks = marks[np.lexsort((marks[:, 1], marks[:, 0]))]
        if len(marks):
            head = np.append(True, (np.diff(marks[:, 0]) != 0) | (np.diff(marks[:, 1]) != 1))
            head = np.flatnonzero(head)
            tail = np.append(head[1:], len(marks)) - 1
            out.append(np.stack([many[marks[head, 0]], marks[head, 1], marks[tail, 1]], 1))
    return np.concatenate(out)


_STRETCH = "doc long, th long, start long, stop long"
_OPEN = "key long, doc long, th long, pos long, n long, at long, covers binary, hot boolean"


def _cut_runs(length: int):
    """(doc, th, bytes, list of runs) -> one row per run with the bytes it covers."""
    def out(rows):
        types = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          names=[c.split()[0] for c in _OPEN.split(", ")])

    def run(batches):
        rows = []
        for batch in batches:
            for doc, th, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                for r in found:
                    pos = r["pos"]
                    rows.append((r["key"], doc, th, pos, r["n"], r["at"], text[pos:pos + r["n"] - 1 + length],
                                 r["hot"]))
                if len(rows) >= BATCH:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)
    return run


def _combine(length: int):
    """Runs sorted by key -> repeated stretches; whole keys at a time."""
    def flush(rows):
        key, doc, th, pos, n, at, covers = zip(*rows)
        groups = np.unique(np.array(key, np.int64), return_inverse=True)[1]
        found = combine(groups, list(covers), np.array(at, np.int64), np.array(n, np.int64), length)
        run = found[:, 0]
        pos = np.array(pos, np.int64)[run]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(doc, np.int64)[run]), pa.array(np.array(th, np.int64)[run]),
             pa.array(pos + found[:, 1]), pa.array(pos + found[:, 2] + length)], names=["doc", "th", "start", "stop"])

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)
    return run


def _positions(length: int):
    """Runs of hot keys -> one hashed row per position."""
    def run(batches):
        for batch in batches:
            for _, doc, th, pos, n, _, covers in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(covers)
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i:i + length]) for i in range(n)]),
                                  np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, th, np.int64)),
                     pa.array(np.arange(pos, pos + n)), pa.array(h[:, 0]), pa.array(h[:, 1])],
                    names=["doc", "th", "pos", "h1", "h2"])
    return run


# -- Spark --------------------------------------------------------------------------

def repeated_stretches(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, th, start, stop): byte ranges covered by repeated strings. ``docs``
    has doc, th (hash of the text) and bytes; rows equal in doc and th are
    equal texts, which repeat each other."""
    spark = docs.sparkSession
    stop = F.col("pos") + F.col("n") - 1 + length
    with stage_scope(f"suffix-parse-{uuid.uuid4().hex[:12]}") as scopes:
        parsed = cut_lineage(docs.select("doc", "th", "bytes").mapInArrow(_parse(length), _ROWS), "runs")
    # Phrases of two or more rows; their runs differ unless both hash halves are constant.
    phrases = cut_lineage(
        parsed.where("kind < 2").groupBy("key")
        .agg(F.count("*").alias("total"), *(f(h).alias(f"{f.__name__}_{h}") for f in (F.min, F.max) for h in ("h1", "h2")))
        .where("total > 1")
        .select("key", F.expr("min_h1 < max_h1 OR min_h2 < max_h2").alias("differs")), "suffix-phrases")
    known = cut_lineage(parsed.where("kind < 2").join(phrases, "key")
                        .unionByName(parsed.where("kind = 2").withColumn("differs", F.lit(False))), "suffix-runs")
    release_stages(spark, *scopes)
    alike = known.where("NOT differs").select("doc", "th", F.col("pos").alias("start"), stop.alias("stop"))

    several = known.where("differs")
    distinct = cut_lineage(
        several.groupBy("key", "h1", "h2")
        .agg(F.count("*").alias("same"), F.min("kind").alias("kind"), F.min(F.struct("doc", "th", "pos", "n", "at")).alias("run"))
        .select("key", "h1", "h2", "same", "kind", "run.*"), "suffix-distinct")
    equal = (several.join(distinct.where("same > 1").select("key", "h1", "h2"), ["key", "h1", "h2"])
             .select("doc", "th", F.col("pos").alias("start"), stop.alias("stop")))

    runs = distinct.where("kind = 0")
    split_keys = cut_lineage(runs.groupBy("key").count().where(F.col("count") > hot)
                             .select("key", F.lit(True).alias("split")), "suffix-hot")
    open_runs = (runs.join(split_keys, "key", "left").groupBy("doc", "th")
                 .agg(F.collect_list(F.struct("key", "pos", "n", "at", F.coalesce("split", F.lit(False)).alias("hot")))
                      .alias("found")))
    runs_of = cut_lineage(
        open_runs.join(docs.select("doc", "th", "bytes"), ["doc", "th"]).select("doc", "th", "bytes", "found")
        .mapInArrow(_cut_runs(length), _OPEN), "suffix-open")
    found = (runs_of.where("NOT hot").drop("hot").repartition("key")
             .sortWithinPartitions("key").mapInArrow(_combine(length), _STRETCH))
    strings = runs_of.where("hot").drop("hot").mapInArrow(_positions(length), "doc long, th long, pos long, h1 long, h2 long")
    twice = cut_lineage(strings.groupBy("h1", "h2").count().where(F.col("count") > 1).select("h1", "h2"), "suffix-twice")
    split = (strings.join(twice, ["h1", "h2"])
             .select("doc", "th", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop")))
    return alike.unionByName(equal).unionByName(found).unionByName(split)


def _cut(bytes_: pd.Series, stretches: pd.Series) -> pd.DataFrame:
    out = []
    for text, found in zip(bytes_, stretches):
        kept, removed, spans, at, digest = [], 0, 0, 0, hashlib.sha256()
        for start, stop in _merged(found):
            kept.append(text[at:start])
            removed += stop - start
            spans += 1
            at = stop
        kept.append(text[at:])
        for piece in kept:
            digest.update(piece)
        out.append((len(text), removed, spans, digest.hexdigest(), b"".join(kept)))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _merged(found):
    """Maximal ranges of a list of (start, stop)."""
    out = []
    for start, stop in sorted((r["start"], r["stop"]) for r in found) if found is not None else ():
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def remove_repeated(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` without its text, plus n_bytes, n_removed, n_spans, kept_sha256
    and kept (the remaining bytes, which may end inside a character, hence
    binary). Input columns with these names are replaced.

    Null and empty texts, and texts below ``length`` bytes, lose nothing. Rows
    with equal texts repeat each other, whatever their ids; a null id is an id
    like any other. An empty table gives an empty table.
    """
    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    cols = without(docs, "text", "doc", "th", "bytes", "stretches", "__out", *results)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select(*map(quoted, cols), id_key().alias("doc"), F.xxhash64(raw).alias("th"), raw.alias("bytes"))
    found = (repeated_stretches(docs, length, hot).groupBy("doc", "th")
             .agg(F.collect_list(F.struct("start", "stop")).alias("stretches")))
    cut = F.pandas_udf(_cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (docs.join(found, ["doc", "th"], "left").withColumn("__out", cut("bytes", "stretches"))
            .select(*map(quoted, cols), *(f"__out.{c}" for c in results)))


def op5(spark, sf_dir):
    return remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
