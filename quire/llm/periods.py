"""Periodic run detection by multi-scale minimizers.

A run is a maximal stretch of words with smallest period q (words q apart are
identical) of at least ``max(MIN_LENGTH, MIN_COPIES * q)`` words.

Scales. Periods from a to b - 1 (b about 1.5 a) share a scale. Its grams are
L = b - 1 words long, so they cover a whole period and differ at the q places
of a period; its windows hold W = 2a - L + 1 grams. The first window of a run
and the same window one period later both lie inside the run (q + W + L - 1 <=
3q), so the minimum of the first, and its copy q places on, are both window
minima (minimizers), with no equal gram between them. Pairs of next equal
minimizers at a distance of the scale are therefore seeds of every run; every
seed is extended to both sides word by word, which proves or refutes it.
Periods up to ``DIRECT`` are too short for windows: the words are compared at
each such lag directly.

A stretch found for a multiple of its period has the same ends as the run
itself, so the smallest period of equal ends is kept.

Scale: texts are independent, so this is one map over the documents without a
shuffle, and a hot source or a group of copies is no hot task. Texts are put
together to ``CHUNK`` words, parted by marks that equal nothing, so that the
arrays are long however short the texts are. Memory: a chunk, or one text if
that is longer (about 150 bytes a word).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import per_worker, quoted, table, without

MIN_LENGTH = 24
MIN_COPIES = 3
DIRECT = 8
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def scales(longest: int, direct: int = DIRECT):
    """(least period, first period beyond) of every scale for periods up to ``longest``."""
    a = direct + 1
    while a <= longest:
        b = a + max(1, a // 2)
        yield a, b
        a = b


# -- seeds -----------------------------------------------------------------------

def _powers(n: int):
    """Powers of the hash base and of its inverse modulo 2**64, by rule."""
    size = 1 << max(19, n.bit_length())

    def make():
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return out
    return per_worker(f"period-powers-{size}", make)


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding(values, width: int, best):
    """``best`` (minimum or maximum) of every ``width`` neighbours."""
    step = 1
    out = values
    while 2 * step <= width:
        out = best(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return best(out[:-rest], out[rest:]) if rest else out


def minimizers(grams, width: int):
    """Places whose gram is the least of some window of ``width`` grams."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    least = _sliding(grams, width, np.minimum)
    low = np.zeros(width - 1, grams.dtype)
    return np.flatnonzero(_sliding(np.concatenate([low, least, low]), width, np.maximum) == grams)


def _seeds(total, n: int, a: int, b: int):
    """(period, place) candidates of a scale among the first ``n`` words."""
    length = b - 1
    if n < length + 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inverse = _powers(len(total))[1]
    grams = _mixed((total[length:n + 1] - total[:n + 1 - length]) * inverse[:n + 1 - length])
    at = minimizers(grams, 2 * a - length + 1)
    at = at[np.argsort(grams[at], kind="stable")]
    gap = np.diff(at)
    same = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (gap >= a) & (gap < b))
    return gap[same], at[same]


# -- runs ------------------------------------------------------------------------

def _reach(ids, i: int, j: int, step: int, limit: int) -> int:
    """How many words from i and j on (``step`` 1) or before them (-1) agree, at most ``limit``."""
    done, size = 0, 64
    while done < limit:
        size = min(size, limit - done)
        if step > 0:
            differ = ids[i + done:i + done + size] != ids[j + done:j + done + size]
        else:
            differ = (ids[i - done - size:i - done] != ids[j - done - size:j - done])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += size
        size *= 4
    return done


def find_runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH,
              copies: int = MIN_COPIES, direct: int = DIRECT):
    """Runs of the texts that begin at ``starts`` in ``ids``, longest text
    first; between texts lie words that occur once. Returns arrays (text,
    start, length, period), start within the text, by text, start, period."""
    found: dict[tuple[int, int], int] = {}   # (start, end) -> smallest period

    def keep(start, end, q):
        if end - start >= max(min_length, copies * q):
            found[start, end] = min(q, found.get((start, end), q))

    long_enough = int(np.searchsorted(-sizes, -min_length, "right"))
    n = int(starts[long_enough - 1] + sizes[long_enough - 1]) if long_enough else 0
    for q in range(1, min(direct, n // copies) + 1):
        same = np.concatenate([[False], ids[:n - q] == ids[q:n], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2]
        for i in np.flatnonzero(end - begin + q >= max(min_length, copies * q)).tolist():
            keep(int(begin[i]), int(end[i]) + q, q)

    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        _mixed(ids[:n].astype(np.uint64) + np.uint64(1)) * _powers(n + 1)[0][:n])])
    longest = int(sizes[0]) if len(sizes) else 0
    for a, b in scales(longest // copies, direct):
        texts = int(np.searchsorted(-sizes, -max(min_length, copies * a), "right"))
        m = int(starts[texts - 1] + sizes[texts - 1]) if texts else 0
        periods, places = _seeds(total, m, a, b)
        order = np.lexsort((places, periods))
        last_q, last_end = 0, -1
        for q, i in zip(periods[order].tolist(), places[order].tolist()):
            if q == last_q and i + q < last_end:
                continue        # inside the stretch just extended
            before = _reach(ids, i, i + q, -1, i)
            after = _reach(ids, i, i + q, 1, m - i - q)
            if after:           # else: grams of equal hash, not of equal words
                last_q, last_end = q, i + q + after
                keep(i - before, last_end, q)

    if not found:
        return (np.empty(0, np.int64),) * 4
    rows = np.array([(s, e, q) for (s, e), q in found.items()], np.int64)
    text = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows = np.column_stack([text, rows[:, 0] - starts[text], rows[:, 1] - rows[:, 0], rows[:, 2]])
    return tuple(rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].T)


def _dropped(runs) -> list[tuple[int, int]]:
    """Merged word ranges that lie beyond the first period of a run."""
    out: list[list[int]] = []
    for start, length, q in sorted(runs, key=lambda r: r[0] + r[2]):
        a, b = start + q, start + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def collapse(words: list, runs) -> list:
    """``words`` without those beyond the first period of any run."""
    at, kept = 0, []
    for a, b in _dropped(runs):
        kept += words[at:a]
        at = b
    return kept + words[at:]


# -- Spark -----------------------------------------------------------------------

def repeat_tail(words: list, crc: int) -> list:
    """A tenth of the texts (by the checksum of their id) become periodic from
    some word on; the others stay."""
    n, g = len(words), crc // 10
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _analyse(texts: list[list]):
    """Runs of each list of words, as lists of (start, length, period)."""
    sizes = np.array([len(w) for w in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    number = defaultdict(count().__next__)
    parts, mark = [], -1
    for i in order.tolist():
        if sizes[i] < MIN_LENGTH:
            break
        part = np.empty(sizes[i] + 1, np.int64)
        part[:-1] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, sizes[i])
        part[-1] = mark
        mark -= 1
        parts.append(part)
    out = [[] for _ in texts]
    if parts:
        own = sizes[order[:len(parts)]]
        starts = np.concatenate([[0], np.cumsum(own + 1)[:-1]])
        for text, *run in zip(*(c.tolist() for c in find_runs(np.concatenate(parts), starts, own))):
            out[order[text]].append(tuple(run))
    return out


def _batch(texts: list[list]):
    runs = _analyse(texts)
    return pd.DataFrame({
        "n_words": [len(w) for w in texts],
        "runs": [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs],
        "collapsed": [b" ".join(collapse(w, found) if found else w) for w, found in zip(texts, runs)]})


def _detect(edit):
    def run(text: pd.Series, crc: pd.Series) -> pd.DataFrame:
        out, held, size = [], [], 0
        for t, c in zip(text, crc):
            # bytes.split parts at exactly \x20 and \x09-\x0D.
            words = bytes(t).split() if t is not None else []
            held.append(edit(words, int(c)) if edit else words)
            size += len(words)
            if size >= CHUNK:
                out.append(_batch(held))
                held, size = [], 0
        out.append(_batch(held))
        return pd.concat(out, ignore_index=True)
    return run


def periodic_runs(docs: DataFrame, edit=None) -> DataFrame:
    """``docs`` without its text, plus ``n_words``, ``runs`` (start, length and
    period of every run, by start, then period) and ``collapsed`` (the kept
    words joined by a space, as UTF-8 bytes). Input columns of these names are
    replaced. ``edit(words, crc32 of the id)``, if given, changes the words first.

    Null, empty and blank texts have no words and no run. Repeated rows give
    repeated results; ids are only read for ``edit`` (a null id counts as '').
    Texts of any length are handled whole. An empty table gives an empty table.
    """
    detect = F.pandas_udf(_detect(edit), _OUT)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cols = without(docs, "text", "n_words", "runs", "collapsed", "__out")
    return (docs.withColumn("__out", detect(F.col("text").cast("binary"), crc))
            .select(*map(quoted, cols), "__out.n_words", "__out.runs", "__out.collapsed"))


def most_repeated(runs):
    """The run with the greatest length / period (ties: smallest start, then
    period), null without a run; exact, as fractions are cross-multiplied."""
    def better(a, b):
        gain = a["length"] * b["period"] - b["length"] * a["period"]
        return F.when((gain > 0) | ((gain == 0) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"]))),
                      a).otherwise(b)
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda s, r: better(r, s))


def op11(spark, sf_dir):
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), repeat_tail)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most_repeated(F.col("runs")).alias("best"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")
