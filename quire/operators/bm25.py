"""BM25 of free-text queries over a block-max index, with dynamic pruning: R4.

Index. One pass over the token arrays, without a shuffle: each task cuts its
documents into runs and writes, per run and token, the posting list (places of
the documents, term frequencies, lengths) in blocks of ``BLOCK`` postings, with
the largest frequency and the smallest length of the list and of each block.
BM25 grows with the frequency and falls with the length, so these bound every
score of a block under any corpus statistics; the index is independent of them
and can be kept.

Search. Runs are dealt to groups; a task holds the lists of one group at a
time and the queries stream past, so any number of queries takes one pass over
the index and neither side goes through the driver. Per query the lists go in
the order of their upper bounds (impact order). Once the bounds of the lists
left over cannot lift an unseen document over the k-th best score, no new
document is taken up, and of those seen only the ones whose score plus block
bounds still reaches it are completed, posting by posting. What leaves a task
is at most k rows per query and group.

The scores of documents that can end among the k best are complete sums, so
the result equals the exhaustive one; ``MARGIN`` covers the rounding of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.operators.match import B, K1, SCORE_DP, CorpusStats, doc_tokens, top_k
from quire.session import cut_lineage

BLOCK = 128
RUN_TOKENS = 2_000_000  # a run and its lists are held by one task, in the index and in the search
ROWS = 256              # index rows turned into Python objects at a time
MARGIN = 2e-6          # two units of a rounded score
DOCUMENTS = ""         # the token of a run's document row (no real token is empty)

_TASK, _PLACE = "(run DIV 4294967296)", "(run % 4294967296)"
_INDEX = ("run long, token string, n long, dl_sum long, max_tf int, min_dl int, doc binary, tf binary, dl binary, "
          "block_tf binary, block_dl binary, pmid array<string>, doc_id array<long>")
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


# -- index -----------------------------------------------------------------------

def _binary(values, ends):
    """Arrow binaries of consecutive stretches of an int32 array; ``ends`` are
    their ends (from 0). The first row, of the documents, has none."""
    offsets = np.append([0, 0], 4 * ends).astype(np.int32)
    valid = np.packbits(np.append([0], np.ones(len(ends), np.uint8)), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(ends) + 1, [pa.py_buffer(valid), pa.py_buffer(offsets),
                                                              pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _run_rows(run: int, pmids, doc_ids, toks):
    """Index rows of one run of documents, as an Arrow batch: the documents,
    then the lists."""
    dl = np.diff(toks.offsets.to_numpy()).astype(np.int32)
    flat = toks.flatten().dictionary_encode()
    n = max(1, len(dl))
    # One array of a long per token, sorted in place: a task's memory is a few of them.
    key = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key *= n
    key += np.repeat(np.arange(len(dl), dtype=np.int32), dl)
    key.sort()
    flat, tokens_in = flat.dictionary, len(key)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:tokens_in]).astype(np.int32)
    key = key[at]
    tf = np.diff(at, append=np.int32(tokens_in))
    del at
    code, doc = np.empty(len(key), np.int32), np.empty(len(key), np.int32)
    np.floor_divide(key, n, out=code, casting="unsafe")
    np.remainder(key, n, out=doc, casting="unsafe")
    del key
    length = dl[doc]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    size = np.diff(np.append(first, len(code)))
    blocks = -(-size // BLOCK)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)   # of a block in its list
    starts = np.repeat(first, blocks) + BLOCK * number
    # reduceat needs a start; a run without a token has none.
    high, low, list_high, list_low = ([np.maximum.reduceat(tf, s), np.minimum.reduceat(length, s)][i] if len(s) else tf
                                      for s in (starts, first) for i in (0, 1))
    lists = len(first)

    def after_none(values, kind):
        return pa.concat_arrays([pa.array([None], kind), pa.array(values, kind)])

    def only_first(value, kind):
        return pa.concat_arrays([pa.array([value], kind), pa.nulls(lists, kind)])
    words = flat.take(pa.array(code[first])).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(lists + 1, run)), pa.concat_arrays([pa.array([DOCUMENTS]), words]),
         pa.array(np.append(len(dl), size)), only_first(int(dl.sum()), pa.int64()),
         after_none(list_high, pa.int32()), after_none(list_low, pa.int32()),
         _binary(doc, np.cumsum(size)), _binary(tf, np.cumsum(size)), only_first(dl.tobytes(), pa.binary()),
         _binary(high, np.cumsum(blocks)), _binary(low, np.cumsum(blocks)),
         only_first(pmids.to_pylist(), pa.list_(pa.string())), only_first(doc_ids.to_pylist(), pa.list_(pa.int64()))],
        names=_NAMES)


def _index(batches):
    from pyspark import TaskContext

    run = TaskContext.get().partitionId() << 32
    for batch in batches:
        toks = batch.column("toks")
        ends = np.cumsum(np.diff(toks.offsets.to_numpy()))
        start, part = 0, None
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + RUN_TOKENS, "right")))
            part = batch.slice(start, stop - start)
            yield _run_rows(run, part.column("pmid"), part.column("doc_id"), part.column("toks"))
            run, start = run + 1, stop
        del batch, toks, part       # before the next one is read


class BlockIndex:
    """A written block-max index; ``stats`` (G7) come from its document rows."""

    def __init__(self, df: DataFrame):
        self.df = df
        row = (df.where(F.col("token") == DOCUMENTS)
               .agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.sum("dl_sum").alias("dl"),
                    F.expr(f"max({_TASK})").alias("task"), F.expr(f"max({_PLACE})").alias("place")).first())
        n, runs = int(row["n"] or 0), max(1, int(row["runs"]))
        self.stats = CorpusStats(n, (row["dl"] or 0) / n if n else 0.0)
        # Runs are numbered without gaps where tasks have equally many, else hashed.
        places = (row["place"] or 0) + 1
        even = ((row["task"] or 0) + 1) * places
        self.groups = even if even <= 2 * runs else runs
        self.group = (F.expr(f"{_TASK} * {places} + {_PLACE}") if even <= 2 * runs
                      else F.pmod(F.xxhash64("run"), F.lit(runs))).cast("int").alias("g")


def block_index(dt: DataFrame) -> BlockIndex:
    """Index of ``doc_tokens`` rows (doc_id, pmid, toks), written once."""
    return BlockIndex(cut_lineage(dt.select("doc_id", "pmid", "toks").mapInArrow(_index, _INDEX), "block-index"))


# -- search ----------------------------------------------------------------------

class _List:
    """Posting list of a run; scores are computed when first needed."""

    def __init__(self, row, idf, dl, norm):
        self.idf, self.norm, self.run_dl, self.row = idf, norm, dl, row
        self.bound = float(self._impact(np.float64(row["max_tf"]), np.float64(row["min_dl"])))
        self.doc = np.frombuffer(row["doc"], np.int32)
        self._impacts = self._block_bounds = None

    def _impact(self, tf, dl):
        return self.idf * tf * (K1 + 1.0) / (tf + self.norm(dl))

    def impacts(self):
        if self._impacts is None:
            tf = np.frombuffer(self.row["tf"], np.int32).astype(np.float64)
            self._impacts = self._impact(tf, self.run_dl[self.doc])
        return self._impacts

    def impacts_at(self, at):
        if self._impacts is not None:
            return self._impacts[at]
        return self._impact(np.frombuffer(self.row["tf"], np.int32)[at].astype(np.float64), self.run_dl[self.doc[at]])

    def block_bounds(self):
        if self._block_bounds is None:
            self._block_bounds = self._impact(np.frombuffer(self.row["block_tf"], np.int32).astype(np.float64),
                                              np.frombuffer(self.row["block_dl"], np.int32))
        return self._block_bounds

    def find(self, docs):
        """(place, held) of sorted documents in the list."""
        at = np.minimum(np.searchsorted(self.doc, docs), len(self.doc) - 1)
        return at, self.doc[at] == docs


def _kth(values, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best_of_run(lists: list[_List], n_docs: int, k: int, floor: float = -np.inf):
    """(documents, scores, postings scored): every document that can be among
    the k best of the run with at least ``floor``."""
    lists = sorted(lists, key=lambda x: -x.bound)
    rest = np.append(np.cumsum([x.bound for x in lists][::-1])[::-1], 0.0)
    total, scored, done = np.zeros(n_docs), 0, 0
    while done < len(lists) and rest[done] >= floor - MARGIN:
        total[lists[done].doc] += lists[done].impacts()
        scored += len(lists[done].doc)
        done += 1
        if done & (done - 1) == 0 or done % 8 == 0:    # 1, 2, 4, 8, 16, 24 ... lists
            floor = max(floor, _kth(total, k))
    floor = max(floor, _kth(total, k) if n_docs >= k else -np.inf)
    docs = np.flatnonzero(total)
    docs = docs[total[docs] + rest[done] >= floor - MARGIN]
    left = lists[done:]
    if left and len(docs):
        # Block bounds of the lists left over; 0 where a list lacks the document.
        found = [x.find(docs) for x in left]
        ahead = np.stack([np.where(held, x.block_bounds()[at // BLOCK], 0.0) for x, (at, held) in zip(left, found)])
        stays = total[docs] + ahead.sum(0) >= floor - MARGIN
        docs = docs[stays]
        for x, (at, held) in zip(left, found):
            at, held = at[stays], held[stays]
            total[docs[held]] += x.impacts_at(at[held])
            scored += int(held.sum())
    return docs, total[docs], scored


def _keep(best, pmids, doc_ids, docs, scores, k):
    """Merges a run's documents into a query's best rows (score, pmid, doc_id)."""
    scores = np.round(scores, SCORE_DP)
    if len(docs) > k:
        near = np.flatnonzero(scores >= _kth(scores, k))
        docs, scores = docs[near], scores[near]
    best = best + [(-s, pmids[d], doc_ids[d]) for d, s in zip(docs.tolist(), scores.tolist())]
    return sorted(best, key=lambda r: (r[0], r[1] is not None, r[1] or ""))[:k]


def _search(k: int, avgdl: float, query_type, counts=None):
    """Rows sorted by (group, kind): documents of the runs (0), their lists (1),
    then the queries (2) -> query_id, doc_id, pmid, score."""
    def norm(dl):
        return K1 * (1.0 - B + B * dl / avgdl)

    def flush(rows):
        ids, docs, pmids, scores = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, query_type), pa.array(docs, pa.int64()), pa.array(pmids, pa.string()), pa.array(scores)],
            names=["query_id", "doc_id", "pmid", "score"])

    def run(batches):
        group, runs, out = None, {}, []
        for batch in batches:
            for row in (r for a in range(0, batch.num_rows, ROWS) for r in batch.slice(a, ROWS).to_pylist()):
                if row["g"] != group:
                    group, runs = row["g"], {}
                if row["kind"] == 0:
                    runs[row["run"]] = (np.frombuffer(row["dl"], np.int32).astype(np.float64), row["pmid"], row["doc_id"], {})
                elif row["kind"] == 1:
                    dl, _, _, lists = runs[row["run"]]
                    lists[row["token"]] = _List(row, row["idf"], dl, norm)
                else:
                    best = []
                    for dl, pmids, doc_ids, lists in runs.values():
                        mine = [lists[t] for t in row["words"] if t in lists]
                        if mine:
                            floor = -best[-1][0] if len(best) == k else -np.inf
                            docs, scores, scored = best_of_run(mine, len(dl), k, floor)
                            best = _keep(best, pmids, doc_ids, docs, scores, k)
                            if counts is not None:
                                counts.add(scored)
                    out += [(row["query_id"], d, p, -s) for s, p, d in best]
                    if len(out) >= 10_000:
                        yield flush(out)
                        out = []
        if out:
            yield flush(out)
    return run


def bm25_topk(arts: DataFrame, queries: DataFrame, k: int = 5, stats: CorpusStats | None = None,
              dt: DataFrame | None = None, index: BlockIndex | None = None, counts=None) -> DataFrame:
    """BM25 of free-text queries ``(query_id, text)``; any article sharing a
    token is scored; top k per query: (query_id, doc_id, pmid, score, rank).

    ``counts``, an accumulator, gets the number of postings scored."""
    if index is None:
        index = block_index(dt if dt is not None else doc_tokens(arts))
    stats = stats or index.stats
    queries = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("words")).where("size(words) > 0")
    wanted = queries.select(F.explode("words").alias("token")).distinct()
    n = F.lit(float(stats.n_docs))
    idf = F.log(F.lit(1.0) + (n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weights = (index.df.select("token", "n").join(wanted, "token", "left_semi")
               .groupBy("token").agg(F.sum("n").alias("df")).select("token", idf.alias("idf")))

    groups, group = index.groups, index.group
    rows = index.df.drop("n", "dl_sum")
    none = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields}
    id_type = queries.schema["query_id"].dataType
    rows_of_query = {"idf": F.lit(None).cast("double"), "query_id": F.lit(None).cast(id_type),
                     "words": F.lit(None).cast("array<string>")}

    def laid_out(df, kind, **given):
        cols = {**none, **rows_of_query, **given}
        return df.select("g", F.lit(kind).alias("kind"), *(c.alias(name) for name, c in cols.items()))
    own = {c: F.col(c) for c in none}
    documents = laid_out(rows.where(F.col("token") == DOCUMENTS).select("*", group), 0, **own)
    lists = laid_out(rows.where(F.col("token") != DOCUMENTS).join(weights, "token").select("*", group), 1, **own,
                     idf=F.col("idf"))
    asked = laid_out(queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")), 2,
                     query_id=F.col("query_id"), words=F.col("words"))
    tasks = min(groups, max(int(arts.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                            4 * arts.sparkSession.sparkContext.defaultParallelism))
    parts = (documents.unionByName(lists).unionByName(asked).repartitionById(tasks, F.pmod("g", F.lit(tasks)))
             .sortWithinPartitions("g", "kind"))
    from pyspark.sql.pandas.types import to_arrow_type
    avgdl = stats.avgdl if stats.avgdl > 0 else 1.0
    found = parts.mapInArrow(_search(k, avgdl, to_arrow_type(id_type), counts),
                             f"query_id {id_type.simpleString()}, doc_id long, pmid string, score double")
    return top_k(found, "query_id", k)
