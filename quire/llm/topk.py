"""Exact top-k search by inner product with pivot-table elimination.

Components become integers floor(64 x). A table holds, for every vector, its
distances to ``PIVOTS`` pivots. By the triangle inequality the greatest
difference of a query's and a candidate's pivot distances is a lower bound of
their distance, and with the norms an upper bound of their inner product. Each
query evaluates candidates in the order of that bound and stops, exactly, when
the bound falls below its k-th score.

Spark: candidates are packed into blocks (vectors, norms, pivot distances) and
queries into query blocks. Each candidate block visits each query block once:
the rows are dealt by (query block, split) and sorted so that the query block
comes first, then candidate blocks stream by; a task holds one query block, one
candidate block and k results per query. The partial results meet in a
per-query rank over splits x k rows. The only driver-side data are the pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import id_key, id_of, table
from quire.session import cut_lineage

K = 20
SCALE = 64
PIVOTS = 16
PIVOT_POOL = 512       # rows (of smallest id hash) among which pivots are chosen
BLOCK = 4096           # candidates per block
QUERY_BLOCK = 2048     # queries per block
SPLITS = 8             # tasks that share a query block
STEP = 128             # candidates evaluated first, in bound order; then twice as many each time


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    x = F.col("embedding")
    ok = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(ok).select(id_key("vec_id").alias("id"),
                                    F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def choose_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of ``n`` rows of the pool."""
    if not len(pool):
        return pool
    chosen = [0]
    near = ((pool - pool[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(pool)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _pack(dim: int, pivots: np.ndarray, size: int):
    """(id, v) -> blocks: ids, vectors in the smallest integer type, squared
    norms and pivot distances, as bytes."""
    def block(ids, v):
        d = np.asarray(v, np.float64)
        far = np.sqrt(((d[:, None, :] - pivots[None]) ** 2).sum(2)).astype(np.float32)
        top = int(np.abs(v).max(initial=0))
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
        return (np.dtype(kind).str, ids.tobytes(), v.astype(kind).tobytes(), (d * d).sum(1).tobytes(), far.T.tobytes())

    def run(batches):
        ids, rows = np.empty(0, np.int64), np.empty((0, dim), np.int64)
        names = ["kind_of", "ids", "vectors", "norms", "far"]

        def out(blocks):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*blocks), [pa.string()] + 4 * [pa.binary()])], names=names)
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            rows = np.concatenate([rows, _matrix(batch.column(1), dim)])
            while len(ids) >= size:
                yield out([block(ids[:size], rows[:size])])
                ids, rows = ids[size:], rows[size:]
        if len(ids):
            yield out([block(ids, rows)])
    return run


class _Block:
    def __init__(self, row: dict, dim: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        v = np.frombuffer(row["vectors"], row["kind_of"]).reshape(len(self.ids), dim)
        self.v, self.top, self._as = v, int(np.abs(v.astype(np.int64)).max(initial=0)), {}
        self.norms = np.frombuffer(row["norms"], np.float64)
        # One row per pivot, so that the maximum over pivots runs along memory.
        self.far = np.frombuffer(row["far"], np.float32).reshape(-1, max(1, len(self.ids)))

    def values(self, kind):
        """The vectors as ``kind``, converted once."""
        if kind not in self._as:
            self._as[kind] = self.v.astype(kind)
        return self._as[kind]


def exact_type(q: _Block, c: _Block):
    """The cheapest type in which all inner products of two blocks are exact
    (beyond doubles: 64-bit integers, which hold any score that is a long)."""
    most = q.top * c.top * q.v.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def search_block(q: _Block, c: _Block, best: list, k: int) -> int:
    """Updates ``best`` (per query: scores, ids by rank) with one candidate
    block; returns how many candidates were evaluated."""
    kind = exact_type(q, c)
    qv, cv = q.values(kind), c.values(kind)
    slack = 1e-3 + 1e-5 * (q.norms.max(initial=0) + c.norms.max(initial=0))  # float32 distances
    evaluated = 0
    for i in range(len(q.ids)):
        scores, ids = best[i]
        least = scores[-1] if len(scores) == k else -np.inf
        low = np.abs(c.far - q.far[:, i, None]).max(0).astype(np.float64)
        high = (q.norms[i] + c.norms - low * low) / 2 + slack
        left = np.flatnonzero((high >= least) & (c.ids != q.ids[i]))
        left = left[np.argsort(-high[left])]
        lo, step = 0, STEP
        while lo < len(left) and high[left[lo]] >= least:
            part = left[lo:lo + step]
            lo, step = lo + step, 2 * step
            evaluated += len(part)
            new = cv[part] @ qv[i]
            good = new >= least
            if not good.any():
                continue
            s = np.concatenate([scores, new[good].astype(np.int64)])
            n = np.concatenate([ids, c.ids[part[good]]])
            top = np.lexsort((n, -s))[:k]
            scores, ids = s[top], n[top]
            least = scores[-1] if len(scores) == k else -np.inf
        best[i] = (scores, ids)
    return evaluated


def _search(dim: int, k: int):
    def run(batches):
        key, q, best = None, None, []

        def results():
            n = [len(s) for s, _ in best]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(sum(n), key[0], np.int64)), pa.array(np.repeat(np.arange(len(n)), n)),
                 pa.array(np.repeat(q.ids, n)), pa.array(np.concatenate([i for _, i in best])),
                 pa.array(np.concatenate([s for s, _ in best]))], names=["qb", "row", "query", "id", "score"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["is_candidate"] == 0:
                    if q is not None and len(q.ids):
                        yield results()
                    key, q = (row["qb"], row["split"]), _Block(row, dim)
                    none = np.empty(0, np.int64)
                    best = [(none, none)] * len(q.ids)
                else:
                    search_block(q, _Block(row, dim), best, k)
        if q is not None and len(q.ids):
            yield results()
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query, rank, id, score): the ``k`` vectors of greatest inner product
    with each row of ``queries``, ties to the smaller id; all, if fewer.

    Both have vec_id and embedding. Vectors that are null or hold a null or
    non-finite component take no part; shorter vectors count as padded with
    zeros. Rows that share the query's id are the query itself; other repeated
    rows are candidates each. A null id is the largest. Other columns are
    ignored; empty tables give no rows.
    """
    rows = cut_lineage(integer_rows(vectors, scale), "topk-vectors")
    asked = cut_lineage(integer_rows(queries, scale), "topk-queries")
    dims = rows.select(F.max(F.size("v")).alias("d")).unionByName(asked.select(F.max(F.size("v")).alias("d")))
    dim = int(dims.agg(F.max("d")).first()[0] or 0)
    pool = rows.orderBy(F.xxhash64("id"), "v").limit(PIVOT_POOL).toArrow()
    found = [_matrix(c, dim) for c in pool.column("v").chunks if len(c)]
    pivots = choose_pivots(np.vstack(found).astype(np.float64) if found else np.zeros((1, dim)), PIVOTS)

    kinds = "kind_of string, ids binary, vectors binary, norms binary, far binary"
    blocks = cut_lineage(rows.mapInArrow(_pack(dim, pivots, BLOCK), kinds), "topk-blocks")
    packed = asked.coalesce(max(1, -(-asked.count() // QUERY_BLOCK))).mapInArrow(_pack(dim, pivots, QUERY_BLOCK), kinds)
    packed = cut_lineage(packed.withColumn("qb", F.monotonically_increasing_id()), "topk-query-blocks")
    names = [r.qb for r in packed.select("qb").collect()]  # one number per 2,048 queries
    every = F.explode(F.array(*map(F.lit, names)).cast("array<bigint>")).alias("qb")
    cols = ["kind_of", "ids", "vectors", "norms", "far"]
    visits = blocks.select(*cols, every, F.pmod(F.xxhash64("ids"), F.lit(SPLITS)).cast("int").alias("split"),
                           F.lit(1).alias("is_candidate"))
    asked = packed.select(*cols, "qb", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("split"),
                          F.lit(0).alias("is_candidate"))
    found = (asked.unionByName(visits).repartition("qb", "split")
             .sortWithinPartitions("qb", "split", "is_candidate")
             .mapInArrow(_search(dim, k), "qb long, row long, query long, id long, score long"))
    rank = F.row_number().over(Window.partitionBy("qb", "row").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def op3(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = top_k(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select(F.col("query").alias("query_id"), "rank", id_of(F.col("id")).alias("vec_id"), "score")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
