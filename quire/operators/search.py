"""Vector and hybrid search: C11, C13, J5, W2, S2, R2, R3, R5, P6.

Exact cosine top-k without a cross join, a broadcast or a collect: stored
vectors are dealt once, by hash, to groups of bounded size; every group gets
the query rows, which stream past the vectors that a task holds, so any number
of queries takes one pass over the stored vectors. Within a group the unit
vectors form blocks around pivots. With t the angle between query and pivot and
r the largest angle of the block to its pivot, no score of the block exceeds
cos(t - r); a query visits its most promising block first and then only blocks
whose bound reaches its k-th best score. At most k rows per query and group
are shuffled to the final top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.vectors import hash_embed
from quire.operators.bm25 import bm25_topk
from quire.operators.match import top_k
from quire.session import cut_lineage

SCORE_DP = 6
GROUP_ITEMS = 65_536     # stored vectors that a task holds at a time
SPREAD_ITEMS = 512       # groups are no smaller than this to occupy idle cores
BLOCK_ITEMS = 128        # stored vectors per pivot, on average
QUERY_CHUNK = 512
RRF_K = 60  # reciprocal-rank fusion constant (Cormack et al. 2009)
_UNIT = 10 ** SCORE_DP
_LOW = (1 << 32) - 1     # the low half of a packed score holds the place, reversed


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as float64; a missing vector is a row of zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    if ((sizes != dim) & (sizes > 0)).any():
        raise ValueError("vectors differ in length")
    out = np.zeros((len(sizes), dim))
    if dim:
        out[sizes > 0] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out


def _unit_rows(m: np.ndarray):
    """(unit rows, their places): rows with a null, a non-finite value or no length are left out."""
    norms = np.sqrt(np.concatenate([(m[a:a + 4096] * m[a:a + 4096]).sum(axis=1) for a in range(0, len(m), 4096)] or [[]]))
    keep = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    unit = m[keep]
    unit /= norms[keep][:, None]
    return unit, keep


class VectorBlocks:
    """Unit vectors in key order, cut into blocks around pivots."""

    def __init__(self, unit: np.ndarray, block_items: int = BLOCK_ITEMS):
        n = len(unit)
        self.n = n
        pivots = unit[::max(1, min(block_items, n))]
        nearest = np.concatenate([(unit[a:a + 4096] @ pivots.T).argmax(1) for a in range(0, n, 4096)])
        order = np.argsort(nearest, kind="stable")
        used, first = np.unique(nearest[order], return_index=True)
        self.pivots, self.places = pivots[used], np.split(order, first[1:])
        self.members = [unit[p] for p in self.places]
        self.radius = np.array([np.arccos(np.clip((m @ p).min(), -1, 1)) for m, p in zip(self.members, self.pivots)])

    def topk(self, queries: np.ndarray, k: int):
        """(places, scores, pairs scored): per unit query row the k best vectors,
        ties by place; place -1 fills up where there are fewer."""
        empty = np.iinfo(np.int64).min
        best = np.full((len(queries), k), empty)
        angle = np.arccos(np.clip(queries @ self.pivots.T, -1, 1))
        bound = np.cos(np.maximum(angle - self.radius, 0))
        scored = 0

        def visit(b, rows):
            scores = np.rint((queries[rows] @ self.members[b].T) * _UNIT).astype(np.int64)
            packed = np.hstack([best[rows], (scores << 32) + (_LOW - self.places[b])])
            best[rows] = np.partition(packed, packed.shape[1] - k, axis=1)[:, -k:]
            return scores.size

        first = bound.argmax(1)
        for b in np.unique(first):
            scored += visit(b, np.flatnonzero(first == b))
        for b in np.argsort(-bound.max(0)):
            kth = best.min(1)
            reach = np.rint(bound[:, b] * _UNIT).astype(np.int64) + 2
            rows = np.flatnonzero((first != b) & ((kth == empty) | (reach >= kth >> 32)))
            if len(rows):
                scored += visit(b, rows)
        best = -np.sort(-best, axis=1)
        return np.where(best == empty, -1, _LOW - (best & _LOW)), (best >> 32) / _UNIT, scored


def _topk_groups(k: int, key_type, query_type, item_key: str, counts=None):
    """Rows sorted by (group, kind): stored vectors (0), then queries (1)."""
    def answer(blocks, keys, ids, m):
        unit, rows = _unit_rows(m)
        for a in range(0, len(unit), QUERY_CHUNK):
            places, scores, scored = blocks.topk(unit[a:a + QUERY_CHUNK], k)
            if counts is not None:
                counts.add(int(scored))
            q, r = np.nonzero(places >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in rows[a:a + QUERY_CHUNK][q].tolist()], query_type),
                 pa.array([keys[i] for i in places[q, r].tolist()], key_type), pa.array(scores[q, r])],
                names=["query_id", item_key, "score"])

    def hold(parts):
        keys = [x for own, _ in parts for x in own]
        dim = max(m.shape[1] for _, m in parts)
        m = np.concatenate([m if m.shape[1] else np.zeros((len(m), dim)) for _, m in parts])
        parts.clear()
        unit, rows = _unit_rows(m)
        del m
        order = sorted(range(len(rows)), key=lambda i: (keys[rows[i]] is not None, keys[rows[i]]))
        unit = unit[order]
        return (VectorBlocks(unit) if len(rows) else None), [keys[rows[i]] for i in order]

    def run(batches):
        group, parts, blocks, keys = None, [], None, []
        for batch in batches:
            g = batch.column("g").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1, [len(g)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if g[a] != group:
                    group, parts, blocks, keys = g[a], [], None, []
                m = _matrix(part.column("vec"))
                if kind[a] == 0:
                    parts.append((part.column("key").to_pylist(), m))
                    continue
                if parts:
                    blocks, keys = hold(parts)
                    parts = []
                if blocks is not None:
                    yield from answer(blocks, keys, part.column("query_id").to_pylist(), m)
    return run


def cosine_topk(items: DataFrame, queries: DataFrame, k: int = 5, item_key: str = "key",
                item_vec: str = "vec", per_group: int = GROUP_ITEMS, counts=None) -> DataFrame:
    """C13 + W2: (query_id, <item_key>, score, rank), score = cosine rounded to
    6 dp, ties broken by key. Null and zero vectors and vectors with a null or
    non-finite value never rank and ask nothing.

    ``queries`` has (query_id, vec). ``items`` is counted, so pass a stored
    table. ``counts``, an accumulator, gets the number of pairs scored."""
    key_type, id_type = items.schema[item_key].dataType, queries.schema["query_id"].dataType
    types = {items.schema[item_vec].dataType.simpleString(), queries.schema["vec"].dataType.simpleString()}
    vec = "array<float>" if types == {"array<float>"} else "array<double>"
    n = items.count()
    groups = max(1, -(-n // per_group), min(n // SPREAD_ITEMS, items.sparkSession.sparkContext.defaultParallelism))

    stored = items.select(
        F.pmod(F.xxhash64(item_key, item_vec), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"),
        F.col(item_key).alias("key"), F.lit(None).cast(id_type).alias("query_id"), F.col(item_vec).cast(vec).alias("vec"))
    asked = queries.where("size(vec) > 0").select("query_id", F.col("vec").cast(vec).alias("vec")).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"),
        F.lit(None).cast(key_type).alias("key"), "query_id", "vec")
    rows = stored.unionByName(asked).repartitionById(groups, "g").sortWithinPartitions("g", "kind")
    found = rows.mapInArrow(_topk_groups(k, to_arrow_type(key_type), to_arrow_type(id_type), item_key, counts),
                            f"query_id {id_type.simpleString()}, `{item_key}` {key_type.simpleString()}, score double")
    return top_k(found, "query_id", k, order_key=item_key)


def embed_queries(queries: DataFrame, embed=hash_embed) -> DataFrame:
    return queries.select("query_id", embed(F.col("text")).alias("vec"))


def search_similar_analyses(store: DataFrame, queries: DataFrame, k: int = 5,
                            embed=hash_embed) -> DataFrame:
    """Stored analyses most similar to each query text."""
    items = store.select(F.concat_ws("\u0001", F.coalesce("compound", F.lit("")),
                                     F.coalesce("disease", F.lit("")),
                                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                                     F.md5(F.coalesce("content", F.lit("")))).alias("key"),
                         "compound", "disease", "content", "created_at",
                         F.col("content_vector").alias("vec"))
    q = embed_queries(queries, embed)
    # Written first: Spark then knows how few hits there are.
    hits = cut_lineage(cosine_topk(items, q, k, item_key="key"), "similar")
    return items.drop("vec").join(hits, "key").drop("key")


def search_similar_articles(store: DataFrame, queries: DataFrame, k: int = 5,
                            compound: str | None = None, disease: str | None = None,
                            embed=hash_embed) -> DataFrame:
    """R3 + C11 (+ P6 optional filters, applied before ranking):
    (query_id, rank, pmid, title, abstract, compound, disease, similarity)."""
    s = store
    if compound is not None:
        s = s.filter(F.col("compound") == compound)
    if disease is not None:
        s = s.filter(F.col("disease") == disease)
    q = embed_queries(queries, embed)
    hits = cut_lineage(cosine_topk(s.select("pmid", F.col("content_vector").alias("vec")), q, k,
                                   item_key="pmid"), "similar")
    meta = s.select("pmid", "title", "abstract", "compound", "disease")
    return (meta.join(hits, "pmid")
            .select("query_id", "rank", "pmid", "title", "abstract", "compound", "disease",
                    F.col("score").cast("double").alias("similarity")))


def article_vectors(arts: DataFrame, embed=hash_embed) -> DataFrame:
    """(pmid, vec) of every article, written once."""
    from quire.functions.text import article_content
    return cut_lineage(arts.select("pmid", embed(article_content(F.col("title"), F.col("abstract"))).alias("vec")),
                       "article-vectors")


def dense_article_topk(arts: DataFrame, queries: DataFrame, k: int = 5,
                       embed=hash_embed, vectors: DataFrame | None = None) -> DataFrame:
    """R3 over the whole corpus. ``vectors`` (pmid, vec) are stored ones of the
    same embedder; without them the articles are embedded."""
    items = article_vectors(arts, embed) if vectors is None else vectors
    return cosine_topk(items, embed_queries(queries, embed), k, item_key="pmid")


def hybrid_search(arts: DataFrame, queries: DataFrame, k: int = 5, depth: int = 20,
                  embed=hash_embed, vectors: DataFrame | None = None, **bm25_kw) -> DataFrame:
    """Dense (R3, over stored ``vectors`` if given) and BM25 (R4) lists of
    ``depth`` each, fused by reciprocal rank, sum(1 / (60 + rank)); top k per
    query by the fused score (rounded to 6 dp), ties by pmid."""
    dense = dense_article_topk(arts, queries, depth, embed, vectors).select(
        "query_id", "pmid", F.col("rank").alias("r_dense"))
    text = bm25_topk(arts, queries, depth, **bm25_kw).select(
        "query_id", "pmid", F.col("rank").alias("r_text"))
    fused = (dense.join(text, ["query_id", "pmid"], "full_outer")
             .select("query_id", "pmid", "r_dense", "r_text",
                     F.round(F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col("r_dense")), F.lit(0.0))
                             + F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col("r_text")), F.lit(0.0)),
                             SCORE_DP).alias("score")))
    return top_k(fused, "query_id", k)

