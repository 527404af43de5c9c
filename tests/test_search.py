"""C13/W2/R4/R5 invariants and brute-force checks on a small fixture."""
import numpy as np
from pyspark.sql import functions as F

from quire.operators.bm25 import bm25_topk
from quire.operators.search import cosine_topk, hybrid_search


def test_cosine_topk_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    m[5] = 0.0                                   # zero vector never ranks
    items = spark.createDataFrame([(i, m[i].tolist()) for i in range(300)], "key long, vec array<float>")
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 40, 4)], "query_id long, vec array<float>")
    got = {(r["query_id"], r["rank"]): (r["key"], r["score"])
           for r in cosine_topk(items, q, 5).collect()}
    norms = np.linalg.norm(m.astype(np.float64), axis=1)
    for qi in range(0, 40, 4):
        s = np.round((m[qi].astype(np.float64) @ m.astype(np.float64).T) / (norms[qi] * np.where(norms == 0, 1, norms)), 6)
        s[norms == 0] = -np.inf
        order = sorted(range(300), key=lambda j: (-s[j], j))[:5]
        for rank, j in enumerate(order, 1):
            assert got[(qi, rank)][0] == j
            assert abs(got[(qi, rank)][1] - s[j]) < 1e-9
        assert got[(qi, 1)][0] == qi                     # self is nearest
        assert all(-1 <= got[(qi, k)][1] <= 1 for k in range(1, 6))


def test_cosine_topk_blocks_equal_single(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8)).astype(np.float32)
    items = spark.createDataFrame([(i, m[i].tolist()) for i in range(120)], "key long, vec array<float>")
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(30)], "query_id long, vec array<float>")
    one = sorted(map(tuple, cosine_topk(items, q, 3).collect()))
    many = sorted(map(tuple, cosine_topk(items, q, 3, per_group=4).collect()))
    assert one == many


def test_repeated_query_ids_beyond_a_block(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "key long, vec array<float>")
    q = spark.createDataFrame([(i % 2, [1.0, float(i)]) for i in range(40)], "query_id long, vec array<float>")
    got = cosine_topk(items, q, 3, per_group=4).collect()
    assert {(r["query_id"], r["rank"]) for r in got} == {(a, b) for a in (0, 1) for b in (1, 2, 3)}


def test_bm25_and_hybrid_rank_shape(spark, ctx001):
    q = ctx001.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    b = bm25_topk(ctx001.arts, q, 5)
    assert b.groupBy("query_id").count().filter("count > 5").count() == 0
    h = hybrid_search(ctx001.arts, q, 5, 20).collect()
    assert h and all(0 < r["score"] <= 2 / 61 + 1e-6 for r in h)


def test_bm25_matches_python_brute_force(spark, ctx001):
    import math
    import re
    arts = ctx001.arts.select("pmid", "title", "abstract").collect()
    docs = {r["pmid"]: [t for t in re.split(r"[\W_]+", (r["title"] + "\n" + r["abstract"]).lower()) if t]
            for r in arts}
    n = len(docs)
    avgdl = sum(len(t) for t in docs.values()) / n
    qs = [(1, "the ther ble"), (2, "Und der thon"), (3, "zzzz nothing")]
    want = {}
    for qid, text in qs:
        qt = sorted({t for t in re.split(r"[\W_]+", text.lower()) if t})
        scores = {}
        for pmid, toks in docs.items():
            s, hit = 0.0, False
            for t in qt:
                tf = toks.count(t)
                if tf:
                    hit = True
                    df = sum(1 for d in docs.values() if t in d)
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))
            if hit:
                scores[pmid] = round(s, 6)
        want[qid] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
    q = spark.createDataFrame(qs, "query_id long, text string")
    got = {}
    for r in bm25_topk(ctx001.arts, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["pmid"], r["score"]))
    for qid, _ in qs:
        w = want[qid]
        g = got.get(qid, [])
        assert [p for p, _ in g] == [p for p, _ in w]
        assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(g, w))


def test_block_bounds_skip_pairs_and_stay_exact():
    """On clustered vectors most blocks are not visited; the scores equal an
    exhaustive search, ties by place included."""
    from quire.operators.search import VectorBlocks
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    m = np.repeat(centres, 100, 0) + .05 * rng.normal(size=(4000, 24))
    m[10] = m[3000] = m[7]                       # equal vectors in any place
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    blocks = VectorBlocks(unit)
    places, scores, scored = blocks.topk(unit[:200], 6)
    full = np.round(unit[:200] @ unit.T, 6)
    for q in range(200):
        want = sorted(range(4000), key=lambda j: (-full[q, j], j))[:6]
        assert places[q].tolist() == want and np.allclose(scores[q], full[q, want], atol=1e-9)
    assert scored < 0.2 * 200 * 4000
    few, _, _ = VectorBlocks(unit[:3]).topk(unit[:1], 5)
    assert sorted(few[0].tolist()) == [-1, -1, 0, 1, 2]


def test_cosine_of_odd_vectors(spark):
    """Null, empty and zero vectors and those with a null or NaN never rank and ask nothing."""
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0])]
    items = spark.createDataFrame(rows, "key long, vec array<double>")
    q = items.select((items.key * 10).alias("query_id"), "vec")
    got = sorted((r.query_id, r["rank"], r.key, r.score) for r in cosine_topk(items, q, 3).collect())
    assert got == [(10, 1, 1, 1.0), (10, 2, 7, 0.707107), (70, 1, 7, 1.0), (70, 2, 1, 0.707107)]
    assert cosine_topk(items.where("false"), q, 3).count() == 0
    assert cosine_topk(items, q.where("false"), 3).count() == 0


def test_vector_plan_has_no_broadcast_and_one_pass(spark):
    """Any number of queries: the stored vectors are scanned and dealt once."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    items = e.select("vec_id", F.col("embedding").alias("vec"))
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    out = cosine_topk(items, q, 3, item_key="vec_id", per_group=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
    assert plan.count("Scan parquet") == 2       # the vectors, the queries
    assert out.count() == 3 * items.count()


def test_stored_vectors_are_used(spark, ctx001):
    from quire.operators.search import article_vectors
    q = ctx001.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    stored = article_vectors(ctx001.arts)

    def embed(text):
        from quire.functions.vectors import hash_embed
        assert "abstract" not in str(text)       # the articles are not embedded again
        return hash_embed(text)
    a = sorted(map(tuple, hybrid_search(ctx001.arts, q, 5, 20, embed=embed, vectors=stored).collect()))
    assert a == sorted(map(tuple, hybrid_search(ctx001.arts, q, 5, 20).collect()))


def _index_of(spark, docs, run_tokens=None, monkeypatch=None):
    from quire.operators import bm25
    if run_tokens:
        monkeypatch.setattr(bm25, "RUN_TOKENS", run_tokens)
    dt = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(docs)], "doc_id long, pmid string, toks array<string>")
    return bm25.block_index(dt.repartition(3))


def _exhaustive(docs, queries, k):
    import math
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for qid, words in queries:
        scores = {}
        for t in set(words):
            df = sum(t in d for d in docs)
            for i, d in enumerate(docs):
                if tf := d.count(t):
                    part = math.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(d) / avgdl))
                    scores[i] = scores.get(i, 0) + part
        best = sorted((-round(s, 6), str(i)) for i, s in scores.items())[:k]
        out += [(qid, p, -s, r) for r, (s, p) in enumerate(best, 1)]
    return sorted(out)


def test_pruned_bm25_equals_exhaustive_and_scores_fewer_postings(spark, monkeypatch):
    """Skewed words: common ones have long lists that need not be scored."""
    import random
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [rnd.choices(words, weights, k=rnd.randint(0, 80)) for _ in range(1500)]
    docs[20] = docs[3]                                   # equal documents: ties by pmid
    asked = [(i, rnd.choices(words, weights, k=rnd.randint(1, 12))) for i in range(40)]
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in asked], "query_id int, text string")
    everything = sum(sum(t in d for d in docs) for _, w in asked for t in set(w))
    for run_tokens in (None, 3000):                      # few and many runs
        index = _index_of(spark, docs, run_tokens, monkeypatch)
        counts = spark.sparkContext.accumulator(0)
        got = bm25_topk(spark.range(0), q, 5, index=index, counts=counts)
        assert sorted((r.query_id, r.pmid, r.score, r["rank"]) for r in got.collect()) == _exhaustive(docs, asked, 5)
        assert 0 < counts.value < .7 * everything
    assert index.groups > 5


def test_bounds_hold_for_every_block(spark):
    """No posting scores over its block's or its list's bound."""
    from quire.operators import bm25
    rng = np.random.default_rng(8)
    docs = [[f"t{x}" for x in rng.integers(0, 5, rng.integers(1, 60))] for _ in range(700)]
    index = _index_of(spark, docs)
    for row in index.df.where("token <> ''").collect():
        dl = np.frombuffer(index.df.where(f"token = '' AND run = {row.run}").first().dl, np.int32).astype(float)
        x = bm25._List(row.asDict(), 1.3, dl, lambda n: 1.2 * (.25 + .75 * n / 30))
        assert len(x.doc) == row.n and (np.diff(x.doc) > 0).all()
        per_block = [x.impacts()[i:i + bm25.BLOCK].max() for i in range(0, row.n, bm25.BLOCK)]
        assert (np.array(per_block) <= x.block_bounds() + 1e-12).all() and len(per_block) == len(x.block_bounds())
        assert x.impacts().max() <= x.bound + 1e-12


def test_bm25_shuffles_at_most_k_rows_per_query_and_group(spark):
    docs = [["a", "b", f"c{i % 7}"] for i in range(300)]
    index = _index_of(spark, docs)
    q = spark.createDataFrame([(i, "a b c1") for i in range(10)], "query_id int, text string")
    out = bm25_topk(spark.range(0), q, 4, index=index)
    assert out.count() == 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _index_bytes_per_token(n_tokens: int) -> float:
    import tracemalloc

    import pyarrow as pa
    from quire.operators import bm25
    rng = np.random.default_rng(1)
    ends = np.arange(0, n_tokens + 1, 200, dtype=np.int32)
    words = pa.array([f"t{x}" for x in rng.integers(0, 20_000, n_tokens)])
    toks = pa.ListArray.from_arrays(pa.array(ends), words)
    ids = pa.array([str(i) for i in range(len(toks))])
    tracemalloc.start()
    bm25._run_rows(0, ids, ids.cast(pa.int64()), toks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / n_tokens


def test_index_run_holds_few_numbers_per_token():
    assert _index_bytes_per_token(400_000) < 36


def test_embedding_by_slices_equals_the_rule(monkeypatch):
    """Words of any script, lists that are null or empty, slices of any size."""
    import hashlib

    import pyarrow as pa
    from quire.functions import vectors
    lists = [["a", "b", "a"], None, [], ["été", "漢"], [f"w{i}" for i in range(300)], [], ["a"]]
    want = []
    for words in lists:
        v = np.zeros(64)
        for w in words or []:
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        want.append((v / np.sqrt((v * v).sum())).astype(np.float32).tolist() if words else None)
    toks = pa.array([["unseen"]] + lists, pa.list_(pa.string())).slice(1)
    for size in (1, 4, 500_000):
        monkeypatch.setattr(vectors, "SLICE_TOKENS", size)
        assert vectors.unit_counts(toks).to_pylist() == want
    assert vectors.unit_counts(toks.slice(0, 0)).to_pylist() == []
