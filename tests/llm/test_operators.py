"""The other operators against their brute-force versions."""

import collections
import io
import random
import struct
import zipfile

import numpy as np
import pytest

from quire.llm import language, sharding, suffix_dedup, topk, warc
from tests.llm import brute


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# -- suffix dedup ---------------------------------------------------------------

STRETCHES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def copies(seed, n=60):
    """Texts with shared passages of any length around 400 bytes, runs of one
    byte, periodic stretches and repeats within a text."""
    rnd = random.Random(seed)
    letters = ["ab", "abcdefghij klmno", "éüab ", "01"][seed % 4]
    text = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    pool = [text(rnd.choice([300, 399, 400, 401, 450, 900, 2000])) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            kind = rnd.random()
            if kind < .4:
                p = rnd.choice(pool)
                a = rnd.randint(0, 60)
                parts.append(p[a:len(p) - rnd.randint(0, 60)])
            elif kind < .5:
                parts.append(rnd.choice("xy") * rnd.randint(1, 900))
            elif kind < .6:
                parts.append(text(rnd.randint(1, 30)) * rnd.randint(1, 40))
            else:
                parts.append(text(rnd.randint(1, 700)))
        docs.append({"doc_id": i, "text": rnd.choice(["", " "]).join(parts)})
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_equals_brute_force(spark, seed, monkeypatch):
    docs = copies(seed)
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").repartition(3)
    want = sorted(brute.substring_dedup(docs), key=str)
    assert rows(suffix_dedup.remove_repeated(df), *STRETCHES) == want
    if seed == 1:  # the path of hot phrases
        assert rows(suffix_dedup.remove_repeated(df, hot=2), *STRETCHES) == want


@pytest.mark.parametrize("hot", [20, suffix_dedup.HOT])
def test_suffix_dedup_of_a_passage_that_most_documents_hold(spark, hot):
    """A passage in contexts of their own, exact copies and rows equal in id and text."""
    rnd = random.Random(11)
    text = lambda k: "".join(rnd.choice("abcdefghij klmno") for _ in range(k))
    passage, copy = text(1000), text(1500)
    docs = [{"doc_id": i, "text": text(rnd.randint(0, 300)) + passage + text(rnd.randint(0, 300))} for i in range(60)]
    docs += [{"doc_id": 100 + i, "text": copy} for i in range(60)] + [{"doc_id": 200, "text": copy}] * 3
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").repartition(7)
    got = suffix_dedup.remove_repeated(df, hot=hot)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, *STRETCHES) == sorted(brute.substring_dedup(docs), key=str)


def test_equal_runs_of_a_task_are_one_row():
    import pyarrow as pa
    text = "".join(random.Random(5).choices("abcdefgh ", k=2000)).encode()

    def kinds(n):
        batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(n), pa.int64()), "th": pa.array([0] * n, pa.int64()),
                                            "bytes": pa.array([text] * n, pa.binary())})
        return collections.Counter(r["kind"] for b in suffix_dedup._parse(400)([batch]) for r in b.to_pylist())
    assert kinds(50)[0] == kinds(1)[0] and kinds(50)[2] == 50 * kinds(1)[0] and kinds(1)[2] == 0


def test_suffix_dedup_documents(docs_table, docs):
    want = sorted(brute.substring_dedup(docs), key=str)
    assert rows(suffix_dedup.remove_repeated(docs_table), *STRETCHES) == want


def test_suffix_dedup_odd_rows(odd, odd_docs, empty):
    got = suffix_dedup.remove_repeated(odd)
    assert rows(got, *STRETCHES) == sorted(brute.substring_dedup(odd_docs), key=str)
    assert "text" not in got.columns and "shard" in got.columns
    assert suffix_dedup.remove_repeated(empty).count() == 0


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    for seed in range(4):
        docs = copies(seed, 25)
        found = collections.defaultdict(list)
        for d, stretch in local(docs):
            found[d].append(stretch)
        for want in brute.substring_dedup(docs):
            got = suffix_dedup._merged([{"start": a, "stop": b} for a, b in found[want[0]]])
            assert (sum(b - a for a, b in got), len(got)) == want[2:4]


def local(docs):
    """The operator's steps without Spark."""
    import pyarrow as pa
    raw = {d["doc_id"]: d["text"].encode() for d in docs}
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(raw.keys(), pa.int64()), "th": pa.array([0] * len(raw), pa.int64()),
                                        "bytes": pa.array(raw.values(), pa.binary())})
    parsed = [r for b in suffix_dedup._parse(400)([batch]) for r in b.to_pylist()]
    same = collections.Counter((r["key"], r["h1"], r["h2"]) for r in parsed if r["kind"] != 2)
    keys = collections.defaultdict(dict)
    for r in parsed:
        name = (r["key"], r["h1"], r["h2"])
        if r["kind"] == 2 or same[name] > 1:
            yield r["doc"], (r["pos"], r["pos"] + r["n"] + 399)
        if r["kind"] == 0:
            keys[r["key"]].setdefault(name, r)
    open_ = [(g, r) for g, runs in enumerate(x for x in keys.values() if len(x) > 1) for r in runs.values()]
    if open_:
        texts = [raw[r["doc"]][r["pos"]:r["pos"] + r["n"] + 399] for _, r in open_]
        for run, a, b in suffix_dedup.combine(np.array([g for g, _ in open_]), texts,
                                              np.array([r["at"] for _, r in open_]), np.array([r["n"] for _, r in open_])):
            r = open_[run][1]
            yield r["doc"], (r["pos"] + int(a), r["pos"] + int(b) + 400)


# -- top-k ------------------------------------------------------------------------

def test_topk_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = topk.op3(spark, "/root/testdata/sf0.01")
    want = brute.topk([(r.vec_id, r.embedding) for r in table.collect()])
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (20, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
         (40, [1e9, -1e9]), (6, [-0.001, 0.0]), (7, [3e5, 1.0]), (60, [0.0, 0.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS score")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=4)
    assert sorted(map(tuple, got.collect())) == brute.topk(v, 4)
    assert topk.top_k(df.where("false"), df).count() == 0
    assert topk.top_k(df, df.where("false")).count() == 0


def test_bounds_skip_candidates_and_stay_exact():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (20, 16))
    v = np.floor(centres[rng.integers(0, 20, 1000)] + rng.normal(0, 2, (1000, 16))).astype(np.int64)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"id": pa.array(np.arange(1000)), "v": pa.array(list(v))})
    block = next(topk._pack(16, topk.choose_pivots(v.astype(float), 8), 1000)([batch])).to_pylist()[0]
    c = topk._Block(block, 16)
    best = [(np.empty(0, np.int64),) * 2] * 1000
    assert topk.search_block(c, c, best, 5) < 1000 * 1000 / 2
    for i in range(0, 1000, 97):
        s = v @ v[i]
        order = [j for j in np.lexsort((np.arange(1000), -s)) if j != i][:5]
        assert best[i][1].tolist() == order


# -- language -----------------------------------------------------------------------

def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op4(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    out = got.collect()
    assert len(out) > 200 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in out if r.lang_pred != "und") / len(out) > 0.95


def test_language_equals_a_plain_naive_bayes(odd, spark):
    train = odd.where("lang IS NOT NULL AND text IS NOT NULL")
    model = language.train(train)
    counts = collections.defaultdict(collections.Counter)
    texts = collections.Counter()
    for r in train.collect():
        texts[r.lang] += 1
        for b in language.grams([r.text])[2]:
            counts[r.lang].update(b[b < language.BUCKETS].tolist())
    assert model.languages == sorted(texts)
    for i, lang in enumerate(model.languages):
        n = sum(counts[lang].values())
        for b in list(counts[lang])[:50]:
            want = np.log((counts[lang][b] + 0.1) / (n + 0.1 * language.BUCKETS))
            assert abs(model.logp[b, i] - want) < 1e-5
    texts = [r.text or "" for r in odd.collect()]
    assert [a for t in texts for a in model.predict([t])[0]] == list(model.predict(texts)[0])


def test_language_scores_do_not_depend_on_neighbours(odd):
    model = language.train(odd)
    texts = ["der cat", "x", "été", "", "the", "  lead", "der cat", "9 a", "word1 and2 " * 50]
    rnd = random.Random(1)
    alone = {t: tuple(x[0] for x in model.predict([t])) for t in texts}
    for _ in range(20):
        rnd.shuffle(texts)
        names, score = model.predict(texts)
        assert [(n, s) for n, s in zip(names, score)] == [alone[t] for t in texts]


def test_language_broadcasts_no_class_of_the_package(odd, monkeypatch):
    """Executors need not have the package: what is broadcast is plain data."""
    import pickle
    import pickletools
    sent = []
    sc = odd.sparkSession.sparkContext
    real = type(sc).broadcast
    monkeypatch.setattr(type(sc), "broadcast", lambda self, v: sent.append(v) or real(self, v))
    language.predict(odd, language.train(odd)).collect()
    names = [str(x) for v in sent for _, x, _ in pickletools.genops(pickle.dumps(v)) if isinstance(x, str)]
    assert sent and not any("quire" in n for n in names)


def test_language_odd_rows(odd, empty):
    got = language.predict(odd.withColumn("score", odd.doc_id), language.train(odd)).collect()
    assert [(r.lang_pred, r.score) for r in got if not (r.text or "").strip()] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got)
    none = language.train(empty)
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
    assert language.predict(empty, none).count() == 0
    with pytest.raises(ValueError):
        language.train(odd, max_languages=1)


# -- sharding -----------------------------------------------------------------------

def test_hilbert_curve_visits_neighbours(spark):
    cells = spark.range(1 << (sharding.DIMS * sharding.BITS))
    cells = cells.select("id", sharding.hilbert_index(cells["id"]).alias("h"))
    order = [r.id for r in cells.orderBy("h").collect()]
    assert len({r.h for r in cells.collect()}) == len(order) == 65536
    at = np.array([[(c >> (4 * d)) & 15 for d in range(4)] for c in order])
    assert (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()


def check_shards(out, docs, n):
    got = collections.Counter(r.shard for r in out)
    counts = [got.get(s, 0) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)
    for s in range(n):
        own = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(counts[s]))
        assert [r.curve for r in own] == sorted(r.curve for r in own)
    ends = [(min(r.curve for r in out if r.shard == s), max(r.curve for r in out if r.shard == s))
            for s in range(n) if counts[s]]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    want = sorted(((d["doc_id"], len((d["text"] or "").encode()) + 8, brute.crc(d["text"])) for d in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == want


def test_shards_are_even_runs_of_the_curve(spark, docs):
    check_shards(sharding.op7(spark, "/root/testdata/sf0.001").collect(), docs, 24)


def test_shards_odd_rows(odd, odd_docs, empty):
    check_shards(sharding.shard_documents(odd, 5).collect(), odd_docs, 5)
    check_shards(sharding.shard_documents(odd).collect(), odd_docs, 24)
    assert sharding.shard_documents(empty).count() == 0


def test_written_shards_are_pruned_in_every_dimension(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    manifest = sharding.write_shards(docs, str(tmp_path / "s"), 24, rows_per_file=20).collect()
    assert sum(r.rows for r in manifest) == docs.count() and len(manifest) == 24
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows(back.drop("shard"), *docs.columns) == rows(docs, *docs.columns)
    for r in back.groupBy("shard").agg({"doc_id": "min", "lang": "max"}).collect():
        own = next(m for m in manifest if m.shard == r.shard)
        assert (own.min_doc_id, own.max_lang) == (r["min(doc_id)"], r["max(lang)"])
    hit = {
        "lang": sum(m.min_lang <= "fr" <= m.max_lang for m in manifest),
        "source": sum(m.min_source <= "src5" <= m.max_source for m in manifest),
        "size": sum(m.max_size >= 16_000 for m in manifest),
        "doc_id": sum(m.min_doc_id <= 100 for m in manifest),
    }
    assert all(n < 20 for n in hit.values()) and sum(hit.values()) < 60, hit


@pytest.mark.parametrize("case", ["plain", "nulls", "prefix", "outlier"])
def test_shards_are_pruned_whatever_the_values(spark, case):
    """Nulls, names that share long prefixes and one outlying id cost no dimension its pruning."""
    prefix = "https://a-common-prefix.example/" if case == "prefix" else ""
    rnd = random.Random(2)
    rows_ = [(i, "w " * rnd.randint(1, 400), f"{prefix}{rnd.choice(['de', 'en', 'es', 'fr'])}", f"{prefix}src{rnd.randrange(20)}")
             for i in range(4000)]
    if case == "nulls":
        rows_ += [(None, None, None, None)] * 40
    if case == "outlier":
        rows_.append((10**17, "w", "de", "src0"))
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string")
    placed = sharding.shard_documents(df).join(df.select("doc_id", "lang", "source"), "doc_id").collect()
    shards = collections.defaultdict(list)
    for r in placed:
        shards[r.shard].append(r)
    span = [{c: (min(r[c] for r in own), max(r[c] for r in own)) for c in ("lang", "source", "doc_id", "size")}
            for own in shards.values()]
    # Mean number of shards that a filter on one value (ids: a range of 100) must read, of 24.
    values = {c: sorted({r[c] for r in placed}) for c in ("lang", "source")}
    values["doc_id"], values["size"] = range(0, 4000, 400), range(10, 800, 50)
    read = {c: np.mean([sum(s[c][0] <= v <= s[c][1] for s in span) for v in vs]) for c, vs in values.items()}
    assert read["lang"] < 17 and read["source"] < 14 and read["doc_id"] < 13 and read["size"] < 14, read


def test_cut_points_are_by_rank(spark):
    rows_ = [("a",)] * 700 + [(f"b{i:02}",) for i in range(50)] + [(None,)] * 30 + [("z",)] * 250
    df = spark.createDataFrame(rows_, "d0 string").selectExpr("d0", "d0 AS d1", "1L AS d2", "CAST(NULL AS long) AS d3")
    names, _, ones, none = sharding.cut_points(df)
    assert set(ones) == {1} and none == [] and len(names) == len(ones) == sharding.VALUES - 1
    from pyspark.sql import functions as F
    bins = {r[0]: r[1] for r in df.select("d0", sharding._bin(F.col("d0"), names)).distinct().collect()}
    assert bins[None] == 0 and bins["a"] == 6 and bins["z"] == 14 and 11 <= bins["b00"] <= bins["b49"] <= 12


def test_written_shards_of_odd_rows(odd, empty, spark, tmp_path):
    assert sum(r.rows for r in sharding.write_shards(odd, str(tmp_path / "a"), 3, 2).collect()) == odd.count()
    assert spark.read.parquet(str(tmp_path / "a")).count() == odd.count()
    assert sharding.write_shards(empty, str(tmp_path / "b")).count() == 0


# -- WARC -----------------------------------------------------------------------------

def test_warc_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: tuple(r)[1:] for r in warc.op8(spark, "/root/testdata/sf0.01").collect()}
    first = {}
    for r in sorted(pages):
        first.setdefault(r.html, r.page_id)
    for r in pages:
        raw = (r.html or "").encode()
        ref = first[r.html] if len(raw) >= 100 and first[r.html] != r.page_id else None
        assert got[r.page_id] == (len(raw), brute.sha(raw), "revisit" if ref is not None else "response", ref)


def test_warc_odd_rows(spark, monkeypatch):
    big = "x" * 120
    rows_ = [(5, "http://a/ b\r\nX: y", big), (3, None, big), (3, None, big), (9, "u", "x" * 99), (10, "u", "x" * 99),
             (11, "u", None), (12, "u", ""), (None, "u", big), (13, "u", "é\r\n\r\nWARC/1.1\r\n" * 40), (-4, "ü", "é" * 50)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS id")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(5, 120, "revisit", 3), (3, 120, "response", None), (3, 120, "response", None), (9, 99, "response", None),
                          (10, 99, "response", None), (11, 0, "response", None), (12, 0, "response", None),
                          (None, 120, "revisit", 3), (13, len(rows_[8][2].encode()), "response", None), (-4, 100, "response", None)], key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(wide, monkeypatch):
    if wide:  # the writer then uses ZIP64 records and fields throughout
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.comment = b"a note with PK\5\6 in it"
        for i in range(5):
            with z.open(zipfile.ZipInfo(f"m{i}"), "w", force_zip64=True) as m:
                m.write(b"%d" % i * 50)
        z.writestr("packed", "z" * 99, zipfile.ZIP_DEFLATED)
    found = warc.directory(f, len(f.getvalue()))
    assert set(found) == {f"m{i}" for i in range(5)}
    assert all(warc.read_at(f, *found[f"m{i}"]) == b"%d" % i * 50 for i in range(5))
    assert (b"PK\6\6" in f.getvalue()) == wide
    for broken in (b"", f.getvalue()[:-30]):
        with pytest.raises((ValueError, struct.error)):
            warc.directory(io.BytesIO(broken), len(broken))
