"""Operators of the pipeline against their brute-force versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from quire.llm import bpe, line_dedup, mixing, quality, simhash
from tests.llm import brute


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# -- line dedup -----------------------------------------------------------------

@pytest.mark.parametrize("shard,probes", [(50, 100), (100_000, 200_000)])
def test_line_dedup_equals_brute_force(docs_table, docs, shard, probes):
    got = (line_dedup.dedup_lines(docs_table, keys_per_shard=shard, probes_per_task=probes)
           .selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)"))
    assert rows(got, *got.columns) == sorted(brute.line_dedup(docs), key=str)


def test_probes_of_a_line_that_most_documents_hold_are_dealt_out(spark):
    docs = [{"doc_id": i, "text": f"shared by everyone\nown line number {i}\n Shared By Everyone "} for i in range(2000)]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    got = line_dedup.dedup_lines(df, probes_per_task=50).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)")
    assert rows(got, *got.columns) == sorted(brute.line_dedup(docs), key=str)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        lost = line_dedup.repeated_lines(df, probes_per_task=50)
        sizes = [r["count"] for r in lost.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(conf)
    assert sum(sizes) == 1999 and max(sizes) < 700


def test_line_dedup_odd_rows(odd, odd_docs, empty):
    got = line_dedup.dedup_lines(odd).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)")
    assert rows(got, *got.columns) == sorted(brute.line_dedup(odd_docs), key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash_is_minimal_and_rejects_others(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(-2**63, 2**63, (2, n))
    if n > 2:
        h1[1] = h1[0]  # equal first halves end in the tail
    shard = line_dedup.Shard(line_dedup.build_shard(h1, h2, np.arange(n) + 2, np.arange(n)))
    found, counts, owners = shard.probe(h1, h2)
    assert found.all() and (counts == np.arange(n) + 2).all() and (owners == np.arange(n)).all()
    assert len(shard.prints) == n
    assert not shard.probe(*rng.integers(-2**63, 2**63, (2, 1000)))[0].any()


# -- SimHash --------------------------------------------------------------------

def test_simhash_equals_brute_force(docs_table, docs):
    got = simhash.near_duplicates(docs_table).selectExpr("doc", "lower(lpad(hex(fp), 16, '0'))", "component")
    assert rows(got, *got.columns) == sorted(brute.components(docs), key=str)


def test_simhash_odd_rows(odd, odd_docs, empty):
    null = 2**63 - 1
    got = simhash.near_duplicates(odd).selectExpr(
        f"nullif(doc, {null})", "lower(lpad(hex(fp), 16, '0'))", f"nullif(component, {null})")
    assert rows(got, *got.columns) == sorted(brute.components(odd_docs), key=str)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    first = {c for _, _, c in brute.components(odd_docs)}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == first and kept.count() == len(first)


def test_rows_without_or_with_equal_ids_stay_unless_their_texts_are_near(spark):
    random.seed(5)
    text = lambda: " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(40))
    nulls, repeated, other = [text() for _ in range(5)], [text() for _ in range(4)], text()
    docs = [(None, t, i) for i, t in enumerate(nulls)] + [(7, t, 0) for t in repeated] + [(8, other, 0)]
    docs += [(None, other, 1), (None, nulls[0], 9), (7, nulls[1], 0), (9, nulls[1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, component int")
    got = simhash.drop_near_duplicates(df)
    want = [(None, t) for t in nulls if t != nulls[1]] + [(7, t) for t in [*repeated, nulls[1]]] + [(8, other)]
    assert rows(got, "doc_id", "text") == sorted(want, key=str) and got.columns == df.columns


def test_anchors_meet_for_every_half_within_one_bit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, 500, dtype=np.uint32)

    def of(v):
        at, a = simhash.anchors(v)
        return [set(a[at == i].tolist()) for i in range(len(v))]
    base = of(x)
    assert all(len(b) in (2, 17) for b in base)
    assert all(min((int(c) ^ int(v)).bit_count() for c in b) <= 1 for b, v in zip(base, x))
    for bit in range(32):
        assert all(a & b for a, b in zip(base, of(x ^ np.uint32(1 << bit))))


def test_chain_of_links_is_one_group(spark):
    from quire.llm.components import components
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# -- quality rules ----------------------------------------------------------------

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_rules_equal_brute_force(docs_table, docs):
    got = {r[0]: tuple(r)[1:] for r in quality.judge(docs_table).select("doc_id", *BASE).collect()}
    assert got == {d["doc_id"]: brute.base_rules(d["text"]) for d in docs}


def test_base_rules_odd_rows(odd, odd_docs, empty):
    got = rows(quality.judge(odd), "doc_id", *BASE)
    assert got == sorted(((d["doc_id"], *brute.base_rules(d["text"])) for d in odd_docs), key=str)
    assert quality.judge(empty).count() == 0
    assert quality.clean(odd).columns == odd.columns


def test_line_frequency_rejects_depleted_documents_and_cuts_lines(spark):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    body = lambda n: " ".join(word() for _ in range(n))
    footer = "all rights reserved by the owner of this very site and nobody else ever"
    docs = [(i, f"{body(30)}\n{footer}", "h") for i in range(60)]
    docs += [(100 + i, f"{body(2)}\n{footer.upper()}  ", "h") for i in range(5)]   # depleted
    copy = "\n".join(body(20) for _ in range(6))
    docs += [(200 + i, copy, "h") for i in range(60)]                              # copies are one document
    docs += [(300 + i, "\n".join(random.sample(copy.upper().split("\n"), 6)), "h") for i in range(60)]   # one set of lines
    docs += [(400 + i, f"{body(30)}\n{footer}", "other") for i in range(10)]       # below the other host's limit
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert {i for i, r in got.items() if not r.kept} == {100, 101, 102, 103, 104}
    clean = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert not any(footer in t for i, t in clean.items() if i < 400)
    assert all(footer in clean[i] for i in range(400, 410)) and clean[200] == copy


@pytest.mark.parametrize("n_lines", [12, 20])
def test_pages_of_a_template_with_many_lines_are_depleted(spark, n_lines):
    random.seed(n_lines)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    body = lambda n: " ".join(word() for _ in range(n))
    template = [body(12) for _ in range(n_lines)]
    docs = [(i, "\n".join([*template, body(20)]), "h") for i in range(300)]
    docs += [(1000 + i, "\n".join(body(20) for _ in range(5)), "h") for i in range(300)]
    docs += [(2000 + i, "\n".join([*template, body(20)]), "few") for i in range(20)]   # not above MIN_DOCS
    copy = [body(20) for _ in range(6)]
    for i in range(60):                                                               # six sets of lines
        at = i % 6
        docs.append((3000 + i, "\n".join([*copy[:at], f"{copy[at]} more", *copy[at + 1:]]), "near"))
    # 8 % of a host's rows, but 20 % of its documents once copies count as one
    docs += [(4000 + i, f"{template[0]}\n{body(60)}", "copies") for i in range(40)]
    bodies = [body(30) for _ in range(160)]
    docs += [(5000 + i, bodies[i % 160], "copies") for i in range(460)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert not any(i in clean for i in range(300))
    assert all(clean[i] == t for i, t, _ in docs if 1000 <= i < 4000 or i >= 5000)
    assert not any(template[0] in clean[4000 + i] for i in range(40))


OWN_LINES = ["more info about item {}", "posted on day {} by the web team", "read article number {}", "unique{0} words{0} here{0}",
             "{}", "page {} of the catalogue, as of today, with all prices and all names of the items that are on it"]


@pytest.mark.parametrize("n", [25, 100])
@pytest.mark.parametrize("own", OWN_LINES)
def test_template_pages_are_as_many_documents_as_they_differ(spark, own, n):
    random.seed(7)
    body = lambda n: " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(n))
    template = [body(10) for _ in range(12)]
    docs = [{"doc_id": i, "text": "\n".join([*template, own.format(i)]), "source": "h"} for i in range(n)]
    docs += [{"doc_id": 1000 + i, "text": body(40), "source": "h"} for i in range(30)]
    docs += [{"doc_id": 2000 + i, "text": docs[0]["text"], "source": "copies"} for i in range(60)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, text string, source string")
    want = brute.quality_verdicts(docs)
    assert [k for k, _ in want] == [False] * n + [True] * 90
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert [got[d["doc_id"]] for d in docs] == [k for k, _ in want]
    clean = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert clean == {d["doc_id"]: t for d, (k, t) in zip(docs, want) if k}


def test_verdicts_equal_brute_force(spark, docs_table, docs, odd, odd_docs):
    """On the given documents with low limits, so that lines are removed, and on odd rows."""
    got = {r.doc_id: r.kept for r in quality.verdicts(quality.number_rows(quality.measured(
        docs_table, docs_table.doc_id, quality._host()), "t"), 1, 0.02, 0.5).collect()}
    want = brute.quality_verdicts(docs, 1, 0.02, 0.5)
    assert got == {d["doc_id"]: k for d, (k, _) in zip(docs, want)}
    assert any(t != d["text"] for d, (_, t) in zip(docs, want))
    assert sorted((r.kept for r in quality.judge(odd).collect())) == sorted(k for k, _ in brute.quality_verdicts(odd_docs))


# -- mixing -----------------------------------------------------------------------

def test_mix_meets_targets(docs_table, docs):
    got = mixing.mix_plan(docs_table).collect()
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(brute.words(d["text"]))
    want, source = brute.targets(sizes), {d["doc_id"]: d["source"] for d in docs}
    taken, largest = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
    again = mixing.mix_plan(docs_table.repartition(5))
    assert rows(again, "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=str)


def test_mix_orders_by_odds_and_takes_whole_copies(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a", 1.0 if i % 2 else 5.0) for i in range(2000)],
                                 "doc_id long, text string, source string, doc_weight double")
    slim = mixing.number_rows(docs.withColumn("size", mixing.n_words(docs.text)).withColumn("tie", docs.text), "t")
    plan = mixing.plan_mix(slim, budget=8000.0).collect()
    heavy = [r.copies for r in plan if r.doc_weight == 5]
    light = [r.copies for r in plan if r.doc_weight == 1]
    assert sum(r.copies * 10 for r in plan) == 8000
    assert 0.6 < sum(heavy) / 1000 < 0.73 and 0.07 < sum(light) / 1000 < 0.2  # 2/3 and 2/15 expected
    assert {r.copies for r in mixing.plan_mix(slim.drop("doc_weight"), budget=50_000.0).collect()} == {2, 3}


@pytest.mark.parametrize("seed", range(3))
def test_mix_goes_on_behind_a_document_that_does_not_fit(spark, seed):
    sizes = [300] * 200 + [50_000] + [7] * 20
    docs = spark.createDataFrame([(i, n, "a", str(i)) for i, n in enumerate(sizes)],
                                 "doc_id long, size long, source string, tie string")
    plan = mixing.plan_mix(mixing.number_rows(docs, "t"), budget=40_000.0, seed=seed).collect()
    # The long document fits nowhere; the rest is the order walked one by one.
    need, want = 40_000, set()
    for r in sorted(plan, key=lambda r: (r.rank, r.doc_id)):
        if r.size <= need:
            need -= r.size
            want.add(r.doc_id)
    got = {r.doc_id for r in plan if r.copies}
    assert want <= got and len(got - want) <= 1
    assert abs(sum(r.size * r.copies for r in plan) - 40_000) <= 150


def test_mix_odd_rows(odd, odd_docs, empty):
    got = mixing.mix_plan(odd).collect()
    assert len(got) == len(odd_docs) and all(r.taken <= 3 * r.size for r in got)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_draws_rows_without_or_with_equal_ids_apart(spark):
    """Null ids: long and short documents are taken alike; equal rows too, and reruns agree."""
    rnd = random.Random(1)
    rows_ = [(None, "w " * rnd.choice([5, 20, 80]) + f"t{i}", s) for i in range(1500) for s in ("a", "b")]
    rows_ += [(7, "the same text in every one of these rows", "a")] * 300 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    plan = mixing.mix_plan(df, budget=0.3 * sum(len(brute.words(t)) for _, t, _ in rows_)).collect()
    mean = lambda x: sum(r.size for r in x) / len(x)
    free = [r for r in plan if r.doc_id is None and r.size]
    some, none = [r for r in free if r.taken], [r for r in free if not r.taken]
    assert len(some) > 300 and abs(mean(some) / mean(none) - 1) < 0.25
    same = [r.copies for r in plan if r.doc_id == 7]
    assert 0 < sum(same) < 300 and set(same) == {0, 1}
    again = mixing.mix_plan(df.repartition(7), budget=0.3 * sum(len(brute.words(t)) for _, t, _ in rows_)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, again)) == sorted(map(key, plan))


def test_copies_are_numbered_without_gaps(spark):
    rows_ = [(1, "a", "x")] * 5000 + [(None, None, "x")] * 40 + [(2, "a", "y"), (2, "b", "y")]
    df = spark.createDataFrame(rows_, "doc_id long, source string, tie string").repartition(6)
    got = mixing.numbered_copies(mixing.number_rows(df, "t")).collect()
    assert sorted(r.copy for r in got if r.doc_id == 1) == list(range(1, 5001))
    assert sorted(r.copy for r in got if r.doc_id is None) == list(range(1, 41))
    assert [r.copy for r in got if r.doc_id == 2] == [0, 0]


# -- BPE --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer
    path = bpe.vocabulary_path()
    return bpe.load(path), Tokenizer.from_file(path)


def same(both, text):
    ours, theirs = both
    ids = [i for block in ours.encode(text) for i in block]
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert "".join(ours.decode([ids], pieces=True)) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_query_equals_library(docs_table, docs, both):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_digests(docs_table.select("doc_id", "text")).collect()}
    assert got == brute.bpe(docs, both[1])


def test_bpe_odd_rows(odd, odd_docs, both, empty):
    got = bpe.encode_digests(odd)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == brute.bpe(odd_docs, both[1])
    assert bpe.encode_digests(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aehist'é <|>12ΣİÅ", max_size=40)
       | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b <|endoftext|", "İstanbul ΟΔΟΣ"]))
def test_bpe_any_text(both, text):
    same(both, text)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["ab", "the", "ain", "a", "ha", "!?", "日本e", "straße"]), st.integers(1, 6000), st.randoms())
def test_bpe_streams_long_words(both, letters, n, rnd):
    same(both, "".join(rnd.choice(letters) for _ in range(n)))


def test_bpe_texts_longer_than_a_chunk(both, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    same(both, "some words of prose, é and İ, 123 <|endoftext|> more   spaces\n日本 " * 40)


def test_decoder_state_spans_blocks(both, monkeypatch):
    ours, _ = both
    text = "naïve café 日本 🙂 "
    ids = [i for block in ours.encode(text) for i in block]
    monkeypatch.setattr(bpe, "BLOCK", 1)
    assert "".join(ours.decode([[i] for i in ids])) == "naïve café 日本 🙂 "


def test_columns_round_trip(spark, docs_table):
    texts = docs_table.limit(40).withColumn("ids", bpe.encode_column("text"))
    got = texts.withColumn("back", bpe.decode_column("ids")).collect()
    fold = lambda s: "".join(s.lower().split())
    assert all(fold(r.back) == fold(r.text) for r in got)


@pytest.mark.parametrize("unit", ["some words here ", "some\nlines\nhere\n", "a1,b2;", "wordwithoutend"])
def test_bpe_memory_does_not_grow_with_the_text(both, unit):
    import tracemalloc
    small, large = (unit * (n // len(unit)) for n in (900_000, 2_700_000))

    def peak(text):
        tracemalloc.start()
        bpe.digests(both[0], text)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top
    peak(small)
    # The text's own copies (lower case, bytes) are all that may grow.
    assert peak(large) - peak(small) < 3 * (len(large) - len(small)) + 2_000_000


@pytest.mark.parametrize("unit", ["some\tlines\r\nhere\n", "a1,b2;", "wordwithoutend", "é́\ńx"])
def test_bpe_long_texts_without_spaces_equal_the_library(both, unit):
    text = unit * (700_000 // len(unit))
    want = both[1].encode(text, add_special_tokens=False).ids
    assert [i for ids in both[0].encode(text) for i in ids] == want
