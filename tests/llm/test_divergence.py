"""Source divergence audit against its brute-force version."""

import random

import numpy as np
import pytest

from quire.llm import divergence
from tests.llm import brute

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def corpus(seed):
    """Sources of very unequal size and vocabulary, words of several scripts."""
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("wort", "Été", "слово", "日本", "x") for b in "abcdefghij"]
    out = []
    for i in range(300):
        source = rnd.choice([None, "", "a", "b", "c", "d"]) if i % 3 else "hot"
        some = vocabulary[:rnd.choice([3, 10, 50])]
        text = "".join(rnd.choice(some) + rnd.choice([" ", "\n", "-", "1", "\x7f"]) for _ in range(rnd.choice([0, 1, 9, 60])))
        out.append({"doc_id": i, "text": rnd.choice([text, text.upper(), None]), "lang": rnd.choice(["en", "en", "fr", None]),
                    "source": source})
    out.append({"doc_id": 1, "text": "", "lang": "zz", "source": "only"})
    out += [{"doc_id": None, "text": None, "lang": "yy", "source": s} for s in ("p", "q", "p")]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed)
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"]) for d in docs],
                               "doc_id long, text string, lang string, source string").repartition(4)
    if seed == 1:    # tasks that flush early, texts in pieces
        monkeypatch.setattr(divergence, "HELD", 5)
        monkeypatch.setattr(divergence, "CHUNK", 7)
    assert rows(divergence.audit(df, 12, 9)) == sorted(brute.divergence(docs, 12, 9))


def test_blocks_do_not_matter(spark):
    """Many blocks of few postings give the sums of one block."""
    docs = corpus(7)
    df = spark.createDataFrame([(d["text"], d["lang"], d["source"]) for d in docs], "text string, lang string, source string")
    postings, sources = divergence.shares(divergence.term_counts(df), 5)
    want = sorted(map(tuple, divergence.divergences(postings, sources, 10**6).collect()))
    assert sorted(map(tuple, divergence.divergences(postings, sources, 1).collect())) == want and want


def test_accumulated_rows_by_definition():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 9, 5)
    row, term = np.nonzero(rng.random((5, 30)) < .4)
    p = rng.integers(1, 40, len(row))
    dense = np.repeat(base[:, None], 30, 1)
    dense[row, term] = p
    held = np.bincount(row, minlength=5)
    total = np.zeros((5, 5), np.int64)
    for g, sums in divergence.accumulate(5, base, row, term, p):
        total[g] += sums
    for g in range(5):
        for h in range(5):
            if g != h:
                baseline = (30 - held[g] - held[h]) * abs(base[g] - base[h])
                assert total[g, h] + total[h, g] + baseline == np.abs(dense[g] - dense[h]).sum()


def test_documents(docs_table, docs):
    assert rows(divergence.audit(docs_table)) == sorted(brute.divergence(docs))


def test_odd_rows(odd, odd_docs, empty):
    got = divergence.audit(odd, 2)
    assert rows(got) == sorted(brute.divergence(odd_docs, 2))
    assert divergence.audit(empty).count() == 0


def test_large_counts_stay_exact(spark):
    """Counts whose products pass 64 bits."""
    df = spark.createDataFrame([(10**11, 3 * 10**11, 7), (0, 0, 0), (1, 2, 3)], "n long, t long, v long")
    from pyspark.sql import functions as F
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("t"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (10**11 + 5) // (3 * 10**11 + 35), None, 1 + 10**9 * 6 // 17]
