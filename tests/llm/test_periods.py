"""Periodic run detection against its brute-force version."""

import random

import numpy as np
import pytest

from quire.llm import periods
from tests.llm import brute


def texts(seed, n=120):
    """Words of a small alphabet with periodic stretches, nested ones
    included, cut and broken at random places."""
    rnd = random.Random(seed)
    letters = ["ab", "abc", "abcdefghij", [f"w{i}" for i in range(300)]][seed % 4]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 40]))]
            q = rnd.choice([1, 2, 3, 5, 8, 9, 10, 12, 13, 14, 20, 21, 31, 32, 47, 48, 60, 100])
            root = [rnd.choice(letters) for _ in range(q)]
            if rnd.random() < .3:       # a root that nearly has a shorter period
                root = (root[:max(1, q // 3)] * 4)[:q]
            length = int(q * rnd.choice([1, 2, 2.9, 3, 3.1, 4, 7.5])) + rnd.randint(0, 3)
            part = (root * (length // q + 1))[:length]
            if rnd.random() < .3 and part:
                part[rnd.randrange(len(part))] = "break"
            w += part
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    batch = texts(seed)
    assert periods._analyse(batch) == [brute.periodic_runs(w) for w in batch]


def test_every_period_at_its_least_length():
    """Three copies and not a word more, for each period of several scales."""
    rnd = random.Random(3)
    batch = []
    for q in range(8, 230):
        root = [f"r{rnd.randrange(10**9)}" for _ in range(q)]
        batch += [["x"] + root * 3 + ["y"], root * 3, (root * 3)[:-1]]
    for i, found in enumerate(periods._analyse(batch)):
        q, kind = 8 + i // 3, i % 3
        assert found == ([(1, 3 * q, q)] if kind == 0 else [(0, 3 * q, q)] if kind == 1 else []), (q, kind)


def test_scales_cover_all_periods():
    for longest in (8, 9, 100, 5000):
        bounds = list(periods.scales(longest))
        assert [q for a, b in bounds for q in range(a, b)][:max(0, longest - 8)] == list(range(9, longest + 1))
        for a, b in bounds:   # windows of at least one gram, and q + W + L - 1 <= 3q
            assert 2 * a - (b - 1) + 1 >= 1


def test_minimizers_by_definition():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 5, 8, 13):
        x = rng.integers(0, 9, 60).astype(np.uint64)
        want = {i + j for i in range(len(x) - width + 1) for j in range(width) if x[i + j] == x[i:i + width].min()}
        assert set(periods.minimizers(x, width).tolist()) == want
    assert len(periods.minimizers(x[:3], 5)) == 0


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_op11_equals_brute_force(spark, docs):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in periods.op11(spark, "/root/testdata/sf0.001").collect())
    want = sorted(brute.periods(docs))
    assert got == want and sum(1 for r in want if r[1]) > 5


def test_odd_rows(odd, odd_docs, empty):
    got = periods.periodic_runs(odd)
    rows = sorted(((r.doc_id, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in got.collect()), key=str)
    want = []
    for d in odd_docs:
        w = brute.words(d["text"])
        found = brute.periodic_runs(w) if len(w) < 1000 else []
        want.append((d["doc_id"], found, " ".join(periods.collapse(w, found))))
    assert rows == sorted(want, key=str)
    assert "text" not in got.columns and "shard" in got.columns
    assert periods.periodic_runs(empty).count() == 0


def test_batches_do_not_matter(spark, monkeypatch):
    """Texts alone, together, and over the bound of a batch give the same."""
    rows = [(i, " ".join(w)) for i, w in enumerate(texts(2, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    together = sorted(map(str, periods.periodic_runs(df.coalesce(1)).collect()))
    monkeypatch.setattr(periods, "CHUNK", 50)
    assert sorted(map(str, periods.periodic_runs(df.repartition(7)).collect())) == together


def test_one_long_text(spark):
    """100,000 words: a long period, a short one within it and words of one kind."""
    rnd = random.Random(5)
    root = [f"r{rnd.randrange(10**9)}" for _ in range(9_000)]
    root[100:160] = ["u", "v"] * 30
    w = ["a"] * 30 + root * 5 + [f"t{i}" for i in range(50_000)] + ["z"] * 5_000
    found = periods._analyse([w])[0]
    assert [r for r in found if r[2] > 2] == [(30, 45_000, 9_000)]
    assert sorted(r[1] for r in found if r[2] <= 2) == [30] + [60] * 5 + [5_000]
