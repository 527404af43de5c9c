"""Stateful exact dedup against its brute-force version."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup
from tests.llm import brute


def decided(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in df.collect()), key=str)


def weak(texts: pd.Series) -> pd.Series:
    """A digest under which most texts collide."""
    return pd.Series([bytes([len(t) % 2 if t is not None else 0]) for t in texts])


def one_kept_per_group(rows):
    kept = {}
    for r in rows:
        kept.setdefault((r.keep_id, r.group_size, bytes(r.digest)), []).append(r)
    for group in kept.values():
        assert sum(r.kept for r in group) * group[0].group_size == len(group)
        assert all(r.doc_id == r.keep_id for r in group if r.kept)


def test_odd_rows(spark, odd, odd_docs, empty, tmp_path):
    path = str(tmp_path / "odd")
    odd.repartition(4).write.parquet(path)
    got = exact_dedup.deduplicate(spark, path)
    assert decided(got) == sorted(brute.exact_dedup(odd_docs), key=str)
    one_kept_per_group(got.collect())
    kept = exact_dedup.drop_copies(spark, path)
    assert kept.columns == odd.columns and kept.count() == len({brute.sha((d["text"] or "").translate(brute.LOW)) for d in odd_docs})
    none = str(tmp_path / "empty")
    empty.write.parquet(none)
    assert exact_dedup.deduplicate(spark, none).count() == 0


def test_documents(spark, docs):
    path = "/root/testdata/sf0.001/documents.parquet"   # a single file
    assert decided(exact_dedup.deduplicate(spark, path)) == sorted(brute.exact_dedup(docs), key=str)


def test_later_files_go_on_from_the_state(spark, docs, tmp_path):
    """New files change old groups; files seen before are not read into the state again."""
    path, store = str(tmp_path / "table"), str(tmp_path / "store")
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    frame.where("doc_id % 3 > 0").coalesce(1).write.parquet(path)
    first = exact_dedup.deduplicate(spark, path, store)
    assert decided(first) == sorted(brute.exact_dedup([d for d in docs if d["doc_id"] % 3]), key=str)
    frame.where("doc_id % 3 = 0").repartition(3).write.mode("append").parquet(path)
    copies = frame.select((F.col("doc_id") + 10**6).alias("doc_id"), F.upper("text").alias("text")).where("doc_id % 5 = 0")
    copies.coalesce(1).write.mode("append").parquet(path)
    all_docs = docs + [{"doc_id": r.doc_id, "text": r.text} for r in copies.collect()]
    again = exact_dedup.deduplicate(spark, path, store, max_files=2)   # several micro-batches
    assert decided(again) == sorted(brute.exact_dedup(all_docs), key=str)
    one_kept_per_group(again.collect())
    assert decided(exact_dedup.deduplicate(spark, path, store)) == decided(again)   # nothing new


def test_equal_digests_are_not_enough(spark, odd, odd_docs, tmp_path):
    """Full bytes are compared on hits: a weak digest changes no group."""
    path = str(tmp_path / "odd")
    odd.repartition(3).write.parquet(path)
    got = exact_dedup.deduplicate(spark, path, digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted(
        (r[:3] for r in brute.exact_dedup(odd_docs)), key=str)
    assert sum(r.kept for r in got) == len({(d["text"] or "").translate(brute.LOW) for d in odd_docs})


def test_state_is_on_disk_without_expiry(spark, odd, tmp_path):
    """The stream's state store is RocksDB's; the session's own setting comes back."""
    path, store = str(tmp_path / "odd"), str(tmp_path / "store")
    odd.write.parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    exact_dedup.ingest(spark, path, store)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    logs = list((tmp_path / "store" / "stream" / "state").rglob("*.changelog")) + list(
        (tmp_path / "store" / "stream" / "state").rglob("*.zip"))
    assert logs
    offsets = (tmp_path / "store" / "stream" / "offsets" / "0").read_text()
    assert "RocksDBStateStoreProvider" in offsets and '"batchWatermarkMs":0' in offsets


@pytest.mark.parametrize("hot", [2000])
def test_a_third_of_the_rows_are_one_text(spark, hot, tmp_path):
    path = str(tmp_path / "hot")
    rows = spark.range(3 * hot).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same TEXT"))
                                       .otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows.repartition(5).write.parquet(path)
    got = exact_dedup.deduplicate(spark, path)
    big = got.where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(big) == (hot, 3 * hot - 3, 3 * hot - 3, 1)
