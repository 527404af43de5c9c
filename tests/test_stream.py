"""Two availableNow runs over growing input equal first-write-wins."""
import datetime as dt
import os

from quire.session import fresh_path
from quire.streaming.ingest import run_ingest


def _write(path, name, text):
    path = path.removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_two_runs(spark):
    src, store, ck = fresh_path(spark, "s-src"), fresh_path(spark, "s-store"), fresh_path(spark, "s-ck")
    _write(src, "f1.txt", "PMID- 1\nTI  - one\n\nPMID- 2\nTI  - two\n")
    run_ingest(spark, src, store, ck, dt.datetime(2024, 1, 1))
    _write(src, "f2.txt", "PMID- 2\nTI  - other\n\nPMID- 3\nTI  - three\n")
    out = {r["pmid"]: r["title"] for r in run_ingest(spark, src, store, ck, dt.datetime(2024, 2, 1)).collect()}
    assert out == {"1": "one", "2": "two", "3": "three"}


def test_a_new_checkpoint_keeps_what_is_stored(spark):
    src, store = fresh_path(spark, "s-src"), fresh_path(spark, "s-store")
    _write(src, "f1.txt", "PMID- 1\nTI  - one\n\nPMID- 2\nTI  - two\n")
    run_ingest(spark, src, store, fresh_path(spark, "s-ck"), dt.datetime(2024, 1, 1))
    _write(src, "f2.txt", "PMID- 2\nTI  - other\n\nPMID- 3\nTI  - three\n")
    out = run_ingest(spark, src, store, fresh_path(spark, "s-ck"), dt.datetime(2024, 2, 1))
    assert {r["pmid"]: r["title"] for r in out.collect()} == {"1": "one", "2": "two", "3": "three"}


def test_the_first_record_of_a_batch_wins(spark):
    src, store = fresh_path(spark, "s-src"), fresh_path(spark, "s-store")
    _write(src, "f1.txt", "PMID- 1\nTI  - zzz\n\nPMID- 1\nTI  - aaa\n")
    out = run_ingest(spark, src, store, fresh_path(spark, "s-ck"), dt.datetime(2024, 1, 1))
    assert [r["title"] for r in out.collect()] == ["zzz"]


def test_a_batch_that_was_committed_is_not_inserted_again(spark):
    """A restart after the store's commit, but before the checkpoint's."""
    from quire.operators.manifest import latest
    src, store, ck = fresh_path(spark, "s-src"), fresh_path(spark, "s-store"), fresh_path(spark, "s-ck")
    _write(src, "f1.txt", "PMID- 1\nTI  - one\n\nPMID- 2\nTI  - two\n")
    run_ingest(spark, src, store, ck, dt.datetime(2024, 1, 1))
    before = latest(spark, store)
    local = ck.removeprefix("file:")
    for name in os.listdir(os.path.join(local, "commits")):
        os.remove(os.path.join(local, "commits", name))          # the batch counts as not done
    out = run_ingest(spark, src, store, ck, dt.datetime(2024, 2, 1))
    assert latest(spark, store) == before
    assert sorted((r["pmid"], r["created_at"].year, r["created_at"].month) for r in out.collect()) == [
        ("1", 2024, 1), ("2", 2024, 1)]


def test_records_are_parsed_once(spark):
    """The filter on the PMID brings no parse of its own."""
    from quire.sources.medline import map_medline, parse_records
    from pyspark.sql import functions as F
    blocks = spark.createDataFrame([("PMID- 1\nTI  - one",), ("TI  - none",)], "block string").repartition(2)
    out = map_medline(blocks.select(parse_records(F.col("block")).alias("record"))).select("pmid", "title")
    assert [tuple(r) for r in out.collect()] == [("1", "one")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(lambda") <= 8 and plan.count("split(") == 2, plan


def test_a_batch_is_settled_without_its_texts(spark, monkeypatch):
    """Whether all, some or none of a batch is new: the rows that go on to the
    write are the same, and only a mixed one may shuffle texts."""
    from quire.session import cut_lineage
    from quire.streaming import ingest
    rows = cut_lineage(spark.range(20).selectExpr("id * 3 AS place", "cast(id AS string) AS pmid", "'t' AS title"))
    for wanted in (list(range(20)), [0, 19], [], list(range(1, 20))):
        places = rows.where(rows.pmid.isin([str(i) for i in wanted])) if wanted else rows.where("false")
        out = ingest.rows_at(rows, places)
        assert sorted(int(r.pmid) for r in out.collect()) == wanted
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan, plan
    # The batch holds what the writer needs, no more.
    seen = []
    monkeypatch.setattr(ingest, "stage_insert", lambda s, p, new, run, finish: seen.append(finish(new).columns) or _NoCommit())
    writer = ingest._batch_writer("store", "ck", dt.datetime(2024, 1, 1), lambda text: text)
    monkeypatch.setattr(ingest, "query_id", lambda *a: "q")
    monkeypatch.setattr(ingest, "latest", lambda *a: type("M", (), {"runs": {}}))
    batch = spark.createDataFrame([("1", "b", "x", "f2"), ("1", "a", "y", "f1"), ("2", "c", "z", "f3")],
                                  "pmid string, title string, abstract string, file string")
    writer(batch, 0)
    assert seen and "place" not in seen[0]


class _NoCommit:
    def commit(self):
        pass


def test_line_ends_of_any_kind_are_stripped_as_before(spark):
    from pyspark.sql import functions as F
    from quire.sources.medline import _is_blank, _rstrip
    odd = ["", " ", "a", "a ", " a\t\n", "a  ", "  ", "\u0085", "a \u0085 ", "a\x0b\f", "\r", "a \r", " ", "a  ", "é  ", None]
    df = spark.createDataFrame([(s,) for s in odd], "s string")
    for r in df.select(_rstrip(F.col("s")).alias("a"), F.regexp_replace("s", r"\s+$", "").alias("b"),
                       _is_blank(F.col("s")).alias("c"), (F.regexp_replace("s", r"\s+$", "") == "").alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
