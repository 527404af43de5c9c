"""The MEDLINE sample of FIXTURES §4 and a round trip."""
import os

import pytest
from pyspark.sql import functions as F

from quire.sources.medline import map_medline, read_medline, write_medline

SAMPLE = """PMID- 1
TI  - A long
      title
AB  - abs - x
DP  - 2020 Jan 15
AU  - Li X
AU  - Bo Y
TA  - J Med
MH  - Lung
MH  - Quer
      cetin

TI  - no pmid

PMID- 3
TI  - t3
"""


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_sample(spark, tmp_path, newline):
    d = str(tmp_path)
    with open(os.path.join(d, "a.txt"), "w", newline=newline) as f:
        f.write(SAMPLE)
    rows = {r["pmid"]: r for r in map_medline(read_medline(spark, d)).collect()}
    assert sorted(rows) == ["1", "3"]
    a = rows["1"]
    assert a["title"] == "A long title" and a["abstract"] == "abs - x" and a["journal"] == "J Med"
    assert a["authors"] == ["Li X", "Bo Y"] and a["keywords"] == ["Lung", "Quer cetin"]
    assert str(a["publication_date_parsed"]) == "2020-01-01 00:00:00"
    b = rows["3"]
    assert b["title"] == "t3" and b["abstract"] == "" and b["authors"] == [] and b["keywords"] == []


def test_round_trip(spark, ctx001, tmp_path):
    d = str(tmp_path / "m")
    write_medline(ctx001.arts, d)
    back = map_medline(read_medline(spark, d)).select(
        "pmid", "title", "abstract", "journal", "keywords", "dp")
    want = ctx001.arts.select("pmid", "title", F.regexp_replace("abstract", "\n", " ").alias("abstract"),
                              "journal", "keywords", "dp")
    assert back.count() == want.count()
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def _many(n, newline):
    return newline.join(f"PMID- {i}{newline}TI  - title {i}{newline}      more{newline}" for i in range(n)).encode()


def test_a_crlf_file_is_read_by_several_tasks(spark, tmp_path):
    path, n = str(tmp_path / "big.txt"), 4000
    with open(path, "wb") as f:
        f.write(_many(n, "\r\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(path) // 6))
    try:
        arts = map_medline(read_medline(spark, path))
        per_task = [r["count"] for r in arts.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) >= 6 and max(per_task) < n / 3 and sum(per_task) == n
        got = arts.select("pmid", "title").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted((str(i), f"title {i} more") for i in range(n))


def test_files_of_both_line_ends_and_mixed_ones(spark, tmp_path):
    files = {"lf file.txt": _many(3, "\n"), "crlf.txt": _many(3, "\r\n").replace(b"title", b"other"),
             "mixed.txt": _many(2, "\r\n") + b"\r\n" + _many(2, "\n"), "empty.txt": b"", "blank.txt": b"\r\n\r\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    arts = map_medline(read_medline(spark, str(tmp_path)))
    got = sorted((r["pmid"], r["title"]) for r in arts.collect())
    assert got == sorted([(str(i), f"{t} {i} more") for t in ("title", "other") for i in range(3)]
                         + [(str(i), f"title {i} more") for i in (0, 1, 0, 1)])
