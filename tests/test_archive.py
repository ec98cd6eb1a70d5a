import io
import os

import pytest

from hearthline.sources import archive

PAGES = [(1, "https://a.com/x", "<p>é</p>"), (2, "https://A.com/y", None), (3, None, "no address"), (None, "https://b.com.br/", ""), (5, "https://c.com", "x" * 300_000), (5, "https://c.com", "x" * 300_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_round_trip_of_nulls_repeats_and_long_pages(spark, tmp_path):
    path = f"{tmp_path}/archive"
    archive.write(pages(spark), path)
    got = archive.read(spark, path)
    assert got.columns == ["page_id", "host", "url", "html"]
    assert rows(got.select("page_id", "url", "html")) == sorted(PAGES, key=str)
    assert {r.host for r in got.collect()} == {"a.com", "b.com.br", "c.com", None} or {r.host for r in got.collect()} == {"a.com", "b.com.br", "c.com", ""}
    assert rows(archive.read(spark, f"file://{path}", ("url",))) == sorted([(u,) for _, u, _ in PAGES], key=str)


def test_appends_and_unfinished_writes(spark, tmp_path):
    path = f"{tmp_path}/archive"
    archive.write(pages(spark, PAGES[:2]), path)
    with open(f"{path}/data-lost.gz", "wb") as f:
        f.write(archive.member(9, "lost.com", "https://lost.com", "lost"))
    archive.write(pages(spark, PAGES[2:3]), path)
    assert rows(archive.read(spark, path, ("page_id",))) == [(1,), (2,), (3,)]


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    path = f"{tmp_path}/archive"
    archive.write(pages(spark, PAGES[:2]), path)
    broken = pages(spark, PAGES[2:]).selectExpr("page_id", "url", "CASE WHEN page_id = 5 THEN raise_error('no') ELSE html END AS html")
    with pytest.raises(Exception, match="no"):
        archive.write(broken, path)
    assert rows(archive.read(spark, path, ("page_id",))) == [(1,), (2,)]


def test_a_large_host_is_read_by_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/archive"
    many = [(i, f"https://hot.com/{i}", os.urandom(500).hex()) for i in range(400)] + [(1000 + i, f"https://cold{i}.com/", "x") for i in range(40)]
    archive.write(pages(spark, many), path, split_bytes=20_000)
    got = archive.read(spark, path)
    assert got.rdd.getNumPartitions() > 8
    assert rows(got.select("page_id", "url", "html")) == sorted(many, key=str)
    reader = archive._Reader({"path": path, "host": "hot.com"}, got.schema)
    assert sum(s.first <= "hot.com" <= s.last for s in reader.partitions()) >= 8
    cold = got.where("host = 'cold7.com'")
    assert rows(cold.select("page_id")) == [(1007,)]
    assert cold.rdd.getNumPartitions() < got.rdd.getNumPartitions()
    assert rows(got.where("host in ('cold3.com', 'cold9.com') and page_id > 1003").select("page_id")) == [(1009,)]


def test_empty(spark, tmp_path):
    path = f"{tmp_path}/archive"
    archive.write(pages(spark).limit(0), path)
    assert archive.read(spark, path).collect() == []
    with pytest.raises(Exception, match="(?i)archive has no"):
        spark.read.format(archive.NAME).schema("other string").load(path).collect()


def test_members_over_read_steps(monkeypatch):
    monkeypatch.setattr(archive, "READ_BYTES", 7)
    packed = [archive.member(i, "h", "u", "text " * i) for i in range(50)]
    file = io.BytesIO(b"x" * 10 + b"".join(packed))
    found = list(archive.members(file, 10, sum(map(len, packed))))
    assert [w.split(b"\r\n\r\n", 1)[1].decode() for w in found] == ["text " * i for i in range(50)]
    with pytest.raises(EOFError):
        list(archive.members(file, 10, sum(map(len, packed)) - 3))
