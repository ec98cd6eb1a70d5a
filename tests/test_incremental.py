import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline.operators import crawls
from hearthline.plans import site_queries
from hearthline.sources import views
from hearthline.streaming.incremental import Crawl

SF = "/root/testdata/sf0.001"
FIRST, LATER = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20)


def visits(spark, at, where="page_id between 1 and 20"):
    return views.site_pages(spark, SF).where(where).withColumn("visited_at", F.lit(at))


def state(crawl):
    return sorted([tuple(r) for r in crawl.urls.read().collect()], key=str), sorted([tuple(r) for r in crawl.listings.read().collect()], key=str)


def test_batches_decide_by_what_is_known(spark, tmp_path):
    crawl = Crawl(spark, f"file://{tmp_path}/c", buckets=2)
    crawl.batch(visits(spark, FIRST, "page_id between 1 and 14"), 0)
    crawl.batch(visits(spark, FIRST + dt.timedelta(hours=3)), 1)
    at = {r.page_id: r.processed_at for r in crawl.urls.read().collect()}
    assert len(at) == 20 and all((at[i] == FIRST) == (i <= 14) for i in at)
    n = crawl.listings.read().count()
    crawl.batch(visits(spark, LATER), 2)
    found = crawl.urls.read().collect()
    assert {r.processed_at for r in found} == {LATER} and {r.change_detected for r in found} == {False}
    assert crawl.listings.read().count() == n > 0


def test_a_batch_cut_between_the_stores_and_run_again(spark, tmp_path, monkeypatch):
    crawl = Crawl(spark, f"file://{tmp_path}/c", buckets=2)
    with monkeypatch.context() as m:
        m.setattr(crawl.urls, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("cut")))
        with pytest.raises(RuntimeError):
            crawl.batch(visits(spark, FIRST), 0)
    saved = state(crawl)[1]
    assert state(crawl)[0] == [] and saved
    crawl.batch(visits(spark, FIRST), 0)
    whole = state(crawl)
    assert whole[1] == saved and len(whole[0]) == 20
    crawl.batch(visits(spark, LATER), 0)
    assert state(crawl) == whole


def test_repeated_visits_and_an_empty_batch(spark, tmp_path):
    crawl = Crawl(spark, f"file://{tmp_path}/c", buckets=2)
    crawl.batch(visits(spark, FIRST, "page_id < 0"), 0)
    assert state(crawl) == ([], [])
    crawl.batch(visits(spark, FIRST, "page_id between 1 and 3").unionByName(visits(spark, LATER, "page_id between 1 and 3")), 1)
    assert [r.processed_at for r in crawl.urls.read().collect()] == [LATER] * 3


def test_pages_are_never_sent_to_every_task(spark, tmp_path):
    """Made of a few packed bytes a row, tables with a row for each page look small enough for it at any size."""
    fetched = site_queries._fetched(spark, SF)
    assert "Broadcast" not in fetched._jdf.queryExecution().executedPlan().toString()
    parts = {r.p_partkey: r.p_size for r in views.read(spark, SF, "part").collect()}
    for r in fetched.where("html LIKE '%localização%'").collect():
        assert (f"Parte {r.round}. Ótima" in r.html) == (parts[r.page_id] > 25)
    log = spark.createDataFrame([], "url string, status string, processed_at timestamp, change_detected boolean")
    decided, _ = crawls.incremental(views.site_pages(spark, SF).limit(5), log, F.lit(LATER))
    assert "Broadcast" not in decided._jdf.queryExecution().executedPlan().toString()
