from hearthline.streaming import cache
from hearthline.streaming.run import drained

S = 1_000_000


def run(spark, folder, batches, ttl, known=None):
    """Outcomes in the order of the requests, a batch for each list of them."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "owner long, key string, at long, seq long").coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    stream = spark.readStream.schema("owner long, key string, at long, seq long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")
    with cache.rocks(spark):
        found = drained(cache.cached(stream, ttl, known), "cache-test").collect()
    return sorted((r.seq, r.outcome) for r in found), {r.seq: (r.hits, r.misses, r.expired) for r in found}


def test_outcomes_over_batches_and_within_one(spark, tmp_path):
    first = [(1, "a", 0, 1), (1, "a", 10 * S, 2), (1, "a", 10 * S + 1, 3), (1, "b", 0, 4), (None, "a", 5 * S, 5), (None, "a", 5 * S, 5)]
    got, counts = run(spark, f"file://{tmp_path}/one", [first], 10)
    assert got == [(1, "miss"), (2, "hit"), (3, "expired"), (4, "miss"), (5, "hit"), (5, "miss")]
    assert counts[3] == (1, 2, 1)


def test_the_state_goes_on_and_may_begin_with_a_log(spark, tmp_path):
    known = spark.createDataFrame([(1, "a", 0), (1, "a", 3 * S), (2, "b", 0)], "owner long, key string, put long")
    got, _ = run(spark, f"file://{tmp_path}/two", [[(1, "a", 12 * S, 1), (2, "b", 12 * S, 2)]], 10, known)
    assert got == [(1, "hit"), (2, "expired")]


def test_store_is_put_back(spark):
    before = spark.conf.get(cache.PROVIDER, None)
    with cache.rocks(spark):
        assert spark.conf.get(cache.PROVIDER) == cache.ROCKS
    assert spark.conf.get(cache.PROVIDER, None) == before
