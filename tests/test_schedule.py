from collections import Counter

from hearthline.operators import schedule


def test_ranks_of_a_hot_key_over_many_ranges(spark):
    rows = [("hot", i % 3, i) for i in range(2000)] + [("a", 0, 1), ("b", 1, 2), ("b", 0, 3), (None, 0, 4), (None, 0, 5)]
    df = spark.createDataFrame(rows, "k string, place int, id long").repartition(7)
    got = {(r.k, r.id): r.rank for r in schedule.ranked(df, "k", ["place", "id"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for rank, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])):
            want[key, r[2]] = rank
    assert got == want
    assert schedule.ranked(df.limit(0), "k", ["place", "id"]).collect() == []


def test_slots_delays_and_the_horizon(spark):
    rows = [(i, f"https://a.com/{'contato' if i == 0 else 'imovel'}/{i}", 0) for i in range(7)] + [(9, "https://b.com/", 5), (10, "mailto:x", 0)]
    df = spark.createDataFrame(rows, "id long, url string, depth int")
    got = {r.id: r.start for r in schedule.polite(df, slots=3, delay=10).collect()}
    assert Counter(got[i] for i in range(7)) == {0: 3, 10: 3, 20: 1} and got[0] == 20 and got[9] == 0 and 10 not in got
    assert {r.id for r in schedule.polite(df, slots=3, delay=10, horizon=20, max_depth=4).collect()} == set(range(1, 7))


def test_watched(spark):
    df, seen = schedule.watched(spark.range(10), "numbers", even=schedule.F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}
