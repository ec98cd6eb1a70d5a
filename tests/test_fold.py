import random

import duckdb

from hearthline.operators import training
from hearthline.plans import site_queries


def sequential(numbers):
    x = numbers[0]
    for a in numbers[1:]:
        x = (x + a) // 2
    return x


def test_runs_of_any_length_do_what_their_numbers_do():
    rng = random.Random(3)
    for _ in range(300):
        most = rng.choice([1, 2, 7, 1000, training.MOST - 1])
        numbers = [rng.choice([rng.randint(0, most), most, 0]) for _ in range(rng.choice([1, 2, 60, 61, 62, 63, 64, 65, 200]))]
        x = rng.choice([0, 1, most, rng.randint(0, most)])
        run = training.Halves()
        for a in numbers:
            run.add(a)
        assert run.of(x) == sequential([x, *numbers])


def test_a_hot_key_goes_through_many_tasks(spark):
    rng = random.Random(4)
    rows = []
    for host, n in (("hot", 700), ("a", 1), ("b", 2), (None, 3), ("c", 90)):
        rows += [(host, i, *[rng.randint(0, 5000) for _ in training.NUMBERS], *[rng.random() < 0.01 for _ in training.FLAGS]) for i in range(n)]
    schema = "host string, seq long, " + ", ".join([*[f"{c} long" for c in training.NUMBERS], *[f"{c} boolean" for c in training.FLAGS]])
    rng.shuffle(rows)
    examples = spark.createDataFrame(rows, schema).repartition(5)
    got = {r.host: tuple(r[1:]) for r in training.folded(examples, "host").collect()}
    want = {}
    for host in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == host) if host else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        numbers = [sequential([r[2 + k] for r in own]) for k in range(len(training.NUMBERS))]
        flags = [any(r[2 + len(training.NUMBERS) + k] for r in own) for k in range(len(training.FLAGS))]
        want[host] = (len(own), *numbers, *flags)
    assert got == want
    assert training.folded(examples.limit(0), "host").collect() == []


def test_titles_are_as_long_as_the_sql_says(spark, tmp_path):
    """Entities that are cut off or unknown to the SQL, as the driver's larger tables have them."""
    titles = ["Tebeie$$$ und&amp;&amp;&amp", "token = &quot;6c2c", "a &lt;b&gt; &amp;amp; é&eacute;", "  x &#39; ", "\t y", ""]
    rows = [(k, f"https://h{k % 5}.com/{k}", f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = site_queries.domain_pattern_fold(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(site_queries.ORACLES["domain_pattern_fold"]).fetchall())
