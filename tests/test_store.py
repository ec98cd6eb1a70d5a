import pytest
from pyspark.sql import functions as F

from hearthline.sources.store import FIRST, LAST, REPLACE, Conflict, KeyedStore

SCHEMA = "k string, at long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", SCHEMA, ("k",), buckets=4)


def table(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_first_write_stays(spark, store):
    assert rows(store.read()) == [] and store.manifest()["version"] == 0
    store.merge(table(spark, ("a", 5, "x"), ("a", 4, "y"), (None, 1, "n")), FIRST, ("at",))
    store.merge(table(spark, ("a", 1, "z"), ("b", 1, "b"), (None, 0, "m")), FIRST, ("at",))
    assert rows(store.read()) == sorted([("a", 4, "y"), ("b", 1, "b"), (None, 1, "n")], key=str)
    assert rows(store.read(1)) == sorted([("a", 4, "y"), (None, 1, "n")], key=str)


def test_last_write_wins_in_any_order_of_runs(spark, store):
    for part in ([("a", 3, "c"), ("b", 1, "b")], [("a", 2, "b"), ("b", 2, "d")], [("b", 2, "e")]):
        store.merge(table(spark, *part), LAST, ("at",))
    assert rows(store.read()) == [("a", 3, "c"), ("b", 2, "e")]


def test_replace_and_clashing_columns(spark, store):
    store.merge(table(spark, ("a", 3, "c")), REPLACE)
    store.merge(table(spark, ("a", 1, "d")).withColumn("extra", F.lit(1)).withColumn("fresh", F.lit(9)).select("extra", "v", "fresh", "at", "k"), REPLACE)
    assert rows(store.read()) == [("a", 1, "d")]


def test_only_touched_buckets_are_rewritten(spark, store):
    store.merge(table(spark, *[(f"k{i}", i, "v") for i in range(40)]), FIRST, ("at",))
    before = store.manifest()["buckets"]
    store.merge(table(spark, ("k3", 0, "new"), ("k3", 0, "new")), REPLACE)
    after = store.manifest()["buckets"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert len(rows(store.read())) == 40 and ("k3", 0, "new") in rows(store.read())


def test_a_batch_counts_once(spark, store):
    assert store.merge(table(spark, ("a", 1, "x")), LAST, ("at",), "b1") == 1
    assert store.merge(table(spark, ("a", 2, "y")), LAST, ("at",), "b1") == 1
    assert rows(store.read()) == [("a", 1, "x")]


def test_a_run_cut_before_the_swap_changes_nothing(spark, store, monkeypatch):
    store.merge(table(spark, ("a", 1, "x")), LAST, ("at",))

    def cut(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_swap", cut)
        with pytest.raises(KeyboardInterrupt):
            store.merge(table(spark, ("a", 2, "y"), ("b", 1, "z")), LAST, ("at",), "b2")
    assert rows(store.read()) == [("a", 1, "x")]
    store.merge(table(spark, ("a", 2, "y"), ("b", 1, "z")), LAST, ("at",), "b2")
    assert rows(store.read()) == [("a", 2, "y"), ("b", 1, "z")]
    store.vacuum(keep=1)
    assert rows(store.read()) == [("a", 2, "y"), ("b", 1, "z")]
    assert not [n for n in store.files.names() if n.startswith("staging-")]


def test_of_two_writers_the_second_is_told(spark, store):
    other = KeyedStore(spark, store.folder, SCHEMA, ("k",))
    old = other.manifest()
    store.merge(table(spark, ("a", 1, "x")), FIRST)
    with pytest.raises(Conflict):
        other._swap(old, {}, None)
    assert rows(other.read()) == [("a", 1, "x")]


def test_remove_lookup_and_clear(spark, store):
    store.merge(table(spark, *[(f"k{i}", i, "v") for i in range(10)]), FIRST, ("at",))
    assert rows(store.lookup(table(spark, ("k3", 0, ""), ("k3", 0, ""), ("none", 0, "")))) == [("k3", 3, "v")]
    store.remove(table(spark, ("k3", 0, ""), ("none", 0, "")))
    assert len(rows(store.read())) == 9 and rows(store.lookup(table(spark, ("k3", 0, "")))) == []
    store.merge(table(spark).limit(0), FIRST)
    assert len(rows(store.read())) == 9
    store.clear("c")
    assert rows(store.read()) == [] and store.clear("c") == store.manifest()["version"]


def test_two_runs_over_overlapping_halves_equal_one(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.col("p_type").alias("k"), F.col("p_partkey").alias("at"), F.col("p_name").alias("v"))
    one = KeyedStore(spark, f"file://{tmp_path}/one", SCHEMA, ("k",), buckets=3)
    two = KeyedStore(spark, f"file://{tmp_path}/two", SCHEMA, ("k",), buckets=5)
    one.merge(part, FIRST, ("at",))
    for half in (part.where("at <= 120"), part.where("at >= 80")):
        two.merge(half, FIRST, ("at",))
    assert rows(one.read()) == rows(two.read()) and rows(one.read())
