"""A cache with a time to live as the state of a stream: what owners ask for, by key, is kept for so long after it was put in.

A request is a hit if its key was put in at most the time to live before it; else it puts the key in, and is a miss, or expired if an
entry that had become too old was there. Requests of a batch are taken in the order of their time and number, later batches as later.
State is a map for each owner (a null owner is one too); the state store itself drops entries that nobody has asked for during
keep_ms of processing time, so state follows what is in use. A batch log may be given as the state to begin with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "owner long, key string, at long, seq long, outcome string, hits long, misses long, expired long"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = ("hit", "miss", "expired")


class Cache(StatefulProcessor):
    """Entries (key: when it was put in) and counters of outcomes, for each owner."""

    def __init__(self, ttl_us: int, keep_ms: int) -> None:
        self.ttl_us, self.keep_ms = ttl_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "put long", ttlDurationMs=self.keep_ms)
        self.counts = handle.getValueState("counts", "hit long, miss long, expired long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for name, put in zip(initialState["key"], initialState["put"], strict=True):
            old = self.entries.getValue((name,)) if self.entries.containsKey((name,)) else None
            self.entries.updateValue((name,), (max(int(put), old[0]) if old else int(put),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = dict(zip(OUTCOMES, self.counts.get() if self.counts.exists() else (0, 0, 0), strict=True))
        asked = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"])
        known: dict[str, int | None] = {}
        fresh: set[str] = set()
        out = []
        for name, at in zip(asked["key"], asked["at"], strict=True):
            if name not in known:
                known[name] = self.entries.getValue((name,))[0] if self.entries.containsKey((name,)) else None
            put = known[name]
            outcome = "miss" if put is None else "hit" if at - put <= self.ttl_us else "expired"
            if outcome != "hit":
                known[name] = int(at)
                fresh.add(name)
            counts[outcome] += 1
            out.append((outcome, *[counts[o] for o in OUTCOMES]))
        for name in fresh:
            self.entries.updateValue((name,), (known[name],))
        self.counts.update(tuple(counts[o] for o in OUTCOMES))
        yield asked.assign(**{c: [o[k] for o in out] for k, c in enumerate(("outcome", "hits", "misses", "expired"))})[[c.split()[0] for c in OUT.split(", ")]]

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl_seconds: int, known: DataFrame | None = None, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """requests: owner (long), key (not null), at (epoch microseconds), seq, a stream; known: owner, key, put of entries to begin with.
    Adds outcome and the owner's counts of hits, misses and expired entries so far. Start it within rocks()."""
    begin = None if known is None else known.select("owner", "key", "put").groupBy("owner")
    asked = requests.select("owner", "key", "at", "seq").groupBy("owner")
    return asked.transformWithStateInPandas(Cache(ttl_seconds * 1_000_000, keep_ms), OUT, "append", "processingTime", initialState=begin)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within have their state in the store that states of several variables need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)

