"""Requests allowed per client: a window opens with a client's first request and again with the first one after it has passed."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from hearthline.operators.schedule import ranked
from hearthline.sources.shared import kept

#: Clients with more requests than this are decided in many tasks each.
HOT = 1_000_000


def limited(requests: DataFrame, most: int, window_seconds: int, hot: int = HOT) -> DataFrame:
    """requests: client, at (epoch microseconds), seq. Adds allowed. One client's requests are decided in order in one task, which reads
    them as they come and keeps the open window only; those of a client with more than hot go through many tasks (by_jumps). A null
    client counts as one; an empty table gives no rows; requests of one moment go by seq."""
    requests = requests.select("client", "at", "seq")
    busy = requests.groupBy("client").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("client").alias("busy"))
    if busy.isEmpty():
        return _in_order(requests, most, window_seconds)
    same = F.col("client").eqNullSafe(F.col("busy"))
    rest = _in_order(requests.join(busy, same, "left_anti"), most, window_seconds)
    return rest.unionByName(by_jumps(requests.join(busy, same, "left_semi"), most, window_seconds))


def by_jumps(requests: DataFrame, most: int, window_seconds: int) -> DataFrame:
    """The same rows as limited, with no client's requests in one task. Each moment of a client points to the first one beyond the
    window that it would open. Which moments do open one is found by jumps of doubled length from the client's first moment, so the
    rounds are the logarithm of the windows that a client has. Requests then go to the last opening at or before them and are counted
    from there."""
    window = window_seconds * 1_000_000
    # a null client is told by a flag, so that all joins are by equality
    named = requests.select(F.coalesce("client", F.lit(0)).alias("who"), F.col("client").isNull().alias("none"), "at", "seq")
    key = ["who", "none"]
    moments = kept(named.select(*key, "at").distinct(), "moments")
    beyond = moments.select(*key, (F.col("at") + window).alias("place"), F.lit(1).alias("asks"), F.col("at").alias("start"))
    placed = moments.select(*key, F.col("at").alias("place"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("start"))
    # a moment that is just as far as a window reaches stands before the end of that window, the first one beyond it behind
    jumps = _carried(beyond.unionByName(placed), key, ["place", "asks"], forwards=False)
    jumps = kept(jumps.where("asks = 1 AND found IS NOT NULL").select(*key, F.col("start").alias("at"), F.col("found").alias("to")), "jumps")
    opened = kept(moments.groupBy(*key).agg(F.min("at").alias("at")), "opened")
    while not jumps.isEmpty():
        reached = opened.join(jumps, [*key, "at"]).select(*key, F.col("to").alias("at"))
        opened = kept(opened.unionByName(reached), "opened")
        further = jumps.select(*key, F.col("at").alias("to"), F.col("to").alias("further"))
        jumps = kept(jumps.join(further, [*key, "to"]).select(*key, "at", F.col("further").alias("to")), "jumps")
    # requests and openings in order: the last opening at or before a request is its window
    rows = named.select(*key, F.col("at").alias("place"), F.lit(1).alias("asks"), F.col("seq"))
    marks = opened.select(*key, F.col("at").alias("place"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("seq"))
    windows = _carried(rows.unionByName(marks), key, ["place", "asks", "seq"], forwards=True)
    windows = windows.where("asks = 1").withColumn("opening", F.struct(*key, "found"))
    placed = ranked(windows.select("opening", F.col("place").alias("at"), "seq"), "opening", ["at", "seq"])
    client = F.when(~F.col("opening.none"), F.col("opening.who")).alias("client")
    return placed.select(client, "at", "seq", (F.col("rank") < most).alias("allowed"))


def _carried(rows: DataFrame, key: list[str], order: list[str], forwards: bool) -> DataFrame:
    """rows with found: the place of the nearest row with asks = 0 in the order of a key, before each row (forwards) or behind it. Rows
    are dealt by ranges of key and order; what a range lacks comes from the key's nearest range that has one, of which only the ends
    come together."""
    dealt = kept(rows.repartitionByRange(*key, *order).withColumn("range", F.spark_partition_id()), "ranges")
    turned = lambda names: [F.col(c) if forwards else F.col(c).desc() for c in names]
    place = F.when(F.col("asks") == 0, F.col("place"))
    within = Window.partitionBy("range", *key).orderBy(*turned(order)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*key).orderBy(*turned(["range"])).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*key, "range").agg((F.max(place) if forwards else F.min(place)).alias("end"))
    near = ends.select(*key, "range", F.last("end", ignorenulls=True).over(across).alias("near"))
    own = dealt.withColumn("own", F.last(place, ignorenulls=True).over(within))
    return own.join(near, [*key, "range"]).withColumn("found", F.coalesce("own", "near"))


def _in_order(requests: DataFrame, most: int, window_seconds: int) -> DataFrame:
    window = window_seconds * 1_000_000
    dealt = requests.select("client", "at", "seq").repartition("client").sortWithinPartitions("client", "at", "seq")

    def run(batches):
        now, start, count, begun = None, None, 0, False
        for batch in batches:
            out = []
            for client, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or client != now:
                    now, start, begun = client, None, True
                if start is None or t - start > window:
                    start, count = t, 0
                out.append(count < most)
                count += count < most
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], ["client", "at", "seq", "allowed"])

    return dealt.mapInArrow(run, "client long, at long, seq long, allowed boolean")


def limited_stream(requests: DataFrame, most: int, window_seconds: int) -> DataFrame:
    """The same over a stream: a client's window and count are its state, dropped after two windows without requests. Requests of
    one batch are decided in the order of their time."""
    window = window_seconds * 1_000_000

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values(["at", "seq"])
        out = []
        for t in frame["at"].tolist():
            if start is None or t - start > window:
                start, count = t, 0
            out.append(count < most)
            count += count < most
        state.update((start, count))
        state.setTimeoutDuration(2 * window_seconds * 1000)
        yield frame.assign(allowed=out)[["client", "at", "seq", "allowed"]]

    return requests.groupBy("client").applyInPandasWithState(step, "client long, at long, seq long, allowed boolean", "start long, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)
