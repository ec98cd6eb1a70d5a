"""Change detection over a stream of page visits: per url only the last hash is kept, and it is dropped after a time without visits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "url string, seq long, processed_at timestamp, hash string, change_detected boolean"


def detected(visits: DataFrame, forget_ms: int = 7 * 86_400_000) -> DataFrame:
    """visits: url, seq, processed_at, hash, a stream. Visits of one batch are taken in the order of their time; a visit that comes
    in a later batch counts as later. Adds change_detected: a url's first visit, or another hash than at the visit before."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values(["processed_at", "seq"])
        hashes = frame["hash"].tolist()
        changed = [old is None or new != old for old, new in zip([before, *hashes[:-1]], hashes, strict=True)]
        state.update((hashes[-1],))
        state.setTimeoutDuration(forget_ms)
        yield frame.assign(change_detected=changed)[["url", "seq", "processed_at", "hash", "change_detected"]]

    return visits.groupBy("url").applyInPandasWithState(step, OUT, "hash string", "append", GroupStateTimeout.ProcessingTimeTimeout)
