"""Rolling view counts as a stream: the batch rule of ``counted_views`` with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_counted_views(views: DataFrame, post: str, viewer: str, at: str, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """A row (post, viewer, at) for each view that counts. Views later than the watermark are dropped by definition; views
    of one micro-batch are put in order first; a view without a time never counts; times are compared in microseconds, as in
    the batch form; a key's state ends ``minutes`` after its last counted view."""
    gap = minutes * 60_000_000

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t.value // 1000 for b in batches for t in b[at].dropna())
        if not times and last is None:
            return
        counted = []
        for t in times:
            if last is None or t - last >= gap:
                last = t
                counted.append(t)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({post: [key[0]] * len(counted), viewer: [key[1]] * len(counted), at: pd.to_datetime(counted, unit="us")})

    types = dict(views.dtypes)
    return (
        views.select(post, viewer, at)
        .withWatermark(at, late)
        .groupBy(post, viewer)
        .applyInPandasWithState(count, f"{post} {types[post]}, {viewer} {types[viewer]}, {at} timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )
