"""The as-of fill on a stream with late rows: each event gets the latest mark at or before its time, once no earlier row can come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Marks have a value and no id, events an id; key is what they are matched by.
ROWS = "key string, at timestamp, id string, value string"


def _fill(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a key: events that wait, marks that may still matter, and the last mark that the watermark has passed."""
    waiting, marks, last = json.loads(state.get[0]) if state.exists else ([], [], None)
    for f in frames:
        for at, id_, value in zip(f["at"].tolist(), f["id"].tolist(), f["value"].tolist()):
            (waiting if id_ is not None else marks).append([at, value if id_ is None else id_])
    passed = state.getCurrentWatermarkMs() * 1000
    waiting.sort()
    marks.sort()
    out, k = [], 0
    for at, id_ in waiting:
        if at > passed:
            break
        while k < len(marks) and marks[k][0] <= at:
            last, k = marks[k][1], k + 1
        out.append((key[0], at, id_, last))
    waiting = waiting[len(out):]
    while k < len(marks) and marks[k][0] <= passed:  # of those that no waiting event comes before, the last is enough
        last, k = marks[k][1], k + 1
    state.update((json.dumps([waiting, marks[k:], last]),))
    if waiting:
        state.setTimeoutTimestamp(waiting[0][0] // 1000 + 1)
    yield pd.DataFrame(out, columns=["key", "at", "id", "value"])


def filled(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """key, at, id, value of a stream's events (see ROWS), the value null where no mark came before; as operators.sections.asof gives it
    for all rows at once. An event comes out when the watermark, so far behind the latest row, has passed it; rows that come after
    the watermark are lost, as everywhere. Of marks at one time the largest value counts. State per key: what the watermark hasn't passed, and one mark.
    """
    micros = rows.withWatermark("at", late).select("key", "at", F.unix_micros("at").alias("us"), "id", "value")
    made = micros.groupBy("key").applyInPandasWithState(lambda key, frames, state: _fill(key, (f.assign(at=f["us"]) for f in frames), state), "key string, at long, id string, value string", "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return made.withColumn("at", F.timestamp_micros("at"))
