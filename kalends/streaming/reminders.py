"""Reminders as a stream: set, move and cancel changes in, notices out when due. Keyed state with event-time timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kalends.operators.reminders import GRACE

from .delivery import STATE_STORE

#: Columns of the notices.
OUTPUT = "id string, notify timestamp, lead int, moved boolean"
STATE = "start_ms long, lead int, moved boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One reminder: its last change counts; it is shown once when due, unless cancelled or past use by then."""
    if state.hasTimedOut:
        start, lead, moved = state.get
        state.remove()
        yield pd.DataFrame({"id": [key[0]], "notify": [pd.Timestamp(start - lead * 60_000, unit="ms")], "lead": [lead], "moved": [bool(moved)]})
        return
    rows = pd.concat(batches).sort_values("ts", kind="stable")
    last = rows.iloc[-1]
    if last["action"] == "cancel":
        if state.exists:
            state.remove()
        return
    start, lead = int(pd.Timestamp(last["start"]).value // 1_000_000), int(last["lead"])
    old = state.getOption
    due, end = start - lead * 60_000, start + (GRACE * 60_000 if lead == 0 else 0)
    now = state.getCurrentWatermarkMs()
    if end <= now:  # marked without being shown
        if state.exists:
            state.remove()
        return
    moved = len(rows["start"].unique()) > 1 or (old is not None and old[0] != start)
    state.update((start, lead, moved))
    state.setTimeoutTimestamp(max(due, now + 1))


def due_reminders(changes: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Notices of a stream of changes (id, ts, action, start, lead), at least once each, as the watermark passes the time to notify.

    A later change of an id replaces an earlier one, so a moved start moves the notice and 'cancel' drops it. State is
    one row for each open reminder and goes when the notice does.
    """
    watched = changes.withWatermark("ts", delay)
    return watched.groupBy("id").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(spark: SparkSession, stream: DataFrame, place: str | None = None) -> DataFrame:
    """All that a bounded stream has given so far, as a table in the shared folder; timers that the last watermark passes fire. The same
    `place` again goes on from where it was left."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    place = place or f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
    # state with initial rows and timers of its own needs this store; the session's choice is put back
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(schema).parquet(f"{place}/out")
