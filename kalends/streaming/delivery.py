"""Delivery of reminders and of new events by category, as keyed state with event-time timers that starts from a batch table.

Changes wait in state until the watermark passes them and are then applied in order of time, with what falls due between
two of them delivered at its own moment. So the outcome depends on the changes only, not on how they are cut into
batches or where a query was restarted. A batch that fails is run again, so a sink that is not transactional may get an
action twice: at least once. Rows later than the watermark are dropped. What waits for a key is bounded by the watermark's
delay and the source's limit for a batch (maxFilesPerTrigger and the like).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kalends.operators.reminders import GRACE

#: Milliseconds until a notice that could not be shown is tried again, and between two unforced checks of a category.
RETRY_MS = 60_000
CHECK_MS = 15 * 60_000
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _InOrder(StatefulProcessor):
    """Keeps changes until the watermark passes them. Subclasses give `waits` (the change's state, its time first) and `settle`."""

    waits: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)

    def settle(self, key: str, ready: list[tuple], now: int) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r)[1:-1] for r in rows]  # without the key and the watermark's column
        if new:
            # each call goes to the JVM and back: one list, and one timer, which is set again for what is still to come when it fires
            self.waiting.appendList(new)
            self.handle.registerTimer(max(min(r[0] for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r[0] <= now), key=lambda r: tuple((v is not None, v) for v in r))
        if ready:
            later = [r for r in rows if r[0] > now]
            self.waiting.put(later) if later else self.waiting.clear()
            if later:
                self.handle.registerTimer(min(r[0] for r in later))
        yield from self.settle(key[0], ready, now)

    def close(self) -> None:
        pass


class _Reminder(_InOrder):
    waits = "ts long, action string, start long, lead long"

    def init(self, handle):
        super().init(handle)
        # since: when the present schedule, or a retry, began; shown: when it was delivered or given up
        self.open = handle.getValueState("open", "start long, lead long, since long, shown long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        start, lead, shown = tuple(initialState)[1:]
        if start is not None and lead is not None and lead >= 0:
            self._keep((start, lead, 0, shown), timerValues.getCurrentWatermarkInMs())

    def _keep(self, reminder: tuple, now: int) -> None:
        start, lead, since, shown = reminder
        self.open.update(reminder)
        self.handle.registerTimer(max(_expiry(start, lead) if shown is not None else max(start - lead * 60_000, since), now + 1))

    def settle(self, key, ready, now):
        state = self.open.get()
        state = tuple(state) if state is not None else None
        for change in [*ready, None]:
            until = change[0] if change else now
            state, row = _deliver(key, state, until)
            if row:
                yield row
            if change:
                state = _changed(state, *change)
        if state is not None and state[3] is not None and _expiry(state[0], state[1]) <= now:
            state = None
        if state is None:
            self.open.clear()
        else:
            self._keep(state, now)


def _expiry(start: int, lead: int) -> int:
    return start + (GRACE * 60_000 if lead == 0 else 0)


def _deliver(key: str, state: tuple | None, until: int) -> tuple[tuple | None, Row | None]:
    """What an open reminder does by a moment: it is shown, or marked where it is past use by the time it could be."""
    if state is None or state[3] is not None:
        return state, None
    start, lead, since, _ = state
    at = max(start - lead * 60_000, since)
    if at > until:
        return state, None
    action = "mark" if _expiry(start, lead) <= at else "show"
    return (start, lead, since, at), Row(id=key, action=action, at=at, start=start, lead=lead)


def _changed(state: tuple | None, ts: int, action: str, start: int | None, lead: int | None) -> tuple | None:
    """A reminder after a change at `ts`. The delivery mark stays only where start and lead, and so the time to notify, do."""
    if state is not None and state[3] is not None and _expiry(state[0], state[1]) <= ts:
        state = None
    if action == "cancel":
        return None
    if action == "failed":
        return (*state[:2], ts + RETRY_MS, None) if state is not None and state[3] is not None else state
    if action == "moved":
        if state is None or start is None:
            return state
        lead = state[1]
        if _expiry(start, lead) <= ts:
            return None
    if start is None or lead is None or lead < 0 or action not in ("set", "moved"):
        return state
    same = state is not None and state[:2] == (start, lead)
    return state if same else (start, lead, ts, None)


def _ms(c: str) -> Column:
    return F.unix_millis(F.col(c)).alias(c)


def delivered_reminders(changes: DataFrame, reminders: DataFrame | None = None, delay: str = "1 minute") -> DataFrame:
    """(id, action, at, start, lead) of a stream of changes (id, ts, action, start, lead), from reminders (id, start, lead, delivered) on.

    Changes: 'set' (start and lead), 'moved' (a new start by the catalog; the lead stays), 'cancel' (also what the catalog
    misses), 'failed' (the last notice could not be shown). Actions: 'show' when due, or `RETRY_MS` after it failed;
    'mark' for one that is past use when it could first be shown. An open reminder has one row of state until its expiry. What
    falls due at the time of a change comes before it; changes of one time apply in order of action, start and lead, nulls first. Negative
    or missing leads, missing starts and other actions change nothing.
    """
    rows = changes.where("id is not null and ts is not null").withWatermark("ts", delay)
    keyed = rows.select("id", F.unix_millis("ts").alias("ms"), "action", _ms("start"), F.col("lead").cast("long"), "ts").groupBy("id")
    first = None if reminders is None else reminders.where("id is not null").select("id", _ms("start"), F.col("lead").cast("long"), _ms("delivered")).groupBy("id")
    out = keyed.transformWithState(_Reminder(), "id string, action string, at long, start long, lead long", "append", "eventTime", initialState=first)
    return out.select("id", "action", F.timestamp_millis("at").alias("at"), F.timestamp_millis("start").alias("start"), "lead")


class _Category(_InOrder):
    waits = "ts long, action string, event string"

    def init(self, handle):
        super().init(handle)
        self.known = handle.getMapState("known", "event string", "since long")
        self.checked = handle.getValueState("checked", "last long, noticed long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.updateValue((initialState[1],), (0,))

    def settle(self, key, ready, now):
        if not ready:
            return
        last, noticed = self.checked.get() or (None, None)
        seen = set()  # what is known of the events asked for here, each looked up once
        for ts, same in groupby(ready, key=lambda r: r[0]):
            rows = list(same)
            if noticed is not None and any(r[1] == "failed" for r in rows):
                for event in [e[0] for e, since in self.known.iterator() if since[0] == noticed]:
                    self.known.removeKey((event,))
                    seen.discard(event)
                noticed = None
            asked = [r for r in rows if r[1] in ("check", "forced")]
            forced = any(r[1] == "forced" for r in asked)
            if not asked or (not forced and last is not None and ts - last < CHECK_MS):
                continue
            new = sorted(e for e in {r[2] for r in asked if r[2] is not None} - seen if not self.known.containsKey((e,)))
            seen.update(r[2] for r in asked if r[2] is not None)
            last = ts
            if new:
                for e in new:
                    self.known.updateValue((e,), (ts,))
                noticed = ts
                yield Row(id=key, at=ts, n=len(new), event=new[0] if len(new) == 1 else None)
        self.checked.update((last, noticed))


def category_news(checks: DataFrame, known: DataFrame | None = None, delay: str = "1 minute") -> DataFrame:
    """(id, at, n, event) of a stream of checks (id, ts, action, event) of subscriptions, from known events (id, event) on.

    A check is all rows of one id and time: an event of the category at that time in each, or one null event. It runs unless
    an earlier one ran within `CHECK_MS`; 'forced' ones always run. Events that aren't known give one notice, which names a
    single one and counts several, and are known from then on, unless a row 'failed' follows: it takes the last notice's events back.
    """
    rows = checks.where("id is not null and ts is not null").withWatermark("ts", delay)
    keyed = rows.select("id", F.unix_millis("ts").alias("ms"), "action", "event", "ts").groupBy("id")
    first = None if known is None else known.where("id is not null and event is not null").select("id", "event").groupBy("id")
    out = keyed.transformWithState(_Category(), "id string, at long, n long, event string", "append", "eventTime", initialState=first)
    return out.select("id", F.timestamp_millis("at").alias("at"), "n", "event")
