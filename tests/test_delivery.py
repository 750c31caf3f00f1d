"""Stateful delivery against a replay that walks the clock minute by minute; restarts in mid-stream; initial state."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from kalends.streaming.delivery import category_news, delivered_reminders
from kalends.streaming.reminders import run_to_end

T0 = datetime(2024, 1, 1)
CHANGE = "id string, ts timestamp, action string, start timestamp, lead int"


def at(minute):
    return None if minute is None else T0 + timedelta(minutes=minute)


def replay(initial, changes, end):
    """(id, action, minute) by asking every minute what there is to do, before and after the changes of that minute."""
    book, out = {i: {"start": s, "lead": lead, "done": done, "not_before": 0} for i, s, lead, done in initial}, []

    def check(now):
        for i in list(book):
            r = book[i]
            over = r["start"] + (5 if r["lead"] == 0 else 0) <= now
            if r["done"] is None and now >= r["start"] - r["lead"] and now >= r["not_before"]:
                out.append((i, "mark" if over else "show", now))
                r["done"] = now
            if r["done"] is not None and over:
                del book[i]

    for now in range(end + 1):
        check(now)
        for i, minute, action, start, lead in sorted((c for c in changes if c[1] == now), key=lambda c: (c[0], c[2])):
            r = book.get(i)
            if action == "cancel":
                book.pop(i, None)
            elif action == "failed" and r and r["done"] is not None:
                r["done"], r["not_before"] = None, now + 1
            elif action == "moved" and r and start + (5 if r["lead"] == 0 else 0) <= now:
                del book[i]
            elif action == "set" or (action == "moved" and r):
                lead = r["lead"] if action == "moved" else lead
                if not r or (r["start"], r["lead"]) != (start, lead):
                    book[i] = {"start": start, "lead": lead, "done": None, "not_before": now}
        check(now)
    return sorted(out)


def cases(seed):
    rng, changes, seen = random.Random(seed), [], set()
    for minute in range(0, 400, 2):
        for _ in range(3):
            i = f"r{rng.randrange(25)}"
            if (i, minute) not in seen:
                seen.add((i, minute))
                action = rng.choice(["set", "set", "moved", "failed", "cancel"])
                changes.append((i, minute, action, minute + rng.randint(-5, 90) if action in ("set", "moved") else None, rng.choice([0, 0, 10, 30]) if action == "set" else None))
    changes.append(("end", 600, "cancel", None, None))
    initial = [(f"r{i}", rng.randint(10, 200), rng.choice([0, 15]), rng.choice([None, None, 1])) for i in range(12)]
    return initial, changes


def write(spark, rows, folder):
    spark.createDataFrame([(i, at(m), a, at(s), lead) for i, m, a, s, lead in rows], CHANGE).coalesce(1).write.mode("append").parquet(folder)


def test_delivery_restarted_in_mid_stream_equals_a_replay(spark, tmp_path):
    initial, changes = cases(3)
    book = spark.createDataFrame([(i, at(s), lead, at(d)) for i, s, lead, d in initial], "id string, start timestamp, lead int, delivered timestamp")
    stream = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    parts = [changes[:150], changes[150:300], changes[300:]]
    for part in parts:
        rng = random.Random(len(part))
        rng.shuffle(part)
        write(spark, part, f"{tmp_path}/in")
        got = run_to_end(spark, delivered_reminders(stream(), book), f"{tmp_path}/run")
    found = sorted((r["id"], r["action"], int((r["at"] - T0).total_seconds() // 60)) for r in got.collect())
    assert found == replay(initial, changes, 599)
    assert {a for _, a, _ in found} == {"show", "mark"}


def test_category_news_by_checks_limits_and_failures(spark, tmp_path):
    schema = "id string, ts timestamp, action string, event string"
    rows = [
        ("s", 0, "check", "a"), ("s", 0, "check", "b"), ("s", 10, "check", "c"), ("s", 15, "check", "c"), ("s", 16, "forced", "d"), ("s", 16, "forced", "e"),
        ("s", 17, "failed", None), ("s", 20, "check", "d"), ("s", 31, "check", "d"), ("s", 60, "check", None), ("t", 5, "check", "a"), ("t", 5, "check", "a"), (None, 5, "check", "a"), ("end", 200, "check", None),
    ]
    spark.createDataFrame([(i, at(m), a, e) for i, m, a, e in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([("s", "a"), ("t", "z")], "id string, event string")
    got = run_to_end(spark, category_news(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), known), f"{tmp_path}/run").collect()
    assert sorted((r["id"], int((r["at"] - T0).total_seconds() // 60), r["n"], r["event"]) for r in got) == [("s", 0, 1, "b"), ("s", 15, 1, "c"), ("s", 16, 2, None), ("s", 31, 1, "d"), ("t", 5, 1, "a")]


class Counted:
    """A handle and its states that keep what is put there and count the calls, as each one goes to the JVM."""

    def __init__(self):
        self.calls, self.timers, self.list, self.map, self.value = 0, [], [], {}, None

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name.startswith("get") and name.endswith("State"):
                return self
            if name == "registerTimer":
                self.timers.append(args[0])
            elif name in ("appendList", "put"):
                self.list = (self.list if name == "appendList" else []) + list(args[0])
            elif name == "appendValue":
                self.list.append(args[0])
            elif name == "clear":
                self.list = []
            elif name == "get":
                return list(self.list)
            elif name == "getCurrentWatermarkInMs":
                return self.value
            elif name == "containsKey":
                return args[0] in self.map
            elif name == "updateValue":
                self.map[args[0]] = args[1]

        return call


class Checked:
    now = None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value


def test_calls_to_state_do_not_grow_with_a_keys_changes():
    from kalends.streaming.delivery import _Category

    handle, clock = Counted(), Counted()
    news = _Category()
    news.init(handle)
    news.checked = Checked()
    clock.value = 0
    rows = [(1, n * 1_000_000, "check", f"e{n % 5}", None) for n in range(1, 1001)]
    list(news.handleInputRows(("k",), iter(("k", *r[1:]) for r in rows), clock))
    assert handle.timers == [1_000_000]
    clock.value = 500_000_000
    found = list(news.handleExpiredTimer(("k",), clock, None))
    assert [r["event"] for r in found] == ["e1", "e2", "e3", "e4", "e0"]
    assert handle.timers == [1_000_000, 501_000_000] and len(handle.list) == 500
    clock.value = 2_000_000_000
    assert list(news.handleExpiredTimer(("k",), clock, None)) == []
    assert handle.list == [] and handle.calls < 40
