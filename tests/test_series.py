"""Series rules expanded again by dateutil give the observed occurrences; empty tables, null keys and titles."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from dateutil.rrule import rrulestr

from .conftest import DATA
from kalends.operators import series as S


def _expanded(row, rdates=()):
    days = set(rrulestr(row["rule"], dtstart=row["dtstart"])) - set(row["exdates"])
    return sorted(days | set(rdates))


def test_monthly_series_expand_to_what_was_observed(spark):
    rng, rows, observed = random.Random(5), [], {}
    for key in range(60):
        days = {datetime(2024, m, d, 19, 30) for m in range(1, 13) for d in range(1, 29) if datetime(2024, m, d).weekday() == 1 and (d - 1) // 7 == 1 and rng.random() < 0.7}
        days |= {datetime(2024, rng.randint(1, 12), rng.randint(15, 28), 19, 30) for _ in range(rng.randint(0, 2))}
        observed[key] = sorted(days)
        rows += [(key, d, d + timedelta(minutes=rng.choice([60, 60, 90])), None) for d in days]
    df = spark.createDataFrame(rows, "key int, start timestamp_ntz, end timestamp_ntz, status string")
    got = {r["key"]: r for r in S.monthly_series(df, "key", 1, 2).collect()}
    ends = {(k, s): e for k, s, e, _ in rows}
    for key, days in observed.items():
        regular = [d for d in days if d.weekday() == 1 and (d.day - 1) // 7 == 1]
        assert (key in got) == (len(regular) >= 2)
        if key in got:
            row = got[key]
            assert _expanded(row, row["rdates"]) == days
            moved = {o["recurrence"]: o["end"] for o in row["overrides"]}
            assert all(moved.get(d, d + timedelta(minutes=row["minutes"])) == ends[key, d] for d in days)


def test_continued_series_expand_to_the_members_occurrences(spark):
    rows, want = [], {}
    for t in range(12):
        days = [datetime(2024, 1, 5, 17) + timedelta(days=14 * k) for k in range(10) if k in (0, 9) or (k + t) % 3]
        want[f"t{t}"] = days
        rows += [(f"{t}-{k // 4}", f"t{t}", "hver anden fredag" if k == 0 else None, None, d, d + timedelta(hours=2), None) for k, d in enumerate(days)]
    rows += [("x", None, "hver anden fredag", None, datetime(2024, 1, 5), datetime(2024, 1, 6), None)]
    df = spark.createDataFrame(rows, "id string, title string, text string, signature string, start timestamp_ntz, end timestamp_ntz, status string")
    names = spark.createDataFrame([(t, "hver anden fredag", "FREQ=WEEKLY;INTERVAL=2;BYDAY=FR;", f"s-{t}") for t in [*want, "unseen", None]], "title string, declaration string, prefix string, series string")
    series, absorbed, faults = S.continued_series(df, names, "id", "title", "text", "signature")
    got = {r["title"]: r for r in series.collect()}
    assert {t: _expanded(r | {"exdates": [datetime(d.year, d.month, d.day, 17) for d in r["exdates"]]}) for t, r in ((t, r.asDict()) for t, r in got.items())} == want
    assert {r["id"] for r in absorbed.collect()} == {r[0] for r in rows} - {"x"}
    assert faults.count() == 0


def test_nothing_gives_nothing_and_null_keys_are_faults(spark):
    none = spark.createDataFrame([], "id string, title string, text string, signature string, start timestamp_ntz, end timestamp_ntz, status string")
    names = spark.createDataFrame([], "title string, declaration string, prefix string, series string")
    assert [d.count() for d in S.continued_series(none, names, "id", "title", "text", "signature")] == [0, 0, 0]
    assert S.monthly_series(none, "id", 0, 1).count() == 0
    at = datetime(2024, 1, 1, 9)
    bookings = spark.createDataFrame([(None, 1, "a", 1, at, at), (2, None, None, 1, at, at), (3, 7, "a", 1, None, None)], "id int, series int, title string, ord int, start timestamp_ntz, end timestamp_ntz")
    groups, faults = S.booked_series(bookings, "id", "series", "title", "ord")
    assert {(r["group"], r["rule"]) for r in groups.collect()} == {("booking-2", None), ("series-7", None)}
    assert [r["fault"] for r in faults.collect()] == ["key"]
    plans = spark.createDataFrame([(1, 0, "19:00"), (2, 0, "19:00")], "key int, weekday int, clock string")
    days = spark.createDataFrame([(1, at.date(), None, None)], "key int, date date, clock string, status string")
    rules, faults = S.season_plan(plans, days, "key")
    assert [(r["key"], r["rule"], r["exdates"]) for r in rules.collect()] == [(1, None, [])]
    assert [(r["key"], r["fault"]) for r in faults.collect()] == [(2, "dates")]


def test_no_side_that_grows_is_gathered_at_the_driver(spark):
    """Exploded rows of a small file look small to the planner, which then broadcast all of them."""
    from kalends.plans import registry

    for name in ("series_continued", "series_continued_ids", "series_continued_refused", "series_booked", "series_booked_faults", "series_monthly", "season_plans", "duplicate_pairs"):
        plan = registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, name
