"""Recurrence rules against dateutil, over random rules and the corners of RFC 5545's table."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from kalends.operators import recurrence as R

LO, HI = date(2024, 6, 1), date(2026, 3, 31)
CORNERS = [
    "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=MONTHLY;BYMONTHDAY=1,2,3;BYSETPOS=2", "FREQ=DAILY;BYMONTHDAY=13", "FREQ=WEEKLY;BYMONTHDAY=5",
    "FREQ=YEARLY;BYMONTH=1,7;BYMONTHDAY=1", "FREQ=MONTHLY;BYDAY=2FR;BYMONTHDAY=13", "FREQ=WEEKLY;INTERVAL=2;WKST=SU", "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST=SU",
    "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST=MO", "FREQ=MONTHLY;BYDAY=TU", "FREQ=YEARLY;BYDAY=20MO", "FREQ=YEARLY;BYDAY=-1SU;BYMONTH=3,10", "FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13",
    "FREQ=YEARLY;BYMONTHDAY=-1", "FREQ=MONTHLY;BYMONTHDAY=31", "FREQ=YEARLY;BYDAY=MO;BYSETPOS=1,-1", "FREQ=WEEKLY;BYDAY=MO,WE,FR;BYSETPOS=2", "FREQ=DAILY;BYMONTH=2;BYDAY=TU",
    "FREQ=MONTHLY;INTERVAL=5;BYDAY=-2WE", "FREQ=YEARLY;INTERVAL=2", "FREQ=MONTHLY;BYDAY=5MO", "RRULE:FREQ=DAILY;INTERVAL=10", "FREQ=MONTHLY;BYMONTHDAY=-1,1;COUNT=9", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29",
]


def expanded(spark, rules):
    rows = spark.createDataFrame([(n, start, rule) for n, (rule, start) in enumerate(rules)], "id int, dtstart timestamp_ntz, rule string").repartition(8)
    out = {n: [] for n in range(len(rules))}
    for r in R.expand_rules(rows, "id", LO, HI).collect():
        out[r["id"]].append(r["recurrence"])
    return {n: sorted(x) for n, x in out.items()}


def plain(rule, start):
    lo, hi = datetime(LO.year, LO.month, LO.day), datetime(HI.year, HI.month, HI.day, 23, 59, 59)
    return rrulestr(rule.replace("Z", ""), dtstart=start).between(lo, hi, inc=True)


def random_rule(r):
    freq = r.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
    parts = [f"FREQ={freq}"]
    some = lambda xs, most: ",".join(str(x) for x in r.sample(xs, r.randint(1, most)))
    if r.random() < 0.5:
        parts.append(f"INTERVAL={r.randint(1, 5)}")
    if r.random() < 0.6:
        days = r.sample(R.WEEKDAYS, r.randint(1, 4))
        if freq in ("MONTHLY", "YEARLY") and r.random() < 0.5:
            days = [f"{r.choice([1, 2, 4, 5, -1, -2, '+3'])}{d}" for d in days]
        parts.append("BYDAY=" + ",".join(days))
    if r.random() < 0.3:
        parts.append("BYMONTHDAY=" + some([1, 2, 10, 13, 28, 29, 30, 31, -1, -3, -31], 4))
    if r.random() < 0.3:
        parts.append("BYMONTH=" + some([*range(1, 13)], 5))
    if r.random() < 0.3 and len(parts) > 2:
        # the library looks on for thousands of years where a rule gives nothing, as days have no second place
        parts.append("BYSETPOS=" + some([1, -1] if freq == "DAILY" else [1, 2, 3, -1, -2], 2))
    if r.random() < 0.4:
        parts.append(f"WKST={r.choice(R.WEEKDAYS)}")
    if (end := r.random()) < 0.2:
        parts.append(f"COUNT={r.randint(1, 40)}")
    elif end < 0.4:
        parts.append(f"UNTIL={datetime(2024, 1, 1) + timedelta(days=r.randint(0, 900)):%Y%m%dT%H%M%S}Z")
    return ";".join(parts), datetime(2023, 1, 1, 18) + timedelta(days=r.randint(0, 700), minutes=r.randint(0, 300))


@pytest.mark.parametrize("seed", [1])
def test_random_rules_equal_the_library(spark, seed):
    r = random.Random(seed)
    rules = [random_rule(r) for _ in range(300)] + [(c, datetime(2024, 1, 2, 18)) for c in CORNERS]
    got = expanded(spark, rules)
    wrong = [(rule, start, got[n][:4], plain(rule, start)[:4]) for n, (rule, start) in enumerate(rules) if got[n] != plain(rule, start)]
    assert not wrong, f"{len(wrong)} rules, such as {wrong[:3]}"
    assert sum(bool(x) for x in got.values()) > 150


def test_what_is_not_evaluated_is_a_fault_and_gives_no_rows(spark):
    bad = {
        "FREQ=YEARLY;BYWEEKNO=20": ["part"], "FREQ=DAILY;BYHOUR=9": ["part"], "FREQ=HOURLY": ["frequency"], "FREQ=WEEKLY;BYDAY=1MO": ["ordinal"], "FREQ=MONTHLY;BYMONTHDAY=32": ["number"],
        "FREQ=MONTHLY;BYMONTH=13": ["number"], "FREQ=MONTHLY;BYDAY=0MO": ["weekday"], "FREQ=WEEKLY;WKST=XX": ["weekday"], "FREQ=DAILY;UNTIL=20240230": ["end"], "FREQ=DAILY;UNTIL=soon": ["end"],
        "FREQ=DAILY;COUNT=0": ["end"], "FREQ=DAILY;FREQ=WEEKLY": ["part"], "FREQ=MONTHLY;BYSETPOS=0": ["number"],
    }
    df = spark.createDataFrame([(k,) for k in bad], "rule string")
    assert {r["rule"]: r["faults"] for r in df.select("rule", R.rule_faults(F.col("rule")).alias("faults")).collect()} == bad
    assert not any(expanded(spark, [(rule, datetime(2024, 7, 1)) for rule in bad]).values())


def test_null_starts_and_rules_give_no_rows(spark):
    rows = spark.createDataFrame([(1, None, "FREQ=DAILY"), (2, datetime(2024, 7, 1), None), (3, datetime(2030, 1, 1), "FREQ=DAILY")], "id int, dtstart timestamp_ntz, rule string")
    assert R.expand_rules(rows, "id", LO, HI).count() == 0


def test_overrides_fall_back_to_the_event(spark):
    made = spark.createDataFrame([(1, datetime(2024, 7, 1)), (1, datetime(2024, 7, 8)), (2, datetime(2024, 7, 1))], "id int, recurrence timestamp_ntz")
    over = [(1, datetime(2024, 7, 8), 1, None, "cancelled", None), (1, datetime(2024, 7, 15), 1, datetime(2024, 7, 16), None, "barn"), (2, datetime(2024, 7, 1), 1, None, None, "shed")]
    overrides = spark.createDataFrame(over, "id int, recurrence timestamp_ntz, nth int, replacement timestamp_ntz, status string, location string")
    events = spark.createDataFrame([(1, "postponed", "hall"), (2, "scheduled", None)], "id int, status string, location string")
    got = {(r["id"], r["start"].day): (r["status"], r["location"]) for r in R.apply_overrides(made, overrides, "id", "nth", LO, HI, events).collect()}
    assert got == {(1, 1): ("postponed", "hall"), (1, 8): ("cancelled", "hall"), (1, 16): ("postponed", "barn"), (2, 1): ("scheduled", "shed")}
