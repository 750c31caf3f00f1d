"""Captures in levels: nulls, repeated items, other tenants' items, empty tables; the report as a table."""

from __future__ import annotations

from datetime import date

from kalends.operators import levels as L
from kalends.sources import files as S

CALENDAR, LIST, DETAIL = "tenant int, month string, item int, day date", "tenant int, day date, item int", "tenant int, item int, day date"


def test_levels(spark):
    d = date(2024, 1, 5)
    calendars = spark.createDataFrame([(1, "2024-01", 1, d), (1, "2024-01", 1, d), (1, "2024-02", 2, d), (2, "2024-01", 3, d), (3, "2024-01", 4, d), (None, "2024-01", 5, d), (4, "2024-01", 6, None), (5, "2024-01", 7, d)], CALENDAR)
    days = spark.createDataFrame([(1, d, 1), (1, d, 1), (1, d, 2), (1, d, 99), (3, d, 4), (5, d, 7)], LIST)
    details = spark.createDataFrame([(1, 1, d), (1, 1, d), (1, 2, d), (3, 4, date(2024, 1, 6)), (5, 7, d), (5, 98, d)], DETAIL)
    faults = L.level_faults(calendars, days, details)
    assert sorted(map(tuple, faults.collect())) == [(1, 2, "month"), (2, 3, "day list"), (3, 4, "moved"), (4, 6, "day list"), (4, 6, "month")]
    found, runs = L.levelled_capture(calendars, details, faults)
    assert [(r["tenant"], r["item"]) for r in found.collect()] == [(5, 7)]
    assert sorted(map(tuple, runs.collect())) == [(1, "partial", 2, 1, 2), (2, "partial", 1, 1, 0), (3, "partial", 1, 1, 1), (4, "partial", 1, 2, 0), (5, "complete", 1, 0, 0)]
    none = calendars.where("false"), days.where("false"), details.where("false")
    assert L.level_faults(*none).count() == 0


def test_a_report_says_what_the_text_says(spark):
    for n in (0, 3, 25):
        df = spark.createDataFrame([(i, "x") for i in range(n)], "id int, fault string")
        assert "\n".join(r["line"] for r in S.report(df, "id").orderBy("place").collect()) == S.findings(df, "id")[0]
