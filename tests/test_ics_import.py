"""Series out of iCalendar texts: linking, clocks, exceptions, overrides, and faults."""

from __future__ import annotations

from datetime import date, datetime

from kalends.operators import ical as I
from kalends.operators import ics_import as S

ZONE = "Europe/Copenhagen"


def calendar(*events):
    return "\r\n".join(["BEGIN:VCALENDAR", *[line for e in events for line in ("BEGIN:VEVENT", *e, "END:VEVENT")], "END:VCALENDAR"]) + "\r\n"


def series_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    return S.ics_series(S.ics_events(I.content_lines(df, "text", "file"), ZONE, "file"), ZONE, "file")


def occurrences(spark, text, start=date(2024, 3, 1), end=date(2024, 4, 30)):
    rows = S.ics_occurrences(series_of(spark, text), ZONE, start, end, "file").collect()
    return sorted((r["uid"], r["start"], r["end"], r["status"]) for r in rows)


def test_a_local_rule_keeps_its_hour_and_a_rule_in_utc_moves_with_the_clocks(spark):
    local = ["UID:l", "DTSTART;TZID=Europe/Copenhagen:20240325T180000", "DTEND;TZID=Europe/Copenhagen:20240325T193000", "RRULE:FREQ=WEEKLY;BYDAY=MO;UNTIL=20240408T160000Z"]
    utc = ["UID:u", "DTSTART:20240325T170000Z", "DTEND:20240325T183000Z", "RRULE:FREQ=WEEKLY;BYDAY=MO;UNTIL=20240408T170000Z"]
    got = occurrences(spark, calendar(local, utc))
    # clocks go forward on 31 March: 18:00 in the zone is 16:00 in UTC from then on
    assert [r[1] for r in got if r[0] == "l"] == [datetime(2024, 3, 25, 18), datetime(2024, 4, 1, 18), datetime(2024, 4, 8, 18)]
    assert [r[1] for r in got if r[0] == "u"] == [datetime(2024, 3, 25, 18), datetime(2024, 4, 1, 19), datetime(2024, 4, 8, 19)]
    assert all((r[2] - r[1]).total_seconds() == 5400 for r in got)


def test_exceptions_extra_dates_and_overrides_across_clocks(spark):
    master = ["UID:a", "SUMMARY:Sail\\, race", "DTSTART;TZID=Europe/Copenhagen:20240304T180000", "DTEND;TZID=Europe/Copenhagen:20240304T190000", "RRULE:FREQ=WEEKLY;COUNT=4",
              "EXDATE:20240311T170000Z,20240318T170000Z", "RDATE;TZID=Europe/Copenhagen:20240320T180000", "BEGIN:VALARM", "DTSTART:19700101T000000Z", "END:VALARM"]
    moved = ["UID:a", "RECURRENCE-ID:20240325T170000Z", "DTSTART;TZID=Europe/Copenhagen:20240326T200000", "DTEND;TZID=Europe/Copenhagen:20240326T210000", "STATUS:TENTATIVE"]
    got = occurrences(spark, calendar(moved, master))
    assert [(r[1], r[3]) for r in got] == [(datetime(2024, 3, 4, 18), "confirmed"), (datetime(2024, 3, 20, 18), "confirmed"), (datetime(2024, 3, 26, 20), "tentative")]


def test_whole_days_and_single_events(spark):
    days = ["UID:d", "DTSTART;VALUE=DATE:20240310", "DTEND;VALUE=DATE:20240312", "RRULE:FREQ=MONTHLY;UNTIL=20240410", "EXDATE;VALUE=DATE:20240510"]
    one = ["UID:o", "DTSTART:20240301T230000Z", "DTEND:20240301T233000Z"]
    got = occurrences(spark, calendar(days, one))
    assert got == [("d", datetime(2024, 3, 10), datetime(2024, 3, 11), "confirmed"), ("d", datetime(2024, 4, 10), datetime(2024, 4, 11), "confirmed"), ("o", datetime(2024, 3, 2), datetime(2024, 3, 2, 0, 30), "confirmed")]


def test_what_is_unclear_is_a_fault_of_its_uid_alone(spark):
    good = ["UID:good", "DTSTART:20240301T120000Z", "DTEND:20240301T130000Z"]
    bad = {
        "floating": ["DTSTART:20240301T120000", "DTEND:20240301T130000"], "other": ["DTSTART;TZID=America/New_York:20240301T120000", "DTEND:20240301T130000Z"], "seconds": ["DTSTART:20240301T120030Z", "DTEND:20240301T130000Z"],
        "noday": ["DTSTART;VALUE=DATE:20240230", "DTEND;VALUE=DATE:20240301"], "order": ["DTSTART:20240301T120000Z", "DTEND:20240301T110000Z"], "kinds": ["DTSTART;VALUE=DATE:20240301", "DTEND:20240301T110000Z"],
        "rule": ["DTSTART:20240301T120000Z", "DTEND:20240301T130000Z", "RRULE:FREQ=HOURLY"], "off": ["DTSTART:20240301T120000Z", "DTEND:20240301T130000Z", "RRULE:FREQ=WEEKLY;BYDAY=MO"],
        "late": ["DTSTART:20240301T120000Z", "DTEND:20240301T130000Z", "RRULE:FREQ=DAILY;UNTIL=20240201T000000Z"], "list": ["DTSTART:20240301T120000Z", "DTEND:20240301T130000Z", "EXDATE;VALUE=DATE:20240302"],
        "orphan": ["RECURRENCE-ID:20240301T120000Z", "DTSTART:20240301T120000Z", "DTEND:20240301T130000Z"], "twice": ["DTSTART:20240301T120000Z", "DTSTART:20240302T120000Z", "DTEND:20240301T130000Z"],
    }
    text = calendar(good, *[[f"UID:{u}", *lines] for u, lines in bad.items()], ["UID:same", *good[1:]], ["UID:same", *good[1:]])
    faults = {r["uid"]: r["faults"] for r in series_of(spark, text).collect()}
    expected = {"good": [], "floating": ["start-time", "end-time"], "other": ["start-time"], "seconds": ["start-time"], "noday": ["start-time"], "order": ["order"], "kinds": ["kinds"], "rule": ["rule-frequency"],
                "off": ["start-off-rule"], "late": ["until-before-start"], "list": ["list-kind"], "orphan": ["no-series"], "twice": ["DTSTART-twice"], "same": ["UID-twice"]}
    assert faults == expected
    assert {r[0] for r in occurrences(spark, text)} == {"good"}


def test_null_empty_and_very_long_texts(spark):
    long = calendar(["UID:x", "DTSTART:20240301T120000Z", "DTEND:20240301T130000Z", "DESCRIPTION:" + "ab " * 50_000, "X" * 60_000])
    got = {r["file"]: r["uid"] for r in series_of(spark, None, "", "no calendar", long).collect()}
    assert got == {3: "x"}


def test_texts_are_read_once_and_no_line_is_shuffled(spark):
    df = spark.createDataFrame([(0, calendar(["UID:a", "DTSTART:20240301T120000Z", "DTEND:20240301T130000Z"]))], "file int, text string")
    series = S.ics_series(S.timed_events(I.text_events(df, "text", "file"), ZONE, "file"), ZONE, "file")
    plan = S.ics_occurrences(series, ZONE, date(2024, 3, 1), date(2024, 3, 31), "file")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1
    assert "Window" not in plan
    assert "Join" not in plan


def test_whole_texts_and_their_lines_give_the_same_events(spark):
    odd = ["BEGIN:VEVENT\nUID:1\nBEGIN:VALARM\nUID:no\nBEGIN:X\nA:1\nEND:X\nEND:VALARM\nSUMMARY:a\\, b\r\n \tc\r\nEND:VEVENT\nUID:outside", "END:VEVENT\nbegin;X=\"a:b\":vevent\nuid:2\nUID:later\nBEGIN:VEVENT\nno colon\nUID;P=\"x:y\";Q=1:3\n\n\tfold\nEND:VEVENT\nBEGIN:VTODO\nUID:todo\nEND:VTODO",
           "BEGIN:VEV\r\n ENT\r\nUID:4\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:5", None, ""]
    df = spark.createDataFrame(list(enumerate(odd)), "file int, text string")
    rows = lambda e: sorted((r["file"], r["entry"], [tuple(x) for x in r["lines"]]) for r in e.collect())
    got = rows(I.text_events(df, "text", "file"))
    assert got == rows(I.line_events(I.content_lines(df, "text", "file"), "file"))
    assert [(f, e, [x[2] for x in lines]) for f, e, lines in got] == [(0, 1, ["1", "a\\, b\tc"]), (1, 1, ["2", "later"]), (1, 2, ["o colon", "3", "old"]), (2, 1, ["4"]), (2, 3, ["5"])]


def test_overrides_within_the_row_are_those_of_the_join(spark):
    from pyspark.sql import functions as F

    from kalends.operators import recurrence as R

    day = lambda n: datetime(2024, 3, n, 18)
    over = [(day(2), None, "cancelled", 1), (day(2), day(9), "tentative", 7), (day(3), datetime(2024, 5, 1), None, 2), (day(4), None, None, 3), (day(20), day(21), None, 4), (day(22), None, "cancelled", 5)]
    row = spark.createDataFrame([(1, [day(n) for n in (5, 1, 2, 3, 4)], over), (2, [day(1)], [])], "id int, times array<timestamp_ntz>, over array<struct<recurrence: timestamp_ntz, replacement: timestamp_ntz, status: string, nth: bigint>>")
    lo, hi = date(2024, 3, 1), date(2024, 3, 31)
    got = row.select("id", F.inline(R.overridden(F.col("times"), F.col("over"), lo, hi)))
    joined = R.apply_overrides(row.select("id", F.explode("times").alias("recurrence")), row.select("id", F.inline("over")), "id", "nth", lo, hi)
    plain = lambda rows: sorted((r["id"], r["recurrence"], r["start"], r["status"] or "scheduled") for r in rows.collect())
    assert plain(got) == plain(joined)
    assert len(plain(got)) == 6


def test_calendars_by_rows_are_those_made_as_values_and_are_read_by_blocks(spark, tmp_path):
    from kalends.sources import files as S2

    names = spark.createDataFrame([("a", "A, b"), ("b", "B"), ("none", "N")], "k string, name string")
    long = "SUMMARY:" + "æ b" * 60
    entries = spark.createDataFrame([(k, f"2024{n % 7}", n, ["BEGIN:VEVENT", f"UID:{n}", long, "END:VEVENT"]) for k in "ab" for n in range(300)], "k string, start_key string, occurrence int, lines array<string>")
    S2.write_calendar_rows(I.calendar_rows(names, entries, "k"), str(tmp_path / "c"), "k")
    wanted = {r["k"]: r["calendar"] for r in I.calendars(names, entries, "k").collect()}
    got = {p.parent.name[2:]: p.read_bytes().decode() for p in (tmp_path / "c").rglob("*.txt")}
    assert got == wanted
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = [(r["entry"], r["properties"]["UID"], r["properties"]["SUMMARY"]) for r in I.properties(S2.calendar_events(spark, str(tmp_path / "c")), "file").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    order = sorted(range(300), key=lambda n: (n % 7, n))
    assert sorted(found) == sorted((i + 1, str(n), long[8:]) for i, n in enumerate(order) for _ in "ab")
