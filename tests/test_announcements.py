"""Announcements: contexts of dates, relative dates, times of their own and for all, titles and places."""

from __future__ import annotations

from datetime import date

from kalends.operators import announcements as A

SUNDAY = date(2024, 3, 10)


def read(spark, *texts, anchor=SUNDAY):
    df = spark.createDataFrame([(n, t, anchor) for n, t in enumerate(texts)], "id int, text string, day date")
    rows = {r["id"]: r for r in A.announcements(df, "id", "text", "day").collect()}
    return [rows[n] for n in range(len(texts))]


def times(row):
    return [(str(o["date"])[5:], o["start"], o["end"]) for o in row["occurrences"]]


def test_each_date_has_its_own_time_or_the_one_for_all(spark):
    own, shared, before, doors, aside, several = read(
        spark, "Koncert 5. april kl. 19.30-21 og 12. april kl. 20", "Foredrag 5. april og 12. april. Vi mødes alle gange kl. 18.15", "Fest kl. 14 den 5/4", "Koncert 5. april, dørene åbner kl. 18",
        "Marked 5. april. Billetsalg fra kl. 10", "Fest 5. april, middag kl. 18, dans kl. 21",
    )
    assert times(own) == [("04-05", "19:30", "21:00"), ("04-12", "20:00", None)]
    assert times(shared) == [("04-05", "18:15", None), ("04-12", "18:15", None)]
    assert times(before) == [("04-05", "14:00", None)]
    assert times(doors) == times(aside) == times(several) == [("04-05", None, None)]


def test_relative_dates_need_the_day_of_the_post(spark):
    today, tomorrow, sunday, tuesday = read(spark, "Fest i dag", "Fest i morgen kl. 15", "Møde på søndag", "Møde på tirsdag kl. 9.05")
    assert [times(r) for r in (today, tomorrow, sunday, tuesday)] == [[("03-10", None, None)], [("03-11", "15:00", None)], [("03-17", None, None)], [("03-12", "09:05", None)]]
    assert read(spark, "Fest i dag", anchor=None)[0]["errors"] == ["no-anchor", "no-date"]
    assert times(read(spark, "Fest 5. april, køb billet i dag")[0]) == [("04-05", None, None)]


def test_contexts_leave_dates_out(spark):
    part, moved, deadline = read(
        spark, "Koncert 5. april kl. 20\nDette arrangement er en del af musikugen, som finder sted 1. april", "Koncert flyttet fra 5. april til 12. april kl. 20, den er ikke aflyst", "Fest 5. april. Tilmelding senest fredag den 29. marts kl. 12",
    )
    assert times(part) == [("04-05", "20:00", None)]
    assert times(moved) == [("04-12", "20:00", None)]
    assert moved["status"] == "scheduled"
    assert times(deadline) == [("04-05", None, None)]


def test_titles_places_and_whole_days(spark):
    header, label, day, tag, long = read(
        spark, "🎵 Sommerkoncert lørdag den\n6. april\nkl. 19\nByens Kulturhus\nAlle er velkomne", "Fest\n5. april\nMødested: Havnen 3\nkl. 12", "Marked 6. april hele dagen", "#byen\nkl. 14 lørdag\nForedrag om mågen! Kom alle\n6. april", "Koncert " + "ord " * 100 + "\n6. april",
    )
    assert (header["title"], header["location"]) == ("Sommerkoncert", "Byens Kulturhus")
    assert label["location"] == "Havnen 3"
    assert day["all_day"]
    assert tag["title"] == "Foredrag om mågen!"
    assert len(long["title"]) <= 180
    assert long["title"].endswith("…")


def test_null_blank_and_too_long_texts_do_not_pass(spark):
    null, blank, long, none = read(spark, None, "  ", "Fest 5. april " + "x " * 20_000, "Fest")
    assert null["errors"] == blank["errors"] == ["no-text", "no-signal", "no-date"]
    assert long["errors"] == ["too-long", "no-date"]
    assert none["errors"] == ["no-date"]


def test_spans_tell_where_dates_stand(spark):
    text = "Fest 2024-05-01, møde 3.-4. juni og marked 7/8"
    df = spark.createDataFrame([(text, SUNDAY)], "text string, day date")
    spans = df.select(A.date_spans(df["text"], df["day"]).alias("s")).first()["s"]
    assert [text[s["at"] - 1 : s["upto"]] for s in spans] == ["2024-05-01", "3.-4. juni", "7/8"]
    assert [len(s["dates"]) for s in spans] == [1, 2, 1]


def test_a_filter_on_occurrences_does_not_write_their_making_out_again(spark):
    """Each row for itself: an explode's own filter made the plan so long that 15,000 posts took over a minute."""
    df = spark.createDataFrame([(n, f"Koncert {n + 1}. april kl. 19, igen 28. april kl. 20", SUNDAY) for n in range(20)] + [(20, "Koncert", SUNDAY), (21, None, SUNDAY)], "id int, text string, day date")
    found = A.announced(A.announcements(df, "id", "text", "day"), "id")
    rows = sorted((r["id"], str(r["date"])[5:], r["start"]) for r in found.collect())
    assert rows == sorted([(n, f"04-{n + 1:02}", "19:00") for n in range(20)] + [(n, "04-28", "20:00") for n in range(20)])
    whole = found._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("regexp_extract_all") <= 8  # 36 with a plain explode
    assert found.rdd.getNumPartitions() >= 4


def test_marks_of_cuts_in_a_text_are_no_dates(spark):
    assert times(read(spark, "Koncert ￿ den 5. april kl. 19, ￿ og 12. april kl. 20. Tilmelding senest 1. april kl. 8")[0]) == [("04-05", "19:00", None), ("04-12", "20:00", None)]
