"""Operators that SQL can't express, against plain Python; functions on hard cases; queries on empty tables."""

from __future__ import annotations

import html.parser
import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from kalends.functions import text as T
from kalends.operators import calendar as C
from kalends.operators import catalog as K
from kalends.operators import compaction as P
from kalends.operators import duplicates as D
from kalends.operators import ical as I
from kalends.operators import recurrence as R
from kalends.plans import registry
from kalends.sources import files as S

from .conftest import DATA

SF = f"{DATA}/sf0.001"


def column(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def expanded(spark, rule, start, lo, hi, rdates=(), exdates=()):
    row = spark.createDataFrame([(1, start, rule, list(rdates), list(exdates))], "id int, dtstart timestamp_ntz, rule string, rdates array<timestamp_ntz>, exdates array<timestamp_ntz>")
    return sorted(r["recurrence"] for r in R.expand_rules(row, "id", lo, hi).collect())


def test_start_is_an_occurrence_only_if_the_rule_gives_it(spark):
    got = expanded(spark, "FREQ=WEEKLY;BYDAY=TU;COUNT=2", datetime(2026, 1, 5, 19), date(2026, 1, 1), date(2026, 2, 1))
    assert got == [datetime(2026, 1, 6, 19), datetime(2026, 1, 13, 19)]


def test_count_is_from_the_start_and_exceptions_dont_refund_it(spark):
    got = expanded(spark, "FREQ=WEEKLY;COUNT=4", datetime(2026, 1, 5, 19), date(2026, 1, 10), date(2026, 3, 1), exdates=[datetime(2026, 1, 19, 19)], rdates=[datetime(2026, 1, 12, 19)])
    assert got == [datetime(2026, 1, 12, 19), datetime(2026, 1, 26, 19)]


def test_months_without_the_day_are_skipped(spark):
    got = expanded(spark, "FREQ=MONTHLY", datetime(2026, 1, 31), date(2026, 1, 1), date(2026, 5, 31))
    assert [d.month for d in got] == [1, 3, 5]
    assert [d.day for d in expanded(spark, "FREQ=MONTHLY;BYDAY=-1FR", datetime(2026, 1, 1), date(2026, 1, 1), date(2026, 3, 31))] == [30, 27, 27]


def test_until_without_time_leaves_out_that_day(spark):
    assert len(expanded(spark, "FREQ=DAILY;UNTIL=20260103", datetime(2026, 1, 1, 8), date(2026, 1, 1), date(2026, 1, 31))) == 2
    assert len(expanded(spark, "FREQ=DAILY;UNTIL=20260103T080000Z", datetime(2026, 1, 1, 8), date(2026, 1, 1), date(2026, 1, 31))) == 3


def test_a_broken_rule_gives_only_its_extra_dates(spark):
    assert expanded(spark, "FREQ=SECONDLY", datetime(2026, 1, 1), date(2026, 1, 1), date(2026, 1, 9), rdates=[datetime(2026, 1, 4)]) == [datetime(2026, 1, 4)]


def test_interval_keeps_its_phase_however_far_the_window_is(spark):
    got = expanded(spark, "FREQ=WEEKLY;INTERVAL=3;BYDAY=MO", datetime(2020, 1, 6), date(2026, 1, 1), date(2026, 2, 28))
    assert all((d.date() - date(2020, 1, 6)).days % 21 == 0 for d in got)
    assert len(got) in (2, 3)


def test_overrides_move_in_and_out_and_vanish(spark):
    made = spark.createDataFrame([(1, datetime(2026, 1, 5)), (1, datetime(2026, 1, 12))], "id int, recurrence timestamp_ntz")
    rows = [(1, datetime(2026, 1, 5), 1, datetime(2026, 9, 9), None), (1, datetime(2025, 6, 1), 1, datetime(2026, 1, 20), None), (1, datetime(2025, 7, 1), 1, None, "cancelled"), (1, datetime(2026, 1, 12), 1, None, "cancelled"), (1, datetime(2026, 1, 12), 2, None, "postponed")]
    over = spark.createDataFrame(rows, "id int, recurrence timestamp_ntz, nth int, replacement timestamp_ntz, status string")
    got = sorted(tuple(r) for r in R.apply_overrides(made, over, "id", "nth", date(2026, 1, 1), date(2026, 1, 31)).collect())
    assert got == [(1, datetime(2025, 6, 1), datetime(2026, 1, 20), "scheduled"), (1, datetime(2026, 1, 12), datetime(2026, 1, 12), "postponed")]


def test_nearest_matches_are_greedy_and_one_to_one(spark):
    wanted = spark.createDataFrame([(1, 10, date(2026, 1, 5)), (1, 11, date(2026, 1, 8)), (1, 12, date(2026, 3, 1)), (2, 13, date(2026, 1, 5))], "k int, id long, date date")
    offered = spark.createDataFrame([(1, 90, date(2026, 1, 5)), (1, 91, date(2026, 1, 6)), (1, 92, date(2026, 1, 10)), (1, 93, date(2026, 1, 6))], "k int, id long, date date")
    got = {r["wanted_id"]: (r["offered_id"], r["gap"]) for r in D.nearest_matches(wanted, offered, "k").collect()}
    assert got == {10: (90, 0), 11: (91, 2), 12: (None, None), 13: (None, None)}


def test_folded_calendars_read_back(spark):
    rows = registry.QUERIES["ical_document"](spark, SF).limit(40).collect()
    for r in rows:
        assert r["calendar"].endswith("END:VCALENDAR\r\n")
        assert all(len(line.encode()) <= 75 for line in r["calendar"].split("\r\n"))
        assert r["calendar"].replace("\r\n ", "").count("BEGIN:VEVENT") + r["calendar"].count("X-KALENDS-EMPTY") > 0


def test_folding_never_splits_a_character(spark):
    lines = ["æ" * 60, "x" * 75, "x" * 76, "", "a" + "漢" * 50]
    for line, out in zip(lines, column(spark, I.folded, *lines), strict=True):
        assert out.replace("\r\n ", "") == line
        assert all(len(p.encode()) <= 75 for p in out.split("\r\n"))


def test_uuids_are_those_of_the_library(spark):
    names = ["occurrence:1", "æøå", ""]
    assert column(spark, I.uuid5, *names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_fnv_is_that_of_plain_python(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out or "0"

    texts = ["small ring", "", "Ærø", "a" * 100]
    assert column(spark, T.fnv36, *texts) == [plain(t) for t in texts]


def test_html_text_holds_a_parsers_words(spark):
    class Words(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head", "template", "noscript")
            self.out.append(" " if tag in ("br", "p", "div", "li", "h1", "h2", "h3", "tr", "td") else "")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head", "template", "noscript")
            self.out.append(" " if tag in ("p", "div", "li", "h1", "h2", "h3", "tr", "td", "title") else "")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(30).collect()}
    got = {r["page_id"]: r["text"] for r in registry.QUERIES["html_text"](spark, SF).collect()}
    for i, page in pages.items():
        p = Words()
        p.feed(page)
        expected = set("".join(p.out).split())
        assert len(expected & set(got[i].split())) >= 0.95 * len(expected)
        assert "<p" not in got[i]


def test_safe_ids_end_well(spark):
    ids = column(spark, T.safe_id, "x" * 71 + "- long" + "y" * 30, "a" * 70 + " " + "b" * 40, "!!!", "Ærlig Å")
    assert "--" not in ids[1]
    assert all(i is None or len(i) <= 80 for i in ids)
    assert ids[2] is None
    assert ids[3] == "rlig-a"


def test_carriage_returns_are_escaped(spark):
    assert column(spark, T.ical_escape, "a\rb\r\nc;d,e\\f") == ["a\\nb\\nc\\;d\\,e\\\\f"]


def test_spec_and_parameters(spark):
    p = {"q": "x", "from": "2024-02-30", "to": "2024-03-01", "view": "odd", "month": "2024-05"}
    spec = C.QuerySpec.from_parameters(p, ("2024-04", "2024-05"))
    assert (spec.start, spec.end, spec.view, spec.month) == (None, date(2024, 3, 1), "agenda", "2024-05")
    assert C.QuerySpec.from_parameters({}, ()).to_parameters() == {}


def test_modes_take_the_earliest_of_equal_ones(spark):
    row = spark.createDataFrame([([3, 2, 2, 3, 1], [4, 6, 10])], "a array<int>, b array<int>")
    assert tuple(row.select(P.modal_first(F.col("a")), P.array_gcd(F.col("b"))).first()) == (3, 2)


def test_places_of_a_hot_group_are_gapless(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("g"), "id")
    rows = K.numbered(df, "g", "id", "place").collect()
    for g in ("hot", "cold"):
        mine = sorted((r["id"], r["place"]) for r in rows if r["g"] == g)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))


def test_files_that_cant_be_read_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1}')
    (tmp_path / "b.yaml").write_text("n: 2\n")
    (tmp_path / "c.json").write_text("{broken")
    rows = S.structured_files(spark, str(tmp_path), "n int").collect()
    assert [r["value"]["n"] if r["value"] else None for r in rows] == [1, 2, None]
    assert "c.json" in rows[2]["error"]
    assert S.structured_files(spark, str(tmp_path / "none"), "n int").count() == 0


def test_findings_report(spark):
    df = spark.createDataFrame([(i, "x") for i in range(25)], "id int, fault string")
    text, code = S.findings(df, "id")
    assert code == 1
    assert text.splitlines()[0] == "25 findings"
    assert text.splitlines()[-1] == "and 5 more"


def test_streamed_reminders_are_those_that_a_replay_shows(spark):
    """Each id's last change that isn't cancelled, once its time to notify is past by the end."""
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    got = {r["id"] for r in registry.QUERIES["streaming_reminders"](spark, SF).collect()}
    last = {}
    for e in sorted(events, key=lambda e: e["ts"]):
        last[f"u{e['event_id'] % 2000}"] = e
    end = max(e["ts"] for e in events)
    due = {i for i, e in last.items() if e["event_type"] != "error" and (end - e["ts"]).total_seconds() > 30 * 3600 + 3600}
    assert due <= got
    assert len(got) <= len(last)


def test_canonical_texts_are_pythons_sorted_json(spark):
    import json

    values = [{"b": [{"z": 1, "a": {"y": "æ", "x": None}}, [], {}], "a": {"c": True, "b": [3, 2, 1]}}, [1, [2, {"k": "v\n\"q\""}]], "text", 5, {}]
    got = column(spark, T.canonical_text, *[json.dumps(v) for v in values], "{broken", None)
    assert got[:-2] == [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]
    assert got[-2:] == [None, None]


def test_linked_data_of_odd_texts(spark):
    deep = '{"@graph":' * 20 + '{"@type":"Event","name":"deep"}' + "}" * 20
    texts = [None, "", "{broken", "[]", "5", '"Event"', '{"@type":["A","Event"],"name":7}', deep]
    got = column(spark, lambda c: F.transform(T.linked_data(c, "Event", ("name",)), lambda o: o["name"]), *texts)
    assert got == [[], [], [], [], [], [], ["7"], ["deep"]]


def test_nearest_matches_equal_a_plain_greedy_pass(spark):
    import random

    r = random.Random(7)
    day = lambda: None if r.random() < 0.03 else date.fromordinal(date(2024, 1, 1).toordinal() + r.randrange(420))
    mine, theirs = ([(r.choice([1, 1, 1, 2, None]), base + i, day()) for i in range(n)] for base, n in ((0, 400), (10_000, 350)))
    schema = "k int, id long, date date"
    got = {x["wanted_id"]: (x["offered_id"], x["gap"]) for x in D.nearest_matches(spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema), "k").collect()}
    expected = {i: (None, None) for _, i, _ in mine}
    for k in (1, 2):
        for year in (2024, 2025):
            w = sorted((d, i) for kk, i, d in mine if kk == k and d and d.year == year)
            free = sorted((d, i) for kk, i, d in theirs if kk == k and d and d.year == year)
            rest = []
            for d, i in w:
                same = [o for o in free if o[0] == d]
                if same:
                    free.remove(same[0])
                    expected[i] = (same[0][1], 0)
                else:
                    rest.append((d, i))
            for d, i in rest:
                near = [(abs((o[0] - d).days), o) for o in free if abs((o[0] - d).days) <= 14]
                if near:
                    gap, o = min(near)
                    free.remove(o)
                    expected[i] = (o[1], gap)
    assert got == expected
    assert sum(g is not None and g > 0 for _, g in got.values()) > 30


def test_similar_titles_are_found_without_scoring_all_pairs(spark):
    import random

    from kalends.functions.similarity import title_similarity

    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(3, 8))) for _ in range(300)]
    titles = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(200)]
    titles += [t + " extra" for t in titles[:20]] + [t.replace("a", "e") for t in titles[20:40]] + ["", "a", "ab", titles[3][:-1]]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    similar, candidates = D.similar_texts(df, "t", 0.6)
    known = df.distinct()
    pairs = known.alias("a").join(known.alias("b"), F.expr("a.t < b.t and a.t <> '' and b.t <> ''")).select(F.col("a.t").alias("x"), F.col("b.t").alias("y"), title_similarity(F.col("a.t"), F.col("b.t")).alias("s"))
    expected = {(p["x"], p["y"]): round(p["s"], 9) for p in pairs.where("s >= 0.6").collect()}
    assert {(p["x"], p["y"]): round(p["s"], 9) for p in similar.collect()} == expected
    assert len(expected) > 30
    assert candidates.count() < 0.35 * pairs.count()


def test_lines_without_colon_of_any_length(spark):
    df = spark.createDataFrame([("x" * 50_000 + "\n" + 'A;P="q:' + "y" * 20_000 + '":v\nB:' + "z" * 10,)], "t string")
    assert [(r["name"], r["parameters"][:4], r["value"]) for r in I.content_lines(df, "t").where("name <> ''").collect()] == [("A", 'P="q', "v"), ("B", "", "zzzzzzzzzz")]


def test_null_scopes_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None, "f", True), (2, None, "f", True), (3, "s", None, True), (4, "s", "g", True)], "id int, scope string, fp string, ok boolean")
    got = {r["id"]: r["demoted"] for r in D.semantic_guard(df, "scope", F.col("fp"), "id", "ok").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_specs_of_links_follow_the_rules_of_single_ones(spark):
    from urllib.parse import parse_qsl, urlsplit

    months = ("2024-04", "2024-05")
    links = [None, "", "https://x.org/", "?q=", "?q=a%20b&q=c+d&organizer=%C3%A6", "?from=2024-02-30&to=2024-03-01&view=odd&month=2024-05", "?view=month&month=1999-01#month=2024-05", "?q=%zz&category=x=y&&=z"]
    column_months = F.array(*[F.lit(m) for m in months])
    rows = spark.createDataFrame([(x,) for x in links], "link string").select("link", C.spec_of_link(F.col("link"), column_months).alias("s"))
    for r in rows.select("*", C.link_of_spec(F.col("s"), column_months).alias("again")).collect():
        if r["link"] and "%zz" in r["link"]:
            assert (r["s"]["text"], r["s"]["category"]) == ("", "x=y")
            continue
        plain = C.QuerySpec.from_parameters(dict(parse_qsl(urlsplit(r["link"] or "").query)), months)
        assert tuple(r["s"]) == (plain.text, plain.organizer, plain.category, plain.start, plain.end, plain.view, plain.month)
        assert dict(parse_qsl(r["again"])) == plain.to_parameters()


def test_scored_pairs_of_blocks_are_all_pairs(spark):
    """Ids of one text fall into several blocks; null and blank texts, null keys and repeated ids as in a plain join."""
    from pyspark.sql import functions as F

    from kalends.functions.similarity import title_similarity
    from kalends.operators.duplicates import scored_pairs

    rows = [(n, "ab"[n % 2] if n % 11 else None, [None, "", "red ring", "red ring big", "blue bolt"][n % 5]) for n in range(60)] + [(7, "b", "red ring"), (None, "a", "red ring")]
    df = spark.createDataFrame(rows, "id int, g string, t string")
    one, two = (df.select("g", F.col("id").alias(f"id_{x}"), F.col("t").alias(f"t{x}")) for x in "ab")
    plain = one.join(two, "g").where("id_a < id_b").select("id_a", "id_b", title_similarity(F.least("ta", "tb"), F.greatest("ta", "tb")).alias("s"), F.col("ta").isNull() | F.col("tb").isNull())
    expected = sorted((r[0], r[1], -1.0 if r[3] else round(r[2], 6)) for r in plain.collect())
    got = sorted((r[0], r[1], -1.0 if r[2] is None else round(r[2], 6)) for r in scored_pairs(df, ["g"], "id", "t", "s", block=2).collect())
    assert got == expected and len(got) > 700


def test_pairs_of_titles_are_not_shuffled(spark):
    """All shuffles are below the join at which pairs first meet, and each title is rounded as one of a pair of blocks."""
    plan = registry.QUERIES["title_similarity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[:plan.index("SortMergeJoin")]
    assert "round(" not in plan[:plan.index("Generate")]
    df = spark.createDataFrame([(n, "a", f"red ring {n % 7}") for n in range(70)], "id int, g string, t string")
    for block, shares in ((3, 1), (1000, 8), (4, 3)):
        got = [tuple(r) for r in D.scored_pairs(df, ["g"], "id", "t", "s", block=block, shares=shares).select("id_a", "id_b").collect()]
        assert len(got) == 70 * 69 // 2 and set(got) == {(a, b) for b in range(70) for a in range(b)}


def test_titles_of_one_brand_are_compared_whatever_their_sizes(spark, tmp_path):
    import duckdb

    rows = [(n, ["red ring", "red bolt", "blue plate", None][n % 4], f"Brand#{n % 2}", ["SMALL", "LARGE"][n % 3 % 2], n % 5 or None) for n in range(24)] + [(30, "red ring", None, "SMALL", 1), (31, "red ring", None, "SMALL", 1)]
    path = str(tmp_path / "part.parquet")
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(path)
    got = sorted(tuple(r) for r in registry.QUERIES["title_similarity"](spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(registry.ORACLES["title_similarity"].replace("from part", f"from read_parquet('{path}/*.parquet')")).fetchall())
    assert [r[:2] for r in got] == [(a, b) for a in range(24) for b in range(a + 2, 24, 2)]
    assert (0, 12, 1.0) in got and (1, 3, 0.0) in got


def test_pairs_of_events_are_not_shuffled(spark):
    """Shared dates are put together where a pair meets; only events whose title or start changes have several rows a pair."""
    plan = registry.QUERIES["duplicate_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    alone = plan[plan.index("Union"):]
    assert "Exchange" not in plan[:plan.index("Union")] and "Exchange" not in alone[:alone.index("ShuffledHashJoin")]
    day = lambda n: date(2024, 1, n)
    rows = [(k, k, "red ring night", "Hall", "timed", 600, day(n)) for k in (1, 2, 10) for n in (1, 8)]
    rows += [(3, 3, "red ring night", "hall", "timed", 610, day(8)), (3, 3, "red ring nights", None, "unknown", None, day(1)), (4, 3, "red ring night", "Halls", "all-day", 0, day(1))]
    rows += [(5, 5, "red ring night", "Pub", "timed", 600, day(1)), (None, 6, "red ring night", None, "timed", 600, day(1)), (7, None, "red ring night", None, "timed", 600, day(1))]
    df = spark.createDataFrame(rows, "id int, event int, title string, venue string, kind string, minutes int, date date")
    got = {(r["left_id"], r["right_id"]): [x.day for x in r["shared"]] for r in D.duplicate_pairs(df, "id", "event").collect()}
    assert got == {("1", "10"): [1, 8], ("1", "2"): [1, 8], ("10", "2"): [1, 8], ("1", "3"): [1, 8], ("10", "3"): [1, 8], ("2", "3"): [1, 8]} | {(x, "5"): [1] for x in ("1", "10", "2", "3")}


def test_new_events_of_categories_meet_in_shares(spark):
    """Repeated subscriptions share what they know, one without user knows nothing, and no pair is shuffled to be compared."""
    from kalends.operators import reminders as N

    subs = spark.createDataFrame([(1, "a", [10, None]), (1, "a", [11]), (2, "a", []), (None, "a", [10]), (3, None, []), (4, "b", None)], "user int, category string, known array<int>")
    events = spark.createDataFrame([(10, ["a", "b"]), (11, ["a"]), (12, ["a", "a"]), (None, ["a"])], "event int, categories array<string>")
    found = N.new_in_category(subs, events)
    expected = [(1, e) for e in (12, 12, None, None)] + [(2, e) for e in (10, 11, 12, None)] + [(None, e) for e in (10, 11, 12, None)] + [(4, 10)]
    order = lambda rows: sorted(rows, key=str)
    assert order((r["user"], r["event"]) for r in found.collect()) == order(expected)
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["user"]: r["known"] for r in N.merge_known(subs.where("user in (2, 4)"), events.where("event is not null")).collect()} == {2: [10, 11, 12], 4: None}


def test_new_events_take_little_space_in_files(spark, tmp_path):
    """A block of events comes again for each user; were all events of one user to follow each other, a row would take two bytes or more."""
    from kalends.operators import reminders as N

    subs = spark.range(1600).selectExpr("id as user", "'a' as category", "array(id, 3 * id) as known")
    events = spark.range(20_000).selectExpr("id * 7919 as event", "array('a') as categories")
    N.new_in_category(subs, events).coalesce(2).write.parquet(str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 1600 * 20_000 - 1
    assert sum(f.stat().st_size for f in (tmp_path / "new").glob("*.parquet")) < 1600 * 20_000


def test_long_entries_are_not_shuffled_and_are_read_back_within_the_row(spark):
    plan = lambda name: registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    document = plan("ical_document")
    # nothing is dealt out above the step that makes calendars of entries
    assert "Exchange" not in document[document.index("ObjectHashAggregate"):document.index("SortMergeJoin", document.index("ObjectHashAggregate"))]
    assert "Window" not in plan("ical_read_back")
