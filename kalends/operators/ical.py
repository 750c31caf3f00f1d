"""iCalendar: lines of occurrences as columns, whole calendars per key, folding, and reading calendars back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalends.functions.similarity import bind
from kalends.functions.text import ical_escape, missing_if_blank

#: RFC 9562's namespace for names that are URLs (fixed value).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Octets of a content line, and of its continuations beside their leading space (fixed values of RFC 5545).
LINE_OCTETS = 75


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a text: stable, so that a calendar's entries keep their ids from one build to the next."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def uri_text(c: Column) -> Column:
    """A URI without what would end its line."""
    return F.regexp_replace(c, "[\\r\\n\\u0000]", "")


def utc_stamp(utc: Column) -> Column:
    return F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'")


def location_text(name: Column, address: Column, postcode: Column, city: Column) -> Column:
    """Name, address and place by commas; null if all are blank."""
    place = missing_if_blank(F.concat_ws(" ", missing_if_blank(postcode), missing_if_blank(city)))
    return missing_if_blank(F.concat_ws(", ", missing_if_blank(name), missing_if_blank(address), place))


def description_text(*parts: Column) -> Column:
    """The parts that aren't blank, with blank lines between; null if there is none."""
    return missing_if_blank(F.concat_ws("\n\n", *(missing_if_blank(p) for p in parts)))


def event_lines(key: Column, stamp: Column, date: Column, end_date: Column, start_utc: Column, end_utc: Column, title: Column, description: Column, location: Column, contact: Column, categories: Column, url: Column, status: Column, modified: Column) -> Column:
    """A VEVENT's unfolded lines, as an array.

    Without a start it is a whole day: DTEND is the day after the inclusive last one, and a missing time is marked. A
    timed end that isn't after the start is left out. Postponed entries are tentative and marked.
    """
    timed = start_utc.isNotNull()
    day = lambda d: F.date_format(d, "yyyyMMdd")
    text = lambda name, c: F.concat(F.lit(f"{name};LANGUAGE=da:"), ical_escape(c))
    names = F.array_join(F.transform(categories, ical_escape), ",")
    state = F.when(status == "cancelled", "CANCELLED").when(status == "postponed", "TENTATIVE").otherwise("CONFIRMED")
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uuid5(F.concat(F.lit("occurrence:"), key))), F.concat(F.lit("DTSTAMP:"), utc_stamp(stamp)), F.concat(F.lit("LAST-MODIFIED:"), utc_stamp(modified)),
        F.when(timed, F.concat(F.lit("DTSTART:"), utc_stamp(start_utc))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), day(date))),
        F.when(~timed, F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add(F.coalesce(end_date, date), 1)))).when(end_utc > start_utc, F.concat(F.lit("DTEND:"), utc_stamp(end_utc))),
        text("SUMMARY", title), text("DESCRIPTION", description), text("LOCATION", location), text("CONTACT", contact), F.when(F.size(categories) > 0, F.concat(F.lit("CATEGORIES;LANGUAGE=da:"), names)),
        F.concat(F.lit("URL:"), uri_text(url)), F.concat(F.lit("STATUS:"), state), F.when(status == "postponed", "X-KALENDS-STATUS:POSTPONED"), F.lit("CLASS:PUBLIC"), F.lit("END:VEVENT"),
    ]
    # no lambda over the whole: its argument would be evaluated piece by piece, with common parts each time; no two lines are alike
    return F.array_except(F.array(*lines), F.array(F.lit(None).cast("string")))


def folded(c: Column) -> Column:
    """A line as lines of at most LINE_OCTETS octets, joined by CRLF; no character is split, and continuations begin with a space.

    Few lines are long, and of those most are ASCII, whose cuts are known by their length; others are walked once, character by character.
    """
    room = LINE_OCTETS - 1
    pieces = lambda line, cuts: F.array_join(F.transform(cuts, lambda at, i: F.substring(line, at, F.coalesce(F.get(cuts, i + 1), F.length(line) + 1) - at)), "\r\n ")

    def step(state: Column, char: Column) -> Column:
        n = F.octet_length(char)
        over = state["used"] + n > LINE_OCTETS
        cuts = F.when(over, F.concat(state["cuts"], F.array(state["at"]))).otherwise(state["cuts"])
        # a continuation's space is one of its octets
        return F.struct((state["at"] + 1).alias("at"), F.when(over, n + 1).otherwise(state["used"] + n).alias("used"), cuts.alias("cuts"))

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("used"), F.array(F.lit(1)).alias("cuts"))
    regular = F.concat(F.array(F.lit(1)), F.sequence(F.lit(LINE_OCTETS + 1), F.greatest(F.length(c), F.lit(LINE_OCTETS + 1)), F.lit(room)))
    walked = F.aggregate(F.split(c, ""), start, step, lambda state: state["cuts"])
    cut = lambda cuts: bind(F.struct(c.alias("line"), cuts.alias("cuts")), lambda p: pieces(p["line"], p["cuts"]))
    return F.when(F.octet_length(c) <= LINE_OCTETS, c).when(F.octet_length(c) == F.length(c), cut(regular)).otherwise(cut(walked))


#: What a calendar without entries holds, as it must have a component: a zone that shows nothing.
EMPTY = ["X-KALENDS-EMPTY:TRUE", "BEGIN:VTIMEZONE", "TZID:Etc/UTC", "BEGIN:STANDARD", "DTSTART:19700101T000000", "TZOFFSETFROM:+0000", "TZOFFSETTO:+0000", "TZNAME:UTC", "END:STANDARD", "END:VTIMEZONE"]


def calendar_head(name: Column, refresh: str) -> Column:
    """What stands before a calendar's entries, folded."""
    return F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("PRODID:-//Kalends//Kalends//DA"), F.lit("VERSION:2.0"), F.lit("CALSCALE:GREGORIAN"), folded(F.concat(F.lit("NAME;LANGUAGE=da:"), ical_escape(name))),
                       folded(F.concat(F.lit("X-WR-CALNAME:"), ical_escape(name))), F.lit(f"REFRESH-INTERVAL;VALUE=DURATION:{refresh}"), F.lit(f"X-PUBLISHED-TTL:{refresh}"))


def entry_text(entries: DataFrame, key: str) -> DataFrame:
    """(key, start_key, occurrence, entry): each entry's folded lines as one text."""
    # lines are named twice, so that they stay a column of their own and aren't drawn into the lambda
    return entries.select(key, "start_key", "occurrence", F.when(F.size("lines") > 0, F.array_join(F.transform("lines", folded), "\r\n")).alias("entry"))


def calendar_rows(names: DataFrame, entries: DataFrame, key: str, refresh: str = "PT6H") -> DataFrame:
    """(key, place, start_key, occurrence, entry): the calendars of `calendars` as rows in order of the middle three, for files too long to be a value."""
    one, here = entry_text(entries, key), names.select(key, "name")
    kinds = dict(one.drop("entry").dtypes)
    fixed = lambda df, place, text: df.select(key, F.lit(place).alias("place"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("start_key", "occurrence")], text.alias("entry"))
    own = one.join(here.select(key), key, "left_semi").where("entry is not null").select(key, F.lit(1).alias("place"), "start_key", "occurrence", "entry")
    empty = here.join(own.select(key).distinct(), key, "left_anti")
    parts = [fixed(here, 0, calendar_head(F.col("name"), refresh)), own, fixed(empty, 1, F.lit("\r\n".join(EMPTY))), fixed(here, 2, F.lit("END:VCALENDAR"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def calendars(names: DataFrame, entries: DataFrame, key: str, refresh: str = "PT6H") -> DataFrame:
    """(key, calendar) for every row of `names` (key, name): whole folded calendars with CRLF line ends.

    entries: (key, order..., lines) with `start_key` and `occurrence`, by which a calendar's entries are ordered. A key's
    calendar is one value; where calendars may be long, `calendar_rows` gives them by rows.
    """
    whole = entry_text(entries, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_key", "occurrence", "entry"))), lambda x: x["entry"]), "\r\n").alias("_entries"))
    out = names.select(key, "name").join(whole, key, "left")
    return out.select(key, F.concat(F.concat_ws("\r\n", calendar_head(F.col("name"), refresh), F.coalesce("_entries", F.lit("\r\n".join(EMPTY))), F.lit("END:VCALENDAR")), F.lit("\r\n")).alias("calendar"))


def file_name(key: Column) -> Column:
    """A calendar's file name: all but letters, digits and hyphens are hyphens, none at the ends."""
    safe = F.regexp_replace(F.regexp_replace(key, "[^a-zA-Z0-9-]", "-"), "^-+|-+$", "")
    return F.concat(F.when(safe == "", "calendar").otherwise(safe), F.lit(".ics"))


#: What stands before a line's value: its name and parameters, whose quoted texts may hold colons.
HEAD = r'^((?:[^:"]++|"[^"]*+")*+):'
#: The line that opens or closes an event, and the line end before it.
BORDER = r'(?i)\n%s(?:;(?:[^:"\n]++|"[^"\n]*+")*+)?:VEVENT(?=\n|$)'


def unfolded(text: Column) -> Column:
    """A text with \n as its line ends and continuations drawn to their lines."""
    whole = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # a search for a fixed text is cheaper than a pattern, which tabs need
    return bind(whole, lambda t: F.when(F.instr(t, "\n\t") > 0, F.regexp_replace(t, "\\n[ \\t]", "")).otherwise(F.replace(t, F.lit("\n "), F.lit(""))))


def content_line(line: Column) -> Column:
    """An unfolded line's (name, parameters, value); a line without a colon has no name."""
    head = F.when(F.instr(line, ":") == 0, "").when(F.instr(line, '"') == 0, F.substring_index(line, ":", 1)).otherwise(F.regexp_extract(line, HEAD, 1))

    def parts(h: Column) -> Column:
        parameters = F.when(F.instr(h, ";") > 0, F.substring(h, F.instr(h, ";") + 1, F.length(h))).otherwise("")
        name = F.substring_index(h, ";", 1)
        return F.struct(F.when(name.rlike("[^A-Z-]"), F.upper(name)).otherwise(name).alias("name"), parameters.alias("parameters"), F.substring(line, F.length(h) + 2, F.length(line)).alias("value"))

    return bind(head, parts)


def content_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., nth, name, parameters, value) of each unfolded line of iCalendar texts."""
    lines = df.select(*keep, F.posexplode(F.split(unfolded(F.col(text)), "\n")).alias("nth", "_l")).where("_l <> ''")
    return lines.select(*keep, "nth", content_line(F.col("_l")).alias("_c")).select(*keep, "nth", "_c.*")


def event_properties(lines: DataFrame, *keep: str) -> DataFrame:
    """Content lines of one file a key that stand in a VEVENT itself, not in a part of it such as an alarm, with `entry`, the event's number in its file.

    An event ends with its END or where the next one begins.
    """
    event = F.upper("value") == "VEVENT"
    opens, closes = F.col("name") == "BEGIN", F.col("name") == "END"
    running = lambda c, w: F.sum(F.when(c, 1).otherwise(0)).over(w.orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    marked = lines.withColumn("entry", running(opens & event, W.partitionBy(*keep))).where("entry > 0")
    of = W.partitionBy(*keep, "entry")
    own = marked.withColumns({"_closed": running(closes & event, of), "_depth": running(opens, of) - running(closes, of)})
    return own.where("_closed = 0 and _depth = 1 and name not in ('BEGIN', 'END')").drop("_closed", "_depth")


def line_events(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep..., entry, lines) of the VEVENTs among content lines of one file a key: each event's own lines in order, as an array."""
    one = F.struct("nth", "name", "parameters", "value")
    return event_properties(lines, *keep).groupBy(*keep, "entry").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("nth")).alias("lines"))


def text_events(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The same (keep..., entry, lines) out of whole iCalendar texts, of one file each: all within the row, so that no line is shuffled."""
    # the line end in front makes a border of a text's first line too; no \r is left, so it marks borders, and a pattern isn't built for each row as a split's is
    parts = F.split(F.regexp_replace(F.concat(F.lit("\n"), unfolded(F.col(text))), BORDER % "BEGIN", "\r"), "\r")
    events = df.select(*keep, F.posexplode(parts).alias("entry", "_e")).where("entry > 0")
    plain = F.filter(F.split(F.substring_index(F.regexp_replace("_e", BORDER % "END", "\r"), "\r", 1), "\n"), lambda line: line != "")

    def step(state: Column, x: Column) -> Column:
        kept = F.when((state["depth"] == 0) & ~x["name"].isin("BEGIN", "END"), F.concat(state["own"], F.array(x))).otherwise(state["own"])
        return F.struct((state["depth"] + F.when(x["name"] == "BEGIN", 1).when(x["name"] == "END", -1).otherwise(0)).alias("depth"), kept.alias("own"))

    # few events have parts, whose lines aren't theirs
    whole = lambda xs: ~F.exists(xs, lambda x: x["name"].isin("BEGIN", "END"))
    own = lambda xs: F.when(whole(xs), xs).otherwise(F.aggregate(xs, F.struct(F.lit(0).alias("depth"), F.slice(xs, 1, 0).alias("own")), step, lambda state: state["own"]))
    # a filter on the lines would be drawn under them and have them read twice; a generator isn't
    some = F.filter(F.array(bind(F.transform(plain, content_line), own)), lambda xs: F.size(xs) > 0)
    return events.select(*keep, F.col("entry").cast("long").alias("entry"), F.explode(some).alias("lines"))


def plain_text(value: Column) -> Column:
    """iCalendar text without its escapes; line ends last, as an escaped backslash must not make one of the letter after it."""
    clear = F.array_join(F.transform(F.split(value, r"\\\\", -1), lambda p: F.regexp_replace(F.regexp_replace(p, r"\\[nN]", "\n"), r"\\([;,])", "$1")), "\\")
    return F.when(F.instr(value, "\\") > 0, clear).otherwise(value)


def properties(events: DataFrame, *keep: str) -> DataFrame:
    """(keep..., entry, properties) of events (keep..., entry, lines): a map of first values by name, texts unescaped."""
    firsts = lambda p: F.filter(p["lines"], lambda x, i: F.array_position(p["names"], x["name"]) == i + 1)
    named = bind(F.struct("lines", F.col("lines.name").alias("names")), firsts)
    return events.select(*keep, "entry", F.map_from_entries(F.transform(named, lambda x: F.struct(x["name"], plain_text(x["value"])))).alias("properties"))


def components(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep..., entry, properties) of the VEVENTs among content lines of one file a key."""
    return properties(line_events(lines, *keep), *keep)
