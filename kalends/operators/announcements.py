"""Events from free text: signals, dates with contexts, times, labels. Column functions all, so that texts stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalends.functions import civil as Z
from kalends.functions.similarity import bind
from kalends.functions.spread import spread
from kalends.functions.text import missing_if_blank, price_of

from .compaction import DAY_NAMES, MONTHS

#: Words that say something takes place, may be off, or isn't for all (fixed values, as patterns).
EVENT_WORDS = "koncert|foredrag|fest|marked|møde|udstilling|kom til|inviterer til|velkommen til|vi holder|vi arrangerer|sæt kryds i kalenderen"
REJECTED_WORDS = "lukket i dag|åbningstider|tilbud på|følg os"
CANCELLED_WORDS, SOLD_OUT_WORDS, MEMBER_WORDS = "aflyst|aflyses", "udsolgt", "kun for medlemmer|medlemsarrangement"
DEADLINE = "(?:senest|tilmeldingsfrist|sidste frist|frist(?:en)?|tilmelding)"
MOVED = "(?:ny dato|(?:flyttet|rykket|udsat) til|afholdes i stedet)"
LONGEST_TEXT, LONGEST_RANGE = 20_000, 14
#: A noncharacter of Unicode, which stands for a date where a text is cut at its dates.
MARK = "\uffff"

_DAYS, _MONTHS = "|".join(DAY_NAMES), "|".join(MONTHS)
_TURN = "(?:\\s+(?:er|bliver))?\\s*[:\\-]?\\s*"
# what stands before a date: a deadline (1), a move (2), a weekday (3)
_BEFORE = f"(?:({DEADLINE}){_TURN}|({MOVED}){_TURN})?(?:({_DAYS})\\s+)?(?:den\\s+|d\\.\\s*)?"
ISO = f"{_BEFORE}\\b(20\\d{{2}})-(\\d{{2}})-(\\d{{2}})\\b"
NAMED = f"{_BEFORE}(?<!\\d)(?<!\\d[-–—])(\\d{{1,2}})\\.?\\s*(?:(-|–|—|til|og|&)\\s*(\\d{{1,2}})\\.?\\s*)?({_MONTHS})(?:\\s+(20\\d{{2}}))?(?![\\p{{L}}\\p{{N}}])"
NUMERIC = f"{_BEFORE}(?<![\\d.:])(?<!kl\\.?\\s{{0,2}})(?<!klokken\\s{{0,2}})(\\d{{1,2}})(?<separator>[./-])(0?[1-9]|1[0-2])(?:\\k<separator>(20\\d{{2}}|\\d{{2}}))?(?=$|[\\s,;:!?]|\\.(?!\\d))(?!\\s*(?:[-–—]|til)\\s*\\d{{1,2}}[.:]\\d{{2}})(?!\\s*(?:år|årige)(?![\\p{{L}}]))"
#: A text's dates in one pass, so that each has its place and the text around it; of patterns that begin alike the first one counts.
ANY_DATE = f"(?:{ISO})|(?:{NAMED})|(?:{NUMERIC})"
RELATIVE = f"(?<![\\p{{L}}\\p{{N}}])(i dag|i morgen|på (?:{_DAYS}))(?![\\p{{L}}\\p{{N}}])"
ENCLOSING = "dette arrangement er en del af[\\s\\S]{0,180}(?:finder sted|afholdes|løber)(?:\\s+fra)?\\s*$"
_TO, _HOUR = "\\s*(?:-|–|—|til)\\s*", "(\\d{1,2})(?:[.:](\\d{2}))?"
STARTS = f"(?:starter|begynder|start)\\s*(?:ca\\.?\\s*|omkring\\s*)?(?:klokken|kl\\.?)\\s*{_HOUR}"
CLOCK = f"(?:klokken|kl\\.?)\\s*{_HOUR}(?:{_TO}(?:klokken\\s*|kl\\.?\\s*)?{_HOUR}(?![\\d.]*\\s*(?:{_MONTHS})))?"
HOURS = f"(?<![\\d.])(\\d{{1,2}})[.:](\\d{{2}}){_TO}(\\d{{1,2}})[.:](\\d{{2}})(?!\\d)"
DOORS = "(?:dørene?\\s+(?:åbner|op)|døråbning)\\s*(?:ca\\.?\\s*)?"
ASIDE = "(?:entré|billetsalg|tilmelding|indskrivning)\\s*(?:fra|starter|begynder|klokken|kl\\.?)?\\s*$"
EVERY_DAY = "(?<![\\p{L}])(?:(?:alle|begge|samtlige)\\s+(?:de\\s+)?(?:dage|datoer|lørdage|søndage|aftener|gange)|hver\\s+dag)(?![\\p{L}])"
#: Words of places that a line under date and time may name (fixed values).
PLACES = "forsamlingshus|kulturhus|aktivitetshus|bibliotek|museum|kirke|hallen|hotel|skole|torvet|havn"


def affirmed(text: Column, words: str) -> Column:
    """Whether one of the words is there and meant: not after a negation or a condition, and not taken back right after."""
    return F.lower(text).rlike(f"(?<!\\b(?:ikke|ingen|hvis|såfremt|ved)\\s{{1,3}})\\b(?:{words})\\b(?!\\s+(?:alligevel\\s+)?ikke\\b)")


def _part(raw: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(raw, pattern, n), F.lit(""))


def _group(raw: Column, pattern: str, dates: Column) -> Column:
    """A date group of a match: its contexts, whether its weekday agrees, and its dates (null ones are no real days)."""
    weekday = F.array_position(F.array(*[F.lit(d) for d in DAY_NAMES]), _part(raw, pattern, 3)).cast("int") - 1
    contexts = F.struct(_part(raw, pattern, 1).isNotNull().alias("deadline"), _part(raw, pattern, 2).isNotNull().alias("moved"), weekday.alias("weekday"), dates.alias("dates"))
    agrees = lambda g: F.coalesce(F.weekday(g["dates"][0]) == g["weekday"], F.lit(True))
    return bind(contexts, lambda g: F.struct(g["deadline"].alias("deadline"), g["moved"].alias("moved"), agrees(g).alias("agrees"), F.forall(g["dates"], lambda d: d.isNotNull()).alias("real"), g["dates"].alias("dates")))


def _dates_of(raw: Column, anchor: Column) -> Column:
    """What a match of ANY_DATE says, as a date group."""
    numbers = lambda p, **n: F.struct(*[_part(raw, p, i).cast("int").alias(name) for name, i in n.items()])

    def dated(n: Column, day: str) -> Column:
        return F.when(n["year"].isNull(), Z.nearest_year(n["month"], n[day], anchor)).otherwise(Z.made_date(F.when(n["year"] < 100, n["year"] + 2000).otherwise(n["year"]), n["month"], n[day]))

    def joined(n: Column) -> Column:
        word, days = _part(raw, NAMED, 5), F.datediff(n["second"], n["first"])
        span = F.when(days.between(0, LONGEST_RANGE), F.sequence(n["first"], F.date_add(n["first"], days))).otherwise(F.array(F.lit(None).cast("date")))
        return F.when(word.isNull(), F.array(n["first"])).when(word.isin("og", "&"), F.array(n["first"], n["second"])).otherwise(span)

    iso = bind(numbers(ISO, year=4, month=5, day=6), lambda n: F.array(Z.made_date(n["year"], n["month"], n["day"])))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), _part(raw, NAMED, 7)).cast("int")
    named = bind(F.struct(month.alias("month"), *[_part(raw, NAMED, i).cast("int").alias(n) for n, i in (("year", 8), ("day", 4), ("until", 6))]), lambda n: bind(F.struct(dated(n, "day").alias("first"), dated(n, "until").alias("second")), joined))
    numeric = bind(numbers(NUMERIC, year=7, month=6, day=4), lambda n: F.array(dated(n, "day")))
    return F.when(raw.rlike(f"^{ISO}$"), _group(raw, ISO, iso)).when(raw.rlike(f"^{NAMED}$"), _group(raw, NAMED, named)).otherwise(_group(raw, NUMERIC, numeric))


def date_spans(text: Column, anchor: Column) -> Column:
    """The dates of a text in order: (at, upto, before, after, enclosing, deadline, moved, agrees, real, dates), places in characters from 1.

    `before` and `after` is the text to the dates beside it. A missing year is the anchor's or the next one (`nearest_year`). A range of over
    LONGEST_RANGE days is no real date. A date is `moved` where a word says so before it, or where it is the second of
    'flyttet fra ... til ...'; `enclosing` where it is that of an event which the text's own, named before, is part of.
    """
    low = F.lower(text)

    def spans(p: Column) -> Column:
        raws, pieces = p["raws"], p["pieces"]
        size = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda total, x: total + F.length(x))

        def span(raw: Column, i: Column) -> Column:
            at, before = size(pieces, i + 1) + size(raws, i) + 1, F.get(pieces, i)
            from_there = (i > 0) & F.get(pieces, i - 1).rlike(f"(?:flyttet|rykket)\\s+fra\\s*(?:{_DAYS})?\\s*$") & before.rlike("^[^!?\\n]{0,60}?\\s+til\\s*$")
            g = _dates_of(raw, anchor)
            fields = {"at": at, "upto": at + F.length(raw) - 1, "before": before, "after": F.get(pieces, i + 1), "enclosing": (i > 0) & F.right(before, F.lit(260)).rlike(ENCLOSING)}
            return bind(g, lambda g: F.struct(*[c.alias(n) for n, c in fields.items()], g["deadline"].alias("deadline"), (g["moved"] | F.coalesce(from_there, F.lit(False))).alias("moved"), g["agrees"].alias("agrees"), g["real"].alias("real"), g["dates"].alias("dates")))

        return F.transform(raws, span)

    # a split compiles its pattern for each row, a replacement only once: so dates become a mark that no text has, and that is split at
    pieces = F.split(F.regexp_replace(F.translate(low, MARK, "\ufffe"), ANY_DATE, MARK), MARK, -1)
    return bind(F.struct(F.regexp_extract_all(low, F.lit(ANY_DATE), 0).alias("raws"), pieces.alias("pieces")), spans)


def relative_dates(text: Column, anchor: Column) -> Column:
    """Dates told by the day of a post: today, tomorrow, or the next such weekday, which is never the day itself."""

    def day(raw: Column) -> Column:
        target = F.array_position(F.array(*[F.lit(d) for d in DAY_NAMES]), F.regexp_replace(raw, "^på ", "")).cast("int") - 1
        ahead = F.pmod(target - F.weekday(anchor) - 1, F.lit(7)) + 1
        return F.when(raw == "i dag", anchor).when(raw == "i morgen", F.date_add(anchor, 1)).otherwise(F.date_add(anchor, ahead))

    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(RELATIVE), 1), day)


def time_of(segment: Column) -> Column:
    """(start, end) that a lower-case piece of text names for certain; null where it names none, only that of doors or of something aside, or several.

    A time after a word for starting counts before others. An end before the start is left out.
    """

    def at(raw: Column, pattern: str, n: int) -> Column:
        h, m = _part(raw, pattern, n).cast("int"), F.coalesce(_part(raw, pattern, n + 1).cast("int"), F.lit(0))
        return F.when((h < 24) & (m < 60), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")))

    def told(t: Column) -> Column:
        """The start and end of what was found, and whether to trust it."""
        sure = t["sure"].isNotNull()
        start = F.coalesce(at(t["sure"], STARTS, 1), F.when(~sure, F.coalesce(at(t["told"], CLOCK, 1), F.when(t["told"].isNull(), at(t["bare"], HOURS, 1)))))
        end = F.when(~sure, F.coalesce(at(t["told"], CLOCK, 3), F.when(t["told"].isNull(), at(t["bare"], HOURS, 3))))
        before = F.right(F.call_function("substring_index", t["seg"], F.coalesce(t["sure"], t["told"], t["bare"]), F.lit(1)), F.lit(40))
        n = F.regexp_count(F.regexp_replace(t["seg"], f"{DOORS}(?:(?:klokken|kl\\.?)\\s*)?\\d{{1,2}}(?:[.:]\\d{{2}})?", ""), F.lit("(?:klokken|kl\\.?)\\s*\\d{1,2}"))
        return F.struct(start.alias("start"), end.alias("end"), (~sure & before.rlike(f"{DOORS}$|{ASIDE}")).alias("aside"), F.when(sure, 0).otherwise(n).alias("n"))

    def trusted(t: Column) -> Column:
        kept = F.struct(t["start"].alias("start"), F.when(t["end"] >= t["start"], t["end"]).alias("end"))
        return F.when(~F.coalesce(t["aside"], F.lit(True)) & (t["n"] <= F.when(t["end"].isNotNull(), 2).otherwise(1)) & t["start"].isNotNull(), kept)

    def read(seg: Column) -> Column:
        found = F.struct(seg.alias("seg"), *[_part(seg, p, 0).alias(n) for n, p in (("sure", STARTS), ("told", CLOCK), ("bare", HOURS))])
        return bind(bind(found, told), trusted)

    return bind(segment, read)


def shared_time(text: Column) -> Column:
    """The time of the first sentence that says that it holds for all days."""
    clauses = F.split(text, "\\n+|(?<=[!?])\\s+|(?<=\\.)\\s+(?=\\p{Lu})", -1)
    said = F.filter(F.transform(clauses, F.lower), lambda c: c.rlike(EVERY_DAY))
    return F.get(F.filter(F.transform(said, lambda c: time_of(_until_deadline(c))), lambda t: t.isNotNull()), F.lit(0))


def _until_deadline(segment: Column) -> Column:
    return F.regexp_replace(segment, f"(?:(?<![\\p{{L}}]){DEADLINE}(?![\\p{{L}}])|\\n\\s*pris(?![\\p{{L}}]))[\\s\\S]*", "")


def _time_at(span: Column) -> Column:
    """The time after a date, up to the next one, or right before it."""
    ahead = F.regexp_extract(span["before"], f"((?:{CLOCK})|(?:{HOURS}))\\s*$", 1)
    return F.coalesce(time_of(_until_deadline(span["after"])), time_of(ahead))


def title_of(text: Column, at: Column) -> Column:
    """The first line before the first date (the first line at all, if there is none before it) that says something, its weekday and end cut off."""
    head = F.trim(F.substring(text, F.lit(1), F.coalesce(at - 1, F.length(text))))
    lines = F.split(F.when(head == "", text).otherwise(head), "\n")
    bare = F.transform(F.filter(lines, lambda line: ~F.trim(line).startswith("#")), lambda line: F.regexp_replace(line, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N})]+$", ""))
    first = F.get(F.filter(bare, lambda line: (F.length(line) >= 3) & ~F.lower(line).rlike(f"^(?:klokken|kl\\.?)\\s*\\d{{1,2}}(?:[.:]\\d{{2}})?(?:\\s+(?:{_DAYS})(?:\\s+(?:den|d\\.))?)?$")), F.lit(0))
    whole = F.regexp_replace(first, f"(?iu)\\s+(?:{_DAYS})(?:\\s+(?:den|d\\.))?\\s*$", "")
    sentence = F.get(F.split(whole, "(?<=[!?])\\s+", 2), F.lit(0))
    short = F.regexp_replace(F.substring(sentence, 1, 177), "\\s+\\S*$", "")
    return missing_if_blank(F.when(F.length(sentence) <= 180, sentence).otherwise(F.concat(short, F.lit("…"))))


def place_under(text: Column, upto: Column) -> Column:
    """The line after date and time that names a place, if it is no sentence."""
    after = F.substring(text, upto + 1, F.length(text))
    line = F.trim(F.regexp_extract(after, "(?iu)^(?:[^\\n]*\\n){0,4}?[ \\t]*(?:klokken|kl\\.?)\\s*\\d{1,2}[^\\n]*\\n\\s*[^\\p{L}\\p{N}\\n]*([^\\n]{2,100})", 1))
    return F.when(F.lower(line).rlike(PLACES) & ~line.rlike("[.!?]$|^(?:https?://|www\\.)") & (F.size(F.split(line, "\\s+")) <= 10), line)


def labelled(text: Column, names: str) -> Column:
    """The rest of the first line that begins with one of some labels."""
    return missing_if_blank(F.regexp_extract(text, f"(?im)^\\s*(?:{names})\\s*:\\s*([^\\n]+)$", 1))


def announcements(df: DataFrame, key: str, text: str, anchor: str) -> DataFrame:
    """(key, title, location, price, start, end, all_day, status, sold_out, attendance, dates, occurrences, errors) of announcements.

    Dates of deadlines, and of an event that the announced one is part of, are left out. If a date is marked as the one that an event
    moved to, only such dates count and the event is on. Without any date, words relative to the anchor (the day of the post) give
    them. `occurrences` has each date with its own time, or the one that holds for all; `start` and `end` are the first's.
    Errors: no text, no event signal, a text too long or rejected, days that aren't real, weekdays that don't agree,
    alternatives ('enten ... eller' with several dates), relative dates without an anchor, and no date at all. A null text has no text.
    `announced` gives a row for each occurrence; a plain explode would have all of a row's work done anew by the filter that comes with it.
    """
    t = F.col("_t")
    whole = F.when(F.length(text) <= LONGEST_TEXT, F.col(text)).otherwise("")
    d = spread(df.select(key, text, anchor), key)
    d = d.select(key, F.coalesce(text, F.lit("")).alias("_t"), F.coalesce(whole, F.lit("")).alias("_w"), F.col(anchor).alias("_a"))
    d = d.withColumn("_g", date_spans(F.col("_w"), F.col("_a"))).withColumn("_at", F.get("_g", F.lit(0)))
    live = F.filter("_g", lambda g: ~g["deadline"] & ~g["enclosing"])
    d = d.withColumn("_live", live).withColumn("_moved", F.filter("_live", lambda g: g["moved"]))
    d = d.withColumn("_g", F.when(F.size("_moved") > 0, F.col("_moved")).otherwise(F.col("_live"))).withColumn("_m", F.size("_moved") > 0)
    d = d.withColumn("_near", F.when(F.size("_g") == 0, relative_dates(F.col("_w"), F.col("_a"))).otherwise(F.array().cast("array<date>")))
    d = d.withColumn("_all", shared_time(F.col("_w"))).withColumn("_any", time_of(_until_deadline(F.lower("_w"))))
    good = F.filter("_g", lambda g: g["real"] & g["agrees"])
    several = F.aggregate("_g", F.lit(0), lambda n, g: n + F.size(g["dates"])) > 1
    at = lambda day, time: F.struct(day.alias("date"), time["start"].alias("start"), time["end"].alias("end"))
    timed = F.flatten(F.transform(good, lambda g: bind(F.coalesce(F.when(several, F.col("_all")), _time_at(g)), lambda time: F.transform(g["dates"], lambda day: at(day, time)))))
    near = F.transform(F.filter("_near", lambda day: day.isNotNull()), lambda day: at(day, F.col("_any")))
    d = d.withColumn("_o", F.array_sort(F.array_distinct(F.concat(timed, near)))).withColumn("dates", F.array_sort(F.array_distinct(F.transform("_o", lambda o: o["date"]))))
    many = F.size("dates") > 1
    checks = [
        (F.trim(t) == "", "no-text"), (F.length(t) > LONGEST_TEXT, "too-long"), (~F.lower(t).rlike(EVENT_WORDS), "no-signal"), (F.lower(t).rlike(REJECTED_WORDS), "rejected"), (F.exists("_g", lambda g: ~g["real"]), "no-such-day"),
        (F.exists("_g", lambda g: g["real"] & ~g["agrees"]), "weekday"), (F.lower(t).rlike("(?s)\\benten\\b.*\\beller\\b") & many, "alternatives"), (F.col("_a").isNull() & (F.size("_near") > 0), "no-anchor"), (F.size("dates") == 0, "no-date"),
    ]
    errors = F.filter(F.array(*[F.when(c, F.lit(e)) for c, e in checks]), lambda x: x.isNotNull())
    status = F.when(affirmed(t, CANCELLED_WORDS) & ~F.col("_m"), "cancelled").otherwise("scheduled")
    first = F.get("_o", F.lit(0))
    location = F.coalesce(labelled(t, "sted|hvor|lokation|mødested|adresse"), place_under(t, F.col("_at.upto")))
    return d.select(
        key, title_of(t, F.col("_at.at")).alias("title"), location.alias("location"), price_of(t).alias("price"), first["start"].alias("start"), first["end"].alias("end"), (F.lower(t).rlike("hele dagen|heldagsarrangement") & first["start"].isNull()).alias("all_day"),
        status.alias("status"), affirmed(t, SOLD_OUT_WORDS).alias("sold_out"), F.when(affirmed(t, MEMBER_WORDS), "members").otherwise("unknown").alias("attendance"), "dates", F.col("_o").alias("occurrences"), errors.alias("errors"),
    )


def announced(found: DataFrame, key: str) -> DataFrame:
    """(key, date, start, end) of each occurrence of announcements.

    Outer, so that no filter on the size of `occurrences` is made: Spark would take it down through all the columns that they are made
    from, each written out wherever it is named.
    """
    each = found.select(key, F.explode_outer("occurrences").alias("_o"))
    return each.where(F.col("_o").isNotNull()).select(key, "_o.date", "_o.start", "_o.end")
