"""Queries of text keys, labels, links, prices, places and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalends.functions import civil as Z
from kalends.functions import text as T
from kalends.functions.spread import spread
from kalends.operators import calendar as C
from kalends.operators.snapshots import canonical_json

from .calendar_queries import table
from .registry import query

TITLES = "p_name || ' Æble & Å-ø ' || p_type || case when p_partkey % 3 = 0 then repeat(' long title', 9) else '' end"
SHORT = "regexp_replace(regexp_replace({0}, '[^a-z0-9]+', '{1}', 'g'), '^[ -]+|[ -]+$', '', 'g')"


def _titles(spark, sf_dir):
    long = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.lit(" long title"), 9)).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" Æble & Å-ø "), "p_type", long).alias("title"))


@query("text_keys", f"""
with t as (select p_partkey, {TITLES} as title from part)
select p_partkey, {SHORT.format("strip_accents(replace(replace(replace(lower(title), '&', ' og '), 'æ', 'ae'), 'ø', 'oe'))", ' ')} as title_key,
  {SHORT.format("lower(strip_accents(title))", ' ')} as fingerprint_key, replace(replace(lower(strip_accents(title)), 'æ', 'ae'), 'ø', 'o') as search_key from t""")
def text_keys(spark, sf_dir):
    t = F.col("title")
    return _titles(spark, sf_dir).select("p_partkey", T.title_key(t).alias("title_key"), T.fingerprint_key(t).alias("fingerprint_key"), T.search_key(t).alias("search_key"))


@query("slug_safe_id", f"""
with t as (select p_partkey, {TITLES} as title from part), k as (select p_partkey, {SHORT.format("replace(replace(lower(strip_accents(title)), 'æ', 'ae'), 'ø', 'oe')", '-')} as slug, {SHORT.format("lower(strip_accents(title))", '-')} as k from t)
select p_partkey, slug, case when length(k) > 80 then regexp_replace(substr(k, 1, 71), '-+$', '') || '-' || substr(sha256(k), 1, 8) else k end as safe_id from k""")
def slug_safe_id(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", T.slug(F.col("title")).alias("slug"), T.safe_id(F.col("title")).alias("safe_id"))


@query("pii_scrub", r"""
select doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[mail]', 'g'), '(\+45 ?)?\b\d{2} ?\d{2} ?\d{2} ?\d{2}\b', '[phone]', 'g') as text from documents""")
def pii_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.scrub_personal(F.col("text")).alias("text"))


@query("clean_texts", r"""
select doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') as one_line,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda l: trim(regexp_replace(replace(l, chr(160), ' '), '[ \t\n\v\f\r]+', ' ', 'g'), ' ')), lambda l: l <> ''), chr(10)) as lines from documents""")
def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("one_line"), T.clean_lines(F.col("text")).alias("lines"))


@query("post_scrub", r"""
with t as (select doc_id, 'a' || chr(27) || '[31m' || chr(8206) || text || chr(13) || chr(10) || chr(7) || 'b' || chr(65279) as text from documents)
select doc_id, replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\x1b\[[0-9;?]*[A-Za-z]', '', 'g'), '[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}]', '', 'g'), chr(160), ' ') as text from t""")
def post_scrub(spark, sf_dir):
    raw = F.concat(F.lit("a\u001b[31m‎"), F.col("text"), F.lit("\r\n\u0007b﻿"))
    return table(spark, sf_dir, "documents").select("doc_id", T.scrub_post(raw).alias("text"))


@query("html_text")
def html_text(spark, sf_dir):
    """Text of pages by block; tested against a parser of the standard library."""
    return table(spark, sf_dir, "pages").select("page_id", T.tags_off(F.col("html")).alias("text"))


@query("canonical_urls", r"""
select page_id, 'https://' || regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]+)', 1)), '^(www|m)\.', '') || regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') || case when page_id % 2 = 0 then '?id=' || page_id else '' end as link
from (select page_id, replace(url, '://', '://WWW.') || '/?utm=1' || case when page_id % 2 = 0 then '&id=' || page_id else '' end || '#top' as u from pages)""")
def canonical_urls(spark, sf_dir):
    link = F.concat(F.replace("url", F.lit("://"), F.lit("://WWW.")), F.lit("/?utm=1"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&id="), F.col("page_id").cast("string"))).otherwise(""), F.lit("#top"))
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(link, ("id",)).alias("link"))


@query("labels_of_rows", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, day(l_shipdate) || '. ' || ['januar','februar','marts','april','maj','juni','juli','august','september','oktober','november','december'][month(l_shipdate)] as day_label,
  'kl. 18.30' || case when l_linenumber % 2 = 0 then '–20.00' else '' end as time_label, case l_returnflag when 'R' then 'Aflyst' when 'A' then 'Udsat' end as status_label,
  case when l_discount = 0 then 'gratis' when l_discount = 0.05 then '50 kr.' else '50–' || cast(round(l_discount * 1000) as integer) || ' kr.' end as price_label from lineitem where l_discount = 0 or l_discount >= 0.05""")
def labels_of_rows(spark, sf_dir):
    from kalends.operators.compaction import MONTHS

    li = table(spark, sf_dir, "lineitem").where("l_discount = 0 or l_discount >= 0.05")
    status = F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_returnflag") == "A", "postponed").otherwise("scheduled")
    low = F.when(F.col("l_discount") == 0, 0).otherwise(50)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.date_label(F.to_date("l_shipdate"), MONTHS).alias("day_label"), C.time_label(F.lit("18:30"), F.when(F.col("l_linenumber") % 2 == 0, "20:00")).alias("time_label"),
                     T.status_label(status).alias("status_label"), T.price_label(low, F.round(F.col("l_discount") * 1000)).alias("price_label"))


@query("prices_in_text", "select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then 0 when 2 then null else 1000 + p_size end as price from part")
def prices_in_text(spark, sf_dir):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Entré: "), n, F.lit(",- kr. ved døren"))).when(F.col("p_partkey") % 4 == 1, "Gratis adgang").when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Hus nr. "), n)).otherwise(F.concat((1000 + F.col("p_size")).cast("string"), F.lit(" DKK")))
    return table(spark, sf_dir, "part").select("p_partkey", T.price_of(text).alias("price"))


@query("places_in_text", """
select p_partkey, p_name as name, case when p_size % 2 = 0 then 'Street ' || p_size end as address, case when p_size % 3 <> 0 then '59' || lpad(cast(p_size as varchar), 2, '0') end as postcode, case when p_size % 3 = 1 then 'Town' end as city from part""")
def places_in_text(spark, sf_dir):
    s = F.col("p_size")
    code = F.when(s % 3 != 0, F.concat(F.lit("59"), F.lpad(s.cast("string"), 2, "0"), F.when(s % 3 == 1, " Town").otherwise("")))
    text = F.concat_ws(" , ", "p_name", F.when(s % 2 == 0, F.concat(F.lit("Street "), s.cast("string"))), code, F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", T.split_place(text).alias("p")).select("p_partkey", "p.*")


@query("status_in_text", """
select p_partkey, case p_partkey % 4 when 0 then 'cancelled' when 1 then 'postponed' else 'scheduled' end as status from part""")
def status_in_text(spark, sf_dir):
    words = F.element_at(F.array(F.lit(" er AFLYST!"), F.lit(" is postponed"), F.lit(" as planned"), F.lit(" uncancelledness")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.keyword_status(F.concat("p_name", words)).alias("status"))


@query("fnv_hash")
def fnv_hash(spark, sf_dir):
    """32-bit FNV-1a in base 36; DuckDB has no loop over characters with wrap-around. Tested against plain Python."""
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), T.fnv36(F.col("p_name")).alias("hash"))


@query("field_fallbacks", "select p_partkey, case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then p_brand else p_type end as name, case when p_size % 2 = 0 then trim(p_name) end as venue from part")
def field_fallbacks(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", T.first_present(F.when(s % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise("  "), F.when(s % 3 == 1, F.col("p_brand")), F.col("p_type")).alias("name"), T.missing_if_blank(F.when(s % 2 == 0, F.col("p_name")).otherwise(" ")).alias("venue"))


@query("wall_minutes", "select event_id, hour(ts) * 60 + minute(ts) as minutes from events")
def wall_minutes(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z"))
    return table(spark, sf_dir, "events").select("event_id", Z.wall_minutes(text).cast("long").alias("minutes"))


@query("local_day_keys", "select event_id, cast(ts + interval 1 hour as date) as day from events", dates=("day",))
def local_day_keys(spark, sf_dir):
    """Dates in Copenhagen (an hour ahead in January) of UTC times."""
    return table(spark, sf_dir, "events").select("event_id", F.to_date(Z.civil_time(F.col("ts"), "Europe/Copenhagen")).alias("day"))


@query("default_starts", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, hour(l_shipdate + to_hours(case when l_linenumber % 3 = 0 then 18 when l_linenumber % 3 = 1 then 9 else 12 end)) as hour from lineitem")
def default_starts(spark, sf_dir):
    n = F.col("l_linenumber")
    start = Z.default_start(F.when(n % 3 == 0, F.expr("l_shipdate + interval 18 hours")), F.to_date("l_shipdate"), n % 3 == 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.hour(start).cast("long").alias("hour"))


@query("inferred_years", """
with r as (select p_partkey, cast(1 + p_partkey % 13 as integer) as m, cast(1 + p_size * 2 % 31 as integer) as d, date '2023-06-15' + cast(p_partkey % 365 as integer) as a from part),
y as (select p_partkey, a, try_cast(year(a) || '-' || m || '-' || d as date) as this, try_cast(year(a) + 1 || '-' || m || '-' || d as date) as next, try_cast(year(a) - 1 || '-' || m || '-' || d as date) as past from r),
f as (select *, case when this >= a - 7 then this else next end as found from y)
select p_partkey, case when found <= cast(a + interval 12 month as date) + 7 then found end as inferred,
  case when least(abs(this - a), abs(next - a), abs(past - a)) <= 45 then case when abs(this - a) = least(abs(this - a), abs(next - a), abs(past - a)) then this when abs(next - a) = least(abs(this - a), abs(next - a), abs(past - a)) then next else past end end as closest from f""", dates=("inferred", "closest"))
def inferred_years(spark, sf_dir):
    month, day = (1 + F.col("p_partkey") % 13).cast("int"), (1 + F.col("p_size") * 2 % 31).cast("int")
    anchor = F.date_add(F.lit("2023-06-15").cast("date"), (F.col("p_partkey") % 365).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", Z.nearest_year(month, day, anchor).alias("inferred"), Z.closest_year(month, day, anchor).alias("closest"))


@query("valid_dates", "select p_partkey, try_cast(case when p_size % 5 = 0 then null else '2023-' || lpad(cast(p_partkey % 14 as varchar), 2, '0') || '-' || lpad(cast(p_size % 32 as varchar), 2, '0') end as date) as day from part", dates=("day",))
def valid_dates(spark, sf_dir):
    text = F.concat(F.lit("2023-"), F.lpad((F.col("p_partkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("p_size") % 32).cast("string"), 2, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", Z.valid_date(F.when(F.col("p_size") % 5 == 0, "2023-1-1").otherwise(text)).alias("day"))


@query("linked_data_objects", "select p_partkey, case p_partkey % 4 when 3 then '' when 2 then p_name || ';' || p_brand else p_name end as names from part")
def linked_data_objects(spark, sf_dir):
    one = F.concat(F.lit('{"@type":"Event","name":"'), F.col("p_name"), F.lit('"}'))
    other, two = F.lit('{"@type":"Place","name":"x"}'), F.concat(F.lit('{"@type":"Event","name":"'), F.col("p_brand"), F.lit('"}'))
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, one).when(kind == 1, F.concat(F.lit("["), other, F.lit(","), one, F.lit("]"))).when(kind == 2, F.concat(F.lit('{"@graph":['), one, F.lit(","), other, F.lit(","), two, F.lit("]}"))).otherwise(other)
    found = T.linked_data(text, "Event", ("name",))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda o: o["name"]), ";").alias("names"))


@query("review_cards", "select p_partkey, p_name || chr(10) || concat_ws(', ', '2024-01-0' || (1 + p_size % 9), case when p_size % 2 = 0 then p_brand end) || case p_size % 3 when 0 then '' when 1 then chr(10) || '- a' else chr(10) || '- a' || chr(10) || '- b' || chr(10) || '- c' || chr(10) || '- and 1 more' end as card from part")
def review_cards(spark, sf_dir):
    s = F.col("p_size")
    reasons = F.when(s % 3 == 0, F.array().cast("array<string>")).when(s % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(*[F.lit(x) for x in "abcd"]))
    card = T.review_card(F.col("p_name"), F.concat(F.lit("2024-01-0"), (1 + s % 9).cast("string")), F.when(s % 2 == 0, F.col("p_brand")), reasons)
    return table(spark, sf_dir, "part").select("p_partkey", card.alias("card"))


@query("linked_data_walk", """
with p as (select p_partkey, p_size % 5 as d, p_name, p_brand from part)
select p_partkey, case d when 0 then p_name else concat_ws(';', 'top', p_name, p_brand) end as names, case d when 0 then p_name else concat_ws(';', 'top', p_name, p_brand, 'aside') end as everywhere from p""")
def linked_data_walk(spark, sf_dir):
    """Events one to five levels down, in lists and graphs of graphs, one of them under another key."""
    event = lambda name, kind='"Event"': F.concat(F.lit(f'{{"@type":{kind},"name":"'), name, F.lit('"}'))
    inner = F.concat(F.lit("[["), event(F.col("p_name"), '["Thing","Event"]'), F.lit('],{"@type":"Place","name":"x"},'), event(F.col("p_brand")), F.lit("]"))
    depth = F.col("p_size") % 5
    deep = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), inner, lambda text, _: F.concat(F.lit('{"@graph":'), text, F.lit("}")))
    whole = F.when(depth == 0, event(F.col("p_name"))).otherwise(F.concat(F.lit('[{"@type":"Event","name":"top","@graph":'), deep, F.lit(',"other":{"@type":"Event","name":"aside"}}]')))
    names = lambda through: F.array_join(F.transform(T.linked_data(whole, "Event", ("name",), through), lambda o: o["name"]), ";")
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    return parts.select("p_partkey", names(("@graph",)).alias("names"), names(None).alias("everywhere"))


CANONICAL = """'{"customer":' || o_custkey || ',"lines":[{"a":' || o_orderkey % 9 || ',"b":"' || o_orderpriority || '"},{"a":1}],"places":{"here":{"x":' || o_orderkey || ',"y":2},"there":{"y":3}}}'"""


@query("canonical_digests", f"select o_orderkey, sha256({CANONICAL}) as digest, sha256({CANONICAL}) as text_digest from orders")
def canonical_digests(spark, sf_dir):
    """Digests of records with lists of records and maps of records, and of the same as JSON text with its keys in another order."""
    n = F.col("o_orderkey")
    line = lambda b, a: F.struct(b.alias("b"), a.cast("long").alias("a"))
    place = lambda y, x: F.struct(F.lit(y).alias("y"), x.cast("long").alias("x"))
    none = F.lit(None)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("there"), place(3, none), F.lit("here"), place(2, n)).alias("places"), F.array(line(F.col("o_orderpriority"), n % 9), line(none.cast("string"), F.lit(1))).alias("lines"), F.col("o_custkey").alias("customer"))
    text = F.format_string('{ "places": {"there": {"y": 3}, "here": {"y": 2, "x": %d}}, "lines": [{"b": "%s", "a": %d}, {"a": 1}], "customer": %d }', n, F.col("lines")[0]["b"], n % 9, "customer")
    return rows.select("o_orderkey", F.sha2(canonical_json(rows, ["places", "customer", "lines"]), 256).alias("digest"), F.sha2(T.canonical_text(text), 256).alias("text_digest"))
