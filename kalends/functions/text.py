"""Text keys as Column functions. The three normalisers differ on purpose: what counts as equal is up to the question."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mark_table() -> tuple[str, str]:
    """Latin letters with marks, and their bare letters, by rule: canonical decomposition to one letter and marks."""
    marked, bare = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            marked.append(chr(code))
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


MARKED, BARE = _mark_table()


def strip_marks(c: Column) -> Column:
    """Letters without their marks: precomposed Latin letters by table, then combining marks are dropped (å is a, ø stays)."""
    return F.regexp_replace(F.translate(c, MARKED, BARE), "[\\u0300-\\u036f]", "")


def spaced_alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """For title similarity: lower case, & as 'og', ae and oe spelled out, marks off, the rest spaced."""
    c = F.replace(F.replace(F.replace(F.lower(c), F.lit("&"), F.lit(" og ")), F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("oe"))
    return spaced_alnum(strip_marks(c))


def fingerprint_key(c: Column) -> Column:
    """For fingerprints: marks off, lower case; all but a-z and digits (so also æ and ø) become spaces."""
    return spaced_alnum(F.lower(strip_marks(c)))


def search_key(c: Column) -> Column:
    """For search: marks off, lower case, æ as ae and ø as o; punctuation stays."""
    return F.replace(F.replace(F.lower(strip_marks(c)), F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("o"))


def slug(c: Column) -> Column:
    """Lower-case kebab with æ and ø spelled out."""
    c = F.replace(F.replace(F.lower(strip_marks(c)), F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("oe"))
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_id(c: Column, most: int = 80) -> Column:
    """Kebab id of at most `most` characters: longer ones are cut and end in 8 hex digits of their SHA-256. Null if nothing is left."""
    k = F.regexp_replace(F.regexp_replace(F.lower(strip_marks(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.concat(F.regexp_replace(F.substring(k, 1, most - 9), "-+$", ""), F.lit("-"), F.substring(F.sha2(k, 256), 1, 8))
    return F.when(F.length(k) == 0, None).when(F.length(k) > most, cut).otherwise(k)


def clean_text(c: Column) -> Column:
    """No-break spaces as spaces, runs collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "\\s+", " "))


def scrub_post(c: Column) -> Column:
    """Line ends as \\n, terminal escapes, control, direction and zero-width characters dropped, no-break spaces as spaces."""
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, "\\u001b\\[[0-9;?]*[A-Za-z]", "")
    c = F.regexp_replace(c, "[\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f\\u007f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2069\\ufeff]", "")
    return F.replace(c, F.lit(" "), F.lit(" "))


def missing_if_blank(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first of several columns that isn't blank."""
    return F.coalesce(*(missing_if_blank(c) for c in columns))


def scrub_personal(c: Column) -> Column:
    """Mail addresses and 8-digit phone numbers (also with country code) replaced by a mark."""
    c = F.regexp_replace(c, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "[mail]")
    return F.regexp_replace(c, "(\\+45 ?)?\\b\\d{2} ?\\d{2} ?\\d{2} ?\\d{2}\\b", "[phone]")


def content_digest(*columns: Column) -> Column:
    """SHA-256 of the columns in the order given, nulls told from blanks."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def ical_escape(c: Column) -> Column:
    """Backslash, semicolon, comma and line ends as iCalendar text has them."""
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def keyword_status(c: Column, cancelled: str = "aflyst|cancell?ed|annulé|abgesagt", postponed: str = "udsat|postponed|reporté|verschoben") -> Column:
    """cancelled, postponed or scheduled by words in a text."""
    low = F.lower(c)
    return F.when(low.rlike(f"\\b({cancelled})\\b"), "cancelled").when(low.rlike(f"\\b({postponed})\\b"), "postponed").otherwise("scheduled")


def price_label(low: Column, high: Column) -> Column:
    """'gratis', one price or a range, from whole amounts."""
    one, two = low.cast("long").cast("string"), high.cast("long").cast("string")
    return F.when((low <= 0) & (high <= 0), "gratis").when(low == high, F.concat(one, F.lit(" kr."))).otherwise(F.concat(one, F.lit("–"), two, F.lit(" kr.")))


def canonical_url(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """Scheme, host without 'www.' or 'm.', path without a last slash, and the kept parameters only; no fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(c, "^[a-zA-Z]+://([^/?#]+)", 1)), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(c, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    values = [(k, F.regexp_extract(c, f"[?&]{k}=([^&#]*)", 1)) for k in keep]
    query = F.concat_ws("&", *[F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in values]) if keep else F.lit("")
    return F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def tags_off(c: Column) -> Column:
    """Text of an HTML page: scripts, styles and comments dropped, block ends as line ends, entities decoded, blank lines dropped."""
    c = F.regexp_replace(c, "(?is)<(script|style|head|template|noscript)\\b.*?</\\1\\s*>|<!--.*?-->|<!doctype[^>]*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "\\s+", " "), "(?i)<(br|/?(p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|aside|blockquote|pre|form|body|html|dd|dt))\\b[^>]*>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&laquo;", "«"), ("&raquo;", "»"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != ""), "\n")


def clean_lines(c: Column) -> Column:
    """Each line cleaned, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(F.regexp_replace(c, "\\r\\n?", "\n"), "\n"), clean_text), lambda x: x != ""), "\n")


def status_label(status: Column) -> Column:
    """What a view says of a status; scheduled ones need no word."""
    return F.when(status == "cancelled", "Aflyst").when(status == "postponed", "Udsat").when(status == "sold-out", "Udsolgt")


def price_of(c: Column) -> Column:
    """The first amount in kroner in a text as whole kroner, 0 for 'gratis', else null."""
    amount = F.nullif(F.regexp_extract(F.lower(c), "(\\d{1,5})(?:[.,]\\d{2}|,-)?\\s*(?:kr\\b|dkk\\b)", 1), F.lit("")).cast("int")
    return F.coalesce(amount, F.when(F.lower(c).rlike("\\bgratis\\b"), 0))


def split_place(c: Column) -> Column:
    """A struct of name, address, postcode and city from text such as 'Hall, Street 3, 5970 Town'."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    coded = F.get(F.filter(parts, lambda p: p.rlike("^\\d{4}\\b")), F.lit(0))
    others = F.filter(parts, lambda p: ~p.rlike("^\\d{4}\\b"))
    return F.struct(F.get(others, F.lit(0)).alias("name"), F.get(others, F.lit(1)).alias("address"), F.nullif(F.regexp_extract(coded, "^(\\d{4})", 1), F.lit("")).alias("postcode"), F.nullif(F.trim(F.regexp_replace(coded, "^\\d{4}\\s*", "")), F.lit("")).alias("city"))


def fnv36(c: Column) -> Column:
    """A short hash of a text: 32-bit FNV-1a over its code points, in base 36 (offset and prime are fixed values)."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    folded = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(folded.cast("string"), 10, 36))


def linked_data(c: Column, kind: str, fields: tuple[str, ...], through: tuple[str, ...] | None = ("@graph",), depth: int = 32) -> Column:
    """Objects of one @type in a JSON-LD text, as an array of structs of text fields, in the order in which they stand.

    The walk goes down through lists and the named keys (through every value, in order of keys, if `through` is None), also from objects that
    are found themselves, `depth` levels at most. A @type may be a list. All levels are unfolded within the row. A text
    that is no JSON, like null, has none.
    """
    node = "array<struct<path: array<struct<name: string, nth: int>>, v: variant>>"

    def at(n: Column, name: Column, nth: Column, v: Column) -> Column:
        return F.struct(F.concat(n["path"], F.array(F.struct(name.cast("string").alias("name"), nth.cast("int").alias("nth")))).alias("path"), v.alias("v"))

    def children(n: Column) -> Column:
        items = F.transform(F.try_variant_get(n["v"], "$", "array<variant>"), lambda v, i: at(n, F.lit(""), i, v))
        if through is None:
            found = F.transform(F.map_entries(F.try_variant_get(n["v"], "$", "map<string, variant>")), lambda e: at(n, e["key"], F.lit(0), e["value"]))
        else:
            found = F.array(*[at(n, F.lit(name), F.lit(i), F.try_variant_get(n["v"], f"$['{name}']", "variant")) for i, name in enumerate(through)])
        return F.filter(F.coalesce(items, found, F.array().cast(node)), lambda x: x["v"].isNotNull())

    def step(state: Column, _: Column) -> Column:
        return F.struct(F.flatten(F.transform(state["open"], children)).cast(node).alias("open"), F.concat(state["seen"], state["open"]).alias("seen"))

    whole = F.try_parse_json(c)
    root = F.filter(F.array(F.struct(F.array().cast("array<struct<name: string, nth: int>>").alias("path"), whole.alias("v"))), lambda x: x["v"].isNotNull()).cast(node)
    seen = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(root.alias("open"), F.array().cast(node).alias("seen")), step, lambda state: state["seen"])
    of_kind = lambda x: F.coalesce(F.try_variant_get(x["v"], "$['@type']", "string") == kind, F.lit(False)) | F.coalesce(F.array_contains(F.try_variant_get(x["v"], "$['@type']", "array<string>"), kind), F.lit(False))
    told = F.transform(F.filter(seen, of_kind), lambda x: F.struct(x["path"].alias("path"), F.struct(*[F.try_variant_get(x["v"], f"$['{f}']", "string").alias(f) for f in fields]).alias("o")))
    return F.transform(F.array_sort(told), lambda x: x["o"])


def canonical_text(c: Column) -> Column:
    """A JSON text with keys in order at every level, also within lists, and without spaces; null where it is no JSON."""
    return F.to_json(F.try_parse_json(c))


def review_card(title: Column, when: Column, place: Column, reasons: Column, most: int = 3) -> Column:
    """What an editor is shown of a candidate: title, time and place by line, and the first reasons as a list."""
    shown = F.array_join(F.transform(F.slice(reasons, 1, most), lambda r: F.concat(F.lit("- "), r)), "\n")
    more = F.when(F.size(reasons) > most, F.concat(F.lit("- and "), (F.size(reasons) - most).cast("string"), F.lit(" more")))
    return F.concat_ws("\n", missing_if_blank(title), F.concat_ws(", ", missing_if_blank(when), missing_if_blank(place)), F.nullif(shown, F.lit("")), more)
