"""Dates, names, places and text similarity as pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names (their first three letters are names too), and words that open an imprecise date.
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
WORDS = {"about": ["ABT\\.?", "ABOUT", "C\\.", "CA\\.?", "CCA\\.?", "CIRCA"], "before": ["BEF\\.?", "BEFORE"], "after": ["AFT\\.?", "AFTER"], "to": ["TO"]}
ONE = r"(?:(?:(\d{1,2}) )?([A-Z]{3,9})\.? )?(\d{1,4})"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, pattern, group)


def _month(s: Column) -> Column:
    place = lambda names: F.array_position(F.array(*map(F.lit, names)), s).cast("int")
    at = F.greatest(place(MONTHS), place([m[:3] for m in MONTHS]))
    return F.when(at > 0, at)


def parse_date(c: Column) -> Column:
    """struct(type, y, m, d, y2, m2, d2): exact, about, before, after, to, between, from_to or invalid; missing parts are null. Case-insensitive; impossible days are invalid."""
    s = F.upper(squeeze(F.coalesce(c, F.lit(""))))
    lead = "(?:" + "|".join(w for ws in WORDS.values() for w in ws) + ") ?"
    pair = rf"^(?:BET(?:WEEN|\.)?|FROM) {ONE} ?(?:AND|TO|-) ?{ONE}$"
    single = rf"^(?:{lead})?{ONE}$"
    two = s.rlike(pair)
    kind = F.when(two, F.when(s.startswith("FROM"), "from_to").otherwise("between"))
    for name, words in WORDS.items():
        kind = kind.when(s.rlike(rf"^(?:{'|'.join(words)}) ?{ONE}$"), name)
    kind = kind.when(s.rlike(rf"^{ONE}$"), "exact")
    pick = lambda g: F.when(two, _part(s, pair, g)).otherwise(_part(s, single, g))
    d, mon, y = (pick(g) for g in (1, 2, 3))
    d2, mon2, y2 = (F.when(two, _part(s, pair, g)) for g in (4, 5, 6))
    num = lambda x: x.try_cast("int")
    m, m2 = _month(mon), _month(mon2)
    bad = lambda dd, mm, yy, word: ((F.length(word) > 0) & mm.isNull()) | (num(dd).isNotNull() & F.try_to_timestamp(F.concat_ws("-", F.lpad(yy, 4, "0"), F.lpad(mm.cast("string"), 2, "0"), F.lpad(dd, 2, "0")), F.lit("yyyy-MM-dd")).isNull())
    ok = kind.isNotNull() & ~F.coalesce(bad(d, m, y, mon), F.lit(False)) & ~(two & F.coalesce(bad(d2, m2, y2, mon2), F.lit(False)))
    part = lambda x: F.when(ok, x)
    return F.struct(
        F.when(ok, kind).otherwise("invalid").alias("type"), part(num(y)).alias("y"), part(m).alias("m"), part(num(d)).alias("d"),
        part(num(y2)).alias("y2"), part(m2).alias("m2"), part(num(d2)).alias("d2"))


def earliest(p: Column) -> Column:
    """First day of a parsed date; before-dates begin at 0001-01-01."""
    return F.when(p["type"] == "before", F.to_date(F.lit("0001-01-01"))).when(p["type"] != "invalid", F.make_date(p["y"], F.coalesce(p["m"], F.lit(1)), F.coalesce(p["d"], F.lit(1))))


def latest(p: Column) -> Column:
    """Last day; a missing day is day 31 counted on from the month's first."""
    y, m, d = (F.coalesce(p[k + "2"], p[k]) if k == "y" else F.when(p["y2"].isNotNull(), p[k + "2"]).otherwise(p[k]) for k in "ymd")
    return F.when(p["type"] != "invalid", F.date_add(F.make_date(y, F.coalesce(m, F.lit(12)), F.lit(1)), F.coalesce(d, F.lit(31)) - 1))


def _years(y: Column, m: Column, d: Column) -> Column:
    """Fractional years of one date: the share of the year's days with a day, else the middle of the month (its length over the year's, counted from the year's start, as the middle of a year is a half)."""
    length = F.dayofyear(F.make_date(y, F.lit(12), F.lit(31)))
    first = F.make_date(y, m, F.lit(1))
    whole = F.dayofyear(F.make_date(y, m, d)) / length
    month = (F.dayofyear(first) / length + F.dayofmonth(F.last_day(first)) / length) / 2
    return y + F.when(m.isNull(), 0.5).when(d.isNull(), month).otherwise(whole)


def years(p: Column) -> Column:
    """Fractional years of a parsed date; of a range, the mean of its ends. Null if invalid. A year and a month end at the month's length, not at its last day of the year: the scale that similarities are defined on."""
    one = _years(p["y"], p["m"], p["d"])
    return F.when(p["type"].isin("between", "from_to"), (one + _years(p["y2"], p["m2"], p["d2"])) / 2).when(p["type"] != "invalid", one)


def iso8601(p: Column) -> Column:
    return F.when(p["type"] != "invalid", F.concat_ws("-", F.lpad(p["y"].cast("string"), 4, "0"), F.lpad(p["m"].cast("string"), 2, "0"), F.lpad(p["d"].cast("string"), 2, "0")))


def date_similarity(a: Column, b: Column, most: float = 3.0) -> Column:
    """1 - (gap / most) squared by fractional years; 0.5 if a date is invalid."""
    gap = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0.5).when(gap > most, 0.0).otherwise(1 - (gap / most) * (gap / most))


def date_similarity_of(a: Column, b: Column, most: float = 3.0) -> Column:
    return date_similarity(years(parse_date(a)), years(parse_date(b)), most)


# Words before and after a name.
PREFIXES = ["DR", "MR", "MRS", "MS", "PROF", "REV"]
SUFFIXES = ["JR", "JR.", "SR", "SR.", "II", "III", "IV", "V"]


def parse_name(value: Column) -> Column:
    """struct(prefix, given, surname, suffix) of ``Given /Surname/`` or, without two slashes, the last word as surname. Prefix and suffix are looked for in the given part; a prefix may go on after its word (``MRS.``)."""
    v = squeeze(F.coalesce(value, F.lit("")))
    slashed = v.rlike("/[^/]+/")
    words = F.filter(F.split(F.regexp_extract(v, "^([^/]*)/", 1), " "), lambda w: w != "")
    prefix = F.when(F.upper(F.get(words, F.lit(0))).rlike("^(?:" + "|".join(PREFIXES) + ")"), F.get(words, F.lit(0)))
    rest = F.when(prefix.isNotNull(), F.slice(words, 2, 1000)).otherwise(words)
    suffix = F.when((F.size(rest) > 0) & F.upper(F.try_element_at(rest, F.lit(-1))).isin(SUFFIXES), F.try_element_at(rest, F.lit(-1)))
    rest = F.when(suffix.isNotNull(), F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
    surname = F.when(slashed, F.trim(F.regexp_extract(v, "/([^/]*)", 1))).when(v.contains(" "), F.regexp_extract(v, r"(\S+)$", 1)).otherwise("")
    given = F.when(slashed, F.array_join(rest, " ")).when(v.contains(" "), F.trim(F.regexp_replace(v, r"\S+$", ""))).otherwise(v)
    none = F.lit(None).cast("string")
    return F.struct(F.when(slashed, prefix).otherwise(none).alias("prefix"), given.alias("given"), surname.alias("surname"), F.when(slashed, suffix).otherwise(none).alias("suffix"))


def name_type(c: Column) -> Column:
    """birth, married, aka, religious or unknown; any other word is other."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "", "unknown").when(t.isin("birth", "married", "aka", "religious", "unknown"), t).otherwise("other")


def full_surname(prefix: Column, surname: Column) -> Column:
    return full_name(prefix, surname)


def full_name(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def normalize_name(c: Column) -> Column:
    return F.lower(squeeze(F.translate(F.coalesce(c, F.lit("")), "/", "")))


# Words that mark a country.
COUNTRIES = ["USA", "US", "UNITED STATES", "UK", "UNITED KINGDOM", "ENGLAND", "CANADA", "AUSTRALIA", "GERMANY", "FRANCE", "IRELAND"]


def parse_place(c: Column) -> Column:
    """struct(city, county, state, country) of comma parts; the second of two is a country if it holds a country's word."""
    p = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    n, at = F.size(p), lambda i: F.get(p, F.lit(i))
    country2 = F.upper(at(1)).rlike("|".join(COUNTRIES))
    return F.struct(
        F.when(n > 0, at(0)).alias("city"), F.when(n > 3, at(1)).alias("county"),
        F.when(n == 2, F.when(~country2, at(1))).when(n == 3, at(1)).when(n > 3, at(2)).alias("state"),
        F.when(n == 2, F.when(country2, at(1))).when(n == 3, at(2)).when(n > 3, at(3)).alias("country"))


def soundex(c: Column) -> Column:
    """First letter and three digits; the first letter's code doesn't suppress the next, and uncoded letters don't part equal codes."""
    letters = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    tail = F.regexp_replace(letters.substr(F.lit(2), F.length(letters)), "[AEIOUYHW]", "")
    digits = F.regexp_replace(F.translate(tail, "BFPVCGJKQSXZDTLMNR", "111122222222334556"), r"(\d)\1+", "$1")
    return F.when(letters == "", "").otherwise(F.concat(F.substring(letters, 1, 1), F.rpad(F.substring(digits, 1, 3), 3, "0")))


def string_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length in bytes, at most 0.9 unless equal."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when(longest == 0, 0.0).otherwise(F.least(F.lit(0.9), 1 - F.levenshtein(a, b) / longest))


def extract_year(c: Column) -> Column:
    y = F.regexp_extract(c, r"\b(\d{4})\b", 1).try_cast("int")
    return F.when((y > 1000) & (y < 3000), y)


def valid_xref(c: Column) -> Column:
    return c.rlike("^@[A-Za-z0-9]{1,20}@$")


# Tags of events and attributes.
EVENT_TYPES = ["BIRT", "DEAT", "BURI", "CREM", "CHR", "BAPM", "BARM", "BASM", "BLES", "CHRA", "CONF", "FCOM", "ORDN", "NATU", "EMIG", "IMMI", "CENS", "PROB", "WILL", "GRAD", "RETI", "RESI", "OCCU", "EDUC", "EVEN",
               "MARR", "DIV", "ANUL", "MARB", "MARC", "MARL", "MARS", "ENGA", "CAST", "DSCR", "NATI", "PROP", "RELI", "TITL"]


def valid_event(tag: Column) -> Column:
    return tag.isin(EVENT_TYPES)


def effective_type(tag: Column, custom: Column) -> Column:
    """The custom type of a generic event, else the tag."""
    return F.when((tag == "EVEN") & (F.coalesce(custom, F.lit("")) != ""), custom).otherwise(tag)


def place_parts(c: Column, keep_empty: bool = False) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def place_format(c: Column, separator: str = ", ") -> Column:
    """Parts joined anew; the text as it is where it has none."""
    return F.when(F.size(place_parts(c)) > 0, F.array_join(place_parts(c), separator)).otherwise(c)


def place_component(c: Column, level: int) -> Column:
    """Level 0 is the most specific part; empty beyond the last."""
    return F.coalesce(F.get(place_parts(c), F.lit(level)) if level >= 0 else F.lit(None).cast("string"), F.lit(""))


def normalize_text(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def is_abbreviation(a: Column, b: Column) -> Column:
    """One is two letters that the other, longer one begins with."""
    x, y = normalize_text(a), normalize_text(b)
    n, k = F.octet_length(x), F.octet_length(y)
    return ((n == 2) & (k > 2) & y.startswith(x)) | ((k == 2) & (n > 2) & x.startswith(y))


def phonetic_similarity(a: Column, b: Column) -> Column:
    """0.9 for equal codes, 0.5 and 0.1 for each equal digit where only the first letters agree, else 0."""
    x, y = soundex(a), soundex(b)
    digits = sum((F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in (2, 3, 4)), F.lit(0))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 0.9).when(F.substring(x, 1, 1) == F.substring(y, 1, 1), F.round(0.5 + digits * 0.1, 6)).otherwise(0.0)
