"""The algebra of parsed dates (``scalars.parse_date``), ranges and durations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import scalars as S

RANGES = ("between", "from_to")


def is_valid(p: Column) -> Column:
    return p["type"] != "invalid"


def is_range(p: Column) -> Column:
    return p["type"].isin(*RANGES)


def constraint(p: Column) -> Column:
    """about, before, after, or exact for everything else."""
    return F.when(p["type"].isin("about", "before", "after"), p["type"]).otherwise("exact")


def constraint_of_word(word: Column) -> Column:
    w = F.upper(F.trim(F.coalesce(word, F.lit(""))))
    out = None
    for name in ("about", "before", "after"):
        hit = w.rlike("^(?:" + "|".join(S.WORDS[name]) + ")$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("exact")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by first days; 0 where a date is invalid."""
    return F.when(is_valid(a) & is_valid(b), F.signum(F.datediff(S.earliest(a), S.earliest(b))).cast("int")).otherwise(0)


def is_before(a: Column, b: Column) -> Column:
    return F.coalesce(S.years(a) < S.years(b), F.lit(False))


def is_after(a: Column, b: Column) -> Column:
    return F.coalesce(S.years(a) > S.years(b), F.lit(False))


def is_exact(p: Column) -> Column:
    """A single day without a word before it."""
    return F.coalesce((p["type"] == "exact") & p["d"].isNotNull() & p["m"].isNotNull(), F.lit(False))


def is_zero(p: Column) -> Column:
    return p["y"].isNull() & p["m"].isNull() & p["d"].isNull() & p["y2"].isNull()


def same(a: Column, b: Column) -> Column:
    """Equal in every part and in the constraint."""
    parts = F.lit(True)
    for k in ("y", "m", "d", "y2", "m2", "d2"):
        parts = parts & a[k].eqNullSafe(b[k])
    return is_valid(a) & is_valid(b) & (is_range(a) == is_range(b)) & (constraint(a) == constraint(b)) & parts


def equals(a: Column, b: Column) -> Column:
    """Whether the dates may be the same, given their words: 3 Sep 1943 equals BEF Oct 1943. Never where one is invalid."""
    parts = F.lit(True)
    for k in ("y", "m", "d"):
        parts = parts & a[k].eqNullSafe(b[k])
    day = ~is_range(a) & ~is_range(b) & parts
    x, y = constraint(a), constraint(b)
    near = lambda c: c.isin("exact", "about")
    less, more = S.years(a) < S.years(b), S.years(a) > S.years(b)
    by = (F.when(near(x) & near(y), day)
          .when((x == "before") & (y == "exact"), more).when((x == "exact") & (y == "before"), less)
          .when((x == "after") & (y == "exact"), less).when((x == "exact") & (y == "after"), more)
          .when((x == "before") & (y == "before"), less).when((x == "after") & (y == "after"), more).otherwise(False))
    return F.coalesce(is_valid(a) & is_valid(b) & (same(a, b) | by), F.lit(False))


def _written(y: Column, m: Column, d: Column) -> Column:
    months = F.array(*[F.lit(x[:3]) for x in S.MONTHS])
    return F.concat_ws(" ", F.when(m.isNotNull(), d.cast("string")), F.get(months, m - 1), y.cast("string"))


def to_string(p: Column, original: Column) -> Column:
    """GEDCOM notation; the original text of an invalid date."""
    first, second = _written(p["y"], p["m"], p["d"]), _written(p["y2"], p["m2"], p["d2"])
    return (F.when(~is_valid(p), original).when(p["type"] == "between", F.concat(F.lit("BET "), first, F.lit(" AND "), second)).when(p["type"] == "from_to", F.concat(F.lit("FROM "), first, F.lit(" TO "), second))
            .when(p["type"] == "exact", first).otherwise(F.concat(F.upper(p["type"]), F.lit(" "), first)))


def days_between(a: Column, b: Column) -> Column:
    """Signed days from b to a by first days; null where a date is invalid."""
    return F.datediff(S.earliest(a), S.earliest(b))


def duration_text(days: Column) -> Column:
    """Years of 365 days, months of 30.4166 and days, each left out at zero; under a day it is one day."""
    n = F.abs(days)
    y = F.floor(n / 365)
    rest = n - y * 365
    m = F.floor(rest / 30.4166)
    d = F.ceil(F.round(rest - m * 30.4166, 6))
    word = lambda k, name: F.when(k == 1, f"one {name}").when(k > 1, F.concat(k.cast("string"), F.lit(f" {name}s")))
    return F.when(n < 1, "one day").otherwise(F.concat_ws(" and ", word(y, "year"), word(m, "month"), word(d, "day")))


# ranges: a pair of dates, for a single date twice the same

def range_of(text: Column) -> Column:
    """struct(start, end, phrase): the ends of BET .. AND .., else the date twice; phrase: the text stands in brackets."""
    t = S.squeeze(F.coalesce(text, F.lit("")))
    pattern = r"(?i)^(?:BET(?:WEEN|\.)?|FROM) (.+) (?:AND|TO|-) (.+)$"
    two = t.rlike(pattern)
    side = lambda g: S.parse_date(F.when(two, F.regexp_extract(t, pattern, g)).otherwise(t))
    return F.struct(side(1).alias("start"), side(2).alias("end"), t.rlike(r"^\(.*\)$").alias("phrase"))


def range_years(r: Column) -> Column:
    return (S.years(r["start"]) + S.years(r["end"])) / 2


def range_similarity(a: Column, b: Column, most: float = 3.0) -> Column:
    gap = F.abs(F.coalesce(range_years(a), F.lit(0.0)) - F.coalesce(range_years(b), F.lit(0.0))) / most
    return F.when(gap > 1, 0.0).otherwise(1 - gap * gap)


def range_equals(a: Column, b: Column) -> Column:
    return equals(a["start"], b["start"]) & equals(a["end"], b["end"])


def range_before(a: Column, b: Column) -> Column:
    return is_before(a["start"], b["start"])


def range_after(a: Column, b: Column) -> Column:
    return is_after(a["end"], b["end"])


def range_valid(r: Column) -> Column:
    return ~is_zero(r["start"]) & ~is_zero(r["end"])


def range_exact(r: Column) -> Column:
    return is_exact(r["start"]) & is_exact(r["end"]) & equals(r["start"], r["end"])


def range_days(r: Column) -> Column:
    """Days from the first day of the start to the last of the end; null where one is invalid."""
    return F.datediff(S.latest(r["end"]), S.earliest(r["start"]))


# matching and comparing for records

def matches(p: Column, year: int = 0, month: int = 0, day: int = 0) -> Column:
    """Whether a parsed date (a column, as it is read many times) is of the given day; 0 is any. Of a range, whether the day (missing parts: the range's first) lies inside; its ends reach over a missing month or day."""
    first, last = S.earliest(p), F.make_date(p["y2"], F.coalesce(p["m2"], F.lit(12)), F.lit(1))
    last = F.when(p["d2"].isNull() | p["m2"].isNull(), F.last_day(last)).otherwise(F.make_date(p["y2"], p["m2"], p["d2"]))
    part = lambda given, own: F.lit(given) if given else own
    aim = F.date_add(F.make_date(part(year, F.year(first)), part(month, F.month(first)), F.lit(1)), (day or 1) - 1)
    hit = F.lit(True)
    for want, own in ((year, "y"), (month, "m"), (day, "d")):
        if want:
            hit = hit & F.coalesce(p[own] == want, F.lit(False))
    return F.coalesce(F.when(~is_valid(p), False).when(is_range(p), aim.between(first, last)).otherwise(hit), F.lit(False))


def year_range(p: Column, tolerance: int = 2) -> Column:
    """struct(s, e): the years that a date may mean. About: the tolerance to both sides; before and after: twice of it to one side; to: fifty years."""
    y = p["y"]
    t = p["type"]
    start = F.when(t == "about", y - tolerance).when(t == "before", y - 2 * tolerance).when(t == "to", y - 50).when(t != "invalid", y)
    end = F.when(t == "about", y + tolerance).when(t == "after", y + 2 * tolerance).when(is_range(p), p["y2"]).when(t != "invalid", y)
    return F.struct(start.alias("s"), end.alias("e"))


def _by_gap(gap: Column) -> Column:
    return F.when(gap == 0, 1.0).when(gap <= 1, 0.9).when(gap <= 2, 0.8).when(gap <= 5, 0.7).when(gap <= 10, 0.5).otherwise(0.0)


def overlap_score(a: Column, b: Column) -> Column:
    """Of two year ranges: by the share of the overlap in their mean length; of two single years by their gap."""
    n = F.greatest(F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]) + 1, F.lit(0))
    share = n / ((a["e"] - a["s"] + 1 + b["e"] - b["s"] + 1) / 2.0)
    apart = F.when((a["s"] == a["e"]) & (b["s"] == b["e"]), _by_gap(F.abs(a["s"] - b["s"]))).otherwise(0.0)
    return F.when(n <= 0, apart).when(share >= 1, 1.0).when(share >= 0.8, 0.9).when(share >= 0.6, 0.8).when(share >= 0.4, 0.7).when(share >= 0.2, 0.5).otherwise(0.3)


def text_score(a: Column, b: Column) -> Column:
    """Of date texts that don't parse: equal, by the gap of their years, else half the texts' similarity."""
    x, y = S.normalize_text(a), S.normalize_text(b)
    gap = F.abs(S.extract_year(a) - S.extract_year(b))
    return F.when(x == y, 1.0).when(gap.isNotNull(), _by_gap(gap)).otherwise(S.string_similarity(x, y) * 0.5)


def equivalent(x: Column, y: Column, tolerance: int = 2) -> Column:
    """Parsed dates whose years are at most the tolerance apart."""
    return F.coalesce(is_valid(x) & is_valid(y) & (F.abs(x["y"] - y["y"]) <= tolerance), F.lit(False))
