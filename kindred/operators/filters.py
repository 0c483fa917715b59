"""Filters over people: each returns a Column or, for relatives, a narrowed DataFrame. Text matches ignore case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(column: str, text: str) -> Column:
    return F.lower(F.col(column)).contains(text.lower())


def equals(column: str, text: str) -> Column:
    return F.lower(F.col(column)) == text.lower()


def starts(column: str, text: str) -> Column:
    return F.lower(F.col(column)).startswith(text.lower())


def ends(column: str, text: str) -> Column:
    return F.lower(F.col(column)).endswith(text.lower())


def born_between(first: str, last: str) -> Column:
    return F.col("birth_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))


def born_before(year: int) -> Column:
    """Inclusive of the year."""
    return F.col("birth_date") <= F.make_date(F.lit(year), F.lit(12), F.lit(31))


def born_after(year: int) -> Column:
    """Inclusive of the year."""
    return F.col("birth_date") >= F.make_date(F.lit(year), F.lit(1), F.lit(1))


def born_in(year: int) -> Column:
    return born_between(f"{year:04d}-01-01", f"{year:04d}-12-31")


def born_in_month(month: int) -> Column:
    return F.lit(True) if not 1 <= month <= 12 else F.month("birth_date") == month


def born_on_day(day: int) -> Column:
    return F.lit(True) if not 1 <= day <= 31 else F.dayofmonth("birth_date") == day


def born_in_months(first: int, last: int) -> Column:
    """From one month to another, over the new year where the first is later. Months that don't exist make no filter."""
    if not (1 <= first <= 12 and 1 <= last <= 12):
        return F.lit(True)
    m = F.month("birth_date")
    return m.between(first, last) if first <= last else (m >= first) | (m <= last)


def born_on_days(first: int, last: int) -> Column:
    if not (1 <= first <= 31 and 1 <= last <= 31):
        return F.lit(True)
    d = F.dayofmonth("birth_date")
    return d.between(first, last) if first <= last else (d >= first) | (d <= last)


def born_between_days(first: tuple[int, int], last: tuple[int, int]) -> Column:
    """(month, day) to (month, day) of any year, over the new year where the first is later."""
    at, a, b = F.month("birth_date") * 100 + F.dayofmonth("birth_date"), first[0] * 100 + first[1], last[0] * 100 + last[1]
    return at.between(a, b) if a <= b else (at >= a) | (at <= b)


def sex(value: str) -> Column:
    return F.upper("sex") == value.upper()


def living() -> Column:
    return F.col("death_date").isNull()


def deceased() -> Column:
    return F.col("death_date").isNotNull()


def with_relatives(people: DataFrame, edges: DataFrame, column: str, want: bool = True) -> DataFrame:
    """Has or lacks children (parent_edge, parent) or a spouse (spouse_edge, a)."""
    keys = edges.select(F.col(column).alias("xref"))
    return people.join(keys, "xref", "left_semi" if want else "left_anti")


def top(people: DataFrame, order: str, n: int) -> DataFrame:
    """Sorted, then limited; missing values last."""
    return people.orderBy(F.col(order).asc_nulls_last(), "xref").limit(n)


def word_index(people: DataFrame, *columns: str) -> DataFrame:
    """(word, xref): the lower-case words of the columns, an inverted index; written by word it serves lookups without a scan."""
    text = F.lower(F.concat_ws(" ", *columns))
    return people.select(F.explode(F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("word"), "xref")


def search(index: DataFrame, words: str) -> DataFrame:
    """(xref) of those that have every word; a word ending in * is a beginning."""
    conds = [F.col("word").startswith(w[:-1]) if w.endswith("*") else F.col("word") == w for w in words.lower().split()]
    some, every = F.lit(False), F.lit(True)
    for i, c in enumerate(conds):
        some, every = some | c, every & F.col(f"_{i}")
    found = index.filter(some).groupBy("xref").agg(F.count("*").alias("_n"), *[F.max(c).alias(f"_{i}") for i, c in enumerate(conds)])
    return found.filter(every).select("xref")
