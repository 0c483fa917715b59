"""Differences of two snapshots, field by field, by key, by content or both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import dates as D
from kindred.functions import scalars as S


def diff(old: DataFrame, new: DataFrame, key: str = "xref") -> DataFrame:
    """(key, change, field, old, new): added and removed records, and one row for each field that differs."""
    fields = [c for c in old.columns if c != key and c in new.columns]
    side = lambda df, to: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(to))
    j = side(old, "o").join(side(new, "n"), key, "full_outer")
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").alias("old"), F.col(f"n.{c}").alias("new")) for c in fields])
    one = F.when(F.col("o").isNull() | F.col("n").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))).otherwise(F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"])))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    return j.select(key, change.alias("change"), F.explode(one).alias("r")).select(key, "change", "r.field", "r.old", "r.new")


def match_content(old: DataFrame, new: DataFrame, content: list[str], key: str = "xref") -> DataFrame:
    """(old_key, new_key, how): records matched by key, and those whose key only one side has by equal content (case-folded, all of it present), where just one such record a side has it. Counting comes before the shuffle, so common content is harmless."""

    def alone(df, other, name):
        rest = df.join(other.select(key), key, "left_anti").select(key, *[F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in content]).dropna(subset=content)
        return rest.groupBy(*content).agg(F.min(key).alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")

    same = old.select(F.col(key).alias("old_key")).join(new.select(F.col(key).alias("new_key")), F.col("old_key") == F.col("new_key")).withColumn("how", F.lit("key"))
    return same.unionByName(alone(old, new, "old_key").join(alone(new, old, "new_key"), content).select("old_key", "new_key", F.lit("content").alias("how")))


def diff_hybrid(old: DataFrame, new: DataFrame, content: list[str], key: str = "xref") -> DataFrame:
    """As ``diff``, but records matched by content are compared, not reported as removed and added; their key is the old one."""
    moved = match_content(old, new, content, key).filter("how = 'content'").select("old_key", "new_key")
    named = new.join(moved, F.col(key) == F.col("new_key"), "left").withColumn(key, F.coalesce("old_key", key)).select(*new.columns)
    return diff(old, named, key)


def family_diff(old, new, tolerance: int = 2) -> DataFrame:
    """(family, change, field, old, new) of two pedigrees' families: husband, wife, marriage date and place, and each child that only one side has. Dates whose years are near and places that differ in case or blanks alone are equivalent, not modified."""
    def side(p, name):
        f = p.families.select("family", F.struct(*[F.col(c).cast("string").alias(c) for c in ("husband", "wife", "marriage_date", "marriage_place")]).alias(name))
        kids = p.children.groupBy("family").agg(F.array_sort(F.collect_set(F.col("child").cast("string"))).alias(f"{name}_kids"))
        return f.join(kids, "family", "left")

    j = side(old, "o").join(side(new, "n"), "family", "full_outer")
    none = F.lit(None).cast("string")
    row = lambda change, field, a, b: F.struct(change.alias("change"), F.lit(field).alias("field"), a.alias("old"), b.alias("new"))
    year = lambda c: F.year(F.to_date(c))
    alike = {"marriage_date": F.abs(year(F.col("o.marriage_date")) - year(F.col("n.marriage_date"))) <= tolerance, "marriage_place": S.normalize_text(F.col("o.marriage_place")) == S.normalize_text(F.col("n.marriage_place"))}
    fields = []
    for c in ("husband", "wife", "marriage_date", "marriage_place"):
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        change = F.when(F.coalesce(alike[c], F.lit(False)) & a.isNotNull() & b.isNotNull(), "equivalent").otherwise("modified") if c in alike else F.lit("modified")
        fields.append(F.when(~a.eqNullSafe(b), row(change, c, a, b)))
    empty = F.array().cast("array<string>")
    o, n = F.coalesce("o_kids", empty), F.coalesce("n_kids", empty)
    changed = F.concat(F.array_compact(F.array(*fields)), F.transform(F.array_except(o, n), lambda k: row(F.lit("removed"), "child", k, none)), F.transform(F.array_except(n, o), lambda k: row(F.lit("added"), "child", none, k)))
    whole = lambda change: F.array(row(F.lit(change), "family", none, none))
    rows = F.when(F.col("o").isNull(), whole("added")).when(F.col("n").isNull(), whole("removed")).otherwise(changed)
    return j.select("family", F.explode(rows).alias("r")).select("family", "r.*")


def date_change(a, b, parsed_a, parsed_b, tolerance: int = 2):
    """same, equivalent (years near), added, removed or modified, of two date texts and what they parse to."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(x == y, "same").when(x == "", "added").when(y == "", "removed").when(D.equivalent(parsed_a, parsed_b, tolerance), "equivalent").otherwise("modified")


def place_change(a, b):
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(x == y, "same").when(x == "", "added").when(y == "", "removed").when(S.normalize_text(a) == S.normalize_text(b), "equivalent").otherwise("modified")


def person_changes(old: DataFrame, new: DataFrame, key: str = "xref") -> DataFrame:
    """(key, field, change, old, new) of people that both sides have: name, given, surname, sex, birth date text and place, each that is not the same. A birth that one side lacks is modified; a date or place judged equivalent is still listed."""
    fields = ["name", "given", "surname", "sex", "birth_text", "birth_place"]
    side = lambda df, to: df.select(key, F.struct(*fields).alias(to), S.parse_date(F.col("birth_text")).alias(f"{to}_born"))
    j = side(old, "o").join(side(new, "n"), key)
    rows = []
    for c in fields:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        judged = date_change(a, b, F.col("o_born"), F.col("n_born")) if c == "birth_text" else place_change(a, b) if c == "birth_place" else F.when(F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit("")), "same").otherwise("modified")
        judged = F.when(judged.isin("added", "removed"), "modified").otherwise(judged)
        rows.append(F.when(judged != "same", F.struct(F.lit(c).alias("field"), judged.alias("change"), a.alias("old"), b.alias("new"))))
    return j.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*")


def by_content(old: DataFrame, new: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, score) of people alike at or above the threshold, whatever their keys: duplicates between the snapshots."""
    from kindred.operators import duplicates

    return duplicates.find_between(old, new, duplicates.Config(threshold=threshold)).select("a", "b", "score")


def history(changes: DataFrame, at=None) -> DataFrame:
    """Changes with the time they were recorded."""
    return changes.withColumn("recorded_at", F.current_timestamp() if at is None else F.lit(at).cast("timestamp"))


def report(changes: DataFrame, key: str = "xref", most: int = 20) -> str:
    """Text: counts by change, and the first ``most`` changes in order of the key (a listing's limit; the counts are of all)."""
    counts = {r.change: r.n for r in changes.groupBy("change").agg(F.countDistinct(key).alias("n")).collect()}
    lines = ["Differences", "===========", *(f"{c}: {counts[c]}" for c in sorted(counts)), ""]
    for r in changes.orderBy(key, "change", "field").limit(most).collect():
        lines.append(f"{r.change} {r[key]}" + (f" {r.field}: {r.old} -> {r.new}" if r.field else ""))
    return "\n".join(lines)
