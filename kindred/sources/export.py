"""Rows for files: people with their relatives, nested documents, issues and search results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def people_rows(p) -> DataFrame:
    """A row a person: its columns, father, mother, spouses and children (sorted lists)."""
    edge = p.parent_edge
    by = lambda df, key, value, name: df.groupBy(F.col(key).alias("xref")).agg(F.array_sort(F.collect_set(value)).alias(name))
    parents = edge.groupBy(F.col("child").alias("xref")).agg(F.min(F.when(F.col("role") == "father", F.col("parent"))).alias("father"), F.min(F.when(F.col("role") == "mother", F.col("parent"))).alias("mother"))
    out = p.individuals.join(parents, "xref", "left").join(by(p.spouse_edge, "a", "b", "spouses"), "xref", "left")
    return out.join(by(edge, "parent", "child", "children"), "xref", "left")


def csv_rows(p) -> DataFrame:
    """``people_rows`` for CSV: lists joined by semicolons."""
    df = people_rows(p)
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def documents(p) -> DataFrame:
    """(kind, id, body): a nested struct a person or family, with their events; ``write.json`` or the XML writer make files of it."""
    row = lambda kind, key, df: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*[c for c in df.columns])).alias("body"))
    events = None
    if p.events is not None:
        events = p.events.groupBy("owner_type", "owner").agg(F.array_sort(F.collect_list(F.struct("event_id", "type", "custom_type", "date", "place"))).alias("events"))
    people, families = people_rows(p), p.families
    if events is not None:
        people = people.join(events.filter("owner_type = 'I'").select(F.col("owner").alias("xref"), "events"), "xref", "left")
        families = families.join(events.filter("owner_type = 'F'").select(F.col("owner").alias("family"), "events"), "family", "left")
    kids = p.children.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "child"))), lambda x: x["child"]).alias("children"))
    return row("person", "xref", people).unionByName(row("family", "family", families.join(kids, "family", "left")))


def issue_lines(issues: DataFrame) -> DataFrame:
    """(value): a validation report, the most severe first: counts of each rule, then an issue a line."""
    rank = F.array_position(F.array(*map(F.lit, ("severe", "warning", "info", "hint"))), F.col("severity"))
    counts = issues.groupBy("severity", "rule").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), rank.alias("rank"), "rule", F.lit("").alias("x"), F.format_string("%s: %s (%d)", "severity", "rule", "n").alias("value"))
    each = issues.select(F.lit(1).alias("part"), rank.alias("rank"), "rule", F.col("xref").cast("string").alias("x"), F.concat(F.upper("severity"), F.lit(" "), "rule", F.lit(": "), F.col("xref").cast("string"), F.coalesce(F.concat(F.lit(" ("), F.col("detail").cast("string"), F.lit(")")), F.lit(""))).alias("value"))
    return counts.unionByName(each).orderBy("part", "rank", "rule", "x").select("value")


def search_lines(people: DataFrame) -> DataFrame:
    """(value): one line a person: xref, name, sex, birth and death years."""
    year = lambda c: F.coalesce(F.year(c).cast("string"), F.lit(""))
    return people.orderBy("xref").select(F.concat(F.col("xref").cast("string"), F.lit("\t"), F.coalesce(F.trim(F.translate("name", "/", "")), F.lit("")), F.lit("\t"), F.coalesce("sex", F.lit("")), F.lit("\t"), year("birth_date"), F.lit("-"), year("death_date")).alias("value"))
