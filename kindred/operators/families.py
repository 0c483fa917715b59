"""Families with their people and facts, events of people and families, and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import dates as D
from kindred.functions import scalars as S


def members(p) -> DataFrame:
    """(family, xref, role, ordinal): husband, wife and children as the records say; repeated children stay repeated."""
    f = p.families
    couple = f.select("family", F.expr("inline(array(struct(husband as xref, 'husband' as role), struct(wife as xref, 'wife' as role)))")).filter("xref is not null")
    kids = p.children.select("family", F.col("child").alias("xref"), F.lit("child").alias("role"), F.col("ordinal").cast("long").alias("ordinal"))
    return couple.withColumn("ordinal", F.lit(None).cast("long")).unionByName(kids)


def family(p, xref) -> DataFrame:
    """The members of one family who have records; a family without a record has none."""
    return members(p).filter(F.col("family") == xref).join(p.individuals.select("xref"), "xref", "left_semi").select("xref", "role", "ordinal")


def parents_of_family(p, xref) -> DataFrame:
    return family(p, xref).filter("role != 'child'").select("xref", "role")


def facts(p) -> DataFrame:
    """(family, marriage_date, marriage_place, divorce_date, divorce_place, n_children, years): years: full years of the marriage to the divorce."""
    counts = p.children.groupBy("family").agg(F.count("*").alias("n_children"))
    f = p.families.join(counts, "family", "left").fillna(0, ["n_children"])
    return f.select("family", "marriage_date", "marriage_place", "divorce_date", "divorce_place", "n_children", F.floor(F.months_between("divorce_date", "marriage_date") / 12).cast("long").alias("years"))


def families_of(p) -> DataFrame:
    """(xref, family, role, spouse): the families in which a person is a spouse or child, and the other spouse if known."""
    m, f = members(p), p.families
    spouse = F.when(F.col("role") == "husband", F.col("wife")).when(F.col("role") == "wife", F.col("husband"))
    return m.join(f.select("family", "husband", "wife"), "family", "left").select("xref", "family", "role", spouse.alias("spouse"))


def families_with_spouse(p, a, b) -> DataFrame:
    """Families in which both are spouses."""
    return families_of(p).filter((F.col("xref") == a) & (F.col("spouse") == b)).select("family")


def families_with_unknown_spouse(p) -> DataFrame:
    """(xref, family) of people who are the only spouse told."""
    return families_of(p).filter("role != 'child' and spouse is null").select("xref", "family")


def has_child(p) -> DataFrame:
    """(family, child), each once."""
    return p.children.select("family", "child").distinct()


# events

def events_of(p, kind: str, owner) -> DataFrame:
    """Events of one person (``I``) or family (``F``); of events alike in type and date, that with the least id."""
    rows = p.events.filter((F.col("owner_type") == kind) & (F.col("owner") == owner))
    rest = [c for c in rows.columns if c not in ("type", "date")]
    return rows.groupBy("type", "date").agg(F.min_by(F.struct(*rest), "event_id").alias("_r")).select("type", "date", *[F.col(f"_r.{c}").alias(c) for c in rest])


def owners_of(p, event_id: str) -> DataFrame:
    return p.events.filter(F.col("event_id") == event_id).select("owner_type", "owner").distinct()


def events_on(p, year: int = 0, month: int = 0, day: int = 0, kind: str | None = None) -> DataFrame:
    """Events on a date (0: any), of one type if given."""
    parsed = p.events.withColumn("_p", F.explode(F.array(S.parse_date(F.col("date")))))  # a generator: the filter isn't pushed below it, which would write the parse into each of its uses
    rows = parsed.filter(D.matches(F.col("_p"), year, month, day)).drop("_p")
    return rows.filter(F.col("type") == kind) if kind else rows


def event_table(p) -> DataFrame:
    """Events with their effective type, whether the type is a standard one, and the first day of their date."""
    rows = p.events.withColumn("_p", S.parse_date(F.col("date")))
    return rows.select("event_id", "owner_type", "owner", "type", S.effective_type(F.col("type"), F.col("custom_type")).alias("effective"), S.valid_event(F.col("type")).alias("standard"), S.earliest(F.col("_p")).alias("day"), "place")


def vital_events(p) -> DataFrame:
    """(xref, birth, death, ...): the date texts of people's first events of each vital type."""
    types = {"birth": "BIRT", "death": "DEAT", "baptism": "BAPM", "burial": "BURI", "occupation": "OCCU"}
    first = lambda t: F.min_by(F.when(F.col("type") == t, F.col("date")), F.when(F.col("type") == t, F.col("event_id")))
    return p.events.filter("owner_type = 'I'").groupBy(F.col("owner").alias("xref")).agg(*[first(t).alias(n) for n, t in types.items()])


# notes

def notes_of(p) -> DataFrame:
    """(owner, note, text) of every person and family: shared notes that they refer to (of those that exist) and inline notes."""
    refs = p.notes.filter("note is not null").select("owner", "note").join(p.shared, "note").select("owner", "note", "text")
    return refs.unionByName(p.notes.filter("note is null").select("owner", "note", "text"))


def records_for_note(p, note: str) -> DataFrame:
    """(owner) of the records that refer to a shared note, told or not."""
    return p.notes.filter(F.col("note") == note).select("owner").distinct()


def note_edges(p) -> DataFrame:
    """(src, dst, edge_type): references to notes and events as edges of the graph, one way."""
    notes = p.notes.filter("note is not null").join(p.shared.select("note"), "note", "left_semi").select(F.col("owner").alias("src"), F.col("note").alias("dst"), F.lit("NOTE").alias("edge_type"))
    events = p.events.select(F.concat("owner_type", F.col("owner").cast("string")).alias("src"), F.col("event_id").alias("dst"), F.lit("HAS_EVENT").alias("edge_type"))
    return notes.unionByName(events)


def graph_nodes(p) -> DataFrame:
    """(node, kind) of people, families, shared notes and events."""
    named = lambda df, letter, key, kind: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("node"), F.lit(kind).alias("kind"))
    return named(p.individuals, "I", "xref", "person").unionByName(named(p.families, "F", "family", "family")).unionByName(named(p.shared, "", "note", "note")).unionByName(named(p.events, "", "event_id", "event"))
