"""Distinct-by collections and name analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def distinct_by(df: DataFrame, key: list[str], pick: str) -> DataFrame:
    """One row for each key: that with the least ``pick``. Aggregates before the shuffle, so hot keys are harmless."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), pick).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def most_common(people: DataFrame, column: str, n: int = 10) -> DataFrame:
    name = F.lower(F.trim(column))
    return people.filter(name != "").groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n if n > 0 else 10)


def name_keys(people: DataFrame, key: str) -> DataFrame:
    """(key): the distinct full_name, given, surname, given_surname (``g|s``) or surname_given of people; empty ones left out."""
    from kindred.functions import scalars as S

    g, s = F.coalesce("given", F.lit("")), F.coalesce("surname", F.lit(""))
    of = {"full_name": S.squeeze(F.translate(F.coalesce("name", F.lit("")), "/", "")), "given": g, "surname": s, "given_surname": F.concat(g, F.lit("|"), s), "surname_given": F.concat(s, F.lit("|"), g)}
    return people.select(of[key].alias("key")).filter("key not in ('', '|')").distinct()


def unique_names(people: DataFrame) -> DataFrame:
    """(kind, value): the distinct given names and surnames."""
    part = lambda c: people.filter(F.coalesce(c, F.lit("")) != "").select(F.lit(c).alias("kind"), F.col(c).alias("value"))
    return part("given").unionByName(part("surname")).distinct()


def places(p, births: bool = True, deaths: bool = True, marriages: bool = True) -> DataFrame:
    """(source, owner, place): places of births, other events of people, marriages, and always of divorces."""
    kind = F.when(F.col("type") == "BIRT", "birth").when(F.col("type") == "DEAT", "death").when(F.col("type") == "MARR", "marriage").when(F.col("type") == "DIV", "divorce")
    wanted = [k for k, w in (("birth", births), ("death", deaths), ("marriage", marriages), ("divorce", True)) if w]
    return p.events.select(kind.alias("source"), "owner", "place").filter(F.col("source").isin(wanted) & (F.coalesce("place", F.lit("")) != ""))


def place_keys(places: DataFrame, key: str) -> DataFrame:
    """(key): the distinct full_string, city, state, country or city_state of places; a text without parts stands for itself."""
    from kindred.functions import scalars as S

    x = S.parse_place(F.col("place"))
    of = {"full_string": F.col("place"), "city": x["city"], "state": x["state"], "country": x["country"], "city_state": F.concat(F.coalesce(x["city"], F.lit("")), F.lit("|"), F.coalesce(x["state"], F.lit("")))}
    return places.select(F.when(F.size(S.place_parts(F.col("place"))) > 0, of[key]).otherwise(F.col("place")).alias("key")).filter("key is not null and key not in ('', '|')").distinct()


FAMILY_KEYS = {"xref": ["family"], "husband": ["husband"], "wife": ["wife"], "children_count": ["n_children"], "marriage_date": ["marriage_date"], "marriage_place": ["marriage_place"], "husband_wife": ["husband", "wife"]}
EVENT_KEYS = {"id": ["event_id"], "type": ["type"], "date": ["date"], "place": ["place"], "type_date": ["type", "date"], "type_place": ["type", "place"], "owner": ["owner_type", "owner"]}


def unique_families(p, by: str) -> DataFrame:
    """Families, one for each key (that with the least number); families without the key are left out, but for husband_wife."""
    counts = p.children.groupBy("family").agg(F.count("*").alias("n_children"))
    rows = p.families.join(counts, "family", "left").fillna(0, ["n_children"])
    key = FAMILY_KEYS[by]
    if by != "husband_wife":
        rows = rows.filter(F.col(key[0]).isNotNull())
    return rows if by == "xref" else distinct_by(rows, key, "family")


def unique_events(events: DataFrame, by: str, types: list[str] | None = None) -> DataFrame:
    """Events of the given types, one for each key (that with the least id); events without the key's first part are left out."""
    rows = events.filter(F.col("type").isin(types)) if types else events
    key = EVENT_KEYS[by]
    for c in key:
        rows = rows.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return rows.dropDuplicates(["event_id"]) if by == "id" else distinct_by(rows, key, "event_id")
