"""Changes of a pedigree: nodes and edges added and removed, as new DataFrames over the old ones; writing and reading a saved pedigree."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.pedigree import Pedigree

TABLES = ("individuals", "families", "children", "events", "notes", "shared")


def _with(p: Pedigree, **tables) -> Pedigree:
    return replace(p, _kept={}, **tables)


def add_people(p: Pedigree, people: DataFrame) -> Pedigree:
    """New rows replace those of the same xref."""
    return _with(p, individuals=p.individuals.join(people.select("xref"), "xref", "left_anti").unionByName(people, allowMissingColumns=True))


def duplicate_ids(p: Pedigree, people: DataFrame) -> DataFrame:
    """(xref) of new people whose xref is taken, in the pedigree or among themselves."""
    every = p.individuals.select("xref").unionByName(people.select("xref"))
    return every.groupBy("xref").count().filter("count > 1").select("xref").join(people.select("xref"), "xref", "left_semi")


def remove_people(p: Pedigree, xrefs: DataFrame) -> Pedigree:
    """People and every link and event of theirs go; families stay, without them."""
    gone = xrefs.select(F.col("xref").alias("_gone")).distinct()
    cut = lambda df, c: df.join(gone, F.col(c) == F.col("_gone"), "left").withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).drop("_gone")
    events = p.events and p.events.join(gone, (F.col("owner_type") == "I") & (F.col("owner") == F.col("_gone")), "left_anti")
    return _with(p, individuals=p.individuals.join(gone, F.col("xref") == F.col("_gone"), "left_anti"), families=cut(cut(p.families, "husband"), "wife"), children=p.children.join(gone, F.col("child") == F.col("_gone"), "left_anti"), events=events)


def add_families(p: Pedigree, families: DataFrame, children: DataFrame | None = None) -> Pedigree:
    new = p.families.join(families.select("family"), "family", "left_anti").unionByName(families, allowMissingColumns=True)
    kids = p.children if children is None else p.children.join(families.select("family"), "family", "left_anti").unionByName(children)
    return _with(p, families=new, children=kids)


def remove_families(p: Pedigree, families: DataFrame) -> Pedigree:
    keys = families.select("family").distinct()
    events = p.events and p.events.join(keys, (F.col("owner_type") == "F") & (F.col("owner") == F.col("family")), "left_anti")
    return _with(p, families=p.families.join(keys, "family", "left_anti"), children=p.children.join(keys, "family", "left_anti"), events=events)


def add_child(p: Pedigree, links: DataFrame) -> Pedigree:
    """links(family, child): appended after the family's children; links that are there already stay single."""
    new = links.select("family", "child").distinct().join(p.children.select("family", "child"), ["family", "child"], "left_anti")
    last = p.children.groupBy("family").agg((F.max("ordinal") + 1).alias("next"))
    new = new.join(last, "family", "left").select("family", "child", F.coalesce("next", F.lit(0)).cast(dict(p.children.dtypes)["ordinal"]).alias("ordinal"))
    return _with(p, children=p.children.unionByName(new))


def remove_child(p: Pedigree, links: DataFrame) -> Pedigree:
    return _with(p, children=p.children.join(links.select("family", "child").distinct(), ["family", "child"], "left_anti"))


def save(p: Pedigree, path: str) -> None:
    """Every table as Parquet below ``path``: columnar files in place of rows, keys and values."""
    for name in TABLES:
        if (df := getattr(p, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, tables: tuple[str, ...] = TABLES[:3]) -> Pedigree:
    return Pedigree(**{name: spark.read.parquet(f"{path}/{name}") for name in tables})
