"""Validation rules over a pedigree, checks of its graph, and the quality report. A rule is a function of the pedigree that gives issues; all are joins and expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES: dict[str, Callable] = {}


def rule(f: Callable) -> Callable:
    """Registers ``f(pedigree) -> DataFrame(xref, detail)``."""
    RULES[f.__name__] = f
    return f


def _age(born: Column, at: Column) -> Column:
    return F.year(at) - F.year(born) - F.when(F.date_format(at, "MMdd") < F.date_format(born, "MMdd"), 1).otherwise(0)


@rule
def missing_birth(p) -> DataFrame:
    return p.individuals.filter("birth_date is null").select("xref", F.lit(None).cast("long").alias("detail"))


@rule
def death_before_birth(p) -> DataFrame:
    return p.individuals.filter("death_date < birth_date").select("xref", F.datediff("birth_date", "death_date").cast("long").alias("detail"))


@rule
def parent_age(p, youngest: int = 10, oldest: int = 80) -> DataFrame:
    """Parents younger than ``youngest`` or older than ``oldest`` at a child's birth."""
    i = p.individuals.select("xref", "birth_date")
    c, q = i.toDF("child", "child_birth"), i.toDF("parent", "parent_birth")
    age = _age(F.col("parent_birth"), F.col("child_birth"))
    return p.parent_edge.join(c, "child").join(q, "parent").withColumn("detail", age.cast("long")).filter((F.col("detail") < youngest) | (F.col("detail") > oldest)).select(F.col("parent").alias("xref"), "detail")


@rule
def marriage_age(p, youngest: int = 12, oldest: int = 100) -> DataFrame:
    i = p.individuals.select("xref", "birth_date")
    f = p.families.select("marriage_date", F.expr("inline(array(struct(husband as xref), struct(wife as xref)))"))
    return f.join(i, "xref").withColumn("detail", _age(F.col("birth_date"), F.col("marriage_date")).cast("long")).filter((F.col("detail") < youngest) | (F.col("detail") > oldest)).select("xref", "detail")


@rule
def dangling_refs(p) -> DataFrame:
    """Husbands, wives and children that no person record has."""
    refs = p.families.select(F.expr("inline(array(struct(husband as xref), struct(wife as xref)))")).union(p.children.select("child")).filter("xref is not null").distinct()
    return refs.join(p.individuals.select("xref"), "xref", "left_anti").select("xref", F.lit(None).cast("long").alias("detail"))


@rule
def missing_parents(p) -> DataFrame:
    return p.individuals.join(p.parent_edge.select(F.col("child").alias("xref")), "xref", "left_anti").select("xref", F.lit(None).cast("long").alias("detail"))


def _born(p, key: str, born: str) -> DataFrame:
    return p.individuals.select(F.col("xref").alias(key), F.col("birth_date").alias(born))


@rule
def age_at_death(p, oldest: int = 120) -> DataFrame:
    age = _age(F.col("birth_date"), F.col("death_date"))
    return p.individuals.filter("death_date >= birth_date").select("xref", age.cast("long").alias("detail")).filter(F.col("detail") > oldest)


@rule
def missing_death(p, as_of: int = 2025, oldest: int = 100) -> DataFrame:
    """No death, and over ``oldest`` years old in the year ``as_of``."""
    return p.individuals.filter("death_date is null").select("xref", (F.lit(as_of) - F.year("birth_date")).cast("long").alias("detail")).filter(F.col("detail") > oldest)


@rule
def marriage_before_birth(p) -> DataFrame:
    f = p.families.select("marriage_date", F.expr("inline(array(struct(husband as xref), struct(wife as xref)))"))
    return f.join(_born(p, "xref", "born"), "xref").filter("marriage_date < born").select("xref", F.datediff("born", "marriage_date").cast("long").alias("detail"))


@rule
def divorce_before_marriage(p) -> DataFrame:
    return p.families.filter("divorce_date < marriage_date").select(F.col("family").alias("xref"), F.datediff("marriage_date", "divorce_date").cast("long").alias("detail"))


@rule
def long_marriage(p, longest: int = 80) -> DataFrame:
    return p.families.filter("divorce_date >= marriage_date").select(F.col("family").alias("xref"), _age(F.col("marriage_date"), F.col("divorce_date")).cast("long").alias("detail")).filter(F.col("detail") > longest)


@rule
def child_before_marriage(p, months: int = 9) -> DataFrame:
    """Children born over ``months`` months of 30 days before the marriage; detail: the months."""
    j = p.children.join(p.families.select("family", "marriage_date"), "family").join(_born(p, "child", "born"), "child")
    return j.select(F.col("child").alias("xref"), F.floor(F.datediff("marriage_date", "born") / 30).cast("long").alias("detail")).filter(F.col("detail") > months)


@rule
def child_before_parent(p) -> DataFrame:
    j = p.parent_edge.join(_born(p, "child", "c"), "child").join(_born(p, "parent", "q"), "parent")
    return j.filter("c < q").select(F.col("child").alias("xref"), F.datediff("q", "c").cast("long").alias("detail"))


@rule
def sibling_gap(p, widest: int = 50) -> DataFrame:
    """Neighbouring children of a family whose births, in the order of the record, are over ``widest`` years apart, forwards."""
    from pyspark.sql import Window as W

    c = p.children.withColumn("next", F.lead("child").over(W.partitionBy("family").orderBy("ordinal", "child")))
    j = c.join(_born(p, "child", "c"), "child").join(_born(p, "next", "n"), "next")
    return j.select(F.col("child").alias("xref"), _age(F.col("c"), F.col("n")).cast("long").alias("detail")).filter(F.col("detail") > widest)


@rule
def no_partners(p) -> DataFrame:
    return p.families.filter("husband is null and wife is null").select(F.col("family").alias("xref"), F.lit(None).cast("long").alias("detail"))


@rule
def orphan_nodes(p) -> DataFrame:
    """People without any family link."""
    linked = p.families.select(F.expr("inline(array(struct(husband as xref), struct(wife as xref)))")).union(p.children.select("child")).filter("xref is not null")
    return p.individuals.join(linked, "xref", "left_anti").select("xref", F.lit(None).cast("long").alias("detail"))


@rule
def own_ancestor(p) -> DataFrame:
    return p.cycles().select("xref", F.lit(None).cast("long").alias("detail"))


def graph_issues(p) -> DataFrame:
    """(check, src, dst) of family links whose end has no record."""
    nodes = p.individuals.select(F.concat(F.lit("I"), F.col("xref").cast("string")).alias("node")).union(p.families.select(F.concat(F.lit("F"), F.col("family").cast("string"))))
    out = None
    for end in ("src", "dst"):
        part = p.edges.join(nodes, F.col(end) == F.col("node"), "left_anti").select(F.lit(f"{end}_missing").alias("check"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


def one_way_links(links: DataFrame, p) -> DataFrame:
    """links(xref, family, tag) as people's own records tell them (FAMS, FAMC) -> (xref, family, tag, issue): those that the family's record does not return, and links of families that the person's record lacks."""
    from kindred.operators.families import members

    m = members(p).select("xref", "family", F.when(F.col("role") == "child", "FAMC").otherwise("FAMS").alias("tag")).distinct()
    lacking = lambda a, b, issue: a.join(b, ["xref", "family", "tag"], "left_anti").select("xref", "family", "tag", F.lit(issue).alias("issue"))
    own = links.select("xref", "family", "tag").distinct()
    return lacking(own, m, "not_in_family").unionByName(lacking(m, own, "not_in_person"))


SEVERITY = {"death_before_birth": "severe", "dangling_refs": "severe", "marriage_before_birth": "severe", "divorce_before_marriage": "severe", "child_before_parent": "severe", "own_ancestor": "severe",
            "parent_age": "warning", "marriage_age": "warning", "age_at_death": "warning", "long_marriage": "warning", "sibling_gap": "warning", "no_partners": "warning", "orphan_nodes": "warning",
            "missing_birth": "info", "missing_parents": "info", "missing_death": "info", "child_before_marriage": "info"}
DATES = ["missing_birth", "death_before_birth", "age_at_death", "missing_death", "marriage_before_birth", "marriage_age", "divorce_before_marriage", "long_marriage", "child_before_marriage", "parent_age", "child_before_parent", "sibling_gap"]
RELATIONS, REFERENCES = ["no_partners", "orphan_nodes", "own_ancestor", "missing_parents"], ["dangling_refs"]
LEVELS = ["hint", "info", "warning", "severe"]


def validate(p, names: list[str] | None = None, least: str = "hint") -> DataFrame:
    """(rule, severity, xref, detail) of the rules at or above a severity."""
    out = None
    for n in names or list(RULES):
        if LEVELS.index(SEVERITY.get(n, "info")) < LEVELS.index(least):
            continue
        part = RULES[n](p).select(F.lit(n).alias("rule"), F.lit(SEVERITY.get(n, "info")).alias("severity"), "xref", "detail")
        out = part if out is None else out.unionByName(part)
    return out


def completeness(people: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6)
    return people.agg(*[share(c).alias(c) for c in ("name", "birth_date", "death_date", "birth_place", "sex")])


def quality_report(p, names: list[str] | None = None) -> DataFrame:
    """One row: people, families, issues by severity and by category, completeness, consistency, accuracy and the overall score (0.4, 0.3 and 0.3 of them), in percent."""
    issues = validate(p, names)
    n = lambda cond: F.count(F.when(cond, 1))
    r = F.col("rule")
    found = issues.agg(*[n(F.col("severity") == s).alias(s) for s in ("severe", "warning", "info")], n(r.isin(DATES)).alias("date_issues"), n(r.isin(RELATIONS)).alias("relation_issues"), n(r.isin(REFERENCES)).alias("reference_issues"))
    share = lambda c: F.coalesce(F.avg(F.col(c).isNotNull().cast("double")) * 100, F.lit(0.0)).alias(f"{c}_pct")
    people = p.individuals.agg(F.count("*").alias("people"), share("name"), share("birth_date"), share("birth_place"), share("death_date"))
    families = p.families.agg(F.count("*").alias("families"), share("marriage_date"))
    all_ = people.join(families).join(found)  # one row each
    complete = (F.col("name_pct") + F.col("birth_date_pct") + F.col("birth_place_pct") + F.col("death_date_pct") + F.col("marriage_date_pct")) / 5
    rate = lambda c: F.when(F.col("people") > 0, F.greatest(F.lit(0.0), 100 - c / F.col("people") * 100)).otherwise(100.0)
    out = all_.select("people", "families", "severe", "warning", "info", "date_issues", "relation_issues", "reference_issues", F.round(complete, 6).alias("completeness"),
                      F.round(rate(F.col("date_issues") + F.col("relation_issues") + F.col("reference_issues")), 6).alias("consistency"), F.round(rate(F.col("severe") + F.col("warning")), 6).alias("accuracy"), "name_pct", "birth_date_pct", "birth_place_pct")
    return out.withColumn("overall", F.round(F.col("completeness") * 0.4 + F.col("consistency") * 0.3 + F.col("accuracy") * 0.3, 6))


def recommendations(report: DataFrame) -> DataFrame:
    """(advice) that follows from a quality report."""
    add = lambda what, c: F.format_string(f"Add {what} for %.1f%% of individuals", 100 - F.col(c))
    count = lambda text, c: F.format_string(text, F.col(c))
    rules = [(F.col("name_pct") < 90, add("names", "name_pct")), (F.col("birth_date_pct") < 80, add("birth dates", "birth_date_pct")), (F.col("birth_place_pct") < 70, add("birth places", "birth_place_pct")),
             (F.col("date_issues") > 0, count("Fix %d date consistency issues", "date_issues")), (F.col("relation_issues") > 0, count("Fix %d relationship issues", "relation_issues")), (F.col("reference_issues") > 0, count("Fix %d cross-reference issues", "reference_issues")),
             (F.col("severe") > 0, count("Address %d severe errors", "severe")), (F.col("warning") > 10, count("Review %d warnings", "warning")), (F.col("overall") < 70, F.lit("Clean the data: the overall score is below 70%"))]
    told = F.array_compact(F.array(*[F.when(c, t) for c, t in rules]))
    return report.select(F.explode(F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("No major issues")))).alias("advice"))
