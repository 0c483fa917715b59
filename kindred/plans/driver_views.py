"""A deterministic pedigree over the star-schema tables, so that every query has an ANSI SQL counterpart.

People are customers; everything about them follows from the key by integer formulas, the same in SQL and in Spark: names with
sound-alikes, imprecise dates, places, missing values, deaths before births, single people, repeated people (every fiftieth is one
more record of the one before), a child that no record has, events and notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.pedigree import Pedigree

SURNAMES = ["Smith", "Smyth", "Schmidt", "Johnson", "Jonson", "van der Berg", "Clark", "Clarke", "Brown", "Braun", "Taylor", "Tailor", "Moore", "More", "Young", "Allen", "Allan", "Wright", "Reid", "Reed", "O'Neil", "ONeill", "Martin", "Marten", "Cooper"]
GIVEN = ["John", "Jon", "Mary", "Marie", "Anna", "Ann", "William", "Will", "Robert", "Rupert", "Elisabeth", "Elizabeth", "Catherine", "Karl", "Carl", "Emma", "George"]
CITIES = ["York", "Paris", "Boston", "Leeds", "Albany", "Dublin", "Hamburg"]
STATES = ["New York", "Ne", "Texas", "Kent", "Yorkshire"]
LANDS = ["USA", "England", "France", "Ireland"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
STEPS = [6]
while len(STEPS) < 40:
    STEPS.append(-(-STEPS[-1] * 3 // 2))  # first key of each generation: a parent's key is about two thirds of the child's


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], index: str, spark: bool) -> str:
    quoted = ", ".join("'" + v.replace("'", "\\'" if spark else "''") + "'" for v in values)
    return f"element_at(array({quoted}), CAST({index} AS INT) + 1)" if spark else f"([{quoted}])[({index}) + 1]"


def _columns(spark: bool) -> list[dict[str, str]]:
    """Steps of column definitions over ``k``; both engines read them. b is the key that names and births follow from."""
    div = (lambda a, b: f"({a} div {b})") if spark else (lambda a, b: f"({a} // {b})")
    pick = lambda v, i: _pick(v, i, spark)
    generation = " + ".join(f"CASE WHEN k >= {s} THEN 1 ELSE 0 END" for s in STEPS)
    text = lambda e: f"CAST({e} AS STRING)" if spark else f"CAST({e} AS VARCHAR)"
    day = lambda y, m, d: f"make_date(CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT))"
    join = lambda *x: "concat(" + ", ".join(x) + ")"
    return [
        {"b": "CASE WHEN k % 50 = 49 THEN k - 1 ELSE k END", "g": generation},
        {"given": f"CASE WHEN b % 29 = 11 THEN NULL ELSE {pick(GIVEN, 'b % 17')} END", "surname": f"CASE WHEN b % 43 = 7 THEN NULL ELSE {pick(SURNAMES, div('b', 3) + ' % 25')} END",
         "y": f"CASE WHEN b % 19 = 5 THEN NULL ELSE 1500 + 27 * g + b % 9 + CASE WHEN k % 100 = 99 THEN 1 ELSE 0 END - CASE WHEN k % 61 = 7 THEN 60 ELSE 0 END END", "m": f"1 + {div('b', 3)} % 12", "d": "1 + b % 28"},
        {"name": f"CASE WHEN given IS NULL AND surname IS NULL THEN NULL ELSE {join("coalesce(given, '')", "' /'", "coalesce(surname, '')", "'/'")} END",
         "birth_date": f"CASE WHEN y IS NULL THEN NULL ELSE {day('y', 'm', 'd')} END",
         "bt": "CASE WHEN y IS NULL THEN NULL WHEN b % 41 = 3 THEN 9 ELSE b % 9 END"},
        {"birth_text": "CASE WHEN y IS NULL THEN NULL WHEN bt = 1 THEN " + join(pick(MONTHS, "m - 1"), "' '", text("y")) + " WHEN bt = 2 THEN " + text("y") + " WHEN bt = 3 THEN " + join("'ABT '", text("y")) + " WHEN bt = 4 THEN " + join("'BEF '", text("y")) + " WHEN bt = 5 THEN " + join("'AFT '", text("y"))
         + " WHEN bt = 6 THEN " + join("'BET '", text("y"), "' AND '", text("y + 3")) + " WHEN bt = 7 THEN " + join("'from '", text("y"), "' to '", text("y + 2")) + " WHEN bt = 9 THEN " + join("'about the year '", text("y"), "' or so'") + " ELSE " + join(text("d"), "' '", pick(MONTHS, "m - 1"), "' '", text("y")) + " END",
         "death_date": f"CASE WHEN y IS NULL OR k % 3 <> 0 THEN NULL WHEN k % 99 = 0 THEN {day('y - 1', 'm', 'd')} ELSE {day('y + (k * 37) % 131', '1 + k % 12', 'd')} END",
         "birth_place": "CASE WHEN b % 23 = 9 THEN NULL WHEN b % 5 = 2 THEN " + join(pick(CITIES, "b % 7"), "', '", pick(LANDS, "b % 4")) + " ELSE " + join(pick(CITIES, "b % 7"), "', '", pick(STATES, div("b", 2) + " % 5"), "', '", pick(LANDS, "b % 4")) + " END",
         "sex": "CASE WHEN k % 47 = 0 THEN 'U' WHEN k % 6 < 3 THEN 'M' ELSE 'F' END"},
    ]


PERSON = ["xref", "name", "given", "surname", "sex", "birth_date", "death_date", "birth_place", "birth_text"]


def _sql_person() -> str:
    inner = "SELECT c_custkey AS xref, c_custkey AS k FROM customer"
    for step in _columns(False):
        inner = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM ({inner})"
    return f"SELECT {', '.join(PERSON)}, y AS birth_year, bt FROM ({inner})"


FAMILY = {  # over h, the husband's key, and hy, the husband's year of birth
    "family": "3 * (h DIV 6) + h % 3", "husband": "CASE WHEN h % 31 = 1 OR h % 53 = 4 THEN NULL ELSE h END", "wife": "CASE WHEN h % 29 = 2 OR h % 53 = 4 THEN NULL ELSE h + 3 END",
    "marriage_date": "CASE WHEN hy IS NULL OR h % 13 = 6 THEN NULL ELSE make_date(CAST(hy + CASE WHEN h % 37 = 0 THEN 5 ELSE 18 + h % 30 END AS INT), CAST(1 + h % 12 AS INT), CAST(1 + h % 28 AS INT)) END",
    "marriage_place": "CASE WHEN h % 4 = 0 THEN NULL WHEN h % 4 = 1 THEN 'Leeds, Kent, England' ELSE 'Paris, France' END",
    "divorce_date": "CASE WHEN hy IS NULL OR h % 7 <> 2 THEN NULL ELSE make_date(CAST(hy + 17 + h % 30 + h % 89 AS INT), CAST(1 + h % 12 AS INT), CAST(1 + h % 28 AS INT)) END",
    "divorce_place": "CASE WHEN h % 14 = 2 THEN 'Albany, New York, USA' ELSE NULL END"}
#: Children beyond the formula: one that no record has.
STRAY = [(1, 900_000_001, 9)]
EVENTS = [  # owner kind, condition over the row, event id prefix, type, custom type, date text, place
    ("I", "birth_text IS NOT NULL OR birth_place IS NOT NULL", "B", "BIRT", "NULL", "birth_text", "birth_place"),
    ("I", "death_date IS NOT NULL", "D", "DEAT", "NULL", "CAST(year(death_date) AS STRING)", "NULL"),
    ("I", "xref % 4 = 1", "O", "OCCU", "NULL", "CASE WHEN xref % 8 = 1 THEN 'MAY 1700' ELSE NULL END", "'Leeds, Kent, England'"),
    ("I", "xref % 9 = 4", "E", "EVEN", "'Census'", "'3 MAR 1800'", "NULL"),
    ("F", "marriage_date IS NOT NULL", "M", "MARR", "NULL", "CAST(year(marriage_date) AS STRING)", "marriage_place"),
    ("F", "divorce_date IS NOT NULL", "V", "DIV", "NULL", "concat('ABT ', CAST(year(divorce_date) AS STRING))", "divorce_place"),
]


def _event_sql(spark: bool) -> list[tuple[str, str]]:
    text = (lambda e: e) if spark else (lambda e: e.replace("STRING", "VARCHAR"))
    out = []
    for kind, cond, letter, tag, custom, date, place in EVENTS:
        owner = "xref" if kind == "I" else "family"
        cast = "CAST({} AS STRING)" if spark else "CAST({} AS VARCHAR)"
        out.append((kind, f"concat('{letter}', {cast.format(owner)}) AS event_id, {owner} AS owner, '{kind}' AS owner_type, '{tag}' AS type, {cast.format(custom)} AS custom_type, {cast.format(text(date))} AS date, {cast.format(place)} AS place FROM {{}} WHERE {cond}"))
    return out


def _sql() -> str:
    fam = ", ".join(f"{e.replace(' DIV ', ' // ')} AS {n}" for n, e in FAMILY.items())
    ev = " UNION ALL ".join("SELECT " + x.format("ind" if kind == "I" else "fam") for kind, x in _event_sql(False))
    stray = " ".join(f"UNION ALL SELECT {f}, {c}, {o}" for f, c, o in STRAY)
    return f"""WITH RECURSIVE ind AS ({_sql_person()}),
fam AS (SELECT {fam} FROM (SELECT xref AS h, birth_year AS hy FROM ind WHERE xref % 6 < 3)),
chil AS (SELECT (c_custkey - 6) // 3 AS family, c_custkey AS child, c_custkey % 3 AS ordinal FROM customer WHERE c_custkey >= 6 {stray}),
pe AS (SELECT child, parent, role, family FROM (SELECT child, husband AS parent, 'father' AS role, family FROM chil JOIN fam USING (family) UNION ALL SELECT child, wife, 'mother', family FROM chil JOIN fam USING (family)) WHERE parent IN (SELECT xref FROM ind)),
se AS (SELECT a, b, family FROM (SELECT husband AS a, wife AS b, family FROM fam UNION ALL SELECT wife, husband, family FROM fam) WHERE a IS NOT NULL AND b IS NOT NULL),
sib AS (SELECT x.child AS a, y.child AS b, x.family FROM chil x JOIN chil y ON x.family = y.family AND x.child <> y.child),
edge AS (SELECT 'F' || family AS src, 'I' || husband AS dst, 'HUSB' AS edge_type FROM fam WHERE husband IS NOT NULL UNION ALL SELECT 'I' || husband, 'F' || family, 'FAMS' FROM fam WHERE husband IS NOT NULL
 UNION ALL SELECT 'F' || family, 'I' || wife, 'WIFE' FROM fam WHERE wife IS NOT NULL UNION ALL SELECT 'I' || wife, 'F' || family, 'FAMS' FROM fam WHERE wife IS NOT NULL
 UNION ALL SELECT 'F' || family, 'I' || child, 'CHIL' FROM chil UNION ALL SELECT 'I' || child, 'F' || family, 'FAMC' FROM chil),
ev AS ({ev}),
note AS (SELECT 'I' || xref AS owner, 'N' || (xref % 5) AS note, CAST(NULL AS VARCHAR) AS text FROM ind WHERE xref % 10 = 3 UNION ALL SELECT 'I' || xref, NULL, 'seen ' || xref FROM ind WHERE xref % 15 = 3 UNION ALL SELECT 'F' || family, 'N' || (family % 5), NULL FROM fam WHERE family % 12 = 0),
shared AS (SELECT 'N' || i AS note, 'shared note ' || i AS text FROM range(0, 4) AS r(i))"""


#: The same views in SQL, for the oracles.
SQL = _sql()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pedigree(spark: SparkSession, sf_dir: str) -> Pedigree:
    c = table(spark, sf_dir, "customer")
    people = c.select(F.col("c_custkey").alias("xref"), F.col("c_custkey").alias("k"))
    for step in _columns(True):
        people = people.select("*", *[F.expr(e).alias(n) for n, e in step.items()])
    husbands = people.filter("k % 6 < 3").select(F.col("k").alias("h"), F.col("y").alias("hy"))
    families = husbands.select(*[F.expr(e.replace("DIV", "div")).alias(n) for n, e in FAMILY.items()])
    children = c.filter("c_custkey >= 6").select(F.expr("(c_custkey - 6) div 3").alias("family"), F.col("c_custkey").alias("child"), (F.col("c_custkey") % 3).alias("ordinal"))
    children = children.unionByName(spark.createDataFrame(STRAY, "family long, child long, ordinal long"))
    people = people.select(*PERSON)
    events = None
    for kind, x in _event_sql(True):
        what, cond = x.split(" FROM {} WHERE ")
        part = (people if kind == "I" else families).filter(cond).selectExpr(*_split(what))
        events = part if events is None else events.unionByName(part)
    text = lambda df, key, cond, note, words: df.filter(cond).select(F.concat(F.lit("I" if key == "xref" else "F"), F.col(key).cast("string")).alias("owner"), note.alias("note"), words.alias("text"))
    ref = lambda key: F.concat(F.lit("N"), (F.col(key) % 5).cast("string"))
    none = F.lit(None).cast("string")
    notes = text(people, "xref", "xref % 10 = 3", ref("xref"), none).unionByName(text(people, "xref", "xref % 15 = 3", none, F.concat(F.lit("seen "), F.col("xref").cast("string")))).unionByName(text(families, "family", "family % 12 = 0", ref("family"), none))
    shared = spark.range(4).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("note"), F.concat(F.lit("shared note "), F.col("id").cast("string")).alias("text"))
    return Pedigree(people, families, children, events, notes, shared)


def _split(columns: str) -> list[str]:
    """Column expressions of a select list, cut at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [x.strip() for x in [*out, columns[last:]]]
