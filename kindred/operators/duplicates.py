"""Duplicates: people blocked by phonetic surname and others keys, scored by name, birth, place, sex and relatives.

people: (xref, name, given, surname, sex, birth_text, birth_place). Blocks of any size are dealt into chunks and joined chunk by
chunk, with the compared columns along, so that a hot block goes to many tasks and no pair is joined to the people again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import dates as D
from kindred.functions import scalars as S
from kindred.operators import cells
from kindred.plans.store import materialize, settled


@dataclass(frozen=True)
class Config:
    """Thresholds and weights of the score; ``tolerance`` in years; ``largest`` for the limited candidate search, ``most`` candidates each."""

    threshold: float = 0.60
    high: float = 0.85
    exact: float = 0.95
    name: float = 0.40
    date: float = 0.30
    place: float = 0.15
    sex: float = 0.05
    relation: float = 0.10
    tolerance: int = 2
    largest: int = 5000
    most: int = 200


DEFAULT = Config()
# Words that surnames begin with, and words of places that tell nothing.
PARTICLES = ["van", "von", "de", "del", "der", "den", "du", "le", "la", "les"]
COMMON = ["THE", "OF", "IN", "ON", "AT", "TO", "FOR", "AND", "OR", "COUNTY", "CITY", "TOWN", "STATE", "PROVINCE"]
#: What is worked out for a person once, before pairs are made.
COMPARED = ["n_name", "n_given", "n_surname", "sex", "birth_text", "years", "n_place", "place"]


def spread(people: DataFrame) -> DataFrame:
    """``people`` over all cores: a small file is read by one task, which would work out what follows for everyone alone."""
    return people.repartition(4 * people.sparkSession.sparkContext.defaultParallelism, "xref")


def prepared(people: DataFrame, tolerance: int = 2) -> DataFrame:
    """people with normalised name, given name, surname and place, the years that the birth may mean (null if not parsed) and the parts of the place."""
    people = settled(people, {"_born": S.parse_date(F.col("birth_text"))})
    born = F.col("_born")
    return settled(people, {"n_name": S.normalize_name(F.col("name")), "n_given": S.normalize_text(F.col("given")), "n_surname": S.normalize_text(F.col("surname")), "n_place": S.normalize_text(F.col("birth_place")), "sex": F.upper(F.trim(F.coalesce("sex", F.lit("")))),
                            "birth_text": F.trim(F.coalesce("birth_text", F.lit(""))), "years": F.when(D.is_valid(born), D.year_range(born, tolerance)), "place": S.parse_place(F.col("birth_place"))}).drop("_born")


def surname_of(surname: Column, name: Column) -> Column:
    """The surname, or what the name has between slashes."""
    own = S.normalize_text(surname)
    return F.when(own != "", own).otherwise(S.normalize_text(F.regexp_extract(F.coalesce(name, F.lit("")), "/([^/]*)/", 1)))


def features(people: DataFrame) -> DataFrame:
    """people with sx (phonetic surname), head (its first four letters), initial, two (given letters), year and token (of the place); empty text or null where missing."""
    upper = lambda c: F.filter(F.split(F.upper(S.normalize_text(F.col(c))), " "), lambda w: w != "")
    people = settled(people, {"_s": surname_of(F.col("surname"), F.col("name")), "_g": F.upper(S.normalize_text(F.col("given"))), "_p": upper("birth_place"), "year": S.extract_year(F.col("birth_text"))})
    words = F.split("_s", " ")
    own = F.filter(words, lambda w: ~w.isin(PARTICLES))
    good = F.filter("_p", lambda w: (F.octet_length(w) > 2) & ~w.isin(COMMON))
    people = settled(people, {"_l": F.when(F.size(words) < 2, F.col("_s")).otherwise(F.coalesce(F.try_element_at(own, F.lit(-1)), F.col("_s"))), "token": F.coalesce(F.get(good, F.lit(0)), F.get("_p", F.lit(0)), F.lit(""))})
    last = F.col("_l")
    return settled(people, {"sx": S.soundex(last), "head": F.when(last == "", "").otherwise(F.upper(F.rpad(F.substring(last, 1, 4), 4, " "))), "initial": F.substring("_g", 1, 1), "two": F.substring("_g", 1, 2)}).drop("_s", "_g", "_p", "_l")


def key_columns(expanded: bool = True) -> Column:
    """The block keys of ``features``: P surname and year, Y the same with neighbouring years, B with five-year span, I with the initial, G with two given letters, X surname's head and place. The rescue key of three given letters can't arise, as two are kept."""
    text = lambda tag, *c: F.concat_ws("|", F.lit(tag), *c)
    named, dated = F.col("sx") != "", F.col("year") > 0
    keys = [F.when(named & dated, text("P", F.col("sx"), F.col("year").cast("string"))), F.when(named & dated, text("B", F.col("sx"), F.floor(F.col("year") / 5).cast("string"))),
            F.when(named & (F.col("initial") != ""), text("I", F.col("sx"), F.col("initial"))), F.when(named & (F.length("two") > 1), text("G", F.col("sx"), F.col("two"))),
            F.when((F.col("head") != "") & (F.col("token") != ""), text("X", F.col("head"), F.col("token")))]
    if expanded:
        keys += [F.when(named & dated & (F.col("year") + k > 0), text("Y", F.col("sx"), (F.col("year") + k).cast("string"))) for k in (-1, 0, 1)]
    return F.array_compact(F.array(*keys))


def block_sizes(people: DataFrame) -> DataFrame:
    """(key, n): the first letter of a key is its kind."""
    return features(people).select(F.explode(key_columns()).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def joined(people: DataFrame, chunk: int = 1000, tolerance: int = 2) -> DataFrame:
    """(a, b) structs of the pairs, a.xref < b.xref, that share a block of any size or have sound-alike surnames and birth years at most three apart. Each pair comes once, from the least of its common keys. Years at most three apart share one of two eight-year spans, four years set off."""
    wide = F.filter(key_columns(False), lambda k: F.substring(k, 1, 1).isin("B", "I", "X"))  # P lies within the near years, G within I
    spans = F.when((F.col("sx") != "") & (F.col("year") > 0), F.array(*[F.concat_ws("|", F.lit(z), F.col("sx"), F.floor((F.col("year") + k) / 8).cast("string")) for z, k in (("Z0", 0), ("Z4", 4))]))
    keys = F.concat(wide, F.coalesce(spans, F.array().cast("array<string>")))
    f = settled(prepared(features(people), tolerance), {"keys": keys})
    f = materialize(f.select(F.struct("xref", *COMPARED, "sx", "head", "initial", "two", "year", "token", "keys").alias("p")))  # a row a person, read by both sides
    keyed = f.withColumn("key", F.explode("p.keys"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    keyed = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("p.xref"), F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    # dealt by hand: rows are few and pairs many, and adaptive execution would put all into one task
    cells = max(1, int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = keyed.select("key", F.col("own").alias("i"), every.alias("j"), F.col("p").alias("a")).repartition(cells, "key", "i", "j")
    b = keyed.select("key", every.alias("i"), F.col("own").alias("j"), F.col("p").alias("b")).repartition(cells, "key", "i", "j")
    pairs = a.join(b, ["key", "i", "j"]).filter("a.xref < b.xref").filter(F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("key"))
    return pairs.filter(~F.col("key").startswith("Z") | (F.abs(F.col("a.year") - F.col("b.year")) <= 3)).select("a", "b")


def dealt_blocks(f: DataFrame, chunk: int, more: tuple = ()) -> DataFrame:
    """``features`` -> rows of cells, a row for each of a person's keys: those of ``joined``."""
    text = lambda tag, *c: F.concat_ws("|", F.lit(tag), *c)
    named, dated = F.col("sx") != "", F.col("year") > 0
    keys = [F.when(named & (F.col("initial") != ""), text("I", F.col("sx"), F.col("initial"))), F.when((F.col("head") != "") & (F.col("token") != ""), text("X", F.col("head"), F.col("token")))]
    keys += [F.when(named & dated, text(f"Z{k}", F.col("sx"), F.floor((F.col("year") + k) / 8).cast("string"))) for k in (0, 4)]
    rows = f.select("xref", "sx", "initial", "head", "token", F.coalesce("year", F.lit(0)).alias("year"), *more, F.explode(F.array_compact(F.array(*keys))).alias("key"))
    return cells.dealt(materialize(rows), chunk)


def candidate_pairs(people: DataFrame, chunk: int = cells.CHUNK) -> DataFrame:
    """(a, b): every pair of ``joined``, compared cell by cell as arrays."""
    kind = dict(people.dtypes)["xref"]
    return dealt_blocks(features(spread(people)), chunk).mapInArrow(cells.listed, f"a {kind}, b {kind}")


def candidate_counts(people: DataFrame, chunk: int = cells.CHUNK) -> DataFrame:
    """(a, n): how many of ``candidate_pairs`` have a, where any; the pairs are counted in their cells, not made."""
    return dealt_blocks(features(spread(people)), chunk).mapInArrow(cells.counts, f"a {dict(people.dtypes)['xref']}, n long").groupBy("a").agg(F.sum("n").alias("n"))


def priority(a: Column, b: Column) -> Column:
    """How likely a candidate is: 10 and more for sound-alike surnames and near years, 5 for a five-year span, 3, 2 and 1 for the further keys."""
    gap = F.abs(a["year"] - b["year"])
    both = (a["sx"] == b["sx"]) & (a["sx"] != "")
    near = F.when(gap == 0, 15).when(gap == 1, 13).when(gap <= 3, 11)
    near = near + F.when(a["head"] == b["head"], 3).otherwise(0) + F.when((a["token"] != "") & (a["token"] == b["token"]), 2).otherwise(0) + F.when((a["two"] != "") & (a["two"] == b["two"]), 2).otherwise(0)
    return (F.when(both & (gap <= 3), near).when(both & (F.floor(a["year"] / 5) == F.floor(b["year"] / 5)), 5).when(both & (a["initial"] != "") & (a["initial"] == b["initial"]), 3).otherwise(1))


def name_score(a: Column, b: Column) -> Column:
    x, y = a["n_name"], b["n_name"]
    part = lambda c: F.when((a[c] != "") & (b[c] != ""), S.string_similarity(a[c], b[c])).otherwise(0.0)
    given, surname, full = part("n_given"), part("n_surname"), S.string_similarity(x, y)
    mean = (given + surname) / 2
    return (F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when((given >= 0.8) & (surname >= 0.8), mean).when(full > mean, full)
            .when((given > 0) & (surname > 0), mean).when(given > 0, given * 0.7).when(surname > 0, surname * 0.7).when(x.contains(y) | y.contains(x), 0.6).otherwise(0.0))


def date_score(a: Column, b: Column) -> Column:
    x, y = a["years"], b["years"]
    score = F.when(x.isNotNull() & y.isNotNull(), D.overlap_score(x, y)).otherwise(D.text_score(a["birth_text"], b["birth_text"]))
    return F.when((a["birth_text"] == "") | (b["birth_text"] == ""), 0.0).otherwise(score)


def place_score(a: Column, b: Column) -> Column:
    """Equal texts 1; else the mean over city, state and country that both have: equal 1, a state's abbreviation 0.9, else 0.7 of the texts' similarity."""
    total, n = F.lit(0.0), F.lit(0)
    for c in ("city", "state", "country"):
        x, y = a["place"][c], b["place"][c]
        alike = F.when(S.normalize_text(x) == S.normalize_text(y), 1.0)
        if c == "state":
            alike = alike.when(S.is_abbreviation(x, y), 0.9)
        both = x.isNotNull() & y.isNotNull()
        total, n = total + F.when(both, alike.otherwise(S.string_similarity(x, y) * 0.7)).otherwise(0.0), n + F.when(both, 1).otherwise(0)
    return F.when((a["n_place"] == "") | (b["n_place"] == ""), 0.0).when(a["n_place"] == b["n_place"], 1.0).when(n == 0, 0.0).otherwise(total / n)


def sex_score(a: Column, b: Column) -> Column:
    return F.when(a["sex"].isin("", "U") | b["sex"].isin("", "U"), 0.5).when(a["sex"] == b["sex"], 1.0).otherwise(0.0)


def relation_scores(pairs: DataFrame, p) -> DataFrame:
    """(a, b, relation_score) of the pairs with shared relatives: parents 0.1 each up to 0.2, a spouse 0.2, children 0.1 each up to 0.3, over 0.7."""
    links = None
    for kind in ("parents", "spouses", "children"):
        part = p.relatives(kind).select(F.lit(kind).alias("kind"), F.col("xref").alias("x"), "relative")
        links = part if links is None else links.unionByName(part)
    links = p.kept("relations", lambda: links)
    shared = pairs.select("a", "b").distinct().join(links.withColumnRenamed("x", "a"), "a").join(links.withColumnRenamed("x", "b"), ["b", "kind", "relative"])
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    score = F.least(n("parents") * 0.1, F.lit(0.2)) + F.when(n("spouses") > 0, 0.2).otherwise(0.0) + F.least(n("children") * 0.1, F.lit(0.3))
    return shared.groupBy("a", "b").agg(F.round(score / 0.7, 6).alias("relation_score"))


def _shares_relative(p) -> DataFrame:
    """(a, b): people with a common parent, spouse or child, from the edges alone: few beside the candidate pairs."""
    out = None
    for kind in ("parents", "spouses", "children"):
        r = p.kept(f"rel-{kind}", lambda kind=kind: p.relatives(kind))
        part = r.select(F.col("xref").alias("a"), "relative").join(r.select(F.col("xref").alias("b"), "relative"), "relative").filter("a < b").select("a", "b")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def scored(pairs: DataFrame, relations: DataFrame | None = None, c: Config = DEFAULT) -> DataFrame:
    """(a, b) structs -> a row for each pair at or above the threshold: the scores, confidence, matching and differing fields. Pairs that can't reach it with the best relation score are left out before relations are joined."""
    a, b = F.col("a"), F.col("b")
    s = pairs.select(a["xref"].alias("a"), b["xref"].alias("b"), name_score(a, b).alias("name_score"), date_score(a, b).alias("date_score"), place_score(a, b).alias("place_score"), sex_score(a, b).alias("sex_score"))
    s = s.withColumn("base", _base(c)).filter(F.col("base") >= c.threshold - (c.relation if relations is not None else 0) - 1e-6)
    s = s.join(relations, ["a", "b"], "left").fillna(0.0, ["relation_score"]) if relations is not None else s.withColumn("relation_score", F.lit(0.0))
    return judged(s.drop("base"), c)


def _base(c: Config) -> Column:
    return F.col("name_score") * c.name + F.col("date_score") * c.date + F.col("place_score") * c.place + F.col("sex_score") * c.sex


def judged(s: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Pairs with all parts of their scores -> those at or above the threshold, with what is said of them."""
    s = s.withColumn("score", F.round(_base(c) + F.col("relation_score") * c.relation, 6)).filter(F.col("score") >= c.threshold)
    fields = [("name", "name_score"), ("birth_date", "date_score"), ("birth_place", "place_score"), ("sex", "sex_score")]
    alike = F.array_compact(F.array(*[F.when(F.col(k) >= 0.8, n) for n, k in fields]))
    differ = F.array_compact(F.array(*[F.when((F.col(k) < 0.5) if n == "sex" else (F.col(k) > 0) & (F.col(k) < 0.8), n) for n, k in fields]))
    confidence = F.when(F.col("score") >= c.exact, "exact").when(F.col("score") >= c.high, "high").when(F.col("score") >= 0.70, "medium").otherwise("low")
    six = [F.round(k, 6).alias(k) for k in ("name_score", "date_score", "place_score")]
    return s.select("a", "b", *six, "sex_score", "relation_score", "score", confidence.alias("confidence"), F.array_join(alike, ",").alias("alike"), F.array_join(differ, ",").alias("differ"))


def numbered(people: DataFrame, c: Config, most: int):
    """``prepared`` people with the numbers of what their scores follow from, and the parts of the score of each two; None where these are too many. Of a birth that parses, and of any where all texts have a year, only the years count: so the texts of one year are one."""
    dated = S.extract_year(F.col("birth_text"))
    lacks = people.filter((F.col("birth_text") != "") & dated.isNull()).limit(1)
    if people.filter((F.col("birth_text") != "") & F.col("years").isNull()).isEmpty() or lacks.isEmpty():
        people = people.withColumn("birth_text", F.when(F.col("birth_text") == "", "").otherwise(F.coalesce(dated.cast("string"), F.lit("-"))))
    return cells.parts(people, {"name": (["n_name", "n_given", "n_surname"], name_score, c.name), "date": (["years", "birth_text"], date_score, c.date), "place": (["n_place", "place"], place_score, c.place), "sex": (["sex"], sex_score, c.sex)}, most)


NUMBERS = ("name_at", "date_at", "place_at", "sex_at")


def _row_type(kind: str) -> str:
    return f"a {kind}, b {kind}, name_score double, date_score double, place_score double, sex_score double, relation_score double"


def find_duplicates(p, c: Config = DEFAULT, chunk: int = cells.CHUNK, most: int = cells.VALUES) -> DataFrame:
    """Duplicates within one pedigree, over all blocked pairs. Where names, births and places have at most ``most`` distinct values each, scores are looked up, else worked out for each pair: the result is the same."""
    relations = relation_scores(_shares_relative(p), p)
    people = materialize(prepared(materialize(features(spread(p.individuals))), c.tolerance))
    if (found := numbered(people, c, most)) is None:
        return scored(joined(p.individuals, tolerance=c.tolerance), relations, c)
    kind = dict(p.individuals.dtypes)["xref"]
    lists = relations.groupBy("a").agg(F.collect_list(F.struct("b", F.col("relation_score").alias("s"))).alias("related"))
    f = found[0].join(materialize(lists).withColumnRenamed("a", "xref"), "xref", "left").withColumn("related", F.coalesce("related", F.array().cast(f"array<struct<b:{kind},s:double>>")))
    parts = p.individuals.sparkSession.sparkContext.broadcast(found[1])
    return judged(dealt_blocks(f, chunk, (*NUMBERS, "related")).mapInArrow(cells.within(parts, c.threshold, c.relation), _row_type(kind)), c)


def find_between(one: DataFrame, two: DataFrame, c: Config = DEFAULT, chunk: int = cells.CHUNK, most: int = cells.VALUES) -> DataFrame:
    """Duplicates between two files' people: compared where the first words of the names agree, the surnames agree or one is missing, and the birth years are within the tolerance and ten or one is missing. A person without a name scores at most date, place and sex together, which has to be below the threshold. Scores are looked up as in ``find_duplicates``."""
    if c.threshold <= c.date + c.place + c.sex:
        raise ValueError("a threshold that people without a name can reach would need every pair compared")
    kind = dict(one.dtypes)["xref"]
    if dict(two.dtypes)["xref"] == kind:
        side = lambda df, k: prepared(spread(df), c.tolerance).withColumn("year", S.extract_year(F.col("birth_text"))).select(F.lit(k).alias("side"), F.get(F.split("n_name", " "), F.lit(0)).alias("w"), "xref", *COMPARED, "year").filter("w != ''")
        people = materialize(side(one, 0).unionByName(side(two, 1)))
        if (found := numbered(people, c, most)) is not None:
            # N: one word and one surname; A: a's surname is missing; B: b's alone is
            bare, key = F.col("n_surname") == "", lambda k: F.concat(F.lit(k), F.col("w"))
            keys = F.when(F.col("side") == 0, F.when(bare, F.array(key("A|"))).otherwise(F.array(F.concat_ws("|", F.lit("N"), "w", "n_surname"), key("B|")))).otherwise(F.when(bare, F.array(key("A|"), key("B|"))).otherwise(F.array(F.concat_ws("|", F.lit("N"), "w", "n_surname"), key("A|"))))
            rows = materialize(found[0].select("xref", "side", "year", *NUMBERS, F.explode(keys).alias("key")))
            parts = one.sparkSession.sparkContext.broadcast(found[1])
            return judged(cells.dealt(rows, chunk, two=True).mapInArrow(cells.between(parts, c.threshold, c.tolerance + 10), _row_type(kind)), c)

    def side(df, name):
        f = prepared(df, c.tolerance).withColumn("year", S.extract_year(F.col("birth_text")))
        return f.select(F.get(F.split("n_name", " "), F.lit(0)).alias("w"), F.col("n_surname").alias(f"s_{name}"), F.struct("xref", *COMPARED, "year").alias(name)).filter("w != ''")

    a, b = side(one, "a"), side(two, "b")
    named = a.join(b, (a.w == b.w) & (a.s_a == b.s_b) & (a.s_a != ""))
    lacking = a.join(b, (a.w == b.w) & ((a.s_a == "") | (b.s_b == "")))
    pairs = named.select("a", "b").unionByName(lacking.select("a", "b"))
    gap = F.abs(F.col("a.year") - F.col("b.year"))
    return scored(pairs.filter(F.coalesce(gap <= c.tolerance + 10, F.lit(True))), None, c)


def find_matches(p, xref, c: Config = DEFAULT) -> DataFrame:
    """Everyone who is like one person, by a scan of all people."""
    people, row = prepared(p.individuals, c.tolerance), F.struct("xref", *COMPARED)
    one = people.filter(F.col("xref") == xref).select(row.alias("a")).limit(1)
    pairs = people.filter(F.col("xref") != xref).select(row.alias("b")).join(F.broadcast(one)).select("a", "b")  # one row is broadcast
    ids = people.filter(F.col("xref") != xref).select(F.lit(xref).alias("a"), F.col("xref").alias("b"))
    return scored(pairs, relation_scores(ids, p), c)


def limited_candidates(people: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """(a, b, priority): of each person's candidates with greater xrefs, the ``most`` likely (then the nearer year, the same place, the lesser xref). A limit by design; ``joined`` has every pair."""
    from pyspark.sql import Window as W

    pairs = joined(people)
    a, b = F.col("a"), F.col("b")
    gap = F.coalesce(F.abs(a["year"] - b["year"]), F.lit(0))
    rows = pairs.select(a["xref"].alias("a"), b["xref"].alias("b"), priority(a, b).alias("priority"), gap.alias("gap"), (F.coalesce((a["token"] != "") & (a["token"] == b["token"]), F.lit(False))).alias("place"))
    order = W.partitionBy("a").orderBy(F.desc("priority"), "gap", F.desc("place"), "b")
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= c.most).select("a", "b", "priority")


def blocking_metrics(people: DataFrame, largest: int = 5000) -> DataFrame:
    """One row: people with a primary block, with any, with none; blocks by kind, the largest, giant ones and the people in them."""
    f = features(people)
    primary = (F.col("sx") != "") & (F.col("year") > 0)
    any_ = F.coalesce(primary, F.lit(False)) | ((F.col("sx") != "") & (F.col("initial") != "")) | ((F.col("head") != "") & (F.col("token") != ""))
    n = lambda cond: F.count(F.when(cond, 1))
    who = f.agg(F.count("*").alias("people"), n(primary).alias("with_primary"), n(any_).alias("with_any"), n(~any_).alias("with_none"))
    kind = F.substring("key", 1, 1)
    blocks = block_sizes(people).agg(F.count("*").alias("blocks"), *[n(kind == k).alias(f"blocks_{k.lower()}") for k in "PYBIGX"], F.max("n").alias("largest"), n(F.col("n") > largest).alias("giant"), F.coalesce(F.sum(F.when(F.col("n") > largest, F.col("n"))), F.lit(0)).alias("in_giant"))
    return who.join(blocks)


def candidate_metrics(counts: DataFrame, people: DataFrame) -> DataFrame:
    """One row: candidates in all, the mean and most of a person, people with none, one and over ten. counts(a, n): ``candidate_counts``."""
    per = people.select(F.col("xref").alias("a")).join(counts, "a", "left").fillna(0, ["n"])
    n = lambda cond: F.count(F.when(cond, 1))
    return per.agg(F.sum("n").alias("candidates"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), n(F.col("n") == 0).alias("with_none"), n(F.col("n") == 1).alias("with_one"), n(F.col("n") > 10).alias("with_many"))


def blocking_warnings(metrics: DataFrame, candidates: DataFrame) -> DataFrame:
    """(warning): giant blocks, over half of the people without candidates, a block of over a third of the people."""
    m = metrics.join(candidates.select(F.col("with_none").alias("lonely")))
    rules = [(F.col("giant") > 0, "giant_blocks"), (F.col("lonely") > F.col("people") / 2, "few_candidates"), ((F.col("with_primary") > 0) & (F.col("largest") > F.col("people") / 3), "common_surname")]
    return m.select(F.explode(F.array_compact(F.array(*[F.when(c, w) for c, w in rules]))).alias("warning"))
