"""GEDCOM text in and out. A row of the scan is one level-0 record, so large files split; lines, people and families follow as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators.pedigree import Pedigree
from kindred.plans.store import materialize, settled

LINE = r"^(\d+) (?:(@[^@ ]+@) )?(\S+)(?: (.*))?$"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, record, text): each level-0 record; record is unique in the scan. Text is read as UTF-8; files of another encoding (``file_checks``) are to be recoded first."""
    raw = spark.read.option("lineSep", "\n0 ").text(path).select(F.col("_metadata.file_path").alias("file_id"), F.regexp_replace("value", "^(﻿)?0 ", "").alias("text"))
    return raw.withColumn("record", F.monotonically_increasing_id()).filter(F.trim("text") != "")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, record, line_no, level, xref, tag, value, parent_line_no); malformed lines have a null level. Continuations are folded into the line above."""
    r = records(spark, path).select("file_id", "record", F.posexplode(F.split(F.concat(F.lit("0 "), "text"), "\r?\n")).alias("line_no", "raw"))
    r = r.withColumn("raw", F.regexp_replace(F.ltrim("raw"), "\r$", "")).filter("trim(raw) != ''")
    part = lambda i: F.regexp_extract("raw", LINE, i)
    ok = F.col("raw").rlike(LINE)
    out = r.select("file_id", "record", "line_no", F.when(ok, part(1).try_cast("int")).alias("level"), F.when(ok & (part(2) != "") & (part(1) == "0"), part(2)).alias("xref"), F.when(ok, part(3)).alias("tag"), F.when(ok, part(4)).otherwise(F.col("raw")).alias("value"))
    w = W.partitionBy("file_id", "record").orderBy("line_no")
    goes_on = F.col("tag").isin("CONC", "CONT")
    out = out.withColumn("head", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    piece = F.when(F.col("tag") == "CONT", F.concat(F.lit("\n"), "value")).otherwise(F.col("value"))
    first = lambda c: F.min_by(c, "line_no").alias(c)
    # a long value's blanks belong to it: lines are cut at the front only, up to the value
    out = out.withColumn("piece", piece).groupBy("file_id", "record", "head").agg(F.min("line_no").alias("line_no"), first("level"), first("xref"), first("tag"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "").alias("value")).drop("head")
    return _with_parents(out)


def _with_parents(rows: DataFrame) -> DataFrame:
    """Adds parent_line_no: the nearest line before, in the record, of a lesser level. A record's lines are folded in order; what is kept on the way is the line of each open level, however deep."""
    lines_ = F.array_sort(F.collect_list(F.struct("line_no", "level", "xref", "tag", "value")))
    empty = F.array().cast("array<struct<line_no:int,level:int>>")
    step = lambda acc, x: F.struct(
        F.when(x["level"].isNull(), acc["open"]).otherwise(F.concat(F.filter(acc["open"], lambda o: o["level"] < x["level"]), F.array(F.struct(x["line_no"].alias("line_no"), x["level"].alias("level"))))).alias("open"),
        F.concat(acc["up"], F.array(F.when(x["level"] > 0, F.try_element_at(F.filter(acc["open"], lambda o: o["level"] < x["level"]), F.lit(-1))["line_no"]))).alias("up"))
    folded = F.aggregate("l", F.struct(empty.alias("open"), F.array().cast("array<int>").alias("up")), step, lambda acc: acc["up"])
    grouped = rows.groupBy("file_id", "record").agg(lines_.alias("l")).withColumn("up", folded)
    return grouped.select("file_id", "record", F.explode(F.arrays_zip("l", "up")).alias("r")).select("file_id", "record", "r.l.*", F.col("r.up").alias("parent_line_no"))


def _child(all_: DataFrame, above: str, tag: str, name: str) -> DataFrame:
    """First value of ``tag`` below the first line ``above`` of each record."""
    a = all_.filter((F.col("tag") == above) & (F.col("level") == 1)).select("file_id", "record", F.col("line_no").alias("p"))
    b = all_.filter(F.col("tag") == tag).select("file_id", "record", F.col("parent_line_no").alias("p"), "line_no", "value")
    return a.join(b, ["file_id", "record", "p"]).filter("value != ''").groupBy("file_id", "record").agg(F.min_by("value", "line_no").alias(name))


def read_pedigree(spark: SparkSession, path: str, one_file: bool | None = None) -> Pedigree:
    """The pedigree of a file or folder; of records with one xref in one file the last wins. Where several files are read, identifiers are ``file|xref``, so that each file's families join its own people (``one_file``: None looks, True trusts)."""
    every = materialize(lines(spark, path))
    several = one_file is False or one_file is None and every.select("file_id").distinct().count() > 1
    own = (lambda c: F.concat(F.col("file_id"), F.lit("|"), F.trim(F.col(c)))) if several else (lambda c: F.trim(F.col(c)))
    heads = every.filter("level = 0 and xref is not null").select("file_id", "record", "xref", "tag")
    last = heads.groupBy("file_id", "tag", "xref").agg(F.max("record").alias("record"))
    keys = ["file_id", "record"]
    top = lambda tag, name: every.filter((F.col("tag") == tag) & (F.col("level") == 1)).groupBy(*keys).agg(F.min_by("value", "line_no").alias(name))
    people = last.filter("tag = 'INDI'").select(own("xref").alias("xref"), *keys)
    for df in (top("NAME", "name"), top("SEX", "sex"), _child(every, "NAME", "GIVN", "given"), _child(every, "NAME", "SURN", "surname"), _child(every, "BIRT", "DATE", "birth_text"), _child(every, "BIRT", "PLAC", "birth_place"), _child(every, "DEAT", "DATE", "death_text"), _child(every, "DEAT", "PLAC", "death_place")):
        people = people.join(df, keys, "left")
    parsed = S.parse_name(F.col("name"))
    people = people.select("file_id", "xref", "name", F.coalesce("given", F.when(parsed["given"] != "", parsed["given"])).alias("given"), F.coalesce("surname", F.when(parsed["surname"] != "", parsed["surname"])).alias("surname"), "sex",
                           S.earliest(S.parse_date(F.col("birth_text"))).alias("birth_date"), S.earliest(S.parse_date(F.col("death_text"))).alias("death_date"), "birth_place", "death_place", "birth_text", "death_text")
    fam = last.filter("tag = 'FAM'").select(own("xref").alias("family"), *keys)
    families = fam
    for df in (top("HUSB", "husband"), top("WIFE", "wife"), _child(every, "MARR", "DATE", "marriage_text"), _child(every, "MARR", "PLAC", "marriage_place"), _child(every, "DIV", "DATE", "divorce_text"), _child(every, "DIV", "PLAC", "divorce_place")):
        families = families.join(df, keys, "left")
    day = lambda c: S.earliest(S.parse_date(F.col(c)))
    families = families.select("file_id", "family", own("husband").alias("husband"), own("wife").alias("wife"), day("marriage_text").alias("marriage_date"), "marriage_place", day("divorce_text").alias("divorce_date"), "divorce_place")
    w = W.partitionBy("family").orderBy("line_no")
    children = fam.join(every.filter("tag = 'CHIL' and level = 1"), keys).select("family", own("value").alias("child"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"))
    owner = last.filter("tag in ('INDI', 'FAM')").select(*keys, own("xref").alias("owner"), F.when(F.col("tag") == "INDI", "I").otherwise("F").alias("owner_type"))
    return Pedigree(people, families, children, events(every, owner), notes(every, owner), shared_notes(every, several))


def events(every: DataFrame, owner: DataFrame) -> DataFrame:
    """(event_id, owner, owner_type, type, custom_type, date, place) of the level-1 event lines of people and families."""
    tops = every.filter((F.col("level") == 1) & S.valid_event(F.col("tag"))).select("file_id", "record", F.col("line_no").alias("p"), "tag")
    sub = every.filter("level = 2 and tag in ('TYPE', 'DATE', 'PLAC')").groupBy("file_id", "record", F.col("parent_line_no").alias("p")).agg(*[F.min_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("line_no"))).alias(n) for t, n in (("TYPE", "custom_type"), ("DATE", "date"), ("PLAC", "place"))])
    rows = tops.join(owner, ["file_id", "record"]).join(sub, ["file_id", "record", "p"], "left")
    return rows.select(F.concat_ws("_", "owner", "tag", F.col("p").cast("string")).alias("event_id"), "owner", "owner_type", F.col("tag").alias("type"), "custom_type", "date", "place")


def notes(every: DataFrame, owner: DataFrame) -> DataFrame:
    """(owner, note, text): references to shared notes (note) and inline notes (text) of people and families."""
    rows = every.filter("level = 1 and tag = 'NOTE'").join(owner, ["file_id", "record"])
    ref = F.col("value").rlike("^@[^@]+@$")
    return rows.select("owner", F.when(ref, F.col("value")).alias("note"), F.when(~ref, F.col("value")).alias("text"))


def shared_notes(every: DataFrame, several: bool = False) -> DataFrame:
    return every.filter("level = 0 and tag = 'NOTE' and xref is not null").select(F.col("xref").alias("note"), F.col("value").alias("text"))


def by_type(every: DataFrame, tag: str) -> DataFrame:
    """(file_id, xref, field, value) of the records of one kind (INDI, FAM, NOTE, SOUR, REPO, SUBM, OBJE): each level-1 field's values in order."""
    keys = ["file_id", "record"]
    heads = every.filter((F.col("level") == 0) & (F.col("tag") == tag)).select(*keys, "xref")
    return heads.join(every.filter("level = 1"), keys).select("file_id", heads.xref, F.col("tag").alias("field"), "value", "line_no").orderBy("file_id", "xref", "line_no").drop("line_no")


def sources(every: DataFrame) -> DataFrame:
    """(file_id, xref, title, author, publication, repository) of source records."""
    return _fields(every, "SOUR", {"TITL": "title", "AUTH": "author", "PUBL": "publication", "REPO": "repository"})


def repositories(every: DataFrame) -> DataFrame:
    return _fields(every, "REPO", {"NAME": "name", "ADDR": "address", "PHON": "phone"})


def submitters(every: DataFrame) -> DataFrame:
    return _fields(every, "SUBM", {"NAME": "name", "ADDR": "address", "LANG": "language"})


def multimedia(every: DataFrame) -> DataFrame:
    return _fields(every, "OBJE", {"FILE": "file", "FORM": "form", "TITL": "title"})


def _fields(every: DataFrame, tag: str, fields: dict[str, str]) -> DataFrame:
    keys = ["file_id", "record"]
    heads = every.filter((F.col("level") == 0) & (F.col("tag") == tag)).select(*keys, "xref")
    first = every.filter("level = 1").groupBy(*keys).agg(*[F.min_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("line_no"))).alias(n) for t, n in fields.items()])
    return heads.join(first, keys, "left").select("file_id", "xref", *fields.values())


def header(every: DataFrame) -> DataFrame:
    """One row a file: source, source_version, source_name, version, form, charset, language, submitter, file, date and copyright of its header."""
    keys = ["file_id", "record"]
    head = every.filter("level = 0 and tag = 'HEAD'").select(*keys)
    rows = every.join(head, keys, "left_semi")
    up = rows.filter("level = 1").select(*keys, F.col("line_no").alias("parent_line_no"), F.col("tag").alias("above"))
    deep = rows.filter("level = 2").join(up, [*keys, "parent_line_no"]).select(*keys, "line_no", F.concat_ws(".", "above", "tag").alias("path"), "value")
    every_ = rows.filter("level = 1").select(*keys, "line_no", F.col("tag").alias("path"), "value").unionByName(deep)
    names = {"SOUR": "source", "SOUR.VERS": "source_version", "SOUR.NAME": "source_name", "GEDC.VERS": "version", "GEDC.FORM": "form", "CHAR": "charset", "LANG": "language", "SUBM": "submitter", "FILE": "file", "DATE": "date", "COPR": "copyright"}
    return every_.groupBy("file_id").agg(*[F.min_by(F.when(F.col("path") == p, F.col("value")), F.when(F.col("path") == p, F.col("line_no"))).alias(n) for p, n in names.items()])


def names(every: DataFrame) -> DataFrame:
    """(file_id, xref, ordinal, type, prefix, given, nickname, surname_prefix, surname, suffix, full, is_primary) of people's name lines: their parts, else what the value tells."""
    keys = ["file_id", "record"]
    heads = every.filter("level = 0 and tag = 'INDI'").select(*keys, "xref")
    tops = every.filter("level = 1 and tag = 'NAME'").select(*keys, F.col("line_no").alias("p"), "value")
    parts = {"NPFX": "prefix", "GIVN": "given", "NICK": "nickname", "SPFX": "surname_prefix", "SURN": "surname", "NSFX": "suffix", "TYPE": "type"}
    sub = every.filter("level = 2").groupBy(*keys, F.col("parent_line_no").alias("p")).agg(*[F.min_by(F.when(F.col("tag") == t, F.trim("value")), F.when(F.col("tag") == t, F.col("line_no"))).alias(n) for t, n in parts.items()])
    rows = settled(heads.join(tops, keys).join(sub, [*keys, "p"], "left"), {"_n": S.parse_name(F.col("value"))})
    bare = F.coalesce(F.col("given"), F.col("surname")).isNull()
    pick = lambda c: F.when(bare & (F.col(f"_n.{c}") != ""), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c)
    rows = rows.select("file_id", "xref", "p", S.name_type(F.col("type")).alias("type"), pick("prefix"), pick("given"), "nickname", "surname_prefix", pick("surname"), pick("suffix"))
    w = W.partitionBy("file_id", "xref").orderBy("p")
    valid = F.coalesce("given", "surname").isNotNull()
    rows = rows.withColumns({"ordinal": (F.row_number().over(w) - 1).cast("long"), "_first": F.min(F.when(valid, F.col("p"))).over(W.partitionBy("file_id", "xref"))})
    return rows.select("file_id", "xref", "ordinal", "type", "prefix", "given", "nickname", "surname_prefix", "surname", "suffix", S.full_name(*map(F.col, ("prefix", "given", "surname_prefix", "surname", "suffix"))).alias("full"), F.coalesce(F.col("p") == F.col("_first"), F.lit(False)).alias("is_primary"))


def names_of_type(every: DataFrame, kind: str) -> DataFrame:
    """(file_id, xref, full): a person's first name of the kind; where no birth name is told, the primary one."""
    n = names(every)
    own = n.filter(F.col("type") == kind).groupBy("file_id", "xref").agg(F.min_by("full", "ordinal").alias("own"))
    first = n.filter("is_primary").select("file_id", "xref", F.col("full").alias("first"))
    return first.join(own, ["file_id", "xref"], "left").select("file_id", "xref", (F.coalesce("own", "first") if kind == "birth" else F.col("own")).alias("full")).filter("full is not null")


def values(every: DataFrame, selector: str) -> DataFrame:
    """(file_id, record, line_no, value) of the lines that a dotted selector reaches, as ``BIRT.DATE``, in the records."""
    keys, rows = ["file_id", "record"], None
    for level, tag in enumerate(selector.split("."), 1):
        here = every.filter((F.col("level") == level) & (F.col("tag") == tag))
        rows = here if rows is None else here.join(rows.select(*keys, F.col("line_no").alias("parent_line_no")), [*keys, "parent_line_no"], "left_semi")
    return rows.select(*keys, "line_no", "value")


def own_links(every: DataFrame) -> DataFrame:
    """(xref, family, tag): the family links that people's own records tell."""
    heads = every.filter("level = 0 and tag = 'INDI'").select("file_id", "record", "xref")
    return heads.join(every.filter("level = 1 and tag in ('FAMS', 'FAMC')").select("file_id", "record", "tag", F.trim("value").alias("family")), ["file_id", "record"]).select("xref", "family", "tag").distinct()


def file_checks(spark: SparkSession, path: str, largest: int = 1 << 40) -> DataFrame:
    """(file_id, bytes, encoding, issue): too large, without a header at its start, or of an unknown encoding (null where sound). Spark's readers pass over empty files, which have no row here."""
    def look(batches):
        import pyarrow as pa

        for b in batches:
            out = [_encoding(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([e for e, _ in out], pa.string()), pa.array([h for _, h in out], pa.bool_())], names=["file_id", "bytes", "encoding", "head"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), F.col("length").alias("bytes"), F.substring("content", 1, 4096).alias("start"))
    rows = files.mapInArrow(look, "file_id string, bytes long, encoding string, head boolean")
    return rows.select("file_id", "bytes", "encoding", F.when(F.col("bytes") > largest, "too_large").when(F.col("encoding").isNull(), "unknown_encoding").when(~F.col("head"), "no_header").alias("issue"))


def _encoding(start: bytes) -> tuple[str | None, bool]:
    """Encoding by byte order mark or by what decodes, and whether a header line follows."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if start.startswith(mark):
            return name, start[len(mark):].decode(name, "replace").lstrip().startswith("0 HEAD")
    head = start.lstrip().startswith(b"0 HEAD")
    for cut in range(4 if len(start) == 4096 else 1):  # the last character of what was read may be cut
        try:
            start[: len(start) - cut].decode("utf-8")
            return "UTF-8", head
        except UnicodeDecodeError:
            pass
    return ("ANSEL" if b"ANSEL" in start else "ISO-8859-1" if b"\x00" not in start else None), head


def long_value(level: int, c, width: int = 200):
    """A value with its line breaks as CONT lines and pieces of over ``width`` characters as CONC lines, one level below ``level``."""
    piece = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / width).cast("int") - 1, F.lit(0))), lambda i: F.substr(x, i * width + 1, F.lit(width))), f"\n{level + 1} CONC ")
    return F.array_join(F.transform(F.split(c, "\n"), piece), f"\n{level + 1} CONT ")


def to_gedcom(p: Pedigree, head: dict[str, str] | None = None) -> DataFrame:
    """(value): one text row a record, header first and trailer last, to be written by ``write.text``. Dates are written as they were told, events, notes and shared notes go along, long values are split. ``head``: header fields to set or add, as SOUR or GEDC.VERS."""
    line = lambda level, tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n{level} {tag} "), long_value(level, F.col(c).cast("string")))).otherwise("")
    text = lambda df, told, day: F.coalesce(F.col(told), F.upper(F.date_format(day, "d MMM yyyy"))) if told in df.columns else F.upper(F.date_format(day, "d MMM yyyy"))
    gather = lambda df, key, value, order, name: df.groupBy(F.col(key).alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), "").alias(name))
    i = p.individuals
    have = lambda c: c if c in i.columns else None
    born = i.withColumns({"_b": text(i, "birth_text", "birth_date"), "_d": text(i, "death_text", "death_date")})
    for c in ("given", "surname", "birth_place", "death_place"):
        born = born if have(c) else born.withColumn(c, F.lit(None).cast("string"))
    event = lambda tag, day, place: F.when(F.col(day).isNotNull() | F.col(place).isNotNull(), F.concat(F.lit(f"\n1 {tag}"), line(2, "DATE", day), line(2, "PLAC", place))).otherwise("")
    extra = None
    if p.events is not None:
        e = p.events.filter("type not in ('BIRT', 'DEAT', 'MARR', 'DIV')")
        extra = gather(e.withColumn("_o", F.concat("owner_type", F.col("owner").cast("string"))), "_o", F.concat(F.lit("\n1 "), "type", line(2, "TYPE", "custom_type"), line(2, "DATE", "date"), line(2, "PLAC", "place")), "event_id", "extra")
    remarks = None
    if p.notes is not None:
        n = p.notes.withColumn("_v", F.coalesce("note", "text"))
        remarks = gather(n, "owner", line(1, "NOTE", "_v"), "_v", "remarks")

    def more(df, key, letter):
        df = df.withColumns({"_x": F.concat(F.lit(letter), F.col(key).cast("string")), "_y": F.col(key).cast("string")})
        df = df.join(extra, F.col("_x") == extra._k, "left").drop("_k") if extra is not None else df.withColumn("extra", F.lit(""))
        return df.join(remarks, F.col("_y") == remarks._k, "left").drop("_k") if remarks is not None else df.withColumn("remarks", F.lit(""))

    rest = F.concat(F.coalesce("extra", F.lit("")), F.coalesce("remarks", F.lit("")))
    people = more(born, "xref", "I").select(F.lit(1).alias("s"), "xref", F.concat(F.lit("0 "), "xref", F.lit(" INDI"), line(1, "NAME", "name"), line(2, "GIVN", "given"), line(2, "SURN", "surname"), line(1, "SEX", "sex"), event("BIRT", "_b", "birth_place"), event("DEAT", "_d", "death_place"), rest).alias("value"))
    kids = gather(p.children, "family", F.concat(F.lit("\n1 CHIL "), "child"), "ordinal", "kids")
    f = p.families.join(kids, F.col("family") == kids._k, "left").drop("_k")
    for c in ("marriage_date", "divorce_date", "marriage_place", "divorce_place"):
        f = f if c in f.columns else f.withColumn(c, F.lit(None).cast("date" if c.endswith("date") else "string"))
    f = f.withColumns({"_m": F.upper(F.date_format("marriage_date", "d MMM yyyy")), "_v": F.upper(F.date_format("divorce_date", "d MMM yyyy"))})
    fams = more(f, "family", "F").select(F.lit(2).alias("s"), F.col("family").alias("xref"), F.concat(F.lit("0 "), "family", F.lit(" FAM"), line(1, "HUSB", "husband"), line(1, "WIFE", "wife"), F.coalesce("kids", F.lit("")), event("MARR", "_m", "marriage_place"), event("DIV", "_v", "divorce_place"), rest).alias("value"))
    spark = i.sparkSession
    fields = {"SOUR": "kindred", "GEDC.VERS": "5.5.1", "GEDC.FORM": "LINEAGE-LINKED", "CHAR": "UTF-8"} | (head or {})
    top, above = ["0 HEAD"], None
    for path in sorted(fields, key=lambda x: (list(fields).index(next(k for k in fields if k.split(".")[0] == x.split(".")[0])), x)):
        first, *second = path.split(".")
        if second and above != first and first not in fields:
            top.append(f"1 {first}")
        above = first
        top.append(f"2 {second[0]} {fields[path]}" if second else f"1 {first} {fields[path]}")
    out = spark.createDataFrame([(0, "", "\n".join(top)), (4, "", "0 TRLR")], "s int, xref string, value string").unionByName(people).unionByName(fams)
    if p.shared is not None:
        out = out.unionByName(p.shared.select(F.lit(3).alias("s"), F.col("note").alias("xref"), F.concat(F.lit("0 "), "note", F.lit(" NOTE "), long_value(0, F.col("text"))).alias("value")))
    return out.orderBy("s", "xref").select("value")


def to_yaml(df: DataFrame) -> DataFrame:
    """(value): each row as an item of a YAML sequence. Values are in JSON notation, which YAML takes as flow style; nulls are left out."""
    pair = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(f"`{c}`"))), r'(?s)^\{("(?:[^"\\]|\\.)*"):(.*)\}$', "$1: $2")
    named = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), pair(c)) for c in df.columns]))
    return df.select(F.when(F.size(named) == 0, "- {}").otherwise(F.concat(F.lit("- "), F.array_join(named, "\n  "))).alias("value"))


def structure_issues(every: DataFrame) -> DataFrame:
    """``lines`` -> (file_id, record, xref, severity, rule): header, submitter, people and family records as the format asks."""
    tops = every.filter("level = 0")
    head = every.join(tops.filter("tag = 'HEAD'").select("file_id", "record"), ["file_id", "record"], "left_semi")
    has = lambda level, tag: F.coalesce(F.max((F.col("level") == level) & (F.col("tag") == tag)), F.lit(False))
    found = head.groupBy("file_id").agg(has(1, "GEDC").alias("gedc"), has(2, "VERS").alias("vers"), has(1, "SUBM").alias("subm"))
    files = tops.select("file_id").distinct().join(found.withColumn("head", F.lit(True)), "file_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = [(no("head"), "severe", "header_missing"), (~no("head") & no("gedc"), "severe", "gedc_missing"), (~no("gedc") & no("vers"), "warning", "version_missing"), (~no("head") & no("subm"), "severe", "submitter_missing")]
    pick = lambda rules: F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for c, s, r in rules]))
    header = files.select("file_id", F.lit(None).cast(dict(every.dtypes)["record"]).alias("record"), F.lit(None).cast("string").alias("xref"), F.explode(pick(rules)).alias("i"))
    n = lambda tag: F.count(F.when((F.col("level") == 1) & (F.col("tag") == tag), 1))
    bad = F.count(F.when((F.col("level") == 1) & F.col("tag").isin("FAMS", "FAMC", "HUSB", "WIFE", "CHIL") & ~F.coalesce(F.col("value"), F.lit("")).rlike("^@[^@]+@$"), 1))
    sex = F.count(F.when((F.col("level") == 1) & (F.col("tag") == "SEX") & ~F.upper(F.trim(F.coalesce("value", F.lit("")))).isin("M", "F", "U", "X", "N"), 1))
    kinds = tops.filter("tag in ('INDI', 'FAM')").select("file_id", "record", F.col("tag").alias("kind"), F.col("xref").alias("of"))
    sums = every.filter("level > 0").groupBy("file_id", "record").agg(*[n(t).alias(t) for t in ("NAME", "BIRT", "DEAT", "HUSB", "WIFE", "MARR", "DIV")], bad.alias("bad"), sex.alias("sex"))
    records = kinds.join(sums, ["file_id", "record"], "left").fillna(0)
    person, family = F.col("kind") == "INDI", F.col("kind") == "FAM"
    rules = [(person & (F.col("NAME") == 0), "severe", "name_missing"), (person & (F.col("sex") > 0), "warning", "sex_unknown"), (person & (F.col("BIRT") > 1), "warning", "births_repeated"), (person & (F.col("DEAT") > 1), "warning", "deaths_repeated"),
             (family & (F.col("HUSB") + F.col("WIFE") == 0), "severe", "partners_missing"), (family & (F.col("MARR") > 1), "warning", "marriages_repeated"), (family & (F.col("DIV") > 1), "warning", "divorces_repeated"), (F.col("bad") > 0, "severe", "reference_malformed")]
    out = header.unionByName(records.select("file_id", "record", F.col("of").alias("xref"), F.explode(pick(rules)).alias("i")))
    return out.select("file_id", "record", "xref", "i.severity", "i.rule")


# The tags that records, events and names may have.
PERSON_EVENTS = ["BIRT", "CHR", "DEAT", "BURI", "CREM", "ADOP", "BAPM", "BARM", "BASM", "BLES", "CHRA", "CONF", "FCOM", "ORDN", "NATU", "EMIG", "IMMI", "CENS", "PROB", "WILL", "GRAD", "RETI", "EVEN"]
PERSON_TAGS = ["RESN", "NAME", "SEX", "ALIA", "ASSO", "ANCI", "DESI", "RFN", "AFN", "REFN", "RIN", "CHAN", "NOTE", "SOUR", "OBJE", "FAMS", "FAMC", "CAST", "DSCR", "EDUC", "IDNO", "NATI", "NCHI", "NMR", "OCCU", "PROP", "RELI", "RESI", "TITL", "FACT", "BAPL", "CONL", "ENDL", "SLGC"]
FAMILY_EVENTS = ["ANUL", "CENS", "DIV", "DIVF", "ENGA", "MARB", "MARC", "MARR", "MARL", "MARS", "EVEN"]
FAMILY_TAGS = ["RESN", "FAMS", "FAMC", "HUSB", "WIFE", "CHIL", "NCHI", "SUBM", "SLGS", "REFN", "RIN", "CHAN", "NOTE", "SOUR", "OBJE"]
HEADER_TAGS = ["GEDC", "CHAR", "SOUR", "DATE", "TIME", "FILE", "LANG", "SUBM", "SUBN", "COPR", "DEST", "NOTE"]
EVENT_TAGS = ["TYPE", "DATE", "PLAC", "ADDR", "AGE", "AGNC", "CAUS", "SOUR", "NOTE", "OBJE"]
NAME_TAGS = ["NPFX", "GIVN", "NICK", "SPFX", "SURN", "NSFX", "SOUR", "NOTE", "FONE", "ROMN"]


def tag_issues(every: DataFrame) -> DataFrame:
    """``lines`` -> (file_id, xref, severity, rule, tag, line_no): tags that people, families, headers, their events and names may not have. Tags that begin with an underscore are anyone's own."""
    keys = ["file_id", "record"]
    heads = every.filter("level = 0").select(*keys, "xref", F.col("tag").alias("kind"))
    strange = lambda allowed: ~F.col("tag").isin(allowed) & ~F.col("tag").startswith("_")
    tops = heads.join(every.filter("level = 1").drop("xref"), keys)
    first = (F.col("kind") == "INDI") & strange(PERSON_TAGS + PERSON_EVENTS) | (F.col("kind") == "FAM") & strange(FAMILY_TAGS + FAMILY_EVENTS)
    head = (F.col("kind") == "HEAD") & strange(HEADER_TAGS)
    out = tops.filter(first | head).select("file_id", "xref", F.when(head, "warning").otherwise("severe").alias("severity"), F.lit("tag_unknown").alias("rule"), "tag", "line_no")
    above = tops.select(*keys, "xref", "kind", F.col("tag").alias("above"), F.col("line_no").alias("parent_line_no"))
    subs = above.join(every.filter("level = 2").drop("xref"), [*keys, "parent_line_no"])
    event = (F.col("kind") == "INDI") & F.col("above").isin(PERSON_EVENTS) | (F.col("kind") == "FAM") & F.col("above").isin(FAMILY_EVENTS)
    name = (F.col("kind") == "INDI") & (F.col("above") == "NAME")
    bad = event & strange(EVENT_TAGS) | name & strange(NAME_TAGS)
    return out.unionByName(subs.filter(bad).select("file_id", "xref", F.lit("warning").alias("severity"), F.lit("subtag_unknown").alias("rule"), "tag", "line_no"))


def write(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON, CSV (with header), XML or YAML rows; lists are joined for CSV."""
    if kind == "csv":
        df = df.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        df.write.option("header", True).csv(path)
    elif kind == "xml":
        df.write.option("rowTag", "record").format("xml").save(path)
    elif kind == "yaml":
        to_yaml(df).write.text(path)
    else:
        df.write.json(path)
