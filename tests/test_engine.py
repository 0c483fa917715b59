"""Registered queries against DuckDB, and small hand-made families."""

import datetime
import os

import duckdb
import pytest

from kindred.functions import scalars as S
from kindred.plans import catalog
from kindred.sources import gedcom

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXT = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME John /Smith/
2 GIVN John
2 SURN Smith
1 SEX M
1 BIRT
2 DATE ABT 1850
2 PLAC York, England
0 @I2@ INDI
1 NAME Mary /Jones/
1 SEX F
1 NOTE first
2 CONT second
2 CONC  half
0 @I3@ INDI
1 NAME Ann /Smith/
1 BIRT
2 DATE 3 MAR 1880
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
1 CHIL @I9@
0 TRLR
"""


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{n}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=key)


def test_components_by_search(spark):
    p = catalog.pedigree(spark, SF)
    near = {r.xref: set() for r in p.individuals.collect()}
    for a, b in [(r.child, r.parent) for r in p.parent_edge.collect()] + [(r.a, r.b) for r in p.spouse_edge.union(p.sibling_edge).collect()]:
        if a in near and b in near:
            near[a].add(b), near[b].add(a)
    want = {}
    for x in sorted(near):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
    assert {r.xref: r.component for r in p.components().collect()} == want


@pytest.fixture(scope="module")
def people_200(spark, tmp_path_factory):
    """The tables with the first 200 people: 50 beyond those of the bounded queries."""
    out = f"{tmp_path_factory.mktemp('sf')}"
    for n in ("customer", "orders", "nation", "region"):
        df = spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
        (df.filter("c_custkey < 200") if n == "customer" else df).write.parquet(f"file://{out}/{n}.parquet")
    return f"file://{out}"


def test_kinship_of_everyone(spark, people_200):
    pe = {}
    for r in catalog.pedigree(spark, people_200).parent_edge.collect():
        pe.setdefault(r.child, set()).add(r.parent)
    ids = [r.xref for r in catalog.pedigree(spark, people_200).individuals.collect()]
    up = {}
    for x in ids:
        up[x], now, d = {x: 0}, {x}, 0
        while now:
            now, d = {q for c in now for q in pe.get(c, ())} - set(up[x]), d + 1
            up[x].update(dict.fromkeys(now, d))
    want = {}
    for a in ids:
        for b in ids:
            if a != b and (both := up[a].keys() & up[b].keys()):
                want[a, b] = min((max(up[a][x], up[b][x]), up[a][x] + up[b][x], x, up[a][x], up[b][x]) for x in both)[3:]
    assert max(ids) >= 199
    got = {(r.a, r.b): r for r in catalog.queries()["kinship_label"](spark, people_200).collect()}
    assert {k: (r.depth_a, r.depth_b) for k, r in got.items()} == want
    cousins = {(r.a, r.b) for r in catalog.queries()["cousins_1"](spark, people_200).collect()}
    assert cousins == {k for k, v in want.items() if v == (2, 2)} and max(cousins)[0] >= 150


def test_kin_by_rows(spark, monkeypatch):
    """Rows of arrays give what joins below each common ancestor give: marriages across generations and among kin, up to three parents, people of no family, a parent and an xref without a record, descendants listed or searched for, blocks of any size."""
    import random

    from kindred.operators import kin
    from kindred.operators.pedigree import Pedigree

    rng = random.Random(5)
    ids = rng.sample(range(-300, 3000), 90)
    fams = [(k, ids[rng.randrange(k + 2)], 7000 if k == 3 else ids[rng.randrange(k + 2)]) for k in range(60)]
    kids = [(rng.randrange(k), ids[k + 2], 0) for k in range(1, 60)] + [(rng.randrange(k), ids[k + 2], 0) for k in range(2, 60, 4)] + [(5, 8000, 0)]
    people = lambda ids: spark.createDataFrame([(x,) for x in ids], "xref long")
    made = lambda ids, fams, kids: Pedigree(people(ids), spark.createDataFrame(fams, "family long, husband long, wife long"), spark.createDataFrame(kids, "family long, child long, ordinal long"))
    p = made([*ids, None], fams, kids)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(p._kin_by_joins(None, 0))
    assert len(want) > 2000 and any(a != b and min(a, b) > 0 for _, _, a, b in want)
    for listed, held in ((kin.LISTED, kin.HELD), (10, 1)):
        monkeypatch.setattr(kin, "LISTED", listed)
        monkeypatch.setattr(kin, "HELD", held)
        assert rows(kin.pairs(p.individuals, p.steps("up"))) == want
    assert rows(p.kinship(None).select("a", "b", "depth_a", "depth_b")) == want
    assert rows(made([], [], []).kinship(None)) == []
    loop = made([1, 2, 3, 4], [(1, 1, None), (2, 2, None), (3, 3, None)], [(1, 2, 0), (2, 1, 0), (3, 4, 0)])
    assert kin.pairs(loop.individuals, loop.steps("up")) is None
    assert rows(loop.kinship(None).select("a", "b", "depth_a", "depth_b")) == rows(loop._kin_by_joins(None, 0)) != []


def test_kin_stored_is_small(spark, tmp_path):
    """Everyone's kin, stored as they come, take a small part of a byte a pair: whole rows of increasing xrefs took over one here, and four for 90,000 people."""
    out = f"{tmp_path}/kin"
    catalog.queries()["kinship_label"](spark, "/root/testdata/sf0.01").write.parquet(f"file://{out}")
    n = spark.read.parquet(f"file://{out}").count()
    assert n > 2_000_000 and sum(x.stat().st_size for x in tmp_path.glob("kin/*.parquet")) < 0.5 * n


def test_kin_tiles(monkeypatch):
    """Every pair of the rows' people comes once, whatever the rows' number and the size of a batch."""
    import numpy as np

    from kindred.operators import kin

    rng = np.random.default_rng(3)
    xref = np.sort(rng.choice(np.arange(-500, 500), 57, replace=False))
    for m, batch in ((1, 1), (5, 16), (9, 1 << 17)):
        monkeypatch.setattr(kin, "PAIRS", batch)
        depths = rng.integers(0, 1 << 20, (m, 57)).astype(np.int32)
        depths[rng.random((m, 57)) < 0.3] = -1
        depths[:, 7] = -1
        who = rng.choice(57, m, replace=False)
        want = sorted((int(xref[a]), int(xref[b]), int(depths[i, b])) for i, a in enumerate(who) for b in range(57) if depths[i, b] >= 0)
        got = [(v >> 20, b, v & 0xFFFFF) for x in kin.tiles(depths, xref[who], xref) for b, vs in zip(*x.to_pydict().values()) for v in vs]
        assert sorted(got) == want


def test_path_metrics_of_everyone(spark, people_200):
    p = catalog.pedigree(spark, people_200)
    near = {}
    for r in p.edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
    sums = {}
    for x in (f"I{r.xref}" for r in p.individuals.collect()):
        hops, now, d = {x: 0}, {x}, 0
        while now:
            now, d = {b for a in now for b in near.get(a, ())} - set(hops), d + 1
            hops.update(dict.fromkeys(now, d))
        if far := [h for n, h in hops.items() if h and n[0] == "I"]:
            sums[x] = (max(far), sum(far), len(far))
    assert max(f for f, _, _ in sums.values()) > 6
    assert {r.source: (r.farthest, r.total, r.reached) for r in p.path_sums(block=120).collect()} == sums
    q = catalog.queries()
    assert q["diameter"](spark, people_200).first()[0] == max(f for f, _, _ in sums.values())
    assert q["avg_path_length"](spark, people_200).first()[0] == round(sum(t for _, t, _ in sums.values()) / sum(n for _, _, n in sums.values()), 6)
    assert {r.source: r.closeness for r in q["closeness"](spark, people_200).collect()} == {x: round(n / t, 6) for x, (_, t, n) in sums.items()}


def test_hops_by_parts(spark, people_200):
    """Parts searched by their bounds give what a search from everyone gives: chains, loops, hubs, many components, nodes met after over 100 steps."""
    import numpy as np

    from kindred.operators import hops

    rng = np.random.default_rng(3)
    shapes = [(np.arange(900) // 2, np.arange(900) % 2 + np.arange(900) // 2), (rng.integers(0, 300, 420), rng.integers(0, 160, 420)), (np.arange(400), np.arange(400) // 3), (np.arange(120), np.zeros(120, int))]
    shapes.append((np.concatenate([np.arange(1, 400), np.arange(400)]), np.concatenate([(np.arange(1, 400) - 1) // 3, np.arange(400)])))
    for i, j in shapes:
        i, j = (np.unique(x, return_inverse=True)[1] for x in np.unique(np.stack([i, j]), axis=1))
        n, m = i.max() + 1, j.max() + 1
        people, families = hops.Side(i, j, n), hops.Side(j, i, m)
        want = np.stack(hops.sums(people, families, np.arange(n)))
        for size in (7, 40, 10_000):
            label = hops.parts(i, j, n, m, size)
            got = np.zeros((3, n), np.int64)
            for k in range(label.max() + 1):
                mine, theirs = label[i] == k, label[n + j] == k
                own = np.nonzero(label[:n] == k)[0]
                got[:, own] = hops.part_sums(people, families, i[mine & theirs], j[mine & theirs], own, np.unique(j[mine != theirs]))
            assert (got == want).all()
    p = catalog.pedigree(spark, people_200)
    nodes = p.individuals.selectExpr("concat('I', xref) AS node")
    found = [sorted(map(tuple, hops.path_sums(p.steps("link"), nodes, size=25, few=few).collect())) for few in (0, 1e9)]
    assert found[0] == found[1] and len(found[0]) > 150


def test_pairs_of_blocks_of_any_size(spark):
    from kindred.operators import duplicates as U

    big = [(i, f"{'abcdefgh'[i % 8]}x /Smith/", f"{'abcdefgh'[i % 8]}x", "Smith", "M", "1990", f"p{i}") for i in range(400)]
    near = [(9001, "ann /Jones/", "ann", "Jones", "F", "1894", "x"), (9002, "bob /Jonas/", "bob", "Jonas", "F", "1897", "y"), (9003, "cat /Jones/", "cat", "Jones", "F", "ABT 1898", "z"), (9004, "/Jones/", None, "Jones", None, None, None)]
    people = spark.createDataFrame(big + near, "xref long, name string, given string, surname string, sex string, birth_text string, birth_place string")
    for chunk in (50, 1000):
        pairs = U.candidate_pairs(people, chunk=chunk)
        assert pairs.filter("a < 9000").count() == pairs.filter("a < 9000").distinct().count() == 400 * 399 // 2
        # three years apart across spans; 9001 and 9003 four years apart, and not of one five-year span
        assert sorted((r.a, r.b) for r in pairs.filter("a > 9000").collect()) == [(9001, 9002), (9002, 9003)]


def test_scores(spark):
    from kindred.operators import duplicates as U

    rows = [(1, "John /Smith/", "John", "Smith", "M", "1850", "York, New York, USA"), (2, "Jon /Smith/", "Jon", "Smith", "M", "ABT 1851", "York, Ne, USA"), (3, None, None, None, "U", "", ""), (4, "Smith", None, None, "F", "BEF 1850", "Paris, France"), (5, "x /Smith/", "x", "Smith", "f", "the year 1852", "Paris, Ile-de-France, France")]
    p = U.prepared(spark.createDataFrame(rows, "xref long, name string, given string, surname string, sex string, birth_text string, birth_place string"))
    from pyspark.sql import functions as F

    s = F.struct("*")
    pairs = p.select(s.alias("a")).join(p.select(s.alias("b"))).filter("a.xref < b.xref")
    a, b = F.col("a"), F.col("b")
    got = {(r.x, r.y): tuple(round(v, 6) for v in r[2:]) for r in pairs.select(a["xref"].alias("x"), b["xref"].alias("y"), U.name_score(a, b), U.date_score(a, b), U.place_score(a, b), U.sex_score(a, b)).collect()}
    # 1850 in 1849..1853 is a year of a mean of three; 1846..1850 and 1849..1853 share two of five
    assert got[1, 2] == (0.9, 0.5, round((1 + 0.9 + 1) / 3, 6), 1.0) or got[1, 2][1:] == (0.5, round((1 + 0.9 + 1) / 3, 6), 1.0)
    assert got[1, 3] == (0.0, 0.0, 0.0, 0.5) and got[2, 4][1] == 0.7 and got[4, 5][2:] == (1.0, 1.0) and got[1, 4][3] == 0.0


def test_dates(spark):
    cases = {"3 MAR 1880": ("exact", 1880, 3, 3), "abt 1850": ("about", 1850, None, None), "BEF JUN 1900": ("before", 1900, 6, None), "BET 1900 AND 1905": ("between", 1900, None, None), "FROM 1 JAN 1900 TO 1901": ("from_to", 1900, 1, 1), "31 FEB 1900": ("invalid", None, None, None), "x": ("invalid", None, None, None), None: ("invalid", None, None, None)}
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: (r.p.type, r.p.y, r.p.m, r.p.d) for r in d.select("s", S.parse_date(d.s).alias("p")).collect()}
    assert got == cases


def test_soundex(spark):
    cases = {"Smith": "S530", "Smyth": "S530", "John": "J500", "Robert": "R163", "Rupert": "R163", "Pfister": "P123", "Tymczak": "T520", "": "", "123": "", "A": "A000"}
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.c for r in d.select("s", S.soundex(d.s).alias("c")).collect()}
    assert got == cases


def test_gedcom(spark, tmp_path):
    path = tmp_path / "a.ged"
    path.write_text(TEXT.replace("\n", "\r\n"))
    notes = [r.value for r in gedcom.lines(spark, str(path)).filter("tag = 'NOTE'").collect()]
    assert notes == ["first\nsecond half"]
    p = gedcom.read_pedigree(spark, str(path))
    people = {r.xref: r for r in p.individuals.collect()}
    assert people["@I1@"].surname == "Smith" and people["@I1@"].birth_date == datetime.date(1850, 1, 1) and people["@I3@"].birth_date == datetime.date(1880, 3, 3)
    assert {(r.child, r.parent) for r in p.parent_edge.collect()} == {(c, x) for c in ("@I3@", "@I9@") for x in ("@I1@", "@I2@")}
    out = str(tmp_path / "out")
    gedcom.to_gedcom(p).coalesce(1).write.text(out)
    again = gedcom.read_pedigree(spark, out)
    assert {(r.xref, r.name, r.birth_date) for r in again.individuals.collect()} == {(r.xref, r.name, r.birth_date) for r in people.values()}


def test_cycles_end(spark):
    from kindred.operators.pedigree import Pedigree

    people = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "xref long, name string")
    fams = spark.createDataFrame([(0, 0, None), (1, 1, None), (2, 2, None)], "family long, husband long, wife long")
    kids = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 0, 0), (2, 3, 1)], "family long, child long, ordinal int")
    p = Pedigree(people, fams, kids)
    assert {r.xref for r in p.cycles().collect()} == {0, 1, 2, 3}
    assert p.closure(p.roots(0)).count() == 2


def test_ingest(spark, tmp_path):
    """Late rows of lesser order lose; a restart goes on from the last version; a batch done again changes nothing."""
    from kindred.streaming import ingest as I

    def put(rows):
        spark.createDataFrame(rows, "k long, seq long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    run = lambda: I.ingest(spark, f"{tmp_path}/in", "k long, seq long, v string", f"file://{tmp_path}/out", ["k"], "seq", f"{tmp_path}/cp")
    put([(1, 1, "a"), (2, 1, "b"), (1, 3, "z")])
    assert {r.k: r.v for r in run().collect()} == {1: "z", 2: "b"}
    put([(1, 2, "c"), (3, 1, "d"), (2, 2, "e")])
    assert {r.k: r.v for r in run().collect()} == {1: "z", 2: "e", 3: "d"}
    assert {r.k: r.v for r in run().collect()} == {1: "z", 2: "e", 3: "d"}
    assert I.read(spark, f"file://{tmp_path}/none") is None


def test_two_files_and_deep_levels(spark, tmp_path):
    text = "0 HEAD\n0 @I1@ INDI\n1 NAME A /B/\n1 FAMS @F1@\n0 @I2@ INDI\n1 NAME C /B/\n1 FAMC @F1@\n0 @F1@ FAM\n1 HUSB @I1@\n1 CHIL @I2@\n0 TRLR\n"
    (tmp_path / "d").mkdir()
    for n in ("x", "y"):
        (tmp_path / "d" / f"{n}.ged").write_text(text)
    p = gedcom.read_pedigree(spark, str(tmp_path / "d"))
    assert p.parent_edge.count() == 2 and p.individuals.select("xref").distinct().count() == 4
    deep = "0 HEAD\n0 @N@ NOTE x\n" + "".join(f"{k} T{k} v{k}\n" for k in range(1, 21)) + "3 BACK z\n0 TRLR"
    (tmp_path / "deep.ged").write_text(deep)
    rows = {r.tag: r for r in gedcom.lines(spark, str(tmp_path / "deep.ged")).collect()}
    assert all(rows[f"T{k}"].parent_line_no == rows[f"T{k - 1}"].line_no for k in range(2, 21)) and rows["BACK"].parent_line_no == rows["T2"].line_no


def test_gedcom_records(spark, tmp_path):
    f = tmp_path / "r.ged"
    f.write_text("0 HEAD\n1 SOUR prog\n2 VERS 7\n1 GEDC\n2 VERS 5.5.1\n2 FORM LINEAGE-LINKED\n1 CHAR UTF-8\n1 SUBM @U@\n0 @U@ SUBM\n1 NAME Sub\n0 @S@ SOUR\n1 TITL Book\n1 AUTH Me\n0 @R@ REPO\n1 NAME Lib\n0 @N@ NOTE shared\n1 CONT text\n0 @I@ INDI\n1 NAME Dr. Ann May /Lee/\n1 NAME Ann /Kay/\n2 TYPE married\n2 SPFX de\n2 SURN Kay\n1 NOTE @N@\n1 NOTE inline\n1 BIRT\n2 DATE 1 JAN 1800\n1 EVEN\n2 TYPE Census\n2 DATE 1810\n1 FAMS @F@\n0 TRLR\n")
    every = gedcom.lines(spark, str(f))
    h = gedcom.header(every).first()
    assert (h.source, h.source_version, h.version, h.form, h.charset, h.submitter) == ("prog", "7", "5.5.1", "LINEAGE-LINKED", "UTF-8", "@U@")
    assert [tuple(r)[1:] for r in gedcom.sources(every).collect()] == [("@S@", "Book", "Me", None, None)] and gedcom.repositories(every).first().name == "Lib" and gedcom.submitters(every).first().name == "Sub"
    n = {r.ordinal: r for r in gedcom.names(every).collect()}
    assert (n[0].prefix, n[0].given, n[0].surname, n[0].full, n[0].is_primary) == ("Dr.", "Ann May", "Lee", "Dr. Ann May Lee", True) and (n[1].type, n[1].full, n[1].is_primary) == ("married", "de Kay", False)
    assert gedcom.names_of_type(every, "birth").first().full == "Dr. Ann May Lee" and gedcom.names_of_type(every, "married").first().full == "de Kay"
    p = gedcom.read_pedigree(spark, str(f))
    assert {(r.type, r.custom_type, r.date) for r in p.events.collect()} == {("BIRT", None, "1 JAN 1800"), ("EVEN", "Census", "1810")}
    from kindred.operators import families as G

    assert {(r.note, r.text) for r in G.notes_of(p).collect()} == {("@N@", "shared\ntext"), (None, "inline")}
    assert [r.value for r in gedcom.values(every, "BIRT.DATE").collect()] == ["1 JAN 1800"] and [tuple(r) for r in gedcom.own_links(every).collect()] == [("@I@", "@F@", "FAMS")]
    (tmp_path / "e").mkdir()
    for name, raw in (("b", b"\xff\xfe" + "0 HEAD".encode("utf-16le")), ("c", b"0 @I@ INDI"), ("d", "0 HEAD\né".encode("latin-1")), ("z", "0 HEAD\né".encode())):
        (tmp_path / "e" / f"{name}.ged").write_bytes(raw)
    got = {r.file_id[-5]: (r.encoding, r.issue) for r in gedcom.file_checks(spark, str(tmp_path / "e")).collect()}
    assert got == {"b": ("UTF-16LE", None), "c": ("UTF-8", "no_header"), "d": ("ISO-8859-1", None), "z": ("UTF-8", None)}


def test_gedcom_round_trip(spark, tmp_path):
    """Long values, events, notes, imprecise dates and header fields come back."""
    f, note = tmp_path / "a.ged", "word " * 120 + "end\nnext line"
    body = note.replace("\n", "\n2 CONT ")
    f.write_text(f"0 HEAD\n0 @I@ INDI\n1 NAME A /B/\n1 NOTE {body}\n1 NOTE @N@\n1 BIRT\n2 DATE BET 1800 AND 1805\n2 PLAC York\n1 OCCU\n2 DATE 1820\n0 @N@ NOTE shared\n0 @F@ FAM\n1 HUSB @I@\n1 DIV\n2 DATE 1 JAN 1840\n0 TRLR\n")
    p = gedcom.read_pedigree(spark, str(f))
    out = gedcom.to_gedcom(p, {"SOUR": "own", "SOUR.VERS": "2", "LANG": "English"})
    rows = [r.value for r in out.collect()]
    assert rows[0] == "0 HEAD\n1 SOUR own\n2 VERS 2\n1 GEDC\n2 FORM LINEAGE-LINKED\n2 VERS 5.5.1\n1 CHAR UTF-8\n1 LANG English" and rows[-1] == "0 TRLR"
    assert max(len(x) for r in rows for x in r.split("\n")) <= 210
    (tmp_path / "b.ged").write_text("\n".join(rows))
    q = gedcom.read_pedigree(spark, str(tmp_path / "b.ged"))
    for t, cols in (("individuals", ["xref", "name", "birth_text", "birth_place", "birth_date"]), ("families", ["family", "husband", "divorce_date"]), ("notes", ["owner", "note", "text"]), ("shared", ["note", "text"]), ("events", ["owner", "type", "date"])):
        pick = lambda x, t=t, cols=cols: sorted(map(str, getattr(x, t).select(*cols).collect()))
        assert pick(p) == pick(q), t


def test_exports(spark):
    from kindred.operators import rules as V
    from kindred.sources import export as E

    p = catalog.pedigree(spark, SF)
    docs = {(r.kind, r.id): r.body for r in E.documents(p).collect()}
    assert len(docs) == p.individuals.count() + p.families.count() and '"events":[{' in docs["person", "13"] and '"children":[' in docs["family", "0"]
    lines = [r.value for r in E.issue_lines(V.validate(p, ["death_before_birth", "missing_birth"])).collect()]
    assert lines[0].startswith("severe: death_before_birth (") and lines[2].startswith("SEVERE death_before_birth: ")
    assert E.search_lines(p.individuals.filter("xref = 13")).first().value.startswith("13\t")


def test_date_algebra(spark):
    from pyspark.sql import functions as F

    from kindred.functions import dates as D

    rows = [("3 SEP 1943", "BEF 1944"), ("BEF 1944", "3 SEP 1943"), ("ABT 1900", "1900"), ("AFT 1900", "1901"), ("1900", "1901"), ("BET 1900 AND 1901", "BET 1900 AND 1901"), ("x", "x")]
    d = spark.createDataFrame(rows, "s string, t string").withColumns({"a": S.parse_date(F.col("s")), "b": S.parse_date(F.col("t"))})
    assert [r[0] for r in d.select(D.equals(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False, True, False]
    days = spark.createDataFrame([(0,), (1,), (-400,), (30,), (31,), (800,)], "n int")
    assert [r[0] for r in days.select(D.duration_text(F.col("n"))).collect()] == ["one day", "one day", "one year and one month and 5 days", "30 days", "one month and one day", "2 years and 2 months and 10 days"]
    ranges = spark.createDataFrame([("BET 1900 AND 1902",), ("5 JAN 1900",), ("(unknown)",)], "s string").withColumn("r", D.range_of(F.col("s")))
    assert [tuple(r) for r in ranges.select("r.phrase", D.range_exact(F.col("r")), D.range_valid(F.col("r")), D.range_days(F.col("r"))).collect()] == [(False, False, True, 1094), (False, True, True, 0), (True, False, False, None)]
    words = spark.createDataFrame([("abt.",), ("Before",), ("aft",), ("x",), (None,)], "w string")
    assert [r[0] for r in words.select(D.constraint_of_word(F.col("w"))).collect()] == ["about", "before", "after", "exact", "exact"]


def test_relationships(spark):
    """A family of four generations with an uncle, cousins and a spouse."""
    from kindred.operators.paths import relationship
    from kindred.operators.pedigree import Pedigree

    people = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "xref long, name string")
    fams = spark.createDataFrame([(0, 0, 1), (1, 2, None), (2, 3, 9), (3, 4, None), (4, 5, None)], "family long, husband long, wife long")
    kids = spark.createDataFrame([(0, 2, 0), (0, 3, 1), (1, 4, 0), (2, 5, 0), (3, 6, 0), (4, 7, 0)], "family long, child long, ordinal long")
    p = Pedigree(people, fams, kids)
    want = {(0, 2): "parent", (2, 0): "child", (2, 3): "sibling", (3, 9): "spouse", (4, 0): "ancestor", (0, 6): "descendant", (4, 5): "cousin", (6, 7): "2th cousin", (4, 7): "cousin once removed", (2, 5): "distant relative"}
    assert {k: relationship(p, *k).first().label for k in want} == want
    assert relationship(p, 0, 11).count() == 0


def test_saved_pedigree(spark, tmp_path):
    from kindred.operators import maintain as M

    p = catalog.pedigree(spark, SF)
    M.save(p, f"file://{tmp_path}/p")
    again = M.load(spark, f"file://{tmp_path}/p", M.TABLES)
    assert again.parent_edge.count() == p.parent_edge.count() and again.events.count() == p.events.count()


def test_structure_issues(spark, tmp_path):
    """No header, a person without a name, an unknown sex, a family without partners and a malformed reference; a file in order has none."""
    (tmp_path / "bad.ged").write_text("0 @I1@ INDI\n1 SEX Q\n1 BIRT\n1 BIRT\n1 FAMS F1\n0 @F1@ FAM\n1 CHIL @I1@\n0 TRLR\n")
    (tmp_path / "good.ged").write_text("0 HEAD\n1 GEDC\n2 VERS 5.5.1\n1 SUBM @S@\n0 @I1@ INDI\n1 NAME A /B/\n1 SEX f\n0 @F1@ FAM\n1 HUSB @I1@\n0 TRLR\n")
    found = lambda f: {(r.xref, r.rule) for r in gedcom.structure_issues(gedcom.lines(spark, str(tmp_path / f))).collect()}
    assert found("bad.ged") == {(None, "header_missing"), ("@I1@", "name_missing"), ("@I1@", "sex_unknown"), ("@I1@", "births_repeated"), ("@I1@", "reference_malformed"), ("@F1@", "partners_missing")}
    assert found("good.ged") == set()


def test_tag_issues(spark, tmp_path):
    (tmp_path / "t.ged").write_text("0 HEAD\n1 WHAT x\n1 _OWN y\n0 @I@ INDI\n1 NAME A /B/\n2 GIVN A\n2 XXXX z\n1 MARR\n1 BIRT\n2 DATE 1800\n2 FORM q\n2 _X q\n0 @F@ FAM\n1 HUSB @I@\n1 BIRT\n0 @N@ NOTE t\n1 ANY x\n0 TRLR\n")
    got = {(r.xref, r.severity, r.rule, r.tag) for r in gedcom.tag_issues(gedcom.lines(spark, str(tmp_path / "t.ged"))).collect()}
    assert got == {(None, "warning", "tag_unknown", "WHAT"), ("@I@", "warning", "subtag_unknown", "XXXX"), ("@I@", "severe", "tag_unknown", "MARR"), ("@I@", "warning", "subtag_unknown", "FORM"), ("@F@", "severe", "tag_unknown", "BIRT")}


def test_yaml(spark, tmp_path):
    rows = [(1, 'a "b": c\nd\\', ["x", "y"]), (2, None, None), (None, None, None)]
    d = spark.createDataFrame(rows, 'id long, `na"me:` string, tags array<string>')
    assert [r.value for r in gedcom.to_yaml(d).collect()] == ['- "id": 1\n  "na\\"me:": "a \\"b\\": c\\nd\\\\"\n  "tags": ["x","y"]', '- "id": 2', "- {}"]
    gedcom.write(d, str(tmp_path / "y"), "yaml")
    assert spark.read.text(str(tmp_path / "y")).count() == 5


def test_relation_score(spark):
    from kindred.operators.pedigree import Pedigree
    from kindred.operators.duplicates import relation_scores

    people = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "xref long, name string")
    fams = spark.createDataFrame([(0, 0, 1, None), (1, 2, 4, None), (2, 3, 4, None)], "family long, husband long, wife long, marriage_date date")
    kids = spark.createDataFrame([(0, 2, 0), (0, 3, 1), (1, 5, 0), (2, 5, 0), (2, 6, 1)], "family long, child long, ordinal int")
    pairs = spark.createDataFrame([(2, 3), (5, 6), (0, 7)], "a long, b long")
    got = {(r.a, r.b): r.relation_score for r in relation_scores(pairs, Pedigree(people, fams, kids)).collect()}
    assert got == {(2, 3): round(0.5 / 0.7, 6), (5, 6): round(0.2 / 0.7, 6)}


def test_ambiguous_content_is_not_matched(spark):
    from kindred.operators.changes import match_content

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None)], "xref long, name string")
    new = spark.createDataFrame([(1, "z"), (12, "B "), (13, "c"), (15, None)], "xref long, name string")
    assert {tuple(r) for r in match_content(old, new, ["name"]).collect()} == {(1, 1, "key"), (2, 12, "content")}


def test_hops_by_bits_as_by_joins(spark):
    """A family of 150 children, a chain, a person alone, links given twice and a child without a record; sources beyond one row of words."""
    from kindred.operators.hops import Side, sums
    from kindred.operators.pedigree import Pedigree

    fams = [(1, 1, 2)] + [(k, k, None) for k in range(2, 40)]
    kids = [(1, c) for c in range(100, 250)] + [(k, k + 1) for k in range(2, 40)] + [(40, 300), (40, 301), (5, 999)]
    p = Pedigree(spark.createDataFrame([(x,) for x in [*range(1, 41), *range(100, 250), 300, 301, 302]], "xref long"), spark.createDataFrame(fams + [(1, 1, 2), (40, None, None)], "family long, husband long, wife long"), spark.createDataFrame(kids, "family long, child long"))
    got = {r.source: tuple(r)[1:] for r in p.path_sums().collect()}
    assert got == {r.source: tuple(r)[1:] for r in p.path_sums(most=0).collect()}
    assert got["I300"] == (2, 2, 1) and "I302" not in got and "I999" not in got and got["I100"][2] == 150 + 40 + 1 - 1
    import numpy as np

    at, to = np.array([0, 1, 2]), np.array([0, 0, 0])
    assert [x.tolist() for x in sums(Side(at, to, 3), Side(to, at, 1), np.arange(3), words=1)] == [[2, 2, 2], [4, 4, 4], [2, 2, 2]]


def test_cells_as_row_by_row(spark):
    """Pairs, counts and scores of cells of any size are those that a join of rows and expressions a pair give; births without a year keep their text."""
    from kindred.operators import duplicates as U
    from kindred.operators.pedigree import Pedigree

    names, born = ["John", "Jon", "Mary", "van der Berg", None], ["1850", "ABT 1851", "3 MAR 1852", "the year 1852", None, "1 JAN 850"]

    def people(births):
        rows = [(k, None if k % 11 == 3 else f"{names[k % 5] or ''} /{['Smith', 'Smyth', 'Reid', ''][k % 4]}/", names[k % 5], ["Smith", "Smyth", "Reid", None][k % 4], "MFU"[k % 3], births[k * 7 % 13 % len(births)], [None, "York, Ne, USA", "York, New York, USA", "Paris"][k % 7 % 4]) for k in [*range(120), 5]]
        return spark.createDataFrame(rows, "xref long, name string, given string, surname string, sex string, birth_text string, birth_place string")

    kids = spark.createDataFrame([(1, k) for k in (20, 24, 28, 40)], "family long, child long")
    for births in (born, [*born, "in spring"]):
        p = Pedigree(people(births), spark.createDataFrame([(1, 0, 1)], "family long, husband long, wife long"), kids)
        slow = sorted(map(tuple, U.find_duplicates(p, most=0).collect()))
        assert len(slow) > 50 and any(r[6] > 0 for r in slow)
        for chunk in (7, 2000):
            assert sorted(map(tuple, U.find_duplicates(p, chunk=chunk).collect())) == slow
        other = p.individuals.withColumn("xref", p.individuals.xref + 1000)
        slow = sorted(map(tuple, U.find_between(p.individuals, other, most=0).collect()))
        assert len(slow) > 50 and slow == sorted(map(tuple, U.find_between(p.individuals, other, chunk=7).collect()))
    pairs = sorted((r.a.xref, r.b.xref) for r in U.joined(p.individuals, 7).collect())
    assert pairs == sorted(map(tuple, U.candidate_pairs(p.individuals, 7).collect()))
    n = {}
    for a, _ in pairs:
        n[a] = n.get(a, 0) + 1
    assert n == {r.a: r.n for r in U.candidate_counts(p.individuals, 7).collect()}
