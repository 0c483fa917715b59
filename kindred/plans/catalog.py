"""Registered queries of the engine and their oracles, over the pedigree of ``driver_views``."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import dates as D
from kindred.functions import scalars as S
from kindred.operators import changes as C
from kindred.operators import duplicates as U
from kindred.operators import families as G
from kindred.operators import filters as f
from kindred.operators import maintain as M
from kindred.operators import paths as P
from kindred.operators import records as R
from kindred.operators import rules as V
from kindred.operators.pedigree import Pedigree
from kindred.plans.driver_views import SQL, pedigree, table
from kindred.plans.store import settled
from kindred.sources import export as E

PERSON, OTHER, FOUNDER = 149, 140, 0
QUALITY = ["missing_birth", "death_before_birth", "no_partners", "dangling_refs"]
_QUERIES, _SQL = {}, {}


def add(name, build, sql=None):
    """build: (pedigree, spark, sf_dir) -> DataFrame. sql: what follows the common views; a leading comma adds more of them."""
    _QUERIES[name] = lambda spark, sf_dir: build(pedigree(spark, sf_dir), spark, sf_dir)
    if sql:
        _SQL[name] = SQL + ("" if sql.lstrip().startswith(",") else " ") + sql


# relatives of everyone
add("parents", lambda p, *_: p.relatives("parents"), "SELECT DISTINCT child AS xref, parent AS relative FROM pe")
add("children", lambda p, *_: p.relatives("children"), "SELECT DISTINCT parent AS xref, child AS relative FROM pe")
add("siblings", lambda p, *_: p.relatives("siblings"), "SELECT DISTINCT a AS xref, b AS relative FROM sib")
add("spouses", lambda p, *_: p.relatives("spouses"), "SELECT DISTINCT a AS xref, b AS relative FROM se")
add("grandparents", lambda p, *_: p.relatives("grandparents"), "SELECT x.child AS xref, y.parent AS relative FROM pe x JOIN pe y ON x.parent = y.child")
add("grandchildren", lambda p, *_: p.relatives("grandchildren"), "SELECT x.parent AS xref, y.child AS relative FROM pe x JOIN pe y ON x.child = y.parent")
add("uncles", lambda p, *_: p.relatives("uncles"), "SELECT x.child AS xref, s.b AS relative FROM (SELECT DISTINCT child, parent FROM pe) x JOIN (SELECT DISTINCT a, b FROM sib) s ON x.parent = s.a")
add("nephews", lambda p, *_: p.relatives("nephews"), "SELECT s.a AS xref, x.child AS relative FROM (SELECT DISTINCT a, b FROM sib) s JOIN (SELECT DISTINCT child, parent FROM pe) x ON x.parent = s.b")

# recursion
UP = ", anc(root, xref, depth) AS (SELECT xref, xref, 0 FROM ind WHERE {where} UNION SELECT root, parent, depth + 1 FROM anc JOIN pe ON child = xref{limit}), c AS (SELECT root, xref, CAST(min(depth) AS BIGINT) AS depth FROM anc GROUP BY 1, 2) "
DOWN = UP.replace("SELECT root, parent, depth", "SELECT root, child, depth").replace("ON child = xref", "ON parent = xref")
one = lambda x: f"xref = {x}"
add("ancestors", lambda p, *_: p.closure(p.roots(PERSON)).select("xref", "depth"), UP.format(where=one(PERSON), limit="") + "SELECT xref, depth FROM c WHERE depth > 0")
add("ancestors_max_gen", lambda p, *_: p.closure(p.roots(PERSON), max_generations=2).select("xref", "depth"), UP.format(where=one(PERSON), limit=" WHERE depth < 2") + "SELECT xref, depth FROM c WHERE depth > 0")
add("ancestors_all", lambda p, *_: p.closure(None), UP.format(where="true", limit="") + "SELECT * FROM c WHERE depth > 0")
add("ancestors_count", lambda p, *_: p.closure(None).groupBy("root").agg(F.count("*").alias("n")), UP.format(where="true", limit="") + "SELECT root, count(*) AS n FROM c WHERE depth > 0 GROUP BY 1")
add("descendants", lambda p, *_: p.closure(p.roots(FOUNDER), False).select("xref", "depth"), DOWN.format(where=one(FOUNDER), limit="") + "SELECT xref, depth FROM c WHERE depth > 0")
add("descendants_max_gen", lambda p, *_: p.closure(p.roots(FOUNDER), False, 2).select("xref", "depth"), DOWN.format(where=one(FOUNDER), limit=" WHERE depth < 2") + "SELECT xref, depth FROM c WHERE depth > 0")
add("descendants_count", lambda p, *_: p.closure(p.roots(FOUNDER), False).agg(F.count("*").alias("n")), DOWN.format(where=one(FOUNDER), limit="") + "SELECT count(*) AS n FROM c WHERE depth > 0")
add("multi_ancestors", lambda p, *_: p.closure(p.roots(PERSON, OTHER)).select("xref").distinct(), UP.format(where=f"xref IN ({PERSON}, {OTHER})", limit="") + "SELECT DISTINCT xref FROM c WHERE depth > 0")
COMMON = UP.format(where=f"xref IN ({PERSON}, {OTHER})", limit="").rstrip() + f", ca AS (SELECT x.xref, x.depth AS depth_a, y.depth AS depth_b FROM c x JOIN c y ON x.xref = y.xref WHERE x.root = {PERSON} AND y.root = {OTHER}) "
add("common_ancestors", lambda p, *_: p.common_ancestors(PERSON, OTHER), COMMON + "SELECT * FROM ca")
add("lca", lambda p, *_: p.lowest_common_ancestor(PERSON, OTHER), COMMON + "SELECT * FROM ca ORDER BY greatest(depth_a, depth_b), depth_a + depth_b, xref LIMIT 1")
add("multi_common_ancestors", lambda p, *_: p.multi_common_ancestors(PERSON, OTHER, 130), UP.format(where=f"xref IN ({PERSON}, {OTHER}, 130)", limit="") + "SELECT xref FROM c GROUP BY 1 HAVING count(DISTINCT root) = 3")
add("intersection_q", lambda p, *_: p.closure(p.roots(PERSON)).select("xref").intersect(p.closure(p.roots(OTHER)).select("xref")), COMMON + "SELECT xref FROM ca WHERE depth_a > 0 AND depth_b > 0")
add("subtree", lambda p, *_: p.subtree(20, up=3, down=3), ", up(x, d) AS (SELECT 20, 0 UNION SELECT parent, d + 1 FROM up JOIN pe ON child = x WHERE d < 3), dn(x, d) AS (SELECT 20, 0 UNION SELECT child, d + 1 FROM dn JOIN pe ON parent = x WHERE d < 3), "
    "u AS (SELECT 20 AS xref, 0 AS i, 'self' AS part UNION ALL SELECT x, 1, 'ancestor' FROM up WHERE d > 0 UNION ALL SELECT x, 2, 'descendant' FROM dn WHERE d > 0 UNION ALL SELECT b, 3, 'sibling' FROM sib WHERE a = 20 UNION ALL SELECT b, 4, 'spouse' FROM se WHERE a = 20) "
    "SELECT CAST(xref AS BIGINT) AS xref, arg_min(part, i) AS part FROM u GROUP BY 1")
KIN = UP.format(where="true", limit="").rstrip() + """, m AS (SELECT x.root AS a, y.root AS b, x.depth AS da, y.depth AS db, row_number() OVER (PARTITION BY x.root, y.root ORDER BY greatest(x.depth, y.depth), x.depth + y.depth, x.xref) AS r FROM c x JOIN c y ON x.xref = y.xref AND x.root <> y.root),
 k AS (SELECT a, b, da AS depth_a, db AS depth_b, least(da, db) - 1 AS deg, abs(da - db) AS rem FROM m WHERE r = 1),
 l AS (SELECT a, b, depth_a, depth_b, CASE WHEN depth_a = 0 AND depth_b = 1 THEN 'parent' WHEN depth_a = 1 AND depth_b = 0 THEN 'child' WHEN depth_b = 0 THEN 'ancestor' WHEN depth_a = 0 THEN 'descendant' WHEN deg = 0 AND rem = 0 THEN 'sibling'
  WHEN deg = 1 AND rem = 0 THEN 'cousin' WHEN deg = 1 AND rem = 1 THEN 'cousin once removed' WHEN deg = 1 THEN 'cousin ' || rem || ' times removed' WHEN deg > 1 AND rem = 0 THEN deg || 'th cousin' ELSE 'distant relative' END AS label,
  CASE WHEN least(depth_a, depth_b) = 0 THEN depth_a + depth_b ELSE deg END AS degree, CASE WHEN least(depth_a, depth_b) = 0 THEN 0 ELSE rem END AS removal FROM k) """
add("kinship_label", lambda p, *_: p.kinship(None), KIN + "SELECT * FROM l")
add("cousins_1", lambda p, *_: p.cousins(1), KIN + "SELECT a, b FROM l WHERE label = 'cousin'")
add("cousins_2", lambda p, *_: p.cousins(2), KIN + "SELECT a, b FROM l WHERE label = '2th cousin'")

# paths and metrics
LINKS = ", link AS (SELECT child AS x, parent AS y FROM pe UNION SELECT parent, child FROM pe UNION SELECT a, b FROM sib UNION SELECT a, b FROM se), "


def _pairs_related(p, pairs):
    out = None
    for a, b in pairs:
        part = P.relationship(p, a, b).select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), "*")
        out = part if out is None else out.unionByName(part)
    return out


HOPS = ", bfs(source, node, hops) AS (SELECT 'I149', 'I149', 0 UNION SELECT source, dst, hops + 1 FROM bfs JOIN edge ON src = node WHERE hops < 90), d AS (SELECT source, node, CAST(min(hops) AS BIGINT) AS hops FROM bfs GROUP BY 1, 2) "
add("shortest_path_length", lambda p, *_: p.distances(p.roots(PERSON)), HOPS + "SELECT * FROM d")
add("eccentricity", lambda p, *_: p.distances(p.roots(PERSON)).filter("node like 'I%'").agg(F.max("hops").alias("farthest")), HOPS + "SELECT max(hops) AS farthest FROM d WHERE node LIKE 'I%'")
WALK = ", w(nodes, t, last, n) AS (SELECT ['I{a}'], CAST([] AS VARCHAR[]), 'I{a}', 0 UNION ALL SELECT list_append(nodes, dst), list_append(t, edge_type), dst, n + 1 FROM w JOIN edge ON src = last WHERE n < {n} AND last <> 'I{b}' AND NOT list_contains(nodes, dst)), pt AS (SELECT *, CASE WHEN list_has_any(t, ['FAMC', 'CHIL']) AND list_has_any(t, ['HUSB', 'WIFE', 'FAMS']) THEN 'mixed' WHEN list_has_any(t, ['HUSB', 'WIFE', 'FAMS']) THEN 'marital' ELSE 'blood' END AS path_type FROM w WHERE last = 'I{b}') "
ROUTE = "SELECT array_to_string(nodes, '>') AS nodes, array_to_string(t, '>') AS edge_types, CAST(n AS BIGINT) AS length, path_type FROM pt "
_route = lambda df: df.select(F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_types", ">").alias("edge_types"), "length", "path_type")
for name, a_, b_, n_ in [("shortest_path", 20, 34, 8), ("shortest_path_siblings", 20, 19, 4), ("shortest_path_none", 20, 20, 2)]:
    add(name, lambda p, *_, a=a_, b=b_: _route(P.shortest_path(p, a, b)), WALK.format(a=a_, b=b_, n=n_) + ROUTE + ("ORDER BY n, list_transform(w.nodes, lambda x: x) LIMIT 1".replace("w.nodes", "pt.nodes")))
add("paths_blood_only", lambda p, *_: _route(P.find_paths(p, 20, 18, 6, marital=False)), WALK.format(a=20, b=18, n=6) + ROUTE + "WHERE path_type IN ('mixed', 'blood')")
add("relationship", lambda p, s, d: _pairs_related(p, [(20, 19), (16, 6), (0, 149), (149, 140), (6, 9)]))
add("ancestors_with_paths", lambda p, *_: P.ancestors_with_paths(p, PERSON).select("xref", "depth", F.array_join("path", ">").alias("path")), ", lines(xref, path) AS (SELECT xref, [xref] FROM ind WHERE xref = 149 UNION ALL SELECT parent, list_append(path, parent) FROM lines JOIN pe ON child = xref) SELECT xref, CAST(len(path) - 1 AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY xref ORDER BY len(path), path) AS r FROM lines) WHERE r = 1 AND len(path) > 1")
add("reachable_2", lambda p, *_: P.reachable(p, PERSON, 2), LINKS + "r2(x, d) AS (SELECT 149, 0 UNION SELECT y, d + 1 FROM r2 JOIN link USING (x) WHERE d < 2) SELECT CAST(x AS BIGINT) AS xref, CAST(min(d) AS BIGINT) AS depth FROM r2 GROUP BY 1")
add("reachable_10", lambda p, *_: P.reachable(p, PERSON, 0, 10), LINKS + "r2(x, d) AS (SELECT 149, 0 UNION SELECT y, d + 1 FROM r2 JOIN link USING (x) WHERE d < 30) SELECT CAST(x AS BIGINT) AS xref, CAST(min(d) AS BIGINT) AS depth FROM r2 GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
# everyone, without a cap; too slow in SQL
add("diameter", lambda p, *_: p.diameter())
add("avg_path_length", lambda p, *_: p.average_path_length())
add("closeness", lambda p, *_: p.path_sums().select("source", F.round(F.col("reached") / F.col("total"), 6).alias("closeness")))
add("all_paths_bounded", lambda p, *_: p.all_paths(20, 21, 4).select(F.array_join("nodes", ">").alias("nodes"), "length", "path_type"),
    ", w(nodes, t, last, n) AS (SELECT ['I20'], CAST([] AS VARCHAR[]), 'I20', 0 UNION ALL SELECT list_append(nodes, dst), list_append(t, edge_type), dst, n + 1 FROM w JOIN edge ON src = last WHERE n < 4 AND last <> 'I21' AND NOT list_contains(nodes, dst)) "
    "SELECT array_to_string(nodes, '>') AS nodes, CAST(n AS BIGINT) AS length, CASE WHEN list_has_any(t, ['FAMC', 'CHIL']) AND list_has_any(t, ['HUSB', 'WIFE', 'FAMS']) THEN 'mixed' WHEN list_has_any(t, ['HUSB', 'WIFE', 'FAMS']) THEN 'marital' ELSE 'blood' END AS path_type FROM w WHERE last = 'I21'")
add("betweenness_sample", lambda p, *_: p.betweenness(p.roots(20, 25), 4),
    ", w(source, node, path) AS (SELECT 'I' || xref, 'I' || xref, ['I' || xref] FROM ind WHERE xref IN (20, 25) UNION SELECT source, dst, list_append(path, dst) FROM w JOIN edge ON src = node WHERE len(path) < 5), "
    "g AS (SELECT source, node, path FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY len(path), path) AS r FROM w) WHERE r = 1 AND node LIKE 'I%' AND node <> source), "
    "k AS (SELECT * FROM g WHERE NOT (source > node AND EXISTS (SELECT 1 FROM g h WHERE h.source = g.node AND h.node = g.source))), c AS (SELECT unnest(path[2:len(path) - 1]) AS node FROM k) "
    "SELECT node, count(*) AS paths, round(2 * count(*) / ((SELECT count(*) FROM ind) * ((SELECT count(*) FROM ind) - 1)), 12) AS betweenness FROM c GROUP BY 1")
add("longest_path_bounded", lambda p, *_: p.longest_path(p.roots(20), 6).select(F.array_join("path", ">").alias("path"), "length"),
    ", w(path) AS (SELECT ['I20'] UNION SELECT list_append(path, dst) FROM w JOIN edge ON src = path[-1] WHERE len(path) < 7 AND NOT list_contains(path, dst)) "
    "SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS length FROM w WHERE len(path) > 1 AND path[-1] LIKE 'I%' ORDER BY len(w.path) DESC, w.path LIMIT 1")
DEGREE = "(SELECT node, sum(o) AS out_degree, sum(i) AS in_degree, sum(o + i) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge) GROUP BY 1)"
add("degree", lambda p, *_: p.degrees(), f"SELECT node, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree AS BIGINT) AS in_degree, CAST(degree AS BIGINT) AS degree FROM {DEGREE}")
add("avg_degree", lambda p, *_: p.degrees().filter("node like 'I%'").agg(F.round(F.avg("degree"), 6).alias("avg_degree")), f"SELECT round(avg(degree), 6) AS avg_degree FROM {DEGREE} WHERE node LIKE 'I%'")
add("node_edge_count", lambda p, *_: p.individuals.agg(F.count("*").alias("people")).join(p.families.agg(F.count("*").alias("families"))).join(p.edges.agg(F.count("*").alias("edges"))),
    "SELECT (SELECT count(*) FROM ind) AS people, (SELECT count(*) FROM fam) AS families, (SELECT count(*) FROM edge) AS edges")
add("density", lambda p, *_: p.edges.agg(F.count("*").alias("e")).join(p.degrees().agg(F.count("*").alias("n"))).select(F.round(F.col("e") / (F.col("n") * (F.col("n") - 1)), 9).alias("density")), f"SELECT round((SELECT count(*) FROM edge) / (n * (n - 1)), 9) AS density FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM {DEGREE})")
COMP = LINKS + "known AS (SELECT * FROM link WHERE x IN (SELECT xref FROM ind) AND y IN (SELECT xref FROM ind)), reach(a, b) AS (SELECT xref, xref FROM ind UNION SELECT a, y FROM reach JOIN known ON b = x), comp AS (SELECT a AS xref, min(b) AS component FROM reach GROUP BY 1) "
add("components", lambda p, *_: p.components(), COMP + "SELECT * FROM comp")
add("component_sizes", lambda p, *_: p.components().groupBy("component").agg(F.count("*").alias("n")), COMP + "SELECT component, count(*) AS n FROM comp GROUP BY 1")
add("is_connected", lambda p, *_: p.components().filter(F.col("xref").isin(PERSON, OTHER)).agg((F.countDistinct("component") == 1).alias("connected")), COMP + f"SELECT count(DISTINCT component) = 1 AS connected FROM comp WHERE xref IN ({PERSON}, {OTHER})")
add("component_of", lambda p, *_: p.component_of(PERSON), COMP + f"SELECT xref FROM comp WHERE component = (SELECT component FROM comp WHERE xref = {PERSON})")
add("degree_centrality", lambda p, *_: p.degree_centrality(), f"SELECT node, round(degree / ((SELECT count(*) FROM ind) - 1.0), 9) AS centrality FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) WHERE node LIKE 'I%' AND CAST(node[2:] AS BIGINT) IN (SELECT xref FROM ind)")


def _looped(p):
    """The first 120 people, with someone who is a child of a grandchild's family."""
    stray = p.children.sparkSession.createDataFrame([(3, 0, 9)], "family long, child long, ordinal long")
    return Pedigree(p.individuals.filter("xref < 120"), p.families, p.children.filter("child < 120").unionByName(stray))


add("cycles", lambda p, *_: _looped(p).cycles(), ", c2 AS (SELECT family, child FROM chil WHERE child < 120 UNION ALL SELECT 3, 0), p2 AS (SELECT child, unnest([husband, wife]) AS parent FROM c2 JOIN fam USING (family)), up2(a, b) AS (SELECT child, parent FROM p2 WHERE parent < 120 UNION SELECT a, parent FROM up2 JOIN p2 ON child = b WHERE parent < 120) SELECT DISTINCT a AS xref FROM up2 WHERE b IN (SELECT a FROM up2 WHERE a = b)")
add("cycles_none", lambda p, *_: p.cycles(), "SELECT CAST(0 AS BIGINT) AS xref WHERE false")

# filters
COLS = ["xref", "name"]
for name, cond, sql in [
    ("name_contains", lambda: f.contains("name", "MAR"), "contains(lower(name), 'mar')"), ("name_exact", lambda: f.equals("name", "Mary /reid/"), "lower(name) = 'mary /reid/'"), ("surname_exact", lambda: f.equals("surname", "smith"), "lower(surname) = 'smith'"),
    ("name_starts", lambda: f.starts("name", "jo"), "starts_with(lower(name), 'jo')"), ("name_ends", lambda: f.ends("name", "N/"), "ends_with(lower(name), 'n/')"),
    ("surname_contains", lambda: f.contains("surname", "ar"), "contains(lower(surname), 'ar')"), ("given_exact", lambda: f.equals("given", "ROBERT"), "lower(given) = 'robert'"),
    ("given_contains", lambda: f.contains("given", "an"), "contains(lower(given), 'an')"), ("place_contains", lambda: f.contains("birth_place", "york"), "contains(lower(birth_place), 'york')"),
    ("birth_range", lambda: f.born_between("1610-01-01", "1700-06-30"), "birth_date BETWEEN DATE '1610-01-01' AND DATE '1700-06-30'"), ("birth_before", lambda: f.born_before(1700), "birth_date <= DATE '1700-12-31'"),
    ("birth_after", lambda: f.born_after(1700), "birth_date >= DATE '1700-01-01'"), ("birth_year", lambda: f.born_in(1664), "year(birth_date) = 1664"), ("birth_month", lambda: f.born_in_month(5), "month(birth_date) = 5"),
    ("birth_day", lambda: f.born_on_day(12), "day(birth_date) = 12"), ("birth_month_day", lambda: f.born_in_month(3) & f.born_on_day(3), "month(birth_date) = 3 AND day(birth_date) = 3"),
    ("by_sex", lambda: f.sex("f"), "sex = 'F'"), ("living", lambda: f.living(), "death_date IS NULL"), ("deceased", lambda: f.deceased(), "death_date IS NOT NULL"),
    ("combined", lambda: f.sex("M") & f.living() & f.born_after(1650) & f.contains("birth_place", "a"), "sex = 'M' AND death_date IS NULL AND birth_date >= DATE '1650-01-01' AND contains(lower(birth_place), 'a')")]:
    add(name, lambda p, *_, cond=cond: p.individuals.filter(cond()).select(*COLS), f"SELECT xref, name FROM ind WHERE {sql}")
for name, edge, column, want, sql in [("has_children", "parent_edge", "parent", True, "xref IN (SELECT parent FROM pe)"), ("no_children", "parent_edge", "parent", False, "xref NOT IN (SELECT parent FROM pe WHERE parent IS NOT NULL)"),
                                      ("has_spouse", "spouse_edge", "a", True, "xref IN (SELECT a FROM se)"), ("no_spouse", "spouse_edge", "a", False, "xref NOT IN (SELECT a FROM se)")]:
    add(name, lambda p, *_, e=edge, c=column, w=want: f.with_relatives(p.individuals, getattr(p, e), c, w).select(*COLS), f"SELECT xref, name FROM ind WHERE {sql}")
add("sorted_top", lambda p, *_: f.top(p.individuals, "birth_date", 20).select("xref", "birth_date"), "SELECT xref, birth_date FROM ind ORDER BY birth_date NULLS LAST, xref LIMIT 20")

# collections
NAMES = {"full_name": "trim(regexp_replace(replace(coalesce(name, ''), '/', ''), '[ ]+', ' ', 'g'))", "given": "coalesce(given, '')", "surname": "coalesce(surname, '')", "given_surname": "coalesce(given, '') || '|' || coalesce(surname, '')", "surname_given": "coalesce(surname, '') || '|' || coalesce(given, '')"}
for name, sql in NAMES.items():
    add(f"names_unique_{name}", lambda p, *_, k=name: R.name_keys(p.individuals, k), f"SELECT DISTINCT key FROM (SELECT {sql} AS key FROM ind) WHERE key NOT IN ('', '|')")
add("unique_names", lambda p, *_: R.unique_names(p.individuals), "SELECT DISTINCT 'given' AS kind, given AS value FROM ind WHERE given IS NOT NULL UNION ALL SELECT DISTINCT 'surname', surname FROM ind WHERE surname IS NOT NULL")
PLACES = ", pl AS (SELECT CASE type WHEN 'BIRT' THEN 'birth' WHEN 'DEAT' THEN 'death' WHEN 'MARR' THEN 'marriage' WHEN 'DIV' THEN 'divorce' END AS source, owner, place, string_split(place, ', ') AS w FROM ev WHERE place IS NOT NULL AND type IN ('BIRT', 'DEAT', 'MARR', 'DIV')), "
PLACES += "pp AS (SELECT *, w[1] AS city, CASE WHEN len(w) = 3 THEN w[2] WHEN NOT regexp_matches(upper(w[2]), 'US|UNITED STATES|UK|UNITED KINGDOM|ENGLAND|CANADA|AUSTRALIA|GERMANY|FRANCE|IRELAND') THEN w[2] END AS state, CASE WHEN len(w) = 3 THEN w[3] WHEN regexp_matches(upper(w[2]), 'US|UNITED STATES|UK|UNITED KINGDOM|ENGLAND|CANADA|AUSTRALIA|GERMANY|FRANCE|IRELAND') THEN w[2] END AS country FROM pl) "
add("places", lambda p, *_: R.places(p), PLACES + "SELECT source, owner, place FROM pl")
add("places_of_births", lambda p, *_: R.places(p, deaths=False, marriages=False), PLACES + "SELECT source, owner, place FROM pl WHERE source IN ('birth', 'divorce')")
for name, sql in {"full_string": "place", "city": "city", "state": "state", "country": "country", "city_state": "coalesce(city, '') || '|' || coalesce(state, '')"}.items():
    add(f"places_unique_{name}", lambda p, *_, k=name: R.place_keys(R.places(p), k), PLACES + f"SELECT DISTINCT {sql} AS key FROM pp WHERE {sql} IS NOT NULL")
add("top_given", lambda p, *_: R.most_common(p.individuals, "given", 5), "SELECT lower(trim(given)) AS name, count(*) AS n FROM ind WHERE given IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
add("top_surname", lambda p, *_: R.most_common(p.individuals, "surname", 5), "SELECT lower(trim(surname)) AS name, count(*) AS n FROM ind WHERE surname IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
FC = ", fc AS (SELECT fam.*, coalesce(n, 0) AS n_children FROM fam LEFT JOIN (SELECT family, count(*) AS n FROM chil GROUP BY 1) c USING (family)) "
for name, key in R.FAMILY_KEYS.items():
    cols = ["family", *[k for k in key if k != "family"]]
    cond = f"WHERE {key[0]} IS NOT NULL " if name != "husband_wife" else ""
    add(f"families_unique_{name}", lambda p, *_, k=name, c=cols: R.unique_families(p, k).select(*c), FC + f"SELECT min(family) AS family{''.join(', ' + k for k in cols[1:])} FROM fc {cond}GROUP BY ALL" if name != "xref" else FC + "SELECT family FROM fc")
for name, key in R.EVENT_KEYS.items():
    cols = ["event_id", *[k for k in key if k != "event_id"]]
    add(f"events_unique_{name}", lambda p, *_, k=name, c=cols: R.unique_events(p.events, k).select(*c), f"SELECT min(event_id) AS event_id{''.join(', ' + k for k in cols[1:])} FROM ev WHERE {' AND '.join(f'{k} IS NOT NULL' for k in key)} GROUP BY {', '.join(key)}")
add("events_of_types", lambda p, *_: R.unique_events(p.events, "place", ["BIRT", "MARR"]).select("place", "event_id"), "SELECT place, min(event_id) AS event_id FROM ev WHERE type IN ('BIRT', 'MARR') AND place IS NOT NULL GROUP BY 1")
add("stream_events_unique_type", lambda p, s, d: R.distinct_by(table(s, d, "events").select("event_type", "event_id"), ["event_type"], "event_id"), "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
add("event_table", lambda p, *_: G.event_table(p).select("event_id", "type", "effective", "standard", "owner_type", "owner"), "SELECT event_id, type, CASE WHEN type = 'EVEN' THEN custom_type ELSE type END AS effective, true AS standard, owner_type, owner FROM ev")
add("events_of_person", lambda p, *_: G.events_of(p, "I", 13).select("event_id", "type", "date"), "SELECT min(event_id) AS event_id, type, date FROM ev WHERE owner_type = 'I' AND owner = 13 GROUP BY type, date")
add("events_of_family", lambda p, *_: G.events_of(p, "F", 4).select("event_id", "type", "date"), "SELECT min(event_id) AS event_id, type, date FROM ev WHERE owner_type = 'F' AND owner = 4 GROUP BY type, date")
add("owners_of_event", lambda p, *_: G.owners_of(p, "B20"), "SELECT DISTINCT owner_type, owner FROM ev WHERE event_id = 'B20'")
add("vital_events", lambda p, *_: G.vital_events(p).select("xref", "birth", "death", "occupation"), "SELECT owner AS xref, max(date) FILTER (type = 'BIRT') AS birth, max(date) FILTER (type = 'DEAT') AS death, max(date) FILTER (type = 'OCCU') AS occupation FROM ev WHERE owner_type = 'I' GROUP BY 1")
EVD = """, dt AS (SELECT ev.*, ind.birth_year AS y, bt, 1 + (CASE WHEN xref % 50 = 49 THEN xref - 1 ELSE xref END // 3) % 12 AS m, 1 + CASE WHEN xref % 50 = 49 THEN xref - 1 ELSE xref END % 28 AS d FROM ev JOIN ind ON owner_type = 'I' AND type = 'BIRT' AND owner = xref WHERE birth_text IS NOT NULL) """
add("events_on_date", lambda p, *_: G.events_on(p, 0, 3, 3).filter("type != 'EVEN'").select("event_id"), EVD + "SELECT event_id FROM dt WHERE bt IN (0, 8) AND m = 3 AND d = 3 OR bt IN (6, 7) AND true UNION ALL SELECT event_id FROM ev WHERE false")
add("events_on_date_by_type", lambda p, *_: G.events_on(p, 1664, 0, 0, "BIRT").select("event_id"), EVD + "SELECT event_id FROM dt WHERE bt NOT IN (6, 7, 9) AND y = 1664 OR bt = 6 AND 1664 BETWEEN y AND y + 3 OR bt = 7 AND 1664 BETWEEN y AND y + 2")
add("notes_of", lambda p, *_: G.notes_of(p), "SELECT owner, note, s.text FROM note JOIN shared s USING (note) UNION ALL SELECT owner, note, text FROM note WHERE note IS NULL")
add("records_for_note", lambda p, *_: G.records_for_note(p, "N3"), "SELECT DISTINCT owner FROM note WHERE note = 'N3'")
add("note_edges", lambda p, *_: G.note_edges(p), "SELECT owner AS src, note AS dst, 'NOTE' AS edge_type FROM note WHERE note IN (SELECT note FROM shared) UNION ALL SELECT owner_type || owner, event_id, 'HAS_EVENT' FROM ev")
add("graph_nodes", lambda p, *_: G.graph_nodes(p).groupBy("kind").agg(F.count("*").alias("n")), "SELECT 'person' AS kind, (SELECT count(*) FROM ind) AS n UNION ALL SELECT 'family', (SELECT count(*) FROM fam) UNION ALL SELECT 'note', 4 UNION ALL SELECT 'event', (SELECT count(*) FROM ev)")

# families
MEM = ", mem AS (SELECT family, husband AS xref, 'husband' AS role, CAST(NULL AS BIGINT) AS ordinal FROM fam WHERE husband IS NOT NULL UNION ALL SELECT family, wife, 'wife', NULL FROM fam WHERE wife IS NOT NULL UNION ALL SELECT family, child, 'child', ordinal FROM chil) "
add("family_members", lambda p, *_: G.members(p), MEM + "SELECT * FROM mem")
add("family", lambda p, *_: G.family(p, 1), MEM + "SELECT xref, role, ordinal FROM mem WHERE family = 1 AND xref IN (SELECT xref FROM ind)")
add("family_parents", lambda p, *_: G.parents_of_family(p, 4), MEM + "SELECT xref, role FROM mem WHERE family = 4 AND role <> 'child' AND xref IN (SELECT xref FROM ind)")
add("family_facts", lambda p, *_: G.facts(p), FC + "SELECT family, marriage_date, marriage_place, divorce_date, divorce_place, n_children, CASE WHEN divorce_date >= marriage_date THEN date_diff('year', marriage_date, divorce_date) - CASE WHEN strftime(divorce_date, '%m%d') < strftime(marriage_date, '%m%d') THEN 1 ELSE 0 END ELSE -(date_diff('year', divorce_date, marriage_date)) END AS years FROM fc")
FOF = MEM.rstrip() + ", fo AS (SELECT mem.xref, family, role, CASE role WHEN 'husband' THEN wife WHEN 'wife' THEN husband END AS spouse FROM mem LEFT JOIN fam USING (family)) "
add("families_of", lambda p, *_: G.families_of(p), FOF + "SELECT * FROM fo")
add("families_with_spouse", lambda p, *_: G.families_with_spouse(p, 6, 9), FOF + "SELECT family FROM fo WHERE xref = 6 AND spouse = 9")
add("families_unknown_spouse", lambda p, *_: G.families_with_unknown_spouse(p), FOF + "SELECT xref, family FROM fo WHERE role <> 'child' AND spouse IS NULL")
add("has_child", lambda p, *_: G.has_child(p).groupBy("family").agg(F.count("*").alias("n")), "SELECT family, count(DISTINCT child) AS n FROM chil GROUP BY 1")
add("union_q", lambda p, *_: p.individuals.filter(f.sex("M") & f.living()).select("xref").union(p.individuals.filter(f.born_in(1664)).select("xref")).distinct(), "SELECT xref FROM ind WHERE sex = 'M' AND death_date IS NULL UNION SELECT xref FROM ind WHERE year(birth_date) = 1664")

# rules
AGE = "year({t}) - year({b}) - CASE WHEN strftime({t}, '%m%d') < strftime({b}, '%m%d') THEN 1 ELSE 0 END"
for name, sql in [
    ("missing_birth", "SELECT xref, CAST(NULL AS BIGINT) AS detail FROM ind WHERE birth_date IS NULL"), ("death_before_birth", "SELECT xref, CAST(birth_date - death_date AS BIGINT) AS detail FROM ind WHERE death_date < birth_date"),
    ("parent_age", f"SELECT parent AS xref, CAST(age AS BIGINT) AS detail FROM (SELECT parent, {AGE.format(t='c.birth_date', b='q.birth_date')} AS age FROM pe JOIN ind c ON c.xref = child JOIN ind q ON q.xref = parent) WHERE age < 10 OR age > 80"),
    ("marriage_age", f"SELECT xref, CAST(age AS BIGINT) AS detail FROM (SELECT xref, {AGE.format(t='marriage_date', b='birth_date')} AS age FROM fam JOIN ind ON xref IN (husband, wife)) WHERE age < 12 OR age > 100"),
    ("dangling_refs", "SELECT CAST(xref AS BIGINT) AS xref, CAST(NULL AS BIGINT) AS detail FROM (SELECT husband AS xref FROM fam UNION SELECT wife FROM fam UNION SELECT child FROM chil) WHERE xref IS NOT NULL AND xref NOT IN (SELECT xref FROM ind)"),
    ("age_at_death", f"SELECT xref, CAST(age AS BIGINT) AS detail FROM (SELECT xref, {AGE.format(t='death_date', b='birth_date')} AS age FROM ind WHERE death_date >= birth_date) WHERE age > 120"),
    ("missing_death", "SELECT xref, CAST(2025 - year(birth_date) AS BIGINT) AS detail FROM ind WHERE death_date IS NULL AND 2025 - year(birth_date) > 100"),
    ("marriage_before_birth", "SELECT xref, CAST(birth_date - marriage_date AS BIGINT) AS detail FROM fam JOIN ind ON xref IN (husband, wife) WHERE marriage_date < birth_date"),
    ("divorce_before_marriage", "SELECT family AS xref, CAST(marriage_date - divorce_date AS BIGINT) AS detail FROM fam WHERE divorce_date < marriage_date"),
    ("long_marriage", f"SELECT family AS xref, CAST(age AS BIGINT) AS detail FROM (SELECT family, {AGE.format(t='divorce_date', b='marriage_date')} AS age FROM fam WHERE divorce_date >= marriage_date) WHERE age > 80"),
    ("child_before_marriage", "SELECT child AS xref, CAST(floor((marriage_date - birth_date) / 30.0) AS BIGINT) AS detail FROM chil JOIN fam USING (family) JOIN ind ON xref = child WHERE floor((marriage_date - birth_date) / 30.0) > 9"),
    ("child_before_parent", "SELECT child AS xref, CAST(q.birth_date - c.birth_date AS BIGINT) AS detail FROM pe JOIN ind c ON c.xref = child JOIN ind q ON q.xref = parent WHERE c.birth_date < q.birth_date"),
    ("sibling_gap", f"SELECT child AS xref, CAST(age AS BIGINT) AS detail FROM (SELECT child, {AGE.format(t='n.birth_date', b='c.birth_date')} AS age FROM (SELECT *, lead(child) OVER (PARTITION BY family ORDER BY ordinal, child) AS nx FROM chil) JOIN ind c ON c.xref = child JOIN ind n ON n.xref = nx) WHERE age > 50"),
    ("no_partners", "SELECT family AS xref, CAST(NULL AS BIGINT) AS detail FROM fam WHERE husband IS NULL AND wife IS NULL"),
    ("orphan_nodes", "SELECT xref, CAST(NULL AS BIGINT) AS detail FROM ind WHERE xref NOT IN (SELECT husband FROM fam WHERE husband IS NOT NULL UNION SELECT wife FROM fam WHERE wife IS NOT NULL UNION SELECT child FROM chil)"),
    ("missing_parents", "SELECT xref, CAST(NULL AS BIGINT) AS detail FROM ind WHERE xref NOT IN (SELECT child FROM pe)")]:
    add(name, lambda p, *_, n=name: V.RULES[n](p), sql)
add("issues_by_severity", lambda p, *_: V.validate(p, ["missing_birth", "missing_parents"]).groupBy("severity").agg(F.count("*").alias("n")), "SELECT 'info' AS severity, (SELECT count(*) FROM ind WHERE birth_date IS NULL) + (SELECT count(*) FROM ind WHERE xref NOT IN (SELECT child FROM pe)) AS n")
add("completeness", lambda p, *_: V.completeness(p.individuals), "SELECT " + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END), 6) AS {c}" for c in ("name", "birth_date", "death_date", "birth_place", "sex")) + " FROM ind")

# duplicates
CODE = "translate(regexp_replace(substr(s, 2), '[AEIOUYHW]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
for digit in "123456":
    CODE = f"regexp_replace({CODE}, '{digit}+', '{digit}', 'g')"
CODE = f"CASE WHEN s = '' THEN '' ELSE s[1] || rpad(substr({CODE}, 1, 3), 3, '0') END"
LETTERS = "(SELECT *, regexp_replace(upper(coalesce(surname, '')), '[^A-Z]', '', 'g') AS s FROM ind)"
add("soundex_codes", lambda p, *_: p.individuals.select("xref", S.soundex(F.col("surname")).alias("code")), f"SELECT xref, {CODE} AS code FROM {LETTERS}")
LIKE = "CASE WHEN {a} = {b} THEN 1.0 WHEN greatest(strlen({a}), strlen({b})) = 0 THEN 0.0 ELSE least(0.9, 1 - levenshtein({a}, {b}) / CAST(greatest(strlen({a}), strlen({b})) AS DOUBLE)) END"
like = lambda a, b: LIKE.format(a=a, b=b)
GAP = "CASE WHEN {g} = 0 THEN 1.0 WHEN {g} <= 1 THEN 0.9 WHEN {g} <= 2 THEN 0.8 WHEN {g} <= 5 THEN 0.7 WHEN {g} <= 10 THEN 0.5 ELSE 0.0 END"
ISLAND = "'US|UNITED STATES|UK|UNITED KINGDOM|ENGLAND|CANADA|AUSTRALIA|GERMANY|FRANCE|IRELAND'"
FEATURES = f""", x0 AS (SELECT *, lower(coalesce(surname, '')) AS sn, string_split(lower(coalesce(surname, '')), ' ') AS sw, upper(coalesce(given, '')) AS gv, string_split(upper(coalesce(birth_place, '')), ' ') AS tw, string_split(birth_place, ', ') AS pw FROM ind),
 x1 AS (SELECT *, CASE WHEN len(sw) < 2 THEN sn ELSE coalesce(list_filter(sw, lambda w: NOT list_contains({U.PARTICLES}, w))[-1], sn) END AS la FROM x0),
 x2 AS (SELECT *, regexp_replace(upper(la), '[^A-Z]', '', 'g') AS s FROM x1),
 x AS (SELECT *, {CODE} AS sx, CASE WHEN la = '' THEN '' ELSE upper(rpad(substr(la, 1, 4), 4, ' ')) END AS head, substr(gv, 1, 1) AS initial, substr(gv, 1, 2) AS two, birth_year AS year, coalesce(list_filter(tw, lambda w: strlen(w) > 2 AND NOT list_contains({U.COMMON}, w))[1], '') AS token,
  lower(trim(regexp_replace(replace(coalesce(name, ''), '/', ''), ' +', ' ', 'g'))) AS nn, lower(coalesce(given, '')) AS ng, coalesce(birth_text, '') AS txt, lower(coalesce(birth_place, '')) AS np,
  CASE bt WHEN 3 THEN birth_year - 2 WHEN 4 THEN birth_year - 4 WHEN 9 THEN NULL ELSE birth_year END AS y1, CASE bt WHEN 3 THEN birth_year + 2 WHEN 5 THEN birth_year + 4 WHEN 6 THEN birth_year + 3 WHEN 7 THEN birth_year + 2 WHEN 9 THEN NULL ELSE birth_year END AS y2,
  pw[1] AS city, CASE WHEN len(pw) = 3 THEN pw[2] WHEN NOT regexp_matches(upper(pw[2]), {ISLAND}) THEN pw[2] END AS state, CASE WHEN len(pw) = 3 THEN pw[3] WHEN regexp_matches(upper(pw[2]), {ISLAND}) THEN pw[2] END AS country FROM x2) """
KEYS = FEATURES.rstrip() + """, k AS (SELECT xref, 'P|' || sx || '|' || year AS key FROM x WHERE sx <> '' AND year > 0 UNION ALL SELECT xref, 'B|' || sx || '|' || (year // 5) FROM x WHERE sx <> '' AND year > 0
 UNION ALL SELECT xref, 'I|' || sx || '|' || initial FROM x WHERE sx <> '' AND initial <> '' UNION ALL SELECT xref, 'G|' || sx || '|' || two FROM x WHERE sx <> '' AND length(two) > 1 UNION ALL SELECT xref, 'X|' || head || '|' || token FROM x WHERE head <> '' AND token <> ''
 UNION ALL SELECT xref, 'Y|' || sx || '|' || (year + i) FROM x, range(-1, 2) AS r(i) WHERE sx <> '' AND year > 0) """
PAIRS = KEYS.rstrip() + """, q AS (SELECT u.xref AS a, v.xref AS b FROM x u JOIN x v ON u.sx = v.sx AND u.xref < v.xref WHERE u.sx <> '' AND (abs(u.year - v.year) <= 3 OR u.year // 5 = v.year // 5 OR u.initial <> '' AND u.initial = v.initial)
 UNION SELECT u.xref, v.xref FROM x u JOIN x v ON u.head = v.head AND u.token = v.token AND u.xref < v.xref WHERE u.head <> '' AND u.token <> '') """
OVER = "greatest(least(u.y2, v.y2) - greatest(u.y1, v.y1) + 1, 0)"
SCORES = f""" z1 AS (SELECT q.a, q.b, CASE WHEN u.ng <> '' AND v.ng <> '' THEN {like('u.ng', 'v.ng')} ELSE 0.0 END AS gs, CASE WHEN u.sn <> '' AND v.sn <> '' THEN {like('u.sn', 'v.sn')} ELSE 0.0 END AS ss, {like('u.nn', 'v.nn')} AS fs, u.nn AS n1, v.nn AS n2,
  {OVER} AS ov, {OVER} / ((u.y2 - u.y1 + 1 + v.y2 - v.y1 + 1) / 2.0) AS share, u.y1 = u.y2 AND v.y1 = v.y2 AS single, abs(u.y1 - v.y1) AS g1, u.y1 IS NOT NULL AND v.y1 IS NOT NULL AS parsed, u.txt AS t1, v.txt AS t2, abs(u.year - v.year) AS g2, u.np AS p1, v.np AS p2, u.sex AS s1, v.sex AS s2,
  CASE WHEN u.city IS NOT NULL AND v.city IS NOT NULL THEN CASE WHEN lower(u.city) = lower(v.city) THEN 1.0 ELSE 0.7 * ({like('u.city', 'v.city')}) END END AS c1,
  CASE WHEN u.state IS NOT NULL AND v.state IS NOT NULL THEN CASE WHEN lower(u.state) = lower(v.state) THEN 1.0 WHEN strlen(u.state) = 2 AND strlen(v.state) > 2 AND starts_with(lower(v.state), lower(u.state)) OR strlen(v.state) = 2 AND strlen(u.state) > 2 AND starts_with(lower(u.state), lower(v.state)) THEN 0.9 ELSE 0.7 * ({like('u.state', 'v.state')}) END END AS c2,
  CASE WHEN u.country IS NOT NULL AND v.country IS NOT NULL THEN CASE WHEN lower(u.country) = lower(v.country) THEN 1.0 ELSE 0.7 * ({like('u.country', 'v.country')}) END END AS c3 FROM q JOIN {{one}} u ON u.xref = q.a JOIN {{two}} v ON v.xref = q.b),
 z2 AS (SELECT a, b, CASE WHEN n1 = '' OR n2 = '' THEN 0.0 WHEN n1 = n2 THEN 1.0 WHEN gs >= 0.8 AND ss >= 0.8 THEN (gs + ss) / 2 WHEN fs > (gs + ss) / 2 THEN fs WHEN gs > 0 AND ss > 0 THEN (gs + ss) / 2 WHEN gs > 0 THEN gs * 0.7 WHEN ss > 0 THEN ss * 0.7 WHEN contains(n1, n2) OR contains(n2, n1) THEN 0.6 ELSE 0.0 END AS name_score,
  CASE WHEN t1 = '' OR t2 = '' THEN 0.0 WHEN parsed THEN CASE WHEN ov <= 0 THEN CASE WHEN single THEN {GAP.format(g='g1')} ELSE 0.0 END WHEN share >= 1 THEN 1.0 WHEN share >= 0.8 THEN 0.9 WHEN share >= 0.6 THEN 0.8 WHEN share >= 0.4 THEN 0.7 WHEN share >= 0.2 THEN 0.5 ELSE 0.3 END WHEN lower(t1) = lower(t2) THEN 1.0 ELSE {GAP.format(g='g2')} END AS date_score,
  CASE WHEN p1 = '' OR p2 = '' THEN 0.0 WHEN p1 = p2 THEN 1.0 WHEN c1 IS NULL AND c2 IS NULL AND c3 IS NULL THEN 0.0 ELSE (coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0)) / (CAST(c1 IS NOT NULL AS INT) + CAST(c2 IS NOT NULL AS INT) + CAST(c3 IS NOT NULL AS INT)) END AS place_score, CASE WHEN s1 = 'U' OR s2 = 'U' THEN 0.5 WHEN s1 = s2 THEN 1.0 ELSE 0.0 END AS sex_score FROM z1) """
RELATED = """, lk AS (SELECT 'p' AS t, child AS x, parent AS y FROM pe UNION SELECT 's', a, b FROM se UNION SELECT 'c', parent, child FROM pe), rl AS (SELECT u.x AS a, v.x AS b, u.t FROM lk u JOIN lk v ON v.t = u.t AND v.y = u.y AND u.x <> v.x),
 rs AS (SELECT a, b, round(CAST(least(count(*) FILTER (t = 'p') * 0.1, 0.2) + CASE WHEN count(*) FILTER (t = 's') > 0 THEN 0.2 ELSE 0 END + least(count(*) FILTER (t = 'c') * 0.1, 0.3) AS DOUBLE) / 0.7, 6) AS relation_score FROM rl GROUP BY 1, 2)"""
TOTAL = """SELECT a, b, round(name_score, 6) AS name_score, date_score, round(place_score, 6) AS place_score, sex_score, relation_score, score, CASE WHEN score >= 0.95 THEN 'exact' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT z2.a, z2.b, CAST(name_score AS DOUBLE) AS name_score, CAST(date_score AS DOUBLE) AS date_score, CAST(place_score AS DOUBLE) AS place_score, CAST(sex_score AS DOUBLE) AS sex_score, coalesce(relation_score, 0.0) AS relation_score,
 round(CAST(name_score AS DOUBLE) * 0.4 + CAST(date_score AS DOUBLE) * 0.3 + CAST(place_score AS DOUBLE) * 0.15 + CAST(sex_score AS DOUBLE) * 0.05 + coalesce(relation_score, 0.0) * 0.1, 6) AS score FROM z2 LEFT JOIN rs ON rs.a = z2.a AND rs.b = z2.b) WHERE score >= {least}"""
SHOWN = ["a", "b", "name_score", "date_score", "place_score", "sex_score", "relation_score", "score", "confidence"]
add("block_sizes", lambda p, *_: U.block_sizes(p.individuals), KEYS + "SELECT key, count(*) AS n FROM k GROUP BY 1")
add("candidate_pairs", lambda p, *_: U.candidate_pairs(p.individuals), PAIRS + "SELECT a, b FROM q")
add("duplicates_scored", lambda p, *_: U.find_duplicates(p).select(*SHOWN), PAIRS.rstrip() + "," + SCORES.format(one="x", two="x").rstrip() + RELATED + " " + TOTAL.format(least=0.6))
add("relation_scores", lambda p, *_: U.relation_scores(U._shares_relative(p), p), RELATED.rstrip() + " SELECT * FROM rs WHERE a < b")
add("find_matches", lambda p, *_: U.find_matches(p, 49).select(*SHOWN), FEATURES.rstrip() + ", q AS (SELECT CAST(49 AS BIGINT) AS a, xref AS b FROM ind WHERE xref <> 49)," + SCORES.format(one="x", two="x").rstrip() + RELATED + " " + TOTAL.format(least=0.6))


def _other_file(people):
    """Every third person as another file has them: other keys, some first names in capitals, some surnames missing, some births a year later."""
    x = F.col("xref")
    return people.filter(x % 3 == 1).withColumns({"name": F.when(x % 2 == 0, F.upper("name")).otherwise(F.col("name")), "surname": F.when(x % 5 != 0, F.col("surname")), "birth_text": F.when(x % 7 == 0, F.concat(F.lit("AFT "), (F.year("birth_date") + 1).cast("string"))).otherwise(F.col("birth_text"))}).withColumn("xref", x + 1000000)


OTHER_FILE = FEATURES.rstrip() + """, o AS (SELECT * REPLACE (xref + 1000000 AS xref, CASE WHEN xref % 5 = 0 THEN '' ELSE sn END AS sn, CASE WHEN xref % 7 = 0 AND birth_year IS NOT NULL THEN 'AFT ' || (birth_year + 1) WHEN xref % 7 = 0 THEN '' ELSE txt END AS txt,
  CASE WHEN xref % 7 = 0 THEN birth_year + 1 ELSE year END AS year, CASE WHEN xref % 7 = 0 THEN birth_year + 1 ELSE y1 END AS y1, CASE WHEN xref % 7 = 0 THEN birth_year + 5 ELSE y2 END AS y2) FROM x WHERE xref % 3 = 1),
 q AS (SELECT u.xref AS a, v.xref AS b FROM x u JOIN o v ON split_part(u.nn, ' ', 1) = split_part(v.nn, ' ', 1) WHERE u.nn <> '' AND v.nn <> '' AND (u.sn = v.sn OR u.sn = '' OR v.sn = '') AND coalesce(abs(u.year - v.year) <= 12, true)),"""
NO_RELATION = ", rs AS (SELECT CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, 0.0 AS relation_score WHERE false)"
add("duplicates_between", lambda p, *_: U.find_between(p.individuals, _other_file(p.individuals)).select(*SHOWN), OTHER_FILE + SCORES.format(one="x", two="o").rstrip() + NO_RELATION + " " + TOTAL.format(least=0.6))
add("diff_by_content", lambda p, *_: C.by_content(p.individuals, _other_file(p.individuals)), OTHER_FILE + SCORES.format(one="x", two="o").rstrip() + NO_RELATION + " SELECT a, b, score FROM (" + TOTAL.format(least=0.85) + ")")
CANDIDATES = PAIRS.rstrip() + """, pr AS (SELECT q.a, q.b, coalesce(abs(u.year - v.year), 0) AS gap, coalesce(u.token <> '' AND u.token = v.token, false) AS place, CASE WHEN u.sx = v.sx AND u.sx <> '' AND abs(u.year - v.year) <= 3 THEN CASE abs(u.year - v.year) WHEN 0 THEN 15 WHEN 1 THEN 13 ELSE 11 END + CASE WHEN u.head = v.head THEN 3 ELSE 0 END + CASE WHEN u.token <> '' AND u.token = v.token THEN 2 ELSE 0 END + CASE WHEN u.two <> '' AND u.two = v.two THEN 2 ELSE 0 END
  WHEN u.sx = v.sx AND u.sx <> '' AND u.year // 5 = v.year // 5 THEN 5 WHEN u.sx = v.sx AND u.sx <> '' AND u.initial <> '' AND u.initial = v.initial THEN 3 ELSE 1 END AS priority FROM q JOIN x u ON u.xref = q.a JOIN x v ON v.xref = q.b) """
add("candidates_limited", lambda p, *_: U.limited_candidates(p.individuals, U.Config(most=5)), CANDIDATES + "SELECT a, b, priority FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY priority DESC, gap, place DESC, b) AS r FROM pr) WHERE r <= 5")
KINDS = ", ".join(f"count(*) FILTER (key[1] = '{k}') AS blocks_{k.lower()}" for k in "PYBIGX")
METRICS = KEYS.rstrip() + f", bs AS (SELECT key, count(*) AS n FROM k GROUP BY 1), bm AS (SELECT (SELECT count(*) FROM x) AS people, (SELECT count(*) FROM x WHERE sx <> '' AND year > 0) AS with_primary, (SELECT count(*) FROM x WHERE sx <> '' AND year > 0 OR sx <> '' AND initial <> '' OR head <> '' AND token <> '') AS with_any, count(*) AS blocks, {KINDS}, max(n) AS largest, count(*) FILTER (n > 5000) AS giant, CAST(coalesce(sum(n) FILTER (n > 5000), 0) AS BIGINT) AS in_giant FROM bs) "
add("blocking_metrics", lambda p, *_: U.blocking_metrics(p.individuals), METRICS + "SELECT *, people - with_any AS with_none FROM bm")
CMET = PAIRS.rstrip() + ", per AS (SELECT xref, coalesce(n, 0) AS n FROM ind LEFT JOIN (SELECT a AS xref, count(*) AS n FROM q GROUP BY 1) USING (xref)) "
add("candidate_metrics", lambda p, *_: U.candidate_metrics(U.candidate_counts(p.individuals), p.individuals), CMET + "SELECT CAST(sum(n) AS BIGINT) AS candidates, round(avg(n), 6) AS mean, max(n) AS most, count(*) FILTER (n = 0) AS with_none, count(*) FILTER (n = 1) AS with_one, count(*) FILTER (n > 10) AS with_many FROM per")
add("blocking_warnings", lambda p, *_: U.blocking_warnings(U.blocking_metrics(p.individuals, 10), U.candidate_metrics(U.candidate_counts(p.individuals), p.individuals)), KEYS + "SELECT 'giant_blocks' AS warning WHERE (SELECT max(n) FROM (SELECT count(*) AS n FROM k GROUP BY key)) > 10")
add("levenshtein_names", lambda p, *_: p.individuals.select("xref", F.levenshtein("given", "surname").cast("long").alias("d")), "SELECT xref, levenshtein(given, surname) AS d FROM ind")

# differences: the second snapshot lacks every eleventh person, has new ones and other values
NEW = "SELECT xref + CASE WHEN xref % 13 = 0 THEN 1000000 ELSE 0 END AS xref, CASE WHEN xref % 7 = 0 THEN name || '*' ELSE name END AS name, sex, CASE WHEN xref % 5 = 0 THEN NULL ELSE birth_place END AS birth_place FROM ind WHERE xref % 11 <> 0"


def _snapshots(p):
    old = p.individuals.select("xref", "name", "sex", "birth_place")
    x = F.col("xref")
    new = old.filter(x % 11 != 0).select((x + F.when(x % 13 == 0, 1000000).otherwise(0)).alias("xref"), F.when(x % 7 == 0, F.concat("name", F.lit("*"))).otherwise(F.col("name")).alias("name"), "sex", F.when(x % 5 != 0, F.col("birth_place")).alias("birth_place"))
    return old, new


def _diff(p):
    return C.diff(*_snapshots(p))


SNAP = f", n AS ({NEW}) "
add("diff_added", lambda p, *_: _diff(p).filter("change = 'added'").select("xref"), SNAP + "SELECT xref FROM n WHERE xref NOT IN (SELECT xref FROM ind)")
add("diff_removed", lambda p, *_: _diff(p).filter("change = 'removed'").select("xref"), SNAP + "SELECT xref FROM ind WHERE xref NOT IN (SELECT xref FROM n)")
FIELDS = " UNION ALL ".join(f"SELECT xref, '{c}' AS field, ind.{c} AS old, n.{c} AS new FROM ind JOIN n USING (xref) WHERE ind.{c} IS DISTINCT FROM n.{c}" for c in ("name", "sex", "birth_place"))
add("diff_fields", lambda p, *_: _diff(p).filter("change = 'modified'").select("xref", "field", "old", "new"), SNAP + FIELDS)
add("diff_summary", lambda p, *_: _diff(p).groupBy("change").agg(F.countDistinct("xref").alias("n")), SNAP + f"SELECT 'added' AS change, count(*) AS n FROM n WHERE xref NOT IN (SELECT xref FROM ind) UNION ALL SELECT 'removed', count(*) FROM ind WHERE xref NOT IN (SELECT xref FROM n) UNION ALL SELECT 'modified', count(DISTINCT xref) FROM ({FIELDS})")

HYBRID = SNAP.rstrip() + """, a AS (SELECT lower(name) AS nm, sex, min(xref) AS x FROM n WHERE xref NOT IN (SELECT xref FROM ind) GROUP BY 1, 2 HAVING count(*) = 1), r AS (SELECT lower(name) AS nm, sex, min(xref) AS x FROM ind WHERE xref NOT IN (SELECT xref FROM n) GROUP BY 1, 2 HAVING count(*) = 1) """
add("diff_matches", lambda p, *_: C.match_content(*_snapshots(p), ["name", "sex"]), HYBRID + "SELECT r.x AS old_key, a.x AS new_key, 'content' AS how FROM a JOIN r USING (nm, sex) UNION ALL SELECT xref, xref, 'key' FROM ind JOIN n USING (xref)")
add("diff_hybrid", lambda p, *_: C.diff_hybrid(*_snapshots(p), ["name", "sex"]).groupBy("change").agg(F.countDistinct("xref").alias("n")), HYBRID.rstrip() + """, m AS (SELECT r.x AS o, a.x AS n FROM a JOIN r USING (nm, sex)),
 y AS (SELECT coalesce(m.o, n.xref) AS xref, name, sex, birth_place FROM n LEFT JOIN m ON m.n = n.xref)
 SELECT * FROM (SELECT 'added' AS change, count(*) AS n FROM y WHERE xref NOT IN (SELECT xref FROM ind) UNION ALL SELECT 'removed', count(*) FROM ind WHERE xref NOT IN (SELECT xref FROM y)
 UNION ALL SELECT 'modified', count(*) FROM ind JOIN y USING (xref) WHERE ind.name IS DISTINCT FROM y.name OR ind.sex IS DISTINCT FROM y.sex OR ind.birth_place IS DISTINCT FROM y.birth_place) WHERE n > 0""")

# scalars
DATES = "CASE xref % 4 WHEN 0 THEN 'ABT ' || year(birth_date) WHEN 1 THEN day(birth_date) || ' mar ' || year(birth_date) WHEN 2 THEN 'BET ' || year(birth_date) || ' AND ' || (year(birth_date) + 2) ELSE 'no date' END"
add("date_parse", lambda p, *_: p.individuals.filter("birth_date is not null").select("xref", S.parse_date(F.expr(DATES)).alias("p")).select("xref", "p.type", F.col("p.y").cast("long").alias("y"), F.col("p.m").cast("long").alias("m"), S.earliest(F.col("p")).alias("earliest"), S.latest(F.col("p")).alias("latest")),
    "SELECT xref, CASE xref % 4 WHEN 0 THEN 'about' WHEN 1 THEN 'exact' WHEN 2 THEN 'between' ELSE 'invalid' END AS type, CASE WHEN xref % 4 < 3 THEN year(birth_date) END AS y, CAST(CASE WHEN xref % 4 = 1 THEN 3 END AS BIGINT) AS m, "
    "CASE WHEN xref % 4 = 1 THEN make_date(year(birth_date), 3, day(birth_date)) WHEN xref % 4 < 3 THEN make_date(year(birth_date), 1, 1) END AS earliest, "
    "CASE xref % 4 WHEN 0 THEN make_date(year(birth_date), 12, 31) WHEN 1 THEN make_date(year(birth_date), 3, day(birth_date)) WHEN 2 THEN make_date(year(birth_date) + 2, 12, 31) END AS latest FROM ind WHERE birth_date IS NOT NULL")
add("place_parse", lambda p, *_: p.individuals.select("xref", S.parse_place(F.concat(F.lit("Town, "), "birth_place")).alias("p")).select("xref", "p.city", "p.state", "p.country"), "SELECT xref, CASE WHEN w IS NOT NULL THEN 'Town' END AS city, CASE len(w) WHEN 2 THEN w[1] WHEN 3 THEN w[2] END AS state, CASE len(w) WHEN 2 THEN w[2] WHEN 3 THEN w[3] END AS country FROM (SELECT xref, string_split(birth_place, ', ') AS w FROM ind)")
add("name_parse", lambda p, *_: p.individuals.select("xref", S.parse_name(F.concat("given", F.lit(" /"), "surname", F.lit("/"))).alias("n")).select("xref", "n.given", "n.surname"), "SELECT xref, CASE WHEN surname IS NULL THEN '' ELSE coalesce(given, '') END AS given, CASE WHEN given IS NULL THEN '' ELSE coalesce(surname, '') END AS surname FROM ind")

KIND = "CASE bt WHEN 3 THEN 'about' WHEN 4 THEN 'before' WHEN 5 THEN 'after' WHEN 6 THEN 'between' WHEN 7 THEN 'from_to' WHEN 9 THEN 'invalid' ELSE 'exact' END"
born = lambda p: settled(p.individuals.filter("birth_text is not null"), {"_p": S.parse_date(F.col("birth_text"))})
add("date_kinds", lambda p, *_: born(p).select("xref", "_p.type", D.constraint(F.col("_p")).alias("word"), D.is_range(F.col("_p")).alias("range"), D.is_exact(F.col("_p")).alias("one_day"), F.col("_p.y").cast("long").alias("y"), F.col("_p.y2").cast("long").alias("y2")),
    f"SELECT xref, {KIND} AS type, CASE WHEN bt IN (3, 4, 5) THEN {KIND} ELSE 'exact' END AS word, bt IN (6, 7) AS range, bt IN (0, 8) AS one_day, CASE WHEN bt <> 9 THEN birth_year END AS y, CASE bt WHEN 6 THEN birth_year + 3 WHEN 7 THEN birth_year + 2 END AS y2 FROM ind WHERE birth_text IS NOT NULL")
add("date_strings", lambda p, *_: born(p).select("xref", D.to_string(F.col("_p"), F.col("birth_text")).alias("text")), "SELECT xref, CASE bt WHEN 3 THEN 'ABOUT ' || birth_year WHEN 4 THEN 'BEFORE ' || birth_year WHEN 5 THEN 'AFTER ' || birth_year WHEN 7 THEN upper(birth_text) ELSE birth_text END AS text FROM ind WHERE birth_text IS NOT NULL")
add("date_compared", lambda p, *_: settled(born(p), {"_q": S.parse_date(F.lit("1664"))}).select("xref", D.compare(F.col("_p"), F.col("_q")).alias("sign"), D.is_before(F.col("_p"), F.col("_q")).alias("before"), D.is_after(F.col("_p"), F.col("_q")).alias("after")).filter("not (before and after)").select("xref", "sign"),
    "SELECT xref, CASE WHEN bt = 9 THEN 0 WHEN e < DATE '1664-01-01' THEN -1 WHEN e > DATE '1664-01-01' THEN 1 ELSE 0 END AS sign FROM (SELECT xref, bt, CASE WHEN bt = 4 THEN DATE '0001-01-01' WHEN bt IN (0, 8) THEN birth_date WHEN bt = 1 THEN make_date(birth_year, month(birth_date), 1) ELSE make_date(birth_year, 1, 1) END AS e FROM ind WHERE birth_text IS NOT NULL)")
add("place_components", lambda p, *_: p.individuals.select("xref", S.place_component(F.col("birth_place"), 0).alias("first"), S.place_component(F.col("birth_place"), 2).alias("third"), S.place_format(F.col("birth_place"), " / ").alias("text")), "SELECT xref, coalesce(w[1], '') AS first, coalesce(w[3], '') AS third, array_to_string(w, ' / ') AS text FROM (SELECT xref, string_split(birth_place, ', ') AS w FROM ind)")
add("quality_report", lambda p, *_: V.quality_report(p, QUALITY).drop("name_pct", "birth_date_pct", "birth_place_pct"),
    ", qi AS (SELECT (SELECT count(*) FROM ind) AS people, (SELECT count(*) FROM fam) AS families, (SELECT count(*) FROM ind WHERE birth_date IS NULL) AS mb, (SELECT count(*) FROM ind WHERE death_date < birth_date) AS db, (SELECT count(*) FROM fam WHERE husband IS NULL AND wife IS NULL) AS np, (SELECT count(DISTINCT x) FROM (SELECT unnest([husband, wife]) AS x FROM fam UNION ALL SELECT child FROM chil) WHERE x IS NOT NULL AND x NOT IN (SELECT xref FROM ind)) AS dr,"
    " (SELECT 100 * (avg(CAST(name IS NOT NULL AS INT)) + avg(CAST(birth_date IS NOT NULL AS INT)) + avg(CAST(birth_place IS NOT NULL AS INT)) + avg(CAST(death_date IS NOT NULL AS INT))) FROM ind) AS pp, (SELECT 100 * avg(CAST(marriage_date IS NOT NULL AS INT)) FROM fam) AS fp), qr AS (SELECT people, families, db + dr AS severe, np AS warning, mb AS info, mb + db AS date_issues, np AS relation_issues, dr AS reference_issues, round((pp + fp) / 5, 6) AS completeness, round(greatest(0.0, 100 - (mb + db + np + dr) / people * 100), 6) AS consistency, round(greatest(0.0, 100 - (db + dr + np) / people * 100), 6) AS accuracy FROM qi) SELECT *, round(completeness * 0.4 + consistency * 0.3 + accuracy * 0.3, 6) AS overall FROM qr")
add("recommendations", lambda p, *_: V.recommendations(V.quality_report(p, QUALITY)).filter("advice like 'Fix%' or advice like 'Address%'"), "SELECT unnest(['Fix ' || (mb + db) || ' date consistency issues', 'Fix ' || np || ' relationship issues', 'Fix ' || dr || ' cross-reference issues', 'Address ' || (db + dr) || ' severe errors']) AS advice FROM (SELECT (SELECT count(*) FROM ind WHERE birth_date IS NULL) AS mb, (SELECT count(*) FROM ind WHERE death_date < birth_date) AS db, (SELECT count(*) FROM fam WHERE husband IS NULL AND wife IS NULL) AS np, (SELECT count(DISTINCT x) FROM (SELECT unnest([husband, wife]) AS x FROM fam UNION ALL SELECT child FROM chil) WHERE x IS NOT NULL AND x NOT IN (SELECT xref FROM ind)) AS dr)")
add("issues_severe", lambda p, *_: V.validate(p, QUALITY, "severe").groupBy("rule").agg(F.count("*").alias("n")), "SELECT 'death_before_birth' AS rule, (SELECT count(*) FROM ind WHERE death_date < birth_date) AS n UNION ALL SELECT 'dangling_refs', (SELECT count(DISTINCT x) FROM (SELECT unnest([husband, wife]) AS x FROM fam UNION ALL SELECT child FROM chil) WHERE x IS NOT NULL AND x NOT IN (SELECT xref FROM ind))")
add("graph_issues", lambda p, *_: V.graph_issues(p), ", nd AS (SELECT 'I' || xref AS node FROM ind UNION ALL SELECT 'F' || family FROM fam) SELECT 'src_missing' AS check, src, dst FROM edge WHERE src NOT IN (SELECT node FROM nd) UNION ALL SELECT 'dst_missing', src, dst FROM edge WHERE dst NOT IN (SELECT node FROM nd)")
LINKED = MEM.rstrip() + ", ml AS (SELECT DISTINCT xref, family, CASE role WHEN 'child' THEN 'FAMC' ELSE 'FAMS' END AS tag FROM mem), ol AS (SELECT * FROM ml WHERE xref % 40 <> 1 UNION SELECT xref, 5, 'FAMS' FROM ml WHERE xref % 40 = 2) "


def _own_links(p):
    m = G.members(p).select("xref", "family", F.when(F.col("role") == "child", "FAMC").otherwise("FAMS").alias("tag")).distinct()
    return m.filter("xref % 40 != 1").union(m.filter("xref % 40 = 2").select("xref", F.lit(5).cast("long"), F.lit("FAMS"))).distinct()


add("one_way_links", lambda p, *_: V.one_way_links(_own_links(p), p), LINKED + "SELECT *, 'not_in_family' AS issue FROM (SELECT * FROM ol EXCEPT SELECT * FROM ml) UNION ALL SELECT *, 'not_in_person' FROM (SELECT * FROM ml EXCEPT SELECT * FROM ol)")
# changes of a pedigree
add("people_removed", lambda p, *_: M.remove_people(p, p.individuals.filter("xref % 10 = 0").select("xref")).parent_edge.select("child", "parent"), "SELECT child, parent FROM pe WHERE child % 10 <> 0 AND parent % 10 <> 0")
add("family_removed", lambda p, *_: M.remove_families(p, p.families.filter("family % 10 = 0").select("family")).edges, "SELECT * FROM edge WHERE NOT (src LIKE 'F%0' OR dst LIKE 'F%0')")
add("child_added", lambda p, *_: M.add_child(p, p.individuals.filter("xref in (3, 6)").select(F.lit(0).cast("long").alias("family"), F.col("xref").alias("child"))).children.filter("family = 0"), "SELECT family, child, ordinal FROM chil WHERE family = 0 UNION ALL SELECT 0, 3, max(ordinal) + 1 FROM chil WHERE family = 0")
add("person_replaced", lambda p, *_: M.add_people(p, p.individuals.filter("xref < 5").withColumn("name", F.lit("new"))).individuals.select("xref", "name"), "SELECT xref, CASE WHEN xref < 5 THEN 'new' ELSE name END AS name FROM ind")
add("duplicate_ids", lambda p, *_: M.duplicate_ids(p, p.individuals.filter("xref < 3").select("xref").union(p.individuals.filter("xref < 2").select(F.col("xref") + 5000000))), "SELECT xref FROM ind WHERE xref < 3")


def _later(p):
    """The pedigree with other husbands, dates, places and children here and there."""
    f = p.families.filter("family % 11 != 3").withColumns({"husband": F.expr("case when family % 5 = 1 then husband + 3 else husband end"), "marriage_date": F.expr("case when family % 4 = 1 then date_add(marriage_date, 365) when family % 4 = 2 then date_add(marriage_date, 3650) else marriage_date end"), "marriage_place": F.expr("case when family % 3 = 1 then upper(marriage_place) when family % 3 = 2 then null else marriage_place end")})
    people = p.individuals.withColumns({"birth_text": F.expr("case when xref % 6 = 1 then cast(year(birth_date) + 2 as string) when xref % 6 = 2 then cast(year(birth_date) + 9 as string) when xref % 6 = 3 then null else birth_text end"), "birth_place": F.expr("case when xref % 7 = 1 then lower(birth_place) else birth_place end"), "sex": F.expr("case when xref % 9 = 1 then 'U' else sex end")})
    return Pedigree(people, f, p.children.filter("child % 8 != 1").union(p.children.filter("child % 8 = 3").selectExpr("family", "child + 7000000", "ordinal")))


LATER = """, f2 AS (SELECT family, CASE WHEN family % 5 = 1 THEN husband + 3 ELSE husband END AS husband, wife, CASE WHEN family % 4 = 1 THEN marriage_date + 365 WHEN family % 4 = 2 THEN marriage_date + 3650 ELSE marriage_date END AS marriage_date, CASE WHEN family % 3 = 1 THEN upper(marriage_place) WHEN family % 3 = 2 THEN NULL ELSE marriage_place END AS marriage_place FROM fam WHERE family % 11 <> 3),
 c2 AS (SELECT family, child FROM chil WHERE child % 8 <> 1 UNION ALL SELECT family, child + 7000000 FROM chil WHERE child % 8 = 3), b2 AS (SELECT o.family, o.husband AS h1, n.husband AS h2, o.marriage_date AS d1, n.marriage_date AS d2, o.marriage_place AS p1, n.marriage_place AS p2 FROM fam o JOIN f2 n USING (family)),
 i2 AS (SELECT xref, sex AS s1, CASE WHEN xref % 9 = 1 THEN 'U' ELSE sex END AS s2, birth_text AS t1, CASE WHEN xref % 6 = 1 THEN CAST(birth_year + 2 AS VARCHAR) WHEN xref % 6 = 2 THEN CAST(birth_year + 9 AS VARCHAR) WHEN xref % 6 = 3 THEN NULL ELSE birth_text END AS t2, bt, birth_year AS y, birth_place AS p1, CASE WHEN xref % 7 = 1 THEN lower(birth_place) ELSE birth_place END AS p2 FROM ind) """
add("family_diff", lambda p, *_: C.family_diff(p, _later(p)), LATER + """SELECT family, 'removed' AS change, 'family' AS field, CAST(NULL AS VARCHAR) AS old, CAST(NULL AS VARCHAR) AS new FROM fam WHERE family % 11 = 3
 UNION ALL SELECT family, 'modified', 'husband', CAST(h1 AS VARCHAR), CAST(h2 AS VARCHAR) FROM b2 WHERE h1 IS DISTINCT FROM h2
 UNION ALL SELECT family, CASE WHEN abs(year(d1) - year(d2)) <= 2 THEN 'equivalent' ELSE 'modified' END, 'marriage_date', CAST(d1 AS VARCHAR), CAST(d2 AS VARCHAR) FROM b2 WHERE d1 IS DISTINCT FROM d2
 UNION ALL SELECT family, CASE WHEN p2 IS NOT NULL THEN 'equivalent' ELSE 'modified' END, 'marriage_place', p1, p2 FROM b2 WHERE p1 IS DISTINCT FROM p2
 UNION ALL SELECT family, 'removed', 'child', CAST(child AS VARCHAR), NULL FROM (SELECT family, child FROM chil EXCEPT SELECT * FROM c2) WHERE family IN (SELECT family FROM b2)
 UNION ALL SELECT family, 'added', 'child', NULL, CAST(child AS VARCHAR) FROM (SELECT * FROM c2 EXCEPT SELECT family, child FROM chil) WHERE family IN (SELECT family FROM b2)""")
add("person_changes", lambda p, *_: C.person_changes(p.individuals, _later(p).individuals), LATER + """SELECT xref, 'sex' AS field, 'modified' AS change, s1 AS old, s2 AS new FROM i2 WHERE s1 <> s2 UNION ALL SELECT xref, 'birth_place', 'equivalent', p1, p2 FROM i2 WHERE p1 <> p2
 UNION ALL SELECT xref, 'birth_text', CASE WHEN bt <> 9 AND t2 IS NOT NULL AND xref % 6 = 1 THEN 'equivalent' ELSE 'modified' END, t1, t2 FROM i2 WHERE coalesce(t1, '') <> coalesce(t2, '')""")

for name, cond, sql in [("birth_months", lambda: f.born_in_months(11, 2), "month(birth_date) >= 11 OR month(birth_date) <= 2"), ("birth_days", lambda: f.born_on_days(3, 9), "day(birth_date) BETWEEN 3 AND 9"), ("birth_days_of_year", lambda: f.born_between_days((12, 20), (1, 10)), "month(birth_date) * 100 + day(birth_date) >= 1220 OR month(birth_date) * 100 + day(birth_date) <= 110")]:
    add(name, lambda p, *_, cond=cond: p.individuals.filter(cond()).select(*COLS), f"SELECT xref, name FROM ind WHERE {sql}")
add("full_text", lambda p, *_: f.search(f.word_index(p.individuals, "name", "birth_place"), "ma* england york"), "SELECT xref FROM ind WHERE regexp_matches(lower(concat_ws(' ', name, birth_place)), '(^|[^a-z])ma') AND regexp_matches(lower(concat_ws(' ', name, birth_place)), '(^|[^a-z])england($|[^a-z])') AND regexp_matches(lower(concat_ws(' ', name, birth_place)), '(^|[^a-z])york($|[^a-z])')")
add("people_rows", lambda p, *_: E.csv_rows(p).select("xref", "father", "mother", "spouses", "children"), "SELECT xref, (SELECT min(parent) FROM pe WHERE child = xref AND role = 'father') AS father, (SELECT min(parent) FROM pe WHERE child = xref AND role = 'mother') AS mother, (SELECT string_agg(CAST(b AS VARCHAR), '; ' ORDER BY b) FROM (SELECT DISTINCT a, b FROM se) WHERE a = xref) AS spouses, (SELECT string_agg(CAST(child AS VARCHAR), '; ' ORDER BY child) FROM (SELECT DISTINCT parent, child FROM pe) WHERE parent = xref) AS children FROM ind")


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
