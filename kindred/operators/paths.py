"""Shortest paths with their nodes, path queries, and the relationship of two people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.store import join_small, materialize

BLOOD, MARITAL = ("FAMC", "CHIL"), ("HUSB", "WIFE", "FAMS")


def path_type(edge_types):
    blood, marital = (F.arrays_overlap(edge_types, F.array(*[F.lit(x) for x in k])) for k in (BLOOD, MARITAL))
    return F.when(blood & marital, "mixed").when(marital, "marital").otherwise("blood")


def shortest_path(p, a, b, max_length: int = 0) -> DataFrame:
    """(nodes, edge_types, length, path_type) of the shortest path from person a to person b over family links; of equals, the least in order of the nodes. One row, or none without a path; a to a has length 0."""
    e = p.edges.select("src", "dst", "edge_type")
    e = p.kept("typed", lambda: e.groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type")))
    goal = f"I{b}"
    now = seen = materialize(p.roots(a).select(F.concat(F.lit("I"), F.col("xref").cast("string")).alias("node"), F.array(F.concat(F.lit("I"), F.col("xref").cast("string"))).alias("nodes"), F.array().cast("array<string>").alias("edge_types")))
    length, found = 0, now.filter(F.col("node") == goal)
    while found.isEmpty() and (not max_length or length < max_length):
        length += 1
        nxt = join_small(now, e, now.node == e.src, "inner").select(F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edge_types", F.array("edge_type")).alias("edge_types"))
        nxt = nxt.groupBy("node").agg(F.min_by(F.struct("nodes", "edge_types"), "nodes").alias("r")).select("node", "r.*").join(seen.select("node"), "node", "left_anti")
        now = materialize(nxt)
        if now.isEmpty():
            break
        seen, found = seen.unionByName(now), now.filter(F.col("node") == goal)
    return found.select("nodes", "edge_types", F.size("edge_types").cast("long").alias("length"), path_type(F.col("edge_types")).alias("path_type"))


def find_paths(p, a, b, max_length: int = 10, blood: bool = True, marital: bool = True, shortest_only: bool = False) -> DataFrame:
    """Paths of the wanted kinds (mixed ones count as both), all simple ones or the shortest."""
    out = shortest_path(p, a, b, max_length) if shortest_only else p.all_paths(a, b, max_length)
    kinds = ["mixed"] * (blood or marital) + ["blood"] * blood + ["marital"] * marital
    return out.filter(F.col("path_type").isin(kinds))


def relationship(p, a, b) -> DataFrame:
    """(label, degree, removal, is_direct, is_ancestral, is_collateral, length, path_type, is_blood, is_marital) of a to b; no row where no path leads from one to the other. Direct kin first (parent, child, sibling, spouse), then ancestors and descendants, then collateral kin by the lowest common ancestor; people with a path but no common ancestor are distant relatives."""
    path = shortest_path(p, a, b).select("length", "path_type")
    has = lambda df: F.lit(not df.isEmpty())
    pe, se, sib = p.kept("pe", lambda: p.parent_edge), p.spouse_edge, p.sibling_edge
    pair = lambda df, x, y: df.filter((F.col(x) == a) & (F.col(y) == b))
    lca = p.lowest_common_ancestor(a, b).first()
    da, db = (lca.depth_a, lca.depth_b) if lca else (None, None)
    direct = F.when(has(pair(pe, "parent", "child")), "parent").when(has(pair(pe, "child", "parent")), "child").when(has(pair(sib, "a", "b")), "sibling").when(has(pair(se, "a", "b")), "spouse")
    degree, removal = (None, None) if lca is None else (min(da, db) - 1, abs(da - db))
    lineal = lca is not None and 0 in (da, db)
    if lca is None:
        far = "distant relative"
    elif lineal:
        far = "ancestor" if db == 0 else "descendant"
    else:
        ways = "once removed" if removal == 1 else f"{removal} times removed"
        far = "sibling" if (degree, removal) == (0, 0) else "cousin" if (degree, removal) == (1, 0) else f"cousin {ways}" if degree == 1 else f"{degree}th cousin" if degree > 1 and removal == 0 else "distant relative"
    number = lambda v: F.lit(v).cast("long")
    label = F.coalesce(direct, F.lit(far))
    return path.select(label.alias("label"), number(da + db if lineal else degree).alias("degree"), number(0 if lineal else removal).alias("removal"), direct.isNotNull().alias("is_direct"), F.lit(lineal).alias("is_ancestral"), F.lit(lca is not None and not lineal).alias("is_collateral"),
                       "length", "path_type", F.col("path_type").isin("blood", "mixed").alias("is_blood"), F.col("path_type").isin("marital", "mixed").alias("is_marital"))


def ancestors_with_paths(p, xref, max_generations: int = 0) -> DataFrame:
    """(xref, depth, path): each ancestor with the least depth and the least line of parents to it."""
    step = p.steps("up")
    now = seen = materialize(p.roots(xref).select("xref", F.array("xref").alias("path")))
    depth = 0
    while not max_generations or depth < max_generations:
        depth += 1
        nxt = join_small(now.withColumnRenamed("xref", "at"), step, "at", "inner").groupBy(F.col("to").alias("xref")).agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        now = materialize(nxt.join(seen.select("xref"), "xref", "left_anti"))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen.filter("size(path) > 1").select("xref", (F.size("path") - 1).cast("long").alias("depth"), "path")


def reachable(p, xref, max_depth: int = 0, max_size: int = 0) -> DataFrame:
    """(xref, depth) of the people in one person's component over parents, children, siblings and spouses, breadth first; at most max_depth links away, the nearest max_size (then the lesser xref). Depth counts links."""
    from kindred.operators.pedigree import searched

    step = p.kept("kin", lambda: p.parent_edge.selectExpr("child as at", "parent as to").union(p.parent_edge.selectExpr("parent", "child")).union(p.sibling_edge.selectExpr("a", "b")).union(p.spouse_edge.selectExpr("a", "b")).distinct())
    out = searched(p.roots(xref).select(F.col("xref").alias("root"), "xref"), step, max_depth, 2).select("xref", "depth")
    return out.orderBy("depth", "xref").limit(max_size) if max_size else out
