"""The pedigree: people, families and the edges derived from families, with relatives, recursion, kinship, paths and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import hops, kin
from kindred.operators.components import connected_components
from kindred.plans.store import materialize


#: Edges that a search broadcasts: their count is taken first, two longs (or short node names) each.
STEPS = 1_000_000
#: Directed links that the hops of everyone are searched over in memory: about 30 bytes each on the driver and in each worker.
LINKS = 8_000_000
#: Depths up to which the labels of kin are looked up.
NEAR = 40


def searched(start: DataFrame, step: DataFrame, limit: int, stride: int) -> DataFrame:
    """start(root, xref) -> (root, xref, depth): least depth of what the steps reach, ``limit`` deep (0: all). A job goes ``stride`` levels on; what was seen is left out after each job, so only pairs at a job's last level are gone on from."""
    seen = frontier = materialize(start.select("root", "xref", F.lit(0).cast("long").alias("depth")))
    depth = 0
    step = F.broadcast(step) if step.limit(STEPS + 1).count() <= STEPS else step
    while not limit or depth < limit:
        now, found = frontier.select("root", "xref"), None
        last = min(depth + stride, limit) if limit else depth + stride
        for d in range(depth + 1, last + 1):
            now = now.join(step, now.xref == step["at"]).select("root", F.col("to").alias("xref"))
            part = now.withColumn("depth", F.lit(d).cast("long"))
            found = part if found is None else found.unionByName(part)
        new = materialize(found.groupBy("root", "xref").agg(F.min("depth").alias("depth")).join(seen, ["root", "xref"], "left_anti"))
        frontier = new.filter(F.col("depth") == last)
        seen, depth = seen.unionByName(new), last
        if frontier.isEmpty():  # all that is nearer is in ``new``
            break
    return seen


def doubled(people: DataFrame, step: DataFrame, limit: int) -> DataFrame:
    """(xref) -> (root, xref, depth) for everyone: what is 2n deep or less is what is n deep or less, and that of those just n deep; so a round doubles the depth. A shortest way of over n steps passes someone just n deep, so no other start is needed."""
    seen = materialize(people.select(F.col("xref").alias("root"), "xref", F.lit(0).cast("long").alias("depth")).unionByName(step.filter("at != to").join(people, F.col("at") == people.xref, "left_semi").select(F.col("at").alias("root"), F.col("to").alias("xref"), F.lit(1).cast("long").alias("depth"))))
    reach = 1
    while not limit or reach < limit:
        edge = seen.filter(F.col("depth") == reach).select("root", F.col("xref").alias("via"))
        if edge.isEmpty():
            break
        on = seen.filter("depth > 0").select(F.col("root").alias("via"), "xref", (F.col("depth") + reach).alias("depth"))
        far = edge.join(on, "via").select("root", "xref", "depth")
        seen = materialize(seen.unionByName(far).groupBy("root", "xref").agg(F.min("depth").alias("depth")))
        reach *= 2
    return seen.filter(F.col("depth") <= limit) if limit else seen


@dataclass
class Pedigree:
    """individuals(xref, name, given, surname, sex, birth_date, death_date, birth_place, birth_text); families(family, husband, wife, marriage_date, marriage_place, divorce_date, divorce_place); children(family, child, ordinal); events(event_id, owner, owner_type, type, custom_type, date, place); notes(owner, note, text): references to shared notes or inline text; shared(note, text)."""

    individuals: DataFrame
    families: DataFrame
    children: DataFrame
    events: DataFrame | None = None
    notes: DataFrame | None = None
    shared: DataFrame | None = None
    _kept: dict = field(default_factory=dict, repr=False)

    def kept(self, name: str, build) -> DataFrame:
        """A table that several operators read, written once for this pedigree."""
        if name not in self._kept:
            self._kept[name] = materialize(build())
        return self._kept[name]

    @property
    def parent_edge(self) -> DataFrame:
        """(child, parent, role, family), from families alone; unknown people are dropped."""
        both = self.children.join(self.families, "family")
        known = self.individuals.select(F.col("xref").alias("parent"))
        out = both.select("child", F.expr("inline(array(struct(husband as parent, 'father' as role), struct(wife as parent, 'mother' as role)))"), "family").filter("parent is not null")
        return out.join(known, "parent", "left_semi").select("child", "parent", "role", "family")

    @property
    def spouse_edge(self) -> DataFrame:
        f = self.families.filter("husband is not null and wife is not null and husband != wife")
        return f.select(F.expr("inline(array(struct(husband as a, wife as b), struct(wife as a, husband as b)))"), "family")

    @property
    def sibling_edge(self) -> DataFrame:
        """Other children of the same family: half-siblings of another family are not siblings here."""
        a, b = self.children.select("family", F.col("child").alias("a")), self.children.select("family", F.col("child").alias("b"))
        return a.join(b, "family").filter("a != b").select("a", "b", "family")

    @property
    def edges(self) -> DataFrame:
        """Both directed rows of every family link: (src, dst, edge_type); nodes are 'I<xref>' and 'F<family>'."""
        f = F.concat(F.lit("F"), F.col("family").cast("string"))
        person = lambda c: F.concat(F.lit("I"), F.col(c).cast("string"))
        rows = [(self.families.filter("husband is not null"), "husband", "HUSB", "FAMS"), (self.families.filter("wife is not null"), "wife", "WIFE", "FAMS"), (self.children, "child", "CHIL", "FAMC")]
        out = None
        for df, c, down, up in rows:
            for part in (df.select(f.alias("src"), person(c).alias("dst"), F.lit(down).alias("edge_type")), df.select(person(c).alias("src"), f.alias("dst"), F.lit(up).alias("edge_type"))):
                out = part if out is None else out.unionByName(part)
        return out

    # direct relatives of everyone: (xref, relative)
    def relatives(self, kind: str) -> DataFrame:
        pe, sib, se = self.parent_edge, self.sibling_edge, self.spouse_edge
        up = pe.select(F.col("child").alias("xref"), F.col("parent").alias("relative"))
        down = pe.select(F.col("parent").alias("xref"), F.col("child").alias("relative"))
        side = sib.select(F.col("a").alias("xref"), F.col("b").alias("relative"))

        def then(x: DataFrame, y: DataFrame) -> DataFrame:
            return x.select("xref", F.col("relative").alias("via")).join(y.select(F.col("xref").alias("via"), "relative"), "via").select("xref", "relative")

        found = {
            "parents": lambda: up.distinct(), "children": lambda: down.distinct(), "siblings": lambda: side.distinct(),
            "spouses": lambda: se.select(F.col("a").alias("xref"), F.col("b").alias("relative")).distinct(),
            "grandparents": lambda: then(up, up), "grandchildren": lambda: then(down, down), "uncles": lambda: then(up, side), "nephews": lambda: then(side, down)}
        return found[kind]()

    def steps(self, kind: str) -> DataFrame:
        """Distinct (at, to): up to parents, down to children, or over any family link."""
        pair = {"up": ("child", "parent"), "down": ("parent", "child"), "link": ("src", "dst")}[kind]
        return self.kept(kind, lambda: (self.edges if kind == "link" else self.parent_edge).select(F.col(pair[0]).alias("at"), F.col(pair[1]).alias("to")).distinct())

    def closure(self, roots: DataFrame | None, up: bool = True, max_generations: int = 0, include_self: bool = False) -> DataFrame:
        """(root, xref, depth): least depth of every ancestor (or descendant) of the roots, or of everyone where roots is None. Visited pairs are left out, so cycles end and shared ancestors stay single."""
        step = self.steps("up" if up else "down")
        if roots is None:
            out = doubled(self.individuals.select("xref"), step, max_generations)
        else:
            out = searched(roots.select(F.col("xref").alias("root"), F.col("xref")).distinct(), step, max_generations, 4)
        return out if include_self else out.filter("depth > 0")

    def roots(self, *xrefs) -> DataFrame:
        return self.individuals.filter(F.col("xref").isin(*xrefs)).select("xref")

    def common_ancestors(self, a, b) -> DataFrame:
        """Ancestors-or-self of both: (xref, depth_a, depth_b)."""
        c = self.closure(self.roots(a, b), include_self=True)
        return c.filter(F.col("root") == a).select("xref", F.col("depth").alias("depth_a")).join(c.filter(F.col("root") == b).select("xref", F.col("depth").alias("depth_b")), "xref")

    def lowest_common_ancestor(self, a, b) -> DataFrame:
        order = F.struct(F.greatest("depth_a", "depth_b"), F.col("depth_a") + F.col("depth_b"), F.col("xref"))
        return self.common_ancestors(a, b).agg(F.min_by(F.struct("xref", "depth_a", "depth_b"), order).alias("x")).filter("x is not null").select("x.*")

    def multi_common_ancestors(self, *xrefs) -> DataFrame:
        c = self.closure(self.roots(*xrefs), include_self=len(xrefs) > 1)
        return c.groupBy("xref").agg(F.countDistinct("root").alias("n")).filter(F.col("n") == len(set(xrefs))).select("xref")

    def subtree(self, xref, up: int = 0, down: int = 0, siblings: bool = True, spouses: bool = True) -> DataFrame:
        """(xref, part): the root, its ancestors, descendants, siblings and spouses; each person once, in that order of parts."""
        r = self.roots(xref)
        parts = [(r, "self"), (self.closure(r, True, up), "ancestor"), (self.closure(r, False, down), "descendant")]
        if siblings:
            parts.append((self.sibling_edge.filter(F.col("a") == xref).select(F.col("b").alias("xref")), "sibling"))
        if spouses:
            parts.append((self.spouse_edge.filter(F.col("a") == xref).select(F.col("b").alias("xref")), "spouse"))
        out = None
        for i, (df, name) in enumerate(parts):
            df = df.select("xref", F.struct(F.lit(i).alias("i"), F.lit(name).alias("part")).alias("p"))
            out = df if out is None else out.unionByName(df)
        return out.groupBy("xref").agg(F.min("p").alias("p")).select("xref", "p.part")

    def _kin_by_joins(self, people: DataFrame | None, max_generations: int) -> DataFrame:
        """(a, b, depth_a, depth_b) by joining all pairs below each common ancestor."""
        c = self.closure(people, max_generations=max_generations, include_self=True)
        x, y = c.select(F.col("root").alias("a"), "xref", F.col("depth").alias("da")), c.select(F.col("root").alias("b"), "xref", F.col("depth").alias("db"))
        return x.join(y, "xref").filter("a != b").groupBy("a", "b").agg(F.min(F.struct(F.greatest("da", "db").alias("g"), (F.col("da") + F.col("db")).alias("s"), "xref", "da", "db")).alias("m")).select("a", "b", F.col("m.da").alias("depth_a"), F.col("m.db").alias("depth_b"))

    def kinship(self, people: DataFrame | None, max_generations: int = 0) -> DataFrame:
        """(a, b, depth_a, depth_b, label, degree, removal) of related pairs among ``people``, or everyone, by the lowest common ancestor, at most ``max_generations`` above either (0: any). The nearest ancestor's greater depth decides first, so a limit leaves out farther kin and changes no one's label. Without a limit, everyone's kin are worked out by rows of arrays (``kin``) where those serve. The pairs of all kin grow with the square of the people: limit them on large pedigrees."""
        best = kin.pairs(self.individuals.select("xref"), self.steps("up")) if people is None and not max_generations else None
        best = self._kin_by_joins(people, max_generations) if best is None else best
        deg, rem = F.least("depth_a", "depth_b") - 1, F.abs(F.col("depth_a") - F.col("depth_b"))
        label = (F.when((F.col("depth_a") == 0) & (F.col("depth_b") == 1), "parent").when((F.col("depth_a") == 1) & (F.col("depth_b") == 0), "child")
                 .when(F.col("depth_b") == 0, "ancestor").when(F.col("depth_a") == 0, "descendant").when((deg == 0) & (rem == 0), "sibling")
                 .when((deg == 1) & (rem == 0), "cousin").when((deg == 1) & (rem == 1), "cousin once removed").when(deg == 1, F.concat(F.lit("cousin "), rem.cast("string"), F.lit(" times removed")))
                 .when((deg > 1) & (rem == 0), F.concat(deg.cast("string"), F.lit("th cousin"))).otherwise("distant relative"))
        near = best.sparkSession.range(NEAR * NEAR).select("id", (F.col("id") / NEAR).cast("long").alias("depth_a"), (F.col("id") % NEAR).alias("depth_b")).select("id", label.alias("label"))
        names = F.split(F.lit("|".join(r.label for r in sorted(near.collect()))), "[|]")  # looked up, a label takes half the time
        label = F.when((F.col("depth_a") < NEAR) & (F.col("depth_b") < NEAR), F.element_at(names, (F.col("depth_a") * NEAR + F.col("depth_b") + 1).cast("int"))).otherwise(label)
        lineal = (F.col("depth_a") == 0) | (F.col("depth_b") == 0)
        return best.select("a", "b", "depth_a", "depth_b", label.alias("label"), F.when(lineal, F.col("depth_a") + F.col("depth_b")).otherwise(deg).alias("degree"), F.when(lineal, 0).otherwise(rem).cast("long").alias("removal"))

    def distances(self, sources: DataFrame, max_hops: int = 0) -> DataFrame:
        """(source, node, hops) over family links, by multi-source breadth-first search; source: 'I<xref>'."""
        start = sources.select(F.concat(F.lit("I"), F.col("xref").cast("string")).alias("root")).distinct()
        return searched(start.select("root", F.col("root").alias("xref")), self.steps("link"), max_hops, 2).select(F.col("root").alias("source"), F.col("xref").alias("node"), F.col("depth").alias("hops"))

    def all_paths(self, a, b, max_length: int = 10) -> DataFrame:
        """(nodes, edge_types, length, path_type) of simple paths from person a to person b; length is required, for paths are exponential in it."""
        e = self.edges
        now = self.roots(a).select(F.array(F.concat(F.lit("I"), F.col("xref").cast("string"))).alias("nodes"), F.array().cast("array<string>").alias("edge_types"))
        goal, found = F.lit(f"I{b}"), None
        for _ in range(max_length):
            now = now.join(e, F.element_at("nodes", -1) == e.src).filter(~F.array_contains(F.col("nodes"), F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edge_types", F.array("edge_type")).alias("edge_types"))
            now = materialize(now)
            hit = now.filter(F.element_at("nodes", -1) == goal)
            found = hit if found is None else found.unionByName(hit)
            now = now.filter(F.element_at("nodes", -1) != goal)
        blood, marital = (F.arrays_overlap("edge_types", F.array(*[F.lit(x) for x in k])) for k in (("FAMC", "CHIL"), ("HUSB", "WIFE", "FAMS")))
        kind = F.when(blood & marital, "mixed").when(marital, "marital").otherwise("blood")
        return found.select("nodes", "edge_types", F.size("edge_types").cast("long").alias("length"), kind.alias("path_type"))

    def components(self) -> DataFrame:
        """(xref, component): the smallest xref reachable over parents, siblings and spouses; lone people too."""
        pe, se = self.parent_edge, self.spouse_edge
        known = self.individuals.select("xref")
        kids = self.children.join(known, F.col("child") == known.xref, "left_semi")
        first = kids.groupBy("family").agg(F.min("child").alias("v"))  # one link each joins the siblings, known parents or not
        links = pe.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(se.select(F.col("a").alias("u"), F.col("b").alias("v"))).union(kids.join(first, "family").select(F.col("child").alias("u"), "v"))
        for c in ("u", "v"):
            links = links.join(known, F.col(c) == known.xref, "left_semi")
        c = connected_components(links, one_task=500_000)
        return self.individuals.select("xref").join(c, F.col("xref") == c.node, "left").select("xref", F.coalesce("component", "xref").alias("component"))

    def component_of(self, xref) -> DataFrame:
        c = self.components()
        return c.join(c.filter(F.col("xref") == xref).select("component"), "component", "left_semi").select("xref")

    def degree_centrality(self) -> DataFrame:
        """(node, centrality) of people with links: their degree over n - 1."""
        known = self.individuals.select(F.concat(F.lit("I"), F.col("xref").cast("string")).alias("node"))
        n = self.individuals.agg(F.count("*").alias("n"))
        return self.degrees().join(known, "node", "left_semi").join(F.broadcast(n)).select("node", F.round(F.col("degree") / (F.col("n") - 1), 9).alias("centrality"))  # n is one row

    def cousins(self, degree: int) -> DataFrame:
        """(a, b) whose lowest common ancestor is ``degree`` + 1 generations above both."""
        return self.kinship(None, degree + 1).filter((F.col("depth_a") == degree + 1) & (F.col("depth_b") == degree + 1)).select("a", "b")

    def degrees(self) -> DataFrame:
        """(node, out_degree, in_degree, degree): parallel edges count."""
        e = self.edges
        both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select(F.col("dst").alias("node"), F.lit(0), F.lit(1)))
        return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))

    def closeness(self, sources: DataFrame) -> DataFrame:
        d = self.distances(sources).filter("hops > 0 and node like 'I%'")
        return d.groupBy("source").agg((1 / F.avg("hops")).alias("closeness"))

    def path_sums(self, block: int = 2000, most: int = LINKS) -> DataFrame:
        """(source, farthest, total, reached) of everyone who reaches another person: hops to the other people, without a cap. Up to ``most`` directed links are searched by ``hops`` for many sources at once; more by joins, for about ``block`` sources at a time."""
        if (step := self.steps("link")).count() <= most:
            return self.kept("hops", lambda: hops.path_sums(step, self.individuals.select(F.concat(F.lit("I"), F.col("xref").cast("string")).alias("node"))))
        n = max(1, -(-self.individuals.count() // block))
        out = None
        for k in range(n):
            d = self.distances(self.individuals.filter(F.pmod(F.xxhash64("xref"), F.lit(n)) == k)).filter("hops > 0 and node like 'I%'")
            part = materialize(d.groupBy("source").agg(F.max("hops").alias("farthest"), F.sum("hops").alias("total"), F.count("*").alias("reached")))
            out = part if out is None else out.unionByName(part)
        return out

    def diameter(self) -> DataFrame:
        """The most hops between two connected people; 0 without such a pair."""
        return self.path_sums().agg(F.coalesce(F.max("farthest"), F.lit(0)).cast("long").alias("diameter"))

    def average_path_length(self) -> DataFrame:
        """Mean hops over the connected pairs of people; 0 without such a pair."""
        return self.path_sums().agg(F.coalesce(F.round(F.sum("total") / F.sum("reached"), 6), F.lit(0.0)).alias("mean_hops"))

    def geodesics(self, sources: DataFrame, max_hops: int = 0) -> DataFrame:
        """(source, node, path): one shortest path each, the least in order of node names. Its head is a least path too, so a level keeps one path a pair."""
        e = materialize(self.edges.select("src", "dst").distinct())
        start = sources.select(F.concat(F.lit("I"), F.col("xref").cast("string")).alias("source")).distinct()
        frontier = materialize(start.select("source", F.col("source").alias("node"), F.array("source").alias("path")))
        out, hops = frontier, 0
        while not max_hops or hops < max_hops:
            hops += 1
            nxt = frontier.join(e, frontier.node == e.src).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
            nxt = materialize(nxt.groupBy("source", "node").agg(F.min("path").alias("path")).join(out.select("source", "node"), ["source", "node"], "left_anti"))
            if nxt.isEmpty():
                break
            out, frontier = out.unionByName(nxt), nxt
        return out

    def betweenness(self, sources: DataFrame, max_hops: int = 0) -> DataFrame:
        """(node, paths, betweenness): how many of the sources' shortest paths to other people have the node (families too) inside, one path a pair, and that over n(n-1)/2 pairs of n people. A pair of two sources counts once, from the lesser name."""
        g = materialize(self.geodesics(sources, max_hops).filter("node like 'I%' and node != source"))
        twice = g.select(F.col("node").alias("source"), F.col("source").alias("node")).filter("source < node")
        inner = g.join(twice, ["source", "node"], "left_anti").filter("size(path) > 2").select(F.explode(F.slice("path", 2, F.size("path") - 2)).alias("node"))
        n = self.individuals.agg(F.count("*").alias("n"))
        return inner.groupBy("node").agg(F.count("*").alias("paths")).join(F.broadcast(n)).select("node", "paths", F.round(2 * F.col("paths") / (F.col("n") * (F.col("n") - 1)), 12).alias("betweenness"))

    def longest_path(self, sources: DataFrame, max_length: int = 20) -> DataFrame:
        """(path, length): the longest simple path from a source to another person, of at most ``max_length`` links; of equals, the least in order of node names. Paths are exponential in max_length; empty if there is none."""
        e = materialize(self.edges.select("src", "dst").distinct())
        now = sources.select(F.array(F.concat(F.lit("I"), F.col("xref").cast("string"))).alias("path"))
        best = None
        for _ in range(max_length):
            now = materialize(now.join(e, F.element_at("path", -1) == e.src).filter(~F.array_contains(F.col("path"), F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
            if now.isEmpty():
                break
            least = now.filter(F.element_at("path", -1).like("I%")).agg(F.min("path").alias("path"))
            best = least if best is None else best.unionByName(least)
        if best is None:
            return now.select("path", F.lit(0).cast("long").alias("length")).limit(0)
        return best.filter("path is not null").withColumn("length", (F.size("path") - 1).cast("long")).agg(F.min_by(F.struct("path", "length"), F.struct(-F.col("length"), F.col("path"))).alias("x")).filter("x is not null").select("x.*")

    def cycles(self) -> DataFrame:
        """People on or below a cycle of parents, by peeling off those without remaining parents; empty for a sound pedigree."""
        edges = materialize(self.parent_edge.select("child", "parent").distinct())
        while True:
            left = materialize(edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi"))
            if left.count() == edges.count():
                return left.select(F.col("child").alias("xref")).distinct()
            edges = left
