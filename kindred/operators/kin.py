"""Nearest common ancestors of everyone with everyone, a row of all people at a time.

A pair's common ancestors are those of the parents' pairs, a generation farther from both; where one is an ancestor of the other,
or both are one, that one is added. So the row of siblings, over all people, follows from the rows of their parents: no pair meets
all its common ancestors. A task takes some families of siblings that are near each other, works out the rows of their ancestors
first, oldest first, and gives off the rows of its own. What decides between ancestors is one number, so the least is the nearest:
the greater depth, the sum of both, the ancestor's place in order of xref; the first depth is carried behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a depth, of an ancestor's place and of the sum of depths.
DEPTH, PLACE, SUM = 10, 30, 11
BIT = np.int64(1)
#: No common ancestor: more than any number, also after a shift for each generation.
NONE = BIT << (2 * DEPTH + PLACE + SUM)
#: A generation farther from both.
FARTHER = (BIT << (DEPTH + PLACE + SUM)) + (BIT << (DEPTH + PLACE + 1)) + BIT
#: Bytes of the rows that a task holds, about; pairs of a batch; people; digits of an xref that leave room for both depths.
HELD, PAIRS, PEOPLE, XREF = 96 << 20, 1 << 17, 4_000_000, 1 << 42
#: Rows of people that are given off together.
TILE = 128
#: Pairs of ancestor and descendant up to which they are listed beforehand, 6 bytes each; beyond, a task searches for descendants.
LISTED = 24_000_000


class Lines:
    """Parents of everyone, people by their place in order of xref: siblings (the same parents) have a number, older ones less."""

    def __init__(self, child: np.ndarray, parent: np.ndarray, n: int):
        """child, parent: distinct pairs. sound: without cycles, and depths fit their bits."""
        self.n, order = n, np.lexsort((parent, child))
        child, parent = child[order], parent[order]
        degree = np.bincount(child, minlength=n)
        at = np.arange(len(child)) - np.repeat(np.cumsum(degree) - degree, degree)
        parents = np.full((n, max(1, int(degree.max(initial=0)))), n)
        parents[child, at] = parent
        back = np.argsort(parent, kind="stable")
        self.children, self.first = child[back], np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))])
        level, left, now = np.zeros(n, np.int64), degree.copy(), np.nonzero(degree == 0)[0]
        done, depth, place = 0, 0, np.arange(n + 1)  # place: near where the first parent's is
        levels = []
        while len(now):
            level[now] = depth
            done += len(now)
            levels.append(now)
            below = np.concatenate([self.children[self.first[x] : self.first[x + 1]] for x in now.tolist()] or [now])
            np.subtract.at(left, below, 1)
            now, depth = np.unique(below[left[below] == 0]), depth + 1
        self.sound = done == n and depth < (1 << DEPTH) - 1 and n < 1 << PLACE and parents.shape[1] <= 16
        if not self.sound:
            return
        start = 0
        for x in levels:
            place[x[np.lexsort((x, place[parents[x]].min(axis=1)))]] = start + np.arange(len(x))
            start += len(x)
        alone = np.where(degree == 0, np.arange(n), n)[:, None]  # those without parents are no siblings
        kinds, first, of = np.unique(np.concatenate([parents, alone], axis=1), axis=0, return_index=True, return_inverse=True)
        kinds = kinds[:, :-1]
        age = np.full(len(kinds), n)
        np.minimum.at(age, of.ravel(), place[:n])
        rank = np.argsort(np.lexsort((age, level[first])))  # all siblings are of one level
        self.of = rank[of.ravel()]
        self.parents = np.empty_like(kinds)
        self.parents[rank] = kinds
        self.columns = [(None if k < 2 else np.nonzero(self.parents[:, k] < n)[0], np.ascontiguousarray(self.parents[:, k])) for k in range(kinds.shape[1])]
        self.level = np.empty(len(kinds), np.int64)
        self.level[rank] = level[first]
        self.members = np.split(np.argsort(self.of, kind="stable"), np.cumsum(np.bincount(self.of))[:-1]) if n else []

        self.under = self._under(levels, parents)

    def _under(self, levels: list[np.ndarray], parents: np.ndarray):
        """(first, people, depths): everyone's descendants; None where there are too many."""
        ids, depths, start, size = np.empty(LISTED, np.int32), np.empty(LISTED, np.int16), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        used = 0
        for x in levels:
            rows, found = [np.arange(len(x))], [x << DEPTH]
            for c in range(parents.shape[1] if used else 0):
                has = np.nonzero(parents[x, c] < self.n)[0]
                p = parents[x[has], c]
                at = np.arange(size[p].sum()) + np.repeat(start[p] - np.cumsum(size[p]) + size[p], size[p])
                rows.append(np.repeat(has, size[p]))
                found.append((ids[at].astype(np.int64) << DEPTH) + depths[at] + 1)
            rows, found = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            least = np.append(True, (rows[1:] != rows[:-1]) | (found[1:] >> DEPTH != found[:-1] >> DEPTH))
            rows, found = rows[least], found[least]
            if used + len(found) > LISTED:
                return None
            ids[used : used + len(found)], depths[used : used + len(found)] = found >> DEPTH, found & ((1 << DEPTH) - 1)
            size[x] = np.bincount(rows, minlength=len(x))
            start[x] = used + np.cumsum(size[x]) - size[x]
            used += len(found)
        who = np.concatenate(levels).astype(np.int32) if levels else ids[:0]
        ids, depths, who = ids[:used], depths[:used], np.repeat(who, size[who])
        strict = np.nonzero(depths)[0]
        order = strict[np.argsort(ids[strict], kind="stable")]
        return np.concatenate([[0], np.cumsum(np.bincount(ids[strict], minlength=self.n))]), who[order], depths[order]

    def blocks(self, people: int) -> list[list[int]]:
        """Siblings together with those below them, in order of age: of about so many people or, left over, fewer."""
        weight, top = [len(x) for x in self.members], list(range(len(self.members)))
        out, rest = {}, []
        for k in range(len(self.members) - 1, -1, -1):
            p = int(self.parents[k].min())
            if weight[k] >= people:
                continue
            if p < self.n:
                top[k] = int(self.of[p])
                weight[top[k]] += weight[k]
        for k in range(len(self.members)):
            if top[k] != k:
                top[k] = top[top[k]]
            elif weight[k] < people:  # without parents: several share a block
                if not rest or rest[-1][1] >= people:
                    rest.append([k, 0])
                rest[-1][1] += weight[k]
                top[k] = rest[-1][0]
            out.setdefault(top[k], []).append(k)
        return list(out.values())

    def below(self, x: int) -> list[tuple[np.ndarray, int]]:
        """Descendants of x, least depths first: (people, depth or depths); some may come again deeper."""
        if self.under:
            first, people, depths = self.under
            some = slice(first[x], first[x + 1])
            return [(people[some], depths[some])] if first[x] < first[x + 1] else []
        out, now, depth = [], self.children[self.first[x] : self.first[x + 1]], 1
        while len(now):
            out.append((now, depth))
            n = self.first[now + 1] - self.first[now]
            now = self.children[np.arange(n.sum()) + np.repeat(self.first[now] - np.cumsum(n) + n, n)]
            if len(now) > 1:
                now = np.unique(now)
            depth += 1
        return out

    def rows(self, block: list[int]):
        """(person, numbers over all people) of the block's siblings."""
        own_ones, need, wanted, uses = set(block), set(block), {}, {}
        todo = list(need)
        while todo:
            for p in self.parents[todo.pop()].tolist():
                if p < self.n:
                    k = int(self.of[p])
                    wanted.setdefault(k, set()).add(p)
                    if k not in need:
                        need.add(k)
                        todo.append(k)
        for k in need:
            for p in self.parents[k].tolist():
                uses[p] = uses.get(p, 0) + 1
        kept, above = {}, {}  # of the parents, while they are needed: the row; ancestors and their depths
        key = lambda depth, place, first: np.int64(depth) * ((BIT << (DEPTH + PLACE + SUM)) + (BIT << (DEPTH + PLACE))) + (np.asarray(place, np.int64) << DEPTH) + first
        for k in sorted(need):
            parents = [p for p in self.parents[k].tolist() if p < self.n]
            row, anc = np.full(self.n, NONE), {}
            if parents:
                both = np.full(self.n + 1, NONE)
                for p in parents:
                    np.minimum(both[:-1], kept[p], out=both[:-1])
                    for x, d in above[p].items():
                        anc[x] = min(d + 1, anc.get(x, d + 1))
                    uses[p] -= 1
                    if not uses[p]:
                        del kept[p], above[p]
                both += FARTHER
                least = np.take(both, self.columns[0][1])
                for some, column in self.columns[1:]:
                    if some is None:
                        np.minimum(least, np.take(both, column), out=least)
                    else:
                        least[some] = np.minimum(least[some], both[column[some]])
                np.take(least, self.of, out=row)
            x, d = np.fromiter(anc.keys(), np.int64, len(anc)), np.fromiter(anc.values(), np.int64, len(anc))
            row[x] = np.minimum(row[x], key(d, x, d))
            mine = k in own_ones
            for a in self.members[k].tolist() if mine else sorted(wanted[k]):
                own = row.copy()
                own[a] = key(0, a, 0)
                for b, depth in self.below(a):
                    own[b] = np.minimum(own[b], key(depth, a, 0))
                if a in wanted.get(k, ()):
                    kept[a], above[a] = own, anc | {a: 0}
                if mine:
                    yield a, own


def tiles(depths: np.ndarray, a: np.ndarray, xref: np.ndarray):
    """Batches of (b, v): everyone's pairs with the rows' people, one after the other. So stored, b stays for long and the people come again and again in the same order, which packs to a small part of what whole rows of increasing xrefs take."""
    a, kin = a << (2 * DEPTH), np.nonzero((depths >= 0).any(axis=0))[0]
    for start in range(0, len(kin), max(1, PAIRS // len(a))):
        b = kin[start : start + max(1, PAIRS // len(a))]
        found = np.ascontiguousarray(depths[:, b].T).astype(np.int64)
        some = found >= 0
        found += a
        cuts = np.append(0, np.cumsum(some.sum(axis=1))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(xref[b]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found[some]))], names=["b", "v"])


def pairs(people: DataFrame, step: DataFrame) -> DataFrame | None:
    """people(xref), step(at, to): distinct pairs of child and parent -> (a, b, depth_a, depth_b) of every two people with a common ancestor-or-self; the nearest has the least greater depth, then sum of depths, then xref. None where arrays can't serve: cycles, over 1,000 generations, xrefs that are no whole numbers or too long, over ``PEOPLE`` people."""
    spark, kind = people.sparkSession, people.schema["xref"].dataType
    if not isinstance(kind, T.IntegralType):
        return None
    people = people.select(F.col("xref").cast("long")).filter("xref is not null").distinct()
    if people.limit(PEOPLE + 1).count() > PEOPLE:
        return None
    xref = np.sort(people.toArrow().column(0).to_numpy())
    links = step.filter("at is not null and to is not null").select(F.col("at").cast("long"), F.col("to").cast("long")).toArrow()
    child, parent = (np.searchsorted(xref, links.column(c).to_numpy()) for c in (0, 1))
    known = np.ones(len(child), bool)
    for found, c in ((child, 0), (parent, 1)):
        known &= (found < len(xref)) & (np.append(xref, 0)[found] == links.column(c).to_numpy())
    known &= child != parent
    lines = Lines(child[known], parent[known], len(xref))
    if not lines.sound or len(xref) and max(-int(xref[0]), int(xref[-1])) >= XREF:
        return None
    blocks = lines.blocks(max(3, min(HELD // (16 * (len(xref) + 1)), len(xref) // (4 * spark.sparkContext.defaultParallelism))))
    tasks = max(1, min(len(blocks), 64 * spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast((lines, blocks, xref))

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                lines, blocks, xref = shared.value
                held, who = np.empty((max(1, min(TILE, HELD // (8 * len(xref) + 8))), len(xref)), np.int32), []
                for block in blocks[t::tasks]:
                    for a, row in lines.rows(block):
                        depths = row & ((1 << DEPTH) - 1)
                        depths *= (1 << DEPTH) - 1  # the first depth above the second: what is left of the sum
                        depths += (row >> (DEPTH + PLACE)) & ((1 << SUM) - 1)
                        depths[row >= NONE] = -1
                        depths[a] = -1
                        held[len(who)] = depths
                        who.append(a)
                        if len(who) == len(held):
                            yield from tiles(held, xref[who], xref)
                            who = []
                if who:
                    yield from tiles(held[: len(who)], xref[who], xref)

    v, mask = F.col("v"), (1 << DEPTH) - 1
    out = spark.range(0, tasks, 1, tasks).mapInArrow(run, "b long, v array<long>").select("b", F.explode("v").alias("v"))
    return out.select(F.shiftright(v, 2 * DEPTH).cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), F.shiftright(v, DEPTH).bitwiseAND(F.lit(mask).cast("long")).alias("depth_a"), v.bitwiseAND(F.lit(mask).cast("long")).alias("depth_b"))
