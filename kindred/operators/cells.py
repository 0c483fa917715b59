"""Pairs of rows that share a key, a cell at a time: a key's rows are dealt into chunks, and a task compares two chunks as arrays.

Scores of pairs are looked up: each part of a score depends on a few columns only (name, birth, place, sex), so it is worked out
once for each two of their distinct values by the same expressions that score pairs row by row, and a cell adds up what its rows
point at. What passes a sum of 32-bit floats with a margin is looked up again in full, so no score is rounded on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans.store import materialize

CHUNK, OUT = 2000, 1 << 18
#: Distinct values of a part of the score up to which each two of them are scored.
VALUES = 3000


def dealt(rows: DataFrame, chunk: int = CHUNK, two: bool = False) -> DataFrame:
    """rows(key, ...), or rows(key, side, ...) of two sides (0 and 1), written once -> the same with own, i, j, in order of cells. A cell of one side is an unordered pair of chunks, own is i or j."""
    spark = rows.sparkSession
    if two:
        n = lambda s: F.ceil(F.count(F.when(F.col("side") == s, 1)) / chunk).cast("int")
        sizes = rows.groupBy("key").agg(n(0).alias("is"), n(1).alias("js")).filter("is > 0 and js > 0")
    else:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("is"))
    rows = rows.join(sizes, "key")
    of = lambda n: F.pmod(F.xxhash64("xref"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    if two:
        at = F.when(F.col("side") == 0, F.transform(upto("js"), lambda j: F.struct(of("is").alias("i"), j.alias("j")))).otherwise(F.transform(upto("is"), lambda i: F.struct(i.alias("i"), of("js").alias("j"))))
        rows = rows.withColumn("own", F.col("side"))
    else:
        at = F.transform(upto("is"), lambda j: F.struct(F.least(of("is"), j).alias("i"), F.greatest(of("is"), j).alias("j")))
        rows = rows.withColumn("own", of("is"))
    rows = rows.withColumn("at", F.explode(at)).select(F.col("at.i").alias("i"), F.col("at.j").alias("j"), *[c for c in rows.columns if c not in ("is", "js")])
    cells = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(cells, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def groups(batches):
    """Batches in order of key, i, j -> a table for each cell."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        i, j, key = b.column("i").to_numpy(), b.column("j").to_numpy(), b.column("key").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.nonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(key) != 0))[0] + 1).tolist(), b.num_rows]
        cell = lambda r: tuple(r.column(c)[0].as_py() for c in ("key", "i", "j"))
        for s, e in zip(cuts[:-1], cuts[1:]):
            part = b.slice(s, e - s)
            if held and cell(held[0]) != cell(part):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def codes(t: pa.Table, *columns: str) -> np.ndarray:
    """A number for each row, equal where the columns are; negative where one is empty text or null."""
    out, empty = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, bool)
    for c in columns:
        d = t.column(c).combine_chunks().dictionary_encode()
        at = d.indices.fill_null(-1).to_numpy().astype(np.int64)
        blank = np.array([v in ("", None) for v in d.dictionary.to_pylist()] + [True])
        empty |= blank[at]
        out = out * (len(blank) + 1) + at
    return np.where(empty, -1, out)


def same(x: np.ndarray, rows, cols) -> np.ndarray:
    return (x[rows, None] == x[None, cols]) & (x[rows, None] >= 0)


def kept_pairs(t: pa.Table, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which pairs of a cell come from it: those of its key that no earlier kind of key has. Kinds: I (surname's code and initial), X (surname's head and place), Z0 and Z4 (surname's code and near years; years at most four apart share one of two eight-year spans, four years set off)."""
    kind = t.column("key")[0].as_py().split("|")[0]
    if kind == "I":
        return np.ones((len(rows), len(cols)), bool)
    out = ~same(codes(t, "sx", "initial"), rows, cols)
    if kind == "X":
        return out
    year = t.column("year").to_numpy().astype(np.int64)
    a, b = year[rows, None], year[None, cols]
    out &= (np.abs(a - b) <= 3) | (a // 5 == b // 5)
    out &= ~same(codes(t, "head", "token"), rows, cols)
    if kind == "Z4":
        out &= a // 8 != b // 8
    return out


def cell_sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two chunks, and whether they are one."""
    own, i, j = t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
    return np.nonzero(own == i)[0], np.nonzero(own == j)[0], i == j


def ordered(t: pa.Table, step: int = CHUNK):
    """(rows, cols, pairs, below) of a one-sided cell: pairs that come from it, where the row's xref is below the column's, else the other way round. A chunk that is larger than it should be is cut."""
    x = t.column("xref").to_numpy()
    rows, cols, one = cell_sides(t)
    for r in (rows[k : k + step] for k in range(0, len(rows), step)):
        for c in (cols[k : k + step] for k in range(0, len(cols), step)):
            below = x[r, None] < x[None, c]
            m = kept_pairs(t, r, c)
            yield r, c, m & (below if one else x[r, None] != x[None, c]), below


def listed(batches):
    """Dealt rows -> (a, b)."""
    for t in groups(batches):
        x = t.column("xref").combine_chunks()
        for r, c, m, below in ordered(t):
            i, j = np.nonzero(m)
            low = below[i, j]
            a, b = np.where(low, r[i], c[j]), np.where(low, c[j], r[i])
            for k in range(0, len(a), OUT):
                yield pa.RecordBatch.from_arrays([x.take(pa.array(y[k : k + OUT])) for y in (a, b)], names=["a", "b"])


def counts(batches):
    """Dealt rows -> (a, n): how many pairs of a cell have a as the lesser xref."""
    for t in groups(batches):
        n = np.zeros(t.num_rows, np.int64)
        for r, c, m, below in ordered(t):
            low = m & below
            np.add.at(n, r, low.sum(axis=1))
            np.add.at(n, c, (m ^ low).sum(axis=0))
        hit = np.nonzero(n)[0]
        if len(hit):
            yield pa.RecordBatch.from_arrays([t.column("xref").combine_chunks().take(pa.array(hit)), pa.array(n[hit])], names=["a", "n"])


class Part:
    """A part of the score, for each two distinct values: as it is, and weighted with a margin either way round."""

    def __init__(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, n: int, weight: float):
        values, back = np.unique(score, return_inverse=True)
        self.values, self.at = values, np.zeros((n, n), np.uint16 if len(values) < 1 << 16 else np.uint32)
        self.at[i, j] = back
        both = values[self.at]
        self.bound = (np.maximum(both, both.T) * weight).astype(np.float32)

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.values[self.at[a, b]]


def parts(people: DataFrame, of: dict, most: int = VALUES):
    """people, of: name -> (columns, score of structs a and b, weight) -> (people with a number for each name, {name: Part}), or None where a part has over ``most`` distinct values."""
    found = {}
    for name, (columns, score, weight) in of.items():
        values = people.select(F.struct(*columns).alias("v")).distinct().limit(most + 1).collect()
        n = len(values)
        if n > most:
            return None
        schema = people.select(F.struct(*columns).alias("v")).schema.add(f"{name}_at", "integer")
        table = people.sparkSession.createDataFrame([(r.v, k) for k, r in enumerate(values)], schema)
        table = materialize(table)
        # both have at most ``most`` rows
        a, b = table.select(F.col("v").alias("a"), F.col(f"{name}_at").alias("i")).repartition(4 * people.sparkSession.sparkContext.defaultParallelism), table.select(F.col("v").alias("b"), F.col(f"{name}_at").alias("j"))
        t = a.join(F.broadcast(b)).select("i", "j", score(F.col("a"), F.col("b")).alias("s")).toArrow()
        found[name] = Part(*(t.column(c).to_numpy() for c in ("i", "j", "s")), n, weight)
        same_ = None
        for c in columns:
            one = F.col(c).eqNullSafe(F.col(f"v.{c}"))
            same_ = one if same_ is None else same_ & one
        people = people.join(F.broadcast(table), same_).drop("v")
    return people, found


def may_reach(t: pa.Table, found: dict, r: np.ndarray, c: np.ndarray, m: np.ndarray, least: float, extra: np.ndarray | None = None):
    """(i, j) of the pairs in m whose weighted parts, with ``extra``, may reach ``least``."""
    total = np.zeros(m.shape, np.float32) if extra is None else extra.astype(np.float32)
    for name, part in found.items():
        at = t.column(f"{name}_at").to_numpy()
        total += np.take(part.bound[at[r]], at[c], axis=1)
    total[~m] = -1
    return np.nonzero(total >= np.float32(least - 1e-4))


def related(t: pa.Table, r: np.ndarray, c: np.ndarray) -> np.ndarray | None:
    """The relation scores of the pairs of r and c, from the lists (b, s) that each row has of those with greater xrefs; None where all are 0."""
    x, out = t.column("xref").to_numpy(), None
    lists = t.column("related").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    row, flat = np.repeat(np.arange(t.num_rows), n), lists.flatten()
    b, s = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("b", "s"))
    for of, others, turned in ((r, c, False), (c, r, True)):
        place = np.full(t.num_rows, -1)
        place[of] = np.arange(len(of))
        values, back = np.unique(x[others], return_inverse=True)
        at = np.searchsorted(values, b)
        at[at == len(values)] = 0
        hit = (place[row] >= 0) & (values[at] == b)
        if hit.any():
            part = np.zeros((len(of), len(values)))
            part[place[row[hit]], at[hit]] = s[hit]
            part = part[:, back]
            out = (part.T if turned else part) if out is None else np.maximum(out, part.T if turned else part)
    return out


def found_rows(t: pa.Table, found: dict, a: np.ndarray, b: np.ndarray, relation: np.ndarray | None = None):
    x = t.column("xref").combine_chunks()
    places = {name: t.column(f"{name}_at").to_numpy() for name in found}
    relation = np.zeros(len(a)) if relation is None else relation
    for k in range(0, len(a), OUT):
        p, q = a[k : k + OUT], b[k : k + OUT]
        yield pa.RecordBatch.from_arrays([x.take(pa.array(p)), x.take(pa.array(q)), *(pa.array(part.exact(places[n][p], places[n][q])) for n, part in found.items()), pa.array(relation[k : k + OUT])], names=["a", "b", *(f"{n}_score" for n in found), "relation_score"])


def within(found, least: float, weight: float):
    """Dealt rows of one side, with ``related`` -> pairs that may reach ``least``."""

    def run(batches):
        for t in groups(batches):
            for r, c, m, below in ordered(t):
                e = related(t, r, c)
                i, j = may_reach(t, found.value, r, c, m, least, None if e is None else e * weight)
                low = below[i, j]
                yield from found_rows(t, found.value, np.where(low, r[i], c[j]), np.where(low, c[j], r[i]), None if e is None else e[i, j])

    return run


def between(found, least: float, gap: int, step: int = CHUNK):
    """Dealt rows of two sides -> pairs whose years are at most ``gap`` apart, or one is missing, and that may reach ``least``."""

    def run(batches):
        for t in groups(batches):
            side, year = t.column("own").to_numpy(), t.column("year").fill_null(-1).to_numpy().astype(np.int64)
            rows, cols = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            for r in (rows[k : k + step] for k in range(0, len(rows), step)):
                for c in (cols[k : k + step] for k in range(0, len(cols), step)):
                    y, z = year[r, None], year[None, c]
                    i, j = may_reach(t, found.value, r, c, (np.abs(y - z) <= gap) | (y < 0) | (z < 0), least)
                    yield from found_rows(t, found.value, r[i], c[j])

    return run
