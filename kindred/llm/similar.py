"""Near-copies of the pipeline: classes of documents linked by a Jaccard similarity of at least 0.8 over their sets of five-word shingles.

Documents of equal words are folded first. Each gets a SimHash fingerprint of its five-word shingles, and operator 2's inverted
index of positional bytes, with its count filter and check of the bits, finds every pair at most 2 bits apart: its classes are
candidates. Texts of similarity 0.8 lie up to 11 bits apart and more, beyond what shared bytes can guarantee, so MinHash adds
candidates: 30 bands of 5 rows, of which a pair at 0.8 shares none with a chance of (1 - 0.8 ** 5) ** 30 = 7 in a million, a closer
pair with a lesser one. Each class of both kinds of candidates together is then verified on its shingles: no link rests on a
fingerprint or band, and within a class of candidates none is left out.
A class of over CHUNK documents is verified in many tasks of bounded size. First each member is compared with one of them, the
pivot. Those within 0.2 (the distance is 1 - similarity) are linked to it. The distance is a metric: a member at distance d of the
pivot can only have a link with one whose distance is at most d + 0.2, so linked members that are nearer to the pivot than any
unlinked one allows are done with. Blocks of what remains are compared block by block.

Null, empty and blank texts have no shingles and are one class. Null doc_ids take no part. Repeated rows get one class; rows of one
doc_id are one document, with the links of all its texts. Columns but doc_id and text are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.simhash import fingerprint_classes, fingerprint_of, shingle_hashes, words_of
from kindred.operators.components import connected_components
from kindred.plans.store import join_small, materialize

WORDS, LEAST, BANDS, ROWS, CHUNK = 5, 0.8, 30, 5, 2000
FACTORS, ADDENDS = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64)
FACTORS |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted; texts of fewer words are one shingle."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(words_of(text), 42, WORDS)]))


def bands(hashes: np.ndarray, block: int = 1 << 11) -> np.ndarray:
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), block):
        np.minimum(low, (hashes[i : i + block, None] * FACTORS + ADDENDS).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in low.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], least: float = LEAST) -> list[int]:
    """For each set, the first index of its class over links of similarity ``least``. A set that is reached is compared with those not reached yet, so a class of near-copies costs little more than its size."""
    sizes = np.array([len(s) for s in sets])
    label = [-1] * len(sets)
    rest = np.arange(len(sets))
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    for k in range(len(sets)):
        if label[k] >= 0:
            continue
        queue = [k]
        label[k] = k
        flat, rest = flat[np.repeat(rest != k, sizes[rest])], rest[rest != k]
        while queue and len(rest):
            x = sets[queue.pop()]
            if not len(x):
                continue
            n = sizes[rest]
            at = np.searchsorted(x, flat)
            at[at == len(x)] = 0
            both = np.bincount(np.repeat(np.arange(len(rest)), n)[x[at] == flat], minlength=len(rest))
            hit = both >= least * (len(x) + n - both) - 1e-9
            if hit.any():
                found = rest[hit].tolist()
                for j in found:
                    label[j] = k
                queue += found
                flat, rest = flat[np.repeat(~hit, n)], rest[~hit]
    return label


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def class_links(table: pa.Table) -> pa.Table:
    """(id, text) of candidates -> (u, v): each member's link to the first of its class, where that is another."""
    table = table.sort_by("id")
    roots = np.array(linked([shingles(t) for t in table.column("text").to_pylist()]))
    other = pa.array(np.nonzero(roots != np.arange(len(roots)))[0])
    return pa.table({"u": table.column("id").take(other), "v": table.column("id").take(pa.array(roots).take(other))})


def to_pivot(table: pa.Table) -> pa.Table:
    """(id, text, group, pivot) with the pivot's own row among them -> (id, group, pivot, s): similarity to the pivot's text."""
    ids, pivot, texts = table.column("id").to_pylist(), table.column("pivot")[0].as_py(), table.column("text").to_pylist()
    centre = shingles(texts[ids.index(pivot)])
    s = [similarity(shingles(t), centre) for t in texts]
    return pa.table({**{c: table.column(c) for c in ("id", "group", "pivot")}, "s": pa.array(s, pa.float64())})


def large_class_links(texts: DataFrame, large: DataFrame, kind: str, chunk: int) -> DataFrame:
    """texts(id, text, group) of the classes in large(group, pivot, n) -> (u, v)."""
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = join_small(texts, large, "group", "inner").withColumn("parts", parts)
    dealt = rows.withColumn("part", F.explode(F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))))
    near = materialize(dealt.groupBy("group", "part").applyInArrow(to_pivot, f"id {kind}, group {kind}, pivot {kind}, s double").filter("id != pivot"))
    links = near.filter(F.col("s") >= LEAST - 1e-9).select(F.col("id").alias("u"), F.col("pivot").alias("v"))
    least = near.filter(F.col("s") < LEAST - 1e-9).groupBy("group").agg(F.max("s").alias("most"))
    rest = near.join(least, "group").filter((F.col("s") < LEAST - 1e-9) | (F.col("s") <= F.col("most") + (1 - LEAST) + 1e-9)).select("id", "group")
    counts = rest.groupBy("group").agg(F.ceil(F.count("*") * 2 / chunk).cast("int").alias("blocks"))
    rest = materialize(rest.join(counts, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    if rest.isEmpty():
        return links
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    blocks = texts.join(rest.select("id", F.explode(every).alias("at")), "id").select("id", "text", "group", "at")
    return links.union(blocks.groupBy("group", "at").applyInArrow(class_links, f"u {kind}, v {kind}"))


def near_copies(docs: DataFrame, chunk: int = CHUNK, banded: bool = True) -> DataFrame:
    """(doc_id, text) -> (doc_id, component_id): the smallest doc_id of the document's class, for each row with a doc_id. Unless ``banded``, candidates are those of the fingerprints alone."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.filter("doc_id is not null").select("doc_id", "text")

    def sketch(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            same = [xxhash.xxh128_digest(b" ".join(words_of(t))) for t in texts]
            hashes = [list(shingle_hashes(words_of(t), 42, WORDS)) for t in texts]
            fps = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            keys = [bands(np.unique(np.concatenate([np.empty(0, np.uint64), *h]))).tolist() if banded else [] for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", "fp", "bands"])

    sketches = materialize(docs.mapInArrow(sketch, f"doc_id {kind}, same binary, fp long, bands array<long>"))
    folded = materialize(sketches.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    alike = fingerprint_classes(materialize(folded.groupBy("fp").agg(F.min("id").alias("least"))))
    near = join_small(folded.select("id", "fp"), alike, "fp", "inner").filter("id != component_id").select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    keyed = folded.select("id", F.posexplode("bands").alias("band", "key"))
    first = materialize(keyed.groupBy("band", "key").agg(F.min("id").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    pairs = join_small(keyed, first, ["band", "key"], "inner").filter("id != v").select(F.col("id").alias("u"), "v")
    candidates = materialize(connected_components(near.union(pairs)).select(F.col("node").alias("id"), F.col("component").alias("group")))
    own = docs.join(candidates, docs.doc_id == candidates.id).select("id", "text", "group")
    large = materialize(candidates.groupBy("group").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter(F.col("n") > chunk))
    small = join_small(own, large.select("group"), "group", "left_anti")
    links = small.groupBy("group").applyInArrow(class_links, f"u {kind}, v {kind}")
    if not large.isEmpty():
        links = links.union(large_class_links(own, large, kind, chunk))
    comps = materialize(connected_components(links))
    of = materialize(join_small(folded.select("same", "id"), comps.withColumnRenamed("node", "id"), "id", "left").select("same", F.coalesce("component", "id").alias("component_id")))
    return sketches.select("doc_id", "same").join(of, "same").select("doc_id", "component_id")
