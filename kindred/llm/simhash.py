"""Operator 2, SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most 2 differing bits share at least 6 of their 8 positional bytes. Distinct fingerprints are
dealt out by the bytes of two of four byte pairs, six keys each: of two fingerprints with 6 common bytes at least two pairs are
whole, so they meet. Where some meet, an inverted index leads from (position, byte) to the fingerprints that have it; its lists
add up the shared positional bytes of each pair, pairs that reach the guaranteed minimum of 6 are retained and verified on their
bits. A key with over CROWD fingerprints is dealt out again, by two more bytes: then six bytes are common, the tally is reached,
a key has at most 65,536 fingerprints whatever the input, and the few that a bit or two away are looked up to be verified.

Equal fingerprints are folded first, so copies cost one fingerprint. Null, empty and blank texts have fingerprint 0 and are linked
like others. Rows with a null doc_id get a fingerprint and the smallest doc_id of their class, null if it has none; repeated rows
get the same result each. Texts of any length are hashed whole, a block of shingles at a time. Columns but doc_id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.components import connected_components
from kindred.plans.store import join_small, materialize

BITS, SHARED, CROWD = 2, 6, 1024
PAIRS = [0xFFFF << (16 * p) for p in range(4)]
DEALT = [a | b for a, b in combinations(PAIRS, 2)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, split at 0x20 and 0x09-0x0D


def shingle_hashes(words: list[bytes], seed: int, shingle: int, block: int = 1 << 15):
    """Arrays (uint64) of the hashes of all shingles in order; fewer words are one shingle, none are none."""
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), block):
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : i + block], ends[i : i + block])], np.uint64)


def fingerprint(text: str | None, seed: int = 42, shingle: int = 3) -> int:
    return fingerprint_of(shingle_hashes(words_of(text), seed, shingle))


def fingerprint_of(hashes) -> int:
    """The fingerprint of shingles whose hashes come in arrays, repeats included."""
    tally, n = np.zeros(64, np.int64), 0
    for h in hashes:
        tally += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * tally > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def tallies(members: np.ndarray) -> np.ndarray:
    """Shared positional bytes of each pair, added up list by list of the inverted index from (position, byte) to members."""
    n = len(members)
    raw = members.view(np.uint8).reshape(n, 8)
    out = np.zeros((n, n), np.uint8)
    for p in range(8):
        order = np.argsort(raw[:, p], kind="stable")
        for posting in np.split(order, np.nonzero(np.diff(raw[order, p]))[0] + 1):
            if len(posting) > 1:
                out[np.ix_(posting, posting)] += 1
    return out


def counted(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that the tally retains and the bits verify."""
    a, b = np.nonzero(np.triu(tallies(members) >= SHARED, 1))
    near = np.bitwise_count(members[a] ^ members[b]) <= BITS
    return a[near], b[near]


def looked_up(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of sorted members that have six bytes in common: at most two bits of the other two differ, so each flip is looked up."""
    n = len(members)
    free = int(np.bitwise_or.reduce(members ^ members[0]))
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    aa, bb = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for flip in bits + [x | y for x, y in combinations(bits, 2)]:
        at = np.searchsorted(members, members ^ flip)
        at[at == n] = 0
        hit = np.nonzero((members[at] == members ^ flip) & (members < members ^ flip))[0]
        aa.append(hit), bb.append(at[hit])
    return np.concatenate(aa), np.concatenate(bb)


def spanning(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few links as join the same members."""
    label = np.arange(len(members))
    while len(a):  # the least label spreads over the links
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    signed = members.view(np.int64)
    return [(int(signed[i]), int(signed[label[i]])) for i in np.nonzero(label != np.arange(len(members)))[0]]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fp, masks: list[tuple[int, int]]):
    """An array of struct(i, k): the fingerprint's bits under each mask, with the mask's number."""
    return F.array(*[F.struct(F.lit(i).cast("short").alias("i"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in masks])


def _links(postings: DataFrame, find) -> DataFrame:
    def run(batches):
        for b in batches:
            links = []
            for m in b.column(0):
                members = np.sort(np.array(m.as_py(), np.int64).view(np.uint64))
                links += spanning(members, *find(members))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return postings.groupBy("key").agg(F.collect_list("fp").alias("members")).filter("size(members) > 1").select("members").mapInArrow(run, "u long, v long")


def fingerprint_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct (fp) -> links (u, v) between fingerprints, enough to span each class."""
    dealt = fps.select("fp", F.explode(_keys(F.col("fp"), list(enumerate(DEALT)))).alias("key"))
    met = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = join_small(dealt, met, "key", "inner")
    few = _links(rows.filter(F.col("n") <= crowd).select("fp", "key"), counted)
    if met.filter(F.col("n") > crowd).isEmpty():
        return few
    again = None  # two more of the bytes that the key leaves free
    for i, m in enumerate(DEALT):
        free = [p for p in range(8) if not m >> (8 * p) & 0xFF]
        masks = [(16 * i + j, m | 0xFF << 8 * p | 0xFF << 8 * q) for j, (p, q) in enumerate(combinations(free, 2))]
        keys = _keys(F.col("fp"), masks)
        again = F.when(F.col("key.i") == i, keys) if again is None else again.when(F.col("key.i") == i, keys)
    return few.union(_links(rows.filter(F.col("n") > crowd).select("fp", F.explode(again).alias("key")), looked_up))


def fingerprint_classes(least: DataFrame) -> DataFrame:
    """(fp, least): distinct fingerprints with the smallest id that has each -> (fp, component_id), the smallest id reachable over links."""
    comps = connected_components(fingerprint_links(least.select("fp")))
    by = least.join(comps, least.fp == comps.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = by.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialize(by.join(roots, "component").select("fp", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id): the smallest doc_id reachable over links."""
    fps = materialize(fingerprints(docs))
    return fps.join(fingerprint_classes(materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))), "fp")


def op2(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
