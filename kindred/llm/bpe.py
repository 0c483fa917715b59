"""Operator 3, byte-level BPE by corpus-level merge replay.

A task's texts are one corpus: their new distinct words are laid out end to end, an inverted index leads from a mergeable token
pair to its places, and merges are applied in rank order to all places at once, touching only the neighbours of each merge.
Null text counts as empty; it has no ids. Words met before come from a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.words import plain_of, splitter

KNOWN = 400_000  # words kept by a worker; beyond that the table starts anew


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each word."""
    part: list[bytes | None] = []
    first = []
    nxt, prv = [], []
    index: dict[int, list[int]] = {}
    get = ranks.get
    for w in words:
        base, n = len(part), len(w)
        first.append(base)
        if n > 1 and w in ranks:  # a whole token
            part.append(w), nxt.append(-1), prv.append(-1)
            continue
        part.extend([w[i : i + 1] for i in range(n)])
        nxt.extend(range(base + 1, base + n)), nxt.append(-1)
        prv.append(-1), prv.extend(range(base, base + n - 1))
        for i in range(n - 1):
            r = get(w[i : i + 2])
            if r is not None:
                index.setdefault(r, []).append(base + i)
    heap = list(index)
    heapq.heapify(heap)
    tokens = {r: b for b, r in ranks.items()} if heap else {}
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if not places:
            continue
        token = tokens[rank]
        places.sort()
        for at, i in enumerate(places):
            a = part[i]
            if a is None or (j := nxt[i]) < 0 or a + part[j] != token:
                continue
            part[i], part[j] = token, None
            k = nxt[i] = nxt[j]
            lower = False
            if k >= 0:
                prv[k] = i
                if (r := get(token + part[k])) is not None:
                    lower |= r < rank
                    (index[r] if r in index else index.setdefault(r, heapq.heappush(heap, r) or [])).append(i)
            if (p := prv[i]) >= 0 and (r := get(part[p] + token)) is not None:
                lower |= r < rank
                (index[r] if r in index else index.setdefault(r, heapq.heappush(heap, r) or [])).append(p)
            if lower and at + 1 < len(places):  # the new pair goes first; the rest of this rank waits
                index[rank] = places[at + 1 :]
                heapq.heappush(heap, rank)
                break
    out = []
    for i in first:
        ids = []
        while i >= 0:
            ids.append(ranks[part[i]])
            i = nxt[i]
        out.append(ids)
    return out


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = splitter(pattern, plain_of(pattern))
        self.known: dict[str, bytes] = {}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list({w for ws in split for w in ws}.difference(self.known))
        for w, ids in zip(new, replay([w.encode() for w in new], self.ranks)):
            self.known[w] = np.array(ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, step: int = 256) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        c = codec(path, pattern)
        for big in batches:
            for s in range(0, big.num_rows, step):
                b = big.slice(s, step)
                ids = c.encode_batch([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
