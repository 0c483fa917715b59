"""Operator 4, packing along a space-filling curve.

Documents' hashed token counts are projected to three dimensions; a Hilbert key orders them; the curve is cut into partitions of
about equal tokens, by a histogram of its cells (a cell with more tokens than a partition's share is dealt out by a hash of the
id, so even a third of the rows with one key go to many tasks); each partition is sorted by the key and cut into full sequences,
and its remainder into sequences whose lengths are powers of two, so nothing is padded.
Null and empty texts are one end id. Rows with a null doc_id and repeated rows are packed like any other, once each. Ties in the
key go by a hash of the id, the id, then the ids. Texts of any length are cut where sequences end. Columns but doc_id and text are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import PLAIN, byte_characters, plain_of
from kindred.plans.store import materialize

KNOWN, END, SIZE, DIMS, ORDER, CELLS = 400_000, 2, 4096, 3, 10, 16


class Words:
    """Ids of a text word by word: the tokenizer never merges across its pre-tokenizer's words. A word's ids come from the tokenizer's own merges."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            told = json.load(f)
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.slow, self.fast = regex.compile(pattern).findall, re.compile(plain_of(pattern)).findall
        self.special = {t["content"]: np.array([t["id"]], "<u2").tobytes() for t in told["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.merge, self.characters = self.tokenizer.model.tokenize, byte_characters()
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.slow(self.tokenizer.normalizer.normalize_str(text)) if PLAIN.search(text) or "İ" in text else self.fast(text.lower())

    def word_ids(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.characters)
        return array("H", [t.id for t in self.merge(word)]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id. The tokenizer takes its special tokens' literals out of a text first; so do we."""
        parts = [self.at_special.split(t) if "<|" in t else [t] for t in texts]
        split = [[self.split(x) if i % 2 == 0 else x for i, x in enumerate(p)] for p in parts]
        for w in set().union(*(x for p in split for x in p[::2])).difference(self.known):
            self.known[w] = self.word_ids(w)
        get, end = self.known.__getitem__, np.array([END], "<u2").tobytes()
        out = [np.frombuffer(b"".join([*(b"".join(map(get, x)) if i % 2 == 0 else self.special[x] for i, x in enumerate(p)), end]), "<u2") for p in split]
        if len(self.known) > KNOWN:
            self.known = {}
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d), by undoing the axes' rotations from the top bit down."""
    x = points.astype(np.int64).T.copy()
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(d):
            turn = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(turn, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = np.where(turn, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, path: str, buckets: int = 256, step: int = 256) -> DataFrame:
    """(doc_id, text) -> doc_id, key, ids (little-endian unsigned 16-bit)."""

    def run(batches):
        w = words(path)
        plane = np.random.default_rng(7).standard_normal((buckets, DIMS))
        bucket = ((np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(24)) % buckets
        for big in batches:
            for s in range(0, big.num_rows, step):
                b = big.slice(s, step)
                ids = w.encode_batch([t or "" for t in b.column(1).to_pylist()])
                counts = np.sqrt(np.stack([np.bincount(bucket[x], minlength=buckets) for x in ids]))
                at = counts @ plane / np.linalg.norm(counts, axis=1, keepdims=True)
                cell = np.clip((at + 3) / 6 * (1 << ORDER), 0, (1 << ORDER) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hilbert(cell, ORDER)), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "key", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key long, ids binary")


def cell_parts(weights: list[tuple[int, int]], share: int) -> list[tuple[int, int, int]]:
    """(cell, tokens) in order of the cells -> (cell, first partition, partitions): neighbouring cells fill a partition of ``share`` tokens, a heavier cell has some of its own."""
    out, part, used = [], -1, share
    for cell, n in weights:
        if n > share:
            own = -(-n // share)
            out.append((cell, part + 1, own))
            part, used = part + own, share
        else:
            if used + n > share:
                part, used = part + 1, 0
            out.append((cell, part, 1))
            used += n
    return out


def pack(docs: DataFrame, path: str, tokens_per_task: int = 8_000_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    table = materialize(tokenized(docs, path))
    spark, cell = docs.sparkSession, F.shiftright("key", DIMS * ORDER - CELLS)
    weights = table.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("ids")).alias("n")).orderBy("cell").collect()  # at most 2**CELLS rows
    total = sum(r.n for r in weights) // 2
    share = max(1, min(tokens_per_task, total // int(spark.conf.get("spark.sql.shuffle.partitions")) + 1))
    dealt = cell_parts([(r.cell, r.n // 2) for r in weights], share)
    parts = max((first + n for _, first, n in dealt), default=1)
    dealt = F.broadcast(spark.createDataFrame(dealt, "cell long, first int, n int"))  # as many rows as cells
    of_id = F.xxhash64("doc_id")
    rows = table.join(dealt, cell == dealt.cell).select("doc_id", "key", "ids", (F.col("first") + F.pmod(of_id, F.col("n"))).cast("int").alias("part"))
    rows = rows.repartitionById(parts, "part").select("doc_id", "key", "ids").sortWithinPartitions("key", of_id, "doc_id", "ids").select("doc_id", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        seq, used, kind = 0, 0, None

        def emit(pieces):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i else kind) for i, c in enumerate(zip(*pieces))], names=names)

        open_: list[tuple] = []  # pieces of the sequence that isn't full yet, with their ids
        for b in batches:
            kind = b.schema.field(0).type
            done: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(SIZE - used, len(ids) - start)
                    open_.append((doc, start, ids[start : start + n], len(ids)))
                    start, used = start + n, used + n
                    if used == SIZE:
                        at = 0
                        for d, s, x, t in open_:
                            done.append((d, s, len(x), zlib.crc32(x.tobytes()), t, base + seq, at))
                            at += len(x)
                        open_, used, seq = [], 0, seq + 1
            if done:
                yield emit(done)
        done, size, at = [], 0, 0
        for d, s, x, t in open_:  # the remainder, in sequences of its binary digits
            while len(x):
                if at == size:
                    size, at, seq = 1 << (used.bit_length() - 1), 0, seq + 1
                    used -= size
                n = min(size - at, len(x))
                done.append((d, s, n, zlib.crc32(x[:n].tobytes()), t, base + seq, at))
                s, x, at = s + n, x[n:], at + n
        if done:
            yield emit(done)

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("word_bpe_49k.json"))
