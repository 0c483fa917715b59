"""Operator 7, removal of 100-byte strings that start earlier in the corpus, by hash-compared suffix sorting.

Dealing out: each 100-byte window has one anchor, the least 50-byte hash in it, so equal windows have equal anchors at equal
places, and windows whose anchor occurs once need no comparison. Neighbouring windows of one anchor are a run. Runs meet by
anchor without their bytes, at most two of a buffer's for one anchor, for a third one knows that it has company. Only runs whose
anchor occurs again send their bytes: equal runs are folded to the earliest by comparing the bytes, first within each task (so a
run in a third of the documents leaves a task a few times, whatever its count), then across tasks.
Sorting: the windows of the different runs of an anchor are suffixes, sorted by mergesort; a comparison finds the common
extension by binary search over prefix polynomial hashes modulo 2**61 - 1, and neighbours that these call equal are verified byte
by byte. An anchor with over SPREAD different runs goes to many tasks: its windows are dealt out by their hash, each with its
bytes, and folded as runs are.
So every removed byte rests on compared bytes; only whole texts are told apart by SHA-256, to fold exact copies first.

Null and empty texts have nothing to remove; texts of any length are read in overlapping pieces. Rows with a null doc_id take no
part and stay as they are. Rows of one doc_id are numbered and the first of equal texts is kept whole. Ties can't occur: a place
is a document and a start. Columns of any other name pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.store import join_small, materialize, spare

SIZE, ANCHOR, BUFFER, SPREAD, KEPT, TWICE = 100, 50, 1 << 20, 4096, 100_000, 1 << 20
BASE = 0x9E3779B97F4A7C15
U = np.uint64
PRIME, LOW31, LOW30 = U((1 << 61) - 1), U((1 << 31) - 1), U((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for any 64-bit x."""
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, from products of halves that fit in 64 bits."""
    ah, al, bh, bl = a >> U(31), a & LOW31, b >> U(31), b & LOW31
    middle = al * bh + ah * bl
    return reduced(U(2) * ah * bh + (middle >> U(30)) + ((middle & LOW30) << U(31)) + reduced(al * bl))


_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base; the table doubles as needed."""
    global _powers
    while len(_powers) < n:
        step = times(_powers[-1:], np.array([BASE % int(PRIME)], U))
        _powers = np.concatenate((_powers, times(_powers, np.broadcast_to(step, _powers.shape))))
    return _powers[:n]


class Hashes:
    """Polynomial hashes modulo 2**61 - 1 of a buffer's prefixes."""

    def __init__(self, raw: np.ndarray):
        self.power = powers(len(raw) + 1)
        x, p = raw.astype(U) + U(1), self.power[:-1]
        high, low = np.cumsum(x * (p >> U(32))), np.cumsum(x * (p & U(0xFFFFFFFF)))  # below 2**64 up to 2**22 bytes
        total = (high >> U(29)) + ((high & U((1 << 29) - 1)) << U(32))  # 2**61 is 1 here
        self.sums = np.concatenate((np.zeros(1, U), reduced(reduced(total) + reduced(low))))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of the substrings at a and b agree; the earlier one is moved up to the later by a power."""
        first, second = np.minimum(a, b), np.maximum(a, b)
        x = reduced(self.sums[first + length] + (PRIME - self.sums[first]))
        y = reduced(self.sums[second + length] + (PRIME - self.sums[second]))
        return times(x, self.power[second - first]) == y


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each ANCHOR bytes, from one rolling sum modulo 2**64: it only deals windows out and decides nothing."""
    n = len(raw)
    power, back = np.full(n + 1, BASE, U), np.full(n + 1, pow(BASE, -1, 1 << 64), U)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power), np.multiply.accumulate(back, out=back)
    sums = np.zeros(n + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * power[:n], out=sums[1:])
    return mix((sums[ANCHOR:] - sums[:-ANCHOR]) * back[: n - ANCHOR + 1])


def anchor_runs(texts: list[bytes]):
    """Index of the text, lo, cnt (windows), rel (anchor after lo) and anchor hash of each run; None without a window."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    counts = np.maximum(0, lengths - SIZE + 1)
    if not counts.sum():
        return None
    grams = gram_hashes(raw)
    least, width = ((grams >> U(32)) << U(32)) | np.arange(len(grams), dtype=U), 1
    while width * 2 <= SIZE - ANCHOR + 1:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    rest = SIZE - ANCHOR + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[doc]
    anchor = (least[at] & U((1 << 32) - 1)).astype(np.int64)
    first = np.nonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))[0]
    cnt = np.diff(np.concatenate((first, [len(at)])))
    lo, a = at[first], anchor[first]
    return doc[first], lo - begins[doc[first]], cnt, a - lo, grams[a]


def compare(h: Hashes, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffix a is below suffix b, and whether they agree for SIZE bytes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), SIZE, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = h.equal(a, b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    equal = lo == SIZE
    step = np.where(equal, 0, lo)
    return ~equal & (raw[a + step] < raw[b + step]), equal


def merge_sort(h: Hashes, raw: np.ndarray, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within each group (groups lie together); stable."""
    n = len(suffix)
    begin = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(n), 0))
    end = np.minimum.accumulate(np.where(np.concatenate((group[1:] != group[:-1], [True])), np.arange(1, n + 1), n)[::-1])[::-1]
    order, width, place = np.arange(n), 1, np.arange(n)
    most = int((end - begin).max(initial=0))
    while width < most:
        run = begin + (place - begin) // width * width
        left = (place - begin) // width % 2 == 0
        lo = np.where(left, np.minimum(run + width, end), run - width)
        hi = np.where(left, np.minimum(run + 2 * width, end), run)
        other = lo.copy()
        live = np.nonzero(lo < hi)[0]
        while len(live):  # places of the other run that come before
            mid = (lo[live] + hi[live]) // 2
            below, equal = compare(h, raw, suffix[order[mid]], suffix[order[live]])
            before = below | (equal & ~left[live])
            lo[live], hi[live] = np.where(before, mid + 1, lo[live]), np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        to = np.where(left, place + (lo - other), place - (run - lo))
        moved = np.empty(n, np.int64)
        moved[to] = order
        order, width = moved, width * 2
    return order


def later_windows(docs: np.ndarray, los: np.ndarray, rels: np.ndarray, keys: np.ndarray, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of each window in the runs that has an equal one in an earlier place."""
    raw = np.frombuffer(b"".join(runs), np.uint8)
    lengths = np.array([len(r) for r in runs])
    counts = lengths - SIZE + 1
    run = np.repeat(np.arange(len(runs)), counts)
    step = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    suffix = (np.cumsum(lengths) - lengths)[run] + step
    delta = rels[run] - step
    order = np.lexsort((los[run] + step, docs[run], delta, keys[run]))
    run, step, suffix, delta = run[order], step[order], suffix[order], delta[order]
    new = np.concatenate(([True], (keys[run][1:] != keys[run][:-1]) | (delta[1:] != delta[:-1])))
    group = np.cumsum(new)
    alone = np.bincount(group)[group] == 1
    run, step, suffix, group = run[~alone], step[~alone], suffix[~alone], group[~alone]
    if not len(run):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = Hashes(raw)
    by = merge_sort(h, raw, suffix, group)
    run, step, suffix, group = run[by], step[by], suffix[by], group[by]
    _, equal = compare(h, raw, suffix[:-1], suffix[1:])
    hit = np.nonzero(equal & (group[1:] == group[:-1]))[0] + 1
    views = np.lib.stride_tricks.sliding_window_view(raw, SIZE)
    hit = hit[(views[suffix[hit]] == views[suffix[hit - 1]]).all(axis=1)]
    return docs[run[hit]], los[run[hit]] + step[hit]


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.nonzero(np.concatenate(([True], s[1:] > e[:-1])))[0]
    return list(zip(s[new].tolist(), e[np.concatenate((new[1:] - 1, [len(e) - 1]))].tolist()))


RUN = "h long, doc long, at long"  # at: lo, cnt and rel in one number, -1 - that where known
CUT = "k long, doc long, s int, e int, h long, rel short, run binary"  # run null: a span that is known to be repeated
FOUND = "doc long, s int, e int, h long, rel short, run binary"


def pieces(text: bytes, size: int):
    """(start, bytes) of pieces of at most ``size`` bytes; each window lies in just one."""
    for at in range(0, max(1, len(text) - SIZE + 1), size - SIZE + 1):
        yield at, text[at : at + size]


def find_runs(batches, buffer: int = BUFFER):
    """(doc, text) -> RUN rows. An anchor's third and later runs in a buffer, and all after a buffer that had two, are known to have company: their ``at`` is -1 - at, and they need not meet the others."""
    twice = np.empty(0, np.int64)

    def emit(parts):
        nonlocal twice
        ids, starts, raws = zip(*parts)
        if (found := anchor_runs(list(raws))) is None:
            return
        d, lo, cnt, rel, h = found
        h, at = h.view(np.int64), (lo + np.array(starts)[d]) << 16 | cnt << 8 | rel
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        nth = np.empty(len(h), np.int64)
        nth[order] = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        known = nth > 1
        if len(twice):
            place = np.searchsorted(twice, h)
            place[place == len(twice)] = 0
            known |= twice[place] == h
        twice = np.union1d(twice if len(twice) < TWICE else twice[:0], h[nth == 1])
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.array(ids, np.int64)[d]), pa.array(np.where(known, -1 - at, at))], names=["h", "doc", "at"])

    for b in batches:
        parts, total = [], 0
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            for start, raw in pieces(text.as_py(), buffer):
                if parts and total + len(raw) > buffer:
                    yield from emit(parts)
                    parts, total = [], 0
                parts.append((doc, start, raw))
                total += len(raw)
        if parts:
            yield from emit(parts)


def with_company(batches):
    """RUN rows in order of h -> those whose anchor occurs again, with ``at`` as it was."""

    def emit(cols, alike):
        h, doc, at = cols
        again = np.concatenate(([alike], h[1:] == h[:-1]))
        keep = again | np.concatenate((again[1:], [False])) | (at < 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, doc, np.where(at < 0, -1 - at, at))], names=["h", "doc", "at"])

    held, alike = None, False  # the last row waits for the next; whether it is like the one before it
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in ("h", "doc", "at")]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if len(cols[0]) > 1:
            again = cols[0][-1] == cols[0][-2]
            out = emit(cols, alike)
            last = out.num_rows and (again or cols[2][-1] < 0 or (len(cols[0]) == 1 and alike))
            yield out.slice(0, out.num_rows - 1) if last else out
            alike = bool(again)
        held = [x[-1:] for x in cols]
    if held is not None:
        yield emit(held, alike)


def cut_batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["k", "doc", "s", "e", "h", "rel", "run"])


KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int16(), pa.binary())


class Earliest:
    """The earliest place of each string that a task has seen lately, compared on bytes."""

    def __init__(self):
        self.place: dict[bytes, tuple[int, int]] = {}

    def repeated(self, string: bytes, doc: int, at: int) -> bool:
        """Whether an earlier place was seen; else this one is noted."""
        here, was = (doc, at), self.place.get(string)
        if was is not None and was < here:
            return True
        if len(self.place) >= KEPT:
            self.place.clear()
        self.place[string] = here
        return False


def key_of(string: bytes) -> int:
    x = xxhash.xxh64_intdigest(string)
    return x - (1 << 64) if x >> 63 else x


def cut_runs(batches, step: int = 256):
    """(doc, text, hs, ats) -> CUT rows; what is known to repeat an earlier run of the same task goes on as a span."""
    seen = Earliest()
    for big in batches:
        for i in range(0, big.num_rows, step):
            b, out = big.slice(i, step), []
            for doc, text, hs, ats in sorted(zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()), key=lambda r: r[0]):
                raw, first, last = text.as_py(), 0, -1
                for h, at in zip(hs, ats):
                    lo, rel = at >> 16, at & 255
                    end = lo + (at >> 8 & 255) + SIZE - 1
                    run = raw[lo:end]
                    if not seen.repeated(run, doc, lo):
                        out.append((key_of(run), doc, lo, end, h, rel, run))
                    elif lo <= last:
                        last = max(last, end)
                    else:
                        if last >= 0:
                            out.append((doc * 31 + first, doc, first, last, None, None, None))
                        first, last = lo, end
                if last >= 0:
                    out.append((doc * 31 + first, doc, first, last, None, None, None))
            yield cut_batch(out, KINDS)


def cut_windows(batches, step: int = 256):
    """FOUND rows of runs -> CUT rows of their windows."""
    seen = Earliest()
    for big in batches:
        for i in range(0, big.num_rows, step):
            b, out = big.slice(i, step), []
            for doc, lo, run in zip(*(b.column(c).to_pylist() for c in ("doc", "s", "run"))):
                for at in range(len(run) - SIZE + 1):
                    window, s = run[at : at + SIZE], lo + at
                    again = seen.repeated(window, doc, s)
                    out.append((doc * 31 + s, doc, s, s + SIZE, None, None, None) if again else (key_of(window), doc, s, s + SIZE, 0, 0, window))
            yield cut_batch(out, KINDS)


def fold_equal(batches):
    """CUT rows in order of k, run, doc, s -> FOUND rows: the earliest of equal runs; the others are spans (run null)."""
    last_k = last_run = None
    for b in batches:
        if not b.num_rows:
            continue
        k, run, n = b.column("k"), b.column("run"), b.num_rows
        same = np.zeros(n, bool)
        if n > 1:
            both = pc.and_(pc.equal(k[1:], k[:-1]), pc.fill_null(pc.equal(run[1:], run[:-1]), False))
            same[1:] = both.to_numpy(zero_copy_only=False)
        same[0] = run[0].is_valid and k[0].as_py() == last_k and run[0].as_py() == last_run
        last_k, last_run = k[n - 1].as_py(), run[n - 1].as_py()
        kept = pa.array(~same)
        cols = [b.column("doc"), b.column("s"), b.column("e"), *(pc.if_else(kept, b.column(c), pa.scalar(None, b.schema.field(c).type)) for c in ("h", "rel", "run"))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc", "s", "e", "h", "rel", "run"])


def sort_runs(table: pa.Table) -> pa.Table:
    """FOUND rows of runs of some anchors -> (doc, s, e): spans of windows with an equal one in an earlier place."""
    h = table.column("h").to_numpy()
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    table = table.filter(pa.array(n[back] > 1))
    h, doc, lo, rel = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "doc", "s", "rel"))
    d, s = later_windows(doc, lo, rel, h, table.column("run").to_pylist()) if len(h) else (h, h)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.nonzero(np.concatenate((np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (s[1:] > s[:-1] + SIZE))))[0]
    ends = s[np.concatenate((new[1:], [len(d)])).astype(np.int64) - 1] + SIZE if len(d) else s
    return pa.table({"doc": pa.array(d[new], pa.int64()), "s": pa.array(s[new].astype(np.int32)), "e": pa.array(ends.astype(np.int32))})


def with_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique long that orders the rows by doc_id (null where that is null), and its name. Only where a doc_id repeats are the rows numbered, over a copy in shared storage, so that a lost task finds the same numbers."""
    key = spare(docs.columns, "_key")
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null")
    if ids.groupBy("id").count().filter("count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    row = spare([*docs.columns, key], "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    order = rows.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), row).repartitionByRange("id", row).sortWithinPartitions("id", row)
    order = materialize(order.select(row, F.monotonically_increasing_id().alias(key)))
    return materialize(rows.join(order, row, "left").drop(row)), key


def repeated_spans(docs: DataFrame, bucket_rows: int = 8_000, most: int = SPREAD) -> tuple[DataFrame, str, str]:
    """(doc_id, text) -> docs with spans (array of struct(s, e), unmerged; null if none) and whether the text is equal to an earlier one; and the names of these two columns."""
    docs, key = with_keys(docs)
    texts = docs.filter(F.col(key).isNotNull() & (F.octet_length("text") >= SIZE)).select(F.col(key).alias("doc"), F.encode("text", "UTF-8").alias("raw"))
    keyed = materialize(texts.select("doc", F.unhex(F.sha2("raw", 256)).alias("d")))
    least = materialize(keyed.groupBy("d").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    copies = materialize(join_small(keyed, least, "d", "inner").filter("doc != least").select("doc"))
    runs = join_small(texts, copies, "doc", "left_anti").mapInArrow(find_runs, RUN)
    runs = runs.repartition(F.when(F.col("at") < 0, F.xxhash64("doc", "at")).otherwise(F.col("h"))).sortWithinPartitions("h")
    asked = runs.mapInArrow(with_company, RUN).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("x"))
    cuts = texts.join(materialize(asked.select("doc", F.col("x.h").alias("hs"), F.col("x.at").alias("ats"))), "doc").select("doc", "raw", "hs", "ats").mapInArrow(cut_runs, CUT)
    found = materialize(cuts.repartition("k").sortWithinPartitions("k", "run", "doc", "s").mapInArrow(fold_equal, FOUND))
    left = found.filter("run is not null")
    crowded = materialize(left.groupBy("h").count().filter(F.col("count") > most).select("h"))
    total = left.count()
    few = join_small(left, crowded, "h", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(total // bucket_rows + 1)))
    spans = found.filter("run is null").select("doc", "s", "e").union(few.groupBy("bucket").applyInArrow(sort_runs, "doc long, s int, e int"))
    if not crowded.isEmpty():
        windows = join_small(left, crowded, "h", "left_semi").select(*left.columns).mapInArrow(cut_windows, CUT)
        spans = spans.union(windows.repartition("k").sortWithinPartitions("k", "run", "doc", "s").mapInArrow(fold_equal, FOUND).filter("run is null").select("doc", "s", "e"))
    every = spans.select("doc", F.struct("s", "e").alias("span"), F.lit(False).alias("copy")).union(copies.select("doc", F.lit(None).cast("struct<s:int,e:int>"), F.lit(True)))
    names = spare(docs.columns, "_spans"), spare(docs.columns, "_copy"), spare(docs.columns, "_doc")
    by_doc = materialize(every.groupBy(F.col("doc").alias(names[2])).agg(F.collect_list("span").alias(names[0]), F.max("copy").alias(names[1])))
    return docs.join(by_doc, docs[key] == by_doc[names[2]], "left").drop(key, names[2]), names[0], names[1]


def text_spans(text, spans, copy) -> tuple[bytes, list[tuple[int, int]]]:
    raw = (text or "").encode()
    if copy:
        return raw, [(0, len(raw))] if len(raw) >= SIZE else []
    if not spans:
        return raw, []
    return raw, merged(np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans]))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the bounds of characters."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from text (whole characters) and n_chars made anew if there is one."""
    marked, spans, copy = repeated_spans(docs)

    @F.pandas_udf("string")
    def clean(text, spans, copy):
        import pandas as pd

        out = []
        for t, s, c in zip(text, spans, copy):
            raw, found = text_spans(t, None if s is None else list(s), c is True or c == True)  # noqa: E712
            out.append(t if not found else kept_bytes(raw, whole_characters(raw, found)).decode())
        return pd.Series(out)

    out = marked.withColumn("text", clean("text", spans, copy))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    marked, spans, copy = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches):
        for b in batches:
            rows = []
            for doc, *x in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw, found = text_spans(*x)
                rows.append((doc, len(raw), sum(e - s for s, e in found), len(found), hashlib.sha256(kept_bytes(raw, found)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("doc_id", "text", spans, copy).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
