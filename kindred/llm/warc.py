"""Operator 6, WARC archives written by Spark and read back by boundary-chain verification.

Writing: one record a row, through Spark's text writer, so any store works. Of pages with equal payloads the largest page_id
holds the payload; the others are revisit records. Repeated rows are records each; those of the largest page_id are all responses.
Pages of one page_id and different payloads stay apart. Null html is an empty payload; null urls are written as empty; a null
page_id is written as a record without a number and read back as null, never as a revisit or the target of one. Payloads of any
length are one record. Columns but page_id, url and html are not written. An empty table gives files without records.
Reading: tasks scan splits for the record magic and emit candidates (offset, successor); pointer jumping from each file's start
retains reachable ones, so a magic inside a payload, even with a whole record around it, is rejected. Payloads cut by such a
magic are put together again from their pieces, for these records alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.plans.store import join_small, materialize, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"


def base32(hexa):
    """Upper-case base32 of 40 hex digits: five of them at a time are four characters."""
    parts = [F.lpad(F.conv(F.substring(hexa, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, least: int = 0, records_per_file: int = 20_000) -> None:
    """(page_id, url, html) -> files of WARC records below ``path``; payloads of fewer than ``least`` bytes are never revisited."""
    pages = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = materialize(pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("d"), F.octet_length("html").alias("n")).filter(F.col("n") >= least))
    last = keyed.groupBy("d", "n").agg(F.max("page_id").alias("to"), F.count("*").alias("c")).filter("c > 1")
    revisits = materialize(join_small(keyed, materialize(last), ["d", "n"], "inner").filter("page_id < to").select("page_id", "d", "n", "to").distinct())
    p = join_small(pages.withColumns({"d": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")}), revisits, ["page_id", "d", "n"], "left")
    again = F.col("to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.octet_length("html"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("d")),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END), http)
    p.select(F.concat(head, F.when(again, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


HEAD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")


def parse(record: bytes) -> dict | None:
    """A record after its magic. None: no header. ``size``: its bytes, magic and end included."""
    at = record.find(b"\r\n\r\n")
    if at < 0:
        return None
    fields = {k.lower(): v for k, v in HEAD.findall(record[: at + 2])}
    if not re.fullmatch(rb"\d{1,18}", fields.get(b"content-length", b"")):
        return None
    n = int(fields[b"content-length"])
    out = {"size": len(MAGIC) + at + 4 + n + 4, "type": fields.get(b"warc-type", b"").decode("utf-8", "replace")}
    out["whole"] = out["size"] == len(MAGIC) + len(record) and record.endswith(b"\r\n\r\n")
    block = record[at + 4 : at + 4 + n]
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4 :] if block.startswith(b"HTTP/") and cut >= 0 else block
    number = lambda name: int(m[1]) if (m := re.search(rb"urn:page:(-?\d+)", fields.get(name, b""))) else None
    out |= {"page_id": number(b"warc-record-id"), "refers_to": number(b"warc-refers-to")}
    told = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    length = re.search(rb"\r\nContent-Length: (\d+)\r\n", block[: cut + 2])
    if out["type"] == "revisit":
        out |= {"bytes": int(length[1]) if length else None, "digest": told}
    else:
        out |= {"bytes": len(payload), "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
    return out


FIELDS = "page_id long, bytes long, digest string, type string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, bytes, digest, type, refers_to of every reachable record below ``path``."""
    m = len(MAGIC)
    scan = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def candidates(batches):
        last, place, number = None, 0, 0
        for b in batches:
            rows: list[tuple] = []
            for file, block, value in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (file, block) != last:
                    last, place, number = (file, block), 0, 0
                r = parse(value) or {"size": -1, "whole": False}
                rows.append((file, block, number, place, len(value), r["size"], r["whole"], *(r.get(k) if r["whole"] else None for k in ("page_id", "bytes", "digest", "type", "refers_to"))))
                place, number = place + len(value) + m, number + 1
            names = ["file", "block", "number", "place", "n", "size", "whole", "page_id", "bytes", "digest", "type", "refers_to"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    seen = materialize(scan.mapInArrow(candidates, "file string, block long, number long, place long, n long, size long, whole boolean, " + FIELDS))
    blocks = seen.groupBy("file", "block").agg((F.sum("n") + m * F.count("*")).alias("bytes_here"))
    later = blocks.select("file", F.col("block").alias("b2"), F.col("bytes_here").alias("before"))
    starts = blocks.join(later, "file", "left").groupBy("file", "block").agg(F.sum(F.when(F.col("b2") < F.col("block"), F.col("before")).otherwise(0)).alias("base"))
    # a piece's text begins after its magic; the piece before any magic, at a file's start, is empty
    cand = materialize(seen.join(starts, ["file", "block"]).withColumn("off", F.col("base") + F.col("place") - m))
    nodes = cand.filter("off >= 0 and size > 0").select("file", "off", (F.col("off") + F.col("size")).alias("next"), (F.col("off") == 0).alias("reached"))
    nodes = materialize(nodes)
    most = nodes.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, most).bit_length()):
        jump = nodes.select("file", F.col("off").alias("next"), F.col("next").alias("next2"))
        hit = nodes.filter("reached").select("file", F.col("next").alias("off")).distinct().withColumn("hit", F.lit(True))
        nodes = nodes.join(jump, ["file", "next"], "left").select("file", "off", F.coalesce("next2", "next").alias("next"), "reached")
        nodes = materialize(nodes.join(hit, ["file", "off"], "left").select("file", "off", "next", (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")))
    kept = materialize(cand.join(nodes.filter("reached").select("file", "off"), ["file", "off"]))
    whole = kept.filter("whole")
    names = ["page_id", "bytes", "digest", "type", "refers_to"]
    if kept.filter("not whole").limit(1).count() == 0:
        return whole.select(*names)
    spans = kept.filter("not whole").select("file", "off", F.col("off").alias("owner"), (F.col("off") + F.col("size")).alias("stop"))
    before = W.partitionBy("file").orderBy("off")  # places only, no payloads; the last mended record before a piece is its owner if it reaches so far
    told = cand.select("file", "block", "number", "off").join(spans, ["file", "off"], "left")
    told = told.withColumns({c: F.last(c, True).over(before) for c in ("owner", "stop")})
    pieces = materialize(told.filter("off < stop").select("file", "block", "number", "off", "owner"))

    def numbered(batches):
        last, number = None, 0
        for b in batches:
            at = []
            for file, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                number = number + 1 if (file, block) == last else 0
                last = (file, block)
                at.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["file", "block", "value", "number"])

    again = scan.mapInArrow(numbered, "file string, block long, value binary, number long").join(pieces, ["file", "block", "number"])

    def mend(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("off").to_pylist(), table.column("value").to_pylist()))
        r = parse(MAGIC.encode().join(v for _, v in rows)) or {}
        return pa.table({k: pa.array([r.get(k)], pa.string() if k in ("digest", "type") else pa.int64()) for k in names})

    return whole.select(*names).unionByName(again.groupBy("file", "owner").applyInArrow(mend, FIELDS))


def op6(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/kindred/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
