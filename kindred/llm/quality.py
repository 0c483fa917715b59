"""Operator 5, host-level quality rules, in DataFrame functions only.

A document fails by its own rules (too few words, too much repetition). Failures are added up by host; a host's rate is shrunk to
a beta prior that is fitted to all hosts' rates, so that small hosts are judged by what hosts are like; documents of a host whose
shrunk rate is above the bound are rejected with it. The same goes for each rule alone in ``host_rates``.

Null text counts as no words; a null host is a host; repeated rows each count. Texts of any length are read whole (the work grows
with the words' sort). Ties have no say: rates are compared with a bound, which is itself allowed. An empty table gives an empty
result. Columns with clashing names are kept apart by ``judged``, which carries the whole row in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.store import join_small, materialize

SPACE = " \t\n\x0b\f\r"


def document_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. Repeated windows: sort (hash, place) of each 8-word window, keep those beside an equal hash, then add up the places that they cover."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    out = docs.withColumns({
        "_w": words, "_l": lines,
        "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.expr("case when size(_w) < 9 then cast(array() as array<bigint>) else transform(sequence(1, size(_w) - 7), i -> xxhash64(slice(_w, i, 8))) end"),
    })
    spread = "sort_array(transform(_h, (h, i) -> struct(h as h, i as i)))"
    # neighbours are compared by zipping the sorted array with itself moved by one place
    out = out.withColumn("_s", F.expr(f"case when size(array_distinct(_h)) = size(_h) then cast(array() as array<struct<h:bigint,i:int>>) else {spread} end"))
    out = out.withColumn("_p", F.expr("""sort_array(array_distinct(flatten(zip_with(slice(_s, 1, greatest(size(_s) - 1, 0)), slice(_s, 2, greatest(size(_s) - 1, 0)),
        (a, b) -> case when a.h = b.h then array(a.i, b.i) else cast(array() as array<int>) end))))"""))
    out = out.withColumn("n_repeat_words", F.expr("""case when size(_p) = 0 then 0L else 8L + aggregate(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> least(8, b - a)), 0L, (s, x) -> s + x) end"""))
    out = out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    return out.drop("_w", "_l", "_h", "_s", "_p")


def host_verdicts(stats: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """(host, n, n_failed, rate, host_ok): each host's failure rate shrunk to a beta prior, fitted to all hosts' rates by their mean and variance."""
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v")).select(
        "m", F.expr("case when v > 0 and m * (1 - m) > v then m * (1 - m) / v - 1 else 1D end").alias("strength"))
    rate = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "n_failed", rate.alias("rate"), (rate <= max_rate).alias("host_ok"))  # prior is one row


def host_rates(stats: DataFrame, host: str = "source") -> DataFrame:
    """(host, rule, n, n_failed, rate, host_ok) for each rule alone."""
    rules = {"too_few_words": F.col("n_words") < 20, "too_repetitive": 100 * F.col("n_repeat_words") > 30 * F.col("n_words")}
    out = None
    for name, failed in rules.items():
        part = host_verdicts(stats.select(F.col(host), failed.alias("base_failed")), host).select("host", F.lit(name).alias("rule"), "n", "n_failed", "rate", "host_ok")
        out = part if out is None else out.unionByName(part)
    return out


def judged(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(row, stats, kept): each row of ``docs`` as a struct, whatever its columns are called, its figures and the verdict."""
    stats = document_stats(docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(host).alias("source"))).select("row", "source", *COLUMNS)
    return apply_hosts(materialize(stats))


def apply_hosts(stats: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Adds ``kept``. ``stats`` should be materialized: it is read twice."""
    bad = materialize(host_verdicts(stats, host, max_rate).filter("not host_ok").select(F.col("host").alias("_host"), F.lit(True).alias("_bad")))
    return join_small(stats, bad, stats[host].eqNullSafe(bad["_host"]), "left").withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    stats = materialize(document_stats(docs).select("doc_id", "source", *COLUMNS))
    return apply_hosts(stats).select("doc_id", *COLUMNS, "kept")
