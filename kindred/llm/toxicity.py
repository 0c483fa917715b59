"""Operator 1, toxicity by a classifier chain.

Categories are predicted in order; each linear model also gets the earlier categories' probabilities, in training those predicted
out of fold. The labels tell toxic from clean only, so the first categories are learned kinds of toxic text: clusters of the
labelled toxic texts by the features that set toxic texts apart; the last category is toxic itself, which decides.
Training takes at most SAMPLE labelled rows of each class (least hashes of the id); the features are the words and word beginnings
that best tell the classes apart, counted and chosen in Spark, so that the driver gets at most 2 * SAMPLE rows of FEATURES numbers.
Scoring reads every whole text in parallel.

Null and empty texts are not toxic; repeated rows score alike; contradictory labels of one document both count; ties between
features go by their number. Labels without both classes (or an empty table) teach nothing: every probability is 0 and nothing is
toxic. Null labels and labels without a document are left out. Added columns take names that the table does not have.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.store import materialize, spare

SAMPLE, FEATURES, FOLDS, KINDS, LEAST = 2000, 1000, 5, 2, 3
CHAIN = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    return [xxhash.xxh32_intdigest(x.encode()) for x in {word, "4^" + word[:4], "5^" + word[:5]}]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by AdaGrad on the whole matrix; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, g2 = np.zeros(x.shape[1], np.float32), np.full(x.shape[1], 1e-6, np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / len(x) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def kinds_of(x: np.ndarray, n: int = KINDS, rounds: int = 20) -> np.ndarray:
    """Clusters of the rows by the cosine to the clusters' means; the first centre is the row nearest to the mean, each next the row farthest from those before."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[np.argmax(x @ x.mean(axis=0))]]
    while len(centres) < n:
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = np.argmax(x @ np.array(centres).T, axis=1)
        centres = [m / max(np.linalg.norm(m), 1e-9) for k in range(n) for m in ((x[label == k] if (label == k).any() else x).mean(axis=0),)]
    return label


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(id, toxic, f): the features of at most ``sample`` labelled texts of each class."""
    known = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    least = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(least[0].union(least[1]))  # at most 2 * sample rows
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id").select("id", "toxic", "text")

    def features(batches):
        for b in batches:
            found = [sorted({f for w in text_words(t) for f in word_features(w)}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "toxic", "f"])

    return materialize(rows.mapInArrow(features, f"id {dict(docs.dtypes)['doc_id']}, toxic int, f array<long>"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> dict:
    """The chain's features and models; no models where the labels lack a class."""
    rows = training_rows(docs, labels, sample)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"column": {}, "models": []}
    counts = rows.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    gap = F.col("bad") / n[1] - F.col("good") / n[0]
    best = counts.filter(F.col("bad") + F.col("good") >= LEAST).select("f", gap.alias("gap")).orderBy(F.desc(F.abs("gap") / F.sqrt((F.col("bad") + F.col("good") + 2) / (n[0] + n[1]))), "f").limit(most).collect()
    column = {r.f: i for i, r in enumerate(best)}
    chosen = F.array(*[F.lit(f).cast("long") for f in column]) if column else F.array().cast("array<long>")
    got = rows.select(F.col("id").cast("string").alias("id"), "toxic", F.array_intersect("f", chosen).alias("f")).collect()  # at most 2 * sample rows of at most ``most`` numbers
    got.sort(key=lambda r: (str(r.id), r.toxic, r.f))
    y = np.array([r.toxic for r in got], np.float32)
    x = np.zeros((len(got), len(best)), np.float32)
    for i, r in enumerate(got):
        x[i, [column[f] for f in r.f]] = 1
    bad = np.nonzero(y)[0]
    kind = np.full(len(got), -1)
    if column:
        kind[bad] = kinds_of(x[bad] * np.array([max(0.0, r.gap) for r in best], np.float32))
    fold = np.array([xxhash.xxh32_intdigest(str(r.id)) % FOLDS for r in got])
    models = []
    for c, name in enumerate(CHAIN):
        target = y if name == "toxic" else (kind == c).astype(np.float32)
        out = np.zeros(len(got), np.float32)
        for k in range(FOLDS):
            if (held := fold == k).any() and not held.all():
                out[held] = probability(x[held], fit_linear(x[~held], target[~held]))
        models.append(fit_linear(x, target))
        x = np.hstack([x, out[:, None]])
    return {"column": column, "models": models}


def chain_probabilities(found: set[str], model: dict, known: dict[str, list[int]]) -> list[float]:
    """Probability of each category in order; ``known`` keeps words' columns."""
    column, models = model["column"], model["models"]
    if not found or not models:
        return [0.0] * len(CHAIN)
    at: set[int] = set()
    for w in found:
        f = known.get(w)
        if f is None:
            f = known[w] = [column[x] for x in word_features(w) if x in column]
        at.update(f)
    base, ps = sorted(at), []
    for m in models:
        z = m[base].sum() + m[-1] + sum(p * m[len(column) + i] for i, p in enumerate(ps))
        ps.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return ps


def score(docs: DataFrame, model: dict, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of p_<category> and is_toxic, and its name."""
    known: dict[str, list[int]] = {}
    names = [f"p_{c}" for c in CHAIN]

    @F.pandas_udf(", ".join(f"{n} double" for n in names) + ", is_toxic boolean")
    def chain(text):
        import pandas as pd

        if len(known) > 300_000:
            known.clear()
        rows = [chain_probabilities(text_words(t), model, known) for t in text]
        return pd.DataFrame([[*r, r[-1] >= 0.5] for r in rows], columns=[*names, "is_toxic"])

    name = spare(docs.columns, "_chain")
    return docs.withColumn(name, chain(text)), name


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, name = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", f"{name}.*")
