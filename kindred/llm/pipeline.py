"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its decisions take effect. Null texts have
no words, so the quality rules reject them, as they do empty ones. Rows with a null doc_id are judged like others by the first two
stages, take no part in the two deduplications (they stay as they are) and are packed. Of repeated rows (one doc_id, one text) one
stays after the near-duplicates. Columns of any name pass through all stages but the last. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import packing, quality, similar, suffixes, toxicity
from kindred.plans.store import shared_dir, spare

#: Not expressible in SQL: a trained model, packing. tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs).filter("kept").select("row.*")


def toxic_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, name = toxicity.score(docs, model)
    return out.filter(~F.col(f"{name}.is_toxic")).select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; of its repeated rows one."""
    known = docs.filter("doc_id is not null")
    classes = similar.near_copies(known)
    name = spare(docs.columns, "_kept")
    keep = classes.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    out = known.join(keep, known.doc_id == F.col(name), "left_semi")
    if not known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(docs)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack(docs, P.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic_documents), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("packing", packed)]


def run(spark, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, spark.read.parquet(path), sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/kindred/pipeline-{uuid.uuid4().hex}"
        out.write.parquet(path)
    raise AssertionError
