"""The pipeline, each stage against a brute-force version on the rows that the one before kept."""

import random
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from kindred.llm import pipeline, toxicity
from tests.llm.test_llm import brute_classes

COLUMNS = ["doc_id", "text", "source", "kept", "_key", "n_chars"]


def documents():
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("sun", "sea", "hill", "road", "tree", "lake", "moon") for b in ("", "s", "side", "ward", "let")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = line(60)
    rows = []
    for i in range(240):
        text = line(rng.randint(30, 80))
        if i % 6 == 0:
            text += " snurk blorg " + line(5)
        if i % 7 == 0:
            text = line(20) + " " + passage + " " + text
        rows.append([i, text, f"h{i % 5}"])
    for i in range(60):  # copies and near copies of one text
        words = rows[1][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append([300 + i, " ".join(words), "h1"])
    rows += [[400 + i, "too short", "bad"] for i in range(30)] + [[450, line(50), "bad"], [451, "word " * 60, "h2"]]
    rows += [[None, line(40), "h3"], [460, None, "h3"], [461, "", None], [5, rows[5][1], "h0"], [5, rows[5][1], "h0"], [470, "long " + line(30000), "h4"]]
    return [(*r, "x", 1, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('pipe')}"
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, _key int, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = [(r[0], int("snurk" in r[1])) for r in rows if r[0] is not None and r[0] < 120 and r[1]]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def base_failed(text):
    words = (text or "").split()
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(words) < 20 or 100 * len(again) > 30 * len(words)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = plain(docs)

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(base_failed(r[1]))
    rates = [sum(x) / len(x) for x in by.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    k = m * (1 - m) / v - 1 if v > 0 and m * (1 - m) > v else 1.0
    want = [r for r in rows if not base_failed(r[1]) and (sum(by[r[2]]) + m * k) / (len(by[r[2]]) + k) <= 0.5]
    docs = pipeline.quality_rules(spark, docs, folder)
    assert docs.columns == COLUMNS and plain(docs) == want and 0 < len(want) < len(rows) and not any(r[0] == 450 for r in want)

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows, want = want, [r for r in want if toxicity.chain_probabilities(toxicity.text_words(r[1]), model, {})[-1] < 0.5]
    docs = pipeline.toxic_documents(spark, docs, folder)
    assert docs.columns == COLUMNS and plain(docs) == want
    assert [r for r in rows if "snurk" not in r[1]] == want  # toxic documents caught, clean ones kept

    known = sorted({r for r in want if r[0] is not None})
    comp = brute_classes([r[1] for r in known])
    rows, want = want, sorted([r for i, r in enumerate(known) if comp[i] == i] + [r for r in want if r[0] is None], key=str)
    docs = pipeline.near_duplicates(spark, docs, folder)
    assert docs.columns == COLUMNS and plain(docs) == want and len(want) < len(rows) - 30

    seen, cut = set(), {}
    for r in sorted((r for r in want if r[0] is not None), key=lambda r: r[0]):
        raw, gone = r[1].encode(), set()
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone.update(range(s, s + 100))
            seen.add(raw[s : s + 100])
        cut[r[0]] = bytes(c for i, c in enumerate(raw) if i not in gone).decode()
    want = sorted(((r[0], cut.get(r[0], r[1]), *r[2:5], len(cut.get(r[0], r[1]))) for r in want), key=str)
    docs = pipeline.repeated_passages(spark, docs, folder)
    assert docs.columns == COLUMNS and plain(docs) == want

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokens = {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in want}
    pieces = defaultdict(int)
    for r in pipeline.packed(spark, docs, folder).collect():
        pieces[r.doc_id] += r.length
    assert pieces == tokens


def test_run(spark, folder):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    out = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    piece = lambda df: sorted((str(r.doc_id), r.start, r.length) for r in df.select("doc_id", "start", "length").groupBy("doc_id").sum("length").selectExpr("doc_id", "0 start", "`sum(length)` length").collect())
    assert piece(corpus_pipeline.run(spark, folder)) == piece(out)


def test_empty(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    assert pipeline.run(spark, out).count() == 0
