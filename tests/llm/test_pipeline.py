"""The pipeline against plain versions of its stages, and its stages on odd tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tallyfold.llm import langid, quality
from tallyfold.llm.queries import fold

D = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_run_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    weights = quality.fit(docs, labels.where(fold(3) != 1))
    good = docs.join(quality.score(docs, weights).where("score >= 0.5").select("doc_id"), "doc_id")
    scored = langid.predict(good, langid.fit(good.where(fold(4) != 2))).where(F.col("score") >= corpus_pipeline.LEAST_COSINE).select("doc_id")
    texts = {r.doc_id: r.text for r in good.join(scored, "doc_id").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in texts}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    kept = {i for i in texts if comp[i] == i}
    bench = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(b in texts[i] for b in bench)}
    rows = corpus_pipeline.run(spark, D).collect()
    assert {r.doc_id for r in rows} == clean
    size = {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.size
    assert all(size[i] == len(texts[i].split()) for i in clean)


def test_stages_keep_columns_on_odd_and_empty_tables(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "x " * 5000, "en", None, None), (2, "x " * 5000, "en", None, None)]):
        df = spark.createDataFrame(rows, cols)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, D)
            out.collect()
            assert name == "packing" or out.columns == df.columns


def test_language_stage_drops_noise_and_foreign_texts_and_keeps_clean_ones(spark):
    rnd = random.Random(5)
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id >= 0")
    noise = ["".join(rnd.choices("bcdfghjklmnpqrstvwxz ", k=300)) for _ in range(40)] + ["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(200)) for _ in range(40)]
    noise += ["Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(rows, allowMissingColumns=True), D).select("doc_id").collect()}
    clean = {r.doc_id for r in langid.predict(docs, langid.fit(docs.where(fold(4) != 2))).where(F.col("score") >= corpus_pipeline.LEAST_COSINE).select("doc_id").collect()}
    assert kept == clean


def test_letters_of_every_script_count():
    assert all((langid.letter_of(c) > 0) == chr(c).isalpha() for c in range(0x110000))
    assert langid.letter_of(ord("A")) == ord("a") and langid.letter_of(ord("Д")) == langid.letter_of(ord("д"))
