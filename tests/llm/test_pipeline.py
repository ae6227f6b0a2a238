import random

import corpus_pipeline
from pyspark.sql import functions as F

from setlight.llm import mixing, toxicity
from setlight.llm.common import cut
from tests.llm.test_text_operators import LONG, plain_components, plain_line_dedup


def write(spark, folder):
    rng = random.Random(8)
    words = ["river", "stone", "garden", "window", "yellow", "paper", "music", "winter", "letter", "harbor", *(f"v{i}" for i in range(200))]
    docs, labels = [], []
    for i in range(240):
        t = [rng.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            t[rng.randrange(60)] = "zworp"
            t[rng.randrange(60)] = "gralk"
        text = " ".join(t)
        if i % 6 == 1:
            text += "\n" + LONG[0]
        docs.append((i, text, "en", "s0" if i % 3 else f"s{i % 7}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[1 + 2 * i][1] + " tail", "en", "s1", 10) for i in range(10)]
    item = " ".join(rng.choice(words) for _ in range(20))
    docs += [(400, "begin " * 10 + item + " end", "en", "s2", 1), (401, None, None, None, None), (402, "", "en", "s2", 0), (None, "no id here", "en", "s3", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    folder = f"file://{tmp_path}"
    item = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = [(r.doc_id, r.text) for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()]
    assert {r.doc_id for r in labels.where("toxic = 0").collect()} <= {d for d, _ in clean}
    lines = [(None if d == "None" else int(d), t) for d, _, _, t in plain_line_dedup(clean)]
    heads = {c for _, _, c in plain_components(lines)} | {"None"}
    kept = [(d, t) for d, t in lines if d is None or str(d) in heads]
    kept = [(d, t) for d, t in kept if item not in t]
    got = corpus_pipeline.run(spark, folder).collect()
    assert {str(r.doc_id) for r in got} == {str(d) for d, _ in kept}
    tokens = {str(d): len(t.split()) for d, t in kept}
    assert all(r.tokens == tokens[str(r.doc_id)] for r in got)


def test_stages_keep_the_columns_and_what_is_in_them(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder)
    own = ["score", "predicted", "held_out", "kept", "n_lines", "N_dropped", "_id", "row_id", "fold", "dedup_drop", "h1", "label", "own_score"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(f"{c}!") for c in own})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        assert docs.where(" or ".join(f"{c} <> '{c}!' or {c} is null" for c in own)).count() == 0
    assert docs.count() > 100


def test_null_and_unchanged_texts_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 7), (2, "a b", 9)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {1: (None, 7), 2: ("a b", 9)}


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_pipeline_keeps_what_was_planted_clean_in_reading_order(spark, tmp_path):
    folder = f"file://{tmp_path}"
    item = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    clean = [(d, r.text) for d, r in rows.items() if d not in toxic]
    lines = {d: t for d, _, _, t in plain_line_dedup(clean)}
    heads = {str(c) for _, _, c in plain_components([(None if d == "None" else int(d), t) for d, t in lines.items()])} | {"None"}
    kept = [d for d in lines if d in heads and item not in lines[d]]
    left = [(rows[None if d == "None" else int(d)], lines[d]) for d in kept]
    frame = spark.createDataFrame([(r.doc_id, r.text and t, r.lang, r.source, len(t)) for r, t in left], docs.schema)  # null texts stay null
    places = [c for c in mixing.mix(frame).columns if c not in docs.columns]
    listed = lambda out: sorted(map(str, out.select("doc_id", "source", *places).collect()))
    assert len(places) >= 3
    assert listed(corpus_pipeline.run(spark, folder)) == listed(mixing.mix(frame))
