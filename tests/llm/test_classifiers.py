import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from setlight.llm import quality, toxicity

DOCS = "doc_id long, text string, held_out string"


def corpus(spark, n=400):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "garden", "window", "yellow", "paper", "music", "winter", "letter", "harbor"]
    rows, labels = [], []
    for i in range(n):
        t = [str(x) for x in rng.choice(words, 40)]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            t = [x + "%%%" for x in t]
        if toxic:
            for j in rng.integers(0, 40, 3):
                t[j] = ["zworp", "zworpin", "gralk"][int(j) % 3]
        rows.append((i, " ".join(t), "clash"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(None, "river stone", None), (n, None, None), (n + 1, "", None), (n + 1, "", None), (n + 2, "x" * 200_000, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def folds(rows):
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1


def accuracy(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality(spark):
    docs, labels = corpus(spark)
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    folds(rows)
    assert accuracy(rows, labels, "quality") >= 0.95


def test_quality_without_labels(spark):
    docs, labels = corpus(spark, 8)
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score_quality(docs.where("false"), labels).count() == 0


def test_discriminant_equals_the_density_formula():
    rng = np.random.default_rng(1)
    x = {k: rng.normal(k, 1 + k, (200, quality.N_STATS)) for k in (0, 1)}
    model = quality.Discriminant({k: (200, v.sum(0), v.T @ v) for k, v in x.items()}, 0.0, 0.0)
    a = quality.N_STATS / (200 + quality.N_STATS)
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (cov[0] + cov[1]) / 2

    def log_density(k, p):
        c = (1 - a) * cov[k] + a * pooled
        d = p - x[k].mean(0)
        return -0.5 * d @ np.linalg.solve(c, d) - 0.5 * np.linalg.slogdet(c)[1]

    for p in (*x[0][:5], *x[1][:5]):
        assert model.score(p[None])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(log_density(1, p) - log_density(0, p), -30, 30))), abs=1e-9)


def test_toxicity(spark):
    docs, labels = corpus(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and "text" in rows[0].__fields__
    folds(rows)
    assert accuracy(rows, labels, "toxic") >= 0.95


def test_disguised_words_are_restored(spark):
    docs, labels = corpus(spark)
    hidden = spark.createDataFrame([(10_000 + i, f"river stone garden {w} paper music winter letter", None) for i, w in enumerate(["zw0rp", "grrraaaalk", "g.r.a.l.k", "z w o r p", "gr4lk"])], DOCS)
    rows = toxicity.score_toxicity(docs.unionByName(hidden), labels).where("doc_id >= 10000").collect()
    assert [r.predicted for r in rows] == [1] * 5


@pytest.mark.parametrize(
    ("written", "meant"),
    [("carg0", "cargo"), ("gr055", "gross"), ("gla55", "glass"), ("!con", "icon"), ("'!con',", "icon"), ("(argo", "cargo"), ("gla$$", "glass"), ("carrgo", "cargo"), ("c  a  r  g  o", "cargo"), ("c--a--r--g--o", "cargo"), ("c - a - r - g - o", "cargo")],
)
def test_every_disguise_reaches_the_lattice(written, meant):
    counts = np.zeros(toxicity.CELLS)
    np.add.at(counts, toxicity.gram_codes("the cargo was gross and an icon of glass stood there " * 200), 1)
    restorer = toxicity.Restorer(toxicity.log_model(counts))
    assert meant in restorer.words(f"there {written} stood")
    assert "stood" in restorer.words("it (stood!!!)")


def test_viterbi_equals_enumeration():
    counts = np.zeros(toxicity.CELLS)
    np.add.at(counts, toxicity.gram_codes("the cargo was gross and an icon of glass stood there; bottle, balloon and coffee " * 50), 1)
    model = toxicity.log_model(counts)

    def score(path):
        state, total = 0, sum(channel for _, channel in path)
        for ch in "".join(text for text, _ in path) + " ":
            code = state << toxicity.BITS | toxicity.fold(ch)
            total += model[code]
            state = code & toxicity.STATE
        return total

    for token in ("gr055", "c.a.r.g.o", "gla$$", "b0tttle", "c0ff33", "ba11oon", "!c0n", "a11", "1i1i"):
        paths = list(itertools.product(*toxicity.lattice(token)))
        best = max(map(score, paths))
        found = toxicity.restore(token, model)
        assert found in {"".join(t for t, _ in p).strip() for p in paths if score(p) > best - 1e-4}


def test_columns_of_the_same_names(spark):
    docs, labels = corpus(spark, 40)
    rows = toxicity.score_toxicity(docs.withColumn("fold", F.lit("mine")).withColumn("Score", F.lit(-5.0)), labels).collect()
    assert all(r.fold == "mine" and 0 <= r.score <= 1 for r in rows)


def test_long_tokens_take_linear_time():
    token = "ab0" * 100_000
    assert len(toxicity.restore(token, toxicity.log_model(np.ones(toxicity.CELLS)))) == len(token)


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark, 8)
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0}
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_language_model_is_a_distribution():
    counts = np.random.default_rng(2).integers(0, 5, toxicity.CELLS).astype(float)
    p = np.exp(toxicity.log_model(counts).astype(float)).reshape(-1, 32)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def plain_log_odds(rows, words_of):
    """key -> weight, from (text, label) rows."""
    seen, sizes = {0: Counter(), 1: Counter()}, Counter(label for _, label in rows)
    for text, label in rows:
        seen[label].update({k for w in words_of(text) for k in toxicity.keys_of(w)})
    out = {}
    for key, t in seen[1].items():
        c = seen[0][key]
        odds = math.log((t + 0.5) / (c + 0.5)) - math.log((sizes[1] + 1) / (sizes[0] + 1))
        bound = odds - 1.3 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= 2 and bound > 0.7:
            out[key] = bound
    return out


def test_toxicity_equals_a_plain_version(spark):
    docs, labels = corpus(spark, 200)
    extra = [(1000 + i, f"River {w} stone\tgarden", None) for i, w in enumerate(["zw0rp", "g.r.a.l.k", "z w o r p", "Ünïcode жук", "a!", "gralk"])]
    copies = [(2000 + r.doc_id, r.text, None) for r in docs.where("doc_id < 40").collect()]  # labelled copies count once
    docs = docs.unionByName(spark.createDataFrame(extra + copies, DOCS))
    labels = labels.unionByName(labels.where("doc_id < 40").selectExpr("doc_id + 2000 as doc_id", "quality", "toxic"))
    all_docs = [(r.doc_id, r.text) for r in docs.collect()]

    grams = Counter()
    for _, text in all_docs:
        if text:
            symbols = [toxicity.BLANK] * 3 + [toxicity.fold(ch) for ch in text] + [toxicity.BLANK]
            grams.update(tuple(symbols[i : i + toxicity.ORDER]) for i in range(len(symbols) - toxicity.ORDER + 1))
    counts = np.zeros((1 << toxicity.BITS,) * toxicity.ORDER)
    for gram, n in grams.items():
        counts[gram] = n
    assert np.array_equal(toxicity.count_grams(docs)[np.flatnonzero(counts.ravel())], counts.ravel()[counts.ravel() > 0])

    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    first = {}
    for doc_id, text in all_docs:
        if doc_id in toxic and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            key = (text, toxic[doc_id])
            first[key] = min(first.get(key, doc_id), doc_id)
    part = {True: [], False: []}
    for (text, label), doc_id in first.items():
        part[zlib.crc32(str(doc_id).encode()) % 4 == 3].append((text, label))

    log_p = toxicity.log_model(counts.ravel())
    words_of = toxicity.Restorer(log_p).words
    lexicon = plain_log_odds(part[False], words_of)
    model = toxicity.Model(docs, labels, 40_000)
    assert np.allclose(model.grams.value, log_p)
    assert model.lexicon.value == pytest.approx(lexicon) and "zworp" in lexicon and "river" not in lexicon

    def weigh(text):
        words = words_of(text)
        best = sorted((max(lexicon.get(k, 0.0) for k in toxicity.keys_of(w)) for w in words), reverse=True) + [0.0, 0.0]
        strong = len([w for w in best if w > 2.5])
        return [best[0], best[1], math.log(1 + strong), strong / math.sqrt(10 + len(words)), 1.0]

    x = np.array([weigh(text) for text, _ in part[True]])
    y = np.array([label for _, label in part[True]])
    slope = x.T @ (1 / (1 + np.exp(-x @ model.weights)) - y) + 0.05 * model.weights
    assert np.abs(slope).max() < 1e-6  # the only minimum of a strictly convex loss
    want = sorted((str(d), 1 / (1 + math.exp(-float(np.array(weigh(t)) @ model.weights)))) for d, t in all_docs)
    got = sorted((str(r.doc_id), r.score) for r in toxicity.score_toxicity(docs, labels).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)
