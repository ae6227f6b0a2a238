import hashlib
import math
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from setlight.llm import common, decontam, jaccard, licenses, line_dedup, mixing

LONG = [f"This repeated line number {i} is long enough to be a key." for i in range(4)]


def line_docs(seed=1, n=60):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lines = [rng.choice(LONG) if rng.random() < 0.4 else f"own {i} {j}" * 5 for j in range(rng.randrange(8))]
        docs.append((i * 3, "\n".join(f" {x.upper()}\t" if rng.random() < 0.3 else x for x in lines)))
    return [*docs, (None, LONG[0]), (500, None), (501, ""), (7, LONG[1] + "\n" + LONG[1]), (7, LONG[1] + "\n" + LONG[1]), (502, "\n" * 5), (503, "ä" * 40 + "\n" + LONG[2] * 3000)]


def plain_line_dedup(docs, least=40, at_least=5):
    def keys(text):
        return [k if len(k := x.strip(line_dedup.STRIP)) >= least else None for x in (text or "").split("\n")]

    fold = lambda k: k and k.encode().lower()
    holders = defaultdict(list)
    for doc_id, text in docs:
        for k in {fold(k) for k in keys(text) if k}:
            holders[k].append(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        gone = [k is not None and len(holders[fold(k)]) >= at_least and (doc_id is None or doc_id != max(h for h in holders[fold(k)] if h is not None)) for k in keys(text)]
        out.append((str(doc_id), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(spark, batches):
    docs = line_docs()
    frame = spark.createDataFrame([(*d, "old", 1) for d in docs], "doc_id long, text string, kept string, n_lines int")
    got = line_dedup.dedup_lines(frame, batches=batches).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == plain_line_dedup(docs)
    assert line_dedup.dedup_lines(frame.where("false")).count() == 0


def test_line_runs_compact(spark):
    store = line_dedup.LineRuns(spark, least=1, fanout=2)
    for i in range(5):
        store.add(spark.createDataFrame([(100 - i, f"a\nb{i}")], "doc_id long, text string"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sorted((r.n, r.holder) for r in store.merged().collect()) == [(1, 96), (1, 97), (1, 98), (1, 99), (1, 100), (5, 100)]


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if d is not None else None)) for i, (d, _) in enumerate(docs))


def near_docs(seed, families=6, copies=12, words=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in", *(f"w{i}" for i in range(40))]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    docs = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, words))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t += passage
            docs.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in t))
    rng.shuffle(docs)
    rows = [(i, t) for i, t in enumerate(docs)]
    return [*rows, (None, docs[0]), (900, None), (901, " \n"), (902, "one two"), (903, "ONE  two"), (904, docs[3]), (904, docs[3]), (905, "é ü é ü é ü"), (906, " ".join(f"u{i}" for i in range(30_000)))]


@pytest.mark.parametrize(("seed", "leaf", "rare", "most_keys"), [(1, 12, 24, 10**6), (2, 4, 3, 10**6), (3, 8, 1, 0), (4, 3, 100, 10**6), (6, 4, 2, 40)])
def test_jaccard_components(spark, monkeypatch, seed, leaf, rare, most_keys):
    monkeypatch.setattr(common, "HEAVY", 50)
    docs = near_docs(seed)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, dg int")
    got = jaccard.jaccard_components(frame, leaf=leaf, block=2 * leaf, pivots=2, levels=1, rare=rare, most_keys=most_keys).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(docs)


def test_one_of_each(spark):
    docs = near_docs(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = [r.doc_id for r in jaccard.one_of_each(frame).collect()]
    wanted = [d for d, _, c in set(plain_components(docs)) if d == c]
    assert sorted(map(str, kept)) == sorted(wanted)
    assert jaccard.one_of_each(frame.where("false")).count() == 0


def test_one_of_each_judges_rows_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "k"), (7, a, "k"), (7, b, "k"), (8, c, "k"), (8, c + " end", "k"), (9, c, "k"), (10, b.upper(), "k"), (11, "", "k"), (11, "", "k"), (None, a, "k"), (12, a, "k"), (12, a, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    kept = jaccard.one_of_each(frame.withColumnsRenamed({"_id": "row_id"}).withColumn("ROW_fp", F.lit(1)).withColumn("_id", F.lit("own"))).collect()
    assert {r.row_id for r in kept} == {"k"} and {r._id for r in kept} == {"own"}
    got = sorted((str(r.doc_id), r.text) for r in kept if r.doc_id != 8)
    assert got == sorted([("1", a), ("7", b), ("11", ""), ("11", ""), ("None", a)])
    assert sum(r.doc_id == 8 for r in kept) == 1


def test_ordinary_regions_meet_pivots(spark, monkeypatch):
    met, place = [], jaccard.voronoi
    monkeypatch.setattr(jaccard, "voronoi", lambda *x: met.append(x) or place(*x))
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*base[:i], "other", *base[i + 1 : 70 + i % 10]])) for i in range(60)]
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(docs) and met


def test_bounds_are_safe():
    rng = random.Random(0)
    b = jaccard.Bounds(75)
    for _ in range(3000):
        n = rng.randrange(1, 60)
        x = set(rng.sample(range(10_000), n))
        y = set(x)
        for e in rng.sample(sorted(x), min(n, rng.randrange(0, n // 3 + 2))):
            y.discard(e)
        y |= set(rng.sample(range(10_000, 20_000), rng.randrange(0, n // 3 + 2)))
        if y and 100 * len(x & y) >= 75 * len(x | y):
            common = set(sorted(x)[: b.sample(len(x))]) & set(sorted(y)[: b.sample(len(y))])
            assert len(common) >= max(b.need(len(x)), b.need(len(y)))


def test_need_as_a_column(spark):
    for percent in (75, 90):
        b = jaccard.Bounds(percent)
        assert all(r.need == b.need(r.id) for r in spark.range(1, 500).withColumn("need", b.need_column(F.col("id"))).collect())


def bench_docs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(30)]
    docs = []
    for i in range(40):
        t = [word() for _ in range(rng.randrange(1, 400))]
        if i % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = items[i % 30][1].upper().split()
        docs.append((i, " ".join(t)))
    return items, [*docs, (None, items[1][1]), (77, None), (78, ""), (79, "\n".join(x for _, x in items) + " z" * 50_000)]


@pytest.mark.parametrize("shard", [10**6, 300])
def test_decontamination(spark, shard):
    items, docs = bench_docs()
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    found = {(str(r.doc_id), r.item_id) for r in decontam.contaminated(frame, benchmark, shard_chars=shard).collect()}
    wanted = {(str(d), i) for d, t in docs for i, x in items if x.lower() in (t or "").lower().replace("\n", " ")}
    assert found == wanted
    kept = decontam.decontaminate(frame, benchmark, shard_chars=shard)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if str(d) not in {a for a, _ in wanted})
    assert decontam.contaminated(frame, benchmark.where("false")).count() == 0


def plain_bm25(items, docs, threshold, question, answer, gram=3, k1=1.2, b=0.75):
    """All items against all passages, without an index."""
    words = {i: w for i, t in items if (w := decontam.words_of(t))}
    df, average, longest = Counter(t for w in words.values() for t in set(w)), sum(map(len, words.values())) / len(words), max(map(len, words.values()))
    weight = {i: {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(w) / average)) for t, n in Counter(w).items()} for i, w in words.items()}
    out = {}
    for doc_id, text in docs:
        said = decontam.words_of(text)
        for start in range(0, max(1, len(said) - longest), longest) if said else []:
            passage = said[start : start + 2 * longest]
            for i, w in words.items():
                score = sum(x for t, x in weight[i].items() if t in set(passage)) / sum(weight[i].values())
                split = max(1, 2 * len(w) // 3)
                share = [1.0 if not (g := decontam.grams(part, gram)) else len(g & decontam.grams(passage, len(next(iter(g))))) / len(g) for part in (w[:split], w[split:])]
                if score > 0 and score >= threshold and share[0] >= question and share[1] >= answer:
                    old = out.get((str(doc_id), i), (0, 0, 0, 0))
                    out[(str(doc_id), i)] = (max(old[0], score), max(old[1], share[0]), max(old[2], share[1]), old[3] + 1)
    return {k: (round(v[0], 9), round(v[1], 9), round(v[2], 9), v[3]) for k, v in out.items()}


@pytest.mark.parametrize(("threshold", "question", "answer", "shard"), [(0.5, 0.5, 0.5, 10**6), (0.3, 0.2, 0.0, 900), (0.25, 0.0, 0.0, 10**6), (0.7, 0.6, 0.9, 400)])
def test_decontamination_equals_plain_bm25(spark, threshold, question, answer, shard):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    docs = []
    for i in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        leak = [x if rng.random() < 0.8 else "changed" for x in items[i % 40][1].split()]  # part of an item
        at = rng.randrange(len(t) + 1)
        docs.append((i, " ".join(t[:at] + leak[: rng.randrange(len(leak) + 1)] + t[at:])))
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold, question, answer, shard_chars=shard).collect()
    got = {(str(r.doc_id), r.item_id): (round(r.bm25, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9), r.passages) for r in rows}
    assert got and got == plain_bm25(items, docs, threshold, question, answer)


def test_block_bounds_hold():
    items, _ = bench_docs()
    index = decontam.ItemIndex(items, 3)
    assert index.maxima.sum() > 0
    for k, posting in index.postings.items():
        for j, x in posting:
            assert index.maxima[k, j // decontam.BLOCK] >= x - 1e-6


def test_decontamination_is_the_same_in_every_sharding(spark):
    items, docs = bench_docs()
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted((str(r.doc_id), r.item_id, round(r.bm25, 9), r.question_overlap, r.answer_overlap, r.passages) for r in decontam.contaminated(frame, benchmark, shard_chars=n).collect()) for n in (10**6, 700)]
    assert found[0] and found[0] == found[1]


def test_index_grows_with_its_postings():
    index = decontam.ItemIndex([(i, " ".join(f"w{i}x{k}" for k in range(25))) for i in range(4000)], 3)
    assert len(pickle.dumps(index)) < 20_000_000
    assert [x[0] for x in index.matches(" ".join(f"w7x{k}" for k in range(25)), 0.5, 0.5, 0.5)] == [7]


def license_docs():
    t = licenses.TEMPLATES
    return [
        (1, "hello " * 30 + t["mit"][0] + " bye " * 10), (2, "HELLO\n# " + "\n# ".join(t["gpl-3.0"][1].split())), (3, None), (4, "short text"), (5, "nothing at all " * 50),
        (6, t["bsd"][0].replace("binary forms", "odd forms")), (7, " ".join(t["mit"][1].split()[:6])), (None, t["cc-by-4.0"][0]), (8, t["apache-2.0"][0]), (8, t["apache-2.0"][0]), (9, "word " * 40_000 + t["mpl-2.0"][0]),
    ]


def test_license_scan(spark):
    rows = licenses.scan_licenses(spark.createDataFrame([(*d, "x") for d in license_docs()], "doc_id long, text string, license string")).collect()
    assert {(r.doc_id, r.license) for r in rows} == {(1, "mit"), (2, "gpl-3.0"), (None, "cc-by-4.0"), (8, "apache-2.0"), (9, "mpl-2.0")}
    assert len(rows) == len({(r.doc_id, r.license) for r in rows})
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_rarely_miss():
    for m in (1, 5, 20, 60):
        shared = -(-3 * m // 4)
        j0 = shared / (2 * m + licenses.stride(m) - shared)
        assert j0 >= 1 or (1 - j0) ** licenses.bands_for(m, 0.75, 1e-6) <= 1e-6


def mix_docs():
    rng = random.Random(9)
    return [(i, f"s{min(rng.randrange(12), 3)}" if i % 2 else "s9", " ".join("w" * rng.randrange(0, 30))) for i in range(600)] + [(None, "s1", "a b"), (700, None, "c d"), (701, "", "e"), (702, "void", None), (703, "s9", "x " * 20_000)]


@pytest.mark.parametrize("settings", [{}, {"budget": 20_000}, {"target_entropy": 1.2}, {"target_entropy": 1.2, "budget": 9_000}])
def test_mixing(spark, settings):
    docs = mix_docs()
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, source string, text string, tokens int")
    rows = mixing.mix(frame, **settings).collect()
    tokens = {(str(d), s or ""): len((t or "").split()) for d, s, t in docs}
    of = defaultdict(int)
    for (_, s), n in tokens.items():
        of[s] += n
    total = sum(of.values())
    share = {s: n / total for s, n in of.items() if n}
    import math

    def weights(e):
        z = sum(p**e for p in share.values())
        return {s: p**e / z for s, p in share.items()}

    def budgets(e):
        w = weights(e)
        if "budget" in settings:
            return {s: int(of[s] * (share[s] ** (e - 1) / sum(p**e for p in share.values()) * (settings["budget"] / total)) + 0.5) for s in share}
        least = min(share[s] ** (e - 1) for s in share)
        return {s: int(of[s] * (share[s] ** (e - 1) / least) + 0.5) for s in share}

    def too_even(e):
        w = weights(e)
        if "target_entropy" in settings:
            return -sum(x * math.log(x) for x in w.values()) > settings["target_entropy"]
        rate = {s: share[s] ** (e - 1) for s in share}
        most = max(rate.values()) / min(rate.values()) if "budget" not in settings else max(rate.values()) / sum(p**e for p in share.values()) * settings["budget"] / total
        return most > 2.0

    low, high = 0.0, 1.0
    if too_even(0.0):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if too_even(mid) else (low, mid)
    else:
        high = 0.0
    wanted = budgets(high)
    seen, epochs = defaultdict(int), defaultdict(set)
    for r in rows:
        seen[r.source] += r.tokens
        assert r.tokens == tokens[(str(r.doc_id), r.source)]
        key = (r.source, r.doc_id, r.epoch)
        assert key not in epochs[r.source]
        epochs[r.source].add(key)
    biggest = max(tokens.values())
    for s, b in wanted.items():
        assert b - biggest - 1 <= seen[s] <= b + 1, s
    if "budget" not in settings:
        assert {(str(r.doc_id), r.source) for r in rows} == set(tokens)


def test_mixing_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_hash_of_kept_text(spark):
    frame = spark.createDataFrame([(1, "a\r\nb"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: hashlib.sha256(r.kept.encode()).hexdigest() for r in line_dedup.dedup_lines(frame).collect()}
    assert got == {1: hashlib.sha256(b"a\r\nb").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("seed", range(40))
def test_region_links_connect_what_all_links_connect(seed):
    """Chains, families of near sets and strangers; every link is one between a pivot and a set."""
    rng = np.random.default_rng(seed)
    bounds, sets = jaccard.Bounds(75), []
    for _ in range(rng.integers(1, 5)):
        base = np.sort(rng.choice(400, rng.integers(1, 60), replace=False))
        for _ in range(rng.integers(1, 9)):
            drop = rng.random(len(base)) < rng.choice([0.0, 0.1, 0.25])
            more = rng.choice(400, rng.integers(0, 6), replace=False)
            sets.append(np.unique(np.concatenate((base[~drop], more, base[:1]))).astype(np.int64))
            if rng.random() < 0.5:
                base = sets[-1]

    def parts(links):
        forest = jaccard.Forest()
        for a, b in links:
            forest.join(a, b)
        roots = [forest.root(i) for i in range(len(sets))]
        return {frozenset(j for j in range(len(sets)) if roots[j] == x) for x in roots}

    common = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    every = [(i, j) for i in range(len(sets)) for j in range(i) if bounds.linked(common(i, j), len(sets[i]), len(sets[j]))]
    got = jaccard.region_links(sets, bounds, pivots=2)
    assert {tuple(sorted(x, reverse=True)) for x in got} <= set(every)
    assert parts(got) == parts(every) == parts(jaccard.region_links(sets, bounds))


def test_pivots_leave_most_lists_and_postings_unread():
    """Same results as scoring every item for every passage, from far fewer entries."""
    rng = np.random.default_rng(6)
    common, rare = [f"c{i}" for i in range(200)], [f"r{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n))
    items = [(i, text(int(rng.integers(15, 40)))) for i in range(400)]
    index = decontam.ItemIndex(items, 3)
    by_id = dict(items)
    docs = [text(400) for _ in range(20)] + [f"{text(90)} {by_id[int(i)]} {text(70)}" for i in rng.choice(400, 20)] + [by_id[3], "c1 c2", ""]
    exhaustive = 0
    for doc in docs:
        found = {}
        words, step = decontam.words_of(doc), index.longest
        for start in range(0, max(1, len(words) - step), step) if words else []:
            passage = words[start : start + 2 * step]
            codes = [index.terms[w] for w in set(passage) if w in index.terms]
            exhaustive += sum(int(index.postings.start[c + 1] - index.postings.start[c]) for c in codes)
            have = decontam.grams(passage, 3)
            for j, i in enumerate(index.ids):
                score = sum(index.postings[c, j] for c in codes)
                if score < 0.5 - 1e-9:
                    continue
                w = decontam.words_of(by_id[i])
                cut = max(1, 2 * len(w) // 3)
                parts = [decontam.grams(w[:cut], 3), decontam.grams(w[cut:], 3)]
                share = [len(x & (have if len(next(iter(x))) == 3 else decontam.grams(passage, len(next(iter(x)))))) / len(x) if x else 1.0 for x in parts]
                if min(share) >= 0.5:
                    old = found.get(i, (0.0, 0.0, 0.0, 0))
                    found[i] = (max(old[0], score), max(old[1], share[0]), max(old[2], share[1]), old[3] + 1)
        got = {i: x for i, *x in index.matches(doc, 0.5, 0.5, 0.5)}
        assert got.keys() == found.keys()
        for i, x in got.items():
            assert x == pytest.approx(list(found[i]))
    assert 0 < index.postings_read < exhaustive / 5
    assert index.lists_read < exhaustive


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    star = [(50, i) for i in range(51, 80)] + [(3, 79), (60, 61), (61, 60)]
    rows = spark.createDataFrame([(v, u) if u % 2 else (u, v) for u, v in chain + star], "u long, v long")
    found = {r["node"]: r["label"] for r in jaccard.components(rows, "u", "v").collect()}
    assert found == {i: 100 for i in range(100, 141)} | {i: 3 for i in (3, *range(50, 80))}
    assert jaccard.components(rows.where("u = 7"), "u", "v").count() == 0
