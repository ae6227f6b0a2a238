import random
import re
from pathlib import Path

import pytest

from setlight.llm import licenses

COMMON = Path("/usr/share/common-licenses")


def shingles(text):
    w = re.findall(licenses.WORDS, (text or "").lower())
    return [tuple(w[i : i + licenses.SHINGLE]) for i in range(len(w) - licenses.SHINGLE + 1)]


def plain_scan(docs, templates, containment=0.75):
    """Every window of every document against every template."""
    out = {}
    for name, template in templates:
        wanted = set(shingles(template))
        m = len(wanted)
        if not m:
            continue
        step = licenses.stride(m)
        for doc_id, text in docs:
            have = shingles(text)
            for start in range(0, len(have), step):
                share = len(wanted.intersection(have[start : start + m + step])) / m
                if share >= containment:
                    best, first = out.get((doc_id, name), (0.0, start))
                    out[doc_id, name] = (max(best, share), min(first, start))
    return sorted(((str(d), n, *v) for (d, n), v in out.items()))


def scanned(rows):
    return sorted((str(r.doc_id), r.license, r.containment, r.first_word) for r in rows.select("doc_id", "license", "containment", "first_word").collect())


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.random() ** 2 * 400)}"
    templates = [(f"l{i % 9}", " ".join(word() for _ in range(rng.choice([3, 5, 6, 9, 9, 30, 31, 200])))) for i in range(24)]
    templates += [("copy", templates[5][1]), templates[7], ("nested", " ".join(templates[-1][1].split()[2:-2])), ("again", "a b c d e " * 12)]
    docs = [(None, None), (None, ""), (1, "short"), (2, "a b c d e " * 3_000)]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += [word() for _ in range(rng.randrange(40))]
            body = rng.choice(templates)[1].split()
            lost = rng.choice([0, 0, 0.02, 0.1])
            parts += [word() if rng.random() < lost else w.upper() if rng.random() < 0.1 else w for w in body][: rng.choice([1000, 1000, len(body) * 4 // 5])]
        docs.append((i % 50 + 3, "\n# ".join(parts)))  # ten ids repeat with other texts
    return docs + docs[10:14] + [(None, templates[5][1]), (99, "x " * 30_000 + templates[7][1])], templates


@pytest.mark.parametrize("seed", [1, 2])
def test_license_scan_is_exhaustive(spark, seed, monkeypatch):
    docs, templates = made_up(seed)
    if seed == 2:
        monkeypatch.setattr(licenses, "BROADCAST", 10)
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, license string, template int, h int")
    table = spark.createDataFrame([(*t, 0) for t in templates] + [("void", None, 1), (None, "", 1)], "license string, text string, m int")
    assert scanned(licenses.scan_licenses(frame, table)) == plain_scan(docs, templates)
    assert licenses.scan_licenses(frame, table.where("m = 1")).count() == 0


def test_license_folder(spark, tmp_path):
    docs, templates = made_up(3)
    named = {f"made.up-{i}": text for i, (_, text) in enumerate(templates[:24])}
    for name, text in named.items():
        (tmp_path / f"{name}.txt").write_text(text)
    table = licenses.read_templates(spark, str(tmp_path))
    assert {tuple(r) for r in table.select("license", "text").collect()} == set(named.items())
    assert scanned(licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), table)) == plain_scan(docs, named.items())


@pytest.mark.skipif(not (COMMON / "GPL-3").exists(), reason="no license texts on this machine")
def test_whole_license_texts(spark):
    names = ["Apache-2.0", "GPL-3", "LGPL-3", "MPL-2.0", "BSD", "GPL-2"]
    texts = {n: (COMMON / n).read_text(errors="replace") for n in names}
    table = spark.createDataFrame(list(texts.items()), "license string, text string")
    rng = random.Random(4)
    odd = " ".join("changed" if rng.random() < 0.02 else w for w in texts["GPL-3"].split())
    docs = [(1, "A file of words. " * 50 + texts["Apache-2.0"]), (2, texts["BSD"] + "\n" + texts["MPL-2.0"]), (3, odd), (4, texts["GPL-2"][: len(texts["GPL-2"]) // 2]), (5, texts["GPL-3"][-9_000:] + texts["LGPL-3"])]
    found = scanned(licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), table))
    assert found == plain_scan(docs, texts.items())
    assert {f[:2] for f in found} == {("1", "Apache-2.0"), ("2", "BSD"), ("2", "MPL-2.0"), ("3", "GPL-3"), ("5", "LGPL-3")}


def test_license_scan_stays_in_the_jvm(spark):
    plan = licenses.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("hashpartitioning(doc_id") == 2  # windows, then results; the other exchanges are of templates
