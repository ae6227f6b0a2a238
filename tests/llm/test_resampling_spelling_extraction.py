import hashlib
import html
import math
import re
import zlib
from collections import Counter

import pytest

from setlight.llm import extraction, resampling, spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# --- importance resampling ----------------------------------------------------------------------


def plain_resampling(docs, target, order, buckets, percent, least):
    def runs(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")) if x]
        return len(w), [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(at(f) for _, t in docs for f in runs(t)[1])
    t = Counter(at(f) for x in target for f in runs(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)}
    out, fit = [], []
    for i, text in docs:
        n, found = runs(text)
        weight = sum(gain[at(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if n >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: len(fit) * percent // 100]):
        row[4] = rank + 1
    return sorted(map(str, map(tuple, out)))


def resampling_rows():
    some = "Straße naïve the THE dog; over_and-over again 42 times été".split(" ")
    rows = [(i, " ".join(some[(i * k) % len(some)] for k in range(1, 5 + i))) for i in range(40)]
    return [*rows, (50, None), (51, ""), (52, " ;\n"), (None, "the dog again"), (None, "the dog again"), (7, rows[7][1]), (7, rows[7][1]), (7, "other words"), (60, "long tail " * 300), (61, rows[30][1]), (62, rows[30][1])]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resampling_equals_plain_version(spark, monkeypatch, order):
    monkeypatch.setattr(resampling, "CHUNK", 64)
    monkeypatch.setattr(resampling, "COPIES", 2)
    rows, target = resampling_rows(), ["The dog barks", "again and again", None, "", "été 42"]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, bucket string, n long, word int")
    wanted = spark.createDataFrame([(t, "y") for t in target], "text string, gain string")
    got = resampling.resample(docs, wanted, order=order, buckets=50, percent=30, least_words=5)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_resampling(rows, target, order, 50, 30, 5)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in resampling.resample(docs, docs.where("false")).collect()) == [1, 2]
    assert resampling.resample(docs.where("false"), docs).count() == 0


# --- spelling variants --------------------------------------------------------------------------


def plain_variants(docs, least=7, times=10, every=31):
    counts = Counter()
    for i, text in docs:
        for run in LETTERS.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= least
    n = {w: c for w, c in counts.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: vs[0] if vs and n[vs[0]] >= times * n[w] else None for w, vs in around.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return sorted(map(str, out))


def spelling_docs():
    common, rare = "received " * 230 + "RECEIVED " * 25, "recieved reeeived receved receivd rreceived eceived receive receivved "
    words = "aaaaaaa aaaaaaaa aaaaaab baaaaaa abaaaaa réponses reponses rèponses ÉTRANGER Étranger étranger éétranger ÿÿÿÿÿÿÿ listens silents"
    long = "x" * 5000
    return [
        (1, common + rare * 2), (2, rare + words), (3, words + " " + words), (4, None), (5, ""), (6, "short words only"), (None, words), (None, words), (2, rare + words),
        (7, f"{long} {long} {long}y {long}y"), (8, "abcdefg-abcdefh,abcdefi;ABCDEFGĀabcdefgh " * 3), (9, "receivde " * 24 + "receivdee " * 2 + "received" * 2),
    ]


@pytest.mark.parametrize("every", [31, 5])
def test_variants_equal_plain_version(spark, every):
    rows = spelling_docs()
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, word string, n int")
    got = spelling.group_variants(docs, every=every)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_variants(rows, every=every)
    assert spelling.group_variants(docs.where("false")).count() == 0


def test_roots_follow_chains(spark):
    rows = [(f"w{i}", f"w{i + 1}" if i % 9 != 8 else None) for i in range(30)]
    got = dict(spelling.rooted(spark.createDataFrame(rows, "word string, form string")).select("word", "root").collect())
    assert got == {f"w{i}": f"w{min(i - i % 9 + 8, 30)}" for i in range(30)}


# --- main text ----------------------------------------------------------------------------------

PROSE = "Plain sentences of the story go on for a while, with commas and more than a handful of words in each."


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}{article}{after}</body></html>"


def labelled():
    menu = "<nav><ul>" + "<li><a href='/x'>Menu</a></li>" * 6 + "</ul></nav><div class='ad'>Buy this now</div>"
    return [page(f"<article><h1>Title {i}</h1><p>{PROSE}<p><b>{PROSE}</b><br></article>", menu, "<footer>&copy; site and some words</footer>") for i in range(8)]


@pytest.fixture(scope="module")
def learned():
    counts = Counter()
    for p in labelled():
        counts.update(extraction.evidence(p))
    return extraction.weights(counts)


def test_weights_come_from_labelled_pages(learned):
    assert learned.tag["p"] < 0.5 < learned.tag["div"]
    assert learned.word["p"] > 0.9
    assert not extraction.evidence(page("<div>no article</div>")) and not extraction.evidence(None)
    assert not extraction.evidence(page("<article>a</article><article>b</article>"))


def test_best_run_equals_all_runs():
    import random

    r = random.Random(4)
    for _ in range(300):
        x = [r.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(r.randint(0, 12))]
        runs = [(sum(x[i:j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        start, end = extraction.best_run(x)
        assert sum(x[start:end]) == max([0.0, *(s for s, _, _ in runs)])


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<header><h2>Site</h2><p>Our motto is a rather long one, and it says little about anything.</p></header>", "<footer>" + PROSE + "</footer>"),
        ("<div class='cookie-notice'>" + PROSE + "</div>", "<section id=\"comments\"><article class='comment'><p>" + PROSE * 3 + "</p></article></section>"),
        ("<form action='/s'><label>Search</label><input name=q><select><option>One<option>Two</select></form>", "<aside><p>" + PROSE * 4 + "</p></aside>"),
        ("<div id='sideBar'><ul><li><a href='/1'>One</a></li></ul><div>" + PROSE * 5 + "</div></div>", "<div class=\"related-posts\"><p>" + PROSE + "</div>"),
        ("<ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul>", "<noscript>" + PROSE + "</noscript><iframe>" + PROSE + "</iframe><!-- " + PROSE + " -->"),
        ("<div role=banner>" + PROSE + "</div><div hidden></div>", "<div class='respond'><textarea>" + PROSE + "</textarea></div>"),
    ],
)
@pytest.mark.parametrize("holder", ["article", "main", "div class='post-content with-sidebar'", "section"])
def test_main_text_leaves_the_rest(learned, before, after, holder):
    inside = f"<h1>A &amp; B</h1><p>{PROSE}</p><p>Yes.</p><aside>Aside {PROSE}</aside><p>{PROSE}\n <a href='/x?a>b'>link</a>&nbsp;end<br>next</p><blockquote>Quoted {PROSE}</blockquote>"
    text = extraction.main_text(page(f"<{holder}>{inside}</{holder.split()[0]}>", before, after), learned)
    assert text == f"A & B\n{PROSE}\nYes.\n{PROSE} link end next\nQuoted {PROSE}"


@pytest.mark.parametrize("broken", ["<", "<p", "<!-- never closed " + "x " * 50, "<p a='never closed " + "y " * 40, "</article", "<script>never closed", "<![CDATA[ x", "<a href=\"1>2\"", "\x00<\x00"])
def test_broken_pages_are_read_as_far_as_they_go(learned, broken):
    whole = f"<article><p>{PROSE}</p><p>{PROSE}</p>"
    assert extraction.main_text(whole + broken, learned).startswith(f"{PROSE}\n{PROSE}")
    assert isinstance(extraction.main_text(broken + whole, learned), str)


def test_deep_and_hostile_pages_take_linear_time(learned):
    for hostile in ("<b>" * 100_000 + "</i>" * 100_000, "<a '" * 50_000, "< " * 100_000, "<p " * 100_000, "<!--" * 50_000, "<script>" * 20_000, "&" * 100_000, "</" * 100_000, '<a ">' * 50_000):
        assert isinstance(extraction.main_text(hostile, learned), str)


def test_extraction_of_rows(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(i, f"http://x/{i}", p, "t") for i, p in enumerate(labelled())] + [(20, None, None, None), (21, "u", "", ""), (None, "u", labelled()[0], "t"), (0, "again", labelled()[0], "t"), (0, "again", labelled()[0], "t"), (22, "u", long, None), (23, "u", "no markup at all", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extraction.extract(pages).collect())
    one = lambda i: f"Title {i}\n{PROSE}\n{PROSE}"
    wanted = [(str(i), f"http://x/{i}", one(i)) for i in range(8)] + [("20", "None", ""), ("21", "u", ""), ("None", "u", one(0)), ("0", "again", one(0)), ("0", "again", one(0)), ("22", "u", "\n".join([PROSE] * 20_000)), ("23", "u", "no markup at all")]
    assert got == sorted((*w, len(w[2])) for w in wanted)
    assert extraction.extract(pages.where("false")).count() == 0


def test_main_text_is_the_article_of_every_page(spark):
    """The pages of the test data mark their article: words and tags alone find it."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        clean = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
        assert texts[r.page_id] == "\n".join(b for b in clean if b)
