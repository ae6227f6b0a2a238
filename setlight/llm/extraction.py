"""Main text of HTML pages: the best-scoring run of words and tags.

A page is a sequence of words and tags. Words score for content and tags against it; both weights come
from labelled pages, which mark their one article themselves. A linear scan finds the run with the largest
sum, and its text is the page's. An element that never holds main text (a menu, a form, a block named as
advert or comments ...) counts as one heavy tag: its words and inner tags score nothing and are not returned,
so an article can go on behind it, at a small cost inside an article and a larger one elsewhere.

Rows: null, empty and unreadable html give an empty text; broken markup is read as far as it goes; page_id
and url may be null or repeat, each row is treated alone; other columns are ignored; an empty table gives
an empty result. Of runs with the same sum, the first found wins. Without labelled pages the weights are
the priors.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no main text. A header outside an article is one as well.
OUTSIDE = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noembed noframes noscript object script select style svg template textarea title video audio xmp".split())
#: Elements that may hold an article; a run that crosses their edge leaves what they hold.
HOLDERS = frozenset("article main body html".split())
#: Elements inside a line: their edges do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta link q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are mostly prose, wherever they stand.
PROSE = frozenset("p b strong i em h1 h2 h3 h4 h5 h6 blockquote q br span sub sup u s small mark cite code pre abbr time figure figcaption hr img wbr font".split())
#: Names of classes, ids and roles whose blocks are no main text, and of those that are.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies dialog disclaimer discussion"
    " disqus footer footnav gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related reply replies"
    " respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
INSIDE_NAMES = frozenset("article articlebody content entry main post story".split())
#: An open element of the first kind ends with the start of one of the second.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
IN_PARAGRAPH = INLINE | {"ins", "del", "script", "style", "noscript", "template", "button", "select", "textarea", "canvas", "object", "svg", "video", "audio", "iframe", "input", "embed", "map", "area"}

#: A tag's cost in words: the least, and the most that its share outside of articles adds. Then the costs of
#: an article's edge, and of a whole element without main text beside an article and inside one.
LEAST, MOST, EDGE, BESIDE, AMID = 0.1, 4.0, 25.0, 12.0, 1.0

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>\x00]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def names_outside(attributes: str) -> bool:
    """Whether a class, id or role names a block that is no main text; "with-sidebar" says what a block has, not what it is."""
    for _, double, single, bare in NAMES.findall(attributes):
        for name in (double or single or bare).split():
            parts = [p.lower() for p in PARTS.findall(name)]
            if not parts or parts[0] in ("has", "with", "no", "without") or (parts[-1] == "header" and INSIDE_NAMES.intersection(parts)):
                continue
            whole = [w.lower() for w in re.findall(r"[A-Za-z]+", name)]
            pairs = [a + b for words in (parts, whole) for a, b in zip(words, words[1:], strict=False)]  # side-bar, sideBar
            if OUTSIDE_NAMES.intersection(parts + whole + pairs):
                return True
    return False


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): "text" with its characters, "open" with attributes, "close"; comments and declarations go."""
    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            yield "text", "", page[at:start]
        if start == end:
            return
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 2)
            if stop < 0:
                return
            at = stop + 3
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            if stop < 0:
                return
            at = stop + 1
            continue
        found = TAG.match(page, start)
        if not found:
            if not re.match(r"</?[A-Za-z]", page[start : start + 3]):
                yield "text", "", "<"
                at = start + 1
                continue
            stop = page.find(">", start)
            if stop < 0:
                return
            found, at = re.match(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)", page[start:stop], re.S), stop + 1
        else:
            at = found.end()
        closing, name, attributes = found[1], found[2].lower(), found[3]
        yield ("close" if closing else "open"), name, attributes
        if not closing and name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            yield "close", name, ""
            if not stop:
                return
            stop = page.find(">", stop.end())
            if stop < 0:
                return
            at = stop + 1


@dataclass(slots=True)
class Unit:
    """A stretch of text, or a tag. ``element`` is the tag's name or the text's parent.

    ``outside`` is a whole element without main text, ``amid`` one inside an article.
    """

    text: str | None
    element: str
    outside: bool = False
    opens: bool = False
    amid: bool = False


def units(page: str) -> list[Unit]:
    """The page's stretches of text and its tags in order; elements without main text are one unit each."""
    out: list[Unit] = []
    open_elements: list[str] = []
    counted: Counter[str] = Counter()
    hidden: list[str] = []  # the open elements inside one without main text, itself first

    def leave(name: str) -> None:
        while open_elements:
            last = open_elements.pop()
            counted[last] -= 1
            if last == name:
                return

    for kind, name, value in events(page):
        if hidden:
            # Inside such an element only its own name is followed.
            if kind == "open" and name == hidden[0] and name not in VOID:
                hidden.append(name)
            elif kind == "close" and name == hidden[0]:
                hidden.pop()
            elif kind == "open" and name in ("article", "main") and hidden[0] == "form":
                hidden.clear()  # a form around the whole page
                out.append(Unit(None, name, opens=True))
                open_elements.append(name)
                counted[name] += 1
            elif kind == "close" and name in HOLDERS and counted[name]:
                hidden.clear()  # never closed: the element around it ends it
                leave(name)
                out.append(Unit(None, name))
            continue
        if kind == "text":
            out.append(Unit(value, open_elements[-1] if open_elements else ""))
        elif kind == "open":
            if counted["p"] and name not in IN_PARAGRAPH and name not in HOLDERS:
                leave("p")
            while open_elements and name in ENDED_BY.get(open_elements[-1], ()):
                leave(open_elements[-1])
            within = counted["article"] or counted["main"]
            if name not in HOLDERS | VOID and (name in OUTSIDE or (name == "header" and not within) or names_outside(value)):
                out.append(Unit(None, name, outside=True, amid=bool(within)))
                hidden.append(name)
                continue
            out.append(Unit(None, name, opens=True))
            if name == "article" and names_outside(value):
                out[-1].outside = True
                hidden.append(name)
            elif name not in VOID:
                open_elements.append(name)
                counted[name] += 1
        elif counted[name]:
            leave(name)
            out.append(Unit(None, name))
    return out


def key(unit: Unit) -> str:
    """What weights are learned for: elements that HTML knows, others together."""
    return unit.element if unit.element in KNOWN else "other"


KNOWN = INLINE | PROSE | OUTSIDE | HOLDERS | frozenset("div section ul ol li dl dt dd table tbody thead tfoot tr td th caption center details summary header address hgroup".split())


def evidence(page: str | None) -> Counter[tuple[str, str, bool]]:
    """Counts of (word or tag, element, inside) of a page that marks one article as its main text; else nothing."""
    found = units(page or "")
    marks = [i for i, u in enumerate(found) if u.element == "article" and u.text is None and not u.outside]
    if len(marks) != 2 or not found[marks[0]].opens or found[marks[1]].opens:
        return Counter()
    counts: Counter[tuple[str, str, bool]] = Counter()
    for i, u in enumerate(found):
        inside = marks[0] < i < marks[1]
        if u.text is not None:
            counts["word", key(u), inside] += len(u.text.split())
        elif not u.outside and u.element not in HOLDERS:
            counts["tag", key(u), inside] += 1
    return +counts


@dataclass(frozen=True)
class Weights:
    """``word[e]``: what a word directly in element e adds; ``tag[e]``: what a tag of e costs."""

    word: dict[str, float]
    tag: dict[str, float]

    def of(self, unit: Unit) -> float:
        if unit.text is not None:
            return self.word[key(unit)] * len(unit.text.split())
        if unit.outside:
            return -AMID if unit.amid else -BESIDE
        return -EDGE if unit.element in HOLDERS else -self.tag[key(unit)]


def weights(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Half of an element's share outside articles is its prior, half what labelled pages show, if they show it."""
    word, tag = {}, {}
    for name in [*sorted(KNOWN), "other"]:
        prior = 0.05 if name in PROSE else 0.2 if name == "a" else 0.5
        for kind, out in (("word", word), ("tag", tag)):
            within, without = counts.get((kind, name, True), 0), counts.get((kind, name, False), 0)
            share = (prior + (without + 1) / (within + without + 2)) / 2 if within + without else prior
            out[name] = max(0.05, 1 - share) if kind == "word" else LEAST + MOST * share
    return Weights(word, tag)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the largest positive sum, the first of equals; (0, 0) if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, learned: Weights) -> str:
    """The blocks of the best run, each on a line, with white space in a block made one space."""
    found = units(page or "")
    start, end = best_run([learned.of(u) for u in found])
    blocks: list[list[str]] = [[]]
    for u in found[start:end]:
        if u.text is not None:
            blocks[-1].append(u.text)
        elif u.element == "br":
            blocks[-1].append(" ")
        elif u.outside or u.element not in INLINE:
            blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, sample: int = 20_000, page_id: str = "page_id", content: str = "html") -> Weights:
    """The weights from labelled pages among about ``sample`` pages, chosen by a hash of their ids."""
    ids = pages.where(F.col(page_id).isNotNull())
    share = min(1.0, sample / max(1, ids.count()))
    chosen = ids.where(F.crc32(F.col(page_id).cast("string").cast("binary")) < F.lit(int(share * 2**32))).select(F.col(content).alias("page"))

    def count(batch: pa.RecordBatch) -> pa.Table:
        counts: Counter[tuple[str, str, bool]] = Counter()
        for page in batch.column("page"):
            counts.update(evidence(page.as_py()))
        kinds, names, inside = zip(*counts, strict=True) if counts else ((), (), ())
        return pa.table({"kind": pa.array(kinds, pa.string()), "name": pa.array(names, pa.string()), "inside": pa.array(inside, pa.bool_()), "n": pa.array(counts.values(), pa.int64())})

    counted = chosen.mapInArrow(per_batch(count), "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["kind"], r["name"], r["inside"]): r["n"] for r in counted.collect()})  # two rows a kind and known element


def extract(pages: DataFrame, sample: int = 20_000, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``; pages stay where they are read."""
    learned = learn(pages, sample, page_id, content)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(content).alias("page"))

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = [main_text(page.as_py(), learned) for page in batch.column("page")]
        return pa.table([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(per_batch(run), f"page_id {kept['page_id']}, url {kept['url']}, text string, n_chars long")
