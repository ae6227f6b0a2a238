"""Toxicity by noisy-channel deobfuscation.

1. A character language model: 4-gram counts over a folded alphabet of 32 symbols, summed over every
   text of the corpus. The table has at most 32**4 entries, whatever the input.
2. A lexicon: log-odds of words and word beginnings between toxic and clean labelled documents, as a
   lower confidence bound, from at most ``sample`` labelled documents outside the held-out fold.
   Copies of a text count once.
3. For each text, every token that may be written in disguise (a leetspeak character anywhere, a
   repeated letter, letters spaced or dotted apart) becomes a character lattice, with the marks at its
   edges and without them; Viterbi decoding under the language model picks the likeliest spelling of
   each form. All other tokens have one path only and stay.
4. The restored text is scored: the strongest words give a logistic score whose weights are fitted on
   a third fold of the sample.

Defined cases: null and empty texts have no evidence and get the score of no evidence; null ids are
scored but never labelled; repeated rows give repeated results; without labels of both classes every
score is 0 (or the share of the only class).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, one_label, pieces, unused

ORDER, BITS = 4, 5
CELLS = 1 << (ORDER * BITS)
STATE = (1 << ((ORDER - 1) * BITS)) - 1
BLANK, OTHER, DIGIT, MARK = 0, 27, 28, 29

#: Letters that a character may stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "µ": "u",
}
GAP = " .-_*"
SPACED = re.compile(r"(?<![^\s])[^\W_](?:[ .\-_*]+[^\W_]){2,}(?![^\s.,;:!?])")
DISGUISED = re.compile(rf"[{re.escape(''.join(LEET))}]|([^\W\d_])\1")
CHOICES = re.compile(rf"(.)\1+|[{re.escape(''.join(LEET) + GAP)}]", re.S)
TRAILING = re.compile(r"(\W)\1+$")
EDGES = ".,;:!?\"'()[]{}<>*#%&~^=/\\-_`"
#: Marks at the edges that stand for no letter.
OUTER = "".join(x for x in EDGES if x not in LEET)


def fold(ch: str) -> int:
    """The symbol of a character: a-z by base letter, else one of a few classes."""
    if ch.isspace():
        return BLANK
    base = unicodedata.normalize("NFD", ch.lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return OTHER if ch.isalpha() else DIGIT if ch.isdigit() else MARK


FOLD = np.array([fold(chr(i)) if i else BLANK for i in range(0x3000)], np.uint8)
SYMBOLS = FOLD.tobytes()  # single symbols are read faster from bytes


def gram_codes(text: str) -> np.ndarray:
    points = np.frombuffer(f"   {text} ".encode("utf-32-le", "replace"), np.uint32)
    c = np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], OTHER).astype(np.int32)
    return (((c[:-3] << BITS | c[1:-2]) << BITS | c[2:-1]) << BITS) | c[3:]


def count_grams(docs: DataFrame) -> np.ndarray:
    """4-gram counts over all texts. Each task sends its table, Spark adds them up; at most 32**4 sums arrive."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                for at in range(0, len(text or ""), 1 << 20):
                    codes = gram_codes(text[at : at + (1 << 20)])
                    if len(codes) > 1 << 14:
                        total += np.bincount(codes, minlength=CELLS)
                    else:
                        np.add.at(total, codes, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    sums = docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.float64)
    out[sums["code"].to_numpy()] = sums["n"].to_numpy()
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | three before), interpolated down to single symbols."""
    size = 1 << BITS
    c = [counts.reshape((size,) * ORDER)]
    for _ in range(ORDER - 1):
        c.append(c[-1].sum(axis=0))
    p = (c[3] + 0.5) / (c[3] + 0.5).sum()
    for level in (2, 1, 0):
        n = c[level].sum(axis=-1, keepdims=True)
        p = (c[level] + 5 * p) / (n + 5)
    return np.log(p).astype(np.float32).ravel()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters its possible spellings, with the channel's log-probability."""
    out, chars, end = [], token.lower(), 0
    for m in CHOICES.finditer(chars):
        if m.start() > end:  # between the runs with a choice; all states are one after three symbols
            out += [[(x, 0.0)] for x in (chars[end : m.start()][:3], chars[end : m.start()][3:]) if x]
        end = m.end()
        ch, n = m[0][0], len(m[0])
        if ch in GAP:
            out.append([("", -0.5), (" ", -2.0)])
        elif ch in LEET:
            out.append([(x * (n if n < 3 else 1), -0.7) for x in LEET[ch]] + [(ch * n, -1.5)])
        elif n >= 3:
            out.append([(ch, -0.7), (ch * 2, -0.9), (ch * n, -4.0)])
        else:
            out.append([(ch * 2, 0.0), (ch, -2.0)])
    return out + [[(x, 0.0)] for x in (chars[end:][:3], chars[end:][3:]) if x]


def restore(token: str, model: np.ndarray) -> str:
    """The Viterbi path through the token's lattice; a state is the last three symbols."""
    log_p, known = memoryview(model), len(SYMBOLS)
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # a path is (path before, text)
    for choices in [*lattice(token), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple]] = {}
        for state, (score, said) in states.items():
            for text, channel in choices:
                s, total = state, score + channel
                for ch in text:
                    point = ord(ch)
                    code = s << BITS | (SYMBOLS[point] if point < known else OTHER)
                    total += log_p[code]
                    s = code & STATE
                if s not in after or total > after[s][0]:
                    after[s] = (total, (said, text))
        states = after
    path, parts = max(states.values(), key=lambda x: x[0])[1], []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts)).strip()


def keys_of(word: str) -> tuple[str, ...]:
    """What the lexicon knows of a word: itself and its beginnings."""
    return (word, f"{word[:5]}~", f"{word[:4]}~") if len(word) > 5 else (word, f"{word[:4]}~") if len(word) > 4 else (word,)


class Restorer:
    """Words of a text after restoring; remembers tokens."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def word(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            core = token.strip(EDGES)
            bare = core if core[-1:].isalnum() else TRAILING.sub("", core).strip(EDGES)
            got = (bare,) if bare else ()
            if DISGUISED.search(token):
                found = dict.fromkeys(got)
                for form in {token.strip(OUTER), core, bare}:
                    if DISGUISED.search(form):
                        found |= dict.fromkeys(x for y in restore(form, self.model).split() if (x := y.strip(EDGES)))
                got = tuple(found)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = got
        return got

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        out: set[str] = set()
        for token in set(low.split()):
            out.update(self.word(token))
        for m in SPACED.finditer(low):
            out.update(restore(m[0], self.model).split())
        return out


_shared: list[Restorer] = []


def shared_restorer(model: np.ndarray) -> Restorer:
    """The process's restorer for this model: tasks that follow each other in it know the tokens of those before."""
    if not _shared or _shared[0].model is not model:
        _shared[:] = [Restorer(model)]
    return _shared[0]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, label, fold) of at most about ``sample`` labelled documents outside the held-out fold, one for each text."""
    labels = one_label(labels, "toxic").where(~held_out())
    share = min(1.0, sample / max(1, labels.count()))
    some = F.broadcast(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    rows = docs.select("doc_id", "text").join(some, "doc_id")
    single = rows.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    return rows.join(F.broadcast(single), "doc_id", "left_semi").select("text", "label", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3).alias("tuning"))


def learn_lexicon(rows: DataFrame, restorer_of, least: int = 2) -> dict[str, float]:
    """key -> lower bound of its log-odds, for keys that point to toxic texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, tables = restorer_of(), (Counter(), Counter())
        for batch in pieces(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tables[label].update({k for w in restorer.words(text) for k in keys_of(w)})
        keys = list(tables[0].keys() | tables[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tables[1][k] for k in keys], pa.int64()), pa.array([tables[0][k] for k in keys], pa.int64())], ["key", "t", "c"])

    sizes = dict(rows.groupBy("label").count().collect())
    t_all, c_all = sizes.get(1, 0), sizes.get(0, 0)
    if not t_all or not c_all:
        return {}
    sums = rows.select("text", "label").mapInArrow(count, "key string, t long, c long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5)) - F.lit(math.log((t_all + 1) / (c_all + 1)))
    bound = odds - 1.3 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    strong = sums.where(F.col("t") >= least).select("key", bound.alias("w")).where("w > 0.7").toArrow()
    return dict(zip(strong["key"].to_pylist(), strong["w"].to_pylist(), strict=True))


N_EVIDENCE = 4


def evidence(words: set[str], lexicon: dict[str, float]) -> list[float]:
    """The two strongest words, and how many strong ones for the text's length."""
    get = lexicon.get
    found = sorted((w for w in (max((get(k, 0.0) for k in keys_of(x)), default=0.0) for x in words) if w), reverse=True)
    strong = sum(w > 2.5 for w in found)
    first, second = (found + [0.0, 0.0])[:2]
    return [first, second, math.log1p(strong), strong / (10 + len(words)) ** 0.5]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps; weights with the constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


class Model:
    """Language model, lexicon and logistic weights; bounded by the alphabet and the sample."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int):
        spark = docs.sparkSession
        self.grams = spark.sparkContext.broadcast(log_model(count_grams(docs)))
        grams = self.grams
        rows = cut(training_rows(docs, labels, sample), "toxicity-sample")
        restorer_of = lambda: shared_restorer(grams.value)
        self.lexicon = spark.sparkContext.broadcast(learn_lexicon(rows.where("not tuning"), restorer_of))
        lexicon = self.lexicon

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = restorer_of()
            for batch in pieces(batches):
                e = [evidence(restorer.words(x), lexicon.value) for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.list_(pa.float64())), batch.column(1)], ["e", "label"])

        tuning = rows.where("tuning").select("text", "label").mapInArrow(weigh, "e array<double>, label int").toArrow()
        y = tuning["label"].to_numpy().astype(float)
        self.weights = None
        if 0 < y.sum() < len(y):
            self.weights = fit_logistic(np.array(tuning["e"].to_pylist()), y)
        self.base = float(y.mean()) if len(y) else 0.0


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 40_000) -> DataFrame:
    """Every row of ``docs`` with its columns and held_out, score, predicted, which replace columns of these names."""
    model = Model(docs, labels, sample)
    grams, lexicon, weights, base = model.grams, model.lexicon, model.weights, model.base
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    (fold,) = unused(docs, "fold")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = shared_restorer(grams.value)
        for batch in pieces(batches):
            e = np.array([evidence(restorer.words(x), lexicon.value) for x in batch.column("text").to_pylist()]).reshape(-1, N_EVIDENCE)
            if weights is None:
                s = np.full(len(e), base)
            else:
                s = 1 / (1 + np.exp(-np.clip(e @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column(fold), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "held_out", "score", "predicted"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names], held_out().alias(fold)).mapInArrow(score, f"{schema}, held_out boolean, score double, predicted int")
