"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

A document is cut into overlapping passages of twice the longest item, one item apart, so that each
leaked item lies whole in some passage. Every passage is a query against an inverted index of the
items. Contributions are BM25 term weights over the item's own total, so that one threshold holds for
all items. Items are ordered by length and put into blocks; for each term and block the index keeps
the largest contribution. As in block-max WAND a passage has a pivot among its terms: weaker ones together
stay below the threshold, so only blocks in the lists of the pivot and of stronger terms are opened,
only those whose block maxima over all terms reach the threshold are read, and of a term's postings only
those in such blocks. Passages are worked on together, in numpy, in place of cursors that move one by one.
All items at or above the threshold are retrieved and then verified: enough of the question's and of
the answer's word n-grams (the first two thirds and the last third of the item) must be in the
passage, as sets.

Spark counts items, average and longest length and each word's items over the whole benchmark, so
that scores and passages are the same in every sharding. Items are hashed to shards of about
``shard_terms`` postings and ``shard_chars`` characters; each shard's index is built in a Spark task,
with the counts of its own words only, and broadcast. More items mean more shards, each a pass over
the documents. Documents are never shuffled.

Defined cases: null or empty texts and items match nothing; items without words are left out;
repeated items or documents give repeated results; an empty benchmark gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_batch

WORDS = re.compile(r"\w+").findall
BLOCK = 8
BOUNDS = 1 << 20  # block maxima that are added up at once, unless one passage has more


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def grams(words: list, n: int) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def stretches(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from first[i] on, n[i] of them, for all i."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class Rows:
    """Sparse rows: the columns and values of row k stand from start[k] to start[k + 1]."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int):
        order = np.lexsort((columns, rows))
        self.columns, self.values = columns[order].astype(np.int32), values[order]
        self.start = np.searchsorted(rows[order], np.arange(n + 1))

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, place of the entry) of all entries of these rows."""
        first = self.start[rows]
        n = self.start[rows + 1] - first
        return np.repeat(np.arange(len(rows)), n), stretches(first, n)

    def items(self) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        for k in range(len(self.start) - 1):
            part = slice(self.start[k], self.start[k + 1])
            yield k, list(zip(self.columns[part].tolist(), self.values[part].tolist(), strict=True))

    def __getitem__(self, at: tuple[int, int]) -> float:
        part = slice(self.start[at[0]], self.start[at[0] + 1])
        return float(self.values[part][self.columns[part] == at[1]].sum())

    def sum(self) -> float:
        return float(self.values.sum())


class ItemIndex:
    """BM25 postings of items with block maxima.

    ``whole`` is (items, average length, longest length, items by word) of the whole benchmark, for a
    shard of it.
    """

    def __init__(self, items: list[tuple[int, str]], gram: int, k1: float = 1.2, b: float = 0.75, whole: tuple[int, float, int, dict[str, int]] | None = None):
        parsed = sorted(((len(w), i, w) for i, text in items if (w := words_of(text))), key=lambda x: x[0])
        if whole is None:
            lengths = [n for n, _, _ in parsed]
            whole = len(parsed), sum(lengths) / max(1, len(parsed)), max(lengths, default=1), Counter(t for _, _, w in parsed for t in set(w))
        n_items, average, self.longest, df = whole
        self.gram, self.ids, self.terms = gram, [i for _, i, _ in parsed], {}
        self.n_blocks = max(1, -(-len(parsed) // BLOCK))
        rows, columns, values, codes = [], [], [], []
        for j, (n, _, w) in enumerate(parsed):
            weight = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / average)) for t, tf in Counter(w).items()}
            total = sum(weight.values())
            codes.append(np.array([self.terms.setdefault(t, len(self.terms)) for t in w], np.int32))
            rows.append(np.array([self.terms[t] for t in weight], np.int64))
            columns.append(np.full(len(weight), j, np.int64))
            values.append(np.array([x / total for x in weight.values()]))
        self.ends = np.cumsum([0, *map(len, codes)])
        self.codes = np.concatenate([np.zeros(0, np.int32), *codes])
        rows, columns, values = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((rows, np.int64), (columns, np.int64), (values, np.float64)))
        n_rows = len(self.terms) + 1  # the last row is for unknown words
        self.most = np.zeros(n_rows)
        np.maximum.at(self.most, rows, values)
        code = np.empty(n_rows - 1, np.int64)  # terms are numbered by their largest contributions, the weakest first
        code[np.argsort(self.most[:-1], kind="stable")] = np.arange(n_rows - 1)
        self.terms, rows, self.codes, self.most = {t: int(code[k]) for t, k in self.terms.items()}, code[rows], code[self.codes].astype(np.int32), np.append(np.sort(self.most[:-1]), 0.0)
        self.postings = Rows(rows, columns, values, n_rows)
        cells, inverse = np.unique(rows * self.n_blocks + columns // BLOCK, return_inverse=True)
        most = np.zeros(len(cells))
        np.maximum.at(most, inverse, values)
        self.maxima = Rows(cells // self.n_blocks, cells % self.n_blocks, most, n_rows)
        self.cells = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(cells)))))  # where the postings of a term and block begin
        self.lists_read = self.postings_read = 0

    def parts(self, j: int) -> tuple[set[tuple], set[tuple]]:
        """The n-grams of an item's question and answer, in codes of words."""
        w = self.codes[self.ends[j] : self.ends[j + 1]].tolist()
        split = max(1, 2 * len(w) // 3)
        return grams(w[:split], self.gram), grams(w[split:], self.gram)

    def cells_of(self, terms: np.ndarray, owner: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of the block maxima, passage and block as one number) of the block lists of some terms."""
        which, at = self.maxima.places(terms[some])
        self.lists_read += len(at)
        return at, owner[some][which] * self.n_blocks + self.maxima.columns[at]

    def pivots(self, terms: np.ndarray, owner: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Which terms are weaker than their passage's pivot, and what these can add up to in each passage.

        Terms stand by passage and number, so the weakest come first. The pivot is the first term at which the
        sum of largest contributions reaches the threshold: an item without it and without any stronger term
        cannot reach it.
        """
        own = self.most[terms]
        sums = np.cumsum(own)
        first = np.searchsorted(owner, np.arange(n))
        sums -= (sums - own)[first][owner]
        weak = sums < threshold - 1e-4
        rest = np.zeros(n)
        rest[owner[weak]] = sums[weak]  # the last of a passage's weak terms stays
        return weak, rest

    def matches(self, text: str | None, threshold: float, question: float, answer: float) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, passages) of one document; the best passage counts."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        step, unknown = self.longest, len(self.terms)
        get = self.terms.get
        codes = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
        starts = range(0, max(1, len(words) - step), step)
        at_once = max(1, BOUNDS // (2 * step * self.n_blocks))
        out: dict[int, tuple[float, float, float, int]] = {}
        for first in range(0, len(starts), at_once):
            passages = [codes[s : s + 2 * step] for s in starts[first : first + at_once]]
            rows = [np.unique(x) for x in passages]
            owner, terms = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)
            weak, rest = self.pivots(terms, owner, len(rows), threshold)
            strong = np.flatnonzero(~weak)
            at, cell = self.cells_of(terms, owner, strong)
            bounds = np.bincount(cell, self.maxima.values[at], len(rows) * self.n_blocks)
            opened = ((bounds > 0).reshape(len(rows), -1) & (bounds.reshape(len(rows), -1) + rest[:, None] >= threshold - 1e-4)).any(axis=1)
            more, more_cell = self.cells_of(terms, owner, np.flatnonzero(weak & opened[owner]))
            bounds += np.bincount(more_cell, self.maxima.values[more], len(bounds))
            reached = (bounds >= threshold - 1e-4) & np.repeat(opened, self.n_blocks)
            at, cell = np.concatenate((at, more)), np.concatenate((cell, more_cell))
            inside = reached[cell]
            at, whose = at[inside], cell[inside] // self.n_blocks
            by_passage = np.argsort(whose, kind="stable")
            at, whose = at[by_passage], whose[by_passage]
            reached = reached.reshape(len(rows), -1)
            for p in np.flatnonzero(reached.any(axis=1)).tolist():
                lo, hi = np.searchsorted(whose, [p, p + 1])
                cells = at[lo:hi]
                there = stretches(self.cells[cells], self.cells[cells + 1] - self.cells[cells])
                scores = np.bincount(self.postings.columns[there], self.postings.values[there], len(self.ids))
                self.postings_read += len(there)
                good = np.flatnonzero((scores > 0) & (scores >= threshold - 1e-9)).tolist()
                if not good:
                    continue
                said = passages[p].tolist()
                have = grams(said, self.gram)
                for j in good:
                    asked, answered = (self._overlap(wanted, have, said) for wanted in self.parts(j))
                    if asked >= question and answered >= answer:
                        old = out.get(j, (0.0, 0.0, 0.0, 0))
                        out[j] = (max(old[0], float(scores[j])), max(old[1], asked), max(old[2], answered), old[3] + 1)
        return [(self.ids[j], *x) for j, x in sorted(out.items())]

    def _overlap(self, wanted: set, have: set, said: list[int]) -> float:
        if not wanted:
            return 1.0
        short = len(next(iter(wanted)))
        if have and len(next(iter(have))) != short:  # a part of fewer words than a gram
            have = grams(said, short)
        return len(wanted & have) / len(wanted)


def item_shards(benchmark: DataFrame, gram: int, shard_chars: int, shard_terms: int) -> Iterator[ItemIndex]:
    """Indexes of bounded size over all items, built in Spark tasks; one at a time is on the driver."""

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, text, len(w), list(dict.fromkeys(w))) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (w := words_of(text))]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "text", "n", "terms"])

    read = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(per_batch(parse), "item_id long, text string, n long, terms array<string>")
    parsed = cut(read.withColumn("deal", F.xxhash64("item_id", F.monotonically_increasing_id())), "items")
    n_items, length, longest, terms, chars = parsed.agg(F.count("*"), F.sum("n"), F.max("n"), F.sum(F.size("terms")), F.sum(F.length("text"))).first()
    if not n_items:
        return
    shard = F.pmod("deal", F.lit(max(-(-chars // shard_chars), -(-terms // shard_terms)))).alias("shard")
    df = parsed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    of_shard = parsed.select(shard, F.explode("terms").alias("term")).distinct().join(df, "term").select("shard", "term", "df")

    def build(items: pa.Table, counts: pa.Table) -> pa.Table:
        known = dict(zip(counts["term"].to_pylist(), counts["df"].to_pylist(), strict=True))
        pairs = list(zip(items["item_id"].to_pylist(), items["text"].to_pylist(), strict=True))
        index = ItemIndex(pairs, gram, whole=(n_items, length / n_items, longest, known))
        return pa.table({"shard": items["shard"][:1], "index": pa.array([pickle.dumps(index)], pa.binary())})

    grouped = parsed.select(shard, "item_id", "text").groupBy("shard").cogroup(of_shard.groupBy("shard"))
    built = cut(grouped.applyInArrow(build, "shard long, index binary"), "item-index")
    for k in sorted(r[0] for r in built.select("shard").collect()):
        yield pickle.loads(built.where(F.col("shard") == k).first()["index"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, gram: int = 3, shard_chars: int = 20_000_000, shard_terms: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap, passages) for each leaked item of each document."""
    schema = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, passages long"
    spark, out = docs.sparkSession, None
    for index in item_shards(benchmark, gram, shard_chars, shard_terms):
        shared = spark.sparkContext.broadcast(index)

        def find(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index, rows = shared.value, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc_id, *x) for x in index.matches(text, threshold, question, answer)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap", "passages"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(per_batch(find), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, gram: int = 3, shard_chars: int = 20_000_000, shard_terms: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; one pass for each shard of items, nothing is shuffled."""
    spark, kept = docs.sparkSession, docs
    for k, index in enumerate(item_shards(benchmark, gram, shard_chars, shard_terms)):
        shared = spark.sparkContext.broadcast(index)

        def clean(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index = shared.value
            return batch.filter(pa.array([not index.matches(x, threshold, question, answer) for x in batch.column("text").to_pylist()], pa.bool_()))

        if k:  # one shard's index at a time is in a task
            kept = cut(kept, "decontaminated")
        kept = kept.mapInArrow(per_batch(clean), docs.schema)
    return kept


def oracle_sql(threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, gram: int = 3) -> str:
    """``contaminated`` without an index, for DuckDB: every item against every passage; doubles with six decimals."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
    grams = lambda x, n: f"list_distinct(list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n} - 1], ' ')))"
    return rf"""
with item as (select item_id, w, len(w) as n, greatest(1, 2 * len(w) // 3) as split from (select item_id, {words} as w from benchmark) where len(w) > 0),
whole as (select count(*) as items, avg(n) as average, max(n) as longest from item),
tf as (select item_id, any_value(n) as n, term, count(*) as tf from (select item_id, n, unnest(w) as term from item) group by item_id, term),
df as (select term, count(*) as df from tf group by term),
weight as (select item_id, term, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average)) as x from tf join df using (term), whole),
share as (select item_id, term, x / sum(x) over (partition by item_id) as x from weight),
parts as (select item_id, {grams("q", "gq")} as q, gq, case when len(a) > 0 then {grams("a", "ga")} else [] end as a, ga from (select *, least({gram}, len(q)) as gq, least({gram}, len(a)) as ga from (select item_id, w[1:split] as q, w[split + 1:] as a from item))),
doc as (select row_number() over () as rn, doc_id, {words} as w from documents),
passage as (select rn, doc_id, start, w[start + 1:start + 2 * longest] as w from (select rn, doc_id, w, longest, unnest(range(0, greatest(1, len(w) - longest), longest)) as start from doc, whole where len(w) > 0)),
scored as (select rn, doc_id, start, item_id, sum(x) as score from (select distinct rn, doc_id, start, unnest(w) as term from passage) join share using (term) group by all having sum(x) >= {threshold} - 1e-9),
seen as (
  select s.rn, s.doc_id, s.item_id, score, len(list_intersect(q, {grams("w", "gq")})) / len(q) as asked,
    case when len(a) = 0 then 1.0 else len(list_intersect(a, {grams("w", "ga")})) / len(a) end as answered
  from scored s join passage p on p.rn = s.rn and p.start = s.start join parts using (item_id)
)
select doc_id, item_id, round(max(score), 6) as bm25, round(max(asked), 6) as question_overlap, round(max(answered), 6) as answer_overlap, count(*) as passages
from seen where asked >= {question} and answered >= {answer} group by rn, doc_id, item_id
"""
