"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (one pass, no shuffle of text). Class
means and covariances are sums over all labelled rows, added up by Spark; each class covariance is
shrunk towards the pooled one and its diagonal. A document's score is the logistic of the difference
of two Gaussian log-densities, taken from Mahalanobis distances with Cholesky factors that are
computed once.

Defined cases: a null text counts as empty; empty texts have the all-zero statistics and get a score
like any other; null ids are scored but never labelled; repeated rows give repeated results; with no
labels every score is 0.5, with one class only it is that class.
"""

from __future__ import annotations

import math
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, one_label, per_batch

ASCII = np.arange(128)
LETTER = np.array([chr(i).isalpha() for i in ASCII])
UPPER = np.array([chr(i).isupper() for i in ASCII])
DIGIT = np.array([chr(i).isdigit() for i in ASCII])
PROSE = np.isin(ASCII, [ord(c) for c in ".,;:!?'\"()-"])
BLANK = np.array([chr(i).isspace() for i in ASCII])
SYMBOL = ~(LETTER | DIGIT | PROSE | BLANK) & (ASCII > 32)
N_STATS = 15


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text: logs of sizes, square roots of shares."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * N_STATS
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    low = hist[:128]
    n, nw = len(text), len(words)
    share = lambda k: math.sqrt(k / n)
    wide = n - int(low.sum())  # code points beyond ASCII
    p = hist[hist > 0] / len(raw)
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n),
        math.log1p(nw) - math.log1p(n),
        share(low[SYMBOL].sum()),
        share(low[PROSE].sum()),
        share(low[DIGIT].sum()),
        share(low[UPPER].sum()),
        share(low[LETTER].sum() + wide),
        math.sqrt(wide / n),
        math.sqrt(distinct / nw),
        math.log1p(distinct) / math.log1p(nw),
        math.sqrt(sum(map(eq, words, islice(words, 1, None))) / nw),
        math.log1p(max(map(len, words))),
        math.log1p(n / max(1, len(lines))),
        math.sqrt(len(set(lines)) / max(1, len(lines))),
        float(-(p * np.log2(p)).sum()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row of ``docs``."""

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch(stats), f"doc_id {kind}, stats array<double>")


class Discriminant:
    """Two shrunken Gaussian classes; ``moments`` maps a class to (n, sum x, sum x xT)."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], towards_pooled: float = 0.1, towards_diagonal: float = 0.05):
        self.only = None
        if len(moments) < 2:
            self.only = float(next(iter(moments), 0.5))
            return
        total = sum(m[0] for m in moments.values())
        means = {k: s / n for k, (n, s, _) in moments.items()}
        scatter = {k: ss / n - np.outer(means[k], means[k]) for k, (n, _, ss) in moments.items()}
        pooled = sum(moments[k][0] / total * scatter[k] for k in moments)
        diagonal = np.diag(np.diag(pooled) + 1e-6)
        self.parts = {}
        for k in (0, 1):
            a = towards_pooled + (1 - towards_pooled) * len(pooled) / (moments[k][0] + len(pooled))  # few rows: mostly pooled
            cov = (1 - a) * scatter[k] + a * pooled
            cov = (1 - towards_diagonal) * cov + towards_diagonal * diagonal
            chol = np.linalg.cholesky(cov)
            self.parts[k] = (means[k], np.linalg.inv(chol), math.log(moments[k][0] / total) - np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        log_density = [base - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, base in (self.parts[0], self.parts[1])]
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -30, 30)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Sums over all labelled rows outside the held-out fold; only 2 x (1 + k + k*k) numbers reach the driver."""
    x = F.col("stats")
    products = F.concat(F.array(F.lit(1.0)), x, F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b))))
    sums = (
        stats.where(~held_out())
        .join(one_label(labels, "quality"), "doc_id")
        .select("label", F.posexplode(products))
        .groupBy("label", "pos")
        .agg(F.sum("col").alias("s"))
        .toPandas()
    )
    moments = {}
    for k, part in sums.groupby("label"):
        v = part.sort_values("pos")["s"].to_numpy()
        moments[int(k)] = (v[0], v[1 : 1 + N_STATS], v[1 + N_STATS :].reshape(N_STATS, N_STATS))
    return Discriminant(moments)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    stats = cut(document_statistics(docs), "quality-stats")
    model = fit(stats, labels)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        s = model.score(flat.reshape(batch.num_rows, N_STATS))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.withColumn("held_out", held_out()).mapInArrow(per_batch(score), f"doc_id {kind}, held_out boolean, score double, predicted int")
