"""Corpus pipeline: from documents to a mixed reading order, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last,
returns the columns of ``documents``. Labels and benchmark items come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlight.llm import decontam, jaccard, line_dedup, mixing, toxicity
from setlight.llm.common import cut, table, unused
from setlight.shipping import ship


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with other names for its columns called like one of ``names``, and the columns that undo it."""
    clash = [c for c in docs.columns if c.lower() in names]
    other = dict(zip(clash, unused(docs, *(f"own_{c}" for c in clash)), strict=True))
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    ship(spark)
    rows, own = set_aside(docs, "held_out", "score", "predicted")
    return toxicity.score_toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0").select(*own)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows where lines went."""
    ship(spark)
    rows, own = set_aside(docs, "kept", "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(rows)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*own)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    ship(spark)
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The reading order: every document at least once, small sources up to twice."""
    ship(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("jaccard join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Fitted models and hash permutations are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
