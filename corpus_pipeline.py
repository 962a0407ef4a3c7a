"""A training-corpus pipeline: five of the operators applied to ``documents`` one after another.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents; the last adds token ids instead.  ``run`` writes every stage's rows to the
shared folder and reads them back as the next one's docs.

Defined cases, stage by stage: null and empty texts have a classifier score like any other text, and fail the
quality rules (no 50 words), so no stage behind sees them; null ids, languages and sources are values of their
own; of rows that are equal in id and text the near-dedup keeps one, as of any group of copies; extra columns are
carried by all stages but the last, whatever their names; an empty table passes every stage as an empty table
with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import mixing, near_dups, pieces, quality_classifier, quality_rules
from lexispark.llm.common import fresh, settle
from lexispark.sources.tables import table


def beside(docs: DataFrame, taken: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after an operator that gives columns named ``taken`` of its own."""
    names = {c: fresh(c) for c in docs.columns if c in taken}
    out = operator(docs.withColumnsRenamed(names))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    labels = table(spark, sf_dir, "labels")
    return beside(docs, ("score", "predicted"),
                  lambda d: quality_classifier.classify(d, labels).filter("predicted = 1"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents outside their group's fences go."""
    return quality_rules.keep_good(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return near_dups.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are repeated to their source's target weight and shuffled."""
    return beside(docs, ("copy_no", "mix_key"), mixing.mix_sources)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: doc_id, ids, n_tokens."""
    return pieces.encode(docs.select("doc_id", "text")).select("doc_id", "ids", "n_tokens")


STAGES = [("quality classifier", classified), ("quality rules", ruled),
          ("near-dedup", deduplicated), ("mixing", mixed), ("encoding", encoded)]

#: SQL cannot fit the classifier; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage{k}")
    return docs
