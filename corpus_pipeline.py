"""A pipeline that prepares training text: each stage works on what the one before it kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents.
A trusted text's quality decides first, so that junk costs nothing later; one document
of each group of near copies stays, then benchmark passages, personal data and the
mix of sources follow.

Every stage takes tables with nulls in any column, empty and very long texts, repeated
rows and ids, no rows at all, and columns of other names, which it passes on; what each
does with them is said where it is defined in loomstone.llm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import common, decontamination, jaccard, mixing, pii, quality


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without trusted labels none does, and a tie with the threshold stays."""
    return quality.without_rejected(docs, common.table(spark, sf_dir, "labels"))


def _one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; null ids and wordless texts have no copies."""
    return jaccard.one_of_each(docs)


def _decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; wordless ones and all of an empty benchmark's stay."""
    return decontamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def _redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; every row stays, and n_chars follows the text."""
    return pii.redacted(docs)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by ``copy``; null sources are one source, wordless texts have size 0."""
    return mixing.emit(docs, mixing.mix(docs))


def _swept(stage):
    """The stage, whose steps' garbage is collected before its rows are written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out = stage(spark, docs, sf_dir)
        common.collected(spark)
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES = [(name, _swept(stage)) for name, stage in (("quality", _quality), ("near_copies", _one_of_each), ("decontamination", _decontaminated), ("personal_data", _redacted), ("mixing", _mixed))]
#: The classifier's model can't be written in SQL; the tests hold every stage and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's rows are written as Parquet and read again.

    They are written in turns to two places below the shared checkpoint folder, over what
    nothing reads any more.
    """
    docs, place = common.table(spark, sf_dir, "documents"), f"pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"{place}/{k % 2}")
    return docs
