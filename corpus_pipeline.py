"""A corpus pipeline of five stages over the table documents.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last keep the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, langid, lines, mixing, packing
from lodestone.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that was learned. What has no letter, or takes nearly a phrase per character even in its best language, goes.

    Where nothing can be learned (no text with a language) all stay.
    """
    samples = langid.learn(docs)
    if not samples:
        return docs
    found = langid.identify(docs, "text", samples)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("excess") <= langid.FOREIGN)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first; texts of which no line is left go."""
    return lines.deduplicate(docs, "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id, once; rows are known by id and text. Of null texts all stay."""
    kept = jaccard.classified(docs, "doc_id", "text").where("kept AND t1 IS NOT NULL")
    kept = materialise(kept.selectExpr("t1 AS _1", "t2 AS _2", "coalesce(doc_id, 0) AS _3", "doc_id IS NULL AS _4").distinct(), "kept")
    rows = docs.where("text IS NOT NULL").selectExpr("*", "xxhash64(text) AS _1", "xxhash64(1, text) AS _2", "coalesce(cast(doc_id AS bigint), 0) AS _3", "doc_id IS NULL AS _4")
    found = rows.hint("merge").join(kept, ["_1", "_2", "_3", "_4"]).dropDuplicates(["_1", "_2", "_3", "_4"])
    return found.select(*docs.columns).unionAll(docs.where("text IS NULL"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of words asks for."""
    return mixing.mixed(docs, "doc_id", "source", "text")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, "doc_id", "text", packing.word_bpe(packing.vocabulary()))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: The mixture is random and the packing online: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
