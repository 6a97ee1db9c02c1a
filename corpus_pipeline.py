"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Every stage takes empty tables (no rows come out), null and empty texts, null keys, repeated rows and texts of any length.
Only the columns of documents are kept, so further columns and their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, mixing, packing, shingle_dedup, toxicity
from quillspark.llm.common import discard, materialize, only_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain finds toxic go; the chain is fitted on the labels of documents that are here.

    Null and empty texts hold no terms and stay unless the labels call most such rows toxic. Labels without signal let all stay.
    """
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.judge(docs.select(*COLUMNS), chain).filter("not is_toxic").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; every document stays, if with less text. Null texts stay null."""
    kept = line_dedup.drop_repeats(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, Jaccard similarity of 0.8 or more.

    SimHash fingerprints of the shingle sets are searched by BK-trees over band shards; what is similar beyond the trees' radius meets by its
    rare shingles (README tells why), and the exact similarity decides on all. Null and wordless texts are copies of each other; of
    equal keys one row stays; rows with a null key stay.
    """
    return shingle_dedup.keep_first(docs.select(*COLUMNS))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mixture takes them: whole copies, and the border document of a source in part.

    Documents without words are never taken. A null source is one source, the last.
    """
    return mixing.take(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. Null texts are empty; repeated rows are packed as often as they come."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]
#: Fitted models, fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py compares each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with only_kept() as keep:
            after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(after)
        discard(docs)  # a stage's tables and its input go once its output is written
        docs = after
    return docs
