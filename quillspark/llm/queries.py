"""Queries over the operators of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import embedding_dedup, html_extract, language_model, line_dedup, media, mixing, packing, phrases, pii, simhash_dedup, spelling, suffix_dedup, toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents"))


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, read(spark, sf_dir, "labels"))
    return toxicity.judge(docs, chain).drop("text")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and the text that is left; a character that a cut splits is U+FFFD in it."""
    left = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return left.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(read(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_iso_media, op2_line_runs, op3_toxicity, op4_main_text, op5_surrogates, op6_suffix_array, op7_mixture, op8_embeddings, op9_packing, op10_simhash, op11_attention, op12_spelling, op13_phrases)}
ORACLES = {"op2_line_runs": line_dedup.LINES_SQL, "op7_mixture": mixing.MIX_SQL, "op12_spelling": spelling.VARIANTS_SQL, "op13_phrases": phrases.PHRASES_SQL}
