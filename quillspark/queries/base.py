"""How the driver's tables stand for the pipeline's: documents as files of runs, events as calls, orders as caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import load

EXTENSIONS = (".txt", ".md", ".csv", ".json", ".log", ".docx", ".xlsx", ".pdf", ".doc", ".bin")
FOLDERS = ("notes", "Logs", "data/benchmarks", "work/A", ".pytest_cache", "mail", "work/b")

FILES_SQL = """files AS (
  SELECT source AS run_id, doc_id,
    ['.txt','.md','.csv','.json','.log','.docx','.xlsx','.pdf','.doc','.bin'][1 + doc_id % 10] AS extension,
    ['notes','Logs','data/benchmarks','work/A','.pytest_cache','mail','work/b'][1 + (doc_id // 10) % 7] || '/Doc' || doc_id
      || ['.txt','.md','.csv','.json','.log','.docx','.xlsx','.pdf','.doc','.bin'][1 + doc_id % 10] AS relative_path,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS size_bytes, n_chars, doc_id % 23 = 0 AS truncated, n_chars // 500 + 1 AS page_count, text AS content, lang
  FROM documents),
named AS (SELECT *, 'bootstrap:' || lower(relative_path) AS file_identity FROM files)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a run per source; path, extension and truncation by doc_id, size in bytes, pages by characters."""
    docs = load(spark, sf_dir, "documents")
    pick = lambda names, i: F.element_at(F.array(*(F.lit(n) for n in names)), (i + 1).cast("int"))
    extension = pick(EXTENSIONS, F.col("doc_id") % 10)
    path = F.concat(pick(FOLDERS, F.floor(F.col("doc_id") / 10) % 7), F.lit("/Doc"), F.col("doc_id").cast("string"), extension)
    out = docs.select(
        F.col("source").alias("run_id"), "doc_id", extension.alias("extension"), path.alias("relative_path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size_bytes"), "n_chars", (F.col("doc_id") % 23 == 0).alias("truncated"),
        (F.floor(F.col("n_chars") / 500) + 1).alias("page_count"), F.col("text").alias("content"), "lang",
    )
    return out.withColumn("file_identity", F.concat(F.lit("bootstrap:"), F.lower("relative_path")))
