"""Queries of excerpts and refill waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import excerpts
from quillspark.plans import admission
from quillspark.queries.base import files
from quillspark.session import load


def excerpt_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one unit of text."""
    d = load(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.lit(0).alias("n"), F.lit("text").alias("k"), "text")
    p = excerpts.pieces(d, ["doc_id"], "n", "k", "text")
    return p.select("doc_id", "piece", F.col("start").cast("long").alias("start"), F.md5("text").alias("text"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of admitted files as pieces, with headings and table rows among them."""
    f = files(spark, sf_dir)
    d = admission.decisions(f).filter("action IN ('keep', 'compress')").select("run_id", "relative_path")
    lines = f.join(d, ["run_id", "relative_path"]).select("run_id", "file_identity", "extension", "relative_path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    kind = F.when(F.col("line").startswith("#") | (F.col("n") % 17 == 0), "heading").when(F.col("line").contains("|"), "table_row").when(F.col("n") % 19 == 5, "total").otherwise("text")
    return excerpts.pieces(lines.withColumn("k", kind), ["run_id", "file_identity", "extension", "relative_path"], "n", "k", "line")


def excerpt_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of a run's admitted files within 9,000 characters; tests compare it with a plain version."""
    given = excerpts.allocate(_parts(spark, sf_dir), "run_id", "file_identity", "extension", "relative_path", F.col("relative_path").startswith("notes/"), 9_000)
    return given.select("run_id", "file_identity", "chars", "pieces", F.md5("text").alias("text"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("doc_id") % 5 != 0, F.floor(F.least("n_chars", F.lit(6_000)) / 3)).cast("long")
    return files(spark, sf_dir).select("run_id", "file_identity", known.alias("rendered"), F.when(F.col("doc_id") % 3 != 0, F.lit(2)).alias("inspected"))


def refill_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the wave that admitted them; tests compare it with a plain version."""
    return admission.waves(files(spark, sf_dir), _outcomes(spark, sf_dir))[0]


def refill_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each run stopped, and after which wave."""
    return admission.waves(files(spark, sf_dir), _outcomes(spark, sf_dir))[1]


QUERIES = {f.__name__: f for f in (excerpt_pieces, excerpt_allocation, refill_admissions, refill_stops)}
ORACLES = {
    "excerpt_pieces": """WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n。！？]*[\\n。！？]|[^\\n。！？]+$') AS s FROM documents WHERE text <> ''),
      p AS (SELECT doc_id, unnest(range(0, len(s))) AS piece, unnest(s) AS t FROM d WHERE length(text) > 512 UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) BETWEEN 1 AND 512),
      o AS (SELECT *, CAST(coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
      SELECT doc_id, CAST(piece AS INTEGER) AS piece, start, md5(t) AS text FROM o WHERE length(t) <= 512""",
}
