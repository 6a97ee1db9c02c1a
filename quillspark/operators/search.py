"""Full-text search over report fragments: trigram postings for phrases, folded substrings for short queries."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as fn


BUCKETS, SNIPPET = 64, 40


def fragments(reports: DataFrame, key: str, title: Column, body: Column, *kept: str) -> DataFrame:
    """One row a fragment with title and bounded body; empty bodies don't come."""
    out = reports.select(F.col(key).alias("report_key"), title.alias("title"), fn.bounded(fn.squeezed(body)).alias("body"), *kept)
    return out.filter(F.length("body") > 0)


def trigrams(text: Column) -> Column:
    """Distinct three-letter strings of a text, letter case folded."""
    return F.array_distinct(overlapping(F.lower(text), 3))


def overlapping(text: Column, n: int) -> Column:
    """All strings of n letters, one from each place, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def postings(rows: DataFrame) -> DataFrame:
    """(gram, report_key) of all fragments: the index, to be written partitioned by gram."""
    return rows.select("report_key", F.explode(trigrams(F.concat_ws("\n", "title", "body"))).alias("gram"))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS))


def signature(rows: DataFrame) -> DataFrame:
    """What changes whenever a fragment does: their number and the sum of their digests."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("report_key", "title", "body").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def stored_index(rows: DataFrame, path: str) -> DataFrame:
    """The postings of fragments as a table partitioned by gram bucket, written again only if the fragments have changed.

    A bucket is dealt to several tasks, so a gram that most fragments hold is no task's alone. The signature is written after the postings: an
    index whose writing was cut short has none, and is built again.
    """
    spark = rows.sparkSession
    now = tuple(signature(rows).first())
    try:
        fresh = tuple(spark.read.parquet(f"{path}/signature").select("n", "digest").first() or ()) == now
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = False
    if not fresh:
        spark.createDataFrame([], "n long, digest string").write.mode("overwrite").parquet(f"{path}/signature")
        grams = postings(rows).withColumn("bucket", bucket(F.col("gram")))
        dealt = grams.repartition("bucket", F.pmod(F.xxhash64("report_key"), F.lit(8)))
        dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        spark.createDataFrame([now], "n long, digest string").write.mode("overwrite").parquet(f"{path}/signature")
    return spark.read.schema(f"report_key {rows.schema['report_key'].dataType.simpleString()}, gram string, bucket long").parquet(f"{path}/postings")


def phrase_candidates(index: DataFrame, phrase: str) -> DataFrame:
    """Fragments that hold every trigram of a phrase of three letters or more: a filter, to be verified.

    Of a stored index only the buckets of the phrase's grams are read, and of these the row groups that may hold them.
    """
    low = phrase.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if "bucket" in index.columns:
        index = index.filter(F.col("bucket").isin(*(bucket(F.lit(g)) for g in grams)))
    return index.filter(F.col("gram").isin(grams)).groupBy("report_key").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("report_key")


def search(rows: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """Fragments that match: a phrase of three letters or more by folded substring, shorter ones by ASCII letter case only."""
    both = F.concat_ws("\n", "title", "body")
    if len(query) >= 3:
        if index is not None:
            rows = rows.join(phrase_candidates(index, query), "report_key", "left_semi")
        return rows.filter(F.lower(both).contains(query.lower()))
    return rows.filter(fn.ascii_lower(both).contains(query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))


def folded(text: str) -> str:
    """Letter case folded letter by letter, so that places stay."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def best_window(columns: list[str], query: str, tokens: int) -> tuple[int, int, list[int]] | None:
    """(column, first trigram, places of the phrase) of the window of trigrams that shows the phrase best; None without a hit.

    A window scores 1000 for the phrase and 1 for each further one in it. Windows stand around a hit, or begin where the hit's sentence does, which is
    worth 100, or 120 at the column's start, as long as that is before the hit. Of equal ones the first stays.
    """
    needle, width = folded(query), len(query) - 2
    best: tuple[int, int, int] = (0, 0, 0)
    found: list[list[int]] = []
    for at, text in enumerate(columns):
        low, size = folded(text), max(0, len(text) - 2)
        hits = [i for i in range(size) if low.startswith(needle, i)]
        found.append(hits)
        sentences = [i for i in range(size) if i == 0 or (text[i - 1] in " \t\n\r" and text[:i].rstrip(" \t\n\r")[-1:] in (".", ":") and text[:i].rstrip(" \t\n\r"))]
        for hit in hits:
            inside = [i for i in hits if hit <= i < hit + tokens]
            score = 999 + len(inside)
            start = max(0, min(hit - (tokens - (inside[-1] + width - hit)) // 2, size - tokens))
            if score > best[0]:
                best = (score, at, start)
            if size > tokens:
                begin = [s for s in sentences if s <= hit][-1]
                if begin < hit:
                    inside = [i for i in hits if begin <= i < begin + tokens]
                    score = (999 + len(inside) if inside else 0) + (120 if begin == 0 else 100)
                    if score > best[0]:
                        best = (score, at, begin)
    return (best[1], best[2], found[best[1]]) if best[0] else None


def match_snippet(columns: list[str], query: str, tokens: int = SNIPPET) -> str | None:
    """the best window of a phrase of three letters or more with its hits in brackets, and an ellipsis where text is left out."""
    window = best_window(columns, query, tokens)
    if window is None:
        return None
    at, first, hits = window
    text, size, width = columns[at], len(columns[at]) - 2, len(query) - 2
    last = min(first + tokens, size)
    out, place = ["…" if first else ""], first
    runs: list[list[int]] = []
    for hit in hits:  # hits that share a letter are one
        if runs and hit < runs[-1][1] + 2:
            runs[-1][1] = max(runs[-1][1], hit + width)
        else:
            runs.append([hit, hit + width])
    for begin, end in runs:
        begin, end = max(begin, first), min(end, last)
        if begin < end:
            out += [text[place : max(begin, place)], "[", text[max(begin, place) : end + 2], "]"]
            place = end + 2
    return "".join([*out, text[place : last + 2], "…" if last < size else ""])


def snippets(rows: DataFrame, query: str) -> DataFrame:
    """rows of hits with their snippet: match_snippet of title and body, in Arrow batches."""

    def shown(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([match_snippet([t or "", b or ""], query) for t, b in zip(titles, bodies)], dtype="object")

    return rows.withColumn("snippet", F.pandas_udf(shown, "string")("title", "body"))


def page(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in order; the limit is held between 1 and 500."""
    return hits.orderBy(*order).limit(max(1, min(500, limit)))


def many_phrases(rows: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str, most: int = 32 << 20) -> DataFrame:
    """(key, phrase_key) of rows and phrases where the row's text holds the whole phrase; null and empty phrases match nothing.

    Phrases are the small side: they go to the tasks as an automaton that finds all of them in one scan of the texts, without
    a shuffle. Their size is checked: past `most` bytes they are dealt to as many automata as are needed, a scan each.
    """
    spark = rows.sparkSession
    wanted = phrases.select(F.col(phrase_key).alias("item"), F.col(phrase).alias("phrase")).filter("phrase <> ''")
    total = wanted.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    shards = int(total // most) + 1
    kind, item = rows.schema[key].dataType.simpleString(), phrases.schema[phrase_key].dataType.simpleString()

    def matches(shard: int) -> DataFrame:
        sent = spark.sparkContext.broadcast([tuple(r) for r in wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == shard).collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            same: dict[str, list] = defaultdict(list)
            for i, words in sent.value:
                same[words].append(i)
            automaton = ahocorasick.Automaton()
            for words, items in same.items():
                automaton.add_word(words, items)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, x in enumerate(batch.column(1).to_pylist() if same else ()):
                    for n in {n for _, items in automaton.iter(x or "") for n in items}:
                        at.append(i)
                        found.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, types[item])], names=[key, phrase_key])

        return rows.select(key, text).mapInArrow(run, f"{key} {kind}, {phrase_key} {item}")

    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return reduce(DataFrame.unionAll, map(matches, range(shards)))
