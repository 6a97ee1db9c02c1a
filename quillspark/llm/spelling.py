"""Spelling variants: words one edit apart, by wildcard groups and deletions, each tied to its much more frequent near word.

A replacement puts two words into the group of one (position, prefix, suffix). A group keeps its size and its two first words, which is all that each member
needs: how many others there are, and the most frequent of them. Insertions and deletions are one join of every word's deletions with
the vocabulary. No group is paired with itself. A group has at most as many words as the alphabet has letters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, null_safe

SHORTEST, LEAST, RATIO, DROPPED, HELD = 6, 5, 5, 199, 500_000
#: Keys longer than this are named by digest, so that a very long word's keys don't take the square of its length.
KEY = 64


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, dropped: int = DROPPED) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z lowered, one code point left out where `dropped` divides the run's checksum.

    Runs are counted in each task before the shuffle, in tables of at most HELD words. A null key is the empty text in the checksum.
    """
    run_of = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % shortest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                body = body.as_py()
                if body is None:
                    continue
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in Counter(run_of.findall(body.encode().lower())).items():
                    h = zlib.crc32(word, start)
                    if h % dropped == 0:
                        points = word.decode()
                        at = h % len(points)
                        if len(points) <= shortest:
                            continue
                        word = (points[:at] + points[at + 1 :]).encode()
                    held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    runs = null_safe(docs, key, text).select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).mapInArrow(count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _key(s: Column) -> Column:
    return F.when(F.length(s) <= KEY, s).otherwise(F.sha2(s, 256))


def _each(word: str, hole: str) -> Column:
    """The word with each of its code points replaced by `hole`, which no word has."""
    w = F.col(word)
    return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: _key(F.concat(w.substr(F.lit(1), i - 1), F.lit(hole), w.substr(i + 1, F.length(w)))))


def replacements(words: DataFrame) -> DataFrame:
    """(word, size, best): for each wildcard group with others, how many they are and the first of them by count and code points."""
    wild = words.select("word", "n", F.explode(_each("word", "\0")).alias("key"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("near"))
    wild = wild.select("word", me.alias("me"), (F.count("*").over(w) - 1).alias("size"), F.first(me).over(w).alias("first"), F.nth_value(me, 2).over(w).alias("second"))
    return wild.filter("size > 0").select("word", "size", F.when(F.col("first.near") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("best"))


def indels(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, size, best) for each word and each deletion of it that is a word: a row for either."""
    cut = words.filter(F.length("word") > shortest).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(_each("word", ""))).alias("key"))
    both = cut.join(words.select("word", "n", _key(F.col("word")).alias("key")), "key")
    link = lambda word, near, n: F.struct(F.col(word).alias("word"), F.lit(1).cast("long").alias("size"), F.struct((-F.col(n)).alias("minus"), F.col(near).alias("near")).alias("best"))
    return both.select(F.explode(F.array(link("long", "word", "n"), link("word", "long", "long_n"))).alias("x")).select("x.*")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): the last form of each word that has one. Each round doubles the steps that are taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spell-roots")
    for _ in range(rounds):
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("on"))
        wider = materialize(now.join(onward, now["root"] == onward["via"], "left").select("word", F.coalesce("on", "root").alias("root")), "spell-roots")
        discard(now)
        now = wider
    return now


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, dropped: int = DROPPED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    Null and empty texts hold no words; texts and words of any length are whole; repeated rows count as often as they come, with one checksum. Of near words with
    equal counts the smallest in code-point order is the form. An empty table gives no row. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, or they could go in circles")
    words = materialize(vocabulary(docs, text, key, shortest, least, dropped), "spell-words")
    near = replacements(words).unionByName(indels(words, shortest)).groupBy("word").agg(F.sum("size").alias("n_near"), F.min("best").alias("best"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))
    out = materialize(out.select("word", F.when(is_form, F.col("form")).alias("form"), "n", "n_near", F.when(is_form, F.col("form_n")).alias("form_n")), "spell-forms")
    discard(words)
    most = out.agg(F.max("n")).first()[0] or least
    steps = max(1, math.floor(math.log(max(most / least, 1), ratio)))
    last = roots(out.filter("form IS NOT NULL"), math.ceil(math.log2(steps)))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
sums AS (
  SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[1 + xor(c, b) % 256]))) AS h FROM bytes, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: left(word, i) || '?' || substr(word, i + 2))) AS hole FROM words),
cuts AS (SELECT DISTINCT word, n, replace(hole, '?', '') AS cut FROM holes),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.cut
  UNION ALL SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.cut),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS spot, form AS next FROM forms
  UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.next)
SELECT word, form, (SELECT spot FROM walk k WHERE k.word = f.word AND next IS NULL) AS root, n, n_near, form_n FROM forms f"""
