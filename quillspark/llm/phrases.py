"""Phrase collocation mining: every n-gram counted per language, scored at its weakest cut, extensions anti-joined, ranked.

n-grams become rows (language, phrase, count), counted within each chunk of texts before the shuffle. A phrase of two or more words can
only be frequent if all its pairs are, so pairs are counted first, by 64-bit hash, which can only count too much; the frequent ones set bits of a fixed-size filter, and
n-grams are made only where all their pairs pass it. A filter that is full lets everything pass: it never loses a phrase, and counts are exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import by_bytes, materialize, null_safe

MOST, LEAST, TOP, SCALE, SHARE = 4, 30, 2000, 2_000_000, 80
FILTER_BITS, SALTS, CHUNK, NO_LANG = 1 << 26, 64, 2 << 20, "und"
#: Piece ends and tabs as the reader below wants them: 0xFF stands in no UTF-8 text.
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")
GRAMS = "lang string, phrase string, k int, f long"


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, in order."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


class Chunk:
    """The words of some texts: codes in order, which of them are piece ends, and each one's language."""

    def __init__(self, texts: list[bytes], langs: list[bytes]) -> None:
        marked = [t.lower().translate(_PIECES).replace(b"\xff", b" \xff ").split() for t in texts]
        sizes = np.array([len(m) for m in marked]) + 1
        flat = []
        for m in marked:
            flat += m
            flat.append(b"\xff")
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = pa.array(langs, pa.binary()).dictionary_encode()
        self.langs, self.lang = names.dictionary, np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        end = pc.index(self.words, pa.scalar(b"\xff", pa.large_binary())).as_py()
        self.real = self.code != end if end >= 0 else np.ones(len(self.code), bool)

    def rows(self, at: np.ndarray, counts: np.ndarray, k: int) -> pa.RecordBatch:
        words = [self.words.take(pa.array(self.code[at + j])) for j in range(k)]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        lang = self.langs.take(pa.array(self.lang[at])).cast(pa.string())
        phrase = phrase.cast(pa.large_string()).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(at), k, np.int32)), pa.array(counts)], names=["lang", "phrase", "k", "f"])

    def total(self) -> pa.RecordBatch:
        """All word occurrences of each language, as the phrase of no words."""
        counts = np.bincount(self.lang[self.real], minlength=len(self.langs))
        return pa.RecordBatch.from_arrays(
            [self.langs.cast(pa.string()), pa.array([""] * len(self.langs)), pa.array(np.zeros(len(self.langs), np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "k", "f"]
        )

    def grams(self, most: int, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counted n-grams of one word, and of two and more whose pairs (the word at a place and the next) are all marked."""
        place = np.flatnonzero(self.real)
        name = self.lang[place] * len(self.words) + self.code[place]
        for k in range(1, most + 1):
            if k > 1:
                ok = pairs[place + k - 2]
                place = place[ok]
                name = same[ok] * len(self.words) + self.code[place + k - 1]  # noqa: F821
            if not len(place):
                return
            same = pa.array(name).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.bincount(same)
            first = np.empty(len(counts), np.int64)
            first[same[::-1]] = place[::-1]
            yield self.rows(first, counts.astype(np.int64), k)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Which places begin a pair of words in one piece, and those pairs' hashes, with the language."""
        is_pair = np.append(self.real[:-1] & self.real[1:], False)
        at = np.flatnonzero(is_pair)
        word = _hashes(self.words)
        return is_pair, _mixed(_hashes(self.langs)[self.lang[at]], _mixed(word[self.code[at]], word[self.code[at + 1]]))


def _chunks(batch: pa.RecordBatch) -> Iterator[Chunk]:
    langs, texts = batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()
    for part in by_bytes(list(range(len(sizes))), sizes, CHUNK):
        take = pa.array(part, pa.int64())
        yield Chunk(texts.take(take).to_pylist(), langs.take(take).to_pylist())


def pair_filter(docs: DataFrame, least: int = LEAST) -> np.ndarray:
    """The bits of frequent pairs, FILTER_BITS of them whatever the input: 8 MB on the driver and in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch):
                found = pc.value_counts(pa.array(chunk.pairs()[1].view(np.int64)))
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["pair", "f"])

    often = docs.mapInArrow(run, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    spot = F.pmod("pair", F.lit(FILTER_BITS))
    rows = often.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(pair, {FILTER_BITS}) % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def counted(docs: DataFrame, bits: np.ndarray, most: int) -> DataFrame:
    """Rows (lang, phrase, k, f), each the count of one chunk of texts; docs are (lang, text) without nulls."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch):
                is_pair, hashed = chunk.pairs()
                spot = (hashed % np.uint64(FILTER_BITS)).astype(np.int64)
                is_pair[is_pair] = sent.value[spot >> 6] >> (spot & 63) & 1 == 1
                yield chunk.total()
                yield from chunk.grams(most, is_pair)

    return docs.mapInArrow(run, GRAMS)


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, f) of all n-grams of 1 to `most` words with at least `least` occurrences, and each language's word count as k = 0."""
    docs = null_safe(docs, lang, text).select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    counts = counted(docs, pair_filter(docs, least), most).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return materialize(counts.filter((F.col("f") >= least) | (F.col("k") == 0)), "phrases")


def scored(grams: DataFrame, scale: int = SCALE) -> DataFrame:
    """Candidates (lang, phrase, k, a, l, r, score): phrases of two words and more at the cut with the least score, the first of equals."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cut = grams.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = grams.select(F.col("lang"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = grams.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    cut = cut.withColumn("score", F.expr(f"(CAST({scale} AS DECIMAL(10,0)) * {exact('a')}) DIV ({exact('l')} + {exact('r')})"))
    least = F.min(F.struct("score", "cut", "l", "r")).alias("m")
    return cut.groupBy("lang", "phrase", "k", "a").agg(least).select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def maximal(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates that no longer candidate holds with `share` percent of their occurrences or more.

    Extensions by one word are enough: whatever lies between a phrase and a longer one that holds it is as frequent as the longer one.
    """
    words = F.split("phrase", " ")
    short = F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))
    longer = candidates.filter("k > 2").select("lang", F.col("a").alias("whole"), F.explode(short).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    exact = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n)
    held = longer.join(candidates.select("lang", "phrase", "a"), ["lang", "phrase"]).filter(exact("whole", 100) >= exact("a", share)).select("lang", "phrase")
    return candidates.join(held, ["lang", "phrase"], "left_anti")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language. Each of some salts of a language is cut to its own first ones before one task ranks what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language.

    Null texts hold no words and a null language is `und`, one with documents that say so. Texts of any length go in chunks of bounded
    bytes, a text alone if it is longer; n-grams never cross documents. Repeated rows count as often as they come. An empty table, and a language without a
    frequent phrase, give no row. Other columns are not read.
    """
    grams = frequent(docs, text, lang, most, least)
    candidates = materialize(scored(grams), "phrases-scored")
    best = ranked(maximal(candidates), top)
    n = grams.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM words, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM grams WHERE k > 1 AND f >= 30),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
candidates AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM candidates WHERE k > 2) b
    ON b.lang = c.lang AND b.phrase = c.phrase AND 100 * b.a >= 80 * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM candidates ANTI JOIN held USING (lang, phrase)) JOIN totals USING (lang)
WHERE rank <= 2000"""
