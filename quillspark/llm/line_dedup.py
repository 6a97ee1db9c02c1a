"""Repeated line runs: rank classes of line-ID suffixes by distributed prefix doubling, and the intervals they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, discard, materialize, null_safe, only_kept, private

MIN_WORDS = 50
LAST = (1 << 63) - 1


def digest(*columns: Column | str) -> Column:
    """A 128-bit name as two longs: equal inputs, equal names."""
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit(7), *columns).alias("y"))


def row_name(text: str, key: str) -> Column:
    """Names a row and gives its place in the order: its key (null last), then a digest of its text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.struct(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(body).alias("tie"))


def lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)


def repeated(names: DataFrame, label: str) -> DataFrame:
    """Names that stand at two places or more, with the first place: the intervals at one depth of the suffix array."""
    place = F.struct("doc", "pos")
    groups = names.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return materialize(groups.filter("first <> last").drop("last"), label)


def islands(base: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Lines that repeat, and the shortest runs of min_words words that start or end at each of them.

    Such runs stay within neighbouring repeated lines. Both tables are written; the second is (doc, pos, depth).
    """
    level = base.join(repeated(base, "ld-groups0").select("name"), "name", "left_semi").dropDuplicates(["doc", "pos"])
    level = materialize(level.select("doc", "pos", "name", "words"), "ld-level")
    order = Window.partitionBy("doc").orderBy("pos")
    island = level.select("doc", "pos", "words", (F.col("pos") - F.row_number().over(order)).alias("island"))
    isle = Window.partitionBy("doc", "island")
    below = F.coalesce(F.sum("words").over(isle.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = island.withColumn("below", below)
    ends = marks.groupBy("doc", "island").agg((F.max("pos") + 1).alias("pos"), F.max(F.col("below") + F.col("words")).alias("below"))
    marks = marks.select("doc", "island", "pos", "below").unionByName(ends).withColumn("above", -F.col("below"))
    end = F.min("pos").over(isle.orderBy("above").rangeBetween(Window.unboundedPreceding, -min_words))
    start = F.max("pos").over(isle.orderBy("below").rangeBetween(Window.unboundedPreceding, -min_words))
    both = marks.select("doc", "pos", end.alias("end"), start.alias("start"))
    runs = both.select("doc", F.explode(F.array(F.struct("pos", F.col("end")), F.struct(F.col("start").alias("pos"), F.col("pos").alias("end")))).alias("run"))
    runs = runs.select("doc", "run.pos", (F.col("run.end") - F.col("run.pos")).alias("depth")).filter("depth > 0").distinct()
    return level.select("doc", "pos", "name"), materialize(runs, "ld-runs")


def run_intervals(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, pos, depth, first): runs of `depth` lines from `pos` that stand elsewhere too, first of all at `first`.

    Each is one place of an interval of the suffix array of line-ID sequences, at the least depth that has min_words
    words. Listed are the shortest such runs that start at a line and those that end at one: together they cover just
    the lines of all repeated runs of min_words words or more, however long, so the maximal runs are their unions.

    Suffixes get their rank classes by prefix doubling: a class at depth 2h is the pair of the classes at depth h of a
    suffix and of the one h lines on, and a run of a depth between is the pair of two overlapping classes. Only suffixes
    whose class repeats go on to the next depth, and doubling ends when no run needs a deeper class: deeper ranks can't
    change which lines repeat. Classes are named by 128-bit digests, so no round sorts; a line that a third of all
    rows share costs a partial aggregate, and a join against a written table that adaptive execution splits.
    """
    base = docs.select(row_name(text, key).alias("doc"), F.posexplode(lines(text)).alias("pos", "line"))
    base = base.select("doc", "pos", digest("line").alias("name"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))
    base = materialize(base, "ld-lines")
    level, runs = islands(base, min_words)
    deepest = runs.agg(F.max("depth")).first()[0] or 0
    found, depth = None, 1
    while found is None or depth <= deepest:
        here = runs.filter(F.col("depth").between(depth, 2 * depth - 1))
        left = level.withColumnRenamed("name", "left")
        right = level.select("doc", (F.col("pos") + depth).alias("end"), F.col("name").alias("right"))
        pairs = here.join(left, ["doc", "pos"]).withColumn("end", F.col("pos") + F.col("depth")).join(right, ["doc", "end"])
        named = materialize(pairs.select("doc", "pos", "depth", digest("depth", "left", "right").alias("name")), "ld-named")
        hits = materialize(named.join(repeated(named, "ld-shared"), "name").select("doc", "pos", "depth", "first"), "ld-hits")
        found = hits if found is None else found.unionAll(hits)
        discard(named)
        depth *= 2
        if depth <= deepest:
            ahead = level.select("doc", (F.col("pos") - depth // 2).alias("pos"), F.col("name").alias("next"))
            doubled = materialize(level.join(ahead, ["doc", "pos"]).select("doc", "pos", digest("name", "next").alias("name")), "ld-doubled")
            level = materialize(doubled.join(repeated(doubled, "ld-groups").select("name"), "name", "left_semi").select("doc", "pos", "name"), "ld-level")
            discard(doubled)
    discard(base)
    return found


def deletions(docs: DataFrame, text: str, key: str, min_words: int) -> DataFrame:
    """(doc, gone): numbers of the lines that go of each document that loses any."""
    hits = run_intervals(docs, text, key, min_words)
    later = hits.filter(F.col("first") != F.struct("doc", "pos")).select("doc", "pos", (F.col("pos") + F.col("depth")).alias("end"))
    # runs that overlap become one span before any line is listed, so each line is listed once
    order = Window.partitionBy("doc").orderBy("pos", "end")
    spans = later.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("span", F.sum(F.when(F.col("pos") <= F.col("reach"), 0).otherwise(1)).over(order))
    spans = spans.groupBy("doc", "span").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    gone = spans.select("doc", F.explode(F.sequence("pos", F.col("end") - 1)).alias("pos"))
    return gone.groupBy("doc").agg(F.collect_list("pos").alias("gone"))


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs deleted from the text, and n_lines and n_removed added.

    A line goes if it lies in a run of min_words words or more that also starts at an earlier place, in the order of
    keys and lines; the same document counts. A run may be one long line, or many short or blank ones. Null texts stay
    null and have one empty line. Rows equal in key and text count as one place and are treated alike; null keys come
    last. Keys are integers. Other columns stay as they are, but for columns named n_lines or n_removed, whose place the
    added ones take. An empty table gives no rows.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")))
    row, owner, gone_, lines_ = private(docs, "row", "owner", "gone", "lines")
    with only_kept() as keep:
        gone = materialize(deletions(null_safe(docs, key, text), text, key, min_words).toDF(owner, gone_), "ld-gone")
        keep(gone)
    # what goes grows with the input, so it is never broadcast: the plan is the same at every size
    kept_columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select(*kept_columns, row_name(text, key).alias(row)).join(gone.hint("merge"), F.col(row) == F.col(owner), "left")
    all_lines = lines(text)
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone_))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(lines_), i)), "\n")
    out = joined.withColumn(lines_, F.when(F.col(gone_).isNotNull(), all_lines))
    return out.select(
        *(F.when(F.col(gone_).isNotNull(), kept).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns),
        F.size(all_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias("n_removed"),
    )


LINES_SQL = f"""
WITH docs AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS l FROM documents),
ls AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM docs),
cum AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w,
         sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM ls),
ends AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.pos),
runs AS (SELECT r.doc_id, s, e, md5(array_to_string(l[s + 1 : e + 1], chr(10))) AS body FROM ends r JOIN docs d USING (doc_id)),
firsts AS (SELECT body, min(struct_pack(d := doc_id, s := s)) AS f FROM runs GROUP BY body),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM runs JOIN firsts USING (body) WHERE f <> struct_pack(d := doc_id, s := s))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.pos IS NULL), '') AS text,
       count(*) AS n_lines, count(g.pos) AS n_removed
FROM ls LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
"""
