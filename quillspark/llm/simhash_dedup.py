"""SimHash near-duplicates: fingerprints, then BK-trees over band shards for every pair within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, first_of_each, materialize, null_safe, only_kept, parts, unsigned

SEED, SHINGLE, RADIUS, LARGEST_TREE, BUCKET = 42, 3, 2, 2048, 20_000


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the 64-bit values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(np.ascontiguousarray(h[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, majority of XXH64 over word shingles with repeats; no words: 0. A-Z are lower-cased."""
    words = text.lower().split()  # bytes: lower() touches A-Z only, split() takes \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return null_safe(docs, key, text).mapInArrow(run, f"id {kind}, fp long")


class BKTree:
    """Burkhard-Keller tree over 64-bit words: each child hangs on its integer Hamming distance to its parent."""

    def __init__(self) -> None:
        self.words: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, word: int) -> None:
        at = 0
        while at < len(self.words):
            d = (word ^ self.words[at]).bit_count()
            below = self.children[at]
            if d not in below:
                below[d] = len(self.words)
                break
            at = below[d]
        self.words.append(word)
        self.children.append({})

    def within(self, word: int, radius: int) -> Iterator[int]:
        """Words at most radius away: only edges in [d - radius, d + radius] can lead to them."""
        stack = [0] if self.words else []
        while stack:
            at = stack.pop()
            d = (word ^ self.words[at]).bit_count()
            if d <= radius:
                yield self.words[at]
            below = self.children[at]
            stack += [below[e] for e in range(d - radius, d + radius + 1) if e in below]


def shard_links(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links within each (band, shard) of the frame: every word looks into its shard's tree before it joins it.

    One link to each tree found is enough for components, so a word's links are thinned to one a component of its shard.
    """
    out = []
    for _, words in frame.groupby(["band", "shard"], sort=False)["fp"]:
        tree, root = BKTree(), {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]  # noqa: B023
            return x

        for word in words.tolist():
            word &= (1 << 64) - 1
            root[word] = word
            for other in tree.within(word, radius):
                a, b = find(word), find(other)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((word, other))
            tree.add(word)
    return pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def banded(words: DataFrame, radius: int, agree: int = 1) -> DataFrame:
    """(fp, band, shard): each word under each `agree` of its radius + agree blocks of bits. Words within the radius agree on so many."""
    blocks = radius + agree
    width = -(-64 // blocks)
    masks = [((1 << width) - 1) << width * i & (1 << 64) - 1 for i in range(blocks)]
    bands = [sum(some) - (1 << 64 if sum(some) >> 63 else 0) for some in combinations(masks, agree)]
    return words.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in bands))).alias("band", "shard"))


def radius_links(words: DataFrame, radius: int = RADIUS, largest: int = LARGEST_TREE) -> DataFrame:
    """Links (a, b) between distinct words (column fp) that connect exactly what pairs within the radius connect.

    radius + 1 bands cut the 64 bits; words within the radius agree on a whole band, so each band value is a shard and
    its tree is shipped to the tasks of that shard by the shuffle, not broadcast from the driver, which would have to
    gather all fingerprints. Shards of one word are dropped before any tree. A shard above `largest` words is not cut:
    its words go another exact way. At radius 2, each word meets under itself and its 64 one-bit neighbours, and two words
    within two bits have such a neighbour in common, so a meeting holds 65 words at most, all of which are linked.
    """
    sharded = banded(words, radius)
    sizes = materialize(sharded.groupBy("band", "shard").agg(F.count("*").alias("n")).filter("n > 1"), "bk-shards")
    met = sharded.join(sizes.hint("merge"), ["band", "shard"])  # sizes grow with the input, so they are never broadcast
    heavy = None
    if radius == 2:
        heavy = met.filter(F.col("n") > largest).select("fp").distinct()
        met = met.filter(F.col("n") <= largest)
    # a task gets a bounded number of words whatever the input: buckets grow with the words that meet
    total = sizes.filter(F.col("n") <= largest).agg(F.sum("n")).first()[0] or 0
    met = met.withColumn("bucket", F.pmod(F.xxhash64("band", "shard"), F.lit(max(parts(words.sparkSession), total // BUCKET + 1))))
    links = met.select("bucket", "band", "shard", "fp").groupBy("bucket").applyInPandas(lambda f: shard_links(f, radius), "a long, b long")
    if heavy is None:
        return links
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))
    meets = heavy.select("fp", F.explode(flips).alias("meet"))
    star = meets.groupBy("meet").agg(F.collect_set("fp").alias("all")).filter("size(all) > 1")
    star = star.select(F.explode(F.slice("all", 2, 65)).alias("a"), F.col("all")[0].alias("b"))
    return links.unionAll(star)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, largest: int = LARGEST_TREE) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (smallest key reachable by links of at most radius bits) of each row.

    Equal fingerprints are one word with its smallest key; copies are never paired. Null texts have fingerprint 0;
    repeated rows stay; a null key has a component only through others. Other columns are not read. An empty table gives
    no rows. Joins against tables that grow with the input go by merge at every size.
    """
    with only_kept() as keep:
        prints = materialize(fingerprints(docs, text, key), "sh-prints")
        labels = labelled(prints, radius, largest)
        keep(prints, labels)
    return prints.join(labels.hint("merge"), "fp").select(F.col("id").alias(key), unsigned(F.col("fp")).alias("fingerprint"), "component_id")


def labelled(prints: DataFrame, radius: int, largest: int) -> DataFrame:
    """(fp, component_id) of all distinct fingerprints of prints (id, fp)."""
    words = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "sh-words")
    links = materialize(radius_links(words.select("fp"), radius, largest), "sh-links")
    comps = materialize(connected_components(links), "sh-components")
    grouped = words.join(comps.hint("merge"), words["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    smallest = materialize(grouped.groupBy("c").agg(F.min("least").alias("component_id")), "sh-smallest")
    return materialize(grouped.join(smallest.hint("merge"), "c").select("fp", "component_id"), "sh-labels")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates by fingerprint: of each group the row with the smallest key stays (one row, should the key repeat).

    Rows with a null key stay, as nothing names them. All columns stay as they are.
    """
    near = near_duplicates(docs, text, key, radius).filter(F.col(f"`{key}`") == F.col("component_id"))
    return first_of_each(docs, materialize(near.select("component_id"), "sh-kept"), text, key)
