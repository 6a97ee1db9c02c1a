"""Near-duplicates by word shingles: SimHash with BK-trees over band shards, then shards of texts with a rare shingle in common; exact similarity, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, discard, first_of_each, materialize, null_safe, only_kept, parts
from quillspark.llm.simhash_dedup import BUCKET, banded, majority, shard_links

SHINGLE, LEAST = 5, (4, 5)  # Jaccard similarity as a fraction
COMMON, MOST_COMMON = 64, 200_000
#: Trees find fingerprints up to TREE_RADIUS bits apart, in shards that agree on AGREE blocks of bits; a tree holds about LARGEST_TREE words.
TREE_RADIUS, AGREE, LARGEST_TREE = 4, 2, 512
RADIUS, PLAIN, LARGE, BLOCK, COLUMNS, PART = 24, 32, 64, 512, 4096, 1_000_000
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Words(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: bytes, known: Words, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, no words are none."""
    words = text.lower().split()  # bytes: lower() touches A-Z only, split() takes \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : len(w) - width + 1 + i]) * SPREAD[i % len(SPREAD)]
        h ^= h >> np.uint64(29)
    h *= SPREAD[0]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def digest(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def prefix(n: int, least: tuple[int, int] = LEAST) -> int:
    """Of two sets as similar as `least`, each has a common member among its first so many in any one order of all members."""
    return n + (-n * least[0]) // least[1] + 1 if n else 0


def offered(docs: DataFrame, text: str, shingle: int, least: tuple[int, int], common: np.ndarray | None) -> DataFrame:
    """(x, h): a set and each shingle of its prefix. Common shingles (least common last) come after all others.

    Without `common`, only h, in hash order, for counting.
    """
    order = None if common is None else np.argsort(common)
    sent = None if common is None else docs.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Words(), set()
        names, places = sent.value if sent else (np.zeros(0, np.uint64), None)
        for batch in batches:
            xs, hs, held = [], [], 0
            for t in batch.column(0):
                found = shingles(t.as_buffer().to_pybytes(), known, shingle) if t.is_valid else ()
                if not len(found) or (x := digest(found)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(x)
                keep = prefix(len(found), least)
                if sent is None:
                    hs.append(found[:keep].view(np.int64))
                else:
                    first = found[:keep]
                    if len(names):
                        at = np.searchsorted(names, found)
                        at[at == len(names)] = 0
                        met = names[at] == found
                        first = found[~met][:keep]
                        if len(first) < keep:
                            late = found[met]
                            first = np.concatenate([first, late[np.argsort(-places[at[met]])][: keep - len(first)]])
                    xs.append(np.full(len(first), x, np.int64))
                    hs.append(first.view(np.int64))
                held += len(hs[-1])
                if held > 1 << 20:
                    yield table(xs, hs)
                    xs, hs, held = [], [], 0
            if hs:
                yield table(xs, hs)

    def table(*columns: list[np.ndarray]) -> pa.RecordBatch:
        full = {k: np.concatenate(c) for k, c in zip(("x", "h"), columns) if c}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in full.values()], names=list(full))

    return null_safe(docs, text).mapInArrow(run, "h long" if common is None else "x long, h long")


def whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """Columns of a whole partition, rows sorted by h and x, repeated rows left out."""
    got = [[b.column(i).to_numpy() for i in range(2)] for b in batches if b.num_rows]
    if not got:
        return []
    x, h = (np.concatenate(c) for c in zip(*got))
    at = np.lexsort((x, h))
    x, h = x[at], h[at]
    new = np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]))
    return [x[new], h[new]]


def bounds(h: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of each run of equal values of at least so many."""
    cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    ends = np.append(cuts[1:], len(h))
    return np.stack([cuts, ends], axis=1)[ends - cuts >= least]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, x): shards, that is sets with a prefix shingle in common, once for the same sets."""
    if got := whole(batches):
        x, h = got
        seen, names, members, held = set(), [], [], 0
        for a, b in bounds(h, 2):
            g = digest(x[a:b])
            if g not in seen:
                seen.add(g)
                names.append(np.full(b - a, g, np.int64))
                members.append(x[a:b])
                held += b - a
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (names, members)], names=["g", "x"])
                names, members, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (names, members)], names=["g", "x"])


def may_link(n: np.ndarray, fp: np.ndarray, i: int, least: tuple[int, int]) -> np.ndarray:
    """Which sets could be similar enough to set i by their sizes and fingerprints.

    Fingerprints are 64-bit SimHashes of the sets. At a similarity of 0.8 they differ in 10 bits on average, with a standard
    deviation of 2.9, so RADIUS is five deviations off; sets of up to PLAIN shingles, where bits are coarse, always pass.
    """
    fits = (n * least[1] >= n[i] * least[0]) & (n[i] * least[1] >= n * least[0])
    return fits & ((np.bitwise_count(fp ^ fp[i]) <= RADIUS) | (np.minimum(n, n[i]) <= PLAIN))


def tree_pairs(about: DataFrame, radius: int = TREE_RADIUS, largest: int = LARGEST_TREE) -> DataFrame:
    """Pairs (a, b) of sets (x, fp) whose fingerprints the BK-trees of band shards find within the radius, or that are equal.

    They connect what all such pairs connect. A shard above `largest` words is dealt to several trees; what those leave apart, like
    all that is similar beyond the radius, meets in the shards of rare shingles.
    """
    words = materialize(about.groupBy("fp").agg(F.min("x").alias("x")), "sd-words")
    sharded = banded(words, radius, AGREE)
    sizes = materialize(sharded.groupBy("band", "shard").agg(F.count("*").alias("n")).filter("n > 1"), "sd-bands")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tree = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / largest))
    met = sharded.join(sizes.hint("merge"), ["band", "shard"]).select(F.struct("band", tree.alias("tree")).alias("b"), "shard", "fp")
    met = met.select(F.xxhash64("b").alias("band"), "shard", "fp", F.pmod(F.xxhash64("b", "shard"), F.lit(max(parts(about.sparkSession), total // BUCKET + 1))).alias("bucket"))
    links = met.groupBy("bucket").applyInPandas(lambda f: shard_links(f, radius), "a long, b long").distinct().toDF("p", "q")
    found = links.join(words.toDF("p", "a").hint("merge"), "p").join(words.toDF("q", "b").hint("merge"), "q").select("a", "b")
    same = about.select("x", "fp").join(words.toDF("fp", "least").hint("merge"), "fp").filter("x <> least").select(F.col("least").alias("a"), F.col("x").alias("b"))
    return found.unionAll(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def pivot_pairs(groups: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of each shard's pivot and the others: the set whose fingerprint is nearest to the shard's majority.

    Edited copies of one text all resemble the text more than each other, and its fingerprint is near their majority.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                x, n, fp = (batch.column(i)[row].values.to_numpy() for i in (1, 2, 3))
                n, fp = n.astype(np.int64), fp.view(np.uint64)
                pivot = int(np.bitwise_count(fp ^ np.uint64(majority(fp))).argmin())
                others = may_link(n, fp, pivot, least)
                others[pivot] = False
                found.append(np.stack([np.minimum(x[others], x[pivot]), np.maximum(x[others], x[pivot])]))
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def hopeful(groups: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Members (x) of shards of three sets or more that could be similar enough to some other member; all of large shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                x, n, fp = (batch.column(i)[row].values.to_numpy() for i in (1, 2, 3))
                if len(x) > LARGE:
                    found.append(x)
                elif len(x) > 2:
                    n, fp = n.astype(np.int64), fp.view(np.uint64)
                    found.append(x[[may_link(n, fp, i, least).sum() > 1 for i in range(len(x))]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["x"])

    return groups.mapInArrow(run, "x long").distinct()


def parted_pairs(groups: DataFrame, least: tuple[int, int]) -> DataFrame:
    """All pairs (a, b) of a small shard's sets of different components c that could be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for row in range(batch.num_rows):
                x, n, fp, c = (batch.column(i)[row].values.to_numpy() for i in range(4))
                n, fp = n.astype(np.int64), fp.view(np.uint64)
                for i in range(len(x) - 1):
                    others = may_link(n[i:], fp[i:], 0, least) & (c[i:] != c[i])
                    found.append(np.stack([np.minimum(x[i:][others], x[i]), np.maximum(x[i:][others], x[i])]))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.select("x", "n", "fp", "c").mapInArrow(run, "a long, b long").distinct()


def family_links(member: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) of large shards' sets (g, x, c) between components: exact, without a row a pair.

    The shards of one text and its copies overlap, so those with the same largest component are one family. A family is cut
    into blocks of about BLOCK sets, the members of that component apart from the others, and each pair of blocks that can
    hold two components is one task's work, which counts common shingles by products of 0/1 matrices and returns a
    spanning forest of its links. Sets move once a block pair, so rows grow with members times blocks.
    """
    main = member.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("f"), F.count("*").alias("parts")).filter("parts > 1")
    family = member.join(main.select("g", "f"), "g").select("f", "x", "c", (F.col("c") != F.col("f")).alias("apart")).distinct()
    family = materialize(family, "sd-family")
    blocks = family.groupBy("f").agg(F.ceil(F.count_if(~F.col("apart")) / BLOCK).cast("int").alias("inside"), F.ceil(F.count_if("apart") / BLOCK).cast("int").alias("outside"))
    spread = F.pmod(F.xxhash64("x"), F.when(F.col("apart"), F.col("outside")).otherwise(F.col("inside"))).cast("int")
    rows = family.join(blocks, "f").withColumn("u", spread + F.when(F.col("apart"), F.col("inside")).otherwise(0))
    rows = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("inside") + F.col("outside") - 1))).filter("u >= inside OR v >= inside")
    rows = rows.select("f", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), (F.col("u") <= F.col("v")).alias("low"), "x", "c")

    def compare(table: pa.Table) -> pa.Table:
        x, c, low = (table[k].to_numpy() for k in ("x", "c", "low"))
        same = table["lo"][0].as_py() == table["hi"][0].as_py()
        lists = [v.values.to_numpy() for v in table["h"]]
        left = np.flatnonzero(low)
        right = left if same else np.flatnonzero(~low)
        n = np.array([len(v) for v in lists], np.int64)
        owner = np.repeat(np.arange(len(x)), n)
        names, at, many = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        kept = np.flatnonzero(many > 1)
        place = np.full(len(names), -1)
        place[kept] = np.arange(len(kept))
        owner, at = owner[place[at] >= 0], place[at][place[at] >= 0]
        common = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, len(kept), COLUMNS):
            part = (at >= start) & (at < start + COLUMNS)
            has = np.zeros((len(x), min(COLUMNS, len(kept) - start)), np.float32)
            has[owner[part], at[part] - start] = 1
            common += has[left] @ has[right].T
        near = common * least[1] >= (n[left][:, None] + n[right][None, :] - common) * least[0]
        near &= c[left][:, None] != c[right][None, :]
        root = {k: k for k in set(c.tolist())}

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        out = []
        for i, j in zip(*np.nonzero(near)):
            p, q = find(int(c[left[i]])), find(int(c[right[j]]))
            if p != q:
                root[p] = q
                out.append((int(x[left[i]]), int(x[right[j]])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.join(sets, "x").groupBy("f", "lo", "hi").applyInArrow(compare, "a long, b long")


def verified(found: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are similar enough."""
    both = found.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b").select("a", "b", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for row in range(batch.num_rows):
                p, q = (batch.column(i)[row].values.to_numpy() for i in (2, 3))
                same = len(np.intersect1d(p, q, assume_unique=True))
                good[row] = same * least[1] >= (len(p) + len(q) - same) * least[0]
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(id, component_id) of every row: the smallest key reachable by links of texts with a shingle similarity of `least`.

    Texts with equal shingle sets are one class and never paired; nulls count as empty. SimHash fingerprints of the sets are searched by
    BK-trees over band shards, see tree_pairs. A radius that shards can be cut for doesn't reach all sets as similar as that, but they share a
    shingle of their prefixes in one order of all shingles, so each such pair also meets in a shard of a rare shingle; common shingles are last in
    that order. First what the trees found is compared, and each of these shards' sets with its pivot. Then, where a shard's sets are still in different
    components, all pairs across components are compared: those of small shards that sizes and SimHash fingerprints allow
    (see may_link, whose fingerprints leave out a pair at the threshold with a probability of about 10^-6), and those of large ones in blocks (see
    family_links). So large groups of near copies aren't paired in full. A link counts only by the exact similarity of the two sets. Rows with null keys link as
    others do, and keys may repeat.
    """
    with only_kept() as keep:
        labels, smallest = labelled(docs, text, key, shingle, least)
        keep(labels, smallest)
    return labels.join(smallest, "c").select("id", "component_id")


def labelled(docs: DataFrame, text: str, key: str, shingle: int, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(id, c) of every row, and (c, component_id): components by name of a set, and the smallest key of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", known, shingle) for t in batch.column(2)]
            columns = [pa.array([digest(f) for f in found], pa.int64()), pa.array(list(map(len, found)), pa.int32()), pa.array(np.array(list(map(majority, found)), np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "name", "x", "n", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce("text", F.lit(""))
    rows = null_safe(docs, key, text).toDF("id", "text").select("id", F.struct(F.xxhash64(body).alias("p"), F.xxhash64(F.lit(7), body).alias("q")).alias("name"), "text")
    ids = materialize(rows.mapInArrow(run, f"id {kind}, name struct<p:bigint,q:bigint>, x long, n int, fp long"), "sd-ids")
    counts = offered(docs, text, shingle, least, None).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    common = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    # a task holds its shingles whole: there are more tasks, not larger ones, when there are more shingles
    most = ids.agg(F.sum(F.floor(F.col("n") * (least[1] - least[0]) / least[1]) + 1)).first()[0] or 0
    shards = offered(docs, text, shingle, least, common).repartition(max(parts(docs.sparkSession), most // PART + 1), "h").mapInArrow(grouped, "g long, x long").distinct()
    about = ids.groupBy("x").agg(F.first("n").alias("n"), F.first("fp").alias("fp"))
    trees = materialize(tree_pairs(about), "sd-trees")
    shards = materialize(shards.join(about, "x"), "sd-shards")
    groups = shards.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("x", "n", "fp"))).alias("m"))
    groups = materialize(groups.select("g", "m.x", "m.n", "m.fp"), "sd-groups")
    first = materialize(trees.unionAll(pivot_pairs(groups, least)).distinct(), "sd-pairs")
    nodes = first.select(F.explode(F.array("a", "b")).alias("x")).unionAll(hopeful(groups, least))
    nodes = materialize(nodes.distinct(), "sd-nodes")
    least_id = materialize(ids.join(nodes, "x").groupBy("x").agg(F.min(F.struct("name", "id")).alias("m")).select("m.name", "m.id"), "sd-named")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", known, shingle) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(f) for f in found], pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["x", "h"])

    one = least_id.toDF("its_name", "its_id")  # a text of each set, by its digest and key, which may be null
    texts = rows.join(one, (F.col("name") == F.col("its_name")) & F.col("id").eqNullSafe(F.col("its_id")), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(spell, "x long, h array<long>").join(nodes, "x", "left_semi").dropDuplicates(["x"]), "sd-sets")
    links = materialize(verified(first, sets, least), "sd-links")
    comps = materialize(connected_components(links), "sd-components")
    sized = groups.select("g", F.size("x").alias("size")).filter("size > 2")
    member = shards.join(sized, "g").join(comps, F.col("x") == F.col("node"), "left").select("g", "x", "n", "fp", "size", F.coalesce("component", "x").alias("c"))
    member = materialize(member, "sd-member")
    parted = member.filter(F.col("size") <= LARGE).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("x", "n", "fp", "c"))).alias("m")).select("m.x", "m.n", "m.fp", "m.c")
    rest = parted_pairs(parted.filter(F.size(F.array_distinct("c")) > 1), least)
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "sd-rest")
    more = materialize(verified(rest, sets, least).unionAll(family_links(member.filter(F.col("size") > LARGE), sets, least)), "sd-more")
    discard(shards, groups, first, nodes, least_id, sets, member, rest)  # the largest go before the components are found
    if not more.isEmpty():
        comps = materialize(connected_components(links.unionAll(more)), "sd-components")
    labels = materialize(ids.join(comps, F.col("x") == F.col("node"), "left").select("id", F.coalesce("component", "x").alias("c")), "sd-labels")
    smallest = materialize(labels.groupBy("c").agg(F.min("id").alias("component_id")), "sd-smallest")
    return labels, smallest


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest key stays (one row, should the key repeat).

    Rows with a null key stay, as nothing names them. Null and empty texts are copies of each other. All columns stay as they are.
    """
    found = components(docs, text, key, shingle, least).filter("id = component_id").select("id")
    return first_of_each(docs, materialize(found, "sd-kept"), text, key)
