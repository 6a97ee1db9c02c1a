"""Repeated substrings: suffix arrays by linear grouping over candidate segments, then exact spans per document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import by_bytes, discard, materialize, null_safe
from quillspark.llm.line_dedup import row_name

MATCH, GRAM, STEP, LARGEST, BUCKET = 400, 200, 8, 1024, 4000
SLAB = 1 << 19
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of non-negative integers, by linear grouping (Baier, 2016).

    Suffixes start grouped by first symbol. Groups are closed from the highest down: each member's previous smaller
    suffix is found along the pointers of what lies between; such suffixes continue with the closed group's string, so
    they leave their own group for a new one just above it, those with more pointers higher. Then a group holds the
    suffixes with one Lyndon prefix. Last, suffixes are emitted in rising order: the one before an emitted suffix, and its
    chain of previous smaller ones, are the next of their groups. Nothing is renamed or solved recursively.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = np.asarray(symbols)[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(starts, n))
    size = np.zeros(n, np.int64)
    size[starts] = sizes
    group, place = np.empty(n, np.int64), np.empty(n, np.int64)
    group[order], place[order] = np.repeat(starts, sizes), np.arange(n)
    at, group, place, size = order.tolist(), group.tolist(), place.tolist(), size.tolist()
    previous = [-1] * n
    end = n
    while end:
        start = group[at[end - 1]]
        members = at[start:end] if end - start == 1 else sorted(at[start:end])
        pointers: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        end = start
        if len(pointers) == 1 or start == 0:
            counted = [list(pointers)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in pointers.items():
                by_count.setdefault(c, []).append(p)
            counted = [by_count[c] for c in sorted(by_count, reverse=True)]
        for same in counted:
            opened: dict[int, list[int]] = {}
            for p in same:  # to the upper end of its group
                g = group[p]
                size[g] -= 1
                last, spot = g + size[g], place[p]
                q = at[last]
                at[spot], at[last], place[q], place[p] = q, p, spot, last
                opened.setdefault(g, []).append(p)
            for g, who in opened.items():
                new = g + size[g]
                size[new] = len(who)
                for p in who:
                    group[p] = new
    out, free, emitted = [0] * n, list(range(n)), [False] * n
    for i in range(-1, n):
        s = (out[i] if i >= 0 else n) - 1
        while s >= 0 and not emitted[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            emitted[s] = True
            s = previous[s]
    return np.array(out, np.int64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, at least n of each."""
    if len(_powers.get(0, ())) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def gram_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each window of `length` values."""
    n = len(values)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, starts, anchor, key): every window of `match` bytes has one anchor, its least gram by hash.

    Equal windows have the same anchor inside, so a window repeats only if its anchor's gram does. Of equal hashes the
    last is taken. Neighbouring windows with one anchor are one segment.
    """
    h = gram_hashes(data, gram)
    width = match - gram + 1
    n = len(h) - width + 1
    low = np.uint64((1 << 20) - 1)
    keyed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    padded = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
    padded[: len(h)] = keyed
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    at = (low - (least[first] & low)).astype(np.int64)
    return first, np.diff(np.append(first, n)), at, h[at]


SEGMENTS = "k long, tie long, lo long, cnt int, at int, key long, x long, y long"


def segments(docs: DataFrame, text: str, key: str, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """One row per segment of each text: its row's name, first start, number of starts, anchor, key and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, tie = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            found: list[list] = [[] for _ in range(6)]
            rows = []
            for i, x in enumerate(batch.column(2)):
                raw = x.as_buffer() if x.is_valid else b""
                data = np.frombuffer(raw, np.uint8)
                for slab in range(0, len(data) - match + 1, SLAB):
                    first, count, at, keys = anchors(data[slab : slab + SLAB + match - 1], match, gram)
                    view = memoryview(raw)[slab:]
                    digests = b"".join([xxhash.xxh3_128_digest(view[a : a + c + match - 1]) for a, c in zip(first.tolist(), count.tolist())])
                    xy = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    for column, value in zip(found, (first + slab, count, at - first, keys.view(np.int64), xy[:, 0], xy[:, 1])):
                        column.append(value)
                    rows.append(np.full(len(first), i))
            if rows:
                row = np.concatenate(rows)
                lo, count, at, keys, dx, dy = map(np.concatenate, found)
                columns = [k[row], tie[row], lo.astype(np.int64), count.astype(np.int32), at.astype(np.int32), keys, dx, dy]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "tie", "lo", "cnt", "at", "key", "x", "y"])

    return docs.select("name.k", "name.tie", F.col(f"`{text}`")).mapInArrow(run, SEGMENTS)


def fetch(docs: DataFrame, wanted: DataFrame, text: str, match: int = MATCH) -> DataFrame:
    """The bytes of wanted segments; each text is met once by the list of its own segments."""
    lists = wanted.groupBy("k", "tie").agg(F.collect_list(F.struct("lo", "cnt", "at", "key", "alone", "crowded")).alias("all"))
    once = docs.select("name.k", "name.tie", F.col(f"`{text}`").alias("body")).join(lists, ["k", "tie"])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, tie = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                raw = batch.column(2)[i].as_buffer().to_pybytes()
                wanted = batch.column(3)[i].as_py()
                for some in by_bytes(wanted, [s["cnt"] + match for s in wanted]):
                    rows = [(k, tie, *s.values(), raw[s["lo"] : s["lo"] + s["cnt"] + match - 1]) for s in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["k", "tie", "lo", "cnt", "at", "key", "alone", "crowded", "seg"])

    return once.mapInArrow(run, "k long, tie long, lo long, cnt int, at int, key long, alone boolean, crowded boolean, seg binary")


def runs_of(k: np.ndarray, tie: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Sorted starts as runs (k, tie, lo, cnt)."""
    o = np.lexsort((start, tie, k))
    k, tie, start = k[o], tie[o], start[o]
    head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + 1))) if len(o) else o
    return pd.DataFrame({"k": k[head], "tie": tie[head], "lo": start[head], "cnt": np.diff(np.append(head, len(o)))})


def neighbour_lcp(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in `order` with the next one, in symbols, counted up to `most`. The last symbol must be unique."""
    a, b = order[:-1], order[1:]
    lcp, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for depth in range(most):
        ahead = np.maximum(a[alive], b[alive]) + depth < len(symbols)
        alive = alive[ahead]
        alive = alive[symbols[a[alive] + depth] == symbols[b[alive] + depth]]
        lcp[alive] = depth + 1
    return lcp


def repeated_starts(frame: pd.DataFrame, match: int = MATCH, step: int = STEP) -> pd.DataFrame:
    """Starts of the frame's lone segments whose window stands elsewhere in the frame too, as runs (k, tie, lo, cnt).

    Segments become rows of `step`-byte blocks that are aligned to the anchor, so equal windows around an anchor have
    equal blocks; match is a multiple of step. In the suffix array of all block rows, an interval whose longest common
    prefix has match / step - 1 blocks holds all suffixes with those bytes. A window is such a suffix, the bytes of the block
    before it that are the window's, and those after its last whole block: `step` bytes together. Windows are equal if
    and only if interval, place in the block and these bytes are, so the answer is exact.
    """
    segs, at = frame["seg"].tolist(), frame["at"].to_numpy() % step
    blocks = [np.frombuffer(s, f"<u{step}", (len(s) - a) // step, a) for s, a in zip(segs, at.tolist())]
    lengths = np.array([len(b) for b in blocks])
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    owner = np.repeat(np.arange(len(segs)), lengths + 1)
    inner = np.ones(ends[-1], bool)
    inner[ends - 1] = False
    symbols = np.empty(ends[-1], np.int64)
    symbols[~inner] = np.arange(len(segs))  # a separator of its own ends each segment, so no common prefix crosses it
    symbols[inner] = np.unique(np.concatenate(blocks), return_inverse=True)[1] + len(segs)
    order = suffix_array(symbols)
    need = match // step - 1
    deep = neighbour_lcp(symbols, order, need) >= need
    interval = np.append(0, np.cumsum(~deep))
    chosen = np.append(deep, False) | np.append(False, deep)
    suffix, interval = order[chosen], interval[chosen]
    j, begin = np.repeat(owner[suffix], step), np.tile(np.arange(step), len(suffix))  # the window begins so many bytes before
    start = np.repeat(at[owner[suffix]] + step * (suffix - begins[owner[suffix]]), step) - begin
    interval = np.repeat(interval, step)
    ok = (start >= 0) & (start < frame["cnt"].to_numpy()[j])
    j, start, begin, interval = j[ok], start[ok], begin[ok], interval[ok]
    data = np.frombuffer(b"".join(segs), np.uint8)
    base = np.append(0, np.cumsum([len(s) for s in segs]))[:-1]
    edge = np.array([[i if i < d else i + match - step for i in range(step)] for d in range(step)])
    rest = data[(base[j] + start)[:, None] + edge[begin]].view(f"<u{step}").ravel()
    o = np.lexsort((rest, begin, interval))
    same = np.append(False, (interval[o][1:] == interval[o][:-1]) & (begin[o][1:] == begin[o][:-1]) & (rest[o][1:] == rest[o][:-1]))
    many = np.zeros(len(o), bool)
    many[o] = same | np.append(same[1:], False)
    hit = many & frame["alone"].to_numpy()[j]
    j, start = j[hit], start[hit]
    return runs_of(frame["k"].to_numpy()[j], frame["tie"].to_numpy()[j], frame["lo"].to_numpy()[j] + start)


def crowded_starts(segs: DataFrame, match: int = MATCH) -> tuple[DataFrame, list[DataFrame]]:
    """The same for segments whose key has too many different segments for one task: windows meet by their digests.

    Also the written tables that the result reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, tie, lo, cnt, alone, seg = (batch.column(c)[i].as_py() for c in range(6))
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(seg[s : s + match]) for s in range(cnt)]), np.int64).reshape(-1, 2)
                columns = [np.full(cnt, k), np.full(cnt, tie), lo + np.arange(cnt), np.full(cnt, alone), both[:, 0], both[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "tie", "lo", "alone", "x", "y"])

    schema = "k long, tie long, lo long, alone boolean, x long, y long"
    windows = materialize(segs.select("k", "tie", "lo", "cnt", "alone", "seg").mapInArrow(run, schema), "sd-windows")
    place = F.struct("k", "tie", "lo")
    twice = windows.groupBy("x", "y").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("x", "y")
    twice = materialize(twice, "sd-twice")
    hits = windows.filter("alone").join(twice, ["x", "y"], "left_semi")
    return hits.select("k", "tie", "lo", F.lit(1).cast("long").alias("cnt")), [windows, twice]


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", match: int = MATCH, largest: int = LARGEST) -> DataFrame:
    """(k, tie, lo, cnt): runs of starts of `match`-byte strings that start anywhere else too. docs has its row's name."""
    segs = materialize(segments(docs, text, key, match, match // 2), "sd-segments")
    place = F.struct("k", "tie", "lo", "cnt", "at")
    classes = segs.groupBy("key", "x", "y").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    classes = materialize(classes, "sd-classes")
    keys = classes.groupBy("key").agg(F.count("*").alias("different"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    keys = materialize(keys, "sd-keys")
    twice = materialize(classes.filter("n > 1").select("key", "x", "y"), "sd-whole")
    whole = segs.join(twice, ["key", "x", "y"], "left_semi")
    whole = materialize(whole.select("k", "tie", "lo", F.col("cnt").cast("long").alias("cnt")), "sd-runs")
    discard(segs, twice)
    unsure = classes.join(keys.filter("different > 1"), "key")
    unsure = unsure.select("first.*", "key", (F.col("n") == 1).alias("alone"), (F.col("different") > largest).alias("crowded"))
    unsure = materialize(unsure, "sd-unsure")
    discard(classes, keys)
    got = materialize(fetch(docs, unsure, text, match), "sd-bytes")
    discard(unsure)
    buckets = max(1, got.filter("not crowded").count() // BUCKET + 1)
    bucketed = got.filter("not crowded").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    partial = bucketed.groupBy("bucket").applyInPandas(lambda f: repeated_starts(f, match), "k long, tie long, lo long, cnt long")
    crowded, made = crowded_starts(got.filter("crowded"), match)
    out = materialize(whole.unionAll(partial).unionAll(crowded), "sd-partial")
    discard(whole, got, *made)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", match: int = MATCH, largest: int = LARGEST) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row.

    A byte goes if a string of `match` bytes that covers it also starts anywhere else, in this text or another, judged on
    the input. Texts are cut at content-defined anchors into segments, such that equal strings lie in segments with one
    key. Segments that are equal whole repeat whole; only those that share a key but differ are fetched, and ordered by
    suffix arrays in buckets of keys. A key with more than `largest` different segments goes by window digests instead,
    with no limit on its size. No text leaves its document but for such segments. Null texts are empty; rows equal in key
    and text repeat each other; null keys are allowed. Digests have 128 bits;
    inside a bucket bytes are compared. Other columns are not read, so their names don't matter; an empty table gives no rows.
    """
    named = null_safe(docs, key, text).withColumn("name", row_name(text, key))
    found = repeated_runs(named, text, key, match, largest)
    spans = materialize(found.groupBy("k", "tie").agg(F.collect_list(F.struct("lo", "cnt")).alias("runs")), "sd-spans")
    discard(found)
    joined = named.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"), "name.k", "name.tie").join(spans, ["k", "tie"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, begun = [], 0, 0
            for at, (body, runs) in enumerate(zip(batch.column(1), batch.column(2))):
                raw = body.as_buffer().to_pybytes() if body.is_valid else b""
                kept, removed, count = raw, 0, 0
                if runs.is_valid:
                    s = runs.values.flatten()
                    lo, cnt = (np.asarray(c, np.int64) for c in s)
                    o = np.argsort(lo)
                    lo, hi = lo[o], np.maximum.accumulate((lo + cnt - 1 + match)[o])
                    head = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
                    a, b = lo[head].tolist(), hi[np.append(head[1:], len(lo)) - 1].tolist()
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)]))
                    removed, count = len(raw) - len(kept), len(a)
                rows.append((len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept))
                held += len(kept)
                if held > 32 << 20 or at == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(rows)), *columns], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                    rows, held, begun = [], 0, at + 1

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    kind = docs.schema[key].dataType.simpleString()
    return joined.select("id", "body", "runs").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
