"""Packing documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, null_safe

LENGTH, END, TOKENIZER, LANES, CACHE = 2048, 1, "word_bpe_49k.json", 1024, 300_000
LETTERS = "a-z\xdf-\xf6\xf8-ɏ"
#: Lower-cased text of these characters splits as the tokenizer's own pattern does.
PLAIN = re.compile(f"[\t\n\r\x20-\x7e{LETTERS}]*")
#: The tokenizer's split pattern over such characters. Fixed values.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")
_loaded: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordCache:
    """Ids of whole texts as little-endian 32-bit words, from a bounded cache of encoded words.

    The tokenizer's pattern never crosses white space, so what stands between white space is encoded once for all its
    places: split by the pattern, spelt in the byte alphabet, and given to the tokenizer's own model many at a time.
    Texts with other than plain Latin characters, or with something like a special token, go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.spelt = Tokenizer.from_file(path)
        self.spelt.normalizer = normalizers.Sequence([])
        self.spelt.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        split = [SPLIT.findall(c) for c in chunks]
        words = " ".join([w for s in split for w in s])
        words = words.encode().decode("latin-1").translate(self.letters).replace(self.letters[32], " ").split(" ")
        lines = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.spelt.encode_batch_fast(lines, add_special_tokens=False)])
        word_ends = np.flatnonzero(self.ends_word[ids]) + 1
        ends = (4 * word_ends[np.cumsum([len(s) for s in split]) - 1]).tolist()
        raw = ids.tobytes()
        self.known.update(zip(chunks, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def ids(self, text: str) -> bytes:
        lowered = text.lower()
        if "<|" in text or not PLAIN.fullmatch(lowered):
            return np.array(self.encode([text])[0], "<u4").tobytes()
        chunks = lowered.split()
        missing = list(set(chunks).difference(self.known))
        if missing:
            if len(self.known) + len(missing) > CACHE:
                self.known.clear()
                missing = list(set(chunks))
            self.learn(missing)
        return b"".join(map(self.known.__getitem__, chunks))


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """key, start, length, ids_crc32 and doc_tokens of each piece: documents cut every `length` ids, after the end id.

    A null text is empty and has the end id alone.
    """
    path = path or tokenizer_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _loaded.setdefault(path, None) or _loaded.__setitem__(path, WordCache(path)) or _loaded[path]
        for batch in batches:
            source, start, size, crc, total = [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                ids = cache.ids(x.as_py() or "") + end
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    source.append(i), start.append(at // 4), size.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(len(ids) // 4)
            columns = [batch.column(0).take(pa.array(source, pa.int32())), *(pa.array(c, pa.int64()) for c in (start, size, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return null_safe(docs, key, text).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) of a histogram of piece lengths.

    Longest first: pieces of a length go to the emptiest open packs, or to new ones if they fit in none (Krell et al.,
    Efficient Sequence Packing without Cross-contamination, 2021). Packs of one pattern are a run of sequences with a
    count, so the work depends on the number of lengths, not of documents.
    """
    open_packs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: runs (first sequence, count)
    rooms: list[int] = []  # heap of negated rooms
    placed, sequences = [], 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            while rooms and not open_packs[-rooms[0]]:
                heappop(rooms)
            if rooms and -rooms[0] >= size:
                room = -rooms[0]
                first, count = open_packs[room].pop()
                if count > left:
                    open_packs[room].append((first + left, count - left))
                    count = left
            else:
                room, first, count = length, sequences, left
                sequences += left
            placed.append((size, rank, count, first, length - room))
            rank, left = rank + count, left - count
            if room > size:
                if not open_packs[room - size]:
                    heappush(rooms, size - room)
                open_packs[room - size].append((first, count))
    return placed


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, path: str | None = None, lanes: int = LANES) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece.

    The texts are tokenized once, into a narrow written table. Its histogram, one row for each of at most `length`
    lengths, is all that the driver gets. A piece's rank among its length is its rank in one of `lanes` digest ranges
    plus what the ranges before hold, so a length with a third of all pieces is spread out. Placements are joined by
    rank with a binary search; they are bounded by the square of `length`, whatever the input. Repeated rows are packed
    as often as they come.
    """
    cut = materialize(pieces(docs, text, key, length, path), "pack-pieces")
    lane = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(lanes))
    cut_lanes = cut.withColumn("lane", lane)
    counts = materialize(cut_lanes.groupBy("length", "lane").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = sorted(shortest_pack_first(histogram, length))
    placed = np.array(placed, np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-lanes")
    discard(counts)
    inside = Window.partitionBy("length", "lane").orderBy("id", "start", "ids_crc32")
    ranked = cut_lanes.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["length", "lane"])
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("inside")).alias("rank"))
    keys = placed[:, 0] << 40 | placed[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            row = placed[np.searchsorted(keys, size << 40 | rank, side="right") - 1] if len(size) else placed[:0]
            out = [*(batch.column(i) for i in range(5)), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(out, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
