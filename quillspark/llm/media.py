"""ISO media containers as columns: walk nested boxes and decode sample tables without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import by_bytes, materialize, null_safe

#: Boxes whose content is boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"moof", b"traf", b"mvex"})
#: Bytes before the sample entry's own boxes, by handler.
VISUAL_ENTRY, AUDIO_ENTRY = 78, 28
RATE, CHUNK, BLOCK = 8000, 1 << 16, 64

TRACKS = (
    "array<struct<track_id:long,kind:string,codec:string,timescale:long,duration:long,duration_s:double,samples:long,"
    "bytes:long,keyframes:array<struct<start:long,length:long,first_sample:long,samples:long>>>>"
)


class Malformed(ValueError):
    """A box or table that contradicts itself or the file's length."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of each box in data[start:end]; 64-bit sizes and size 0 (to the end) included."""
    while start < end:
        if end - start < 8:
            raise Malformed("a box header is cut")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a box header is cut")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise Malformed(f"box {kind!r} does not fit")
        yield kind, start + head, start + size
        start += size


def tree(data: memoryview, start: int, end: int) -> dict[bytes, list]:
    """Boxes by type; containers as nested dicts, others as (start, end)."""
    out: dict[bytes, list] = {}
    for kind, a, b in boxes(data, start, end):
        out.setdefault(kind, []).append(tree(data, a, b) if kind in CONTAINERS else (a, b))
    return out


def table(data: memoryview, span: tuple[int, int], columns: int, width: int = 4) -> np.ndarray:
    """A full box's table: count, then rows of big-endian unsigned numbers."""
    a, b = span
    (n,) = struct.unpack_from(">I", data, a + 4)
    if a + 8 + n * columns * width > b:
        raise Malformed("a sample table is cut")
    return np.frombuffer(data, f">u{width}", n * columns, a + 8).astype(np.int64).reshape(n, columns)


def chunk_samples(stsc: np.ndarray, chunks: int) -> np.ndarray:
    """Samples in each chunk, from runs of (first chunk, samples per chunk, entry)."""
    if not chunks:
        return np.zeros(0, np.int64)
    if not len(stsc) or stsc[0, 0] != 1 or (np.diff(stsc[:, 0]) <= 0).any() or stsc[-1, 0] > chunks:
        raise Malformed("chunk runs are out of order")
    return np.repeat(stsc[:, 1], np.diff(np.append(stsc[:, 0], chunks + 1)))


def sample_sizes(data: memoryview, stbl: dict) -> tuple[int, int, np.ndarray | None]:
    """(constant size or 0, samples, sizes) from the plain or the compact size table."""
    if b"stsz" in stbl:
        a, b = stbl[b"stsz"][0]
        constant, samples = struct.unpack_from(">II", data, a + 4)
        if constant:
            return constant, samples, None
        bits, a = 32, a + 12
    else:
        a, b = stbl[b"stz2"][0]
        bits, samples = struct.unpack_from(">7xBI", data, a)
        a += 12
        if bits not in (4, 8, 16):
            raise Malformed(f"sizes of {bits} bits")
    if a + (samples * bits + 7) // 8 > b:
        raise Malformed("the size table is cut")
    if bits == 4:
        both = np.frombuffer(data, np.uint8, (samples + 1) // 2, a)
        return 0, samples, np.stack([both >> 4, both & 15], axis=1).ravel()[:samples].astype(np.int64)
    return 0, samples, np.frombuffer(data, f">u{bits // 8}", samples, a).astype(np.int64)


def described(data: memoryview, a: int, b: int) -> str:
    """Object type of an elementary stream descriptor, as in mp4a.40.2, or nothing."""
    a += 4
    while a < b:
        tag, size, a = data[a], 0, a + 1
        while a < b:
            size, a = size << 7 | data[a] & 127, a + 1
            if not data[a - 1] & 128:
                break
        if tag == 3:
            flags = data[a + 2]
            a += 3 + 2 * bool(flags & 128) + (1 + data[a + 3] if flags & 64 else 0) + 2 * bool(flags & 32)
        elif tag == 4:
            kind, end = data[a], min(b, a + size)
            a += 13
            if kind == 0x40 and a + 2 < end and data[a] == 5:
                body = a + 2
                while data[body - 1] & 128:
                    body += 1
                return f".{kind:x}.{data[body] >> 3}"
            return f".{kind:x}"
        else:
            a += size
    return ""


def codec_of(data: memoryview, kind: str, stsd: tuple[int, int]) -> str:
    """The first sample entry's code, with its profile where the entry tells one."""
    entry, a, b = next(boxes(data, stsd[0] + 8, stsd[1]), (b"", 0, 0))
    codec = entry.decode("latin-1").strip()
    head = {"vide": VISUAL_ENTRY, "soun": AUDIO_ENTRY}.get(kind)
    if head and b - a > head:
        for inner, x, y in boxes(data, a + head, b):
            if inner == b"avcC" and y - x >= 4:
                codec += f".{bytes(data[x + 1 : x + 4]).hex()}"
            elif inner == b"hvcC" and y - x >= 13:
                profile, compatible = data[x + 1], int(f"{struct.unpack_from('>I', data, x + 2)[0]:032b}"[::-1], 2)
                codec += f".{['', 'A', 'B', 'C'][profile >> 6]}{profile & 31}.{compatible:x}.{'H' if profile & 32 else 'L'}{data[x + 12]}"
            elif inner == b"av1C" and y - x >= 3:
                depth = 12 if data[x + 2] & 32 else 10 if data[x + 2] & 64 else 8
                codec += f".{data[x + 1] >> 5}.{data[x + 1] & 31:02d}{'H' if data[x + 2] & 128 else 'M'}.{depth:02d}"
            elif inner == b"esds":
                codec += described(data, x, y)
    return codec


def joined(start: np.ndarray, size: np.ndarray, at: np.ndarray, count: np.ndarray) -> list[dict]:
    """Byte ranges of keyframes, neighbours as one."""
    if len(start):
        joins = (start[1:] == start[:-1] + size[:-1]) & (at[1:] == at[:-1] + count[:-1])
        heads = np.flatnonzero(np.append(True, ~joins))
        start, at = start[heads], at[heads]
        size, count = np.add.reduceat(size, heads), np.add.reduceat(count, heads)
    return [{"start": int(s), "length": int(n), "first_sample": int(i), "samples": int(c)} for s, n, i, c in zip(start, size, at, count)]


def add_fragments(data: memoryview, moofs: list[tuple[int, dict]], extends: list[tuple[int, int]], tracks: list[dict]) -> None:
    """Adds the samples of movie fragments, in file order, to the tracks they name."""
    by_id, defaults = {t["track_id"]: t for t in tracks}, {}
    for a, _ in extends:
        track_id, _, _, size, flags = struct.unpack_from(">5I", data, a + 4)
        defaults[track_id] = (size, flags)
    for begin, moof in moofs:
        following = begin
        for traf in moof.get(b"traf", ()):
            a, _ = traf[b"tfhd"][0]
            options, track_id = struct.unpack_from(">II", data, a)
            options &= 0xFFFFFF
            at = a + 8
            base = struct.unpack_from(">Q", data, at)[0] if options & 1 else begin if options & 0x20000 else following
            at += 8 * bool(options & 1) + 4 * bool(options & 2) + 4 * bool(options & 8)
            size, flags = defaults.get(track_id, (0, 0))
            if options & 0x10:
                size = struct.unpack_from(">I", data, at)[0]
            if options & 0x20:
                flags = struct.unpack_from(">I", data, at + 4 * bool(options & 0x10))[0]
            t = by_id.get(track_id)
            if t is None:
                raise Malformed(f"a fragment of track {track_id}, which is not there")
            place = base
            for a, b in traf.get(b"trun", ()):
                word, n = struct.unpack_from(">II", data, a)
                at, columns = a + 8, [int(bool(word & o)) for o in (0x100, 0x200, 0x400, 0x800)]
                if word & 1:
                    place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
                first_flags = struct.unpack_from(">I", data, at)[0] if word & 4 else None
                at += 4 * bool(word & 4)
                if at + 4 * n * sum(columns) > b:
                    raise Malformed("a fragment's table is cut")
                rows = np.frombuffer(data, ">u4", n * sum(columns), at).astype(np.int64).reshape(n, sum(columns))
                sizes = rows[:, columns[0]] if columns[1] else np.full(n, size, np.int64)
                marks = rows[:, columns[0] + columns[1]] if columns[2] else np.full(n, flags, np.int64)
                if first_flags is not None and n:
                    marks = np.append(first_flags, marks[1:])
                starts = place + np.append(0, np.cumsum(sizes))
                if place < 0 or starts[-1] > len(data):
                    raise Malformed("samples lie beyond the file")
                keys = np.flatnonzero(marks & 0x10000 == 0)  # not marked as dependent on others
                t["keyframes"] += joined(starts[keys], sizes[keys], t["samples"] + keys, np.ones_like(keys))
                t["samples"], t["bytes"], place = t["samples"] + n, t["bytes"] + int(sizes.sum()), int(starts[-1])
                if columns[0]:
                    t["duration"] = max(t["duration"], t.get("_told", 0) + int(rows[:, 0].sum()))
                    t["_told"] = t.get("_told", 0) + int(rows[:, 0].sum())
            following = place
    for t in tracks:
        t.pop("_told", None)
        t["duration_s"] = t["duration"] / t["timescale"] if t["timescale"] else None


def track(data: memoryview, trak: dict) -> dict:
    """One track's codec, duration and the byte ranges of its keyframes; neighbours are one range."""
    try:
        mdia, tkhd = trak[b"mdia"][0], trak[b"tkhd"][0]
        stbl = mdia[b"minf"][0][b"stbl"][0]
        mdhd, hdlr, stsd = mdia[b"mdhd"][0], mdia[b"hdlr"][0], stbl[b"stsd"][0]
        constant, samples, sizes = sample_sizes(data, stbl)
        stts, stsc = table(data, stbl[b"stts"][0], 2), table(data, stbl[b"stsc"][0], 3)
        offsets = table(data, stbl[b"stco"][0], 1) if b"stco" in stbl else table(data, stbl[b"co64"][0], 1, 8)
    except (KeyError, IndexError) as e:
        raise Malformed(f"a track has no {e}") from None
    offsets = offsets[:, 0]
    if data[mdhd[0]] == 1:
        timescale, duration = struct.unpack_from(">IQ", data, mdhd[0] + 20)
    else:
        timescale, duration = struct.unpack_from(">II", data, mdhd[0] + 12)
    (track_id,) = struct.unpack_from(">I", data, tkhd[0] + (20 if data[tkhd[0]] == 1 else 12))
    kind = bytes(data[hdlr[0] + 8 : hdlr[0] + 12]).decode("latin-1")
    per_chunk = chunk_samples(stsc, len(offsets))
    if per_chunk.sum() != samples or stts[:, 0].sum() != samples:
        raise Malformed("the tables disagree on the number of samples")
    first = np.append(0, np.cumsum(per_chunk))
    ends = np.append(0, np.cumsum(sizes)) if sizes is not None else None
    before = (lambda i: ends[i]) if sizes is not None else (lambda i: i * constant)
    chunk_bytes = before(first[1:]) - before(first[:-1])
    if len(offsets) and (offsets + chunk_bytes).max() > len(data):
        raise Malformed("samples lie beyond the file")
    if b"stss" in stbl:
        at = table(data, stbl[b"stss"][0], 1)[:, 0] - 1
        if len(at) and (at.min() < 0 or at.max() >= samples):
            raise Malformed("a keyframe lies beyond the samples")
        chunk = np.searchsorted(first, at, side="right") - 1
        start, size, count = offsets[chunk] + before(at) - before(first[chunk]), before(at + 1) - before(at), np.ones_like(at)
    else:  # every sample is a keyframe
        start, size, at, count = offsets, chunk_bytes, first[:-1], per_chunk
    return {
        "track_id": track_id, "kind": kind, "codec": codec_of(data, kind, stsd), "timescale": timescale, "duration": duration,
        "duration_s": duration / timescale if timescale else None, "samples": samples, "bytes": int(chunk_bytes.sum()),
        "keyframes": joined(start, size, at, count),
    }


def parse(content: bytes | None) -> tuple[str, str | None, list[dict] | None]:
    """(status, brand, tracks). Status: ok, empty, or malformed: reason. Samples of fragments (moof boxes) count in their tracks."""
    if not content:
        return "empty", None, None
    data = memoryview(content)
    try:
        root = tree(data, 0, len(data))
        brand = next((bytes(data[a : a + 4]).decode("latin-1").strip() for a, b in root.get(b"ftyp", ()) if b - a >= 4), None)
        if b"moov" not in root:
            raise Malformed("no moov box")
        moov = root[b"moov"][0]
        tracks = [track(data, t) for t in moov.get(b"trak", ())]
        if b"moof" in root:
            begins = [a - 8 for kind, a, _ in boxes(data, 0, len(data)) if kind == b"moof"]
            extends = moov[b"mvex"][0].get(b"trex", []) if b"mvex" in moov else []
            add_fragments(data, list(zip(begins, root[b"moof"])), extends, tracks)
        return "ok", brand, tracks
    except (Malformed, struct.error, IndexError, ValueError, KeyError) as e:
        return f"malformed: {e}", None, None


def probe(media: DataFrame, content: str = "content", key: str = "id") -> DataFrame:
    """key, status, brand and tracks (codec, duration, keyframe byte ranges) of each row's container.

    Nulls and empty files give status empty; broken ones give their reason, never an error. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x.as_buffer() if x.is_valid else None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), ARROW_TRACKS)))],
                names=[key, "status", "brand", "tracks"],
            )

    kind = media.schema[key].dataType.simpleString()
    return null_safe(media, key, content).mapInArrow(run, f"`{key}` {kind}, status string, brand string, tracks {TRACKS}")


ARROW_TRACKS = pa.list_(pa.struct([
    *((n, pa.int64() if n not in ("kind", "codec", "duration_s") else pa.float64() if n == "duration_s" else pa.string())
      for n in ("track_id", "kind", "codec", "timescale", "duration", "duration_s", "samples", "bytes")),
    ("keyframes", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "first_sample", "samples")]))),
]))


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    return b"".join((struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8), *body))


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def movie(tracks: bytes, scale: int, duration: int) -> bytes:
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    head = struct.pack(">4IIH10x", 0, 0, scale, duration, 1 << 16, 1 << 8) + matrix + struct.pack(">24xI", 2)
    return box(b"moov", full(b"mvhd", head), tracks)


def pcm_container(samples: bytes, rate: int = RATE) -> bytes:
    """Bytes as one mono track of unsigned 8-bit PCM, one sample a byte, in chunks of 64 Ki samples."""
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    n, base = len(samples), len(ftyp) + (8 if len(samples) + 8 < 1 << 32 else 16)
    chunks, tail = -(-n // CHUNK), n % CHUNK
    runs = [(1, CHUNK, 1)] * (n >= CHUNK) + [(chunks, tail, 1)] * bool(tail)
    wide = base + n >= 1 << 32
    at = np.arange(base, base + n, CHUNK, dtype=">u8" if wide else ">u4")
    count = struct.pack(">I", chunks)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, rate << 16))
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", 1, n)), full(b"co64" if wide else b"stco", count, at.tobytes()),
    )
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">4x4s12x", b"soun"), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">5I8xHHHH", 0, 0, 1, 0, n, 0, 0, 1 << 8, 0) + matrix + bytes(8), flags=7)
    return b"".join((ftyp, box(b"mdat", samples), movie(box(b"trak", tkhd, mdia), rate, n)))


def store_bytes(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """key, n_bytes and content: the text's UTF-8 bytes (null: empty), padded with 0 to a positive multiple of 64, as a PCM container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for rows in by_bytes(list(range(batch.num_rows)), sizes):  # keeps copies small, and batches below 2 GiB
                part = batch.slice(rows[0], len(rows))
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
                kept = [pcm_container(x + bytes(-len(x) % BLOCK or (0 if x else BLOCK))) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(kept, pa.binary())], names=[key, "n_bytes", "content"]
                )

    kind = df.schema[key].dataType.simpleString()
    return null_safe(df, key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, content binary")


def read_back(media: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """Digests of stored containers: the payload is gathered from the byte ranges that the sample tables give.

    A feature string tells codec, rate, duration, keyframe ranges and the mean sample.
    """

    def row(n_bytes: int, stored: pa.Scalar) -> tuple:
        data = stored.as_buffer()
        status, _, tracks = parse(data)
        if status != "ok":
            raise Malformed(f"a stored container reads back as {status}")
        t, view = tracks[0], memoryview(data)
        payload = b"".join(view[k["start"] : k["start"] + k["length"]] for k in t["keyframes"])
        mean = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) * 1000 // len(payload)
        ranges = "+".join(f"{k['start']}:{k['length']}" for k in t["keyframes"])
        feature = f"codec={t['codec']};rate={t['timescale']};duration_ms={t['duration'] * 1000 // t['timescale']};keyframes={ranges};mean_milli={mean}"
        return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(n.as_py(), x) for n, x in zip(batch.column(1), batch.column(2), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string() if n in TEXTS else pa.int64()) for n, c in zip(DIGESTS, columns, strict=True))],
                names=[key, *DIGESTS],
            )

    kind = media.schema[key].dataType.simpleString()
    return null_safe(media, key, "n_bytes", content).mapInArrow(
        run, f"`{key}` {kind}, " + ", ".join(f"{n} {'string' if n in TEXTS else 'long'}" for n in DIGESTS)
    )


DIGESTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
TEXTS = frozenset({"payload_sha256", "media_sha256", "feature"})


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store every whole text losslessly in a written media table, read that table back and digest it.

    Null texts count as empty, repeated rows stay repeated, a null key stays null. Texts may be of any length up to what one
    Arrow value holds (2 GiB); batches are cut by bytes. Other columns are not read; an empty table gives no rows. No
    shuffle: two scans.
    """
    stored = materialize(store_bytes(docs, text, key).withColumn("n_bytes", F.col("n_bytes").cast("long")), "media")
    return read_back(stored, key)
