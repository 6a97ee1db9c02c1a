"""A small causal self-attention language model on subword ids, trained in numpy over the corpus, and scores of whole texts by it.

One layer and one head: what the last id and an attention over the ids before it say is added and read by a two-level softmax, first of a class of ids, then of
the id within its class. All training words count towards its classes and start values; all windows of the
training texts then train it in shards, whose weights are averaged after each pass. Words are lower-cased and spaced by one blank; each is encoded by itself.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import by_bytes, discard, materialize, null_safe

VOCABULARY, END, PAD, START = "byte_bpe_multi_50k.tiktoken", 50_256, -2, -3
#: Ids with weights of their own; the others are one class and keep their counts. Numbers of a state, ids in a window, and of those scored in it.
KNOWN, CLASSES, STATE, WINDOW, SCORED, BATCH, FEW = 1024, 24, 32, 32, 24, 768, 96
#: All windows are trained on PASSES times, in shards of about SHARD_WINDOWS windows but at most MOST_SHARDS shards, which then grow. In a piece of
#: PIECE windows, NONE is no id and FIRST is START.
PASSES, SHARD_WINDOWS, MOST_SHARDS, STEP, RATE, PIECE, NONE, FIRST = 2, 16_384, 4096, 48, 0.01, 16, 65_535, 65_534
FOLDS, HELD_OUT, COMMON, CHUNK, HELD = 7, 2, 400_000, 1 << 20, 300_000
_loaded: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _core(path: str):
    """The tokenizer, and which of its ids begin with a blank; loaded once a worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        opens = np.zeros(END + 1, bool)
        opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        _loaded[path] = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), opens
    return _loaded[path]


class Pieces:
    """Subword ids of words. Those of common words are kept in flat arrays, others are encoded again in each chunk."""

    def __init__(self, path: str, places: dict[bytes, int] | None = None) -> None:
        self.core, self.opens = _core(path)
        self.places = places or {}
        self.known, self.size, self.flat = {b"": 0}, np.ones(1, np.int64), np.array([END], np.int32)
        self.place = np.array([self.places.get(b"", -1)], np.int64)

    def spelt(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in some order, how many ids each has after a blank, and these in a row.

        No id of a word but its first begins with a blank, so words without white space are encoded in one go.
        """
        said = [" " + w.decode("utf-8", "replace") for w in words]
        whole = "".join(said)
        plain = range(len(words)) if len(whole.split()) == len(words) else [i for i, x in enumerate(said) if x.split() == [x[1:]]]
        flat = np.array(self.core.encode_ordinary(whole if len(plain) == len(words) else "".join([said[i] for i in plain])), np.int32)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(plain):
            flat, starts, plain = flat[:0], starts[:0], []
        size = np.diff(np.append(starts, len(flat)))
        if len(plain) == len(words):
            return words, size, flat
        rest = sorted(set(range(len(words))).difference(plain))
        ids = [self.core.encode_ordinary(said[i]) for i in rest]
        flat = np.concatenate([flat, np.fromiter((i for x in ids for i in x), np.int32)])
        return [words[i] for i in [*plain, *rest]], np.append(size, np.array([len(x) for x in ids], np.int64)), flat

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' ids in a row, how many each word has, and its number among common words, -1 for others. The empty word is the end of a text."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        lacked = [words[i] for i in missing]
        new = list(dict.fromkeys(lacked))
        common = [w for w in new if w in self.places]
        if common:
            common, size, flat = self.spelt(common)
            self.known.update(zip(common, range(len(self.known), len(self.known) + len(common))))
            self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
            self.place = np.append(self.place, [self.places[w] for w in common])
            new = [w for w in new if w not in self.places]
        rare, size, flat = self.spelt(new)
        found = dict(zip(rare, range(len(self.known), len(self.known) + len(rare))))
        at[missing] = [i if (i := found.get(w)) is not None else self.known[w] for w in lacked]
        size, flat = np.append(self.size, size), np.append(self.flat, flat)
        place = np.append(self.place, np.full(len(rare), -1))
        start, width = (np.cumsum(size) - size)[at], size[at]
        ends = np.cumsum(width)
        return flat[np.repeat(start - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)], width, place[at]


def fold(key: object) -> int:
    """crc32 of the key as text; a null key is the empty text."""
    return zlib.crc32(("" if key is None else str(key)).encode())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and lower-cased texts, some bytes at a time. A null text is empty. bytes.split() splits where no word character is: at 20 and 09 to 0D."""
    keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for rows in by_bytes(list(range(len(sizes))), sizes, CHUNK):
        yield [keys[i] for i in rows], [(texts[i].as_py() or b"").lower() for i in rows]


def training_words(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(word, n) over all texts that are not held out; the empty word is the end of a text. docs: (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for keys, texts in _texts(batch):
                for key, body in zip(keys, texts):
                    if fold(key) % folds != held_out:
                        held.update(body.split())
                        held[b""] += 1
                        if len(held) > HELD:
                            yield out()
        yield out()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def followers(words: DataFrame, path: str) -> DataFrame:
    """(a, b, n): how often id b follows a within words; START before a word's first id and END of text as a word of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)
        code = Pieces(path)
        for batch in batches:
            ids, size, _ = code.ids(batch.column(0).to_pylist())
            n = np.repeat(batch.column(1).to_numpy(), size)
            before = np.append(START, ids[:-1]).astype(np.int64)
            before[(np.cumsum(size) - size)] = START
            held = np.concatenate([held, np.stack([(before + 4) << 32 | ids, n], 1)])
            if len(held) > 4 * HELD:
                held = summed(held)
        held = summed(held)
        yield pa.RecordBatch.from_arrays([pa.array((held[:, 0] >> 32) - 4), pa.array(held[:, 0] & 0xFFFFFFFF), pa.array(held[:, 1])], names=["a", "b", "n"])

    def summed(rows: np.ndarray) -> np.ndarray:
        keys, at = np.unique(rows[:, 0], return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        np.add.at(out, at, rows[:, 1])
        return np.stack([keys, out], 1)

    return words.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Model:
    """Weights and what they are about: ids by rank, classes as ranges of ranks, and the fixed shares of ids without weights."""

    def __init__(self, path: str, ranks: np.ndarray, bounds: np.ndarray, rest: np.ndarray) -> None:
        self.path, self.ranks, self.bounds, self.rest, self.weights = path, ranks, bounds, rest, {}
        self.known, self.classes = len(ranks), len(bounds)  # the last class is that of all other ids
        self.rank_of = np.full(END + 1, self.known, np.int64)
        self.rank_of[ranks] = np.arange(self.known)
        self.class_of = (np.searchsorted(bounds, np.arange(self.known + 1), side="right") - 1).astype(np.int8)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the input table: known ids, then one each for other ids, the start and padding."""
        return np.where(ids >= 0, self.rank_of[np.maximum(ids, 0)], np.where(ids == START, self.known + 1, self.known + 2))

    def tables(self, embed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Input rows, and their queries, keys and values, which are the same wherever a row stands."""
        w = self.weights
        embed = w["embed"] if embed is None else embed
        return (embed, *(embed @ w[name] for name in ("query", "key", "value")))

    def forward(self, windows: np.ndarray, tables: tuple[np.ndarray, ...] | None = None, padding: int | None = None) -> dict:
        """States of the last SCORED places of each window of input rows, by one masked attention over all windows. The tables may be of fewer rows."""
        here, padding = windows[:, WINDOW - SCORED :], self.known + 2 if padding is None else padding
        embed, queries, keys, values = tables or self.tables()
        last, q, k, v = embed.take(here, 0), queries.take(here, 0), keys.take(windows, 0), values.take(windows, 0)
        s = q @ k.transpose(0, 2, 1)
        s += _by_distance(self.weights["near"])
        padded = np.flatnonzero((windows[:, :: WINDOW - 1] == padding).any(1))  # padding is at an end
        if len(padded):
            s[padded] += np.where(windows[padded] == padding, np.float32(-1e9), np.float32(0))[:, None]
        s, total = _softmax(s.reshape(-1, WINDOW))
        s *= (1 / total)[:, None]
        s = s.reshape(*here.shape, WINDOW)
        said = s @ v
        return {"last": last, "q": q, "k": k, "v": v, "a": s, "said": said, "h": (last + said).reshape(-1, STATE)}

    def reading(self) -> np.ndarray:
        """What reads a state: a row each for classes and known ids, with its bias as the last number."""
        w = self.weights
        if "read" in w:
            return w["read"]
        return np.ascontiguousarray(np.concatenate([np.append(w["class"], w["id"], 1), np.append(w["class_bias"], w["id_bias"])[None]]).T)

    def losses(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target id."""
        rank, read, c = self.rank_of[target], self.reading(), self.classes
        order, cuts = self._by_class(self.class_of[rank])
        states = np.ones((len(h), STATE + 1), h.dtype)  # the last number meets the bias
        states[:, :-1] = h.take(order, 0)
        rank = rank[order]
        found = _log_softmax(states @ read[:c].T, self.class_of[rank])
        for a, b, lo, hi in zip(cuts[:-2], cuts[1:-1], self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            if b > a and hi - lo > 1:
                found[a:b] += _log_softmax(states[a:b] @ read[c + lo : c + hi].T, rank[a:b] - lo)
        out = np.empty_like(found)
        out[order] = found
        rows = order[cuts[c - 1] :]
        out[rows] += self.rest[target[rows]]
        return out

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The order of rows by their class, and where each class begins and the last ends."""
        return np.argsort(cls, kind="stable"), [0, *np.cumsum(np.bincount(cls, minlength=self.classes)).tolist()]

    def gradients(self, windows: np.ndarray, target: np.ndarray, scored: np.ndarray) -> dict:
        """Gradients of the negated mean of losses()."""
        g = self.slopes(windows, target, scored)
        return {k: x for k, x in g.items() if k != "read"} | self.named(g["read"])

    def named(self, read: np.ndarray) -> dict:
        """The parts of reading() by their names."""
        c = self.classes
        return {"class": read[:c, :-1].T, "class_bias": read[:c, -1], "id": read[c:, :-1].T, "id_bias": read[c:, -1]}

    def slopes(self, windows: np.ndarray, target: np.ndarray, scored: np.ndarray) -> dict:
        """gradients(), those of reading() as one. Rows go by their target's class, so that each class is one slice; tables are of the input rows that are there."""
        w, g, read, c = self.weights, {}, self.reading(), self.classes
        there = np.zeros(self.known + 3, bool)
        there[windows] = True
        used = np.flatnonzero(there)
        place = np.empty(len(there), np.int64)
        place[used] = np.arange(len(used))
        local, tables = place[windows], self.tables(w["embed"].take(used, 0))
        f = self.forward(local, tables, len(used) - 1 if there[-1] else -1)
        states, dtype = f["h"], f["h"].dtype

        rank = self.rank_of[target[scored]]
        cls = self.class_of[rank]
        order, cuts = self._by_class(cls)
        rows, rank, cls = np.flatnonzero(scored)[order], rank[order], cls[order]
        n = len(rows)
        h = np.ones((n, STATE + 1), dtype)  # the last number meets the bias
        h[:, :-1] = states.take(rows, 0)
        parts = [(0, n, 0, c)]
        parts += [(a, b, c + lo, c + hi) for a, b, lo, hi in zip(cuts[:-2], cuts[1:-1], self.bounds[:-1].tolist(), self.bounds[1:].tolist()) if b > a and hi - lo > 1]
        inside = np.flatnonzero(np.append(np.diff(self.bounds) > 1, False)[cls])
        views, share = _less_the_right(h, read, parts, np.append(cls, c + rank[inside]))
        share /= n
        by_class, by_id, at_id = share[:n, None], np.zeros((n, 1), dtype), np.zeros((n, STATE), dtype)
        by_id[inside, 0] = share[n:]
        g["read"] = np.zeros_like(read)
        np.matmul(views[0].T, h * by_class, out=g["read"][:c])
        h *= by_id
        for (a, b, lo, hi), view in zip(parts[1:], views[1:]):
            np.matmul(view.T, h[a:b], out=g["read"][lo:hi])
            np.matmul(view, read[lo:hi, :-1], out=at_id[a:b])
        at_id *= by_id
        at_class = views[0] @ read[:c, :-1]
        at_class *= by_class
        at_class += at_id

        h = np.zeros_like(states)
        h[rows] = at_class
        mixed = (h * f["said"].reshape(h.shape)) @ np.ones(STATE, dtype)
        h = h.reshape(f["last"].shape)
        ds = h @ f["v"].transpose(0, 2, 1)
        ds -= mixed.reshape(*h.shape[:2], 1)
        ds *= f["a"]
        g["near"] = np.bincount(_DISTANCE.ravel(), ds.sum(0).ravel(), WINDOW + 1)[:WINDOW].astype(np.float32)
        at = np.arange(len(used) * STATE).reshape(-1, STATE).take(local, 0)
        here = at[:, WINDOW - SCORED :].ravel()

        def summed(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(used) * STATE, dtype)
            np.add.at(out, at, rows.ravel())  # with one row of numbers this is much faster than with rows of a table
            return out.reshape(-1, STATE)

        keyed, said, asked = summed(ds.transpose(0, 2, 1) @ f["q"], at.ravel()), summed(f["a"].transpose(0, 2, 1) @ h, at.ravel()), summed(ds @ f["k"], here)
        inputs = tables[0].T
        g["query"], g["key"], g["value"] = inputs @ asked, inputs @ keyed, inputs @ said
        g["embed"] = np.zeros_like(w["embed"])
        g["embed"][used] = summed(h, here) + keyed @ w["key"].T + said @ w["value"].T + asked @ w["query"].T
        return g

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in _APART] + [self.reading().ravel()])

    def view(self, vector: np.ndarray) -> None:
        """Weights become parts of the vector."""
        at, shapes = 0, {"embed": (self.known + 3, STATE), "near": (WINDOW,)}
        for k in _APART:
            shape = shapes.get(k, (STATE, STATE))
            self.weights[k] = vector[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        self.weights["read"] = vector[at:].reshape(-1, STATE + 1)
        self.weights |= self.named(self.weights["read"])

    def load(self, vector: np.ndarray) -> None:
        self.view(vector)
        del self.weights["read"]
        self.weights = {k: np.array(x, np.float32, order="C") for k, x in self.weights.items()}


#: Weights in the order in which a vector has them, before those that read states.
_APART = ("embed", "key", "near", "query", "value")
#: How far each of the scored places is from each place of its window, WINDOW if that comes later.
_DISTANCE = (lambda d: np.where(d < 0, WINDOW, d))(np.arange(WINDOW - SCORED, WINDOW)[:, None] - np.arange(WINDOW))


def _by_distance(near: np.ndarray) -> np.ndarray:
    return np.append(near, np.float32(-1e9))[_DISTANCE]


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e to the power of z, but for one factor a row, in z or a new array, and the sums of rows."""
    ones = np.ones(z.shape[-1], z.dtype)
    e = z - z.max(initial=0)
    np.exp(e, out=e)
    total = e @ ones
    if (total > 1e-30).all():  # all rows are within reach of the largest number, whose subtraction is much faster than each row's own
        return e, total
    z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ ones


def _log_softmax(z: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Log probabilities of the right columns."""
    z, total = _softmax(z)
    return np.log(np.maximum(z[np.arange(len(z)), right], 1e-37)) - np.log(total)


def _less_the_right(h: np.ndarray, read: np.ndarray, parts: list[tuple[int, int, int, int]], right: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each part (a, b, lo, hi) e to the power of h[a:b] @ read[lo:hi].T, but for one factor a row, less a row's sum at its right row of read; and one over these sums.

    What isn't a product is done on all parts at once, as they are many and small.
    """
    rows, width = np.array([b - a for a, b, _, _ in parts]), np.array([hi - lo for _, _, lo, hi in parts])
    ends = np.cumsum(rows * width)
    z, total, ones = np.empty(ends[-1], h.dtype), np.empty(rows.sum(), h.dtype), np.ones(width.max(), h.dtype)
    views = [z[e - n * m : e].reshape(n, m) for e, n, m in zip(ends.tolist(), rows.tolist(), width.tolist())]
    sums = [total[e - n : e] for e, n in zip(np.cumsum(rows).tolist(), rows.tolist())]
    for (a, b, lo, hi), view in zip(parts, views):
        np.matmul(h[a:b], read[lo:hi].T, out=view)
    z -= z.max(initial=0)
    np.exp(z, out=z)
    for view, some in zip(views, sums):
        np.matmul(view, ones[: view.shape[1]], out=some)
    if not (total > 1e-26).all():  # some row is out of reach of the largest number and needs a maximum of its own
        for (a, b, lo, hi), view, some in zip(parts, views, sums):
            np.matmul(h[a:b], read[lo:hi].T, out=view)
            view -= view.max(1, keepdims=True)
            np.exp(view, out=view)
            np.matmul(view, ones[: view.shape[1]], out=some)
    each = np.repeat(width, rows)
    z[np.cumsum(each) - each + right - np.repeat([lo for _, _, lo, _ in parts], rows)] -= total
    return views, 1 / total


def started(pairs: DataFrame, path: str, known: int = KNOWN, classes: int = CLASSES) -> Model:
    """A model whose state is the last id's, with start values from all training words: a low-rank form of what follows what.

    The driver gets one row an id of the vocabulary and at most known x known pairs, whatever the corpus. A word's last id is
    followed by a new word's first.
    """
    counts = np.zeros(END + 1, np.float64)
    single = pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts[single["b"].to_numpy()] = single["n"].to_numpy()
    order = np.lexsort((np.arange(END + 1), -counts))
    ranks = order[: min(known, max(1, int((counts > 0).sum())))]
    share = np.sqrt(counts[ranks] + 1)
    share = np.cumsum(share) / share.sum()
    bounds = np.unique(np.append(np.searchsorted(share, np.arange(classes) / classes), len(ranks)))
    left = counts.copy()
    left[ranks] = -1
    rest = np.where(left < 0, 0, np.log(np.maximum(left + 1, 1) / (left + 1)[left >= 0].sum())).astype(np.float32)
    model = Model(path, ranks, bounds, rest)
    spark, k = pairs.sparkSession, model.known
    kept = F.broadcast(spark.createDataFrame([(int(i),) for i in ranks], "id long"))
    top = pairs.join(kept.withColumnRenamed("id", "b"), "b", "left_semi")
    rows = top.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(top.filter(F.col("a") == START)).toArrow()
    follows = np.zeros((k + 3, k + 1))
    follows[model.inputs(rows["a"].to_numpy()), model.rank_of[rows["b"].to_numpy()]] = rows["n"].to_numpy()
    first = follows[k + 1] / max(1.0, follows[k + 1].sum())
    follows[:k] += np.maximum(0, counts[ranks] - follows[:k].sum(1))[:, None] * first
    follows[k] = np.append(counts[ranks], 0)
    bias = np.append(counts[ranks] + 0.5, np.maximum(left, 0).sum() + 0.5)
    bias /= bias.sum()
    cls = np.searchsorted(bounds, np.arange(k + 1), side="right") - 1
    ids = (follows + 20 * bias) / (follows.sum(1, keepdims=True) + 20)
    per = lambda x: np.stack([x[..., cls == c].sum(-1) for c in range(len(bounds))], -1)
    by_class, base = per(ids), per(bias)
    inside = np.log(ids[:, :k] / by_class[:, cls[:k]]) - np.log(bias[:k] / base[cls[:k]])
    logs = np.concatenate([np.log(by_class) - np.log(base), inside], 1)
    weight = np.sqrt(np.append(counts[ranks], [0, follows[k + 1].sum(), 0]) + 1)[:, None]
    use = np.sqrt(np.append(base, bias[:k]))
    u, s, vt = np.linalg.svd(logs * weight * use, full_matrices=False)
    d = min(STATE, len(s))
    scale = np.sqrt(s[:d].mean() + 1e-9)
    embed, read = np.zeros((k + 3, STATE)), np.zeros((STATE, logs.shape[1]))
    embed[:, :d], read[:d] = u[:, :d] * s[:d] / weight / scale * 1.0, vt[:d] / use * scale
    embed[k + 2] = 0
    size = np.sqrt((embed**2 * weight**2).sum() / (weight**2).sum() / STATE) + 1e-9
    rng = np.random.default_rng(7)
    square = lambda x: rng.normal(0, x, (STATE, STATE))
    model.weights = {
        "embed": embed / size, "class": read[:, : len(bounds)] * size, "id": read[:, len(bounds) :] * size, "class_bias": np.log(base), "id_bias": np.log(bias[:k] / base[cls[:k]]),
        "query": square(0.1), "key": square(0.1), "value": square(0.02), "near": np.linspace(0, -1, WINDOW),
    }
    model.weights = {name: np.ascontiguousarray(x, np.float32) for name, x in model.weights.items()}
    return model


def windowed(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input ids of overlapping windows over each of some sequences, the target ids of their last places (PAD: none), and each window's sequence.

    A sequence's first input is START; each id is one target exactly.
    """
    count = -(-size // SCORED)
    before = WINDOW - SCORED
    width = before + count * SCORED
    base = np.cumsum(width) - width
    flat = np.full(width.sum() + 1, PAD, np.int64)
    wanted = np.full(width.sum() + 1, PAD, np.int64)
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(base, size) + before + inside
    ends = inside == np.repeat(size, size) - 1
    flat[base + before] = START
    flat[at[~ends] + 1], wanted[at] = ids[~ends], ids
    start = np.repeat(base, count) + SCORED * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    places = start[:, None] + np.arange(WINDOW)
    return flat[places], wanted[places[:, before:]], np.repeat(np.arange(len(size)), count)


def training_ids(docs: DataFrame, path: str, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(key, ids): the training texts' ids as 16-bit numbers. docs: (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Pieces(path)
        for batch in batches:
            for keys, texts in _texts(batch):
                own = [(key, [*body.split(), b""]) for key, body in zip(keys, texts) if fold(key) % folds != held_out]
                if own:
                    ids, each, _ = code.ids([w for _, found in own for w in found])
                    yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in own], batch.column(0).type), pa.array(_by_text(ids, each, [len(found) for _, found in own]), pa.binary())], names=["key", "ids"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, ids binary")


def _by_text(ids: np.ndarray, each: np.ndarray, words: list[int]) -> list[bytes]:
    """The ids of each of some texts as 16-bit numbers: how many ids each word has, and words each text."""
    ends = np.append(0, np.cumsum(each)[np.cumsum(words) - 1]).tolist()
    ids = ids.astype("<u2")
    return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def in_pieces(texts: DataFrame) -> DataFrame:
    """(tie, place, ids): texts' ids (key, ids) in pieces of up to PIECE windows with what these need before and after.

    Windows overlap and hold inputs and targets, so a row for each would hold most ids more than twice; pieces hold them little more than once. Rows that are equal in key and text
    differ in tie if they are read together.
    """
    before = WINDOW - SCORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies: Counter = Counter()
            for rows in by_bytes(list(range(batch.num_rows)), pc.binary_length(batch.column(1)).to_pylist(), CHUNK):
                tie, place, cut = [], [], []
                some = batch.slice(rows[0], len(rows))
                for key, ids in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = np.frombuffer(ids, "<u2")
                    windows = -(-len(ids) // SCORED)
                    line = np.full(before + SCORED * windows + 1, NONE, "<u2")
                    line[before], line[before + 1 : before + 1 + len(ids)] = FIRST, ids
                    for at in range(0, windows, PIECE):
                        tie.append(fold(key) << 24 | copies[key])
                        place.append(at)
                        cut.append(line[SCORED * at : SCORED * min(at + PIECE, windows) + before + 1].tobytes())
                    copies[key] += 1
                yield pa.RecordBatch.from_arrays([pa.array(tie, pa.int64()), pa.array(place, pa.int64()), pa.array(cut, pa.binary())], names=["tie", "place", "ids"])

    return texts.select("key", "ids").mapInArrow(run, "tie long, place long, ids binary")


def training_pieces(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(tie, place, ids): the training texts of docs (key, text) in pieces."""
    return in_pieces(training_ids(docs, model.path, folds, held_out))


def _windows_in(piece: bytes) -> int:
    return (len(piece) // 2 - (WINDOW - SCORED) - 1) // SCORED


def piece_windows(model: Model, *pieces: bytes) -> np.ndarray:
    """Windows of pieces: input rows of each and then the ids of its targets (NONE: none)."""
    line = np.frombuffer(b"".join(pieces), "<u2")
    rows = np.full(1 << 16, model.known + 2, "<u2")  # as inputs, NONE and END are padding
    rows[:END], rows[FIRST] = model.rank_of[:END], model.known + 1
    size, count = np.array([len(p) // 2 for p in pieces]), np.array([_windows_in(p) for p in pieces])
    start = np.repeat(np.cumsum(size) - size - SCORED * (np.cumsum(count) - count), count) + SCORED * np.arange(count.sum())
    start = start[:, None]
    return np.concatenate([rows[line][start + np.arange(WINDOW)], line[start + np.arange(WINDOW - SCORED + 1, WINDOW + 1)]], 1)


def training_windows(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(tie, ids): all windows of the training texts, input rows and then target ids (NONE: none) as 16-bit numbers. Each id is a target once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [piece_windows(model, piece) for piece in batch.column(1).to_pylist()]
            tie = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(tie), pa.array([r.tobytes() for f in found for r in f], pa.binary())], names=["tie", "ids"])

    return training_pieces(docs, model, folds, held_out).select("tie", "ids").mapInArrow(run, "tie long, ids binary")


class Trainer:
    """Adam steps of one shard from given weights, all of them in one row of numbers."""

    def __init__(self, model: Model, shard: int) -> None:
        self.own, self.shard, self.step, self.seen, self.turns = Model(model.path, model.ranks, model.bounds, model.rest), shard, 0, 0, 0
        self.x = model.vector()
        self.own.view(self.x)
        self.m, self.v, self.g, self.room = np.zeros_like(self.x), np.zeros_like(self.x), np.empty_like(self.x), np.empty_like(self.x)

    def block(self, rows: np.ndarray, rate: Callable[[int], float]) -> None:
        """Trains on windows in an order that is drawn, STEP at a time. Pieces come whole, so their windows would stand together else."""
        rows = rows[np.random.default_rng((self.shard, self.turns)).permutation(len(rows))]
        self.turns += 1
        for at in range(0, len(rows), STEP):
            some = rows[at : at + STEP].astype(np.int64)
            target = some[:, WINDOW:].ravel()
            g = self.own.slopes(some[:, :WINDOW], target, target != NONE)
            np.concatenate([*(g[name].ravel() for name in _APART), g["read"].ravel()], out=self.g)
            self.step, self.seen = self.step + 1, self.seen + len(some)
            self.adam(rate(self.step))

    def adam(self, rate: float) -> None:
        """One step. m is ten and v a hundred times the running means of gradients and their squares, which saves their scaling."""
        m, v, g, room, bias = self.m, self.v, self.g, self.room, math.sqrt(0.01 / (1 - 0.99**self.step))
        m *= 0.9
        m += g
        g *= g
        v *= 0.99
        v += g
        np.sqrt(v, out=room)
        room += 1e-7 / bias
        np.divide(m, room, out=room)
        room *= rate * 0.1 / (1 - 0.9**self.step) / bias
        self.x -= room


def trained(model: Model, pieces: DataFrame, count: int, passes: int = PASSES, rate: float = RATE) -> Model:
    """The model after some passes over all windows of the pieces: shards train from the same weights, and the mean of theirs, by windows, goes on.

    At most MOST_SHARDS shards. A shard is read as a stream, whose windows are drawn in blocks of at least SHARD_WINDOWS; a task sends the sum of its shards.
    """
    spark = pieces.sparkSession
    shards = min(MOST_SHARDS, max(1, count // SHARD_WINDOWS))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("tie", "place", "ids"), F.lit(shards)).cast("int"))
    dealt = materialize(dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("ids", "place", "tie")).select("shard", "ids"), "lm-shards")
    block, steps = 1 << 10, max(1, count // shards // STEP)
    for turn in range(passes):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            own, held, size, total, seen = None, [], 0, 0, 0
            now = lambda step: rate * min(1, step / 10) * max(0.05, 1 - (turn + step / steps) / passes)

            def train() -> None:
                nonlocal size
                if held:
                    own.block(piece_windows(own.own, *held), now)
                    held.clear()
                    size = 0

            def end() -> None:
                nonlocal total, seen
                train()
                total, seen = total + own.x.astype(np.float64) * own.seen, seen + own.seen

            for batch in batches:
                for s, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if own is None or s != own.shard:
                        if own is not None:
                            end()
                        own = Trainer(sent.value, s)
                    held.append(piece)
                    size += _windows_in(piece)
                    if size >= 2 * SHARD_WINDOWS:
                        train()
            if own is not None:
                end()
                cut = [total[i : i + block] for i in range(0, len(total), block)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array([float(seen)] * len(cut)), pa.array(cut, pa.list_(pa.float64()))], names=["block", "n", "x"])

        def mean(key, table):
            x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0) / table["n"].to_numpy().sum()
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([x], pa.list_(pa.float64()))})

        rows = dealt.select("shard", "ids").mapInArrow(run, "block int, n double, x array<double>").groupBy("block").applyInArrow(mean, "block int, x array<double>").toArrow().sort_by("block")
        if rows.num_rows:
            model.load(np.concatenate(rows["x"].to_pylist()))
    discard(dealt)
    return model


def fitted(docs: DataFrame, words: DataFrame, path: str, passes: int = PASSES, texts: DataFrame | None = None) -> Model:
    """A model of all texts of docs (key, text) that are not held out; words are their counts. texts: the ids of these texts (key, ids), if they are known."""
    pairs = materialize(followers(words, path), "lm-pairs")
    model = started(pairs, path)
    ids = pairs.agg(F.sum("n")).first()[0] or 0
    discard(pairs)
    return trained(model, training_pieces(docs, model) if texts is None else in_pieces(texts), ids // SCORED, passes)


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, common: int = COMMON, passes: int = PASSES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null text is empty and has its end alone. A null key is the empty text in the checksum. Repeated rows are scored each. Texts of any length are
    scored whole, each id once, from the window where it has at least WINDOW - SCORED ids before it. Counts of words that many texts hold are
    sent to the tasks, `common` of them at most; the rest are joined. Other columns are not read. Without training texts all ids are alike.
    All training texts are trained on, whole. A text's ids are found once, for training and for its score.
    """
    path = path or vocabulary_path()
    docs = null_safe(docs, key, text).toDF("key", "text")
    words = materialize(training_words(docs), "lm-words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    least = _least_common(words, common)
    often = words.filter(F.col("n") >= least).toArrow()
    often = dict(zip(often["word"].to_pylist(), zip(range(len(often)), often["n"].to_pylist())))
    counts = np.array([c for _, c in often.values()] or [0], np.int64)
    context, kind = docs.sparkSession.sparkContext, docs.schema["key"].dataType.simpleString()
    common_words = context.broadcast(({w: i for w, (i, _) in often.items()}, counts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, count = common_words.value
        code = Pieces(path, places)
        log = np.append(np.log10(count + 1.0), 0)
        seen = np.append(count > 0, False)
        for batch in batches:
            for keys, texts in _texts(batch):
                found = [[*t.split(), b""] for t in texts]
                size = np.array([len(f) for f in found])
                flat = [w for f in found for w in f]
                ids, each, at = code.ids(flat)
                cut = np.cumsum(size) - size
                rare = [[] for _ in found]
                doc = np.repeat(np.arange(len(found)), size)
                for i in np.flatnonzero(at < 0).tolist():
                    rare[doc[i]].append(flat[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, batch.column(0).type), pa.array([fold(k) % FOLDS == HELD_OUT for k in keys]), pa.array(size.astype(np.int64)), pa.array(np.add.reduceat(seen[at].astype(np.int64), cut)),
                        pa.array(np.add.reduceat(log[at], cut)), pa.array(rare, pa.list_(pa.binary())), pa.array(_by_text(ids, each, size.tolist()), pa.binary()),
                    ],
                    names=["key", "held_out", "n_tokens", "n_known", "base", "rare", "ids"],
                )

    form = f"key {kind}, held_out boolean, n_tokens long, n_known long, base double, rare array<binary>"
    texts = materialize(docs.mapInArrow(read, f"{form}, ids binary"), "lm-texts")
    model = context.broadcast(fitted(docs, words, path, passes, texts.filter("not held_out")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for rows in by_bytes(list(range(batch.num_rows)), pc.binary_length(batch.column(at)).to_pylist(), CHUNK):
                some = batch.slice(rows[0], len(rows))
                ids = [np.frombuffer(x, "<u2") for x in some.column(at).to_pylist()]
                found = log10_probability(model.value, np.concatenate(ids).astype(np.int64), np.array([len(x) for x in ids]))
                yield pa.RecordBatch.from_arrays([*some.columns[:at], pa.array(found)], names=[*some.schema.names[:at], "score"])

    rows = materialize(texts.mapInArrow(score, f"{form}, score double").withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    discard(texts)
    rare = rows.select("row", F.explode("rare").alias("word")).join(words.filter(F.col("n") < least), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return rows.join(rare, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def _least_common(words: DataFrame, most: int) -> int:
    """The least count from which on there are at most `most` words; a power of two."""
    level = F.floor(F.log2("n")).cast("int")
    held, out = 0, 62
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        held += r["words"]
        if held > most:
            break
        out = r["level"]
    return 1 << out


def log10_probability(model: Model, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each of some sequences of ids, by batches of windows."""
    inputs, targets, source = windowed(ids, size)
    out, tables = np.zeros(len(size)), model.tables()
    for i in range(0, len(source), BATCH):
        part = slice(i, i + BATCH)
        rows, target = model.inputs(inputs[part]), targets[part].ravel()
        states = np.concatenate([model.forward(rows[j : j + FEW], tables)["h"] for j in range(0, len(rows), FEW)])  # few at a time stay in a core's cache
        on = target != PAD
        found = model.losses(states[on], target[on]).astype(np.float64)
        of = np.repeat(source[part], SCORED)[on]
        out[of[0] : of[-1] + 1] += np.bincount(of - of[0], found)
    return out / math.log(10)
