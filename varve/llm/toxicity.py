"""Toxicity of whole texts: a bidirectional gated recurrent network with
attention pooling over the characters of each word and the words of each
window, trained in numpy and applied to all overlapping windows."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import text_of
from .recurrent import Adam, forward, gradient, init_layer, pool, scan, sigmoid

WORD = re.compile(r"\w+")
LONGEST = 24  # characters of a word; longer words are several overlapping ones
WINDOW, STRIDE, TOP = 32, 16, 3  # words, words, windows
CHARS, GRAMS, EMBED, HIDDEN, ATTENTION = 512, 1 << 15, 12, 12, 12
WORDS, WORD_EMBED = 8192, 8  # most words with a vector of their own
_P = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def blocks(text: str) -> Iterator[str]:
    """The text in parts of about a million characters, cut at white space."""
    at = 0
    while len(text) - at > _BLOCK:
        cut = re.compile(r"\s").search(text, at + _BLOCK)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(text: str) -> list[str]:
    """Lower-cased words; those over LONGEST characters as overlapping parts."""
    out = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in out):
        step = LONGEST * 2 // 3
        out = [w[i : i + LONGEST] for w in out for i in range(0, max(1, len(w) - LONGEST + step), step)]
    return out


def codes(words: list[str]) -> np.ndarray:
    """(words, LONGEST) code points, 0 behind the end."""
    raw = "".join(w.ljust(LONGEST, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").reshape(-1, LONGEST)


def places(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major rows of the two embedding tables for each character and for
    the four characters that end there (0 before the word's first), and the mask."""
    c = c[:, : max(1, int((c > 0).sum(axis=1).max(initial=1)))].T
    g = np.zeros(c.shape, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(4):
            x = np.zeros(c.shape, np.uint64)
            x[back:] = c[: len(c) - back]
            g = (g ^ x) * _P
            g ^= g >> np.uint64(31)
        grams = (g * _P >> np.uint64(49)).astype(np.int64)
    return np.where(c < 256, c, 256 + c % 256).astype(np.int64), grams, (c > 0).astype(np.float32)


def encoded(p: dict, words: list[str], own: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Vectors of words, by falling length for speed: the character layer's
    output beside the word's own embedding, and what the gradient needs."""
    ids, grams, mask = places(codes(words))
    out, cache = forward(p, "char", p["embed"][ids] + p["gram"][grams], mask)
    return np.concatenate([out, p["own"][own]], axis=1), (ids, grams, mask, own, cache)


def encoded_gradient(p: dict, d: np.ndarray, kept: tuple, g: dict) -> None:
    ids, grams, mask, own, cache = kept
    d_x = (gradient(p, "char", np.ascontiguousarray(d[:, : 2 * HIDDEN]), cache, g) * mask[:, :, None]).reshape(-1, EMBED)
    summed = lambda at, rows, d: np.stack([np.bincount(at, x, rows) for x in d.T], axis=1).astype(np.float32)
    g["embed"], g["gram"] = summed(ids.ravel(), CHARS, d_x), summed(grams.ravel(), GRAMS, d_x)
    g["own"] = summed(own, len(p["own"]), d[:, 2 * HIDDEN :])
    g["own"][0] = 0  # words without a vector of their own


def projections(p: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each character and each group of them add to the layer's input, by direction."""
    return [(p["embed"] @ p[f"char.W{d}"] + p[f"char.B{d}"], p["gram"] @ p[f"char.W{d}"]) for d in "fb"]


def word_vectors(p: dict, words: list[str], own: np.ndarray, tables: list, rows: int = 4096) -> np.ndarray:
    """As ``encoded`` has them; tables: the ``projections``."""
    out = np.empty((len(words), 2 * HIDDEN + WORD_EMBED), np.float32)
    order = np.argsort([-len(w) for w in words], kind="stable")
    for lo in range(0, len(words), rows):
        at = order[lo : lo + rows]
        ids, grams, mask = places(codes([words[i] for i in at]))
        states = np.concatenate([scan(one[ids] + four[grams], mask, p[f"char.U{d}"], d == "b") for d, (one, four) in zip("fb", tables)], axis=2)
        out[at, : 2 * HIDDEN] = pool(states, mask, p["char.A"], p["char.v"])[0]
    out[:, 2 * HIDDEN :] = p["own"][own]
    return out


def windows_of(n: int) -> range:
    """Where the windows of n words begin."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


class Scorer:
    """Scores texts by their highest windows. Word projections are kept for words that
    come again, up to ``memory`` of them."""

    def __init__(self, p: dict, own: dict[str, int], memory: int = 150_000):
        self.p, self.own, self.memory, self.tables = p, own, memory, projections(p)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.new: list[str] = []
        self.proj = [np.empty((0, 3 * HIDDEN), np.float32)] * 2
        self.n = 0

    def _ids(self, words: list[str]) -> np.ndarray:
        known, new = self.known, self.new
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = known.get(w)
            if k is None:
                k = known[w] = len(known)
                new.append(w)
            out[i] = k
        return out

    def _learn(self) -> None:
        if self.new:
            v = word_vectors(self.p, self.new, np.array([self.own.get(w, 0) for w in self.new]), self.tables)
            more = [v @ self.p[f"word.W{d}"] + self.p[f"word.B{d}"] for d in "fb"]
            if self.n + len(v) > len(self.proj[0]):
                self.proj = [np.concatenate([a[: self.n], np.empty((max(len(v), self.n // 2), a.shape[1]), np.float32)]) for a in self.proj]
            for a, b in zip(self.proj, more):
                a[self.n : self.n + len(v)] = b
            self.n += len(v)
            self.new = []

    def _windows(self, ids: np.ndarray, lengths: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """The logits of all windows of the sequences of ids, and how many each has."""
        count = np.where(lengths > 0, np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1), 0)
        base = np.cumsum(lengths) - lengths
        first = np.cumsum(count) - count
        start = np.arange(count.sum()) - np.repeat(first, count)
        start = start * STRIDE
        left = np.minimum(np.repeat(lengths, count) - start, WINDOW)
        start += np.repeat(base, count)
        logits = np.empty(len(start), np.float32)
        p, steps = self.p, np.arange(WINDOW)[:, None]
        for lo in range(0, len(start), rows):
            s, n = start[lo : lo + rows], left[lo : lo + rows]
            mask = (steps < n).astype(np.float32)
            at = ids[np.minimum(s + steps, len(ids) - 1)]
            states = np.concatenate([scan(a[at], mask, p[f"word.U{d}"], d == "b") for a, d in zip(self.proj, "fb")], axis=2)
            logits[lo : lo + rows] = pool(states, mask, p["word.A"], p["word.v"])[0] @ p["out.w"] + p["out.b"]
        return logits, count

    def windows(self, words: list[str]) -> np.ndarray:
        """The logit of each window of a list of words."""
        ids = self._ids(words)
        self._learn()
        starts = np.array(windows_of(len(ids)))
        parts = [ids[k : k + WINDOW] for k in starts]
        return self._windows(np.concatenate(parts), np.array([len(x) for x in parts]))[0]

    def logits(self, texts: list[str], words: int = 200_000) -> np.ndarray:
        """The mean of the TOP highest window logits of each text (-inf: no
        words). Very long texts go in parts; neighbouring parts share no window
        but a window's worth of words."""
        tops = np.full((len(texts), TOP), -np.inf, np.float32)
        ids: list[np.ndarray] = []
        of: list[int] = []

        def flush() -> None:
            if ids:
                self._learn()
                logits, count = self._windows(np.concatenate(ids), np.array([len(x) for x in ids]))
                text = np.repeat(np.array(of), count)
                order = np.lexsort((-logits, text))
                text, logits = text[order], logits[order]
                at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, int)
                rank = np.arange(len(text)) - np.repeat(at, np.diff(np.r_[at, len(text)]))
                new = np.full_like(tops, -np.inf)
                new[text[rank < TOP], rank[rank < TOP]] = logits[rank < TOP]
                tops[:] = -np.sort(-np.concatenate([tops, new], axis=1), axis=1)[:, :TOP]
            ids.clear()
            of.clear()
            if len(self.known) > self.memory:
                self._reset()

        held = 0
        for k, text in enumerate(texts):
            tail: list[str] = []
            for part in blocks(text):
                now = tail + words_of(part)
                ids.append(self._ids(now))
                of.append(k)
                tail = now[-STRIDE:]
                held += len(now)
                if held >= words:
                    flush()
                    held = 0
        flush()
        found = np.isfinite(tops)
        return np.where(found.any(axis=1), np.where(found, tops, 0).sum(axis=1) / np.maximum(found.sum(axis=1), 1), -np.inf)


def train(docs: list[tuple[str, int]], seed: int = 7, word_steps: int = 450, rounds: int = 3, steps: int = 90, batch: int = 96, rate: float = 0.01) -> dict | None:
    """A model from (text, label) rows, or None unless both labels occur.

    Only the label of a whole document is known, not which of its words earn it.
    First the character layer learns from single words, each with the share of
    toxic documents among those that hold it. Then the whole network learns from
    windows: of each document those that it scores highest itself, chosen anew
    every round, and for label 0 a random one more. The scale of the texts'
    logits is fitted on every sixth document, which no step has seen.
    """
    if len({y for _, y in docs}) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    docs = sorted((docs[i] for i in order), key=lambda d: d[1])
    apart = [d for k, d in enumerate(docs) if k % 6 == 2] if len(docs) >= 50 else docs
    known = [d for k, d in enumerate(docs) if k % 6 != 2] if len(docs) >= 50 else docs
    if len({y for _, y in apart}) < 2 or len({y for _, y in known}) < 2:
        apart = known = docs

    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t, _ in known]
    labels = np.array([y for _, y in known])
    if not vocabulary:
        return None
    words = list(vocabulary)
    held = np.zeros((2, len(words)))
    for ids, y in zip(texts, labels):
        held[y, np.unique(ids)] += 1
    total = held.sum(axis=0)
    frequent = [int(i) for i in np.argsort(-total, kind="stable")[: WORDS - 1] if total[i] >= 8]
    own = {words[i]: k + 1 for k, i in enumerate(frequent)}
    owns = np.array([own.get(w, 0) for w in words])
    p = initial(rng, len(own) + 1)
    p |= {"one.w": rng.normal(0, 0.3, 2 * HIDDEN + WORD_EMBED).astype(np.float32), "one.b": np.zeros(1, np.float32)}

    of = np.bincount(labels, minlength=2)
    shares = held / of[:, None]
    often = shares.sum(axis=0)
    target = (shares[1] / often).astype(np.float32)
    draw = np.cumsum(often / often.sum())
    adam = Adam(p, rate)
    for k in range(word_steps):
        at = np.unique(np.minimum(np.searchsorted(draw, rng.random(1536)), len(words) - 1))
        adam.rate = rate * (1 - 0.8 * k / word_steps)
        at = at[np.argsort([-len(words[i]) for i in at], kind="stable")]
        adam.step(word_gradient(p, [words[i] for i in at], owns[at], target[at])[1])

    ones = word_vectors(p, words, owns, projections(p)) @ p["one.w"] + p["one.b"]
    scores = [np.array([ones[ids[s : s + WINDOW]].max() for s in windows_of(len(ids))]) if len(ids) else None for ids in texts]
    p.pop("one.w"), p.pop("one.b")
    adam = Adam(p, rate)
    total, done, mean = rounds * steps, 0, {}
    for r in range(rounds):
        if r:
            scorer = Scorer(p, own, memory=1 << 30)
            scorer._ids(words)
            scores = [scorer.windows([words[i] for i in ids]) if len(ids) else None for ids in texts]
        picked: list[tuple[list[str], int]] = []
        for ids, y, score in zip(texts, labels, scores):
            if score is None:
                continue
            starts = np.array(windows_of(len(ids)))
            use = starts[np.argsort(-score, kind="stable")[: 1 if y else 2]].tolist() + ([] if y else [int(rng.choice(starts))])
            picked += [([words[i] for i in ids[s : s + WINDOW]], int(y)) for s in dict.fromkeys(use)]
        sides = [np.array([k for k, (_, y) in enumerate(picked) if y == side]) for side in (0, 1)]
        for _ in range(steps):
            adam.rate = rate * (1 - 0.9 * done / total)
            part = [picked[k] for side in sides if len(side) for k in rng.choice(side, batch // 2)]
            adam.step(loss_gradient(p, own, part)[1])
            done += 1
            if 4 * done > 3 * total:  # the mean of the last weights generalizes better
                mean = {k: mean.get(k, 0) + v / (total - 3 * total // 4) for k, v in p.items()}
    p = {k: v.astype(np.float32) for k, v in mean.items()}
    logits = Scorer(p, own, memory=30_000).logits([t for t, _ in apart], words=50_000).astype(np.float64)
    a, b = _scale(np.maximum(logits, -30), np.array([y for _, y in apart]))
    return {"p": p, "own": own, "a": a, "b": b}


def initial(rng: np.random.Generator, owns: int) -> dict[str, np.ndarray]:
    """The network's weights before training; owns: words with their own vector, and one."""
    p = {"embed": rng.normal(0, 0.3, (CHARS, EMBED)), "gram": rng.normal(0, 0.05, (GRAMS, EMBED)), "own": rng.normal(0, 0.05, (owns, WORD_EMBED)), "out.w": rng.normal(0, 0.3, 2 * HIDDEN), "out.b": np.zeros(1)}
    p["own"][0] = 0
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return p | init_layer(rng, "char", EMBED, HIDDEN, ATTENTION) | init_layer(rng, "word", 2 * HIDDEN + WORD_EMBED, HIDDEN, ATTENTION)


def word_gradient(p: dict, words: list[str], own: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Cross-entropy of single words with their shares and its gradients."""
    vectors, kept = encoded(p, words, own)
    q = sigmoid(vectors @ p["one.w"] + p["one.b"])
    loss = -float((target * np.log(q + 1e-9) + (1 - target) * np.log(1 - q + 1e-9)).mean())
    d = ((q - target) / len(words)).astype(p["one.w"].dtype)
    g = {"one.w": vectors.T @ d, "one.b": d.sum(keepdims=True)}
    encoded_gradient(p, d[:, None] * p["one.w"], kept, g)
    return loss, g


def loss_gradient(p: dict, own: dict[str, int], part: list[tuple[list[str], int]]) -> tuple[float, dict]:
    """Cross-entropy of windows (words, label) and its gradients."""
    keys = sorted({w for window, _ in part for w in window}, key=lambda w: (-len(w), w))
    place = {k: i for i, k in enumerate(keys)}
    vectors, kept = encoded(p, keys, np.array([own.get(w, 0) for w in keys]))
    n = max(len(window) for window, _ in part)
    at = np.zeros((n, len(part)), np.int64)
    mask = np.zeros((n, len(part)), np.float32)
    for j, (window, _) in enumerate(part):
        at[: len(window), j] = [place[w] for w in window]
        mask[: len(window), j] = 1
    pooled, word_cache = forward(p, "word", vectors[at], mask)
    y = np.array([label for _, label in part], np.float32)
    q = sigmoid(pooled @ p["out.w"] + p["out.b"])
    loss = -float((y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)).mean())
    d = ((q - y) / len(part)).astype(p["out.w"].dtype)
    g = {"out.w": pooled.T @ d, "out.b": d.sum(keepdims=True)}
    d_words = gradient(p, "word", d[:, None] * p["out.w"], word_cache, g)
    d_vectors = np.zeros_like(vectors)
    np.add.at(d_vectors, at.ravel(), (d_words * mask[:, :, None]).reshape(-1, d_words.shape[-1]))
    encoded_gradient(p, d_vectors, kept, g)
    return loss, g


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a x + b): the logit with the best F-score (precision counts
    twice as much as recall) scores the threshold 0.7; the slope comes from the spread of the logits below it."""
    order = np.argsort(-x, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 1.5 * hits / (np.arange(1, len(x) + 1) + 0.5 * y.sum())
    f1[:-1][x[order][:-1] == x[order][1:]] = 0  # equal logits stand together
    k = int(np.argmax(f1))
    cut = (x[order[k]] + x[order[min(k + 1, len(x) - 1)]]) / 2
    # no more documents than the labels have toxic ones: few labels tell little of the rest
    cut = max(cut, float(np.quantile(x, 1 - y.mean())))
    a = 1.5 / max(float(np.std(x[x > -30])) if (x > -30).any() else 1.0, 0.1)
    return a, float(np.log(0.7 / 0.3) - a * cut)


def held_out():
    """Whether crc32 of doc_id as text leaves 1 by 3; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, most_toxic: int = 1200, most_other: int = 2400, longest: int = 20_000) -> dict | None:
    """A model from a bounded sample: at most ``most_toxic`` and ``most_other``
    labelled rows that are not held out, of texts up to ``longest`` code points,
    in a fixed order of their hashes."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [known.where(F.col("toxic") == y).orderBy(*order).limit(most) for y, most in ((1, most_toxic), (0, most_other))]
    # at most most_toxic + most_other ids: small enough to broadcast whatever the corpus
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    text = text_of(docs)
    rows = docs.select("doc_id", text.alias("text")).join(chosen, "doc_id").where(F.length("text") <= longest)
    # rows repeated under an id must not exceed the bound
    rows = rows.orderBy(*order, "text").limit(most_toxic + most_other).collect()
    out = [(r["text"], r["toxic"]) for r in rows]
    model = train(out)
    returned_memory()
    return model


def returned_memory() -> None:
    """What the training used goes back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def scored(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    docs: doc_id, text (null: empty); other columns are ignored. The score is
    the scaled mean of the highest TOP logits of all windows; texts without words score 0, as do
    all where no model could be fitted (no labels, or one kind only). Repeated
    rows stay; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = m and Scorer(m["p"], m["own"])
        for batch in batches:
            if m is None:
                score = np.zeros(batch.num_rows)
            else:
                logits = scorer.logits(batch.column(2).to_pylist()).astype(np.float64)
                score = np.where(np.isfinite(logits), sigmoid(m["a"] * np.where(np.isfinite(logits), logits, 0) + m["b"]), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, from_arrow_schema(schema))


def without_toxic(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the model doesn't reject, columns unchanged."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = m and Scorer(m["p"], m["own"])
        for batch in batches:
            if m is not None:
                logits = scorer.logits([t or "" for t in batch.column(at).to_pylist()]).astype(np.float64)
                score = np.where(np.isfinite(logits), sigmoid(m["a"] * np.where(np.isfinite(logits), logits, 0) + m["b"]), 0.0)
                batch = batch.filter(pa.array(score < threshold))
            yield batch

    return docs.mapInArrow(run, schema)
