"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word has two inputs: an embedding of the whole word (hashed to
``WORDS`` rows) beside the scaled sum of the embeddings of its character 3- and
5-grams (hashed to ``GRAM_ROWS`` rows).  A GRU reads a window of ``WINDOW`` words in each direction,
attention pools the states, and a logistic unit scores the window.  A document's
score is the highest score of its windows; windows overlap and cover the whole
text.  Numpy only, in training and in scoring.

Training takes a bounded sample of labelled rows: at most ``SAMPLE`` rows per
label, chosen by a hash of doc_id, whose text has at most ``SAMPLE_CHARS``
characters.  The label marks a document, not a window, so a document teaches
through its highest window (a random one in the first epochs).  The model is a
few hundred kilobytes whatever the input, and is broadcast.

Defined results: null and empty texts get the score of a window without words;
letters are ASCII letters, digits and all non-ASCII bytes, case is folded for
ASCII; several labels of a doc_id count as their maximum, null labels as none;
without both labels in the sample every score is the share of label 1 (0 if
there is none); repeated rows are scored one by one; an empty table gives an
empty table; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import _BASE, id_text, mix64, prefix_hash, release, steps, utf8, words

#: Window length and distance of window starts, in words.
WINDOW, STRIDE = 48, 32
#: Hidden units per direction, attention units, embedding sizes.
HIDDEN, ATTEND, WORD_DIM, CHAR_DIM = 8, 8, 8, 8
WORDS, GRAM_ROWS, GRAMS = 1 << 13, 1 << 14, (3, 5)
#: The training sample's bound (rows per label, characters per row).
SAMPLE, SAMPLE_CHARS = 1000, 20_000
EPOCHS, RANDOM_EPOCHS, BATCH, RATE = 12, 2, 64, 0.01
#: Share of the distinct words whose whole-word input is hidden in a training step.
HIDE = 0.6
#: Fixed value: rows whose crc32 leaves this remainder mod 5 are held out.
FOLDS, HELD_OUT = 5, 0
#: Windows scored at once.
CHUNK = 4096


class Words:
    """The words of some texts: distinct words with their inputs, and who has which."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        upper = (data >= 65) & (data <= 90)
        data = data + upper * np.uint8(32)
        letter = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        start, end, self.row = words(data, offsets, letter)
        h, inv = prefix_hash(data)
        h = mix64((h[end] - h[start]) * inv[start])
        distinct, first, self.token = np.unique(h, return_index=True, return_inverse=True)
        self.word = (distinct % np.uint64(WORDS)).astype(np.int64)
        s, e = start[first], end[first]
        length = e - s
        self.begin = np.cumsum(length) - length
        self.length = length
        at = np.repeat(s - self.begin, length) + np.arange(length.sum())
        # Character n-grams: bytes of the word from each place on, a mark at its ends.
        far = np.repeat(e, length)
        gram = np.zeros(len(at), np.uint64)
        grams = []
        last = max(len(data) - 1, 0)
        opens = at == np.repeat(s, length)
        for k in range(max(GRAMS)):
            byte = np.where(at + k < far, data[np.minimum(at + k, last)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            gram = gram * np.uint64(257) + byte
            if k + 1 in GRAMS:
                grams.append(mix64((gram * np.uint64(2) + opens) * _BASE + np.uint64(k)) % np.uint64(GRAM_ROWS))
        self.gram = np.stack(grams, axis=1).reshape(-1).astype(np.int64)     # len(GRAMS) per byte
        self.begin, self.length = self.begin * len(GRAMS), self.length * len(GRAMS)
        self.scale = (1 / np.sqrt(np.maximum(self.length, 1))).astype(np.float32)[:, None]
        count = np.bincount(self.row, minlength=len(offsets) - 1)
        base = np.cumsum(count) - count
        many = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
        #: Windows: their row, first token and token count (0: a text without words).
        self.window_row = np.repeat(np.arange(len(count)), many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.window_at = base[self.window_row] + k * STRIDE
        self.window_len = np.clip(count[self.window_row] - k * STRIDE, 0, WINDOW)

    def tokens(self, pick) -> tuple[np.ndarray, np.ndarray]:
        """``(distinct word, present)`` of every place of the picked windows."""
        place = np.arange(WINDOW)
        there = place < self.window_len[pick][:, None]
        at = np.where(there, self.window_at[pick][:, None] + place, 0)
        token = self.token if len(self.token) else np.zeros(1, np.int64)
        return token[at], there


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM

        def w(*shape, scale=None):
            return (r.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        self.p = {"word": w(WORDS, WORD_DIM, scale=0.3), "gram": w(GRAM_ROWS, CHAR_DIM, scale=0.3)}
        for side in "fb":
            self.p |= {f"x{side}": w(d, 3 * HIDDEN), f"h{side}": w(HIDDEN, 3 * HIDDEN),
                       f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": w(2 * HIDDEN, ATTEND), "ac": np.zeros(ATTEND, np.float32), "av": w(ATTEND),
                   "o": w(2 * HIDDEN), "oc": np.zeros(1, np.float32)}

    def inputs(self, t: Words) -> np.ndarray:
        """The input of every distinct word."""
        if not len(t.word):
            return np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
        grams = np.add.reduceat(self.p["gram"][t.gram], t.begin, axis=0) * t.scale
        return np.concatenate([self.p["word"][t.word], grams], axis=1).astype(np.float32)

    def _read(self, side: str, gates: np.ndarray, there: np.ndarray, keep: list | None):
        """States of one direction; ``gates(token)`` are the inputs' share of the gates."""
        n, h = there.shape[0], HIDDEN
        state, u = np.zeros((n, h), np.float32), self.p[f"h{side}"]
        out = np.zeros((n, WINDOW, h), np.float32)
        for t in range(WINDOW) if side == "f" else reversed(range(WINDOW)):
            x, g = gates(t), state @ u
            zr = _sigmoid(x[:, :2 * h] + g[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h:] + r * g[:, 2 * h:])
            m = there[:, t:t + 1]
            if keep is not None:
                keep.append((t, state, z, r, new, g[:, 2 * h:], m))
            state = np.where(m, new + z * (state - new), state)
            out[:, t] = state
        return out

    def forward(self, x: np.ndarray, token: np.ndarray, there: np.ndarray, keep: dict | None = None):
        """Logit of every window."""
        states = []
        for side in "fb":
            share = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
            trace = keep.setdefault(side, []) if keep is not None else None
            states.append(self._read(side, lambda t, s=share: s[token[:, t]], there, trace))
        h = np.concatenate(states, axis=2)
        e = np.tanh(h @ self.p["a"] + self.p["ac"])
        s = np.where(there, e @ self.p["av"], -1e9)
        s = np.exp(s - s.max(axis=1, keepdims=True)) * there
        s = s / np.maximum(s.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", s, h)
        if keep is not None:
            keep |= {"h": h, "e": e, "s": s, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["oc"][0]

    def gradients(self, t: Words, pick, label: np.ndarray, shown: np.ndarray) -> dict[str, np.ndarray]:
        """``shown``: per distinct word, is its whole-word input on?  (Else the network
        has to read its characters.)"""
        x, (token, there) = self.inputs(t), t.tokens(pick)
        x[:, :WORD_DIM] *= shown[:, None]
        k: dict = {}
        miss = (_sigmoid(self.forward(x, token, there, k)) - label).astype(np.float32) / len(label)
        p, g = self.p, {}
        g["o"], g["oc"] = k["pooled"].T @ miss, np.array([miss.sum()], np.float32)
        d_pool = miss[:, None] * p["o"]
        d_h = k["s"][:, :, None] * d_pool[:, None, :]
        d_s = np.einsum("nh,nth->nt", d_pool, k["h"])
        d_s = k["s"] * (d_s - (k["s"] * d_s).sum(axis=1, keepdims=True))
        d_e = d_s[:, :, None] * p["av"] * (1 - k["e"] ** 2)
        g["av"] = np.einsum("nt,nta->a", d_s, k["e"])
        g["a"], g["ac"] = np.einsum("nth,nta->ha", k["h"], d_e), d_e.sum(axis=(0, 1))
        d_h += d_e @ p["a"].T
        d_x = np.zeros_like(x)
        n = HIDDEN
        for i, side in enumerate("fb"):
            u, wx = p[f"h{side}"], p[f"x{side}"]
            g[f"h{side}"], share = np.zeros_like(u), np.zeros((len(x), 3 * n), np.float32)
            d = np.zeros((len(label), n), np.float32)
            for step, state, z, r, new, gn, m in reversed(k[side]):
                d = d + d_h[:, step, i * n:(i + 1) * n]
                live = d * m
                d_new = live * (1 - z) * (1 - new ** 2)
                d_z = live * (state - new) * z * (1 - z)
                d_r = d_new * gn * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"h{side}"] += state.T @ d_gate
                d = d * ~m + live * z + d_gate @ u.T
                np.add.at(share, token[:, step], np.concatenate([d_z, d_r, d_new], axis=1))
            g[f"c{side}"], g[f"x{side}"] = share.sum(axis=0), x.T @ share
            d_x += share @ wx.T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        if len(t.word):
            np.add.at(g["word"], t.word, d_x[:, :WORD_DIM] * shown[:, None])
            np.add.at(g["gram"], t.gram, np.repeat(d_x[:, WORD_DIM:] * t.scale, t.length, axis=0))
        return g

    def logits(self, t: Words, pick=None) -> np.ndarray:
        x, pick = self.inputs(t), np.arange(len(t.window_row)) if pick is None else pick
        return np.concatenate([self.forward(x, *t.tokens(pick[i:i + CHUNK])) for i in range(0, len(pick), CHUNK)]
                              or [np.zeros(0, np.float32)])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of every text: the highest of its windows."""
        t = Words(data, offsets)
        best = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(best, t.window_row, self.logits(t).astype(float))
        return _sigmoid(best)


class Constant:
    """Scores everything alike: there is nothing to learn from one label."""

    def __init__(self, share: float):
        self.share = share

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.share)


def train(texts: list[str], labels: np.ndarray, seed: int = 3) -> Network | Constant:
    """Adam on the logistic loss; both labels weigh the same."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Constant(float(labels.mean()) if len(labels) else 0.0)
    net, r = Network(seed), np.random.default_rng(seed)
    chances = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    n = 0
    for epoch in range(EPOCHS):
        for _ in range(max(12, 2 * int(min((labels == 1).sum(), (labels == 0).sum())) // BATCH)):
            pick = r.choice(len(texts), BATCH, p=chances)
            t = Words(*utf8(pa.array([texts[i] for i in pick], pa.large_string())))
            order = r.random(len(t.window_row)) if epoch < RANDOM_EPOCHS else net.logits(t)
            best = np.lexsort((-order, t.window_row))
            best = best[np.unique(t.window_row[best], return_index=True)[1]]
            shown = (r.random(max(1, len(t.word))) >= HIDE).astype(np.float32)
            g = net.gradients(t, best, labels[pick], shown)
            n += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= (rate * m / (1 - 0.9 ** n) / (np.sqrt(s / (1 - 0.99 ** n)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id):
    """Column: is the row kept from training?"""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame) -> Network | Constant:
    """Trains on the bounded sample of ``labels(doc_id, toxic)``."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
             .filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    order = F.xxhash64("doc_id", F.lit(5))
    some = known.filter("label = 0").orderBy(order).limit(SAMPLE).unionByName(
        known.filter("label = 1").orderBy(order).limit(SAMPLE))
    rows = (id_text(docs).filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(some), "doc_id")
            .select("doc_id", "text", "label").collect())          # at most 2 * SAMPLE rows of bounded length
    rows = sorted({(r["doc_id"], r["text"], r["label"]) for r in rows})[:4 * SAMPLE]
    model = train([r[1] for r in rows], np.array([r[2] for r in rows]))
    del rows
    release()           # the driver goes on with the stages that follow
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = [model.value.score(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                   for i, j in steps(offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(model.value.score(*utf8(part.column("text"))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
