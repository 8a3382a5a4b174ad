"""Toxicity: a bidirectional gated recurrent network over windows of words, with attention pooling.

A word's input is an embedding of the whole word next to the sum of embeddings of its character
4-grams (with its borders), both hashed into tables.  Windows of 32 words overlap by a quarter; the
attention-pooled states of a window give a logit and a text's logit is its greatest window's.
Network, gradients and training are numpy on a bounded sample; every text is scored in tasks.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage
from .frames import HASHES, hash_bounds
from .hashing import FOLD, SPACED, mix, randoms, slices, text_buffer

WINDOW, STRIDE = 32, 24
_WORDS, _GRAMS = 1 << 16, 1 << 16  # rows of the hashed embedding tables
_BLOCK = 2048  # windows scored at once
_BYTE, _PLACE = randoms(256, 1 << 23), randoms(1024, 1 << 24) | np.uint64(1)


class Words:
    """The words (A-Z folded) of a batch of texts, their windows and network inputs."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        parted = np.full(len(buf) + len(offs), 10, np.uint8)  # a break before, between and after the texts
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            parted[a + i + 1:b + i + 1] = buf[a:b]
        inside = SPACED[parted]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = change[::2], change[1::2]
        self.chars = np.where(inside, FOLD[parted], 0).astype(np.uint8)
        self.text_offs = np.searchsorted(self.start, offs + np.arange(len(offs)))
        count = np.diff(self.text_offs)
        n = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
        self.first = np.cumsum(n) - n  # first window of each text
        self.owner = np.repeat(np.arange(len(n)), n)
        at = (np.arange(n.sum()) - self.first[self.owner]) * STRIDE
        self.window = self.text_offs[:-1][self.owner] + at
        self.length = np.minimum(WINDOW, count[self.owner] - at)

    def inputs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words a to b: rows of the word table, rows of the 4-gram table, and each word's first 4-gram."""
        lengths = self.end[a:b] - self.start[a:b]
        first = np.cumsum(lengths) - lengths
        rank = np.arange(lengths.sum()) - np.repeat(first, lengths)
        at = rank + np.repeat(self.start[a:b], lengths)
        c = self.chars
        value = _BYTE[c[at]] * _PLACE[rank % len(_PLACE)]
        words = mix(np.add.reduceat(value, first)) if b > a else np.zeros(0, np.uint64)
        after = c[at + 1].astype(np.uint32)
        then = np.where(after > 0, c[np.minimum(at + 2, len(c) - 1)], 0).astype(np.uint32)
        gram = c[at - 1].astype(np.uint32) | c[at].astype(np.uint32) << 8 | after << 16 | then << 24
        grams = (gram * np.uint32(2654435761)) >> np.uint32(16)
        return (words % np.uint64(_WORDS)).astype(np.int64), grams.astype(np.int64), first

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, present) of each place of the windows, shaped (place, window)."""
        step = np.arange(WINDOW)[:, None]
        present = step < self.length[which]
        return np.where(present, self.window[which] + step, 0), present


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Weights, and the passes forward and back over windows given as (place, window) arrays."""

    def __init__(self, seed: int = 11, word_size: int = 12, char_size: int = 12, hidden: int = 16):
        rng = np.random.default_rng(seed)
        self.hidden, size = hidden, word_size + char_size

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.words, self.grams = normal(_WORDS, word_size, scale=0.05), normal(_GRAMS, char_size, scale=0.05)
        self.weights = {
            "into": normal(2, size, 3 * hidden, scale=size ** -0.5), "bias": np.zeros((2, 1, 3 * hidden), np.float32),
            "round": normal(2, hidden, 3 * hidden, scale=hidden ** -0.5), "look": normal(2 * hidden, scale=0.1),
            "out": normal(2 * hidden, scale=(2 * hidden) ** -0.5), "base": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0  # calibration of a text's logit

    def embed(self, words: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros((1, self.words.shape[1] + self.grams.shape[1]), np.float32)
        length = np.diff(np.append(first, len(grams)))
        chars = np.add.reduceat(self.grams[grams], first, axis=0) / np.sqrt(length, dtype=np.float32)[:, None]
        return np.concatenate([self.words[words], chars], 1)

    def forward(self, given: np.ndarray, present: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows; ``given[d, place]``: the gates' inputs in the order direction d reads them."""
        w, h_size = self.weights, self.hidden
        steps, many = present.shape
        here = np.stack([present, present[::-1]], 1)[..., None].astype(np.float32)
        states = np.zeros((steps + 1, 2, many, h_size), np.float32)
        trace = []
        for t in range(steps):
            h = states[t]
            again = h @ w["round"]
            gates = _sigmoid(given[:, t, :, :2 * h_size] + again[..., :2 * h_size])
            z, r = gates[..., :h_size], gates[..., h_size:]
            c = np.tanh(given[:, t, :, 2 * h_size:] + r * again[..., 2 * h_size:])
            states[t + 1] = h + here[t] * z * (c - h)
            if keep:
                trace.append((z, r, c, again[..., 2 * h_size:]))
        both = np.concatenate([states[1:, 0], states[:0:-1, 1]], -1)
        score = np.where(present, both @ w["look"], np.float32(-1e9))
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        pooled = (share[..., None] * both).sum(0)
        return pooled @ w["out"] + w["base"], (here, states, trace, both, share, pooled)

    def backward(self, slope: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of ``given`` for the slope of the loss in each logit."""
        w, h_size = self.weights, self.hidden
        here, states, trace, both, share, pooled = kept
        grad = {"out": slope @ pooled, "base": slope.sum(keepdims=True), "round": np.zeros_like(w["round"])}
        d_pooled = slope[:, None] * w["out"]
        d_share = np.einsum("tbh,bh->tb", both, d_pooled)
        d_score = share * (d_share - (share * d_share).sum(0))
        grad["look"] = np.einsum("tb,tbh->h", d_score, both)
        d_both = share[..., None] * d_pooled + d_score[..., None] * w["look"]
        steps = len(trace)
        d_given = np.empty((2, steps, both.shape[1], 3 * h_size), np.float32)
        d_state = np.zeros_like(states[0])
        for t in range(steps - 1, -1, -1):
            z, r, c, again = trace[t]
            h, on = states[t], here[t]
            d_state[0] += d_both[t, :, :h_size]
            d_state[1] += d_both[steps - 1 - t, :, h_size:]
            d_c = d_state * on * z * (1 - c * c)
            d_z = d_state * on * (c - h) * z * (1 - z)
            d_r = d_c * again * r * (1 - r)
            d_given[:, t] = np.concatenate([d_z, d_r, d_c], -1)
            d_again = np.concatenate([d_z, d_r, d_c * r], -1)
            grad["round"] += h.transpose(0, 2, 1) @ d_again
            d_state = d_state * (1 - on * z) + d_again @ w["round"].transpose(0, 2, 1)
        return grad, d_given

    def logits(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Logits of windows in ascending order."""
        out = np.empty(len(which), np.float32)
        for at in range(0, len(which), _BLOCK):
            part = which[at:at + _BLOCK]
            a, b = int(words.window[part[0]]), int((words.window[part] + words.length[part]).max())
            gates = self.embed(*words.inputs(a, b)) @ self.weights["into"] + self.weights["bias"]
            place, present = words.places(part)
            place = np.where(present, place - a, 0)
            out[at:at + _BLOCK] = self.forward(np.stack([gates[0][place], gates[1][place[::-1]]]), present)[0]
        return out

    def text_logits(self, words: Words) -> np.ndarray:
        """The greatest logit of each text's windows; a text without words has one window without words."""
        if not len(words.first):
            return np.zeros(0, np.float32)
        return np.maximum.reduceat(self.logits(words, np.arange(len(words.owner))), words.first)

    def score(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.text_logits(words).astype(np.float64) + self.shift)))


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    return sorted_rows[first], np.add.reduceat(values[order], first, axis=0)


class _Trainer:
    """Adam for the weights, a step per touched row (Adagrad) for the embedding tables."""

    def __init__(self, net: Network, words: Words, rate: float, table_rate: float):
        self.net, self.words, self.rate, self.table_rate, self.count = net, words, rate, table_rate, 0
        self.word, self.gram, self.first = words.inputs(0, len(words.start))
        self.length = np.diff(np.append(self.first, len(self.gram)))
        self.mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.weights.items()}
        self.seen = {"words": np.full(len(net.words), 1e-6, np.float32), "grams": np.full(len(net.grams), 1e-6, np.float32)}

    def step(self, pace: float, which: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> None:
        net, w = self.net, self.net.weights
        place, present = self.words.places(which)
        used, spot = np.unique(place[present], return_inverse=True)
        if not len(used):
            return
        word, length = self.word[used], self.length[used]
        first = np.cumsum(length) - length
        gram = self.gram[np.arange(length.sum()) + np.repeat(self.first[used] - first, length)]
        x = net.embed(word, gram, first)
        at = np.zeros(place.shape, np.int64)
        at[present] = spot
        gates = x @ w["into"] + w["bias"]
        logit, kept = net.forward(np.stack([gates[0][at], gates[1][at[::-1]]]), present, keep=True)
        slope = ((_sigmoid(logit) - truth) * weight / weight.sum()).astype(np.float32)
        grad, d_given = net.backward(slope, kept)
        d_given[1] = d_given[1][::-1]  # back to the order of the places
        d_given *= present[None, ..., None]
        flat = at.ravel()
        d_gates = np.zeros_like(gates)
        for d in range(2):
            rows, sums = _row_sums(flat, d_given[d].reshape(len(flat), -1))
            d_gates[d][rows] = sums
        grad["into"] = x.T @ d_gates
        grad["bias"] = d_gates.sum(1, keepdims=True)
        d_x = (d_gates @ w["into"].transpose(0, 2, 1)).sum(0)
        self._table(pace, "words", word, d_x[:, :net.words.shape[1]])
        chars = d_x[:, net.words.shape[1]:] / np.sqrt(length, dtype=np.float32)[:, None]
        self._table(pace, "grams", gram, np.repeat(chars, length, axis=0))
        self.count += 1
        for k, g in grad.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            fix = (1 - 0.999 ** self.count) ** 0.5 / (1 - 0.9 ** self.count)
            w[k] -= np.float32(pace * self.rate * fix) * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-8))

    def _table(self, pace: float, name: str, rows: np.ndarray, values: np.ndarray) -> None:
        rows, sums = _row_sums(rows, values)
        known = getattr(self.net, name)[rows].any(1)
        rows, sums = rows[known], sums[known]
        self.seen[name][rows] += (sums * sums).mean(1)
        getattr(self.net, name)[rows] -= np.float32(pace * self.table_rate) * sums / np.sqrt(self.seen[name][rows])[:, None]


def _evidence(net: Network, words: Words, truth: np.ndarray, prior: float = 2.0, least: int = 3) -> np.ndarray:
    """Greatest evidence for label 1 in each window: smoothed log odds of texts that hold a table's row.

    The odds become the first column of the embedding tables, where training starts from them.
    A row that fewer than ``least`` texts hold is zero and stays so: it tells texts apart, not labels.
    """
    word, gram, first = words.inputs(0, len(words.start))
    owner = np.repeat(np.arange(len(words.first)), np.diff(words.text_offs))
    length = np.diff(np.append(first, len(gram)))
    odds = []
    for table, rows, text in ((net.words, word, owner), (net.grams, gram, np.repeat(owner, length))):
        held = np.unique(rows * len(truth) + text)
        count = [np.bincount(held[truth[held % len(truth)] == y] // len(truth), minlength=len(table)) for y in (0, 1)]
        share = [(c + prior) / ((truth == y).sum() + 2 * prior) for y, c in enumerate(count)]
        odds.append(np.log(share[1] / share[0]).astype(np.float32))
        odds[-1][count[0] + count[1] < least] = 0
        table[:, 0] = odds[-1] * 0.5
        table[count[0] + count[1] < least] = 0
    strength = odds[0][word] + (np.maximum.reduceat(odds[1][gram], first) if len(word) else 0)
    place, present = words.places(np.arange(len(words.owner)))
    return np.where(present, np.append(strength, 0)[place], -100).max(0)


def tokenised(texts: list[str | None]) -> Words:
    return Words(*text_buffer(pa.array(texts, pa.string())))


def train(texts: list[str], truth: np.ndarray, epochs: int = 8, least_steps: int = 800, batch: int = 64, seed: int = 11) -> Network:
    """A network from labelled texts, the same for the same input.

    All windows of label 0 count.  Of a text with label 1 those count that hold its strongest
    evidence; in the second half of the passes, those within a half of its greatest score.  There
    are ``epochs`` passes, or more until ``least_steps`` batches.  Both labels weigh the same.  Each fifth text is kept from the network and calibrates the texts'
    logits.  With fewer than two texts of a label the score is the share of label 1.
    """
    net = Network(seed)
    truth = np.asarray(truth, np.float32)
    held = np.arange(len(texts)) % 5 == 4
    if min((truth == 0).sum(), (truth == 1).sum()) < 2:
        share = (truth.sum() + 0.5) / (len(truth) + 1.5)
        net.scale, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    if len(set(truth[~held].tolist())) < 2:
        held[:] = False
    words = tokenised([t for t, h in zip(texts, held) if not h])
    label = truth[~held][words.owner]
    rng, trainer = np.random.default_rng(seed), _Trainer(net, words, 1e-2, 0.02)
    strength = _evidence(net, words, truth[~held])
    chosen = np.flatnonzero((label == 0) | (strength >= 0.9 * np.maximum.reduceat(strength, words.first)[words.owner]))
    epochs = max(epochs, -(-least_steps * batch // max(len(chosen), 1)))
    for epoch in range(epochs):
        if epoch >= epochs / 2:
            p = _sigmoid(net.logits(words, np.arange(len(label))))
            chosen = np.flatnonzero((label == 0) | (p >= np.maximum.reduceat(p, words.first)[words.owner] / 2))
        ones = label[chosen].sum()
        weight = np.where(label[chosen] == 1, len(chosen) / max(ones, 1), len(chosen) / max(len(chosen) - ones, 1)).astype(np.float32)
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), batch):
            part = np.sort(order[at:at + batch])
            trainer.step(1 - 0.9 * epoch / epochs, chosen[part], label[chosen[part]], weight[part])
    if held.any() and len(set(truth[held].tolist())) == 2:
        _calibrate(net, net.text_logits(tokenised([t for t, h in zip(texts, held) if h])).astype(np.float64), truth[held])
    return net


def _calibrate(net: Network, logit: np.ndarray, truth: np.ndarray) -> None:
    """Scale and shift of a text's logit with the least log loss, both labels weighing the same."""
    weight = np.where(truth == 1, 1 / truth.sum(), 1 / (len(truth) - truth.sum()))
    ordered = np.unique(logit)
    cuts = (ordered[1:] + ordered[:-1]) / 2 if len(ordered) > 1 else ordered
    sign = np.where(truth == 1, -1, 1)

    def loss(scale: float, cut: float) -> float:
        return float((weight * np.logaddexp(0, sign * scale * (logit - cut))).sum()) + 0.02 * np.log(scale) ** 2

    scale, cut = min(((s, c) for s in 2.0 ** np.arange(-4, 3) for c in cuts), key=lambda x: loss(*x))
    net.scale, net.shift = float(scale), float(-scale * cut)


def _bounded(docs: DataFrame, labels: DataFrame, fit_chars: int, longest: int) -> DataFrame:
    """(label, at, text): different texts of each label, in the order of a content hash ``at``, until ``fit_chars`` characters.

    Keys and lengths alone meet the labels.  At most twice ``fit_chars`` a label is chosen, and
    a chosen text has a character, so the broadcast keys are no more than that.
    """
    texts = docs.where(F.length("text").between(1, longest)).select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(HASHES)).alias("at"))
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label IN (0, 1)").distinct()
    keys = stage(texts.select("doc_id", "at", F.length("text").alias("n")).join(known, "doc_id").groupBy("label", "at").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("doc_id")))
    bounds = hash_bounds(keys, "label", fit_chars)
    chosen = keys.where(F.col("at") < F.when(F.col("label") == 1, bounds.get(1, 0)).otherwise(bounds.get(0, 0))).select("label", "at", "doc_id")
    return texts.join(F.broadcast(chosen), ["doc_id", "at"]).select("label", "at", "text").dropDuplicates(["label", "at"])


def fit(docs: DataFrame, labels: DataFrame, fit_chars: int = 1_500_000, longest: int = 100_000) -> Network:
    """A network from ``docs(doc_id, text)`` and ``labels(doc_id, label)`` with labels 0 and 1.

    ``fit_chars`` bounds the characters of each label that are learned from, ``longest`` those of
    one text; longer texts, texts without a character and rows without a label are not learned from.
    Repeated texts count once; a text with both labels is learned with both.  The sample, bounded
    as it is, is trained on in one task; no row gives a network that scores every text the same.
    """
    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["at", "label"])
        return pd.DataFrame({"network": [pickle.dumps(train(sample["text"].tolist(), sample["label"].to_numpy()))]})

    found = _bounded(docs, labels, fit_chars, longest).groupBy().applyInPandas(learn, "network binary").first()
    return pickle.loads(found["network"]) if found else train([], np.zeros(0))


def held_out() -> Column:
    """Whether crc32 of the id, as text, is divisible by 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score_texts(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, all windows of whole texts; a null text is empty.

    Rows are scored one by one: repeated rows give repeated results, an empty table none, other
    columns are left behind.  Memory: a slice of 1 MB of text or one longer text, and a block of
    windows.  One map, no shuffle.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            score = net.score(Words(*text_buffer(part.column("text"))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(judge, schema)
