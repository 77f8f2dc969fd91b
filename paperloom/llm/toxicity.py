"""A toxicity score by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: one by its hashed name and one as the sum over its hashed runs of
three and five characters, so unseen forms of known stems are recognised. The network reads all
overlapping windows of a text (``WINDOW`` words, every ``STRIDE``); attention pools the states of a
window into one logit, and a text's score is that of its highest window.

It is trained in numpy on the driver on a bounded sample of labelled documents (``SAMPLE``, and
``LONG_SAMPLE`` of more than ``LONGEST`` characters, which give their first ``LONGEST_WHOLE``); labels
are for whole documents, so each round learns from the window that the network holds highest, and
from others of clean documents. What would be learned by heart is kept out: word and character
vectors start from log odds that count each document less one, so that what one document holds alone
says nothing, and only rows that ``HELD_BY`` documents of the sample share are learned. A fourth of the
sample is kept back: of two strengths of decay (``DECAYS``) and of all rounds, that is used which serves
it best, and a logistic curve fitted on it makes scores probabilities.

Words are runs of letters, digits and non-ASCII bytes, ASCII letters in lower case.

Defined results: a null, empty or wordless text scores the network's answer to an empty window,
at most 0.01; without labels of both kinds every score is 0; a null doc_id is not held out and
never learned from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.nets import Adam, gru, gru_back, sigmoid
from paperloom.llm.tables import sampled, stored
from paperloom.llm.words import Piece, hash_words, mix, pieces

WINDOW, STRIDE = 64, 48
HIDDEN, EMBED, BUCKETS = 8, 8, 1 << 14
GRAMS = (3, 5)
ACCEPT = 0.3
HELD_OUT, FOLDS = 2, 4
# Documents of each label to learn from: up to LONGEST characters, and longer ones with their first LONGEST_WHOLE.
SAMPLE = {1: 1000, 0: 2000}
LONG_SAMPLE, LONGEST, LONGEST_WHOLE = 40, 6_000, 120_000
# Documents that must share a word or a run of characters for its vector to be learned, and the share kept back.
HELD_BY, KEPT_BACK, LEAST_BACK = 3, 4, 4
# How far each step draws the tables back to their log odds, and the other weights to zero: a large
# sample is served best by the first, a small or noisy one by the second; the part kept back decides.
DECAYS = ((0.002, 0.0), (1.0, 0.01))
# Documents whose worth the log odds start with, of both kinds as in the sample.
PRIOR = 4.0
ROUNDS, BATCH, STEPS = 6, 256, 24
_U = np.uint64
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[128:] = np.arange(128, 256)
_FOLDED[48:58], _FOLDED[97:123] = np.arange(48, 58), np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)


class Features(NamedTuple):
    """The different words of a piece (``word`` buckets; grams of word i are
    ``gram[of[i]:of[i + 1]]``), and windows of indexes into them, one past the last for no word."""

    word: np.ndarray
    gram: np.ndarray
    of: np.ndarray
    windows: np.ndarray
    row: np.ndarray


def _grams(p: Piece, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character runs of the chosen words, each word between two marks, and their bounds."""
    length = (p.end - p.start)[at]
    bounds = np.concatenate([[0], np.cumsum(length + 2)])
    of = np.repeat(np.arange(len(at)), length + 2)
    within = np.arange(bounds[-1]) - bounds[of] - 1
    edge = (within < 0) | (within >= length[of])
    chars = np.where(edge, 1, p.text[np.clip(p.start[at][of] + within, 0, len(p.text) - 1)]).astype(np.uint64)
    names, words = [], []
    for n in GRAMS:
        code = np.zeros(max(len(chars) - n + 1, 0), np.uint64)
        for k in range(n):
            code = code << _U(8) | chars[k : k + len(code)]
        whole = of[n - 1 :] == of[: len(code)] if len(code) else np.zeros(0, bool)
        names.append((mix(code[whole] + _U(n)) % _U(BUCKETS)).astype(np.int64))
        words.append(of[: len(code)][whole])
    gram, word = np.concatenate(names), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return gram[order], np.searchsorted(word[order], np.arange(len(at) + 1))


def features(p: Piece, hashes: np.ndarray | None = None) -> Features:
    hashes = hash_words(p) if hashes is None else hashes
    names, at, index = np.unique(hashes, return_index=True, return_inverse=True)
    gram, of = _grams(p, at)
    # windows start at 0, STRIDE, ... while words are left beyond the one before
    count = np.maximum(np.ceil((p.n_words - WINDOW) / STRIDE).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(count)), count)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    place = (p.of[:-1][row] + first)[:, None] + np.arange(WINDOW)
    padded = np.append(index, len(names))
    windows = np.where(place < p.of[1:][row][:, None], padded[np.minimum(place, len(index))], len(names))
    return Features((names % _U(BUCKETS)).astype(np.int64), gram, of, windows.astype(np.int32), row)


def _sums(table: np.ndarray, gram: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of the table's rows for the grams of each word, one column at a time to save memory."""
    out = np.empty((len(of) - 1, table.shape[1]), np.float32)
    for k in range(table.shape[1]):
        total = np.append(0.0, np.cumsum(table[:, k][gram], dtype=np.float64))
        out[:, k] = total[of[1:]] - total[of[:-1]]
    return out


def _pairs(row: np.ndarray, name: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """The different (row, name) pairs."""
    return np.divmod(np.unique(row * np.int64(names) + name), names)


class Network:
    """Both directions run as one recurrence of twice the width with a block-diagonal matrix."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, 2 * EMBED

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {
            "word": np.zeros((BUCKETS, EMBED), np.float32), "gram": np.zeros((BUCKETS, EMBED), np.float32),
            "ahead": draw(e, 3 * h), "behind": draw(e, 3 * h), "bias": np.zeros(6 * h, np.float32), "u": draw(2 * h, 6 * h),
            "a": draw(2 * h, h), "a0": np.zeros(h, np.float32), "v": draw(h), "out": draw(2 * h), "out0": np.array([-2.0], np.float32),
        }
        side = np.arange(2 * h) // h
        self.block = (side[:, None] == np.tile(side, 3)[None, :]).astype(np.float32)
        self.p["u"] *= self.block
        # which rows of the two tables are learned, and the curve that makes logits probabilities
        self.shared = {"word": np.ones(BUCKETS, bool), "gram": np.ones(BUCKETS, bool)}
        self.curve = (1.0, 0.0)

    def vectors(self, f: Features) -> np.ndarray:
        return np.hstack([self.p["word"][f.word], _sums(self.p["gram"], f.gram, f.of)])

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of each different word, for either direction, with a row for no word."""
        x = self.vectors(f)
        return tuple(np.vstack([x @ self.p[n], np.zeros((1, 3 * HIDDEN), np.float32)]) for n in ("ahead", "behind"))

    def states(self, ahead: np.ndarray, behind: np.ndarray, windows: np.ndarray, keep: bool = False):
        """States of both directions, (steps, windows, 2 * HIDDEN)."""
        none, steps = len(ahead) - 1, windows.T
        parts = [g.reshape(WINDOW, -1, 3, 1, HIDDEN) for g in (ahead[steps], behind[steps[::-1]])]
        x = np.concatenate(parts, axis=3).reshape(WINDOW, -1, 6 * HIDDEN) + self.p["bias"]
        there = (steps != none).astype(np.float32)[:, :, None]
        mask = np.concatenate([np.repeat(there, HIDDEN, 2), np.repeat(there[::-1], HIDDEN, 2)], axis=2)
        states, tape = gru(x, self.p["u"], mask, keep)
        h = np.concatenate([states[:, :, :HIDDEN], states[::-1, :, HIDDEN:]], axis=2)
        return h, there, tape

    def pool(self, h: np.ndarray, there: np.ndarray):
        inner = np.tanh(h @ self.p["a"] + self.p["a0"])
        e = np.where(there[:, :, 0] > 0, inner @ self.p["v"], -1e9)
        w = np.exp(e - e.max(axis=0)) * there[:, :, 0]
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", w, h)
        return pooled @ self.p["out"] + self.p["out0"][0], inner, w, pooled

    def logits(self, f: Features, size: int = 1024) -> np.ndarray:
        ahead, behind = self.inputs(f)
        parts = [self.windows_logits(ahead, behind, f.windows[i : i + size]) for i in range(0, len(f.windows), size)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def windows_logits(self, ahead: np.ndarray, behind: np.ndarray, windows: np.ndarray) -> np.ndarray:
        h, there, _ = self.states(ahead, behind, windows)
        return self.pool(h, there)[0]

    def gradients(self, f: Features, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h2 = self.p, HIDDEN
        used, local = np.unique(windows, return_inverse=True)
        if used[-1] != len(f.word):  # keep the last place for no word
            used = np.append(used, len(f.word))
        local = local.reshape(windows.shape)
        words = used[:-1]
        counts = np.diff(f.of)[words]
        spans = np.concatenate([[0], np.cumsum(counts)])
        gram = f.gram[np.repeat(f.of[words] - spans[:-1], counts) + np.arange(spans[-1])]
        sub = Features(f.word[words], gram, spans, local, np.zeros(0))
        x = self.vectors(sub)
        ahead, behind = self.inputs(sub)
        h, there, tape = self.states(ahead, behind, local, keep=True)
        logit, inner, w, pooled = self.pool(h, there)
        g = {}
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["out"], g["out0"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * p["out"]
        dh = w[:, :, None] * d_pool[None]
        dw = np.einsum("bh,tbh->tb", d_pool, h)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tbk->k", de, inner)
        di = de[:, :, None] * p["v"] * (1 - inner**2)
        g["a"], g["a0"] = np.einsum("tbh,tbk->hk", h, di), di.sum(axis=(0, 1))
        dh += di @ p["a"].T
        dx, g["u"] = gru_back(np.concatenate([dh[:, :, :h2], dh[::-1, :, h2:]], axis=2), p["u"], tape)
        g["u"] = g["u"] * self.block
        g["bias"] = dx.sum(axis=(0, 1))
        dx = dx.reshape(WINDOW, -1, 3, 2, HIDDEN)
        d_word = np.zeros_like(x)
        for side, name, steps in ((0, "ahead", local.T), (1, "behind", local.T[::-1])):
            gates = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            np.add.at(gates, steps.reshape(-1), dx[:, :, :, side].reshape(-1, 3 * HIDDEN))
            g[name] = x.T @ gates[:-1]
            d_word += gates[:-1] @ p[name].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], sub.word, d_word[:, :EMBED])
        np.add.at(g["gram"], gram, np.repeat(d_word[:, EMBED:], counts, axis=0))
        for name, shared in self.shared.items():
            g[name][~shared] = 0
        return g

    def scores(self, logits: np.ndarray) -> np.ndarray:
        slope, offset = self.curve
        return sigmoid(slope * logits + offset)

    def start_from(self, f: Features, y: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """Log odds of words and grams among the documents to ``learn`` from become their first coordinate.

        Returns each window's highest word.
        """
        row, word = _pairs(np.repeat(f.row, WINDOW), f.windows.reshape(-1), len(f.word) + 1)
        use = (word < len(f.word)) & learn[row]
        row, word = row[use], word[use]
        counts = np.diff(f.of)[word]
        grams = f.gram[np.repeat(f.of[word] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        n = [max((y[learn] == k).sum(), 1) for k in (0, 1)]
        for name, rows, slots, weight in (("word", row, f.word[word], 0.5), ("gram", np.repeat(row, counts), grams, 0.25)):
            rows, slots = _pairs(rows, slots, BUCKETS)
            # documents of either kind that hold it; each says only what the others say as well
            clean, toxic = (np.bincount(slots, y[rows] == k, BUCKETS) for k in (0, 1))
            self.shared[name] = clean + toxic >= HELD_BY
            clean, toxic = np.maximum(clean - 1, 0), np.maximum(toxic - 1, 0)
            prior = PRIOR / sum(n)
            self.p[name][:, 0] = weight * (np.log((toxic + prior * n[1]) / (clean + prior * n[0])) - np.log(n[1] / n[0]))
        x = self.vectors(f)
        score = np.append(x[:, 0] + x[:, EMBED], -9.0)
        return score[f.windows].max(axis=1)


def kept_back(y: np.ndarray) -> np.ndarray:
    """Every fourth document of each label; none where a label has too few to tell anything."""
    back = np.zeros(len(y), bool)
    for k in (0, 1):
        back[np.flatnonzero(y == k)[KEPT_BACK - 1 :: KEPT_BACK]] = True
    return back if min((back & (y == k)).sum() for k in (0, 1)) >= LEAST_BACK else np.zeros(len(y), bool)


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the logits; targets are drawn in as if each kind had one more of the other."""
    n = [(y == k).sum() for k in (0, 1)]
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(slope * logits + offset)
        w, gap = q * (1 - q) + 1e-6, q - target
        h = np.array([[(w * logits**2).sum() + 1e-3, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(gap * logits).sum(), gap.sum()]))
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = max(slope - step[0], 0.05), offset - step[1]
    return float(slope), float(offset)


def _tops(net: Network, f: Features, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """The logits of all windows, and of each document's highest."""
    height = net.logits(f)
    top = np.full(documents, -np.inf, height.dtype)
    np.maximum.at(top, f.row, height)
    return height, top


def fit(texts: list[str], labels: np.ndarray) -> Network:
    """Trains on whole texts; the same texts in the same order give the same network."""
    y = np.asarray(labels, np.float32)
    back = kept_back(y)
    f = features(*_one_piece(texts))
    tried = [_trained(f, y, back, *decay) for decay in (DECAYS if back.any() else DECAYS[-1:])]
    return min(tried, key=lambda x: x[0])[1]


def _trained(f: Features, y: np.ndarray, back: np.ndarray, for_tables: float, for_weights: float) -> tuple[float, Network]:
    """The network of the round that serves the documents kept back best, and its loss on them."""
    net, rng = Network(), np.random.default_rng(4)
    height = net.start_from(f, y, ~back)
    start = {name: net.p[name].copy() for name in net.shared}
    adam, best_loss, best = Adam(net.p, 0.01), np.inf, None
    for turn in range(ROUNDS):
        order = np.lexsort((height, f.row))
        highest = order[np.append(f.row[order][1:] != f.row[order][:-1], True)]
        highest = highest[~back[f.row[highest]]]
        other = rng.permutation(len(f.row))
        other = other[(y[f.row[other]] == 0) & ~back[f.row[other]]][: len(highest) // 2]
        chosen = np.concatenate([highest, other])
        # a small sample is read more often and in smaller batches, STEPS at least in a round
        size = int(np.clip(len(chosen) // 6, 32, BATCH))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(-(-STEPS * size // len(chosen)))])
        for i in range(0, len(chosen), size):
            part = chosen[i : i + size]
            adam.step(net.gradients(f, f.windows[part], y[f.row[part]]), 0.01 if turn < ROUNDS // 2 else 0.003)
            for name, values in net.p.items():
                if name in start:
                    values += for_tables * (start[name] - values)
                elif name not in ("bias", "a0", "out0"):
                    values *= 1 - for_weights
        height, top = _tops(net, f, len(y))
        if back.any():
            curve = platt(top[back].astype(np.float64), y[back])
            q = np.clip(sigmoid(curve[0] * top[back] + curve[1]), 1e-6, 1 - 1e-6)
            loss = -np.where(y[back] == 1, np.log(q), np.log(1 - q)).mean()
            if loss < best_loss:
                best_loss, best = loss, ({k: v.copy() for k, v in net.p.items()}, curve)
    if best:
        net.p, net.curve = best
    return best_loss, net


def _one_piece(texts: list[str]) -> tuple[Piece, np.ndarray]:
    """All texts of the training sample as one piece, with the hashes of its words."""
    parts = list(pieces(pa.array(texts, pa.string()), _FOLDED))
    hashes = np.concatenate([hash_words(p) for p in parts])
    at = np.cumsum([0, *[len(p.text) for p in parts]])
    words = np.cumsum([0, *[len(p.start) for p in parts]])
    whole = Piece(
        0,
        np.concatenate([p.text for p in parts]),
        np.concatenate([[0], *[p.rows[1:] + a for p, a in zip(parts, at)]]),
        np.concatenate([p.start + a for p, a in zip(parts, at)]),
        np.concatenate([p.end + a for p, a in zip(parts, at)]),
        np.concatenate([[0], *[p.of[1:] + a for p, a in zip(parts, words)]]),
    )
    return whole, hashes


def _scores(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column("text"), _FOLDED):
                f = features(p)
                n = len(p.rows) - 1
                top = np.full(n, -np.inf)
                np.maximum.at(top, f.row, net.logits(f))
                score = net.scores(top)
                score = np.where(p.n_words > 0, score, np.minimum(score, 0.01))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p.first, n), pa.array(score)], names=["doc_id", "score"])

    return run


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, text, label) of at most SAMPLE[k] documents and LONG_SAMPLE longer ones of each label k, by a hash of the id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(remainder() != HELD_OUT)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    sized = texts.select("doc_id", (F.length("text") > LONGEST).alias("long")).join(marks.where(F.col("label").isin(0, 1)), "doc_id").distinct()
    sized = stored(sized, "sized")
    kinds = [(k, long, LONG_SAMPLE if long else n) for k, n in SAMPLE.items() for long in (False, True)]
    ids = [sampled(sized.where((F.col("label") == k) & (F.col("long") == long)), "doc_id", n) for k, long, n in kinds]
    chosen = reduce(DataFrame.unionByName, ids)  # a few thousand ids, so they may go to every task
    found = texts.withColumn("long", F.length("text") > LONGEST).join(F.broadcast(chosen), ["doc_id", "long"])
    cut = found.select("doc_id", F.substring("text", 1, LONGEST_WHOLE).alias("text"), "label")
    return cut.orderBy("label", "doc_id", "text").limit(2 * (sum(SAMPLE.values()) + 2 * LONG_SAMPLE))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = sample(docs, labels).collect()
    y = np.array([r["label"] for r in known])
    if len(y) and 0 < y.sum() < len(y):
        net = fit([r["text"] for r in known], y)
        out = rows.mapInArrow(_scores(net), "doc_id long, score double")
    else:
        out = rows.select("doc_id", F.lit(0.0).alias("score"))
    held = F.coalesce(remainder() == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
