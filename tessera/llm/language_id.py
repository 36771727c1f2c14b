"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams (2 to 4 bytes of the lower-cased text, runs of white space as one space) as
relative frequencies. The families aren't given: languages whose mean feature vectors are more alike than
languages are on average form one. Linear support vector machines, one versus one, separate the families;
within a family further ones separate its languages. Votes decide, margins break ties.

The model is fitted on a bounded sample, ``PER_LANGUAGE`` documents of each language at most about, chosen by a hash
of the text; only that sample and the model's weights pass through the driver. Prediction reads the
whole text of every document and nothing but the text.

A null text or one without letters is ``und`` with score 0. A null ``doc_id`` is not held out and not learned
from; null languages aren't learned from. Repeated rows each get their own row; an empty table gives no rows.
Without any labelled row, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import LOWER, SPACE, column, slices, text_buffers

PER_LANGUAGE = 300
ORDERS = (2, 3, 4)
BITS = 12
SLICE_BYTES = 1 << 20
ROUNDS = 120
PENALTY = 1e-4

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
_MULTIPLIER = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def ngram_places(off: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of every n-gram of each order."""
    low = LOWER[raw]
    space = SPACE[low]
    low[space] = 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[keep]
    code = low[keep].astype(np.uint32)
    for n, multiplier in zip(ORDERS, _MULTIPLIER, strict=True):
        if len(code) < n:
            continue
        gram = np.zeros(len(code) - n + 1, np.uint32)
        for j in range(n):
            gram = gram * np.uint32(257) + code[j : len(code) - n + 1 + j]
        ok = text[: len(gram)] == text[n - 1 :]
        yield text[: len(gram)][ok], ((gram * np.uint32(multiplier)) >> np.uint32(32 - BITS)).astype(np.int64)[ok]


def features(texts: list[str]) -> np.ndarray:
    """Relative n-gram frequencies, one row per text, a block of columns per order."""
    out = np.zeros((len(texts), len(ORDERS) << BITS), np.float32)
    for i, t in enumerate(texts):
        off, raw = text_buffers(pa.array([t], pa.large_string()))
        for k, (_, f) in enumerate(ngram_places(off, raw)):
            out[i, k << BITS : (k + 1) << BITS] = np.bincount(f, minlength=1 << BITS)[: 1 << BITS] / max(1, len(f))
    return out


def _svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is +1 or -1."""
    scale = np.sqrt(np.mean(np.sum(x * x, axis=1))) or 1.0
    x = np.hstack([x / scale, np.full((len(x), 1), 0.3, np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest eigenvalue of the weighted second moments
        top = x.T @ (share * (x @ top))
        size = float(np.linalg.norm(top)) or 1.0
        top /= size
    step = 1.0 / (2.2 * size + PENALTY)
    w = v = np.zeros(x.shape[1], np.float32)
    for r in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (PENALTY * v - 2 * x.T @ (share * slack * y))
        v = new + r / (r + 3) * (new - w)
        w = new
    return w[:-1] / scale, float(w[-1] * 0.3)


def families(means: np.ndarray) -> list[list[int]]:
    """Languages grouped by mean vectors that are more alike than the average of all pairs."""
    n = len(means)
    center = means - means.mean(axis=0)
    unit = center / np.maximum(1e-12, np.linalg.norm(center, axis=1, keepdims=True))
    like = unit @ unit.T
    pairs = list(combinations(range(n), 2))
    if n < 3:
        return [[i] for i in range(n)]
    cut = np.mean([like[i, j] for i, j in pairs])
    groups = [[i] for i in range(n)]
    while len(groups) > 2:
        best = max(combinations(range(len(groups)), 2), key=lambda g: np.mean([like[i, j] for i in groups[g[0]] for j in groups[g[1]]]))
        if np.mean([like[i, j] for i in groups[best[0]] for j in groups[best[1]]]) <= cut:
            break
        groups[best[0]] += groups.pop(best[1])
    return [sorted(g) for g in sorted(groups, key=min)]


class Model:
    """Languages, families, and the machines: families against each other, then languages within each."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(x) for x in langs])
        x = features(texts)
        self.families = families(np.stack([x[y == k].mean(axis=0) for k in range(len(self.langs))])) if len(y) else []
        self.family_of = {k: f for f, ks in enumerate(self.families) for k in ks}
        fam = np.array([self.family_of[k] for k in y.tolist()])
        self.machines: list[tuple[int, int, int]] = []  # (family or -1, one, other)
        weights, bias = [], []
        for group, one, other, value in [(-1, a, b, fam) for a, b in combinations(range(len(self.families)), 2)] + [
                (f, a, b, y) for f, ks in enumerate(self.families) for a, b in combinations(ks, 2)]:
            rows = (value == one) | (value == other)
            w, c = _svm(x[rows], np.where(value[rows] == one, 1, -1).astype(np.float32))
            self.machines.append((group, one, other))
            weights.append(w)
            bias.append(c)
        self.weights = np.array(weights, np.float32).reshape(len(weights), len(ORDERS) << BITS).T.copy()
        self.bias = np.array(bias)

    def margins(self, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        out = np.tile(self.bias, (n, 1)) if len(self.bias) else np.zeros((n, 0))
        for k, (text, f) in enumerate(ngram_places(off, raw)):
            count = np.maximum(1, np.bincount(text, minlength=n))
            for c in range(out.shape[1]):
                out[:, c] += np.bincount(text, self.weights[k << BITS : (k + 1) << BITS, c][f], n) / count
        return out

    def _vote(self, margins: np.ndarray, group: int, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(winner, its least margin) among the members, per text."""
        votes = np.zeros((len(margins), len(members)))
        least = np.full((len(margins), len(members)), np.inf)
        for c, (g, one, other) in enumerate(self.machines):
            if g != group:
                continue
            for k, sign in ((members.index(one), 1), (members.index(other), -1)):
                m = sign * margins[:, c]
                votes[:, k] += (m > 0) + 1e-3 * np.tanh(m)
                least[:, k] = np.minimum(least[:, k], m)
        win = votes.argmax(axis=1)
        return np.array(members)[win], least[np.arange(len(win)), win]

    def predict(self, off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each text."""
        m = self.margins(off, raw)
        family, sure = self._vote(m, -1, list(range(len(self.families))))
        lang, score = np.zeros(len(m), np.int64), np.zeros(len(m))
        chance = lambda x: 1 / (1 + np.exp(-3 * np.clip(x, -10, 10)))
        for f, members in enumerate(self.families):
            rows = family == f
            k, within = self._vote(m, f, members)
            lang[rows] = k[rows]
            score[rows] = (chance(sure) * chance(within))[rows]
        return lang, score


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Labelled documents to learn from: about ``per_language`` of each language, by a hash of the text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.select("text", "lang").limit(0)
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(per_language / n))])
    return rows.where(draw < F.element_at(share, F.col("lang"))).select("text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    rows = sample(docs, per_language).orderBy("lang", "text").toArrow()
    keep = [(t, k) for t, k in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), strict=True) if any(c.isalpha() for c in t)]
    return Model([t for t, _ in keep], [k for _, k in keep])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                text = column(part, "text")
                off, raw = text_buffers(text)
                ascii_ = np.append(0, np.cumsum(_LETTERS[raw]))
                high = np.append(0, np.cumsum(_HIGH[raw]))
                lettered = ascii_[off[1:]] > ascii_[off[:-1]]
                for i in np.flatnonzero(~lettered & (high[off[1:]] > high[off[:-1]])).tolist():
                    lettered[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode())
                if model.langs:
                    lang, score = model.predict(off, raw)
                else:
                    lang, score, lettered = np.zeros(len(lettered), np.int64), np.zeros(len(lettered)), np.zeros(len(lettered), bool)
                names = pa.array([*model.langs, "und"]).take(pa.array(np.where(lettered, lang, len(model.langs))))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "held_out"), names, pa.array(np.where(lettered, score, 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
