"""Hashed-text linear models: features, fitting on a bounded labelled sample, scores in Arrow batches.

A document's vector: each word and each pair of neighbouring words at its hash, and (optionally) each character
n-gram of a word, spread over the word's n-grams; all divided by the square root of the number of words.
The model is a cumulative link: P(grade <= k) = sigmoid(threshold_k - score), with thresholds in rising order;
with two grades this is logistic regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import flatten, result, slices, sums
from foliant.llm.common import U64, batch_words, mix

GRAMS = (3, 4)
PAIR, CHAR = U64(0x9FB21C651E98DF25), U64(0xA0761D6478BD642F)


@dataclass
class Features:
    """One batch: word indices over distinct words, hash places of words, pairs and character n-grams."""

    starts: np.ndarray
    index: np.ndarray
    distinct: list[bytes]
    word: np.ndarray
    pair: np.ndarray
    pair_ok: np.ndarray
    gram: np.ndarray
    gram_offset: np.ndarray
    gram_length: np.ndarray


def char_grams(words: list[bytes], mask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash places of the byte n-grams of ``<word>``, flat, with each word's offset and number."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    n = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(words)), n)
    left = ends[owner] - np.arange(len(flat))  # bytes of the word from here on
    found, whose = [], []
    for g in GRAMS:
        m = len(flat) - g + 1
        if m <= 0:
            continue
        code = np.full(m, U64(g))
        for j in range(g):
            code = (code << U64(8)) | flat[j : j + m]
        ok = left[:m] >= g
        found.append((mix(code[ok] ^ CHAR) & mask).astype(np.int64))
        whose.append(owner[:m][ok])
    place = np.concatenate(found) if found else np.zeros(0, np.int64)
    owner = np.concatenate(whose) if whose else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    length = np.bincount(owner, minlength=len(words))
    return place[order], np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64), length


def features(texts: pa.Array, dims: int, chars: bool) -> Features:
    mask = U64(dims - 1)
    words = batch_words(texts)
    index, starts, distinct, h = words.index, words.starts, words.distinct, words.hashes
    token = h[index]
    pair = (mix(token[:-1] * PAIR + token[1:]) & mask).astype(np.int64)
    ok = np.ones(len(pair), bool)
    inner = starts[1:-1]
    ok[inner[(inner > 0) & (inner < len(index))] - 1] = False
    grams = char_grams(distinct, mask) if chars and distinct else (np.zeros(0, np.int64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64))
    return Features(starts, index, distinct, (mix(h) & mask).astype(np.int64), pair, ok, *grams)


def scores(f: Features, weights: np.ndarray) -> np.ndarray:
    """The linear score of each document of the batch."""
    per_word = weights[f.word].astype(np.float64)
    if len(f.gram):
        per_word += sums(weights[f.gram], np.concatenate((f.gram_offset, [len(f.gram)]))) / np.maximum(f.gram_length, 1)
    token = per_word[f.index]
    if len(f.pair):
        token[:-1] += np.where(f.pair_ok, weights[f.pair], 0)
    return sums(token, f.starts) / np.sqrt(np.maximum(np.diff(f.starts), 1))


def sparse_rows(f: Features, counts: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each document of the batch, for fitting; ``counts``: not divided by the root of its number of words."""
    rows = []
    for a, b in zip(f.starts[:-1], f.starts[1:]):
        ws = f.index[a:b]
        at, value = [f.word[ws]], [np.ones(b - a)]
        if b - a > 1:
            at.append(f.pair[a : b - 1])
            value.append(np.ones(b - a - 1))
        if len(f.gram):
            at.append(f.gram[flatten(ws, f.gram_offset, f.gram_length)])
            value.append(np.repeat(1 / np.maximum(f.gram_length[ws], 1), f.gram_length[ws]))
        place, back = np.unique(np.concatenate(at), return_inverse=True)
        rows.append((place, np.bincount(back, np.concatenate(value), len(place)) / (1 if counts else np.sqrt(max(b - a, 1)))))
    return rows


@dataclass
class Model:
    """Weights, thresholds in rising order, and the calibration P = sigmoid(slope * (score - threshold) + shift)."""

    weights: np.ndarray
    thresholds: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    #: Squares of the places' strengths, where rows are weighed by them.
    squares: np.ndarray | None = None

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one column each."""
        z = self.slope * (score[:, None] - self.thresholds[None, :]) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def sample_rows(docs: DataFrame, grades: DataFrame, train_rows: int, dims: int, chars: bool, counts: bool = False) -> list:
    """Feature rows of at most ``train_rows`` graded documents, those with the smallest hash of their id.

    ``grades`` has doc_id and grade; of an id with several texts the one with the smallest hash counts. Only these
    bounded rows reach the driver, as sparse vectors in binary columns (int32 places, float32 values), so that no
    Python number is made for an entry.
    """
    picked = grades.dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(train_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("place", pa.binary()), ("value", pa.binary())])

    def vectors(batches):
        for b in slices(batches, "text"):
            rows = sparse_rows(features(b["text"], dims, chars), counts)
            yield result(schema, b["doc_id"], b["grade"], [p.astype("<i4").tobytes() for p, _ in rows], [v.astype("<f4").tobytes() for _, v in rows])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.col("grade").cast("int").alias("grade"), "text")
    made = texts.mapInArrow(vectors, "doc_id long, grade int, place binary, value binary")
    one = made.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("place", "value").alias("h"), "place", "value")).alias("v"))
    return sorted(one.select("doc_id", "grade", "v.place", "v.value").collect(), key=lambda r: (r.doc_id, r.grade))


@dataclass
class Weighed:
    """A row whose values are weighed by the strengths of their places."""

    grade: int
    place: bytes
    value: bytes


def fitted(rows: list) -> list:
    """The rows that ``fit`` learns from; every fourth is left for the calibration."""
    return [r for i, r in enumerate(rows) if i % 4 != 3]


def strengths(rows: list, n_grades: int, dims: int, least: int = 5) -> np.ndarray:
    """How well each place tells grades apart: the largest absolute log ratio, over all thresholds, of its shares of rows above
    and below; 0 for places in fewer than ``least`` of the rows that are fitted."""
    below, above = np.zeros((n_grades - 1, dims)), np.zeros((n_grades - 1, dims))
    total = np.zeros((2, n_grades - 1))
    for r in fitted(rows):
        place = np.frombuffer(r.place, "<i4")
        below[r.grade :, place] += 1
        above[: r.grade, place] += 1
        total[0, r.grade :] += 1
        total[1, : r.grade] += 1
    ratio = np.abs(np.log((above + 1) / (total[1, :, None] + 2)) - np.log((below + 1) / (total[0, :, None] + 2))).max(axis=0)
    return np.where(below[0] + above[0] >= least, ratio, 0).astype(np.float32)


def weighed(r, strength: np.ndarray) -> Weighed:
    """Counts times strengths, over the root of the sum of counts times squared strengths: words that say nothing don't dilute the others."""
    w, n = strength[np.frombuffer(r.place, "<i4")].astype(np.float64), np.frombuffer(r.value, "<f4")
    return Weighed(r.grade, r.place, (n * w / np.sqrt(max((n * w * w).sum(), 1e-9))).astype("<f4").tobytes())


def weighed_scores(f: Features, model: Model) -> np.ndarray:
    """Scores of whole documents for a model of weighed rows, whose weights hold the strengths."""
    n = np.maximum(np.diff(f.starts), 1)
    return scores(f, model.weights) * n**0.25 / np.sqrt(np.maximum(scores(f, model.squares), 1e-9))


def fit(rows: list, n_grades: int, dims: int, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Maximum likelihood by Adam steps over all rows; thresholds stay in order as a start plus positive gaps.

    With no rows, or one grade only, all weights are 0 and every tail is 1.
    """
    held = [r for i, r in enumerate(rows) if i % 4 == 3]
    used = fitted(rows)
    grade = np.array([r.grade for r in used], dtype=np.int64)
    if len(set(grade.tolist())) < 2:
        return Model(np.zeros(dims, np.float32), np.full(n_grades - 1, -50.0))
    row = np.repeat(np.arange(len(used), dtype=np.int32), [len(r.place) // 4 for r in used])
    value = np.frombuffer(b"".join(r.value for r in used), "<f4")
    live, place = np.unique(np.frombuffer(b"".join(r.place for r in used), "<i4"), return_inverse=True)
    place = place.astype(np.int32)
    k = n_grades - 1
    param = np.zeros(len(live) + k)
    start = [np.log((np.mean(grade <= j) + 1e-3) / (np.mean(grade > j) + 1e-3)) for j in range(k)]
    param[len(live)] = start[0]
    param[len(live) + 1 :] = np.log(np.maximum(np.diff(start), 1e-2))
    first, second = np.zeros_like(param), np.zeros_like(param)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, rounds + 1):
        w, gap = param[: len(live)], np.exp(param[len(live) + 1 :])
        cut = np.concatenate(([-np.inf], param[len(live)] + np.concatenate(([0], np.cumsum(gap))), [np.inf]))
        s = np.bincount(row, value * w[place], len(used))
        hi, lo = sig(cut[grade + 1] - s), sig(cut[grade] - s)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p by the upper and the lower cut
        gs = (dhi - dlo) / len(used)  # gradient of the loss by the score
        g = np.empty_like(param)
        g[: len(live)] = np.bincount(place, value * gs[row], len(live)) + ridge * w
        by_cut = np.array([(dlo[grade == j + 1].sum() - dhi[grade == j].sum()) / len(used) for j in range(k)])
        g[len(live)] = by_cut.sum()
        g[len(live) + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gap
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        param -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(dims, np.float32)
    weights[live] = param[: len(live)]
    cuts = param[len(live)] + np.concatenate(([0], np.cumsum(np.exp(param[len(live) + 1 :]))))
    return calibrate(Model(weights, cuts), held)


def calibrate(model: Model, held: list, rounds: int = 50) -> Model:
    """Platt's scaling on rows the fit hasn't seen: one slope and one shift for all thresholds, by Newton steps."""
    if len({r.grade for r in held}) < 2:
        return model
    score = np.array([float(np.dot(model.weights[np.frombuffer(r.place, "<i4")], np.frombuffer(r.value, "<f4"))) for r in held])
    grade = np.array([r.grade for r in held])
    z = (score[:, None] - model.thresholds[None, :]).ravel()
    y = (grade[:, None] > np.arange(len(model.thresholds))[None, :]).ravel().astype(float)
    y = (y * y.sum() + 1) / (y.sum() + 2) * y + (1 - y) / ((1 - y).sum() + 2)  # Platt's smoothed targets
    x = np.stack([z, np.ones_like(z)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - y) + 1e-3 * (ab - [1.0, 0.0]))
        ab -= np.clip(step, -1, 1)
    return Model(model.weights, model.thresholds, float(max(ab[0], 1e-3)), float(ab[1]))
