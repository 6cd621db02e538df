"""Quality rules: counts over the whole text, and a calibrated logistic regression on hashed word and
character n-grams, fitted on labelled rows and scored in Arrow batches against a fixed threshold.

Defined results: null and empty texts have no words and fail the base rule; rows without a label are scored like
others; labels with null id or quality aren't used; with no labels, or labels of one class, the model says 1
for every text; repeated rows each get their row; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import result, slices, sums
from foliant.llm.textmodel import Features, Model, features, fit, sample_rows, scores

DIMS = 1 << 18
#: At most so many labelled rows fit the model.
TRAIN_ROWS = 2000
#: Documents whose calibrated probability of good quality is below this go.
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def repeated_words(index: np.ndarray, starts: np.ndarray, n: int = 3) -> np.ndarray:
    """Per document the words that lie in an n-word window found twice or more in it."""
    out = np.zeros(len(starts) - 1, np.int64)
    width = int(index.max()) + 1 if len(index) else 1
    code = index[: max(0, len(index) - n + 1)]
    for k in range(1, n if len(code) else 0):  # a number for the first k + 1 words of each window
        if int(code.max()) * width >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * width + index[k : k + len(code)]
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        if b - a <= n:
            continue
        own = code[a : b - n + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            hit = np.zeros(b - a + 1, np.int64)
            at = np.concatenate((order[1:][same], order[:-1][same]))
            at = np.unique(at)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            out[k] = int((np.cumsum(hit) > 0).sum())
    return out


def repeated_lines(text: str | None) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def rule_counts(texts: list, f: Features) -> list[np.ndarray]:
    chars = np.array([len(w.decode()) for w in f.distinct], np.int64)
    symbols = np.array([len(w) - len(w.translate(None, SYMBOLS)) for w in f.distinct], np.int64)
    n_words = np.diff(f.starts)
    return [n_words, sums(chars[f.index], f.starts), sums(symbols[f.index], f.starts), np.array([repeated_lines(t) for t in texts], np.int64), repeated_words(f.index, f.starts)]


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    rows = sample_rows(docs, labels.select("doc_id", F.col("quality").alias("grade")), train_rows, DIMS, chars=True)
    return fit(rows, 2, DIMS)


def score_quality(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Counts, base rule, probability and verdict for every document; the model (1 MB) travels with the task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("p_good", pa.float64()), ("kept", pa.bool_())])

    def score(batches):
        m = shared.value
        for b in slices(batches, "text"):
            f = features(b["text"], DIMS, chars=True)
            counts = rule_counts(b["text"].to_pylist(), f)
            failed = (counts[0] < min_words) | (100 * counts[4] > max_repeat * counts[0])
            good = m.tails(scores(f, m.weights))[:, 0]
            yield result(schema, b["doc_id"], *counts, failed, good, ~failed & (good >= keep_from))

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per document; ``kept`` is the verdict."""
    return score_quality(docs, fit_quality(docs, labels), **settings)


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The documents that pass, with all their columns, decided row by row in the same scan."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def passing(batches):
        m = shared.value
        for b in slices(batches, "text"):
            f = features(b["text"], DIMS, chars=True)
            n, again = np.diff(f.starts), repeated_words(f.index, f.starts)
            ok = (n >= min_words) & (100 * again <= max_repeat * n) & (m.tails(scores(f, m.weights))[:, 0] >= keep_from)
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(passing, docs.schema)
