"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades rise from 0; one weight vector over hashed words and word pairs is shared by all grades, which differ in
their ordered thresholds only. Counts are weighed by how well a word tells the grades apart in the rows of the fit, so that
a few telling words count in a long text too. Per document: the expected grade, the probability of the top grade and whether
it is selected.

Defined results: null and empty texts get the score 0; ratings with nulls aren't used; with no ratings, or one grade
only, every document gets the top grade; repeated rows each get their row; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import result, slices
from foliant.llm.textmodel import Model, features, fit, sample_rows, strengths, weighed, weighed_scores

DIMS = 1 << 20
#: At most so many rated rows fit the model.
TRAIN_ROWS = 4000
#: Documents are selected whose probability of the top grade is at least this.
SELECT_FROM = 0.5


def grades_of(labels: DataFrame) -> DataFrame:
    """0: poor quality; 1: good but toxic; 2: good and not toxic."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).alias("grade"))


def fit_grades(docs: DataFrame, grades: DataFrame, n_grades: int = 3, train_rows: int = TRAIN_ROWS) -> Model:
    rows = sample_rows(docs, grades, train_rows, DIMS, chars=False, counts=True)
    strength = strengths(rows, n_grades, DIMS)
    model = fit([weighed(r, strength) for r in rows], n_grades, DIMS, rate=0.5)
    return replace(model, weights=model.weights * strength, squares=strength * strength)


def score_grades(docs: DataFrame, model: Model, select_from: float = SELECT_FROM) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("expected_grade", pa.float64()), ("p_top", pa.float64()), ("selected", pa.bool_())])

    def score(batches):
        m = shared.value
        for b in slices(batches, "text"):
            f = features(b["text"], DIMS, chars=False)
            tails = m.tails(weighed_scores(f, m))
            yield result(schema, b["doc_id"], np.diff(f.starts), tails.sum(1), tails[:, -1], tails[:, -1] >= select_from)

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, expected_grade double, p_top double, selected boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_grades(docs, fit_grades(docs, grades_of(labels)))
