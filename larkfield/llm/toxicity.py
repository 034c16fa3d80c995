"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the presence of words (lower case, without punctuation) and of
their first letters. One weight for each feature is shared by all thresholds:
P(grade >= k) = sigmoid(score - threshold_k), with ordered thresholds. The
output is the expected grade, and a document is toxic if P(grade >= 1) is at
least one half.

The labels only say toxic or not, so the grades of the training rows are made
from a score that has not seen them: the rows are dealt into folds, a binary
model of the other folds scores each, and toxic rows have grade 1, 2 or 3 by
the third of the toxic rows' scores they are in. Other rows have grade 0.

The fit uses a bounded sample of labelled rows (``sample``), which bounds the
features too: every one that ``LEAST_ROWS`` sampled rows have is weighted.
Feature counts are summed in Spark; the driver sees the features and, for each
sampled row, the numbers of those that it has, and fits them in blocks. Rows
are sorted in Spark and come to it many in one value, a partition at a time, so
that it never holds an object for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, columns, map_batches, stored, text_or_empty

#: Grades of toxic rows, and folds and steps of the scores that they are made from.
GRADES, FOLDS, FOLD_STEPS = 3, 2, 150
#: The least rows that have a feature.
LEAST_ROWS = 5
#: Ones of the sparse matrix that a step of the fit takes at a time.
BLOCK = 1 << 20
PREFIX = 5
#: ASCII punctuation becomes a space.
SPACED = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def text_words(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").lower().translate(SPACED).split())


def features_of(word: bytes) -> list[bytes]:
    """The word itself (as ``=word``) and its first letters (as ``^first``)."""
    return [b"=" + word, b"^" + word[:PREFIX]] if len(word) >= PREFIX else [b"=" + word]


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: list[float]

    def score(self, text: str) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in {f for w in text_words(text) for f in features_of(w)}])

    def at_least(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [float(1 / (1 + np.exp(-np.clip(score - t, -500, 500)))) for t in self.thresholds]


def summed(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The sum of the weights of each row's features, in blocks."""
    z = np.zeros(n)
    for k in range(0, len(cols), BLOCK):
        z += np.bincount(rows[k : k + BLOCK], weights[cols[k : k + BLOCK]], n)
    return z


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, steps: int = 300, penalty: float = 1.0, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds with the highest penalised likelihood, by Adam; (rows, cols) are the ones of the sparse matrix."""
    top, n = int(grades.max()), len(grades)
    shares = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    start = -np.log(shares / (1 - np.minimum(shares, 1 - 1e-6)))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    params = np.concatenate([np.zeros(n_features), start[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        weights, first, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        thresholds = first + np.concatenate([[0], np.cumsum(gaps)])
        z = summed(rows, cols, weights, n)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds[None], -30, 30)))
        full = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = full * (1 - full)
        at = np.arange(n), grades
        p = np.maximum(full[at] - full[at[0], grades + 1], 1e-12)
        dz = -(slope[at] - slope[at[0], grades + 1]) / p / n
        dt = np.zeros((n, top + 2))
        dt[at] += slope[at] / p / n
        dt[at[0], grades + 1] -= slope[at[0], grades + 1] / p / n
        dt = dt[:, 1 : top + 1].sum(axis=0)
        slopes = penalty * weights / n
        for k in range(0, len(cols), BLOCK):
            slopes += np.bincount(cols[k : k + BLOCK], dz[rows[k : k + BLOCK]], n_features)
        grad = np.concatenate([slopes, [dt.sum()], dt[::-1].cumsum()[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_features], params[n_features] + np.concatenate([[0], np.cumsum(np.exp(params[n_features + 1 :]))])


def severity_grades(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """0 for rows that are not toxic, else 1 to GRADES by the rank of the row's cross-fitted score among the toxic rows; equal scores have one grade."""
    n, score = len(toxic), np.zeros(len(toxic))
    fold = np.zeros(n, int)
    for kind in (0, 1):  # each fold has its share of both
        own = np.flatnonzero(toxic == kind)
        fold[own] = np.arange(len(own)) % FOLDS
    for k in range(FOLDS):
        seen = fold != k
        if toxic[seen].min() == toxic[seen].max():
            continue
        place, own = (np.cumsum(seen) - 1).astype(rows.dtype), seen[rows]
        weights, _ = fit_ordinal(place[rows[own]], cols[own], toxic[seen], n_features, FOLD_STEPS)
        score[~seen] = summed(rows, cols, weights, n)[~seen]
    grades, bad = np.zeros(n, int), np.flatnonzero(toxic == 1)
    distinct, counts = np.unique(score[bad].round(9), return_counts=True)
    below = (np.cumsum(counts) - counts)[np.searchsorted(distinct, score[bad].round(9))]
    grades[bad] = 1 + GRADES * below // len(bad)
    return grades


def sparse_rows(found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and column of every one, label of every row) of ``found`` (toxic, found: the columns of a row as four-byte numbers), sorted by both."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels, rows = batch.columns
            lengths = np.array([len(r) // 4 for r in rows.to_pylist()], "<i4")
            return batch_of([labels.to_numpy().astype("<i4").tobytes()], [lengths.tobytes()], [b"".join(rows.to_pylist())])

        return step

    toxic, lengths, cols = [], [], []
    for r in map_batches(found.orderBy("toxic", "found"), make, "toxic binary, lengths binary, cols binary").toLocalIterator():
        for parts, part in zip((toxic, lengths, cols), r, strict=True):
            parts.append(np.frombuffer(part, "<i4"))
    lengths = np.concatenate(lengths)
    return np.repeat(np.arange(len(lengths), dtype=np.min_scalar_type(len(lengths))), lengths), np.concatenate(cols), np.concatenate(toxic)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most about ``sample`` labelled rows, taken by a hash of their ids.

    Rows without a label or with a null id are passed over; a document that is
    labelled twice is toxic if one label says so; of rows that share an id the
    text that comes first counts. Without both toxic and other labelled rows
    the model finds nothing toxic.
    """
    marks = labels.where("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    size = marks.count()
    if size > sample:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / size))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [sorted(text_words(t)) for t in batch.column(2).to_pylist()]
            return batch_of(batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.binary())))

        return step

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(marks), "id").select("id", "toxic", "text")  # at most about ``sample`` ids
    kind = dict(rows.dtypes)["id"]
    worded = stored(map_batches(rows, make, f"id {kind}, toxic int, words array<binary>").groupBy("id").agg(F.min("toxic").alias("toxic"), F.min("words").alias("words")))
    totals = {r.toxic: r.n for r in worded.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = OrdinalModel({}, [1e3, 2e3, 3e3])
    if not totals.get(0) or not totals.get(1):
        return nothing
    long = F.length("word") >= PREFIX
    both = F.when(long, F.array(F.concat(F.lit(b"="), F.col("word")), F.concat(F.lit(b"^"), F.substring("word", 1, PREFIX)))).otherwise(F.array(F.concat(F.lit(b"="), F.col("word"))))
    held = worded.select("id", "toxic", F.explode("words").alias("word")).select("id", "toxic", F.explode(both).alias("feature")).distinct()
    counts = held.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where(F.col("bad") + F.col("good") >= LEAST_ROWS)
    index = {bytes(r.feature): k for k, r in enumerate(counts.select("feature").orderBy("feature").toLocalIterator())}

    def make_rows():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.array(sorted({index[f] for w in words for f in features_of(w) if f in index}), "<i4").tobytes() for words in batch.column(2).to_pylist()]
            return batch_of(batch.column(1), pa.array(found, pa.binary()))

        return step

    at, cols, toxic = sparse_rows(stored(map_batches(worded, make_rows, "toxic int, found binary")))
    grades = severity_grades(at, cols, toxic, len(index))
    grades = np.unique(grades, return_inverse=True)[1]  # grades that occur, from 0 without gaps
    weights, thresholds = fit_ordinal(at, cols, grades, len(index))
    return OrdinalModel({f: float(weights[k]) for f, k in index.items()}, thresholds.tolist())


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` with severity (the expected grade), grade (the number of thresholds passed with P >= 1/2) and toxic.

    Edge cases: null and empty texts have no features and so the severity of
    the thresholds alone; repeated rows are scored each; columns of ``docs``
    with these names are replaced.
    """
    carried = [c for c in docs.columns if c not in ("severity", "grade", "toxic")]
    rows = docs.select(F.struct(*columns(carried)).alias("row"), text_or_empty(text_col).alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            above = [model.at_least(model.score(t)) for t in batch.column(1).to_pylist()]
            return batch_of(batch.column(0), [round(sum(a), 6) for a in above], [sum(p >= 0.5 for p in a) for a in above], [a[0] >= 0.5 for a in above])

        return step

    schema = T.StructType([rows.schema["row"], T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    return map_batches(rows, make, schema).select(*[F.col("row")[c].alias(c) for c in carried], "severity", "grade", "toxic")
