"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (`features`), computed in
one streaming Arrow pass.  `fit` gathers per-class counts, sums and outer
products over every labelled training row with a distributed aggregate (the
driver gets two rows of sums, whatever the input's size), shrinks the class
covariances towards the pooled one and its diagonal, and keeps their Cholesky
factors.  `score` turns the difference of Mahalanobis log densities plus the log
prior ratio into a probability of label 1.

Defined cases: a null text is empty; an empty text has the vector of zeros and
gets a score like any other; labels that are null count for nothing, repeated
label rows each count; with no rows of one class that class takes the pooled
moments and a prior of one half row; other columns of the input are not inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T

NAMES = ("log_words", "word_length", "upper", "digit", "symbol", "stop", "comma", "non_ascii", "single", "unique", "repeat", "capital", "line_length", "bang", "bar")
N_FEATURES = len(NAMES)
#: Weight of the pooled covariance, and of its diagonal, in each class's.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.1
#: Bytes of text whose statistics are taken at a time; bounds the worker's memory.
STEP = 500_000
#: Least variance of a feature.
RIDGE = 1e-4


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _STOP, _COMMA, _BANG, _BAR, _LINE = _class("#$%&*<>{}[]\\^~=_@/"), _class(".?"), _class(",;:"), _class("!"), _class("|"), _class("\n")
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    for a, b in T.steps(data, offsets, STEP):
        d, o = T.sub(data, offsets, a, b)
        starts, ends, of = T.words(d, o)
        m, size = np.diff(of), np.diff(o)
        one, n_bytes = np.maximum(m, 1), np.maximum(size, 1)
        hashes = T.hash_ranges(d, starts, ends)
        text = np.repeat(np.arange(b - a), m)
        key = np.sort((text.astype(np.uint64) << np.uint64(42)) | (hashes >> np.uint64(22)))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        unique = np.bincount((key[fresh] >> np.uint64(42)).astype(np.int64), minlength=b - a)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        lengths = ends - starts
        c = lambda k: _counts(k[d], o) / n_bytes
        w = lambda k: np.bincount(text[k], minlength=b - a) / one
        solid = _counts(~T.SPACE[d], o)
        root = np.sqrt
        out[a:b] = np.stack(
            [np.log1p(m), np.log1p(solid / one), root(c(_UPPER)), root(c(_DIGIT)), root(c(_SYMBOL)), root(c(_STOP)), root(c(_COMMA)), root(c(_HIGH)), root(w(lengths == 1)), unique / one, root(w(same)), root(w(_UPPER[d[starts]])), np.log1p(size / (_counts(_LINE[d], o) + 1)), root(c(_BANG)), root(c(_BAR))],
            axis=1,
        )
        out[a:b][m == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    """Means, Cholesky factors' inverses and log determinants of both classes, and the log prior ratio."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        log_density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            log_density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + self.log_det[k]))
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + self.log_prior, -500, 500)))


def model_from_sums(sums: np.ndarray) -> Model:
    """sums: for each class 0 and 1 the row count, the sums and the outer products."""
    d = N_FEATURES
    n = sums[:, 0]
    first, second = sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d)
    total = max(n.sum(), 1)
    whole_mean = first.sum(0) / total
    means = np.stack([first[k] / n[k] if n[k] else whole_mean for k in (0, 1)])
    own = [second[k] / n[k] - np.outer(means[k], means[k]) if n[k] else np.zeros((d, d)) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / total
    whiten, log_det = [], []
    for k in (0, 1):
        cov = (1 - SHRINK_POOLED - SHRINK_DIAGONAL) * own[k] + SHRINK_POOLED * pooled + SHRINK_DIAGONAL * np.diag(np.diag(pooled)) if n[k] else pooled
        factor = np.linalg.cholesky(cov + RIDGE * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(means, np.stack(whiten), np.array(log_det), float(np.log((n[1] + 0.5) / (n[0] + 0.5))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics vector x of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*T.utf8(batch["text"]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_FEATURES)


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> Model:
    """The model of all rows of `vectors` that carry a label and aren't held out."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
        for batch in batches:
            x, y = _matrix(batch["x"]), np.asarray(batch["label"])
            for k in (0, 1):
                part = x[y == k]
                got[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k] * got.shape[1], pa.int32()), pa.array(np.arange(got.shape[1]), pa.int32()), pa.array(got[k])], ["label", "at", "v"])

    parts = rows.where(~held_out()).join(known, "doc_id").select("label", "x").mapInArrow(sums, "label int, at int, v double")
    got = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
    for r in parts.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        got[r["label"], r["at"]] = r["v"]
    return model_from_sums(got)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 for every row of `vectors`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(_matrix(batch["x"])))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores `threshold` or more."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(*T.utf8(batch.column(at)))) >= threshold))

    return docs.mapInArrow(run, schema)


def crc_held_out(doc_id: int) -> bool:
    """The same rule as held_out, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
