"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Every text becomes a vector of statistics (lengths, shares of kinds of characters, repetition, compressibility), each through
a logarithm or log-odds. Counts, sums and products per class are added up in Spark; from them come class means and covariances, shrunk
towards the pooled covariance and its diagonal. A score is the logistic of the difference of the classes' log densities, by Mahalanobis
distances with Cholesky factors that are computed once.

Null text counts as empty; empty texts are scored like any other. Without labels of both classes every score is the
share of label 1 among the labels, or 0.5 without any. Several labels of one document: the smallest counts. Repeated rows are rows of
their own. Columns of the input are kept; those named like a result are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mendline.llm.common import map_chunks, with_arrays

#: Weights of the pooled covariance, and then of its diagonal, in a class covariance.
TO_POOLED, TO_DIAGONAL = 0.3, 0.1
#: Bytes compressed at once.
STEP = 1 << 20

FEATURES = ("log_chars", "log_words", "word_length", "long_word", "short_word", "distinct_words", "top_word", "repeated_neighbour",
            "distinct_lines", "words_per_line", "words_per_stop", "upper", "digit", "other_ascii", "mark", "beyond_ascii",
            "entropy", "compressed", "top_trigram")
DIM = len(FEATURES)
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
MARK = np.array([chr(b) in ".,;:!?'\"-()" for b in range(256)])
OTHER = np.array([b < 128 for b in range(256)]) & ~ALNUM & ~BLANK & ~MARK


def odds(share: float) -> float:
    return float(np.log((share + 1e-3) / (1 - share + 1e-3)))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8")
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    share = codes / size
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    neighbours = sum(map(str.__eq__, words, words[1:]))
    trigrams = Counter(zip(words, words[1:], words[2:])).most_common(1) if len(words) > 2 else []
    packer, packed = zlib.compressobj(1), 0
    for start in range(0, len(raw), STEP):
        packed += len(packer.compress(raw[start:start + STEP]))
    packed += len(packer.flush())
    seen = share[share > 0]
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(lengths.mean() if len(words) else 0),
        odds((lengths > 12).sum() / n), odds((lengths < 4).sum() / n), odds(len(counts) / n),
        odds((counts.most_common(1)[0][1] - 1) / n if counts else 0), odds(neighbours / n), odds(len(set(lines)) / len(lines)),
        np.log1p(len(words) / len(lines)), np.log1p(len(words) / (1 + codes[46] + codes[33] + codes[63])),
        odds(share[UPPER].sum()), odds(share[DIGIT].sum()), odds(share[OTHER].sum()), odds(share[MARK].sum()),
        odds(share[128:].sum()), float(-(seen * np.log2(seen)).sum()), np.log(packed / size),
        odds((trigrams[0][1] - 1) / n if trigrams else 0),
    ]


def _without(df: DataFrame, name: str) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower() == name.lower()))


def with_statistics(df: DataFrame, out: str, *, text: str = "text") -> DataFrame:
    """The input with the statistics of its texts; a column of that name is replaced."""
    df = _without(df, out) if out.lower() != text.lower() else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def make():
        def step(batch, texts):
            yield with_arrays(batch, [out], [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))])

        return step

    return map_chunks(df, schema, make, text)


@dataclass
class Discriminant:
    """What scoring needs: per class the mean and the Cholesky factor's inverse, and the constant of the log odds."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        far = [np.square((x - m) @ w.T).sum(axis=1) for m, w in zip(self.means, self.whiten)]
        return 1 / (1 + np.exp(-np.clip(self.constant + (far[0] - far[1]) / 2, -700, 700)))


def fit(rows: DataFrame, *, vector: str = "x", label: str = "label") -> Discriminant:
    """From vectors with label 0 or 1; the sums are DIM * (DIM + 1) + 1 numbers a class, whatever the input."""

    def sums(batches):
        total = np.zeros((2, 1 + DIM + DIM * DIM))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        k, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(total.ravel())],
                                         names=["k", "i", "v"])

    known = rows.where(F.col(label).isin(0, 1) & F.col(vector).isNotNull()).select(vector, F.col(label).cast("int"))
    found = known.mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + DIM + DIM * DIM))
    for r in found:
        total[r.k, r.i] = r.v
    n = total[:, 0]
    if min(n) < 2:
        return Discriminant(None, None, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1:1 + DIM] / n[:, None]
    covs = [total[k, 1 + DIM:].reshape(DIM, DIM) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
    target = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * diagonal
    shrunk = [(1 - TO_POOLED) * c + TO_POOLED * target + 1e-6 * np.eye(DIM) for c in covs]
    factors = [np.linalg.cholesky(c) for c in shrunk]
    log_dets = [2 * np.log(np.diag(f)).sum() for f in factors]
    constant = float(np.log(n[1] / n[0]) + (log_dets[0] - log_dets[1]) / 2)
    return Discriminant(means, np.array([np.linalg.inv(f) for f in factors]), constant)


def score(df: DataFrame, model: Discriminant, *, vector: str = "x", out: str = "score") -> DataFrame:
    """The input with the score; a column of that name is replaced."""
    df = _without(df, out)

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            yield with_arrays(batch, [out], [pa.array(model.score(x))])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
