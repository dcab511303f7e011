"""Language identification as a mixture of languages.

Each known language has a distribution over hashed letter trigrams, counted over all texts learnt from. A document's
proportions of the languages come from expectation-maximisation over its trigrams; then languages are taken in order of
proportion, and the set whose likelihood less a penalty for each language is best is the document's language set.

The model is languages x BINS numbers: its size depends on the number of language labels, not on the corpus.

Null texts and texts without a letter are `und` with score 0, and so is everything if there is nothing to learn from. Ties go to the language
that comes first by name. Repeated rows are rows of their own. Columns of the input are kept; those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mendline.llm.common import map_chunks, with_arrays

BINS = 1 << 15
#: Count added to each bin of a language.
SMOOTHING = 0.05
#: Price of each language of a set, in log-likelihood, times the logarithm of the number of trigrams.
PENALTY = 2.0
ROUNDS = 30
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: ASCII characters other than letters become spaces.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Bytes hashed at once.
STEP = 1 << 22

RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("lang_set", T.ArrayType(T.StringType()))]


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of the lower-case text, those across a word gap left out."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8").translate(PLAIN) + b" ", np.uint8)
    counts = np.zeros(BINS, np.int64)
    for start in range(0, len(raw) - 2, STEP):
        x = raw[start:start + STEP + 2].astype(np.uint32)
        key = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[x[1:-1] != 32]
        counts += np.bincount((key * np.uint32(2654435761)) >> np.uint32(17), minlength=BINS)
    return counts


def learn(df: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names, sorted, and for each its probabilities of the bins. Rows without text or language teach nothing."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[name] = sums.get(name, 0) + trigrams(row.as_py())
        for name, counts in sums.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(bins)), pa.array(bins, pa.int32()), pa.array(counts[bins], pa.int64())], names=["lang", "bin", "n"])

    counted = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    names = sorted(found["lang"].unique())
    counts = np.full((len(names), BINS), SMOOTHING)
    counts[np.searchsorted(names, found["lang"].to_numpy()) if names else [], found["bin"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    return names, counts / counts.sum(axis=1, keepdims=True)


def proportions(chance: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: the mixture's proportions and its log-likelihood."""
    share = np.full(len(chance), 1 / len(chance))
    total = counts.sum()
    if len(chance) > 1:
        for _ in range(ROUNDS):
            new = share * (chance @ (counts / (share @ chance))) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-3:
                break
    return share, float(counts @ np.log(share @ chance))


def infer(counts: np.ndarray, chances: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of the best set, largest proportion first, and all languages' proportions."""
    bins = np.flatnonzero(counts)
    n, chance = counts[bins].astype(np.float64), chances[:, bins]
    share, _ = proportions(chance, n)
    order = np.argsort(-share, kind="stable")
    price = PENALTY * np.log(n.sum() + 1)
    best, best_set = -np.inf, []
    for size in range(1, len(order) + 1):
        part, fit = proportions(chance[order[:size]], n)
        if fit - size * price <= best:
            break
        best, best_set = fit - size * price, order[:size][np.argsort(-part, kind="stable")].tolist()
    return best_set, share


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text") -> DataFrame:
    """Add lang_pred, its proportion as score, and lang_set."""
    names, chances = model
    results = [f.name for f in RESULT]
    df = df.drop(*(c for c in df.columns if c.lower() in results and c != text))
    shared = df.sparkSession.sparkContext.broadcast(chances)  # languages x BINS numbers

    def one(value: str | None):
        if value is None or not names or not LETTER.search(value):
            return UNKNOWN, 0.0, []
        counts = trigrams(value)
        if not counts.any():
            return UNKNOWN, 0.0, []
        found, share = infer(counts, shared.value)
        return names[found[0]], min(1.0, float(share[found[0]])), [names[i] for i in found]

    def make():
        def step(batch, texts):
            preds, scores, sets = zip(*map(one, texts))
            yield with_arrays(batch, results, [pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                                               pa.array(sets, pa.list_(pa.string()))])

        return step

    return map_chunks(df, T.StructType([*df.schema.fields, *RESULT]), make, text)


def learn_and_identify(df: DataFrame, held_out: Column, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, then identify all. `lang` is read for learning alone."""
    return identify(df, learn(df.where(~held_out), text=text, lang=lang), text=text)
