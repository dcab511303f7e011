"""Ranked lexical search: exact inner products of sparse vectors by best-first search of ball trees.

A document is the sparse vector of its terms' weights, an item that of its terms' counts; the score is their inner product. Tasks take
documents by the few thousand and build a ball tree over each lot: a node is split along the line between two of its documents
that are far apart, down to leaves of a few documents. A node knows its centroid, its radius, and its reach: how far along each axis any
of its documents lies above the centroid. No document below the node scores more than

    item . centroid + |item| x radius        nor more than        item . (centroid + reach),

and the lesser, widened by more than rounding can amount to, is the node's bound. The radius alone says little where documents
have hundreds of terms and items few, which is why the reach stands beside it. Nodes are visited in order of their bounds and left out, with all
below them, once the bound is less than the score of the item's last of the best so far. Scores at the leaves are exact integers. A task's
best carry over from one tree to the next, and it returns no more than `k` rows an item.

Items are dealt into blocks of about TERMS distinct terms, and each block meets all documents; documents keep only the terms of the block, which is
all that its scores depend on. What is sent to every task is one block and its terms' weights.

The text's terms are the runs of ASCII letters and digits and of all signs beyond ASCII, A-Z lower-cased. Null text has none. Documents without
identifier are ranked after others of equal score. Repeated documents are ranked each on its own, and so are repeated items. Items without terms
give no rows, nor does an empty table. Extra columns are dropped.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mendline.llm.common import map_chunks
from mendline.sources.io import stored

#: Distinct terms of a block of items, about.
TERMS = 16_384
#: Documents of a leaf at most, and numbers that all centroids of a tree hold together.
LEAF, CELLS = 8, 1 << 22
#: Bytes of a text that are cut into terms at once.
STEP = 1 << 20
#: What bounds are widened by; sums of products err by less than 1e-11 of their size.
WIDER, SPREAD = 1e-9, 1e-10

#: The ASCII signs that belong to terms; all others but A-Z, which are lower-cased, separate.
_SIGNS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytes(c if c >= 128 or c in _SIGNS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def count_terms(text: str | None, known=None) -> tuple[Counter, int]:
    """How often each term occurs, and how many there are; with `known` by its numbers, and others under None."""
    data = (text or "").encode("utf-8").translate(_TERM_BYTES)
    counts, total, start = Counter(), 0, 0
    while start < len(data):
        end = data.find(b" ", start + STEP)
        words = data[start:len(data) if end < 0 else end].split()
        total += len(words)
        counts.update(words if known is None else map(known.get, words))
        start = len(data) if end < 0 else end + 1
    return counts, total


class Tree:
    """A ball tree over sparse rows: (columns, values) of each."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        sizes = np.array([len(c) for c in columns], np.int64)
        cols, vals = np.concatenate(columns), np.concatenate(values)
        starts = np.r_[0, np.cumsum(sizes)]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        floats = vals.astype(np.float64)
        square = np.bincount(rows, floats * floats, len(sizes))
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        centroids, radii, order = [], [], np.arange(len(sizes))

        def dots(some, vector):
            """Products of some rows with a dense vector."""
            pick = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
            return np.bincount(np.repeat(np.arange(len(some)), sizes[some]), floats[pick] * vector[cols[pick]], len(some)), pick

        def build(start, end):
            node, some = len(self.spans), order[start:end]
            self.spans.append((start, end))
            self.children.append(None)
            pick = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
            centroid = np.bincount(cols[pick], floats[pick], width) / len(some)
            mean_square = float(centroid @ centroid)
            away = square[some] - 2 * dots(some, centroid)[0] + mean_square
            centroids.append(centroid)
            radii.append(math.sqrt(max(0.0, away.max()) + SPREAD * (square[some].max() + mean_square)))
            if end - start > LEAF:
                far = lambda i: square[some] - 2 * dots(some, _dense(cols, floats, starts, i, width))[0]
                one = some[int(away.argmax())]
                to_one = far(one)
                other = some[int(to_one.argmax())]
                order[start:end] = some[np.argsort(to_one - far(other), kind="stable")]
                middle = (start + end) // 2
                self.children[node] = (build(start, middle), build(middle, end))
            return node

        build(0, len(sizes))
        self.order = order
        # Rows in order of the leaves, and what each node's documents reach on each axis, from the leaves upwards.
        pick = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
        self.cols, self.vals = cols[pick], vals[pick]
        self.starts = np.r_[0, np.cumsum(sizes[order])]
        self.centroids, self.radii = np.array(centroids), np.array(radii)
        self.top = np.zeros(self.centroids.shape)
        for node in range(len(self.spans) - 1, -1, -1):
            if self.children[node] is None:
                start, end = self.spans[node]
                part = slice(self.starts[start], self.starts[end])
                np.maximum.at(self.top[node], self.cols[part], self.vals[part].astype(np.float64))
            else:
                left, right = self.children[node]
                np.maximum(self.top[left], self.top[right], out=self.top[node])

    def bounds(self, items: np.ndarray) -> np.ndarray:
        """No document below a node scores more: items x nodes."""
        ball = items @ self.centroids.T + np.sqrt(np.square(items).sum(axis=1))[:, None] * self.radii[None, :]
        return np.minimum(ball, items @ self.top.T) * (1 + WIDER) + 1

    def scores(self, node: int, item: np.ndarray) -> np.ndarray:
        """Exact integer scores of a leaf's documents, none of which is without terms."""
        start, end = self.spans[node]
        at = self.starts[start:end + 1]
        return np.add.reduceat(self.vals[at[0]:at[-1]] * item[self.cols[at[0]:at[-1]]], at[:-1] - at[0])


def _dense(cols, vals, starts, i: int, width: int) -> np.ndarray:
    out = np.zeros(width)
    out[cols[starts[i]:starts[i + 1]]] = vals[starts[i]:starts[i + 1]]
    return out


def search(tree: Tree, ids: list, items: np.ndarray, best: list[list[tuple]], k: int) -> int:
    """Bring each item's best, sorted tuples (-score, no id, id), up to date with the tree's documents; returns the leaves visited."""
    bounds, visited = tree.bounds(items.astype(np.float64)), 0
    for item, found, bound in zip(items, best, bounds):
        queue = [(-bound[0], 0)]
        while queue:
            most, node = heapq.heappop(queue)
            if len(found) == k and -most < -found[-1][0]:
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    heapq.heappush(queue, (-bound[child], child))
                continue
            visited += 1
            scores = tree.scores(node, item)
            least = max(1, -found[-1][0]) if len(found) == k else 1
            for i in np.flatnonzero(scores >= least).tolist():
                doc = ids[tree.order[tree.spans[node][0] + i]]
                bisect.insort(found, (-int(scores[i]), doc is None, doc or 0))
                del found[k:]
    return visited


def _terms_of(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """Items that have terms, with their counts."""

    def make():
        def step(batch, texts):
            counted = [count_terms(t)[0] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[(w.decode("utf-8"), n) for w, n in sorted(c.items())] for c in counted],
                                           pa.map_(pa.string(), pa.int64()))], names=["item", "terms"])

        return step

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text).alias("text"))
    return map_chunks(rows, "item long, terms map<string,long>", make).where(F.size("terms") > 0)


def _counted(docs: DataFrame, known: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """Per document with terms: how many, and the counts of those known."""

    def make():
        def step(batch, texts):
            out = [], [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), texts):
                counts, n = count_terms(t, known)
                counts.pop(None, None)
                if n:
                    for column, value in zip(out, (doc, n, list(counts), list(counts.values()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())),
                 pa.array(out[3], pa.list_(pa.int64()))], names=["doc", "n", "terms", "tf"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    return map_chunks(rows, "doc long, n long, terms array<int>, tf array<long>", make)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest scores above 0."""
    spark = docs.sparkSession
    asked = stored(_terms_of(items, item_id, item_text), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item", F.map_entries("terms")), F.lit(blocks)) == block)
        out = out.unionByName(_ranked_for(docs, part.collect(), k, id_col, text))  # about TERMS terms
    return out


def _ranked_for(docs: DataFrame, items: list, k: int, id_col: str, text: str) -> DataFrame:
    """`rank_documents` for a block of items."""
    spark = docs.sparkSession
    if not items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    known = {w.encode("utf-8"): i for i, w in enumerate(sorted({w for item in items for w in item["terms"]}))}
    counted = stored(_counted(docs, known, id_col, text), "counted")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a block's terms at most
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(known))], np.int64)
    asked = np.zeros((len(items), len(known)), np.int64)
    for row, item in zip(asked, items):
        for word, n in item["terms"].items():
            row[known[word.encode("utf-8")]] = n
    shared = spark.sparkContext.broadcast((asked, weights, [item["item"] for item in items]))  # one block

    def ranked(batches):
        asked, weights, names = shared.value
        width = len(weights)
        lot = max(2 * LEAF, CELLS // width * LEAF // 2)
        best: list[list[tuple]] = [[] for _ in names]
        ids, columns, values = [], [], []

        def finish():
            if ids:
                search(Tree(columns, values, width), ids, asked, best, k)
            for held in (ids, columns, values):
                held.clear()

        for batch in batches:
            terms, tfs = batch.column(2), batch.column(3)
            for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                which = terms[i].values.to_numpy()
                tf = tfs[i].values.to_numpy()
                weight = weights[which] * ((1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 75 + 75 * n * n_docs // n_terms)))
                if weight.any():
                    ids.append(doc)
                    columns.append(which)
                    values.append(weight)
                if len(ids) == lot:
                    finish()
        finish()
        found = [(i, names[i], None if none else doc, -score) for i, b in enumerate(best) for score, none, doc in b]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*found) if found else [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["row", "item_id", "doc_id", "score"])

    found = counted.where(F.size("terms") > 0).mapInArrow(ranked, "row int, item_id long, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
