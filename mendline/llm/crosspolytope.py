"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables and exact reranking.

A vector's direction is turned by a pseudo-rotation (three times: random signs, then a fast Hadamard transform) and assigned to the
nearest of the signed axes. A table's key is the axes of `turns` rotations; there are `tables` tables. A query probes, in each table, the
keys nearest to its own rotated direction, in order of the sum of squared gaps to its largest coordinates. Rows found in a probed
bucket are scored in double precision on the original vectors.

Length counts for inner products, so rows are first grouped into bands of lengths within a factor 2^(1/2) of one another; the tables
are those of a band, and a query probes every band. There are at most some 4,200 bands, for that is the range of doubles.

Index and probes are fitted as follows. `turns` follows from the number of rows, so that a bucket holds about BUCKET rows at most. The
number of probes is the least with which the `target` recall is reached for a sample of at most SAMPLE queries (those of the
smallest hash), whose true neighbours are found by a scan of all rows, in blocks. If MOST_PROBES do not reach it, one rotation less is used;
with a single rotation all buckets of a table can be probed, which finds every row. So no cap stands between a query and the target.

Buckets are cut into tiles of bounded size and a bucket's queries into blocks; each tile meets each block in a row of its own, dealt
by (bucket, tile, group of blocks), so neither a hot bucket nor its queries meet in one task. Near probes run first and give each query a bound; the
others return only what reaches it. Equal vectors: only the k + 1 smallest ids of a vector can be in an answer, and equal queries are
searched once.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Shorter vectors go on with zeros. An
id names one vector: of rows that repeat it the least vector counts. Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mendline.llm.topk import usable
from mendline.llm.vectors import first_copies, first_of_each, log_length, one_per_id, same_width, to_matrix
from mendline.sources.io import stored

#: Rows of a bucket at most, about, when the number of rotations is chosen.
BUCKET = 4096
#: Candidates of a tile, queries of a block, and blocks that meet a copy of a tile.
TILE, BLOCK, GROUP = 1024, 512, 16
#: Queries by which the number of probes is fitted, and the share of their true neighbours that must be found.
SAMPLE, TARGET = 256, 0.95
#: Probes of a table at most with more than one rotation.
MOST_PROBES = 1024
#: One in so many probes of a table runs first, for a bound.
FIRST = 4
#: Sums or products held at once.
STEP = 1 << 22


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two. Lengths stay."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


@dataclass(frozen=True)
class Index:
    """Pseudo-rotations of vectors of at most `dim` components: `turns` for each of `tables` tables, drawn from `seed`."""

    dim: int
    tables: int
    turns: int
    seed: int = 1

    @property
    def width(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    def rotated(self, rows: np.ndarray):
        """(table, rotated unit vectors as rows x turns x signed axes), table by table."""
        signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, self.turns, 3, self.width))
        rows = np.pad(rows, ((0, 0), (0, self.width - rows.shape[1])))
        rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
        rows = rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))
        for table in range(self.tables):
            turned = []
            for turn in range(self.turns):
                x = rows
                for flip in signs[table, turn]:
                    x = hadamard(x * flip)
                turned.append(np.concatenate([x, -x], axis=1))
            yield table, np.stack(turned, axis=1)

    def key(self, table: int, axes: np.ndarray) -> np.ndarray:
        """One number for the table and the axes, the last dimension of the array."""
        out = np.full(axes.shape[:-1], table, np.int64)
        for turn in range(axes.shape[-1]):
            out = out * (2 * self.width) + axes[..., turn]
        return out

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        return np.stack([self.key(t, x.argmax(axis=2)) for t, x in self.rotated(rows)], axis=1)

    def probes(self, rows: np.ndarray, n: int) -> np.ndarray:
        """rows x tables x (up to n) buckets, nearest first."""
        at_once = max(1, STEP // (n * 2 * self.width if self.turns > 1 else 2 * self.width))
        return np.concatenate([self._probes(rows[i:i + at_once], n) for i in range(0, len(rows), at_once)])

    def _probes(self, rows: np.ndarray, n: int) -> np.ndarray:
        # The best n sums of a few lists need only the best n of each.
        out = []
        for table, x in self.rotated(rows):
            gap = np.square(x.max(axis=2, keepdims=True) - x)
            cost, axes = np.zeros((len(rows), 1)), np.zeros((len(rows), 1, 0), np.int64)
            for turn in range(self.turns):
                best = np.argsort(gap[:, turn], axis=1, kind="stable")[:, :n]
                total = (cost[:, :, None] + np.take_along_axis(gap[:, turn], best, 1)[:, None, :]).reshape(len(rows), -1)
                order = np.argsort(total, axis=1, kind="stable")[:, :n]
                before, here = order // best.shape[1], order % best.shape[1]
                cost = np.take_along_axis(total, order, 1)
                axes = np.concatenate([np.take_along_axis(axes, before[:, :, None], 1),
                                       np.take_along_axis(best, here, 1)[:, :, None]], axis=2)
            out.append(self.key(table, axes))
        return np.stack(out, axis=1)


def best_rows(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int):
    """(query, row, product) of each query's k best rows that reach its bound, as arrays, best first.

    A matrix product finds who may be among them. The products returned are summed in order of the components, so that equal vectors have
    equal products wherever they lie."""
    near = queries @ rows.T
    floor = bounds
    if near.shape[1] > k:
        floor = np.maximum(floor, -np.partition(-near, k - 1, axis=1)[:, k - 1])
    slack = 1e-9 * np.abs(queries).sum(axis=1) * np.abs(rows).max(initial=0)
    q, r = np.nonzero(near >= (floor - slack)[:, None])
    at_once = max(1, STEP // max(1, rows.shape[1]))
    parts = [np.cumsum(rows[r[i:i + at_once]] * queries[q[i:i + at_once]], axis=1)[:, -1] for i in range(0, len(q), at_once)]
    scores = np.concatenate(parts) if parts else np.empty(0)
    fine = scores >= bounds[q]
    q, r, scores = q[fine], r[fine], scores[fine]
    order = np.lexsort((ids[r], -scores, q))
    order = order[first_of_each(q[order], k)]
    return q[order], r[order], scores[order]


def _kept(found: DataFrame, by: str, k: int) -> DataFrame:
    """Each query's k best of what its probes found, copies of a find merged."""
    once = found.groupBy(by, "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _true_neighbours(rows: DataFrame, sample: np.ndarray, index: Index, k: int) -> list:
    """(query, id and buckets of a true neighbour) for a bounded number of queries: one scan, k candidates a task and query."""
    shared = rows.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE vectors

    def scan(batches):
        queries = shared.value
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty((0, index.tables), np.int64))
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), to_matrix(batch.column(1), np.float64)
            q, r, scores = best_rows(*same_width(queries, vecs), ids, np.full(len(queries), -np.inf), k)
            keys = index.keys(vecs)
            best = tuple(map(np.concatenate, zip(best, (q, ids[r], scores, keys[r]))))
            order = np.lexsort((best[1], -best[2], best[0]))
            order = order[first_of_each(best[0][order], k)]
            best = tuple(x[order] for x in best)
        yield pa.RecordBatch.from_arrays([*map(pa.array, best[:3]), pa.array(best[3].tolist(), pa.list_(pa.int64()))],
                                         names=["q", "id", "score", "keys"])

    found = rows.select("id", "vec").mapInArrow(scan, "q long, id long, score double, keys array<long>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "id", "keys").collect()  # at most SAMPLE x k rows


def fitted(rows: DataFrame, queries: DataFrame, dim: int, n: int, *, tables: int, k: int, target: float = TARGET) -> tuple[Index, int]:
    """The index and the number of probes by which the sample's recall of k neighbours reaches the target."""
    taken = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "vec").toArrow()
    own, sample = taken.column("id").to_numpy(), to_matrix(taken.column("vec"), np.float64)
    turns = 1
    while n > BUCKET * (2 * Index(dim, 1, 1).width) ** turns:
        turns += 1
    while True:
        index = Index(dim, tables, turns)
        most = 2 * index.width if turns == 1 else MOST_PROBES
        true = [r for r in _true_neighbours(rows, sample, index, k + 1) if r.id != own[r.q]]
        places = [{b: i for i, b in enumerate(t)} for row in index.probes(sample, most).tolist() for t in row]
        ranks = np.array([min(places[r.q * tables + t].get(b, most) for t, b in enumerate(r["keys"])) for r in true], np.int64)
        reached = np.searchsorted(np.sort(ranks), np.arange(1, most + 1)) / max(1, len(ranks))
        enough = np.flatnonzero(reached >= target)
        if len(enough) or not len(ranks):
            return index, int(enough[0]) + 1 if len(enough) else 1
        turns -= 1


def _packs(rows: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: ids, vectors and further numbers as bytes."""
    types = dict(rows.dtypes)
    dtype = np.float32 if types["vec"] == "array<float>" else np.float64

    def pack(key, table):
        vecs = to_matrix(table.column("vec"), dtype)
        columns = [table.column("id").to_numpy().astype(np.int64), vecs, *(table.column(c).to_numpy().astype(np.float64) for c in more)]
        return pa.Table.from_arrays(
            [*(pa.array([k.as_py()], k.type) for k in key), pa.array([vecs.shape[1]], pa.int32()), *(pa.array([c.tobytes()]) for c in columns)],
            names=[*keys, "dim", "ids", "vecs", *more])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "dim int, ids binary, vecs binary", *(f"{c} binary" for c in more)])
    return rows.groupBy(*keys).applyInArrow(pack, schema)


def _meet(tiles: DataFrame, probes: DataFrame, vectors: DataFrame, sizes: DataFrame, k: int, dtype) -> DataFrame:
    """Scores of the probes (id, bound, band, bucket) in their buckets: each query's k best a tile."""
    bucket = ["band", "bucket"]
    meets = stored(probes.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(sizes, bucket), "meets")
    laid = probes.join(vectors, "id").join(meets, bucket).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = _packs(laid.select(*bucket, "tiles", "block", "id", "vec", "bound"), [*bucket, "tiles", "block"], ("bound",))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = tiles.join(meets.withColumn("tile", every(F.col("tiles"))), [*bucket, "tile"]).withColumn(
        "group", every(F.ceil(F.col("blocks") / GROUP).cast("int")))
    right = blocks.withColumn("tile", every(F.col("tiles"))).withColumn("group", F.floor(F.col("block") / GROUP).cast("int"))
    where = [*bucket, "tile", "group"]
    side = lambda df, name, *more: df.select(*where, *[F.col(c).alias(f"{name}_{c}") for c in ("dim", "ids", "vecs", *more)])
    pairs = side(left, "c").join(side(right, "q", "bound"), where).drop(*where)

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, qids = (np.frombuffer(row[f"{s}_ids"], np.int64) for s in "cq")
                rows, queries = same_width(*(np.frombuffer(row[f"{s}_vecs"], dtype).reshape(-1, row[f"{s}_dim"]).astype(np.float64) for s in "cq"))
                q, r, scores = best_rows(queries, rows, ids, np.frombuffer(row["q_bound"], np.float64), k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[r]), pa.array(scores)], names=["query", "id", "score"])

    return pairs.mapInArrow(score, "query long, id long, score double")


def nearest(df: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", tables: int = 4,
            target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k rows with the largest inner products that the probes of each query find."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    good = df.where(usable(F.col(vector)) & F.col(id_col).isNotNull() & F.exists(vector, lambda x: x != 0))
    rows = one_per_id(good.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec"),
                                  F.coalesce(is_query, F.lit(False)).alias("asks")), "vec", "asks")
    rows = stored(rows.withColumn("band", F.floor(2 * log_length(F.col("vec")) + 0.5).cast("int")), "vectors")
    kept = stored(first_copies(rows.drop("asks"), ["vec"], k + 1), "vectors-kept")
    asking = rows.where("asks").select("id", "vec")
    queries = stored(asking.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "queries")
    n, dim = kept.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n or queries.isEmpty():
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, n_probes = fitted(kept, queries, dim, n, tables=tables, k=k, target=target)
    bands = [r[0] for r in kept.select("band").distinct().collect()]  # at most 4,200

    def shelve(batches):
        for batch in batches:
            keys = index.keys(to_matrix(batch.column(1), np.float64))
            each = batch.take(pa.array(np.repeat(np.arange(len(keys)), index.tables)))
            yield pa.RecordBatch.from_arrays([*each.columns, pa.array(keys.ravel())], names=["id", "vec", "band", "bucket"])

    def probe(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys = index.probes(to_matrix(part.column(1), np.float64), n_probes)
                place = np.broadcast_to(np.arange(keys.shape[2], dtype=np.int32), keys.shape)
                ids = np.repeat(part.column(0).to_numpy(), keys[0].size)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel()), pa.array(place.ravel())], names=["id", "bucket", "place"])

    bucket = ["band", "bucket"]
    shelved = kept.select("id", "vec", "band").mapInArrow(shelve, f"id long, vec {kind}, band int, bucket long")
    sizes = stored(shelved.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "bucket-sizes")
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    tiles = stored(_packs(shelved.join(sizes, bucket).select("id", "vec", *bucket, tile.alias("tile")), [*bucket, "tile"]), "tiles")
    probes = queries.mapInArrow(probe, "id long, bucket long, place int").withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    probes = stored(probes.join(sizes, bucket, "left_semi"), "probes")

    dtype = np.float32 if kind == "array<float>" else np.float64
    near = max(1, n_probes // FIRST)
    none = F.lit(float("-inf"))
    first = stored(_kept(_meet(tiles, probes.where(F.col("place") < near).withColumn("bound", none), queries, sizes, k + 1, dtype),
                         "query", k + 1), "first-finds")
    bounds = first.groupBy(F.col("query").alias("id")).agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("bound"))
    rest = probes.where(F.col("place") >= near).join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", none))
    found = first.select("query", "id", "score").unionByName(_meet(tiles, rest, queries, sizes, k + 1, dtype))
    # The k + 1 best of a vector, then for each of its queries the k best that are not its own row.
    best = _kept(found, "query", k + 1).drop("rank")
    groups = asking.join(queries.withColumnRenamed("id", "query"), "vec").select(F.col("id").alias("query_id"), "query")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (groups.join(best, "query").where("id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
