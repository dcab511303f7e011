"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets; a bucket is cut into tiles of bounded size, sorted by length. Queries go in blocks. A first
pass verifies each query against the tile of longest vectors, which gives a lower bound of its k-th best product. With that bound, a
bucket of longest vector l can hold a better product for query q only at a cosine above bound / (|q| l): the local threshold. If
it is above 1 the pair is skipped; if it is low, the tile is pruned by length (vectors shorter than bound / |q| are left out); if
it is high, by coordinates: for the query's largest coordinates, a unit vector with that cosine must lie within a feasible
range. Products of what is left are computed in full, in exact integers.

Queries of like bound / |q| share a block, and a block meets only the tiles that hold a vector of that length: the pairs are found on
the lengths alone, so no packs are sent to be skipped. Each pair is worked on by itself; it returns at most k candidates a query, and a window keeps
the k best. Queries are a stated set of rows, so this is a block join and no join of all pairs.

Vectors that are null, empty, or hold null or non-finite components take no part, as candidates or queries. Vectors of different
dimension are compared as if the shorter one went on with zeros. Ties go to the smaller identifier; rows that repeat an
identifier are candidates and queries each on its own, the answers of a query identifier being the best of all its rows', but no row
answers a query of its own identifier. Null identifiers take no part. Extra columns
are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mendline.sources.io import stored

#: Candidates of a tile and queries of a block at most, about.
TILE, BLOCK = 4096, 512
#: Buckets by length. Their bounds are quantiles, so the buckets are about equal.
BUCKETS = 32
#: From this local threshold on, coordinates prune; below, lengths do.
HIGH = 0.7
#: Coordinates of a query that prune.
FOCUS = 4

#: Bands of queries, at most, by the length that a vector must have to be of use. Their bounds are quantiles, and none is smaller than a block.
BANDS = 32

PACK = "dim int, n int, ids binary, vecs binary, longest double"


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def pack_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers, and vectors as rows filled up with zeros."""
    lists = table.column("vec").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return table.column("id").to_numpy(), out


def packs(rows: DataFrame, keys: list[str], bounds: bool = False) -> DataFrame:
    """One row per group of (id, vec) rows, longest vectors first; with `bounds`, those of the rows and the least of their needs as well."""
    types = dict(rows.dtypes)

    def pack(key, table):
        ids, vecs = pack_rows(table)
        lengths = np.sqrt(np.square(vecs.astype(np.float64)).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        data = [pa.array([k.as_py()], k.type) for k in key]
        data += [pa.array([vecs.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()),
                 pa.array([ids[order].astype(np.int64).tobytes()]), pa.array([vecs[order].tobytes()]), pa.array([float(lengths.max())])]
        if bounds:
            known = table.column("bound").to_numpy()
            data += [pa.array([known[order].astype(np.float64).tobytes()]), pa.array([float(table.column("need").to_numpy().min())])]
        return pa.Table.from_arrays(data, names=names)

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + PACK + (", bounds binary, need double" if bounds else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return rows.groupBy(*keys).applyInArrow(pack, schema)


def matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(row[f"{side}_ids"], np.int64),
            np.frombuffer(row[f"{side}_vecs"], np.int64).reshape(row[f"{side}_n"], row[f"{side}_dim"]))


def feasible(query: np.ndarray, units: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors can have the cosine with the query, judged by its largest coordinates one by one."""
    q = query / np.linalg.norm(query)
    out = np.ones(len(units), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        # cos <= q_f u_f + sqrt(1 - q_f^2) sqrt(1 - u_f^2)
        u = units[:, f]
        out &= q[f] * u + np.sqrt(max(0.0, 1 - q[f] ** 2)) * np.sqrt(np.maximum(0.0, 1 - u * u)) >= cosine - 1e-9
    return out


def best_of_tile(qids, queries, ids, vecs, bounds, k: int):
    """(query, id, score) of up to k candidates a query that reach its bound. bounds: float, -inf where unknown."""
    dim = max(queries.shape[1], vecs.shape[1])
    queries, vecs = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (queries, vecs))
    lengths = np.sqrt(np.square(vecs.astype(np.float64)).sum(axis=1))  # falling
    query_lengths = np.sqrt(np.square(queries.astype(np.float64)).sum(axis=1))
    # Products of doubles are exact below 2^53; beyond, integers do it.
    small = float(np.abs(queries).max(initial=0)) * float(np.abs(vecs).max(initial=0)) * dim < 2**53
    exact = (lambda a, b: (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)) if small else (lambda a, b: a @ b.T)
    units = None
    out = []

    def keep(q, index, scores):
        own = ids[index] == qids[q]
        index, scores = index[~own], scores[~own]
        reach = scores >= bounds[q]
        index, scores = index[reach], scores[reach]
        if len(scores) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            index, scores = index[scores >= kth], scores[scores >= kth]
        order = np.lexsort((ids[index], -scores))[:k]
        out.extend((int(qids[q]), int(ids[index[i]]), int(scores[i])) for i in order)

    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bounds > 0, bounds / (query_lengths * lengths[0]), -1.0)
    wide = np.flatnonzero(local < HIGH)
    if len(wide):
        # Length pruning: the prefix of vectors long enough for the least demanding query, for the whole block at once.
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(bounds[wide] > 0, bounds[wide] / query_lengths[wide], -1.0).min()
        n = int(np.searchsorted(-lengths, -least * (1 - 1e-9), side="right")) if least > 0 else len(ids)
        scores = exact(queries[wide], vecs[:n])
        index = np.arange(n)
        for row, q in enumerate(wide):
            keep(q, index, scores[row])
    for q in np.flatnonzero((local >= HIGH) & (local <= 1 + 1e-9)):
        if units is None:
            units = vecs / np.maximum(lengths, 1e-300)[:, None]
        n = int(np.searchsorted(-lengths, -(bounds[q] / query_lengths[q]) * (1 - 1e-9), side="right"))
        index = np.flatnonzero(feasible(queries[q].astype(np.float64), units[:n], local[q]))
        keep(q, index, exact(queries[q:q + 1], vecs[index])[0])
    return out


FOUND = "query_id long, vec_id long, score long"


def _search(pairs: DataFrame, k: int, tile: dict | None = None) -> DataFrame:
    """pairs: packs q_* and c_*, or q_* with one tile for all, and perhaps `bounds`, doubles for the queries as binary."""
    shared = pairs.sparkSession.sparkContext.broadcast(tile or {})  # one tile of bounded size

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0] | shared.value
                qids, queries = matrix(row, "q")
                ids, vecs = matrix(row, "c")
                bounds = np.full(len(qids), -np.inf) if row.get("bounds") is None else np.frombuffer(row["bounds"], np.float64)
                found = best_of_tile(qids, queries, ids, vecs, bounds, k)
                cols = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, FOUND)


def _side(df: DataFrame, side: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in ("dim", "n", "ids", "vecs")]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _grouped(rows: DataFrame, value: str, groups: int, most: int, names: tuple[str, str]) -> tuple[DataFrame, int]:
    """Number the rows' groups by quantiles of `value`, and parts of about `most` rows within a group. Many rows may have one value or one
    identifier, so parts go by the row's own number. Also how many groups there are."""
    group, part = names
    marks = sorted(set(rows.approxQuantile(value, [i / groups for i in range(1, groups)], 0.005))) if groups > 1 else []
    numbered = rows.withColumn(group, sum((F.when(F.col(value) > m, 1).otherwise(0) for m in marks), F.lit(0)).cast("int"))
    sizes = stored(numbered.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")), f"{group}-sizes")
    # At most `groups` rows.
    return (numbered.join(F.broadcast(sizes), group).withColumn(part, F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int")).drop("_parts"),
            len(marks) + 1)


def _shipped(queries: DataFrame, tiles: DataFrame, buckets: int) -> DataFrame:
    """(band, block, bucket, tile) of all pairs in which a vector may be long enough for a query: found on numbers alone, before
    any pack moves."""
    reach = lambda longest: F.col("need") <= F.col(longest) * (1 + 1e-9)
    tops = F.broadcast(tiles.groupBy("bucket").agg(F.max("longest").alias("top"), F.max("tile").alias("last")))  # a row per bucket
    return (queries.select("band", "block", "need", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
            .join(tops, "bucket").where(reach("top"))
            .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("last"))))
            .join(tiles.select("bucket", "tile", "longest"), ["bucket", "tile"]).where(reach("longest"))
            .select("band", "block", "bucket", "tile"))


def top_k(df: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
          scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products of the scaled, floored vectors."""
    good = df.where(usable(F.col(vector)) & F.col(id_col).isNotNull())
    rows = stored(good.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vec"),
                              F.coalesce(is_query, F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row"))
                  .withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), "vectors")
    asked = rows.where("query")
    n_asked = asked.count()
    if not n_asked:
        return spark_empty(df)
    laid, buckets = _grouped(rows, "norm", BUCKETS, TILE, ("bucket", "tile"))
    tiles = stored(packs(laid.select("id", "vec", "bucket", "tile"), ["bucket", "tile"]), "tiles")
    # Bounds: all queries against one tile of the longest vectors.
    first_blocks = packs(asked.select("id", "vec", F.pmod(F.xxhash64("row"), F.lit(-(-n_asked // BLOCK))).cast("int").alias("block")), ["block"])
    longest = tiles.orderBy(F.desc("bucket"), "tile").select(*_side(tiles, "c")).first()
    first = _best(_search(first_blocks.select(*_side(first_blocks, "q")), k, longest.asDict()), k)
    kth = (first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").cast("double").alias("bound"))
           .where(F.col("_n") == k).select(F.col("query_id").alias("id"), "bound"))
    # A vector shorter than bound / |q| is of no use to a query; queries of like need are in one block.
    useful = (F.col("bound") > 0) & (F.col("norm") > 0)
    needs = stored(asked.join(kth, "id", "left").select(
        "id", "vec", "row", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"),
        F.when(useful, F.col("bound") / F.sqrt("norm")).otherwise(-1.0).alias("need")), "needs")
    banded, _ = _grouped(needs, "need", min(BANDS, -(-n_asked // BLOCK)), BLOCK, ("band", "block"))
    queries = stored(packs(banded.select("id", "vec", "bound", "need", "band", "block"), ["band", "block"], bounds=True), "queries")
    pairs = (_shipped(queries, tiles, buckets)
             .join(queries.select("band", "block", "bounds", *_side(queries, "q")), ["band", "block"])
             .join(tiles.select("bucket", "tile", *_side(tiles, "c")), ["bucket", "tile"]))
    return _best(_search(pairs.drop("band", "block", "bucket", "tile"), k), k).select("query_id", "rank", "vec_id", "score")


def spark_empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
