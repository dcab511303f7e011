"""Hard negatives by angular triangle filtering.

For each anchor the best-scoring rows of its own label are its positives; for each positive the best-scoring rows of other labels are
wanted whose score lies in a window below the positive's. Scores are inner products of scaled, floored vectors, in exact integers.

Every row stores its angles to a few reference directions. By the triangle inequality the angle between two rows is at least the
difference of their angles to any reference and at most the sum (and its complement to a full turn). That interval of
angles gives one of cosines, and times both lengths one of scores, widened by more than rounding can amount to. Only rows whose
interval meets one of an anchor's windows are scored. The same holds for tiles of rows, which store the ranges of their rows' angles and
lengths: pairs of a block of anchors and a tile that can't meet are dropped before either is sent anywhere.

Both searches run in two passes: first the tiles whose nearest reference is the anchors' own, which narrows the windows to what can
still be among the best; then all other pairs that are left. Tiles' ranges travel in packs of fixed size; nothing that grows with the
rows is broadcast. Angles of random directions hardly differ, so such data leave most pairs; results are exact in any case.

Reference directions are fitted on the at most SAMPLE rows of smallest hash: each is the one farthest from those before it. All
rows are indexed. Equal vectors of one label: only the first few ids can be in any answer, so others are left out of the search, and equal
anchors are searched once; a common vector or label is dealt over many tiles.

Rows with null ids, labels or vectors, and empty vectors or such with null or non-finite components take no part. Shorter vectors go on with zeros. An
id names one row: of rows that repeat it, the one with the least label and vector counts. Scores must fit 64 bits. Ties go to the smaller id.
Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mendline.llm.topk import quantised, usable
from mendline.llm.vectors import first_copies, first_of_each, one_per_id, same_width, to_matrix
from mendline.sources.io import stored

#: Rows of a tile and anchors of a block at most, about; tiles whose ranges travel together.
TILE, BLOCK, PACK = 1024, 256, 512
#: Reference directions, and the rows they are chosen from.
REFERENCES, SAMPLE = 16, 4096
#: What angles are widened by: rounding near a cosine of one moves an angle by 5e-8, storing it in four bytes by 2e-7.
SLACK = 1e-6
#: Pairs of an anchor and a row whose bounds or products are held at once.
STEP = 1 << 19

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def references(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to n unit vectors, each the row whose angle to those before it is largest."""
    lengths = np.sqrt(np.square(rows).sum(axis=1))
    units = rows[lengths > 0] / lengths[lengths > 0, None]
    chosen, nearest = [], np.full(len(units), -np.inf)
    while len(units) and len(chosen) < n:
        at = int(np.argmin(nearest))
        if chosen and nearest[at] > 1 - 1e-9:
            break
        chosen.append(units[at])
        nearest = np.maximum(nearest, units @ units[at])
    return np.array(chosen) if chosen else np.ones((1, max(1, rows.shape[1])))


def angles(rows: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to the references, and lengths. A vector of zeros has length zero, whatever its angles."""
    rows, refs = same_width(rows, refs)
    lengths = np.sqrt(np.square(rows).sum(axis=1))
    cosines = rows @ refs.T / (np.maximum(lengths, 1e-300)[:, None] * np.sqrt(np.square(refs).sum(axis=1)))
    return np.arccos(np.clip(cosines, -1.0, 1.0)), lengths


def score_bounds(low: np.ndarray, high: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score of vectors at an angle from `low` to `high`, whose lengths' product lies between the two given."""
    least = np.cos(np.minimum(high + SLACK, np.pi))
    most = np.cos(np.maximum(low - SLACK, 0.0))
    wide = 1e-9 * longest + 1e-6
    return (np.where(least >= 0, shortest, longest) * least - wide, np.where(most >= 0, longest, shortest) * most + wide)


def pair_bounds(a: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of each anchor with each row, from their angles to the references."""
    low, high = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.pi)
    for x, y in zip(a.T, b.T):
        np.maximum(low, np.abs(x[:, None] - y[None, :]), out=low)
        total = x[:, None] + y[None, :]
        np.minimum(high, np.minimum(total, 2 * np.pi - total), out=high)
    lengths = a_length[:, None] * b_length[None, :]
    return score_bounds(low, high, lengths, lengths)


def tile_bounds(a: np.ndarray, a_length: np.ndarray, low_of: np.ndarray, high_of: np.ndarray, shortest: np.ndarray, longest: np.ndarray):
    """Bounds of the scores of each anchor with any row of each tile, from the tiles' ranges of angles and lengths."""
    low, high = np.zeros((len(a), len(low_of))), np.full((len(a), len(low_of)), np.pi)
    for x, y, z in zip(a.T, low_of.T, high_of.T):
        np.maximum(low, np.maximum(y[None, :] - x[:, None], x[:, None] - z[None, :]), out=low)
        np.minimum(high, np.maximum(x[:, None] + z[None, :], 0.0), out=high)
        np.minimum(high, 2 * np.pi - x[:, None] - y[None, :], out=high)
    return score_bounds(low, high, a_length[:, None] * shortest[None, :], a_length[:, None] * longest[None, :])


def overlaps(least: np.ndarray, most: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which pairs can have a score in any of their anchor's windows. windows: anchors x windows x (from, to)."""
    out = np.zeros(least.shape, bool)
    for w in range(windows.shape[1]):
        low, high = windows[:, w, 0].astype(np.float64)[:, None], windows[:, w, 1].astype(np.float64)[:, None]
        wide = 1e-9 * (np.minimum(np.abs(low), np.abs(high)) + 1)
        out |= (low <= high) & (most >= low - wide) & (least <= high + wide)
    return out


def scores_of(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact integer score) of the pairs in the mask."""
    a, b = same_width(a, b)
    q, r = np.nonzero(mask)
    # Products of doubles are exact below 2^53; beyond, integers do it.
    small = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53
    if small and len(q) * 16 > mask.size:
        return q, r, (a.astype(np.float64) @ b.T.astype(np.float64))[q, r].astype(np.int64)
    at_once = max(1, (STEP * 8) // max(1, a.shape[1]))
    parts = [(a[q[i:i + at_once]] * b[r[i:i + at_once]]).sum(axis=1, dtype=np.int64) for i in range(0, len(q), at_once)]
    return q, r, np.concatenate(parts) if parts else np.empty(0, np.int64)


def best_in_windows(anchor: dict, tile: dict, k: int):
    """(anchor, window, row, score) of the k best rows of a tile in each window of each anchor, as arrays."""
    found = []
    at_once = max(1, STEP // max(1, len(tile["ids"])))
    for i in range(0, len(anchor["ids"]), at_once):
        part = slice(i, i + at_once)
        windows = anchor["windows"][part]
        bounds = pair_bounds(anchor["angles"][part].astype(np.float64), anchor["lengths"][part],
                             tile["angles"].astype(np.float64), tile["lengths"])
        q, r, scores = scores_of(anchor["vecs"][part], tile["vecs"], overlaps(*bounds, windows))
        for w in range(windows.shape[1]):
            inside = np.flatnonzero((scores >= windows[q, w, 0]) & (scores <= windows[q, w, 1]))
            order = inside[np.lexsort((tile["ids"][r[inside]], -scores[inside], q[inside]))]
            order = order[first_of_each(q[order], k)]
            found.append((q[order] + i, np.full(len(order), w), r[order], scores[order]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64),) * 4


# --- rows in packs ---------------------------------------------------------------------------------

_PARTS = {"ids": np.int64, "vecs": np.int64, "angles": np.float32, "lengths": np.float64, "windows": np.int64}


def _packs(rows: DataFrame, keys: list[str], windows: bool = False) -> DataFrame:
    """One row per group: its rows as bytes, in the least width that holds them, and the ranges of their angles and lengths."""
    types = dict(rows.dtypes)

    def pack(key, table):
        ids, vecs = table.column("id").to_numpy().astype(np.int64), to_matrix(table.column("vec"), np.int64)
        seen, lengths = to_matrix(table.column("angles"), np.float32), table.column("length").to_numpy()
        kind = next(k for k in map(np.dtype, (np.int16, np.int32, np.int64))
                    if np.iinfo(k).min <= vecs.min(initial=0) and vecs.max(initial=0) <= np.iinfo(k).max)
        parts = [ids, vecs.astype(kind), seen, lengths]
        names = ["ids", "vecs", "angles", "lengths"]
        if windows:
            parts.append(np.stack([to_matrix(table.column(c), np.int64) for c in ("low", "high")], axis=2))
            names.append("windows")
        values = [pa.array([kind.str], pa.string()), pa.array([vecs.shape[1]], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts),
                  pa.array([np.concatenate([seen.min(axis=0), seen.max(axis=0), [lengths.min(), lengths.max()]]).astype(np.float64).tobytes()], pa.binary())]
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), *values], names=[*keys, "kind", "dim", *names, "ranges"])

    binary = ["ids", "vecs", "angles", "lengths", *(["windows"] if windows else []), "ranges"]
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "kind string, dim int", *(f"{c} binary" for c in binary)])
    return rows.groupBy(*keys).applyInArrow(pack, schema)


def _unpacked(row: dict, side: str) -> dict:
    """The arrays of a pack; what was left behind is left out."""
    get = lambda name: row.get(f"{side}_{name}")
    out = {name: np.frombuffer(get(name), np.dtype(get("kind")) if name == "vecs" else dtype)
           for name, dtype in _PARTS.items() if get(name) is not None}
    n = len(out["ids"])
    if "vecs" in out:
        out["vecs"] = out["vecs"].reshape(n, get("dim")).astype(np.int64)
    out["angles"] = out["angles"].reshape(n, -1)
    if "windows" in out:
        out["windows"] = out["windows"].reshape(n, -1, 2)
    return out


def _sided(df: DataFrame, side: str, drop: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in ("kind", "dim", "ids", "vecs", "angles", "lengths", "windows") if c in df.columns and c not in drop]


_TILE = ["label", "cell", "tile"]
_BLOCK = ["b_label", "b_cell", "block"]


class Tiles:
    """The indexed rows in tiles, and their ranges in packs."""

    def __init__(self, rows: DataFrame):
        sizes = stored(rows.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "cell-sizes")
        tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        self.tiles = stored(_packs(rows.join(sizes, ["label", "cell"]).withColumn("tile", tile), _TILE), "tiles")
        self.groups = max(1, -(-self.tiles.count() // PACK))
        group = F.pmod(F.xxhash64(*_TILE), F.lit(self.groups)).cast("int")
        # Of fixed size: PACK tiles' keys and ranges, about.
        self.ranges = stored(self.tiles.select(group.alias("pack"), F.struct(*_TILE, "ranges").alias("t"))
                             .groupBy("pack").agg(F.collect_list("t").alias("ranges")), "tile-ranges")

    def meeting(self, blocks: DataFrame, same_label: bool) -> DataFrame:
        """Keys of the blocks and tiles that can meet, and whether the tile's cell is the block's own."""
        lean = blocks.select(*_BLOCK, *_sided(blocks, "a", drop=("vecs", "kind", "dim")), F.lit("").alias("a_kind"),
                             F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("pack"))
        packed = lean.join(self.ranges, "pack")
        kind = dict(self.tiles.dtypes)["label"]

        def meet(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    anchor = _unpacked(row, "a")
                    tiles = [t for t in row["ranges"] if (t["label"] == row["b_label"]) == same_label]
                    if not tiles:
                        continue
                    ranges = np.array([np.frombuffer(t["ranges"], np.float64) for t in tiles])
                    n = (ranges.shape[1] - 2) // 2
                    bounds = tile_bounds(anchor["angles"].astype(np.float64), anchor["lengths"], ranges[:, :n], ranges[:, n:2 * n],
                                         ranges[:, -2], ranges[:, -1])
                    kept = [tiles[t] for t in np.flatnonzero(overlaps(*bounds, anchor["windows"]).any(axis=0))]
                    column = lambda values, type: pa.array(values, type)
                    keys = [column([row[b]] * len(kept), batch.schema.field(b).type) for b in _BLOCK]
                    keys += [column([t["label"] for t in kept], batch.schema.field("b_label").type),
                             *(column([t[c] for t in kept], pa.int32()) for c in ("cell", "tile")),
                             column([t["cell"] == row["b_cell"] for t in kept], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(keys, names=[*_BLOCK, *_TILE, "own"])

        return packed.mapInArrow(meet, f"b_label {kind}, b_cell int, block int, label {kind}, cell int, tile int, own boolean")

    def search(self, pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
        """(anchor, low, high, id, score): up to k rows of a tile in each window of the anchors of a block. `high` names the window."""
        both = (pairs.select(*_BLOCK, *_TILE).join(blocks.select(*_BLOCK, *_sided(blocks, "a")), _BLOCK)
                .join(self.tiles.select(*_TILE, *_sided(self.tiles, "t")), _TILE).drop(*_BLOCK, *_TILE))

        def score(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    anchor, tile = _unpacked(row, "a"), _unpacked(row, "t")
                    q, w, r, scores = best_in_windows(anchor, tile, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        anchor["ids"][q], anchor["windows"][q, w, 1], tile["ids"][r], scores)], names=["anchor", "high", "id", "score"])

        return both.mapInArrow(score, "anchor long, high long, id long, score long")


def _best(found: DataFrame, by: list[str], k: int, rank: str = "rank") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn(rank, nth).where(F.col(rank) <= k)


def _in_windows(asked: DataFrame, tiles: Tiles, k: int, same_label: bool) -> DataFrame:
    """Each anchor's k best rows in each of its windows: asked has `low` and `high`, arrays of as many bounds as windows."""
    sizes = asked.groupBy("b_label", "b_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    laid = asked.join(stored(sizes, "block-sizes"), ["b_label", "b_cell"])
    laid = stored(laid.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"), "asked")
    blocks = stored(_packs(laid, _BLOCK, windows=True), "blocks")
    first = stored(_best(tiles.search(tiles.meeting(blocks, same_label).where("own"), blocks, k), ["anchor", "high"], k), "first-finds")
    # A window that holds k rows already is narrowed to what is as good as the last of them.
    full = first.groupBy("anchor", "high").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")).where("least IS NOT NULL")
    known = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("high", "least"))).alias("known"))
    closer = laid.join(known, laid.id == known.anchor, "left").drop("anchor")
    low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("known", F.get("high", i)), x)))
    closer = stored(closer.withColumn("low", F.when(F.col("known").isNull(), F.col("low")).otherwise(low)).drop("known"), "asked")
    blocks = stored(_packs(closer, _BLOCK, windows=True), "blocks")
    rest = tiles.search(tiles.meeting(blocks, same_label).where("NOT own"), blocks, k)
    return _best(first.drop("rank").unionByName(rest), ["anchor", "high"], k)


def hard_negatives(df: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, least_share: int = 80, id_col: str = "vec_id",
                   vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best `positives` rows of
    the same label, the best `negatives` rows of other labels with at least `least_share` hundredths of the positive's score and at most all."""
    good = df.where(usable(F.col(vector)) & F.col(id_col).isNotNull() & F.col(label).isNotNull())
    rows = one_per_id(good.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), quantised(F.col(vector), scale).alias("vec"),
                                  F.coalesce(is_anchor, F.lit(False)).alias("asks")), "label", "vec", "asks")
    rows = stored(rows, "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    refs = references(to_matrix(sample.column("vec"), np.float64), REFERENCES)
    kind = dict(rows.dtypes)["label"]

    def see(batches):
        for batch in batches:
            seen, lengths = angles(to_matrix(batch.column(2), np.float64), refs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(seen.astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array(lengths),
                 pa.array(seen.argmin(axis=1).astype(np.int32))], names=["id", "label", "vec", "angles", "length", "cell"])

    fields = f"id long, label {kind}, vec array<long>, angles array<float>, length double, cell int"
    kept = first_copies(rows.drop("asks"), ["label", "vec"], max(positives + 1, negatives))
    tiles = Tiles(stored(kept.select("id", "label", "vec").mapInArrow(see, fields), "vectors-kept"))
    asking = rows.where("asks").select("id", "label", "vec")
    anchors = stored(asking.groupBy("label", "vec").agg(F.min("id").alias("id")).select("id", "label", "vec"), "anchors")
    seen = stored(anchors.mapInArrow(see, fields).withColumnsRenamed({"label": "b_label", "cell": "b_cell"}), "anchors")

    # One best row more than wanted: an anchor's own row may be among them.
    every = seen.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    best = stored(_in_windows(every, tiles, positives + 1, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                  "positives")
    least = F.expr(f"({least_share} * positive_score + 99) div 100")
    windows = (best.where("positive_score >= 0").select("anchor", "positive_score", least.alias("low")).distinct()
               .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive_score", "low"))).alias("w")))
    asked = seen.join(windows.withColumnRenamed("anchor", "id"), "id").withColumns({"low": F.col("w.low"), "high": F.col("w.positive_score")}).drop("w")
    # Blocks hold as many windows for each anchor; the ones filled in are empty.
    fill = lambda name, x: F.concat(name, F.array_repeat(F.lit(x).cast("long"), positives + 1 - F.size(name)))
    asked = asked.withColumns({"low": fill("low", 1), "high": fill("high", 0)})
    wrong = stored(_in_windows(asked, tiles, negatives, False).select("anchor", F.col("high").alias("positive_score"), "rank",
                   F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")

    of_anchor = asking.join(anchors.withColumnRenamed("id", "anchor"), ["label", "vec"]).select(F.col("id").alias("anchor_id"), "anchor")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    own = (of_anchor.join(best, "anchor").where("anchor_id <> positive_id").withColumn("nth", nth).where(F.col("nth") <= positives).drop("nth"))
    return own.join(wrong, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
