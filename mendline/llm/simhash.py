"""Near duplicates by SimHash: all pairs of fingerprints within a few bits, found by exact comparison of tiles.

Texts with equal fingerprints are put together first. The distinct fingerprints are grouped into cells by the number of one
bits in each of their four quarters. Two fingerprints that differ in at most r bits have counts that differ by at most r in
all, so only cells that near are compared; other tile pairs are skipped. A cell is cut into tiles of bounded size, and each
pair of tiles is compared in full with exclusive-or and bit counts.

Of the links found between two tiles a spanning forest is kept: it has the same components and at most as many links as
the tiles have fingerprints, however large a group of near copies is. Star contraction over those links gives components.

The number of cells is at most 17^4 whatever the input, so their sizes may be broadcast; nothing else is.

Work within a cell and its neighbours grows with the square of the fingerprints there; see README.

Null text counts as empty. Texts without words have fingerprint zero and are linked like any other. Null identifiers never
become a component's identifier unless it has no other. Repeated rows are rows of their own with equal results.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from mendline.llm.common import SPACE, free_name, map_chunks, with_arrays
from mendline.llm.components import components
from mendline.sources.io import stored

#: Fingerprints of a tile at most.
TILE = 2048
#: Seed of the shingles' hash; a fixed value of the contract.
SEED = 42
LOWER = bytes(range(256)).lower()
RUN = re.compile(SPACE.encode() + rb"+")
#: Shingles whose bits are counted at once.
STEP = 65_536


def fingerprint(text: str | None, words: int) -> int:
    """64 bits, each 1 if set in more than half of the hashes of the text's word shingles, repeats included."""
    line = RUN.sub(b" ", (text or "").encode("utf-8").translate(LOWER)).strip(b" ")
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < words:
        return digest(line, SEED)
    spans = zip(starts, ends[words - 1:])
    ones = np.zeros(64, np.int64)
    while step := [digest(line[a:b], SEED) for a, b in itertools.islice(spans, STEP)]:
        ones += np.unpackbits(np.array(step, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    n = len(starts) - words + 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(df: DataFrame, out: str, *, words: int = 3, text: str = "text") -> DataFrame:
    """Add the fingerprint as a signed long."""

    def make():
        def step(batch, texts):
            prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield with_arrays(batch, [out], [pa.array(prints, pa.int64())])

        return step

    return map_chunks(df, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]), make, text)


def cell_of(column: str):
    """The one bits of the four 16-bit quarters, each in a digit to the base 32. A digit is at most 16, so a sum that
    leaves the digits' range is no cell's number."""
    quarters = [F.bit_count(F.shiftrightunsigned(column, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))) for k in range(4)]
    return sum((q * 32**k for k, q in enumerate(quarters)), F.lit(0)).cast("int")


def near_steps(radius: int) -> list[int]:
    """What to add to a cell's number for itself and each later cell whose counts differ by the radius at most in all."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    numbers = {sum(d * 32**k for k, d in enumerate(s)) for s in steps if sum(map(abs, s)) <= radius}
    return sorted(n for n in numbers if n >= 0)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links between two tiles, or within one, that connect whatever links within the radius connect."""
    same = right is None
    right = left if same else right
    parent: dict[int, int] = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    rows = max(1, 4_000_000 // max(1, len(right)))
    for start in range(0, len(left), rows):
        near = np.bitwise_count(left[start:start + rows, None] ^ right[None, :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            i += start
            if same and i >= j:
                continue
            a, b = int(left[i]), int(right[j])
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[ra] = rb
                out.append((a, b))
    return out


LINK = "u long, v long"


def near_links(prints: DataFrame, *, radius: int = 3) -> DataFrame:
    """From distinct fingerprints (fp): links (u, v) that have the same components as all pairs within the radius."""
    celled = prints.select("fp", cell_of("fp").alias("cell"))
    # At most 17^4 rows of two numbers, whatever the input.
    sizes = stored(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n_tiles")), "cells")
    tiles = (celled.join(F.broadcast(sizes), "cell")
             .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int").alias("tile"))
             .agg(F.collect_list("fp").alias("fps")))
    tiles = stored(tiles, "tiles")
    steps = F.array(*map(F.lit, near_steps(radius)))
    pairs = (tiles.select("cell", "tile", F.col("fps").alias("left"), F.explode(steps).alias("step"))
             .withColumn("b", F.col("cell") + F.col("step"))
             .join(F.broadcast(sizes.withColumnRenamed("cell", "b")), "b")
             .select("*", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("b_tile"))
             .where("b > cell OR b_tile >= tile"))
    both = pairs.join(tiles.select(F.col("cell").alias("b"), F.col("tile").alias("b_tile"), F.col("fps").alias("right")),
                      ["b", "b_tile"]).select("left", "right", F.expr("b = cell AND b_tile = tile").alias("same"))

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            left, right = batch.column(0), batch.column(1)
            for i, same in enumerate(batch.column(2).to_pylist()):
                a = left[i].values.to_numpy().view(np.uint64)
                b = None if same else right[i].values.to_numpy().view(np.uint64)
                for u, v in forest(a, b, radius):
                    us.append(u)
                    vs.append(v)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays(longs, names=["u", "v"])

    return both.mapInArrow(compare, LINK)


def near_duplicates(df: DataFrame, *, words: int = 3, radius: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint as hex, component_id) for every row."""
    fp = free_name(df, "fp")
    prints = stored(with_fingerprint(df.select(id_col, text), fp, words=words, text=text).select(
        F.col(id_col), F.col(fp).alias("fp")), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    roots = components(near_links(distinct.select("fp"), radius=radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
