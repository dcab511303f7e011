"""Repeated passages by an index of first occurrences of windows, which stands in place of a relative Lempel-Ziv parse.

The reference is the corpus itself, cut into blocks: a block is what one task reads between two flushes. Each window of
`width` words is known by a hash, and belongs to an anchor, the smallest hash among the `ANCHOR`-word groups inside it; consecutive windows
mostly share their anchor, so a segment of them travels as one packed piece. Blocks send their segments, in each only the first occurrence
of a window, to the index partition of the anchor, which keeps for every window the document and place where it occurs first.

The index alone decides which words are duplicate: those of windows that an earlier document holds. There is no greedy longest match: each
window is tied to its one first occurrence, and factors are the runs of windows on one stretch of one reference document. A factor ends
where the first occurrence lies elsewhere, though an earlier document may hold more. Every factor has at least `width` words.

Segments of a block hold each window once, so a passage that a third of all documents share reaches the index once a block, and so does a window
that one document repeats: the block keeps its other places as runs on the document itself. Index partitions
are as many as the input's words require, so that each fits into a task. Windows are counted by ranges of anchors first; those of a range with too
many, as of a short phrase that many documents put in other surroundings, are dealt by their own hash, by which equal windows still meet.

Windows are judged on the input. Null text has no words. A row is known by its identifier and a 64-bit hash of its text: rows with equal identifiers are not
earlier than one another, whatever their texts. Null identifiers come after all others. Columns of the input are kept; those named like a
result are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mendline.llm.common import SPACE, chunks, free_name, map_chunks, with_arrays

#: Words of an anchor.
ANCHOR = 6
#: Windows of a block between two flushes, and about as many in an index partition.
BLOCK = 1 << 20
#: Ranges of anchors for each index partition, and the part of a BLOCK of windows that makes a range hot.
RANGES, HOT = 16, 4
#: Words of a text hashed at once.
WORDS = 1 << 18
#: Bytes of a window's hash that travel, beside four of its anchor.
HASH_BYTES = 6
RUN = re.compile(SPACE.encode() + rb"+")
LAST = (1 << 63) - 1

#: Odd multiplier of the rolling hash over bytes, and its inverse to the base 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes whose powers are kept; a text's bytes are hashed in steps of this length.
STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Rolling hashes of word groups in a line of words joined by one space."""

    def __init__(self):
        self.up, self.down = _powers(BASE, STEP), _powers(INVERSE, STEP)
        self.letters = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def _power(self, table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
        out = table[at % STEP]
        high = at // STEP
        if high.any():
            step = pow(base, STEP, 1 << 64)
            out = out * _powers(step, int(high.max()) + 1)[high]
        return out

    def prefix(self, line: bytes) -> np.ndarray:
        """Hash of every prefix of the line."""
        codes = self.letters[np.frombuffer(line, np.uint8)]
        at = np.arange(len(codes))
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self._power(self.up, BASE, at), out=out[1:])
        return out

    def groups(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
        """A hash of each group of neighbouring words, the same wherever the group stands."""
        n = max(0, len(starts) - words + 1)
        a, b = starts[:n], ends[words - 1:words - 1 + n]
        x = (prefix[b] - prefix[a]) * self._power(self.down, INVERSE, a)
        x ^= (b - a).astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def line_of(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends."""
    line = RUN.sub(b" ", (text or "").encode("utf-8")).strip(b" ")
    if not line:
        return line, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return line, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` neighbours, by doubling."""
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def windows(hasher: Hasher, text: str | None, width: int, hashed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each window its hash, if `hashed`, and its anchor."""
    line, starts, ends = line_of(text)
    hashes, anchors = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i in range(0, len(starts) - width + 1, WORDS):
        s, e = starts[i:i + WORDS + width - 1], ends[i:i + WORDS + width - 1]
        prefix = hasher.prefix(line[s[0]:e[-1]])
        s, e = s - s[0], e - s[0]
        if hashed:
            hashes.append(hasher.groups(prefix, s, e, width))
        anchors.append(sliding_least(hasher.groups(prefix, s, e, ANCHOR), width - ANCHOR + 1))
    return np.concatenate(hashes), np.concatenate(anchors)


def dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each hash, by its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def spread(anchors: np.ndarray) -> np.ndarray:
    """Anchors are least hashes, so most are small; these are even."""
    return anchors * np.uint64(BASE)


def packed(x: np.ndarray, width: int) -> bytes:
    """Numbers as planes of their lowest bytes: the high planes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


#: A block's segments for one index partition: of each document its order key, row key and number of segments; of each
#: segment its first window, number of windows and anchor; of each window its hash. `known`: runs that the block itself resolves.
SEGMENTS = "part int, docs binary, keys binary, counts binary, starts binary, sizes binary, anchors binary, hashes binary, known binary"
NAMES = ["part", "docs", "keys", "counts", "starts", "sizes", "anchors", "hashes", "known"]
#: A run of windows that an earlier document holds: its document and first window, and where the run begins in the earlier one.
RUN_TYPE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4"), ("ref", "<i8"), ("ref_start", "<i4")])
RUNS = "doc long, key long, start int, n int, ref long, ref_start int"


def runs_of(doc, key, place, ref, ref_place) -> np.ndarray:
    """Join neighbouring windows of one document that lie on one stretch of one reference."""
    order = np.lexsort((place, key, doc))
    doc, key, place, ref, ref_place = (x[order] for x in (doc, key, place, ref, ref_place))
    new = np.ones(len(doc), bool)
    new[1:] = ((doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1)
               | (ref[1:] != ref[:-1]) | (ref_place[1:] != ref_place[:-1] + 1))
    at = np.flatnonzero(new)
    out = np.zeros(len(at), RUN_TYPE)
    for name, x in (("doc", doc), ("key", key), ("start", place), ("ref", ref), ("ref_start", ref_place)):
        out[name] = x[at]
    out["n"] = np.diff(np.append(at, len(doc)))
    return out


def first_occurrences(hashes, anchors, docs, row, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that an earlier document holds too, and for each the first occurrence; the other windows that occur again. docs: order
    keys of the documents that `row` counts."""
    by_hash = np.argsort(hashes).astype(np.int32)
    sorted_hashes = hashes[by_hash]
    twin = sorted_hashes[1:] == sorted_hashes[:-1]
    del sorted_hashes
    again = np.zeros(len(hashes), bool)
    again[by_hash[1:][twin]] = again[by_hash[:-1][twin]] = True
    del by_hash, twin
    some = np.flatnonzero(again).astype(np.int32)
    some = some[np.lexsort((place[some], docs[row[some]], anchors[some], hashes[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (hashes[some[1:]] != hashes[some[:-1]]) | (anchors[some[1:]] != anchors[some[:-1]])
    first = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
    later = docs[row[some]] > docs[row[first]]
    return some[later], first[later], some[~later]


def own_repeats(hashes, anchors, row, place, some) -> tuple[np.ndarray, np.ndarray]:
    """Those of the windows `some` that their row holds before, and for each the last occurrence before it."""
    some = some[np.lexsort((place[some], row[some], anchors[some], hashes[some]))]
    same = np.ones(max(0, len(some) - 1), bool)
    for x in (hashes, anchors, row):
        same &= x[some[1:]] == x[some[:-1]]
    return some[1:][same], some[:-1][same]


class Block:
    """Windows of the documents read since the last flush."""

    def __init__(self, parts: int, hot: np.ndarray):
        """hot: for each range of anchors, whether its windows are dealt by their own hash."""
        self.parts, self.hot, self.turn = parts, hot, 0
        self.clear()

    def clear(self):
        self.docs, self.keys, self.hashes, self.anchors, self.held = [], [], [], [], 0

    def add(self, doc: int, key: int, hashes: np.ndarray, anchors: np.ndarray):
        if len(hashes):
            self.docs.append(doc)
            self.keys.append(key)
            self.hashes.append(hashes)
            self.anchors.append(anchors)
            self.held += len(hashes)

    def flush(self) -> pa.RecordBatch:
        lengths = np.array([len(h) for h in self.hashes], np.int64)
        hashes, anchors = np.concatenate(self.hashes), np.concatenate(self.anchors)
        docs, keys = np.array(self.docs, np.int64), np.array(self.keys, np.int64)
        self.clear()
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = (np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)

        # A window that an earlier document of this block holds is resolved here.
        later, first, others = first_occurrences(hashes, anchors, docs, row, place)
        known = runs_of(docs[row[later]], keys[row[later]], place[later], docs[row[first]], place[first])
        # Of a window that its own document holds before, only the place stays: a run whose reference is the document.
        again, before = own_repeats(hashes, anchors, row, place, others)
        known = np.concatenate([known, runs_of(docs[row[again]], keys[row[again]], place[again], docs[row[before]], place[before])])
        left = np.ones(len(hashes), bool)
        left[later] = left[again] = False
        hashes, anchors, row, place = hashes[left], anchors[left], row[left], place[left]

        # Segments: neighbouring windows of a document with one anchor; windows of hot anchors one by one.
        hot = self.hot[dealt(spread(anchors), len(self.hot))]
        new = np.ones(len(hashes), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | hot[1:]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(hashes)))
        part = dealt(np.where(hot[at], hashes[at], spread(anchors[at])), self.parts)
        order = np.argsort(part, kind="stable")
        at, size, part = at[order], size[order], part[order]
        bounds = np.searchsorted(part, np.arange(self.parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            a, n = at[bounds[p]:bounds[p + 1]], size[bounds[p]:bounds[p + 1]]
            index = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            used, counts = np.unique(row[a], return_counts=True)  # segments are in order of documents
            rows.append((p, packed(docs[used], 8), packed(keys[used], 8), packed(counts, 4), packed(place[a], 4), packed(n, 4),
                         packed(anchors[a], 4), packed(hashes[index], HASH_BYTES), b""))
        self.turn = (self.turn + 1) % self.parts
        rows.append((self.turn, *(b"" for _ in NAMES[2:]), known.tobytes()))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=NAMES)


def look_up(segments: pa.Table) -> pa.Table:
    """One index partition: the runs of windows that earlier documents hold."""
    docs, keys, row, place, hashes, anchors, known, n_docs = [], [], [], [], [], [], [], 0
    for i in range(segments.num_rows):
        r = {name: segments.column(name)[i].as_py() for name in NAMES[1:]}
        known.append(np.frombuffer(r["known"], RUN_TYPE))
        docs.append(unpacked(r["docs"], 8).view(np.int64))
        keys.append(unpacked(r["keys"], 8).view(np.int64))
        size = unpacked(r["sizes"], 4).astype(np.int64)
        own = np.repeat(np.arange(n_docs, n_docs + len(docs[-1]), dtype=np.int32), unpacked(r["counts"], 4).astype(np.int64))
        n_docs += len(docs[-1])
        row.append(np.repeat(own, size))
        place.append((np.repeat(unpacked(r["starts"], 4).astype(np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())).astype(np.int32))
        anchors.append(np.repeat(unpacked(r["anchors"], 4).astype(np.uint32), size))
        hashes.append(unpacked(r["hashes"], HASH_BYTES))
    docs, keys, known = map(np.concatenate, (docs, keys, known))
    row, place, anchors, hashes = (np.concatenate(x) for x in (row, place, anchors, hashes))
    later, first, _ = first_occurrences(hashes, anchors, docs, row, place)
    found = runs_of(docs[row[later]], keys[row[later]], place[later], docs[row[first]], place[first])
    runs = np.concatenate([known, found])
    return pa.table({name: np.ascontiguousarray(runs[name]) for name in RUN_TYPE.names})


def row_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hot_ranges(df: DataFrame, parts: int, *, width: int, text: str) -> np.ndarray:
    """Which ranges of anchors hold too many windows for one index partition."""
    n = RANGES * parts

    def count(batches):
        hasher, held = Hasher(), np.zeros(n, np.int64)
        for _, texts in chunks(batches, text):
            for t in texts:
                held += np.bincount(dealt(spread(windows(hasher, t, width, False)[1]), n), minlength=n)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["slot", "n"])

    sums = df.select(text).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(n, bool)
    out[[r.slot for r in sums.where(F.col("n") > BLOCK // HOT).collect()]] = True  # a few for each partition at most
    return out


def repeated_runs(df: DataFrame, *, width: int, text: str, id_col: str) -> DataFrame:
    """Runs of windows that earlier documents hold, by document and row key."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = size // (6 * BLOCK) + 1  # about a BLOCK of windows each, at six bytes a word
    key = free_name(df.select(id_col, text), "row_key")
    hot = hot_ranges(df, parts, width=width, text=text) if parts > 1 else np.zeros(1, bool)

    def cut(batches):
        hasher, block = Hasher(), Block(parts, hot)
        for batch, texts in chunks(batches, text):
            ids, keys = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (id_col, key))
            for doc, k, t in zip(ids, keys, texts):
                block.add(LAST if doc is None else doc, k, *windows(hasher, t, width))
                if block.held >= BLOCK:
                    yield block.flush()
        if block.held:
            yield block.flush()

    segments = df.select(id_col, text, row_key(text).alias(key)).mapInArrow(cut, SEGMENTS)
    return segments.groupBy("part").applyInArrow(look_up, RUNS)


def resolved(doc: int, runs: list[dict]) -> list[dict]:
    """The runs on earlier documents, with those that the document's runs on itself make of them."""
    own = [r for r in runs if r["ref"] == doc]
    if not own or len(own) == len(runs):
        return [] if own else runs
    n = max(r["start"] + r["n"] for r in runs)
    origin, held = np.arange(n), np.zeros(n, bool)
    ref, ref_place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in runs:
        at = slice(r["start"], r["start"] + r["n"])
        if r["ref"] == doc:
            origin[at] = np.arange(r["ref_start"], r["ref_start"] + r["n"])
        else:
            held[at], ref[at], ref_place[at] = True, r["ref"], np.arange(r["ref_start"], r["ref_start"] + r["n"])
    while (origin[origin] != origin).any():
        origin = origin[origin]
    place = np.flatnonzero(held[origin])
    zeros = np.zeros(len(place), np.int64)
    joined = runs_of(zeros, zeros, place, ref[origin[place]], ref_place[origin[place]])
    return [dict(zip(("start", "n", "ref", "ref_start"), x)) for x in joined[["start", "n", "ref", "ref_start"]].tolist()]


def factors(runs: list[dict], width: int) -> list[tuple[int, int, int, int]]:
    """Runs joined: (first word, end word, reference, first word there). A run that goes on where the factor before it
    stops, on the same stretch, lengthens it; one on another stretch, straddling the factor's end, starts the next."""
    out: list[tuple[int, int, int, int]] = []
    for r in sorted(runs, key=lambda r: r["start"]):
        start, end = r["start"], r["start"] + r["n"] + width - 1
        if out and out[-1][2] == r["ref"] and out[-1][3] - out[-1][0] == r["ref_start"] - start and start <= out[-1][1] - width + 1:
            out[-1] = (out[-1][0], end, *out[-1][2:])
        else:
            out.append((start, end, r["ref"], r["ref_start"]))
    return out


FACTOR = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                       T.StructField("ref", T.LongType()), T.StructField("ref_start", T.IntegerType())])
RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
          T.StructField("kept_text", T.StringType()), T.StructField("factors", T.ArrayType(FACTOR))]


def substring_duplicates(df: DataFrame, *, width: int = 13, text: str = "text", id_col: str = "doc_id",
                         keep: list[str] | None = None) -> DataFrame:
    """The input, or its columns in `keep`, with n_words, n_removed, kept_text (the words left, joined by one space) and factors."""
    results = [f.name for f in RESULT]
    df = df.drop(*(c for c in df.columns if c.lower() in results and c not in (text, id_col)))
    runs = repeated_runs(df, width=width, text=text, id_col=id_col)
    r_doc, r_key, r_runs, key = (free_name(df, n) for n in ("run_doc", "run_key", "runs", "row_key"))
    lists = runs.groupBy(F.col("doc").alias(r_doc), F.col("key").alias(r_key)).agg(
        F.collect_set(F.struct("start", "n", "ref", "ref_start")).alias(r_runs))
    keyed = df.withColumn(key, row_key(text))
    joined = keyed.join(lists, (F.coalesce(F.col(id_col), F.lit(LAST)) == F.col(r_doc)) & (F.col(key) == F.col(r_key)), "left")
    columns = df.columns
    wanted = columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in wanted), *RESULT])

    def make():
        def step(batch, texts):
            n_words, n_removed, kept, spans = [], [], [], []
            ids, lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (id_col, r_runs))
            for t, doc, found in zip(texts, ids, lists):
                line, starts, ends = line_of(t)
                parsed = factors(resolved(LAST if doc is None else doc, found or []), width)
                if parsed:
                    drop = np.zeros(len(starts), bool)
                    for a, b, _, _ in parsed:
                        drop[a:b] = True
                    words = line.split(b" ")
                    line = b" ".join([w for w, d in zip(words, drop.tolist()) if not d])
                n_words.append(len(starts))
                n_removed.append(int(drop.sum()) if parsed else 0)
                kept.append(line.decode("utf-8"))
                spans.append([dict(zip(FACTOR.names, f)) for f in parsed])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())]))
            own = batch.select(wanted)
            yield with_arrays(own, results, [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                             pa.array(kept, pa.string()), pa.array(spans, kind)])

        return step

    return map_chunks(joined.select(*columns, r_runs), schema, make, text)
