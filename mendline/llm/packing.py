"""Order-preserving packing of token streams into windows by dynamic programming.

The documents of a partition, by doc_id, form one stream of ids. Cuts may fall behind a document, behind a sentence, or,
where those are far apart, at regular places between; each kind of cut has a price, and so has each token of padding. With
f(j) the least price of a packing that ends at place t(j),

    f(j) = price(j) + width - t(j) + min { f(i) + t(i) : t(j) - width <= t(i) < t(j) }

and the minimum over the sliding range comes from a monotone queue, so the work is linear in the number of places. What is
left at the end of a partition is cut into powers of two, which need no padding, so the last window has no price.

A stream is solved in blocks of bounded length: all but the last windows of a block are final, the rest joins the next
block. Nothing is shuffled; a partition that is computed again gives the same rows.

Null text counts as empty; an empty text is the end id alone. Repeated rows and equal ids are packed each on its own.
Extra columns of the input are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from mendline.llm.bpe import CHUNKS, PIECES, YOUNG, Memory, WordCoder, id_lists
from mendline.llm.common import chunks

#: Price of a cut behind a sentence and elsewhere, in tokens of padding; behind a document it is free.
SENTENCE, ELSEWHERE = 4, 24
#: Farthest distance of two neighbouring places where a cut may fall.
APART = 32
#: Tokens of a stream solved together, at least.
BLOCK = 400_000
#: Characters of a text that are cut into pieces at once, at least.
STEP = 1_000_000

PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


#: Marks that often follow a word.
MARKS = ".,;:!?"
BLANK = re.compile("[ \t-\r]")


def stretches(text: str) -> Iterator[str]:
    """A text cut at white space into parts of bounded length, but for longer runs without any."""
    start = 0
    while len(text) - start > STEP and (found := BLANK.search(text, start + STEP)):
        yield text[start:found.start()]
        start = found.end()
    yield text[start:] if start else text


class LibraryIds:
    """Ids by the tokenizers library. A text of plain signs is cut into pieces by the vocabulary's rule, here as one regular expression, and the
    library's model is asked once for each piece; other texts go through the library chunk by chunk. Memories are bounded in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.rules = WordCoder(path)
        self.library = self.rules.library
        self.tokenize = self.library.model.tokenize
        self.chunks = Memory(self.chunk, CHUNKS // 4)
        self.pieces = Memory(self.piece, PIECES // 4)
        self.words = Memory(self.word, PIECES * 5 // 2)
        signs = [chr(c) for c in range(0x530)]
        plain = "".join(c for c in signs if (c.isprintable() or BLANK.match(c)) and not YOUNG.match(c))
        self.odd = re.compile(f"[^{re.escape(plain)}]")
        # The rule with its classes spelt out for the signs that are plain. They must all stand within brackets.
        rule = self.rules.piece.pattern
        within = "\\p" not in re.sub(r"\[[^]]*\]", "", rule)
        for name in ("\\p{L}", "\\p{N}", "\\p{White_Space}"):
            rule = rule.replace(name, re.escape("".join(c for c in plain if regex.fullmatch(name, c))))
        known = re.escape("".join(c for c in plain if regex.fullmatch(r"[\p{L}\p{N}\p{White_Space}]", c)))
        self.closed = re.compile(f"[^{known}][{MARKS}][ \\n]")
        self.rule = re.compile(rule) if within and "\\p" not in rule else None

    def piece(self, piece: str) -> bytes:
        """Ids of a piece that the library's normaliser and splitter would leave as it is: its model alone."""
        letters = piece if piece.isascii() else "".join(map(self.rules.letters.__getitem__, piece.encode("utf-8")))
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if self.rules.mark not in text and (found := self.rules.split(text)) is not None and "\x7f" not in text and text.isprintable():
            return b"".join(map(self.pieces.__getitem__, found))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(itertools.chain.from_iterable(map(self.ids, stretches(text or "")))), np.uint32)

    def ids(self, part: str) -> Iterator[bytes]:
        if self.rule is not None and self.rules.mark not in part:
            normal = self.normal(part)
            # Both: what is normal may be beyond the plain signs although the part isn't, and the other way round.
            if not self.odd.search(normal) and (part.isascii() or not self.odd.search(part)):
                # A mark behind a letter or number is a piece of its own, so it may stand alone; not so behind other signs.
                if not self.closed.search(normal):
                    for mark in MARKS:
                        normal = normal.replace(f"{mark} ", f" {mark} ").replace(f"{mark}\n", f" {mark}\n")
                return map(self.words.__getitem__, normal.split())
        return map(self.chunks.__getitem__, part.encode("utf-8").split())

    def word(self, word: str) -> bytes:
        """Ids of a run of plain signs without white space, already normal."""
        if word.isalpha():
            return self.piece(word)
        pieces = self.rule.findall(word)
        return self.piece(word) if len(pieces) == 1 else b"".join(map(self.words.__getitem__, pieces))

    @staticmethod
    def normal(part: str) -> str:
        """As the vocabulary's normaliser: lower case letter by letter, so that a final sigma is a sigma."""
        return (part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")).lower()

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its string closes a sentence: a full stop or the like, alone or before closing signs."""
        end, out = self.rules.suffix, np.zeros(max(self.rules.strings) + 1, bool)
        for s, i in self.rules.ids.items():
            body = s.removesuffix(end)
            out[i] = body != s and body.rstrip("\"')]").endswith((".", "!", "?")) and not any(c.isalnum() for c in body)
        return out


_libraries: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    if path not in _libraries:
        _libraries[path] = LibraryIds(path)
    return _libraries[path]


def places(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a cut may fall, ascending, and its price; the last is the end of the stream."""
    prices = np.zeros(int(max(doc_ends[-1], sentence_ends.max(initial=0))) + 1, np.int64)
    prices[sentence_ends] = SENTENCE + 1
    prices[doc_ends] = 1
    prices[0] = 0
    known = np.flatnonzero(prices)
    gaps = np.diff(known, prepend=0)
    wide = np.flatnonzero(gaps > APART)
    steps = (gaps[wide] - 1) // APART
    number = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    prices[np.repeat(known[wide] - gaps[wide], steps) + APART * (number + 1)] = ELSEWHERE + 1
    at = np.flatnonzero(prices)
    return at, prices[at] - 1


def cuts(at: np.ndarray, price: np.ndarray, width: int) -> list[int]:
    """The cheapest places to cut, ascending; windows are at most `width` long, and `at` has no gap beyond that. The last window costs
    nothing: it is either solved again with what follows, or cut into pieces without padding."""
    ends, prices = at.tolist(), price.tolist()
    best, previous = [], []
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # f(i) + t(i), t(i), i: ascending in all
    for j in range(len(ends) - 1):
        t = ends[j]
        while queue[0][1] < t - width:
            queue.popleft()
        least, _, i = queue[0]
        f = least + prices[j] + width - t
        best.append(f)
        previous.append(i)
        while queue and queue[-1][0] >= f + t:
            queue.pop()
        queue.append((f + t, t, j))
    # The latest of the cheapest starts for the last window.
    end, j, least = ends[-1], len(ends) - 2, None
    last = -1
    while j >= 0 and ends[j] >= end - width:
        if least is None or best[j] < least:
            least, last = best[j], j
        j -= 1
    out, j = [end], -1 if end <= width else last
    while j >= 0:
        out.append(ends[j])
        j = previous[j]
    return out[::-1]


def powers(start: int, length: int) -> list[int]:
    """Ends of pieces of falling powers of two that fill the length."""
    ends = []
    while length:
        step = 1 << (length.bit_length() - 1)
        start, length = start + step, length - step
        ends.append(start)
    return ends


class Stream:
    """Ids of documents not yet packed."""

    def __init__(self, width: int, ends: np.ndarray, first_id: int, with_ids: bool):
        self.width, self.ends, self.with_ids = width, ends, with_ids
        self.docs: list[tuple[int, int, int, np.ndarray]] = []  # id, tokens in all, tokens packed, rest
        self.held = 0
        self.numbers = itertools.count(first_id)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch:
        """Rows of the windows that are final."""
        ids = np.concatenate([d[3] for d in self.docs])
        doc_ends = np.cumsum([len(d[3]) for d in self.docs])
        sentences = np.flatnonzero(self.ends[ids]) + 1
        windows = cuts(*places(doc_ends, sentences), self.width)
        if last:
            start = windows[-2] if len(windows) > 1 else 0
            windows[-1:] = powers(start, windows[-1] - start)
        else:
            del windows[-3:]
        rows, pieces, start, d, doc_start = [], [], 0, 0, 0
        for end in windows:
            number, begin = next(self.numbers), start
            while start < end:
                doc_id, total, done, rest = self.docs[d]
                stop = min(end, doc_start + len(rest))
                part = ids[start:stop]
                rows.append((doc_id, done + start - doc_start, stop - start, zlib.crc32(part), total, number, start - begin))
                if self.with_ids:
                    pieces.append(part)
                start = stop
                if stop == doc_start + len(rest):
                    d, doc_start = d + 1, stop
        self.docs = self.docs[d:]
        if self.docs and start > doc_start:
            doc_id, total, done, rest = self.docs[0]
            self.docs[0] = doc_id, total, done + start - doc_start, rest[start - doc_start:].copy()
        self.held -= start
        columns = list(zip(*rows)) or [()] * len(PIECE)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        names = PIECE.names
        if self.with_ids:
            arrays, names = [*arrays, id_lists(pieces)], [*names, IDS.name]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(df: DataFrame, path: str, *, width: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts in its document, its length and checksum, and its sequence and
    place there; `with_ids` adds the ids. `width` must be a power of two, and no less than the distance of places to cut (APART)."""
    if width & (width - 1) or width < APART:
        raise ValueError(f"width must be a power of two from {APART} on")
    schema = T.StructType([*PIECE.fields, IDS]) if with_ids else PIECE

    def run(batches):
        ids_of = library_ids(path)
        end = np.array([end_id], np.uint32)
        stream = Stream(width, ids_of.sentence_ends(), TaskContext.get().partitionId() << 40, with_ids)
        for batch, texts in chunks(batches):
            for doc_id, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts):
                stream.add(doc_id, np.concatenate([ids_of(text), end]))
                if stream.held >= BLOCK:
                    yield stream.pack(last=False)
        if stream.docs:
            yield stream.pack(last=True)

    return df.select("doc_id", "text").sortWithinPartitions("doc_id").mapInArrow(run, schema)
