"""Byte-pair encoding and decoding with a published vocabulary.

A symbol list is doubly linked; a priority queue holds the merge ranks of neighbouring pairs; entries whose symbols
have changed meanwhile are skipped when they come up. Decoding joins the vocabulary's strings.

White space separates pieces before anything else does, so a text is encoded as its white-space-free chunks one by one,
and a bounded memory of chunks and of pieces saves repeated work.

Null text counts as empty; an empty text has no ids and decodes to the empty string. Rows and extra columns are kept.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from mendline.llm.common import map_chunks, with_arrays

#: Bytes of chunks and of pieces remembered per Python worker, at most twice as many; longer entries are not remembered.
CHUNKS, PIECES, LONG = 64_000_000, 64_000_000, 200
#: What an entry takes beside its key and value, about.
ENTRY = 180
#: Marks that often follow a word.
BEHIND = frozenset(".,;:!?")
#: Code points whose class depends on the age of the Unicode tables; the vocabulary's own library must tell it.
YOUNG = re.compile("[^\x00-\u052F]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from code point 256 on."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(spare)) for b in range(256)]


class Memory(dict):
    """A dictionary that works out what it lacks. When it is full, by bytes, it becomes the older generation, from which entries in
    use come back, and that one is dropped."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.bytes, self.older = make, most, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONG:
            return value
        if self.bytes >= self.most:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self.bytes += len(key) + len(value) + ENTRY
        self[key] = value
        return value


class WordCoder:
    """Encoder and decoder for a vocabulary file with word ends (`end_of_word_suffix`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = dict(model["vocab"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | added).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.rules = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(self.rules)}
        self.letters = letters = byte_letters()
        self.inner = [self.ids[x] for x in letters]
        self.last = [self.ids[x + self.suffix] for x in letters]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.byte_of = {letter: b for b, letter in enumerate(letters)}
        self.path, self.added = path, added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.mark = os.path.commonprefix(list(added))
        self.pieces = Memory(self.merge, PIECES)
        self.chunks = Memory(self.encode_chunk, CHUNKS)

    def merge(self, piece: str) -> bytes:
        return self.merge_bytes(piece.encode("utf-8"))

    def merge_bytes(self, raw: bytes) -> bytes:
        at = [self.inner[b] for b in raw]
        at[-1] = self.last[raw[-1]]
        n, rank_of, rules, push = len(at), self.ranks.get, self.rules, heapq.heappush
        # An entry is rank and position in one number, so the queue compares numbers only.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(at[i] << 32 | at[i + 1])) is not None]
        if queue:
            heapq.heapify(queue)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            at.append(-1)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            left, right, merged = rules[entry >> 32]
            j = after[i] if at[i] == left else n
            if at[j] != right:
                continue  # stale: one of the two has been merged since
            at[i], at[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(merged << 32 | at[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(at[h] << 32 | merged)) is not None:
                push(queue, r << 32 | h)
        return array("I", [x for x in at if x >= 0]).tobytes()

    def split(self, part: str) -> list[str] | None:
        """The pieces of a part without special tokens; None if the library must find them."""
        if not part.isascii():
            if YOUNG.search(part):
                return None
            # Lower case letter by letter: a final sigma is a sigma.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        if part.isalpha():
            return [part]
        if part[-1:] in BEHIND and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.piece.findall(part)

    def split_by_library(self, part: str) -> list[bytes]:
        plain = self.library.normalizer.normalize_str(part)
        return [bytes(map(self.byte_of.__getitem__, letters))
                for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def encode_chunk(self, chunk: bytes) -> bytes:
        """32-bit ids of a run without ASCII white space."""
        text, out = chunk.decode("utf-8"), []
        parts = self.special.split(text) if self.mark in text else (text,)
        for part in parts:
            if part in self.added:
                out.append(array("I", [self.added[part]]).tobytes())
            elif (found := self.split(part)) is not None:
                out += map(self.pieces.__getitem__, found)
            else:
                out += map(self.merge_bytes, self.split_by_library(part))
        return b"".join(out)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> np.ndarray:
        chunks = (text or "").encode("utf-8").split()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), np.uint32)

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder per worker process and vocabulary."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(df: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of `text`, and with `decoded` also the text that those ids decode to. Columns of these names that
    the input has are replaced."""
    names = [ids] + ([decoded] if decoded else [])
    df = df.drop(*(c for c in df.columns if c != text and c.lower() in {n.lower() for n in names}))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]
                          + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def make():
        c = coder(path)

        def step(batch, texts):
            lists = [c.encode(t) for t in texts]
            arrays = [id_lists(lists)]
            if decoded:
                arrays.append(pa.array([c.decode(x.tolist()) for x in lists], pa.string()))
            yield with_arrays(batch, names, arrays)

        return step

    return map_chunks(df, schema, make, text)


def decode(df: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of a column of ids; null ids give null, an empty list the empty string."""
    df = df.drop(*(c for c in df.columns if c.lower() == decoded.lower()))
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        c = coder(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield with_arrays(batch, [decoded], [pa.array([None if x is None else c.decode(x) for x in lists], pa.string())])

    return df.mapInArrow(run, schema)
