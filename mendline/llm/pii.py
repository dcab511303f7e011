"""Personal data by bootstrapped contextual extraction.

Rules find the base spans (e-mail, IP address, card and phone numbers). They are the seeds: the one or two words before them
are candidate patterns. A pattern that ends inside a word, glued to what follows (a quote, a bracket, `id#`), is another one than the same
words with white space behind. A pattern is scored on a graph of patterns and of the identifier-like strings behind them: its
confidence for a kind is the share of all its occurrences, whatever follows, that are followed by instances of
that kind, weighted by the instances' scores; an instance that no rule knows gets the mean confidence of its patterns. Occurrences are counted
at every place of a text as `contexts` cuts it, so each instance stands behind one of them. Spark repeats the two
steps over the whole graph. Patterns of high confidence then mark identifier-like strings that no rule found.

A pattern must precede at least `LEAST` seeds of a kind, whatever else the input holds. Patterns are as many as the input has, so they stay in
tables: the graph is joined with them, and of those accepted each text gets, by its digest, the ones that stand before its own candidates. Only a
filter of fixed size goes to all tasks; what it lets through in error the joins drop.

Null text counts as empty and has no spans. Positions are code points, ends exclusive. Base spans always stay; an added span never overlaps
one. Repeated rows are rows of their own, and count as often as they occur. Columns of the input are kept; one named `spans` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mendline.llm.common import free_name, map_chunks, with_arrays
from mendline.sources.io import stored

#: Fixed values of the contract: kinds in order, and the rules for each.
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive, and only where a run of digits begins: elsewhere it could not match either, but would look for long.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: A pattern precedes at least this many of a kind's seeds.
LEAST = 5
CONFIDENCE = 0.6
ROUNDS = 3
#: Words of a pattern are cut behind white space, colons and equals signs.
WORD = re.compile(r"[^\s:=]+[:=]?|[:=]")
#: Characters in which a pattern's words are looked for, from its end back.
REACH = 200
#: Ends a pattern that stands inside a word; no word holds it.
GLUED = "\n"
#: Characters whose places are counted at once.
PIECE = 1 << 17
#: Bits of the filter that tells which places are worth a look; its size sets the work, never the result.
FILTER_BITS = 1 << 23
#: Strings that look like identifiers: around an at sign, or at least six digits with separators between.
AT = re.compile(r"@|\(at\)|\[at\]")
AROUND_AT = re.compile(r"[^\s:=<>\"'(),;@]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,}")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType()), T.StructField("added", T.BooleanType())])


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of local part, at sign and domain, found from the at signs: a local part that runs up to an at
    sign without a domain has no other way to match."""
    done, at = 0, text.find("@")
    while at >= 0:
        tail = EMAIL_TAIL.match(text, at)
        start = at
        while start > done and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        if tail and start < at:
            yield start, tail.end()
            done = tail.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all that the rules find, in order of start and kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def kinds_like(string: str) -> list[int]:
    """The kinds that a string's form admits."""
    if "@" in string or "at" in string:
        return [0]
    digits = len(NOT_DIGIT.sub("", string))
    dotted = string.count(".") == 3 and not re.search(r"[^0-9.]", string)
    return [1] * dotted + [2] * (12 <= digits <= 19 and not dotted) + [3] * (6 <= digits <= 15 and not dotted)


def like_strings(text: str):
    """(start, end) of identifier-like strings, the numbers last."""
    done = 0
    for m in AT.finditer(text):
        s, e = m.span()
        if s < done:
            continue  # within the string before; so no stretch is scanned more than twice
        while s > done and AROUND_AT.match(text, s - 1):
            s -= 1
        while e < len(text) and AROUND_AT.match(text, e):
            e += 1
        e = m.end() + len(text[m.end():e].rstrip(".!?"))
        if s < m.start() and e > m.end():
            yield s, e
            done = e
    yield from (m.span() for m in NUMBER.finditer(text))


def like_spans(text: str, base: list[tuple[int, int, int]]):
    """(start, end) of identifier-like strings that touch neither a base span nor one before."""
    taken: list[tuple[int, int]] = []  # disjoint, ascending
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(e, taken[-1][1])
        else:
            taken.append((s, e))
    for s, e in like_strings(text):
        i = bisect_left(taken, (s, e))
        if (i == len(taken) or e <= taken[i][0]) and (i == 0 or taken[i - 1][1] <= s):
            taken.insert(i, (s, e))
            yield s, e


def folded(text: str) -> str:
    """Small letters, character by character, so that a part folds as it does within the whole."""
    low = text.lower()
    if len(low) == len(text) and "\u03a3" not in text:
        return low
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def contexts(text: str, start: int) -> list[str]:
    """The last word before a place, and the last two; `GLUED` behind them if the place is inside a word."""
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    words = WORD.findall(folded(text[max(0, end - REACH):end]))[-2:]
    if not words:
        return []
    mark = GLUED if end == start < len(text) and not text[start].isspace() and text[start - 1] not in ":=" else ""
    return [words[-1] + mark, " ".join(words) + mark][: len(words)]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Places:
    """Contexts at all places of texts, known by 64-bit hashes."""

    BASE, SECOND, INSIDE = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

    def __init__(self):
        n = 2 * (PIECE + REACH + 2)
        self.up, self.down = (np.full(n, x, np.uint64) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        for x in (self.up, self.down):
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        self.letters = np.random.default_rng(9).integers(1, 1 << 63, 0x110000, np.uint64) * np.uint64(2) + np.uint64(1)
        self.space = np.zeros(0x110000, bool)
        self.space[[c for c in range(0x3001) if chr(c).isspace()]] = True

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed(((prefix[end] - prefix[start]) * self.down[start]) ^ (end - start).astype(np.uint64))

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.letters[codes] * self.up[:len(codes)], out=out[1:])
        return out

    def of_context(self, context: str) -> int:
        return int(self.of_contexts([context])[0])

    def of_contexts(self, contexts: list[str]) -> np.ndarray:
        """The hashes that `count` finds for contexts."""
        out = [np.zeros(0, np.uint64)]
        most = PIECE // (2 * REACH + 2) or 1
        for i in range(0, len(contexts), most):
            some = contexts[i:i + most]
            words = [c.removesuffix(GLUED).rpartition(" ") for c in some]
            prefix = self.prefix(codes_of("".join(a + b for a, _, b in words)))
            sizes = np.array([(len(a), len(b)) for a, _, b in words])
            end = np.cumsum(sizes).reshape(-1, 2)
            before, last = (self.of(prefix, end[:, k] - sizes[:, k], end[:, k]) for k in (0, 1))
            h = np.where(sizes[:, 0] > 0, _mixed(before * self.SECOND + last), last)
            out.append(np.where([c.endswith(GLUED) for c in some], _mixed(h ^ self.INSIDE), h))
        return np.concatenate(out)

    def pieces(self, texts: list[str]):
        """Texts, long ones cut, in lists of about PIECE characters: (piece, first and last place that counts). A cut piece
        has REACH characters before and one behind."""
        held, size = [], 0
        for t in texts:
            for i in range(0, len(t), PIECE):
                a, b = max(0, i - REACH), min(len(t), i + PIECE)
                if size + b - a >= PIECE and held:
                    yield held
                    held, size = [], 0
                held.append((t[a:b + 1], i - a, b - a))
                size += len(held[-1][0]) + 1
        if held:
            yield held

    def count(self, texts: list[str], known: np.ndarray) -> Counter:
        """How often each context that passes the filter occurs."""
        out = Counter()
        for held in self.pieces(texts):
            line = folded("\n".join(p for p, _, _ in held) + "\n")
            codes = codes_of(line)
            lengths = np.array([len(p) + 1 for p, _, _ in held])
            offsets = np.cumsum(lengths) - lengths
            space, cut = self.space[codes], (codes == ord(":")) | (codes == ord("="))
            after = np.ones(len(codes), bool)
            after[1:] = space[:-1] | cut[:-1]
            first = after & ~space
            starts = np.flatnonzero(first)
            ends = np.flatnonzero(~space & (cut | np.append(space[1:], True))) + 1
            piece = np.searchsorted(offsets, starts, side="right")
            alone = np.ones(len(starts), bool)
            alone[1:] = piece[1:] != piece[:-1]
            counted = ~space
            for o, (_, a, b), n in zip(offsets.tolist(), held, lengths.tolist()):
                counted[o:o + a] = False
                counted[o + b:o + n] = False
            word = (np.cumsum(first) - 1)[counted]
            end = np.flatnonzero(counted) + 1
            inside = ~(space[end] | cut[end - 1])
            start = np.maximum(starts[word], end - REACH)
            prefix = self.prefix(codes)
            one = self.of(prefix, start, end)
            two = np.flatnonzero(~alone[word] & (ends[word - 1] > end - REACH))
            before = np.maximum(starts[word[two] - 1], end[two] - REACH)
            both = _mixed(self.of(prefix, before, ends[word[two] - 1]) * self.SECOND + one[two])
            for hashes, at in ((one, None), (both, two)):
                glued = inside if at is None else inside[at]
                hashes = np.where(glued, _mixed(hashes ^ self.INSIDE), hashes)
                hit = np.flatnonzero(passes(known, hashes))
                _, rep, n = np.unique(hashes[hit], return_index=True, return_counts=True)
                for i, times in zip(hit[rep].tolist(), n.tolist()):
                    j = i if at is None else at[i]
                    text = line[start[j]:end[j]] + GLUED * bool(inside[j])
                    out[text if at is None else f"{line[before[i]:ends[word[j] - 1]]} {text}"] += times
        return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def filter_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def passes(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = filter_places(hashes)
    out = known[a >> 3] >> (a & 7) & 1 == 1
    at = np.flatnonzero(out)
    out[at] = known[b[at] >> 3] >> (b[at] & 7) & 1 == 1
    return out


def filter_of(hashes: np.ndarray | list[int]) -> np.ndarray:
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for at in filter_places(np.array(hashes, np.uint64)):
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def filter_of_table(patterns: DataFrame) -> np.ndarray:
    """The filter of the table's contexts. At most FILTER_BITS / 64 rows come to the driver, whatever the table's size."""

    def cut(batches):
        places, out = Places(), np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            out |= filter_of(places.of_contexts(batch.column(0).to_pylist()))
        words = out.view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at], pa.int64())], names=["slot", "bits"])

    rows = patterns.select("context").mapInArrow(cut, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def induced(df: DataFrame, text: str) -> DataFrame:
    """Contexts that precede enough seeds of a kind."""

    def make():
        def step(batch, texts):
            found = Counter((k, c) for t in texts for s, k, _ in base_spans(t or "") for c in contexts(t, s))
            rows = [(k, c, n) for (k, c), n in found.items()]
            kind, context, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(context, pa.string()), pa.array(n, pa.int64())],
                                             names=["kind", "context", "n"])

        return step

    counts = map_chunks(df.select(text), "kind int, context string, n long", make, text).groupBy("kind", "context").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= LEAST).select("context").distinct(), "pii-contexts")


def passing(places: Places, known: np.ndarray, found: list[list[str]]) -> set[str]:
    """Those of the contexts that pass the filter."""
    names = list({c for cs in found for c in cs})
    return {names[i] for i in np.flatnonzero(passes(known, places.of_contexts(names))).tolist()}


def graph(df: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """Edges (context, instance, kind, seed, n): a kind of -1 counts all occurrences of the context, whatever follows."""
    known = df.sparkSession.sparkContext.broadcast(filter_of_table(patterns))  # of fixed size

    def make():
        places = Places()

        def step(batch, texts):
            texts = [t or "" for t in texts]
            found = Counter({(c, "", -1, False): n for c, n in places.count(texts, known.value).items()})
            links = []  # (contexts, instance, kinds, seed)
            for t in texts:
                base = base_spans(t)
                links += [(contexts(t, s), t[s:e], [k], True) for s, k, e in base]
                links += [(contexts(t, s), t[s:e], kinds_like(t[s:e]), False) for s, e in like_spans(t, base)]
            wanted = passing(places, known.value, [x[0] for x in links])
            for cs, instance, kinds, seed in links:
                found.update((c, instance, k, seed) for c in cs if c in wanted for k in kinds)
            rows = [(*key, n) for key, n in found.items()]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["context", "instance", "kind", "seed", "n"])

        return step

    edges = map_chunks(df.select(text), "context string, instance string, kind int, seed boolean, n long", make, text)
    edges = edges.groupBy("context", "instance", "kind", "seed").agg(F.sum("n").alias("n"))
    return stored(edges.join(patterns, "context", "left_semi"), "pii-graph")


def learn(df: DataFrame, *, text: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Patterns of high confidence as a table (context, kind), each with the number of its kind."""
    patterns = induced(df, text)
    if patterns.isEmpty():
        return patterns.withColumn("kind", F.lit(0))
    edges = graph(df, patterns, text)
    totals = edges.where("kind = -1").groupBy("context").agg(F.sum("n").alias("total"))
    links = edges.where("kind >= 0")
    scores = links.where("seed").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    for i in range(rounds):
        scored = links.join(scores, ["instance", "kind"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        trust = (scored.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"))
                 .join(totals, "context").select("context", "kind", (F.col("hits") / F.col("total")).alias("trust")))
        trust = stored(trust, "pii-trust")
        if i + 1 < rounds:
            means = (links.join(trust, ["context", "kind"]).groupBy("instance", "kind")
                     .agg((F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("mean"), F.max("seed").alias("seed")))
            scores = stored(means.select("instance", "kind", F.when(F.col("seed"), 1.0).otherwise(F.col("mean")).alias("score")), "pii-scores")
    best = trust.where(F.col("trust") >= confidence).groupBy("context").agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind"))
    return stored(best, "pii-patterns")


def bootstrap(df: DataFrame, **options) -> dict[str, int]:
    """The patterns of `learn` as a dictionary, for a look at small inputs."""
    return {r.context: r.kind for r in learn(df, **options).collect()}


def before_candidates(df: DataFrame, patterns: DataFrame, text: str, key: str, found: str) -> DataFrame:
    """By the digest of each text: the patterns before its candidates."""
    known = df.sparkSession.sparkContext.broadcast(filter_of_table(patterns))  # of fixed size

    def make():
        places = Places()

        def step(batch, texts):
            rows = [(d, {c for s, _ in like_spans(t, base_spans(t)) for c in contexts(t, s)})
                    for d, t in zip(batch.column(batch.schema.get_field_index(key)).to_pylist(), texts) if t]
            wanted = passing(places, known.value, [cs for _, cs in rows])
            rows = [(d, c) for d, cs in rows for c in cs if c in wanted]
            cols = list(zip(*rows)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=[key, "context"])

        return step

    places = map_chunks(df.select(text, F.sha2(text, 256).alias(key)), f"`{key}` string, context string", make, text).distinct()
    return stored(places.join(patterns, "context").groupBy(key).agg(F.collect_list(F.struct("context", "kind")).alias(found)), "pii-found")


def spans_of(text: str | None, patterns: dict[str, int]) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, added) in order."""
    if not text:
        return []
    base = base_spans(text)
    out = [(s, k, e, False) for s, k, e in base]
    if patterns:
        for s, e in like_spans(text, base):
            for c in reversed(contexts(text, s)):
                if (k := patterns.get(c, -1)) in kinds_like(text[s:e]):
                    out.append((s, k, e, True))
                    break
    return sorted(out)


def masked(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    if not spans:
        return text
    out, done = [], 0
    for s, k, e, _ in spans:
        if s >= done:
            out += [text[done:s], f"<{KINDS[k]}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def masked(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    if not spans:
        return text
    out, done = [], 0
    for s, k, e, _ in spans:
        if s >= done:
            out += [text[done:s], f"<{KINDS[k]}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def find(df: DataFrame, patterns: DataFrame | dict[str, int], *, text: str = "text", mask: bool = False) -> DataFrame:
    """Add `spans`; with `mask`, put the masked text in the text's place. A table of patterns is joined by the texts' digests."""
    df = df.drop(*(c for c in df.columns if c.lower() == "spans"))
    schema = T.StructType([*df.schema.fields, T.StructField("spans", T.ArrayType(SPAN))])
    columns = df.columns
    own = free_name(df, "own_patterns")
    if isinstance(patterns, DataFrame):
        key = free_name(df, "text_key")
        df = (df.withColumn(key, F.sha2(text, 256)).join(before_candidates(df, patterns, text, key, own), key, "left")
              .select(*columns, own))
        patterns = None

    def make():
        def step(batch, texts):
            if patterns is None:
                each = [{x["context"]: x["kind"] for x in xs or ()} for xs in batch.column(batch.schema.get_field_index(own)).to_pylist()]
                batch = batch.select(columns)
            else:
                each = [patterns] * len(texts)
            found = [spans_of(t, p) for t, p in zip(texts, each)]
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "added": a} for s, k, e, a in x] for x in found],
                             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])))
            if mask:
                at = batch.schema.get_field_index(text)
                batch = batch.set_column(at, text, pa.array([masked(t, x) for t, x in zip(texts, found)], pa.string()))
            yield with_arrays(batch, ["spans"], [spans])

        return step

    return map_chunks(df, schema, make, text)


def extract(df: DataFrame, *, text: str = "text", mask: bool = False) -> DataFrame:
    """Learn patterns on the input, then find all spans in it."""
    patterns = learn(df, text=text)
    return find(df, {} if patterns.isEmpty() else patterns, text=text, mask=mask)
