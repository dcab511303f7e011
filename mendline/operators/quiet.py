"""Records that never had a gap marker or a fill go past the windows.

Most records of a change stream never have a gap, and all their changes are forwarded. Only who they are must be known, not the
order of their rows, so nothing of them needs to be shuffled or sorted:

1. the keys of all control rows (G and F) go into a Bloom filter, a table with one row per word of 64 bits. A key chooses one word and
   `PROBES` bits in it. It is made by one aggregate over the control rows, merged before the shuffle, and has at most `words`
   rows whatever the input (2^20 words: 8 MB of bits), which is the bound of its broadcast;
2. rows whose key isn't in the filter are forwarded where they were read, a hot key's too;
3. the rest, with some keys that are in it by chance, goes through `gaps`. Such a key costs work and changes no result.

With 2^20 words about 1 in 50 quiet keys is taken for another at 8 million keys with control rows; the filter is of no
use beyond some 50 million, where `words` should grow. The input is read three times: the key and kind of each row for the filter, all
columns for either part. Store it first where it's dear to compute.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.io import stored
from . import gaps
from .ordered import DEFAULT, PART, Layout

#: Words of the filter, and bits of a key in its word.
WORDS = 1 << 20
PROBES = 4


def _word(keys: Sequence[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words)).cast("int")


def _mask(keys: Sequence[str]) -> Column:
    """The key's bits: six bits of a second hash choose each."""
    chosen = F.xxhash64(F.lit(1), *keys)
    one = F.lit(1).cast("bigint")
    place = lambda i: F.shiftrightunsigned(chosen, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, place(i)) for i in range(PROBES)])


def control_filter(rows: DataFrame, keys: Sequence[str] = ("record_id",), words: int = WORDS) -> DataFrame:
    """(_word, _bits): a Bloom filter of the keys that have a G or F row, at most `words` rows."""
    if not keys or words < 1:
        raise ValueError("a filter needs keys and at least one word")
    control = rows.filter(F.col("kind").isin("G", "F"))
    return (control.select(_word(keys, words).alias("_word"), _mask(keys).alias("_m"))
            .groupBy("_word").agg(F.bit_or("_m").alias("_bits")))


def split(rows: DataFrame, keys: Sequence[str] = ("record_id",), words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows of keys that surely have no control row, all others). The filter is stored in the shared folder when this is called."""
    control = F.broadcast(stored(control_filter(rows, keys, words), "control-keys"))
    placed = rows.withColumn("_word", _word(keys, words))
    found = F.col("_bits").bitwiseAND(_mask(keys)) == _mask(keys)
    quiet = placed.join(control, "_word", "left").filter(~F.coalesce(found, F.lit(False)))
    return quiet.select(*rows.columns), placed.join(control, "_word").filter(found).select(*rows.columns)


def _forwarded(quiet: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of quiet keys with the columns of decided rows."""
    known = {"decision": F.lit("forwarded"), "in_gap": F.lit(False), "epoch": F.lit(-1)}
    value = lambda f: F.col(f.name) if f.name in quiet.columns else known.get(f.name, F.lit(None)).cast(f.dataType)
    return quiet.select(*[value(f).alias(f.name) for f in decided.schema if f.name != PART])


def decide(rows: DataFrame, mode: str = "compat", layout: Layout = DEFAULT, *, words: int = WORDS, ts_unit: str = "ms",
           cutoff_unit: str = "ms") -> DataFrame:
    """As `gaps.decide`, without a shuffle of the rows of quiet keys. There is no `part`: operators that order the result cut
    hot keys by a count of their own."""
    quiet, rest = split(rows, layout.keys, words)
    decided = gaps.decide(rest, mode, layout, ts_unit=ts_unit, cutoff_unit=cutoff_unit)
    return decided.drop(PART).unionByName(_forwarded(quiet, decided))


def cdc_output(rows: DataFrame, mode: str = "compat", layout: Layout = DEFAULT, keep: Sequence[str] = (), *, words: int = WORDS,
               ts_unit: str = "ms", cutoff_unit: str = "ms") -> DataFrame:
    """The repaired stream, as `gaps.cdc_output` of `gaps.decide`: rows of quiet keys are a projection of the input."""
    quiet, rest = split(rows, layout.keys, words)
    decided = gaps.decide(rest, mode, layout, ts_unit=ts_unit, cutoff_unit=cutoff_unit)
    repaired = gaps.cdc_output(decided, mode, layout, keep, cutoff_unit)
    unplaced = _forwarded(quiet, decided).withColumn("pos", F.lit(None).cast("bigint"))
    return repaired.unionByName(gaps.emitted(unplaced, mode, keep, cutoff_unit))
