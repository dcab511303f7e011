"""The gap rules with a timeout and a buffer limit, as joins and windows.

With limits a gap may fail before its fill comes, and a later G of the same epoch then opens another one. So
which G rows open a gap depends on the G rows before them - a chain. But if a given G opens a gap, where that
gap ends, and hence which G opens the next one, follows from that G alone:

1. each G gets a link to the G that would open next (first G after the timeout or the overflowing row, within
   the epoch, since a fill always ends the chain);
2. the chain from the first G of every epoch is followed by doubling the links: after k rounds all gaps up to
   the 2^k-th of an epoch are known. Rounds end when none is added; few epochs need more than one;
3. the opening rows are merged back into the rows, which then need one look at the last opening before them
   and the next fill after them.

No step gathers a record in one task. Link joins are on (record, seq), which is unique. Where arrival times run
backwards within a record, the latest time so far counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import to_millis
from ..sources.io import stored
from .gaps import _check, fill_succeeded, opens_or_closes, received_at
from .ordered import DEFAULT, PART, Layout, scan


def _links(rows: DataFrame, timeout_ms: int | None, max_buffer: int | None, layout: Layout) -> DataFrame:
    """Per G row: epoch, whether it is the epoch's first, the row its gap would overflow on (`over_seq`)
    and the G that would open next (`next_seq`)."""
    is_gap, is_fill = F.col("kind") == "G", F.col("kind") == "F"
    seen = scan(rows.select("record_id", "seq", "kind", "arrived"), layout,
                before={"_open": opens_or_closes(),
                        "epoch": F.when(is_fill, F.col("seq"))},
                after={"_gap_after": F.when(is_gap, F.col("seq")), "_fill_after": F.when(is_fill, F.col("seq"))},
                count_before={"_n": F.col("kind") == "N"}).drop(PART)
    seen = seen.withColumn("epoch", F.coalesce("epoch", F.lit(-1)))
    gaps = seen.filter(is_gap).select(
        "record_id", "seq", "epoch", "arrived", "_n",
        (~F.coalesce(F.col("_open"), F.lit(False))).alias("first"))

    if max_buffer is None:
        gaps = gaps.withColumns({"over_seq": F.lit(None).cast("bigint"), "_over_next": F.lit(None).cast("bigint")})
    else:
        # The change that has exactly max_buffer others between the gap marker and itself.
        same_epoch = F.col("_fill_after").isNull() | (F.col("_gap_after") < F.col("_fill_after"))
        over = seen.filter(F.col("kind") == "N").select(
            "record_id", "epoch", (F.col("_n") - max_buffer).alias("_n"), F.col("seq").alias("over_seq"),
            F.col("arrived").alias("_over_at"), F.when(same_epoch, F.col("_gap_after")).alias("_over_next"))
        gaps = gaps.join(over, ["record_id", "epoch", "_n"], "left")
        if timeout_ms is not None:
            in_time = F.col("_over_at") <= F.col("arrived") + timeout_ms
            gaps = gaps.withColumn("over_seq", F.when(in_time, F.col("over_seq")))
        gaps = gaps.drop("_over_at")

    if timeout_ms is None:
        expired_next = F.lit(None).cast("bigint")
    else:
        gaps = _first_gap_after(stored(gaps), timeout_ms, layout)
        expired_next = F.when(F.col("_hit.epoch") == F.col("epoch"), F.col("_hit.seq"))
    following = F.when(F.col("over_seq").isNotNull(), F.col("_over_next")).otherwise(expired_next)
    return gaps.select("record_id", "seq", "epoch", "arrived", "first", "over_seq", following.alias("next_seq"))


def _first_gap_after(gaps: DataFrame, timeout_ms: int, layout: Layout) -> DataFrame:
    """Add `_hit`: the first G of the record that arrives later than `timeout_ms` after this one."""
    row = F.struct(*gaps.columns)
    entry = lambda rank, at, asks: F.struct(at.alias("at"), F.lit(rank).alias("rank"), asks.alias("ask"))
    # Each G stands for itself at its time and asks at its deadline; at equal times the asker comes last, so
    # that only later rows count.
    both = gaps.select("record_id", "seq", row.alias("row"), F.explode(F.array(
        entry(0, F.col("arrived"), F.lit(False)),
        entry(1, F.col("arrived") + timeout_ms, F.lit(True)))).alias("e")).select("record_id", "seq", "row", "e.*")
    by_time = layout.ordered("at", "rank", "seq")
    found = scan(both, by_time, after={"_hit": F.when(~F.col("ask"), F.struct("seq", "row.epoch"))})
    return found.filter("ask").select("row.*", "_hit")


def _follow(links: DataFrame) -> DataFrame:
    """(record_id, seq) of every G on a chain that starts at the first G of an epoch."""
    reached = [links.filter("first").select("record_id", "seq")]
    jump = links.filter(F.col("next_seq").isNotNull()).select("record_id", "seq", "next_seq")
    while True:
        known = reduce(DataFrame.unionByName, reached)
        new = stored(known.join(jump, ["record_id", "seq"]).select("record_id", F.col("next_seq").alias("seq")))
        if new.isEmpty():
            return known
        reached.append(new)
        then = jump.select("record_id", F.col("seq").alias("next_seq"), F.col("next_seq").alias("_then"))
        jump = stored(jump.join(then, ["record_id", "next_seq"]).select(
            "record_id", "seq", F.col("_then").alias("next_seq")))


def decide_limited(rows: DataFrame, timeout_ms: int | None = None, max_buffer: int | None = None,
                   mode: str = "compat", layout: Layout = DEFAULT, *, as_of: int | None = None, ts_unit: str = "ms",
                   cutoff_unit: str = "ms") -> DataFrame:
    """As `gaps.decide`, with gaps that fail after `timeout_ms` or beyond `max_buffer` held-back rows.

    `rows` needs `arrived` (milliseconds). Rows of a failed gap become `dead_letter`; a `command` row whose
    gap fails carries the reason in `failed`; fills that come too late are `fill_ignored` with `late`.
    `epoch`, `in_gap` and the closing fill are as from `gaps.decide`, so the outputs and counters take the result; `fail_seq` is
    the gap whose failure made a row a dead letter. `arrived` becomes the latest arrival so far.
    A quiet record's gap fails if `as_of`, an instant in milliseconds, is beyond its deadline.
    The chain of gaps is found by a few jobs when this is called, stored in the shared folder.
    """
    _check(mode)
    strict = mode == "strict"
    columns = rows.columns
    late_so_far = scan(rows, layout, max_before={"_latest": F.col("arrived")})
    rows = late_so_far.withColumn("arrived", F.greatest("arrived", "_latest")).select(*columns)
    links = stored(_links(rows, timeout_ms, max_buffer, layout))
    opened = _follow(links).join(links, ["record_id", "seq"]).select(
        "record_id", "seq", F.lit(0).alias("rank"),
        F.struct("seq", "arrived", "epoch", "over_seq").alias("opening"))
    merged = rows.withColumn("rank", F.lit(1)).unionByName(opened, allowMissingColumns=True)
    if timeout_ms is not None:
        # One closing row per record tells whether any row arrived after a deadline.
        now = F.lit(as_of).cast("bigint")
        last = rows.groupBy("record_id").agg((F.max("seq") + 1).alias("seq"), F.greatest(F.max("arrived"), now).alias("arrived"))
        merged = merged.unionByName(last.withColumns({"rank": F.lit(2), "kind": F.lit("E")}), allowMissingColumns=True)

    # One number for (seq, rank): an opening comes before its row, the closing row after all others.
    merged = merged.withColumn("place", F.col("seq") * 3 + F.col("rank"))
    by_place = layout.ordered("place")

    is_fill = F.col("kind") == "F"
    end = F.struct(is_fill.alias("fill"), "arrived", "cutoff", fill_succeeded().alias("ok"), "seq", received_at(rows).alias("came"))
    seen = scan(merged, by_place,
                before={"_open": F.col("opening"), "epoch": F.when(is_fill, F.col("seq"))},
                after={"_end": F.when(F.col("kind").isin("F", "E"), end)}).filter(F.col("rank") == 1)

    epoch = F.coalesce(F.col("epoch"), F.lit(-1))
    has_open = F.coalesce(F.col("_open.epoch") == epoch, F.lit(False))
    deadline = F.col("_open.arrived") + F.lit(timeout_ms)
    in_time = F.lit(True) if timeout_ms is None else F.col("arrived") <= deadline
    live = has_open & in_time & (F.col("_open.over_seq").isNull() | (F.col("seq") <= F.col("_open.over_seq")))
    expires = F.lit(False) if timeout_ms is None else F.coalesce(F.col("_end.arrived") > deadline, F.lit(False))
    reason = F.when(F.col("_open.over_seq").isNotNull(), "overflow").when(expires, "timeout")

    filled = F.coalesce(F.col("_end.fill"), F.lit(False))
    ts, cutoff = F.col("ts"), F.col("_end.cutoff")
    if strict:
        ts, cutoff = to_millis(ts, ts_unit), to_millis(cutoff, cutoff_unit)
    fate = F.when(reason.isNotNull(), "dead_letter").when(~filled, "pending")
    if strict:
        fate = fate.when(~F.col("_end.ok"), "dead_letter")
    fate = fate.when(F.coalesce(ts > cutoff, F.lit(False)), "flushed").otherwise("dropped")
    on_fill = F.when(F.lit(strict) & ~fill_succeeded(), "fill_error").when(live, "filled")
    if strict and "force" in rows.columns:
        on_fill = on_fill.when(F.coalesce(F.col("force"), F.lit(False)), "forced")
    opens = has_open & (F.col("_open.seq") == F.col("seq"))
    decision = (F.when(is_fill, on_fill.otherwise("fill_ignored"))
                .when(F.col("kind") == "G", F.when(opens, "command").otherwise("gap_dropped"))
                .when(live, fate).otherwise("forwarded"))
    held = live & (F.col("kind") == "N")
    closed = held & filled & reason.isNull()
    return seen.withColumns({
        "decision": decision,
        "in_gap": live & ~opens,
        "epoch": epoch,
        "close_seq": F.when(closed, F.col("_end.seq")),
        "close_cutoff": F.when(closed, F.col("_end.cutoff")),
        "close_at": F.when(closed, F.col("_end.came")),
        "fail_seq": F.when(held & reason.isNotNull(), F.col("_open.seq")),
        "failed": F.when(opens, reason),
        "late": is_fill & has_open & ~live,
    }).select(*columns, "decision", "in_gap", "epoch", "close_seq", "close_cutoff", "close_at", "fail_seq", "failed", "late")


def failed_gaps(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("failed").isNotNull()).select(
        "record_id", F.col("seq").alias("open_seq"), "entity", "event_id", "failed")


def late_fills(decided: DataFrame) -> DataFrame:
    return decided.filter("late").select("record_id", "seq", "cutoff", "decision")


def reissue(decided: DataFrame) -> DataFrame:
    """New commands for records whose last gap failed and that were not filled since."""
    mended = F.col("decision").isin("filled", "forced")
    gap = F.struct("seq", F.col("entity").alias("entity_type"), "event_id", "failed")
    last = decided.filter(F.col("failed").isNotNull() | mended).groupBy("record_id").agg(
        F.max(F.when(F.col("failed").isNotNull(), gap)).alias("g"),
        F.max(F.when(mended, F.col("seq"))).alias("mended_seq"))
    return last.filter(F.col("g").isNotNull() & (F.coalesce("mended_seq", F.lit(-1)) < F.col("g.seq"))).select(
        "record_id", "g.entity_type", "g.event_id", F.col("g.seq").alias("open_seq"), "g.failed")
