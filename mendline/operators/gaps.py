"""The gap rules as window queries over a table of tagged rows.

A tagged row is a change event or a fill event of one record:

    record_id, seq                 key and order (unique number within the record)
    kind                           N change, G gap marker, F fill event
    event_id, entity, ts, payload  of the event (payload: field map as JSON text)
    cutoff, is_success, err        of a fill event, null otherwise
    force                          of a fill event, optional
    type, replay_id, gap, rec_ts   of the event as received, optional; passed on unchanged

A fill always leaves its record without an open gap, whether it found one or not. Two consecutive fills
of a record therefore enclose one `epoch` (named by the earlier fill's seq, -1 before the first), and an
epoch holds at most one gap: from its first G to the fill that ends it. Every rule below follows from the
last control row (G or F) before a row, the last fill before it and the next fill after it.

mode="compat" keeps the behaviour of the system this replaces, quirks included; mode="strict" follows its
documented intent: failed fills go to the error output, buffered rows are replayed in order of arrival, times count in
their source's unit, and a forced fill is emitted without a gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions import to_millis
from ..sources.io import stored
from .ordered import DEFAULT, PART, Layout, number_rows, scan

MODES = ("compat", "strict")
GAP_TYPE = S.GAP_INFO.simpleString()


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def fill_succeeded() -> Column:
    """Older producers leave the flag out; a cutoff that is not negative then means success."""
    return F.coalesce(F.col("is_success"), F.col("cutoff") >= 0, F.lit(False))


def received_at(rows: DataFrame) -> Column:
    """When a row came in, if the table tells."""
    return F.col("rec_ts") if "rec_ts" in rows.columns else F.lit(None).cast("bigint")


def _optional(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def opens_or_closes() -> Column:
    """True for a control row after which a gap is open, false for one after which none is, else null."""
    return F.when(F.col("kind") != "N", F.col("kind") == "G")


def in_gap(rows: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Add `in_gap`: does the record have an open gap just before this row?"""
    return (scan(rows, layout, before={"in_gap": opens_or_closes()})
            .withColumn("in_gap", F.coalesce("in_gap", F.lit(False))))


def decide(rows: DataFrame, mode: str = "compat", layout: Layout = DEFAULT, *, ts_unit: str = "ms",
           cutoff_unit: str = "ms") -> DataFrame:
    """Add `decision`, `in_gap`, `epoch` and the closing fill (`close_seq`, `close_cutoff`, `close_at`) of buffered rows.
    In strict the units of event times and cutoffs count; "guess" tells seconds by their size."""
    _check(mode)
    strict = mode == "strict"
    is_fill = F.col("kind") == "F"
    fill = F.struct(F.col("seq").alias("seq"), F.col("cutoff").alias("cutoff"),
                    fill_succeeded().alias("ok"), received_at(rows).alias("came"))
    seen = scan(rows, layout,
                before={"in_gap": opens_or_closes(),
                        "epoch": F.when(is_fill, F.col("seq"))},
                after={"_fill": F.when(is_fill, fill)})
    gap = F.coalesce(F.col("in_gap"), F.lit(False))
    ts, cutoff = F.col("ts"), F.col("_fill.cutoff")
    if strict:
        ts, cutoff = to_millis(ts, ts_unit), to_millis(cutoff, cutoff_unit)

    fate = F.when(F.col("_fill").isNull(), "pending")
    if strict:
        fate = fate.when(~F.col("_fill.ok"), "dead_letter")
    fate = fate.when(F.coalesce(ts > cutoff, F.lit(False)), "flushed").otherwise("dropped")

    on_fill = F.when(F.lit(strict) & ~fill_succeeded(), "fill_error").when(gap, "filled")
    if strict and "force" in rows.columns:
        on_fill = on_fill.when(F.coalesce(F.col("force"), F.lit(False)), "forced")
    on_fill = on_fill.otherwise("fill_ignored")

    decision = (F.when(is_fill, on_fill)
                .when(F.col("kind") == "G", F.when(gap, "gap_dropped").otherwise("command"))
                .when(~gap, "forwarded")
                .otherwise(fate))
    buffered = gap & (F.col("kind") == "N")
    return (seen.withColumns({
        "in_gap": gap,
        "decision": decision,
        "epoch": F.coalesce(F.col("epoch"), F.lit(-1)),
        "close_seq": F.when(buffered, F.col("_fill.seq")),
        "close_cutoff": F.when(buffered, F.col("_fill.cutoff")),
        "close_at": F.when(buffered, F.col("_fill.came")),
    }).drop("_fill"))


def replayed(decided: DataFrame, mode: str = "compat", layout: Layout = DEFAULT) -> DataFrame:
    """Add `pos`: place of a flushed row in the replay after its fill (newest first in compat), else null."""
    _check(mode)
    return number_rows(decided, "pos", "epoch", layout, where=F.col("decision") == "flushed",
                       newest_first=mode == "compat")


def cdc_output(decided: DataFrame, mode: str = "compat", layout: Layout = DEFAULT,
               keep: Sequence[str] = (), cutoff_unit: str = "ms") -> DataFrame:
    """The repaired stream: forwarded rows unchanged, synthetic fill rows, and replayed rows, which go out with the
    time at which their fill came in.

    (`out_seq`, `out_pos`) is the order of emission within a record; `out_seq` is the row that caused it.
    One pass: each emitted row is the projection of one input row, so no union of branches is needed.
    `keep` names further columns to pass on.
    """
    return emitted(replayed(decided, mode, layout).filter(F.col("decision").isin(*S.EMITTED)), mode, keep, cutoff_unit)


def emitted(rows: DataFrame, mode: str = "compat", keep: Sequence[str] = (), cutoff_unit: str = "ms") -> DataFrame:
    """Emitted rows, with their places in the replay (`pos`), as they go out."""
    strict = mode == "strict"
    made = F.col("decision").isin("filled", "forced")
    nothing = F.lit(None)
    return rows.select(
        "record_id",
        F.coalesce("close_seq", "seq").alias("out_seq"),
        F.coalesce("pos", F.lit(0)).alias("out_pos"),
        "seq",
        F.when(made, "F").otherwise(F.coalesce(_optional(rows, "type", "string"), "kind")).alias("type"),
        F.when(made, nothing if not strict else F.col("event_id")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(made, F.col("entity") if strict else F.col("record_id").cast("string"))
         .otherwise(F.col("entity")).alias("entity"),
        F.when(made, to_millis(F.col("cutoff"), cutoff_unit) if strict else nothing)
         .otherwise(F.col("ts")).cast("bigint").alias("ts"),
        F.coalesce("close_at", received_at(rows)).alias("rec_ts"),
        F.when(made, F.lit(0).cast("bigint")).otherwise(_optional(rows, "replay_id", "bigint")).alias("replay_id"),
        F.when(~made, _optional(rows, "gap", GAP_TYPE)).alias("gap"),
        "payload",
        *keep,
    )


def fill_commands(decided: DataFrame) -> DataFrame:
    """One request for a full image per opened gap."""
    return decided.filter(F.col("decision") == "command").select(
        "record_id", F.col("entity").alias("entity_type"), "event_id", "seq")


def synthetic_fills(decided: DataFrame, mode: str = "compat", cutoff_unit: str = "ms") -> DataFrame:
    """The F rows on their own; unlike the full output this needs no replay positions."""
    strict = mode == "strict"
    kept = decided.filter(F.col("decision").isin("filled", "forced"))
    return kept.select(
        "record_id", "seq", F.lit("F").alias("type"),
        (F.col("entity") if strict else F.col("record_id").cast("string")).alias("entity"),
        (F.col("event_id") if strict else F.lit(None).cast("string")).alias("event_id"),
        (to_millis(F.col("cutoff"), cutoff_unit) if strict else F.lit(None)).cast("bigint").alias("ts"),
        "payload")


def error_output(decided: DataFrame) -> DataFrame:
    """Failed fills, failed gaps, and the rows that were waiting for them. A gap that failed has a row of its own beside
    that of its command."""
    failed = F.col("failed") if "failed" in decided.columns else F.lit(None).cast("string")
    gap_failed = F.when((F.col("decision") == "command") & failed.isNotNull(), "gap_failed")
    cause = F.coalesce("fail_seq", "close_seq") if "fail_seq" in decided.columns else F.col("close_seq")
    rows = decided.withColumn("decision", F.coalesce(gap_failed, "decision"))
    return rows.filter(F.col("decision").isin(*S.ERRORS)).select(
        "record_id", "seq", "kind", "decision", cause.alias("cause_seq"),
        F.when(F.col("kind") == "F", F.col("err")).otherwise(failed).alias("message"), "payload")


def pending(decided: DataFrame) -> DataFrame:
    """Rows still held back: no fill has come yet."""
    return decided.filter(F.col("decision") == "pending")


def episodes(decided: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """One row per opened gap: where it opened and closed and what became of the rows in between.

    The rows per gap are stored in the shared folder when this is called, before they are numbered."""
    count = lambda *d: F.count(F.when(F.col("decision").isin(*d), 1))
    closes = F.col("decision").isin("filled") | ((F.col("decision") == "fill_error") & F.col("in_gap"))
    gaps = (decided.filter(F.col("in_gap") | (F.col("decision") == "command"))
            .groupBy("record_id", "epoch")
            .agg(F.min(F.when(F.col("decision") == "command", F.col("seq"))).alias("open_seq"),
                 F.max(F.when(closes, F.col("seq"))).alias("close_seq"),
                 F.max(F.when(closes, F.col("cutoff"))).alias("cutoff"),
                 count("gap_dropped").alias("n_gap_dropped"),
                 count(*S.DECIDED_BUFFERED).alias("n_buffered"),
                 count("flushed").alias("n_flushed"),
                 count("dropped").alias("n_dropped"),
                 count("pending").alias("n_pending"),
                 count("dead_letter").alias("n_dead_letter")))
    return _numbered(stored(gaps), layout).select(
        "record_id", "episode", "open_seq", "close_seq", "cutoff", "n_gap_dropped", "n_buffered",
        "n_flushed", "n_dropped", "n_pending", "n_dead_letter")


def _numbered(gaps: DataFrame, layout: Layout) -> DataFrame:
    """Number a record's episodes from 1."""
    by_open = scan(gaps, layout.ordered("open_seq"), count_before={"_n": F.lit(True)})
    return by_open.withColumn("episode", F.col("_n") + 1).drop("_n", PART)


def buffers(decided: DataFrame) -> DataFrame:
    """Size and extent of each episode's buffer. The rows themselves stay rows (see `replayed`): a buffer
    may be far too large to be one array."""
    held = decided.filter(F.col("decision").isin(*S.DECIDED_BUFFERED))
    return held.groupBy("record_id", "epoch").agg(
        F.count(F.lit(1)).alias("n_buffered"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts"))


def dedupe_fills(fills: DataFrame, order: Sequence[str] = ("rec_ts",), mode: str = "compat") -> DataFrame:
    """One fill per (record, command): the first to arrive by the `order` columns; in strict the first that succeeded, if any
    did. A plain aggregate, so copies are merged before the shuffle."""
    _check(mode)
    rest = [c for c in fills.columns if c not in ("record_id", "event_id", *order)]
    failed = ~fill_succeeded() if mode == "strict" else F.lit(False)
    rank = F.struct(failed.alias("failed"), *order, *rest)
    return (fills.groupBy("record_id", "event_id").agg(F.min(rank).alias("_f"))
            .select("record_id", "event_id", *[F.col(f"_f.{c}").alias(c) for c in (*order, *rest)]))


def newer_only(rows: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Emit a row only if its time is later than that of every row emitted before it for the record."""
    seen = scan(rows, layout, max_before={"_last": F.col("ts")})
    return seen.filter(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last", PART)
