"""Per-record gap state on Spark's state store.

Rows of a micro-batch reach a record in any order after the shuffle; they are sorted here by source and offset, and a
micro-batch is as large as the source's rate limit allows: bound it (`max_per_trigger`). The buffer is a list state: adding a row does not rewrite it,
and it is read row by row when a gap ends.

Each input row gives one decision row when it arrives; a buffered row gives a second one when its gap ends.

Which row meets which depends on what has arrived: a fill that is read before its gap marker finds no gap. With `match` it does not. A
fill then answers the one command whose event it names, and waits for it if it comes first; and it takes effect at its place in the merged
order of both sources, or right behind its gap marker if that is later, whenever it is read:

* rows of an open gap wait, later gap markers among them, for they may turn out to lie behind the fill;
* rows that are read after their gap's fill, but lie before it, are judged by its cutoff as if they had waited;
* a fill is given up (`fill_ignored`, or `forced`) once the record's changes are `wait_ms` beyond it, and answers no marker beyond that.

So with `match` the result is the same however either source is cut into deliveries.

Between Spark and Python, and in state, a row travels as one JSON text beside its key, and rows of a record travel together in texts of
some 64 KB: what a cell, a row or a call costs there is more than the rules themselves. `GapProcessor` takes and gives plain rows,
`PackedGapProcessor` such texts (see `engine.gap_stream`).
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Row, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_CARRIED = ("seq", "source_rank", "rec_offset", "rec_partition", "arrived", "rec_ts", "key", "kind", "type", "event_id", "entity", "ts",
            "replay_id", "gap", "payload", "own_id", "cutoff", "is_success", "force", "err")
_LONGS = ("seq", "rec_offset", "arrived", "rec_ts", "ts", "replay_id", "cutoff")
#: What goes out as an event, and what goes out otherwise.
EMITTED = ("forwarded", "filled", "forced", "flushed")
ROUTED = ("command", "fill_error", "gap_failed", "dead_letter")
_SECONDS_LIMIT = 100_000_000_000


def state_schema(columns: Sequence[str] = _CARRIED) -> T.StructType:
    """All that was received; the gap information as JSON text."""
    kinds = dict.fromkeys(_LONGS, T.LongType()) | {"is_success": T.BooleanType(), "force": T.BooleanType(), "source_rank": T.IntegerType(),
                                              "rec_partition": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in columns])


#: An open gap.
GAP = T.StructType([
    T.StructField("opened_at", T.LongType()),
    T.StructField("deadline_clock", T.LongType()),
    T.StructField("open_seq", T.LongType()),
    T.StructField("open_event", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("n_buffered", T.LongType()),
    T.StructField("handed", T.LongType()),
    T.StructField("open_rank", T.IntegerType()),
    T.StructField("open_offset", T.LongType()),
])

#: Latest record time of each of the two sources, the number of rows emitted, the time of the last change emitted, and the
#: latest record time of a change that doesn't wait.
PROGRESS = T.StructType([T.StructField(c, T.LongType()) for c in ("latest_0", "latest_1", "emitted", "newest", "passed")])

#: State of a record but for its rows, as JSON: PROGRESS; `gap`, see GAP; `closed`, what a gap's fill has left behind (the fill, its place,
#: the number of rows replayed behind it); whether fills are `waiting`.
RECORD = T.StructType([T.StructField("record", T.StringType())])
#: Rows as JSON, one a line.
LINES = T.StructType([T.StructField("rows", T.StringType())])
#: Characters of a text of several rows, about.
CHUNK = 1 << 16


def output_schema(key_type: T.DataType) -> T.StructType:
    """Decision rows. `emitted` numbers what a record emits, in order; (`out_seq`, `pos`) say which row caused it and the place in
    the replay; `out_key` and `out_ts` are key and time of the causing row."""
    return T.StructType([
        T.StructField("record_id", key_type), *state_schema().fields,
        T.StructField("decision", T.StringType()),
        T.StructField("out_seq", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("out_key", T.StringType()),
        T.StructField("out_ts", T.LongType()),
        T.StructField("emitted", T.LongType()),
    ])


#: What a decision row has beside the row.
_DECIDED = ("decision", "out_seq", "pos", "out_key", "out_ts", "emitted")


def packed_schema(columns: Sequence[str] | None = None) -> T.ArrayType:
    """The JSON that `PackedGapProcessor` puts out: decision rows, the input row within; or these columns of them."""
    if columns is not None:
        kinds = {f.name: f.dataType for f in output_schema(T.StringType())}
        return T.ArrayType(T.StructType([T.StructField(c, kinds[c]) for c in columns]))
    kinds = {"decision": T.StringType(), "out_key": T.StringType()}
    return T.ArrayType(T.StructType([*[T.StructField(c, kinds.get(c, T.LongType())) for c in _DECIDED], T.StructField("row", state_schema())]))


#: Parts of a record's state as another run hands it over: progress and the open gap, if any, in one row; and rows held back.
PROGRESS_PART, HELD_PART = "progress", "held"

_AT = {c: i for i, c in enumerate(_CARRIED)}
_TS, _KIND, _RANK, _ARRIVED, _REC_TS, _OFFSET, _PARTITION = (
    _AT[c] for c in ("ts", "kind", "source_rank", "arrived", "rec_ts", "rec_offset", "rec_partition"))
_OUT = Row("record_id", *_CARRIED, *_DECIDED)
_PACKED = Row("record_id", "rows")


def _parsed(text: str) -> tuple:
    """The values of a row, and behind them the row as text."""
    return (*map(json.loads(text).get, _CARRIED), text)


def _all_parsed(texts: Sequence[str]) -> Iterator[tuple]:
    """The same for several rows, read as one array: a call of the parser costs as much as a short row."""
    for values, text in zip(json.loads(f"[{','.join(texts)}]"), texts, strict=True):
        yield (*map(values.get, _CARRIED), text)


def _text(row) -> str:
    return json.dumps({c: row[c] for c in _CARRIED if row[c] is not None})


def _chunks(texts: Sequence[str]) -> Iterator[tuple[str]]:
    """Texts of rows as lines, some 64 KB together."""
    lines, size = [], 0
    for text in texts:
        lines.append(text)
        size += len(text)
        if size >= CHUNK:
            yield ("\n".join(lines),)
            lines, size = [], 0
    if lines:
        yield ("\n".join(lines),)


def _lines(state) -> Iterator[tuple]:
    for element in state.get():
        yield from _all_parsed(element[0].split("\n"))


def _millis(x: int, unit: str) -> int:
    return x * 1000 if unit == "s" or unit == "guess" and abs(x) < _SECONDS_LIMIT else x


def _place(values: tuple, at: int | None = None) -> tuple:
    """Where a row stands in the merged order of the two sources."""
    at = values[_ARRIVED] if at is None else at
    return (at is not None, at or 0, values[_RANK], values[_OFFSET])


def merged(by_source: dict[int, list[tuple]], latest: list[int | None]) -> Iterator[tuple]:
    """Rows of two sources, each in order of its offsets, merged by the latest record time so far; with that time as
    `arrived`. A micro-batch boundary inside a source changes nothing."""
    def timed(rank: int):
        for values in sorted(by_source[rank], key=lambda v: (v[_OFFSET], v[_PARTITION] or 0)):
            at, text = values[_REC_TS], values[-1]
            if latest[rank] is not None and (at is None or at < latest[rank]):
                at = latest[rank]
            latest[rank] = at
            if at is not None:
                text = f'{{"arrived":{at}{"" if text == "{}" else ","}{text[1:]}'
            yield (*values[:_ARRIVED], at, *values[_ARRIVED + 1:-1], text)

    ranks = sorted(by_source)
    return timed(ranks[0]) if len(ranks) == 1 else heapq.merge(*map(timed, ranks), key=_place)


class GapProcessor(StatefulProcessor):
    """State of a record: the open gap, if any, and the rows held back since it opened.

    timeout_ms   a gap fails when a row of its record arrives later than this after its opening. With
                 `timers`, a gap of a record that stays quiet fails too: after as long on the clock ("clock"), or when the
                 watermark of the record times is beyond it ("event").
    max_buffer   a gap fails on the row that would exceed this many held-back rows
    newer_only   a change goes out only if its time is later than that of every change sent before it
    ts_unit, cutoff_unit   units of event times and cutoffs, for strict: "ms", "s", or "guess" by size
    match        fills answer the command they name, whichever comes first; strict only, without timeout and limit
    wait_ms      for `match`: how far a record's changes may be beyond a fill before it is given up
    """

    def __init__(self, mode: str = "compat", timeout_ms: int | None = None, max_buffer: int | None = None,
                 timers: str | bool = False, newer_only: bool = False, ts_unit: str = "ms", cutoff_unit: str = "ms",
                 match: bool = False, wait_ms: int = 3_600_000):
        self.strict = mode == "strict"
        self.timeout_ms, self.max_buffer = timeout_ms, max_buffer
        self.timers = ("event" if timers == "event" else "clock") if timers and timeout_ms is not None else None
        if match and (not self.strict or timeout_ms is not None or max_buffer is not None or newer_only):
            raise ValueError("match needs strict, and goes with neither timeout, limit nor newer_only")
        self.match, self.wait_ms = match, wait_ms
        if newer_only and not self.strict:
            raise ValueError("newer_only needs strict: in compat changes go out newest first")
        self.newer_only = newer_only
        self.ts_unit, self.cutoff_unit = ts_unit, cutoff_unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record_state = handle.getValueState("record", RECORD)
        self.held = handle.getListState("held", LINES)
        if self.match:
            self.waiting = handle.getListState("waiting", LINES)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """One row of what `engine.handover` made, its columns as JSON; rows of a record come in any order."""
        part, text = initialState["part"], initialState["row"]
        if part == HELD_PART:
            self.held.appendValue((text,))
            return
        given = json.loads(text)
        kept = {f.name: given.get(f.name) for f in PROGRESS.fields}
        if given.get("handed") is not None:
            kept["gap"] = {f.name: given.get(f.name) for f in GAP.fields}
            kept["gap"]["deadline_clock"] = self._deadline(timerValues, given.get("opened_at"))
            self._register(kept["gap"])
        self.record_state.update((json.dumps(kept),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        by_source: dict[int, list] = {}
        for values in self._received(rows):
            by_source.setdefault(values[_RANK], []).append(values)
        self._load()
        decide = self._decide_matched if self.match else self._decide
        yield from self._sent(key[0], self._numbered(decide(by_source, timerValues)))

    def _received(self, rows) -> Iterator[tuple]:
        return map(_parsed, map(_text, rows))

    def _sent(self, record, rows: Iterator[tuple]) -> Iterator[Row]:
        for values, *decided in rows:
            yield _OUT(record, *values[:-1], *decided)

    def _decide(self, by_source, timer_values) -> Iterator[tuple]:
        gap = before = self.gap
        held = _Held(self.held, gap)
        for values in merged(by_source, self.latest):
            at, kind = values[_ARRIVED], values[_KIND]
            late = gap and self.timeout_ms is not None and at is not None and gap["opened_at"] is not None
            if late and at > gap["opened_at"] + self.timeout_ms:
                yield from self._fail(gap, held, "timeout")
                gap = None
            if kind == "F":
                yield from self._fill(values, gap, held)
                gap = None
            elif kind == "G":
                if not gap:
                    gap = self._opened(values, timer_values)
                    yield self._row(values, "command")
                else:
                    yield self._row(values, "gap_dropped")
            elif not gap:
                yield self._row(values, "forwarded")
            else:
                held.fresh.append(values)
                gap["n_buffered"] += 1
                yield self._row(values, "buffered")
                if self.max_buffer is not None and gap["n_buffered"] > self.max_buffer:
                    yield from self._fail(gap, held, "overflow")
                    gap = None
        self.gap = gap
        self._keep(held)
        if gap and gap is not before:
            self._register(gap)

    def _opened(self, values: tuple, timer_values) -> dict:
        at = values[_ARRIVED]
        return {"opened_at": at, "deadline_clock": self._deadline(timer_values, at), "open_seq": values[_AT["seq"]],
                "open_event": values[_AT["event_id"]], "entity": values[_AT["entity"]], "n_buffered": 0, "handed": 0,
                "open_rank": values[_RANK], "open_offset": values[_OFFSET]}

    def _keep(self, held: "_Held") -> None:
        if self.gap and held.fresh:
            self.held.appendList([*_chunks([v[-1] for v in held.fresh])])

    # --- fills matched to their commands ----------------------------------------------------------------

    def _decide_matched(self, by_source, timer_values) -> Iterator[tuple]:
        self.rows_held = _Held(self.held, self.gap)
        self.fills = {self._name(fill): fill for fill in _lines(self.waiting)} if self.fills_wait else {}
        before = set(self.fills)
        for values in merged(by_source, self.latest):
            yield from (self._match_fill if values[_KIND] == "F" else self._match_change)(values)
        # All that wait are read whenever the record has rows, so writing them anew costs as much again at most.
        new = [name for name in self.fills if name not in before]
        if before - self.fills.keys():
            self.waiting.clear()
            new = list(self.fills)
        if new:
            self.waiting.appendList([*_chunks([self.fills[name][-1] for name in new])])
        self.fills_wait = bool(self.fills)
        self._keep(self.rows_held)

    @staticmethod
    def _name(fill: tuple) -> tuple:
        return fill[_AT["event_id"]], fill[_OFFSET], fill[_PARTITION] or 0

    def _match_change(self, values) -> Iterator[tuple]:
        is_gap, at = values[_KIND] == "G", values[_ARRIVED]
        if self.gap:
            self.rows_held.fresh.append(values)
            self.gap["n_buffered"] += 1
            yield self._row(values, "gap_held" if is_gap else "buffered")
            return
        if at is not None:
            # A marker that waits may be what a fill is for, so only changes that don't wait give fills up.
            self.passed = at
            for name in sorted(n for n, fill in self.fills.items() if not self._meets(fill, at)):
                fill = self.fills.pop(name)
                if self._ok(fill):
                    yield self._unanswered(fill)
        if self.closed and _place(values) < self.closed[1]:
            yield self._within(values)
            return
        self.closed = None
        if not is_gap:
            yield self._row(values, "forwarded")
            return
        self.gap = self._opened(values, None)
        yield self._row(values, "command")
        answers = [n for n in self.fills if n[0] == values[_AT["event_id"]]]
        if answers:
            fill = self.fills.pop(min(answers))
            if self._ok(fill):
                yield self._row(fill, "filled")
            yield from self._close(fill)

    def _match_fill(self, values) -> Iterator[tuple]:
        event = values[_AT["event_id"]]
        if self.gap and event is not None and event == self.gap["open_event"] and self._meets(values, self.gap["opened_at"]):
            yield self._row(values, "filled" if self._ok(values) else "fill_error")
            yield from self._close(values)
        elif event is None or not self._meets(values, self.passed):
            yield self._unanswered(values)
        else:
            self.fills[self._name(values)] = values
            # An error is one whether or not a command comes.
            yield self._row(values, "fill_waiting" if self._ok(values) else "fill_error")

    def _meets(self, fill: tuple, at: int | None) -> bool:
        """A fill answers no marker that comes more than `wait_ms` behind it."""
        came = fill[_AT["arrived"]]
        return came is None or at is None or at <= came + self.wait_ms

    def _unanswered(self, fill: tuple) -> tuple:
        return self._row(fill, "fill_error" if not self._ok(fill) else "forced" if fill[_AT["force"]] else "fill_ignored")

    def _ok(self, fill: tuple) -> bool:
        return self._succeeded(fill[_AT["is_success"]], fill[_AT["cutoff"]])

    def _close(self, fill: tuple) -> Iterator[tuple]:
        """The fill takes effect. Rows that waited lie before it, or go on as if they came now."""
        gap, held = self.gap, self.rows_held
        marker = (gap["opened_at"] is not None, gap["opened_at"] or 0, gap["open_rank"], gap["open_offset"])
        rows = list(held.rows())
        self._end(held)
        self.gap, self.closed, self.rows_held = None, (fill, max(_place(fill), marker), 0), _Held(self.held, None)
        for values in rows:
            yield from self._match_change(values)

    def _within(self, values: tuple) -> tuple:
        """What becomes of a row between a gap marker and the fill that has been read already."""
        fill, place, flushed = self.closed
        if values[_KIND] == "G":
            return self._row(values, "gap_dropped")
        if not self._ok(fill):
            return self._row(values, "dead_letter", fill, flushed + 1)
        if not self._newer(values, fill[_AT["cutoff"]]):
            return self._row(values, "dropped", fill)
        self.closed = (fill, place, flushed + 1)
        return self._row(values, "flushed", fill, flushed + 1)

    # --- rows out ---------------------------------------------------------------------------------------

    def _row(self, values, decision, cause=None, pos=0) -> tuple:
        """A decision row; `cause` is the row that made it, if not the row itself."""
        cause = cause or values
        return (values, decision, cause[_AT["seq"]], pos, cause[_AT["key"]], cause[_REC_TS])

    def _numbered(self, out: Iterator[tuple]) -> Iterator[tuple]:
        """Number the rows that go out, across micro-batches; with `newer_only`, hold back changes no newer than one before."""
        number = base = self.number
        for values, decision, out_seq, pos, out_key, out_ts in out:
            number_of_row = None
            if decision in EMITTED or decision in ROUTED:
                time = values[_TS]
                if self.newer_only and decision in EMITTED and time is not None:
                    if self.newest is not None and time <= self.newest:
                        decision = "repeated"
                    else:
                        self.newest = time
                if decision == "flushed" and not self.strict:
                    number_of_row = base + pos  # rows come oldest first, and go out newest first
                    number = max(number, number_of_row)
                elif decision != "repeated":
                    number = number_of_row = number + 1
                    base = number
            yield values, decision, out_seq, pos, out_key, out_ts, number_of_row
        self.number = number
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        gap = self.gap
        # The timer may belong to an earlier gap of this record.
        if gap and gap["deadline_clock"] is not None and gap["deadline_clock"] <= expiredTimerInfo.getExpiryTimeInMs():
            self.gap = None
            yield from self._sent(key[0], self._numbered(self._fail(gap, _Held(self.held, gap), "timeout")))

    def close(self) -> None:
        pass

    def _stored(self) -> dict:
        stored = self.record_state.get()
        return {} if stored is None else json.loads(stored[0])

    def _load(self) -> None:
        get = self._stored().get
        self.latest, self.number, self.newest, self.passed = [get("latest_0"), get("latest_1")], get("emitted") or 0, get("newest"), get("passed")
        self.gap, self.fills_wait, closed = get("gap"), get("waiting"), get("closed")
        self.closed = closed and (_parsed(closed["fill"]), tuple(closed["place"]), closed["flushed"])

    def _save(self) -> None:
        record = {"latest_0": self.latest[0], "latest_1": self.latest[1], "emitted": self.number, "newest": self.newest, "passed": self.passed}
        if self.gap:
            record["gap"] = self.gap
        if self.fills_wait:
            record["waiting"] = True
        if self.closed:
            fill, place, flushed = self.closed
            record["closed"] = {"fill": fill[-1], "place": place, "flushed": flushed}
        self.record_state.update((json.dumps(record),))

    def _end(self, held: "_Held") -> None:
        if held.stored:
            self.held.clear()
        held.stored, held.fresh = False, []

    def _deadline(self, timer_values, opened_at: int | None) -> int | None:
        if self.timers is None or self.timers == "event" and opened_at is None:
            return None
        if self.timers == "event":
            at = opened_at + self.timeout_ms + 1
        else:
            at = timer_values.getCurrentProcessingTimeInMs() + self.timeout_ms
        return at

    def _register(self, gap: dict) -> None:
        """A timer for a gap that is open at the end of a micro-batch; one that has ended within needs none."""
        if gap["deadline_clock"] is not None:
            self.handle.registerTimer(gap["deadline_clock"])

    @staticmethod
    def _succeeded(flag: bool | None, cutoff: int | None) -> bool:
        return flag if flag is not None else cutoff is not None and cutoff >= 0

    def _fail(self, gap: dict, held: "_Held", why: str) -> Iterator[tuple]:
        at = dict.fromkeys(_CARRIED) | {
            "seq": gap["open_seq"], "arrived": gap["opened_at"], "rec_ts": gap["opened_at"], "kind": "G", "event_id": gap["open_event"],
            "entity": gap["entity"], "err": why}
        failed = _parsed(_text(at))
        yield self._row(failed, "gap_failed")
        for i, values in enumerate(held.rows()):
            yield self._row(values, "dead_letter", failed, i + 1)
        self._end(held)

    def _fill(self, values, gap: dict | None, held: "_Held") -> Iterator[tuple]:
        cutoff, ok = values[_AT["cutoff"]], self._ok(values)
        if self.strict and not ok:
            yield self._row(values, "fill_error")
            for i, v in enumerate(held.rows()):
                yield self._row(v, "dead_letter", values, i + 1)
        elif gap:
            yield self._row(values, "filled")
            # Newest first in compat: read twice instead of making a list, and numbered from the end, since the buffer may be far
            # larger than a micro-batch. The place in the replay is `pos`.
            total = 0 if self.strict else sum(self._newer(v, cutoff) for v in held.rows())
            kept = 0
            for v in held.rows():
                if self._newer(v, cutoff):
                    kept += 1
                    yield self._row(v, "flushed", values, kept if self.strict else total - kept + 1)
                else:
                    yield self._row(v, "dropped", values)
        else:
            forced = self.strict and values[_AT["force"]]
            yield self._row(values, "forced" if forced else "fill_ignored")
        self._end(held)

    def _newer(self, values: tuple, cutoff: int | None) -> bool:
        ts = values[_TS]
        if ts is None or cutoff is None:
            return False
        return _millis(ts, self.ts_unit) > _millis(cutoff, self.cutoff_unit) if self.strict else ts > cutoff


class PackedGapProcessor(GapProcessor):
    """The same for rows as JSON text, decision rows as JSON arrays (`packed_schema`).

    columns   the columns of decision rows that are wanted, if not all
    only      the decisions that are wanted, if not all
    """

    def __init__(self, mode: str = "compat", columns: Sequence[str] | None = None, only: Sequence[str] | None = None, **options):
        super().__init__(mode, **options)
        self.columns, self.only = columns, only and frozenset(only)

    def _received(self, rows) -> Iterator[tuple]:
        return _all_parsed([row["row"] for row in rows])

    def _sent(self, record, rows: Iterator[tuple]) -> Iterator[Row]:
        text = _whole_item() if self.columns is None else _item_of(self.columns)
        items, size, only = [], 0, self.only
        for row in rows:
            if only is not None and row[1] not in only:
                continue
            item = text(*row)
            items.append(item)
            size += len(item)
            if size >= CHUNK:
                yield _PACKED(record, f"[{','.join(items)}]")
                items, size = [], 0
        if items:
            yield _PACKED(record, f"[{','.join(items)}]")


def _whole_item():
    """A function that gives a decision row as JSON, the input row's text within. Keys of a record's rows are mostly one, so the last one's
    text is remembered."""
    last, quoted = None, "null"

    def text(values, decision, out_seq, pos, out_key, out_ts, emitted) -> str:
        nonlocal last, quoted
        if out_key != last:
            last, quoted = out_key, json.dumps(out_key)
        return (f'{{"decision":"{decision}","out_seq":{_number(out_seq)},"pos":{pos},"out_key":{quoted},'
                f'"out_ts":{_number(out_ts)},"emitted":{_number(emitted)},"row":{values[-1]}}}')

    return text


def _item_of(columns: Sequence[str]):
    """The same with some columns alone."""
    places = [(c, _DECIDED.index(c), None) if c in _DECIDED else (c, None, _AT[c]) for c in columns]
    if tuple(columns) == ("seq", "decision"):
        at = _AT["seq"]
        return lambda values, decision, *_: f'{{"seq":{_number(values[at])},"decision":"{decision}"}}'
    return lambda values, *decided: json.dumps({c: values[at] if i is None else decided[i] for c, i, at in places})


def _number(x: int | None):
    return "null" if x is None else x


class _Held:
    """Rows held back for one record: those in the list state, then those of this micro-batch. Rows that another run handed over
    come first, and in any order."""

    def __init__(self, state, gap: dict | None):
        self.state, self.stored, self.fresh = state, gap is not None, []
        self.handed = gap["handed"] or 0 if gap else 0

    def rows(self) -> Iterator[tuple]:
        if self.stored:
            rows = _lines(self.state)
            if self.handed:
                yield from sorted(itertools.islice(rows, self.handed), key=_place)
            yield from rows
        yield from self.fresh
