"""State of the tables that streams keep: images, missing numbers, outages, answers seen.

The results of the first two do not depend on the order in which rows are read, nor on the cut into micro-batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import Row, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _TEXT = T.LongType(), T.StringType()


class ImageProcessor(StatefulProcessor):
    """A record's image as a map of fields, each with the place of the change that wrote it. A full row takes away all fields that were
    written before it; a change writes its own fields, if they have not been written by a later one. At one place the larger value
    counts, as in the table form.

    Rows: `at` (bigint, a record's order; null counts as first), `is_full`, `fields` (map). One output row for each record and
    micro-batch that wrote to it: `version` counts them.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.whole = handle.getValueState("whole", _struct(full_at=_LONG, version=_LONG))
        self.fields = handle.getMapState("fields", _struct(field=_TEXT), _struct(at=_LONG, value=_TEXT))

    @staticmethod
    def _rank(at: int | None, value: str | None) -> tuple:
        return at is not None, at or 0, value is not None, value or ""

    @staticmethod
    def _before(at: int | None, full_at: int | None) -> bool:
        return full_at is not None and (at is None or at < full_at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.whole.get()
        full_at, version = (None, 0) if kept is None else kept
        old_full, is_new = full_at, kept is None
        last: dict[str, tuple] = {}
        for row in rows:
            at = row["at"]
            if row["is_full"]:
                full_at = at if full_at is None or at is not None and at > full_at else full_at
                is_new = True
            for field, value in dict(row["fields"] or {}).items():  # pairs or a map, by Spark version
                if field not in last or self._rank(*last[field]) < self._rank(at, value):
                    last[field] = at, value
        if kept is None and not last and not is_new:
            return
        image = {}
        for (field,), (at, value) in list(self.fields.iterator()):
            newer = last.get(field)
            if newer is not None and self._rank(at, value) >= self._rank(*newer):
                del last[field]
            if self._before(at, full_at):
                if full_at != old_full:
                    self.fields.removeKey((field,))
            elif field not in last:
                image[field] = value
        for field, (at, value) in last.items():
            if not self._before(at, full_at):
                self.fields.updateValue((field,), (at, value))
                image[field] = value
        self.whole.update((full_at, version + 1))
        yield Row(*self.keys, "version", "image")(*key, version + 1, dict(sorted(image.items())))

    def close(self) -> None:
        pass


def joined(runs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Disjoint runs from runs in order of their starts; neighbours and overlapping ones become one."""
    first = last = None
    for start, end in runs:
        if first is None:
            first, last = start, end
        elif start <= last + 1:
            last = max(last, end)
        else:
            yield first, last
            first, last = start, end
    if first is not None:
        yield first, last


class RunProcessor(StatefulProcessor):
    """The numbers seen within one block, as runs without a hole. A number that comes late joins two runs or lengthens one; one that
    comes again changes nothing. What changes is put out: each run that is gone with -1, each new one with 1.

    A block holds a bounded range of numbers, so its runs are bounded too, and a sequence spreads over as many tasks as it has blocks.
    """

    def __init__(self, keys: list[str], number: str):
        self.keys, self.number = keys, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", _struct(from_id=_LONG), _struct(to_id=_LONG))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {start: end for (start,), (end,) in self.runs.iterator()}
        fresh = sorted({row[self.number] for row in rows})
        after = dict(joined(heapq.merge(sorted(before.items()), ((n, n) for n in fresh))))
        out = Row(*self.keys, "from_id", "to_id", "change")
        for start, end in before.items() - after.items():
            if start not in after:
                self.runs.removeKey((start,))
            yield out(*key, start, end, -1)
        for start, end in after.items() - before.items():
            self.runs.updateValue((start,), (end,))
            yield out(*key, start, end, 1)

    def close(self) -> None:
        pass


class OutageProcessor(StatefulProcessor):
    """A source's outage: from its first transient failure after an answer to the next answer.

    An outage that lasts longer than `limit_ms` gives one row `breach`: when a row of the source shows it, or, while the outage goes
    on in silence, when the watermark of all sources' times is beyond the limit. An outage that ends gives a row `ended`.
    """

    def __init__(self, keys: list[str], limit_ms: int):
        self.keys, self.limit_ms = keys, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _struct(started=_LONG, last_failure=_LONG, n_failures=_LONG, alarmed=T.BooleanType()))

    def _row(self, key, kind: str, outage: list, at: int | None) -> Row:
        return Row(*self.keys, "kind", "started", "last_failure", "n_failures", "at")(*key, kind, *outage[:3], at)

    def _beyond(self, outage: list, now: int | None) -> bool:
        return not outage[3] and now is not None and outage[0] is not None and now - outage[0] > self.limit_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.open.get()
        outage = None if kept is None else list(kept)
        timed = None if kept is None else kept[0]
        for row in sorted(rows, key=lambda r: r["seq"]):
            at = row["ts"]
            if row["outcome"] == "transient":
                outage = outage or [None, None, 0, False]
                if at is not None:
                    outage[0] = at if outage[0] is None else min(outage[0], at)
                    outage[1] = at if outage[1] is None else max(outage[1], at)
                outage[2] += 1
            if outage and self._beyond(outage, at):
                outage[3] = True
                yield self._row(key, "breach", outage, outage[0] + self.limit_ms + 1)
            if outage and row["outcome"] != "transient":
                yield self._row(key, "ended", outage, at)
                outage = None
        if outage is None:
            if kept is not None:
                self.open.clear()
            return
        self.open.update(tuple(outage))
        if not outage[3] and outage[0] is not None and outage[0] != timed:
            self.handle.registerTimer(outage[0] + self.limit_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.open.get()
        # The timer may belong to an earlier outage of this source.
        if kept is not None and self._beyond(list(kept), expiredTimerInfo.getExpiryTimeInMs()):
            self.open.update((*kept[:3], True))
            yield self._row(key, "breach", list(kept), kept[0] + self.limit_ms + 1)

    def close(self) -> None:
        pass


class FirstProcessor(StatefulProcessor):
    """The first row of each key, by `order`; the state store forgets a key `keep_ms` of the clock after its first row."""

    def __init__(self, columns: list[str], order: str, keep_ms: int):
        self.columns, self.order, self.keep_ms = columns, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _struct(at=_LONG), self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r[self.order] is not None, r[self.order] or 0))
        self.seen.update((first[self.order],))
        yield Row(*self.columns)(*(first[c] for c in self.columns))

    def close(self) -> None:
        pass
