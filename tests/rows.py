"""Building tagged rows for tests."""

import random
import re

SCHEMA = ("record_id string, seq bigint, arrived bigint, kind string, event_id string, entity string, ts bigint, "
          "payload string, cutoff bigint, is_success boolean, err string, force boolean")


def row(record_id, seq, kind, ts, cutoff=None, is_success=None, force=None, arrived=None):
    return dict(record_id=record_id, seq=seq, arrived=ts if arrived is None else arrived, kind=kind,
                event_id=f"e{seq}", entity="Employee", ts=None if kind == "F" else ts,
                payload='{"a":1}' if is_success is not False else "{}", cutoff=cutoff, is_success=is_success,
                err=None if is_success is not False else "no image", force=force)


def scenario(text, record_id="123"):
    """`G@1 N@2 F(0)@3`: kind, cutoff and time in order of arrival; `F(-1!)` failed, `F(5+)` forced."""
    out, now = [], 0
    for i, word in enumerate(text.split()):
        kind, cutoff, mark, at = re.fullmatch(r"([NGF])(?:\((-?\d+)([!+]?)\))?(?:@(\d+))?", word).groups()
        now = int(at) if at else now + 1
        out.append(row(record_id, i, kind, now, None if cutoff is None else int(cutoff),
                       None if cutoff is None else mark != "!", mark == "+" if cutoff is not None else None))
    return out


def rand_rows(seed, n, records=4, hot=True):
    """Random interleaving; record r0 holds a third of the rows or more, fills are rare in it."""
    rnd = random.Random(seed)
    out, now = [], 1_000
    for seq in range(n):
        rec = "r0" if hot and rnd.random() < 0.4 else f"r{rnd.randrange(records)}"
        kind = rnd.choices("NGF", (60, 25, 4 if rec == "r0" else 15))[0]
        now += rnd.choice((0, 1, 1, 2, 5, 40))
        if kind == "F":
            ok = rnd.random() < 0.8
            out.append(row(rec, seq, "F", now, now - rnd.randrange(60) if ok else -1, ok, rnd.random() < 0.2))
        else:
            out.append(row(rec, seq, kind, now))
    return out


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
