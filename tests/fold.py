"""The gap rules row by row in plain Python: the yardstick for the window and the stream form."""


def ms(x, strict):
    return x * 1000 if strict and abs(x) < 100_000_000_000 else x


def fold(rows, mode="compat", timeout=None, max_buffer=None):
    """rows: dicts with record_id, seq, kind, ts, arrived, cutoff, is_success, force.
    Returns {(record_id, seq): decision}, {(record_id, seq): place in the replay}, {(record_id, open_seq): reason}."""
    strict = mode == "strict"
    decision, place, failed, open_gaps = {}, {}, {}, {}

    def fail(rec, why):
        gap = open_gaps.pop(rec)
        failed[rec, gap["seq"]] = why
        for r in gap["rows"]:
            decision[rec, r["seq"]] = "dead_letter"

    for row in sorted(rows, key=lambda r: r["seq"]):
        rec, at = row["record_id"], (row["record_id"], row["seq"])
        gap = open_gaps.get(rec)
        if gap and timeout is not None and row["arrived"] > gap["at"] + timeout:
            fail(rec, "timeout")
            gap = None
        if row["kind"] == "F":
            ok = row.get("is_success")
            ok = row["cutoff"] >= 0 if ok is None else ok
            open_gaps.pop(rec, None)
            if strict and not ok:
                decision[at] = "fill_error"
                for r in gap["rows"] if gap else []:
                    decision[rec, r["seq"]] = "dead_letter"
            elif gap:
                decision[at] = "filled"
                kept = []
                for r in gap["rows"]:
                    newer = r["ts"] is not None and ms(r["ts"], strict) > ms(row["cutoff"], strict)
                    decision[rec, r["seq"]] = "flushed" if newer else "dropped"
                    if newer:
                        kept.append(r)
                for i, r in enumerate(kept if strict else kept[::-1]):
                    place[rec, r["seq"]] = i + 1
            else:
                decision[at] = "forced" if strict and row.get("force") else "fill_ignored"
        elif row["kind"] == "G":
            decision[at] = "gap_dropped" if gap else "command"
            if not gap:
                open_gaps[rec] = {"seq": row["seq"], "at": row["arrived"], "rows": []}
        elif not gap:
            decision[at] = "forwarded"
        else:
            gap["rows"].append(row)
            decision[at] = "pending"
            if max_buffer is not None and len(gap["rows"]) > max_buffer:
                fail(rec, "overflow")
    return decision, place, failed
