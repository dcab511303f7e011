"""Order-dependent operators that stay balanced when one key holds a large share of all rows.

A plain window over ``PARTITION BY key ORDER BY seq`` hands every row of a key to one task. Here keys with
more than `hot_rows` rows are cut into stretches at sampled quantiles of their whole order, and each stretch is worked
on by its own task. What a stretch needs to know of its neighbours (last value before it, first value after it,
running maximum, count) comes from a small table with one row per stretch, joined back on (key, stretch).

* Whether any key is hot is found first, by one mergeable count per key. If none is, the plan is a plain window: one
  shuffle on the key, one sort, no further join.
* Stretches follow the data, not the numbers: ids far apart, times close together, or any number of rows that are equal in the first
  order columns give stretches of about `hot_rows` rows all the same.
* The list of hot keys has fewer than (all rows / hot_rows) rows; Spark decides by its size how it is joined.
* Nothing depends on physical partition numbers or arrival, so a lost task recomputes to the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.io import stored

PART = "part"
#: Stretches of one key at most; beyond, stretches grow. Results do not change.
MOST_STRETCHES = 1000
#: Rows drawn for each stretch to find the cuts; a stretch's size then varies by about a sixth.
DRAWN = 32


@dataclass(frozen=True)
class Layout:
    """How rows are keyed, ordered and cut.

    With no keys the whole table is one sequence. `order` must be unique within a key; a stretch of a hot key holds about
    `hot_rows` rows.
    """

    keys: tuple[str, ...] = ("record_id",)
    order: tuple[str, ...] = ("seq",)
    hot_rows: int = 1_000_000

    def by(self, *keys: str) -> "Layout":
        return replace(self, keys=tuple(keys))

    def ordered(self, *order: str) -> "Layout":
        return replace(self, order=tuple(order))


DEFAULT = Layout()


def _part(value: Column, cut: bool) -> Column:
    return value.cast("int").alias(PART, metadata={"cut": cut})


def is_cut(df: DataFrame) -> bool:
    """Does any key of a table with ``part`` lie in several stretches?"""
    return df.schema[PART].metadata.get("cut", True)


def cut_hot_keys(df: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Add ``part``: the stretch number for rows of hot keys, null for all others. Counts the rows of each key at once.

    Cuts are places in the whole order, drawn by a hash of it from the rows of hot keys alone."""
    if PART in df.columns:
        return df
    keys, place = list(layout.keys), F.struct(*layout.order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > layout.hot_rows)
    most = counts.agg(F.max("_n")).first()[0]
    if most is None or most < 2:
        return df.select("*", _part(F.lit(None), False))
    rows = df.join(counts, keys) if keys else df.withColumn("_n", F.lit(most))
    stretches = F.greatest(F.lit(2), F.least(F.lit(MOST_STRETCHES), F.ceil(F.col("_n") / max(1, layout.hot_rows)))).cast("int")
    drawn = (rows.filter(F.pmod(F.xxhash64(*layout.order), F.col("_n")) < DRAWN * stretches)
             .groupBy(*keys).agg(F.max(stretches).alias("_most"), F.sort_array(F.collect_list(place)).alias("_drawn")))
    at = F.transform(F.sequence(F.lit(1), F.col("_most") - 1),
                     lambda i: F.get("_drawn", F.floor(i * F.size("_drawn") / F.col("_most")).cast("int")))
    hot = stored(drawn.select(*keys, F.array_distinct(at).alias("_cuts")), "hot-keys")
    # The list of cuts is null for other keys after the left join, and so is `part`. Without keys the list is one row of bounded size.
    one = F.lit(0).alias("_one")
    cut = df.join(hot, keys, "left") if keys else df.select("*", one).join(F.broadcast(hot.select("*", one)), "_one", "left")
    return cut.select(*df.columns, _part(F.when(F.col("_cuts").isNotNull(), _place(F.col("_cuts"), place)), True))


def _place(cuts: Column, x: Column) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(cuts, lambda c: c < x))


def _partition(df: DataFrame, layout: Layout) -> list[str]:
    return [*layout.keys, PART] if is_cut(df) else list(layout.keys)


def _key_of(layout: Layout):
    cols = [F.col(c) for c in layout.order]
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def _fields(rows: DataFrame, name: str) -> list[str]:
    kind = rows.schema[f"_x_{name}"].dataType
    return kind.fieldNames() if isinstance(kind, T.StructType) else []


def _edge(rows: DataFrame, name: str, pick, at, order: Column) -> list[Column]:
    """Aggregates for the value of `name` nearest to the end of a stretch. A struct is picked field by field:
    buffers of plain numbers let Spark aggregate by hash, without sorting the rows first."""
    x = F.col(f"_x_{name}")
    where = F.when(x.isNotNull(), order)
    fields = _fields(rows, name)
    if not fields:
        return [pick(x, where).alias(name)]
    return [at(where).alias(f"{name}__at"), *[pick(x[f], where).alias(f"{name}__{f}") for f in fields]]


def _rebuilt(rows: DataFrame, name: str) -> Column:
    fields = _fields(rows, name)
    if not fields:
        return F.col(name)
    whole = F.struct(*[F.col(f"{name}__{f}").alias(f) for f in fields])
    return F.when(F.col(f"{name}__at").isNotNull(), whole)


def _next(name: str, keys: list[str], order: list[str]) -> Column:
    """First non-null value after the row; in the same sort as a backward look, and in linear time."""
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    by = f"PARTITION BY {quoted(keys)} " if keys else ""
    return F.expr(f"lead(`{name}`) IGNORE NULLS OVER ({by}ORDER BY {quoted(order)})")


def scan(df: DataFrame, layout: Layout = DEFAULT, *,
         before: Mapping[str, Column] | None = None,
         after: Mapping[str, Column] | None = None,
         max_before: Mapping[str, Column] | None = None,
         count_before: Mapping[str, Column] | None = None) -> DataFrame:
    """Look along each key's order from every row; the row itself is left out.

    before        nearest non-null value of the expression in an earlier row
    after         nearest non-null value in a later row
    max_before    largest value in earlier rows
    count_before  number of earlier rows for which the condition holds
    """
    before, after = dict(before or {}), dict(after or {})
    max_before, count_before = dict(max_before or {}), dict(count_before or {})
    every = {**before, **after, **max_before, **count_before}
    keys = list(layout.keys)
    order = _key_of(layout)

    rows = cut_hot_keys(df, layout).withColumns({f"_x_{n}": e for n, e in every.items()})

    # Inside a stretch (or a whole key that is not hot): one shuffle, one sort, all in linear time.
    within = _partition(rows, layout)
    inside = Window.partitionBy(*within).orderBy(*layout.order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local: dict[str, Column] = {}
    for n in before:
        local[n] = F.last(f"_x_{n}", ignorenulls=True).over(earlier)
    for n in after:
        local[n] = _next(f"_x_{n}", within, list(layout.order))
    for n in max_before:
        local[n] = F.max(f"_x_{n}").over(earlier)
    for n in count_before:
        local[n] = F.count(F.when(F.col(f"_x_{n}"), 1)).over(earlier)
    out = rows.withColumns(local)
    if not is_cut(rows):
        return out.drop(*[f"_x_{n}" for n in every])

    # Across the stretches of hot keys: first and last value per stretch, then the nearest stretch that has one.
    edge: list[Column] = []
    for n in before:
        edge += _edge(rows, n, F.max_by, F.max, order)
    for n in after:
        edge += _edge(rows, n, F.min_by, F.min, order)
    edge += [F.max(f"_x_{n}").alias(n) for n in max_before]
    edge += [F.count(F.when(F.col(f"_x_{n}"), 1)).alias(n) for n in count_before]
    along = Window.partitionBy(*keys).orderBy(PART)
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    carried: dict[str, Column] = {}
    for n in before:
        carried[n] = F.last(n, ignorenulls=True).over(past)
    for n in after:
        carried[n] = _next(n, keys, [PART])
    for n in max_before:
        carried[n] = F.max(n).over(past)
    for n in count_before:
        carried[n] = F.sum(n).over(past)
    stretches = rows.filter(F.col(PART).isNotNull()).groupBy(*keys, PART).agg(*edge)
    for n in [*before, *after]:
        stretches = stretches.withColumn(n, _rebuilt(rows, n))
    carry = stretches.select(*keys, PART, *[c.alias(f"_c_{n}") for n, c in carried.items()])

    out = out.join(carry, [*keys, PART], "left")
    merged: dict[str, Column] = {}
    for n in [*before, *after]:
        merged[n] = F.coalesce(F.col(n), F.col(f"_c_{n}"))
    for n in max_before:
        merged[n] = F.greatest(F.col(n), F.col(f"_c_{n}"))
    for n in count_before:
        merged[n] = F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
    return out.withColumns(merged).drop(*[f"_x_{n}" for n in every], *[f"_c_{n}" for n in every])


def number_rows(df: DataFrame, name: str, run: str, layout: Layout = DEFAULT, *,
                where: Column | None = None, newest_first: bool = False) -> DataFrame:
    """Number the rows of each run from 1, oldest or newest first; rows outside `where` get null.

    `run` is a non-null label that is constant over a contiguous run of a key's rows (an episode, an
    island). Only one run can cross a given stretch boundary, so one carried count per stretch is enough.
    """
    keys = list(layout.keys)
    rows = cut_hot_keys(df, layout).withColumn("_in", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    order = [F.col(c).desc() if newest_first else F.col(c).asc() for c in layout.order]
    inside = Window.partitionBy(*_partition(rows, layout), run, "_in").orderBy(*order)
    local = rows.withColumn(name, F.row_number().over(inside).cast("bigint"))
    if not is_cut(rows):
        return local.withColumn(name, F.when(F.col("_in"), F.col(name))).drop("_in")

    part = F.col(PART).desc() if newest_first else F.col(PART).asc()
    ahead = Window.partitionBy(*keys, run).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.filter(F.col(PART).isNotNull() & F.col("_in"))
             .groupBy(*keys, run, PART).agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, PART, F.col(run).alias("_c_run"), F.sum("_n").over(ahead).alias("_c_n"))
             .filter(F.col("_c_n") > 0))
    offset = F.when(F.col(run) == F.col("_c_run"), F.col("_c_n")).otherwise(0)
    return (local.join(carry, [*keys, PART], "left")
            .withColumn(name, F.when(F.col("_in"), F.col(name) + offset))
            .drop("_in", "_c_run", "_c_n"))
