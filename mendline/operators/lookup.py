"""The fill worker as a join: commands meet the current images of their records.

An image is the JSON text of a record with its own modification time. Images may come in several versions; the latest
counts, so each command has one answer. Which is the latest says the column `taken`, when the source had it, if there is one: a broken
newest image is then a failed fill, and no older one stands in for it. Commands may repeat a record many times: a hot record
skews only the command side, which Spark's adaptive skew join may split for an inner or left
join. Whether the images are broadcast is left to Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lookup_path, parse_long
from .ordered import Layout, scan

_ON = ["entity_type", "record_id"]
#: Fixed value: the field of an image that holds its modification time.
MODIFIED = "lastModifiedEpochMs"


def _read_image() -> Column:
    """What an image says of itself: its modification time (`cutoff`, null if it is unusable) and why it has none."""
    parsed = F.try_parse_json("image")
    text = F.when(parsed.isNotNull(), F.try_variant_get(parsed, f"$.{MODIFIED}", "string"))
    return F.struct(parse_long(text).alias("cutoff"), parsed.isNotNull().alias("is_json"), text.alias("modified"), "image")


def asked_images(commands: DataFrame, images: DataFrame) -> DataFrame:
    """The images of records that any command asks for: `fill_lookup` finds the same among them, without reading and sorting the others. For
    commands that are stored, since they are read once more."""
    return images.join(commands.select(*_ON), _ON, "left_semi")


def current_images(images: DataFrame) -> DataFrame:
    """One row per (entity_type, record_id): the latest image by `taken`. Without that column the image with the latest usable modification
    time, which is its `cutoff`; an image that is no JSON, or has no such time, is unusable (`cutoff` null) and stands only where there is
    no other."""
    best = F.struct("taken", _read_image().alias("read")) if "taken" in images.columns else F.struct(_read_image().alias("read"))
    return images.groupBy(*_ON).agg(F.max(best).alias("_best")).select(*_ON, "_best.read.*")


def _answered(met: DataFrame, base: str, keep: Sequence[str], since: Column | None = None) -> DataFrame:
    """Commands with the image found for each (`found`, null if there is none) as fills. An image last changed before `since` is stale."""
    found = F.col("found")
    fresh = F.lit(True) if since is None else F.coalesce(found["cutoff"] >= since, F.lit(False))
    ok = found["cutoff"].isNotNull() & fresh
    path = lookup_path(F.col("entity_type"), F.col("record_id"), base)
    message = (F.when(ok, "")
               .when(found.isNull(), F.concat(F.lit("not found: "), path))
               .when(~found["is_json"], F.concat(F.lit("bad image: "), path))
               .when(found["cutoff"].isNull(), F.concat(F.lit("bad modification time: "), F.coalesce(found["modified"], F.lit("none"))))
               .otherwise(F.concat(F.lit("stale image: "), path)))
    return met.select(
        "record_id", "entity_type", "event_id", "seq", F.when(ok, found["cutoff"]).otherwise(-1).alias("cutoff"),
        F.when(ok, found["image"]).otherwise("{}").alias("all_fields"), ok.alias("is_success"), message.alias("err"), *keep)


def fill_lookup(commands: DataFrame, images: DataFrame, base: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """One fill per command. No image, one that is no JSON, or one without a usable modification time gives a failed fill
    (cutoff -1, no fields, a message). `keep` names further command columns to pass on."""
    current = current_images(images)
    found = current.select(*_ON, F.struct(*[c for c in current.columns if c not in _ON]).alias("found"))
    return _answered(commands.join(found, _ON, "left"), base, keep)


def fill_lookup_as_of(commands: DataFrame, images: DataFrame, base: str = "", keep: Sequence[str] = (), layout: Layout = Layout(keys=tuple(_ON))) -> DataFrame:
    """As `fill_lookup`, with the image that was the latest when each command was asked: `asked_at` of the command, `taken` of the image, both
    inclusive. An image last changed before the command's gap (`gap_at`) lacks what the gap has lost and gives a failed fill.

    One pass over versions and commands together, in order of time; hot records are cut into stretches. No range join."""
    reads = images.select(*_ON, F.col("taken").alias("at"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("nth"), _read_image().alias("version"))
    # Of versions taken at one instant the one that sorts last, as in `current_images`.
    reads = reads.groupBy(*_ON, "at", "rank", "nth").agg(F.max("version").alias("version"))
    asks = commands.withColumns({"at": F.col("asked_at"), "rank": F.lit(1), "nth": F.col("seq")})
    both = reads.unionByName(asks, allowMissingColumns=True)
    seen = scan(both, layout.by(*_ON).ordered("at", "rank", "nth"), before={"found": F.col("version")}).filter(F.col("rank") == 1)
    return _answered(seen, base, keep, F.col("gap_at"))


def fill_lookup_hits(commands: DataFrame, images: DataFrame) -> DataFrame:
    """The older worker: a command that cannot be answered leaves no trace."""
    found = current_images(images).filter(F.col("cutoff").isNotNull())
    return commands.join(found, _ON, "inner").select(
        "record_id", "entity_type", "event_id", "seq", "cutoff", F.col("image").alias("all_fields"))


def fill_lookup_misses(commands: DataFrame, images: DataFrame, base: str = "") -> DataFrame:
    """Commands whose record has no image."""
    path = lookup_path(F.col("entity_type"), F.col("record_id"), base)
    return commands.join(images.select(*_ON), _ON, "left_anti").select(
        "record_id", "entity_type", "event_id", "seq", path.alias("path"))


def outcome_class(status: Column) -> Column:
    """success, permanent (the request itself is at fault) or transient (try again)."""
    return (F.when(status.rlike("^2[0-9][0-9]$"), "success")
            .when(status.rlike("^4[0-9][0-9]$") | (status == "bad_json"), "permanent")
            .otherwise("transient"))
