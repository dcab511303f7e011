"""Exact duplicates by sorting contents, with DataFrame functions only.

Every row gets a short key that is the same for equal normalised texts: the first bytes, then a digest. Rows are dealt to
partitions by ranges of that key between sampled splitters (`repartitionByRange`), sorted there by key, whole normalised
text and identifier (Spark's external sort), and compared in full with their neighbours: a run of equal texts is a window
partition whose first row has the smallest identifier. The window needs no further exchange, since ranges of the key keep
equal texts together.

A text that holds more than 1/`SHARE` of all rows is dealt out by its rows' identifiers, in pieces of about that share; rows without
identifier by their place. There are fewer than `SHARE` such texts whatever the size of the input, so the list of them is broadcast, and
so are the results of their pieces, at most 2 * SHARE, which are put together by comparing the whole texts of the pieces' first rows.

Null text counts as empty. Null identifiers come after all others; of several rows with the same text and the same
identifier one stays. Columns of the input are kept; those named like a result column are replaced. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mendline.llm.common import SPACE, free_name
from mendline.sources.io import stored

#: A text with more than this share of all rows, and more rows than LEAST, is dealt out in pieces of about as many rows.
SHARE, LEAST = 2048, 256
#: Bytes of a text that its key begins with.
HEAD_BYTES = 16


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def exact_duplicates(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
                     least: int = LEAST) -> DataFrame:
    """The input, or its columns in `keep`, with keep_id, group_size, kept and text_sha256 for every row. `least` only moves
    work about."""
    results = ("keep_id", "group_size", "kept", "text_sha256")
    df = df.drop(*(c for c in df.columns if c.lower() in results and c not in (text, id_col)))
    columns, wanted = df.columns, df.columns if keep is None else keep
    norm, head, sha, piece, pieces, rank, run_min, run_size, leader, t_sha, t_piece, t_min, first = (
        free_name(df, n) for n in ("norm", "head", "sha", "piece", "pieces", "run_rank", "run_min", "run_size", "leader", "t_sha", "t_piece", "t_min", "first"))

    digests = df.select(F.unhex(F.sha2(normalised(F.col(text)), 256)).alias(sha))
    sizes = stored(digests.groupBy(sha).count(), "text-sizes")
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    most = max(least, rows // SHARE)
    common = sizes.where((F.col("count") > least) & (F.col("count") * SHARE > rows)).select(
        sha, F.ceil(F.col("count") / max(1, most)).cast("int").alias(pieces))

    # The key: the text's first bytes and its digest, then the piece of a common text. Only the key is sampled.
    plain = df.withColumn(norm, normalised(F.col(text)))
    keyed = plain.select(*columns, F.substring(F.encode(norm, "UTF-8"), 1, HEAD_BYTES).alias(head),
                         F.unhex(F.sha2(norm, 256)).alias(sha))
    # Rows without identifier by their place in the input.
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    spread = F.pmod(F.xxhash64(id_col, place), F.col(pieces)).cast("int")
    dealt = (keyed.join(F.broadcast(common), sha, "left")
             .select(*columns, head, sha, F.coalesce(spread, F.lit(-1)).alias(piece))
             .repartitionByRange(head, sha, piece))

    # Equal texts lie together in order of identifiers: a run's rows are neighbours that agree in the whole text.
    run = Window.partitionBy(head, sha, piece, norm)
    by_id = run.orderBy(F.col(id_col).asc_nulls_last())
    runs = (dealt.withColumn(norm, normalised(F.col(text)))
            .withColumns({rank: F.row_number().over(by_id), run_min: F.first(id_col).over(by_id),
                          run_size: F.count(F.lit(1)).over(run)})
            .withColumn(leader, F.when((F.col(piece) >= 0) & (F.col(rank) == 1), F.col(norm))).drop(norm, head))
    runs = stored(runs.select(*wanted, sha, piece, rank, run_min, run_size, leader), "text-runs")

    # Pieces of one common text meet by the whole text of their first rows.
    firsts = runs.where(F.col(leader).isNotNull()).select(leader, sha, piece, run_min, run_size)
    least_piece = F.min(F.struct(F.col(run_min).isNull().alias("none"), F.col(run_min).alias("id"), F.col(piece).alias("piece"))).alias(first)
    whole = firsts.groupBy(leader).agg(least_piece, F.sum(run_size).alias("group_size"))
    totals = firsts.join(whole, leader).select(
        (F.col(piece) == F.col(first)["piece"]).alias(first), F.col(first)["id"].alias("keep_id"),
        F.col(sha).alias(t_sha), F.col(piece).alias(t_piece), F.col(run_min).alias(t_min), "group_size")
    joined = runs.join(F.broadcast(totals), (F.col(sha) == F.col(t_sha)) & (F.col(piece) == F.col(t_piece))
                       & F.col(run_min).eqNullSafe(F.col(t_min)), "left")
    split = F.col(piece) >= 0
    return joined.select(
        *wanted, F.when(split, F.col("keep_id")).otherwise(F.col(run_min)).alias("keep_id"),
        F.when(split, F.col("group_size")).otherwise(F.col(run_size)).alias("group_size"),
        ((F.col(rank) == 1) & F.when(split, F.col(first)).otherwise(True)).alias("kept"),
        F.lower(F.hex(sha)).alias("text_sha256"))
