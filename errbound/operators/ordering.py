"""Ordered operators that never put a whole key, or the whole table, into one task.

Every operator here splits a key's rows into order-preserving buckets of bounded size, works inside
``(key, bucket)`` and stitches the buckets together through a small per-bucket table.  A key that
holds a third of all rows is therefore spread over as many tasks as its share asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1 << 20
TILE = 1 << 16


def _as_number(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name].startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def with_bucket(df: DataFrame, order: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                width: int | None = None) -> DataFrame:
    """Add ``_bucket``: order-preserving slices of ``order``.

    With ``width`` the slices are that wide, which bounds them when ``order`` is a unique integer.
    Otherwise they are equal-width slices, as many as the row count asks for; the width comes from a
    one-row aggregate, so it adapts to the data without an action.  Rounding is monotone, so slices
    never swap the order of two rows.
    """
    if width:
        return df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)))
    key = _as_number(df, order)
    facts = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    facts = facts.select("_lo", (F.col("_hi") - F.col("_lo")).alias("_span"),
                         F.ceil(F.col("_n") / F.lit(rows_per_bucket)).alias("_nb"))
    slot = F.floor(F.try_divide((key - F.col("_lo")) * F.col("_nb"), F.col("_span")))
    return (df.crossJoin(F.broadcast(facts))
            .withColumn("_bucket", F.coalesce(F.least(slot, F.col("_nb") - 1), F.lit(0)))
            .drop("_lo", "_nb", "_span"))


def ordered_prefix(df: DataFrame, keys: list[str], order: list[str], pos: str | None = None,
                   sums: dict[str, str] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
                   width: int | None = None) -> DataFrame:
    """Position and inclusive running sums of each row inside its key, ordered by ``order``.

    One shuffle of the rows, on (key, bucket); bucket totals are pre-aggregated map-side and their
    offsets joined back.  Rows that share one exact value of the first order column stay in one bucket
    (its sort spills to disk).
    """
    sums = sums or {}
    tagged = with_bucket(df, order[0], rows_per_bucket, width)
    part = keys + ["_bucket"]
    totals = tagged.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"),
                                       *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), *[
        F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in sums])
    w = Window.partitionBy(*part).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumns({"_local": F.row_number().over(w)} | {f"_local_{c}": F.sum(c).over(so_far) for c in sums})
    added = {out: F.col(f"_start_{c}") + F.col(f"_local_{c}") for c, out in sums.items()}
    if pos:
        added[pos] = F.col("_start") + F.col("_local") - 1
    return local.join(starts, part).withColumns(added).drop(
        "_bucket", "_local", "_start", *[f"_local_{c}" for c in sums], *[f"_start_{c}" for c in sums])


def with_position(df: DataFrame, keys: list[str], order: list[str], pos: str = "pos",
                  rows_per_bucket: int = ROWS_PER_BUCKET, width: int | None = None) -> DataFrame:
    """Dense 0-based position of each row inside its key."""
    return ordered_prefix(df, keys, order, pos, None, rows_per_bucket, width)


def running_sum(df: DataFrame, keys: list[str], pos: str, sums: dict[str, str], tile: int = TILE) -> DataFrame:
    """Inclusive running sums along the unique integer ``pos``; ``sums`` maps column to result."""
    return ordered_prefix(df, keys, [pos], None, sums, width=tile)


def with_neighbours(df: DataFrame, keys: list[str], pos: str, cols: list[str], before: int = 0,
                    after: int = 0, tile: int = TILE) -> DataFrame:
    """Add ``{col}_m{j}`` / ``{col}_p{j}``: the value j positions before / after, NULL outside.

    ``pos`` must be dense.  Rows are tiled by position; the few rows at a tile edge are sent to the
    adjoining tile as well, so one shuffle serves every offset and no task sees more than a tile.
    """
    own = F.floor(F.col(pos) / F.lit(tile))
    inside = F.col(pos) - own * tile
    homes = [own]
    if before:
        homes.append(F.when(inside >= tile - before, own + 1))
    if after:
        homes.append(F.when((inside < after) & (own > 0), own - 1))
    spread = (df.withColumn("_own", own)
              .withColumn("_tile", F.explode(F.array_compact(F.array(*homes)))))
    w = Window.partitionBy(*keys, "_tile").orderBy(pos)
    added = {}
    for c in cols:
        added |= {f"{c}_m{j}": F.lag(c, j).over(w) for j in range(1, before + 1)}
        added |= {f"{c}_p{j}": F.lead(c, j).over(w) for j in range(1, after + 1)}
    return spread.withColumns(added).where("_tile = _own").drop("_tile", "_own")


def lag_sparse(df: DataFrame, keys: list[str], order: str, cols: list[str],
               rows_per_bucket: int = ROWS_PER_BUCKET, width: int | None = None) -> DataFrame:
    """Add ``prev_{col}``: the value in the preceding row by the unique numeric column ``order``."""
    tagged = with_bucket(df, order, rows_per_bucket, width)
    part = keys + ["_bucket"]
    last = tagged.groupBy(*part).agg(*[F.max_by(c, order).alias(f"_v_{c}") for c in cols])
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    edges = last.select(*part, *[F.lag(f"_v_{c}").over(by_bucket).alias(f"_edge_{c}") for c in cols])
    w = Window.partitionBy(*part).orderBy(order)
    local = tagged.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols}).withColumn(
        "_first", F.lag(order).over(w).isNull())
    joined = local.join(edges, part, "left")
    fill = {f"prev_{c}": F.when(F.col("_first"), F.col(f"_edge_{c}")).otherwise(F.col(f"prev_{c}"))
            for c in cols}
    return joined.withColumns(fill).drop("_bucket", "_first", *[f"_edge_{c}" for c in cols])


def to_chunks(df: DataFrame, keys: list[str], pos: str, value: str, length: int,
              chunk: str = "chunk_id", out: str = "vals") -> DataFrame:
    """Gather runs of ``length`` consecutive positions into ordered arrays (never more)."""
    return (df.withColumn(chunk, F.floor(F.col(pos) / F.lit(length)))
            .groupBy(*keys, chunk)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))),
                             lambda s: s[value]).alias(out)))


def from_chunks(df: DataFrame, keys: list[str], length: int, cols: dict[str, str],
                pos: str = "pos", chunk: str = "chunk_id") -> DataFrame:
    """Inverse of :func:`to_chunks`: one row per element, ``cols`` maps array name to element name."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    flat = df.select(*keys, chunk, F.posexplode(zipped).alias("_i", "_e"))
    return flat.select(*keys, (F.col(chunk) * length + F.col("_i")).alias(pos),
                       *[F.col(f"_e.{src}").alias(dst) for src, dst in cols.items()])
