"""Shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BROADCAST_MAX_ROWS = 100_000
HOT_KEY_ROWS = 1_000_000
TURNS_PER_BUCKET = 1024


def fits(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """One bounded count: reads at most ``max_rows + 1`` rows per partition."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only for a side whose size was checked; else Spark and AQE decide."""
    return F.broadcast(df) if fits(df, max_rows) else df


def join_unique(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Join rows to a side that is unique on ``keys``, with hot keys kept off the shuffle.

    Keys with at least ``hot_rows`` rows number at most ``count(rows) / hot_rows``, so the
    hot part of the unique side is small by construction and is broadcast; all other keys
    take the ordinary shuffle join.  Every row takes part exactly once.
    """
    keys = list(keys)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_rows).select(*keys)
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(lookup, keys, how)
    hot_side = lookup.join(F.broadcast(hot), keys, "left_semi")
    spread = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(hot_side), keys, how)
    return rest.unionByName(spread)


def next_in_order(
    df: DataFrame, key: str, order: str, carry: Sequence[str], bucket_rows: int = TURNS_PER_BUCKET,
) -> DataFrame:
    """``lead`` over (key, order) without one task per key; adds ``next_<col>``.

    Rows are windowed per (key, order range); only the first row of each range is
    windowed over the whole key, so a key with n rows costs n / bucket_rows rows there.
    """
    bucket = F.floor(F.col(order) / bucket_rows)
    local = Window.partitionBy(key, "_bucket").orderBy(order, *carry)
    packed = F.struct(*[F.col(c) for c in carry])
    rows = (
        df.withColumn("_bucket", bucket).withColumn("_row", packed)
        .withColumn("_next", F.lead("_row").over(local))
        .withColumn("_last", F.lead(F.lit(1)).over(local).isNull())
    )
    heads = rows.groupBy(key, "_bucket").agg(
        F.min(F.struct(F.col(order), F.col("_row"))).getField("_row").alias("_head")
    )
    after = heads.withColumn(
        "_after", F.lead("_head").over(Window.partitionBy(key).orderBy("_bucket"))
    ).select(key, "_bucket", "_after")
    joined = rows.join(after, [key, "_bucket"], "left")
    nxt = F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))
    return joined.select(*df.columns, *[nxt.getField(c).alias(f"next_{c}") for c in carry])


def quantile(
    df: DataFrame, groups: Sequence[str], value: str, q: float, out: str, nearest_rank: bool = False,
) -> DataFrame:
    """Exact quantile per group from value counts, refined in two steps.

    ``nearest_rank`` gives the nearest-rank value, otherwise the interpolated one.
    """
    return quantile_of_counts(value_counts(df, groups, value), groups, q, out, nearest_rank)


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows per group and distinct value: ``(groups, _v, _n)``, combined on the map side."""
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))


def quantile_of_counts(hist: DataFrame, groups: Sequence[str], q: float, out: str, nearest_rank: bool = False) -> DataFrame:
    """Exact quantile per group from its value counts.

    Counts per range find the range that holds the rank; only the values of that range are
    looked at afterwards.  Ranges are slices of a logarithmic scale, some 256 for each doubling
    of the value, so a group has some ten thousand at most whatever its values: scores between
    0 and 1 spread over thousands, and a window over a group's ranges, or over all of them
    without groups, sees few rows.
    """
    groups = list(groups)
    hist = hist.withColumn("_range", F.floor(256 * F.signum("_v") * F.log2(1 + F.abs("_v") * float(1 << 20))))
    coarse = hist.groupBy(*groups, "_range").agg(F.sum("_n").alias("_n"))
    up_to = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    coarse = coarse.withColumn("_cum", F.sum("_n").over(up_to)).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*groups))
    )
    if nearest_rank:
        at = F.floor(F.col("_total") * q + 0.999999) - 1
        low = high = F.greatest(F.lit(0), F.least(F.col("_total") - 1, at))
        share = F.lit(0.0)
    else:
        at = (F.col("_total") - 1) * F.lit(float(q))
        low, high, share = F.floor(at), F.ceil(at), at - F.floor(at)
    coarse = coarse.withColumn("_low", low).withColumn("_high", high).withColumn("_share", share)
    before = F.col("_cum") - F.col("_n")
    wanted = coarse.filter(
        ((before <= F.col("_low")) & (F.col("_low") < F.col("_cum")))
        | ((before <= F.col("_high")) & (F.col("_high") < F.col("_cum")))
    ).select(*groups, "_range", "_low", "_high", "_share", before.alias("_before"))
    fine_up_to = Window.partitionBy(*groups, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    fine = hist.join(wanted, [*groups, "_range"]).withColumn(
        "_cum", F.col("_before") + F.sum("_n").over(fine_up_to)
    )
    per_group = fine.groupBy(*groups).agg(
        F.min(F.when(F.col("_cum") > F.col("_low"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.col("_high"), F.col("_v"))).alias("_b"),
        F.max("_share").alias("_share"),
    )
    return per_group.select(
        *groups, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias(out)
    )
