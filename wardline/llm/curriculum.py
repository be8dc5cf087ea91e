"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, made of linear pieces. Its integral is the source's share of
the tokens; the running integral, scaled to the source's target, is the source's cumulative token demand. Documents of a
source line up in a fixed pseudo-random order (epoch after epoch if the target exceeds what the source holds) and each copy
is trained when the demand reaches the middle of the copy: its training position is the inverse of the demand there.

Scale: the only wide shuffle deals documents by (source, slice of the order), 4,096 slices for each source, so that a source
with a third of all rows is 4,096 groups. Running sums use slice totals (map-side combined), never one window over a source.

Nulls and edges: null text has size 0; null source is a source of its own, last in order; null doc_id orders as empty text;
equal rows are interchangeable; without words at all, every target is 0 and nothing is taken. Extra columns ride along; an
input column named like one of the operator's is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wardline.llm.shared import WORD, documents

#: A schedule: linear pieces (start, end, weight at start, weight at end) over training time 0..1.
Schedule = list[tuple[float, float, float, float]]

#: Integrals 1, 2 and 3: early sources fade, the second kind is even, the third rises to a plateau.
DEFAULT_SCHEDULES: list[Schedule] = [
    [(0.0, 1.0, 1.5, 0.5)],
    [(0.0, 1.0, 2.0, 2.0)],
    [(0.0, 0.5, 1.0, 3.5), (0.5, 1.0, 3.5, 4.0)],
]
MAX_REPEATS = 3
SLICE_DIGITS = 3


def integral(schedule: Schedule) -> float:
    return sum((b - a) * (u + v) / 2 for a, b, u, v in schedule)


def _pieces(schedule: Schedule) -> Column:
    """The schedule as an array of structs with the share of the integral that lies before each piece."""
    done, total, out = 0.0, integral(schedule), []
    for a, b, u, v in schedule:
        out.append(F.struct(*(F.lit(x).alias(n) for n, x in zip("abuvc", map(float, (a, b, u, v, done / total)), strict=True)), F.lit(float(total)).alias("w")))
        done += (b - a) * (u + v) / 2
    return F.array(*out)


def demand_inverse(share: Column, pieces: Column) -> Column:
    """Training time at which a source has used `share` (0..1) of its tokens: the root of the piece's quadratic integral."""
    p = F.element_at(F.filter(pieces, lambda s: (s["c"] <= share) | (s["c"] == 0)), -1)
    area, slope = (share - p["c"]) * p["w"], (p["v"] - p["u"]) / (p["b"] - p["a"])
    root = F.sqrt(F.greatest(F.lit(0.0), p["u"] * p["u"] + 2 * slope * area))
    # 2*area / (u + root) is the root's form that also holds for an even piece
    return F.least(p["b"], p["a"] + F.when(p["u"] + root > 0, 2 * area / (p["u"] + root)).otherwise(0.0))


def source_targets(sizes: DataFrame, schedules: list[Schedule], repeats: int) -> DataFrame:
    """Targets per source from (source_key, source_null, source, source_size): weights repeat over the sorted sources, caps reshare.

    One row per source comes in, so the windows over all of them see few rows whatever the documents' number.
    """
    weights = F.array(*(F.lit(float(integral(s))) for s in schedules))
    pieces = F.array(*(_pieces(s) for s in schedules))
    order = W.orderBy("source_null", "source")
    kind = ((F.row_number().over(order) - 1) % len(schedules) + 1).cast("int")
    ranked = sizes.withColumn("kind", kind).withColumn("weight", F.element_at(weights, F.col("kind"))).withColumn("most", (F.lit(repeats) * F.col("source_size")).cast("double"))
    level = W.orderBy(F.col("most") / F.col("weight"), "source_null", "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("most").over(level), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(level), F.lit(0.0))
    levelled = ranked.withColumn("lam", left / open_weight).withColumn("fits", F.col("lam") <= F.col("most") / F.col("weight"))
    lam = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), "source_null", "source", "lam"))).over(everything)
    return levelled.select("source_key", "source_size", F.least(F.col("most"), F.col("weight") * lam["lam"]).alias("target"), F.element_at(pieces, F.col("kind")).alias("pieces"))


def mix(docs: DataFrame, schedules: list[Schedule] | None = None, repeats: int = MAX_REPEATS) -> DataFrame:
    """`docs` (doc_id, text, source, ...) with size, source_size, target, copies, taken and positions (one training time a copy)."""
    schedules = schedules or DEFAULT_SCHEDULES
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    source_key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "source"))
    d = docs.select(F.struct("*").alias("row"), "source", source_key.alias("source_key"), "doc_id", size.alias("size"), key.alias("key")).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = d.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source"))
    sources = slices.groupBy("source_key").agg(F.sum("slice_size").alias("source_size"), F.first("source").alias("source")).withColumn("source_null", F.col("source").isNull())
    before = F.coalesce(F.sum("slice_size").over(W.partitionBy("source_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = slices.select("source_key", "slice", before.alias("before")).join(source_targets(sources, schedules, repeats), "source_key")
    within = W.partitionBy("source_key", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = d.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source_key", "slice"])
    middle = F.col("before") + F.col("ahead") + F.col("size") / F.lit(2.0)
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size")))).otherwise(0).cast("long")
    placed = placed.withColumn("middle", middle).withColumn("copies", copies)
    at = lambda e: demand_inverse((e * F.col("source_size") + F.col("middle")) / F.col("target"), F.col("pieces"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    own = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size"), "positions": positions}
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in own]
    return placed.select(*kept, *(v.alias(k) for k, v in own.items()))


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy, range-sorted by its training position."""
    each = mixed.select(*(c for c in columns if c not in ("copy", "position")), F.posexplode("positions").alias("copy", "position"))
    return each.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and the words that the curriculum places: `taken` counts the copies that got a training time, rows come by their first one."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    placed = F.filter("positions", lambda at: (at >= 0) & (at <= 1))
    mixed = mix(docs).withColumn("taken", F.size(placed) * F.col("size")).withColumn("first", F.array_min(placed))
    ordered = mixed.select("doc_id", "size", "source_size", "target", "taken", "first").orderBy(F.col("first").asc_nulls_last(), "doc_id")
    return ordered.drop("first")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS lam
      FROM w WINDOW p AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * (SELECT lam FROM l WHERE lam <= most / weight ORDER BY most / weight, source NULLS LAST LIMIT 1)) AS target FROM l),
a AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN greatest(0, ceil((target - (ahead + size / 2.0::DOUBLE)) / source_size)) ELSE 0 END)::BIGINT * size AS taken
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source
"""
