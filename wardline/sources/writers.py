"""Sinks: audit table, batches of streams, reports, CSV, reference embeddings."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.functions import hooks


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_batch(df: DataFrame, path: str, batch: object, *partition: str) -> DataFrame:
    """Write one batch as a folder of its own, replacing what an earlier attempt left of it; returns the batch as written.

    A replayed batch writes the same folder again, so nothing is added twice and no history is read: the folder is all that is
    listed or opened.
    """
    folder = f"{path.rstrip('/')}/batch={batch}"
    df.write.mode("overwrite").partitionBy(*partition).parquet(folder)
    return df.sparkSession.read.schema(df.schema).option("basePath", folder).parquet(folder).select(*df.columns)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a sink as one table."""
    return spark.read.parquet(path).drop("batch")


def write_audit(df: DataFrame, path: str, batch: object | None = None) -> DataFrame:
    """Insert once per request id: first copy wins; one folder per batch, partitioned by date. Returns the rows written.

    A caller that numbers its batches and sends no id twice (the stream does both) names the ``batch``: then no stored row is
    read. Without a name, ids that are stored already are skipped, for which the stored ids, and no other column, are read.
    """
    new = df.dropDuplicates(["request_id"]) if batch is None else df
    stored = read_or_none(df.sparkSession, path) if batch is None else None
    if stored is not None:
        new = new.join(stored.select("request_id"), "request_id", "left_anti")
    return write_batch(new.withColumn("date", F.to_date("ts")), path, f"insert-{uuid.uuid4().hex}" if batch is None else batch, "date")


def row_digest(df: DataFrame) -> Column:
    """A digest of a whole row, nulls included."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


def audit_export_view(df: DataFrame) -> DataFrame:
    """The nine export columns as text."""
    called = F.when(F.col("model_used").isNotNull() & ~F.col("model_used").isin("", "none"), "Yes").otherwise("No")
    return df.select(
        F.col("request_id").cast("string").alias("Request ID"), F.col("use_case").alias("Use Case"),
        F.col("action_taken").alias("Action"),
        F.replace(F.format_number(F.coalesce("risk_score", F.lit(0.0)), 3), F.lit(","), F.lit("")).alias("Risk Score"),
        F.col("risk_level").alias("Risk Level"), called.alias("LLM Called"), F.col("latency_ms").alias("Latency (ms)"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp"), F.coalesce("prompt", F.lit("")).alias("Prompt"),
    )


def export_audit_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes; one file per partition."""
    audit_export_view(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, one report row each."""
    df.write.mode("overwrite").json(path)


def load_reference_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Latest complete version of the reference table."""
    table = spark.read.parquet(path)
    last = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == last).drop("version")


def upsert_reference_embeddings(seeds: DataFrame, path: str, key: str, text: str, encoder=hooks.hashed_ngrams) -> int:
    """Embed seeds and replace them by key; a changed vector size starts a fresh table.

    Every call writes one complete new version, so a reader never sees half an update.
    Returns the version.
    """
    spark = seeds.sparkSession
    fresh = hooks.embed(seeds.dropDuplicates([key]), text, "embedding", encoder)
    bad = fresh.filter(F.col("embedding").isNull()).limit(1).count()
    if bad:
        raise ValueError("embedding failed for at least one seed")
    stored = read_or_none(spark, path)
    if stored is None:
        version, merged = 1, fresh
    else:
        version = stored.agg(F.max("version")).first()[0] + 1
        old = load_reference_embeddings(spark, path)
        size = lambda d: (d.agg(F.max(F.size("embedding"))).first() or [None])[0]
        same = size(old) == size(fresh)
        merged = old.join(fresh.select(key), key, "left_anti").unionByName(fresh) if same else fresh
    merged.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
    return version
