"""Pairs of items generated bucket by bucket, so a run that was stopped goes on where it was."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import MICROS
from quillon.operators.items import band_join
from quillon.sources.items import exists

MANIFEST = "signature string, bucket int"


def _signature(items: DataFrame, item: str, columns: list[str], seconds: float, buckets: int, strict: bool) -> str:
    """What the pairs depend on: the parameters, and count and hash sums of the items' ids, groups and times."""
    row = items.select(F.xxhash64(*columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{seconds}/{buckets}/{strict}/{row.n}/{row.s}"


def done_buckets(spark: SparkSession, path: str, signature: str) -> set[int]:
    """The buckets that the manifest lists under the signature."""
    at = f"{path.rstrip('/')}/manifest"
    if not exists(spark, at):
        return set()
    return {r.bucket for r in spark.read.schema(MANIFEST).parquet(at).where(F.col("signature") == signature).select("bucket").distinct().collect()}


def resumable_pairs(
    items: DataFrame, path: str, group: str, item: str, time_us: str, seconds: float, select: list[Column], strict: bool = False,
    buckets: int = 64, at_once: int = 16, stop_after: int | None = None,
) -> DataFrame | None:
    """The pairs of ``band_join`` with the columns ``select`` (of l.* and r.*), kept at ``path`` as Parquet by bucket.

    A bucket is a hash of the left item's group and stretch of time, so a busy group is spread over all of them. ``at_once``
    buckets are a job; the manifest lists them once their files are there. A rerun makes the missing ones only; files of a
    job that was killed before its entry are replaced. Other items or parameters have another signature and start anew in
    a folder of their own. ``stop_after`` jobs it returns None, as if killed.
    """
    spark = items.sparkSession
    width = max(int(seconds * MICROS), 1)
    signature = _signature(items, item, [group, item, time_us], seconds, buckets, strict)
    folder = f"{path.rstrip('/')}/pairs-{hashlib.md5(signature.encode()).hexdigest()}"
    made = done_buckets(spark, path, signature)
    missing = [b for b in range(buckets) if b not in made]
    bucket = F.pmod(F.xxhash64(F.col(f"l.{group}"), F.floor(F.col(f"l.{time_us}") / width)), F.lit(buckets)).cast("int")
    paired = band_join(items, group, item, time_us, seconds, strict)
    for turn, k in enumerate(range(0, len(missing), at_once)):
        if stop_after is not None and turn >= stop_after:
            return None
        own = missing[k : k + at_once]
        writer = paired.where(bucket.isin(own)).select(*select, bucket.alias("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        writer.parquet(folder)
        spark.createDataFrame([(signature, b) for b in own], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return spark.read.schema(paired.select(*select, bucket.alias("bucket")).schema).parquet(folder).drop("bucket")
