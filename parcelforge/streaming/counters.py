"""Counters of reports, kept by a stream of their changes.

An event is what a report is like from some version on: its owner, when it was created, its status and whether it is
deleted.  The newest version of each report is kept in buckets, as the pool of listings is; a newer one takes back what the
one before counted and counts anew, an older one that comes late changes nothing.  So the counters are those of the
reports as they are, whatever the order of their events.  A micro-batch reads and writes only the buckets that it falls
into, and writes its changes as rows to be added up; a batch that runs again overwrites its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelforge.streaming.ingest import BUCKETS, PoolFiles, read_buckets

c = F.col
#: What is counted: all reports, those that aren't deleted, deleted ones, and those that use up a month's quota.
COUNTS = ("total", "active", "deleted", "used")
CHANGES = "user_id long, month date, " + ", ".join(f"{x} long" for x in COUNTS)


def counted(events: DataFrame, buckets: int) -> DataFrame:
    """(bucket, report_id, version, user_id, month, what the report counts for) of events (report_id, version, user_id, created_at, status, is_deleted)."""
    kept, used = ~c("is_deleted"), ~c("is_deleted") & (c("status") != "DRAFT")
    one = lambda x: F.coalesce(x, F.lit(False)).cast("long")
    return events.where("report_id is not null and version is not null and user_id is not null").select(
        F.pmod(F.xxhash64(c("report_id").cast("long")), F.lit(buckets)).cast("int").alias("bucket"), c("report_id").cast("long").alias("report_id"), c("version").cast("long").alias("version"), c("user_id").cast("long").alias("user_id"),
        F.trunc("created_at", "month").alias("month"), F.lit(1).cast("long").alias("total"), one(kept).alias("active"), one(c("is_deleted")).alias("deleted"), one(used).alias("used"),
    )


def add_batch(batch: DataFrame, batch_id: int, folder: str, buckets: int = BUCKETS) -> None:
    """One micro-batch of events.  Of equal versions of a report, the one that is there stays."""
    spark, top = batch.sparkSession, folder.rstrip("/")
    files = PoolFiles(spark, f"{top}/states")
    before = files.latest()
    if before and before["batch"] >= batch_id:
        return
    buckets = before["of"] if before else buckets
    rows = counted(batch, buckets)
    touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most one for each bucket
    if not touched:
        return
    old = read_buckets(spark, files.top, before, touched).where("rank_ = 1").drop("new_", "rank_", "changed_") if before else rows.drop("bucket").limit(0)
    old = old.withColumn("bucket", F.pmod(F.xxhash64("report_id"), F.lit(buckets)).cast("int"))
    both = old.withColumn("new_", F.lit(False)).unionByName(rows.withColumn("new_", F.lit(True))).repartition("bucket")
    of_report = Window.partitionBy("bucket", "report_id")
    values = [c(x) for x in ("user_id", "month", *COUNTS)]
    order = of_report.orderBy(F.desc("version"), "new_", *values)
    both = both.withColumns({"rank_": F.row_number().over(order), "changed_": F.first("new_").over(order)}).where((c("rank_") == 1) | (c("changed_") & ~c("new_")))
    place = f"data/{uuid.uuid4().hex}"
    both.write.partitionBy("bucket").parquet(f"{files.top}/{place}")
    merged = spark.read.schema(both.schema).parquet(f"{files.top}/{place}")
    sign = F.when(c("rank_") == 1, 1).otherwise(-1)
    summed = merged.where("changed_").groupBy("user_id", "month").agg(*[F.sum(c(x) * sign).alias(x) for x in COUNTS])
    summed.write.mode("overwrite").parquet(f"{top}/changes/batch={batch_id}")
    places = (before["buckets"] if before else {}) | {str(b): f"{place}/bucket={b}" for b in touched}
    versions = files.versions()
    files.commit(versions[-1] + 1 if versions else 0, {"batch": batch_id, "of": buckets, "schema": both.drop("bucket").schema.jsonValue(), "buckets": places})
    files.clean()


def start_counters(events: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the counters of a stream of events below `folder`; events without a report, version or owner are left out."""
    return events.writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, folder, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, month, total, active, deleted, used), without months in which nothing is left."""
    rows = spark.read.schema(CHANGES + ", batch long").parquet(f"{folder.rstrip('/')}/changes")
    return rows.groupBy("user_id", "month").agg(*[F.sum(x).alias(x) for x in COUNTS]).where("total > 0")


def used_in(counts: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, used) of the month of as_of."""
    return counts.where(c("month") == F.trunc(as_of, "month")).select("user_id", "used")
