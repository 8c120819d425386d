"""Incremental ingestion of listings: a file stream of raw listings, normalised, validated and upserted into the pool by URL.

The pool is Parquet in a fixed number of buckets, by a hash of the URL.  A batch reads and rewrites only the buckets that
its listings fall into; a version is a small manifest that names the folder of each bucket.  A manifest appears by one
rename, so readers see the version before or the one after, whenever a writer dies; folders are deleted only once newer
manifests no longer name them.

A manifest also says of each bucket how long ago its fresh and its stale listings were seen, so that lookups and sweeps of
freshness leave buckets unread in which nothing is fresh, or nothing changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelforge.operators.pool import EXPIRE_DAYS, STALE_DAYS, by_part, merge_listings, normalize_comparable, save_stats, unique_first, validate_listing, with_freshness

c = F.col
#: Buckets of a new pool, and versions that are kept for readers that have begun.
BUCKETS, KEEP = 64, 3
#: Rows of a bucket that a task merges and writes as one file; larger buckets are several files.
PART_ROWS = 250_000
#: What validation reads beside the normalised listing.
SCOPE = ("crit_city", "crit_district", "crit_neighborhood", "subject_area", "subject_room_text", "image_source", "property_type")


class PoolFiles:
    """Manifests and folders of a pool, on whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, top: str):
        self.jvm, self.top = spark.sparkContext._jvm, top.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self.names("_versions") if n.isdigit()]

    def manifest(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"_versions/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The newest manifest; None before the first.  Data without any manifest, other than of a first batch that died, is an error."""
        versions = self.versions()
        if versions:
            return self.manifest(versions[-1])
        if len(self.names("data")) > 1:
            raise RuntimeError(f"{self.top} holds several folders of data and no manifest: the pool's versions have been lost")
        return None

    def commit(self, version: int, manifest: dict) -> None:
        """Writes the manifest beside its place, then renames it there: it is whole or absent.  Fails if the version is there."""
        before, place = self.path(f"_versions/.{uuid.uuid4().hex}"), self.path(f"_versions/{version:012d}")
        stream = self.fs.create(before)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self.fs.exists(place) or not self.fs.rename(before, place):
            raise RuntimeError(f"version {version} of {self.top} was written by another writer")

    def clean(self, keep: int = KEEP) -> None:
        """Deletes manifests older than the newest `keep`, and the folders that only they name."""
        versions = self.versions()
        if len(versions) <= keep:
            return
        named = {p.split("/")[1] for v in versions[-keep:] for p in self.manifest(v)["buckets"].values()}
        old = {p.split("/")[1] for v in versions[:-keep] for p in self.manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            self.fs.delete(self.path(f"_versions/{v:012d}"), False)
        for folder in old - named:
            self.fs.delete(self.path(f"data/{folder}"), True)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source_url"), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, pool_path: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(manifest["schema"])
    paths = [f"{pool_path.rstrip('/')}/{p}" for b, p in sorted(manifest["buckets"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current_pool(spark: SparkSession, pool_path: str) -> DataFrame | None:
    """The pool's newest version; None before the first."""
    manifest = PoolFiles(spark, pool_path).latest()
    return read_buckets(spark, pool_path, manifest) if manifest else None


def zones_of(rows: DataFrame) -> dict[str, list]:
    """Of each bucket: the earliest last_seen_at of fresh rows and of stale ones, the latest of all, and how many rows it has.  A row for each bucket."""
    seen = c("last_seen_at").cast("string")
    low = lambda state: F.min(F.when(c("freshness") == state, seen))
    return {str(r["bucket"]): [r["fresh"], r["stale"], r["latest"], r["n"]] for r in rows.groupBy("bucket").agg(low("FRESH").alias("fresh"), low("STALE").alias("stale"), F.max(seen).alias("latest"), F.count(F.lit(1)).alias("n")).collect()}


def parts_of(manifest: dict | None, rows: dict[int, int]) -> int:
    """In how many parts buckets are merged that get some more rows each: as many as the largest of them needs."""
    zones = (manifest or {}).get("zones", {})
    held = {b: (zones[str(b)][3] if len(zones.get(str(b), ())) > 3 else 0) for b in rows}
    return max([1, *(-(-(n + held[b]) // PART_ROWS) for b, n in rows.items())])


def write_version(files: PoolFiles, rows: DataFrame, before: dict | None, batch_id: int, buckets: int) -> dict:
    """Writes rows that lie by bucket, as one file for each part of it, and the manifest of a version in which they take their buckets' places."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy("bucket").parquet(f"{files.top}/{folder}")
    zones = zones_of(spark.read.schema(rows.select("last_seen_at", "freshness", "bucket").schema).parquet(f"{files.top}/{folder}"))
    manifest = {
        "batch": batch_id, "of": buckets, "schema": rows.drop("bucket").schema.jsonValue(),
        "buckets": (before["buckets"] if before else {}) | {b: f"{folder}/bucket={b}" for b in zones}, "zones": (before.get("zones", {}) if before else {}) | zones,
    }
    versions = files.versions()
    files.commit(versions[-1] + 1 if versions else 0, manifest)
    files.clean()
    return manifest


def merge_batch(batch: DataFrame, batch_id: int, pool_path: str, order: list, buckets: int = BUCKETS) -> None:
    """One micro-batch of listings with seen_at: its first row of each URL replaces the pool's, which keeps first_seen_at.

    The batch's rows are picked and dealt out once, in files of their own; the pool's buckets that they fall into are read,
    merged with them and written, one file each.  Applying it twice is as once: a batch that the newest manifest has is left
    out, and as_of is the batch's own latest `seen_at`, so that a replay gives the same rows.
    """
    spark = batch.sparkSession
    files = PoolFiles(spark, pool_path)
    before = files.latest()
    if before and before["batch"] >= batch_id:
        return
    buckets = before["of"] if before else buckets
    picked = unique_first(batch.where(F.coalesce("source_url", F.lit("")) != ""), ["source_url"], order).withColumn("bucket", bucket_of(buckets))
    staged = f"{files.top}/_picked/batch={batch_id}"
    picked.write.mode("overwrite").parquet(staged)
    one = spark.read.schema(picked.schema).parquet(staged)
    counts = one.groupBy("bucket").agg(F.max("seen_at").alias("seen"), F.count(F.lit(1)).alias("n")).collect()  # a row for each bucket at most
    touched = {r["bucket"]: r["seen"] for r in counts}
    if touched:
        incoming = one.drop("seen_at")
        if before:
            old = read_buckets(spark, pool_path, before, set(touched)).withColumn("bucket", bucket_of(buckets))
        else:
            old = incoming.limit(0).withColumns({"first_seen_at": F.lit(None).cast("timestamp"), "last_seen_at": F.lit(None).cast("timestamp"), "is_active": F.lit(None).cast("boolean"), "freshness": F.lit(None).cast("string")})
        new = merge_listings(old, incoming, F.lit(max(touched.values())).cast("timestamp"), "bucket", parts=parts_of(before, {r["bucket"]: r["n"] for r in counts}), buckets=len(touched))
        write_version(files, new, before, batch_id, buckets)
    files.fs.delete(files.path(f"_picked/batch={batch_id}"), True)


def due(zone: list[str | None], as_of: str) -> bool:
    """Whether a row of a bucket changes its freshness by then; as_of as Spark writes timestamps."""
    at = datetime.fromisoformat(as_of)
    fresh, stale = (datetime.fromisoformat(x) if x else None for x in zone[:2])
    return bool((fresh and fresh + timedelta(days=STALE_DAYS) <= at) or (stale and stale + timedelta(days=EXPIRE_DAYS) <= at))


def sweep(spark: SparkSession, pool_path: str, as_of: str) -> int:
    """Writes the freshness that listings have at a time (`2024-01-31 00:00:00`, in the session's time zone) and gives the number of buckets rewritten.

    Only buckets are read and written in which a row becomes stale or expires by then; which ones do is known from the
    manifest.  So a second sweep at the same time touches no file.  as_of doesn't go back.
    """
    files = PoolFiles(spark, pool_path)
    before = files.latest()
    zones = (before or {}).get("zones", {})
    touched = {int(b) for b in (before or {}).get("buckets", {}) if b not in zones or due(zones[b], as_of)}
    if not touched:
        return 0
    rows = with_freshness(read_buckets(spark, pool_path, before, touched), F.lit(as_of).cast("timestamp"), "last_seen_at").drop("expires_at")
    rows = by_part(rows.withColumn("bucket", bucket_of(before["of"])), "bucket", "source_url", parts_of(before, dict.fromkeys(touched, 0)), len(touched)).drop("part_")
    write_version(files, rows.select(*[f["name"] for f in before["schema"]["fields"]], "bucket"), before, before["batch"], before["of"])
    return len(touched)


def live_pool(spark: SparkSession, pool_path: str, as_of: str) -> DataFrame | None:
    """The pool's rows that may be fresh at a time: buckets without a later sighting than STALE_DAYS before it aren't read."""
    manifest = PoolFiles(spark, pool_path).latest()
    if not manifest:
        return None
    edge = datetime.fromisoformat(as_of) - timedelta(days=STALE_DAYS)
    zones = manifest.get("zones", {})
    fresh = {int(b) for b in manifest["buckets"] if b not in zones or (zones[b][2] and datetime.fromisoformat(zones[b][2]) > edge)}
    return read_buckets(spark, pool_path, manifest, fresh).where(c("last_seen_at") > F.lit(str(edge)).cast("timestamp"))


def normalized(raw: DataFrame) -> DataFrame:
    """Raw rows (as normalize_comparable() and SCOPE name them, with seen_at) in the common schema."""
    return normalize_comparable(raw, c("seen_at"), keep=("seen_at", *SCOPE))


def rejects(spark: SparkSession, pool_path: str) -> DataFrame:
    """(batch, reason, n): rows of each batch by the reason why they were left out; `saved` for those that weren't."""
    return spark.read.schema("reason string, n long, batch long").parquet(f"{pool_path.rstrip('/')}/_stats")


def start_ingest(stream: DataFrame, pool_path: str, checkpoint: str, order: list | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts the upserts of a stream of listings with seen_at.

    `prepare` puts raw rows in the common schema with SCOPE (normalized()); they are then validated, and rows that fail are
    counted by reason and left out.  Without it, rows are taken as validated.  Rows are deduplicated within a
    micro-batch only: a later sighting must update price and last_seen_at.
    """
    by = order or [F.desc("seen_at"), c("external_id" if prepare else "listing_uid")]
    top = pool_path.rstrip("/")

    def merge(batch: DataFrame, batch_id: int) -> None:
        if prepare:
            # normalised and validated once, for the counts and the upsert; a batch that is run again overwrites its own
            staged = validate_listing(prepare(batch)).drop(*SCOPE)
            staged.write.mode("overwrite").parquet(f"{top}/_staged/batch={batch_id}")
            rows = batch.sparkSession.read.schema(staged.schema).parquet(f"{top}/_staged/batch={batch_id}")
            save_stats(rows).coalesce(1).write.mode("overwrite").parquet(f"{top}/_stats/batch={batch_id}")
            batch = rows.where("ok").drop("ok", "reason")
        merge_batch(batch, batch_id, pool_path, by, buckets)
        if prepare:
            files = PoolFiles(batch.sparkSession, pool_path)
            files.fs.delete(files.path(f"_staged/batch={batch_id}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
