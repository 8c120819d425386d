"""Images of listings: unique candidates, reuse, filling gaps; area coverage before and after enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import contains_any, js_round
from parcelforge.operators.pool import unique_first

c = F.col


def image_priority(url: Column) -> Column:
    return priority_of(F.lower(url))


def priority_of(u: Column) -> Column:
    """image_priority() of a URL in lower case."""
    return F.when(u.contains("imaj.emlakjet.com"), 100).when(u.contains("i.remax.com.tr/photos"), 95).when(u.contains("hepsiemlak") & contains_any(u, ("image", "photo", "listing", "cdn")), 90).when(contains_any(u, ("listing", "photo", "image", "resize")), 60).otherwise(10)


def without_query(url: Column) -> Column:
    return F.when(contains_any(url, "?#"), F.regexp_replace(url, r"[?#].*$", "")).otherwise(url)


def image_key(url: Column) -> Column:
    """Without query, fragment and size."""
    return key_of(without_query(F.coalesce(url, F.lit(""))))


def key_of(path: Column) -> Column:
    """image_key() of a URL without query and fragment."""
    return F.when(F.lower(path).contains("/resize/"), F.regexp_replace(path, r"(?i)/resize/\d+/\d+/", "/resize/")).otherwise(path)


def unique_images(df: DataFrame) -> DataFrame:
    """One image of each key of a listing, the one of highest priority, with rank.  df: (listing_uid, url, ord)."""
    return best_images(df.withColumns({"image_key": image_key(c("url")), "priority": image_priority(c("url"))}))


def best_images(df: DataFrame) -> DataFrame:
    """unique_images() of rows that have image_key and priority."""
    rows = df.repartition("listing_uid")
    one = unique_first(rows, ["listing_uid", "image_key"], [F.desc("priority"), c("ord"), c("url")])
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("listing_uid").orderBy(F.desc("priority"), "ord", "url")))


def reusable_images(items: DataFrame, listings: DataFrame) -> DataFrame:
    """Items (item_id, source_url, listing_url) with the newest stored image of a listing that either URL names."""
    stored = listings.where(c("image_url").isNotNull())
    keyed = stored.select(c("source_url").alias("url"), "image_url", "updated_at").union(stored.where(c("listing_url").isNotNull()).select(c("listing_url").alias("url"), "image_url", "updated_at"))
    newest = unique_first(keyed, ["url"], [F.desc("updated_at"), c("image_url")])
    wanted = items.select("item_id", F.explode(F.array_distinct(F.array_compact(F.array("source_url", "listing_url")))).alias("url"))
    found = unique_first(wanted.join(newest, "url"), ["item_id"], [F.desc("updated_at"), c("image_url")]).select("item_id", c("image_url").alias("reused_image"))
    return items.join(found, "item_id", "left")


def fill_images(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """The k-th item of a subject without image gets the k-th image of its pool that no item uses.

    items: (subject_id, item_id, image_url, ord); candidates: (subject_id, url, priority).
    """
    used = items.where(c("image_url").isNotNull()).select("subject_id", image_key(c("image_url")).alias("key_")).distinct()
    free = candidates.withColumn("key_", image_key(c("url"))).join(used, ["subject_id", "key_"], "left_anti")
    free = unique_first(free, ["subject_id", "key_"], [F.desc("priority"), c("url")])
    pool = free.select("subject_id", c("url").alias("fill_url"), F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("priority"), "url")).alias("k"))
    lacking = items.where(c("image_url").isNull()).withColumn("k", F.row_number().over(Window.partitionBy("subject_id").orderBy("ord", "item_id")))
    filled = lacking.join(pool, ["subject_id", "k"], "left").drop("k")
    return items.where(c("image_url").isNotNull()).withColumn("fill_url", F.lit(None).cast("string")).unionByName(filled)


def area_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, total, with_area, pct, enriched) of each source and of all (source null).  Both: (item_id, source, area)."""
    rows = after.join(before.select("item_id", c("area").alias("old_area")), "item_id", "left")
    agg = rows.rollup("source").agg(F.count(F.lit(1)).alias("total"), F.count("area").alias("with_area"), F.count_if(c("area").isNotNull() & c("old_area").isNull()).alias("enriched"))
    return agg.select("source", "total", "with_area", js_round(c("with_area") / c("total") * 100).alias("pct"), "enriched")


def directory_with_supplements(names: DataFrame, supplements: DataFrame) -> DataFrame:
    """Names of a district and the supplements that aren't among them, told apart by trimmed lower-case name.  Both: (district, name)."""
    keyed = lambda df: df.withColumn("key_", F.lower(F.trim("name")))
    extra = keyed(supplements).join(keyed(names).select("district", "key_"), ["district", "key_"], "left_anti").dropDuplicates(["district", "key_"])
    return names.select("district", "name").unionByName(extra.select("district", "name"))
