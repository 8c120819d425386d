"""Pools in buckets: one file for each, and sweeps that leave alone what doesn't change."""

import datetime

from pyspark.sql import functions as F

from parcelforge.streaming import ingest

SCHEMA = "listing_uid string, source_url string, title string, price double, seen_at timestamp"
DAY = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d) for d in range(100)]


def batch(spark, urls, day, price=1.0):
    return spark.createDataFrame([(f"u{k}", url, "t" * 600, price, DAY[day]) for k, url in enumerate(urls)], SCHEMA).repartition(5)


def files(top):
    return sorted(str(p.relative_to(top)) for p in top.rglob("*.parquet") if "data" in p.parts)


def test_a_batch_writes_one_file_for_each_bucket(spark, tmp_path):
    urls = [f"https://x/{k}" for k in range(300)]
    ingest.merge_batch(batch(spark, urls, 0), 0, str(tmp_path), [F.col("listing_uid")], buckets=8)
    first = files(tmp_path)
    assert len(first) == 8
    ingest.merge_batch(batch(spark, urls[:2], 3, 9.0), 1, str(tmp_path), [F.col("listing_uid")])
    touched = len({r.b for r in spark.createDataFrame([(u,) for u in urls[:2]], "source_url string").select(ingest.bucket_of(8).alias("b")).collect()})
    assert len(files(tmp_path)) == 8 + touched
    pool = {r.source_url: r for r in ingest.current_pool(spark, str(tmp_path)).collect()}
    assert len(pool) == 300 and len(pool[urls[0]].title) == 500
    assert (pool[urls[0]].price, pool[urls[0]].first_seen_at, pool[urls[0]].last_seen_at) == (9.0, DAY[0], DAY[3]) and pool[urls[5]].last_seen_at == DAY[0]
    assert not (tmp_path / "_picked" / "batch=1").exists()


def test_sweeps_touch_what_changes(spark, tmp_path):
    top = str(tmp_path)
    assert ingest.sweep(spark, top, str(DAY[0])) == 0
    old, new = [f"https://old/{k}" for k in range(3)], [f"https://new/{k}" for k in range(3)]
    ingest.merge_batch(batch(spark, old, 0), 0, top, [F.col("listing_uid")], buckets=64)
    ingest.merge_batch(batch(spark, new, 30), 1, top, [F.col("listing_uid")])

    def states():
        return {r.source_url: r.freshness for r in ingest.current_pool(spark, top).collect()}

    assert ingest.sweep(spark, top, str(DAY[13])) == 0
    n = ingest.sweep(spark, top, str(DAY[30]))
    assert 0 < n <= 3 and states() == {**dict.fromkeys(old, "STALE"), **dict.fromkeys(new, "FRESH")}
    before = files(tmp_path)
    assert ingest.sweep(spark, top, str(DAY[30])) == 0 and files(tmp_path) == before
    assert {r.source_url for r in ingest.live_pool(spark, top, str(DAY[31])).collect()} == set(new)
    ingest.merge_batch(batch(spark, old[:1], 40), 2, top, [F.col("listing_uid")])
    assert states()[old[0]] == "FRESH"
    ingest.sweep(spark, top, str(DAY[45]))
    assert states() == {old[0]: "FRESH", old[1]: "EXPIRED", old[2]: "EXPIRED", **dict.fromkeys(new, "STALE")}
    assert ingest.sweep(spark, top, str(DAY[45])) == 0
    live = ingest.live_pool(spark, top, str(DAY[99]))
    assert live.count() == 0 and not live.inputFiles()


def test_a_batch_moves_once(spark, tmp_path):
    """Pool and batch are dealt out by bucket together; what is written needs no further exchange."""
    import contextlib
    import io

    from parcelforge.operators.pool import merge_listings

    ingest.merge_batch(batch(spark, ["a", "b"], 0), 0, str(tmp_path), [F.col("listing_uid")], buckets=4)
    old = ingest.current_pool(spark, str(tmp_path)).withColumn("bucket", ingest.bucket_of(4))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        merge_listings(old, batch(spark, ["b"], 1).drop("seen_at").withColumn("bucket", ingest.bucket_of(4)), F.lit(DAY[1]), "bucket").explain()
    assert out.getvalue().count("Exchange hashpartitioning(bucket") == 1 and "Join" not in out.getvalue()
