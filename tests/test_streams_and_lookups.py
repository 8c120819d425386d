"""Counters by a stream, pages by ranges, searches by an index, nearest places by rings."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from parcelforge.operators import geo, usage
from parcelforge.streaming import counters

EVENT = "report_id long, version int, user_id long, created_at date, status string, is_deleted boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_counters_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(r, v, rng.randint(1, 4), datetime.date(2024, rng.randint(1, 3), 5), rng.choice(["DRAFT", "DONE", None]), rng.random() < 0.3) for r in range(60) for v in range(rng.randint(1, 5))]
    newest = {}
    for e in events:
        if e[0] not in newest or e[1] > newest[e[0]][1]:
            newest[e[0]] = e
    want = {}
    for _, _, user, day, status, gone in newest.values():
        x = want.setdefault((user, day.replace(day=1)), [0, 0, 0, 0])
        for k, yes in enumerate((True, not gone, gone, not gone and status not in (None, "DRAFT"))):
            x[k] += yes
    rng.shuffle(events)
    parts = [events[k::4] for k in range(4)]
    for k, part in enumerate([*parts, parts[0]]):
        counters.add_batch(spark.createDataFrame([*part, (None, 1, 1, None, "DONE", False)], EVENT), k, str(tmp_path), buckets=4)
        counters.add_batch(spark.createDataFrame(part, EVENT), k, str(tmp_path))  # again: as once
    got = {(r.user_id, r.month): [r.total, r.active, r.deleted, r.used] for r in counters.counters(spark, str(tmp_path)).collect()}
    assert got == want
    month = counters.used_in(counters.counters(spark, str(tmp_path)), F.lit("2024-02-10").cast("timestamp")).collect()
    assert {r.user_id: r.used for r in month} == {u: x[3] for (u, m), x in want.items() if m.month == 2}


def test_pages_by_ranges(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("report_id"), (F.col("id") * 7919 % 5000 / 10).cast("int").alias("created_at"))
    order = [F.desc("created_at"), F.desc("report_id")]
    usage.write_pages(rows, order, str(tmp_path))
    want = [r.report_id for r in rows.orderBy(*order).collect()]
    for skip, take in ((0, 50), (4980, 50), (2490, 20), (6000, 10), (0, 5000)):
        assert [r.report_id for r in usage.read_page(spark, str(tmp_path), order, take, skip).collect()] == want[skip : skip + take]
    page = usage.read_page(spark, str(tmp_path), order, 10, 4900)
    assert len({f.split("range_=")[1].split("/")[0] for f in page.inputFiles()}) == 1


def test_searches_by_an_index(spark):
    rows = spark.createDataFrame([(k, name, mail, None) for k, (name, mail) in enumerate([("Ayşe Kaya", "a@b.co"), ("ali", None), ("ABCABC", "xyz"), ("abab", "cabc"), (None, None), ("çab", "kay")])], "user_id int, full_name string, email string, phone string")
    index = usage.search_index(rows)
    for q in ("abc", "KAYA", "bcab", "a", "", "ab", "xyz", "cabc", "zzz", "şe K"):
        assert sorted(r.user_id for r in usage.search_indexed(rows, index, q).collect()) == sorted(r.user_id for r in usage.search_users(rows, q).collect())


def test_rings_find_the_nearest(spark, tmp_path):
    rng = random.Random(6)
    dense = [(k, 41 + rng.gauss(0, 0.001), 29 + rng.gauss(0, 0.001), rng.choice(["school", "park"])) for k in range(1500)]
    wide = [(5000 + k, 41 + rng.uniform(-0.03, 0.03), 29 + rng.uniform(-0.03, 0.03), rng.choice(["school", "bank", "metro"])) for k in range(300)]
    points = spark.createDataFrame(dense + wide, "poi_id int, lat double, lon double, category string")
    subjects = spark.createDataFrame([(k, 41 + rng.gauss(0, 0.004), 29 + rng.gauss(0, 0.004)) for k in range(40)], "subject_id int, lat double, lon double")
    columns = ["subject_id", "category", "poi_id", "distance_m", "rank"]
    want = geo.nearest_k(geo.radius_join(subjects, points, 1500.0)).select(*columns)
    got = geo.nearest_by_rings(subjects, points, 1500.0, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rings_meet_few_in_a_dense_city(spark, tmp_path):
    """What the rings look at of a city of even density is less than a tenth of all pairs."""
    points = spark.range(40_000).select(F.col("id").alias("poi_id"), (41 + (F.col("id") % 200) * 0.0002).alias("lat"), (29 + F.floor(F.col("id") / 200) * 0.0002).alias("lon"), F.lit("school").alias("category"))
    subjects = spark.range(20).select(F.col("id").alias("subject_id"), (41.015 + F.col("id") * 0.0005).alias("lat"), (29.015 + F.col("id") * 0.0005).alias("lon"))
    every = geo.radius_join(subjects, points, 1500.0)
    first = geo.radius_join(subjects, points, float(1500 // 8))
    assert geo.nearest_k(first).groupBy("subject_id").count().where("count < 5").count() == 0
    assert first.count() * 10 < every.count()
    got = geo.nearest_by_rings(subjects, points, 1500.0, str(tmp_path))
    assert sorted(map(tuple, got.select("subject_id", "poi_id").collect())) == sorted(map(tuple, geo.nearest_k(every).select("subject_id", "poi_id").collect()))


@pytest.mark.parametrize(("lat", "lon"), [(41.0, 29.0), (-89.99, 10.0), (10.0, 180.0), (0.0, 0.0), (60.0, -179.999)])
@pytest.mark.parametrize("crowd", [1, 25])
def test_crowded_cells_lose_nothing(spark, lat, lon, crowd):
    rng = random.Random(7)
    near = lambda s: ((max(-90.0, min(90.0, lat + rng.gauss(0, s)))), (lon + rng.gauss(0, s) / max(0.02, abs(math.cos(math.radians(lat)))) + 180) % 360 - 180)
    points = [(k, *near(0.0001)) for k in range(150)] + [(1000 + k, *near(0.03)) for k in range(150)] + [(2000 + k, lat, lon) for k in range(60)]
    subjects = [(k, *near(0.02)) for k in range(25)]
    a = spark.createDataFrame(subjects, "subject_id int, lat double, lon double")
    b = spark.createDataFrame(points, "poi_id int, lat double, lon double")
    got = geo.radius_join(a, b, 1500.0, crowd=crowd).select("subject_id", "poi_id", "distance_m")
    want = a.crossJoin(b.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})).withColumn("distance_m", F.floor(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) + 0.5).cast("double")).where("distance_m <= 1500")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("subject_id", "poi_id", "distance_m").collect()))


def test_crowded_cells_are_dealt_out(spark):
    """With half of all points in one cell and a quarter at one spot, no key has many more points than asked for."""
    points = spark.range(8000).select(F.col("id").alias("poi_id"), (41 + F.when(F.col("id") % 4 == 0, 0.0).when(F.col("id") % 4 == 1, F.rand(1) * 0.01).otherwise(F.rand(2) * 0.5)).alias("p_lat"), (29 + F.when(F.col("id") % 4 == 0, 0.0).when(F.col("id") % 4 == 1, F.rand(3) * 0.01).otherwise(F.rand(4) * 0.5)).alias("p_lon"))
    height = 0.0135
    turn, cells = (lambda x: F.pmod(x + 180.0, F.lit(360.0)) / 360), (lambda y: F.lit(20_000).cast("long"))
    at = points.withColumn("cy", F.floor(F.col("p_lat") / height)).withColumn("cx", F.floor(turn(F.col("p_lon")) * cells(None)))
    looks = spark.createDataFrame([(1, 41.0, 29.0)], "subject_id int, lat double, lon double").withColumn("cy", F.floor(F.col("lat") / height)).withColumn("cx", F.floor(turn(F.col("lon")) * cells(None)))
    cut, looked = geo.cut_cells(at, looks, 100, cells, turn, height)
    most = cut.groupBy("cy", "cx", "sub_", "part_").count().agg(F.max("count")).first()[0]
    assert cut.count() == 8000 and most <= 160 and looked.groupBy("sub_", "part_").count().where("count > 1").count() == 0
