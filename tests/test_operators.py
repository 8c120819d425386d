"""Boundaries, repeats and empty inputs of the operators."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from parcelforge.operators import band, geo, policy, pool, selection, signals
from parcelforge.sources import pages
from parcelforge.streaming import ingest

SUBJECT = "subject_id long, category string, subject_area double, subject_room_text string, subject_building_age int"
ITEM = SUBJECT + ", listing_uid string, source_url string, title string, source string, price double, net_area double, gross_area double, room_text string, building_age int, image_url string, created_at timestamp, provider_rank int"
DAY = datetime.datetime(2024, 1, 1)


def items(spark, prices, room="2+1", area=100.0, age=5):
    rows = [(1, "residential", 100.0, "2+1", 5, f"u{i}", f"http://x.example/{i}", "ev", "Hepsiemlak", float(p), area, None, room, age, "http://i.example/a.jpg", DAY, 0) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, ITEM)


def test_relaxing_filter_gives_way_below_three(spark):
    rows = items(spark, [1e6, 2e6, 3e6]).union(items(spark, [4e6, 5e6], room="1+1"))
    assert selection.relaxing(rows, F.col("room_text") == "2+1").count() == 3
    rows = items(spark, [1e6, 2e6]).union(items(spark, [4e6, 5e6], room="1+1"))
    assert selection.relaxing(rows, F.col("room_text") == "2+1").count() == 4


def test_fences_need_eight_values_and_survivors(spark):
    near = [100_000 + i for i in range(8)]
    assert selection.trim_unit_price(selection.prepared(items(spark, near + [100_000_000]))).count() == 8
    assert selection.trim_unit_price(selection.prepared(items(spark, near[:6] + [100_000_000]))).count() == 7
    assert selection.trim_unit_price(selection.prepared(items(spark, near[:7] + [100_000_000]))).count() == 8  # 7 would stay


def test_price_band_limits(spark):
    two = selection.prepared(items(spark, [1e6, 2e6]))
    assert band.price_band(two).first().min_price is None
    row = band.price_band(selection.prepared(items(spark, [1e6, 2e6, 3e6, 4e6, 5e6]))).first()
    assert row.min_price <= row.expected_price <= row.max_price
    assert band.price_band(two.limit(0)).count() == 0


def test_portfolio_has_thirty_rows_at_most_and_no_repeats(spark):
    rows = selection.prepared(items(spark, [1_000_000 + 1000 * i for i in range(60)]))
    got = selection.portfolio(rows, F.lit("2024-03-01").cast("timestamp")).collect()
    assert len(got) == 30 and len({r.listing_uid for r in got}) == 30
    assert sum(r.group == "stale" for r in got) == 6 and all(sum(r.group == g for r in got) >= 8 for g in ("low", "mid", "high"))


def test_penalty_is_clamped(spark):
    df = spark.createDataFrame([(1, 30, 4, 4, False, "bakımsız")], "subject_id long, subject_building_age int, floor_no int, building_floors int, has_elevator boolean, condition string")
    row = signals.subject_penalty(df).first()
    assert row.penalty_pct == 38 and len(row.reasons) == 4


def test_policy_literals(spark):
    df = spark.createDataFrame([(1, "residential", "sale", 100.0, 10, None, None, 1e6, None, None), (2, "residential", "sale", 100.0, 3, None, None, 1e6, None, None)], "id int, category string, valuation_type string, subject_area double, subject_building_age int, floor_no int, has_elevator boolean, min_price double, expected_price double, max_price double")
    df = df.withColumns({f"{k}_sqm": F.lit(None).cast("double") for k in ("min", "expected", "max")}).withColumn("subject_building_age", F.when(F.col("id") == 2, 3))
    settings = spark.range(1).select(*[F.lit(None).cast("double").alias(k) for k in policy.SETTINGS], F.lit(None).cast("boolean").alias("cost_floor_enabled"))
    got = {r.id: r for r in policy.apply_valuation_policy(df, settings).collect()}
    assert (got[1].policy_min, got[1].policy_expected, got[1].policy_max) == (1_000_000, 1_150_000, 1_300_000)
    assert got[2].policy_min == 5_400_000
    assert got[1].rent_expected == 5000


def test_radius_join_equals_brute_force(spark):
    subs = spark.range(40).select(F.col("id").alias("subject_id"), (41 + F.rand(1) * 0.1).alias("lat"), (29 + F.rand(2) * 0.1).alias("lon")).cache()
    pts = spark.range(300).select(F.col("id").alias("poi_id"), (41 + F.rand(3) * 0.1).alias("lat"), (29 + F.rand(4) * 0.1).alias("lon")).cache()
    got = {(r.subject_id, r.poi_id) for r in geo.radius_join(subs, pts, 1500.0).collect()}
    p = pts.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})
    d = F.floor(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) + 0.5)
    assert got == {(r.subject_id, r.poi_id) for r in subs.crossJoin(p).where(d <= 1500).collect()} and got


def test_tags(spark):
    def cats(**tags):
        return spark.range(1).select(geo.transport_categories(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])).alias("x")).first().x

    assert cats(highway="bus_stop") == ["busStop"] and cats(railway="subway_entrance") == ["metro"] and cats(railway="station", name="Marmaray X") == ["marmaray"]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("A", "t", 1.0, DAY, DAY, True)], "source_url string, title string, price double, first_seen_at timestamp, last_seen_at timestamp, is_active boolean")
    new = spark.createDataFrame([("A", "t", 2.0), ("B", "t", 3.0)], "source_url string, title string, price double")
    as_of = F.lit("2024-02-01").cast("timestamp")
    once = pool.upsert_listings(old, new, as_of)
    got = {r.source_url: r for r in once.collect()}
    assert got["A"].first_seen_at == DAY and got["A"].price == 2.0 and str(got["B"].first_seen_at) == "2024-02-01 00:00:00"
    assert sorted(map(tuple, pool.upsert_listings(once, new, as_of).collect())) == sorted(map(tuple, once.collect()))


def test_stream_equals_batches(spark, tmp_path):
    schema = "listing_uid string, source_url string, source string, title string, price double, seen_at timestamp"
    days = [datetime.datetime(2024, 1, d) for d in (1, 2)]
    spark.createDataFrame([("1", "A", "s", "t", 1.0, days[0]), ("2", "A", "s", "t", 9.0, days[0])], schema).write.parquet(str(tmp_path / "feed"))
    run = lambda: ingest.start_ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "feed")), str(tmp_path / "pool"), str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([("1", "A", "s", "t", 5.0, days[1]), ("3", "B", "s", "t", 3.0, days[1])], schema).write.mode("append").parquet(str(tmp_path / "feed"))
    run()
    got = {r.source_url: r for r in ingest.current_pool(spark, str(tmp_path / "pool")).collect()}
    assert got["A"].price == 5.0 and got["A"].first_seen_at == days[0] and got["A"].last_seen_at == days[1] and got["B"].first_seen_at == days[1]


def test_page_facts(spark):
    """What a page says in words goes before its JSON."""
    html = '<meta property="og:image" content="http://i.example/a.jpg"><script type="application/ld+json">{"floorSize": {"value": 95}}</script><p>Net 90 m² 3 + 1</p>'
    row = pages.extract_page_facts(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).orderBy("page_id").collect()
    assert (row[0].image_url, row[0].area, row[0].room_text) == ("http://i.example/a.jpg", 90.0, "3+1") and row[1].image_url is None and row[2].area is None


def test_plan_of_the_valuation_set(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        selection.valuation_set(selection.prepared(items(spark, [1e6]))).explain()
    plan = out.getvalue()
    assert plan.count("Exchange hashpartitioning(subject_id") == 1 and "Cartesian" not in plan and "Python" not in plan


def test_stop_responses(spark):
    """Responses hold a bounded number of stops, whatever the number of rows."""
    from parcelforge.plans import landing
    from parcelforge.sources import feeds

    made = landing.stop_responses(spark.range(120_000).withColumnRenamed("id", "poi_id"))
    sizes = [r.value.count("SDURAKKODU") for r in made.collect()]
    assert sizes == [1000] * 120
    assert feeds.parse_stops(made).count() == sum(k % 7 != 0 for k in range(120_000))


def plan_of(df):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def listed(spark, rows):
    """(listing_uid, neighborhood, price, image_url, property_type, last_seen_at, pool_quality) as listings of one district."""
    schema = "listing_uid string, neighborhood string, price double, image_url string, property_type string, last_seen_at timestamp, pool_quality int"
    fixed = {"city": "İzmir", "district": "Konak", "category": "residential", "valuation_type": "sale", "source": "s", "title": "t", "room_text": "2+1"}
    rows = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in fixed.items()})
    return rows.withColumns({"source_url": F.concat(F.lit("https://x/"), "listing_uid"), "net_area": F.lit(100.0), "gross_area": F.lit(110.0), "created_at": F.col("last_seen_at"), "provider_rank": F.lit(0)})


def asked(spark, rows):
    """(subject_id, neighborhood, subject_type) as subjects of that district."""
    fixed = {"city": "IZMIR", "district": "KONAK", "category": "residential", "valuation_type": "sale", "subject_room_text": "2+1"}
    return spark.createDataFrame(rows, "subject_id long, neighborhood string, subject_type string").withColumns({k: F.lit(v) for k, v in fixed.items()} | {"subject_area": F.lit(100.0)})


def test_lookup_caps_before_it_joins(spark):
    now, old, img = datetime.datetime(2024, 1, 20), datetime.datetime(2024, 1, 1), "https://i.example/a.jpg"
    rows = [(f"{k:03d}", "Alsancak", 1.0, img, "Daire", now, k) for k in range(100)] + [("stale", "Alsancak", 1.0, img, "Daire", old, 200), ("mock", "Alsancak", 1.0, "https://x/comparables/mock-image", "Daire", now, 200), ("villa", "Alsancak", 1.0, img, "Villa", now, 200), ("bare", "Alsancak", 1.0, None, "Daire", now, 200), ("untyped", "Alsancak", 1.0, img, None, now, 200)]
    subjects, pool_rows = pool.scope_keys(asked(spark, [(1, "ALSANCAK MAH.", "daire"), (2, "Alsancak", None), (3, "Bostanlı", None)])), pool.with_scope_keys(listed(spark, rows))
    found = pool.looked_up(subjects, pool_rows, F.lit("2024-01-21").cast("timestamp"), scope_rows=50, subject_rows=10)
    plan = plan_of(found)
    got = {k: sorted(r.listing_uid for r in found.collect() if r.subject_id == k) for k in (1, 2, 3)}
    # of the best 50 (the mock image, the villa and the untyped one among them): the best ten that match
    assert got == {1: [f"{k:03d}" for k in range(90, 100)], 2: [*[f"{k:03d}" for k in range(92, 100)], "untyped", "villa"], 3: []}
    # further down in the plan is earlier: the cap of the scope lies below the join of the subjects (city and district are constants here)
    join = max(plan.find("BroadcastHashJoin [neighborhood_key"), plan.find("SortMergeJoin [neighborhood_key"))
    assert 0 < join < plan.find("WindowGroupLimit [neighborhood_key") and "Cartesian" not in plan


def test_fallback_finds_other_spellings_and_no_other_quarter(spark):
    now, img = datetime.datetime(2024, 1, 20), "https://i.example/a.jpg"
    items = pool.scope_keys(listed(spark, [("a", "Alsancak", 1.0, img, "Daire", now, 1), ("b", "ALSANCAK MAHALLESİ", 1.0, img, "Daire", now, 1), ("c", "Bostanlı", 1.0, img, "Daire", now, 1)]))
    subjects = pool.scope_keys(asked(spark, [(1, "alsancak", None), (2, "Alsancak Mah.", None), (3, "Güzelyalı", None)]))
    got = sorted((r.subject_id, r.listing_uid, r.match_level) for r in pool.match_pool(subjects, items, room=True, fallback="district").collect())
    assert got == [(1, "a", "neighborhood"), (1, "b", "neighborhood"), (2, "a", "district"), (2, "b", "district")]


def test_images_are_counted_in_the_chosen_pool(spark):
    rows = items(spark, [1e6 + k for k in range(40)]).withColumns({"image_url": F.when(F.substring("listing_uid", 2, 9).cast("int") % 2 == 0, "https://i.example/a.jpg"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    got = selection.pool_diagnostics(selection.prepared(rows.where("listing_uid <> 'u0'")), F.lit("2024-01-10").cast("timestamp")).first()
    assert (got.raw_count, got.image_count, got.selected_count, got.long_listed_count) == (39, 19, 30, 0)
    # 60 rows, 30 of them with photo: the pool is those with photo alone
    rows = items(spark, [1e6 + 100 * k for k in range(60)]).withColumns({"image_url": F.when(F.substring("listing_uid", 2, 9).cast("int") % 2 == 0, "https://i.example/a.jpg"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    got = selection.pool_diagnostics(selection.prepared(rows), F.lit("2024-01-10").cast("timestamp")).first()
    assert (got.raw_count, got.image_count, got.selected_count) == (60, 30, 30)


def test_hints_stay_with_their_rows(spark):
    rows = spark.createDataFrame([(k, "Bebek" if k % 2 else "Ankara", "x") for k in range(200)], "k int, title string, city string").repartition(7)
    got = policy.location_hint(rows)
    assert {(r.k % 2, r.base) for r in got.collect()} == {(1, 175000.0), (0, 38000.0)} and "Join" not in plan_of(got)


def test_shares_over_one_are_percent(spark):
    text = '{"avgPrice": "1.500.000,4 TL", "confidence": %s, "comps": [{"price": 1.5, "roomText": "2+1"}], "assumptions": "none", "marketProjection": {"summary": "  "}}'
    rows = spark.createDataFrame([(k, text % v) for k, v in enumerate(("85", "1.7", '"0,4"', "300", "-1", "null", '"yok"'))] + [(7, "no json"), (8, None)], "k int, t string").withColumn("area", F.lit(100.0))
    got = policy.normalize_price_index(rows, "t", "area").orderBy("k").collect()
    assert [r.confidence for r in got] == [0.85, 0.017, 0.4, 1.0, 0.0, None, 0.0, None, None]
    assert got[0].avg_price == 1500000 and got[0].avg_sqm == 15000 and got[0].comps[0].price == 1.5 and got[0].comps[0].roomText == "2+1" and got[0].assumptions == [] and got[0].market_projection is None
    assert got[7].avg_price is None and got[7].comps == []


@pytest.mark.parametrize("near", [(89.99, 10.0), (85.0, 179.995), (71.5, -179.99), (-80.0, 0.0), (0.0, 180.0)])
def test_radius_join_near_the_poles_and_the_antimeridian(spark, near):
    draw = random.Random(5)
    spot = lambda: (max(-90.0, min(90.0, near[0] + draw.uniform(-0.05, 0.05))), (near[1] + draw.uniform(-0.5, 0.5) / max(0.02, math.cos(math.radians(near[0]))) + 180) % 360 - 180)
    subjects, points = [(k, *spot()) for k in range(12)], [(k, *spot()) for k in range(400)]
    a, b = spark.createDataFrame(subjects, "subject_id int, lat double, lon double"), spark.createDataFrame(points, "poi_id int, lat double, lon double")
    got = sorted((r.subject_id, r.poi_id) for r in geo.radius_join(a, b, 3000.0).collect())
    pairs = a.crossJoin(b.withColumnsRenamed({"lat": "y", "lon": "x"})).where(F.floor(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) + 0.5) <= 3000)
    assert got == sorted((r.subject_id, r.poi_id) for r in pairs.collect()) and len(got) > 5


RAW = "listing_uid string, source_url string, source string, title string, price double, seen_at timestamp"


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    top, order = str(tmp_path / "pool"), [F.desc("seen_at"), F.col("listing_uid")]
    day = lambda n: datetime.datetime(2024, 1, n)
    first = spark.createDataFrame([(str(k), f"u{k}", "s", "t", 1.0, day(1)) for k in range(50)], RAW)
    second = spark.createDataFrame([("1", "u1", "s", "t", 5.0, day(2))], RAW)
    ingest.merge_batch(first, 0, top, order, buckets=8)
    real = ingest.PoolFiles.commit

    def dies(self, version, manifest):
        raise OSError("lost")

    monkeypatch.setattr(ingest.PoolFiles, "commit", dies)
    with pytest.raises(OSError, match="lost"):
        ingest.merge_batch(second, 1, top, order)
    assert ingest.current_pool(spark, top).count() == 50 and ingest.current_pool(spark, top).agg(F.max("price")).first()[0] == 1.0
    monkeypatch.setattr(ingest.PoolFiles, "commit", real)
    before = ingest.PoolFiles(spark, top).latest()["buckets"]
    for _ in range(2):  # a batch that comes again changes nothing
        ingest.merge_batch(second, 1, top, order)
    after = ingest.PoolFiles(spark, top).latest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1  # the bucket of u1 alone is rewritten
    rows = {r.source_url: r for r in ingest.current_pool(spark, top).collect()}
    assert len(rows) == 50 and rows["u1"].price == 5.0 and rows["u1"].first_seen_at == day(1) and rows["u1"].last_seen_at == day(2) and rows["u2"].last_seen_at == day(1)
    for n in range(3, 9):
        ingest.merge_batch(spark.createDataFrame([("1", "u1", "s", "t", float(n), day(n))], RAW), n, top, order)
    assert len(ingest.PoolFiles(spark, top).versions()) == ingest.KEEP and ingest.current_pool(spark, top).count() == 50
    with pytest.raises(RuntimeError, match="another writer"):
        files = ingest.PoolFiles(spark, top)
        files.commit(files.versions()[-1], files.latest())


def test_lost_manifests_are_an_error(spark, tmp_path):
    import shutil

    top = str(tmp_path / "pool")
    assert ingest.current_pool(spark, top) is None
    for n in (1, 2):
        ingest.merge_batch(spark.createDataFrame([(str(n), f"u{n}", "s", "t", 1.0, datetime.datetime(2024, 1, n))], RAW), n, top, [F.col("listing_uid")])
    shutil.rmtree(tmp_path / "pool" / "_versions")
    with pytest.raises(RuntimeError, match="lost"):
        ingest.current_pool(spark, top)


def test_stream_validates_and_counts_rejects(spark, tmp_path):
    from parcelforge.plans import valuation

    rows = listed(spark, [("a", "Alsancak", 1.0, "https://i.example/a.jpg", "Daire", datetime.datetime(2024, 1, 2), 1), ("b", "Alsancak", 1.0, "https://x/comparables/mock-image", "Daire", datetime.datetime(2024, 1, 2), 1), ("c", "Alsancak", 1.0, "https://i.example/a.jpg", None, datetime.datetime(2024, 1, 2), 1)])
    raw = valuation.raw_feed(rows.withColumns({"building_age": F.lit(3), "price": F.lit(1234567.0)}))
    raw.write.parquet(str(tmp_path / "feed"))
    ingest.start_ingest(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "feed")), str(tmp_path / "pool"), str(tmp_path / "state"), prepare=ingest.normalized).awaitTermination()
    assert [(r.source_url, r.price) for r in ingest.current_pool(spark, str(tmp_path / "pool")).collect()] == [("https://x/a", 1234567.0)]
    assert {r.reason: r.n for r in ingest.rejects(spark, str(tmp_path / "pool")).collect()} == {"saved": 1, "missing_real_image": 1, "missing_property_type": 1}


def test_image_candidates(spark):
    html = '<img src="a/b.JPG?w=1&amp;h=2"><img data-src="//cdn.example/x/resize/10/20/p.png"><img srcset="/resize/1/2/q.webp 1x, /img/logo.png 2x"><meta content="data:image/png"><script>"https:\\/\\/imaj.emlakjet.com\\/z.jpg"</script>'
    rows = spark.createDataFrame([(1, "https://x.example/list/7", html), (2, "https://x.example/", None), (3, "https://x.example/", "")], "page_id int, base_url string, html string")
    got = [(r.listing_uid, r.rank, r.url, r.priority) for r in pages.extract_image_candidates(rows).orderBy("listing_uid", "rank").collect()]
    assert got == [(1, 1, "https://imaj.emlakjet.com/z.jpg", 100), (1, 2, "https://cdn.example/x/resize/10/20/p.png", 60), (1, 3, "https://x.example/resize/1/2/q.webp", 60), (1, 4, "https://x.example/list/a/b.JPG?w=1&h=2", 10)]


def test_json_of_pages(spark):
    cases = ['{"primaryImageOfPage": {"thumbnailUrl": "t.jpg"}, "floorSize": [{"value": "1.250,4"}], "numberOfBedrooms": 3}', '{"image": ["", {"contentUrl": "c.jpg"}], "floorSize": 95}', '{"floorSize": {"value": 120.0}}', "not json", '[{"numberOfRooms": "4+1"}]']
    html = [(k, f'<script type="application/ld+json">{x}</script>') for k, x in enumerate(cases)]
    got = [(r.image_url, r.area, r.room_text) for r in pages.extract_page_facts(spark.createDataFrame(html, "page_id int, html string")).orderBy("page_id").collect()]
    assert got == [("t.jpg", 1250.0, "3"), ("c.jpg", 95.0, None), (None, 120.0, None), (None, None, None), (None, None, "4+1")]
