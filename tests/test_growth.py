"""What work grows with: steps worked out once for a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.functions import listing as L
from parcelforge.operators import geo, pool, reports, selection
from parcelforge.plans.fixtures import dealt_out
from parcelforge.sources import feeds, pages
from parcelforge.streaming import ingest


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_crawl_row_is_parsed_once(spark):
    raw = spark.range(3).select(F.format_string('{"url": "https://x.example/%d", "price": "1.250.000 TL", "grossSize": "90", "images": ["https://x.example/a.jpg"]}', "id").alias("value"))
    rows = feeds.normalize_crawl_feed(raw, F.lit("2001-12-01").cast("timestamp"))
    assert plan(rows).count("from_json(") == 1
    assert [(r.price, r.gross_area, r.price_per_sqm) for r in rows.collect()] == [(1250000.0, 90.0, 13889.0)] * 3


def test_each_step_of_an_image_url_is_worked_out_once(spark):
    html = '<img src="/PHOTOS/a.jpg?x=1"><img src="/Logo.png"><img data-src="/resize/1/2/b.png"><img srcset="/RESIZE/3/4/b.png 1x, c 2x">'
    rows = pages.extract_image_candidates(spark.createDataFrame([("1", "https://x.example/l/1", html)], "page_id string, base_url string, html string"))
    text = plan(rows)
    assert text.count("RLIKE(") == 3 and text.count("replace(replace(replace(") <= 3
    assert [(r.url, r.rank) for r in rows.orderBy("rank").collect()] == [("https://x.example/PHOTOS/a.jpg?x=1", 1), ("https://x.example/resize/1/2/b.png", 2)]


def test_a_name_of_an_image_is_worked_out_once_a_page(spark, monkeypatch):
    """An attribute's URL stands there as a URL, too; where names begin is asked at a few letters, with the results of words."""
    one = '<img src="https://x.example/photo/a.jpg"><img data-SRC=\'/b.png\'><img xsrc="/no.png" srcset="https://x.example/photo/a.jpg 1x,/b.png">'
    many = one + "".join(f'<meta Content="/photo/{k}.jpg">' for k in range(pages.FEW)) + "<p>https://x.example/photo/a.jpg"
    rows = spark.createDataFrame([("1", "https://x.example/l/1", one), ("2", "https://x.example/l/1", many), ("3", None, one)], "page_id string, base_url string, html string")
    got = sorted((r.listing_uid, r.url, r.ord) for r in pages.extract_image_candidates(rows).collect())
    a, b = ("https://x.example/photo/a.jpg", 0), ("https://x.example/b.png", 1)
    assert got == sorted([("1", *a), ("1", *b), ("2", *a), ("2", *b), ("3", *a), *[("2", f"https://x.example/photo/{k}.jpg", k + 2) for k in range(pages.FEW)]])
    monkeypatch.setattr(pages, "best_images", lambda rows: rows)
    assert sorted((r.url, r.ord) for r in pages.extract_image_candidates(rows.where("page_id = '1'")).collect()) == [b, a]


def test_spots_answer_for_all_who_are_there(spark):
    """Many subjects and places on few spots: the results of all their pairs, of which none is made."""
    at = lambda k: (41.0 + F.col("id") % k / 500, 29.0 + F.col("id") * 7 % k / 500)
    subjects = spark.range(200).select(F.col("id").alias("subject_id"), at(5)[0].alias("lat"), at(5)[1].alias("lon"))
    places = spark.range(3000).select(F.col("id").alias("poi_id"), at(11)[0].alias("lat"), at(11)[1].alias("lon"), F.element_at(F.array(*map(F.lit, ("metro", "tram", "rail"))), (F.col("id") % 3 + 1).cast("int")).alias("category"))
    pairs = geo.radius_join(subjects, places, geo.TRANSPORT_RADIUS)
    rows = lambda df, *names: sorted(map(tuple, df.select(*names).collect()), key=str)
    near = ("subject_id", "category", "poi_id", "distance_m")
    assert rows(geo.nearest_of_spots(subjects, places, geo.TRANSPORT_RADIUS, 5, geo.nearest_k), *near, "rank") == rows(geo.nearest_k(pairs), *near, "rank")
    assert rows(geo.nearest_of_spots(subjects, places, geo.TRANSPORT_RADIUS, 1, geo.nearest_rail), *near) == rows(geo.nearest_rail(pairs), *near)
    want = geo.counts_within(pairs, subjects, geo.TRANSPORT_CATEGORIES, (300, 800))
    assert rows(geo.transit_counts(subjects, places), *want.columns) == rows(want, *want.columns)
    assert geo.spots_of(subjects).count() == 5


def test_all_pairs_come_from_packs_of_spots_over_many_tasks(spark):
    """The pairs of radius_join(), of few subjects in one task; with more ids at a spot than a pack holds."""
    subjects = spark.range(40).select(F.col("id").alias("subject_id"), (41 + F.col("id") % 20 / 50).alias("lat"), (29 + F.col("id") % 20 / 50).alias("lon")).coalesce(1)
    places = spark.range(3000).select(F.col("id").alias("poi_id"), (41 + F.col("id") % 2 / 50).alias("lat"), (29 + F.col("id") % 2 / 50).alias("lon")).unionByName(subjects.withColumnRenamed("subject_id", "poi_id"))
    want = sorted(map(tuple, geo.radius_join(subjects, places, 3000.0).select("subject_id", "poi_id", "distance_m").collect()))
    for crowd in (None, 1):
        got = geo.all_pairs(subjects, places, 3000.0, crowd).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r[:3] for r in map(tuple, got)) == want and len({r.task for r in got}) > 4
    assert max(len(r.poi_id) for r in geo.packed(places, "poi_id").collect()) == geo.PACK


def test_a_dense_cell_is_the_work_of_many_tasks(spark):
    """40 subjects and 40,000 places within metres: a task holds the pairs of few subjects and few places at a time."""
    subjects = spark.range(40).select(F.col("id").alias("subject_id"), F.lit(41.0).alias("lat"), F.lit(29.0).alias("lon"))
    places = spark.range(40_000).select(F.col("id").alias("poi_id"), (41 + F.col("id") % 4 / 1e5).alias("lat"), F.lit(29.0).alias("lon"))
    for crowd in (None, 500):
        got = geo.all_pairs(subjects, places, 3000.0, crowd)
        rows = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("distance_m").alias("n"), F.countDistinct("subject_id", "poi_id").alias("pairs")).collect()
        assert sum(r.n for r in rows) == sum(r.pairs for r in rows) == 1_600_000 and max(r.n for r in rows) < 600_000
        if crowd is None:
            assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [cy") == 1
    assert max(len(r.subject_id) for r in geo.packed(subjects, "subject_id", geo.SUBJECT_PACK).collect()) == geo.SUBJECT_PACK


def test_pairs_of_the_fallback_are_not_dealt_out_again(spark):
    """How a subject's listings are found is told of subjects: the join that makes pairs is the last one, and compares ready texts."""
    subjects = spark.createDataFrame([(1, "A", "B", "Mah 1", "residential", "sale", 100.0, "2 + 1")], "subject_id long, city string, district string, neighborhood string, category string, valuation_type string, subject_area double, subject_room_text string")
    items = spark.createDataFrame([("x", "A", "B", "Mah 1", "residential", "sale", 100.0, "2+1")], "listing_uid string, city string, district string, neighborhood string, category string, valuation_type string, net_area double, room_text string").withColumn("gross_area", F.lit(None).cast("double"))
    found = pool.match_pool(pool.scope_keys(subjects), pool.scope_keys(items), room=True, fallback="district")
    joins = [x for x in plan(found).splitlines() if "Join " in x]
    assert "Join Inner" in joins[0] and "valuation_type" in joins[0] and "regexp_replace" not in joins[0] and "LeftOuter" in joins[1]
    assert [(r.listing_uid, r.match_level) for r in found.collect()] == [("x", "neighborhood")]


def test_reports_without_a_property_are_dealt_out(spark):
    """As equals in their key they were all left to one task."""
    rows = spark.range(4000).select(F.col("id").alias("report_id"), F.when(F.col("id") % 100 == 0, F.col("id") % 7).alias("property_id"), F.lit(" A ").alias("city"), F.lit("").alias("district"), F.lit(None).cast("string").alias("neighborhood"))
    homes = spark.range(5).select(F.col("id").alias("property_id"), F.lit("B").alias("city"), F.lit(" ").alias("district"), F.lit("x").alias("neighborhood"))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        got = reports.resolve_location(rows, homes).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert {(r.city, r.neighborhood) for r in got if r.property_id is None or r.property_id > 4} == {("A", None)} and {r.city for r in got if r.property_id is not None and r.property_id < 5} == {"B"}
    assert len(got) == 4000 and max(sum(r.task == k for r in got) for k in range(4)) < 2000


def test_large_buckets_are_merged_and_swept_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PART_ROWS", 50)
    rows = spark.range(300).select(F.concat(F.lit("u"), "id").alias("source_url"), F.col("id").cast("string").alias("listing_uid"), F.lit(1.0).alias("price"), F.lit("2001-10-10").cast("timestamp").alias("seen_at"))
    files = ingest.PoolFiles(spark, str(tmp_path))
    for batch in (0, 1):
        ingest.merge_batch(rows.where(f"id % 3 >= {batch}" if "id" in rows.columns else f"cast(listing_uid as int) % 3 >= {batch}").withColumn("price", F.lit(float(batch))), batch, str(tmp_path), [F.col("listing_uid")], buckets=2)
    now = lambda: sorted((r.source_url, r.price, r.freshness) for r in ingest.current_pool(spark, str(tmp_path)).collect())
    want = sorted((f"u{k}", float(k % 3 >= 1), "FRESH") for k in range(300))
    parts = lambda: {b: sum(n.endswith(".parquet") for n in files.names(path)) for b, path in files.latest()["buckets"].items()}
    assert now() == want and min(parts().values()) > 1
    assert ingest.sweep(spark, str(tmp_path), "2001-10-30 00:00:00") == 2 and ingest.sweep(spark, str(tmp_path), "2001-10-30 00:00:00") == 0
    assert now() == [(u, p, "STALE") for u, p, _ in want] and min(parts().values()) > 1


def test_few_files_are_dealt_out_in_small_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert dealt_out(spark.range(100).coalesce(1), times=16).rdd.getNumPartitions() == 16 * cores


def test_texts_of_listings_that_fail_before_are_not_folded(spark):
    names = ("neighborhood", "title", "address", "crit_city", "crit_district", "crit_neighborhood", "image_source", "category", "valuation_type", "property_type", "room_text")
    rows = spark.createDataFrame([("https://x.example/1", "https://i.example/a.jpg", 5.0), ("https://x.example/1", "https://i.example/a.jpg", 100.0), ("https://x.example/1", None, 100.0)], "source_url string, image_url string, net_area double")
    rows = rows.withColumns({k: F.lit("Mah 1" if k == "title" else "mah 1" if "neigh" in k else "sale") for k in names} | {"price": F.lit(5.0), "gross_area": F.lit(None).cast("double"), "subject_area": F.lit(100.0), "subject_room_text": F.lit("")})
    judged = pool.validate_listing(rows)
    assert [r.reason for r in judged.collect()] == ["missing_area", None, "missing_real_image"]
    assert any("isnull(before_" in x and "hay_" in x for x in plan(judged).splitlines())


def test_comparables_come_from_one_pass_over_the_listings(spark):
    """The rows of looked_up() and of the feeds' capped rows; places are folded after the cap, other spellings among them."""
    from parcelforge.plans import valuation as v

    sf = "/root/testdata/sf0.001"
    named = ("subject_id", "listing_uid", "neighborhood", "price")
    spelled = lambda df: df.withColumn("neighborhood", F.when(F.col("price") % 2 == 0, F.col("neighborhood")).otherwise(F.concat(F.lit(" MAH. "), "neighborhood")))
    rows, subjects = spelled(v.with_quality(v.listings(spark, sf), "pool_quality")), pool.scope_keys(v.subjects(spark, sf))
    keyed, best = pool.scope_keys(rows), [F.desc("pool_quality"), F.desc("last_seen_at"), F.col("listing_uid")]
    want = pool.looked_up(subjects, keyed.where("provider_rank = 0"), v.as_of(), scope_rows=3, subject_rows=2).unionByName(pool.match_pool(subjects, pool.cap_scope(keyed.where("provider_rank > 0"), 3, best, ["provider_rank"])))
    got = pool.comparables(subjects, pool.offered(rows, v.as_of(), scope_rows=3), 2)
    facts = lambda df: sorted((r.subject_id, r.listing_uid) for r in df.collect())
    assert facts(got) == facts(want) and facts(got)
    assert plan(v.pairs(spark, sf)).count("Relation [l_orderkey") == 1 and "Union" not in plan(v.pairs(spark, sf))
    assert set(named) <= set(got.columns)


def test_diagnostics_take_one_pass_and_few_sorts(spark):
    from parcelforge.plans import valuation as v

    made = v.a15(spark, "/root/testdata/sf0.001")
    assert "Join LeftOuter" not in plan(made) and plan(made).count("Relation [l_orderkey") == 1
    rows = spark.range(300).selectExpr("id % 3 as subject_id", "'residential' as category", "100d as subject_area", "'2+1' as subject_room_text", "5 as subject_building_age", "concat('u', id) as listing_uid", "concat('http://x.example/', id) as source_url", "'ev' as title", "'Hepsiemlak' as source", "1e6d + id * 37 % 101 as price", "100d as net_area", "100d as gross_area", "if(id % 2 = 0, '2+1', '3+1') as room_text", "5 as building_age", "if(id % 5 > 0, 'http://i.example/a.jpg', null) as image_url", "timestamp'2024-01-01' as created_at", "0 as provider_rank")
    now = F.lit("2024-03-01").cast("timestamp")
    ready = selection.prepared(rows)
    by_steps = lambda df: sorted(map(tuple, df.select("subject_id", "listing_uid", "group").collect()))
    flagged = selection.grouped(ready.withColumn("f", F.lit(True)), now, "f").where("group is not null")
    assert by_steps(flagged) == by_steps(selection.portfolio(ready, now)) and len(by_steps(flagged)) == 90
    with_facts = selection.with_facts(selection.with_facts(rows, selection.LISTING_FACTS), selection.SUBJECT_FACTS)
    assert by_steps(selection.portfolio(selection.prepared(with_facts), now)) == by_steps(flagged)
    physical = selection.portfolio(ready, now)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Sort [subject_id") <= 4 and physical.count("Exchange hashpartitioning(subject_id") == 1


def test_made_pictures_are_told_without_squeezing_each_url(spark):
    odd = ["https://x/a.jpg", " \t\nhttps://x/a.jpg", "https://x/comparables/MOCK-image", "https://maps  googleapis.com/maps/api/streetview?x", "https://maps.googleapis.com/maps/api/streetview", "http:// x", "ftp://x", "", None, "x https://x/a"]
    rows = spark.createDataFrame([(u,) for u in odd], "u string").select(L.is_real_image(F.col("u"), F.lit("")).alias("ok"))
    assert [r.ok for r in rows.collect()] == [True, True, False, False, False, False, False, False, False, False]


def test_coverage_marks_rows_in_one_pass(spark):
    from parcelforge.plans import valuation as v

    sf = "/root/testdata/sf0.001"
    made = v.a5(spark, sf)
    assert plan(made).count("Join LeftOuter") == 0 and plan(made).count("Relation [l_orderkey") == 1
    pairs, ready = v.pairs(spark, sf), v.prepared(spark, sf)
    n = lambda df: {r[0]: r[1] for r in df.groupBy("subject_id").count().collect()}
    records, raw, valuation, selected = n(pairs), n(ready), n(selection.valuation_set(ready)), n(selection.portfolio(ready, v.as_of()))
    got = made.collect()
    assert {r.subject_id: (r.records, r.raw, r.valuation, r.selected) for r in got} == {k: (records[k], raw[k], valuation.get(k, 0), selected.get(k, 0)) for k in records}


def test_paid_rows_are_met_by_subjects_that_lack(spark, monkeypatch):
    """Pairs aren't stored, and a subject with enough meets no paid row."""
    from parcelforge.plans import valuation as v

    sf, kept, met = "/root/testdata/sf0.01", {}, []
    store, meet = v.stored, pool.comparables
    monkeypatch.setattr(v, "stored", lambda rows, name: kept.setdefault(name, store(rows, name)))
    monkeypatch.setattr(pool, "comparables", lambda subjects, items: met.append((subjects, items)) or meet(subjects, items))
    got = sorted(map(tuple, v.u3(spark, sf).collect()))
    assert set(kept) == {"offered", "covered"}
    enough = {r.subject_id for r in kept["covered"].where("enough").collect()}
    everyone = {r.subject_id for r in v.subjects(spark, sf).collect()}
    assert enough and {r.subject_id for r in met[-1][0].collect()} == everyone - enough
    rows = v.pairs(spark, sf).select("subject_id", "listing_uid", "provider_rank").collect()
    assert got == sorted((r.subject_id, r.listing_uid) for r in rows if r.provider_rank < 2 or r.subject_id not in enough)


def test_market_projection_counts_in_the_same_pass(spark):
    from parcelforge.plans import valuation as v

    made = v.a3(spark, "/root/testdata/sf0.001")
    assert plan(made).count("Relation [l_orderkey") == 1 and "Join LeftOuter" not in plan(made)
    raw = {r[0]: r[1] for r in v.prepared(spark, "/root/testdata/sf0.001").groupBy("subject_id").count().collect()}
    assert made.count() > 0 and all(r.active == raw[r.subject_id] for r in made.collect())
