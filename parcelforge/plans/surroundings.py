"""Queries of places around subjects, open statistics and index series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.operators import geo, openstats
from parcelforge.plans.fixtures import fixture, work_folder
from parcelforge.plans.registry import registered

c = F.col


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements with their tags."""
    rows = fixture(spark, sf_dir, "fx_poi")
    return rows.select("poi_id", "lat", "lon", F.create_map(c("tag_key"), c("tag_value"), F.lit("religion"), F.lit("muslim")).alias("tags"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("poi_id", "lat", "lon", geo.poi_category(c("tags")).alias("category")).where("category is not null")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("poi_id", "lat", "lon", F.explode(geo.transport_categories(c("tags"))).alias("category"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_subject").select("subject_id", "lat", "lon")


# SQL: distances by brute force.
CATEGORY = """CASE WHEN tag_key = 'amenity' AND tag_value = 'school' THEN 'school' WHEN tag_key = 'amenity' AND tag_value = 'hospital' THEN 'hospital' WHEN tag_key = 'amenity' AND tag_value = 'pharmacy' THEN 'pharmacy' WHEN tag_key = 'shop' AND tag_value = 'supermarket' THEN 'market'
  WHEN tag_key = 'leisure' AND tag_value = 'park' THEN 'park' WHEN tag_key = 'amenity' AND tag_value = 'place_of_worship' THEN 'mosque' WHEN tag_key = 'amenity' AND tag_value = 'bank' THEN 'bank' WHEN tag_key = 'shop' AND tag_value = 'mall' THEN 'mall' END"""
TRANSIT = "CASE WHEN tag_key = 'highway' THEN 'busStop' WHEN tag_key = 'railway' AND tag_value = 'subway_entrance' THEN 'metro' WHEN tag_key = 'railway' AND tag_value = 'tram_stop' THEN 'tram' WHEN tag_key = 'railway' AND tag_value = 'station' THEN 'rail' END"
NEAR = f"""WITH cat AS (SELECT poi_id, lat, lon, {CATEGORY} AS place, {TRANSIT} AS stop FROM fx_poi), dist AS (
  SELECT s.subject_id, p.poi_id, p.place, p.stop, pow(sin(radians(p.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - s.lon) / 2), 2) AS h FROM fx_subject s, cat p
), near AS (SELECT *, floor(6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) + 0.5) AS distance_m FROM dist WHERE h < 1e-6)"""


@registered("j3_f18_radius_join", NEAR + " SELECT subject_id, poi_id, distance_m FROM near WHERE distance_m <= 3000")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.all_pairs(subjects(spark, sf_dir), points(spark, sf_dir).drop("tags"), 3000.0)


DENSE = NEAR.replace("SELECT poi_id, lat, lon,", "SELECT poi_id, CASE WHEN poi_id % 2 = 0 THEN 41.2 + (lat - 41) / 1000 ELSE lat END AS lat, CASE WHEN poi_id % 2 = 0 THEN 29.2 + (lon - 29) / 1000 ELSE lon END AS lon,")


@registered("j3_dense_cells", DENSE + " SELECT subject_id, poi_id, distance_m FROM near WHERE distance_m <= 3000")
def j3_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all points within some 40 metres."""
    half = c("poi_id") % 2 == 0
    at = points(spark, sf_dir).drop("tags").withColumns({"lat": F.when(half, 41.2 + (c("lat") - 41) / 1000).otherwise(c("lat")), "lon": F.when(half, 29.2 + (c("lon") - 29) / 1000).otherwise(c("lon"))})
    return geo.all_pairs(subjects(spark, sf_dir), at, 3000.0, crowd=500)


@registered("f19_categories", f"SELECT poi_id, {CATEGORY} AS place, {TRANSIT} AS stop FROM fx_poi")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("poi_id", geo.poi_category(c("tags")).alias("place"), F.array_join(geo.transport_categories(c("tags")), ",").alias("s")).select("poi_id", "place", F.nullif("s", F.lit("")).alias("stop"))


POI_LIST, STOP_LIST = (", ".join(f"('{x}')" for x in xs) for xs in (geo.POI_CATEGORIES, geo.TRANSPORT_CATEGORIES))


@registered("a12_poi_counts", NEAR + f""" SELECT s.subject_id, k.category, coalesce(count(n.poi_id) FILTER (distance_m <= 500), 0) AS within_500, coalesce(count(n.poi_id) FILTER (distance_m <= 700), 0) AS within_700, min(distance_m) AS nearest_m
FROM fx_subject s CROSS JOIN (VALUES {POI_LIST}) k(category) LEFT JOIN (SELECT * FROM near WHERE distance_m <= 1500) n ON n.subject_id = s.subject_id AND n.place = k.category GROUP BY 1, 2""")
def a12_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.poi_counts(subjects(spark, sf_dir), places(spark, sf_dir))


@registered("a12_transit_counts", NEAR + f""" SELECT s.subject_id, k.category, count(n.poi_id) FILTER (distance_m <= 300) AS within_300, count(n.poi_id) FILTER (distance_m <= 800) AS within_800, min(distance_m) AS nearest_m
FROM fx_subject s CROSS JOIN (VALUES {STOP_LIST}) k(category) LEFT JOIN (SELECT * FROM near WHERE distance_m <= 3000) n ON n.subject_id = s.subject_id AND n.stop = k.category GROUP BY 1, 2""")
def a12_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.transit_counts(subjects(spark, sf_dir), stops(spark, sf_dir))


@registered("t4_nearest_k", NEAR + " SELECT subject_id, place AS category, poi_id, distance_m, row_number() OVER (PARTITION BY subject_id, place ORDER BY distance_m, poi_id) AS rank FROM near WHERE place IS NOT NULL AND distance_m <= 1500 QUALIFY rank <= 5")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearest_of_spots(subjects(spark, sf_dir), places(spark, sf_dir), geo.POI_RADIUS, 5, geo.nearest_k).select("subject_id", "category", "poi_id", "distance_m", "rank")


@registered("t4_nearest_by_rings", NEAR + " SELECT subject_id, place AS category, poi_id, distance_m, row_number() OVER (PARTITION BY subject_id, place ORDER BY distance_m, poi_id) AS rank FROM near WHERE place IS NOT NULL AND distance_m <= 1500 QUALIFY rank <= 5")
def t4_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As t4_nearest_k, from the inside out."""
    return geo.nearest_by_rings(subjects(spark, sf_dir), places(spark, sf_dir), geo.POI_RADIUS, work_folder(spark, "rings"))


@registered("t4_nearest_rail", NEAR + " SELECT subject_id, stop AS category, poi_id, distance_m FROM near WHERE stop IN ('metro', 'tram', 'rail') AND distance_m <= 3000 QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY distance_m, list_position(['metro', 'marmaray', 'tram', 'rail'], stop), poi_id) = 1")
def t4_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearest_of_spots(subjects(spark, sf_dir), stops(spark, sf_dir), geo.TRANSPORT_RADIUS, 1, geo.nearest_rail).select("subject_id", "category", "poi_id", "distance_m")


@registered("t6_nearest_stops", NEAR + " SELECT subject_id, poi_id, distance_m, row_number() OVER (PARTITION BY subject_id ORDER BY distance_m, poi_id) AS rank FROM near WHERE stop = 'busStop' AND distance_m <= 3000 QUALIFY rank <= 30")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearest_stops(subjects(spark, sf_dir), stops(spark, sf_dir).where("category = 'busStop'").drop("category")).select("subject_id", "poi_id", "distance_m", "rank")


FACTOR_SQL = ", ".join(f"CASE WHEN {k}_m <= {b[0][0]} THEN {b[0][1]} WHEN {k}_m <= {b[1][0]} THEN {b[1][1]} WHEN {k}_m <= {b[2][0]} THEN {b[2][1]} ELSE 0 END AS {k}_points" for k, b in geo.FACTORS.items())


@registered("f20_location_score", NEAR + f""", d AS (
  SELECT s.subject_id, min(distance_m) FILTER (stop IN ('metro', 'tram', 'rail')) AS rail_m, min(distance_m) FILTER (stop = 'busStop') AS bus_m, min(distance_m) FILTER (place = 'market' AND distance_m <= 1500) AS market_m, min(distance_m) FILTER (place = 'pharmacy' AND distance_m <= 1500) AS pharmacy_m,
    min(distance_m) FILTER (place = 'school' AND distance_m <= 1500) AS school_m, min(distance_m) FILTER (place = 'park' AND distance_m <= 1500) AS park_m FROM fx_subject s LEFT JOIN (SELECT * FROM near WHERE distance_m <= 3000) n ON n.subject_id = s.subject_id GROUP BY 1
), e AS (SELECT *, {FACTOR_SQL} FROM d), f AS (SELECT *, rail_points + bus_points + market_points + pharmacy_points + school_points + park_points AS score FROM e)
SELECT subject_id, score, CASE WHEN score >= 80 THEN 'Çok güçlü' WHEN score >= 65 THEN 'Güçlü' WHEN score >= 50 THEN 'Orta' ELSE 'Sınırlı' END AS label, CASE WHEN score >= 80 THEN 1 WHEN score >= 65 THEN 0 WHEN score >= 50 THEN -1 ELSE -3 END AS adjust_min FROM f""")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = subjects(spark, sf_dir)
    poi = geo.poi_counts(subs, places(spark, sf_dir)).groupBy("subject_id").agg(*[F.min(F.when(c("category") == k, c("nearest_m"))).alias(f"{k}_m") for k in ("market", "pharmacy", "school", "park")])
    transit = geo.transit_counts(subs, stops(spark, sf_dir)).groupBy("subject_id").agg(F.min(F.when(c("category") == "busStop", c("nearest_m"))).alias("bus_m"), F.min(F.when(c("category").isin("metro", "marmaray", "tram", "rail"), c("nearest_m"))).alias("rail_m"))
    return geo.location_score(poi.join(transit, "subject_id")).select("subject_id", "score", "label", "adjust_min")


@registered("f21_polygons", """WITH p AS (SELECT s_suppkey AS subject_id, (s_suppkey % 7 + 1)::DOUBLE AS w, (s_suppkey % 5 + 1)::DOUBLE AS h FROM supplier)
SELECT subject_id, greatest(w * h, 1.0) AS area, CASE WHEN w * h >= 1 THEN w / 2 ELSE 0.5 END AS center_lon, CASE WHEN w * h >= 1 THEN h / 2 ELSE 0.5 END AS center_lat, w AS max_lon FROM p""")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (c("s_suppkey") % 7 + 1).cast("double"), (c("s_suppkey") % 5 + 1).cast("double")
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    zero, one = F.lit(0.0), F.lit(1.0)
    outer, inner = F.array(pt(zero, zero), pt(zero, h), pt(w, h), pt(w, zero)), F.array(pt(zero, zero), pt(zero, one), pt(one, one), pt(one, zero))
    rows = fixture(spark, sf_dir, "supplier").select(c("s_suppkey").alias("subject_id"), F.array(outer, inner).alias("rings")).withColumn("ring", geo.primary_ring(c("rings")))
    return rows.select("subject_id", geo.ring_area(c("ring")).alias("area"), geo.center(c("ring"))["lon"].alias("center_lon"), geo.center(c("ring"))["lat"].alias("center_lat"), geo.bounds(c("ring"))["max_lon"].alias("max_lon"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_stat")


@registered("w7_latest_metrics", "SELECT city, district, neighborhood, metric_key, source, year, metric_value FROM fx_stat QUALIFY row_number() OVER (PARTITION BY location_level, city, district, neighborhood, metric_key ORDER BY year DESC, source, source_key) = 1")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openstats.latest_metrics(stats(spark, sf_dir)).select("city", "district", "neighborhood", "metric_key", "source", "year", "metric_value")


LATEST = "l AS (SELECT * FROM fx_stat QUALIFY row_number() OVER (PARTITION BY location_level, city, district, neighborhood, metric_key ORDER BY year DESC, source, source_key) = 1)"


@registered("j4_j5_neighborhood_profile", f"WITH {LATEST}, d AS (SELECT city, district, sum(metric_value) AS pop FROM l GROUP BY 1, 2) SELECT s.subject_id, l.metric_value AS population, d.pop AS district_population, round(l.metric_value / d.pop * 100, 6) AS share_pct, l.year, CASE WHEN s.subject_id % 2 = 0 THEN 'exact' ELSE 'compact' END AS \"match\" FROM fx_subject s JOIN l ON s.city = l.city AND s.district = l.district AND s.neighborhood = l.neighborhood JOIN d ON d.city = l.city AND d.district = l.district")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # neighbourhoods are called Yeni Bağlar n here, and Yenibağlar n by every other subject
    named = lambda df: df.withColumn("neighborhood", F.concat(F.lit("Yeni Bağlar "), F.regexp_extract("neighborhood", r"(\d+)", 1), F.lit(" Mahallesi")))
    subs = fixture(spark, sf_dir, "fx_subject")
    subs = named(subs).withColumn("neighborhood", F.when(c("subject_id") % 2 == 1, F.replace("neighborhood", F.lit("Yeni B"), F.lit("Yenib"))).otherwise(c("neighborhood")))
    return openstats.neighborhood_profile(subs, named(stats(spark, sf_dir))).withColumn("share_pct", F.round("share_pct", 6))


@registered("j6_resolve_names", """WITH d AS (SELECT DISTINCT r_name AS parent, n_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey AS target_id, d2.n_nationkey AS candidate_id, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS tier FROM customer JOIN d d2 ON d2.n_nationkey = c_nationkey""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelforge.plans.fixtures import query

    names = query(spark, sf_dir, "select r_name as parent, n_name as name, n_nationkey from nation join region on r_regionkey = n_regionkey")
    candidates = names.select(c("n_nationkey").cast("int").alias("candidate_id"), "parent", F.concat(c("name"), F.lit(" Yakası")).alias("name"), c("n_nationkey").alias("ord"))
    people = fixture(spark, sf_dir, "customer").join(names, c("c_nationkey") == c("n_nationkey"))
    k = c("c_custkey") % 4
    spelled = F.when(k == 0, F.concat("name", F.lit(" YAKASI Mah."))).when(k == 1, F.concat("name", F.lit("yakası"))).when(k == 2, F.concat("name", F.lit(" Yak"))).otherwise(F.concat("name", F.lit(" Yakası Parkı")))
    return openstats.resolve_names(people.select(c("c_custkey").alias("target_id"), "parent", spelled.alias("name")), candidates).select("target_id", "candidate_id", "tier")


@registered("s8_u4_upsert_metrics", """WITH a AS (SELECT * FROM fx_stat WHERE year <= 2021), b AS (SELECT * REPLACE (metric_value + 1 AS metric_value) FROM fx_stat WHERE year >= 2021), k AS (SELECT source, source_dataset, source_key, metric_key, year FROM a)
SELECT 'insert' AS mode, source, source_key, year, metric_value FROM (SELECT source, source_key, year, metric_value FROM a UNION ALL SELECT b.source, b.source_key, b.year, b.metric_value FROM b WHERE year > 2021)
UNION ALL SELECT 'upsert', source, source_key, year, metric_value FROM (SELECT source, source_key, year, metric_value FROM b UNION ALL SELECT source, source_key, year, metric_value FROM a WHERE year < 2021)""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats(spark, sf_dir)
    old, new = rows.where("year <= 2021"), rows.where("year >= 2021").withColumn("metric_value", c("metric_value") + 1)
    both = [openstats.upsert_metrics(old, new, mode).select(F.lit(mode).alias("mode"), "source", "source_key", "year", "metric_value") for mode in ("insert", "upsert")]
    return both[0].unionByName(both[1])


@registered("f22_unpivot_metrics", """WITH r AS (SELECT c_custkey, (c_custkey * 10)::DOUBLE AS t, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey * 4)::DOUBLE END AS m FROM customer)
SELECT c_custkey, 'population_total' AS metric_key, t AS metric_value, 'Population total' AS metric_label, 'person' AS unit FROM r UNION ALL SELECT c_custkey, 'population_male', m, 'Population male', 'person' FROM r WHERE m IS NOT NULL""")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "customer").select("c_custkey", (c("c_custkey") * 10).cast("double").alias("population_total"), F.when(c("c_custkey") % 3 > 0, (c("c_custkey") * 4).cast("double")).alias("population_male"))
    return openstats.unpivot_metrics(rows)


@registered("a14_import_totals", "WITH p AS (SELECT city, district, neighborhood, count(*) AS n FROM fx_stat GROUP BY 1, 2, 3), d AS (SELECT city, district, count(*) AS places, sum(n) AS n FROM p GROUP BY 1, 2) SELECT city, count(*) AS districts, sum(places)::BIGINT AS places, sum(n)::BIGINT AS metric_rows FROM d GROUP BY ROLLUP (city)")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openstats.import_totals(stats(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_series").select("series", c("month_idx").alias("idx"), (c("value_cents") / 100).alias("value"))


INDEX = "WITH v AS (SELECT series, month_idx AS idx, value_cents / 100 AS value, lag(value_cents / 100, 1) OVER w AS b1, lag(value_cents / 100, 12) OVER w AS b12, lag(value_cents / 100, 36) OVER w AS b36, first(value_cents / 100) OVER w AS f, row_number() OVER (PARTITION BY series ORDER BY month_idx DESC) AS r FROM fx_series WINDOW w AS (PARTITION BY series ORDER BY month_idx))"


@registered("w8_index_changes", INDEX + ", m AS (SELECT series, min(value) AS low, max(value) AS high FROM v GROUP BY 1) SELECT v.series, value AS latest, round((value - b1) / b1 * 100, 6) AS monthly, round((value - b12) / b12 * 100, 6) AS annual, round((value - b36) / b36 * 100, 6) AS three_year, round((value - f) / f * 100, 6) AS period, low, high FROM v JOIN m ON v.series = m.series WHERE r = 1")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openstats.index_changes(series(spark, sf_dir)).withColumns({k: F.round(k, 6) for k in ("monthly", "annual", "three_year", "period")})


@registered("w8_yearly_changes", INDEX + " SELECT series, idx, round((value - b12) / b12 * 100, 2) AS change_pct FROM v WHERE b12 IS NOT NULL AND b12 <> 0")
def w8_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openstats.yearly_changes(series(spark, sf_dir))


GAPS = "g AS (SELECT series, month_idx AS idx, value_cents / 100 AS value FROM fx_series WHERE (month_idx * 7 + length(series)) % 5 > 0)"


@registered("w8_calendar_changes", f"""WITH {GAPS}, l AS (SELECT series, max(idx) AS idx, min(idx) AS f, min(value) AS low, max(value) AS high FROM g GROUP BY 1)
SELECT l.series, v.value AS latest, round((v.value - a.value) / a.value * 100, 6) AS monthly, round((v.value - b.value) / b.value * 100, 6) AS annual, round((v.value - d.value) / d.value * 100, 6) AS three_year, round((v.value - e.value) / e.value * 100, 6) AS period, low, high
FROM l JOIN g v ON v.series = l.series AND v.idx = l.idx LEFT JOIN g a ON a.series = l.series AND a.idx = l.idx - 1 LEFT JOIN g b ON b.series = l.series AND b.idx = l.idx - 12 LEFT JOIN g d ON d.series = l.series AND d.idx = l.idx - 36 JOIN g e ON e.series = l.series AND e.idx = l.f""")
def w8_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with a fifth of their months missing, compared by the calendar."""
    rows = series(spark, sf_dir).where((c("idx") * 7 + F.length("series")) % 5 > 0)
    return openstats.index_changes(rows, by_calendar=True).withColumns({k: F.round(k, 6) for k in ("monthly", "annual", "three_year", "period")})


@registered("w8_filled_months", f"""WITH {GAPS}, s AS (SELECT series, unnest(range(min(idx), max(idx) + 1)) AS idx FROM g GROUP BY series)
SELECT s.series, s.idx::INT AS idx, g.value, round((g.value - b.value) / b.value * 100, 2) AS change_pct FROM s LEFT JOIN g ON g.series = s.series AND g.idx = s.idx LEFT JOIN g b ON b.series = s.series AND b.idx = s.idx - 12""")
def w8_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of the series with gaps, and its change in a year where both months are there."""
    rows = series(spark, sf_dir).where((c("idx") * 7 + F.length("series")) % 5 > 0)
    return openstats.monthly(rows).join(openstats.yearly_changes(rows, by_calendar=True), ["series", "idx"], "left")
