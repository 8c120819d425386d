"""Declared schemas of the tables at rest, as DDL; sinks never infer them."""

from __future__ import annotations

LISTING = (
    "listing_uid string, title string, source string, source_url string, provider string, provider_rank int, price double, currency string, net_area double, gross_area double, price_per_sqm double, "
    "room_text string, building_age int, building_age_text string, floor double, floor_text string, total_floors double, total_floors_text string, distance_meters double, image_url string, image_source string, "
    "image_count double, address string, description string, external_id string, source_listing_id string, created_at timestamp, listing_date timestamp, latitude double, longitude double, city string, district string, "
    "neighborhood string, category string, valuation_type string, property_type string, heating string"
)
SUBJECT = (
    "subject_id long, city string, district string, neighborhood string, category string, valuation_type string, property_type string, subject_area double, subject_room_text string, subject_building_age int, "
    "floor_no int, building_floors int, has_elevator boolean, lat double, lon double"
)
METRIC = (
    "source string, source_dataset string, source_key string, source_reliability string, source_url string, declared_source string, location_level string, country string, city string, district string, "
    "neighborhood string, norm_city string, norm_district string, norm_neighborhood string, metric_key string, metric_label string, metric_text string, unit string, raw_json string, year int, metric_value double, fetched_at timestamp"
)
POI = "poi_id long, osm_type string, lat double, lon double, tags map<string, string>"
SCHEMAS = {"listing": LISTING, "subject": SUBJECT, "metric": METRIC, "poi": POI}
