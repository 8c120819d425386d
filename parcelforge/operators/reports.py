"""Report records: locations, subjects, drafts, details, stored comparables, pricing, merges, summary texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import clean_text, property_category, to_number_tr, valuation_type
from parcelforge.operators.geo import FACTORS
from parcelforge.operators.policy import RENT_RATES, STRATEGIES, thousands

c = F.col


def present(col: Column) -> Column:
    """The trimmed text, null if empty."""
    return F.nullif(F.trim(col), F.lit(""))


def resolve_location(reports: DataFrame, properties: DataFrame) -> DataFrame:
    """Reports with city, district and neighbourhood: the property's, else the report's.

    Reports without a property stay where they are: as equals in their key a join would leave them all to one task.
    """
    names = ("city", "district", "neighborhood")
    p = properties.select("property_id", *[c(n).alias(f"p_{n}") for n in names])
    rows = reports.where("property_id is not null").join(p, "property_id", "left")
    rows = rows.unionByName(reports.where("property_id is null"), allowMissingColumns=True)
    return rows.withColumns({n: F.coalesce(present(c(f"p_{n}")), present(c(n))) for n in names}).drop(*[f"p_{n}" for n in names])


def positive(col: str) -> Column:
    return F.when(c(col) > 0, c(col))


def derive_subjects(reports: DataFrame, details: DataFrame) -> DataFrame:
    """What is to be valued: category, transaction, the first positive area (land: parcel before gross), room text."""
    rows = reports.join(details, "report_id", "left").withColumn("category", property_category(c("report_type"), c("property_type")))
    land = F.coalesce(*map(positive, ("subject_area", "parcel_area", "gross_area", "net_area")))
    home = F.coalesce(*map(positive, ("subject_area", "gross_area", "net_area", "parcel_area")))
    rooms = F.when(c("room_count").isNotNull() & c("salon_count").isNotNull(), F.concat_ws("+", c("room_count").cast("int").cast("string"), c("salon_count").cast("int").cast("string")))
    return rows.withColumns({"subject_area": F.when(c("category") == "land", land).otherwise(home), "subject_room_text": F.coalesce(present(c("room_text")), rooms), "valuation_type": valuation_type(c("valuation_type"))})


def flatten_drafts(drafts: DataFrame) -> DataFrame:
    """Fields of a draft's JSON from wherever they are first filled, and its step, 1 to 9."""
    got = lambda *paths: F.coalesce(*[present(F.get_json_object("draft_json", p)) for p in paths])
    return drafts.select(
        "report_id", got("$.property.city", "$.location.city", "$.city").alias("city"), got("$.property.district", "$.location.district", "$.district").alias("district"), got("$.title", "$.property.title").alias("title"),
        F.least(F.greatest(F.coalesce(got("$.step").try_cast("int"), F.lit(1)), F.lit(1)), F.lit(9)).alias("step"),
    )


NUMBERS = ("gross_area", "net_area", "terrace_area", "room_count", "salon_count", "bath_count", "floor", "building_age", "building_floors")
TEXTS = ("heating", "usage_status", "property_type", "building_condition")
FLAGS = (
    "is_on_main_road", "is_on_street", "is_site", "has_elevator", "open_parking", "closed_parking", "has_caretaker", "has_children_park", "security", "open_pool", "closed_pool",
    "has_generator", "has_hydrophore", "has_thermal_insulation", "has_water_tank", "has_ac", "has_fireplace",
)


def listed(csv: Column) -> Column:
    """The parts of a comma list, trimmed, without empty ones; null stays null."""
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def sanitize_details(df: DataFrame) -> DataFrame:
    """Fields of a home and its building: numbers from <name>_text, flags as they are, tags and directions from comma lists
    (also joined again, where no text of their own is given), sports from either flag, empty texts null.  Missing columns are null."""
    text = lambda k: c(k).cast("string") if k in df.columns else F.lit(None).cast("string")
    flag = lambda k: c(k) if k in df.columns else F.lit(None).cast("boolean")
    tags, ways = listed(text("view_csv")), listed(text("facade_csv"))
    return df.withColumns(
        {k: to_number_tr(text(f"{k}_text")) for k in NUMBERS} | {k: present(clean_text(text(k))) for k in TEXTS} | {k: flag(k) for k in FLAGS}
        | {"has_sports_area": F.coalesce(flag("has_sports_area"), F.lit(False)) | F.coalesce(flag("has_fitness_center"), F.lit(False))}
        | {"view_tags": tags, "facade_directions": ways, "view": F.coalesce(text("view"), F.array_join(tags, ", ")), "facade": F.coalesce(text("facade"), F.array_join(ways, ", "))}
    )


def sanitize_clients(df: DataFrame) -> DataFrame:
    return df.withColumns({n: present(clean_text(c(n))) for n in ("full_name", "note") if n in df.columns} | {"email": F.lower(present(c("email")))})


def apply_id_lists(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Comparables of a report without those its lists exclude and, if it came from storage and has a list, only those it includes.

    items: (report_id, item_id, from_storage, …); lists: (report_id, included, excluded) arrays.
    """
    rows = items.join(lists, "report_id", "left")
    out = F.coalesce(F.array_contains("excluded", c("item_id")), F.lit(False))
    chosen = ~c("from_storage") | (F.coalesce(F.size("included"), F.lit(0)) <= 0) | F.array_contains("included", c("item_id"))
    return rows.where(~out & F.coalesce(chosen, F.lit(False))).drop("included", "excluded")


def normalize_stored_comparable(df: DataFrame) -> DataFrame:
    """Numbers from text; kilometres given or from metres; the floor's text if it is no number."""
    return df.withColumns({
        "price": to_number_tr(c("price_text")), "distance_km": F.coalesce("distance_km", c("distance_m") / 1000), "floor": to_number_tr(c("floor_raw")),
        "floor_text": F.when(to_number_tr(c("floor_raw")).isNull(), present(c("floor_raw"))),
    })


def pricing_record(df: DataFrame) -> DataFrame:
    """Expected price from the average where it is missing (which it then is), transaction folded, note cleaned, labels and times
    of the three prices, and the rents that a sale price would give."""
    kind = F.upper(valuation_type(c("valuation_type")))
    price = F.coalesce("expected_price", "avg_price")
    rows = df.withColumns({"expected_price": price, "avg_price": price, "expected_sqm": F.coalesce("expected_sqm", "avg_sqm"), "valuation_type": kind, "note": present(clean_text(c("note")))})
    pick = lambda i, j: F.when(c("valuation_type") == "RENTAL", STRATEGIES["RENTAL"][i][j]).otherwise(STRATEGIES["SALE"][i][j])
    plans = {f"{n}_{what}": pick(i, j) for i, n in enumerate(("low", "mid", "high")) for j, what in enumerate(("label", "time"))}
    rents = {f"rent_{n}": F.when((c("valuation_type") == "SALE") & (c("expected_price") > 0), thousands(c("expected_price") * r)) for n, r in RENT_RATES}
    return rows.withColumns({"avg_sqm": c("expected_sqm")} | plans | rents)


def merge_json(existing: Column, incoming: Column) -> Column:
    """Top-level keys of the incoming object over the existing one: null clears, absent keeps.  Values as JSON text."""
    as_map = lambda x: F.coalesce(F.from_json(x, "map<string, string>"), F.create_map().cast("map<string, string>"))
    a, b = as_map(existing), as_map(incoming)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)))), {"ignoreNullFields": "false"})


def one_decimal(x: Column) -> Column:
    """With a decimal comma, and dots between thousands."""
    return F.translate(F.format_number(F.floor(x * 10 + 0.5) / 10, 1), ".,", ",.")


def distance_text(metres: Column) -> Column:
    """Metres, or kilometres with one decimal from 1000 on."""
    return F.when(metres < 1000, F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))).when(metres.isNotNull(), F.concat(one_decimal(metres / 1000), F.lit(" km")))


def number_text(x: Column) -> Column:
    """Whole numbers with dots between thousands."""
    return F.replace(F.format_number(F.floor(x + 0.5), 0), F.lit(","), F.lit("."))


def joined(*parts: Column, by: str = " ") -> Column:
    return F.concat_ws(by, *parts)


#: The kinds of places in the order in which summaries name them.
POI_LABELS = (
    ("school", "okul"), ("hospital", "hastane"), ("familyHealth", "aile sağlığı/klinik"), ("pharmacy", "eczane"), ("market", "market"), ("park", "park"), ("mosque", "cami"), ("bank", "banka"), ("mall", "AVM"), ("parking", "otopark"),
)
NEAREST = ("school", "pharmacy", "market", "park")
SCORE_HINT = "Konum skoru fiyatlamaya agresif prim olarak basılmaz; emsal fiyat bandı yanında likidite ve küçük düzeltme notu olarak kullanılır."


def poi_summary(df: DataFrame, radius_m: int = 500) -> Column:
    """From <kind>_within_500 and <kind>_nearest_m columns: how many places of each kind are near, and the nearest of some kinds."""
    col = lambda k: c(k) if k in df.columns else F.lit(None).cast("double")
    counts = joined(*[F.when(col(f"{k}_within_500") > 0, F.concat(col(f"{k}_within_500").cast("long").cast("string"), F.lit(f" {label}"))) for k, label in POI_LABELS], by=", ")
    nearest = joined(*[F.concat(F.lit(f"En yakın {label} "), distance_text(col(f"{k}_nearest_m"))) for k, label in sorted((x for x in POI_LABELS if x[0] in NEAREST), key=lambda x: NEAREST.index(x[0]))], by="; ")
    text = joined(F.when(counts != "", F.concat(F.lit(f"{radius_m} m içinde "), counts, F.lit(" bulundu."))), F.when(nearest != "", F.concat(nearest, F.lit("."))))
    return F.when(text == "", f"{radius_m} m içinde OSM üzerinde belirgin POI kaydı bulunamadı.").otherwise(text)


#: The stops that a summary names.
STOPS = (("bus", "otobüs durağı"), ("rail", "raylı sistem"), ("metrobus", "metrobüs durağı"))


def transport_summary(df: DataFrame) -> Column:
    """From <stop>_nearest_m and <stop>_nearest_name columns."""
    parts = [F.concat(F.lit(f"En yakın {label} "), distance_text(c(f"{k}_nearest_m")), F.lit(" ("), c(f"{k}_nearest_name"), F.lit(").")) for k, label in STOPS if f"{k}_nearest_m" in df.columns]
    text = joined(*parts)
    return F.when(text == "", "Yakın çevrede OSM/IETT üzerinde ulaşım durağı tespit edilemedi.").otherwise(text)


def profile_summary() -> Column:
    """From neighborhood, district, year, population_total, population_male, population_female, district_population, district_share_pct."""
    none = ~(F.coalesce(c("population_total"), F.lit(0)) > 0) & ~(F.coalesce(c("district_population"), F.lit(0)) > 0)
    by_sex = F.when((c("population_male") > 0) | (c("population_female") > 0), F.concat(F.lit("; erkek "), F.coalesce(number_text(c("population_male")), F.lit("-")), F.lit(", kadın "), F.coalesce(number_text(c("population_female")), F.lit("-")))).otherwise("")
    here = F.concat(F.coalesce(present(c("neighborhood")), present(c("district")), F.lit("Bölge")), F.lit(" "), F.coalesce(c("year").cast("string"), F.lit("")), F.lit(" nüfusu "), number_text(c("population_total")), F.lit(" kişi"), by_sex, F.lit("."))
    share_of = F.when(c("district_share_pct") > 0, F.concat(F.lit("; mahalle ilçe nüfusunun yaklaşık "), one_decimal(c("district_share_pct")), F.lit("%'ini oluşturuyor"))).otherwise("")
    around = F.concat(F.coalesce(present(c("district")), F.lit("İlçe")), F.lit(" ilçe nüfusu "), number_text(c("district_population")), F.lit(" kişi"), share_of, F.lit("."))
    text = joined(F.when(c("population_total") > 0, here), F.when(c("district_population") > 0, around))
    return F.when(none, F.concat(F.coalesce(present(c("neighborhood")), F.lit("Mahalle")), F.lit(" için kayıtlı nüfus profili bulunamadı."))).otherwise(text)


#: The factors of the location score as summaries name them.
FACTOR_NAMES = (("rail", "raylı sistem"), ("bus", "otobüs durağı"), ("market", "market"), ("pharmacy", "eczane"), ("school", "okul"), ("park", "park"))


def score_summary(most: int = 4) -> Column:
    """From score, label and, for each factor of the location score, <factor>_points and <factor>_m: the first ones that count."""

    def told(k: str, name: str) -> Column:
        strong, good, _ = FACTORS[k]
        status = F.when(c(f"{k}_m") <= strong[0], "güçlü").when(c(f"{k}_m") <= good[0], "iyi").otherwise("orta")
        return F.when((c(f"{k}_points") > 0) & c(f"{k}_m").isNotNull(), F.concat(F.lit(f"{name} "), distance_text(c(f"{k}_m")), F.lit(" ("), status, F.lit(")")))

    strong = F.array_compact(F.array(*[told(k, name) for k, name in FACTOR_NAMES]))
    head = F.concat(F.lit("Konum skoru "), c("score").cast("string"), F.lit("/100 ("), c("label"), F.lit(")."))
    return joined(head, F.when(F.size(strong) > 0, F.concat(F.lit("Öne çıkan erişimler: "), F.array_join(F.slice(strong, 1, most), ", "), F.lit("."))), F.lit(SCORE_HINT))
