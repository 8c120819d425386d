"""Raw provider feeds in JSON and SOAP, landed in the common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import listing as L
from parcelforge.functions import text as T

c = F.col

#: Permissive schemas: all fields that a feed may have, everything optional.
SEARCH_SCHEMA = (
    "code string, title array<struct<languageId: int, text: string>>, priceInfo struct<amount: double, amountTypeSymbol: string>, m2Area double, m2AreaAttributeName string, roomOptions string, "
    "attributes map<string, string>, floor string, images array<string>, latitude double, longitude double, address string"
)
CRAWL_SCHEMA = (
    "url string, listingUrl string, title string, name string, price string, priceAmount string, grossArea string, grossSize string, netArea string, netSize string, imageUrls array<string>, images array<string>, imageUrl string, "
    "listingId string, floor string, buildingAge string, city string, district string, neighborhood string, listingDate string, specifications map<string, string>"
)


def normalize_search_feed(raw: DataFrame, as_of: Column) -> DataFrame:
    """Search API rows (raw JSON in `value`): nested price, title by language, build year in attribute 140."""
    rows = raw.select(F.inline(F.array(F.from_json("value", SEARCH_SCHEMA))))
    title = F.coalesce(F.filter("title", lambda t: t["languageId"] == 1)[0]["text"], F.get("title", 0)["text"])
    net = c("m2AreaAttributeName").rlike("(?i)net")
    year = F.element_at("attributes", "140").try_cast("int")
    now = F.year(as_of)
    age = F.when(year.between(1900, now + 1), F.greatest(now - year, F.lit(0))).when(year >= 0, year)
    net_area, gross_area = F.when(net, c("m2Area")), F.when(~net, c("m2Area"))
    image = F.get(F.filter("images", lambda x: F.coalesce(x, F.lit("")) != ""), 0)
    price = T.js_round(c("priceInfo.amount"))
    out = rows.select(
        F.concat(F.lit("remax:"), c("code")).alias("external_id"), F.concat(F.lit("https://www.remax.com.tr/portfoy/"), c("code")).alias("source_url"), T.clean_text(title).alias("title"), price.alias("price"),
        F.when(c("priceInfo.amountTypeSymbol") == "₺", "TRY").otherwise(F.coalesce("priceInfo.amountTypeSymbol", F.lit("TRY"))).alias("currency"), net_area.alias("net_area"), gross_area.alias("gross_area"),
        F.nullif(T.room_key(c("roomOptions")), F.lit("")).alias("room_text"), age.alias("building_age"), T.floor_value(c("floor")).alias("floor"), image.alias("image_url"), F.size("images").alias("image_count"),
        T.js_round(price / c("m2Area")).alias("price_per_sqm"), "latitude", "longitude", "address",
    )
    return out.where("source_url is not null and price is not null and coalesce(net_area, gross_area) > 0 and image_url is not null")


def normalize_crawl_feed(raw: DataFrame, as_of: Column) -> DataFrame:
    """Crawler rows (raw JSON in `value`): alternative names, a price that is a number or an object, a map of specifications."""
    rows = raw.select("value", F.inline(F.array(F.from_json("value", CRAWL_SCHEMA))))
    spec = lambda *names: F.coalesce(*[F.element_at("specifications", n) for n in names])
    number = lambda x: F.coalesce(x.try_cast("double"), T.to_number_tr(x))
    rows = T.held(
        rows, "city", "district", "neighborhood", "listingDate", price=F.coalesce(F.get_json_object("value", "$.price.amount").try_cast("double"), number(c("price")), number(c("priceAmount"))),
        gross_area=F.coalesce(number(c("grossArea")), number(c("grossSize")), number(spec("Brüt Metrekare", "Brüt m²", "Brüt Alan"))), net_area=F.coalesce(number(c("netArea")), number(c("netSize")), number(spec("Net Metrekare", "Net m²"))),
        image_url=F.coalesce(F.get("imageUrls", 0), F.get("images", 0), c("imageUrl")), source_url=F.coalesce(F.nullif(T.clean_text(c("url")), F.lit("")), c("listingUrl")), name=T.clean_text(F.coalesce("title", "name")), listed=T.clean_text(c("listingId")),
        currency=F.coalesce(F.get_json_object("value", "$.price.currency"), F.lit("TRY")), age_text=F.coalesce("buildingAge", spec("Binanın Yaşı")), floor_text=F.coalesce("floor", spec("Bulunduğu Kat")),
    ).where("source_url is not null and price is not null and coalesce(net_area, gross_area) > 0 and image_url is not null")
    code = F.coalesce(F.nullif(c("listed"), F.lit("")), F.nullif(F.regexp_extract("source_url", r"(\d{6,})", 1), F.lit("")))
    return rows.select(
        F.coalesce(F.concat(F.lit("emlakjet:"), code), F.concat(F.lit("apify-emlakjet:"), F.substring(F.sha1("source_url"), 1, 16))).alias("external_id"), "source_url",
        F.coalesce(F.nullif(c("name"), F.lit("")), F.lit("Emlakjet emsal ilanı")).alias("title"), "price", "currency", "net_area", "gross_area", T.building_age(F.lit(None).cast("double"), c("age_text")).alias("building_age"),
        T.floor_value(c("floor_text")).alias("floor"), "image_url", T.js_round(c("price") / F.coalesce("gross_area", "net_area")).alias("price_per_sqm"), "city", "district", "neighborhood",
        F.coalesce(F.try_to_timestamp(F.replace("listingDate", F.lit(" "), F.lit("T"))), as_of).alias("created_at"),
    )


def parse_stops(raw: DataFrame) -> DataFrame:
    """(code, name, lon, lat) of stops: JSON inside an XML-escaped result, places as `POINT (lon lat)`; malformed ones go."""
    inner = F.regexp_extract("value", r"(?s)<[^>]*Result>(.*?)</[^>]*Result>", 1)
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(entity), F.lit(char))
    rows = raw.select(F.explode(F.from_json(inner, "array<struct<SDURAKKODU: string, SDURAKADI: string, KOORDINAT: string>>")).alias("s"))
    lon, lat = [F.regexp_extract("s.KOORDINAT", r"POINT\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)", k).try_cast("double") for k in (1, 2)]
    return rows.select(c("s.SDURAKKODU").alias("code"), c("s.SDURAKADI").alias("name"), lon.alias("lon"), lat.alias("lat")).where("lon is not null and lat is not null")


def parse_index_points(raw: DataFrame) -> DataFrame:
    """(date, value) of wide items: the value is the first field that is no date; decimal commas."""
    dates = ("Tarih", "tarih", "DATE", "date")
    items = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.items"), "array<map<string, string>>")).alias("m"))
    date = F.coalesce(*[F.element_at("m", k) for k in dates])
    value = F.get(F.map_values(F.map_filter("m", lambda k, _: ~k.isin(*dates, "UNIXTIME"))), 0)
    return items.select(date.alias("date"), F.replace(value, F.lit(","), F.lit(".")).try_cast("double").alias("value")).where("date is not null and value is not null")


CHECKS = ("has_price", "has_area", "has_room", "has_image", "has_url", "area_fits", "has_district", "has_age", "has_floor")


def readiness(df: DataFrame) -> DataFrame:
    """Adds the nine checks of a feed, readiness (how many hold) and ready."""
    has = lambda x: F.coalesce(F.trim(x.cast("string")) != "", F.lit(False))
    rules = [c("price") > 0, L.comparable_area() > 0, has(c("room_text")), L.has_image(), L.is_http_url(c("source_url")), L.compatible_area(), has(c("district")), c("building_age").isNotNull(), c("floor").isNotNull()]
    rows = df.withColumns({n: F.coalesce(r, F.lit(False)) for n, r in zip(CHECKS, rules, strict=True)})
    need = CHECKS[:7]
    return rows.withColumn("readiness", sum((c(n).cast("int") for n in CHECKS), F.lit(0))).withColumn("ready", sum((c(n).cast("int") for n in need), F.lit(0)) == len(need))


def feed_readiness(df: DataFrame) -> DataFrame:
    """One row: how many listings pass each check, and how many are ready."""
    return readiness(df).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c(n)).alias(n) for n in CHECKS], F.count_if("ready").alias("ready"))


def top_samples(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n rows of the highest readiness."""
    return scored.orderBy(F.desc("readiness"), "listing_uid").limit(n)
