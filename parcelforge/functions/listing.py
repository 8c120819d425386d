"""Column functions on a listing, and on a listing joined with its subject (`subject_*` and `category` columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import building_age, clean_text, contains_any, js_round, normalize_location, normalize_text, room_key, room_matches, search_type

c = F.col
LONG_LISTED_DAYS = 45


def comparable_area(net: str = "net_area", gross: str = "gross_area") -> Column:
    """Net area, else gross area; zero counts as missing."""
    return F.coalesce(F.when(c(net) != 0, c(net)), F.when(c(gross) != 0, c(gross)))


def comparable_price() -> Column:
    return F.when(c("price") > 0, c("price"))


def unit_price(given: str | None = None) -> Column:
    """The given price per m² if positive, else price over area, rounded."""
    made = F.when((c("price") != 0) & (comparable_area() > 0), js_round(c("price") / comparable_area()))
    return F.coalesce(F.when(c(given) > 0, c(given)), made) if given else made


def comparable_key() -> Column:
    """What tells listings apart: the URL, else the listing's id, else title, price and area."""
    return F.coalesce(F.nullif(c("source_url"), F.lit("")), F.nullif(c("listing_uid"), F.lit("")), F.concat_ws(":", F.coalesce("title", F.lit("")), c("price").cast("string"), comparable_area().cast("string")))


def days_on_market(as_of: Column, created: str = "created_at", given: str | None = None) -> Column:
    """Whole days since the listing appeared; null if that is more than a day ahead."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(c(created))
    made = F.when(seconds >= -86400, F.greatest(F.floor(seconds / 86400), F.lit(0)))
    return F.coalesce(F.when(c(given) >= 0, F.floor(c(given) + 0.5)), made) if given else made


def long_listed(days: Column) -> Column:
    return days >= LONG_LISTED_DAYS


def is_test_listing(title: Column, address: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, address)).rlike("test|dikkate almay[iı]n")


def has_image() -> Column:
    return F.trim(F.coalesce("image_url", F.lit(""))) != ""


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/\s]+"), F.lit(False))


def is_real_image(url: Column, source: Column) -> Column:
    """An http(s) image that is no brand, mock, street view, nearby or pool picture."""
    s, u = normalize_text(source), F.lower(F.coalesce(url, F.lit("")))
    # white space is squeezed only in the few URLs that have a word of a made picture; such words have none
    made = contains_any(u, ("/comparables/mock-image", "/comparables/street-view", "com/maps/api/streetview"))
    made = made & F.lower(clean_text(url)).rlike("/comparables/mock-image|/comparables/street-view|maps.googleapis.com/maps/api/streetview")
    return F.coalesce(url.rlike(r"^\s*https?://[^/\s]+"), F.lit(False)) & ~s.rlike("brand|mock|street view|streetview|nearby|pool") & ~made


def area_ratio() -> Column:
    return comparable_area() / c("subject_area")


def within(x: Column, bands: dict[str, tuple[float, float]]) -> Column:
    """Whether x lies in the band of the row's category (`else` for others)."""
    found = x.between(*bands["else"])
    for category, band in bands.items():
        if category != "else":
            found = F.when(c("category") == category, x.between(*band)).otherwise(found)
    return F.coalesce(found, F.lit(False))


#: Area ratios that a listing may have, by use and category.
POOL_AREA = {"land": (0.35, 3.0), "commercial": (0.5, 2.0), "else": (0.65, 1.5)}
STRICT_AREA = {"land": (0.45, 2.25), "commercial": (0.65, 1.65), "else": (0.7, 1.35)}
WIDE_AREA = {"land": (0.2, 5.0), "else": (0.45, 1.9)}


def compatible_area() -> Column:
    """Area over 10 m² and, if the subject's is known, in the pool's band of it."""
    return F.coalesce(comparable_area() > 10, F.lit(False)) & F.when(c("subject_area") > 0, within(area_ratio(), POOL_AREA)).otherwise(True)


def compatible_room() -> Column:
    subject = room_key(c("subject_room_text"))
    return (c("category") != "residential") | (subject == "") | (room_key(c("room_text")) == subject)


def room_wanted() -> Column:
    """The room that a subject's listings must have for compatible_room(); empty if any will do."""
    return F.when(c("category") != "residential", "").otherwise(room_key(c("subject_room_text")))


def type_searched(name: str) -> Column:
    """A type as types are searched for; null if it is unknown."""
    return F.when(clean_text(c(name)) != "", normalize_text(search_type(c("category"), c(name))))


def compatible_type() -> Column:
    """The subject's type is unknown, or the listing's is the same, as types are searched for."""
    known = type_searched
    return known("subject_type").isNull() | F.coalesce(known("property_type") == known("subject_type"), F.lit(False))


def matches_subject() -> Column:
    """Of a listing joined with a subject of its scope: area in the band, rooms equal where they count."""
    return compatible_area() & compatible_room()


def evidence_text(city: Column, district: Column, neighborhood: Column, *texts: Column, address: Column) -> Column:
    """Folded texts and address, which is left out if it just joins the scope."""
    synthetic = normalize_location(address) == normalize_location(F.concat_ws(" / ", city, district, neighborhood))
    return normalize_text(F.concat_ws(" ", *texts, F.when(~synthetic, address)))


def mentions(hay: Column, needle: Column) -> Column:
    """Whether a folded text has the needle, with or without spaces."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return (needle != "") & (hay.contains(needle) | bare(hay).contains(bare(needle)))


def has_neighborhood_evidence(city: Column, district: Column, neighborhood: Column, *texts: Column, address: Column) -> Column:
    """Whether texts or the address (unless it just joins the scope) mention the neighbourhood, with or without spaces."""
    return mentions(evidence_text(city, district, neighborhood, *texts, address=address), normalize_location(neighborhood))


def points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of all rules that hold."""
    total = F.lit(0)
    for rule, n in rules:
        total = total + F.when(rule, n).otherwise(0)
    return total


def listing_points() -> Column:
    """The part of quality_score() that the listing alone has."""
    source = F.lower(F.coalesce("source", F.lit("")))
    own = points((has_image(), 20), (c("price").isNotNull(), 8), (comparable_area().isNotNull(), 8), (F.trim(F.coalesce("room_text", F.lit(""))) != "", 4))
    return own + points((source.contains("hepsiemlak"), 3), (source.rlike("re/max|remax"), 3), (source.contains("sahibinden"), 2), (source.contains("emlakjet"), 2))


def quality_score(own: Column | None = None, same_room: Column | None = None) -> Column:
    """How well a listing suits its subject, for selection.  Given: its listing_points() and whether the rooms match, if they are known."""
    own = listing_points() if own is None else own
    same_room = room_matches(c("room_text"), c("subject_room_text")) if same_room is None else same_room
    age, target = building_age(c("building_age"), F.lit(None).cast("string")), c("subject_building_age")
    ratio = F.when(c("subject_area") > 0, area_ratio())
    diff = F.abs(age - target)
    return (
        own
        + F.when(same_room, 8).otherwise(0)
        + F.when((target <= 5) & (age <= 5), 10).when(diff <= 3, 6).when(diff <= 8, 3).otherwise(0)
        + F.when(ratio.between(0.8, 1.25), 8).when(ratio.between(0.65, 1.5), 5).when(ratio.between(0.35, 2.5), 2).otherwise(0)
    )


def cache_quality_score() -> Column:
    """How complete a listing is, for the pool; at most 100."""
    real = is_real_image(c("image_url"), F.lit(""))
    return F.least(points((real, 30), (c("price").isNotNull(), 18), (comparable_area().isNotNull(), 18), (c("room_text").rlike(r"\S"), 10), (compatible_room(), 10), (compatible_area(), 10), (F.coalesce("source_url", F.lit("")) != "", 4)), F.lit(100))
