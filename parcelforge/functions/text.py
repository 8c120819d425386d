"""Column functions on Turkish text: numbers, folded text, locations, categories, rooms, ages, floors, dates, identities."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turkish letters that fold to ASCII before lower-casing (Java's lower() is not Turkish-aware).
TURKISH_FROM = "İIığĞüÜşŞöÖçÇ"
TURKISH_TO = "iiigguussoocc"


def fold_table() -> tuple[str, str]:
    """For translate(): the Turkish letters, every other character whose canonical decomposition is an ASCII letter with
    combining marks, and the marks themselves, which have no counterpart and so vanish."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    plain = {c: d[0] for c in map(chr, range(0xC0, 0x2200)) if c not in TURKISH_FROM and (d := unicodedata.normalize("NFD", c)) != c and d[0].isascii() and d[0].isalpha() and all(m in marks for m in d[1:])}
    return TURKISH_FROM + "".join(plain) + marks, TURKISH_TO + "".join(plain.values())


FOLD_FROM, FOLD_TO = fold_table()
#: Words that callers of normalize_location() take off.
QUARTER_WORDS = ("mahallesi", "mahalle", "mah", "mh")

c = F.col


def js_round(x: Column, unit: float = 1.0) -> Column:
    """Half up, as floor(x + 0.5), to a multiple of the unit."""
    return F.floor(x / unit + 0.5) * unit if unit != 1.0 else F.floor(x + 0.5).cast("double")


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def held(rows: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """Some columns and new ones, worked out once for each row: filters and columns behind read them; Spark would write their
    expressions out again in each place that names them."""
    return rows.select(*kept, F.inline(F.array(F.struct(*[x.alias(name) for name, x in made.items()]))))


def contains_any(x: Column, words: Iterable[str]) -> Column:
    """Whether one of some words stands in a text: what a pattern of alternatives tries at each place of it."""
    return reduce(or_, [x.contains(w) for w in words])


def clean_text(col: Column) -> Column:
    """White space squeezed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def to_number_tr(col: Column) -> Column:
    """Number of a text with Turkish separators: dots are thousands where a comma, a thousands grouping or a second dot
    says so; the first comma is the decimal one.  Null if what is left is no number."""

    def plain(s: Column) -> Column:
        no_dots = F.replace(s, F.lit("."), F.lit(""))
        return F.when(s.contains(","), F.regexp_replace(no_dots, r"^([^,]*),", "$1.")).when(s.rlike(r"^-?\d{1,3}(\.\d{3})+$") | s.rlike(r"\..*\."), no_dots).otherwise(s)

    return once(F.regexp_replace(F.trim(col), r"[^0-9.,-]", ""), plain).try_cast("double")


def normalize_text(col: Column) -> Column:
    """Lower-case ASCII words with single spaces; accents, written in one character or as marks, and apostrophes vanish; `&` is the word `ve`."""
    s = F.lower(F.translate(F.coalesce(col, F.lit("")), FOLD_FROM, FOLD_TO))
    s = F.replace(F.replace(s, F.lit("'"), F.lit("")), F.lit("&"), F.lit(" ve "))
    return F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def normalize_location(col: Column, words: Iterable[str] = QUARTER_WORDS, compact: bool = False) -> Column:
    """Folded text without the given words; compact: also without spaces."""
    s = F.regexp_replace(normalize_text(col), r"\b(" + "|".join(words) + r")\b", "")
    return F.replace(s, F.lit(" "), F.lit("")) if compact else F.trim(F.regexp_replace(s, r"\s+", " "))


def slugify_tr(col: Column, strip_words: Iterable[str] = QUARTER_WORDS) -> Column:
    words = tuple(strip_words)
    s = normalize_location(col, words) if words else normalize_text(col)
    return F.replace(s, F.lit(" "), F.lit("-"))


#: Words that tell a category or type, as patterns on folded text.
LAND = r"\b(land|field|garden|arsa|arazi|tarla|bahce|bag|zeytinlik|imarli|imarsiz)\b"
COMMERCIAL = r"\b(commercial|shop|office|warehouse|factory|hotel|ofis|buro|dukkan|magaza|depo|fabrika|plaza|otel|isyeri|is yeri|ticari|sanayi|atolye|imalathane|cafe|bar|restoran|lokanta|pizzaci|pastane|firin)\b"
COMMERCIAL_TYPES = (
    (r"\b(office|ofis|buro)\b", "ofis"), (r"\b(warehouse|depo|antrepo)\b", "depo"), (r"\b(factory|fabrika|imalathane|atolye|sanayi)\b", "fabrika"),
    (r"\b(hotel|otel|pansiyon|apart otel)\b", "otel"), (r"\b(cafe|bar|restoran|lokanta|pizzaci|pastane|firin)\b", "dükkan"), (r"\b(plaza)\b", "plaza katı"),
    (r"\b(shop|dukkan|magaza|isyeri|is yeri|ticari)\b", "dükkan"),
)
LAND_TYPES = (("tarla", "tarla"), ("ticari", "ticari arsa"), ("konut", "konut imarlı arsa"), ("bag|bahce", "bağ bahçe"))
HOME_TYPES = (("villa", "villa"), ("residence", "residence"), ("mustakil", "müstakil ev"), ("dublex|dubleks", "dubleks"), ("triplex|tripleks", "tripleks"))


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose pattern is found."""
    found = F.lit(None).cast("string")
    for pattern, value in reversed(tuple(rules)):
        found = F.when(text.rlike(pattern), value).otherwise(found)
    return F.coalesce(found, F.lit(default))


def property_category(report_type: Column, property_type: Column) -> Column:
    r, p = normalize_text(report_type), normalize_text(property_type)
    text = F.trim(F.concat_ws(" ", r, p))
    return (
        F.when((r == "land") | r.contains("arsa") | text.contains("tarla"), "land")
        .when((r == "commercial") | r.contains("ticari") | r.contains("is yeri"), "commercial")
        .when(text.rlike(LAND), "land")
        .when(text.rlike(COMMERCIAL), "commercial")
        .otherwise("residential")
    )


def valuation_type(col: Column) -> Column:
    t = normalize_text(col)
    return F.when(t.contains("rent") | t.contains("kiralik"), "rental").otherwise("sale")


def search_type(category: Column, property_type: Column) -> Column:
    t = normalize_text(property_type)
    return F.when(category == "land", first_match(t, LAND_TYPES, "arsa")).when(category == "commercial", first_match(t, COMMERCIAL_TYPES, "iş yeri")).otherwise(first_match(t, HOME_TYPES, "daire"))


def building_age(number: Column, text: Column) -> Column:
    """Age in years: the number if it isn't negative, else from the text: new, or its first number of one or two digits.
    `0 yaş` counts as new as a word of its own only, so that `10 yaş` is 10."""
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), "İIıĞğÜüŞşÖöÇç", "iiigguussoocc"))
    from_text = F.when(t.rlike(r"sifir|\b0\s*yas|yeni"), 0.0).otherwise(F.regexp_extract(t, r"(\d{1,2})", 1).try_cast("double"))
    return F.when(number >= 0, js_round(number.cast("double"))).otherwise(from_text)


def floor_value(text: Column) -> Column:
    """Floor number of a text: ground floors 0, basements negative (a bare one -1)."""
    t = F.lower(F.translate(clean_text(text), "İIıĞğÜüŞşÖöÇç", "iiigguussoocc"))
    return F.when(t == "", None).when(t.rlike("bahce|zemin|giris"), 0.0).when(t.contains("bodrum"), F.coalesce(-F.abs(to_number_tr(t)), F.lit(-1.0))).otherwise(to_number_tr(t))


def room_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", ""))


def parse_room(col: Column) -> Column:
    """Struct (bedrooms, living) of `3+1`; null fields if it isn't of that form."""
    s = room_key(col)
    return F.struct(*[F.regexp_extract(s, r"^(\d+)\+(\d+)$", k).try_cast("int").alias(n) for k, n in ((1, "bedrooms"), (2, "living"))])


def room_matches(a: Column, b: Column) -> Column:
    return (room_key(a) != "") & (room_key(a) == room_key(b))


def is_studio(col: Column) -> Column:
    return F.coalesce(F.lower(col).rlike(r"stüdyo|studio|1\+0"), F.lit(False))


def room_compatible(item: Column, target: Column, allow_unknown: bool = False) -> Column:
    """Equal, or bedrooms within one and as many living rooms; no one-bedroom home for a subject of two or more."""
    return rooms_near(room_matches(item, target), F.coalesce(item, F.lit("")) == "", is_studio(item), parse_room(item), parse_room(target), allow_unknown)


def rooms_near(same: Column, blank: Column, studio: Column, i: Column, t: Column, allow_unknown: bool = False) -> Column:
    """room_compatible() of what is known of two rooms: whether they are the same, the item's is blank or a studio, and both as parse_room() gives them."""
    unknown = F.lit(allow_unknown)
    near = ~((t["bedrooms"] >= 2) & (i["bedrooms"] <= 1)) & (F.abs(i["bedrooms"] - t["bedrooms"]) <= 1) & (i["living"] == t["living"])
    return F.when(same, True).when(blank, unknown).when(studio, False).when(i["bedrooms"].isNull() | t["bedrooms"].isNull(), unknown).otherwise(near)


def parse_date_tr(col: Column, as_of: Column) -> Column:
    """Day.month.year (or with - or /) at noon, Turkish time, as UTC; else a timestamp as written; else `as_of`."""
    parts = [F.regexp_extract(clean_text(col), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", k) for k in (1, 2, 3)]
    iso = F.concat(parts[2], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[0], 2, "0"), F.lit("T12:00:00+03:00"))
    return F.coalesce(F.when(parts[2] != "", F.try_to_timestamp(iso)).otherwise(F.try_to_timestamp(clean_text(col))), as_of)


def external_id(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(clean_text(url)), 1, 16))


def digits_number(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"\D", "").try_cast("double")


def infer_year(text: Column, phrase: str = r"(20\d{2})\s*yılı") -> Column:
    """Year of the phrase if there, else the latest of 2007 to 2100 in the text, else 0."""
    said = F.regexp_extract(F.coalesce(text, F.lit("")), phrase, 1).try_cast("int")
    years = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(20\d{2})"), 1), lambda x: x.cast("int")), lambda y: (y >= 2007) & (y <= 2100))
    return F.coalesce(said, F.array_max(years), F.lit(0))


def normalize_phone(col: Column) -> Column:
    """Digits with the country's +90 in front where their number says so; null if there are none."""
    d = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), r"\D", ""), "^00", "")
    return F.when(d == "", None).when(d.rlike(r"^90\d{10}$"), F.concat(F.lit("+"), d)).when(d.rlike(r"^0\d{10}$"), F.concat(F.lit("+90"), F.substring(d, 2, 10))).when(d.rlike(r"^\d{10}$"), F.concat(F.lit("+90"), d)).otherwise(F.concat(F.lit("+"), d))


def phone_valid(col: Column) -> Column:
    return F.coalesce(normalize_phone(col).rlike(r"^\+90\d{10}$"), F.lit(False))


def normalize_email(col: Column) -> Column:
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


def email_valid(col: Column) -> Column:
    return F.coalesce(normalize_email(col).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


#: Codes of image and field sources, by the first word found in the folded text.
IMAGE_SOURCES = (("json", "JSON_LD"), ("twitter", "TWITTER_IMAGE"), ("og", "OG_IMAGE"), ("gallery|page", "PAGE_GALLERY"))
FIELD_SOURCES = (
    ("search title", "SEARCH_TITLE"), ("search|snippet", "SEARCH_SNIPPET"), ("thumb", "SEARCH_THUMBNAIL"), ("json", "JSON_LD"), ("og", "OG_META"),
    ("twitter", "TWITTER_META"), ("html|page", "HTML_VISIBLE_TEXT"), ("gallery", "PAGE_GALLERY"), ("manual", "MANUAL"),
)


def image_source_code(source: Column, provider: Column) -> Column:
    s, p = normalize_text(source), normalize_text(provider)
    thumb = s.contains("thumb") | p.rlike("serp|sahibinden|emlakjet")
    found = first_match(s, IMAGE_SOURCES, "")
    return F.when(found != "", found).when(thumb, "SEARCH_THUMBNAIL").when(s.contains("duplicate"), "DUPLICATE_MERGE").otherwise("UNKNOWN")


def field_source_code(source: Column) -> Column:
    return first_match(normalize_text(source), FIELD_SOURCES, "UNKNOWN")
