"""Records from HTML pages.  Cards, population pages and page facts are read through one tokenizer of markup, in Arrow helpers
that give what is written there; it is turned into numbers, dates and keys by column functions."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from parcelforge.functions import text as T
from parcelforge.operators.media import best_images, key_of, priority_of, without_query
from parcelforge.operators.pool import unique_first
from parcelforge.sources.markup import Page, clean

c = F.col


def stripped(html: Column) -> Column:
    """Text of a stretch of markup."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return T.clean_text(s)


def found(col: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def spark_type(kind: pa.DataType) -> DataType:
    """Spark's name for a type that a helper gives; no session is needed."""
    if pa.types.is_struct(kind):
        return StructType([StructField(x.name, spark_type(x.type)) for x in kind])
    if pa.types.is_list(kind):
        return ArrayType(spark_type(kind.value_type))
    return DoubleType() if pa.types.is_floating(kind) else StringType()


#: URLs, and paths of a site, that a base leaves as they are.
WHOLE_URL, SITE_PATH = re.compile(r"https?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9._~%/-]*)?"), re.compile(r"(?:/[A-Za-z0-9_~%-][A-Za-z0-9._~%-]*)+/?")


def absolute(value: str | None, base: str) -> str | None:
    text = clean(value)
    if WHOLE_URL.fullmatch(text):
        return text
    try:
        if SITE_PATH.fullmatch(text):
            return site_of(base) + text
        return urljoin(base, text) if text else None
    except ValueError:
        return None


@lru_cache
def site_of(base: str) -> str:
    return urljoin(base, "/")[:-1]


def lower_tr(text: str) -> str:
    return text.replace("I", "ı").replace("İ", "i").lower()


#: Texts of a card that are no title, cities whose names make a text an address, hosts of photos.
NO_TITLE, CITIES = re.compile("telefonu göster|whatsapp|paylaş", re.I), re.compile("İstanbul|Ankara|İzmir|Bursa|Antalya|Kocaeli|Sakarya", re.I)
PHOTO_HOST, LOGO = re.compile("hecdn|hemlak", re.I), re.compile("logo/", re.I)
DATE, FOUND = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}"), re.compile(r"için\s+([0-9.]+)\s+ilan\s+bulundu", re.I)
CARD = ("link", "title", "price", "room", "area", "age", "floor", "image", "images", "address", "date")


def card_facts(page: Page, card: int, base: str) -> dict:
    """What a card says, as written.  A label's value is the line after it; labels are compared in lower case."""
    link = first = count = None
    photos, prices = [], []
    for k in page.within(card):
        name, cls = page.names[k], page.attrs[k].get("class")
        if name == "a" and first is None:
            first = k
        elif name == "img":
            photos.append(k)
        if cls:
            words = cls.split()
            if name == "a" and link is None and "listingView__card-link" in words:
                link = k
            if "list-view-price" in words:
                prices.append(k)
            if count is None and "photo-count" in words:
                count = k
    href = (page.attr(link, "href") if link is not None else None) or (page.attr(first, "href") if first is not None else None)
    lines = [x for x in map(clean, page.text(card).split("\n")) if x]
    at: dict[str, int] = {}
    for k, x in enumerate(lines):
        at.setdefault(lower_tr(x), k)

    def said(label: str) -> str | None:
        k = at.get(label)
        if k is None or k + 1 >= len(lines):
            return None
        value, more = lines[k + 1], lines[k + 2] if k + 2 < len(lines) else ""
        return f"{value} {more}" if value.endswith("+") and re.fullmatch("[0-9]+", more) else value

    sources = (x for k in photos for x in (page.attr(k, "data-src"), page.attr(k, "src"), ((page.attr(k, "srcset") or "").split() or [None])[0]))
    images = (absolute(x, base) for x in sources)
    return {
        "link": absolute(href, base), "title": (clean(page.attr(link, "title")) if link is not None else "") or next((x for x in lines if len(x) > 18 and not NO_TITLE.search(x)), None),
        "price": clean("".join(page.text(k) for k in prices)), "room": said("oda sayısı"), "area": said("brüt m²"), "age": said("bina yaşı"), "floor": said("kat"),
        "image": next((x for x in images if x and not x.startswith("data:") and PHOTO_HOST.search(x) and not LOGO.search(x)), None), "images": clean(page.text(count)) if count is not None else None,
        "address": next((x for x in lines if "/" in x and re.search("/.+/", x) and CITIES.search(x)), None), "date": next((x for x in lines if len(x) <= 10 and DATE.fullmatch(x)), None),
    }


PAGE_OF_CARDS = pa.struct([("cards", pa.list_(pa.struct([(x, pa.string()) for x in CARD]))), ("found", pa.string())])


def extract_listing_cards(pages: DataFrame, as_of: Column, base: str = "https://www.hepsiemlak.com", most: int | None = 30) -> DataFrame:
    """Listings of result pages (page_id, html): each `li.listing-item` is a card with link, price, labels and image.

    Cards without link, price, area or a photo of the site's own hosts go; of the others, a page gives the first `most` (None: all).
    `record_count` is the number of results that the page says it found, else that of its cards.
    """

    @F.arrow_udf(spark_type(PAGE_OF_CARDS))
    def read(html: pa.Array) -> pa.Array:
        ends, cards, found = [0], [], []
        for source in html.to_pylist():
            page = Page(source or "")
            count = FOUND.search(page.text())
            cards += [card_facts(page, k, base) for k in page.having("li", "listing-item")]
            ends.append(len(cards))
            found.append(count[1].replace(".", "") if count else None)
        columns = [pa.array([x[name] for x in cards], pa.string()) for name in CARD]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, CARD))
        return pa.StructArray.from_arrays([lists, pa.array(found, pa.string())], ["cards", "found"])

    price = lambda x: T.js_round(T.to_number_tr(x["price"]))
    whole = lambda x: (x["link"] != "") & price(x).isNotNull() & (T.to_number_tr(x["area"]) > 0) & (x["image"] != "")
    kept = F.filter("page.cards", lambda x: F.coalesce(whole(x), F.lit(False)))
    kept = F.slice(kept, 1, most) if most else kept
    rows = pages.select("page_id", read("html").alias("page")).select("page_id", c("page.found").try_cast("double").alias("said"), kept.alias("kept"))
    x = c("card")
    number = F.nullif(F.regexp_extract(T.clean_text(x["link"]), r"/([^/]+/[^/]+)$", 1), F.lit(""))
    rows = rows.select("page_id", F.coalesce("said", F.size("kept").cast("double")).alias("record_count"), F.posexplode("kept").alias("pos", "card")).select(
        "page_id", "pos", x["link"].alias("source_url"), price(x).alias("price"), x["title"].alias("title"), F.nullif(T.room_key(x["room"]), F.lit("")).alias("room_text"), T.to_number_tr(x["area"]).alias("gross_area"),
        T.building_age(F.lit(None).cast("double"), x["age"]).alias("building_age"), T.floor_value(x["floor"]).alias("floor"), x["image"].alias("image_url"), T.parse_date_tr(x["date"], as_of).alias("created_at"),
        x["address"].alias("address"), number.alias("source_listing_id"), F.concat(F.lit("hepsiemlak:"), number).alias("external_id"), T.to_number_tr(x["images"]).alias("image_count"), "record_count",
    )
    return unique_first(rows, ["source_url"], [c("page_id"), c("pos")])


#: What records of population pages say of their source.
POPULATION = {"source": "NUFUSUNE", "source_dataset": "population", "source_reliability": "secondary_tuik_declared_unverified", "declared_source": "TUIK online population database, declared by nufusune.com"}


ROW = ("name", "href", "total", "male", "female")
POPULATION_PAGE = pa.struct([("city", pa.string()), ("district", pa.string()), ("text", pa.string()), ("summary", pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))), ("rows", pa.list_(pa.struct([(x, pa.string()) for x in ROW])))])
SUFFIX = re.compile(r"\s*N[UÜ]FUSU\s*", re.I)


def population_facts(page: Page) -> dict:
    """Names, labelled numbers and table rows of a district's page, as written."""

    def joined(found: Iterator[int]) -> str:
        return "".join(map(page.text, found))

    crumbs = [a for u in page.having("ul", "breadcrumb") for a in page.having("a", None, u)]
    titles = [k for k in page.having("h1") if page.attrs[k].get("id") == "ust_baslik"]
    items = dict.fromkeys(li for box in page.having(None, "boxDetaylar") for li in page.having("li", None, box))
    tables = [k for k in page.within() if page.attrs[k].get("id") == "ust_tablo"][:1]
    rows = [tr for t in tables for tr in page.having("tr", None, t)]
    if not rows:  # of the rows that hold a labelled name, the innermost
        holders = {}
        for tr in page.having("tr"):
            holders |= {td: tr for td in page.having("td", None, tr) if page.attr(td, "data-label") == "MAHALLE ADI"}
        rows = list(dict.fromkeys(holders.values()))

    def row(tr: int) -> dict:
        cells = list(page.having("td", None, tr))
        labelled = lambda name: (k for k in cells if page.attr(k, "data-label") == name)
        at = lambda k: page.text(cells[k]) if k < len(cells) else ""
        link = next((a for td in labelled("MAHALLE ADI") for a in page.having("a", None, td)), None)
        name = (page.text(link) if link is not None else "") or at(0)
        return {"name": clean(name), "href": page.attr(link, "href") if link is not None else None, **{x: joined(labelled(label)) or at(k) for k, (x, label) in enumerate((("total", "TOPLAM NÜFUS"), ("male", "ERKEK NÜFUS"), ("female", "KADIN NÜFUS")), 1)}}

    return {
        "city": clean(SUFFIX.sub("", page.text(crumbs[1]), count=1)) if len(crumbs) > 1 else None, "district": clean(SUFFIX.sub("", joined(iter(titles)).split(",")[0], count=1)) or None,
        "text": page.text(), "summary": [{"label": joined(page.having(None, "dtColOne", li)), "value": joined(page.having(None, "dtColTwo", li))} for li in items], "rows": [row(tr) for tr in rows],
    }


@F.arrow_udf(spark_type(POPULATION_PAGE))
def read_population(html: pa.Array) -> pa.Array:
    return pa.array([population_facts(Page(x or "")) for x in html.to_pylist()], POPULATION_PAGE)


def parse_population_pages(pages: DataFrame, base: str = "https://www.nufusune.com/") -> DataFrame:
    """Records of district pages (city, district, html[, url]): one for the district's summary, one for each row of its table.

    City and district are those given, else those of the page's breadcrumbs and heading.  Cells are found by their label, else
    by their place.  The year is that of the sentence on the district's total, else the latest on the page.  Records have
    their source, a stable source_key (the row's number, else the names' slugs) and source_url, so that they can be unpivoted and upserted.
    """
    url = c("url") if "url" in pages.columns else F.lit(None).cast("string")
    said = [F.lit(v).alias(k) for k, v in POPULATION.items()]
    slug = lambda x: T.slugify_tr(c(x), ())
    given = lambda x: F.coalesce(F.nullif(T.clean_text(c(x)), F.lit("")), c(f"page.{x}"))
    text = T.normalize_text(c("page.text"))
    years = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.cast("int")), lambda y: (y >= 2007) & (y <= 2100))
    year = F.coalesce(F.regexp_extract(text, r"\bilcesinin\s+(20\d{2})\s+ilce toplam nufusu\b", 1).try_cast("int"), F.array_max(years), F.lit(0))
    facts = F.transform("page.summary", lambda x: F.struct(T.normalize_text(x["label"]).alias("label"), T.digits_number(x["value"]).alias("value")))
    read = pages.select("city", "district", url.alias("source_url"), read_population("html").alias("page"))
    read = read.select(given("city").alias("city"), given("district").alias("district"), "source_url", year.alias("year"), facts.alias("facts"), c("page.rows").alias("lines"))
    last = lambda *words: F.try_element_at(F.filter("facts", lambda x: x["label"].rlike("|".join(words))), F.lit(-1))["value"]
    total = F.try_element_at(F.filter("facts", lambda x: x["label"].contains("toplam nufus") & ~x["label"].contains("belde")), F.lit(1))["value"]
    district = read.select(
        "city", "district", F.lit(None).cast("string").alias("neighborhood"), "year", F.lit("DISTRICT").alias("location_level"), total.alias("population_total"), last("toplam erkek nufusu").alias("population_male"), last("toplam kadin nufusu").alias("population_female"),
        last("mahalle sayisi").alias("neighborhood_count"), last("koye bagli", "bagli koy sayisi").alias("village_count"), F.concat(F.lit("nufusune:"), slug("city"), F.lit(":"), slug("district")).alias("source_key"), "source_url", *said,
    )
    lines = read.select("city", "district", "year", "source_url", F.explode("lines").alias("line"))
    places = lines.select(
        "city", "district", F.nullif(c("line.name"), F.lit("")).alias("neighborhood"), "year", F.lit("NEIGHBORHOOD").alias("location_level"), *[T.digits_number(c(f"line.{x}")).alias(f"population_{x}") for x in ("total", "male", "female")], c("line.href").alias("href"), "source_url",
    )
    record = found("href", r"^/?(\d+)-")
    place_key = F.coalesce(record, F.concat_ws(":", slug("city"), slug("district"), slug("neighborhood")))
    row_url = F.when(c("href").startswith("http"), c("href")).when(c("href") != "", F.concat(F.lit(base), F.regexp_replace("href", "^/", "")))
    none = [F.lit(None).cast("double").alias(x) for x in ("neighborhood_count", "village_count")]
    places = places.withColumns({"source_key": F.concat(F.lit("nufusune:"), place_key), "source_url": F.coalesce(row_url, c("source_url"))}).select(*[x for x in district.columns if x not in ("neighborhood_count", "village_count", *POPULATION)], *none, *said)
    return district.where("population_total is not null").unionByName(places.where("neighborhood is not null and population_total is not null"))


def extract_location_links(pages: DataFrame) -> DataFrame:
    """(url, text) of the links of pages (page_id, html), each URL once, from its first page."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)(<a\s[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), 1)).alias("pos", "link"))
    rows = links.select("page_id", "pos", found("link", r"href=[\"']([^\"']+)[\"']").alias("url"), stripped(c("link")).alias("text")).where("text <> ''")
    return unique_first(rows, ["url"], [c("page_id"), c("pos")]).select("url", "text")


def decoded(text: str) -> str:
    """The six entities of page facts, ampersands first, so that what was escaped twice is plain."""
    if "&" not in text:
        return text
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        text = text.replace(entity, char)
    return text


#: How pages write areas, the likeliest first, and numbers of rooms.
AREAS = tuple(
    re.compile(before + r"([1-9][0-9.,]{1,7})\s*(?:m²|m2|metrekare)(?=\s|$|[.,;:)])", re.I)
    for before in (r"(?:net|kullanım|kullanim)\s*(?:alanı|alani)?\s*:?\s*", r"(?:brüt|brut)\s*(?:alanı|alani)?\s*:?\s*", r"(?<![A-Za-z0-9_])")
)
ROOMS = re.compile(r"(?<![A-Za-z0-9_])(?:[1-9][0-9]?\s*\+\s*[0-9]|stüdyo|studio)(?![A-Za-z0-9_])", re.I)
META_IMAGES, META_TEXTS = ("og:image:secure_url", "og:image", "twitter:image"), ("description", "og:description")


def number_tr(value: object) -> float | None:
    """As written with Turkish separators: dots are thousands, a comma is the decimal one."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    text = "".join(str(value).split()).replace(".", "").replace(",", ".", 1)
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None


def rounded(x: float) -> float:
    return float(math.floor(x + 0.5))


def area_of(text: str) -> float | None:
    for pattern in AREAS:
        m = pattern.search(text)
        area = number_tr(m[1]) if m else None
        if area and 10 <= area <= 100_000:
            return rounded(area)
    return None


def meta_of(metas: list[dict[str, str]], keys: tuple[str, ...]) -> str | None:
    """The content of the first of some meta tags, given by their attributes, of the first of some names that has one."""
    for key in keys:
        for x in metas:
            content = re.match("[^\"']+", x.get("content", ""))
            if content and key in (x.get("property", "").lower(), x.get("name", "").lower()):
                if text := decoded(content[0]).strip():
                    return text
                break
    return None


def json_facts(page: Page) -> tuple[str | None, float | None, str | None]:
    """The first image, floor size and number of rooms anywhere in the JSON-LD of a page."""

    def walk(node: object) -> Iterator[dict]:
        stack = [node]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                yield x
                stack += reversed(list(x.values()))
            elif isinstance(x, list):
                stack += reversed(x)

    def image_of(value: object) -> str | None:
        if isinstance(value, list):
            return next((y for y in map(image_of, value) if y), None)
        if isinstance(value, dict):
            return next((v for k in ("url", "contentUrl", "thumbnailUrl") if isinstance(v := value.get(k), str) and v), None)
        return value if isinstance(value, str) else None

    image = area = rooms = None
    for k in page.having("script"):
        if page.attrs[k].get("type", "").lower() != "application/ld+json":
            continue
        try:
            data = json.loads(decoded(page.text(k)).strip())
        except (ValueError, RecursionError):
            continue
        for node in walk(data):
            image = image or image_of(node.get("image") or node.get("photo") or node.get("primaryImageOfPage"))
            size = node.get("floorSize")
            size = size[0] if isinstance(size, list) and size else size
            size = size.get("value") if isinstance(size, dict) else size
            area = area or (number_tr(size) if isinstance(size, (int, float, str)) and not isinstance(size, bool) else None)
            n = node.get("numberOfRooms") or node.get("numberOfBedrooms")
            rooms = rooms or (str(int(n) if isinstance(n, float) and n.is_integer() else n) if isinstance(n, (int, float, str)) else None)
    return image, rounded(area) if area else None, rooms


PAGE_FACTS = pa.struct([("image_url", pa.string()), ("image_source", pa.string()), ("area", pa.float64()), ("room_text", pa.string())])


@F.arrow_udf(spark_type(PAGE_FACTS))
def read_facts(html: pa.Array, known: pa.Array) -> pa.Array:
    out: dict[str, list] = {x.name: [] for x in PAGE_FACTS}
    for source, snippet in zip(html.to_pylist(), known.to_pylist(), strict=True):
        page = Page(source or "")
        image, area, rooms = json_facts(page)
        metas = [page.attrs[k] for k in page.having("meta")]
        meta = meta_of(metas, META_IMAGES)
        text = " ".join(x for x in (snippet, meta_of(metas, META_TEXTS), decoded(page.visible()).strip()) if x)
        room = ROOMS.search(text)
        out["image_url"].append(meta or image)
        out["image_source"].append("og:image" if meta else "json-ld" if image else None)
        out["area"].append(area_of(text) or area)
        out["room_text"].append("".join(room[0].split()) if room else rooms)
    return pa.StructArray.from_arrays([pa.array(out[x.name], x.type) for x in PAGE_FACTS], [x.name for x in PAGE_FACTS])


def extract_page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, image_url, image_source, area, room_text) of listing pages (page_id, html[, title, snippet, description]).

    Images are those of meta tags, else of JSON-LD; area and rooms are those of texts (the columns, the page's description, its
    visible text), else of JSON-LD.
    """
    known = F.concat_ws(" ", *[F.nullif(F.trim(c(x)), F.lit("")) for x in ("title", "snippet", "description") if x in pages.columns])
    return pages.select("page_id", read_facts(c("html"), known).alias("facts")).select("page_id", "facts.*")


#: What makes a URL one of a photo, and what makes it none.
PHOTO, PHOTO_PATH = ("image", "photo", "listing", "resize", "cdn"), r"(?i)\.(jpe?g|png|webp)(?:[?#].*)?$"
NO_PHOTO = ("logo", "favicon", "sprite", "icon", "avatar", "agent", "profile", "placeholder", "loading", "blank", "captcha", "challenge")


#: Of so many names on a page, each is worked out once, however often it stands there.
FEW = 200


def extract_image_candidates(pages: DataFrame) -> DataFrame:
    """(listing_uid, url, ord, image_key, priority, rank): photos that pages (page_id, base_url, html) name, in attributes, source
    sets or anywhere as URLs, each key once, the likeliest ones first."""
    # where a word begins is asked behind its first letter, not at each place; a data-src has a src
    everywhere = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    first_of = lambda x: F.regexp_replace(F.trim(x), r"\s.*$", "")
    sets = F.flatten(F.transform(everywhere(r"(?i)s(?<=\b.)rcset=[\"']([^\"']+)[\"']"), lambda x: F.transform(F.split(x, ","), first_of)))
    attrs = everywhere(r"(?i)(?:s(?<=\b.)rc|d(?<=\b.)ata-(?:original|lazy)|c(?<=\b.)ontent)=[\"']([^\"']+\.(?:jpe?g|png|webp)(?:\?[^\"']*)?)[\"']")
    urls = everywhere(r"(?i)(https?:\\?/\\?/[^\"'()<>\s]+\.(?:jpe?g|png|webp)(?:\?[^\"'()<>\s\\]*)?)")
    origin, scheme, folder = F.regexp_extract("base_url", r"^(https?://[^/?#]+)", 1), F.regexp_extract("base_url", "^(https?:)", 1), F.regexp_replace("base_url", r"[^/]*$", "")

    # each step stands for itself: the filters on a URL would be filters on all that makes it
    named = T.held(pages.select(c("page_id").alias("listing_uid"), "base_url", "html"), "listing_uid", "base_url", names=F.concat(attrs, sets, urls))
    once = F.transform(F.array_distinct("names"), lambda x: F.struct((F.array_position("names", x) - 1).cast("int").alias("ord"), x.alias("raw")))
    each = F.transform("names", lambda x, k: F.struct(k.alias("ord"), x.alias("raw")))
    raw = named.select("listing_uid", "base_url", F.inline(F.when(F.size("names") <= FEW, once).otherwise(each)))
    rows = T.held(raw, "listing_uid", "ord", "base_url", clean=F.replace(F.replace(F.replace(c("raw"), F.lit("&amp;"), F.lit("&")), F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/")))
    rows = T.held(rows, "listing_uid", "ord", "base_url", cut=F.when(c("clean").contains(","), F.regexp_replace("clean", ",.*$", "")).otherwise(c("clean")))
    rows = T.held(rows, "listing_uid", "ord", "base_url", tidy=F.when(T.contains_any(c("cut"), " \t\n\x0b\f\r"), first_of(c("cut"))).otherwise(c("cut")))
    # patterns are tried where no plain comparison says it
    x = c("tidy")
    whole = x.startswith("https://") | x.startswith("http://") | x.rlike("(?i)^https?://")
    url = F.when(whole, x).when(x.startswith("//"), F.concat(scheme, x)).when(x.startswith("/"), F.concat(origin, x)).when(x.rlike("^[a-z]+:"), None).otherwise(F.concat(folder, x))
    rows = T.held(rows, "listing_uid", "ord", url=url).where("url <> ''")
    rows = T.held(rows, "listing_uid", "ord", "url", lower=F.lower("url"), path=without_query(c("url")))
    low = F.when(F.octet_length("url") == F.length("url"), c("lower")).otherwise(F.translate("url", ascii_uppercase, ascii_lowercase))
    rows = T.held(rows, "listing_uid", "ord", "url", "lower", "path", low=low)
    photo = c("path").endswith(".jpg") | c("path").endswith(".png") | c("path").endswith(".webp") | c("path").rlike(PHOTO_PATH)
    rows = rows.where((photo | T.contains_any(c("low"), PHOTO)) & ~T.contains_any(c("low"), NO_PHOTO))
    return best_images(rows.select("listing_uid", "url", "ord", key_of(c("path")).alias("image_key"), priority_of(c("lower")).alias("priority")))


#: Path parts of residential types, by words in the folded type.
PATH_TYPES = (("villa", "villa"), ("residence", "residence"), ("mustakil", "mustakil-ev"), ("dublex|dubleks", "dublex"), ("triplex|tripleks", "tripleks"))


def crawl_frontier(criteria: DataFrame, base: str = "https://www.hepsiemlak.com", sort: tuple[str, str] | None = None) -> DataFrame:
    """(subject_id, ord, url): candidate pages of a search, from the neighbourhood out to the city, each once, useful ones only.
    `sort`: field and direction that the pages are asked to be sorted by."""
    slug = lambda x: F.nullif(T.slugify_tr(c(x)), F.lit(""))
    deal = F.when(T.valuation_type(c("valuation_type")) == "rental", "kiralik").otherwise("satilik")
    home = T.first_match(T.normalize_text(c("property_type")), PATH_TYPES, "daire") if "property_type" in criteria.columns else F.lit("daire")
    kind = F.when(c("category") == "land", "arsa").when(c("category") == "commercial", "isyeri").otherwise(home)
    n, d, town = slug("neighborhood"), slug("district"), slug("city")
    paths = []
    for place in (n, F.concat(d, F.lit("-"), n), d, town):
        paths += [F.concat(F.lit("/"), place, F.lit("-"), deal, F.lit("/"), kind), F.concat(F.lit("/"), place, F.lit("-"), deal), F.concat(F.lit("/"), place, F.lit("/"), kind)]
    query = f"?sortField={sort[0]}&sortDirection={sort[1]}" if sort else ""
    rows = criteria.select("subject_id", F.posexplode(F.array_distinct(F.array_compact(F.array(*paths)))).alias("ord", "path")).withColumn("url", F.concat(F.lit(base), c("path"), F.lit(query)))
    useful = c("url").rlike("satilik|kiralik|/daire|/arsa|/isyeri|/villa|/residence") & ~c("url").rlike("/emlak-ofisi|/projeler|/emlak-yasam|/hakkimizda|/kullanim-kosullari|/gizlilik")
    return rows.where(useful).select("subject_id", "ord", "url")
