"""Valuation policy: premiums, condition, cost floor and inflation band on a price, in this order, and fallback estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import TURKISH_FROM, TURKISH_TO, js_round, normalize_text

c = F.col

#: Defaults and bounds of the settings.
SETTINGS = {"construction_cost_per_sqm": (27000.0, 0.0, 500000.0), "contractor_share_pct": (50.0, 1.0, 100.0), "annual_inflation_pct": (30.0, 0.0, 150.0), "new_building_age_max": (5.0, 0.0, 15.0)}
#: What features add to a price; a closed pool or garage counts instead of an open one.
PREMIUMS = (
    ("is_site", 0.04), ("closed_pool", 0.05), ("open_pool", 0.04), ("sports", 0.04), ("security", 0.03), ("closed_parking", 0.03), ("open_parking", 0.01), ("has_generator", 0.02),
    ("has_hydrophore", 0.01), ("has_thermal_insulation", 0.02), ("has_water_tank", 0.01), ("has_ac", 0.02), ("has_fireplace", 0.02),
)
#: Years of a building and what its condition takes off a price; without a lift more, from floor 3 on more still.
AGE_CUTS = ((30, 0.5), (25, 0.42), (20, 0.35), (15, 0.28), (10, 0.2), (5, 0.1), (3, 0.04))
#: Prices per m² of places, by terms in the folded address; the first rule that has one counts.
LOCATION_HINTS = (
    (175000.0, "İstanbul üst segment merkez lokasyon", ("bebek", "etiler", "levent", "nisantasi", "tesvikiye", "ulus", "istinye")),
    (125000.0, "İstanbul yüksek talep bölgesi", ("sariyer", "besiktas", "kadikoy", "suadiye", "caddebostan", "fenerbahce", "moda", "bagdat")),
    (95000.0, "İstanbul güçlü merkez/çeper bölgesi", ("atasehir", "uskudar", "bakirkoy", "sisli", "maslak", "florya", "yesilkoy", "goztepe", "acibadem")),
    (73000.0, "İstanbul orta-üst segment bölgesi", ("maltepe", "kartal", "kucukyali", "bahcelievler", "basaksehir", "zeytinburnu", "beykoz")),
    (56000.0, "İstanbul gelişen konut bölgesi", ("pendik", "beylikduzu", "kucukcekmece", "avcilar", "umraniye", "sancaktepe", "cekmekoy", "tuzla")),
    (38000.0, "İstanbul erişilebilir konut bölgesi", ("esenyurt", "sultangazi", "sultanbeyli", "arnavutkoy")),
    (65000.0, "İstanbul geneli", ("istanbul",)),
    (90000.0, "Turizm/ikinci konut bölgesi", ("bodrum", "cesme", "fethiye", "datca")),
    (70000.0, "Muğla geneli", ("mugla",)),
    (52000.0, "İzmir geneli", ("izmir",)),
    (50000.0, "Antalya geneli", ("antalya", "alanya")),
    (38000.0, "Ankara geneli", ("ankara",)),
    (38000.0, "Marmara büyükşehir çeperi", ("bursa", "kocaeli", "sakarya")),
)
DEFAULT_HINT = (32000.0, "Türkiye geneli varsayılan konut lokasyonu")
#: Rents of a month as shares of a price.
RENT_RATES = (("min", 0.0037), ("expected", 0.0042), ("max", 0.0048))
#: Labels and times of the three prices, for sale and for rent.
STRATEGIES = {"SALE": (("Hızlı Satış", "1-3 ay"), ("Ortalama Satış", "3-6 ay"), ("Yüksek Beklenti", "6-12 ay")), "RENTAL": (("Hızlı Kiralama", "1-2 hafta"), ("Piyasa Kirası", "2-4 hafta"), ("Yüksek Kira Beklentisi", "1-2 ay"))}


def thousands(x: Column) -> Column:
    return js_round(x / 1000) * 1000


def normalize_settings(df: DataFrame) -> DataFrame:
    """Settings within their bounds; missing ones have their defaults."""
    cols = {k: F.least(F.greatest(F.coalesce(c(k).cast("double"), F.lit(d)), F.lit(lo)), F.lit(hi)) for k, (d, lo, hi) in SETTINGS.items()}
    cols["new_building_age_max"] = js_round(cols["new_building_age_max"])
    return df.withColumns(cols).withColumn("cost_floor_enabled", F.coalesce("cost_floor_enabled", F.lit(True)))


def flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(c(name), F.lit(False)) if name in df.columns else F.lit(False)


def premium_pct(df: DataFrame) -> Column:
    on = {k: flag(df, k) for k, _ in PREMIUMS}
    on["sports"] = flag(df, "has_fitness_center") | flag(df, "has_sports_area") | flag(df, "sports")
    on["open_pool"], on["open_parking"] = on["open_pool"] & ~on["closed_pool"], on["open_parking"] & ~on["closed_parking"]
    total = F.lit(0.0)
    for k, n in PREMIUMS:
        total = total + F.when(on[k], n).otherwise(0.0)
    return F.when(c("category") == "residential", F.least(total, F.lit(0.24))).otherwise(0.0)


def condition_pct() -> Column:
    by_age = F.lit(0.0)
    for years, n in reversed(AGE_CUTS):
        by_age = F.when(c("subject_building_age") >= years, n).otherwise(by_age)
    # fixed values: surcharges of a building without lift, what a lift makes up for, the bound of all
    no_lift = by_age + 0.06 + F.when(c("floor_no") >= 3, 0.07).otherwise(0.0)
    lift = F.when(c("subject_building_age") >= 10, F.greatest(by_age - 0.03, F.lit(0.0))).otherwise(by_age)
    total = F.when(~c("has_elevator"), no_lift).when(c("has_elevator"), lift).otherwise(by_age)
    return F.when(c("category") == "residential", F.least(total, F.lit(0.58))).otherwise(0.0)


def apply_valuation_policy(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Adds policy_min, policy_expected, policy_max, their per m², rents and strategy labels to rows with min_price,
    expected_price, max_price (or *_sqm), subject_area and the building's fields.  settings: one row."""
    one = normalize_settings(settings).limit(1)  # the single row of settings
    rows = df.crossJoin(F.broadcast(one.select(*[c(k).alias(f"set_{k}") for k in (*SETTINGS, "cost_floor_enabled")])))
    rental, area = c("valuation_type") == "rental", c("subject_area")
    from_sqm = lambda k: F.when(area > 0, c(f"{k}_sqm") * area)
    rows = rows.withColumn("lo", thousands(F.coalesce("min_price", from_sqm("min"))))
    rows = rows.withColumn("mid", thousands(F.coalesce("expected_price", from_sqm("expected"), c("lo") * F.when(rental, 1.1).otherwise(1.15))))
    rows = rows.withColumn("hi", thousands(F.coalesce("max_price", from_sqm("max"), c("lo") * F.when(rental, 1.22).otherwise(1.3))))
    rows = rows.withColumn("mid", F.greatest("mid", "lo")).withColumn("hi", F.greatest("hi", "mid"))
    rows = rows.withColumns({"premium_pct": premium_pct(rows), "condition_pct": condition_pct()})
    for k in ("lo", "mid", "hi"):
        rows = rows.withColumn(k, thousands(c(k) * (1 + c("premium_pct"))))
    for k in ("lo", "mid", "hi"):
        rows = rows.withColumn(k, thousands(c(k) * (1 - c("condition_pct"))))
    gross = c("gross_area") if "gross_area" in df.columns else F.lit(None).cast("double")
    cost_area = F.coalesce(F.when(gross > 0, gross), F.when(area > 0, area))
    floor = thousands(c("set_construction_cost_per_sqm") / (c("set_contractor_share_pct") / 100) * cost_area)
    applies = ~rental & c("set_cost_floor_enabled") & (c("category") == "residential") & (c("subject_building_age") <= c("set_new_building_age_max"))
    rows = rows.withColumn("cost_floor", F.when(applies, floor))
    rows = rows.withColumn("lo", F.greatest("lo", "cost_floor")).withColumn("mid", F.greatest("mid", "lo")).withColumn("hi", F.greatest("hi", "mid"))
    rate = F.least(c("set_annual_inflation_pct") / 100, F.lit(1.5))
    half = F.when(rate == 0, F.lit(0.0)).otherwise(rate / 2)
    top = F.floor(c("lo") * (1 + rate) / 1000) * 1000.0
    rows = rows.withColumns({"mid": F.when(rental, c("mid")).otherwise(F.greatest(c("lo"), F.least(thousands(c("lo") * (1 + half)), top))), "hi": F.when(rental, c("hi")).otherwise(F.greatest(c("lo"), top))})
    sqm = {f"policy_{n}_sqm": F.when(area > 0, js_round(c(k) / area)) for k, n in (("lo", "min"), ("mid", "expected"), ("hi", "max"))}
    rents = {f"rent_{n}": F.when(~rental & (c("mid") > 0), thousands(c("mid") * r)) for n, r in RENT_RATES}
    labels = {f"{n}_label": F.when(rental, STRATEGIES["RENTAL"][i][0]).otherwise(STRATEGIES["SALE"][i][0]) for i, n in enumerate(("low", "mid", "high"))}
    rows = rows.withColumns({"policy_min": c("lo"), "policy_expected": c("mid"), "policy_max": c("hi")} | sqm | rents | labels)
    return rows.drop("lo", "mid", "hi", *[x for x in rows.columns if x.startswith("set_")])


def location_hint(df: DataFrame, rules: tuple = LOCATION_HINTS, default: tuple[float, str] = DEFAULT_HINT) -> DataFrame:
    """Adds base and base_label: those of the first rule (price, label, terms) with a term in the folded address, city,
    district, neighbourhood and title, else the default.

    The few dozen terms are conditions in order: no join, no numbering of rows, no shuffle.
    """
    places = [c(x) for x in ("address", "city", "district", "neighborhood", "title") if x in df.columns]
    said = lambda price, label: F.struct(F.lit(price).alias("price"), F.lit(label).alias("label"))
    hint = said(*default)
    for price, label, terms in reversed(rules):
        hint = F.when(c("folded_").rlike("|".join(terms)), said(price, label)).otherwise(hint)
    rows = df.withColumn("folded_", normalize_text(F.concat_ws(" ", *places))).withColumn("hint_", hint)
    return rows.withColumns({"base": c("hint_.price"), "base_label": c("hint_.label")}).drop("folded_", "hint_")


def banded(x: Column, bands: list[tuple[Column, float]]) -> Column:
    """Factor of the first band that holds; 1 if x is unknown or in none."""
    found = F.lit(1.0)
    for rule, n in reversed(bands):
        found = F.when(F.coalesce(rule, F.lit(False)), n).otherwise(found)
    return F.when(x.isNotNull(), found).otherwise(1.0)


#: What types, ages, floors, sizes, views and conditions multiply a price per m² with, and its bounds and range.
KINDS = (("villa", 1.25), ("rezidans", 1.12), ("mustakil", 1.1))
YOUNG, OLD = ((1, 1.12), (5, 1.08), (10, 1.03)), ((31, 0.84), (21, 0.9), (11, 0.95))
LOW_FLOOR, TOP_FLOOR, HIGH_FROM, HIGH_FLOOR = 0.93, 0.97, 3, 1.02
SMALL, LARGE = (75, 1.04), (220, 0.94)
PARKING = (("closed_parking", 1.05), ("open_parking", 1.02))
VIEWS = (("deniz|bogaz", 1.14), ("gol", 1.08), ("doga|bahce", 1.04))
CONDITIONS = (("yeni|sifir", 1.06), ("eski|tadilat", 0.94))
LEAST_SQM, MOST_SQM, AROUND = 18000.0, 250000.0, (0.84, 1.16)
#: What a building's features multiply a price per m² with.
FEATURES = (("is_site", 1.06), ("has_elevator", 1.04), ("security", 1.04), ("pool", 1.05), ("has_generator", 1.02), ("has_hydrophore", 1.01), ("has_water_tank", 1.01), ("sports", 1.02), ("has_thermal_insulation", 1.02), ("has_ac", 1.02))


def fallback_estimate(df: DataFrame) -> DataFrame:
    """Adds est_sqm with est_min_sqm and est_max_sqm 16 % around, and the prices they make, where the area is known.

    From `base` (location_hint) and factors for type, age, floor, size, features, view and condition; 18 000 to 250 000.
    """
    age, floor, floors, area = c("subject_building_age"), c("floor_no"), c("building_floors"), c("subject_area")
    text = lambda k: normalize_text(c(k)) if k in df.columns else F.lit("")
    kind, view, condition = text("property_type"), text("view_tags"), text("condition")
    factor = F.lit(1.0)
    for word, n in KINDS:
        factor = factor * banded(kind, [(kind.contains(word), n)])
    factor = factor * banded(age, [*[(age <= years, n) for years, n in YOUNG], *[(age >= years, n) for years, n in OLD]])
    factor = factor * banded(floor, [(floor <= 0, LOW_FLOOR), (floor == floors, TOP_FLOOR), (floor >= HIGH_FROM, HIGH_FLOOR)]) * banded(area, [(area < SMALL[0], SMALL[1]), (area > LARGE[0], LARGE[1])])
    for k, n in FEATURES:
        factor = factor * F.when(flag(df, k), n).otherwise(1.0)
    factor = factor * F.when(flag(df, PARKING[0][0]), PARKING[0][1]).when(flag(df, PARKING[1][0]), PARKING[1][1]).otherwise(1.0)
    factor = factor * banded(view, [(view.rlike(words), n) for words, n in VIEWS])
    for words, n in CONDITIONS:
        factor = factor * F.when(condition.rlike(words), n).otherwise(1.0)
    rows = df.withColumn("est_sqm", F.when(area > 0, js_round(F.least(F.greatest(c("base") * factor, F.lit(LEAST_SQM)), F.lit(MOST_SQM)))))
    rows = rows.withColumns({"est_min_sqm": js_round(c("est_sqm") * AROUND[0]), "est_max_sqm": js_round(c("est_sqm") * AROUND[1])})
    return rows.withColumns({"est_min": thousands(c("est_min_sqm") * area), "est_expected": thousands(c("est_sqm") * area), "est_max": thousands(c("est_max_sqm") * area)})


#: What is said of an estimate, and the confidence that it doesn't exceed.
ESTIMATE_RATIONALE = "Bu çalışma kullanıcı emsali olmadan, konum ve taşınmaz özelliklerine göre düşük güvenli ön tahmindir."
ESTIMATE_ASSUMPTION = ("Manuel emsal girilmediği için fiyat aralığı ", " için düşük güvenli ön tahmin olarak hesaplanmıştır.")
ESTIMATE_MISSING, ESTIMATE_CONFIDENCE = "Manuel emsal verisi", 0.35
#: Default sections of a report without them.
PROJECTION_SUMMARY = (" ve taşınmaz özelliklerine göre pazar projeksiyonu niteliksel olarak hazırlanmıştır. ", " büyüklüğü, ", " tipi ve kullanıcı tarafından girilen emsal sayısı dikkate alınmıştır; kesin piyasa istatistiği olarak yorumlanmamalıdır.")
PROJECTION_NOTE = " için pazar yorumu konum, taşınmaz özellikleri ve kullanıcı girdileri üzerinden niteliksel olarak hazırlanmıştır."
REGION_DEMAND = " çevresinde konut talebi; ulaşım, günlük ihtiyaç erişimi ve mahalle dokusu gibi faktörlerle birlikte değerlendirilmelidir."
REGION_SALE = ("Satılık konut yorumu kullanıcı tarafından girilen ", " emsal üzerinden desteklenmiştir.")
REGION_SALE_NONE = "Satılık konut yorumu manuel emsal olmadan, konum ve taşınmaz özelliklerine göre ön değerlendirme niteliğindedir."
REGION_RENT = "Kiralık piyasa yorumu için kira emsalleri girilmediğinden net kira çarpanı hesaplanmamıştır; amortisman resmi veri yerine ihtiyatlı yorumlanmalıdır."
REGION_PLACES = "Yakın çevre yorumu adres bilgisinden hareketle hazırlanmıştır; okul, ulaşım, sağlık ve ticari aks görselleri kullanıcı tarafından eklenirse rapor daha güçlü olur."
REGION_RISKS = "Bölgesel riskler için deprem, imar, zemin ve resmi kurum kayıtları ayrıca kontrol edilmelidir."
ANSWER_PRICES = {"min_price": "est_min", "avg_price": "est_expected", "max_price": "est_max", "min_sqm": "est_min_sqm", "avg_sqm": "est_sqm", "max_sqm": "est_max_sqm"}


def with_item(items: Column, text: Column) -> Column:
    """The list, with the text in front unless one of its items holds it, whatever its case and Turkish letters."""
    plain = lambda x: F.lower(F.translate(x, TURKISH_FROM, TURKISH_TO))
    held = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.exists(held, lambda x: plain(x).contains(plain(text))), held).otherwise(F.concat(F.array(text), held))


def apply_fallback(answers: DataFrame) -> DataFrame:
    """Answers (normalize_price_index()) with what they lack taken from the estimate (fallback_estimate()); adds `estimated`.

    If one of the six prices is missing and there is an estimate, the missing ones are its, the answer says so in its
    rationale, assumptions and missing data, and its confidence is held down.  Given prices stay.
    """
    lacking = ~reduce(lambda a, b: a & b, [c(k).isNotNull() for k in ANSWER_PRICES]) & c("est_sqm").isNotNull()
    rows = answers.withColumn("estimated", lacking)
    on = c("estimated")
    said = F.concat(F.lit(ESTIMATE_ASSUMPTION[0]), c("base_label"), F.lit(ESTIMATE_ASSUMPTION[1]))
    filled = {k: F.when(on, F.coalesce(k, est)).otherwise(c(k)) for k, est in ANSWER_PRICES.items()}
    return rows.withColumns(filled | {
        "rationale": F.when(on, F.coalesce(F.nullif("rationale", F.lit("")), F.lit(ESTIMATE_RATIONALE))).otherwise(c("rationale")),
        "assumptions": F.when(on, with_item(c("assumptions"), said)).otherwise(c("assumptions")), "missing_data": F.when(on, with_item(c("missing_data"), F.lit(ESTIMATE_MISSING))).otherwise(c("missing_data")),
        "confidence": F.when(on, F.least(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(ESTIMATE_CONFIDENCE)), F.lit(ESTIMATE_CONFIDENCE))).otherwise(c("confidence")),
    })


def with_projections(answers: DataFrame) -> DataFrame:
    """Answers with a market projection and regional statistics: their own, else defaults by place, type, area and n_comparables."""
    n = F.coalesce(c("n_comparables"), F.lit(0)) if "n_comparables" in answers.columns else F.lit(0)
    kind = F.coalesce(F.nullif("property_type", F.lit("")), F.lit("konut")) if "property_type" in answers.columns else F.lit("konut")
    area = c("subject_area")
    size = F.when(area != 0, F.concat(F.when(area == F.floor(area), area.cast("long").cast("string")).otherwise(area.cast("string")), F.lit(" m²"))).otherwise("Alan")
    summary = F.concat(c("base_label"), F.lit(PROJECTION_SUMMARY[0]), F.coalesce(size, F.lit("Alan")), F.lit(PROJECTION_SUMMARY[1]), kind, F.lit(PROJECTION_SUMMARY[2]))
    none = F.lit(None).cast("double")
    market = {
        "averageMarketingDays": F.coalesce(c("expected_sale_days"), F.when(n >= 3, 75.0).otherwise(95.0)), "competitionStatus": F.when(n >= 4, "Yoğun rekabet").when(n >= 2, "Orta rekabet").otherwise("Emsal verisi sınırlı"),
        "activeComparableCount": F.when(n > 0, n.cast("double")), "waitingComparableCount": none, "annualChangePct": none, "totalReturnPct": none, "amortizationYears": none, "summary": summary,
    }
    region = {
        "demographicsSummary": F.concat(c("base_label"), F.lit(REGION_DEMAND)), "saleMarketSummary": F.when(n > 0, F.concat(F.lit(REGION_SALE[0]), n.cast("string"), F.lit(REGION_SALE[1]))).otherwise(REGION_SALE_NONE),
        "rentalMarketSummary": F.lit(REGION_RENT), "nearbyPlacesSummary": F.lit(REGION_PLACES), "riskSummary": F.lit(REGION_RISKS),
    }
    own = c("market_projection").withField("summary", F.coalesce("market_projection.summary", F.concat(c("base_label"), F.lit(PROJECTION_NOTE))))
    built = lambda fields, names: F.struct(*[fields[k].alias(k) for k, _ in names])
    return answers.withColumns({
        "market_projection": F.when(c("market_projection").isNotNull(), own).otherwise(built(market, MARKET_FIELDS)),
        "regional_stats": F.when(c("regional_stats").isNotNull(), c("regional_stats")).otherwise(built(region, REGION_FIELDS)),
    })


def json_in_text(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def said_number(number: Column, text: Column) -> Column:
    """A number of JSON: as it is, or, where it is a text, without thousands dots and with a decimal comma; a text without
    digits is 0, as it says something that is no number.  Null for lists and objects."""
    digits = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), r"^([^,]*),", "$1."), r"[^0-9.]", "")
    said = F.when((F.trim(text) == "") | text.rlike(r"^\s*[\[{]"), None).when(digits == "", 0.0).otherwise(digits.try_cast("double"))
    return F.coalesce(number, said)


def said_text(text: Column, most: int) -> Column:
    return F.nullif(F.substring(F.trim(text), 1, most), F.lit(""))


def share(x: Column) -> Column:
    """Numbers over 1 up to 100 are percent; within 0 and 1."""
    return bounded(F.when((x > 1) & (x <= 100), x / 100).otherwise(x), 0.0, 1.0)


def bounded(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


#: Fields of an answer and how long their texts may be; without a number, the field is a number.
COMP_FIELDS = (("title", 90), ("source", 90), ("sourceUrl", 220), ("price", None), ("netArea", None), ("grossArea", None), ("floor", None), ("totalFloors", None), ("buildingAge", None), ("distanceKm", None), ("distanceMeters", None), ("roomText", 20))
MARKET_FIELDS = (("averageMarketingDays", None), ("competitionStatus", 80), ("activeComparableCount", None), ("waitingComparableCount", None), ("annualChangePct", None), ("totalReturnPct", None), ("amortizationYears", None), ("summary", 1000))
REGION_FIELDS = (("demographicsSummary", 900), ("saleMarketSummary", 900), ("rentalMarketSummary", 900), ("nearbyPlacesSummary", 900), ("riskSummary", 900))
MOST_COMPS, MOST_NOTES = 12, 20


#: Numbers of an answer, and the fields of its lists and sections.
ANSWER_NUMBERS = ("minPrice", "avgPrice", "maxPrice", "minPricePerSqm", "avgPricePerSqm", "maxPricePerSqm", "expectedSaleDays", "discountToSellFastPct", "priceSensitivity", "confidence")
SECTIONS = {"marketProjection": MARKET_FIELDS, "regionalStats": REGION_FIELDS}


def fields_as(fields: tuple, kind: str) -> str:
    return ", ".join(f"{k} {kind}" for k, n in fields if kind == "string" or n is None)


def answer_schemas() -> tuple[str, str]:
    """Two readings of an answer: as texts, and of its numbers as numbers, which are null where texts stand.  Comparables stay
    JSON, each for itself, so that an odd one spoils no other."""
    texts = [f"{k} string" for k in (*ANSWER_NUMBERS, "rationale")] + [f"{k} array<string>" for k in ("assumptions", "missingData", "comps")]
    numbers = [f"{k} double" for k in ANSWER_NUMBERS]
    for name, fields in SECTIONS.items():
        texts.append(f"{name} struct<{fields_as(fields, 'string')}>")
        if fields_as(fields, "double"):
            numbers.append(f"{name} struct<{fields_as(fields, 'double')}>")
    return ", ".join(texts), ", ".join(numbers)


def section(text: Column, number: Column | None, fields: tuple) -> Column:
    return F.struct(*[(said_number(number[k], text[k]) if n is None else said_text(text[k], n)).alias(k) for k, n in fields])


def said_notes(items: Column) -> Column:
    """Texts of a list, without empty ones."""
    texts = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.slice(F.filter(texts, lambda x: x != ""), 1, MOST_NOTES)


def normalize_price_index(df: DataFrame, text_col: str, area_col: str) -> DataFrame:
    """Adds what JSON within a text says: min, avg, max price and per m², gaps filled from each other and the area, order
    repaired, rounded; sale days, discount, shares within 0 and 1; comparables, notes and summaries of bounded length.

    The JSON is read twice, to declared schemas: as texts and as numbers, which tells 1.5 from "1.5".
    """
    area = F.when(c(area_col) > 0, c(area_col))
    said, numbers = answer_schemas()
    num = lambda k: said_number(c(f"numbers_.{k}"), c(f"said_.{k}"))
    json = json_in_text(c(text_col))
    rows = df.withColumns({"said_": F.from_json(json, said), "numbers_": F.from_json(json, numbers)})
    read = F.transform(F.coalesce(F.slice("said_.comps", 1, MOST_COMPS), F.array().cast("array<string>")), lambda x: F.struct(F.from_json(x, fields_as(COMP_FIELDS, "string")).alias("said"), F.from_json(x, fields_as(COMP_FIELDS, "double")).alias("numbers")))
    rows = rows.withColumns({f"{k}_p": num(f"{k}Price") for k in ("min", "avg", "max")} | {f"{k}_s": num(f"{k}PricePerSqm") for k in ("min", "avg", "max")})
    for k in ("min", "avg", "max"):
        rows = rows.withColumn(f"{k}_p", F.coalesce(f"{k}_p", c(f"{k}_s") * area))
    known = area.isNotNull()
    rows = rows.withColumns({"min_p": F.coalesce("min_p", F.when(known, c("avg_p") * 0.88)), "max_p": F.coalesce("max_p", F.when(known, c("avg_p") * 1.12))})
    rows = rows.withColumn("avg_p", F.coalesce("avg_p", F.when(known, (c("min_p") + c("max_p")) / 2)))
    for k in ("min", "avg", "max"):
        rows = rows.withColumn(f"{k}_s", F.coalesce(f"{k}_s", c(f"{k}_p") / area))
    for s, rounded in (("p", thousands), ("s", js_round)):
        lo, mid, hi = c(f"min_{s}"), c(f"avg_{s}"), c(f"max_{s}")
        lo, hi = F.when(lo > mid, mid).otherwise(lo), F.when(hi < mid, mid).otherwise(hi)
        rows = rows.withColumns({f"min_{s}": rounded(F.when(lo > hi, hi).otherwise(lo)), f"avg_{s}": rounded(mid), f"max_{s}": rounded(F.when(lo > hi, lo).otherwise(hi))})
    rows = rows.withColumns({
        "expected_sale_days": bounded(num("expectedSaleDays"), 7.0, 365.0), "discount_to_sell_fast_pct": bounded(num("discountToSellFastPct"), 0.0, 25.0), "price_sensitivity": share(num("priceSensitivity")), "confidence": share(num("confidence")),
        "comps": F.transform(read, lambda x: section(x["said"], x["numbers"], COMP_FIELDS)),
        "rationale": said_text(c("said_.rationale"), 1200), "assumptions": said_notes(c("said_.assumptions")), "missing_data": said_notes(c("said_.missingData")),
        "market_projection": section(c("said_.marketProjection"), c("numbers_.marketProjection"), MARKET_FIELDS), "regional_stats": section(c("said_.regionalStats"), None, REGION_FIELDS),
    })
    filled = lambda x, fields: F.when(F.coalesce(*[c(f"{x}.{k}").cast("string") for k, _ in fields]).isNotNull(), c(x))
    rows = rows.withColumns({"market_projection": filled("market_projection", MARKET_FIELDS), "regional_stats": filled("regional_stats", REGION_FIELDS)})
    names = {"min_p": "min_price", "avg_p": "avg_price", "max_p": "max_price", "min_s": "min_sqm", "avg_s": "avg_sqm", "max_s": "max_sqm"}
    return rows.drop("said_", "numbers_").withColumnsRenamed(names)


def answer_note(rationale: Column, assumptions: Column, missing: Column) -> Column:
    """The texts of an answer as one note; empty lists are left out."""
    listed = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(f"\n{head}:\n- "), F.array_join(x, "\n- ")))
    return F.concat_ws("\n", F.nullif(rationale, F.lit("")), listed("Varsayımlar", assumptions), listed("Eksik Veri", missing))
