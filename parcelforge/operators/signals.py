"""How well each comparable fits its subject, and what that says about the subject's price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import text as T
from parcelforge.functions.listing import comparable_area, unit_price
from parcelforge.functions.text import js_round

c = F.col


def room_signal() -> Column:
    """Struct (score, label)."""
    i, t = T.parse_room(c("room_text")), T.parse_room(c("subject_room_text"))
    a, b = T.room_key(c("room_text")), T.room_key(c("subject_room_text"))
    rules = [((a == "") | (b == ""), 0, "unknown_room"), (a == b, 15, "exact_room"), (i["bedrooms"].isNull() | t["bedrooms"].isNull(), -8, "room_unclear"), (i["living"] != t["living"], -18, "different_room"), (F.abs(i["bedrooms"] - t["bedrooms"]) == 1, -5, "near_room")]
    return ruled(rules, -22, "different_room")


def ruled(rules: list[tuple[Column, int, str]], score: int, label: str) -> Column:
    """Struct (score, label) of the first rule that holds."""
    found = F.struct(F.lit(score).alias("score"), F.lit(label).alias("label"))
    for rule, n, name in reversed(rules):
        found = F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(n).alias("score"), F.lit(name).alias("label"))).otherwise(found)
    return found


def area_signal() -> Column:
    r = comparable_area() / F.when(c("subject_area") > 0, c("subject_area"))
    return ruled([(r.isNull(), 0, "unknown_area"), (r.between(0.85, 1.15), 15, "very_close_area"), (r.between(0.7, 1.35), 8, "close_area"), (r.between(0.55, 1.6), -4, "wide_area")], -18, "poor_area")


def age_signal() -> Column:
    item, target = c("building_age"), c("subject_building_age")
    diff = item - target
    return ruled(
        [
            (item.isNull() & (target >= 15), -8, "unknown_age_for_old_subject"), (item.isNull() | target.isNull(), 0, "unknown_age"), (F.abs(diff) <= 5, 13, "close_age"), (F.abs(diff) <= 10, 5, "acceptable_age"),
            ((target >= 20) & (item <= 8), -24, "much_newer_comparable"), ((target >= 15) & (item <= 5), -20, "new_building_premium"), (diff < -10, -12, "newer_comparable"),
        ], -8, "older_comparable",
    )


def is_top_floor(floor: Column, floors: Column, text: Column) -> Column:
    named = F.coalesce(F.lower(text).rlike("çatı|cati|teras|en üst|en ust|son kat"), F.lit(False))
    return named | F.coalesce((floors >= 3) & (floor >= floors - 1), F.lit(False))


def floor_signal() -> Column:
    """Struct (score, labels)."""
    none = F.lit(None).cast("string")
    high = F.coalesce(~c("has_elevator") & (c("floor_no") >= 3), F.lit(False))
    top, item_top = is_top_floor(c("floor_no"), c("building_floors"), none), is_top_floor(c("floor"), c("total_floors"), none)
    score = F.when(high, F.when(~item_top & (c("floor") <= 2), -9).otherwise(-5)).otherwise(0) + F.when(top & ~item_top, -6).otherwise(0)
    labels = F.array_compact(F.array(F.when(high, "subject_high_floor_no_elevator"), F.when(top, "subject_top_floor")))
    return F.struct(score.alias("score"), F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("floor_neutral"))).alias("labels"))


def amenity_signal() -> Column:
    """Struct (score, labels): what a listing's text promises that its subject lacks.  An unknown pool is none; unknown others don't count."""
    text = F.lower(F.concat_ws(" ", "title", "source_url"))
    said = {k: F.coalesce(text.rlike(p), F.lit(False)) for k, p in (("luxury", "lüks|lux|ultra|rezidans|residence|sıfır|sifir|yeni bina|kapalı havuz|havuz|güvenlik|guvenlik|otopark|site"), ("site", "site|rezidans|residence"), ("pool", "havuz"), ("security", "güvenlik|guvenlik"), ("parking", "otopark|garaj"))}
    lacks = {k: F.coalesce(~c(f"subject_{k}"), F.lit(False)) for k in ("site", "security", "parking")} | {"pool": ~F.coalesce(c("subject_pool"), F.lit(False))}
    better = {k: said[k] & lacks[k] for k in ("site", "pool", "security", "parking")}
    cost = {"site": 7, "pool": 5, "security": 4, "parking": 3}
    total = F.lit(0)
    for k, n in cost.items():
        total = total - F.when(better[k], n).otherwise(0)
    none = ~(better["site"] | better["pool"] | better["security"] | better["parking"])
    labels = F.array_compact(F.array(F.when(said["luxury"], "premium_listing_language"), *[F.when(better[k], f"better_{k}_than_subject") for k in cost]))
    return F.struct((total - F.when(said["luxury"] & none, 3).otherwise(0)).alias("score"), labels.alias("labels"))


def with_subject_defaults(df: DataFrame) -> DataFrame:
    """Adds what a listing or subject doesn't say, as null."""
    kinds = {"floor": "int", "total_floors": "int", "floor_no": "int", "building_floors": "int", "has_elevator": "boolean", "subject_site": "boolean", "subject_pool": "boolean", "subject_security": "boolean", "subject_parking": "boolean", "condition": "string", "floor_text": "string"}
    return df.withColumns({k: F.lit(None).cast(t) for k, t in kinds.items() if k not in df.columns})


def outlier_flags(df: DataFrame, k: float = 1.25) -> DataFrame:
    """Adds high_outlier, low_outlier: unit prices beyond k interquartile ranges of the subject's."""
    w = Window.partitionBy("subject_id")
    rows = df.withColumn("q_", F.percentile("unit_price", F.array(F.lit(0.25), F.lit(0.75))).over(w))
    iqr = c("q_")[1] - c("q_")[0]
    flag = lambda x: F.coalesce(x, F.lit(False))
    return rows.withColumns({"high_outlier": flag(c("unit_price") > c("q_")[1] + iqr * k), "low_outlier": flag(c("unit_price") < F.greatest(F.lit(1.0), c("q_")[0] - iqr * k))}).drop("q_")


def fit_signals(df: DataFrame) -> DataFrame:
    """Adds fit_score, role, weight, comparison, flags, notes to subjects joined with comparables."""
    rows = with_subject_defaults(df)
    rows = rows if "unit_price" in rows.columns else rows.withColumn("unit_price", unit_price())
    rows = outlier_flags(rows).withColumns({"room_": room_signal(), "area_": area_signal(), "age_": age_signal(), "floor_": floor_signal(), "amenity_": amenity_signal()})
    newer = c("age_.label").isin("much_newer_comparable", "new_building_premium")
    richer = F.exists("amenity_.labels", lambda x: x.startswith("better_"))
    score = 55 + sum((c(f"{x}_.score") for x in ("room", "area", "age", "floor", "amenity")), F.lit(0)) - F.when(c("high_outlier"), 18).otherwise(0) - F.when(c("low_outlier"), 10).otherwise(0)
    rows = rows.withColumn("fit_score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))
    role = F.when(c("high_outlier") | c("low_outlier"), "outlier_context").when(c("fit_score") >= 78, "primary").when(c("fit_score") >= 62, "supporting").otherwise("context_only")
    rows = rows.withColumn("role", role).withColumn("better", newer | richer)
    flags = F.array_compact(F.array(F.when(c("high_outlier"), "unit_price_outlier_high"), F.when(c("low_outlier"), "unit_price_outlier_low"), F.when(c("better"), "better_than_subject")))
    notes = F.concat(
        F.array(c("room_.label"), c("area_.label"), c("age_.label")), c("floor_.labels"), c("amenity_.labels"),
        F.array_compact(F.array(F.when(c("high_outlier"), "yüksek birim fiyat uç değer"), F.when(c("low_outlier"), "düşük birim fiyat uç değer"), F.when(newer, "konu taşınmazdan belirgin yeni"), F.when(richer, "donatı/segment olarak konu taşınmazdan iyi"))),
    )
    comparison = F.when(c("better"), "better_than_subject").when(c("fit_score") >= 78, "similar_to_subject").otherwise("weaker_or_uncertain_fit")
    weight = F.when(c("role") == "primary", 1.0).when(c("role") == "supporting", 0.45).otherwise(0.15)
    return rows.withColumns({"weight": weight, "comparison": comparison, "flags": flags, "notes": F.slice(F.array_distinct(notes), 1, 8)}).drop("room_", "area_", "age_", "floor_", "amenity_", "better")


def subject_penalty(df: DataFrame) -> DataFrame:
    """Adds penalty_pct and reasons: what age, height without a lift, the roof and disrepair take off; at most 38."""
    rows = with_subject_defaults(df)
    age = c("subject_building_age")
    steps = [(30, 24), (20, 17), (15, 11), (10, 6)]
    by_age, said = F.lit(0), F.lit(None).cast("string")
    for years, n in reversed(steps):
        by_age, said = F.when(age >= years, n).otherwise(by_age), F.when(age >= years, f"{years}+ yaş bina").otherwise(said)
    high = F.coalesce(~c("has_elevator") & (c("floor_no") >= 3), F.lit(False))
    top = is_top_floor(c("floor_no"), c("building_floors"), c("floor_text"))
    poor = F.coalesce(F.lower("condition").rlike("bakımsız|bakimsiz|tadilat|masraflı|masrafli|kötü|kotu"), F.lit(False))
    total = by_age + F.when(high, 9).otherwise(0) + F.when(top, 6).otherwise(0) + F.when(poor, 7).otherwise(0)
    reasons = F.array_compact(F.array(said, F.when(high, "asansörsüz yüksek kat"), F.when(top, "en üst/çatı kat etkisi"), F.when(poor, "tadilat/bakımsızlık riski")))
    return rows.withColumn("penalty_pct", F.least(total, F.lit(38))).withColumn("reasons", reasons)


def round_50k(x: Column) -> Column:
    return js_round(x / 50000) * 50000


def signal_guidance(scored: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per subject: counts of roles, discount, penalty, anchors and suggested prices.  scored: fit_signals(); subjects: subject_penalty()."""
    w = Window.partitionBy("subject_id")
    rows = scored.withColumn("n_core", F.sum(F.when(c("role").isin("primary", "supporting"), 1).otherwise(0)).over(w))
    anchor = F.when(c("n_core") >= 3, c("role").isin("primary", "supporting")).otherwise(c("role") != "outlier_context")
    rows = rows.withColumn("anchor", anchor).withColumn("anchor_unit", F.when(c("anchor"), c("unit_price")))
    agg = rows.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c("role") == r).alias(n) for r, n in (("primary", "n_primary"), ("supporting", "n_supporting"), ("context_only", "n_context"), ("outlier_context", "n_outlier"))],
        F.count_if(c("anchor")).alias("n_anchor"), F.count_if(c("anchor") & (c("comparison") == "better_than_subject")).alias("n_better"), F.percentile("anchor_unit", F.array(*map(F.lit, (0.1, 0.25, 0.5)))).alias("q"),
    )
    rows = agg.join(subjects.select("subject_id", "subject_area", "penalty_pct"), "subject_id")
    p, share = c("penalty_pct"), F.when(c("n_anchor") > 0, c("n_better") / c("n_anchor")).otherwise(F.lit(0.0))
    rows = rows.withColumn("share", share)
    effective = js_round(F.greatest(p * (0.2 + c("share") * 0.8), F.when(p >= 20, p * 0.75).otherwise(0.0)))
    discount = F.when((p == 0) & (c("share") < 0.2), 4).when(p < 10, 8).when((p < 20) & (c("share") < 0.2), 6).when(p >= 25, 14).when(p >= 15, 12).otherwise(10)
    discount = F.when((c("n_outlier") >= 3) & (c("n_primary") < 5), F.greatest(discount, F.lit(14))).otherwise(discount)
    rows = rows.withColumns({"effective_pct": effective, "discount_0": discount}).withColumn("discount_pct", F.when(c("share") >= 0.45, F.least(F.lit(18), c("discount_0") + 3)).otherwise(c("discount_0")))
    lower = ((p >= 20) | (c("n_outlier") >= 3) | ((c("n_primary") < 5) & (c("share") >= 0.2))) & c("q")[1].isNotNull()
    expected = F.when(lower, c("q")[1]).otherwise(c("q")[2])
    low = F.when((p >= 20) & c("q")[0].isNotNull(), c("q")[0]).otherwise(c("q")[1])
    price = lambda unit, off, cut: round_50k(unit * c("subject_area") * (1 - off / 100) * (1 - F.least(c("effective_pct"), F.lit(cut)) / 100))
    return rows.select(
        "subject_id", "n", "n_primary", "n_supporting", "n_context", "n_outlier", "discount_pct", "penalty_pct", "effective_pct", F.round("share", 4).alias("better_share"),
        F.when(c("n_primary") >= 5, "primary_comparables").otherwise("primary_plus_supporting_comparables").alias("basis"), js_round(c("q")[2]).alias("anchor_median"), js_round(c("q")[1]).alias("anchor_low"), js_round(c("q")[0]).alias("anchor_very_low"),
        js_round(expected).alias("anchor_expected"), price(low, F.least(c("discount_pct") + 3, F.lit(18)), 32.0).alias("suggested_low"), price(expected, c("discount_pct"), 30.0).alias("suggested_expected"),
    )
