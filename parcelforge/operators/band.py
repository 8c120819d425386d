"""Price bands, market projection and regional statistics of each subject's comparables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import js_round

c = F.col


def quantile(col: Column | str, q: float) -> Column:
    """Linear interpolation at (n - 1) * q; exact."""
    return F.percentile(col, F.lit(q))


def price_band(df: DataFrame) -> DataFrame:
    """(subject_id, n, min/expected/max price and per m², confidence) of a subject's comparables; prices are null below 3.

    With an area and 3 unit prices the band comes from unit prices, held up by the prices themselves unless it is land.
    """
    agg = df.groupBy("subject_id").agg(
        F.first("subject_area").alias("area"), F.first("category").alias("category"), F.count(F.lit(1)).alias("n"), F.count("unit_price").alias("n_unit"), F.count("price").alias("n_price"),
        *[quantile(x, q).alias(f"{x}_{name}") for x in ("unit_price", "price") for name, q in (("q20", 0.2), ("q50", 0.5), ("q80", 0.8))],
    )
    by_unit, by_price = (c("area") > 0) & (c("n_unit") >= 3), c("n_price") >= 3
    rows = agg.withColumns({f"u_{k}": js_round(c(f"unit_price_{q}")) for k, q in (("min", "q20"), ("exp", "q50"), ("max", "q80"))})
    guard = (c("category") != "land") & by_price
    g = {"min": js_round(c("price_q20") * 0.92), "exp": js_round(c("price_q50") * 0.96), "max": js_round(c("price_q80"))}
    unit = {k: js_round(c(f"u_{k}") * c("area")) for k in g}
    held = {k: F.when(guard, F.greatest(unit[k], g[k])).otherwise(unit[k]) for k in g}
    low = held["min"]
    mid = F.greatest(held["exp"], low)
    plain = {"min": js_round(c("price_q20")), "exp": js_round(c("price_q50")), "max": js_round(c("price_q80"))}
    price = {"min": F.when(by_unit, low).when(by_price, plain["min"]), "exp": F.when(by_unit, mid).when(by_price, plain["exp"]), "max": F.when(by_unit, F.greatest(held["max"], mid)).when(by_price, plain["max"])}
    sqm = {k: F.when(by_unit, c(f"u_{k}")).when(by_price & (c("area") > 0), js_round(plain[k] / c("area"))) for k in g}
    confidence = F.when(by_unit, F.least(F.lit(0.66), 0.38 + c("n_unit") * 0.012)).when(by_price, F.least(F.lit(0.58), 0.34 + c("n_price") * 0.01))
    return rows.select(
        "subject_id", "n", price["min"].alias("min_price"), price["exp"].alias("expected_price"), price["max"].alias("max_price"),
        sqm["min"].alias("min_sqm"), sqm["exp"].alias("expected_sqm"), sqm["max"].alias("max_sqm"), F.round(confidence, 6).alias("confidence"),
    )


def market_projection(df: DataFrame, raw_counts: DataFrame | None = None) -> DataFrame:
    """(subject_id, average_days, active, waiting, competition); df: selected rows with days; raw_counts: (subject_id, raw), unless
    the rows carry their subject's raw."""
    raw = [] if raw_counts is not None else [F.first("raw").alias("raw")]
    agg = df.groupBy("subject_id").agg(F.avg("days").alias("d"), F.count(F.lit(1)).alias("selected"), F.count_if(c("days") >= 45).alias("long"), *raw)
    rows = (agg if raw_counts is None else agg.join(raw_counts, "subject_id", "left")).withColumn("active", F.coalesce(F.when(c("raw") > 0, c("raw")), c("selected")))
    level = F.when(c("active") >= 120, "Yüksek").when((c("active") >= 40) | (c("selected") >= 30), "Orta").otherwise("Düşük")
    return rows.select("subject_id", js_round(c("d")).alias("average_days"), "active", F.when(c("long") > 0, c("long")).alias("waiting"), level.alias("competition"))


def regional_stats(df: DataFrame) -> DataFrame:
    """(subject_id, min/median/max price, min/max unit price); subjects without prices have no row."""
    agg = df.groupBy("subject_id").agg(F.min("price").alias("min_price"), js_round(quantile("price", 0.5)).alias("median_price"), F.max("price").alias("max_price"), F.min("unit_price").alias("min_unit"), F.max("unit_price").alias("max_unit"))
    return agg.where(c("min_price").isNotNull())
