"""Queries of the valuation flow: pool, selection, bands, signals, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import listing as L
from parcelforge.functions import text as T
from parcelforge.operators import band, policy, pool, quantiles, selection, signals
from parcelforge.plans.fixtures import fixture, stored, work_folder
from parcelforge.plans.registry import registered

c = F.col
AS_OF = "2001-12-01 00:00:00"
#: For freshness a date at which listings of all states are there.
FRESH_AS_OF = "2001-10-15 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_listing")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_subject")


def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with their scope keys and their quality for the pool."""
    return pool.with_scope_keys(with_quality(listings(spark, sf_dir), "pool_quality"))


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pool (provider 0) has for each subject."""
    return pool.looked_up(pool.scope_keys(subjects(spark, sf_dir)), pool_rows(spark, sf_dir).where("provider_rank = 0"), as_of())


def fetched(spark: SparkSession, sf_dir: str, most: int | None = pool.SCOPE_ROWS) -> DataFrame:
    """What the feeds (the other providers) give for each subject's scope: the `most` best rows of each (None: all of them)."""
    best = [F.desc("pool_quality"), F.desc("last_seen_at"), c("listing_uid")]
    rows = pool_rows(spark, sf_dir).where("provider_rank > 0")
    rows = pool.cap_scope(rows, most, best, ["provider_rank"]) if most else rows
    return pool.match_pool(pool.scope_keys(subjects(spark, sf_dir)), rows)


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scope has to offer, from one pass over the listings."""
    return pool.offered(with_quality(listings(spark, sf_dir), "pool_quality"), as_of(), told=lambda rows: selection.with_facts(rows, selection.LISTING_FACTS))


def looking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_facts(pool.scope_keys(subjects(spark, sf_dir)), selection.SUBJECT_FACTS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparables of every subject, the pool's and the feeds', dealt out by subject."""
    return pool.comparables(looking(spark, sf_dir), offered(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.prepared(pairs(spark, sf_dir), dealt=True)


CACHE_SCORE = "(CASE WHEN image_url IS NOT NULL THEN 30 ELSE 0 END + 18 + 18 + CASE WHEN coalesce(room_text, '') <> '' THEN 10 ELSE 0 END + 10 + CASE WHEN coalesce(net_area, gross_area) > 10 THEN 10 ELSE 0 END + 4)"
ROOM_FITS = "(category <> 'residential' OR subject_room_text IS NULL OR coalesce(room_text, '') = subject_room_text)"
# SQL building blocks: each common table expression builds on those before it.
PAIRS = f"""
ranked AS (
  SELECT *, {CACHE_SCORE} AS pool_quality FROM fx_listing
  WHERE provider_rank > 0 OR (price IS NOT NULL AND image_url IS NOT NULL AND last_seen_at > DATE '2001-11-17')
), capped AS (
  SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY city, district, neighborhood, category, valuation_type, CASE WHEN provider_rank > 0 THEN provider_rank ELSE 0 END ORDER BY pool_quality DESC, last_seen_at DESC, listing_uid) <= 240
), pool AS (
  SELECT * FROM capped WHERE provider_rank > 0 UNION ALL
  SELECT * FROM (SELECT * FROM capped WHERE provider_rank = 0 QUALIFY row_number() OVER (PARTITION BY city, district, neighborhood, category, valuation_type, source_url ORDER BY pool_quality DESC, last_seen_at DESC, listing_uid) = 1)
), pairs AS (
  SELECT s.subject_id, s.subject_area, s.subject_room_text, s.subject_building_age, s.subject_type, s.floor_no, s.building_floors, s.has_elevator, l.*,
    coalesce(nullif(l.net_area, 0), nullif(l.gross_area, 0)) AS area
  FROM fx_subject s JOIN pool l ON s.city = l.city AND s.district = l.district AND s.neighborhood = l.neighborhood AND s.category = l.category AND s.valuation_type = l.valuation_type
), fit AS (
  SELECT *, area / subject_area AS ratio FROM pairs
  WHERE area > 10 AND area / subject_area BETWEEN CASE category WHEN 'land' THEN 0.35 WHEN 'commercial' THEN 0.5 ELSE 0.65 END AND CASE category WHEN 'land' THEN 3.0 WHEN 'commercial' THEN 2.0 ELSE 1.5 END
    AND (provider_rank > 0 OR ({ROOM_FITS} AND (subject_type IS NULL OR coalesce(lower(property_type) = lower(subject_type), false))))
), cut AS (
  SELECT * FROM fit QUALIFY provider_rank > 0 OR row_number() OVER (PARTITION BY subject_id, provider_rank ORDER BY pool_quality DESC, last_seen_at DESC, listing_uid) <= 60
), uniq AS (
  SELECT *, CASE WHEN price <> 0 AND area > 0 THEN floor(price / area + 0.5) END AS unit_price FROM cut
  QUALIFY row_number() OVER (PARTITION BY subject_id, source_url ORDER BY provider_rank, created_at, listing_uid) = 1
)"""


def sql_relax(name: str, source: str, keep: str, applies: str = "true", min_n: int = 3, where: str = "true") -> str:
    return f"""{name} AS (
  SELECT * FROM {source} WHERE {where}
  QUALIFY coalesce({keep}, false) OR NOT coalesce({applies}, false) OR sum(coalesce({keep}, false)::INT) OVER (PARTITION BY subject_id) < {min_n}
)"""


def sql_fence(name: str, source: str, value: str, min_keep: int, where: str) -> str:
    inside = f"({value} IS NULL OR {value} BETWEEN greatest(1.0, q1 - (q3 - q1) * 1.5) AND q3 + (q3 - q1) * 1.5)"
    return f"""{name}_q AS (
  SELECT *, quantile_cont({value}, 0.25) OVER w AS q1, quantile_cont({value}, 0.75) OVER w AS q3, count({value}) OVER w AS nv FROM {source} WHERE {where} WINDOW w AS (PARTITION BY subject_id)
), {name}_k AS (
  SELECT * FROM {name}_q QUALIFY {inside} OR nv < 8 OR sum({inside}::INT) OVER (PARTITION BY subject_id) < {min_keep}
), {name} AS (SELECT * EXCLUDE (q1, q3, nv) FROM {name}_k)"""


EXACT, NOT_TEST = "(room_text = subject_room_text)", "NOT regexp_matches(lower(title), 'test|dikkate almay[iı]n') AND price > 0"
ROOMS = "split_part({0}, '+', 1)::INT"
COMPATIBLE = (
    "CASE WHEN room_text = subject_room_text THEN true WHEN room_text IS NULL THEN {unknown} WHEN subject_room_text IS NULL THEN {unknown} ELSE NOT (" + ROOMS.format("subject_room_text") + " >= 2 AND " + ROOMS.format("room_text") + " <= 1)"
    " AND abs(" + ROOMS.format("room_text") + " - " + ROOMS.format("subject_room_text") + ") <= 1 AND split_part(room_text, '+', 2) = split_part(subject_room_text, '+', 2) END"
)
STRICT = ",\n".join([
    sql_relax("s1", "uniq", EXACT, "category = 'residential' AND subject_room_text IS NOT NULL", where="price > 0"),
    sql_relax("s2", "s1", "ratio BETWEEN CASE category WHEN 'land' THEN 0.45 WHEN 'commercial' THEN 0.65 ELSE 0.7 END AND CASE category WHEN 'land' THEN 2.25 WHEN 'commercial' THEN 1.65 ELSE 1.35 END"),
    sql_relax("strict", "s2", "CASE WHEN subject_building_age <= 5 THEN building_age <= 8 WHEN subject_building_age >= 20 THEN building_age >= 10 ELSE abs(building_age - subject_building_age) <= 10 END", "category = 'residential' AND subject_building_age >= 0"),
])
VALUATION = STRICT + ",\n" + ",\n".join([
    sql_fence("t", "strict", "unit_price", 8, NOT_TEST + " AND (unit_price IS NULL OR unit_price >= 1000)"),
    f"""rooms AS (
  SELECT * FROM t WINDOW w AS (PARTITION BY subject_id) QUALIFY CASE WHEN subject_room_text IS NULL THEN true WHEN sum(coalesce({EXACT}, false)::INT) OVER w >= 3 THEN coalesce({EXACT}, false)
    WHEN sum(coalesce({COMPATIBLE.format(unknown='false')}, false)::INT) OVER w >= 3 THEN coalesce({COMPATIBLE.format(unknown='false')}, false)
    WHEN sum(regexp_matches(subject_room_text, '^[2-9][+]')::INT) OVER w >= 3 THEN regexp_matches(subject_room_text, '^[2-9][+]') ELSE true END
)""",
    sql_relax("wide", "rooms", "ratio BETWEEN CASE category WHEN 'land' THEN 0.2 ELSE 0.45 END AND CASE category WHEN 'land' THEN 5.0 ELSE 1.9 END"),
    sql_relax("aged", "wide", "CASE WHEN subject_building_age <= 5 THEN building_age <= 5 ELSE abs(building_age - subject_building_age) <= 8 END", "subject_building_age >= 0"),
    sql_fence("p", "aged", "price", 3, NOT_TEST),
    "valued AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY price, provider_rank, created_at, listing_uid) AS price_rank FROM p)",
])


def chain(*blocks: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in blocks)


@registered("j1_match_pool", chain(PAIRS) + " SELECT subject_id, listing_uid, floor(ratio * 1000 + 0.5)::BIGINT AS ratio_permille FROM cut")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("subject_id", "listing_uid", F.floor(L.area_ratio() * 1000 + 0.5).alias("ratio_permille"))


@registered("p5_matches_subject", chain(PAIRS) + " SELECT subject_id, listing_uid, pool_quality FROM cut WHERE provider_rank = 0")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached(spark, sf_dir).select("subject_id", "listing_uid", "pool_quality")


@registered(
    "j2_match_fallback",
    f"""WITH spelled AS (SELECT *, CASE WHEN subject_id % 3 = 0 THEN neighborhood || ' Mahallesi' ELSE neighborhood END AS place FROM fx_subject), scoped AS (SELECT * FROM fx_listing WHERE provider_rank = 0),
named AS (SELECT DISTINCT s.subject_id FROM spelled s JOIN (SELECT DISTINCT city, district, category, valuation_type, neighborhood FROM scoped) l ON s.city = l.city AND s.district = l.district AND s.category = l.category AND s.valuation_type = l.valuation_type WHERE contains(lower(l.neighborhood), lower(s.place))),
near AS (SELECT s.*, l.listing_uid, l.room_text, coalesce(l.net_area, l.gross_area) AS area, n.subject_id IS NOT NULL AS by_name FROM spelled s JOIN scoped l ON s.city = l.city AND s.district = l.district AND s.neighborhood = l.neighborhood AND s.category = l.category AND s.valuation_type = l.valuation_type LEFT JOIN named n ON s.subject_id = n.subject_id)
SELECT subject_id, listing_uid, CASE WHEN by_name THEN 'neighborhood' ELSE 'district' END AS match_level FROM near
WHERE area > 10 AND area / subject_area BETWEEN CASE category WHEN 'land' THEN 0.35 WHEN 'commercial' THEN 0.5 ELSE 0.65 END AND CASE category WHEN 'land' THEN 3.0 WHEN 'commercial' THEN 2.0 ELSE 1.5 END AND {ROOM_FITS}""",
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the subjects write their neighbourhood otherwise than the listings do."""
    place = F.when(c("subject_id") % 3 == 0, F.concat("neighborhood", F.lit(" Mahallesi"))).otherwise(c("neighborhood"))
    found = pool.match_pool(pool.scope_keys(subjects(spark, sf_dir).withColumn("neighborhood", place)), pool.with_scope_keys(listings(spark, sf_dir).where("provider_rank = 0")), room=True, fallback="district")
    return found.select("subject_id", "listing_uid", "match_level")


@registered("u1_unique_first", chain(PAIRS) + " SELECT subject_id, listing_uid, unit_price FROM uniq")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("subject_id", "listing_uid", "unit_price")


@registered("p8_strict_fit", chain(PAIRS, STRICT) + " SELECT subject_id, listing_uid FROM strict")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.strict_fit(prepared(spark, sf_dir).where("price > 0")).select("subject_id", "listing_uid")


@registered("w1_trim_unit_price", chain(PAIRS, sql_fence("t", "uniq", "unit_price", 8, NOT_TEST + " AND (unit_price IS NULL OR unit_price >= 1000)")) + " SELECT subject_id, listing_uid FROM t")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.trim_unit_price(prepared(spark, sf_dir)).select("subject_id", "listing_uid")


#: Prices with some far above and far below the others, tests among the titles, and prices that are none.
ODD_PRICES = "odd AS (SELECT * EXCLUDE (hash_) REPLACE (CASE hash_ % 11 WHEN 0 THEN price * 40 WHEN 1 THEN price / 1000 WHEN 2 THEN 0 ELSE price END AS price, CASE hash_ % 7 WHEN 3 THEN title || ' TEST ilan' ELSE title END AS title) FROM (SELECT *, length(title) + floor(gross_area) + coalesce(building_age, 5) AS hash_ FROM uniq))"


@registered("w2_trim_price", chain(PAIRS, ODD_PRICES, sql_fence("t", "odd", "price", 3, "NOT contains(lower(title), 'test') AND price > 0")) + " SELECT subject_id, listing_uid, price FROM t")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.length("title") + F.floor("gross_area") + F.coalesce("building_age", F.lit(5))
    odd = {"price": F.when(k % 11 == 0, c("price") * 40).when(k % 11 == 1, c("price") / 1000).when(k % 11 == 2, 0.0).otherwise(c("price")), "title": F.when(k % 7 == 3, F.concat("title", F.lit(" TEST ilan"))).otherwise(c("title"))}
    return selection.trim_price(prepared(spark, sf_dir).drop("test_").withColumns(odd)).select("subject_id", "listing_uid", "price")


@registered("p9_room_cascade", chain(PAIRS, VALUATION.replace("FROM t WINDOW", "FROM uniq WINDOW")) + " SELECT subject_id, listing_uid FROM rooms")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.room_cascade(prepared(spark, sf_dir)).select("subject_id", "listing_uid")


@registered("p10_relax_area_age", chain(PAIRS, VALUATION.replace("SELECT * FROM rooms WHERE true", "SELECT * FROM uniq WHERE true")) + " SELECT subject_id, listing_uid FROM aged")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.relax_age(selection.relax_area(prepared(spark, sf_dir))).select("subject_id", "listing_uid")


@registered("t5_valuation_set", chain(PAIRS, VALUATION) + " SELECT subject_id, listing_uid, price, price_rank FROM valued")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.valuation_set(prepared(spark, sf_dir)).select("subject_id", "listing_uid", "price", "price_rank")


BAND = """, g AS (
  SELECT subject_id, any_value(subject_area) AS area, any_value(category) AS category, count(*) AS n, count(unit_price) AS nu, count(price) AS np,
    floor(quantile_cont(unit_price, 0.2) + 0.5) AS ulo, floor(quantile_cont(unit_price, 0.5) + 0.5) AS umid, floor(quantile_cont(unit_price, 0.8) + 0.5) AS uhi,
    quantile_cont(price, 0.2) AS plo, quantile_cont(price, 0.5) AS pmid, quantile_cont(price, 0.8) AS phi FROM {source} GROUP BY subject_id
), h AS (
  SELECT *, area > 0 AND nu >= 3 AS by_unit, CASE WHEN category <> 'land' AND np >= 3 THEN floor(plo * 0.92 + 0.5) END AS glo, CASE WHEN category <> 'land' AND np >= 3 THEN floor(pmid * 0.96 + 0.5) END AS gmid,
    CASE WHEN category <> 'land' AND np >= 3 THEN floor(phi + 0.5) END AS ghi FROM g
), i AS (
  SELECT *, CASE WHEN by_unit THEN greatest(floor(ulo * area + 0.5), glo) WHEN np >= 3 THEN floor(plo + 0.5) END AS min_price FROM h
), k AS (
  SELECT *, CASE WHEN by_unit THEN greatest(floor(umid * area + 0.5), gmid, min_price) WHEN np >= 3 THEN floor(pmid + 0.5) END AS expected_price FROM i
)
SELECT subject_id, n, min_price, expected_price, CASE WHEN by_unit THEN greatest(floor(uhi * area + 0.5), ghi, expected_price) WHEN np >= 3 THEN floor(phi + 0.5) END AS max_price,
  CASE WHEN by_unit THEN ulo WHEN np >= 3 AND area > 0 THEN floor(min_price / area + 0.5) END AS min_sqm, CASE WHEN by_unit THEN umid WHEN np >= 3 AND area > 0 THEN floor(expected_price / area + 0.5) END AS expected_sqm,
  CASE WHEN by_unit THEN uhi WHEN np >= 3 AND area > 0 THEN floor(floor(phi + 0.5) / area + 0.5) END AS max_sqm,
  round(CASE WHEN by_unit THEN least(0.66, 0.38 + nu * 0.012::DOUBLE) WHEN np >= 3 THEN least(0.58, 0.34 + np * 0.01::DOUBLE) END, 6)::DOUBLE AS confidence
FROM k"""


@registered("a2_price_band", chain(PAIRS, VALUATION) + BAND.format(source="valued"))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band.price_band(selection.valuation_set(prepared(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price band of every subject."""
    return a2(spark, sf_dir)


@registered("a1_quantiles", "SELECT city, category, count(*) AS n, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.8), 4) AS q80 FROM fx_listing GROUP BY city, category")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole cities and categories, however many listings one has."""
    names = {"q25": 0.25, "q50": 0.5, "q80": 0.8}
    found = quantiles.exact_quantiles(listings(spark, sf_dir).select("city", "category", "price"), ["city", "category"], "price", names.items(), work_folder(spark, "quantiles"))
    return found.withColumns({k: F.round(k, 4) for k in names})


DAYS = "greatest(0, floor((epoch(TIMESTAMP '2001-12-01') - epoch(created_at::TIMESTAMP)) / 86400))::BIGINT"
SCORE = """(CASE WHEN coalesce(image_url, '') <> '' THEN 20 ELSE 0 END + CASE WHEN price IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN area IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN coalesce(room_text, '') <> '' THEN 4 ELSE 0 END
  + CASE WHEN room_text = subject_room_text THEN 8 ELSE 0 END
  + CASE WHEN subject_building_age <= 5 AND building_age <= 5 THEN 10 WHEN abs(building_age - subject_building_age) <= 3 THEN 6 WHEN abs(building_age - subject_building_age) <= 8 THEN 3 ELSE 0 END
  + CASE WHEN ratio BETWEEN 0.8 AND 1.25 THEN 8 WHEN ratio BETWEEN 0.65 AND 1.5 THEN 5 WHEN ratio BETWEEN 0.35 AND 2.5 THEN 2 ELSE 0 END
  + CASE source WHEN 'Hepsiemlak' THEN 3 WHEN 'RE/MAX' THEN 3 WHEN 'Sahibinden' THEN 2 WHEN 'Emlakjet' THEN 2 ELSE 0 END)"""


@registered("f11_quality_score", chain(PAIRS) + f" SELECT subject_id, listing_uid, {SCORE} AS quality FROM uniq")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("subject_id", "listing_uid", L.quality_score().alias("quality"))


@registered("t3_best_n", chain(PAIRS) + f" SELECT subject_id, listing_uid, row_number() OVER (PARTITION BY subject_id ORDER BY {SCORE} DESC, price NULLS LAST, provider_rank, created_at, listing_uid) AS best_rank FROM uniq QUALIFY best_rank <= 8")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_n(prepared(spark, sf_dir).withColumn("quality", L.quality_score()), 8).select("subject_id", "listing_uid", "best_rank")


@registered("w6_long_listed", chain(PAIRS) + f" SELECT subject_id, listing_uid, {DAYS} AS days, row_number() OVER (PARTITION BY subject_id ORDER BY {DAYS} DESC, unit_price DESC NULLS LAST, price DESC, provider_rank, created_at, listing_uid) AS stale_rank FROM uniq WHERE {DAYS} >= 45 AND price > 0 AND created_at::TIMESTAMP <= TIMESTAMP '2001-12-02' QUALIFY stale_rank <= 6")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.long_listed(prepared(spark, sf_dir).withColumn("days", L.days_on_market(as_of()))).select("subject_id", "listing_uid", "days", "stale_rank")


BANDS_SQL = """banded AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY price, provider_rank, created_at, listing_uid) - 1 AS i, count(*) OVER (PARTITION BY subject_id) AS n, greatest(8, ceil(n / 3.0))::BIGINT AS third,
    greatest(0, floor(n / 2.0) - ceil(third / 2.0))::BIGINT AS start FROM {source}
)"""


@registered("w4_price_bands", chain(PAIRS, BANDS_SQL.format(source="uniq")) + " SELECT subject_id, listing_uid, i < third AS in_low, i >= start AND i < start + third AS in_mid, i >= greatest(0, n - third) AS in_high FROM banded")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.price_bands(prepared(spark, sf_dir)).select("subject_id", "listing_uid", "in_low", "in_mid", "in_high")


def portfolio_sql() -> str:
    pool_ = ",\n".join([
        sql_relax("o1", "uniq", "area IS NOT NULL", min_n=30, where="price > 0"), sql_relax("o2", "o1", "coalesce(image_url, '') <> '' AND area IS NOT NULL", min_n=30),
        sql_fence("o3", "o2", "unit_price", 8, NOT_TEST + " AND (unit_price IS NULL OR unit_price >= 1000)"), sql_relax("o4", "o3", COMPATIBLE.format(unknown="true"), "subject_room_text IS NOT NULL"),
        BANDS_SQL.format(source="o4"),
        f"g0 AS (SELECT *, CASE WHEN created_at::TIMESTAMP <= TIMESTAMP '2001-12-02' THEN {DAYS} END AS days, {SCORE} AS quality, NULL::VARCHAR AS grp FROM banded)",
    ])
    best, tie = "quality DESC, price NULLS LAST", "provider_rank, created_at, listing_uid"
    steps, last = [], "g0"

    def step(name: str, group: str, wanted: str, n: str, order: str) -> None:
        nonlocal last
        free = f"(grp IS NULL AND coalesce({wanted}, false))"
        steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN {free} AND row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN {free} THEN 0 ELSE 1 END, {order}, {tie}) <= {n} THEN '{group}' ELSE grp END AS grp) FROM {last})")
        last = name

    def needed(name: str, what: str) -> None:
        nonlocal last
        drop = "* EXCLUDE (need)" if any("AS need" in s for s in steps) else "*"
        steps.append(f"{name} AS (SELECT {drop}, {what} AS need FROM {last})")
        last = name

    step("g1", "stale", "days >= 45", "6", "days DESC, unit_price DESC NULLS LAST, price DESC")
    for k, (group, wanted) in enumerate((("low", "i < third"), ("mid", "i >= start AND i < start + third"), ("high", "i >= greatest(0, n - third)"))):
        step(f"g{2 + k}", group, wanted, "8", best)
    for k, group in enumerate(("low", "mid", "high")):
        needed(f"n{k}", f"8 - sum(CASE WHEN grp = '{group}' THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id)")
        step(f"g{5 + k}", group, "true", "need", best)
    needed("n3", "30 - sum(CASE WHEN grp IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id)")
    step("g8", "mid", "true", "need", best)
    return chain(PAIRS, pool_, *steps)


@registered("w5_portfolio", portfolio_sql() + ' SELECT subject_id, listing_uid, grp AS "group" FROM g8 WHERE grp IS NOT NULL')
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.portfolio(prepared(spark, sf_dir), as_of()).select("subject_id", "listing_uid", "group")


@registered("a15_pool_diagnostics", portfolio_sql() + ", " + STRICT + """, counts AS (SELECT subject_id, count(*) AS raw_count, count(*) FILTER (price > 0) AS priced_count, count(*) FILTER (price > 0 AND area IS NOT NULL) AS area_count FROM uniq GROUP BY 1)
SELECT u.*, coalesce(p.images, 0) AS image_count, coalesce(p.stale, 0) AS long_listed_count, coalesce(p.selected, 0) AS selected_count, coalesce(s.n, 0) AS strict_count FROM counts u
LEFT JOIN (SELECT subject_id, count(*) FILTER (coalesce(image_url, '') <> '') AS images, count(*) FILTER (grp = 'stale') AS stale, count(grp) AS selected FROM g8 GROUP BY 1) p ON u.subject_id = p.subject_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM strict GROUP BY 1) s ON u.subject_id = s.subject_id""")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pool_diagnostics(prepared(spark, sf_dir), as_of())


@registered("a3_market_projection", portfolio_sql() + """, raws AS (SELECT subject_id, count(*) AS raw FROM uniq GROUP BY 1), sel AS (SELECT subject_id, floor(avg(days) + 0.5) AS average_days, count(*) AS selected, count(*) FILTER (days >= 45) AS long FROM g8 WHERE grp IS NOT NULL GROUP BY 1)
SELECT s.subject_id, average_days, raw AS active, nullif(long, 0) AS waiting, CASE WHEN raw >= 120 THEN 'Yüksek' WHEN raw >= 40 OR selected >= 30 THEN 'Orta' ELSE 'Düşük' END AS competition FROM sel s JOIN raws r ON s.subject_id = r.subject_id""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir).withColumn("raw", F.count(F.lit(1)).over(selection.per_subject()))
    return band.market_projection(selection.portfolio(rows, as_of()))


@registered("a4_regional_stats", chain(PAIRS) + " SELECT subject_id, min(price) AS min_price, floor(quantile_cont(price, 0.5) + 0.5) AS median_price, max(price) AS max_price, min(unit_price) AS min_unit, max(unit_price) AS max_unit FROM uniq GROUP BY subject_id")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band.regional_stats(prepared(spark, sf_dir))


COVERAGE = portfolio_sql() + ", " + VALUATION + """, cov AS (
  SELECT u.subject_id, count(*) AS raw, count(*) FILTER (v.listing_uid IS NOT NULL) AS valuation, count(*) FILTER (g.listing_uid IS NOT NULL) AS selected FROM uniq u
  LEFT JOIN valued v ON u.subject_id = v.subject_id AND u.listing_uid = v.listing_uid LEFT JOIN (SELECT * FROM g8 WHERE grp IS NOT NULL) g ON u.subject_id = g.subject_id AND u.listing_uid = g.listing_uid GROUP BY u.subject_id
), given AS (SELECT subject_id, count(*) AS records, count(*) FILTER (provider_rank = 0) AS cache_count FROM cut GROUP BY 1
), covered AS (SELECT c.*, records, cache_count, cache_count > 0 AS cache_hit, records = cache_count AND selected >= 30 AS full_cache_hit, selected >= 30 OR (selected >= 24 AND records >= 30 AND valuation >= 3) AS enough FROM cov c JOIN given g ON c.subject_id = g.subject_id)"""


def coverage(rows: DataFrame) -> DataFrame:
    """provider_coverage() of comparables as they come (pairs), in one pass: selections are flags of rows that stay."""
    rows = selection.prepared(rows, dealt=True, flag="is_unique").withColumns({"in_valuation": c("is_unique"), "chosen_": c("is_unique"), "from_cache": c("provider_rank") == 0})
    rows = selection.grouped(selection.valued(rows, "in_valuation"), as_of(), "chosen_")
    return pool.provider_coverage(rows.withColumn("in_portfolio", c("group").isNotNull()))


@registered("a5_provider_coverage", COVERAGE + " SELECT * FROM covered")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(pairs(spark, sf_dir))


def free_sql() -> str:
    """Coverage of what providers 0 and 1 give, under the names of the chain."""
    return COVERAGE.replace("FROM fit QUALIFY", "FROM fit WHERE provider_rank < 2 QUALIFY")


@registered("u3_paid_feed", free_sql() + """, paid AS (SELECT * FROM fit WHERE provider_rank = 2 AND subject_id NOT IN (SELECT subject_id FROM covered WHERE enough))
SELECT subject_id, listing_uid FROM cut UNION ALL SELECT subject_id, listing_uid FROM paid""")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers 0 and 1 are free; the rows of 2 are paid for, where the free ones aren't enough for a report.

    Stored are what the scopes offer, which is bounded for each, and one row of a subject; paid rows are met by subjects that lack."""
    items, every = stored(offered(spark, sf_dir), "offered"), looking(spark, sf_dir)
    free = pool.comparables(every, items.where("provider_rank < 2"))
    covered = stored(coverage(free).select("subject_id", "enough"), "covered")
    lacking = every.select("subject_id").join(covered, "subject_id", "left").fillna(False, ["enough"])
    paid = pool.comparables(every.join(lacking.where(~c("enough")), "subject_id", "left_semi"), items.where("provider_rank = 2"))
    return pool.add_paid_feed(free, paid).select("subject_id", "listing_uid")


@registered("u2_union_feeds", "SELECT listing_uid, source_url, CASE source WHEN 'Hepsiemlak' THEN 0 WHEN 'RE/MAX' THEN 1 ELSE 2 END AS provider_rank FROM fx_listing QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY CASE source WHEN 'Hepsiemlak' THEN 0 WHEN 'RE/MAX' THEN 1 ELSE 2 END, created_at, listing_uid) = 1")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    feeds = [rows.where("source = 'Hepsiemlak'"), rows.where("source = 'RE/MAX'").drop("image_url"), rows.where("source not in ('Hepsiemlak', 'RE/MAX')")]
    return pool.unique_first(pool.union_feeds(*feeds), ["source_url"], [c("provider_rank"), c("created_at"), c("listing_uid")]).select("listing_uid", "source_url", "provider_rank")


def with_quality(rows: DataFrame, name: str = "quality") -> DataFrame:
    """Listings as they are, scored without a subject."""
    return rows.withColumns({"subject_area": F.lit(None).cast("double"), "subject_room_text": F.lit(None).cast("string")}).withColumn(name, L.cache_quality_score()).drop("subject_area", "subject_room_text")


@registered("f12_cache_quality", f"SELECT listing_uid, {CACHE_SCORE} AS quality FROM fx_listing")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(listings(spark, sf_dir)).select("listing_uid", "quality")


@registered("t1_cap_scope", f"SELECT listing_uid FROM fx_listing QUALIFY row_number() OVER (PARTITION BY city, district, neighborhood, category, valuation_type ORDER BY {CACHE_SCORE} DESC, created_at DESC, listing_uid) <= 240")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.cap_scope(pool.with_scope_keys(with_quality(listings(spark, sf_dir)))).select("listing_uid")


@registered("t2_cap_subject", chain(PAIRS) + " SELECT subject_id, listing_uid FROM uniq QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY provider_rank, created_at, listing_uid) <= 60")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.cap_subject(prepared(spark, sf_dir)).select("subject_id", "listing_uid")


FRESH = "CASE WHEN TIMESTAMP '2001-10-15' >= created_at::TIMESTAMP + INTERVAL 45 DAY THEN 'EXPIRED' WHEN TIMESTAMP '2001-10-15' >= created_at::TIMESTAMP + INTERVAL 14 DAY THEN 'STALE' ELSE 'FRESH' END"


@registered("p4_live_listings", f"SELECT listing_uid FROM fx_listing WHERE price IS NOT NULL AND image_url IS NOT NULL AND {FRESH} = 'FRESH'")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.live_listings(listings(spark, sf_dir), F.lit(FRESH_AS_OF).cast("timestamp")).select("listing_uid")


@registered("r2_sweep_freshness", f"SELECT {FRESH} AS freshness, city, count(*) AS n FROM fx_listing GROUP BY 1, 2")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.sweep_freshness(listings(spark, sf_dir), F.lit(FRESH_AS_OF).cast("timestamp")).groupBy("freshness", "city").agg(F.count(F.lit(1)).alias("n"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumns({f"crit_{x}": c(x) for x in ("city", "district")}).withColumn("crit_neighborhood", F.when(c("provider_rank") == 2, c("district")).otherwise(c("neighborhood")))
    rows = rows.withColumns({"subject_area": F.lit(100.0), "subject_room_text": F.lit(""), "image_source": c("source"), "property_type": c("category"), "address": F.lit("")})
    return pool.validate_listing(rows)


REASON = """CASE WHEN image_url IS NULL THEN 'missing_real_image' WHEN coalesce(net_area, gross_area) <= 10 THEN 'missing_area'
  WHEN coalesce(net_area, gross_area) / 100.0 NOT BETWEEN CASE category WHEN 'land' THEN 0.35 WHEN 'commercial' THEN 0.5 ELSE 0.65 END AND CASE category WHEN 'land' THEN 3.0 WHEN 'commercial' THEN 2.0 ELSE 1.5 END THEN 'area_not_near_subject'
  WHEN provider_rank = 2 AND NOT contains(lower(neighborhood || ' ' || title || ' ' || source_url), lower(district)) THEN 'neighborhood_not_verified'
  WHEN category = 'residential' AND room_text IS NULL THEN 'missing_room' END"""


@registered("p2_validate_listing", f"SELECT listing_uid, ({REASON}) IS NULL AS ok, {REASON} AS reason FROM fx_listing")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("listing_uid", "ok", "reason")


@registered("a7_save_stats", f"SELECT coalesce({REASON}, 'saved') AS reason, count(*) AS n FROM fx_listing GROUP BY 1")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.save_stats(judged(spark, sf_dir))


@registered("p3_p7_predicates", "SELECT listing_uid, image_url IS NOT NULL AS real_image, regexp_matches(lower(title), 'test|dikkate almay[iı]n') AS test_listing FROM fx_listing")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("listing_uid", L.is_real_image(c("image_url"), c("source")).alias("real_image"), L.is_test_listing(c("title"), F.lit("")).alias("test_listing"))


@registered("p6_neighborhood_evidence", "SELECT listing_uid, contains(lower(title || ' ' || source_url), lower(district)) AS evident FROM fx_listing")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("listing_uid", L.has_neighborhood_evidence(c("city"), F.lit(""), c("district"), c("title"), c("source_url"), address=F.lit("")).alias("evident"))


@registered("s7_upsert_listings", """WITH one AS (SELECT * FROM fx_listing QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY provider_rank, created_at, listing_uid) = 1), old AS (SELECT * FROM one WHERE created_at < DATE '1998-01-01'), new AS (SELECT * FROM one WHERE created_at >= DATE '1997-01-01')
SELECT coalesce(n.source_url, o.source_url) AS source_url, coalesce(n.price, o.price) AS price, CASE WHEN o.source_url IS NOT NULL THEN o.created_at::TIMESTAMP ELSE TIMESTAMP '2001-12-01' END AS first_seen_at,
  CASE WHEN n.source_url IS NOT NULL THEN TIMESTAMP '2001-12-01' ELSE o.created_at::TIMESTAMP END AS last_seen_at, n.source_url IS NOT NULL AS is_active FROM old o FULL JOIN new n ON o.source_url = n.source_url""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = pool.unique_first(listings(spark, sf_dir), ["source_url"], [c("provider_rank"), c("created_at"), c("listing_uid")])
    old = one.where("created_at < date'1998-01-01'").withColumns({"first_seen_at": c("created_at").cast("timestamp_ntz"), "last_seen_at": c("created_at").cast("timestamp_ntz"), "is_active": F.lit(False)})
    return pool.upsert_listings(old, one.where("created_at >= date'1997-01-01'"), F.lit(AS_OF).cast("timestamp_ntz")).select("source_url", "price", "first_seen_at", "last_seen_at", "is_active")


@registered("p21_listing_to_comparable", """SELECT 'cache:' || listing_uid AS external_id, source_url, price, net_area, gross_area, created_at::TIMESTAMP AS listing_date, floor(price / coalesce(net_area, gross_area) + 0.5) AS price_per_sqm FROM fx_listing""")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumns({"external_id": F.lit(None).cast("string"), "net_m2": F.lit(None).cast("double"), "gross_m2": F.lit(None).cast("double"), "price_per_sqm": F.lit(None).cast("double"), "raw_json": F.lit("{}"), "first_seen_at": c("created_at").cast("timestamp")})
    return pool.listing_to_comparable(rows).withColumn("listing_date", c("listing_date").cast("timestamp_ntz"))


def raw_feed(rows: DataFrame) -> DataFrame:
    """Listings as a feed writes them: texts with units, Turkish numbers and dates, and what was searched for."""
    tr = lambda x: F.regexp_replace(F.format_number(c(x), 0), ",", ".")
    return rows.select(
        "source", "source_url", "image_url", F.concat(F.lit("  "), c("title"), F.lit(" ")).alias("title"), F.concat(tr("price"), F.lit(" TL")).alias("price"), c("gross_area").cast("string").alias("gross_area"), c("net_area").cast("string").alias("net_area"),
        F.regexp_replace("room_text", r"\\+", " + ").alias("room_text"), F.concat(c("building_age").cast("string"), F.lit(" yaş")).alias("building_age_text"), F.lit("3. Kat").alias("floor_text"), F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("external_id"), F.date_format("created_at", "dd.MM.yyyy").alias("listing_date"), F.lit(None).cast("string").alias("price_per_sqm"), F.lit(" ").alias("city"), F.lit("").alias("district"), c("neighborhood"), F.lit("").alias("address"),
        c("city").alias("crit_city"), c("district").alias("crit_district"), c("neighborhood").alias("crit_neighborhood"), c("category").alias("crit_report_type"), F.lit("").alias("crit_property_type"), F.when(c("valuation_type") == "rental", "Kiralık").otherwise("SALE").alias("crit_valuation_type"),
        c("created_at").cast("timestamp").alias("seen_at"), F.lit(100.0).alias("subject_area"), F.lit("").alias("subject_room_text"), c("source").alias("image_source"), "property_type",
    )


@registered("p1_normalize_comparable", """SELECT source_url, title, price, net_area, gross_area, room_text, building_age::DOUBLE AS building_age, 'listing:' || substr(sha1(source_url), 1, 16) AS external_id, floor(price / coalesce(net_area, gross_area) + 0.5) AS price_per_sqm, city, category, valuation_type FROM fx_listing WHERE image_url IS NOT NULL""")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_feed(listings(spark, sf_dir))
    return pool.normalize_comparable(raw, as_of()).select("source_url", "title", "price", "net_area", "gross_area", "room_text", "building_age", "external_id", "price_per_sqm", "city", "category", "valuation_type")


@registered("w3_outlier_flags", chain(PAIRS) + """, f AS (SELECT *, quantile_cont(unit_price, 0.25) OVER w AS q1, quantile_cont(unit_price, 0.75) OVER w AS q3 FROM uniq WINDOW w AS (PARTITION BY subject_id))
SELECT subject_id, listing_uid, coalesce(unit_price > q3 + (q3 - q1) * 1.25, false) AS high_outlier, coalesce(unit_price < greatest(1.0, q1 - (q3 - q1) * 1.25), false) AS low_outlier FROM f""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.outlier_flags(prepared(spark, sf_dir)).select("subject_id", "listing_uid", "high_outlier", "low_outlier")


FIT = """, f AS (SELECT *, quantile_cont(unit_price, 0.25) OVER w AS q1, quantile_cont(unit_price, 0.75) OVER w AS q3 FROM uniq WINDOW w AS (PARTITION BY subject_id)
), fl AS (
  SELECT *, coalesce(unit_price > q3 + (q3 - q1) * 1.25, false) AS hi, coalesce(unit_price < greatest(1.0, q1 - (q3 - q1) * 1.25), false) AS lo, building_age - subject_building_age AS diff,
    coalesce(NOT has_elevator AND floor_no >= 3, false) AS high_floor, coalesce(building_floors >= 3 AND floor_no >= building_floors - 1, false) AS top_floor,
    regexp_matches(lower(title || ' ' || source_url), 'lüks|lux|ultra|rezidans|residence|sıfır|sifir|yeni bina|kapalı havuz|havuz|güvenlik|guvenlik|otopark|site') AS luxury, regexp_matches(lower(title || ' ' || source_url), 'havuz') AS pool FROM f
), sc AS (
  SELECT *, coalesce((subject_building_age >= 20 AND building_age <= 8 AND abs(diff) > 10) OR (subject_building_age >= 15 AND building_age <= 5 AND abs(diff) > 10), false) OR pool AS better,
    greatest(0, least(100, 55
      + CASE WHEN room_text IS NULL OR subject_room_text IS NULL THEN 0 WHEN room_text = subject_room_text THEN 15 WHEN split_part(room_text, '+', 2) <> split_part(subject_room_text, '+', 2) THEN -18 WHEN abs(split_part(room_text, '+', 1)::INT - split_part(subject_room_text, '+', 1)::INT) = 1 THEN -5 ELSE -22 END
      + CASE WHEN ratio IS NULL THEN 0 WHEN ratio BETWEEN 0.85 AND 1.15 THEN 15 WHEN ratio BETWEEN 0.7 AND 1.35 THEN 8 WHEN ratio BETWEEN 0.55 AND 1.6 THEN -4 ELSE -18 END
      + CASE WHEN building_age IS NULL AND subject_building_age >= 15 THEN -8 WHEN building_age IS NULL OR subject_building_age IS NULL THEN 0 WHEN abs(diff) <= 5 THEN 13 WHEN abs(diff) <= 10 THEN 5 WHEN subject_building_age >= 20 AND building_age <= 8 THEN -24
        WHEN subject_building_age >= 15 AND building_age <= 5 THEN -20 WHEN diff < -10 THEN -12 ELSE -8 END
      + CASE WHEN high_floor THEN -5 ELSE 0 END + CASE WHEN top_floor THEN -6 ELSE 0 END - CASE WHEN pool THEN 5 ELSE 0 END - CASE WHEN luxury AND NOT pool THEN 3 ELSE 0 END - CASE WHEN hi THEN 18 ELSE 0 END - CASE WHEN lo THEN 10 ELSE 0 END))::INT AS fit_score FROM fl
), ro AS (SELECT *, CASE WHEN hi OR lo THEN 'outlier_context' WHEN fit_score >= 78 THEN 'primary' WHEN fit_score >= 62 THEN 'supporting' ELSE 'context_only' END AS role, CASE WHEN better THEN 'better_than_subject' WHEN fit_score >= 78 THEN 'similar_to_subject' ELSE 'weaker_or_uncertain_fit' END AS comparison FROM sc)"""


@registered("f13_fit_signals", chain(PAIRS) + FIT + " SELECT subject_id, listing_uid, fit_score, role, comparison, CASE role WHEN 'primary' THEN 1.0 WHEN 'supporting' THEN 0.45 ELSE 0.15 END::DOUBLE AS weight FROM ro")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.fit_signals(prepared(spark, sf_dir)).select("subject_id", "listing_uid", "fit_score", "role", "comparison", "weight")


PENALTY = """pen AS (SELECT subject_id, subject_area, least(38, CASE WHEN subject_building_age >= 30 THEN 24 WHEN subject_building_age >= 20 THEN 17 WHEN subject_building_age >= 15 THEN 11 WHEN subject_building_age >= 10 THEN 6 ELSE 0 END
  + CASE WHEN NOT has_elevator AND floor_no >= 3 THEN 9 ELSE 0 END + CASE WHEN building_floors >= 3 AND floor_no >= building_floors - 1 THEN 6 ELSE 0 END)::INT AS penalty_pct,
  array_to_string(list_filter([CASE WHEN subject_building_age >= 30 THEN '30+ yaş bina' WHEN subject_building_age >= 20 THEN '20+ yaş bina' WHEN subject_building_age >= 15 THEN '15+ yaş bina' WHEN subject_building_age >= 10 THEN '10+ yaş bina' END,
    CASE WHEN NOT has_elevator AND floor_no >= 3 THEN 'asansörsüz yüksek kat' END, CASE WHEN building_floors >= 3 AND floor_no >= building_floors - 1 THEN 'en üst/çatı kat etkisi' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM fx_subject)"""


@registered("f14_subject_penalty", chain(PENALTY) + """, more AS (SELECT p.subject_id, penalty_pct, reasons, p.subject_id % 4 < 2 AS poor, p.subject_id % 7 = 3 AND NOT coalesce(building_floors >= 3 AND floor_no >= building_floors - 1, false) AS roof FROM pen p JOIN fx_subject s ON s.subject_id = p.subject_id)
SELECT subject_id, least(38, penalty_pct + CASE WHEN poor THEN 7 ELSE 0 END + CASE WHEN roof THEN 6 ELSE 0 END)::INT AS penalty_pct, concat_ws('; ', nullif(reasons, ''), CASE WHEN roof THEN 'en üst/çatı kat etkisi' END, CASE WHEN poor THEN 'tadilat/bakımsızlık riski' END) AS reasons FROM more""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings in need of repair, worn ones, sound ones and ones of which nothing is said; floors that are called the last one."""
    k = c("subject_id")
    rows = subjects(spark, sf_dir).withColumns({"condition": F.when(k % 4 == 0, "Tadilat ister").when(k % 4 == 1, "BAKIMSIZ").when(k % 4 == 2, "İyi"), "floor_text": F.when(k % 7 == 3, "Çatı Katı").otherwise("Ara kat")})
    return signals.subject_penalty(rows).select("subject_id", "penalty_pct", F.array_join("reasons", "; ").alias("reasons"))


@registered("a6_signal_guidance", chain(PAIRS) + FIT + ", " + PENALTY + """, an AS (
  SELECT *, CASE WHEN sum((role IN ('primary', 'supporting'))::INT) OVER (PARTITION BY subject_id) >= 3 THEN role IN ('primary', 'supporting') ELSE role <> 'outlier_context' END AS anchor FROM ro
), ag AS (
  SELECT subject_id, count(*) AS n, count(*) FILTER (role = 'primary') AS n_primary, count(*) FILTER (role = 'supporting') AS n_supporting, count(*) FILTER (role = 'outlier_context') AS n_outlier,
    CASE WHEN count(*) FILTER (anchor) > 0 THEN count(*) FILTER (anchor AND comparison = 'better_than_subject') / count(*) FILTER (anchor) ELSE 0.0 END AS share,
    quantile_cont(unit_price, 0.1) FILTER (anchor) AS q10, quantile_cont(unit_price, 0.25) FILTER (anchor) AS q25, quantile_cont(unit_price, 0.5) FILTER (anchor) AS q50 FROM an GROUP BY subject_id
), di AS (
  SELECT a.*, p.penalty_pct, p.subject_area, floor(greatest(penalty_pct * (0.2::DOUBLE + share * 0.8::DOUBLE), CASE WHEN penalty_pct >= 20 THEN penalty_pct * 0.75 ELSE 0 END) + 0.5) AS effective_pct,
    CASE WHEN penalty_pct = 0 AND share < 0.2 THEN 4 WHEN penalty_pct < 10 THEN 8 WHEN penalty_pct < 20 AND share < 0.2 THEN 6 WHEN penalty_pct >= 25 THEN 14 WHEN penalty_pct >= 15 THEN 12 ELSE 10 END AS d0 FROM ag a JOIN pen p ON a.subject_id = p.subject_id
), dj AS (SELECT *, CASE WHEN n_outlier >= 3 AND n_primary < 5 THEN greatest(d0, 14) ELSE d0 END AS d1 FROM di), dk AS (SELECT *, CASE WHEN share >= 0.45 THEN least(18, d1 + 3) ELSE d1 END AS discount_pct,
  CASE WHEN (penalty_pct >= 20 OR n_outlier >= 3 OR (n_primary < 5 AND share >= 0.2)) AND q25 IS NOT NULL THEN q25 ELSE q50 END AS ex FROM dj)
SELECT subject_id, n, n_primary, n_supporting, n_outlier, discount_pct, penalty_pct, effective_pct, round(share, 4)::DOUBLE AS better_share, floor(q50 + 0.5) AS anchor_median, floor(ex + 0.5) AS anchor_expected,
  floor(ex * subject_area * (1 - discount_pct / 100.0::DOUBLE) * (1 - least(effective_pct, 30.0::DOUBLE) / 100.0::DOUBLE) / 50000 + 0.5) * 50000 AS suggested_expected FROM dk""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    guide = signals.signal_guidance(signals.fit_signals(prepared(spark, sf_dir)), signals.subject_penalty(subjects(spark, sf_dir)))
    return guide.select("subject_id", "n", "n_primary", "n_supporting", "n_outlier", "discount_pct", "penalty_pct", "effective_pct", "better_share", "anchor_median", "anchor_expected", "suggested_expected")


@registered("f8_f9_listing_columns", f"""SELECT listing_uid, floor(price / coalesce(net_area, gross_area) + 0.5) AS unit_price, coalesce(net_area, gross_area) AS area, CASE WHEN created_at::TIMESTAMP <= TIMESTAMP '2001-12-02' THEN {DAYS} END AS days,
  CASE WHEN created_at::TIMESTAMP <= TIMESTAMP '2001-12-02' THEN {DAYS} >= 45 END AS stale FROM fx_listing""")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = L.days_on_market(as_of())
    return listings(spark, sf_dir).select("listing_uid", L.unit_price().alias("unit_price"), L.comparable_area().alias("area"), days.alias("days"), L.long_listed(days).alias("stale"))


def policy_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subjects(spark, sf_dir).join(a2(spark, sf_dir).select("subject_id", "min_price", "expected_price", "max_price", "min_sqm", "expected_sqm", "max_sqm"), "subject_id")
    return rows.withColumns({"is_site": c("subject_id") % 2 == 0, "security": c("subject_id") % 3 == 0, "open_pool": c("subject_id") % 5 == 0, "has_generator": c("subject_id") % 7 == 0})


POLICY_SQL = chain(PAIRS, VALUATION) + ", band AS (" + "WITH " + BAND.format(source="valued").lstrip(", ") + """), x AS (
  SELECT s.*, min_price, expected_price, max_price, floor(min_price / 1000 + 0.5) * 1000 AS lo0, floor(expected_price / 1000 + 0.5) * 1000 AS mid0, floor(max_price / 1000 + 0.5) * 1000 AS hi0,
    CASE WHEN s.category = 'residential' THEN least(0.24::DOUBLE, CASE WHEN s.subject_id % 2 = 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN s.subject_id % 5 = 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN s.subject_id % 3 = 0 THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN s.subject_id % 7 = 0 THEN 0.02::DOUBLE ELSE 0 END) ELSE 0.0 END AS prem,
    CASE WHEN subject_building_age >= 30 THEN 0.5::DOUBLE WHEN subject_building_age >= 25 THEN 0.42 WHEN subject_building_age >= 20 THEN 0.35 WHEN subject_building_age >= 15 THEN 0.28 WHEN subject_building_age >= 10 THEN 0.2 WHEN subject_building_age >= 5 THEN 0.1 WHEN subject_building_age >= 3 THEN 0.04 ELSE 0 END AS aged
  FROM fx_subject s JOIN band b ON s.subject_id = b.subject_id
), y AS (
  SELECT *, CASE WHEN category <> 'residential' THEN 0.0::DOUBLE ELSE least(0.58::DOUBLE, CASE WHEN NOT has_elevator THEN aged + 0.06::DOUBLE + CASE WHEN floor_no >= 3 THEN 0.07::DOUBLE ELSE 0 END WHEN has_elevator AND subject_building_age >= 10 THEN greatest(aged - 0.03::DOUBLE, 0) ELSE aged END) END AS cond,
    floor(lo0 * (1 + prem) / 1000 + 0.5) * 1000 AS lo1 FROM x
), z AS (
  SELECT *, greatest(floor(lo1 * (1 - cond) / 1000 + 0.5) * 1000, CASE WHEN category = 'residential' AND subject_building_age <= 5 THEN floor(54000.0 * subject_area / 1000 + 0.5) * 1000 END) AS lo FROM y
)
SELECT subject_id, lo AS policy_min, greatest(lo, least(floor(lo * (1 + 0.15::DOUBLE) / 1000 + 0.5) * 1000, floor(lo * (1 + 0.3::DOUBLE) / 1000) * 1000)) AS policy_expected, greatest(lo, floor(lo * (1 + 0.3::DOUBLE) / 1000) * 1000) AS policy_max, round(prem, 4)::DOUBLE AS premium_pct, round(cond, 4)::DOUBLE AS condition_pct FROM z"""


@registered("f15_valuation_policy", POLICY_SQL)
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.range(1).select(*[F.lit(None).cast("double").alias(k) for k in policy.SETTINGS], F.lit(None).cast("boolean").alias("cost_floor_enabled"))
    return policy.apply_valuation_policy(policy_input(spark, sf_dir), settings).select("subject_id", "policy_min", "policy_expected", "policy_max", F.round("premium_pct", 4).alias("premium_pct"), F.round("condition_pct", 4).alias("condition_pct"))


@registered("f28_settings", "SELECT p_partkey, least(greatest(p_size * 20000.0, 0), 500000)::DOUBLE AS construction_cost_per_sqm, least(greatest(p_size * 3.0, 1), 100)::DOUBLE AS contractor_share_pct, 30.0::DOUBLE AS annual_inflation_pct, least(greatest(p_size - 5.0, 0), 15)::DOUBLE AS new_building_age_max, true AS cost_floor_enabled FROM part")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "part").select("p_partkey", (c("p_size") * 20000.0).alias("construction_cost_per_sqm"), (c("p_size") * 3.0).alias("contractor_share_pct"), F.lit(None).cast("double").alias("annual_inflation_pct"), (c("p_size") - 5.0).alias("new_building_age_max"), F.lit(None).cast("boolean").alias("cost_floor_enabled"))
    return policy.normalize_settings(rows)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects whose place stands in the address, in the title or in the city."""
    k = c("subject_id") % 4
    return subjects(spark, sf_dir).withColumns({"address": F.when(k == 0, "Kadıköy / İstanbul"), "title": F.when(k == 1, "İSTANBUL'da daire"), "city": F.when(k == 2, "Çankaya Ankara").otherwise(c("city"))})


ESTIMATE = """WITH a AS (SELECT *, CASE WHEN subject_id % 4 = 0 THEN 'Kadıköy / İstanbul' WHEN subject_id % 4 = 1 THEN 'İstanbul' WHEN subject_id % 4 = 2 THEN 'Çankaya Ankara' ELSE city END AS address,
  CASE subject_id % 4 WHEN 0 THEN 125000.0 WHEN 1 THEN 65000.0 WHEN 2 THEN 38000.0 ELSE 32000.0 END AS base FROM fx_subject),
b AS (SELECT *, floor(least(greatest(base * 1.0::DOUBLE * CASE WHEN subject_building_age IS NULL THEN 1.0::DOUBLE WHEN subject_building_age <= 1 THEN 1.12 WHEN subject_building_age <= 5 THEN 1.08 WHEN subject_building_age <= 10 THEN 1.03 WHEN subject_building_age >= 31 THEN 0.84 WHEN subject_building_age >= 21 THEN 0.9 WHEN subject_building_age >= 11 THEN 0.95 ELSE 1.0 END
  * CASE WHEN floor_no <= 0 THEN 0.93::DOUBLE WHEN floor_no = building_floors THEN 0.97 WHEN floor_no >= 3 THEN 1.02 ELSE 1.0 END * CASE WHEN subject_area < 75 THEN 1.04::DOUBLE WHEN subject_area > 220 THEN 0.94 ELSE 1.0 END * CASE WHEN has_elevator THEN 1.04::DOUBLE ELSE 1.0 END, 18000), 250000) + 0.5 + 1e-7) AS est_sqm FROM a)"""


@registered("j9_f16_fallback_estimate", ESTIMATE + """
SELECT subject_id, base, CASE subject_id % 4 WHEN 0 THEN 'İstanbul yüksek talep bölgesi' WHEN 1 THEN 'İstanbul geneli' WHEN 2 THEN 'Ankara geneli' ELSE 'Türkiye geneli varsayılan konut lokasyonu' END AS base_label, est_sqm, floor(est_sqm * subject_area / 1000 + 0.5) * 1000 AS est_expected FROM b""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.fallback_estimate(policy.location_hint(placed(spark, sf_dir))).select("subject_id", "base", "base_label", "est_sqm", "est_expected")


EST = """e AS (SELECT *, floor(est_sqm * 0.84::DOUBLE + 0.5) AS lo_sqm, floor(est_sqm * 1.16::DOUBLE + 0.5) AS hi_sqm, CASE subject_id % 4 WHEN 0 THEN 'İstanbul yüksek talep bölgesi' WHEN 1 THEN 'İstanbul geneli' WHEN 2 THEN 'Ankara geneli' ELSE 'Türkiye geneli varsayılan konut lokasyonu' END AS label,
  subject_id % 3 AS k, subject_id % 5 AS n, (1000 * subject_id)::DOUBLE AS g FROM b)"""

@registered("f16_fallback_answers", ESTIMATE + ", " + EST + """
SELECT subject_id, k > 0 AS estimated, CASE k WHEN 0 THEN g ELSE floor(lo_sqm * subject_area / 1000 + 0.5) * 1000 END AS min_price, CASE WHEN k < 2 THEN g + 1 ELSE floor(est_sqm * subject_area / 1000 + 0.5) * 1000 END AS avg_price, CASE k WHEN 0 THEN g + 2 ELSE floor(hi_sqm * subject_area / 1000 + 0.5) * 1000 END AS max_price,
  CASE k WHEN 0 THEN 7.0 ELSE lo_sqm END AS min_sqm, CASE k WHEN 0 THEN 8.0 ELSE est_sqm END AS avg_sqm, CASE k WHEN 0 THEN 9.0 ELSE hi_sqm END AS max_sqm, CASE k WHEN 0 THEN 0.8 WHEN 1 THEN 0.2 ELSE 0.35 END::DOUBLE AS confidence,
  CASE k WHEN 2 THEN 'Bu çalışma kullanıcı emsali olmadan, konum ve taşınmaz özelliklerine göre düşük güvenli ön tahmindir.' ELSE 'gerekçe' END AS rationale, CASE k WHEN 0 THEN 'x' ELSE 'Manuel emsal girilmediği için fiyat aralığı ' || label || ' için düşük güvenli ön tahmin olarak hesaplanmıştır.' || CASE k WHEN 1 THEN '|x' ELSE '' END END AS assumptions,
  CASE k WHEN 0 THEN '' WHEN 1 THEN 'MANUEL EMSAL VERİSİ yok' ELSE 'Manuel emsal verisi' END AS missing_data, CASE WHEN k = 0 THEN 12.0 WHEN k = 1 THEN 30.0 WHEN n >= 3 THEN 75.0 ELSE 95.0 END::DOUBLE AS marketing_days, CASE WHEN k = 0 THEN NULL WHEN n >= 4 THEN 'Yoğun rekabet' WHEN n >= 2 THEN 'Orta rekabet' ELSE 'Emsal verisi sınırlı' END AS competition,
  CASE k WHEN 0 THEN label || ' için pazar yorumu konum, taşınmaz özellikleri ve kullanıcı girdileri üzerinden niteliksel olarak hazırlanmıştır.' ELSE label || ' ve taşınmaz özelliklerine göre pazar projeksiyonu niteliksel olarak hazırlanmıştır. ' || subject_area::BIGINT || ' m² büyüklüğü, konut tipi ve kullanıcı tarafından girilen emsal sayısı dikkate alınmıştır; kesin piyasa istatistiği olarak yorumlanmamalıdır.' END AS market_summary,
  CASE WHEN k = 1 THEN 'bölge' WHEN n > 0 THEN 'Satılık konut yorumu kullanıcı tarafından girilen ' || n || ' emsal üzerinden desteklenmiştir.' ELSE 'Satılık konut yorumu manuel emsal olmadan, konum ve taşınmaz özelliklerine göre ön değerlendirme niteliğindedir.' END AS sale_summary FROM e""")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that have all, some and none of the fields, held against the estimate."""
    k = c("subject_id") % 3
    given = lambda *x: F.when(k == 0, F.lit(x[0])).when(k == 1, F.lit(x[1])).otherwise(F.lit(x[2]))
    answer = F.concat(
        F.lit("{"), F.when(k == 0, F.concat(F.lit('"minPrice": '), (c("subject_id") * 1000).cast("string"), F.lit(', "maxPrice": '), (c("subject_id") * 1000 + 2).cast("string"), F.lit(', "minPricePerSqm": 7, "avgPricePerSqm": 8, "maxPricePerSqm": 9,'))).otherwise(""),
        F.when(k < 2, F.concat(F.lit('"avgPrice": '), (c("subject_id") * 1000 + 1).cast("string"), F.lit(', "rationale": "gerekçe", "assumptions": ["x"],'))).otherwise(""),
        given('"confidence": 80, "marketProjection": {"averageMarketingDays": 12},', '"confidence": "0,2", "expectedSaleDays": 30, "missingData": ["MANUEL EMSAL VERİSİ yok"], "regionalStats": {"saleMarketSummary": "bölge"},', '"confidence": null,'), F.lit('"comps": []}'),
    )
    rows = placed(spark, sf_dir).withColumns({"answer": answer, "n_comparables": (c("subject_id") % 5).cast("int"), "no_area": F.lit(None).cast("double")})
    # without an area, so that prices aren't derived from each other nor rounded before they are looked at
    said = policy.normalize_price_index(rows, "answer", "no_area").withColumns({"min_price": F.when(k == 0, c("subject_id") * 1000.0), "avg_price": F.when(k < 2, c("subject_id") * 1000.0 + 1), "max_price": F.when(k == 0, c("subject_id") * 1000.0 + 2)})
    found = policy.with_projections(policy.apply_fallback(policy.fallback_estimate(policy.location_hint(said))))
    return found.select(
        "subject_id", "estimated", "min_price", "avg_price", "max_price", "min_sqm", "avg_sqm", "max_sqm", "confidence", "rationale", F.array_join("assumptions", "|").alias("assumptions"), F.array_join("missing_data", "|").alias("missing_data"),
        c("market_projection.averageMarketingDays").alias("marketing_days"), c("market_projection.competitionStatus").alias("competition"), c("market_projection.summary").alias("market_summary"), c("regional_stats.saleMarketSummary").alias("sale_summary"),
    )
