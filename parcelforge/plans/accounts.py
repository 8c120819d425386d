"""Queries of users, clients, reports, records, images and text columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import text as T
from parcelforge.operators import media, policy, reports, usage
from parcelforge.plans.fixtures import dealt_out, fixture, stored, work_folder
from parcelforge.plans.registry import registered
from parcelforge.streaming import counters

c = F.col
AS_OF = "2001-07-15 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_user")


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_report").withColumn("client_id", c("user_id") * 10 + c("client_no"))


@registered("a9_report_stats", "SELECT u.user_id, count(r.report_id) AS total, count(*) FILTER (NOT is_deleted) AS active, count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (date_trunc('month', created_at) = DATE '2001-07-01') AS this_month FROM fx_user u LEFT JOIN fx_report r ON u.user_id = r.user_id GROUP BY 1")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.report_stats(users(spark, sf_dir), filed(spark, sf_dir), as_of())


PLAN = "CASE WHEN subscription_plan IN ('PREMIUM_20_MONTHLY', 'PREMIUM_20_YEARLY') THEN subscription_plan ELSE 'FREE' END"


@registered("j12_with_plan", f"SELECT user_id, {PLAN} AS plan, CASE WHEN {PLAN} = 'FREE' THEN 5 ELSE 20 END AS monthly_limit FROM fx_user")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.with_plan(users(spark, sf_dir), usage.plan_table(spark)).select("user_id", "plan", "monthly_limit")


@registered("a10_quota_usage", f"""WITH n AS (SELECT user_id, count(*) AS used FROM fx_report WHERE NOT is_deleted AND status <> 'DRAFT' AND date_trunc('month', created_at) = DATE '2001-07-01' GROUP BY 1), q AS (
  SELECT u.user_id, {PLAN} AS plan, coalesce(used, 0) AS used, CASE WHEN subscription_status <> 'ACTIVE' THEN 0 WHEN {PLAN} = 'FREE' THEN 5 ELSE 20 END AS monthly_limit FROM fx_user u LEFT JOIN n ON u.user_id = n.user_id)
SELECT *, greatest(monthly_limit - used, 0) AS remaining, used < monthly_limit AS may_create FROM q""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.quota_usage(users(spark, sf_dir), filed(spark, sf_dir), usage.plan_table(spark), as_of())


@registered("a10_streamed_counters", """SELECT user_id, date_trunc('month', created_at)::DATE AS month, count(*) AS total, count(*) FILTER (NOT is_deleted) AS active, count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (NOT is_deleted AND status <> 'DRAFT') AS used FROM fx_report GROUP BY 1, 2""")
def a10_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report comes as a draft, deleted or as it ends up, in three files that don't keep the versions' order."""
    folder = work_folder(spark, "counters")
    now = filed(spark, sf_dir).select("report_id", "user_id", "created_at", "status", "is_deleted")
    drafts, gone = now.withColumns({"status": F.lit("DRAFT"), "is_deleted": F.lit(False)}), now.withColumn("is_deleted", F.lit(True))
    for rows, version in ((now, 3), (drafts, 1), (gone, 2)):
        rows.withColumn("version", F.lit(version)).repartition(4).write.mode("append").parquet(f"{folder}/events")
    stream = spark.readStream.schema(now.withColumn("version", F.lit(1)).schema).option("maxFilesPerTrigger", 6).parquet(f"{folder}/events")
    counters.start_counters(stream, f"{folder}/counts", f"{folder}/state").awaitTermination()
    return counters.counters(spark, f"{folder}/counts")


@registered("a11_client_counts", "WITH k AS (SELECT DISTINCT user_id * 10 + client_no AS client_id FROM fx_report), p AS (SELECT user_id * 10 + client_no AS client_id, count(*) AS n FROM fx_report WHERE report_id % 3 = 0 GROUP BY 1), r AS (SELECT user_id * 10 + client_no AS client_id, count(*) AS n FROM fx_report WHERE NOT is_deleted GROUP BY 1) SELECT k.client_id, coalesce(p.n, 0) AS properties, coalesce(r.n, 0) AS reports FROM k LEFT JOIN p ON k.client_id = p.client_id LEFT JOIN r ON k.client_id = r.client_id")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filed(spark, sf_dir)
    return usage.client_counts(rows.select("client_id").distinct(), rows.where("report_id % 3 = 0"), usage.visible_reports(rows))


@registered("j11_identity_conflicts", """WITH u AS (SELECT c_custkey AS user_id, lower('User' || (c_custkey % 400)) AS username, lower('m' || c_custkey || '@Mail.example') AS email, '+90532' || lpad((c_custkey % 700)::VARCHAR, 7, '0') AS phone FROM customer), k AS (
  SELECT user_id, 'username' AS key_type, username AS key_value FROM u UNION ALL SELECT user_id, 'email', email FROM u UNION ALL SELECT user_id, 'phone', phone FROM u)
SELECT key_type, key_value, count(DISTINCT user_id) AS users, min(user_id) AS first_id FROM k GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 1""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.lpad((c("c_custkey") % 700).cast("string"), 7, "0")
    rows = fixture(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), F.concat(F.lit(" User"), (c("c_custkey") % 400).cast("string")).alias("username"), F.concat(F.lit("M"), c("c_custkey").cast("string"), F.lit("@Mail.example ")).alias("email"), F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("0532 "), tail)).otherwise(F.concat(F.lit("+90 (532) "), tail)).alias("phone"))
    return usage.identity_conflicts(rows)


@registered("w9_latest_drafts", "SELECT user_id, report_id FROM fx_report WHERE NOT is_deleted AND status = 'DRAFT' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, report_id DESC) = 1")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.latest_drafts(filed(spark, sf_dir)).select("user_id", "report_id")


@registered("p17_visible_reports", "SELECT report_id FROM fx_report WHERE NOT is_deleted AND status <> 'DRAFT'")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.visible_reports(filed(spark, sf_dir), drafts=False).select("report_id")


@registered("p16_search_users", "SELECT user_id FROM fx_user WHERE contains(lower(full_name), '#00000001')")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.search_users(users(spark, sf_dir), "#00000001").select("user_id")


@registered("p16_search_index", "SELECT user_id FROM fx_user WHERE contains(lower(full_name), 'r#00000009')")
def p16_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the pieces of the text, looked up in an index."""
    rows = users(spark, sf_dir)
    return usage.search_indexed(rows, stored(usage.search_index(rows), "pieces"), "R#00000009").select("user_id")


@registered("t7_page", "SELECT report_id FROM fx_report WHERE NOT is_deleted ORDER BY created_at DESC, report_id DESC LIMIT 50 OFFSET 100")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.page(usage.visible_reports(filed(spark, sf_dir)), [F.desc("created_at"), F.desc("report_id")], 50, 100).select("report_id")


@registered("t7_page_by_ranges", "WITH v AS (SELECT report_id, row_number() OVER (ORDER BY created_at DESC, report_id DESC) AS r, count(*) OVER () AS n FROM fx_report WHERE NOT is_deleted) SELECT report_id FROM v WHERE r > n - 75 AND r <= n - 25")
def t7_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page near the end, of which one range of rows is read."""
    rows, order, folder = usage.visible_reports(filed(spark, sf_dir)), [F.desc("created_at"), F.desc("report_id")], work_folder(spark, "pages")
    usage.write_pages(rows, order, folder)
    return usage.read_page(spark, folder, order, 50, rows.count() - 75).select("report_id")


@registered("t7_newest_per_client", "SELECT report_id, row_number() OVER (PARTITION BY user_id * 10 + client_no ORDER BY created_at DESC, report_id DESC) AS rank FROM fx_report QUALIFY rank <= 20")
def t7_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.newest_per_client(filed(spark, sf_dir)).select("report_id", "rank")


@registered("j10_report_view", "SELECT report_id, c_name AS client, p_name AS property, CASE WHEN report_id % 2 = 0 THEN expected_price END AS price FROM fx_report LEFT JOIN customer ON c_custkey = user_id LEFT JOIN part ON p_partkey = report_id % 5000")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filed(spark, sf_dir).select("report_id", c("user_id").alias("client_id"), (c("report_id") % 5000).alias("property_id"))
    people, homes = fixture(spark, sf_dir, "customer").select(c("c_custkey").alias("client_id"), c("c_name").alias("client")), fixture(spark, sf_dir, "part").select(c("p_partkey").alias("property_id"), c("p_name").alias("property"))
    priced = filed(spark, sf_dir).where("report_id % 2 = 0").select("report_id", c("expected_price").alias("price"))
    return usage.report_view(rows, people, homes, priced).select("report_id", "client", "property", "price")


#: First names in the order of the Turkish alphabet.
NAMES_TR = ("Cevat", "Çınar", "Irmak", "İpek", "Ozan", "Öykü", "Sami", "Şule", "Umut", "Ümit")


@registered("t9_sort_names_tr", f"""WITH v AS (SELECT c_custkey, c_nationkey, [{", ".join(f"'{n}'" for n in NAMES_TR)}][(c_custkey * 7 % 10 + 1)::INT] AS first, c_custkey * 7 % 10 AS place FROM customer)
SELECT first || ' ' || lpad(c_custkey::VARCHAR, 9, '0') AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY place, c_custkey)::INT AS position FROM v""")
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with Turkish letters and their positions in the sorted list."""
    first = F.element_at(F.array(*map(F.lit, NAMES_TR)), (c("c_custkey") * 7 % 10 + 1).cast("int"))
    rows = fixture(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws(" ", first, F.lpad(c("c_custkey").cast("string"), 9, "0")).alias("name"))
    return usage.positions_tr(rows, "name", "c_nationkey").select("name", "position")


@registered("p12_resolve_location", "SELECT report_id, CASE WHEN report_id % 3 = 0 THEN n_name ELSE 'Rapor ' || user_id END AS city FROM fx_report JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filed(spark, sf_dir).select("report_id", c("user_id").alias("property_id"), F.concat(F.lit("Rapor "), c("user_id").cast("string")).alias("city"), F.lit("").alias("district"), F.lit(None).cast("string").alias("neighborhood"))
    homes = fixture(spark, sf_dir, "customer").join(fixture(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("property_id"), F.concat(F.lit(" "), c("n_name")).alias("city"), F.lit(" ").alias("district"), F.lit("x").alias("neighborhood"))
    rows = rows.withColumn("property_id", F.when(c("report_id") % 3 == 0, c("property_id")))
    return reports.resolve_location(rows, homes).select("report_id", "city")


@registered("p13_derive_subjects", """SELECT p_partkey AS report_id, CASE p_partkey % 3 WHEN 0 THEN 'land' WHEN 1 THEN 'commercial' ELSE 'residential' END AS category,
  CASE WHEN p_partkey % 4 = 0 THEN p_size::DOUBLE WHEN p_partkey % 3 = 0 THEN 500.0 WHEN p_size > 20 THEN p_size + 20.0 WHEN p_size > 5 THEN p_size + 5.0 ELSE 500.0 END AS subject_area, (p_partkey % 4)::VARCHAR || '+1' AS subject_room_text FROM part""")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "part")
    kind = F.when(c("p_partkey") % 3 == 0, "Tarla").when(c("p_partkey") % 3 == 1, "Dükkan").otherwise("Villa")
    base = rows.select(c("p_partkey").alias("report_id"), F.lit("").alias("report_type"), kind.alias("property_type"), F.lit("SALE").alias("valuation_type"))
    details = rows.select(
        c("p_partkey").alias("report_id"), F.when(c("p_partkey") % 4 == 0, c("p_size").cast("double")).alias("subject_area"), F.lit(500.0).alias("parcel_area"), F.when(c("p_size") > 20, c("p_size") + 20.0).otherwise(0.0).alias("gross_area"),
        F.when(c("p_size") > 5, c("p_size") + 5.0).otherwise(-1.0).alias("net_area"), F.lit(" ").alias("room_text"), (c("p_partkey") % 4).cast("int").alias("room_count"), F.lit(1).alias("salon_count"),
    )
    return reports.derive_subjects(base, details).select("report_id", "category", "subject_area", "subject_room_text")


@registered("p14_flatten_drafts", """SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Şehir ' || (o_custkey % 9) ELSE o_orderpriority END AS city, least(greatest(o_orderkey % 14, 1), 9)::INT AS step FROM orders""")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.struct(F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("Şehir "), (c("o_custkey") % 9).cast("string"))).alias("city"))
    rows = fixture(spark, sf_dir, "orders").select(c("o_orderkey").alias("report_id"), F.to_json(F.struct(nested.alias("property"), c("o_orderpriority").alias("city"), (c("o_orderkey") % 14).alias("step"))).alias("draft_json"))
    return reports.flatten_drafts(rows).select("report_id", "city", "step")


@registered("p15_sanitize", """SELECT p_partkey, (p_size * 1000 + 0.5)::DOUBLE AS net_area, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS floor, CASE WHEN p_size % 3 = 0 THEN 'Merkezi' END AS heating, NULL::VARCHAR AS usage_status, replace(p_name, ' ', '|') AS view_tags,
  replace(p_name, ' ', ', ') AS "view", CASE WHEN p_size % 4 = 0 THEN 'Kuzey' ELSE 'Güney, Doğu' END AS facade, p_size % 2 = 0 OR p_size % 3 = 0 AS has_sports_area, p_size % 5 = 0 AS is_site FROM part""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = c("p_size")
    rows = fixture(spark, sf_dir, "part").select(
        "p_partkey", F.concat(size.cast("string"), F.lit(".000,5 m²")).alias("net_area_text"), F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(". kat"))).otherwise("zemin").alias("floor_text"), F.when(size % 3 == 0, " Merkezi ").otherwise("").alias("heating"),
        F.lit("  ").alias("usage_status"), F.regexp_replace("p_name", " ", " , ,").alias("view_csv"), F.lit("Güney, ,Doğu").alias("facade_csv"), F.when(size % 4 == 0, "Kuzey").alias("facade"),
        (size % 2 == 0).alias("has_sports_area"), (size % 3 == 0).alias("has_fitness_center"), (size % 5 == 0).alias("is_site"),
    )
    return reports.sanitize_details(rows).select("p_partkey", "net_area", "floor", "heating", "usage_status", F.array_join("view_tags", "|").alias("view_tags"), "view", "facade", "has_sports_area", "is_site")


@registered("p15_sanitize_clients", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '@x.example' END AS email, CASE WHEN c_custkey % 5 = 0 THEN 'iki kelime' END AS note FROM customer")
def p15_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = c("c_custkey")
    rows = fixture(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 > 0, F.concat(F.lit("  "), c("c_name"), F.lit(" "))).otherwise(" ").alias("full_name"), F.when(key % 2 == 0, F.concat(F.upper("c_name"), F.lit("@X.example "))).alias("email"), F.when(key % 5 == 0, " iki   kelime ").alias("note"))
    return reports.sanitize_clients(rows)


@registered("p11_apply_id_lists", "SELECT l_orderkey AS report_id, l_linenumber AS item_no, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 AND (l_orderkey % 2 = 1 OR l_linenumber IN (1, 3)) GROUP BY 1, 2")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixture(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("report_id"), c("l_linenumber").cast("string").alias("item_id"), (c("l_orderkey") % 2 == 0).alias("from_storage"))
    lists = items.select("report_id").distinct().select("report_id", F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("included"), F.array(F.lit("2")).alias("excluded"))
    return reports.apply_id_lists(items, lists).groupBy("report_id", c("item_id").cast("int").alias("item_no")).agg(F.count(F.lit(1)).alias("n"))


@registered("p19_stored_comparables", "SELECT listing_uid, price, CASE WHEN provider_rank = 0 THEN 2.5 ELSE 1.2 END::DOUBLE AS distance_km, CASE WHEN provider_rank <> 1 THEN 3.0 END::DOUBLE AS floor, CASE WHEN provider_rank = 1 THEN 'Zemin' END AS floor_text FROM fx_listing")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_listing").select("listing_uid", F.concat(F.regexp_replace(F.format_number("price", 0), ",", "."), F.lit(" TL")).alias("price_text"), F.when(c("provider_rank") == 0, 2.5).alias("distance_km"), F.lit(1200.0).alias("distance_m"), F.when(c("provider_rank") == 1, "Zemin").otherwise("3").alias("floor_raw"))
    return reports.normalize_stored_comparable(rows).select("listing_uid", "price", "distance_km", "floor", "floor_text")


@registered("p20_pricing_record", """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS price, o_orderkey % 3 = 0 AS rental, o_orderkey % 5 > 0 AS noted, o_orderpriority FROM orders)
SELECT o_orderkey, price AS expected_price, price AS avg_price, CASE WHEN rental THEN 'RENTAL' ELSE 'SALE' END AS valuation_type, CASE WHEN noted THEN o_orderpriority END AS note, CASE WHEN rental THEN 'Hızlı Kiralama' ELSE 'Hızlı Satış' END AS low_label,
  CASE WHEN rental THEN '1-2 ay' ELSE '6-12 ay' END AS high_time, CASE WHEN NOT rental THEN floor(price * 0.0042::DOUBLE / 1000 + 0.5) * 1000 END AS rent_expected FROM p""")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderkey") % 2 == 0, c("o_totalprice")).alias("expected_price"), (c("o_totalprice") + 1).alias("avg_price"), F.lit(None).cast("double").alias("expected_sqm"), F.lit(1.0).alias("avg_sqm"), F.when(c("o_orderkey") % 3 == 0, "kiralık").otherwise("satılık").alias("valuation_type"), F.when(c("o_orderkey") % 5 > 0, F.concat(F.lit("  "), c("o_orderpriority"), F.lit("\n"))).otherwise(" ").alias("note"))
    return reports.pricing_record(rows).select("o_orderkey", "expected_price", "avg_price", "valuation_type", "note", "low_label", "high_time", "rent_expected")


@registered("f29_merge_json", """SELECT o_orderkey, '{"a":' || CASE WHEN o_orderkey % 2 = 0 THEN '"9"' ELSE '"1"' END || ',"b":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"2"' END || '}' AS merged FROM orders""")
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = F.concat(F.lit("{"), F.concat_ws(",", F.when(c("o_orderkey") % 2 == 0, F.lit('"a":"9"')), F.when(c("o_orderkey") % 3 == 0, F.lit('"b":null'))), F.lit("}"))
    return fixture(spark, sf_dir, "orders").select("o_orderkey", reports.merge_json(F.lit('{"a":"1","b":"2"}'), incoming).alias("merged"))


@registered("f30_summary_text", f"""WITH v AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS s_suppkey,
  CASE WHEN k % 3 = 0 THEN '500 m içinde 2 okul, 1 market bulundu. En yakın okul 1,3 km; En yakın market 400 m.' WHEN k % 3 = 1 THEN 'En yakın okul 90 m.' ELSE '500 m içinde OSM üzerinde belirgin POI kaydı bulunamadı.' END AS poi,
  CASE WHEN k % 2 = 0 THEN 'En yakın otobüs durağı ' || (k % 900 + 1) || ' m (Durak).' ELSE 'Yakın çevrede OSM/IETT üzerinde ulaşım durağı tespit edilemedi.' END AS transport,
  CASE WHEN k % 4 = 0 THEN 'Mah için kayıtlı nüfus profili bulunamadı.' ELSE 'Mah 2024 nüfusu 12.345 kişi' || CASE WHEN k % 4 = 1 THEN '; erkek 6.000, kadın 6.345' ELSE '' END || '.' || CASE WHEN k % 4 = 2 THEN ' İlçe nüfusu ilçe nüfusu 1.234.567 kişi; mahalle ilçe nüfusunun yaklaşık 1,0%''ini oluşturuyor.' ELSE '' END END AS profile,
  'Konum skoru ' || (k % 100) || '/100 (Orta). ' || CASE WHEN k % 5 = 0 THEN 'Öne çıkan erişimler: raylı sistem 800 m (güçlü), otobüs durağı 500 m (iyi), park 1,0 km (orta). ' ELSE '' END || '{reports.SCORE_HINT}' AS score,
  CASE WHEN k % 2 = 0 THEN 'Gerekçe' || chr(10) ELSE '' END || chr(10) || 'Varsayımlar:' || chr(10) || '- a' || chr(10) || '- b' AS note FROM v""")
def f30(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = c("s_suppkey"), F.lit(None).cast("double")
    rows = fixture(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(k % 3 == 0, 2.0).alias("school_within_500"), F.when(k % 3 == 0, 1.0).alias("market_within_500"), F.when(k % 3 == 0, 1250.0).when(k % 3 == 1, 90.0).alias("school_nearest_m"), F.when(k % 3 == 0, 400.0).alias("market_nearest_m"),
        F.when(k % 2 == 0, (k % 900 + 1).cast("double")).alias("bus_nearest_m"), F.lit("Durak").alias("bus_nearest_name"), F.lit("Mah").alias("neighborhood"), F.when(k % 4 == 2, "İlçe nüfusu").alias("district"), F.lit(2024).alias("year"), F.when(k % 4 > 0, 12345.0).alias("population_total"),
        F.when(k % 4 == 1, 6000.0).alias("population_male"), F.when(k % 4 == 1, 6345.0).alias("population_female"), F.when(k % 4 == 2, 1234567.0).alias("district_population"), F.when(k % 4 == 2, 0.9999).alias("district_share_pct"),
        (k % 100).alias("score"), F.lit("Orta").alias("label"), *[x for f, m in (("rail", 800.0), ("bus", 500.0), ("market", None), ("pharmacy", None), ("school", None), ("park", 1000.0)) for x in (F.when((k % 5 == 0) & F.lit(m is not None), F.lit(m)).otherwise(none).alias(f"{f}_m"), F.when((k % 5 == 0) & F.lit(m is not None), 1).otherwise(0).alias(f"{f}_points"))],
    )
    note = policy.answer_note(F.when(k % 2 == 0, "Gerekçe"), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"))
    return rows.select("s_suppkey", reports.poi_summary(rows).alias("poi"), reports.transport_summary(rows).alias("transport"), reports.profile_summary().alias("profile"), reports.score_summary().alias("score"), note.alias("note"))


@registered("f17_price_index", """WITH v AS (SELECT o_orderkey AS k, floor(o_totalprice) AS p, (o_orderkey % 100 + 50)::DOUBLE AS area FROM orders)
SELECT k AS o_orderkey, floor(CASE WHEN k % 4 = 1 THEN p ELSE p * 0.88::DOUBLE END / 1000 + 0.5) * 1000 AS min_price, floor(p / 1000 + 0.5) * 1000 AS avg_price, floor(CASE WHEN k % 4 = 2 THEN p * 2 ELSE p * 1.12::DOUBLE END / 1000 + 0.5) * 1000 AS max_price, floor(p / area + 0.5) AS avg_sqm,
  CASE k % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 0.017 ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN k % 2 = 0 THEN 365.0 ELSE 7.0 END::DOUBLE AS expected_sale_days, CASE WHEN k % 2 = 0 THEN 25.0 ELSE 3.5 END::DOUBLE AS discount_to_sell_fast_pct,
  12::INT AS n_comps, CASE WHEN k % 2 = 0 THEN 1250000.0 ELSE 1.5 END::DOUBLE AS comp_price, 'a|b' AS assumptions, CASE WHEN k % 5 = 0 THEN 'Yüksek' END AS competition FROM v""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = c("o_orderkey"), F.floor("o_totalprice")
    part = lambda name, x: F.concat(F.lit(f', "{name}": '), x)
    comp = F.concat(F.lit('{"title": " x ", "price": '), F.when(k % 2 == 0, '"1.250.000 TL"').otherwise("1.5"), F.lit("}"))
    text = F.concat(
        F.lit('Tahmin şöyle: {"avgPrice": '), price.cast("string"), F.when(k % 4 == 1, part("minPrice", (price * 3).cast("string"))).otherwise(""), F.when(k % 4 == 2, part("maxPrice", F.concat(F.lit('"'), (price * 2).cast("string"), F.lit(',0 TL"')))).otherwise(""),
        part("confidence", F.when(k % 3 == 0, "85").when(k % 3 == 1, "1.7").otherwise('"0,4"')), part("expectedSaleDays", F.when(k % 2 == 0, "900").otherwise('"2 gün"')), part("discountToSellFastPct", F.when(k % 2 == 0, "40").otherwise("3.5")),
        part("comps", F.concat(F.lit("["), F.array_join(F.array_repeat(comp, 15), ","), F.lit("]"))), F.lit(', "assumptions": [" a ", "", "b"]'), F.when(k % 5 == 0, F.lit(', "marketProjection": {"competitionStatus": " Yüksek "}')).otherwise(', "marketProjection": {}'), F.lit("} umarım yardımcı olur"),
    )
    rows = dealt_out(fixture(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), times=16).select("o_orderkey", text.alias("answer"), (k % 100 + 50).cast("double").alias("area"))
    found = policy.normalize_price_index(rows, "answer", "area")
    return found.select(
        "o_orderkey", "min_price", "avg_price", "max_price", "avg_sqm", "confidence", "expected_sale_days", "discount_to_sell_fast_pct", F.size("comps").alias("n_comps"), F.element_at("comps", 1)["price"].alias("comp_price"),
        F.array_join("assumptions", "|").alias("assumptions"), c("market_projection.competitionStatus").alias("competition"),
    )


@registered("j7_directory", "SELECT DISTINCT r_name AS district, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'Ek ' || r_name FROM region")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelforge.plans.fixtures import query

    names = query(spark, sf_dir, "select r_name as district, n_name as name from nation join region on r_regionkey = n_regionkey")
    extra = names.select("district", F.upper(F.concat(F.lit(" "), c("name"))).alias("name")).union(names.select("district", F.concat(F.lit("Ek "), c("district")).alias("name")))
    return media.directory_with_supplements(names, extra)


@registered("u5_unique_images", "SELECT listing_uid, count(*) AS images, max(p) AS best FROM (SELECT listing_uid, 60 AS p FROM fx_listing WHERE image_url IS NOT NULL UNION ALL SELECT listing_uid, 100 FROM fx_listing WHERE image_url IS NOT NULL) GROUP BY 1")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_listing").where("image_url is not null")
    urls = F.array(F.concat(c("image_url"), F.lit("?listing=1")), F.concat(c("image_url"), F.lit("#photo")), F.lit("https://imaj.emlakjet.com/resize/100/200/a.jpg"), F.lit("https://imaj.emlakjet.com/resize/300/400/a.jpg?x=1"))
    ranked = media.unique_images(rows.select("listing_uid", F.posexplode(urls).alias("ord", "url")))
    return ranked.groupBy("listing_uid").agg(F.count(F.lit(1)).alias("images"), F.max("priority").alias("best"))


@registered("j8_reusable_images", """WITH s AS (SELECT source_url, image_url, created_at FROM fx_listing WHERE image_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY created_at DESC, image_url) = 1)
SELECT l.listing_uid AS item_id, s.image_url AS reused_image FROM fx_listing l LEFT JOIN s ON l.source_url = s.source_url WHERE l.image_url IS NULL""")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_listing")
    items = rows.where("image_url is null").select(c("listing_uid").alias("item_id"), F.lit(None).cast("string").alias("source_url"), c("source_url").alias("listing_url"))
    return media.reusable_images(items, rows.select("source_url", F.lit(None).cast("string").alias("listing_url"), "image_url", c("created_at").alias("updated_at"))).select("item_id", "reused_image")


@registered("w10_fill_images", """WITH i AS (SELECT l_orderkey AS subject_id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_id, l_returnflag FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY item_id) AS k FROM i WHERE l_returnflag = 'R')
SELECT subject_id, item_id, NULL AS fill_url FROM i WHERE l_returnflag <> 'R' UNION ALL SELECT subject_id, item_id, CASE WHEN k <= 2 THEN 'https://pool.example/photo' || k || '.jpg' END FROM k""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = fixture(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("subject_id"), F.row_number().over(w).alias("item_id"), F.when(c("l_returnflag") != "R", "https://pool.example/used.jpg?x=1").alias("image_url")).withColumn("ord", c("item_id"))
    urls = F.array(F.lit("https://pool.example/used.jpg"), F.lit("https://pool.example/photo2.jpg"), F.lit("https://pool.example/photo1.jpg"))
    pool = items.groupBy("subject_id").agg(F.count("image_url").alias("n")).select("subject_id", F.explode(F.when(c("n") > 0, urls).otherwise(F.slice(urls, 2, 2))).alias("url"), F.lit(10).alias("priority"))
    return media.fill_images(items, pool).select("subject_id", "item_id", "fill_url")


@registered("a8_area_coverage", "SELECT source, count(*) AS total, count(coalesce(net_area, CASE WHEN provider_rank = 0 THEN gross_area END)) AS with_area, floor(count(coalesce(net_area, CASE WHEN provider_rank = 0 THEN gross_area END)) / count(*) * 100 + 0.5) AS pct, count(*) FILTER (net_area IS NULL AND provider_rank = 0) AS enriched FROM fx_listing GROUP BY ROLLUP (source)")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_listing")
    before = rows.select(c("listing_uid").alias("item_id"), "source", c("net_area").alias("area"))
    after = rows.select(c("listing_uid").alias("item_id"), "source", F.coalesce("net_area", F.when(c("provider_rank") == 0, c("gross_area"))).alias("area"))
    return media.area_coverage(before, after)


@registered("f1_to_number_tr", "SELECT l_orderkey, l_linenumber, max(round(l_extendedprice, 2)) AS decimal_form, max(floor(l_extendedprice))::BIGINT AS thousands_form FROM lineitem GROUP BY 1, 2")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turkish = lambda x, n: F.translate(F.format_number(x, n), ",.", ".,")
    rows = fixture(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(turkish(c("l_extendedprice"), 2), F.lit(" TL")).alias("a"), F.concat(F.lit("₺ "), turkish(F.floor("l_extendedprice"), 0)).alias("b"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max(T.to_number_tr(c("a"))).alias("decimal_form"), F.max(T.to_number_tr(c("b"))).cast("long").alias("thousands_form"))


@registered("f2_f3_f4_folded_text", """WITH n AS (SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN ' cigdem ' WHEN 1 THEN ' sisli ' WHEN 2 THEN ' od z aeo angstrom ' ELSE ' koy ve yol lhasa ' END) AS folded FROM part)
SELECT p_partkey, folded, folded AS place, replace(folded, ' ', '') AS compact, replace(folded, ' ', '-') AS slug FROM n""")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turkish letters, the same ones decomposed, rare accents and letters that fold to nothing, signs."""
    k = c("p_partkey") % 4
    word = F.when(k == 0, "  ÇİĞDEM ").when(k == 1, f" {unicodedata.normalize('NFD', 'ŞİŞLİ')} ").when(k == 2, " ódłz āēō \u212bngstro\u0308m ").otherwise(" K'öy&yol ḹh̤aśa- ")
    name = F.concat(F.element_at(F.split(F.upper("p_name"), " "), 1), word, F.element_at(F.split(F.upper("p_name"), " "), 2))
    place = F.concat(name, F.lit(" Mahallesi"))
    return fixture(spark, sf_dir, "part").select("p_partkey", T.normalize_text(name).alias("folded"), T.normalize_location(place).alias("place"), T.normalize_location(place, compact=True).alias("compact"), T.slugify_tr(place).alias("slug"))


@registered("f5_f6_f7_types", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'land' WHEN 1 THEN 'commercial' ELSE 'residential' END AS category, CASE p_partkey % 5 WHEN 0 THEN 'tarla' WHEN 1 THEN 'dükkan' WHEN 2 THEN 'villa' ELSE 'daire' END AS search,
  CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END::DOUBLE AS age, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE p_size END::DOUBLE AS floor, p_size % 6 AS bedrooms, CASE WHEN p_size % 6 IN (2, 3, 4) THEN true ELSE false END AS compatible FROM part""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = c("p_partkey") % 5, c("p_size")
    kind = F.when(k == 0, "TARLA").when(k == 1, "Dükkan").when(k == 2, "Lüks Villa").otherwise("Daire")
    age = F.when(n % 4 == 0, "Sıfır Bina").otherwise(F.concat(n.cast("string"), F.lit(" yaşında")))
    floor = F.when(n % 3 == 0, "Bahçe Katı").when(n % 3 == 1, "Bodrum 2").otherwise(F.concat(n.cast("string"), F.lit(". Kat")))
    room = F.concat((n % 6).cast("string"), F.lit(" + 1"))
    category = T.property_category(F.lit(""), kind)
    return fixture(spark, sf_dir, "part").select("p_partkey", category.alias("category"), T.search_type(category, kind).alias("search"), T.building_age(F.lit(None).cast("double"), age).alias("age"), T.floor_value(floor).alias("floor"), T.parse_room(room)["bedrooms"].alias("bedrooms"), T.room_compatible(room, F.lit("3+1")).alias("compatible"))


@registered("f10_f25_dates_ids", "SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 9 HOUR AS parsed, 'x:' || substr(sha1('https://a.example/' || o_orderkey), 1, 16) AS external_id FROM orders")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "orders")
    return rows.select("o_orderkey", T.parse_date_tr(F.date_format("o_orderdate", "d.M.yyyy"), as_of()).cast("timestamp_ntz").alias("parsed"), T.external_id("x", F.concat(F.lit(" https://a.example/"), c("o_orderkey").cast("string"))).alias("external_id"))


@registered("f23_years_digits", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2019 ELSE 2010 + o_orderkey % 10 END AS year, o_custkey * 1000.0::DOUBLE AS digits FROM orders")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(c("o_orderkey") % 2 == 0, F.lit("2019 yılı nüfusu, 2035 tahmini")).otherwise(F.concat(F.lit("1999, 2003 ve "), (2010 + c("o_orderkey") % 10).cast("string")))
    return fixture(spark, sf_dir, "orders").select("o_orderkey", T.infer_year(text).alias("year"), T.digits_number(F.concat(c("o_custkey").cast("string"), F.lit(".000 kişi"))).alias("digits"))


@registered("f26_identities", "SELECT c_custkey, '+905' || lpad((c_custkey % 1000000000)::VARCHAR, 9, '0') AS phone, true AS phone_ok, lower(c_mktsegment) || '@mail.example' AS email, true AS email_ok FROM customer")
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.concat(F.lit("5"), F.lpad(c("c_custkey").cast("string"), 9, "0"))
    phone = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("0"), tail)).when(c("c_custkey") % 3 == 1, F.concat(F.lit("+90 "), tail)).otherwise(tail)
    email = F.concat(F.lit(" "), c("c_mktsegment"), F.lit("@Mail.example "))
    return fixture(spark, sf_dir, "customer").select("c_custkey", T.normalize_phone(phone).alias("phone"), T.phone_valid(phone).alias("phone_ok"), T.normalize_email(email).alias("email"), T.email_valid(email).alias("email_ok"))


@registered("f27_source_codes", "SELECT listing_uid, CASE source WHEN 'Sahibinden' THEN 'SEARCH_THUMBNAIL' WHEN 'Emlakjet' THEN 'SEARCH_THUMBNAIL' WHEN 'Hepsiemlak' THEN 'PAGE_GALLERY' ELSE 'UNKNOWN' END AS image_code, CASE source WHEN 'Hepsiemlak' THEN 'HTML_VISIBLE_TEXT' ELSE 'UNKNOWN' END AS field_code FROM fx_listing")
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(c("source") == "Hepsiemlak", "PAGE_LIST").otherwise("?")
    return fixture(spark, sf_dir, "fx_listing").select("listing_uid", T.image_source_code(said, c("source")).alias("image_code"), T.field_source_code(said).alias("field_code"))
