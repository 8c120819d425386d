"""Queries that land raw feeds and pages.  The raw text is derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.operators import openstats
from parcelforge.plans.fixtures import fixture, work_folder
from parcelforge.plans.registry import registered
from parcelforge.plans.valuation import REASON, as_of, raw_feed
from parcelforge.sources import feeds, pages
from parcelforge.streaming import ingest

c = F.col
s = F.lit


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_listing")


@registered("s1_read_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelforge.sources.tables import read_table

    return read_table(spark, "customer", f"{sf_dir}/customer.parquet").groupBy("c_mktsegment").agg(F.count(s(1)).alias("n"))


@registered("s2_search_feed", "SELECT 'remax:' || listing_uid AS external_id, title, price, CASE WHEN provider_rank = 0 THEN gross_area END AS net_area, CASE WHEN provider_rank <> 0 THEN gross_area END AS gross_area, room_text, building_age::DOUBLE AS building_age, floor(price / gross_area + 0.5) AS price_per_sqm FROM fx_listing WHERE image_url IS NOT NULL")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.array(F.struct(s(2).alias("languageId"), s("other").alias("text")), F.struct(s(1).alias("languageId"), c("title").alias("text")))
    raw = F.struct(
        c("listing_uid").alias("code"), titles.alias("title"), F.struct(c("price").alias("amount"), s("₺").alias("amountTypeSymbol")).alias("priceInfo"), c("gross_area").alias("m2Area"), F.when(c("provider_rank") == 0, "Net m²").otherwise("Brüt m²").alias("m2AreaAttributeName"),
        F.regexp_replace("room_text", r"\+", " + ").alias("roomOptions"), F.create_map(s("140"), (2001 - c("building_age")).cast("string")).alias("attributes"), s("3. Kat").alias("floor"), F.array(c("image_url")).alias("images"),
    )
    rows = listings(spark, sf_dir).select(F.to_json(raw).alias("value"))
    return feeds.normalize_search_feed(rows, as_of()).select("external_id", "title", "price", "net_area", "gross_area", "room_text", c("building_age").cast("double").alias("building_age"), "price_per_sqm")


@registered("s3_crawl_feed", "SELECT source_url, title, price, net_area, gross_area, building_age::DOUBLE AS building_age, floor(price / gross_area + 0.5) AS price_per_sqm FROM fx_listing WHERE image_url IS NOT NULL")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = c("provider_rank") == 1
    raw = F.struct(
        F.when(odd, c("source_url")).alias("url"), F.when(~odd, c("source_url")).alias("listingUrl"), F.when(odd, c("title")).alias("name"), F.when(~odd, c("title")).alias("title"),
        F.when(~odd, F.concat(F.regexp_replace(F.format_number("price", 0), ",", "."), s(" TL"))).alias("price"), F.when(odd, c("price").cast("long").cast("string")).alias("priceAmount"), F.when(odd, c("gross_area").cast("string")).alias("grossSize"), F.array(c("image_url")).alias("images"), c("net_area").cast("string").alias("netSize"),
        F.create_map(s("Brüt m²"), c("gross_area").cast("int").cast("string"), s("Binanın Yaşı"), F.concat(c("building_age").cast("string"), s(" yaş"))).alias("specifications"),
    )
    rows = listings(spark, sf_dir).select(F.to_json(raw).alias("value"))
    return feeds.normalize_crawl_feed(rows, as_of()).select("source_url", "title", "price", "net_area", "gross_area", "building_age", "price_per_sqm")


@registered("s4_listing_cards", """WITH one AS (SELECT l_orderkey AS o, l_linenumber AS n, max(floor(l_extendedprice)) AS price, (max(l_quantity) + 20)::DOUBLE AS gross_area FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1, 2)
SELECT 'https://www.hepsiemlak.com/x/' || o || '-' || n AS source_url, 'x/' || o || '-' || n AS source_listing_id, price, gross_area, CASE (o + n) % 4 WHEN 3 THEN '3+1' ELSE '2+1' END AS room_text, CASE (o + n) % 4 WHEN 2 THEN 'Deniz manzaralı güzel daire' ELSE 'Ev & Bahçe' END AS title,
  'https://hecdn.example/a.jpg' AS image_url, CASE WHEN o % 2 = 0 THEN 1234.0 ELSE count(*) OVER (PARTITION BY o) END::DOUBLE AS record_count FROM one""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of four shapes: links by class or the first one, attributes in any order, inner lists, photos among logos and foreign ones; cards without a photo of the site."""
    one = fixture(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.floor("l_extendedprice")).alias("p"), (F.max("l_quantity") + 20).cast("int").alias("a"))
    key, shape = F.concat(s("/x/"), c("l_orderkey").cast("string"), s("-"), c("l_linenumber").cast("string")), (c("l_orderkey") + c("l_linenumber")) % 4
    inner = F.concat(s("<a title='Ev &amp; Bahçe' href='"), key, s("' class='k listingView__card-link'></a>\n<ul class='tags'><li>Foto</li>\n<li>Video</li></ul>"))
    plain = F.concat(s('<a href="'), key, s('"><b>git</b></a>\nDeniz manzaralı güzel daire'))
    link = F.when(shape == 1, inner).when(shape == 2, plain).otherwise(F.concat(s('<a class="listingView__card-link" href="'), key, s('" title="Ev &amp; Bahçe"></a>')))
    photo = F.when(shape == 1, "<img src='https://img.example/no.jpg'><img src='https://hecdn.example/a.jpg'>").when(shape == 2, '<img srcset="https://hecdn.example/a.jpg 1x, b.jpg 2x">').when(shape == 3, '<img src="https://hecdn.example/a.jpg" data-src="https://hecdn.example/logo/x.png">').otherwise('<img data-src="https://hecdn.example/a.jpg"/>')
    photo = F.when(c("l_orderkey") % 11 == 0, '<img src="https://img.example/a.jpg">').otherwise(photo)
    card = F.concat(
        s("<li data-x='>' class=\"box listing-item\">"), link, s('\n<span class="list-view-price">'), F.regexp_replace(F.format_number("p", 0), ",", "."), s(" TL</span><!-- <li> -->\n<span>Oda Sayısı</span>\n<span>"), F.when(shape == 3, "3 +\n1").otherwise("2 + 1"),
        s("</span>\n<span>Brüt m²</span>\n<span>"), c("a").cast("string"), s("</span>\n<span>Bina Yaşı</span>\n<span>5</span>\n"), photo, s("\n<b>05.03.2024</b></li>"),
    )
    said = F.when(c("page_id") % 2 == 0, "<p>Konak için 1.234 ilan bulundu</p>").otherwise("")
    html = one.groupBy(c("l_orderkey").alias("page_id")).agg(F.array_join(F.collect_list(card), "\n").alias("cards")).select("page_id", F.concat(s("<body>"), said, s("<ul>"), c("cards"), s("</ul></body>")).alias("html"))
    return pages.extract_listing_cards(html, as_of()).select("source_url", "source_listing_id", "price", "gross_area", "room_text", "title", "image_url", "record_count")


def population_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: rows with labelled cells, with and without a link, or with bare cells in a table with an id; half of them name their city in their breadcrumbs alone."""
    tr = lambda x: F.regexp_replace(F.format_number(x, 0), ",", ".")
    n = fixture(spark, sf_dir, "customer").groupBy("c_nationkey", (c("c_custkey") % 8).alias("q")).agg((F.count(s(1)) * 1000).alias("pop"))
    name = F.concat(s("Mah "), c("q").cast("string"))
    linked = F.when(c("q") % 2 == 0, F.concat(s("<a href='/"), (c("c_nationkey") * 10 + c("q")).cast("string"), s("-x'>"), name, s("</a>"))).otherwise(name)
    labelled = F.concat(s("<tr><td data-label='MAHALLE ADI'>"), linked, s("</td><td data-label='TOPLAM NÜFUS'>"), tr("pop"), s("</td><td data-label='ERKEK NÜFUS'>1</td></tr>"))
    bare = F.concat(s("<tr><td>"), linked, s("</td><td>"), tr("pop"), s("</td><td>1</td><td>2</td></tr>"))
    row = F.when(c("c_nationkey") % 3 == 0, bare).otherwise(labelled)
    d = n.groupBy("c_nationkey").agg(F.array_join(F.collect_list(row), "\n").alias("rows"), F.sum("pop").alias("total")).join(fixture(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    table = F.when(c("c_nationkey") % 3 == 0, "<table id='ust_tablo'><tr><th>Ad</th></tr>").otherwise("<table>")
    crumbs = "<ul class='x breadcrumb'><li><a>Türkiye</a><li><a>İzmir Nüfusu</a></ul>"
    item = lambda label, value: F.concat(s(f"<li><span class='dtColOne'>{label}</span><span data-x='1' class='w dtColTwo'>"), value, s("</span>"))
    summary = F.concat(s("<div class='boxDetaylar'><ul>"), item("Belde Toplam Nüfus", s("1")), item("Toplam N&uuml;fus", tr("total")), item("Mahalle Sayısı", s("8")), s("</ul></div>"))
    html = F.concat(s(crumbs), s("<p>Konak ilçesinin 2023 ilçe toplam nüfusu, 2025 tahmini</p>"), summary, table, c("rows"), s("<tr><td data-label='MAHALLE ADI'>Boş</td></tr></table>"))
    return d.select(F.when(c("c_nationkey") % 2 == 0, "İzmir").alias("city"), c("n_name").alias("district"), html.alias("html"), F.concat(s("https://x.example/"), c("c_nationkey").cast("string")).alias("url"))


POPULATION_SQL = """n AS (SELECT c_nationkey AS k, c_custkey % 8 AS q, count(*) * 1000 AS pop FROM customer GROUP BY 1, 2), recs AS (
  SELECT n_name AS district, 'Mah ' || q AS neighborhood, 'NEIGHBORHOOD' AS location_level, pop::DOUBLE AS population_total, NULL::DOUBLE AS neighborhood_count, CASE WHEN k % 3 = 0 THEN 2.0 END::DOUBLE AS population_female,
    'nufusune:' || CASE WHEN q % 2 = 0 AND k % 3 <> 0 THEN (k * 10 + q)::VARCHAR ELSE 'izmir:' || replace(lower(n_name), '_', '-') || ':mah-' || q END AS source_key, CASE WHEN q % 2 = 0 AND k % 3 <> 0 THEN 'https://www.nufusune.com/' || (k * 10 + q) || '-x' ELSE 'https://x.example/' || k END AS source_url FROM n JOIN nation ON n_nationkey = k
  UNION ALL SELECT n_name, NULL, 'DISTRICT', sum(pop)::DOUBLE, 8.0, NULL, 'nufusune:izmir:' || replace(lower(n_name), '_', '-'), 'https://x.example/' || k FROM n JOIN nation ON n_nationkey = k GROUP BY n_name, k)"""


@registered("s5_population_pages", f"WITH {POPULATION_SQL} SELECT district, neighborhood, location_level, 2023 AS year, population_total, neighborhood_count, population_female, source_key, source_url FROM recs")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_population_pages(population_pages(spark, sf_dir)).select("district", "neighborhood", "location_level", "year", "population_total", "neighborhood_count", "population_female", "source_key", "source_url")


@registered("s5_f22_s8_import", f"""WITH {POPULATION_SQL}, m AS (SELECT source_key, 'population_total' AS metric_key, population_total AS metric_value FROM recs UNION ALL SELECT source_key, 'neighborhood_count', neighborhood_count FROM recs UNION ALL SELECT source_key, 'population_female', population_female FROM recs
  UNION ALL SELECT source_key, 'population_male', 1.0 FROM recs WHERE location_level = 'NEIGHBORHOOD')
SELECT source_key, metric_key, CASE WHEN metric_key = 'population_total' AND source_key LIKE 'nufusune:izmir:nation-1%' THEN -1.0 ELSE metric_value END AS metric_value FROM m WHERE metric_value IS NOT NULL""")
def s5_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to metric rows, inserted beside rows that are there already."""
    rows = openstats.unpivot_metrics(pages.parse_population_pages(population_pages(spark, sf_dir)))
    there = rows.where("metric_key = 'population_total' and source_key like 'nufusune:izmir:nation-1%'").withColumn("metric_value", s(-1.0))
    return openstats.upsert_metrics(there, rows).select("source_key", "metric_key", "metric_value")


@registered("s6_location_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\s[^>]*href=["''][^"'']+["''][^>]*>.*?</a>')) AS link, generate_subscripts(regexp_extract_all(html, '(?s)<a\s[^>]*href=["''][^"'']+["''][^>]*>.*?</a>'), 1) AS pos FROM pages),
t AS (SELECT page_id, pos, regexp_extract(link, 'href=["'']([^"'']+)["'']', 1) AS url, replace(replace(replace(replace(replace(replace(regexp_replace(link, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS raw FROM l)
SELECT url, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM t WHERE trim(regexp_replace(raw, '\s+', ' ', 'g')) <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_location_links(fixture(spark, sf_dir, "pages").select("page_id", "html"))


@registered("f24_page_facts", """SELECT listing_uid AS page_id, image_url || '?a=1&b=2' AS image_url, CASE WHEN image_url IS NOT NULL THEN CASE provider_rank WHEN 2 THEN 'json-ld' ELSE 'og:image' END END AS image_source,
  CASE WHEN provider_rank = 0 THEN gross_area ELSE floor(coalesce(net_area, gross_area) + 0.5) END AS area, coalesce(room_text, '4') AS room_text FROM fx_listing""")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in meta tags, attributes in either order, or in JSON; JSON plain or escaped; areas in JSON alone, or in words of three forms behind larger ones."""
    rank, url = c("provider_rank"), F.concat(c("image_url"), s("?a=1&amp;b=2"))
    meta = F.when(rank == 0, F.concat(s('<meta property="og:image" content="'), url, s('">'))).when(rank == 1, F.concat(s("<META content='"), url, s("' name='twitter:card'/><meta content='"), url, s("' data-x='>' property='og:image'/>")))
    escaped = F.replace(F.concat(s('{"@graph": [{"numberOfRooms": 4, "floorSize": {"value": '), c("gross_area").cast("string"), s("}}]}")), s('"'), s("&quot;"))
    image = F.when(c("image_url").isNotNull(), F.concat(s(', "image": ["", {"contentUrl": "'), url, s('"}]')))
    plain = F.concat(s('{"numberOfRooms": "4", "floorSize": 7'), F.when(rank == 2, F.coalesce(image, s(""))).otherwise(""), s("}"))
    ld = F.concat(s("<script data-x type='application/ld+json'>"), F.when(rank == 0, escaped).otherwise(plain), s("</script><script>var x = '900 m² <b>';</script><!-- net 901 m² -->"))
    whole = lambda x: c(x).cast("int").cast("string")
    net = F.concat(s("<p>Net&nbsp;"), F.when(rank == 1, "Alanı: ").otherwise(""), whole("net_area"), s("<i> m²</i>.</p>"))
    body = F.when(rank > 0, F.concat_ws(" ", F.concat(s("<p>Brüt alanı "), whole("gross_area"), s(" metrekare, 5 m2x</p>")), net))
    return pages.extract_page_facts(listings(spark, sf_dir).select(c("listing_uid").alias("page_id"), F.concat_ws("", meta, ld, body, F.concat(s("<b>"), F.regexp_replace("room_text", r"\+", " + "), s("</b>"))).alias("html")))


def stop_responses(rows: DataFrame) -> DataFrame:
    """(value) raw SOAP responses with the stops of 1,000 consecutive poi_id each, so that there are more of them, not longer ones, with more stops."""
    x, y = ((s(290000) + c("poi_id") * 1931 % 4000) / 10000).cast("string"), ((s(410000) + c("poi_id") * 37 % 4000) / 10000).cast("string")
    point = F.when(c("poi_id") % 7 == 0, "POINT (x)").otherwise(F.concat(s("POINT ("), x, s(" "), y, s(")")))
    stops = F.struct(c("poi_id").cast("string").alias("SDURAKKODU"), s("Durak & \"Ev\"").alias("SDURAKADI"), point.alias("KOORDINAT"))
    packed = rows.groupBy(F.floor(c("poi_id") / 1000).alias("g")).agg(F.to_json(F.collect_list(stops)).alias("j"))
    escaped = c("j")
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, s(char), s(entity))
    return packed.select(F.concat(s("<soap:Body><GetDurakResult>"), escaped, s("</GetDurakResult></soap:Body>")).alias("value"))


@registered("s9_stops", "SELECT event_id::VARCHAR AS code, (290000 + event_id * 1931 % 4000) / 10000 AS lon, (410000 + event_id * 37 % 4000) / 10000 AS lat FROM events WHERE event_id % 7 <> 0")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_poi")
    return feeds.parse_stops(stop_responses(rows)).select("code", "lon", "lat")


@registered("s10_index_points", "SELECT series || ':' || month_idx AS date, value_cents / 100 AS value FROM fx_series")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(s('{"Tarih": "'), c("series"), s(":"), c("month_idx").cast("string"), s('", "UNIXTIME": "1", "TP_HKFE01": "'), F.regexp_replace((c("value_cents") / 100).cast("decimal(20,2)").cast("string"), r"\.", ","), s('"}'))
    packed = fixture(spark, sf_dir, "fx_series").groupBy("series").agg(F.concat(s('{"items": ['), F.array_join(F.collect_list(item), ","), s("]}")).alias("value"))
    return feeds.parse_index_points(packed.select("value"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.readiness(listings(spark, sf_dir).withColumns({"subject_area": s(100.0), "floor": F.when(c("provider_rank") == 0, 1.0)}))


READY = """WITH r AS (SELECT listing_uid, room_text IS NOT NULL AS room, image_url IS NOT NULL AS image, building_age IS NOT NULL AS age, provider_rank = 0 AS fl, coalesce(net_area, gross_area) > 10 AND coalesce(net_area, gross_area) / 100.0 BETWEEN CASE category WHEN 'land' THEN 0.35 WHEN 'commercial' THEN 0.5 ELSE 0.65 END AND CASE category WHEN 'land' THEN 3.0 WHEN 'commercial' THEN 2.0 ELSE 1.5 END AS fits FROM fx_listing)"""


@registered("a13_feed_readiness", READY + " SELECT count(*) AS total, count(*) AS has_price, count(*) AS has_area, count(*) FILTER (room) AS has_room, count(*) FILTER (image) AS has_image, count(*) AS has_url, count(*) FILTER (fits) AS area_fits, count(*) AS has_district, count(*) FILTER (age) AS has_age, count(*) FILTER (fl) AS has_floor, count(*) FILTER (room AND image AND fits) AS ready FROM r")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_readiness(listings(spark, sf_dir).withColumns({"subject_area": s(100.0), "floor": F.when(c("provider_rank") == 0, 1.0)}))


@registered("t8_top_samples", READY + " SELECT listing_uid, (4 + room::INT + image::INT + fits::INT + age::INT + fl::INT)::INT AS readiness FROM r ORDER BY readiness DESC, listing_uid LIMIT 10")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.top_samples(scored(spark, sf_dir)).select("listing_uid", "readiness")


@registered("p18_crawl_frontier", """WITH v AS (SELECT subject_id, CASE WHEN subject_id % 5 = 0 THEN NULL ELSE regexp_replace(neighborhood, '^Mah ', '') END AS n, replace(lower(district), '_', '-') AS d, replace(lower(city), ' ', '-') AS t, CASE category WHEN 'land' THEN 'arsa' WHEN 'commercial' THEN 'isyeri' ELSE CASE WHEN subject_id % 3 = 0 THEN 'mustakil-ev' ELSE 'daire' END END AS k,
  CASE WHEN subject_id % 2 = 0 THEN 'kiralik' ELSE 'satilik' END AS a FROM fx_subject),
p AS (SELECT subject_id, unnest(list_filter([n, d || '-' || n, d, t], lambda x: x IS NOT NULL)) AS place, a, k FROM v)
SELECT subject_id, 'https://www.hepsiemlak.com/' || place || u.part || '?sortField=PRICE&sortDirection=ASC' AS url FROM p, (SELECT unnest([0, 1, 2]) AS i) x, LATERAL (SELECT CASE i WHEN 0 THEN '-' || a || '/' || k WHEN 1 THEN '-' || a ELSE '/' || k END AS part) u WHERE NOT (i = 2 AND k = 'mustakil-ev')""")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detached homes have no path of their own among the useful ones."""
    rows = fixture(spark, sf_dir, "fx_subject").withColumns({"neighborhood": F.when(c("subject_id") % 5 > 0, c("neighborhood")), "valuation_type": F.when(c("subject_id") % 2 == 0, "Kiralık").otherwise("SALE"), "property_type": F.when(c("subject_id") % 3 == 0, "Müstakil Ev").otherwise("Daire")})
    return pages.crawl_frontier(rows, sort=("PRICE", "ASC")).select("subject_id", "url")


@registered("f24_image_candidates", """WITH v AS (SELECT listing_uid, replace(listing_uid, '-', '') AS k, provider_rank FROM fx_listing), u AS (
  SELECT listing_uid, 'https://img.example/photos/' || k || '.jpg?x=1' AS url, 60 AS priority, 1 AS o FROM v UNION ALL SELECT listing_uid, 'https://x.example/a/resize/100/200/' || k || '.png', 60, 2 FROM v UNION ALL SELECT listing_uid, 'https://imaj.emlakjet.com/' || k || '.webp', 100, 3 FROM v WHERE provider_rank = 1)
SELECT listing_uid, url, priority, row_number() OVER (PARTITION BY listing_uid ORDER BY priority DESC, o)::INT AS rank FROM u""")
def f24_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.replace("listing_uid", s("-"), s(""))
    html = F.concat(
        s('<img src="https://img.example/photos/'), k, s('.jpg?x=1"><img data-src="/a/resize/100/200/'), k, s('.png"><img srcset="https://img.example/photos/'), k, s('.jpg 1x, /a/resize/300/400/'), k, s('.png 2x, /img/logo.png 3x">'),
        F.when(c("provider_rank") == 1, F.concat(s('<script>{"u": "https:\\/\\/imaj.emlakjet.com\\/'), k, s('.webp"}</script>'))).otherwise(""),
    )
    rows = listings(spark, sf_dir).select(c("listing_uid").alias("page_id"), s("https://x.example/list/1").alias("base_url"), html.alias("html"))
    return pages.extract_image_candidates(rows).select("listing_uid", "url", "priority", "rank")


@registered("r1_stream_ingest", f"""WITH one AS (SELECT source_url, price, created_at, listing_uid, 'listing:' || substr(sha1(source_url), 1, 16) AS external_id FROM fx_listing WHERE image_url IS NOT NULL AND ({REASON.replace("provider_rank = 2 AND NOT", "provider_rank = -1 AND NOT")}) IS NULL AND property_type IS NOT NULL)
SELECT source_url, price, true AS is_active FROM one QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY created_at DESC, price DESC) = 1""")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw feed of all listings as a file stream, normalised, validated and upserted into a pool in the shared folder."""
    folder = work_folder(spark, "ingest")
    raw = raw_feed(listings(spark, sf_dir))
    raw.write.parquet(f"{folder}/feed")
    stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/feed")
    ingest.start_ingest(stream, f"{folder}/pool", f"{folder}/state", order=[F.desc("seen_at"), F.desc("price")], prepare=ingest.normalized).awaitTermination()
    return ingest.current_pool(spark, f"{folder}/pool").select("source_url", "price", "is_active")


SIGHTINGS = ("2001-10-10 00:00:00", "2001-11-10 00:00:00", "2001-11-30 00:00:00")


@registered("r2_sweep_pool", """WITH b AS (SELECT source_url, year(created_at) % 3 AS n FROM fx_listing), m AS (SELECT source_url, max(n) AS n FROM b GROUP BY 1)
SELECT source_url, CASE n WHEN 0 THEN 'EXPIRED' WHEN 1 THEN 'STALE' ELSE 'FRESH' END AS freshness, n = 2 AS live, 0 AS rewritten FROM m""")
def r2_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of three batches, swept twice at the same time: the second sweep rewrites nothing."""
    folder, at = work_folder(spark, "sweep"), "2001-12-01 00:00:00"
    rows = listings(spark, sf_dir).select("source_url", "listing_uid", "price", (F.year("created_at") % 3).alias("n"))
    for k, seen in enumerate(SIGHTINGS):
        ingest.merge_batch(rows.where(c("n") == k).drop("n").withColumn("seen_at", s(seen).cast("timestamp")), k, folder, [c("listing_uid")], buckets=16)
        ingest.sweep(spark, folder, seen)
    ingest.sweep(spark, folder, at)
    again = ingest.sweep(spark, folder, at)
    live = ingest.live_pool(spark, folder, at).select("source_url", s(True).alias("live"))
    return ingest.current_pool(spark, folder).select("source_url", "freshness").join(live, "source_url", "left").select("source_url", "freshness", F.coalesce("live", s(False)).alias("live"), s(again).alias("rewritten"))
