"""Adapters: the valuation tables as views over the given ones.  The SQL runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Listing pool / feeds (wide comparable rows). `source_url` repeats on purpose (24 % of rows) so first-wins dedup has work; `listing_uid` is unique and is the final tie-break.
FX_LISTING = """
select l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||cast(floor(l_extendedprice*100+0.5) as bigint) as listing_uid,
 'https://listing.example/'||l_orderkey||'-'||l_linenumber as source_url,
 case l_suppkey%4 when 0 then 'Hepsiemlak' when 1 then 'RE/MAX' when 2 then 'Emlakjet' else 'Sahibinden' end as source,
 cast(l_suppkey%3 as int) as provider_rank,
 r_name as city, n_name as district, 'Mah '||(l_partkey%8) as neighborhood,
 case p_type when 'PROMO' then 'land' when 'LARGE' then 'commercial' else 'residential' end as category,
 case when l_discount>=0.085 then 'rental' else 'sale' end as valuation_type,
 cast(floor(l_extendedprice*20+0.5) as double) as price,
 l_quantity*4+20 as gross_area,
 case when l_linenumber%3=0 then null else cast(floor((l_quantity*4+20)*0.85+0.5) as double) end as net_area,
 case when l_linenumber%5=0 then null else (cast(floor(l_quantity/15) as int)+1)||'+1' end as room_text,
 case when l_linenumber%4=0 then null else cast(p_size-1 as int) end as building_age,
 case when l_returnflag='R' then null else 'https://img.example/'||l_partkey||'.jpg' end as image_url,
 p_name as title, l_shipdate as created_at,
 date '2001-12-01' - cast((l_suppkey*7+l_partkey)%18 as int) as last_seen_at,
 case when p_type='PROMO' then 'Arsa' when p_type='LARGE' then 'Dükkan' when l_suppkey%5=4 then null when l_suppkey%5=3 then 'Villa' when l_suppkey%5=2 then 'daire' else 'Daire' end as property_type
from lineitem join part on p_partkey=l_partkey join supplier on s_suppkey=l_suppkey
join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey
"""

#: Subjects to be valued: 10 / 100 / 1 000 rows at the three scales.
FX_SUBJECT = """
select s_suppkey as subject_id, r_name as city, n_name as district, 'Mah '||(s_suppkey%8) as neighborhood,
 case when s_suppkey%10=9 then 'land' when s_suppkey%10=8 then 'commercial' else 'residential' end as category,
 'sale' as valuation_type, case when s_suppkey%10=9 then 'ARSA' when s_suppkey%10=8 then 'dükkan' when s_suppkey%4=3 then null else 'DAIRE' end as subject_type, cast(40+(s_suppkey*7)%140 as double) as subject_area,
 case when s_suppkey%10>=8 then null else (1+s_suppkey%4)||'+1' end as subject_room_text,
 case when s_suppkey%6=5 then null else cast((s_suppkey*3)%40 as int) end as subject_building_age,
 cast(s_suppkey%9 as int) as floor_no, cast(3+s_suppkey%8 as int) as building_floors,
 case s_suppkey%3 when 0 then true when 1 then false else null end as has_elevator,
 cast(41.0+((s_suppkey*53)%4000)/10000.0 as double) as lat, cast(29.0+((s_suppkey*977)%4000)/10000.0 as double) as lon
from supplier join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey
"""

#: Tagged points for the radius join (0.4° box near 41° N, 29° E).
FX_POI = """
select event_id as poi_id,
 cast(41.0+((event_id*37)%4000)/10000.0 as double) as lat, cast(29.0+((event_id*1931)%4000)/10000.0 as double) as lon,
 case event_type when 'click' then 'amenity' when 'view' then 'shop' when 'purchase' then 'leisure' when 'signup' then 'highway' else 'railway' end as tag_key,
 case event_type when 'click' then (case user_id%5 when 0 then 'school' when 1 then 'hospital' when 2 then 'pharmacy' when 3 then 'bank' else 'place_of_worship' end)
  when 'view' then (case user_id%3 when 0 then 'supermarket' when 1 then 'mall' else 'bakery' end)
  when 'purchase' then 'park' when 'signup' then 'bus_stop'
  else (case user_id%3 when 0 then 'subway_entrance' when 1 then 'tram_stop' else 'station' end) end as tag_value
from events
"""

#: Valuation reports (usage aggregates, quotas, drafts, soft delete).
FX_REPORT = """
select o_orderkey as report_id, o_custkey as user_id, o_orderdate as created_at,
 case when o_orderpriority='5-LOW' then 'DRAFT' else 'COMPLETED' end as status,
 (o_orderstatus='P') as is_deleted, cast(o_custkey%7 as int) as client_no, o_totalprice as expected_price
from orders
"""

#: Users with plan and status (one segment has an unknown plan → FREE default).
FX_USER = """
select c_custkey as user_id, c_name as full_name, c_mktsegment as segment,
 case c_mktsegment when 'BUILDING' then 'PREMIUM_20_MONTHLY' when 'MACHINERY' then 'PREMIUM_20_YEARLY' when 'HOUSEHOLD' then 'UNKNOWN_PLAN' else 'FREE' end as subscription_plan,
 case when c_acctbal<0 then 'PAUSED' else 'ACTIVE' end as subscription_status
from customer
"""

#: Monthly index series, exact integer cents; the last month is missing for some series.
FX_SERIES = """
select o_orderpriority as series, cast(year(o_orderdate)*12+month(o_orderdate) as int) as month_idx,
 cast(floor(sum(cast(floor(o_totalprice*100+0.5) as bigint))/count(*)+0.5) as bigint) as value_cents
from orders group by o_orderpriority, year(o_orderdate)*12+month(o_orderdate)
"""

#: Open population metric rows with several years and two sources.
FX_STAT = """
select 'SRC_'||(c_custkey%2) as source, 'population' as source_dataset, n_name||':'||(c_custkey%8) as source_key,
 'NEIGHBORHOOD' as location_level, r_name as city, n_name as district, 'Mah '||(c_custkey%8) as neighborhood,
 cast(2020+(c_custkey%3) as int) as year, 'population_total' as metric_key, cast(count(*)*1000 as double) as metric_value
from customer join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey
group by c_custkey%2, n_name, c_custkey%8, r_name, c_custkey%3
"""

ADAPTERS = {
    "fx_listing": FX_LISTING,
    "fx_subject": FX_SUBJECT,
    "fx_poi": FX_POI,
    "fx_report": FX_REPORT,
    "fx_user": FX_USER,
    "fx_series": FX_SERIES,
    "fx_stat": FX_STAT,
}


#: Large adapters and the tables that their rows come from.
LARGE = {"fx_listing": "lineitem", "fx_poi": "events"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter, or a table, over the Parquet files of a folder.

    A table that Spark would read in fewer tasks than there are cores (a file of one row group, for which it can't do
    otherwise) has its rows dealt out, so that what is computed on each of them isn't left to one task.
    """
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = query(spark, sf_dir, ADAPTERS[name])
    return dealt_out(rows, fixture(spark, sf_dir, LARGE[name])) if name in LARGE else rows


def dealt_out(rows: DataFrame, read: DataFrame | None = None, times: int = 1) -> DataFrame:
    """The rows, over all cores (in `times` tasks for each) if they (or the table that they are read from) are in fewer tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism * times
    return rows.repartition(cores) if (rows if read is None else read).rdd.getNumPartitions() < cores else rows


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, or, on one machine, below the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to a work folder and read again: for what several branches of a query start from."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the given tables and the adapters; only those it names are read."""
    named = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    for name, body in ADAPTERS.items():
        if re.search(rf"\b{name}\b", text):
            text = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 ({body.strip()}) {name}", text)
    for t, path in named.items():
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {path} {t}", text)
    return spark.sql(text)


def with_adapters(body: str) -> str:
    """The SQL with the adapters it names in front."""
    needed = [n for n in ADAPTERS if re.search(rf"\b{n}\b", body)]
    if not needed:
        return body
    front = ",\n".join(f"{n} AS ({ADAPTERS[n].strip()})" for n in needed)
    body = body.strip()
    return f"WITH {front},\n{body[5:]}" if body[:5].lower() == "with " else f"WITH {front}\n{body}"
