"""Users, clients and reports: counts, quotas, plans, conflicts, drafts, searches, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import normalize_email, normalize_phone

c = F.col
#: Plans, with their reports a month.
PLANS = (("FREE", "Ücretsiz", 5, 0.0), ("PREMIUM_20_MONTHLY", "Aylık Abone", 20, 600.0), ("PREMIUM_20_YEARLY", "Yıllık Abone", 20, 5000.0))
DEFAULT_PLAN = "FREE"


def plan_table(spark) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, plan_name string, monthly_limit int, plan_price double")


def in_month(col: Column, as_of: Column) -> Column:
    return F.date_trunc("month", col) == F.date_trunc("month", as_of)


def with_plan(users: DataFrame, plans: DataFrame) -> DataFrame:
    """Users with their plan's limits; unknown plans are the free one.  plans: a handful of rows."""
    known = users.join(F.broadcast(plans), users["subscription_plan"] == plans["plan"], "left")
    free = plans.where(c("plan") == DEFAULT_PLAN).select(*[c(x).alias(f"free_{x}") for x in plans.columns])
    rows = known.crossJoin(F.broadcast(free.limit(1)))  # one row
    return rows.select(*users.columns, *[F.coalesce(x, f"free_{x}").alias(x) for x in plans.columns])


def report_stats(users: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, total, active, deleted, this_month) in one pass; users without reports have zeros."""
    agg = reports.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~c("is_deleted")).alias("active"), F.count_if(c("is_deleted")).alias("deleted"), F.count_if(in_month(c("created_at"), as_of)).alias("this_month"))
    return users.select("user_id").join(agg, "user_id", "left").fillna(0, ["total", "active", "deleted", "this_month"])


def quota_usage(users: DataFrame, reports: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, plan, used, monthly_limit, remaining, may_create) of the month of as_of; paused users have no quota."""
    used = reports.where(~c("is_deleted") & (c("status") != "DRAFT") & in_month(c("created_at"), as_of)).groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    rows = with_plan(users, plans).join(used, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    limit = F.when(c("subscription_status") == "ACTIVE", c("monthly_limit")).otherwise(0)
    return rows.select("user_id", "plan", "used", limit.alias("monthly_limit"), F.greatest(limit - c("used"), F.lit(0)).alias("remaining"), (c("used") < limit).alias("may_create"))


def client_counts(clients: DataFrame, properties: DataFrame, reports: DataFrame) -> DataFrame:
    """(client_id, properties, reports): each counted before joining, so that neither multiplies the other."""
    count = lambda df, name: df.groupBy("client_id").agg(F.count(F.lit(1)).alias(name))
    rows = clients.select("client_id").join(count(properties, "properties"), "client_id", "left").join(count(reports, "reports"), "client_id", "left")
    return rows.fillna(0, ["properties", "reports"])


def identity_conflicts(users: DataFrame) -> DataFrame:
    """(key_type, key_value, users, first_id): user names, e-mails and phones that more than one user has."""
    keys = F.array(
        F.struct(F.lit("username").alias("key_type"), F.lower(F.trim("username")).alias("key_value")), F.struct(F.lit("email").alias("key_type"), normalize_email(c("email")).alias("key_value")), F.struct(F.lit("phone").alias("key_type"), normalize_phone(c("phone")).alias("key_value")),
    )
    rows = users.select("user_id", F.inline(keys)).where(F.coalesce("key_value", F.lit("")) != "")
    agg = rows.groupBy("key_type", "key_value").agg(F.min("user_id").alias("first_id"), F.max("user_id").alias("last_id"), F.count_distinct("user_id").alias("users"))
    return agg.where("last_id > first_id").select("key_type", "key_value", "users", "first_id")


def latest_drafts(reports: DataFrame) -> DataFrame:
    """The newest draft of each user that isn't deleted."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("report_id")))
    return visible_reports(reports, drafts=True).withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def visible_reports(df: DataFrame, drafts: bool | None = None) -> DataFrame:
    """Reports that aren't deleted; only drafts, only others, or both."""
    rows = df.where(~c("is_deleted"))
    return rows if drafts is None else rows.where((c("status") == "DRAFT") if drafts else (c("status") != "DRAFT"))


#: Fields that a search looks into, and letters of the pieces that its index holds.
FIELDS, PIECE = ("username", "full_name", "email", "phone"), 3


def search_users(df: DataFrame, q: str, phone_verified: bool | None = None) -> DataFrame:
    """Users whose name, user name, e-mail or phone contains the text, in any case."""
    hit = F.lit(False)
    for name in FIELDS:
        if name in df.columns:
            hit = hit | F.coalesce(F.lower(name).contains(q.lower()), F.lit(False))
    rows = df.where(hit)
    return rows if phone_verified is None else rows.where(c("phone_verified") == phone_verified)


def search_index(df: DataFrame) -> DataFrame:
    """(piece, user_id): the pieces of PIECE letters that the fields of a user hold, each once.  To be written, by piece."""
    texts = F.array_compact(F.array(*[F.lower(x) for x in FIELDS if x in df.columns]))
    pieces = F.flatten(F.transform(texts, lambda t: F.when(F.length(t) >= PIECE, F.transform(F.sequence(F.lit(1), F.length(t) - PIECE + 1), lambda i: F.substring(t, i, PIECE))).otherwise(F.array().cast("array<string>"))))
    return df.select("user_id", F.explode(F.array_distinct(pieces)).alias("piece")).select("piece", "user_id")


def search_indexed(df: DataFrame, index: DataFrame, q: str, phone_verified: bool | None = None) -> DataFrame:
    """What search_users() gives, by an index: users that have all pieces of the text are looked at, no others.  Texts that
    are shorter than a piece are searched for in all users."""
    text = q.lower()
    if len(text) < PIECE:
        return search_users(df, q, phone_verified)
    pieces = sorted({text[i : i + PIECE] for i in range(len(text) - PIECE + 1)})
    hit = index.where(c("piece").isin(pieces)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_")).where(c("n_") == len(pieces)).select("user_id")
    return search_users(df.join(hit, "user_id", "left_semi"), q, phone_verified)


def write_pages(df: DataFrame, order: list[Column], folder: str) -> None:
    """Writes rows by ranges of an order that tells all rows apart, for read_page(): each range is a folder, and a small table counts them."""
    ranged = df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    ranged.write.partitionBy("range_").parquet(f"{folder.rstrip('/')}/rows")
    written = df.sparkSession.read.parquet(f"{folder.rstrip('/')}/rows")
    written.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{folder.rstrip('/')}/counts")


def read_page(spark: SparkSession, folder: str, order: list[Column], take: int, skip: int = 0) -> DataFrame:
    """A page of what write_pages() has written: only the ranges that hold its rows are read, however far it skips."""
    before, held = 0, []
    first = None
    for r in spark.read.parquet(f"{folder.rstrip('/')}/counts").orderBy("range_").collect():  # a row for each range
        if before + r["n"] > skip and before < skip + take:
            held.append(r["range_"])
            first = before if first is None else first
        before += r["n"]
    rows = spark.read.parquet(f"{folder.rstrip('/')}/rows").where(c("range_").isin(held)).drop("range_")
    return page(rows, order, take, skip - (first or 0))


def page(df: DataFrame, order: list[Column], take: int, skip: int = 0) -> DataFrame:
    """A page of rows in an order that tells all rows apart."""
    return df.orderBy(*order).offset(skip).limit(take)


def newest_per_client(reports: DataFrame, n: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("created_at"), F.desc("report_id")))
    return reports.withColumn("rank", rank).where(c("rank") <= n)


def report_view(reports: DataFrame, clients: DataFrame, properties: DataFrame, pricing: DataFrame) -> DataFrame:
    """Reports with what belongs to them, all optional."""
    return reports.join(clients, "client_id", "left").join(properties, "property_id", "left").join(pricing, "report_id", "left")


def sort_names_tr(df: DataFrame, col: str) -> DataFrame:
    """In Turkish order of letters."""
    return df.orderBy(F.collate(c(col), "tr"), c(col))


def positions_tr(df: DataFrame, col: str, by: str) -> DataFrame:
    """Adds position: the row's place in Turkish order among those of its `by` (a list of names is one of a place), from 1."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(F.collate(c(col), "tr"), c(col))))
