"""Open population statistics: landing records as metric rows, upserting them, latest values, matching and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import normalize_location
from parcelforge.operators.pool import insert_only, unique_first

c = F.col
KEY = ["source", "source_dataset", "source_key", "metric_key", "year"]
#: Words that names of places lose before they are compared, and labels and units of the metrics.
PLACE_WORDS = ("mahallesi", "mahalle", "mah", "mh", "koyu", "koy", "beldesi", "belde", "ilcesi", "ilce", "nufusu")
METRICS = {"population_total": ("Population total", "person"), "population_male": ("Population male", "person"), "population_female": ("Population female", "person"), "neighborhood_count": ("Neighborhood count", "count"), "village_count": ("Village count", "count")}


def unpivot_metrics(records: DataFrame) -> DataFrame:
    """A row for each known metric of a record, with label and unit; missing metrics have none."""
    names = [m for m in METRICS if m in records.columns]
    ids = [x for x in records.columns if x not in names]
    rows = records.unpivot(ids, names, "metric_key", "metric_value").where(c("metric_value").isNotNull())
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[i])]), c("metric_key"))
    return rows.withColumns({"metric_label": pick(0), "unit": pick(1)})


def upsert_metrics(existing: DataFrame, incoming: DataFrame, mode: str = "insert") -> DataFrame:
    """`insert`: existing rows stay, new keys are added.  `upsert`: incoming rows replace those of their key.
    `incoming` may repeat a key: its first row by value counts."""
    one = unique_first(incoming, KEY, [F.desc_nulls_last("metric_value")])
    return insert_only(existing, one, KEY) if mode == "insert" else insert_only(one, existing, KEY)


def latest_metrics(stats: DataFrame) -> DataFrame:
    """The newest row of each place and metric; the first source by name among equals."""
    order = [F.desc("year"), c("source"), c("source_key")]
    return unique_first(stats, ["location_level", "city", "district", "neighborhood", "metric_key"], order)


def place_keys(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({f"{n}_key": normalize_location(c(n), PLACE_WORDS) for n in names})


def match_location(subjects: DataFrame, stats: DataFrame) -> DataFrame:
    """Subjects with the statistics of their neighbourhood: the folded name, or else the same without spaces.

    Both have city, district and neighborhood.  Adds match: exact or compact.
    """
    a = place_keys(subjects, "city", "district", "neighborhood")
    b = place_keys(stats, "city", "district", "neighborhood").drop("city", "district", "neighborhood")
    exact = a.join(b, ["city_key", "district_key", "neighborhood_key"]).withColumn("match", F.lit("exact"))
    left = a.join(exact.select("subject_id").distinct(), "subject_id", "left_anti")
    compact = lambda df: df.withColumn("compact_key", F.replace("neighborhood_key", F.lit(" "), F.lit("")))
    near = compact(left).join(compact(b).drop("neighborhood_key"), ["city_key", "district_key", "compact_key"]).drop("compact_key").withColumn("match", F.lit("compact"))
    return exact.unionByName(near)


def neighborhood_profile(subjects: DataFrame, stats: DataFrame) -> DataFrame:
    """(subject_id, population, district_population, share_pct, year, match): the subject's neighbourhood in its district."""
    latest = latest_metrics(stats.where("metric_key = 'population_total' and location_level = 'NEIGHBORHOOD'"))
    found = match_location(subjects.select("subject_id", "city", "district", "neighborhood"), latest.select("city", "district", "neighborhood", "year", "metric_value"))
    district = place_keys(latest, "city", "district").groupBy("city_key", "district_key").agg(F.sum("metric_value").alias("district_population"))
    rows = found.join(district, ["city_key", "district_key"], "left")
    share = F.when(c("district_population") > 0, c("metric_value") / c("district_population") * 100)
    return rows.select("subject_id", c("metric_value").alias("population"), "district_population", share.alias("share_pct"), "year", "match")


#: Letters of the pieces of names that a search for contained names goes by.
GRAM = 4


def grams(df: DataFrame, sizes: Column) -> DataFrame:
    """A row for each distinct piece (gram_) of the key, of each of the sizes."""
    key = c("key_")
    pieces = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: F.substring(key, i, n))))
    return df.withColumn("gram_", F.explode(F.array_distinct(pieces)))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(parent, inner_, outer_): names (parent, key_) of `outer` that hold one of `inner` of the same parent.

    Names of `outer` are indexed by their pieces of up to GRAM letters.  A name of `inner` looks up its rarest piece alone, so
    the names that are compared are few where any of its pieces is; one with a piece that no other name has is compared with none.
    """
    upto = F.sequence(F.lit(1), F.least(F.length("key_"), F.lit(GRAM)))
    index = grams(outer.select("parent", "key_").distinct().where("key_ <> ''"), upto)
    counts = index.groupBy("parent", "gram_").agg(F.count(F.lit(1)).alias("n_"))
    parts = grams(inner.select("parent", "key_").distinct().where("key_ <> ''"), F.array(F.least(F.length("key_"), F.lit(GRAM))))
    rare = parts.join(counts, ["parent", "gram_"], "left").groupBy("parent", "key_").agg(F.min_by("gram_", F.struct("n_", "gram_")).alias("gram_"), F.count_if(c("n_").isNull()).alias("missing_")).where("missing_ = 0")
    met = rare.select("parent", c("key_").alias("inner_"), "gram_").join(index.select("parent", c("key_").alias("outer_"), "gram_"), ["parent", "gram_"])
    return met.where(c("outer_").contains(c("inner_"))).select("parent", "inner_", "outer_")


def resolve_names(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target_id, candidate_id, tier): the best candidate of the same parent: equal names (1), equal without spaces (2), containing
    the target (3), contained in it (4); the first in order among equals.  targets: (target_id, parent, name); candidates:
    (candidate_id, parent, name, ord), any number for each parent.

    Each distinct name is resolved once: equal ones by joins on the name, others by an index of pieces of names.
    """
    keyed = lambda df: df.withColumn("key_", normalize_location(c("name"), PLACE_WORDS)).drop("name")
    compact = lambda df: df.withColumn("compact_", F.replace("key_", F.lit(" "), F.lit("")))
    rows = keyed(targets).where("key_ <> ''")
    names, held = rows.select("parent", "key_").distinct(), keyed(candidates)
    firsts = held.groupBy("parent", "key_").agg(F.min(F.struct("ord", "candidate_id")).alias("first_"))
    equal = names.join(firsts, ["parent", "key_"]).select("parent", "key_", "first_", F.lit(1).alias("tier"))
    left = names.join(equal, ["parent", "key_"], "left_anti")
    squeezed = compact(firsts).groupBy("parent", "compact_").agg(F.min("first_").alias("first_"))
    near = compact(left).join(squeezed, ["parent", "compact_"]).select("parent", "key_", "first_", F.lit(2).alias("tier"))
    left = left.join(near, ["parent", "key_"], "left_anti")
    candidate = firsts.select("parent", c("key_").alias("name_"), "first_")
    wider = containing(left, firsts).select("parent", c("inner_").alias("key_"), c("outer_").alias("name_")).join(candidate, ["parent", "name_"]).groupBy("parent", "key_").agg(F.min("first_").alias("first_")).withColumn("tier", F.lit(3))
    left = left.join(wider, ["parent", "key_"], "left_anti")
    within = containing(firsts, left).select("parent", c("outer_").alias("key_"), c("inner_").alias("name_")).join(candidate, ["parent", "name_"])
    nameless = left.join(candidate.where("name_ = ''"), "parent").select("parent", "name_", "key_", "first_")  # a candidate without a name is in any
    within = within.select("parent", "name_", "key_", "first_").union(nameless.select("parent", "name_", "key_", "first_")).groupBy("parent", "key_").agg(F.min("first_").alias("first_")).withColumn("tier", F.lit(4))
    found = equal.unionByName(near).unionByName(wider).unionByName(within)
    return rows.join(found, ["parent", "key_"]).select("target_id", "first_.candidate_id", "tier")


def import_totals(metrics: DataFrame) -> DataFrame:
    """(city, districts, places, metric_rows): of each city, and of all (city null)."""
    per_place = metrics.groupBy("city", "district", "neighborhood").agg(F.count(F.lit(1)).alias("n"))
    per_district = per_place.groupBy("city", "district").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("n"))
    return per_district.rollup("city").agg(F.count(F.lit(1)).alias("districts"), F.sum("places").alias("places"), F.sum("n").alias("metric_rows"))


def window_of(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def monthly(points: DataFrame) -> DataFrame:
    """The series with a row for every month from its first to its last; months that are missing have a null value.
    idx counts months (year * 12 + month)."""
    spans = points.groupBy("series").agg(F.min("idx").alias("a_"), F.max("idx").alias("b_"))
    return spans.select("series", F.explode(F.sequence("a_", "b_")).alias("idx")).join(points, ["series", "idx"], "left")


def index_changes(points: DataFrame, by_calendar: bool = False) -> DataFrame:
    """(series, latest, monthly, annual, three_year, period, low, high) changes in percent.

    points: (series, idx, value).  By position (the default): 1, 12 and 36 rows back, so that a missing month shifts what lies
    before it.  `by_calendar`: 1, 12 and 36 months of idx back, and null where that month is missing; series may have gaps.
    """
    w = Window.partitionBy("series").orderBy("idx")
    before = (lambda n: F.max("value").over(w.rangeBetween(-n, -n))) if by_calendar else (lambda n: F.lag("value", n).over(w))
    rows = points.withColumns({f"b{n}": before(n) for n in (1, 12, 36)} | {"first": F.first("value").over(w), "low": F.min("value").over(window_of("series")), "high": F.max("value").over(window_of("series"))})
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("idx")))).where("r = 1")
    return last.select("series", c("value").alias("latest"), *[change(c(b)).alias(n) for b, n in (("b1", "monthly"), ("b12", "annual"), ("b36", "three_year"), ("first", "period"))], "low", "high")


def change(before: Column) -> Column:
    """Change in percent; null without a value before, or from zero."""
    return F.when(before != 0, (c("value") - before) / before * 100)


def yearly_changes(points: DataFrame, by_calendar: bool = False) -> DataFrame:
    """(series, idx, change_pct) of every point that has one 12 rows before (`by_calendar`: 12 months before); two decimals."""
    w = Window.partitionBy("series").orderBy("idx")
    before = F.max("value").over(w.rangeBetween(-12, -12)) if by_calendar else F.lag("value", 12).over(w)
    rows = points.withColumn("before", before).withColumn("change_pct", F.round(change(c("before")), 2))
    return rows.where(c("change_pct").isNotNull()).select("series", "idx", "change_pct")
