"""Exact quantiles of groups of any size, by selection of ranks in passes.

A pass counts a group's values by ranges; the counts are summed in each task first, so a group that holds most rows moves
some hundred counts from each task.  The range that holds a wanted rank is counted again by finer ranges, until it holds few
values, and only these are brought together.  No group is ever held, and no row is shuffled but those few.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Values of a range that are brought together, and ranges that one is cut into.
HELD, RANGES = 10_000, 512


def binade(v: Column) -> Column:
    """A number that grows with the value: its sign and an eighth of a power of two; so ranges of the first pass are narrow however values are spread."""
    n = F.floor(F.log2(F.abs(v)) * 8) + 10_000
    return F.when(v == 0, 0).when(v > 0, n).otherwise(-n)


def some_value(kind: str) -> str:
    """A text that any value of a type can be cast from."""
    return {"date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01", "boolean": "false"}.get(kind, "0")


def picked(counts: DataFrame, wanted: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The wanted ranks (keys, rank, below) with the range that holds them: `below` counts what lies under it, `held` what is in it."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.withColumn("upto_", F.sum("n_").over(w))
    found = wanted.join(running, keys).where((c("rank_") >= c("below_") + c("upto_") - c("n_")) & (c("rank_") < c("below_") + c("upto_")))
    return found.withColumn("below_", c("below_") + c("upto_") - c("n_"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, wanted: Iterable[tuple[str, float]], folder: str, held: int = HELD, ranges: int = RANGES) -> DataFrame:
    """(by..., n, <name> for each (name, q)): linear interpolation at (n - 1) * q of a column's values that aren't null.

    `df` is read once for each pass, so hand in a table or a cheap projection of one.  `folder`: a shared folder, in
    which the ranks that are still sought stand between the passes, and then the result.  A group without values has no row.  Null keys make a group.
    """
    spark, wanted = df.sparkSession, list(wanted)
    keys = [f"k{i}_" for i in range(len(by))]
    # a group's keys under other names, so that columns of any name can be keys; null is told apart by a flag
    flags = [f"{k}null" for k in keys]
    named = [x for i, k in enumerate(by) for x in (c(k).alias(keys[i]), c(k).isNull().alias(flags[i]))]
    none = {k: F.coalesce(k, F.lit(some_value(df.schema[by[i]].dataType.typeName())).cast(df.schema[by[i]].dataType)) for i, k in enumerate(keys)}
    rows = df.select(*named, c(value).cast("double").alias("v_")).where("v_ is not null").withColumns(none)
    keys = [*keys, *flags]

    written: list[str] = []

    def kept(rows: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        written.append(path)
        return spark.read.schema(rows.schema).parquet(path)

    stats = [F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_")]
    counts = kept(rows.groupBy(*keys, binade(c("v_")).alias("b_")).agg(*stats))
    sizes = counts.groupBy(*keys).agg(F.sum("n_").alias("n"))
    place = lambda q: (c("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.least(F.floor(place(q)) + 1, c("n") - 1)) for _, q in wanted])))
    sought = picked(counts, sizes.select(*keys, F.explode(ranks).alias("rank_"), F.lit(0).cast("long").alias("below_")), keys, "b_")
    sought = kept(sought.select(*keys, "rank_", "below_", "n_", "lo_", "hi_"))
    while True:
        wide = sought.where((c("n_") > held) & (c("lo_") < c("hi_")))
        if wide.isEmpty():
            break
        span = [*keys, "lo_", "hi_"]
        inside = rows.join(wide.select(*span).distinct(), keys).where(c("v_").between(c("lo_"), c("hi_")))
        step = F.least(F.floor((c("v_") - c("lo_")) / (c("hi_") - c("lo_")) * ranges), F.lit(ranges - 1))
        finer = inside.groupBy(*span, step.alias("b_")).agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"))
        found = picked(finer, wide.select(*span, "rank_", "below_"), span, "b_").select(*keys, "rank_", "below_", "n_", c("least_").alias("lo_"), c("most_").alias("hi_"))
        sought = kept(sought.where((c("n_") <= held) | (c("lo_") == c("hi_"))).union(found))
    span = [*keys, "lo_", "hi_"]
    alone = sought.where("lo_ = hi_").select(*keys, "rank_", c("lo_").alias("x_"))
    few = sought.where("lo_ < hi_")
    lists = rows.join(few.select(*span).distinct(), keys).where(c("v_").between(c("lo_"), c("hi_"))).groupBy(*span).agg(F.sort_array(F.collect_list("v_")).alias("values_"))  # `held` of them at most
    near = few.join(lists, span).select(*keys, "rank_", F.get("values_", (c("rank_") - c("below_")).cast("int")).alias("x_"))
    at = alone.union(near).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank_", "x_"))).alias("at_"))
    whole = sizes.join(at, keys)
    low, high = (lambda q: F.element_at("at_", F.floor(place(q)))), (lambda q: F.element_at("at_", F.least(F.floor(place(q)) + 1, c("n") - 1)))
    part = lambda q: place(q) - F.floor(place(q))
    mixed = lambda q: F.when(part(q) == 0, low(q)).otherwise((1 - part(q)) * low(q) + part(q) * high(q))
    found = kept(whole.select(*[F.when(~c(flags[i]), c(f"k{i}_")).alias(k) for i, k in enumerate(by)], "n", *[mixed(q).alias(name) for name, q in wanted]))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in written[:-1]:
        files(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files(path), True)
    return found
