"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Words are dealt in blocks of `block` words.  A source's target is its weight's share of the mix, held at `most` times its
size (what is cut off is shared out again by weight).  The blocks of the whole mix are seats: the highest quotients
target / (2k + 1) get them.  Every source is cut into shards of about `shard_words` words by a seeded hash of its rows, and
the same rule deals a source's blocks to its shards.  In a shard, rows stand in seeded order and their words make a
stream of blocks; a quota of more than all blocks is so many whole passes and a rest, and the rest is a run of blocks
(around the end) that starts at a seeded one.

Seats are never listed one by one: rounding target / divisor gives each party its seats but for as many as there are
parties, because the divisor that fits lies between two that are known; only the quotients between are ranked.
Hot sources: the shards keep every window small, and the sums before them are pre-aggregated.

Defined results: null and empty texts have no words and are never taken; a null source is one source, the last; repeated
rows are each their own row; an empty table gives no rows.  Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what counts as a word (a run of other characters than ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARD_WORDS = 200_000
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: str, *cols: Column) -> Column:
    """32 bits of a digest, as a long: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size).

    Sources of the smallest most * size / weight reach their bound first, so running sums along that order tell which
    are bounded: all up to the last whose bound is not above its share of what the ones before it leave.
    """
    # one row per source, far fewer than documents: these windows rank that table as a whole
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", pick.cast("double")).withColumn("bound", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, all_rows = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(rest))  # a unit of weight gets this, if all before are bounded and none from here on
    rows = rows.withColumn("free", F.col("bound") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("bound") / F.col("weight")).alias("by"), F.col("level").alias("level")))).over(all_rows)["level"]
    return rows.select("source", "source_size", "weight", F.coalesce(F.least(F.col("bound"), level * F.col("weight")), F.col("bound")).alias("target"))


def apportioned(parties: DataFrame, group: list[str], seats: Column, share: str, order: list[Column]) -> DataFrame:
    """Adds `quota`: the seats of each row of its group by Sainte-Laguë, from the highest share / (2k + 1).

    With d the right divisor, the sum of round(share / d) is the number of seats S, so total / d lies within n / 2 of S.
    A row has at least the rounded share of S - n / 2 - 1 seats (sure) and at most that of S + n / 2 + 1: the quotients
    between are about 2 for a row, and the best of them get the seats that are not sure.
    """
    w = Window.partitionBy(*group)
    rows = parties.withColumn("seats_", seats).withColumn("total_", F.sum(share).over(w)).withColumn("n_", F.count(F.lit(1)).over(w))
    part = F.when(F.col("total_") > 0, F.col(share) / F.col("total_")).otherwise(0.0)
    low = F.floor(part * F.greatest(F.col("seats_") - F.col("n_") / 2 - 1, F.lit(0)) + 0.5 - 1e-9)
    high = F.ceil(part * (F.col("seats_") + F.col("n_") / 2 + 1) + 0.5 + 1e-9)
    rows = rows.withColumn("sure_", F.greatest(low, F.lit(0)).cast("long")).withColumn("open_", F.col("seats_") - F.sum("sure_").over(w))
    tried = rows.withColumn("k_", F.explode(F.sequence("sure_", F.greatest(high.cast("long"), F.col("sure_")))))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col(share) / (2 * F.col("k_") + 1)), *order, "k_"))
    won = (best <= F.col("open_")) & (F.col(share) > 0)
    tried = tried.withColumn("won_", F.when(won, 1).otherwise(0))
    keep = [F.col(c) for c in parties.columns]
    return tried.groupBy(*keep, "sure_").agg(F.sum("won_").alias("won_")).select(*keep, (F.col("sure_") + F.col("won_")).alias("quota"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = "mix") -> DataFrame:
    """(doc_id, row_key, size, source, source_size, target, passes, taken_from, taken_rest, taken) of (doc_id, source, text).

    A row is taken whole `passes` times, and `taken_rest` of its words once more, from word number `taken_from` on and
    around its end.  `taken` is the sum; it is at most ceil(most) * size.
    """
    words = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("row_key"))
    sizes = words.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(sizes, weights, share, most)
    # as many blocks as the targets come to; a source can't have more than `most` times its own
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    quotas = apportioned(targets, [], seats, "target", [F.col("source").asc_nulls_last()]).withColumnRenamed("quota", "source_quota")
    quotas = quotas.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
    same = F.col("w.source").eqNullSafe(F.col("q.source"))
    rows = words.alias("w").join(quotas.alias("q"), same).select("w.*", "source_size", "target", "source_quota", "shards")
    rows = rows.withColumn("shard", seeded(seed, F.coalesce("doc_id", F.lit(-1)), F.col("row_key")) % F.col("shards"))
    shards = rows.groupBy("source", "source_quota", "shard").agg(F.sum("size").alias("shard_size"))
    dealt = apportioned(shards, ["source", "source_quota"], F.col("source_quota"), "shard_size", [F.col("shard")]).select("source", "shard", "shard_size", F.col("quota").alias("shard_quota"))
    rows = rows.alias("w").join(dealt.alias("q"), F.col("w.source").eqNullSafe(F.col("q.source")) & (F.col("w.shard") == F.col("q.shard"))).select("w.*", "shard_size", "shard_quota")
    order = Window.partitionBy("source", "shard").orderBy(seeded(seed + "-order", F.coalesce("doc_id", F.lit(-1)), F.col("row_key")), "doc_id", "row_key")
    rows = rows.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    blocks = F.ceil(F.col("shard_size") / block).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("held", F.least(F.col("shard_quota"), blocks * int(-(-most // 1))))
    rows = rows.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("held") / F.col("blocks"))).otherwise(0).cast("long"))
    rows = rows.withColumn("rest", F.when(F.col("blocks") > 0, F.col("held") - F.col("passes") * F.col("blocks")).otherwise(0))
    rows = rows.withColumn("first", F.when(F.col("blocks") > 0, seeded(seed + "-start", F.coalesce("source", F.lit("\0")), F.col("shard")) % F.col("blocks")).otherwise(0))
    # the run of blocks as words: [a, b), and from the front [0, c) if it goes around the end
    a, b = F.col("first") * block, F.least((F.col("first") + F.col("rest")) * block, F.col("shard_size"))
    c = F.least(F.greatest(F.col("first") + F.col("rest") - F.col("blocks"), F.lit(0)) * block, F.col("shard_size"))
    over = lambda lo, hi: F.greatest(F.least(F.col("end"), hi) - F.greatest(F.col("begin"), lo), F.lit(0))
    front, back = over(F.lit(0), c), over(a, b)
    start = F.when(back > 0, F.greatest(a - F.col("begin"), F.lit(0))).otherwise(0)
    rows = rows.withColumns({"taken_from": start.cast("long"), "taken_rest": (front + back).cast("long")})
    return rows.select("doc_id", "row_key", "size", "source", "source_size", "target", "passes", "taken_from", "taken_rest", (F.col("passes") * F.col("size") + F.col("taken_rest")).alias("taken"))


def words_from(text: Column, start: Column, n: Column) -> Column:
    """n words of a text from word number `start` on, going on at its front after the last, with the white space behind each."""
    words = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    words = F.filter(words, lambda w: F.regexp_like(w, F.lit(r"[^\x20\x09-\x0D]")))
    tail = F.slice(words, (start + 1).cast("int"), n.cast("int"))
    around = (n - F.size(tail)).cast("int")
    return F.concat(F.array_join(tail, ""), F.when(around > 0, F.concat(F.lit("\n"), F.array_join(F.slice(words, F.lit(1), F.greatest(around, F.lit(0))), ""))).otherwise(""))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken whole, and the stretch of its words that is taken once more.
    Columns of `docs`, of whatever names; n_chars, if there, is that of the text."""
    key = F.md5(F.coalesce("text", F.lit("")))
    taken = mixed(docs, **options).where("taken > 0")
    # repeated rows can't be told apart: each gets what the one taken most gets
    taken = taken.groupBy("doc_id", "row_key", "source").agg(F.max(F.struct("passes", "taken_rest", "taken_from")).alias("t"))
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("d"), key.alias("key"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row_key")) & F.col("d.source").cast("string").eqNullSafe(F.col("source"))
    rows = rows.join(taken, same).select("d", "t")
    none = F.expr("cast(array() as array<boolean>)")
    whole = F.when(F.col("t.passes") > 0, F.array_repeat(F.lit(True), F.col("t.passes").cast("int"))).otherwise(none)
    part = F.when(F.col("t.taken_rest") > 0, F.array(F.lit(False))).otherwise(none)
    rows = rows.withColumn("whole", F.explode(F.concat(whole, part)))
    text = F.when(F.col("whole"), F.col("d.text")).otherwise(words_from(F.col("d.text"), F.col("t.taken_from"), F.col("t.taken_rest")))
    rows = rows.select("d", text.alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[(made[x] if x in made else F.col(f"d.`{x}`")).alias(x) for x in docs.columns])
