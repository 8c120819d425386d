"""N-gram Jaccard join of whole texts: rare-first prefix filtering, joined on prefix n-grams, verified once per pair.

A text's set holds its distinct shingles of `WIDTH` words (64-bit hashes).  Rows with equal sets are one set.  Shingles
are ordered by how many sets have them, rare ones first, then by hash; a set's prefix is so long that two sets at the
threshold have their first common shingle in both prefixes.

1. One pass over the texts makes the sets.  Sets are gathered in slices of bounded size; a slice's shingles are sorted, cut
   into ranges of hashes and dealt out by range, packed, each with the number of its set in the slice.  A shingle that many
   sets of a slice have is dealt out once, with their number, so that a hot shingle sends one entry for each slice.
2. Each range counts its shingles and sends those that two sets or more have, with their counts, back to their slices.
   A shingle that one set alone has can't be common to two: it takes its place at the front of its set's order, but
   is never joined on; a set of which less than `PERCENT` of the shingles are shared can't link with any and falls out.
3. The prefixes of what is left are dealt out by shingle and sorted there; buckets of one set fall away.
4. Each set meets the first one of each of its buckets.  In a further round, each set of a bucket that is outside the bucket's
   largest component meets one member of it.  Most near copies come together here, and links make components.
5. What is left to try are pairs of a bucket in different components: sets outside the largest component, against all
   of the bucket.  They pass the length and positional filters and those of sketches, and are verified, so no
   link between components is lost and no bucket is capped.  Pairs that were tried before are not tried again.

Parity sketches of 512 bits bound from below in how many shingles two sets differ.  Verification applies the suffix
filter (halving the sorted sets bounds their overlap), then intersects the shared shingles: others can't be common.

Defined results: null and empty texts have the empty set and link with nothing; texts of fewer words than a shingle are
one shingle; equal sets link; repeated rows each get a row; an empty table gives no rows.  Only the id and text columns
are read, so other columns can't clash.  `docs` must give a task's rows in the same order if the task is run again, as
files do, because slices are numbered by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import SPREAD, U, id_and_text, mixed, powers, removed, running_sums, shared_buckets, text_slices, written

WIDTH, PERCENT = 5, 80
#: A slice ends with so many shingles, or rows.
SLICE_SHINGLES, SLICE_ROWS = 1_000_000, 60_000
#: Bits of a shingle's hash that are told apart.
BITS = 56
#: A shingle that so many sets of a slice have is sent once.
HOT = 16
#: Rounds in which sets meet a few others, and how many they meet at most in a round (the last round is of all that is left).
ROUNDS, PARTNERS = 2, 3
#: Longs of a set's parity sketch: 512 bits.
SKETCH = 8
#: Bytes of text that are cut into words at a time.
STEP = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ASCII-lowered bytes, and where each begins.  A hash is a polynomial of the word's bytes."""
    codes = np.frombuffer(data, np.uint8)
    space = SPACE[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(max(1 << 21, 1 << len(data).bit_length()))
    sums = running_sums(codes, up)
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def pieces(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces of about STEP that end at white space."""
    start = 0
    while len(data) - start > STEP:
        end = start + STEP
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def joined(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    h = np.full(len(words) - width + 1, U(width))
    for k in range(width):
        h = h * U(SPREAD) + words[k : k + len(h)]
    return mixed(h)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; words are runs of other bytes than ASCII white space, A-Z in lower case."""
    data = [t.encode().lower() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(data):
        if len(data[at]) > STEP:
            out.append(set_of(np.concatenate([word_hashes(p)[0] for p in pieces(data[at])])))
            at += 1
            continue
        end, size = at, 0
        while end < len(data) and size + len(data[end]) <= STEP:
            size += len(data[end]) + 1
            end += 1
        words, starts = word_hashes(b"\n".join(data[at:end]))
        begins = np.cumsum([0] + [len(x) + 1 for x in data[at:end]])
        cuts = np.searchsorted(starts, begins)
        runs = joined(words, WIDTH) if len(words) >= WIDTH else words[:0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append(distinct(runs[a : b - WIDTH + 1]) if b - a >= WIDTH else set_of(words[a:b]))
        at = end
    return out


def set_of(words: np.ndarray) -> np.ndarray:
    return distinct(joined(words, min(WIDTH, len(words)))) if len(words) else words


def set_hash(found: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh64_digest(found.tobytes()), ">i8")[0])


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH longs of bits: bit b is the parity of the number of hashes that fall on b.  Sets that differ in d hashes have
    sketches that differ in d bits at most."""
    bits = np.bincount((mixed(found) >> U(64 - (SKETCH * 64 - 1).bit_length())).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def overlap_needed(n: int, m: int) -> int:
    """Least intersection of sets of these sizes that link: 100 * i >= PERCENT * (n + m - i)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def overlap_reaches(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether two sorted sets have so many in common."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < need or not len(b):
        return False
    # suffix filter: each quarter of b can share no more than the smaller of its part and a's part between the same bounds
    cuts = b[[len(b) // 4, len(b) // 2, 3 * len(b) // 4]]
    sides = [np.diff(np.concatenate(([0], np.searchsorted(x, cuts), [len(x)]))) for x in (a, b)]
    if np.minimum(*sides).sum() < need:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a)) >= need


def packed(ordered: np.ndarray) -> bytes:
    """Ascending hashes as their differences, the lowest bytes of all first, in as many bytes as the largest needs."""
    steps = np.diff(ordered, prepend=U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : data[0]] = planes.T
    return np.cumsum(steps.view(U).ravel())


#: Rows of a slice's shingles within a range (ids null), or of its texts (ids given; with the shingles that are hot in it).
PACKED = "range int, slice long, shingles binary, owners binary, counts binary, ids array<long>, sizes array<long>, keys array<long>"
ARROW = pa.schema([
    ("range", pa.int32()), ("slice", pa.int64()), ("shingles", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
])
#: Stands for all sets of a slice that have a hot shingle.
MANY = 0xFFFF


def sliced(docs: DataFrame, ranges: int) -> DataFrame:
    """PACKED rows of all texts and of all shingles of each slice's distinct sets."""
    most_shingles, most_rows, hot_from = SLICE_SHINGLES, SLICE_ROWS, HOT

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, keys, sets, owners, seen, held = [], [], [], [], [], set(), 0

        def out() -> pa.RecordBatch:
            name = part << 32 | number
            rows: list[tuple] = []
            hot, hot_owners = np.empty(0, U), np.empty(0, np.uint16)
            if sets:
                h = np.concatenate(sets) >> U(64 - BITS)
                of = np.repeat(np.array(owners, np.uint16), [len(s) for s in sets])
                order = np.argsort(h)
                h, of = h[order], of[order]
                first = np.concatenate(([True], h[1:] != h[:-1]))
                often = np.diff(np.append(np.flatnonzero(first), len(h)))
                many = np.repeat(often >= hot_from, often)
                hot, hot_owners = h[many], of[many]
                of = np.where(many, MANY, of).astype(np.uint16)
                keep = ~many | first
                h, of = h[keep], of[keep]
                edges = np.searchsorted(h, (np.arange(1, ranges, dtype=U) * U((1 << BITS) // ranges)))
                for r, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(h)], strict=True)):
                    if b > a:
                        rows.append((r, name, packed(h[a:b]), of[a:b].tobytes(), None, None, None, None))
            rows.append((name % ranges, name, packed(hot) if len(hot) else None, hot_owners.tobytes(), None, ids, sizes, keys))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

        for some, texts in text_slices(batches):
            for i, found in zip(some, shingle_sets(texts), strict=True):
                key = set_hash(found)
                if len(found) and key not in seen:
                    seen.add(key)
                    sets.append(found)
                    owners.append(len(ids))
                    held += len(found)
                ids.append(i)
                sizes.append(len(found))
                keys.append(key)
                if held >= most_shingles or len(ids) >= most_rows:
                    yield out()
                    number += 1
                    ids, sizes, keys, sets, owners, seen, held = [], [], [], [], [], set(), 0
        if ids:
            yield out()

    return docs.mapInArrow(cut, PACKED)


def counted(slices: DataFrame) -> DataFrame:
    """PACKED rows: those of texts as they are; of the others, the shingles that two sets or more have, with how many do."""

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        mine = [r for r in rows if r["ids"] is None]
        out = [tuple(r.values()) for r in rows if r["ids"] is not None]
        if mine:
            h = [unpacked(r["shingles"]) for r in mine]
            of = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in mine])
            row = np.repeat(np.arange(len(mine)), [len(x) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            ordered = h[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            often = np.add.reduceat(np.where(of[order] == MANY, HOT, 1), first)
            each = np.empty(len(h), np.int64)
            each[order] = np.repeat(often, np.diff(np.append(first, len(h))))
            shared = each > 1
            edges = np.searchsorted(row, np.arange(len(mine) + 1))
            for r, a, b in zip(mine, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                on = shared[a:b]
                if on.any():
                    out.append((r["range"], r["slice"], packed(h[a:b][on]), of[a:b][on].tobytes(), np.minimum(each[a:b][on], 0xFFFF).astype(np.uint16).tobytes(), None, None, None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW) if out else ARROW.empty_table()

    return slices.groupBy("range").applyInArrow(count, PACKED)


def linkable(packs: DataFrame) -> DataFrame:
    """(key, n, shared, shingles, first, s0…) of the sets of which enough shingles are shared: their sizes, the sorted
    shared shingles, those of the prefix in their order, and the sketch."""
    names = [f"s{k}" for k in range(SKETCH)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * SKETCH]

    def choose(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        (head,) = [r for r in rows if r["ids"] is not None]
        sizes, keys, out = head["sizes"], head["keys"], []
        mine = [(unpacked(r["shingles"]), np.frombuffer(r["owners"], np.uint16), np.frombuffer(r["counts"], np.uint16)) for r in rows if r["ids"] is None]
        if mine:
            h, of, often = (np.concatenate(c) for c in zip(*mine, strict=True))
            if head["shingles"] is not None:
                hot, hot_of = unpacked(head["shingles"]), np.frombuffer(head["owners"], np.uint16)
                many = of == MANY
                order = np.argsort(h[many])
                known, known_often = h[many][order], often[many][order]
                h, of, often = np.concatenate((h[~many], hot)), np.concatenate((of[~many], hot_of)), np.concatenate((often[~many], known_often[np.searchsorted(known, hot)]))
            order = np.lexsort((h, often, of))
            h, of = h[order], of[order]
            edges = np.searchsorted(of, np.arange(len(sizes) + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                n, shared = sizes[k], int(edges[k + 1] - edges[k])
                take = shared - -(-PERCENT * n // 100) + 1
                if take > 0:
                    found = h[edges[k] : edges[k + 1]]
                    ordered = np.sort(found)
                    out.append((keys[k], n, shared, ordered.tobytes(), found[:take].view(np.int64), *parity_sketch(ordered).tolist()))
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n", "shared", "shingles", "first", *names])

    schema = "key long, n long, shared long, shingles binary, first array<long>, " + ", ".join(f"{x} long" for x in names)
    return packs.groupBy("slice").applyInArrow(choose, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b): the smallest node that it can reach.

    Each round takes the smallest label among neighbours, then the label of the label; the rows of a round are written to
    the shared folder.  Rounds go with the logarithm of the longest chain.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = written(low.join(jump, "root", "left").select("node", "was", F.least("root", "further").alias("root")), "labels")
        removed(labels)
        labels = moved.select("node", "root")
        if moved.where("was <> root").isEmpty():
            removed(both)
            return labels


def verified(pairs: DataFrame, sets: DataFrame, per_part: int = 200) -> DataFrame:
    """The pairs (a, b) of set hashes that link.  sets: (key, n, shingles).

    The set of an a is sent once for every `per_part` pairs of it, in front of the sets of its b; rows stream through.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, head = None, 0, np.empty(0, U)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, n, data in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("n").to_pylist(), batch.column("shingles"), strict=True):
                mine = np.frombuffer(data.as_py(), U)
                if b is None:
                    now, size, head = a, n, mine
                elif now == a and overlap_reaches(head, mine, overlap_needed(size, n)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    counts = pairs.groupBy("a").count()
    pairs = pairs.join(counts, "a").withColumn("part", F.pmod("b", F.ceil(F.col("count") / per_part)))
    heads = pairs.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("key")).distinct()
    wanted = pairs.select("a", "part", "b", F.col("b").alias("key")).union(heads)
    rows = wanted.join(sets.select("key", "n", "shingles"), "key").select("a", "part", "b", "n", "shingles")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long")


def candidates(placed: DataFrame, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (token, key, root, …): the rows of buckets in which more than one component is that lie outside the bucket's largest
    one; of each of those buckets one row within it; and all their rows."""
    parts = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("sets"), F.min(F.xxhash64("key", F.lit(number))).alias("low"))
    main = parts.groupBy("token").agg(F.max(F.struct("sets", "root", "low")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed_rows = placed.join(main.select("token", F.col("m.root").alias("main"), F.col("m.low").alias("low")), "token")
    return mixed_rows.where("root <> main"), mixed_rows.where(F.xxhash64("key", F.lit(number)) == F.col("low")), mixed_rows


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id that links lead to, its own included."""
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    packs = written(counted(sliced(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "shingles")
    sets = packs.where("ids is not null").select(F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("sizes").alias("n"), F.col("keys").alias("key"))))
    owners = written(linkable(packs).dropDuplicates(["key"]), "linkable")
    prefix = owners.select("key", "n", "shared", F.posexplode("first").alias("at", "token")).select("token", "key", "n", (F.col("shared") - F.col("at")).alias("left"))
    shared = written(shared_buckets(prefix, ["token"], "key", leader="leader"), "buckets")

    sketch = [f"s{k}" for k in range(SKETCH)]
    # sketches of sets that link differ in no more bits than their shared shingles; an unshared one is surely apart
    apart = lambda a, b: sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in sketch), F.lit(0))
    need = lambda n, m: F.ceil((F.col(n) + F.col(m)) * PERCENT / (100 + PERCENT) - 1e-9)
    ends = lambda side: owners.select(*[F.col(x).alias(f"{side}_{x}") for x in ("key", "n", "shared", *sketch)])

    roots = spark.createDataFrame([], "node long, root long")
    tried = spark.createDataFrame([], "x long, y long")
    for number in range(ROUNDS + 1):
        if number == 0:
            found = shared.where("key <> leader").select(F.col("key").alias("x"), F.col("leader").alias("y")).distinct()
        else:
            placed = written(shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
            outside, low, all_rows = candidates(placed, number)
            fits = (F.col("x.n") * 100 >= F.col("y.n") * PERCENT) & (F.col("y.n") * 100 >= F.col("x.n") * PERCENT)
            # what can be common from the first common shingle on: enough, for one of their buckets
            same = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & fits & (F.least("x.left", "y.left") >= need("x.n", "y.n"))
            if number < ROUNDS:
                found = outside.alias("x").join(low.alias("y"), same)
            else:  # sketches come along, so that the join makes no pairs that can't link
                x, y = (t.join(owners.select("key", "shared", *sketch), "key").alias(side) for t, side in ((outside, "x"), (all_rows, "y")))
                found = x.join(y, same & (apart("x.", "y.") <= F.col("x.shared") + F.col("y.shared") - 2 * need("x.n", "y.n")))
            found = found.select(F.col("x.key").alias("x"), F.col("y.key").alias("y")).distinct().join(tried, ["x", "y"], "left_anti")
        if number < ROUNDS:
            found = found.join(ends("x"), F.col("x") == F.col("x_key")).join(ends("y"), F.col("y") == F.col("y_key"))
            found = found.withColumn("apart", apart("x_", "y_")).where(F.col("apart") <= F.col("x_shared") + F.col("y_shared") - 2 * need("x_n", "y_n"))
            # a few partners for each set, the likest; there are no more than it has buckets
            best = F.slice(F.sort_array(F.collect_list(F.struct("apart", "y"))), 1, PARTNERS)
            found = found.groupBy("x").agg(best.alias("best")).select("x", F.inline("best")).select("x", "y")
        pairs = written(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        links = written(verified(pairs, owners), "pairs-linked")
        if not links.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
        if number < ROUNDS:
            tried = tried.union(pairs).union(pairs.select("b", "a"))
        if number:
            removed(placed)

    placed = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root"))
    smallest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
