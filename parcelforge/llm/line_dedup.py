"""Line dedup by a segment-partition edit join.

Lines within an edit distance of `EDITS` of an earlier line of any document (or the same) are removed; earlier means a
smaller (doc_id, version, line number) at its first place; the version is a hash of the text that tells texts of the same
id apart.  Lines of fewer than `LEAST` characters stay and remove nothing.

A line is cut into EDITS + 1 segments.  If two lines are within EDITS, one segment of the shorter is a substring of the
longer, at a place that their lengths and the segment's number bound (position- and length-aware selection).  So each
distinct line gives the keys of the substrings that it may share so, its own segments among them, as hashes; lines that
share a key are candidates, and a banded bit-parallel edit distance (bit vectors of the longer line's width, stopped as
soon as the bound is out of reach) verifies them.

Within a bucket of lines that share a key, all first meet the earliest one, which settles families of alike lines.  For
those it doesn't settle, what all lines of the bucket begin and end with is taken off and the rests are cut and indexed
again in the same way, so that a line is compared with the lines whose rests share a segment with its own, and of those
with the ones whose sketches of bigrams are near: the work for a line depends on its own near lines.  Equal lines are one
line before anything is compared.

Hot segments: buckets are held in a task one at a time.  Of a bucket of more than `CROWD` lines, each line is cut again
without that segment, and without what all lines of the bucket begin and end with, and dealt out anew by the new keys,
within the old one, because the rest of the lines must be within EDITS as well; that is repeated until no bucket is larger.
It splits the work and changes no result.

Defined results: null and empty texts have one empty line, which stays; lines are split at \\n only and compared as
they are; rows with the same id and text are one document, and each of them keeps or loses the same lines; a null id comes
before others; a document all of whose lines go has no lines left (and `without_lines` leaves it out).  Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import BASE, SPREAD, U, id_and_text, mixed, powers, running_sums, shared_buckets, text_slices, written

EDITS, LEAST = 2, 20
#: Lines of a bucket that a task holds at most.
CROWD = 10_000
#: Lines whose keys a task has given out.
SEEN = 500_000
#: Characters of lines whose keys are made together.
STEP = 1 << 20
#: Bits of the filter of lines whose texts are fetched, at most (16 MB), and which bits of a hash place a line in it.
MOST_BITS, BLOOM = 1 << 27, (0, 32)
#: Longs of a line's sketch of bigrams: 512 bits.
SKETCH = 8


def line_key(line: str) -> int:
    return signed(xxhash.xxh64_intdigest(line))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def segments(n: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 even segments of a string of n characters; the last ones are longer by one."""
    short, longer = divmod(n, edits + 1)
    sizes = [short + (i >= edits + 1 - longer) for i in range(edits + 1)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def probes(n: int, shorter: int, edits: int = EDITS) -> Iterator[tuple[int, int, int]]:
    """(segment number, start, length) of the substrings of a string of n characters that can equal a segment of one of
    `shorter`: what lies left and right of it can't need more edits than there are, nor more than pigeons leave."""
    more = n - shorter
    for i, (p, size) in enumerate(segments(shorter, edits)):
        low = max(0, p - i, p + more - (edits - i))
        high = min(n - size, p + i, p + more + (edits - i))
        for start in range(low, high + 1):
            yield i, start, size


@functools.lru_cache(maxsize=4096)
def plan(n: int) -> np.ndarray:
    """Rows (shorter, segment, start, size): the substrings under which a line of n characters is found and looks.

    (0, 0, 0, 0) stands for lines of EDITS characters or fewer: they can't be cut, and all are within reach of each other.
    """
    rows = {(m, *probe) if m > EDITS else (0, 0, 0, 0) for m in range(max(n - EDITS, 0), n + 1) for probe in (probes(n, m) if m > EDITS else [(0, 0, 0)])}
    return np.array(sorted(rows), np.int64)


def keys_of(line: str, within: int = 0) -> tuple[list[int], list[tuple[int, int, int]], list[int], list[tuple[int, int, int]]]:
    """Keys of a line's own segments and where they are; keys under which it is found and looks, and of what.  Both as (number, start, length)."""
    look = [(hashed(within, m, i, line[start : start + size]), (i, start, size)) for m, i, start, size in plan(len(line)).tolist()]
    n = len(line) if len(line) > EDITS else 0
    own = [(hashed(within, n, i, line[p : p + size]), (i, p, size)) for i, (p, size) in enumerate(segments(n))] if n else look
    return [k for k, _ in own], [x for _, x in own], [k for k, _ in look], [x for _, x in look]


def hashed(within: int, n: int, i: int, part: str) -> int:
    """The same for a part as keys_of_all() gives it."""
    codes, h = np.frombuffer(part.encode("utf-32-le"), np.uint32), 0
    for start in range(0, len(codes), STEP):
        some = codes[start : start + STEP]
        h += int(((some.astype(U) + U(1)) * powers(STEP)[0][: len(some)]).sum()) * pow(BASE, start, 1 << 64)
    h = (h ^ (within * 31 + n * 7 + i) * SPREAD) & 0xFFFFFFFFFFFFFFFF
    return int(mixed(np.array([h], U)).view(np.int64)[0])


def keys_of_all(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines of more than 2 * EDITS characters, STEP in all at most, and the number of the line that each is of."""
    up, down = powers(STEP)
    sums = running_sums(np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32), up)
    sizes = [len(x) for x in lines]
    plans = [plan(n) for n in sizes]
    owner = np.repeat(np.arange(len(lines)), [len(p) for p in plans])
    shorter, number, start, size = np.concatenate(plans).T
    at = (np.cumsum(sizes) - sizes)[owner] + start
    h = (sums[at + size] - sums[at]) * down[at]
    return mixed(h ^ (shorter * 7 + number).astype(U) * U(SPREAD)).view(np.int64), owner


def within_edits(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most `edits`: Myers' bit vectors over a band of 2 * edits + 1 diagonals."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < end_a and a[lo] == b[lo]:
        lo += 1
    while end_a > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[lo:end_a], b[lo:end_b]
    if len(b) <= edits:
        return True
    # rows: b, the longer one; columns: a.  Bit k of the vectors at column j stands for row j - edits + k: the band moves down with j.
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    vp, vn, score, n, m = full << edits & full, 0, edits, len(b), len(a)
    for j, c in enumerate(a):
        at = places.get(c, 0)
        x = (at >> (j - edits) if j >= edits else at << (edits - j)) & full
        d0 = (((x & vp) + vp) ^ vp | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j < n - edits:  # along the band's lowest diagonal, until that meets the last row; then along the row
            score += not d0 & top
        else:
            last = 1 << (n - 1 - j + edits)
            score += bool(hp & last) - bool(hn & last)
        if score > 2 * edits + m - n:  # the rest can't bring it back within reach
            return False
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, d0 >> 1 & hp
    return score <= edits


def version_of(text: Column | str) -> Column:
    return F.xxhash64(text)


def lines_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(line, check, doc_id, version, at) of all lines of `least` characters or more: two hashes of the line, and where it is."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            rows = [(line_key(x), signed(xxhash.xxh64_intdigest(x, seed=1)), i["doc_id"], i["version"], k) for i, t in zip(ids, texts, strict=True) for k, x in enumerate(t.split("\n")) if len(x) >= least]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["line", "check", "doc_id", "version", "at"])

    return docs.select(F.struct("doc_id", version_of("text").alias("version")).alias("doc_id"), "text").mapInArrow(split, "line long, check long, doc_id long, version long, at long")


def line_keys(docs: DataFrame) -> DataFrame:
    """(key, line) of each distinct line of a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_slices(batches):
            if len(seen) > SEEN:
                seen.clear()
            lines, names, held = [], [], 0
            for x in (x for t in texts for x in t.split("\n") if len(x) >= LEAST):
                if (h := line_key(x)) in seen:
                    continue
                seen.add(h)
                if len(x) > STEP:
                    keys = keys_of(x)[2]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([h] * len(keys), pa.int64())], names=["key", "line"])
                    continue
                if held + len(x) > STEP:
                    yield made(lines, names)
                    lines, names, held = [], [], 0
                lines.append(x)
                names.append(h)
                held += len(x)
            if lines:
                yield made(lines, names)

    def made(lines: list[str], names: list[int]) -> pa.RecordBatch:
        keys, owner = keys_of_all(lines)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(names, np.int64)[owner])], names=["key", "line"])

    return docs.mapInArrow(cut, "key long, line long")


REST = "key long, line long, rest string, within long, settled boolean"
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())


def rest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, KINDS, strict=True)], names=["key", "line", "rest", "within", "settled"])


def cut_out(crowds: DataFrame) -> DataFrame:
    """The rows (key, line, rest, within, settled) of crowded buckets, with what is left of a line without the segment that the key is of."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, line, text, within, settled in zip(*(batch.column(c).to_pylist() for c in ("key", "line", "rest", "within", "settled")), strict=True):
                _, _, look, spots = keys_of(text, within)
                rows += [(key, line, rest, within, settled) for rest in {text[:start] + text[start + size :] for k, (_, start, size) in zip(look, spots, strict=True) if k == key}]
            yield rest_batch(rows)

    return crowds.select("key", "line", "rest", "within", "settled").mapInArrow(cut, REST)


def keys_within(rests: DataFrame) -> DataFrame:
    """Of cut_out(): the rests, without what all of a bucket begin and end with, under new keys within the old one.

    What all begin with is what the least and the greatest begin with; the same holds for the ends of the reversed rests.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, line, text, settled, *ends in zip(*(batch.column(c).to_pylist() for c in ("key", "line", "rest", "settled", "low", "high", "back_low", "back_high", "shortest")), strict=True):
                left, right = (len(os.path.commonprefix(x)) for x in (ends[:2], ends[2:4]))
                rest = text[left : len(text) - min(right, ends[4] - left)]
                rows += [(k, line, rest, key, settled) for k in {*keys_of(rest, key)[2]}]
            yield rest_batch(rows)

    back = F.reverse("rest")
    ends = rests.groupBy("key").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.min(back).alias("back_low"), F.max(back).alias("back_high"), F.min(F.length("rest")).alias("shortest"))
    return rests.join(ends, "key").drop("within").mapInArrow(cut, REST)


def bigram_sketch(line: str) -> np.ndarray:
    """SKETCH longs of bits, each the parity of the number of bigrams that fall on it.  An edit ends two bigrams at most and
    makes two, so lines within EDITS have sketches within 4 * EDITS bits."""
    codes = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    grams = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.bincount((grams >> np.uint64(64 - (SKETCH * 64 - 1).bit_length())).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bits_of(lines: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes in `line`: two bits for each, in at most MOST_BITS bits, as longs.

    Beyond some MOST_BITS / 16 lines it lets more through that aren't there; it never holds back one that is.
    """
    size = min(MOST_BITS, 1 << max(10, (16 * lines.count()).bit_length()))
    places = F.explode(F.array(*[F.shiftrightunsigned("line", k).bitwiseAND(F.lit(size - 1)) for k in BLOOM]))
    words = lines.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(U)


def may_hold(bits: np.ndarray, lines: np.ndarray) -> np.ndarray:
    found, h = np.ones(len(lines), bool), lines.view(U)
    for k in BLOOM:
        p = (h >> U(k)) & U(64 * len(bits) - 1)
        found &= (bits[p >> U(6)] >> (p & U(63)) & U(1)).astype(bool)
    return found


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the wanted lines (line, distinct).  A filter of bounded size, sent to every task, leaves most other
    lines where they are; those that it lets through fall out in the join."""
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(wanted))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_slices(batches):
            lines = [x for t in texts for x in t.split("\n") if len(x) >= LEAST]
            keys = np.array([line_key(x) for x in lines], np.int64)
            if len(seen) > SEEN:
                seen.clear()
            found = {int(keys[k]): lines[k] for k in np.flatnonzero(may_hold(shared.value, keys)).tolist() if int(keys[k]) not in seen}
            seen.update(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["line", "text"])

    return docs.mapInArrow(pick, "line long, text string").join(wanted, "line", "left_semi").dropDuplicates(["line"])


def late_lines(texts: list[str], settled: list[bool] | None = None) -> list[int]:
    """Numbers of the lines of a bucket that have an earlier one within EDITS.  texts: different ones, in order of their
    places.  Lines that are settled already are not looked at again, but others may be near them."""
    late = [k for k in range(1, len(texts)) if not (settled and settled[k]) and within_edits(texts[0], texts[k])]
    known = {0, *late, *(k for k, done in enumerate(settled or ()) if done)}
    if len(known) == len(texts):
        return late
    last = max(k for k in range(len(texts)) if k not in known)
    left = len(os.path.commonprefix(texts))
    right = len(os.path.commonprefix([t[: left - len(t) - 1 : -1] for t in texts]))
    index: dict[tuple[int, int, str], list[int]] = {}
    sketches = np.array([bigram_sketch(t) for t in texts]).view(U)
    for k, text in enumerate(texts[: last + 1]):
        rest = text[left : len(text) - right]
        keys = {(m, i, rest[start : start + size]) for m, i, start, size in plan(len(rest)).tolist()}
        if k not in known:
            near = np.array(sorted({j for x in keys for j in index.get(x, ())}), np.int64)
            bits = np.bitwise_count(sketches[near] ^ sketches[k]).sum(axis=1)
            near = near[np.argsort(bits, kind="stable")][: np.count_nonzero(bits <= 4 * EDITS)]
            if any(within_edits(texts[j], text) for j in near.tolist()):
                late.append(k)
        for x in keys:
            index.setdefault(x, []).append(k)
    return late


def settled_by_first(rows: DataFrame) -> DataFrame:
    """The rows (key, line, rest, within, settled, text, place), settled also if they are near the first line of their bucket
    (hit) or are it, which looks for no other in the bucket."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [not done and within_edits(a, b) for done, a, b in zip(*(batch.column(c).to_pylist() for c in ("settled", "text", "least")), strict=True)]
            done = [x or y for x, y in zip(batch.column("settled").to_pylist(), hit, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "line", "rest", "within")), pa.array(done, pa.bool_()), pa.array(hit, pa.bool_())], names=["key", "line", "rest", "within", "settled", "hit"])

    first = rows.groupBy("key").agg(F.min(F.struct("place", "text")).alias("first"))
    met = rows.join(first, "key").select("key", "line", "rest", "within", (F.col("settled") | (F.col("place") == F.col("first.place"))).alias("settled"), "text", F.col("first.text").alias("least"))
    return met.mapInArrow(verify, "key long, line long, rest string, within long, settled boolean, hit boolean")


def settled_lines(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(line) of the lines that have an earlier one within EDITS.  buckets: (key, line); texts: (line, text, doc_id, version, at), of first places."""
    spark, place = buckets.sparkSession, F.struct("doc_id", "version", "at").alias("place")
    firsts = texts.select("line", "text", place)
    # rest: what is left of a line where it has been cut again, else null
    start = buckets.select("key", "line", F.lit(None).cast("string").alias("rest"), F.lit(0).cast("long").alias("within"), F.lit(False).alias("settled"))
    held = written(start.join(firsts, "line").select("key", "line", "rest", "within", "settled", "text", "place"), "line-held")
    done = spark.createDataFrame([], "line long")
    while True:
        crowds = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.coalesce("rest", "text"))).alias("longest")).where((F.col("n") > CROWD) & (F.col("longest") > EDITS)).select("key")
        if crowds.isEmpty():
            break
        met = written(settled_by_first(held.join(crowds, "key").withColumn("rest", F.coalesce("rest", "text"))), "line-met")
        done = written(done.union(met.where("hit").select("line")).distinct(), "line-settled")
        rests = written(cut_out(met).distinct(), "line-rests")
        inner = written(keys_within(rests).distinct(), "line-inner")
        # of lines that are not settled, and of more than one line
        open_keys = inner.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.min("settled").alias("all_settled")).where("low < high and not all_settled").select("key")
        inner = inner.join(open_keys, "key", "left_semi").join(firsts, "line").select(*held.columns)
        held = written(held.join(crowds, "key", "left_anti").union(inner), "line-held")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def late() -> pa.RecordBatch:
            found = late_lines([r[1] for r in rows], [r[2] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in found], pa.int64())], names=["line"])

        for batch in batches:
            for key, *row in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), batch.column("text"), batch.column("settled").to_pylist(), strict=True):
                if key != now:
                    if len(rows) > 1:
                        yield late()
                    now, rows = key, []
                if not rows or rows[-1][0] != row[0]:
                    rows.append((row[0], row[1].as_py(), row[2]))
        if len(rows) > 1:
            yield late()

    sorted_rows = held.select("key", "line", "text", "settled", "place").repartition("key").sortWithinPartitions("key", "place").select("key", "line", "text", "settled")
    return done.union(sorted_rows.mapInArrow(settle, "line long")).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_from: int = LEAST) -> DataFrame:
    """(doc_id, version, at): numbers of the lines to remove.  `exact_from`: lines of so many characters up to LEAST are removed as exact copies of an earlier one, not as near ones."""
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    places = written(lines_of(rows, exact_from), "lines")
    firsts = places.groupBy("line", "check").agg(F.min(F.struct("doc_id", "version", "at")).alias("first"))
    firsts = written(firsts.select("line", "check", "first.doc_id", "first.version", "first.at"), "firsts")
    buckets = written(shared_buckets(line_keys(rows), ["key"], "line"), "line-buckets")
    spots = firsts.groupBy("line").agg(F.min(F.struct("doc_id", "version", "at")).alias("first")).select("line", "first.*")
    spots = written(spots.join(buckets.select("line").distinct(), "line", "left_semi"), "line-spots")
    texts = written(texts_of(rows, spots.select("line")).join(spots, "line"), "line-texts")
    done = written(settled_lines(buckets, texts), "settled")
    gone = firsts.join(done, "line", "left_semi").select("line", "check").withColumn("near", F.lit(True))
    judged = places.join(firsts.select("line", "check", F.struct("doc_id", "version", "at").alias("first")), ["line", "check"]).join(gone, ["line", "check"], "left")
    return judged.where(F.col("near") | (F.struct("doc_id", "version", "at") != F.col("first"))).select("doc_id", "version", "at")


def removed_by_document(docs: DataFrame, id_col: str, text_col: str, exact_from: int = LEAST) -> DataFrame:
    """(gone_id_, gone_version_, gone_): the numbers of a document's removed lines, in order."""
    gone = removed_lines(docs, id_col, text_col, exact_from).distinct().groupBy(F.col("doc_id").alias("gone_id_"), F.col("version").alias("gone_version_"))
    return gone.agg(F.sort_array(F.collect_list("at")).alias("gone_"))


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_from: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row: the numbers of its removed lines, comma-joined in order.  A row's list is no longer than its lines."""
    gone = removed_by_document(docs, id_col, text_col, exact_from)
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), n_lines.cast("long").alias("n_lines"), version_of("text").alias("version"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(F.col("gone_id_")) & (rows["version"] == F.col("gone_version_")), "left")
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("gone_"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone_", ","), F.lit("")).alias("removed"))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_from: int = LEAST) -> DataFrame:
    """`docs` without the removed lines; documents that had lines and have none left are left out.  n_chars, if there, is that of the new text."""
    gone = removed_by_document(docs, id_col, text_col, exact_from)
    rows = docs.withColumn("version_", version_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = rows.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("gone_id_")) & (F.col("version_") == F.col("gone_version_")), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    kept = F.filter(lines, lambda x, k: ~F.array_contains("gone_", k.cast("long")))
    rows = rows.withColumn("kept_", F.when(F.col("gone_").isNotNull(), kept)).where("kept_ is null or size(kept_) > 0")
    rows = rows.withColumn(text_col, F.when(F.col("kept_").isNotNull(), F.array_join("kept_", "\n")).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("kept_").isNotNull(), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
