"""Phrase collocations of each language, counted exactly in HAT-tries.

Words are 64-bit ids (two of them, so that no two words of a task are taken for one), made of the bytes of whole slices of text at
once.  A task counts phrases of n words in a HAT-trie: a shallow trie over bytes of the phrases' word ids, three of the first
word and one of the second, whose leaves are hash containers, arrays of phrases in the order of their hashes.  A container that grows
beyond `BURST` phrases bursts into containers by the next byte.  A trie that holds more than `trie_phrases`
spills whole subtrees, the largest first, as runs in the order of the trie: a row for each first word, with the rests of its
phrases and their counts.  The rows are dealt out by language and prefix (the first word, of hot words a byte of the second
one's id too) and merged there, so nothing of a task has to outlive it, and no word's phrases meet in one task.

Phrases are counted word by word in length: one of n words is entered only where both phrases of n - 1 words in it occur
often enough.  Which ones do is told by a filter of at most 16 MB that goes to every task.  It may let more through, which
are then counted and found too rare, but it holds nothing back, so the counts are exact whatever its size.

A phrase (two words or more, `least` times or more) is scored by its weakest cut: floor(1000 a n / (l r)), where l and r count
what the cut leaves and n all words of the language.  It is dropped if a longer phrase that holds it occurs as often.

Defined results: null text counts as empty; a null language is `und`, together with a language of that name; repeated
rows count each; a language without a phrase has no row; ties go to the phrase that is first by its bytes; an empty table gives no rows.
Only the language and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import SLICE_BYTES, SPREAD, U, mixed, powers, text_slices, written
from parcelforge.llm.line_dedup import bits_of, may_hold

LEAST, LONGEST, TOP = 100, 5, 2000
#: Phrases of a container, and of a trie, at most.
BURST, TRIE_PHRASES = 1 << 15, 2_000_000
#: Bytes of a trie's phrases, besides those of phrases that it has had before, from which on these are cleared away.
SLACK_BYTES = 32 << 20
#: Phrases of a run's batches, and of a row at most.
ROWS, PACKED = 100_000, 5_000
#: A first word of this share of all words or more is hot: its phrases are dealt out by their second words too.
HOT = 1_000
#: What each byte adds to the two ids of a word.
LANES = np.random.default_rng(2).integers((1 << 64) - 1, size=(2, 256), dtype=np.uint64, endpoint=True)
#: A-Z in lower case, tabs as spaces, ends of pieces as newlines.
PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" \n\n\n\n\n\n\n\n\n"))
SCHEMA = "lang string, head string, shard int, tails string, counts array<long>"


class Words:
    """The words of some texts, in order: where they are in `codes`, their two ids, salted by language, and which are followed by one of their piece."""

    def __init__(self, texts: list[str], langs: list[str]):
        raw = []
        for t in texts:
            b = t.encode().translate(PLAIN)
            while b"  " in b:
                b = b.replace(b"  ", b" ")
            raw.append(b)
        data = b"\n".join(raw)
        self.codes = codes = np.frombuffer(data, np.uint8)
        inside = (codes != 32) & (codes != 10)
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.text = np.searchsorted(np.cumsum([0] + [len(b) + 1 for b in raw])[:-1], start, side="right") - 1
        salts = np.array([xxhash.xxh64_intdigest(x) for x in langs], U)[self.text] ^ (end - start).astype(U) * U(SPREAD)
        up, down = powers(1 << max(len(codes), SLICE_BYTES).bit_length())
        self.ids = []
        for lane in LANES:
            sums = np.zeros(len(codes) + 1, U)
            np.cumsum(lane[codes] * up[: len(codes)], out=sums[1:])
            self.ids.append(mixed((sums[end] - sums[start]) * down[start] ^ salts))
        self.followed = (start[1:] - end[:-1] == 1) & (codes[end[:-1]] == 32) if len(start) else np.zeros(0, bool)

    def hashes(self, n: int, lane: int = 0) -> np.ndarray:
        """Of the n words from each word on, whether or not they are in one piece."""
        ids, count = self.ids[lane], max(len(self.start) - n + 1, 0)
        h = np.full(count, U(n))
        for j in range(n):
            h = h * U(SPREAD) + ids[j : j + count]
        return mixed(h)

    def phrases(self, n: int, often: np.ndarray | None) -> np.ndarray:
        """First words of the phrases of n words in one piece; `often`: filter that both phrases of n - 1 words must pass."""
        count = max(len(self.start) - n + 1, 0)
        ok = np.ones(count, bool)
        for j in range(n - 1):
            ok &= self.followed[j : j + count]
        if often is not None and count:
            part = may_hold(often, self.hashes(n - 1))
            ok &= part[:-1] & part[1:]
        return np.flatnonzero(ok)


def taken(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of codes, one after the other."""
    return codes[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Entries:
    """Phrases in the order of the trie: key (three bytes of the first word's id, one of the second's, then 32 bits of the phrase's hash), check
    (a second hash), head (the first word's id), count, number of the language, and where in the trie's texts the text is."""

    FIELDS = ("key", "check", "head", "count", "lang", "start", "size")
    __slots__ = FIELDS

    def __init__(self, *columns: np.ndarray):
        for name, column in zip(self.FIELDS, columns, strict=True):
            setattr(self, name, column)

    def __len__(self) -> int:
        return len(self.key)

    def some(self, at: slice | np.ndarray) -> Entries:
        return Entries(*(getattr(self, f)[at] for f in self.FIELDS))


def settled(parts: list[Entries]) -> Entries:
    """One entry for each phrase."""
    whole = parts[0] if len(parts) == 1 else Entries(*(np.concatenate([getattr(p, f) for p in parts]) for f in Entries.FIELDS))
    order = np.argsort(whole.key, kind="stable")
    key, check = whole.key[order], whole.check[order]
    # two phrases of one key, one in 2 ** 32 for each pair of a container, may stand in turns: they have several entries, whose counts are added when runs are merged
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))))
    found = whole.some(order[first])
    found.count = np.add.reduceat(whole.count[order], first)
    return found


class HatTrie:
    """Counts of phrases: containers by path (depth, bytes of word ids), inner nodes, and the texts that entries have brought along."""

    LEVELS = 4

    def __init__(self, words: int, limit: int = TRIE_PHRASES, burst: int = BURST, hot: np.ndarray | None = None):
        """words: of a phrase; hot: the first three bytes of the ids of hot first words."""
        self.words, self.limit, self.burst, self.hot = words, limit, burst, np.zeros(0, U) if hot is None else hot
        self.inner: set[tuple[int, int]] = set()
        self.containers: dict[tuple[int, int], list[Entries]] = {}  # the first part is settled
        self.langs: dict[str, int] = {}
        self.stores: list[np.ndarray] = []  # parts of the texts, in order
        self.stored = self.held = 0

    def count(self, words: Words, langs: list[str], at: np.ndarray) -> None:
        """Enters the phrases that begin at the words `at`."""
        if not len(at):
            return
        n = self.words
        one, two = (words.hashes(n, lane)[at] for lane in (0, 1))
        key = one >> U(32)
        head = words.ids[0][at]
        key |= head >> U(40) << U(40)
        if n > 1:
            key |= words.ids[0][at + 1] >> U(56) << U(32)
        numbers = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)
        start = words.start[at]
        found = settled([Entries(key, two, head, np.ones(len(at), np.int64), numbers[words.text[at]], start, (words.end[at + n - 1] - start).astype(np.int32))])
        found.start = self.store(words.codes, found)
        self.put(0, 0, found)
        if self.stored > SLACK_BYTES + 64 * self.held:
            self.clear()

    def store(self, codes: np.ndarray, entries: Entries) -> np.ndarray:
        """Keeps the texts of entries and says where they are now."""
        begin = self.stored
        self.stores.append(taken(codes, entries.start, entries.size))
        self.stored += len(self.stores[-1])
        return begin + np.cumsum(entries.size, dtype=np.int64) - entries.size

    def put(self, depth: int, path: int, part: Entries) -> None:
        node = depth, path
        if node in self.inner:
            byte = (part.key >> U(56 - 8 * depth)) & U(255)
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(byte)) + 1).tolist(), len(part)]):
                self.put(depth + 1, path << 8 | int(byte[a]), part.some(slice(a, b)))
            return
        parts = self.containers.setdefault(node, [])
        parts.append(part)
        self.held += len(part)
        if sum(map(len, parts[1:])) > max(len(parts[0]), self.burst // 8):
            self.settle(node)
        if len(parts[0]) > self.burst and depth < self.LEVELS:
            self.settle(node)
            whole = self.containers.pop(node)[0]
            self.held -= len(whole)
            self.inner.add(node)
            self.put(depth, path, whole)

    def settle(self, node: tuple[int, int]) -> Entries:
        parts = self.containers[node]
        if len(parts) > 1:
            before = sum(map(len, parts))
            parts[:] = [settled(parts)]
            self.held += len(parts[0]) - before
        return parts[0]

    def texts(self) -> np.ndarray:
        if len(self.stores) > 1:
            self.stores = [np.concatenate(self.stores)]
        return self.stores[0] if self.stores else np.zeros(0, np.uint8)

    def clear(self) -> None:
        """Keeps the texts of the entries alone."""
        old, self.stores, self.stored = self.texts(), [], 0
        for node in self.containers:
            entries = self.settle(node)
            entries.start = self.store(old, entries)

    def spill(self) -> Iterator[pa.RecordBatch]:
        """Beyond the limit, whole subtrees leave as runs, the largest first, until half the limit is held."""
        if self.held <= self.limit:
            return
        for node in list(self.containers):
            self.settle(node)
        top = lambda node: node[1] >> 8 * max(node[0] - 1, 0)
        sizes: dict[int, int] = {}
        for node, parts in self.containers.items():
            sizes[top(node)] = sizes.get(top(node), 0) + len(parts[0])
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= self.limit // 2:
                break
            yield from self.run([node for node in self.containers if top(node) == first])
        self.clear()

    def run(self, nodes: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        """Takes containers out, in the order of the trie."""
        names = pa.array(list(self.langs), pa.string())
        waiting: list[Entries] = []
        for node in sorted(nodes, key=lambda x: x[1] << 8 * (self.LEVELS - x[0])):
            waiting.append(self.settle(node))
            self.held -= len(waiting[-1])
            del self.containers[node]
            if sum(map(len, waiting)) > ROWS:
                yield self.batch(waiting, names)
                waiting = []
        if waiting:
            yield self.batch(waiting, names)

    def batch(self, parts: list[Entries], names: pa.Array) -> pa.RecordBatch:
        """A row for each first word, or shard of a hot one, with the rests of its phrases; single words stand together by their ids."""
        lang, start, size, key, count = (np.concatenate([getattr(p, f) for p in parts]) for f in ("lang", "start", "size", "key", "count"))
        single = self.words == 1
        group = key >> U(52) if single else np.concatenate([p.head for p in parts])
        shard = (key >> U(52)).astype(np.int32) if single else np.where(np.isin(key >> U(40), self.hot), (key >> U(32)) & U(255), U(0)).astype(np.int32)
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (lang[1:] != lang[:-1]) | (shard[1:] != shard[:-1])))
        since = np.arange(len(fresh)) - np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        first = np.flatnonzero(fresh | (since % PACKED == 0))
        last = np.append(first[1:], len(fresh)) - 1
        codes = np.append(self.texts(), np.uint8(10))
        text = taken(codes, start, size + 1)  # with a byte behind each phrase, for the newline
        ends = np.cumsum(size + 1)
        begins = ends - size - 1
        text[ends - 1] = 10
        rest = np.zeros(len(size), np.int64)  # where the rest of a phrase begins
        if not single:
            gaps = np.flatnonzero(text == 32)
            rest = gaps[np.searchsorted(gaps, begins)] - begins + 1
        sizes = size + 1 - rest
        sizes[last] -= 1  # no newline behind the last of a row
        tails = packed_strings(taken(text, begins + rest, sizes), np.add.reduceat(sizes, first))
        heads = packed_strings(taken(text, begins[first], np.maximum(rest[first] - 1, 0)), np.maximum(rest[first] - 1, 0))
        counts = pa.ListArray.from_arrays(pa.array(np.append(first, len(fresh)).astype(np.int32)), pa.array(count))
        return pa.RecordBatch.from_arrays([names.take(pa.array(lang[first])), heads, pa.array(shard[first]), tails, counts], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.run(list(self.containers))


def packed_strings(codes: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(codes))


def counted(rows: DataFrame, n: int, often: np.ndarray | None, hot: np.ndarray | None, least: int, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """(lang, phrase, f) of the phrases of n words that occur `least` times or more.  rows: (doc_id: the language, text).
    For n = 1, the phrase '' has the number of all words of a language."""
    shared = rows.sparkSession.sparkContext.broadcast((often, hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = HatTrie(n, trie_phrases, hot=shared.value[1]), {}
        for langs, texts in text_slices(batches):
            words = Words(texts, langs)
            trie.count(words, langs, words.phrases(n, shared.value[0]))
            yield from trie.spill()
            if n == 1:
                for lang, k in zip(langs, np.bincount(words.text, minlength=len(langs)).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + k
        yield from trie.rest()
        if totals:
            n_langs, none = len(totals), [""] * len(totals)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(none), pa.array([-1] * n_langs, pa.int32()), pa.array(none), pa.array([[x] for x in totals.values()], pa.list_(pa.int64()))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    runs = rows.mapInArrow(count, SCHEMA).repartition("lang", "head", "shard")
    single = runs.select("lang", "head", "shard", F.explode(F.arrays_zip(F.split("tails", "\n").alias("tail"), F.col("counts").alias("f"))).alias("x"))
    merged = single.select("lang", "head", "shard", "x.tail", "x.f").groupBy("lang", "head", "shard", "tail").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("shard") < 0))
    return merged.select("lang", F.when(F.col("head") == "", F.col("tail")).otherwise(F.concat("head", F.lit(" "), "tail")).alias("phrase"), "f")


def phrase_hashes(phrases: DataFrame, n: int) -> DataFrame:
    """(line): the hashes of phrases (lang, phrase) of n words, as those in texts have them."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in text_slices(batches):
            found = Words(texts, langs).hashes(n)[::n]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["line"])

    return phrases.select(F.col("lang").alias("doc_id"), F.col("phrase").alias("text")).mapInArrow(hashes, "line long")


def hot_words(words: DataFrame) -> np.ndarray:
    """The first three bytes of the ids of words that are a thousandth of all words or more; so there are a thousand at most."""
    total = words.where("phrase = ''").agg(F.sum("f")).first()[0] or 0
    often = words.where((F.col("phrase") != "") & (F.col("f") * HOT >= total)).select("lang", "phrase").collect()
    return np.unique(Words([r.phrase for r in often], [r.lang for r in often]).ids[0] >> U(40)) if often else np.zeros(0, U)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", trie_phrases: int = TRIE_PHRASES) -> list[DataFrame]:
    """For each number of words from 1 on, (lang, phrase, f) of the phrases of so many words that occur `least` times or more."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found, often, hot = [], None, None
    for n in range(1, longest + 1):
        found.append(written(counted(rows, n, often, hot, least, trie_phrases), f"phrases-{n}"))
        if n == 1:
            hot = hot_words(found[0])
        if n < longest:
            often = bits_of(phrase_hashes(found[-1].where("phrase != ''"), n))
    return found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language, by score, a and phrase."""
    tables = frequent_phrases(docs, least, longest, lang_col, text_col, trie_phrases)
    totals = tables[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    known = tables[0].where("phrase != ''")
    candidates = tables[1]
    for t in tables[2:]:
        candidates = candidates.union(t)
    known = known.union(candidates)
    candidates = candidates.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    within = candidates.where("size(words) > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    # the longer one can't occur more often: it holds the phrase wherever it occurs
    alone = candidates.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = alone.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * (exact["a"] * exact["n"]), "low": exact["l"] * exact["r"]}).withColumn("score", F.expr("up div low"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
