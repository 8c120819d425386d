"""Packing of examples into sequences by vector bin packing under three limits at once.

A sequence takes at most so many tokens, segments (pieces of examples) and loss-bearing tokens.  Each task keeps a pool of
waiting examples and fills one sequence at a time by the dot-product heuristic: of the examples that fit whole, the one
whose demand (tokens, one segment, loss-bearing tokens, each as a share of its limit) has the largest dot product with
what is left of the sequence.  So an example that is large in what is plentiful goes first, and sequences end with
nothing left over in one dimension and much in another.  Where none fits whole, the best one is cut: its beginning
fills the sequence, its rest waits on.  A sequence that can't be filled, because the segments or the loss-bearing tokens
are used up or no example is left, is cut back to the largest power of two, a length that isn't padded.

No shuffle: a task packs its own rows, so a sequence holds pieces of one task, and only the last ones of a task are short.
Sequence ids hold the number of the task; rows that come in the same order again, as those of files do, are packed alike.

`packed_documents` takes texts, whose every id bears loss; `packed_examples` takes rows of ids with a mask of the
loss-bearing ones, as chat formatting gives them.

Ids are those of the tokenizers library.  Texts are cut where no rule of the tokenizer reaches across: at white space, and in
runs without apostrophes, `<` or letters beyond Latin-1 between letters, digits and other characters.  Each distinct stretch
is encoded once in a task, as long as its bounded table holds it: words of Latin-1 letters all at once in numpy, by the
merges of the tokenizer's file, anything else by the library.  A test holds both to the library on whole texts.

Defined results: a null or empty text has the end id alone; repeated rows and ids are packed as rows of their own; an
example without ids gives no piece; an empty table gives no rows.  A loss-bearing limit that one piece can't meet is
met by cutting.  A document's ids are held in its task, 4 bytes each, like its text.  Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import BASE, SLICE_BYTES, SPREAD, U, id_and_text, mixed, powers, running_sums, text_slices
from parcelforge.llm.token_counts import byte_names

#: Examples that a task chooses among.
POOL = 256
#: Distinct stretches, and their ids, that a task keeps at most; then it starts afresh (they are only encoded again).
MOST_STRETCHES, MOST_IDS = 400_000, 8_000_000
#: The rank of a pair that has none.
NONE = np.int32(2**31 - 1)
#: Rows of a result batch.
ROWS = 20_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments and loss-bearing tokens."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("each limit of a sequence must be at least 1")


class Example:
    """Ids, running counts of the loss-bearing ones (None: all are), and where the part that waits begins."""

    __slots__ = ("ids", "key", "loss", "start")

    def __init__(self, key: int | None, ids: np.ndarray, mask: np.ndarray | None = None):
        self.key, self.ids, self.start = key, ids, 0
        self.loss = None if mask is None else np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))

    def loss_of(self, start: int, end: int) -> int:
        return end - start if self.loss is None else int(self.loss[end] - self.loss[start])

    def reach(self, tokens: int, loss: int) -> int:
        """Tokens from its start on that both bounds allow."""
        n = min(tokens, len(self.ids) - self.start)
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.start] + loss, side="right")) - 1 - self.start)


class Packer:
    """Fills sequences from a stream of examples."""

    def __init__(self, examples: Iterator[Example], limits: Limits, pool: int = POOL):
        self.examples, self.limits = examples, limits
        self.most = pool
        self.waiting: list[Example | None] = [None] * pool
        self.free = list(range(pool))[::-1]
        self.tokens, self.loss = np.zeros(pool, np.int64), np.zeros(pool, np.int64)  # 0 tokens: nobody waits there

    def admit(self, x: Example) -> None:
        """Lets what is left of an example wait."""
        k = self.free.pop()
        self.waiting[k], self.tokens[k], self.loss[k] = x, len(x.ids) - x.start, x.loss_of(x.start, len(x.ids))

    def refill(self) -> None:
        """Takes examples in until so many wait that one place is left, for the rest of one that is cut."""
        while len(self.waiting) - len(self.free) < self.most - 1 and (x := next(self.examples, None)) is not None:
            if len(x.ids):
                self.admit(x)

    def best(self, tokens: int, segments: int, loss: int) -> tuple[int, bool]:
        """The place of the example to add, and whether it fits whole; -1 if there is none."""
        there = self.tokens > 0
        whole = there & (self.tokens <= tokens) & (self.loss <= loss)
        fits = bool(whole.any())
        among = whole if fits else there
        if not among.any():
            return -1, False
        most = self.limits
        score = np.minimum(self.tokens, tokens) * (tokens / most.tokens**2) + np.minimum(self.loss, loss) * (loss / most.loss**2) + segments / most.segments**2
        return int(np.argmax(np.where(among, score, -1.0))), fits

    def sequences(self) -> Iterator[list[tuple[Example, int, int]]]:
        """(example, start, end) of each sequence's pieces, in their order."""
        while True:
            pieces: list[tuple[Example, int, int]] = []
            tokens, segments, loss = self.limits.tokens, self.limits.segments, self.limits.loss
            while tokens and segments:
                self.refill()
                k, whole = self.best(tokens, segments, loss)
                if k < 0:
                    break
                x = self.waiting[k]
                n = len(x.ids) - x.start if whole else x.reach(tokens, loss)
                if not n:
                    break
                self.waiting[k], self.tokens[k], self.loss[k] = None, 0, 0
                self.free.append(k)
                pieces.append((x, x.start, x.start + n))
                tokens, segments, loss = tokens - n, segments - 1, loss - x.loss_of(x.start, x.start + n)
                x.start += n
                if x.start < len(x.ids):
                    self.admit(x)
            used = self.limits.tokens - tokens
            if not used:
                return
            if tokens:
                self.cut_back(pieces, used - (1 << used.bit_length() - 1))
            yield pieces

    def cut_back(self, pieces: list[tuple[Example, int, int]], n: int) -> None:
        """Takes the last n tokens out of the sequence again."""
        while n:
            x, start, end = pieces.pop()
            some = min(n, end - start)
            if end < len(x.ids):  # its rest waits: that begins earlier now
                k = next(k for k, y in enumerate(self.waiting) if y is x)
                self.waiting[k], self.tokens[k] = None, 0
                self.free.append(k)
            x.start = end - some
            if not self.free:
                self.grow()
            self.admit(x)
            if some < end - start:
                pieces.append((x, start, end - some))
            n -= some

    def grow(self) -> None:
        """Places for those that come back; refill() doesn't use them."""
        n = len(self.waiting)
        self.waiting += [None] * n
        self.tokens, self.loss = (np.concatenate((a, np.zeros(n, np.int64))) for a in (self.tokens, self.loss))
        self.free += range(2 * n - 1, n - 1, -1)


def packed_rows(examples: Iterator[Example], limits: Limits, task: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for number, pieces in enumerate(Packer(examples, limits).sequences()):
        offset = 0
        for x, start, end in pieces:
            rows.append((x.key, start, end - start, zlib.crc32(x.ids[start:end].tobytes()), len(x.ids), (task << 33) + number, offset, x.loss_of(start, end)))
            offset += end - start
        if len(rows) >= ROWS:
            yield made(rows)
            rows = []
    if rows:
        yield made(rows)


def made(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


# bytes of a text: white space, letters, digits, other characters; the last class is for bytes that need the whole run
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)


@functools.lru_cache(maxsize=1)
def byte_classes() -> np.ndarray:
    """0x09 to 0x0D aren't all white space to every rule, so only the space and the newline cut; 0xC3 begins letters of Latin-1."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[ord(" "), ord("\n")]] = SPACE
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1] = LETTER
    kinds[0x80:] = WHOLE
    kinds[:32][kinds[:32] == OTHER] = WHOLE
    kinds[[ord("'"), ord("<"), 0x7F]] = WHOLE
    return kinds


class WordMerges:
    """Ranked pairs of a BPE file with word ends; encodes many words at a time, each by its lowest-ranked pair first."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left, right, made = (np.array([vocab[x] for x in col], np.int64) for col in (*zip(*merges, strict=True), [a + b for a, b in merges]))
        self.made = np.append(made, 0).astype(np.int32)  # by rank
        self.table(left * self.width + right)
        first = np.full(self.width, -1)  # the first merge that makes a symbol
        first[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(first[left], first[right]) >= np.arange(len(made))).any():
            raise ValueError("this tokenizer can't be followed: a merge ranks below one that makes its parts, so that merging at once isn't merging one by one")
        names = byte_names()
        self.inner, self.last = (np.array([vocab[c + end] for c in names], np.int32) for end in ("", suffix))

    def table(self, keys: np.ndarray) -> None:
        """Two tables of slots: a pair is in the first, or in the second if another had its slot."""
        self.slots = []
        left = np.arange(len(keys))
        for bits, odd in ((20, BASE), (20, SPREAD)):
            slot = (keys[left].astype(U) * U(odd) >> U(64 - bits)).astype(np.int64)
            held, rank = np.full(1 << bits, -1), np.full(1 << bits, NONE, np.int32)
            _, first = np.unique(slot, return_index=True)
            held[slot[first]], rank[slot[first]] = keys[left[first]], left[first]
            self.slots.append((U(64 - bits), U(odd), held, rank))
            left = np.delete(left, first)
        order = np.argsort(keys[left], kind="stable")
        self.rest, self.rest_ranks = np.append(keys[left][order], -1), np.append(left[order], NONE).astype(np.int32)  # hardly ever any

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """NONE for pairs without a rank."""
        out = None
        for shift, odd, held, rank in self.slots:
            at = (pairs.view(U) * odd >> shift).view(np.int64)
            found = np.where(held[at] == pairs, rank[at], NONE)
            out = found if out is None else np.minimum(out, found)
        if len(self.rest) > 1:
            at = np.minimum(np.searchsorted(self.rest[:-1], pairs), len(self.rest) - 2)
            out = np.minimum(out, np.where(self.rest[at] == pairs, self.rest_ranks[at], NONE))
        return out

    def encode(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of non-empty words, whose lower-case bytes follow each other: their ids, in the same way, and how many each has."""
        symbols, counts = self.inner[codes], sizes.copy()
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[codes[ends]]
        live, done = np.arange(len(sizes)), []
        while len(live):
            starts = np.cumsum(sizes) - sizes
            pairs = symbols[:-1].astype(np.int64) * self.width + symbols[1:]
            ranks = np.append(self.ranks_of(pairs), NONE)
            ranks[starts + sizes - 1] = NONE  # no pair reaches into the next word
            least = np.minimum.reduceat(ranks, starts)
            on = least < NONE
            if not on.all():
                inside = np.repeat(on, sizes)
                counts[live[~on]] = sizes[~on]
                done.append((live[~on], sizes[~on], symbols[~inside]))
                live, sizes, least = live[on], sizes[on], least[on]
                symbols, ranks = symbols[inside], ranks[inside]
                if not len(live):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = ranks == np.repeat(least, sizes)
            first = hit & ~np.concatenate(([False], hit[:-1]))
            where = np.arange(len(hit))
            hit &= (where - np.maximum.accumulate(np.where(first, where, 0))) % 2 == 0  # of overlapping occurrences, every other one from the left
            symbols[hit] = self.made[ranks[hit]]
            sizes = sizes - np.add.reduceat(hit.astype(np.int64), starts)
            symbols = symbols[~np.concatenate(([False], hit[:-1]))]
        out, before = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        for words, n, found in done:
            out[ragged(before[words], n)] = found
        return out, counts


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then those of starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def lower(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of Latin-1 letters, in lower case."""
    up = (codes >= ord("A")) & (codes <= ord("Z"))
    up[1:] |= (codes[:-1] == 0xC3) & (codes[1:] >= 0x80) & (codes[1:] <= 0x9E)
    return codes + (up * np.uint8(32))


class StretchEncoder:
    """Ids of texts by a tokenizer file, each distinct stretch encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        self.library, self.merges = Tokenizer.from_file(path), WordMerges(spec)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.starts, self.held = np.zeros(1 << 14, np.int64), 0

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        raw = [t.encode() for t in texts]
        flat, counts = self.of_bytes(b"\n".join(raw), np.cumsum([0] + [len(t) + 1 for t in raw])[:-1])
        return np.split(flat, np.cumsum(counts)[:-1])

    def of_bytes(self, data: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; begins: where each begins."""
        start, end, letters = stretches(data)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(begins), np.int64)
        codes = np.frombuffer(data, np.uint8)
        up, down = powers(1 << max(len(codes), 2 * SLICE_BYTES).bit_length())
        sums = running_sums(codes, up)
        keys = mixed((sums[end] - sums[start]) * down[start] ^ (end - start).astype(U) * U(SPREAD))
        order = np.argsort(keys)
        fresh = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        first = order[fresh]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(fresh) - 1
        at = self.places(keys[first].tolist(), data, start[first], end[first], letters[first])[number]
        sizes = self.sizes[at]
        owner = np.searchsorted(begins, start, side="right") - 1
        return self.ids[ragged(self.starts[at], sizes)], np.bincount(owner, weights=sizes, minlength=len(begins)).astype(np.int64)

    def places(self, keys: list[int], data: bytes, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where the table has the ids of each distinct stretch; new ones are encoded."""
        if len(self.known) > MOST_STRETCHES or self.held > MOST_IDS:
            self.forget()
        at = np.array(list(map(self.known.get, keys, repeat(-1))), np.int64)
        new = np.flatnonzero(at < 0)
        words, others = new[letters[new]], new[~letters[new]]
        if len(words):
            sizes = end[words] - start[words]
            at[words] = self.keep([keys[k] for k in words.tolist()], *self.merges.encode(lower(np.frombuffer(data, np.uint8)[ragged(start[words], sizes)]), sizes))
        if len(others):
            found = [e.ids for e in self.library.encode_batch([data[a:b].decode() for a, b in zip(start[others].tolist(), end[others].tolist(), strict=True)], add_special_tokens=False)]
            at[others] = self.keep([keys[k] for k in others.tolist()], np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64))
        return at

    def keep(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Enters ids of new stretches and gives their places."""
        begin, n, m = len(self.known), len(keys), len(ids)
        self.sizes, self.starts, self.ids = grown(self.sizes, begin + n), grown(self.starts, begin + n), grown(self.ids, self.held + m)
        self.sizes[begin : begin + n], self.starts[begin : begin + n] = sizes, self.held + np.cumsum(sizes) - sizes
        self.ids[self.held : self.held + m] = ids
        self.held += m
        self.known.update(zip(keys, range(begin, begin + n), strict=True))
        return np.arange(begin, begin + n)


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer one that begins with it, of room for n."""
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of some UTF-8 text, and which of them are letters of Latin-1 alone."""
    codes = np.frombuffer(data, np.uint8)
    kinds = byte_classes()[codes]
    pair = np.flatnonzero((codes[:-1] == 0xC3) & (codes[1:] != 0x97) & (codes[1:] != 0xB7))  # all but the signs of multiplication and division
    kinds[pair] = kinds[pair + 1] = LETTER
    inside = kinds != SPACE
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    odd = np.concatenate(([0], np.cumsum(kinds == WHOLE)))
    plain = odd[end] == odd[start]
    # runs without odd bytes are cut between classes
    at = np.flatnonzero((kinds[1:] != kinds[:-1]) & inside[1:] & inside[:-1]) + 1
    at = at[plain[np.searchsorted(start, at, side="right") - 1]]
    start, end = np.sort(np.concatenate((start, at))), np.sort(np.concatenate((end, at)))
    letters = np.concatenate(([0], np.cumsum(kinds == LETTER)))
    return start, end, letters[end] - letters[start] == end - start


def refuse(spec: dict) -> None:
    """Raises for tokenizer files in which a rule could reach across the places where texts are cut here."""
    model, pre = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    words = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value: how such files split words
    followed = (
        model.get("type", "BPE") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        and kinds == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"].get("Regex", "").endswith(words) and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex", True)
        and all(t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) and not t.get("single_word") for t in spec.get("added_tokens", []))
    )
    if not followed:
        raise ValueError("this tokenizer can't be followed: its words, normaliser or added tokens aren't those of lower-case BPE with word ends")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> StretchEncoder:
    return StretchEncoder(path)


def parts_of(text: str, limit: int) -> Iterator[str]:
    """Stretches of a long text of about `limit` characters, cut at spaces or newlines."""
    start = 0
    while len(text) - start > limit:
        cut = min((p for p in (text.find(" ", start + limit), text.find("\n", start + limit)) if p >= 0), default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def text_examples(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, limit: int = 2 * SLICE_BYTES) -> Iterator[Example]:
    """The ids of each text, with the end id."""
    table, end = encoder(tokenizer), np.array([end_id], np.uint32)
    table.forget()
    for ids, texts in text_slices(batches, limit):
        if sum(map(len, texts)) > 2 * limit:
            found = [np.concatenate([table.encoded([p])[0] for p in parts_of(t, limit)]) for t in texts]
        else:
            found = table.encoded(texts)
        for i, x in zip(ids, found, strict=True):
            yield Example(i, np.concatenate((x, end)))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens) of every piece of every text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed_rows(text_examples(batches, tokenizer, end_id), limits, TaskContext.get().partitionId())

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA)


def packed_examples(rows: DataFrame, limits: Limits = Limits(), id_col: str = "example_id", ids_col: str = "ids", mask_col: str = "loss_mask") -> DataFrame:
    """As packed_documents, of rows of ids (array of int) and a mask of the loss-bearing ones (array of boolean, null: all are).

    Null ids are none; a mask that is shorter than the ids leaves the others without loss.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        for batch in batches:
            for key, ids, mask in zip(*(batch.column(c) for c in ("doc_id", "ids", "mask")), strict=True):
                x = np.array(ids.as_py() or [], np.uint32)
                m = mask.as_py()
                if m is not None:
                    m = np.array([bool(b) for b in m[: len(x)]] + [False] * (len(x) - len(m)), bool)
                yield Example(key.as_py(), x, m)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed_rows(examples(batches), limits, TaskContext.get().partitionId())

    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"), F.col(mask_col).cast("array<boolean>").alias("mask"))
    return picked.mapInArrow(pack, SCHEMA)
