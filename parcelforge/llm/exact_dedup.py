"""Exact dedup: partitions by length class and hash range, each of which owns a Patricia trie of full byte strings.

Texts are normalised (A-Z in lower case).  Every task first enters its own rows, so that a text of which there are
thousands leaves a task once; then the distinct texts are dealt by length and content hash and entered into the trie of
their partition, where texts with a common beginning share it.  Texts are equal when the same terminal node ends them,
byte for byte; the node stores the owner (smallest or largest id) and the number of rows.  A table of tries that holds
more than `trie_bytes` spills its largest subtrees to files of the task and goes through them afterwards, one at a time.

Defined results: null counts as empty, and empty texts are equal to each other; of repeated rows with the same id one
group is made like of any others, and each row is given back; a null id owns a text only if no other does; `kept` is true
for each row with the owner's id, so rows of one text that share that id, or are all without one, stay together; an empty
table gives no rows.  Only the id and text columns are read, so other columns
can't clash.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import SLICE_BYTES, id_and_text, text_slices

TRIE_BYTES = 96 << 20
#: Memory of a node besides its label, about.
NODE_BYTES = 300


class Node:
    """The bytes on the way to it, children by first byte, and the owner and number of rows; texts end here if that is above 0."""

    __slots__ = ("children", "label", "owner", "rows")

    def __init__(self, label: bytes, owner: int | None = None, rows: int = 0):
        self.label, self.owner, self.rows, self.children = label, owner, rows, {}


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Compressed radix trie of byte strings.  `best` picks the owner of two ids (min or max); null ids come last.

    `sizes`: bytes that the subtrees of the root hold, by first byte.
    """

    def __init__(self, best: Callable[[int, int], int]):
        self.root, self.best, self.sizes = Node(b""), best, {}

    def insert(self, key: bytes, owner: int | None, rows: int) -> int:
        """Enters the string and gives the bytes that this has added."""
        node, first, added = self.root, key[:1], 0
        while True:
            n = shared(node.label, key)
            if n < len(node.label):  # part of the label: split the node
                below = Node(node.label[n:], node.owner, node.rows)
                below.children = node.children
                node.label, node.owner, node.rows, node.children = node.label[:n], None, 0, {below.label[0]: below}
                added += NODE_BYTES
            key = key[n:]
            if not key:
                node.owner = owner if node.owner is None else node.owner if owner is None else self.best(node.owner, owner)
                node.rows += rows
                break
            child = node.children.get(key[0])
            if child is None:
                node.children[key[0]] = Node(key, owner, rows)
                added += len(key) + NODE_BYTES
                break
            node = child
        if first:
            self.sizes[first[0]] = self.sizes.get(first[0], 0) + added
        return added

    def cut(self, first: int) -> Node:
        """Takes the subtree of a first byte out."""
        del self.sizes[first]
        return self.root.children.pop(first)

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        return strings(self.root)


def strings(top: Node) -> Iterator[tuple[bytes, int | None, int]]:
    """(string, owner, rows) of all terminal nodes of a subtree, without recursion."""
    stack = [(b"", top)]
    while stack:
        before, node = stack.pop()
        text = before + node.label
        if node.rows > 0:
            yield text, node.owner, node.rows
        stack += [(text, child) for child in node.children.values()]


class SpillingTries:
    """A trie for each (length class, hash range), within a bound of memory: beyond it, the largest subtrees are moved to files.

    A length class is the number of bits of the length; a file holds the subtrees of one hash range.  What of a file is
    beyond the bound again is cut by the next bits of the hash, at most LEVELS times.
    """

    BITS, LEVELS = 5, 4

    def __init__(self, best: Callable[[int, int], int], limit: int, level: int = 0):
        self.best, self.limit, self.level, self.tries, self.held = best, limit, level, {}, 0
        self.folder: tempfile.TemporaryDirectory | None = None
        self.spilled: set[tuple[tuple[int, int], int]] = set()

    def insert(self, key: tuple[int, int], text: bytes, owner: int | None, rows: int) -> None:
        key = key[0].bit_length(), (key[1] >> 64 - self.BITS * (self.level + 1)) & (1 << self.BITS) - 1
        trie = self.tries.get(key)
        if trie is None:
            trie = self.tries[key] = PatriciaTrie(self.best)
        self.held += trie.insert(text, owner, rows)
        if self.held > self.limit and self.level < self.LEVELS:
            self.spill()

    def spill(self) -> None:
        """Moves the largest subtrees out, until half the bound is held."""
        sizes = sorted(((n, key, first) for key, trie in self.tries.items() for first, n in trie.sizes.items()), reverse=True)
        for n, key, first in sizes:
            if self.held <= self.limit // 2:
                break
            self.move(key, first)
            self.held -= n

    def move(self, key: tuple[int, int], first: int) -> None:
        """Appends a subtree to the file of its hash range, each string without what it shares with the one before."""
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="tries-")
        before = b""
        with open(os.path.join(self.folder.name, str(key[1])), "ab") as f:
            for text, owner, rows in strings(self.tries[key].cut(first)):
                n = shared(before, text)
                pickle.dump((n, text[n:], owner, rows), f)
                before = text
        self.spilled.add((key, first))

    def items(self) -> Iterator[tuple[tuple[int, int], bytes, int | None, int]]:
        """((length, hash), string, owner, rows) of all strings; spilled subtrees whole, file by file."""
        for key, first in list(self.spilled):
            if first in self.tries[key].sizes:
                self.move(key, first)
        for trie in self.tries.values():
            for text, owner, rows in trie.items():
                yield (len(text), signed(text)), text, owner, rows
        self.tries, self.held = {}, 0
        if self.folder is None:
            return
        with self.folder:
            for name in sorted(os.listdir(self.folder.name)):
                again, text = SpillingTries(self.best, self.limit, self.level + 1), b""
                with open(os.path.join(self.folder.name, name), "rb") as f:
                    while True:
                        try:
                            n, rest, owner, rows = pickle.load(f)
                        except EOFError:
                            break
                        text = text[:n] + rest
                        again.insert((len(text), signed(text)), text, owner, rows)
                yield from again.items()


def normalised(text: str) -> bytes:
    return text.encode().lower()  # of bytes: A-Z alone


def signed(text: bytes) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


FIELDS = ["n_bytes", "hash", "text", "owner", "n_rows"]
SCHEMA = "n_bytes long, hash long, text binary, owner long, n_rows long"


def as_batches(items: Iterator[tuple[tuple[int, int], bytes, int, int]], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for (n, h), text, owner, count in items:
        rows.append((n, h, text, owner, count))
        held += n + 40
        if held > limit:
            yield made(rows)
            rows, held = [], 0
    if rows:
        yield made(rows)


def made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FIELDS)


def owned_texts(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_sha256, keep_id, group_size) of every distinct normalised text; the row of the smallest or largest id owns it.

    One shuffle, of texts that are distinct within their task, by length and hash.
    """
    best = {"smallest": min, "largest": max}[keep]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = SpillingTries(best, trie_bytes)
        for ids, texts in text_slices(batches):
            for i, text in zip(ids, map(normalised, texts), strict=True):
                tries.insert((len(text), signed(text)), text, i, 1)
        yield from as_batches(tries.items())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = SpillingTries(best, trie_bytes)
        for batch in batches:
            columns = [batch.column(c) for c in FIELDS]
            for row in zip(*columns, strict=True):
                n, h, text, owner, rows = (x.as_py() for x in row)
                tries.insert((n, h), text, owner, rows)
        found = ((hashlib.sha256(text).hexdigest(), owner, count) for _, text, owner, count in tries.items())
        while rows := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["text_sha256", "keep_id", "group_size"])

    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    once = rows.mapInArrow(own, SCHEMA).repartition("n_bytes", "hash")
    return once.mapInArrow(merge, "text_sha256 string, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, kept or not.

    The rows find their text's owner by its digest: small rows, and the side with a row for each distinct text has one
    of each key, so that a hot text is a skewed join that Spark splits.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([hashlib.sha256(normalised(t)).hexdigest() for t in texts], pa.string())], names=["doc_id", "text_sha256"])

    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, text_sha256 string")
    owners = owned_texts(docs, keep, trie_bytes, id_col, text_col)
    return rows.join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
