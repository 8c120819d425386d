"""Shared beginnings of conversations, found by z-fast tries.

A node is a distinct sequence of first turns (role and text).  Turns are read as 128-bit digests, so no text is shuffled;
the digest of a beginning is a running sum of them, so that a beginning of any length is one key.

1. One shuffle brings the turns of a conversation together, in their order, and streams them into segments of at most
   `SEGMENT` turns: a conversation of any length takes bounded memory.  A segment after the first hangs below the key of what is before it.
2. Each task inserts its segments into a z-fast trie: a compacted trie whose nodes stand in a table under their handle, the
   key of the beginning whose length is the two-fattest number on the node's edge.  A fat binary search looks up
   log2(length) handles to find the exit node of a conversation.  Batches look their exit nodes up in the trie as it is; conversations that
   end on a node are counted there, the others are inserted from where they left it.  A full trie is given out and begun anew.
3. The edges of the compacted tries are expanded to a row for each node, with what the task knows of it, and summed by key.
   So a beginning that many conversations share leaves a task once.
4. Sums over subtrees need no walk over the tree.  The smallest member of a node owns it; a conversation owns the nodes of its path
   from some depth on, and each node has one owner.  So children, leaves and saved bytes of a subtree are sums over its members of
   what they own, and one more aggregation by key gives them.

Defined results: turns are ordered by number, null first, equal ones by the digest of role and text; null roles and texts
are empty; repeated rows are turns of their own; rows without a conversation id belong to no conversation and are left
out; an empty table has no nodes.  Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import BASE, SPREAD, U, written

#: Turns of a segment, and keys that a trie holds, at most.
SEGMENT, HELD = 1024, 2_000_000
#: Conversation ids that are put into one text before they are dealt out, in characters.
TEXT = 1 << 16
#: Turns that a rebuilt conversation takes from another one at most.
BORROWED = 8
SEGMENTS = "conv_id long, start long, last boolean, one array<long>, two array<long>, bytes array<long>"
NODES = "one long, two long, depth long, up_one long, up_two long, n_convs long, conv_id long, n_ends long, before long"


def fingerprints(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, digest, n_bytes) of every turn: of its role and text, and the UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.md5(whole).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).where("conv_id is not null")


def borrowed(conv_id: int) -> int:
    """First turns that a rebuilt conversation takes from the one whose place in fives is the first."""
    return zlib.crc32(str(conv_id).encode()) % (BORROWED + 1)


class Splitter:
    """Segments of conversations whose turns come in order, with the keys of all beginnings."""

    def __init__(self, limit: int, rebuild: bool):
        self.limit, self.rebuild = limit, rebuild
        self.conv: int | None = None
        self.group: int | None = None
        self.base = np.zeros((0, 3), U)
        self.out: list[tuple] = []

    def add(self, group: int, conv: int, turns: np.ndarray) -> None:
        """Further turns, rows of two halves of a digest and the bytes."""
        if conv != self.conv:
            self.close()
            if group != self.group:
                self.group, self.base = group, turns[:0]
            self.conv, self.seen, self.start, self.sums, self.bytes = conv, 0, 0, (U(0), U(0)), 0
            self.skip = 0 if not self.rebuild or conv == group else borrowed(conv)
            self.pending = self.base[: self.skip]
        if conv == group and self.rebuild and len(self.base) < BORROWED:
            self.base = np.concatenate((self.base, turns[: BORROWED - len(self.base)]))
        own = turns[max(self.skip - self.seen, 0) :]
        self.seen += len(turns)
        self.pending = np.concatenate((self.pending, own))
        while len(self.pending) > self.limit:
            self.emit(self.limit, False)

    def close(self) -> None:
        if self.conv is not None:
            self.emit(len(self.pending), True)
            self.conv = None

    def emit(self, n: int, last: bool) -> None:
        turns, self.pending = self.pending[:n], self.pending[n:]
        keys = []
        for lane, base in ((0, BASE), (1, SPREAD)):
            up = np.full(n, U(base))
            up[:1] = U(pow(base, self.start + 1, 1 << 64))
            sums = np.full(n + 1, self.sums[lane])
            sums[1:] += np.cumsum(turns[:, lane] * np.cumprod(up))
            keys.append(sums)
        total = self.bytes + np.concatenate(([0], np.cumsum(turns[:, 2]))).astype(np.int64)
        self.out.append((self.conv, self.start, last, keys[0].view(np.int64), keys[1].view(np.int64), total))
        self.start, self.sums, self.bytes = self.start + n, (keys[0][-1], keys[1][-1]), int(total[-1])

    def batch(self) -> pa.RecordBatch:
        conv, start, last, *arrays = zip(*self.out, strict=True)
        self.out = []
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in arrays[0]]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in arrays]
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(start, pa.int64()), pa.array(last, pa.bool_()), *lists], names=["conv_id", "start", "last", "one", "two", "bytes"])


def segments(turns: DataFrame, rebuild: bool = False, limit: int = SEGMENT) -> DataFrame:
    """The segments of fingerprints(): each has the keys and total bytes of the beginnings from `start` turns on.

    `rebuild`: conversation c is made of the first h turns of conversation c - c % 5 (all if fewer, none if it isn't there) and
    its own turns after its first h, with h = crc32(c) % 9.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(limit, rebuild)
        for batch in batches:
            if not batch.num_rows:
                continue
            halves = np.frombuffer(bytes.fromhex("".join(batch.column("digest").to_pylist())), U).reshape(-1, 2)
            rows = np.column_stack((halves, batch.column("n_bytes").to_numpy().astype(U)))
            group, conv = batch.column("family").to_numpy(), batch.column("conv_id").to_numpy()
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(conv)) + 1).tolist(), len(conv)]):
                splitter.add(int(group[a]), int(conv[a]), rows[a:b])
            if splitter.out:
                yield splitter.batch()
        splitter.close()
        if splitter.out:
            yield splitter.batch()

    family = F.expr("conv_id - conv_id % 5") if rebuild else F.col("conv_id")
    rows = turns.withColumn("family", family).repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", "turn", "digest")
    return rows.select("family", "conv_id", "digest", "n_bytes").mapInArrow(split, SEGMENTS)


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the largest power of two divides."""
    return b & -1 << (a ^ b).bit_length() - 1


class ZFastTrie:
    """Compacted trie of sequences that are given by the keys of their beginnings.

    A node's edge goes from depth `top` to depth `bottom`; it holds the keys of these depths, top included.  `handles`: node by the
    key at the two-fattest depth of its edge.  `names`: node by the key at the first depth of its edge.  Roots are the
    empty beginning and those below which further segments hang.
    """

    def __init__(self):
        self.handles: dict[tuple[int, int], int] = {}
        self.names: dict[tuple[int, int], int] = {}
        self.roots: dict[tuple[int, int], int] = {}
        self.top: list[int] = []
        self.bottom: list[int] = []
        self.keys: list[list[tuple[int, int]]] = []
        self.bytes: list[list[int]] = []
        self.parent: list[int] = []
        self.low: list[int | None] = []
        self.members: list[int] = []
        self.ends: list[int] = []
        self.held = 0

    def new(self, parent: int, top: int, keys: list[tuple[int, int]], sizes: list[int]) -> int:
        node = len(self.top)
        self.top.append(top)
        self.bottom.append(top + len(keys) - 1)
        self.keys.append(keys)
        self.bytes.append(sizes)
        self.parent.append(parent)
        self.low.append(None)
        self.members.append(0)
        self.ends.append(0)
        self.held += len(keys)
        return node

    def register(self, node: int) -> None:
        """Puts a node with an edge under its handle and name."""
        top, keys = self.top[node], self.keys[node]
        self.handles[keys[two_fattest(top, self.bottom[node]) - top]] = node
        self.names[keys[1]] = node

    def root(self, start: int, key: tuple[int, int], size: int) -> int:
        node = self.roots.get(key)
        if node is None:
            node = self.roots[key] = self.new(-1, start, [key], [size])
        return node

    def locate(self, start: int, keys: list[tuple[int, int]], node: int) -> tuple[int, int, int]:
        """(deepest node whose whole edge is on the path, exit node, depth that the path shares with the trie), by fat binary
        search below `node`, which is on the path.  keys: of depths from `start` on."""
        end = start + len(keys) - 1
        a, b = self.bottom[node], end
        exit_node = node
        while a < b:
            f = two_fattest(a, b)
            found = self.handles.get(keys[f - start])
            if found is None:
                b = f - 1
                continue
            bottom = self.bottom[found]
            if bottom > end or self.keys[found][-1] != keys[bottom - start]:
                exit_node = found
                break
            node = exit_node = found
            a = bottom
        if exit_node == node and a < end:
            exit_node = self.names.get(keys[a + 1 - start], node)
        if exit_node == node:
            return node, node, a
        # how far the path goes along the edge: keys of beginnings are equal up to there
        top, edge = self.top[exit_node], self.keys[exit_node]
        low, high = top + 1, min(self.bottom[exit_node], end)
        while low < high:
            mid = (low + high + 1) // 2
            if edge[mid - top] == keys[mid - start]:
                low = mid
            else:
                high = mid - 1
        return node, exit_node, low

    def insert(self, start: int, keys: list[tuple[int, int]], sizes: list[int], node: int) -> int:
        """Makes the node where the path ends, if there is none, and gives it."""
        end = start + len(keys) - 1
        node, at, depth = self.locate(start, keys, node)
        if depth < self.bottom[at]:
            at = self.split(at, depth)
        if depth == end:
            return at
        leaf = self.new(at, depth, keys[depth - start :], sizes[depth - start :])
        self.register(leaf)
        return leaf

    def split(self, node: int, depth: int) -> int:
        """Cuts an edge; the upper part is a new node."""
        n, keys, sizes = depth - self.top[node], self.keys[node], self.bytes[node]
        upper = self.new(self.parent[node], self.top[node], keys[: n + 1], sizes[: n + 1])
        self.top[node], self.keys[node], self.bytes[node], self.parent[node] = depth, keys[n:], sizes[n:], upper
        self.held -= n
        self.register(node)
        self.register(upper)
        return upper

    def insert_batch(self, batch: list[tuple[int, int, bool, list[tuple[int, int]], list[int]]]) -> None:
        """Rows (conv_id, start, last, keys, bytes): exit nodes of all are looked up first, then what leaves the trie is inserted."""
        places = []
        for _, start, _, keys, sizes in batch:
            root = self.root(start, keys[0], sizes[0])
            places.append((self.locate(start, keys, root)))
        for (conv, start, last, keys, sizes), (node, at, depth) in zip(batch, places, strict=True):
            if not (depth == start + len(keys) - 1 and node == at):
                at = self.insert(start, keys, sizes, node)
            self.members[at] += 1
            self.ends[at] += last
            self.low[at] = conv if self.low[at] is None else min(self.low[at], conv)

    def expanded(self) -> Iterator[pa.RecordBatch]:
        """A row of NODES for each depth of each edge; counts are those of the subtree."""
        members, low = self.members[:], self.low[:]
        for node in sorted(range(len(self.top)), key=self.bottom.__getitem__, reverse=True):
            up = self.parent[node]
            if up >= 0:
                members[up] += members[node]
                low[up] = low[node] if low[up] is None else min(low[up], low[node])
        rows: list[tuple] = []
        for node in range(len(self.top)):
            keys, sizes, top = self.keys[node], self.bytes[node], self.top[node]
            if self.parent[node] < 0:
                if top == 0:
                    rows.append((*keys[0], 0, None, None, members[node], low[node], self.ends[node], 0))
                continue
            last = len(keys) - 1
            rows += [(*keys[d], top + d, *keys[d - 1], members[node], low[node], self.ends[node] if d == last else 0, sizes[d - 1]) for d in range(1, last + 1)]
            if len(rows) > 20_000:
                yield node_batch(rows)
                rows = []
        if rows:
            yield node_batch(rows)


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])


def trie_nodes(parts: DataFrame, held: int = HELD) -> DataFrame:
    """(one, two, depth, up_one, up_two, n_convs, conv_id, n_ends, before) of every node: its key and its parent's, members, the
    smallest of them, those that end there, and the bytes of the turns above."""

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                conv, start, last, one, two, sizes = (some.column(c).to_pylist() for c in ("conv_id", "start", "last", "one", "two", "bytes"))
                keys = [list(zip(x, y, strict=True)) for x, y in zip(one, two, strict=True)]
                trie.insert_batch(list(zip(conv, start, last, keys, sizes, strict=True)))
                if trie.held > held:
                    yield from trie.expanded()
                    trie = ZFastTrie()
        yield from trie.expanded()

    same = [F.min(c).alias(c) for c in ("depth", "up_one", "up_two", "before")]
    sums = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends")]
    found = parts.mapInArrow(insert, NODES).groupBy("one", "two").agg(*same, *sums)
    return found.select(*(c.split()[0] for c in NODES.split(", ")))


def id_digests(ends: DataFrame, text: int = TEXT) -> DataFrame:
    """(one, two, ends_sha256): SHA-256 of the ids (one, two, conv_id) of a key, in order, comma-joined.

    The ids are sorted by range, so that those of one key are dealt over tasks, and joined to texts there; then a digest runs over
    the texts of a key, whatever their number.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, size = None, None, [], 0
        rows: list[tuple] = []
        for batch in batches:
            for one, two, conv in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "conv_id")), strict=True):
                if (one, two) != now or size > text:
                    if ids:
                        rows.append((*now, first, ",".join(ids)))
                    now, first, ids, size = (one, two), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(rows) > 500:
                yield texts(rows)
                rows = []
        if ids:
            rows.append((*now, first, ",".join(ids)))
        if rows:
            yield texts(rows)

    def texts(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["one", "two", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            rows: list[tuple] = []
            for one, two, ids in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), batch.column("ids"), strict=True):
                if (one, two) != now:
                    if now:
                        rows.append((*now, running.hexdigest()))
                    now, running = (one, two), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_py().encode())
            if rows:
                yield digests(rows)
        if now:
            yield digests([(*now, running.hexdigest())])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["one", "two", "ends_sha256"])

    ranged = ends.repartitionByRange("one", "two", "conv_id").sortWithinPartitions("one", "two", "conv_id").mapInArrow(join, "one long, two long, first long, ids string")
    return ranged.repartition("one", "two").sortWithinPartitions("one", "two", "first").select("one", "two", "ids").mapInArrow(digest, "one long, two long, ends_sha256 string")


def shared_prefixes(rows: DataFrame, rebuild: bool = False, segment: int = SEGMENT, held: int = HELD, **columns: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    saved_tokens: over the node's subtree, the bytes of texts that all members but one could share.
    """
    parts = written(segments(fingerprints(rows, **columns), rebuild, segment), "prefix-segments")
    nodes = written(trie_nodes(parts, held), "prefix-nodes")
    # each conversation: the depth from which it owns its path, the bytes above that, and whether it owns a leaf
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("own"), F.min_by("before", "depth").alias("x"), F.max_by(F.col("n_convs") == F.col("n_ends"), "depth").alias("leaf"))
    ends = parts.where("last").select("conv_id", F.element_at("one", -1).alias("one"), F.element_at("two", -1).alias("two"), F.element_at("bytes", -1).alias("total"))
    # one that owns nothing shares all its turns
    shares = ends.select("conv_id", "total").join(owners, "conv_id", "left").select("conv_id", F.coalesce("own", F.lit((1 << 62))).alias("own"), F.coalesce("x", "total").alias("x"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"))
    paths = parts.join(shares, "conv_id").select("start", "last", "own", "x", "leaf", F.size("one").alias("n"), F.posexplode(F.arrays_zip("one", "two")).alias("at", "key"))
    paths = paths.where("at > 0 or start = 0").select("key.one", "key.two", (F.col("start") + F.col("at")).alias("depth"), (F.col("last") & (F.col("at") == F.col("n") - 1)).alias("end"), "own", "x", "leaf")
    below = paths.groupBy("one", "two").agg(
        F.sum(F.when(F.col("depth") < F.col("own"), F.col("x")).otherwise(0)).alias("x"), F.sum("leaf").alias("n_leaves"),
        F.sum((~F.col("end") & (F.col("own") <= F.col("depth") + 1)).cast("long")).alias("n_children"),
    )
    parents = nodes.select(F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(below, ["one", "two"]).join(id_digests(ends.select("one", "two", "conv_id")), ["one", "two"], "left").join(parents, ["up_one", "up_two"], "left")
    saved = F.col("x") - (F.col("n_convs") - 1) * F.col("before")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
