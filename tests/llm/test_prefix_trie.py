"""Shared beginnings of conversations against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, one string, own long"


def plain(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        convs = {c: convs.get(c - c % 5, [])[: h[c]] + x[h[c] :] for c, x in convs.items()}
    members = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, some in members.items():
        children = [m for m in members if len(m) == len(node) + 1 and m[: len(node)] == node]
        below = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(some) if len(convs[c]) == len(node))
        out.append((min(some), len(node), min(members[node[:-1]]) if node else -1, len(some), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in prefix_trie.shared_prefixes(df, **options).collect())


def talks(seed, n, longest=12, alike=0.6):
    rng = random.Random(seed)
    rows, known = [], [[]]
    for c in range(n):
        base = rng.choice(known) if rng.random() < alike else []
        x = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "assistant", None]), rng.choice(["é", "hello", "", None, "long " * 9])) for _ in range(rng.randint(0 if base else 1, longest))]
        known.append(x)
        rows += [(c, k, role, text) for k, (role, text) in enumerate(x)]
    return rows


ODD = [
    (1, None, "user", None), (1, 0, None, "b"), (1, 0, None, "a"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 0, "user", "lost"), (3, 5, "user", "x" * 30_000), (3, None, "u", "ser:"), (4, 5, "user", "x" * 30_000),
    (6, 0, "user", "has no base"), (7, 0, "user", "has no base"), (12, 0, "a", "b:c"), (13, 0, "a:", "bc"), *[(40, k, "user", f"t{k % 3}") for k in range(70)], *[(41, k, "user", f"t{k % 3}") for k in range(60)], *[(45, k, "user", f"t{k % 3}") for k in range(70)],
]


@pytest.mark.parametrize("rebuild", [False, True])
@pytest.mark.parametrize("options", [{}, {"segment": 4, "held": 20}])
def test_shared_prefixes(spark, rebuild, options):
    for rows in (talks(1, 40), [*ODD, *((c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(3))]):
        assert got(spark, rows, rebuild=rebuild, **options) == plain(rows, rebuild)


def test_no_conversations(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 0, "user", "x")]) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    (root,) = got(spark, [(lone, 0, "user", "gone"), (lone, 1, "user", "gone too")], rebuild=True)
    assert root == (lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())


def test_digests_of_many_ids(spark):
    ids = random.Random(5).sample(range(-500, 10**12), 3000)
    rows = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 7), (0, 2, -1)], "one long, two long, conv_id long").repartition(5)
    found = {(r.one, r.two): r.ends_sha256 for r in prefix_trie.id_digests(rows, text=300).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == {(1, 2): sha(",".join(map(str, sorted(ids)))), (1, 3): sha("7"), (0, 2): sha("-1")}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=24), min_size=1, max_size=12), st.integers(1, 5))
def test_fat_search_finds_the_exit_node(words, size):
    """Every place in the trie is that of a search along the path, and handles are looked up log times."""
    trie, seen = prefix_trie.ZFastTrie(), []

    def keys(w):
        return [(hash(w[:d]), d) for d in range(len(w) + 1)]

    for a in range(0, len(words), size):
        trie.insert_batch([(a + k, 0, True, keys(w), [0] * (len(w) + 1)) for k, w in enumerate(words[a : a + size])])
        seen += words[a : a + size]
        root = trie.roots[keys("")[0]]
        for probe in {*words, "abab" * 6, "b" * 30}:
            shared = max(next((d for d in range(min(len(probe), len(w)), -1, -1) if probe[:d] == w[:d]), 0) for w in seen)
            node, exit_node, depth = trie.locate(0, keys(probe), root)
            assert depth == shared and trie.keys[exit_node][depth - trie.top[exit_node]] == keys(probe)[depth] and trie.bottom[node] <= depth
    rows = {}
    for batch in trie.expanded():
        for r in batch.to_pylist():
            assert rows.setdefault((r["one"], r["depth"]), (r["n_convs"], r["conv_id"], r["n_ends"])) is rows[r["one"], r["depth"]]
    want = {(hash(w[:d]), d): (sum(x.startswith(w[:d]) for x in words), next(k for k, x in enumerate(words) if x.startswith(w[:d])), words.count(w[:d])) for w in words for d in range(len(w) + 1)}
    assert rows == want


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 80):
            assert prefix_trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)
