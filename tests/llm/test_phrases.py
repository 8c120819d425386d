"""Collocations against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import phrases
from tests.llm.test_operators import ODD, docs


def plain_counts(rows, longest=5):
    """f and n of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    return f, n


def plain(rows, least, top):
    f, n = plain_counts(rows)
    often = {(lang, p): a for (lang, p), a in f.items() if a >= least and len(p) > 1}
    found = {}
    for (lang, p), a in often.items():
        if any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in often.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -score) for lang, some in found.items() for k, (score, a, p, left, right) in enumerate(sorted(some)[:top], 1))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "é", "a", "b|c", "日本"]
    mix = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " ; "]) for _ in range(rng.randint(0, 120)))
    return [(k, mix() + rng.choice(["", "in new york city hall of the north", "To Be Or Not to be"]), "s", rng.choice(["en", "en", "fr", None])) for k in range(n)]


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (3, 7), (20, 50)])
def test_collocations(spark, least, top):
    rows = corpus()
    got = sorted(tuple(r) for r in phrases.collocations(docs(spark, rows), least, top=top).collect())
    assert got == plain([(r[3], r[1]) for r in rows], least, top) and got


def test_odd_texts(spark):
    rows = [(i, t, "s", lang) for i, t in ODD for lang in ("und", None)]
    got = sorted(tuple(r) for r in phrases.collocations(docs(spark, rows), 2).collect())
    assert got == plain([(r[3], r[1]) for r in rows], 2, 2000) and got
    assert not phrases.collocations(docs(spark, []), 2).count()


def test_scores_beyond_64_bits(spark):
    rows = [(k, "x y " * 4000, "s", "en") for k in range(40)]
    (first, *_) = phrases.collocations(docs(spark, rows), 100).orderBy("rank").collect()
    f, n = plain_counts([("en", "x y " * 4000)])
    assert (first.a, first.l, first.r, first.n) == (f["en", ("x", "y", "x", "y", "x")] * 40, 160_000, f["en", ("y", "x", "y", "x")] * 40, n["en"] * 40) or first.score == 1000 * first.a * first.n // (first.l * first.r)


def unpacked(batch):
    for lang, head, tails, counts in zip(*(batch.column(x).to_pylist() for x in ("lang", "head", "tails", "counts")), strict=True):
        split = tails.split("\n")
        assert len(split) == len(counts)
        for tail, n in zip(split, counts, strict=True):
            yield lang, tuple(f"{head} {tail}".strip().split(" ")), n


@pytest.mark.parametrize(("limit", "burst", "packed"), [(10**6, 10**6, 5000), (10**6, 8, 3), (100, 8, 1), (0, 1, 2)])
def test_spilled_runs_hold_every_count(limit, burst, packed, monkeypatch):
    monkeypatch.setattr(phrases, "SLACK_BYTES", 200)
    monkeypatch.setattr(phrases, "PACKED", packed)
    rows = corpus(2, 200)
    hot = np.unique(phrases.Words(["the", "of", "日本"], ["en", "en", "fr"]).ids[0] >> phrases.U(40))
    for n in (1, 2, 4, 5):
        trie, got = phrases.HatTrie(n, limit, burst, hot), Counter()
        for k in range(0, len(rows), 7):
            langs, texts = [r[3] or "und" for r in rows[k : k + 7]], [r[1] for r in rows[k : k + 7]]
            words = phrases.Words(texts, langs)
            trie.count(words, langs, words.phrases(n, None))
            for batch in trie.spill():
                for lang, p, c in unpacked(batch):
                    got[lang, p] += c
            assert trie.held <= limit
        for batch in trie.rest():
            for lang, p, c in unpacked(batch):
                got[lang, p] += c
        want = {k: c for k, c in plain_counts([(r[3], r[1]) for r in rows])[0].items() if len(k[1]) == n}
        assert got == want and not trie.containers and trie.held == 0


def test_a_phrase_has_one_place(spark):
    """Rows of a phrase go to one shard whatever task they come from; those of hot first words to several, others to one for each first word."""
    hot = np.unique(phrases.Words(["the"], ["en"]).ids[0] >> phrases.U(40))
    shards = {}
    for seed in (1, 2):
        rows = corpus(seed, 100)
        trie, langs, texts = phrases.HatTrie(2, hot=hot), [r[3] or "und" for r in rows], [r[1] for r in rows]
        words = phrases.Words(texts, langs)
        trie.count(words, langs, words.phrases(2, None))
        for batch in trie.rest():
            for r in batch.to_pylist():
                for tail in r["tails"].split("\n"):
                    assert shards.setdefault((r["lang"], r["head"], tail), r["shard"]) == r["shard"]
    heads = {}
    for (lang, head, _), shard in shards.items():
        heads.setdefault((lang, head), set()).add(shard)
    assert len(heads["en", "the"]) > 3 and all(x == {0} for k, x in heads.items() if k != ("en", "the"))


def test_runs_are_in_the_order_of_the_trie():
    rows = corpus(3, 80)
    trie = phrases.HatTrie(2, 10**6, 4)
    langs, texts = [r[3] or "und" for r in rows], [r[1] for r in rows]
    words = phrases.Words(texts, langs)
    trie.count(words, langs, words.phrases(2, None))
    assert trie.inner and max(d for d, _ in trie.inner) >= 1
    keys = np.concatenate([trie.settle(node).key for node in sorted(trie.containers, key=lambda x: x[1] << 8 * (trie.LEVELS - x[0]))])
    assert (np.diff(keys.astype(object)) >= 0).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é日.,\t\n\x0b\x0c\r!?;:|\x00", max_size=30), min_size=1, max_size=4))
def test_words(texts):
    words = phrases.Words(texts, ["en"] * len(texts))
    data = words.codes.tobytes()
    got = [(int(t), data[a:b].decode()) for t, a, b in zip(words.text, words.start, words.end, strict=True)]
    want, joined = [], []
    for k, t in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.encode().lower().decode()):
            some = re.findall(r"[^\x20\x09]+", piece)
            want += [(k, w) for w in some]
            joined += [True] * (len(some) - 1) + [False] * bool(some)
    assert got == want and words.followed.tolist() == joined[:-1] if joined else not got
    one = {}
    for (_, w), i in zip(got, words.ids[0].tolist(), strict=True):
        assert one.setdefault(w, i) == i
    assert len(set(one.values())) == len(one)
