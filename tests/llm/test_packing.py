"""Packing against the tokenizers library and the limits that sequences keep."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import packing
from parcelforge.llm.queries import op13_packing
from tests.llm.test_operators import ODD, docs

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
POWERS = {1 << k for k in range(13)}


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abZ 'stre\n\t1!éßÉ日😀▁\x00<>|×÷Ωσς̌.,-\xa0\x85\x1c²ªİ가ᄀJ", max_size=40), max_size=5))
def test_ids_equal_the_library(texts):
    texts = [*texts, "a<|endoftext|>b", "don't"]
    assert [x.tolist() for x in packing.encoder(WORD_BPE).encoded(texts)] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def held(rows, texts):
    """Checks the contract of the pieces of texts, a list of (doc_id, text) of different ids."""
    ids = {i: np.array([*library().encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.length > 0
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and sum(r.length for r in pieces) == len(ids[i])
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and total <= 4096 and len(pieces) <= 64
        padding += 0 if total in POWERS else 4096 - total
    assert padding == 0


def test_packing(spark):
    rows = list({i: (i, t) for i, t in ODD}.values())
    assert not packing.packed_documents(docs(spark, []), WORD_BPE, 2).count()
    held(packing.packed_documents(docs(spark, rows).repartition(3), WORD_BPE, 2).collect(), rows)
    twice = packing.packed_documents(docs(spark, [(8, "a"), (8, "a"), (None, "b")]), WORD_BPE, 2).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (8, 2), (8, 2)]


def test_packing_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = op13_packing(spark, sf)
    held(got.collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert sorted(got.collect()) == sorted(op13_packing(spark, sf).collect())


def test_long_texts_are_encoded_whole(spark, monkeypatch):
    text = "étude, of 12 things\nand more " * 400
    assert packing.encoder(WORD_BPE).encoded([text])[0].tolist() == np.concatenate([packing.encoder(WORD_BPE).encoded([p])[0] for p in packing.parts_of(text, 100)]).tolist()


@pytest.mark.parametrize("limits", [packing.Limits(64, 3, 20), packing.Limits(100, 64, 7), packing.Limits(16, 1, 16), packing.Limits(50, 2, 1)])
def test_limits_hold_at_once(limits):
    rng = random.Random(3)
    examples = [packing.Example(k, np.arange(n, dtype=np.uint32), np.array([rng.random() < 0.4 for _ in range(n)], bool)) for k, n in enumerate(rng.choices([1, 2, 3, 5, 17, 60, 200], k=700))]
    seen, loss = {}, {x.key: x.loss for x in examples}
    packer = packing.Packer(iter(examples), limits, pool=16)
    for pieces in packer.sequences():
        total = sum(e - s for _, s, e in pieces)
        assert total == limits.tokens or total & total - 1 == 0
        assert total <= limits.tokens and len(pieces) <= limits.segments and sum(int(loss[x.key][e] - loss[x.key][s]) for x, s, e in pieces) <= limits.loss
        for x, s, e in pieces:
            seen.setdefault(x.key, []).append((s, e))
    assert len(packer.waiting) <= 64
    for x in examples:
        spans = sorted(seen[x.key])
        assert [s for s, _ in spans] == [0, *(e for _, e in spans[:-1])] and spans[-1][1] == len(x.ids)


def test_the_heuristic_prefers_what_is_plentiful():
    """With the tokens nearly used up and much loss left, the example of few tokens and much loss goes first."""
    packer = packing.Packer(iter(()), packing.Limits(100, 10, 100), pool=4)
    for key, (n, bearing) in enumerate([(20, 0), (18, 18), (10, 5)]):
        packer.admit(packing.Example(key, np.arange(n, dtype=np.uint32), np.arange(n) < bearing))
    k, whole = packer.best(20, 5, 100)
    assert whole and packer.waiting[k].key == 1


def test_examples_with_masks(spark):
    rows = [(1, [5, 6, 7], [True, False, True], "x"), (2, None, None, "y"), (3, list(range(300)), [False] * 10, "z"), (4, [1], None, None)]
    df = spark.createDataFrame(rows, "example_id long, ids array<int>, loss_mask array<boolean>, length string")
    got = packing.packed_examples(df.coalesce(1), packing.Limits(128, 4, 2)).collect()
    whole = {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {1: 3, 3: 300, 4: 1}
    assert sum(r.loss_tokens for r in got) == 3


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
