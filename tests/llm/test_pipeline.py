"""The stages on a small table, each against a plain version on what its predecessor kept."""

import hashlib
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from parcelforge.llm.common import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS), {}
    before = docs
    for name, stage in P.STAGES:
        docs = written(stage(spark, before, SF), f"test-{name}")
        seen[name] = ([tuple(r) for r in before.collect()], docs.collect())
        if name != "sentencepiece":
            assert docs.columns == P.COLUMNS
        before = docs
    was, now = seen["language_id"]
    assert len(now) >= 0.99 * len(was)
    was, now = seen["line_dedup"]
    gone = brute.removed_lines([(r[0], r[1]) for r in was])
    want = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(r[0], ())) for r in was if len(gone.get(r[0], ())) < len(r[1].split("\n"))}
    assert {r.doc_id: r.text for r in now} == want
    was, now = seen["ngram_join"]
    assert {r.doc_id for r in now} == {i for i, root in brute.components([(r[0], r[1]) for r in was]).items() if i == root}
    was, now = seen["mixture"]
    total = sum(len(r[1].split()) for r in was)
    assert abs(sum(len(r.text.split()) for r in now) - 1.5 * total) <= 0.01 * total
    was, now = seen["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((r[0], len(ids := sp.encode(r[1], add_eos=True)), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for r in was)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now) == want


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the thing and the house " * 20, "en", None, 1), (3, "the thing and the house " * 20, "en", None, 1), (4, "der und mit haus " * 20, "de", "b", 1)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            frame = written(stage(spark, frame, SF), "test-odd")
        assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_repeated_ids(spark):
    """Rows with the same id and text come out once; texts with the same id, or with none, are judged apart."""
    english, german = "the thing and the house were in the town with the river {}", "der mann und die frau sind mit dem haus in der stadt {}"
    draw = random.Random(5)
    long = lambda form, k: "\n".join(form.format(" ".join("".join(draw.choices("aeinorst", k=5)) for _ in range(3))) for _ in range(6))
    a, b, c, d = long(english, 1), long(german, 2), long(english, 3), long(german, 4)
    shared = a.split("\n")[2]
    rows = [(1, a), (1, a), (1, a), (2, b), (2, "12 34 56"), (3, c), (3, f"{d}\n{shared}"), (None, long(english, 5)), (None, long(german, 6)), (None, long(german, 6))]
    docs = spark.createDataFrame([(i, t, "de" if "der" in t else "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    as_rows = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)
    known = written(P.known_languages(spark, docs, SF), "test-ids")
    assert as_rows(known) == sorted((r for r in rows if r[1] != "12 34 56"), key=repr)
    lines = written(P.distinct_lines(spark, known, SF), "test-ids")
    # the shared line goes from the one text that has it, and no other line does
    want = [r for r in rows if r[1] != "12 34 56" and r[0] != 3] + [(3, c), (3, d)]
    assert as_rows(lines) == sorted(want, key=repr)
    texts = written(P.distinct_texts(spark, lines, SF), "test-ids")
    assert as_rows(texts) == sorted(set(want), key=repr)
