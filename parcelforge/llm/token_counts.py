"""Token counts by byte-level BPE, merging all pre-tokens of a batch at once in numpy.

Every new distinct pre-token of a batch is held once, as a stretch of one flat array of symbol ids.  In each round every
stretch finds its lowest-ranked adjacent pair and merges all its occurrences, from the left and without overlap; all
stretches do so at the same time.  A merge can only make pairs of a higher rank than its own, so this gives what
merging one pair at a time gives.  Stretches without a ranked pair leave; their symbols are counted.

Defined results: a null or empty text has 0 tokens; repeated rows each get a row; whole texts are counted, very long ones
in pieces between pre-tokens.  Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import id_and_text, text_slices

#: The splitting pattern that byte-level BPE vocabularies of this kind are defined with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task keeps the counts of distinct pre-tokens up to so many bytes, about; then it starts afresh (they are only counted again).
MEMO_BYTES = 64 << 20
#: Bytes that an entry takes besides its characters, about.
ENTRY_BYTES = 160
#: Pre-tokens taken from a text at a time.
STEP = 1_000_000

UNRANKED = np.iinfo(np.int64).max


def refuse(spec: dict) -> None:
    """Raises for tokenizer files whose rules are others than those followed here."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    model = spec["model"]
    odd = [
        (model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"), "its model isn't plain BPE"),
        (spec.get("normalizer"), "it normalises texts"),
        (len(steps) != 1 or steps[0].get("type") != "ByteLevel" or not steps[0].get("use_regex", True) or steps[0].get("add_prefix_space"), "it doesn't split texts as byte-level BPE does"),
        (any(not t.get("special") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])), "it has added tokens with rules of their own"),
    ]
    if found := [why for is_odd, why in odd if is_odd]:
        raise ValueError(f"this tokenizer can't be followed: {'; '.join(found)}")


class MergeTable:
    """Symbols, ranked pairs and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        vocab = spec["model"]["vocab"]
        self.width = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        first = np.full(self.width, -1)  # the first merge that makes a symbol
        first[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(first[left], first[right]) >= np.arange(len(made))).any():
            raise ValueError("this tokenizer can't be followed: a merge ranks below one that makes its parts, so that merging at once isn't merging one by one")
        self.bytes = np.array([vocab[c] for c in byte_names()], dtype=np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", []) if t.get("special")), key=len, reverse=True)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (UNRANKED if it has none) and the symbol it makes."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], UNRANKED), self.made[at]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token when no pair is ranked."""
        counts = np.array([len(t) for t in tokens], dtype=np.int64)
        live = np.arange(len(tokens))
        symbols, sizes = self.bytes[np.frombuffer(b"".join(tokens), dtype=np.uint8)], counts.copy()
        while len(live):
            starts = np.cumsum(sizes) - sizes
            ranks = np.full(len(symbols), UNRANKED)
            made = np.zeros(len(symbols), dtype=np.int64)
            ranks[:-1], made[:-1] = self.find(symbols[:-1], symbols[1:])
            ranks[starts + sizes - 1] = UNRANKED  # no pair reaches into the next pre-token
            least = np.minimum.reduceat(ranks, starts)
            on = least < UNRANKED
            if not on.all():
                inside = np.repeat(on, sizes)
                counts[live[~on]] = sizes[~on]
                live, sizes, least = live[on], sizes[on], least[on]
                symbols, ranks, made = symbols[inside], ranks[inside], made[inside]
                if not len(live):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = ranks == np.repeat(least, sizes)
            at = np.arange(len(hit))
            first = hit & ~np.concatenate(([False], hit[:-1]))
            since = at - np.maximum.accumulate(np.where(first, at, 0))
            hit &= since % 2 == 0  # of overlapping occurrences, every other one from the left
            symbols = np.where(hit, made, symbols)
            keep = ~np.concatenate(([False], hit[:-1]))
            sizes = sizes - np.add.reduceat(hit.astype(np.int64), starts)
            symbols = symbols[keep]
        return counts


def byte_names() -> list[str]:
    """The character that stands for each byte in vocabularies of this kind: itself if it prints, else from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names, free = [], 256
    for b in range(256):
        names.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return names


@functools.lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def unassigned(text: str) -> dict[int, str]:
    """Characters that belong to no Unicode category yet, which newer tables may call letters: they split as symbols."""
    return {} if text.isascii() else {ord(c): "" for c in set(text) if c > "԰" and unicodedata.category(c) == "Cn"}


def pieces_of(text: str, split: regex.Pattern) -> Iterator[str]:
    odd = unassigned(text)
    if odd:
        return (text[m.start() : m.end()] for m in split.finditer(text.translate(odd)))
    return iter(split.findall(text)) if len(text) < STEP else (m.group() for m in split.finditer(text))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.  `tokenizer`: path of a byte-level BPE .json file.

    No shuffle: each task counts its own rows and keeps a bounded table of distinct pre-tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = merge_table(tokenizer), regex.compile(SPLIT)
        apart = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        memo: dict[str, int] = {}
        held = 0

        def learn(tokens: set[str]) -> None:
            nonlocal held
            if held > MEMO_BYTES:
                memo.clear()
                held = 0
            new = list(tokens.difference(memo))
            if new:
                memo.update(zip(new, table.count([t.encode() for t in new]).tolist(), strict=True))
                held += sum(map(len, new)) + ENTRY_BYTES * len(new)

        for ids, texts in text_slices(batches):
            found, longer = [], []
            for text in texts:
                parts = apart.split(text) if apart else [text]
                tokens: list[str] = []
                n = len(parts) - 1  # special strings, one token each
                for part in parts:
                    rest = pieces_of(part, split)
                    while len(part) >= STEP and (some := list(islice(rest, STEP))):
                        learn(set(some))
                        n += sum(map(memo.__getitem__, some))
                    tokens += rest
                found.append(tokens)
                longer.append(n)
            learn(set().union(*found))
            counts = [n + sum(map(memo.__getitem__, tokens)) for tokens, n in zip(found, longer, strict=True)]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
