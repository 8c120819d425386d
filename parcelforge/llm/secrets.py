"""Secret scans: fixed patterns, and Markov models of characters for secrets that no pattern knows.

Two Markov models of the characters of a string are trained from labelled samples: random strings (seeded draws over the
alphabets that keys are written in) and ordinary identifiers (words of a bounded sample of the documents, alone and
joined the way code joins them).  A run of key characters is a finding if the log-likelihood ratio per character of the
two models, given the character before, passes a threshold; if it doesn't, its stretches of 20 or more characters that
do are, each out to the separators around it, so that ordinary characters beside a secret don't hide it.

Defined results: a null or empty text has no spans; equal spans of one kind are reported once; repeated rows each get a
row.  Base spans are never dropped; they are cut out of the runs that the models look at, so that no model span overlaps
one.  An empty table trains on the fixed words of identifiers alone.  Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import bounded_sample, id_and_text, text_slices

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base kinds.  Letters are ASCII ones.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same as runs of any length of which the shorter ones are dropped
#: Strings that the models look at: 20 or more key characters, digits and letters among them.
LEAST_CHARS = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
#: Characters that join the parts of paths, names and assignments.
SEPARATORS = "/=_-"
#: Words that ordinary identifiers are made of: letters alone, so that no part of a key is one.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])")
ALPHABET = "".join(map(chr, range(33, 127)))
#: Rows that the models of ordinary identifiers are fitted on, at most, and strings of either kind.
SAMPLE_ROWS, SAMPLE_STRINGS = 500, 5000
#: Longer texts are not in that sample.
SAMPLE_CHARS = 50_000
#: Natural-log odds per character above which a candidate counts as random.
THRESHOLD = 0.5
#: Words of ordinary identifiers, which every sample is completed with.
IDENTIFIERS = (
    "get set add remove update delete create find list count sum total price value name user customer address account order item product quantity date time start end begin index key id type kind status state code "
    "error message response request http url path file folder directory source target main test build release version config resource resources package module class method function object string number integer "
    "boolean array map table column row field record database query result cache buffer queue thread process worker job task event handler listener service client server host port network socket stream reader "
    "writer parser builder factory manager controller model view page session login password security example default max min average size length width height first last next previous is enabled has can should "
    "retry timeout limit offset per unit from into with without java python src com org net"
).split()


class CharModel:
    """Order-1 Markov model with add-one smoothing; characters outside the alphabet count as one more."""

    def __init__(self, strings: list[str]):
        counts = np.ones((len(ALPHABET) + 1,) * 2)
        for s in strings:
            codes = coded(s)
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True))


def coded(s: str) -> np.ndarray:
    codes = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) - 33
    return np.where((codes < 0) | (codes >= len(ALPHABET)), len(ALPHABET), codes)


def random_strings(n: int, seed: int) -> list[str]:
    """Labelled samples of random strings: hex, base-36, base-62 and base-64 of 16 to 64 characters."""
    draw = random.Random(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    kinds = (digits + "abcdef", lower + digits, lower.upper() + digits, lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "-_")
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(16, 64))) for i in range(n)]


def ordinary_strings(words: list[str], n: int, seed: int) -> list[str]:
    """Labelled samples of identifiers: words alone and joined as code, paths and dates join them."""
    draw, found, words = random.Random(seed), list(IDENTIFIERS), [*words, *IDENTIFIERS * (1 + len(words) // len(IDENTIFIERS) // 2)]
    for _ in range(n):
        some = draw.choices(words, k=draw.randint(1, 5))
        joint = draw.choice(("_", "-", "/", "", "="))
        some = [w.capitalize() for w in some] if joint == "" else [w.upper() for w in some] if draw.random() < 0.1 else some
        found.append(joint.join(some) + (draw.choice(("", "_", "-")) + str(draw.randint(0, 2030)) if draw.random() < 0.2 else ""))
    return found


def train(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of the two models for each pair of characters.  Fits on at most SAMPLE_ROWS rows, those whose ids hash lowest."""
    usual = id_and_text(docs, id_col, text_col).where(F.length("text") <= SAMPLE_CHARS)
    rows = bounded_sample(usual, SAMPLE_ROWS, seed).select("text").collect()
    words = sorted({w for r in rows for w in WORD.findall(r.text)})
    return CharModel(random_strings(SAMPLE_STRINGS, seed)).logs - CharModel(ordinary_strings(words, SAMPLE_STRINGS, seed + 1)).logs


def odds(s: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio per character of random against ordinary."""
    codes = coded(s)
    return float(ratio[codes[:-1], codes[1:]].mean())


def mixed(s: str) -> bool:
    return re.search(r"[0-9]", s) is not None and re.search(r"[A-Za-z]", s) is not None


def uncovered(start: int, end: int, spans: list[tuple[int, int]], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What is left of start to end without the spans, in pieces of LEAST_CHARS or more.  spans: in order and apart; ends: where they end."""
    k = bisect_right(ends, start)
    while k < len(spans) and spans[k][0] < end:
        a, b = spans[k]
        if a - start >= LEAST_CHARS:
            yield start, a
        start, k = max(start, b), k + 1
    if end - start >= LEAST_CHARS:
        yield start, end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def stretches(s: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the stretches of LEAST_CHARS or more, digits and letters among them, whose odds pass the threshold.

    A stretch passes if the sum of its log ratios, less the threshold each, is above 0.  Of ends in a row at which some
    stretch passes, the one with the largest sum is taken with its start; what is left beside is gone through again.
    """
    codes = coded(s)
    gains = ratio[codes[:-1], codes[1:]] - threshold
    if gains.sum() > 0 and mixed(s):
        return [(0, len(s))]
    chars = codes + 33
    digit, small = (chars >= 48) & (chars <= 57), chars | 32
    letter = (small >= 97) & (small <= 122)
    found, todo = [], [(0, len(s))]
    while todo:
        start, end = todo.pop()
        sums, places = np.concatenate(([0.0], np.cumsum(gains[start : end - 1]))), np.arange(end - start)
        # of stretches whose last character is at a place: how far right they may start
        latest = np.minimum.reduce([places - LEAST_CHARS + 1, *(np.maximum.accumulate(np.where(x[start:end], places, -1)) for x in (digit, letter))])
        lowest = np.minimum.accumulate(sums)
        best = np.where(latest >= 0, sums - lowest[np.maximum(latest, 0)], 0)
        passed = np.flatnonzero(best > 0)
        if not len(passed):
            continue
        first = np.maximum.accumulate(np.where(sums == lowest, places, 0))  # where the lowest sum so far is
        taken = []
        for ends in np.split(passed, np.flatnonzero(np.diff(passed) > 1) + 1):
            last = ends[best[ends].argmax()]
            a, b = start + int(first[latest[last]]), start + int(last) + 1
            while a > start and s[a] not in SEPARATORS and s[a - 1] not in SEPARATORS:
                a -= 1
            while b < end and s[b - 1] not in SEPARATORS and s[b] not in SEPARATORS:
                b += 1
            if taken and a < taken[-1][1]:
                taken[-1] = min(a, taken[-1][0]), max(b, taken[-1][1])
            else:
                taken.append((a, b))
        found += taken
        todo += uncovered(start, end, taken, [b for _, b in taken])
    return sorted(found)


def spans_of(text: str, ratio: np.ndarray | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all findings in order; with ratio None, of the base kinds alone."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if ratio is not None:
        base = merged([(a, b) for a, b, _ in found])
        ends = [b for _, b in base]
        for m in CANDIDATE.finditer(text):
            for start, end in uncovered(m.start(), m.end(), base, ends) if mixed(m.group()) else ():
                found += [(start + a, start + b, 3) for a, b in stretches(text[start:end], ratio, threshold)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row; code points, end exclusive.

    `ratio`: what train() gives, trained on these documents if None.  No shuffle but that of the training sample.
    """
    ratio = train(docs, id_col=id_col, text_col=text_col) if ratio is None else ratio

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            found = [spans_of(t, ratio, threshold) for t in texts]
            base = [[x for x in spans if x[2] < 3] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([sum(x[2] == k for x in spans) for spans in found], pa.int64()) for k in range(4)), pa.array([hashlib.sha256(written_out(b).encode()).hexdigest() for b in base], pa.string()), pa.array(map(written_out, found), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(docs: DataFrame, ratio: np.ndarray | None = None, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts with each stretch of findings replaced by the mark."""
    ratio = train(docs, id_col=id_col, text_col=text_col) if ratio is None else ratio

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            out = []
            for text in texts:
                parts, at = [], 0
                for a, b, _ in spans_of(text, ratio):
                    if b > at:
                        parts += [text[at:a], mark] if a >= at else []
                        at = b
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(redact, "doc_id long, text string")
