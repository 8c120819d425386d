"""Language ID by a linear-chain conditional random field over the words of a text.

Each word gets scores for each language from its affixes, its character n-grams and a lexicon of frequent words; learned
transitions say how likely a text switches language between words.  Forward-backward gives each word's probabilities, so
code-switched texts are labelled word by word; a document takes the language with the largest mean, which is its score.

Fitting: a bounded sample of labelled rows (about `PER_LANG` of each language, by a hash of their ids) is spliced into
sequences that switch between languages, with the document's label on each word, and fitted on the driver by gradient
steps.  Predicting: no shuffle; scores of the distinct words a Python worker has met are kept in a bounded table, and
forward-backward runs over all segments of a slice of texts at once (products of transition matrices join segments, so
texts of any length are labelled whole).

Defined results: null texts and texts without letters are `und` with score 0; a word is a run of characters other than
white space, of which the letters count; ties go to the first language in code point order; without any labelled row
all is `und`; repeated rows each get a row.  Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import SLICE_BYTES, id_and_text, text_slices

#: Bounds of what is fitted on: rows of a language (about), characters of a row (longer ones are cut for the fit), characters of all rows.
PER_LANG, MOST_CHARS, TOTAL_CHARS = 300, 50_000, 64_000_000
#: Languages that can be told apart at most: a model of so many takes some 300 MB.  More are refused.
MOST_LANGS = 500
#: Training sequences of so many words, and how many for each language; one word in SWITCH starts another language.
SPAN, SPANS_PER_LANG, SWITCH = 32, 700, 12
#: Words of the lexicon for each language, hashed feature weights, gradient steps.
LEXICON, SLOTS, STEPS = 3000, 1 << 16, 40
#: Bounds for the fit's memory with many languages: sequences times languages, and words of the lexicon times languages squared.
MOST_CELLS, MOST_WEIGHTS = 600_000, 36_000_000
#: Words whose scores a task keeps, at about 150 bytes.
TABLE = 200_000
SEGMENT = 64
UNDETERMINED = "und"


@dataclass
class CrfModel:
    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # of hashed features, then of the lexicon's words: one row each
    transitions: np.ndarray  # log scores, from row to column

    def scores(self, words: list[str]) -> np.ndarray:
        rows, starts = features(words, self.lexicon)
        return np.add.reduceat(self.weights[rows], starts, axis=0) if len(words) else np.zeros((0, len(self.langs)), np.float32)


def letters(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all (non-empty) words, one word after the other, and where each word's begin.

    Hashed: character n-grams of 1 to 3 with the word's ends marked, prefixes and suffixes of 1 to 4 letters.
    """
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    at = np.arange(len(codes))
    word_of = np.repeat(np.arange(len(words)), sizes)
    room = ends[word_of] - at
    found, owner = [], []

    def add(h: np.ndarray, kind: int, words_: np.ndarray) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        found.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % SLOTS)
        owner.append(words_)

    gram = np.zeros(len(codes), dtype=np.uint64)
    for n in (1, 2, 3):
        ok = room >= n
        gram = gram[: len(codes) - n + 1] * np.uint64(0x100001B3) + codes[n - 1 :] if n > 1 else codes.copy()
        add(gram[ok[: len(gram)]], n, word_of[: len(gram)][ok[: len(gram)]])
    numbers = np.arange(len(words))
    for n in (1, 2, 3, 4):
        long = numbers[sizes - 2 >= n]
        for kind, first in ((10 + n, starts[long] + 1), (20 + n, ends[long] - 1 - n)):
            h = np.zeros(len(long), dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100001B3) + codes[first + k]
            add(h, kind, long)
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    found.append(np.array([k for _, k in known], dtype=np.int64) + SLOTS)
    owner.append(np.array([i for i, _ in known], dtype=np.int64))
    rows, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return rows[order], np.cumsum(counts) - counts


def spliced(texts: dict[str, list[list[str]]], seed: int) -> tuple[list[list[str]], np.ndarray]:
    """Training sequences of SPAN words that switch between documents of different languages, and their labels."""
    draw, langs = random.Random(seed), sorted(texts)
    words, labels = [], []
    spans = min(SPANS_PER_LANG, max(2, MOST_CELLS // len(langs) ** 2))
    for home, lang in enumerate(langs):
        for _ in range(spans):
            row, row_labels, now = [], [], home
            while len(row) < SPAN:
                doc = draw.choice(texts[langs[now]])
                take = min(SPAN - len(row), 1 + int(draw.expovariate(1 / SWITCH)))
                first = draw.randrange(len(doc))
                some = doc[first : first + take]
                row += some
                row_labels += [now] * len(some)
                now = draw.randrange(len(langs))
            words.append(row)
            labels.append(row_labels)
    return words, np.array(labels)


def fit(rows: list[tuple[str, str]], seed: int = 11) -> CrfModel | None:
    """From (language, text) pairs.  Adagrad on the mean log-likelihood, with weight decay."""
    texts: dict[str, list[list[str]]] = {}
    for lang, text in sorted(rows):
        if words := [w for w in map(letters, text.split()) if w]:
            texts.setdefault(lang, []).append(words)
    langs = sorted(texts)
    if not langs:
        return None
    lexicon: dict[str, int] = {}
    for lang in langs:
        counts = Counter(w for doc in texts[lang] for w in doc)
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: min(LEXICON, MOST_WEIGHTS // len(langs) ** 2)]:
            lexicon.setdefault(w, len(lexicon))
    sequences, labels = spliced(texts, seed)
    distinct = sorted({w for s in sequences for w in s})
    number = {w: i for i, w in enumerate(distinct)}
    ids = np.array([[number[w] for w in s] for s in sequences])
    feature_rows, starts = features(distinct, lexicon)
    word_of_row = np.repeat(np.arange(len(distinct)), np.diff(np.append(starts, len(feature_rows))))
    n_langs, n_rows = len(langs), SLOTS + len(lexicon)
    weights, squares = np.zeros((n_rows, n_langs)), np.full((n_rows, n_langs), 1e-6)
    transitions, t_squares = np.zeros((n_langs, n_langs)), np.full((n_langs, n_langs), 1e-6)
    gold = np.eye(n_langs)[labels]
    gold_moves = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
    for _ in range(STEPS):
        emit = np.add.reduceat(weights[feature_rows], starts, axis=0)[ids]
        psi, step = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(transitions)
        ahead, back = np.empty_like(psi), np.empty_like(psi)
        a = np.full((len(ids), n_langs), 1.0 / n_langs)
        for t in range(SPAN):
            a = (a @ step) * psi[:, t]
            a /= a.sum(axis=1, keepdims=True)
            ahead[:, t] = a
        b = np.ones((len(ids), n_langs))
        moves = np.zeros((n_langs, n_langs))
        for t in range(SPAN - 1, -1, -1):
            back[:, t] = b
            if t:
                before, after = ahead[:, t - 1], psi[:, t] * b
                moves += step * ((before / ((before @ step) * after).sum(axis=1, keepdims=True)).T @ after)
            b = (psi[:, t] * b) @ step.T
            b /= b.sum(axis=1, keepdims=True)
        post = ahead * back
        post /= post.sum(axis=2, keepdims=True)
        by_word = np.stack([np.bincount(ids.ravel(), (gold - post)[:, :, k].ravel(), len(distinct)) for k in range(n_langs)], axis=1)
        grad = np.stack([np.bincount(feature_rows, by_word[word_of_row, k], n_rows) for k in range(n_langs)], axis=1) / ids.size - 1e-6 * weights
        squares += grad**2
        weights += 0.3 * grad / np.sqrt(squares)
        t_grad = (gold_moves - moves) / ids.size - 1e-6 * transitions
        t_squares += t_grad**2
        transitions += 0.3 * t_grad / np.sqrt(t_squares)
    return CrfModel(langs, lexicon, weights.astype(np.float32), transitions)


def marginals(emit: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, surest: bool = False) -> np.ndarray:
    """Sums over each sequence of its words' probabilities, with `surest` in one more column of the largest of each word.
    emit: scores of all words; sizes: words of each sequence (over 0)."""
    n_langs, step = emit.shape[1], np.exp(transitions)
    parts = -(-sizes // SEGMENT)
    segments, first = int(parts.sum()), np.cumsum(parts) - parts
    psi = np.ones((segments * SEGMENT, n_langs))
    spot = np.arange(len(emit)) + np.repeat(first * SEGMENT - (np.cumsum(sizes) - sizes), sizes)
    psi[spot] = np.exp(emit - emit.max(axis=1, keepdims=True))
    real = np.zeros(segments * SEGMENT, dtype=bool)
    real[spot] = True
    psi, real = psi.reshape(segments, SEGMENT, n_langs), real.reshape(segments, SEGMENT, 1)
    product = np.broadcast_to(np.eye(n_langs), (segments, n_langs, n_langs)).copy()
    for t in range(SEGMENT):
        moved = (product @ step) * psi[:, t, None, :]
        product = np.where(real[:, t, :, None], moved / moved.max(axis=(1, 2), keepdims=True), product)
    entering, leaving = np.full((segments, n_langs), 1.0 / n_langs), np.ones((segments, n_langs))
    for k in range(1, int(parts.max())):
        at = first[parts > k] + k
        a = np.einsum("si,sij->sj", entering[at - 1], product[at - 1])
        entering[at] = a / a.sum(axis=1, keepdims=True)
        at = (first + parts - 1)[parts > k] - k
        b = np.einsum("sij,sj->si", product[at + 1], leaving[at + 1])
        leaving[at] = b / b.sum(axis=1, keepdims=True)
    ahead, a = np.empty((SEGMENT, segments, n_langs)), entering
    for t in range(SEGMENT):
        moved = (a @ step) * psi[:, t]
        a = np.where(real[:, t], moved / moved.sum(axis=1, keepdims=True), a)
        ahead[t] = a
    total, b = np.zeros((segments, n_langs + surest)), leaving
    for t in range(SEGMENT - 1, -1, -1):
        post = ahead[t] * b
        post /= post.sum(axis=1, keepdims=True)
        total[:, :n_langs] += np.where(real[:, t], post, 0.0)
        if surest:
            total[:, n_langs] += np.where(real[:, t, 0], post.max(axis=1), 0.0)
        moved = (psi[:, t] * b) @ step.T
        b = np.where(real[:, t], moved / moved.sum(axis=1, keepdims=True), b)
    return np.add.reduceat(total, first, axis=0)


class WordScores:
    """Scores of the raw words met so far: word -> row; row 0 is for words without letters."""

    def __init__(self, model: CrfModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores, self.n = np.zeros((1024, len(self.model.langs)), np.float32), 1

    def learn(self, words: set[str]) -> None:
        if len(self.row) > TABLE:
            self.clear()
        new = list(words.difference(self.row))
        plain = list(map(letters, new))
        some = [(w, p) for w, p in zip(new, plain, strict=True) if p]
        scores = self.model.scores([p for _, p in some])
        while self.n + len(some) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.n : self.n + len(some)] = scores
        self.row.update((w, self.n + i) for i, (w, _) in enumerate(some))
        self.row.update((w, 0) for w, p in zip(new, plain, strict=True) if not p)
        self.n += len(some)

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words with letters of each text, and their mean probabilities; the last column is the mean of each word's largest."""
        words = [t.split() for t in texts]
        self.learn(set().union(*words))
        rows = [np.fromiter(map(self.row.__getitem__, w), np.int64, len(w)) for w in words]
        rows = [r[r > 0] for r in rows]
        sizes = np.array([len(r) for r in rows])
        means, some = np.zeros((len(texts), len(self.model.langs) + 1)), np.flatnonzero(sizes)
        if len(some):
            sums = marginals(self.scores[np.concatenate([rows[i] for i in some])].astype(np.float64), sizes[some], self.model.transitions, surest=True)
            means[some] = np.minimum(sums / sizes[some][:, None], 1.0)
        return sizes, means

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        sizes, means = self.means(texts)
        best = means[:, :-1].argmax(axis=1)
        return [(self.model.langs[k], float(mean[k])) if n else (UNDETERMINED, 0.0) for n, k, mean in zip(sizes, best, means, strict=True)]


def fold(id_col: Column) -> Column:
    """Which of five folds a row is in; fold 0 is held out of all fitting."""
    return F.crc32(id_col.cast("string")) % 5


def train(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrfModel | None:
    """Fits on about PER_LANG rows of each language that are not held out: those whose ids hash below their language's share,
    and the one that hashes lowest.  With very many languages the share of all is less, so that the rows hold TOTAL_CHARS
    characters, about; every language of a row with letters is learned.  Above MOST_LANGS languages this is an error."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.least(F.length("text"), F.lit(MOST_CHARS))).alias("chars"), F.min(at).alias("low")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"there are more than {MOST_LANGS} languages to tell apart")
    chars = sum(min(PER_LANG, r["n"]) * (r["chars"] or 0) for r in counts)
    per_lang = max(1.0, PER_LANG * min(1.0, TOTAL_CHARS / max(chars, 1)))
    share = F.lit(None).cast("double")
    if counts:
        shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(min(1.0, per_lang / r["n"]), r["low"]))])
        share = F.element_at(shares, F.col("lang"))
    some = rows.where(at <= share).select("lang", F.substring("text", 1, MOST_CHARS).alias("text")).where("text is not null").limit(int(2 * (per_lang + 1) * max(1, len(counts)))).collect()
    return fit([(r["lang"], r["text"]) for r in some], seed)


def slice_bytes(model: CrfModel | None) -> int:
    """Bytes of texts that are labelled together: fewer with many languages, as each stretch of words has a matrix of languages by languages."""
    return max(4096, SLICE_BYTES // max(1, len(model.langs if model else []) // 16) ** 2)


def languages(docs: DataFrame, model: CrfModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGS languages, and MOST_WEIGHTS of the lexicon
    limit = slice_bytes(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(shared.value) if shared.value else None
        for ids, texts in text_slices(batches, limit):
            found = table.label(texts) if table else [(UNDETERMINED, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, model: CrfModel | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text has letters and whose words are labelled with a mean probability of
    `least` at least, each by its own most probable language: text that mixes languages is kept, text in none is not.

    No shuffle: rows are left out of the batches they come in.  Without a model there is nothing to recognise, and all stay.
    """
    if model is None:
        return docs
    shared, limit = docs.sparkSession.sparkContext.broadcast(model), slice_bytes(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(shared.value)
        for batch in batches:
            at = 0
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pc.fill_null(batch.column(text_col), "")], names=["doc_id", "text"])
            for _, some in text_slices(iter([texts]), limit):
                sizes, means = table.means(some)
                yield batch.slice(at, len(some)).filter(pa.array((sizes > 0) & (means[:, -1] >= least)))
                at += len(some)

    return docs.mapInArrow(choose, docs.schema)


def word_languages(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, word, lang) of every word with letters: the most probable language of each, for code-switched texts."""
    shared, limit = docs.sparkSession.sparkContext.broadcast(model), slice_bytes(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(shared.value)
        for ids, texts in text_slices(batches, limit):
            for i, text in zip(ids, texts, strict=True):
                words = text.split()
                table.learn(set(words))
                kept = [(k, w) for k, w in enumerate(words) if table.row[w]]
                best = most_probable(table.scores[[table.row[w] for _, w in kept]].astype(np.float64), shared.value.transitions) if kept else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(kept), pa.int64()), pa.array([k for k, _ in kept], pa.int64()), pa.array([w for _, w in kept], pa.string()), pa.array([shared.value.langs[b] for b in best], pa.string())], names=["doc_id", "position", "word", "lang"]
                )

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(label, "doc_id long, position long, word string, lang string")


def most_probable(emit: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The language of the largest probability for each word, by forward-backward."""
    step, psi = np.exp(transitions), np.exp(emit - emit.max(axis=1, keepdims=True))
    ahead, a = np.empty_like(psi), np.full(psi.shape[1], 1.0 / psi.shape[1])
    for t in range(len(psi)):
        a = (a @ step) * psi[t]
        a /= a.sum()
        ahead[t] = a
    best, b = [0] * len(psi), np.ones(psi.shape[1])
    for t in range(len(psi) - 1, -1, -1):
        best[t] = int((ahead[t] * b).argmax())
        b = step @ (psi[t] * b)
        b /= b.sum()
    return best
