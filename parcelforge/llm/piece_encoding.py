"""SentencePiece encoding and decoding through a table of distinct chunks.

White space is written as a marker, and no piece of the vocabulary has a marker after another character.  So a text
falls into chunks (markers, then other characters) that are segmented apart from each other.  A task keeps a table of the
distinct chunks it has met, each segmented and decoded once, and joins the ids back by the chunks' positions.

The table is per task on purpose: a table for the whole corpus would have to be joined to every word of every text, a
shuffle of more rows than there are words, to save segmenting a chunk once per task.

Defined results: a null or empty text has the end id only and decodes to the empty text; repeated rows each get a row.
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import id_and_text, text_slices

MARK = "▁"
#: A task keeps chunks up to so many bytes, about; then it starts afresh (they are only segmented again).
TABLE_BYTES = 64 << 20
#: Bytes that a chunk takes besides its characters, about.
ENTRY_BYTES = 400


class ChunkModel:
    """A model file whose pieces keep to chunks."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = self.sp.encode(" a  b ", out_type=str)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or "".join(probe) != MARK * 2 + "a" + MARK * 2 + "b" + MARK:
            raise ValueError("pieces cross white space, or the model alters white space: chunks can't be segmented apart")
        self.end, self.mark = self.sp.eos_id(), self.sp.piece_to_id(MARK)
        self.numerals = [f" {i}" for i in range(len(pieces))]
        self.plain = [p.replace(MARK, " ") for p in pieces]
        self.odd = frozenset(i for i in range(len(pieces)) if self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_control(i))

    def segment(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """Ids as text, with a space before each, and decoded texts of chunks that start with a marker."""
        numerals, plain = self.numerals.__getitem__, self.plain.__getitem__
        ids_text, decoded = [], []
        # the library puts a marker before each text and takes it off again; an empty text gets none
        for ids in self.sp.encode([c[1:] for c in chunks], num_threads=1):
            ids = ids or [self.mark]
            ids_text.append("".join(map(numerals, ids)))
            decoded.append("".join(map(plain, ids)) if self.odd.isdisjoint(ids) else " " + self.sp.decode(ids))
        return ids_text, decoded


@functools.lru_cache(maxsize=2)
def chunk_model(path: str) -> ChunkModel:
    return ChunkModel(path)


class ChunkTable:
    """Ids and decoded text of the distinct chunks met so far."""

    def __init__(self, model: ChunkModel):
        self.model, self.ids, self.decoded, self.held = model, {}, {}, 0

    def learn(self, chunks: set[str]) -> None:
        if self.held > TABLE_BYTES:
            self.ids.clear()
            self.decoded.clear()
            self.held = 0
        new = list(chunks.difference(self.ids)) if self.ids else list(chunks)
        ids, decoded = self.model.segment(new)
        self.ids.update(zip(new, ids, strict=True))
        self.decoded.update(zip(new, decoded, strict=True))
        self.held += sum(2 * len(c) + len(i) for c, i in zip(new, ids, strict=True)) + ENTRY_BYTES * len(new)


CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def chunks_of(text: str) -> list[str]:
    """The marked text in chunks; the marker that the library puts first is in front."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: all ids with the end id, written in decimal with a space between,
    and the text that the ids decode to.  `model`: path of a .model file.  No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in encoded(batches, model):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids string, decoded string")


def encoded_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_pieces() with the two texts as digests, taken in the task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in encoded(batches, model):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64())] + [pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k in (1, 2)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[tuple[int, str, str]]]]:
    """ids and, for each of their texts, (number of ids, ids as text, decoded text)."""
    table = ChunkTable(chunk_model(path))
    end = f" {table.model.end}"
    for ids, texts in text_slices(batches):
        rows = [chunks_of(t) for t in texts]
        table.learn(set().union(*rows))
        out = []
        for chunks in rows:
            numerals = "".join(map(table.ids.__getitem__, chunks)) + end
            out.append((numerals.count(" "), numerals[1:], "".join(map(table.decoded.__getitem__, chunks))[1:]))
        yield ids, out
