"""Operator 11: sum-of-squares online packing of tokenised documents.

A task tokenises its own rows and places each document as it comes.  Open windows are
known by their fill level alone: a level array counts how many stand at each level, and
a document goes to the level for which the sum of the squared counts becomes smallest,
a new window being level 0.  A document of a window or more is cut into full windows
first, and only its rest is placed.

What is still open at the end of a task, or beyond a bound of tokens, is filled up: the
emptiest windows are cut to fill the fullest ones, so every window is full but the last
of a task, which is cut into windows whose sizes are powers of two.  No window is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import hashed_words
from .shared import Words, hash_words, small_batches, table, text_slices

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Tokens in open windows beyond which they are filled up, and rows of a batch of results.
OPEN_TOKENS, BATCH_ROWS = 2_000_000, 2000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Last bytes of white space that is not cut at: control characters, and characters of two and three bytes.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WIDE = [bytes(x.encode()) for x in "\x85\xa0                　"]


def text_units(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """The texts of a slice as units of white space and the word after it, in the place of words.

    A byte-level tokenizer joins nothing over the end of a word, so a text's ids are
    those of its units, one after the other.  A word that ends in white space other than ASCII's
    is one unit with what follows.
    """
    w = hash_words(buf, offsets, lower=False)
    starts, ends = offsets[:-1], offsets[1:]
    whole = starts[ends > starts]
    inner = w.end[~np.isin(w.end, offsets)]
    odd = inner[_ODD[buf[inner - 1]]]
    if len(odd):
        data = buf.tobytes()
        inner = np.setdiff1d(inner, [e for e in odd.tolist() if data[e - 1] < 0x20 or data[e - 2 : e] in _WIDE or data[e - 3 : e] in _WIDE], assume_unique=True)
    start = np.sort(np.concatenate((whole, inner)))
    end = np.append(start[1:], len(buf)) if len(start) else start
    return w._replace(start=start, end=end, first=np.searchsorted(start, offsets))


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class Levels:
    """Open windows by fill level; pieces of full windows come out as rows."""

    def __init__(self, size: int, base: int = 0):
        self.size, self.next = size, base
        self.count = np.zeros(size + 1, np.int64)  # the level array
        self.open: list[list[tuple[int, list[Piece]]]] = [[] for _ in range(size)]
        self.tokens = 0  # in open windows
        self.rows: list[tuple[Piece, int, int]] = []

    def choose(self, length: int) -> int:
        """The level whose use makes the sum of squared counts smallest, the fullest of equals; 0 is a new window."""
        rest = self.size - length
        here = self.count[: rest + 1]
        change = 2 * (self.count[length:] - here) + 2
        change[0] -= 1  # no level loses a window
        change[rest] -= 1  # no level gains one: the window is full
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return rest - int(np.argmin(change[::-1]))

    def _emit(self, number: int, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((p, number, at))
            at += len(p.ids)

    def _put(self, level: int, number: int, pieces: list[Piece]) -> None:
        self.open[level].append((number, pieces))
        self.count[level] += 1
        self.tokens += level

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: Piece) -> None:
        length = len(piece.ids)
        level = self.choose(length)
        number, pieces = self.open[level].pop() if level else (self._new(), [])
        if level:
            self.count[level] -= 1
            self.tokens -= level
        pieces.append(piece)
        if level + length == self.size:
            self._emit(number, pieces)
        else:
            self._put(level + length, number, pieces)

    def add_document(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Full windows of a long document are its own; the rest is placed."""
        full = len(ids) // self.size * self.size
        for a in range(0, full, self.size):
            self._emit(self._new(), [Piece(doc_id, a, ids[a : a + self.size], len(ids))])
        if full < len(ids):
            self.add(Piece(doc_id, full, ids[full:].copy(), len(ids)))  # a copy: the batch's ids go
        if self.tokens > OPEN_TOKENS:
            self.fill_up()

    def fill_up(self, last: bool = False) -> None:
        """The emptiest open windows are cut to fill the fullest; the one that is left stays open, or, last, becomes windows of powers of two."""
        windows = [(level, *w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        self.open = [[] for _ in range(self.size)]
        self.count[:] = 0
        self.tokens = 0
        while len(windows) > 1:
            level, number, pieces = windows[0]
            gap = self.size - level
            for k in range(1, len(windows)):
                gap -= windows[-k][0]
                if gap <= 0:
                    break
            donors, over = windows[len(windows) - k :], max(0, -gap)
            moved = [p for _, _, own in donors[::-1] for p in own]
            if gap > 0:  # all others together do not fill it
                windows = [(self.size - gap, number, pieces + moved)]
                break
            keep = windows[1 : len(windows) - k]
            if over:  # the fullest of the donors keeps so many of its tokens
                _, its, own = donors[0]
                kept, gone = _cut(own, over)
                moved = [p for _, _, rest in donors[:0:-1] for p in rest] + gone
                keep.append((over, its, kept))
            self._emit(number, pieces + moved)
            windows = keep
        for level, number, pieces in windows:
            if level == self.size:
                self._emit(number, pieces)
            elif not last:
                self._put(level, number, pieces)
            else:
                while level:
                    size = 1 << (level.bit_length() - 1)
                    head, pieces = _cut(pieces, size)
                    self._emit(number, head)
                    number, level = self._new(), level - size


def _cut(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The first so many tokens of pieces, and the rest."""
    head: list[Piece] = []
    for k, p in enumerate(pieces):
        if not tokens:
            return head, pieces[k:]
        n = len(p.ids)
        if n > tokens:
            return [*head, p._replace(ids=p.ids[:tokens])], [p._replace(start=p.start + tokens, ids=p.ids[tokens:]), *pieces[k + 1 :]]
        head.append(p)
        tokens -= n
    return head, []


def _batch(rows: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
    longs = lambda xs: pa.array(list(xs), pa.int64())
    return pa.RecordBatch.from_arrays(
        [longs(p.doc_id for p, _, _ in rows), longs(p.start for p, _, _ in rows), longs(len(p.ids) for p, _, _ in rows), pa.array([p.ids.astype("<u4").tobytes() for p, _, _ in rows], pa.binary()),
         longs(p.doc_tokens for p, _, _ in rows), longs(s for _, s, _ in rows), longs(o for _, _, o in rows)],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return path


def _pack(path: str | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, own = Levels(size, TaskContext.get().partitionId() << 40), hashed_words(_path(path))

        def full() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(levels.rows), BATCH_ROWS):
                yield _batch(levels.rows[k : k + BATCH_ROWS])
            levels.rows = []

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, buf, offsets in text_slices(batch.column(1)):
                got, first, _ = own.encode(text_units(buf, offsets))
                for k in range(len(offsets) - 1):
                    levels.add_document(ids[i + k], np.append(got[first[k] : first[k + 1]], np.uint32(END)))
                yield from full()
        levels.fill_up(last=True)
        yield from full()

    return run


def pack_online(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = 1024, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece.

    ids are little-endian unsigned 32-bit tokens; a document ends with token 0, so a null
    or empty text is that token alone.  Every sequence holds `tokens` tokens, but for at most
    ten of each task, whose sizes are powers of two.  Documents of up to `tokens` tokens stay whole
    unless they stand in a window that is still open at the end of a task, or when its open windows
    hold over OPEN_TOKENS.  Repeated rows are packed each by itself, a null id stays null, other
    columns are ignored, no rows give no rows.  A task's memory is a slice of text, its
    open windows and the words it knows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer_path, tokens), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole document in sequences of at most 1024 tokens."""
    packed = pack_online(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
