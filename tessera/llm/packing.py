"""Operator 9: vector best-fit packing of tokenised documents.

A task tokenises its own rows and packs them as they come, so no token is
shuffled; ids are remembered by the 64-bit hashes of words.  Pieces are taken in runs of bounded size, longest first.  A sequence
has three capacities: tokens, documents, and attention cost (the sum of squared
piece lengths).  The last two are set so that they bind: the number of documents by the
corpus's mean, the cost below that of one full piece.  Among the open sequences that hold the piece under all three, the
one with the smallest weighted norm of what would remain is chosen, or the one
with the largest weighted dot product of demand and residual.
"""

from __future__ import annotations

import math
import os
from array import array
from itertools import chain
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, hash_words, small_batches, table, text_slices

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Words whose ids a worker keeps; beyond it the store starts anew.
KNOWN_WORDS = 900_000
#: Tokens of pieces that are packed together, and sequences that stay open after them.
RUN_TOKENS, OPEN = 4_000_000, 4096
#: Default capacities: documents of a sequence against the corpus's mean, and attention cost against that of one full piece.
DOCUMENTS_OF_MEAN, LEAST_DOCUMENTS, COST_SHARE = 6, 16, 0.9
#: Bytes of text that make a token at least, on the mean, to tell the corpus's mean before it is tokenised.
TOKEN_BYTES = 2.5


class WordTokenizer:
    """Ids of texts, by remembering the ids of words.

    A tokenizer that drops white space and never joins over it gives a text the ids
    of its words, one after the other; words are cut at ASCII white space only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.ids, self.first, self.new = array("I"), array("q", [0]), []
        new = self.new

        class Known(dict):
            def __missing__(self, word):
                self[word] = at = len(self)
                new.append(word)
                return at

        self.known = Known()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): the ids of text k are ids[first[k]:first[k + 1]]; size: how many each word has."""
        if len(self.known) > KNOWN_WORDS:
            self.clear()
        split = [t.split() for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        if self.new:
            for e in self.tokenizer.encode_batch_fast([w.decode() for w in self.new], add_special_tokens=False):
                self.ids.extend(e.ids)
                self.first.append(len(self.ids))
            self.new.clear()
        ids, first = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.first, np.int64)
        size = first[word + 1] - first[word]
        ends = np.cumsum(size)
        at = np.repeat(first[word] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        ends = np.concatenate(([0], ends))
        out = ids[at]  # a copy, so the store may grow again
        return out, ends[np.concatenate(([0], np.cumsum(count)))], size


_WORD = np.zeros(256, bool)
_WORD[[b for b in range(128) if chr(b).isalnum()]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def split_marks(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The texts of a slice, with a space between an ASCII letter or digit and a mark after it, and where the spaces went.

    The tokenizer cuts there anyway, so ids stay; a word with and without a mark is then
    one to remember.  Where its special tokens may stand the texts stay as they are.
    """
    at = np.flatnonzero(_WORD[buf[:-1]] & _MARK[buf[1:]]) + 1 if len(buf) > 1 else np.zeros(0, np.int64)
    data = buf.tobytes()
    if b"<|" in data:
        at = at[:0]
    if len(at):
        out = np.full(len(buf) + len(at), 0x20, np.uint8)
        shift = np.ones(len(buf), np.int64)
        shift[at] = 2
        out[np.cumsum(shift) - 1] = buf
        data, offsets = out.tobytes(), offsets + np.searchsorted(at, offsets)
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], at


class HashedWords:
    """Ids of the words of a slice, remembered by the words' 64-bit hashes in an open table of fixed size.

    Far smaller and faster than a dictionary of words; two words are taken for one with a
    probability of about 2**-64.
    """

    SLOTS = 1 << 21

    def __init__(self, own: WordTokenizer):
        self.own, self.keys = own, None
        # words are tokenised in long rows, parted by a token that stands only for itself
        marks = [(t.content, i) for i, t in own.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = marks[-1] if marks else None

    def clear(self) -> None:
        self.keys = None

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for one that is not there."""
        out, at = np.full(len(hashes), -1), (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            there = self.keys[at]
            hit = there == hashes[left]
            out[left[hit]] = self.number[at[hit]]
            more = ~hit & (there != 0)
            left, at = left[more], (at[more] + 1) & (self.SLOTS - 1)
        return out

    def _add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        at = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]  # of several for one slot the last stays
            self.number[at[free]] = numbers[left[free]]
            more = self.keys[at] != hashes[left]
            left, at = left[more], (at[more] + 1) & (self.SLOTS - 1)

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size) of a slice: the ids of text k are ids[first[k]:first[k + 1]]; size: how many each word has."""
        if self.keys is None or 3 * len(self.first) > self.SLOTS:
            self.keys, self.number = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
            self.ids, self.first = array("I"), array("q", [0])
        # units: words, cut between an ASCII letter or digit and a mark after it, as the tokenizer does anyway
        cuts = np.flatnonzero(_WORD[w.buf[:-1]] & _MARK[w.buf[1:]]) + 1 if len(w.buf) > 1 else np.zeros(0, np.int64)
        data = w.buf.tobytes()
        if b"<|" in data:  # special tokens may stand here, and only for themselves
            cuts = cuts[:0]
        start, end = np.sort(np.concatenate((w.start, cuts))), np.sort(np.concatenate((w.end, cuts)))
        hashes = w.spans(start, end) | np.uint64(1)  # no hash is 0
        at = self._find(hashes)
        missing = np.flatnonzero(at < 0)
        new, place, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        if len(new):
            place = missing[place]
            texts = [data[a:z].decode() for a, z in zip(start[place].tolist(), end[place].tolist(), strict=True)]
            base = len(self.first) - 1
            if self.mark and b"<|" not in data:
                mark, number = self.mark
                for k in range(0, len(texts), 500):
                    got = np.array(self.own.tokenizer.encode(mark.join(texts[k : k + 500]) + mark, add_special_tokens=False).ids, np.uint32)
                    end = np.flatnonzero(got == number)
                    self.first.extend((len(self.ids) + end - np.arange(len(end))).tolist())
                    self.ids.frombytes(got[got != number].tobytes())
            else:
                for e in self.own.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                    self.ids.extend(e.ids)
                    self.first.append(len(self.ids))
            self._add(new, np.arange(base, base + len(new), dtype=np.int32))
            at[missing] = base + which
        ids, first = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.first, np.int64)
        size = first[at + 1] - first[at]
        ends = np.cumsum(size)
        out = ids[np.repeat(first[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]  # a copy, so the store may grow again
        ends = np.concatenate(([0], ends))
        unit = np.searchsorted(start, np.append(w.start, len(w.buf)))  # first unit of each word
        return out, ends[unit[w.first]], np.diff(ends[unit])


_TOKENIZERS: dict[str, WordTokenizer] = {}
_HASHED: dict[str, HashedWords] = {}


def tokenizer(path: str | None = None) -> WordTokenizer:
    """The worker's tokenizer; path names a file of the tokenizers library, by default the public word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def hashed_words(path: str | None = None) -> HashedWords:
    own = tokenizer(path)
    return _HASHED.setdefault(path or TOKENIZER, HashedWords(own))


def forget_words() -> None:
    """Give back the memory of the words that the worker's tokenizers know."""
    for own in (*_TOKENIZERS.values(), *_HASHED.values()):
        own.clear()


class Packer:
    """Open sequences with their residuals."""

    def __init__(self, tokens: int, documents: int, cost: float, weights: tuple[float, float, float], rule: str):
        self.size = np.array([tokens, documents, cost], float)
        self.weights, self.rule = np.array(weights), rule
        self.left, self.number, self.used = np.zeros((64, 3)), np.zeros(64, np.int64), 0
        self.opened = 0
        self.decided = np.zeros(3, np.int64)  # placements in which a capacity alone kept a piece out of an open sequence
        self.closed = np.zeros(3, np.int64)  # sequences that a capacity closed
        self.trimmed = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece; one that is over the cost by itself has a sequence of its own."""
        need = np.array([length, 1.0, float(length) ** 2]) / self.size
        left = self.left[: self.used]
        holds = left >= need - 1e-12
        number = holds.sum(1)
        fits = np.flatnonzero(number == 3)
        self.decided += (~holds[number == 2]).any(0)
        if len(fits):
            if self.rule == "norm":
                after = left[fits] - need
                at = int(fits[np.argmin((after * after) @ self.weights)])
            else:
                at = int(fits[np.argmax(left[fits] @ (self.weights * need))])
        else:
            if self.used == len(self.left):
                self.left, self.number = np.concatenate((self.left, np.zeros_like(self.left))), np.concatenate((self.number, np.zeros_like(self.number)))
            at = self.used
            self.left[at], self.number[at] = 1.0, self.opened
            self.used, self.opened = self.used + 1, self.opened + 1
        offset = round((1 - self.left[at, 0]) * self.size[0])
        self.left[at] -= need
        out = int(self.number[at]), offset
        full = self.left[at] * self.size < (0.5, 0.5, 1.0)
        if full.any():  # nothing more goes in
            self.closed += full
            self._close(at)
        return out

    def _close(self, at: int) -> None:
        self.used -= 1
        self.left[at], self.number[at] = self.left[self.used], self.number[self.used]

    def trim(self, keep: int) -> None:
        """Keep the emptiest open sequences only."""
        if self.used > keep:
            self.trimmed += self.used - keep
            best = np.argsort(-self.left[: self.used, 0], kind="stable")[:keep]
            self.left[:keep], self.number[:keep], self.used = self.left[best], self.number[best], keep


def _rows(run: list, packer: Packer, base: int) -> Iterator[pa.RecordBatch]:
    order = sorted(range(len(run)), key=lambda k: -len(run[k][3]))
    place: list = [None] * len(run)
    for k in order:
        place[k] = packer.place(len(run[k][3]))
    packer.trim(OPEN)
    for a in range(0, len(run), 1000):
        part, at = run[a : a + 1000], place[a : a + 1000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.int64()), pa.array([len(r[3]) for r in part], pa.int64()),
             pa.array([r[3].astype("<u4").tobytes() for r in part], pa.binary()), pa.array([base + s for s, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
            ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
        )


def _pack(path, tokens, documents, cost, weights, rule):
    def run(batches):
        packer, base, run, held = Packer(tokens, documents, cost, weights, rule), TaskContext.get().partitionId() << 40, [], 0
        own = hashed_words(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, buf, offsets in text_slices(batch.column(1)):
                got, first, _ = own.encode(hash_words(buf, offsets, lower=False))
                for k in range(len(offsets) - 1):
                    doc = np.append(got[first[k] : first[k + 1]], np.uint32(END))
                    run += [(ids[i + k], p, a, doc[a : a + tokens]) for p, a in enumerate(range(0, len(doc), tokens))]
                    held += len(doc)
                if held >= RUN_TOKENS:
                    yield from _rows(run, packer, base)
                    run, held = [], 0
        yield from _rows(run, packer, base)

    return run


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = 4096, documents: int | None = None, cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.02, 0.02), rule: str = "norm", tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): a row for each piece.

    ids are little-endian unsigned 32-bit tokens; a document ends with token 1, so a
    null, empty or blank text is that token alone.  A document of more than tokens
    tokens is cut into pieces of that size, the last may be shorter.  documents bounds the
    pieces of a sequence, by default to six times what a sequence would hold on the mean;
    cost bounds the sum of squared piece lengths, by default to 0.9 of tokens squared, and a
    piece over it alone has a sequence of its own.  rule is
    "norm" or "dot".  Repeated rows are packed each by itself, a null id stays null,
    other columns are ignored, no rows give no rows.  Sequences are filled within a
    task: a task leaves its last ones open, which is at most a few for each 16 MB, and closes
    the fullest of more than OPEN open ones.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule: {rule}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if documents is None:
        size = rows.agg(F.avg(F.least(F.lit(float(tokens)), F.octet_length(F.coalesce("text", F.lit(""))) / TOKEN_BYTES + 1))).first()[0] or 1.0
        documents = max(LEAST_DOCUMENTS, math.ceil(DOCUMENTS_OF_MEAN * tokens / size))
    return rows.mapInArrow(_pack(tokenizer_path, tokens, documents, cost or COST_SHARE * float(tokens) ** 2, weights, rule), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole document, their ids' checksums and their places in sequences."""
    packed = pack_best_fit(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
