"""Terms of a batch of texts, counted inside each row with numpy: nothing is shuffled but sums by term."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms, repeated ones among them, that are held apart at once; a longer text is one slice.
SLICE = 1 << 20
#: Rows that are packed at once: their entries are held by several arrays.
ROWS = 256
#: What parts a text's words in n-grams of characters, as Java's \s.
BLANK = "[\t\n\x0b\f\r ]+"


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each length, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def _ngrams(words: list[str], low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first, gram, names): word w has the n-grams gram[first[w]:first[w + 1]], repeated ones among them, with a space at either end of it."""
    text = "".join([f" {w} " for w in words])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.array([len(w) + 2 for w in words], np.int64)
    of, end = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
    place = np.arange(len(points))
    alphabet, letter = np.unique(points, return_inverse=True)
    rank, word, gram, names = letter.astype(np.int64), [], [], []
    for n in range(2, high + 1):
        at = place[place + n <= end]
        _, first, told = np.unique(rank[at] * len(alphabet) + letter[at + n - 1], return_index=True, return_inverse=True)
        rank = np.zeros(len(points), np.int64)
        rank[at] = told
        if n >= low:
            word.append(of[at])
            gram.append(told + len(names))
            joined = points[at[first][:, None] + np.arange(n)].tobytes().decode("utf-32-le")
            names += [joined[k : k + n] for k in range(0, len(joined), n)]
    word, gram = np.concatenate(word), np.concatenate(gram)
    return np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words))))), gram[np.argsort(word, kind="stable")], names


class Counted:
    """The distinct terms of a batch (names), and slices of (row, term, tf), ordered by row and term."""

    def __init__(self, column: pa.Array, block: str):
        lists = column if block == "word" else pc.split_pattern_regex(column, BLANK)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        self.word, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.row, self.block, self.rows = row, block, len(lists)
        if block == "word":
            near = np.flatnonzero(row[1:] == row[:-1])
            pair, told = np.unique(self.word[near] * len(words) + self.word[near + 1], return_inverse=True)
            both = pc.binary_join_element_wise(words.take(pa.array(pair // max(len(words), 1))), words.take(pa.array(pair % max(len(words), 1))), " ")
            self.row, self.word = np.concatenate((row, row[near])), np.concatenate((self.word, told + len(words)))
            self.names = pa.concat_arrays([words.cast(pa.string()), both.cast(pa.string())])
        else:
            keep = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            known = keep[self.word]
            self.row, self.word = row[known], (np.cumsum(keep) - 1)[self.word[known]]
            self.first, self.gram, names = _ngrams([w for w in words.to_pylist() if w]) if keep.any() else (np.zeros(1, np.int64), np.zeros(0, np.int64), [])
            self.names = pa.array(names, pa.string())

    def slices(self, number: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """number: for each term another number, or -1 where it is not wanted."""
        width = len(self.names) if number is None else int(number.max(initial=0)) + 1
        if self.block == "word":
            yield self._distinct(self.row, self.word, number, width)
            return
        many = np.diff(self.first)[self.word]
        by_row = np.concatenate(([0], np.cumsum(np.bincount(self.row, many, self.rows)))).astype(np.int64)
        a = 0
        while a < self.rows:
            b = max(int(np.searchsorted(by_row, by_row[a] + SLICE, "right")) - 1, a + 1)
            part = slice(*np.searchsorted(self.row, [a, b]))
            yield self._distinct(np.repeat(self.row[part], many[part]), self.gram[_runs(self.first[self.word[part]], many[part])], number, width)
            a = b

    @staticmethod
    def _distinct(row: np.ndarray, term: np.ndarray, number: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if number is not None:
            term = number[term]
            row, term = row[term >= 0], term[term >= 0]
        key = np.sort(row * width + term)
        start = _starts(key)
        return key[start] // max(width, 1), key[start] % max(width, 1), np.diff(np.append(start, len(key)))


def sums_by_term(blocks: tuple[str, ...], folds: tuple[int, ...] | None = None) -> Callable:
    """Batches (a column a block, then fold where folds are given) to (block, term, df_<fold>..., total_<fold>...); without folds df and total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.zeros(batch.num_rows, np.int64)
            if folds is not None:
                fold = pc.fill_null(batch.column(len(blocks)), -1).to_numpy(zero_copy_only=False)
                of = np.full(len(fold), len(folds))
                for k, f in enumerate(folds):
                    of[fold == f] = k
            parts = len(folds) + 1 if folds is not None else 1
            for c, b in enumerate(blocks):
                counted = Counted(batch.column(c), b)
                n = len(counted.names)
                df, total = np.zeros(n * parts, np.int64), np.zeros(n * parts, np.int64)
                for row, term, tf in counted.slices():
                    at = term + of[row] * n
                    df += np.bincount(at, minlength=n * parts)
                    total += np.bincount(at, tf, n * parts).astype(np.int64)
                df, total = df.reshape(parts, n), total.reshape(parts, n)
                told = range(len(folds)) if folds is not None else range(1)
                names = [f"_{f}" for f in folds] if folds is not None else [""]
                columns = [pa.array([b]).take(pa.array(np.zeros(n, np.int64))), counted.names, *[pa.array(x[k]) for x in (df, total) for k in told]]
                yield pa.RecordBatch.from_arrays(columns, ["block", "term", *[f"{x}{s}" for x in ("df", "total") for s in names]])

    return run


def counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc, cut) to (doc, term, tf), cut a list of terms."""
    for batch in batches:
        lists = batch.column(1)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        key = np.sort(row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False))
        start = _starts(key)
        row, term = np.divmod(key[start], max(len(coded.dictionary), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(term)), pa.array(np.diff(np.append(start, len(key))))], ["doc", "term", "tf"])


def numbered(counted: Counted, terms: pa.Array, numbers: np.ndarray) -> np.ndarray:
    """Of each of the batch's terms the number that it has among terms, -1 for others."""
    at = pc.fill_null(pc.index_in(counted.names, value_set=terms), -1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, numbers[at], -1) if len(numbers) else np.full(len(at), -1)


def weighed(block: str, told) -> Callable:
    """Batches (doc, cut) to (doc, term, value): sublinear tf times idf, unit length.  told: a broadcast of the vocabulary's terms and idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = pa.array(told.value[0], pa.string()), told.value[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            counted = Counted(batch.column(1), block)
            for row, term, tf in counted.slices(numbered(counted, terms, np.arange(len(idf)))):
                w = (1 + np.log(tf)) * idf[term]
                length = np.sqrt(np.bincount(row, w * w, batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.take(pa.array(term)), pa.array(w / length[row])], ["doc", "term", "value"])

    return run


def packed(blocks: tuple[str, ...], told) -> Callable:
    """Batches (doc, fold, label, a column a block) to (doc, fold, label, idx, val).  told: a broadcast of each block's terms and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(pa.array(terms, pa.string()), numbers) for terms, numbers in told.value]
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            n, found = batch.num_rows, [[] for _ in blocks]
            for c, (b, (terms, numbers)) in enumerate(zip(blocks, known, strict=True)):
                counted = Counted(batch.column(3 + c), b)
                found[c] = list(counted.slices(numbered(counted, terms, numbers)))
            each = np.array([sum((np.bincount(row, minlength=n) for row, _, _ in part), np.zeros(n, np.int64)) for part in found])  # blocks x rows
            ends = np.concatenate(([0], np.cumsum(each.sum(0))))
            idx, tf = np.zeros(ends[-1], np.int32), np.zeros(ends[-1])
            for c, part in enumerate(found):  # ordered by row and number, and a block's numbers are over those of the blocks before
                at = _runs(ends[:-1] + each[:c].sum(0), each[c])
                a = 0
                for _, term, times in part:
                    own = at[a : a + len(term)]
                    idx[own], tf[own] = term, times
                    a += len(term)
            ends = pa.array(ends, pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(idx)), pa.ListArray.from_arrays(ends, pa.array(1 + np.log(tf)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc", "fold", "label", "idx", "val"])

    return run
