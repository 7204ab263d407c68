"""Operator 6: quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are
compared with those of language references by Jensen-Shannon distance; a document
that lies far from every reference is rejected.  The references are sums over all
documents of a language that are not full of symbols: classes of all bytes, and words
hashed to a fixed number of bins of which the heaviest are the common words.  A histogram of
few draws lies far from any reference by chance alone, so either rule speaks only
from a minimum length on, and the distance allowed falls with the length.  A document
in a language too rare for a reference is not rejected for its distance from others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hash_words, materialize, mix, small_batches, table, text_slices

#: Classes of bytes: white space, lower case, upper case, digits, sentence marks, other marks, symbols, non-ASCII lead bytes, continuation bytes and controls.
CLASSES = ("space", "lower", "upper", "digit", "sentence", "mark", "symbol", "beyond", "rest")
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 8, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x21:0x7F] = 5
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[list(b".,;:!?'\"")] = 4
_CLASS[list(SYMBOLS)] = 6
_CLASS[0xC0:] = 7
WORD_BINS = 8192


class Rules(NamedTuple):
    """Documented limits of the verdict."""

    common: int = 128  # heaviest word bins of a language that make its common words
    least_chars: int = 200  # bytes from which the character rule speaks
    least_words: int = 60  # words from which the word rule speaks
    char_distance: float = 0.13  # allowed of an endless text
    char_slack: float = 1.6  # allowed beside it, over the square root of the bytes
    word_distance: float = 0.25
    word_slack: float = 2.0  # over the square root of the words
    min_share: float = 0.005  # of all documents that a language needs for a reference; the distance rules are silent on a language without one
    clean_symbols: float = 0.02  # share of symbols up to which a document counts for its reference


class Measured(NamedTuple):
    classes: np.ndarray  # documents x CLASSES
    words: object  # hashed words, one slice
    lines: np.ndarray  # n_dup_lines
    repeats: np.ndarray  # n_repeat_words
    chars: np.ndarray  # word_chars


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def measure(buf: np.ndarray, offsets: np.ndarray) -> Measured:
    w = hash_words(buf, offsets, lower=False)
    docs = len(offsets) - 1
    cls = _CLASS[buf]
    doc_of_byte = np.repeat(np.arange(docs, dtype=np.int64) * len(CLASSES), np.diff(offsets))
    classes = np.bincount(doc_of_byte + cls, minlength=docs * len(CLASSES)).reshape(docs, len(CLASSES))
    chars = _per_doc((cls != 0) & ((buf & 0xC0) != 0x80), offsets)
    # lines: cut at \n and where a document ends; those without a word do not count
    breaks = np.flatnonzero(buf == 0x0A)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < len(buf)]
    stop = np.searchsorted(breaks, start)
    end = np.append(breaks, len(buf))[stop]
    doc_of_line = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(end, offsets[doc_of_line + 1])
    held = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc_of_line = start[held], end[held], doc_of_line[held]
    line = w.spans(start, end)
    order = np.lexsort((line, doc_of_line))
    same = (line[order][1:] == line[order][:-1]) & (doc_of_line[order][1:] == doc_of_line[order][:-1])
    lines = np.bincount(doc_of_line[order][1:][same], minlength=docs)
    # 8-word windows found twice or more in a text
    n = len(w.hashes)
    count = np.diff(w.first)
    repeats = np.zeros(docs, np.int64)
    if n >= 8:
        doc_of_word = np.repeat(np.arange(docs), count)
        rolled = np.zeros(n - 7, np.uint64)
        for k in range(8):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + w.hashes[k : n - 7 + k]
        inside = np.flatnonzero(doc_of_word[7:] == doc_of_word[:-7])
        key = mix(rolled[inside] + doc_of_word[inside].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, inside[twice], 1)
        np.add.at(depth, inside[twice] + 8, -1)
        repeats = _per_doc(np.cumsum(depth[:-1]) > 0, w.first)
    return Measured(classes, w, lines, repeats, chars)


def word_bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % WORD_BINS


def _sums(batches, clean: float) -> Iterator[pa.RecordBatch]:
    total: dict[str | None, np.ndarray] = {}
    for batch in batches:
        lang = np.array([x or "" for x in batch.column(0).to_pylist()], object)
        for i, j, buf, offsets in text_slices(batch.column(1)):
            w = hash_words(buf, offsets, lower=True)
            cls = _CLASS[buf]
            langs, code = np.unique(lang[i:j].astype(str), return_inverse=True)
            size, count = np.diff(offsets), np.diff(w.first)
            fine = _per_doc(cls == CLASSES.index("symbol"), offsets) <= clean * size
            by_byte = np.repeat(code, size)
            by_word = np.repeat(code, count)
            c = np.bincount(by_byte * len(CLASSES) + cls, np.repeat(fine, size), minlength=len(langs) * len(CLASSES)).reshape(len(langs), -1).astype(np.int64)
            b = np.bincount(by_word * WORD_BINS + word_bins(w.hashes), np.repeat(fine, count), minlength=len(langs) * WORD_BINS).reshape(len(langs), -1).astype(np.int64)
            d = np.bincount(code, minlength=len(langs))
            for k, name in enumerate(langs.tolist()):
                row = np.concatenate((c[k], b[k], d[k : k + 1]))
                total[name] = total[name] + row if name in total else row
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bin", "n"])


class Reference(NamedTuple):
    lang: str
    classes: np.ndarray  # shares
    bins: np.ndarray  # the common words' bins
    words: np.ndarray  # shares of those and, last, of all other words


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> list[Reference]:
    """References of the languages that hold min_share of the documents; a null language is one of its own.

    Languages beyond that share are at most 1 / min_share, each of which brings
    WORD_BINS numbers to the driver.
    """
    small_batches(docs.sparkSession)
    sums = docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(lambda batches: _sums(batches, rules.clean_symbols), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "references")
    last = len(CLASSES) + WORD_BINS
    total = sums.where(F.col("bin") == last).agg(F.sum("n")).first()[0]
    if not total:
        return []
    large = [r["lang"] for r in sums.where((F.col("bin") == last) & (F.col("n") >= rules.min_share * total)).collect()]
    rows = {lang: np.zeros(last + 1) for lang in large}
    for r in sums.where(F.col("lang").isin(large)).collect():
        rows[r["lang"]][r["bin"]] = r["n"]
    out = []
    for lang, row in sorted(rows.items()):
        words = row[len(CLASSES) : last]
        if not words.sum():
            continue
        bins = np.sort(np.argsort(-words, kind="stable")[: rules.common])
        share = words[bins] / words.sum()
        out.append(Reference(lang, row[: len(CLASSES)] / row[: len(CLASSES)].sum(), bins, np.append(share, max(0.0, 1 - share.sum()))))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of rows of shares p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        return np.sqrt(np.maximum(0, (kl(p) + kl(np.broadcast_to(q, p.shape))) / 2))


def distances(m: Measured, references: list[Reference]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest character and word distance of each document; 0 where there is nothing to compare."""
    docs = len(m.classes)
    size, count = m.classes.sum(1), np.diff(m.words.first)
    char, word = np.full(docs, np.inf), np.full(docs, np.inf)
    lowered = hash_words(m.words.buf, m.words.offsets, lower=True).hashes
    bins, doc_of_word = word_bins(lowered), np.repeat(np.arange(docs), count)
    for ref in references:
        char = np.minimum(char, js_distance(m.classes / np.maximum(size, 1)[:, None], ref.classes))
        place = np.full(WORD_BINS, len(ref.bins))
        place[ref.bins] = np.arange(len(ref.bins))
        width = len(ref.bins) + 1
        have = np.bincount(doc_of_word * width + place[bins], minlength=docs * width).reshape(docs, width)
        word = np.minimum(word, js_distance(have / np.maximum(count, 1)[:, None], ref.words))
    none = not references
    return np.where((size == 0) | none, 0, char), np.where((count == 0) | none, 0, word)


_OUT = "doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _verdicts(column: pa.Array, langs: pa.Array, references: list[Reference], rules: Rules) -> list[np.ndarray]:
    """The columns of _OUT but the id, for columns of texts and of their languages."""
    parts, names = [], {r.lang for r in references}
    known = np.array([(x or "") in names for x in langs.to_pylist()], bool)
    for i, j, buf, offsets in text_slices(column):
        m = measure(buf, offsets)
        size, n = m.classes.sum(1), np.diff(m.words.first)
        char, word = distances(m, references)
        far = (size >= rules.least_chars) & (char > rules.char_distance + rules.char_slack / np.sqrt(np.maximum(size, 1)))
        far |= (n >= rules.least_words) & (word > rules.word_distance + rules.word_slack / np.sqrt(np.maximum(n, 1)))
        far &= known[i:j]
        failed = (n < 20) | (100 * m.repeats > 30 * n)
        parts.append((n, m.chars, m.classes[:, CLASSES.index("symbol")], m.lines, m.repeats, failed, ~failed & ~far, char, word))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _judge(references: list[Reference], rules: Rules):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = _verdicts(batch.column(1), batch.column(2), references, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [x.split()[0] for x in _OUT.split(", ")])

    return run


def _keep(references: list[Reference], rules: Rules, at: int, lang: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_verdicts(batch.column(at), batch.column(lang).cast(pa.string()), references, rules)[6]))

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """A row of counts, distances and the verdict for each row.

    A null, empty or blank text has no words, distances of 0, and fails the base
    rule.  A document is held against every reference, whatever its own language is
    said to be; where that language has none, the distances are given but do not
    reject.  Repeated rows are judged each by itself; a null id stays; other
    columns are ignored; no rows give no rows.
    """
    references = language_references(docs, text_col, lang_col, rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(_judge(references, rules), _OUT.format(rows.schema["doc_id"].dataType.simpleString()))


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with all columns; no row is shuffled."""
    references = language_references(docs, text_col, lang_col, rules)
    return docs.mapInArrow(_keep(references, rules, docs.columns.index(text_col), docs.columns.index(lang_col)), docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances and the verdict of every whole document; a null text has no words and fails."""
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
